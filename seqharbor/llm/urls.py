"""URL rules by a sort-merge range join: reversed hosts turn rules into intervals, a sweep keeps the open ones."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_type

from .common import bounded

SAMPLE_ROWS = 20_000
BINS_PER_PARTITION = 8
_REST = re.compile(r"([^/?#]*)([^?#]*)")
_LOWER = {c: c + 32 for c in range(65, 91)}


def host_and_path(url: str | None) -> tuple[str, str]:
    """The host, A-Z lower-cased, and the path of a url; both empty without ``://``."""
    _, mark, rest = (url or "").partition("://")
    found = _REST.match(rest)
    return (found[1].translate(_LOWER), found[2]) if mark else ("", "")


def host_key(host: str) -> str:
    """The labels in reverse, each closed by a dot: a host and its subdomains share the prefix."""
    return ".".join(reversed(host.split("."))) + "."


class HostRules:
    """The path rules of one host in path order, each with the rule it is nested in."""

    def __init__(self, key: str, host: str):
        self.key, self.host = key, host
        self.paths: list[str] = []
        self.verdicts: list[str] = []
        self.outer: list[int] = []

    def add(self, path: str, verdict: str) -> None:
        if self.paths and self.paths[-1] == path:  # equal rules: block wins
            self.verdicts[-1] = min(self.verdicts[-1], verdict, key=lambda v: v != "block")
            return
        at = len(self.paths) - 1
        while at >= 0 and not path.startswith(self.paths[at]):
            at = self.outer[at]
        self.paths.append(path)
        self.verdicts.append(verdict)
        self.outer.append(at)

    def longest(self, path: str) -> int:
        at = bisect_right(self.paths, path) - 1
        while at >= 0 and not path.startswith(self.paths[at]):
            at = self.outer[at]
        return at


class Sweep:
    """Rules and urls in key order; the stack holds the hosts whose interval is open."""

    def __init__(self, default: str):
        self.default, self.stack, self.bin = default, [], None

    def _close(self, number: int, key: str) -> None:
        if number != self.bin:
            self.bin = number
            self.stack.clear()
        while self.stack and not key.startswith(self.stack[-1].key):
            self.stack.pop()

    def rule(self, number: int, key: str, host: str, path: str, verdict: str) -> None:
        self._close(number, key)
        if not self.stack or self.stack[-1].key != key:
            self.stack.append(HostRules(key, host))
        self.stack[-1].add(path, verdict)

    def judge(self, number: int, key: str, path: str) -> tuple[str | None, str]:
        self._close(number, key)
        best, text, verdict = -1, None, self.default
        for rules in reversed(self.stack):
            at = rules.longest(path)
            if at >= 0 and len(rules.host) + len(rules.paths[at]) > best:
                text, verdict = rules.host + rules.paths[at], rules.verdicts[at]
                best = len(text)
        return text, verdict


def judge_urls(
    pages: DataFrame, rules: DataFrame, default: str = "allow", key: str = "page_id", url: str = "url"
) -> DataFrame:
    """(key, host, path, rule, verdict), a row for each row of ``pages``.

    ``rules`` has host, path and verdict (allow or block). A rule fits its host and all
    subdomains if the url's path starts with the rule's; of those that fit the longest text wins,
    of two as long the longer host's. Without one, and for a null url or one without ``://``
    (host and path empty), rule is null and the verdict is ``default``. Rules with a null part
    are left out. Further columns are not read.

    Urls and rules meet in bins of the sorted key space, cut at quantiles of a bounded sample of
    keys. A key that fills several bins is dealt over all of them, and a rule goes to every bin
    that its interval touches, so a hot host or a hot url is no task of its own. A task streams
    its bins in key order and holds no more than the rules of the hosts that are open.
    """
    spark = bounded(pages.sparkSession)
    total = pages.count()
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    share = min(1.0, SAMPLE_ROWS / max(total, 1))

    def keys(batches):
        for batch in batches:
            found = ["".join(_keyed(u)) for u in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.string())], names=["k"])

    sample = sorted(r[0] for r in pages.sample(share, seed=1).select(url).mapInArrow(keys, "k string").collect())
    bins = min(parts * BINS_PER_PARTITION, len(sample))
    cuts = [sample[i * len(sample) // bins] for i in range(1, bins)]

    def cut_pages(batches):
        for batch in batches:
            rows = [(*_keyed(u), *host_and_path(u)) for u in batch.column(1).to_pylist()]
            numbers = []
            for i, (k, p, *_) in enumerate(rows):
                low, high = bisect_left(cuts, k + p), bisect_right(cuts, k + p)
                numbers.append(low + i % (high - low + 1))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(numbers, pa.int32()), pa.array([r[0] for r in rows], pa.string()),
                    pa.array([1] * len(rows), pa.int32()), pa.array([r[3] for r in rows], pa.string()),
                    batch.column(0), pa.array([r[2] for r in rows], pa.string()),
                    pa.array([None] * len(rows), pa.string()),
                ],
                names=["bin", "k", "kind", "path", "id", "host", "verdict"],
            )

    def cut_rules(batches):
        for batch in batches:
            for row in batch.to_pylist():
                k = host_key(row["host"])
                for number in range(bisect_left(cuts, k), bisect_right(cuts, k[:-1] + "/") + 1):
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([number], pa.int32()), pa.array([k]), pa.array([0], pa.int32()),
                            pa.array([row["path"]]), pa.nulls(1, id_type), pa.array([row["host"]]),
                            pa.array([row["verdict"]]),
                        ],
                        names=["bin", "k", "kind", "path", "id", "host", "verdict"],
                    )

    id_type = to_arrow_type(pages.schema[key].dataType)
    kind = pages.schema[key].dataType.simpleString()
    schema = f"bin int, k string, kind int, path string, id {kind}, host string, verdict string"
    known = rules.select("host", "path", "verdict").dropna()
    both = pages.select(key, url).mapInArrow(cut_pages, schema).unionByName(known.mapInArrow(cut_rules, schema))

    def run(batches):
        sweep = Sweep(default)
        for batch in batches:
            ids, hosts, paths, texts, verdicts = [], [], [], [], []
            columns = [batch.column(i).to_pylist() for i in (0, 1, 2, 3, 5, 6)]
            for i, (number, k, rule_or_url, path, host, verdict) in enumerate(zip(*columns, strict=True)):
                if rule_or_url:
                    text, said = sweep.judge(number, k, path)
                    ids.append(i)
                    hosts.append(host)
                    paths.append(path)
                    texts.append(text)
                    verdicts.append(said)
                else:
                    sweep.rule(number, k, host, path, verdict)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(4).take(pa.array(ids, pa.int64())), pa.array(hosts, pa.string()),
                    pa.array(paths, pa.string()), pa.array(texts, pa.string()), pa.array(verdicts, pa.string()),
                ],
                names=[key, "host", "path", "rule", "verdict"],
            )

    placed = both.repartition(parts, "bin").sortWithinPartitions("bin", "k", "kind", "path")
    return placed.mapInArrow(run, f"`{key}` {kind}, host string, path string, rule string, verdict string")


def _keyed(url: str | None) -> tuple[str, str]:
    host, path = host_and_path(url)
    return host_key(host), path
