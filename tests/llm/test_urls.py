from __future__ import annotations

import random

import pytest

from seqharbor.llm import urls

RULES = [
    ("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"),
    ("com", "/de/", "block"), ("a.com", "/", "block"), ("a.com", "/x", "allow"), ("a.com", "/x/y", "block"), ("b.a.com", "", "allow"),
]


def brute(url, rules, default="allow"):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut:]
        path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
    best = None
    for h, p, v in rules:
        if (host == h or host.endswith("." + h)) and path.startswith(p):
            key = (len(h + p), len(h), v == "block")
            if best is None or key > best[0]:
                best = (key, h + p, v)
    return (host, path, best[1], best[2]) if best else (host, path, None, default)


def sample(n, seed=1):
    rng = random.Random(seed)
    hosts = ["org", "example.org", "x.example.org", "notexample.org", "a.com", "b.a.com", "c.b.a.com", "ba.com", "com", "org.com", "EXAMPLE.org", "org.", ".org", "a..org", "org-x.com", ""]
    paths = ["", "/", "/es/", "/es", "/en/1", "/en/12/x", "/fr/", "/de/q", "/x", "/x/y/z", "/xy", "?q=/fr/", "#/es/", "/é/", "//", "/fr/://b"]
    rows = [(i, f"{rng.choice(['http', 'HTTPS', ''])}://{rng.choice(hosts)}{rng.choice(paths)}{rng.choice(['', '?a=1', '#t'])}") for i in range(n)]
    hot = [(n + i, "http://hot.example.org/es/same") for i in range(n // 2)]
    return rows + hot + [(-1, None), (-2, "no mark"), (-3, ""), (None, "http://org/"), (-4, "http://a.com/" + "y" * 100000), (1, "x://org/z"), (-5, "http://org\n/a\nb")]


@pytest.mark.parametrize("parts", [1, 4])
def test_verdicts_match_brute_force(spark, parts, monkeypatch):
    monkeypatch.setattr(urls, "BINS_PER_PARTITION", 16 * parts)
    pages = sample(400)
    frame = spark.createDataFrame([(*r, "x", 1) for r in pages], "page_id int, url string, host string, bin int").repartition(3)
    extra = [*RULES, ("com", "/fr/", "block"), (None, "/", "block"), ("net", None, "block")]
    got = urls.judge_urls(frame, spark.createDataFrame(extra, "host string, path string, verdict string")).collect()
    known = [r for r in extra if None not in r]
    assert sorted([tuple(r) for r in got], key=repr) == sorted([(i, *brute(u, known)) for i, u in pages], key=repr)


def test_many_rules(spark):
    rng = random.Random(5)
    rules = list({(".".join(rng.choices("abc", k=rng.randint(1, 4))), "/" + "".join(rng.choices("xy/", k=rng.randint(0, 4)))): rng.choice(["allow", "block"]) for _ in range(300)}.items())
    rules = [(h, p, v) for (h, p), v in rules]
    pages = [(i, "u://" + ".".join(rng.choices("abcd", k=rng.randint(1, 5))) + "/" + "".join(rng.choices("xy/z", k=rng.randint(0, 6)))) for i in range(500)]
    got = urls.judge_urls(spark.createDataFrame(pages, "page_id int, url string"), spark.createDataFrame(rules, "host string, path string, verdict string"), "block")
    found = {r.page_id: tuple(r)[1:] for r in got.collect()}
    assert found == {i: brute(u, rules, "block") for i, u in pages}


def test_empty_tables(spark):
    none = spark.createDataFrame([], "page_id int, url string")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    assert urls.judge_urls(none, rules).count() == 0
    one = spark.createDataFrame([(1, "http://org/")], "page_id int, url string")
    assert tuple(urls.judge_urls(one, rules.limit(0)).first()) == (1, "org", "/", None, "allow")
