"""License scans: ordered signature rules behind keyword filters, in DataFrame functions only.

A rule is a pattern over words with a keyword that must stand in the text before the pattern is
tried (a whole word, or a part of one), a tier (0 says most) and a label. Every place of every rule is found; a place inside
another one of an equal or better tier is suppressed, so that the most telling statement is left.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from .common import free_prefix

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"  # between words
OPEN, CLOSE = "\x01", "\x02"  # no word holds them
FOLDED = 512  # places folded into one piece of the result

#: how sure a rule of each tier is that its text is under a license
CERTAINTY = (0.98, 0.9, 0.85, 0.7, 0.5)
GRANT, PLAIN_GRANT, VERSIONED, NAMED, HINT = range(5)

#: phrases whose places are counted as they stand, with their labels
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

# A pattern is a row of words, each a regular expression; {in braces} optional words, .. up to four of any kind.
# label | keyword, with * where it may be a part of a word | name | versions
FAMILIES = """
apache | apache | apache {software} licen[cs]e | 1.0 1.1 2.0
mit | licen* | (mit|expat|x11) licen[cs]e |
bsd | bsd | bsd {style} {(licen[cs]e|licen[cs]es)} |
bsd-2-clause | bsd | (bsd 2 clause|2 clause bsd|simplified bsd|freebsd) {licen[cs]e} |
bsd-3-clause | bsd | (bsd 3 clause|3 clause bsd|modified bsd|new bsd|revised bsd) {licen[cs]e} |
bsd-4-clause | bsd | (bsd 4 clause|4 clause bsd|original bsd) {licen[cs]e} |
0bsd | bsd | (0bsd|zero clause bsd|bsd zero clause) {licen[cs]e} |
gpl | general | {gnu} general public licen[cs]e | 1.0 2.0 3.0
gpl | gpl* | {gnu} gpl | 1.0 2.0 3.0
lgpl | lesser | {gnu} lesser general public licen[cs]e | 2.1 3.0
lgpl | library | {gnu} library general public licen[cs]e | 2.0
lgpl | lgpl* | {gnu} lgpl | 2.0 2.1 3.0
agpl | affero | {gnu} affero general public licen[cs]e | 1.0 3.0
agpl | agpl* | {gnu} agpl | 1.0 3.0
gfdl | documentation | {gnu} free documentation licen[cs]e | 1.1 1.2 1.3
gfdl | gfdl* | {gnu} gfdl | 1.1 1.2 1.3
mpl | mozilla | mozilla public licen[cs]e | 1.0 1.1 2.0
mpl | mpl* | mpl | 1.0 1.1 2.0
epl | eclipse | eclipse public licen[cs]e | 1.0 2.0
edl | eclipse | eclipse distribution licen[cs]e | 1.0
cddl | development | common development and distribution licen[cs]e | 1.0 1.1
cddl | cddl* | cddl | 1.0 1.1
cpl | common | common public licen[cs]e | 1.0
eupl | european | european union public licen[cs]e | 1.0 1.1 1.2
eupl | eupl* | eupl | 1.0 1.1 1.2
cecill | cecill | cecill {licen[cs]e} | 1.0 2.0 2.1
osl | open | open software licen[cs]e | 1.0 2.0 2.1 3.0
afl | academic | academic free licen[cs]e | 1.1 1.2 2.0 2.1 3.0
artistic | artistic | artistic licen[cs]e | 1.0 2.0
bsl | boost | boost software licen[cs]e | 1.0
busl | business | business source licen[cs]e | 1.1
sspl | server | server side public licen[cs]e | 1.0
elastic | elastic | elastic licen[cs]e | 1.0 2.0
zlib | zlib | (zlib|zlib libpng) licen[cs]e |
libpng | libpng | libpng licen[cs]e | 2.0
isc | licen* | isc licen[cs]e |
openssl | openssl | openssl licen[cs]e |
python | python | (python|psf|python software foundation) licen[cs]e | 2.0
php | php | php licen[cs]e | 3.0 3.01
ruby | ruby | ruby licen[cs]e |
perl | perl | same terms as perl {itself} |
postgresql | postgresql | postgresql licen[cs]e |
unlicense | unlicen* | (the unlicense|unlicense) |
wtfpl | wtfpl* | wtfpl | 2.0
wtfpl | fuck | do what the fuck you want to {public} licen[cs]e | 2.0
cc0 | cc0 | cc0 | 1.0
cc0 | zero | (creative commons zero|cc zero) | 1.0
pddl | dedication | public domain dedication and licen[cs]e | 1.0
odbl | database | open (database|data commons open database) licen[cs]e | 1.0
odc-by | commons | open data commons attribution licen[cs]e | 1.0
ogl | government | open government licen[cs]e | 1.0 2.0 3.0
ofl | font | {sil} open font licen[cs]e | 1.0 1.1
lppl | latex | latex project public licen[cs]e | 1.0 1.1 1.2 1.3
ncsa | ncsa | (ncsa|university of illinois ncsa) {open} {source} licen[cs]e |
ms-pl | microsoft | microsoft public licen[cs]e |
ms-rl | microsoft | microsoft reciprocal licen[cs]e |
upl | universal | universal permissive licen[cs]e | 1.0
vim | licen* | vim licen[cs]e |
w3c | w3c | w3c {software} {notice} {and} licen[cs]e |
beerware | beer | beer ware {licen[cs]e} |
json | licen* | json licen[cs]e |
llama | llama | llama {[0-9]+} community licen[cs]e |
openrail | rail | (openrail|open rail|openrail m|bigscience rail) {licen[cs]e} |
"""

#: Creative Commons terms: every one with every version, written out or in letters
COMMONS = {
    "by": "attribution",
    "by-sa": "attribution (share alike|sharealike)",
    "by-nd": "attribution (no derivatives|no derivs|noderivatives|noderivs)",
    "by-nc": "attribution (non commercial|noncommercial)",
    "by-nc-sa": "attribution (non commercial|noncommercial) (share alike|sharealike)",
    "by-nc-nd": "attribution (non commercial|noncommercial) (no derivatives|no derivs|noderivatives|noderivs)",
}
COMMONS_VERSIONS = "1.0 2.0 2.5 3.0 4.0"

# label | keyword | pattern: statements that name no license
HINTS = """
reserved | reserved | all rights {are} reserved
some-rights | reserved | some rights reserved
no-rights | reserved | no rights reserved
rights | derechos | todos los derechos reservados
rights | droits | tous droits (réservés|reserves)
rights | rechte | alle rechte vorbehalten
copyright | copyright | copyright {c} {by} [12][0-9]{3}
copyright | copyright | copyright (c|holder|holders|owner|notice)
public-domain | domain | (in|into|to) the public domain
public-domain | domain | public domain (work|mark|dedication|notice)
proprietary | proprietary | proprietary (and|or) confidential
proprietary | proprietary | (proprietary|commercial) licen[cs]e
proprietary | reproduc* | no part of .. may be reproduced
proprietary | permission | without .. (prior|express|written) {written} permission
permission | permission | permission is hereby granted {free} {of} {charge}
permission | permission | permission to use copy modify {and} {or} distribute
permission | redistribut* | redistribution and use in source and binary forms
permission | redistribut* | you (may|can) redistribute it {and} {or} modify it
no-warranty | warrant* | without (warranty|warranties) of any kind
no-warranty | warrant* | without any (warranty|warranties)
terms | terms | terms of (use|service) apply
noncommercial | commercial | (for|only) .. (non commercial|noncommercial) (use|purposes)
licensed | licen* | licen[cs]ed (under|by|to)
licensed | licen* | (end user|site|open source|free software|source code) licen[cs]e {agreement}
"""

GRANTS = "(licen[cs]ed|released|distributed|available|published|provided|offered|covered|governed|redistributed)"


@dataclass(frozen=True)
class Rule:
    """All strings are sought in a text in which every word stands as `` word ``; ``also`` is a second keyword."""

    label: str
    keyword: str
    pattern: str
    tier: int
    also: str = ""


def word_pattern(text: str) -> str:
    """The notation above as a regular expression; a bracket may list words or rows of words."""
    out = []
    for part in re.findall(r"\{[^}]*\}|\([^)]*\)|\S+", text):
        if part == "..":
            out.append("(?: [^ ]+ ){0,4}?")
        elif part.startswith("{"):
            out.append(f"(?:{word_pattern(part[1:-1])})?")
        elif part.startswith("("):
            out.append(f" (?:{part[1:-1].replace(' ', '  ')}) ")
        else:
            out.append(f" (?:{part}) ")
    return "".join(out)


def _keyword(text: str) -> str:
    return text[:-1] if text.endswith("*") else f" {text} "


def _versioned(name: str, keyword: str, number: str) -> list[str]:
    """A name before a version; short names may also be one word with it."""
    major, minor = number.split(".")
    rest = "{0}" if minor == "0" else minor
    forms = [f"{name} {{(version|ver|v)}} v?{major} {rest}"]
    if keyword.endswith("*") and name.endswith(keyword[:-1]):
        forms.append(f"{name}v?{major} {rest}")
    return forms


def family_rules(label: str, keyword: str, name: str, versions: str = "") -> list[Rule]:
    """Grants before bare names, names with a version before those without."""
    named = [
        (f"{label}-{number}", form, GRANT, VERSIONED)
        for number in versions.split()
        for form in _versioned(name, keyword, number)
    ]
    named.append((label, name, PLAIN_GRANT if versions else GRANT, NAMED))
    rules = []
    for full, pattern, granted, plain in named:
        rules.append(Rule(full, _keyword(keyword), word_pattern(f"{GRANTS} .. under .. {pattern}"), granted, " under "))
        rules.append(Rule(full, _keyword(keyword), word_pattern(pattern), plain))
    return rules


def _identifier_rules(labels: list[str]) -> list[Rule]:
    """Machine-readable tags: the words of the label behind the tag's name."""
    words = {label: re.sub(r"[^a-z0-9]+", " ", label) for label in labels}
    return [Rule(x, " spdx ", word_pattern(f"spdx licen[cs]e identifier {w}"), GRANT) for x, w in words.items()]


def _rows(text: str) -> list[list[str]]:
    """The lines of a table; a bar inside brackets does not part columns."""
    return [[part.strip() for part in re.split(r" \| | \|$", line)] for line in text.strip().splitlines()]


def signature_rules() -> list[Rule]:
    """All rules in their order: families, Creative Commons, tags, hints."""
    rules = [rule for row in _rows(FAMILIES) for rule in family_rules(*row)]
    for terms, name in COMMONS.items():
        written = (("cc", f"cc {terms.replace('-', ' ')}"), ("commons", f"creative commons {name}"))
        for keyword, pattern in written:
            rules += family_rules(f"cc-{terms}", keyword, pattern, COMMONS_VERSIONS)
    rules += _identifier_rules(list(dict.fromkeys(r.label for r in rules)))
    rules += [Rule(label, _keyword(keyword), word_pattern(pattern), HINT) for label, keyword, pattern in _rows(HINTS)]
    return list(dict.fromkeys(rules))


RULES = tuple(signature_rules())


def _rule_array(rules: tuple[Rule, ...]) -> Column:
    """The rules as a constant column (some hundred rows that the program itself holds)."""
    rows = [
        {"keyword": r.keyword, "also": r.also or r.keyword, "pattern": f"({r.pattern})", "tier": r.tier, "rule": i, "label": r.label}
        for i, r in enumerate(rules)
    ]
    return F.from_json(F.lit(json.dumps(rows)), "array<struct<keyword:string,also:string,pattern:string,tier:int,rule:int,label:string>>")


def _word_places(words: Column, phrase: str) -> Column:
    """Starts of a phrase in an array of words."""
    parts = phrase.split(" ")

    def here(i: Column) -> Column:
        same = F.get(words, i) == parts[0]
        for k, part in enumerate(parts[1:], 1):
            same = same & (F.get(words, i + k) == part)
        return same

    starts = F.sequence(F.lit(0), F.size(words) - F.lit(len(parts)))
    return F.filter(starts, lambda i: here(i))


def _labelled(starts: Column, label: str) -> Column:
    return F.transform(starts, lambda i: F.struct(i.alias("start"), F.lit(label).alias("label")))


def _rule_places(line: Column, rule: Column) -> Column:
    """(start, minus end, tier, rule, label) of the places of one rule.

    Each place is enclosed in two marks that are words of their own; the k-th pair has 2k marks
    before it, so that a mark's position says which word it stands at.
    """
    marked = F.regexp_replace(line, rule["pattern"], F.lit(f" {OPEN} $1 {CLOSE} "))
    words = F.split(F.substring(marked, F.lit(2), F.length(marked) - F.lit(2)), "  ")

    def marks(mark: str, offset: int) -> Column:
        at = F.filter(F.transform(words, lambda w, i: F.when(w == mark, i)), lambda i: i.isNotNull())
        return F.transform(at, lambda i, k: i - k * F.lit(2) - F.lit(offset))

    pairs = F.arrays_zip(marks(OPEN, 0).alias("a"), marks(CLOSE, 1).alias("b"))
    return F.transform(
        pairs,
        lambda p: F.struct(
            p["a"].alias("start"), (-p["b"]).alias("minus_end"), rule["tier"].alias("tier"),
            rule["rule"].alias("rule"), rule["label"].alias("label"),
        ),
    )


def _unsuppressed(places: Column) -> Column:
    """Of ordered places those that no other place of an equal or better tier contains.

    In their order, by start, longest first, then tier and rule, whatever contains a place stands
    before it: the farthest end up to each tier decides. Pieces of ``FOLDED`` keep the fold linear.
    """
    kind = "array<struct<start:int,minus_end:int,tier:int,rule:int,label:string>>"
    none = F.array().cast(kind)
    tiers = len(CERTAINTY)

    def one(state: Column, p: Column) -> Column:
        end = -p["minus_end"]
        hidden = F.get(state["ends"], p["tier"]) >= end
        ends = F.transform(state["ends"], lambda x, t: F.when((t >= p["tier"]) & (x < end), end).otherwise(x))
        kept = F.when(hidden, state["kept"]).otherwise(F.concat(state["kept"], F.array(p)))
        return F.struct(ends.alias("ends"), kept.alias("kept"))

    def piece(state: Column, part: Column) -> Column:
        start = F.struct(state["ends"].alias("ends"), none.alias("kept"))
        done = F.aggregate(part, start, one)
        grown = F.transform(F.array(done), lambda d: F.struct(
            d["ends"].alias("ends"), F.concat(state["kept"], F.array(d["kept"])).alias("kept")))
        return F.get(grown, F.lit(0))

    parts = F.transform(
        F.sequence(F.lit(0), F.floor((F.size(places) - 1) / FOLDED).cast("int")),
        lambda i: F.slice(places, i * FOLDED + 1, F.lit(FOLDED)),
    )
    begin = F.struct(F.array_repeat(F.lit(-1), tiers).alias("ends"), F.array().cast(f"array<{kind}>").alias("kept"))
    return F.flatten(F.aggregate(parts, begin, piece)["kept"])


def scan_licenses(
    docs: DataFrame, text: str = "text", phrases=PHRASES, rules: tuple[Rule, ...] = RULES, names: str = "lic_"
) -> DataFrame:
    """``docs`` with the license statements of each whole text; nothing is shuffled.

    Adds ``words`` (long), ``places`` (start, label of every place of a phrase, by start),
    ``found`` (start, end, tier, rule, label of the rules' places that are not suppressed, end excluded,
    by start) and ``score``, the best certainty among them, 0 without any; all behind ``names``, and
    columns of ``docs`` that start so are replaced. Upper case A-Z is lower-cased; a null text is empty.
    Rows are judged one by one: repeated rows and null or repeated ids stay as they are.
    """
    lead = free_prefix(docs, "scan_")
    kept = docs.select(*[F.col(f"`{c}`") for c in docs.columns if not c.startswith(names)])
    low, words, line, places, found, keys_held = (
        f"{lead}{c}" for c in ("low", "words", "line", "places", "found", "keys")
    )
    base = F.translate(F.coalesce(F.col(f"`{text}`"), F.lit("")), UPPER, LOWER)
    parts = F.split(F.col(low), BREAK, -1)
    out = kept.withColumn(low, base).withColumn(words, F.filter(parts, lambda w: w != ""))
    # keywords that the text holds; texts without any go no further
    sought = dict.fromkeys([k for r in rules for k in (r.keyword, r.also) if k] + [f" {max(p.split(' '), key=len)} " for p, _ in phrases])
    whole = F.array(*[F.lit(k.strip()) for k in sought if k.startswith(" ")])
    inside = [F.when(F.contains(F.col(low), F.lit(k)), F.lit(k)) for k in sought if not k.startswith(" ")]
    held = F.concat(
        F.transform(F.array_intersect(whole, F.col(words)), lambda w: F.concat(F.lit(" "), w, F.lit(" "))),
        F.array_compact(F.array(F.lit(None).cast("string"), *inside)),
    )
    out = out.withColumn(keys_held, held)
    spaced = F.concat(F.lit(" "), F.array_join(words, "  "), F.lit(" "))
    out = out.withColumn(line, F.when(F.size(keys_held) > 0, spaced))
    kind = "array<struct<start:int,label:string>>"
    none = F.array().cast(kind)
    of_phrases = [
        F.when(
            F.contains(F.col(line), F.lit(" " + p.replace(" ", "  ") + " ")),
            _labelled(_word_places(F.col(words), p), label),
        ).otherwise(none)
        for p, label in phrases
    ]
    tried = F.filter(
        _rule_array(rules),
        lambda r: F.array_contains(F.col(keys_held), r["keyword"])
        & F.array_contains(F.col(keys_held), r["also"])
        & F.rlike(F.col(line), r["pattern"]),
    )
    raw = F.flatten(F.transform(tried, lambda r: _rule_places(F.col(line), r)))
    wide = "array<struct<start:int,minus_end:int,tier:int,rule:int,label:string>>"
    out = out.withColumn(places, F.when(F.col(line).isNull(), none).otherwise(F.array_sort(F.concat(none, *of_phrases))))
    out = out.withColumn(found, F.when(F.size(keys_held) > 0, F.array_sort(raw)).otherwise(F.array().cast(wide)))
    out = out.withColumn(found, F.when(F.size(found) > 0, _unsuppressed(F.col(found))).otherwise(F.col(found)))
    sure = F.array(*[F.lit(x) for x in CERTAINTY])
    best = F.array_max(F.transform(found, lambda p: F.get(sure, p["tier"])))
    plain = F.when(F.size(places) > 0, F.lit(CERTAINTY[HINT])).otherwise(F.lit(0.0))
    shown = F.transform(found, lambda p: F.struct(
        p["start"].alias("start"), (-p["minus_end"]).alias("end"), p["tier"].alias("tier"),
        p["rule"].alias("rule"), p["label"].alias("label")))
    return out.select(
        *[F.col(f"`{c}`") for c in kept.columns],
        F.size(words).cast("long").alias(f"{names}words"),
        F.col(places).alias(f"{names}places"),
        shown.alias(f"{names}found"),
        F.greatest(F.coalesce(best, F.lit(0.0)), plain).alias(f"{names}score"),
    )


def license_digest(docs: DataFrame, names: str = "lic_") -> DataFrame:
    """One row per document: counts, first and last place of the phrases, labels, score."""
    places, found = F.col(f"{names}places"), F.col(f"{names}found")
    of = lambda rows: F.transform(rows, lambda p: p["label"])
    said = lambda rows: F.array_join(F.array_sort(F.array_distinct(rows)), ",")
    starts = F.transform(places, lambda p: p["start"].cast("long"))
    return docs.select(
        "doc_id",
        F.col(f"{names}words").alias("n_words"),
        F.size(places).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        said(of(places)).alias("base_labels"),
        said(F.concat(of(places), of(found))).alias("labels"),
        F.col(f"{names}score").alias("score"),
    )
