from __future__ import annotations

import random
import re

import pytest

from seqharbor.llm import licenses

ASCII = str.maketrans(licenses.UPPER, licenses.LOWER)
RULES = [(r, re.compile(r.pattern)) for r in licenses.RULES]


def brute(text):
    """Words, phrase places and unsuppressed rule places of one text, every rule tried."""
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(ASCII))
    places = sorted(
        (i, label)
        for phrase, label in licenses.PHRASES
        for i in range(len(words))
        if words[i : i + len(phrase.split())] == phrase.split()
    )
    line, spans = "".join(f" {w} " for w in words), []
    for number, (rule, pattern) in enumerate(RULES):
        if rule.keyword in line and rule.also in line:
            for m in pattern.finditer(line):
                start = line.count("  ", 0, m.start() + 1)
                spans.append((start, start + len(m.group().split()), rule.tier, number, rule.label))

    def hides(q, p):
        better = q[2] < p[2] or (q[2] == p[2] and (q[1] - q[0] > p[1] - p[0] or q[3] < p[3]))
        return q[0] <= p[0] and q[1] >= p[1] and better

    kept = sorted((p for p in spans if not any(hides(q, p) for q in spans)), key=lambda p: (p[0], -p[1], *p[2:]))
    score = max([licenses.CERTAINTY[p[2]] for p in kept] + [0.5 if places else 0.0])
    return len(words), places, kept, score


def scan(spark, texts, **options):
    frame = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id int, text string, lic_words string")
    return licenses.scan_licenses(frame, **options)


STATEMENTS = [
    "Licensed under the Apache License, Version 2.0.",
    "All rights reserved.",
    "GNU Lesser General Public License v2.1",
    "licensed under CC BY-NC-SA 4.0",
    "released, as is, under the terms of the MIT licence",
    "SPDX-License-Identifier: GPL-3.0",
    "gplv3",
    "Creative Commons Attribution Non Commercial 3.0",
    "Copyright (C) 2020 by someone",
    "THE SOFTWARE IS PROVIDED without warranty of any kind",
    "réservés tous droits réservés",
]


def test_spans_match_brute_force(spark):
    rng = random.Random(5)
    filler = ["under", "license", "the", "cc", "by", "all", "rights", "reserved", "2", "0", "ééall", "x", "general", "gpl"]
    texts = [None, "", "  \n", "no statement here", *STATEMENTS, "cc by cc by-sa, CC  BY"]
    for _ in range(60):
        texts.append(" ".join(rng.choice([rng.choice(STATEMENTS), *rng.sample(filler, 6)]) for _ in range(rng.randrange(1, 60))))
    texts += [texts[-1], "All rights reserved. " * 700 + "Licensed under the MIT License. " * 700]
    got = scan(spark, texts).collect()
    assert len(got) == len(texts)
    for row in got:
        words, places, kept, score = brute(texts[row.doc_id])
        assert row.lic_words == words
        assert [(p.start, p.label) for p in row.lic_places] == places
        assert [(p.start, p.end, p.tier, p.rule, p.label) for p in row.lic_found] == kept
        assert row.lic_score == pytest.approx(score)


def test_labels_of_statements(spark):
    rows = licenses.license_digest(scan(spark, STATEMENTS)).collect()
    assert {r.doc_id: r.labels for r in rows} == {
        0: "apache-2.0", 1: "reserved", 2: "gpl,lgpl-2.1", 3: "cc-by,cc-by-nc-sa-4.0", 4: "mit", 5: "gpl-3.0", 6: "gpl-3.0",
        7: "cc-by-nc-3.0", 8: "copyright", 9: "no-warranty", 10: "rights",
    }
    assert {r.doc_id: (r.n_base, r.first_word, r.last_word, r.base_labels) for r in rows}[2] == (1, 2, 2, "gpl")


def test_every_rule_matches_its_own_words():
    # the tables are read as meant: hundreds of distinct rules, each with a keyword its pattern asks for
    assert len({(r.label, r.pattern) for r in licenses.RULES}) > 300
    for rule in licenses.RULES:
        word = rule.keyword.strip()
        assert word in rule.pattern or any(word in part for part in re.split(r"\W+", rule.pattern.replace("[cs]", "c")))


def test_columns_empty_table_and_repeats(spark):
    none = spark.createDataFrame([], "doc_id int, text string, line string")
    assert licenses.license_digest(licenses.scan_licenses(none)).count() == 0
    frame = spark.createDataFrame(
        [(1, "mit license", "a"), (1, "mit license", "a"), (None, "mit license", None)], "doc_id int, text string, scan_low string"
    )
    out = licenses.scan_licenses(frame)
    assert out.columns == ["doc_id", "text", "scan_low", "lic_words", "lic_places", "lic_found", "lic_score"]
    assert [[p.label for p in r.lic_found] for r in out.collect()] == [["mit"]] * 3


def test_no_python_and_no_shuffle_in_the_plan(spark):
    frame = spark.createDataFrame([(1, "x")], "doc_id int, text string")
    plan = licenses.license_digest(licenses.scan_licenses(frame))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan
