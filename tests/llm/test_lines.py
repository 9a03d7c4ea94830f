from __future__ import annotations

from collections import Counter

from seqharbor.llm import lines


def brute(rows, ratio, least):
    pages, sites = Counter(), Counter()
    for _, site, text in rows:
        sites[site] += 1
        for line in {x.strip(" ") for x in (text or "").split("\n")} - {""}:
            pages[site, line] += 1
    out = []
    for i, site, text in rows:
        if text is None:
            out.append((i, 0, 0, None))
            continue
        every = text.split("\n")
        bad = [x.strip(" ") != "" and pages[site, x.strip(" ")] >= least and pages[site, x.strip(" ")] > ratio * sites[site] for x in every]
        out.append((i, len(every), sum(bad), "\n".join(x for x, b in zip(every, bad, strict=True) if not b)))
    return sorted(out, key=repr)


def test_boilerplate_matches_brute_force(spark):
    rows = [(i, "a" if i % 3 else "b", f"Menu\nbody {i}\n  Menu \n\nshare {i % 4}") for i in range(60)]
    rows += [(100 + i, None, "null site\nMenu\r\nx") for i in range(6)] + [(200, "one", "Menu\nMenu"), (201, "a", None), (202, "a", "")]
    rows += [(203, "a", "Menu"), (203, "a", "Menu"), (None, "b", "Menu\nrest"), (300, "a", "Menu\n" * 20000)]
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id int, source string, text string, ld_text string, pages int")
    for ratio, least in ((0.1, 5), (0.24, 5), (0.5, 1), (0.9, 100)):
        got = lines.drop_boilerplate(frame, ratio=ratio, least=least)
        assert got.columns == ["doc_id", "source", "text", "pages", "ld_lines", "ld_dropped", "ld_text"]
        found = sorted([(r.doc_id, r.ld_lines, r.ld_dropped, r.ld_text) for r in got.collect()], key=repr)
        assert found == brute(rows, ratio, least)


def test_empty_table_and_ties(spark):
    none = spark.createDataFrame([], "doc_id int, source string, text string")
    assert lines.drop_boilerplate(none).count() == 0
    # five of fifty pages are a tenth, which is not more than the ratio
    rows = [(i, "s", "Same" if i < 5 else f"own {i}") for i in range(50)]
    assert lines.boilerplate(spark.createDataFrame(rows, "doc_id int, source string, text string")).count() == 0
