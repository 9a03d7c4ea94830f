"""Line dedup by site-relative frequency: lines on too large a share of a site's pages are dropped."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import materialize

RATIO = 0.1
LEAST_PAGES = 5


def _lines(text: str):
    return F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)


def _key(line):
    return F.xxhash64(F.trim(line))


def boilerplate(
    pages: DataFrame, site: str = "source", text: str = "text", ratio: float = RATIO, least: int = LEAST_PAGES
) -> DataFrame:
    """(site, line_key, pages, site_pages): the lines on more than ``ratio`` of their site's pages.

    A line counts once for a page, without the blanks around it, by a 64-bit hash; blank lines do
    not count. Every page counts for its site's total, also one without text; pages with a null
    site are a site of their own. A line must stand on ``least`` pages at least, so that a site
    of a few pages does not lose lines that it merely has twice.
    """
    totals = pages.groupBy(F.col(f"`{site}`").alias("site")).agg(F.count("*").alias("site_pages"))
    keys = F.transform(F.filter(_lines(text), lambda x: F.trim(x) != ""), _key)
    found = (
        pages.select(F.col(f"`{site}`").alias("site"), F.explode(F.array_distinct(keys)).alias("line_key"))
        .groupBy("site", "line_key")
        .agg(F.count("*").alias("pages"))
        .filter(F.col("pages") >= least)
    )
    found, totals = materialize(found, "line-counts"), materialize(totals, "site-pages")
    return (
        found.join(totals.withColumnRenamed("site", "of"), F.col("site").eqNullSafe(F.col("of")))
        .filter(F.col("pages") > ratio * F.col("site_pages"))
        .select("site", "line_key", "pages", "site_pages")
    )


def drop_boilerplate(
    pages: DataFrame, site: str = "source", text: str = "text", ratio: float = RATIO, least: int = LEAST_PAGES,
    names: str = "ld_",
) -> DataFrame:
    """``pages`` with ``ld_lines``, ``ld_dropped`` (long) and ``ld_text``, the lines that stay.

    Lines that stay keep their order and their blanks, joined by line feeds. A text that loses
    nothing is unchanged, a null text has no lines and stays null. A site has at most
    lines-per-page / ``ratio`` boilerplate lines, so their keys travel as one array per site.
    Columns of ``pages`` whose name starts with ``names`` are replaced.
    """
    kept = pages.select(*[F.col(f"`{c}`") for c in pages.columns if not c.startswith(names)])
    own, keys, every, stays = (f"{names}{c}" for c in ("site", "keys", "all", "stays"))
    sites = (
        boilerplate(pages, site, text, ratio, least)
        .groupBy(F.col("site").alias(own))
        .agg(F.collect_set("line_key").alias(keys))
    )
    sites = materialize(sites, "boilerplate")
    left = F.filter(every, lambda x: (F.trim(x) == "") | ~F.array_contains(keys, _key(x)))
    out = kept.join(sites, F.col(site).eqNullSafe(F.col(own)), "left").withColumn(
        every, F.when(F.col(text).isNull(), F.array().cast("array<string>")).otherwise(_lines(text))
    )
    out = out.withColumn(stays, F.when(F.col(keys).isNull(), F.col(every)).otherwise(left))
    same = F.size(every) == F.size(stays)
    return out.select(
        *[F.col(f"`{c}`") for c in kept.columns],
        F.size(every).cast("long").alias(f"{names}lines"),
        (F.size(every) - F.size(stays)).cast("long").alias(f"{names}dropped"),
        F.when(same, F.col(text)).otherwise(F.array_join(stays, "\n")).alias(f"{names}text"),
    )
