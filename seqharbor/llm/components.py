"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import materialize


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node that has an edge to another one; root is the smallest node reachable.

    ``edges`` has two columns of one ordered type; direction, repeats and loops do not matter and
    rows with a null end are left out. Every round is written to the shared folder, so lost
    executors cost one round. Minima are taken before the shuffle and joined from written tables,
    so that a hub's rows can be split among tasks.
    """
    a, b = edges.columns
    links = materialize(
        edges.filter(F.col(a) != F.col(b))
        .select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo"))
        .distinct(),
        "links",
    )
    before = None
    while (now := _digest(links)) != before and now[0]:
        before = now
        ends = links.select(F.col("lo").alias("u"), F.col("lo").alias("m")).union(
            links.select(F.col("hi"), F.col("lo"))
        )
        least = materialize(ends.groupBy("u").agg(F.min("m").alias("m")), "least")
        # large star: a node's larger neighbours move to its smallest neighbour
        links = materialize(
            links.join(least, links.lo == least.u).select("hi", F.col("m").alias("lo")).distinct(), "links"
        )
        least = materialize(links.groupBy(F.col("hi").alias("u")).agg(F.min("lo").alias("m")), "least")
        # small star: a node and its smaller neighbours move to the smallest of them
        moved = links.join(least, links.hi == least.u).select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        links = materialize(
            moved.filter("hi <> lo").union(least.select("u", "m")).distinct(), "links"
        )
    roots = links.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct()
    return links.select(F.col("hi").alias("node"), F.col("lo").alias("root")).union(roots)


def _digest(links: DataFrame) -> tuple:
    row = links.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(20,0)"))).first()
    return tuple(row)
