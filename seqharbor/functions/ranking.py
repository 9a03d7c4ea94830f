"""Exact ranks inside groups of any size.

A plain ``row_number`` sends a whole group to one task. Here each group is cut into blocks that
follow the rank order: rows are numbered inside their block, and the sizes of the earlier blocks
(one small row per block) are added. A group holding a third of all rows is spread over its
blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

HASH_PREFIX = 3  # hex digits of the order hash used as block: 4096 blocks per group


def blocked_rank(
    df: DataFrame, groups: list[str], block: Column, order: list[str], out: str = "rank"
) -> DataFrame:
    """1-based rank of each row in its group by ``order``; ``block`` must be monotone in it.

    ``df`` is read twice, once for the block sizes: pass narrow or written tables.
    """
    keyed = df.withColumn("_block", block)
    sizes = keyed.groupBy(*groups, "_block").agg(F.count(F.lit(1)).alias("_size"))
    earlier = Window.partitionBy(*groups).orderBy("_block").rowsBetween(
        Window.unboundedPreceding, -1
    )
    offsets = sizes.select(
        *groups, "_block", F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_before")
    )
    inside = Window.partitionBy(*groups, "_block").orderBy(*order)
    return (
        keyed.withColumn(out, F.row_number().over(inside))
        .join(offsets, [*groups, "_block"])
        .withColumn(out, (F.col(out) + F.col("_before")).cast("long"))
        .drop("_block", "_before")
    )


def hash_rank(
    df: DataFrame, groups: list[str], key: str, seed: int | str, out: str = "rank"
) -> DataFrame:
    """Rank rows of a group in the order of MD5(key|seed): a seeded random permutation."""
    digest = F.md5(F.concat_ws("|", F.col(key).cast("string"), F.lit(str(seed))))
    keyed = df.withColumn("_order", digest)
    block = F.substring("_order", 1, HASH_PREFIX)
    return blocked_rank(keyed, groups, block, ["_order", key], out).drop("_order")
