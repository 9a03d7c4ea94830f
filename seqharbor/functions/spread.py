"""Place rows: all cores on small inputs, broadcasts behind a count."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def spread(scan: DataFrame, key: str) -> DataFrame:
    """Repartition a file scan whose rows lie in too few tasks to keep the session's cores busy.

    A few small files, or large files of few row groups, would otherwise keep sequence work on a few tasks: a
    file is split by bytes, but the rows of a row group all go to one of its splits. So rows are counted by task, which reads
    ``key`` only. A scan with a task for every core, none of them with over twice its share, stays as it is: no shuffle.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    tasks = scan.rdd.getNumPartitions()
    if tasks >= cores:
        by_task = scan.select(key).groupBy(F.spark_partition_id()).count()
        found = by_task.agg(F.max("count").alias("most"), F.sum("count").alias("all")).first()
        if found["all"] is None or found["most"] * cores <= 2 * found["all"]:
            return scan
    return scan.repartition(max(cores, tasks), key)


def broadcast_if_small(df: DataFrame, most_rows: int) -> DataFrame:
    """Mark ``df`` for broadcast if it has at most ``most_rows`` rows, which is counted.

    A larger one is returned as it is and joins by a shuffle, whose hot keys adaptive execution
    splits (``session.DEFAULT_CONF`` lets it do so in every join).
    """
    if df.limit(most_rows + 1).count() > most_rows:
        return df
    return F.broadcast(df)
