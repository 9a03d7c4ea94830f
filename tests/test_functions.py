from __future__ import annotations

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from seqharbor import session
from seqharbor.functions.rand import uniform, uniform_int
from seqharbor.functions.ranking import blocked_rank
from seqharbor.functions.scalars import clamp, first_argmax, let, round_half_even, zero_if_missing
from seqharbor.functions.spread import broadcast_if_small, spread


def test_scalars(spark):
    df = spark.createDataFrame([(0.12345, 2.0, float("nan"), None)], "a double, b double, c double, d double")
    row = df.select(
        round_half_even(F.lit(2.5), 0), round_half_even(F.lit(-0.00005), 4), round_half_even(F.col("a"), 4),
        clamp(F.col("b"), high=1.0), zero_if_missing(F.col("c")), zero_if_missing(F.col("d")),
        first_argmax([F.col("a"), F.col("b"), F.col("b")]), let(F.col("b"), lambda x: x * x),
    ).first()
    assert tuple(row) == (2.0, 0.0, 0.1234, 1.0, 0.0, 0.0, 1, 4.0)


def test_draws_do_not_depend_on_partitioning(spark, rows):
    df = spark.range(300).withColumn("k", F.concat(F.lit("s"), "id"))
    draw = lambda d: rows(d.select("k", uniform(F.col("k"), 1), uniform_int(3, 5, F.col("k"), 2)))
    once = draw(df)
    assert once == draw(df.repartition(11))
    assert all(0 <= u < 1 for _, u, _ in once) and {n for *_, n in once} == {3, 4, 5}
    assert 0.4 < sum(u for _, u, _ in once) / 300 < 0.6


def test_rank_of_a_hot_group(spark, rows):
    df = spark.range(2000).select(F.when(F.col("id") % 3 == 0, "cold").otherwise("hot").alias("g"), "id")
    ranked = blocked_rank(df, ["g"], F.floor(F.col("id") / 64), ["id"])
    plain = df.selectExpr("g", "id", "row_number() over (partition by g order by id) as rank")
    assert rows(ranked, "g", "id", "rank") == rows(plain, "g", "id", "rank")


def test_spread_leaves_wide_scans(spark, tmp_path):
    spark.range(100).coalesce(1).write.parquet(str(tmp_path / "one"))
    one = spark.read.parquet(str(tmp_path / "one"))
    assert spread(one, "id").rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    wide = spark.range(0, 100, 1, 9)
    assert spread(wide, "id") is wide


def test_spread_counts_rows_of_tasks_not_tasks(spark, tmp_path, rows):
    path = str(tmp_path / "grouped")
    table = pa.table({"id": list(range(2000)), "text": [f"{i:040d}" for i in range(2000)]})
    pq.write_table(table, path, row_group_size=2000, compression="none")
    kept = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        scan = spark.read.parquet(path)
        assert scan.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
        sizes = [len(part) for part in spread(scan, "id").rdd.glom().collect()]
        assert max(sizes) * spark.sparkContext.defaultParallelism <= 2 * sum(sizes) == 4000
        assert rows(spread(scan, "id")) == rows(scan)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", kept)


def test_shared_folder(spark, rows):
    assert session.shared_root(spark) == spark.conf.get("spark.checkpoint.dir")
    df = spark.createDataFrame([("a", [1.0], None)], "k string, v array<double>, n int")
    kept = session.materialize(df, "t")
    assert kept.schema == df.schema and rows(kept) == rows(df)
    assert all(session.shared_root(spark) in f for f in kept.inputFiles())


def test_cluster_needs_a_shared_folder():
    class Context:
        master = "yarn"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            get = staticmethod(lambda key, default: default)

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_root(Session())


def test_broadcast_needs_a_small_count(spark):
    plan = lambda df: df._jdf.queryExecution().logical().toString()
    left = spark.range(50)
    assert "broadcast" in plan(left.join(broadcast_if_small(spark.range(10), 10), "id")).lower()
    assert "broadcast" not in plan(left.join(broadcast_if_small(spark.range(11), 10), "id")).lower()
