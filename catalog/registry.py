"""Registered queries, each beside the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from seqharbor.functions.scalars import round_half_even

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return register


def tidy(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every floating column the way ``r`` does in SQL."""
    return df.select(
        *[
            (round_half_even(F.col(f"`{f.name}`").cast("double"), digits) + F.lit(0.0)).alias(f.name)
            if isinstance(f.dataType, (T.DoubleType, T.FloatType))
            else F.col(f"`{f.name}`")
            for f in df.schema.fields
        ]
    )


def unpack(df: DataFrame, vector: str, size: int, prefix: str) -> DataFrame:
    return df.withColumns({f"{prefix}{i}": F.col(vector)[i] for i in range(size)}).drop(vector)


def r(expr: str, digits: int = 6, alias: str | None = None) -> str:
    scale = f"1e{digits}"
    text = f"(round_even(({expr})::double*{scale},0)/{scale}+0.0::double)"
    return f"{text} as {alias}" if alias else text


def u32(*parts: str) -> str:
    return f"cast('0x'||substr(md5(concat_ws('|',{','.join(parts)})),1,8) as bigint)"


def uni(*parts: str) -> str:
    return f"({u32(*parts)}/4294967296::double)"
