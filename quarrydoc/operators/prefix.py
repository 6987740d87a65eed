"""Prefix scans without one task per key: rows are cut into buckets that follow their order, and a row per bucket carries what came before.

`bucket` is a column that never falls in the order of the rows of a key. Each bucket is bounded work; only bucket rows of a key meet in one task.
Null keys are a key of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Pages of a bucket.
BUCKET_PAGES = 256


def page_bucket(page: str = "page", size: int = BUCKET_PAGES) -> Column:
    """Null pages come first, as they do in ascending order."""
    return F.coalesce(F.floor(F.col(page) / size).cast("long"), F.lit(-(2**62)))


def _with_before(df: DataFrame, keys: list[str], per: DataFrame, columns: list[str]) -> DataFrame:
    """df joined with the columns of its bucket's row; null keys meet."""
    p = per.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_bucket").alias("_b"), *columns)
    on = df["_bucket"] == p["_b"]
    for i, k in enumerate(keys):
        on &= df[k].eqNullSafe(p[f"_k{i}"])
    return df.join(p, on).drop("_bucket", "_b", *[f"_k{i}" for i in range(len(keys))])


def carry_forward(df: DataFrame, keys: list[str], bucket: Column, order: list[str], value: str, out: str) -> DataFrame:
    """df plus `out`: the last value that is not null, up to and with the row."""
    d = df.withColumn("_bucket", bucket)
    inner = Window.partitionBy(*keys, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("_own", F.last(value, ignorenulls=True).over(inner))
    last = F.max_by(F.when(F.col(value).isNotNull(), F.col(value)), F.when(F.col(value).isNotNull(), F.struct(*order)))
    per = df.withColumn("_bucket", bucket).groupBy(*keys, "_bucket").agg(last.alias("_last"))
    before = F.last("_last", ignorenulls=True).over(Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1))
    d = _with_before(d, keys, per.withColumn("_before", before), ["_before"])
    return d.withColumn(out, F.coalesce("_own", "_before")).drop("_own", "_before")


def positions(df: DataFrame, keys: list[str], bucket: Column, order: list[str], at: str, total: str) -> DataFrame:
    """df plus `at`, the row's place in its key from 0, and `total`, the rows of the key."""
    d = df.withColumn("_bucket", bucket)
    d = d.withColumn("_own", F.row_number().over(Window.partitionBy(*keys, "_bucket").orderBy(*order)) - 1)
    w = Window.partitionBy(*keys)
    before = F.coalesce(F.sum("_n").over(w.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    per = df.withColumn("_bucket", bucket).groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    per = per.withColumns({"_before": before, total: F.sum("_n").over(w)})
    return _with_before(d, keys, per, ["_before", total]).withColumn(at, F.col("_own") + F.col("_before")).drop("_own", "_before")
