"""Shared pieces: word expressions, intermediate tables, distributed prefix sums.

Words are maximal runs of characters other than space, tab, LF, VT, FF and CR,
the same class in Java, Python ``bytes.split`` and RE2.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..scratch import discard, fresh_path, hinted, is_small, shared_dir, table  # noqa: F401

SPACE = r"[\x20\x09-\x0D]+"
NULL_KEY = "\u0000null"


def words(text: Column) -> Column:
    """array<string> of words; null text has none."""
    t = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\x0c\r"))
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, SPACE))


def n_words(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once, however often `body` names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def hash_windows(hashes: Column, width: int) -> Column:
    """64-bit hash of every `width` consecutive elements of an array<long> (empty when shorter)."""
    at = F.sequence(F.lit(0), F.size(hashes) - width)
    win = F.transform(at, lambda i: F.xxhash64(*[F.get(hashes, i + j) for j in range(width)]))
    return F.when(F.size(hashes) >= width, win).otherwise(F.array().cast("array<bigint>"))


def prefix_sums(df: DataFrame, keys: list[str], order: str, weight: str, out: str, bucket: Column, ties: list[str] | None = None) -> DataFrame:
    """Exclusive running sum of `weight` per `keys` in the order of (`order`, `ties`), without one task per key.

    `bucket` must be monotone in `order`; each bucket is bounded work. Sums per
    (keys, bucket) are a small table; a running sum over it gives each bucket its start.
    """
    d = df.withColumn("_bucket", bucket)
    per = d.groupBy(*keys, "_bucket").agg(F.sum(weight).alias("_w"))
    over = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    start = F.coalesce(F.sum("_w").over(over.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = per.select(*keys, "_bucket", start.alias("_start"))
    inner = Window.partitionBy(*keys, "_bucket").orderBy(order, *(ties or [])).rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("_run", F.coalesce(F.sum(weight).over(inner), F.lit(0)))
    return d.join(starts, [*keys, "_bucket"]).withColumn(out, (F.col("_start") + F.col("_run"))).drop("_bucket", "_start", "_run")


def hash_bucket(h: Column, bits: int) -> Column:
    """The top `bits` of a signed 64-bit hash, monotone in it."""
    return F.shiftright(h, 64 - bits)


def bucket_bits(rows: int, per_bucket: int = 2_000) -> int:
    """Bits of hash buckets of about `per_bucket` rows each, were all rows of one key."""
    return max(1, (rows // per_bucket).bit_length())


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
