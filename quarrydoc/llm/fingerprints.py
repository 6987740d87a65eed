"""Document fingerprints: bottom-k sketches of word-shingle hashes, natively.

A text's sketch is the `k` smallest distinct 64-bit hashes of its shingles (`width`
consecutive words; a shorter non-empty text is one shingle; a null or wordless text has
none), kept in ascending order together with its number of shingles when that is
below k. Sketches of parts merge by taking the k smallest of their union, so a corpus
or a document in pieces can be sketched in any grouping. From two sketches:
resemblance (Jaccard), containment and distinct shingle counts.

Defined results: null text is empty; null ids come first; two empty sketches resemble each other by 1, an empty and a non-empty
one by 0; equal texts have equal sketches; rows with one id follow each other by the hash of their text, and repeated rows are rows of their own (rows equal in id and
text lie in one range); the row after the last is the first, so a table's only row is its own next; an empty table gives no rows;
very long texts are sketched whole; other columns are ignored.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, hash_windows, table, words

#: 2^64, the size of the hash space.
SPACE_SIZE = 18446744073709551616.0


def bound(x: Column, f) -> Column:
    """f(x) with x computed once: aggregate over a one-element array binds it to a variable."""
    probe = F.transform(F.array(x), f)
    return F.get(probe, 0)


def shingle_hashes(text: Column, width: int = 5) -> Column:
    def shingles(h: Column) -> Column:
        long = hash_windows(h, width)
        whole = F.array(F.aggregate(h, F.lit(42).cast("long"), lambda s, x: F.xxhash64(s, x)))
        return F.when(F.size(h) >= width, long).when(F.size(h) > 0, whole).otherwise(F.array().cast("array<bigint>"))

    return bound(F.transform(words(text), lambda w: F.xxhash64(w)), shingles)


def sketch(text: Column, k: int = 128, width: int = 5) -> Column:
    """array<long>: the k smallest distinct shingle hashes, ascending."""
    return F.slice(F.sort_array(F.array_distinct(shingle_hashes(text, width))), 1, k)


def merge(a: Column, b: Column, k: int = 128) -> Column:
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def merged(df: DataFrame, by: list[str], col: str, k: int = 128) -> DataFrame:
    """One sketch per group: distinct hashes, then the k smallest by rank, pre-cut in each task's own share by the window's group limit."""
    h = df.select(*by, F.explode(col).alias("_h")).distinct()
    w = Window.partitionBy(*by).orderBy("_h")
    small = h.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k)
    return small.groupBy(*by).agg(F.sort_array(F.collect_list("_h")).alias(col))


def distinct_count(s: Column, k: int = 128) -> Column:
    """Estimated number of distinct shingles: exact below k, else (k - 1) / the k-th smallest hash as a share of the space."""
    share = (F.element_at(s, -1).cast("double") + SPACE_SIZE / 2) / SPACE_SIZE
    return F.when(F.size(s) < k, F.size(s).cast("double")).otherwise((k - 1) / share)


def resemblance(a: Column, b: Column, k: int = 128) -> Column:
    """Share of the k smallest hashes of the union that both sketches hold."""
    est = bound(
        F.struct(merge(a, b, k).alias("u"), F.array_intersect(a, b).alias("i")),
        lambda x: F.when(F.size(x["u"]) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(x["u"], x["i"])) / F.size(x["u"])),
    )
    return F.when(a == b, F.lit(1.0)).otherwise(est)


def containment(a: Column, b: Column, k: int = 128) -> Column:
    """Estimated share of a's shingles that b has too: resemblance * |a u b| / |a|."""
    union = distinct_count(merge(a, b, k), k)
    own = distinct_count(a, k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), resemblance(a, b, k) * union / own))


def as_string(s: Column) -> Column:
    """Fixed-width lower-case hexadecimal of the sketch."""
    return F.array_join(F.transform(s, lambda h: F.lower(F.lpad(F.hex(h), 16, "0"))), "")


#: At most so many ranges, so that their first keys, three numbers each, stay small in a plan; larger corpora have longer ranges.
MOST_RANGES = 2**16


def place_key(order: str, tie: Column) -> Column:
    """What rows are ordered by: nulls first, then `order`, then `tie`."""
    return F.struct(F.col(order).isNotNull().cast("int").alias("f"), F.coalesce(F.col(order).cast("long"), F.lit(0)).alias("o"), tie.alias("t"))


def range_heads(sizes: DataFrame, target: int, least: int = 1, most: int = MOST_RANGES) -> list:
    """Ascending first keys of ranges of `sizes` (_key, _size), about `least` at least, that hold about `target` of _size each at most.

    A range exchange orders the keys; each of its parts is cut where its running sum passes a multiple of the target. The driver
    holds one key per range.
    """
    total = sizes.agg(F.sum("_size")).head()[0] or 0
    ranges = min(most, max(least, -(-total // target)))
    parts = max(1, ranges // 8)
    target = max(1, total // ranges)
    dealt = sizes.repartitionByRange(parts, "_key").withColumn("_part", F.spark_partition_id())
    run = F.sum("_size").over(Window.partitionBy("_part").orderBy("_key"))
    # the middle of a row decides where it lies; rows of one key share the running sum and with it the piece
    dealt = dealt.groupBy("_part", "_key").agg(F.sum("_size").alias("_size")).withColumn("_piece", F.floor((run - F.col("_size") / 2) / target))
    heads = dealt.groupBy("_part", "_piece").agg(F.min("_key").alias("_key")).select("_key.*").collect()
    return sorted((r["f"], r["o"], r["t"]) for r in heads)


def range_of(key: Column, heads: list) -> Column:
    """Number of the range, from 0, whose first key is the last that is not above `key`, by binary search in one array."""
    cuts = F.from_json(F.lit(json.dumps([{"f": f, "o": o, "t": t} for f, o, t in heads[1:]])), "array<struct<f:int,o:bigint,t:bigint>>")
    steps = F.array(*[F.lit(2**i) for i in reversed(range(len(heads[1:]).bit_length()))]).cast("array<int>")
    return F.aggregate(steps, F.lit(0), lambda at, s: F.when(F.coalesce(F.get(cuts, at + s - 1) <= key, F.lit(False)), at + s).otherwise(at))


def with_next(docs: DataFrame, order: str, columns: list[str], buckets: int = 1, heads: list | None = None, derived: dict[str, Column] | None = None) -> DataFrame:
    """docs plus `derived` columns, and next_<column> of both of the following row in ascending `order` (cyclic), in bounded tasks.

    Rows are dealt to the ranges that begin at `heads` (by default about `buckets` of about as many rows), one task each; each range also gets a
    copy of the first row of the range after it, so the lead never leaves a task. Ties of
    `order` are broken by the columns' hash. Derived columns are made once per row, in its task.
    """
    derived, key = derived or {}, place_key(order, F.xxhash64(*columns))
    if heads is None:
        heads = range_heads(docs.select(key.alias("_key"), F.lit(1).cast("long").alias("_size")), 2**62, buckets)
    if not heads:
        return docs.withColumns(derived).select("*", *[F.col(c).alias(f"next_{c}") for c in [*columns, *derived]])
    d = docs.withColumn("_key", key).withColumn("_b", range_of(F.col("_key"), heads))
    # the first row of a range, one of repeated ones, follows the range before
    first = F.from_json(F.lit(json.dumps([{"f": f, "o": o, "t": t} for f, o, t in heads])), "array<struct<f:int,o:bigint,t:bigint>>")
    ghosts = d.where(F.get(first, F.col("_b")) == F.col("_key")).dropDuplicates(["_b"]).withColumn("_b", F.pmod(F.col("_b") - 1, F.lit(len(heads)))).withColumn("_ghost", F.lit(1))
    w = Window.partitionBy("_b").orderBy("_ghost", "_key")
    both = d.withColumn("_ghost", F.lit(0)).unionByName(ghosts).repartitionById(len(heads), F.col("_b")).withColumns(derived)
    out = both.select("*", *[F.lead(c).over(w).alias(f"next_{c}") for c in [*columns, *derived]])
    return out.where(F.col("_ghost") == 0).drop("_ghost", "_b", "_key")


def edited_text(text: Column, following: Column) -> Column:
    """The last floor(n/4) code points replaced by the first as many (or all) of the following text."""
    n = F.length(text)
    cut = F.floor(n / 4).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - cut), F.substring(following, F.lit(1), cut))


def fingerprint_pairs(docs: DataFrame, key: str = "doc_id", k: int = 128, width: int = 5, buckets: int | None = None, range_bytes: int = 128 * 2**20) -> DataFrame:
    """Per document: key, n_chars, edited (text), sketch, edited_sketch, next_sketch.

    The lead's tasks are ranges of ids, and of hashes where ids repeat or are null, with about equally many bytes of text: about `buckets` (by default the shuffle partitions), and more where a range would have more than `range_bytes`.
    """
    base = docs.select(F.col(key), F.coalesce("text", F.lit("")).alias("text"))
    sizes = base.select(place_key(key, F.xxhash64("text")).alias("_key"), (F.octet_length("text") + 64).cast("long").alias("_size"))
    sizes = table(sizes, "fingerprint-sizes")
    heads = range_heads(sizes, range_bytes, buckets or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    discard(sizes)
    d = with_next(base, key, ["text"], heads=heads, derived={"sketch": sketch(F.col("text"), k, width)})
    d = d.select(key, F.length("text").cast("long").alias("n_chars"), edited_text(F.col("text"), F.col("next_text")).alias("edited"), "sketch", "next_sketch")
    return d.select("*", sketch(F.col("edited"), k, width).alias("edited_sketch"))
