"""Retrieval quality: recall, reciprocal rank, keyword matches, ground-truth checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import BROADCAST_BYTES, hinted, is_small, size_of, table

#: White space between words for matching; a word is what lies between.
SPACES = r"[\x20\x09-\x0D]+"


def holding(texts: DataFrame, items: DataFrame, text: str, item: str, width: int = 4) -> DataFrame:
    """Pairs of rows whose `text` contains `item` as it stands.

    An item's words but the first and the last are whole words of any text that contains it, so texts and items meet by
    hash of the first `width` such words, or of all where an item has fewer, and the pairs are verified. Only (row, hash) and (row, item) travel
    before that; texts are fetched last, for rows that met an item. Items of one or two words have no such word: they meet all
    texts, as blocks of items that are broadcast one after the other.
    """
    bare = F.filter(F.split(item, SPACES), lambda w: w != "")
    its = items.withColumns({"_i": F.xxhash64(*items.columns), "_n": F.least(F.greatest(F.size(bare) - 2, F.lit(0)), F.lit(width))})
    widths = sorted(r["_n"] for r in its.select("_n").distinct().collect())  # at most width + 1
    rows = texts.withColumn("_k", F.xxhash64(*texts.columns))
    out = _met(rows, its, bare, [n for n in widths if n] or [width], text, item)
    if 0 in widths:
        short = table(its.where("_n = 0").drop("_n"), "held-short")
        blocks = -(-size_of(short) // BROADCAST_BYTES)
        for i in range(blocks):
            block = short.where(F.pmod("_i", F.lit(blocks)) == i).drop("_i")
            out = out.unionByName(texts.join(F.broadcast(block), F.col(text).contains(F.col(item))))
    return out


def _met(rows: DataFrame, items: DataFrame, bare: Column, widths: list[int], text: str, item: str) -> DataFrame:
    """The pairs that share the hash of `_n` words in a row, verified. Rows and items of equal columns share their keys."""

    def windows(h: Column, n: int) -> Column:
        at = F.when(F.size(h) >= n, F.sequence(F.lit(0), F.size(h) - n)).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda i: F.xxhash64(F.lit(n), *[F.get(h, i + j) for j in range(n)]))

    key = F.lit(None).cast("long")
    for n in widths:
        key = F.when(F.col("_n") == n, F.xxhash64(F.lit(n), *[F.xxhash64(F.get(bare, F.lit(j + 1))) for j in range(n)])).otherwise(key)
    long = table(items.where("_n > 0").withColumn("_h", key).drop("_n"), "held-items")
    words = F.filter(F.split(text, SPACES), lambda w: w != "")
    # a one-element array binds the words' hashes to a variable, so that they are made once per text
    hashes = F.transform(F.array(F.transform(words, lambda w: F.xxhash64(w))), lambda h: F.array_distinct(F.concat(*[windows(h, n) for n in widths])))[0]
    named = table(long.select("_h", "_i").distinct(), "held-hashes")
    pairs = table(rows.select("_k", F.explode(hashes).alias("_h")).join(hinted(named), "_h").select("_k", "_i").distinct(), "held-pairs")
    found = rows.join(hinted(pairs), "_k").join(hinted(long), "_i").drop("_k", "_i", "_h")
    return found.where(F.col(text).contains(F.col(item)))


def hits(text: Column, keywords: Column) -> Column:
    # a one-element array binds the lower-cased text to a variable, so that it is made once per row
    return F.transform(F.array(F.lower(text)), lambda t: F.size(F.filter(keywords, lambda k: t.contains(F.lower(k)))))[0]


def keyword_match(text: Column, keywords: Column, share: float = 0.5) -> Column:
    return hits(text, keywords) >= F.greatest(F.lit(1.0), F.size(keywords) * share)


def majority_match(text: Column, keywords: Column) -> Column:
    return hits(text, keywords) >= F.floor(F.size(keywords) / 2) + 1


def first_rank(candidates: DataFrame, gold: DataFrame, match: Column) -> DataFrame:
    """(config, query_id, rank): the first rank whose candidate matches; null for a miss."""
    d = gold.select("query_id").crossJoin(F.broadcast(candidates.select("config").distinct())) if "config" in candidates.columns else gold.select("query_id").withColumn("config", F.lit("all"))
    c = candidates if "config" in candidates.columns else candidates.withColumn("config", F.lit("all"))
    found = c.join(gold, "query_id").where(match).groupBy("config", "query_id").agg(F.min("rank").alias("rank"))
    return d.join(found, ["config", "query_id"], "left")


def recall_mrr(ranks: DataFrame, k: int) -> DataFrame:
    """Per config: recall at k and mean reciprocal rank at k, a miss counting 0."""
    hit = F.col("rank").isNotNull() & (F.col("rank") <= k)
    return ranks.groupBy("config").agg(F.count(F.lit(1)).alias("n"), F.avg(F.when(hit, 1.0).otherwise(0.0)).alias("recall"), F.avg(F.when(hit, 1.0 / F.col("rank")).otherwise(0.0)).alias("mrr"))


def verify_gold(gold: DataFrame, pages: DataFrame) -> DataFrame:
    """Per item: the pages of its source that hold most of its keywords, and whether the expected one is among them.

    The items travel to the pages, so that no text does, unless there are too many.
    """
    gold = table(gold, "gold-items")
    sought = gold.select("query_id", "expected_source", "expected_keywords")
    d = pages.withColumnRenamed("source", "expected_source").join(F.broadcast(sought) if is_small(gold) else sought, "expected_source")
    d = d.where(majority_match(F.col("text"), F.col("expected_keywords"))).groupBy("query_id").agg(F.array_sort(F.collect_set("page")).alias("found"))
    out = gold.select("query_id", "expected_page").join(d, "query_id", "left").withColumn("found", F.coalesce("found", F.array().cast("array<int>")))
    return out.withColumn("status", F.when(F.array_contains("found", F.col("expected_page")), "OK").otherwise("MISMATCH"))
