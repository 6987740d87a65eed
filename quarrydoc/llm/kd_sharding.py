"""Sharding: a k-d tree over document metadata with distributed weighted medians.

Points are groups of equal texts (same digest and length), so that copies travel together; only a group that alone
is larger than a shard's target is split, into parts by row hash. A point carries the coordinates of its smallest document and
the bytes of all its rows. A large point, of more than `LARGE` of the target, lies at the low or high end of every dimension, by its
hash, as its rows lie all over anyway: there hardly any cut meets it, and the shards come out even.
The target is given, or the table's bytes over the number of shards, and so many leaves are cut that each holds about the target. The tree is split from the root: a node that shall become n
leaves takes its widest dimension (range as a share of the whole table's range) and is cut
where the bytes below reach floor(n/2)/n. The cut is a weighted quantile of a 63-bit key,
31 bits of the coordinate followed by 32 hash bits that order equal coordinates. It is found by
narrowing: each pass counts bytes in `BINS` equal bins of the interval, grouped in the
executors, and keeps the bin that holds the quantile, until the bin is one key or carries
under `tolerance` of the node. All nodes of a level share each pass, so passes do not grow
with the data; the driver holds one interval per node, at most the number of shards. A point's node is a column of the
written points, and each level's cuts reach it by a join, so that plans do not grow with the tree.

Slots number a shard's rows from 0 without gaps: rows are bucketed by hash, bucket counts
give each bucket its start, and ranks within buckets are bounded work.

Defined results: null text has size 1 and no bytes; null metadata lies at the low end of its
dimension; repeated rows take separate slots; fewer points than shards leave shards empty;
an empty table gives an empty result; other columns may be anything.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bucket_bits, discard, hash_bucket, prefix_sums, table

BINS = 1024
COORD = 2**31 - 1
HASH_SPAN = 2**32
LOW = -(2**63)
#: Share of the target: of a large point, and of a part of a group that is split.
LARGE, PART = 0.01, 0.05


@dataclass
class Node:
    """A node to cut: leaves [first, first + leaves), the dimension of the cut and the interval that holds it."""

    first: int
    leaves: int
    dim: int = 0
    lo: int = 0
    hi: int = 0
    below: float = 0.0
    total: float = 0.0
    open: bool = True

    @property
    def half(self) -> int:
        return self.leaves // 2

    @property
    def goal(self) -> float:
        return self.total * self.half / self.leaves


def coordinates() -> dict[str, Column]:
    """Metadata dimensions of `documents`: length, id, and places of language and source in hash order."""
    return {
        "x0": F.coalesce(F.length("text"), F.lit(0)).cast("double"),
        "x1": F.col("doc_id").cast("double"),
        "x2": F.coalesce(F.xxhash64("lang").bitwiseAND(0xFFFF), F.lit(0)).cast("double"),
        "x3": F.coalesce(F.xxhash64("source").bitwiseAND(0xFFFF), F.lit(0)).cast("double"),
    }


def kd_leaves(points: DataFrame, dims: list[str], leaves: int, tolerance: float = 1e-4) -> DataFrame:
    """points (dims double, h long in [0, 2^32), w long, end: -1, 0 or 1) plus `leaf`, 0 to leaves - 1.

    end: -1 and 1 put a point at the low or high end of every dimension.
    """
    spark = points.sparkSession
    span = points.agg(*[f(d).alias(f"{n}{d}") for d in dims for n, f in (("lo", F.min), ("hi", F.max))]).head()
    keys = []
    for i, d in enumerate(dims):
        lo, hi = span[f"lo{d}"] or 0.0, span[f"hi{d}"] or 0.0
        scaled = F.lit(0.0) if hi <= lo else (F.coalesce(F.col(d), F.lit(lo)) - lo) / (hi - lo)
        inner = F.floor(scaled * (COORD - 2)).cast("long") + 1
        place = F.when(F.col("end") < 0, F.lit(0)).when(F.col("end") > 0, F.lit(COORD)).otherwise(inner)
        keys.append((place.cast("long") * HASH_SPAN + F.col("h")).alias(f"k{i}"))
    names = [f"k{i}" for i in range(len(dims))]
    base = table(points.select("*", *keys, F.lit(0).alias("leaf")), "kd-points")
    level = [Node(0, leaves)]
    key_of = F.get(F.array(*names), F.col("_dim"))

    while any(n.leaves > 1 for n in level):
        nodes = {n.first: n for n in level if n.leaves > 1}
        inner = [f(F.when(F.col("end") == 0, F.col(k))).alias(f"{n}{k}") for k in names for n, f in (("ilo", F.min), ("ihi", F.max))]
        stats = base.groupBy("leaf").agg(F.sum("w").alias("w"), *inner, *[f(k).alias(f"{n}{k}") for k in names for n, f in (("lo", F.min), ("hi", F.max))]).collect()
        for r in stats:
            if r["leaf"] in nodes:
                n = nodes[r["leaf"]]
                widths = [((r[f"ihi{k}"] or 0) - (r[f"ilo{k}"] or 0)) // HASH_SPAN for k in names]
                n.dim = max(range(len(names)), key=lambda i: widths[i])
                n.lo, n.hi, n.total = r[f"lo{names[n.dim]}"], r[f"hi{names[n.dim]}"], float(r["w"])
        live = {f: n for f, n in nodes.items() if n.total > 0}
        while narrowing := [n for n in live.values() if n.open and n.hi > n.lo]:
            by_leaf = {n.first: n for n in narrowing}
            width = {n.first: (n.hi - n.lo) // BINS + 1 for n in narrowing}
            nodes_ = spark.createDataFrame([(n.first, n.dim, n.lo, n.hi, width[n.first], n.goal - n.below) for n in narrowing], "leaf int, _dim int, _lo long, _hi long, _width long, _goal double")
            inside = base.join(F.broadcast(nodes_), "leaf").withColumn("_k", key_of).where("_k between _lo and _hi")  # one row per node
            bins = inside.groupBy("leaf", F.expr("int((_k - _lo) div _width)").alias("bin"), "_goal").agg(F.sum("w").alias("w"))
            upto = F.sum("w").over(Window.partitionBy("leaf").orderBy("bin"))  # at most BINS rows
            bins = bins.withColumn("upto", upto).withColumn("at", F.struct("bin", F.col("upto").alias("upto"), "w"))
            chosen = bins.groupBy("leaf").agg(F.coalesce(F.min(F.when(F.col("upto") >= F.col("_goal"), F.col("at"))), F.max("at")).alias("at"))
            for r in chosen.select("leaf", "at.*").collect():
                n, step = by_leaf[r["leaf"]], width[r["leaf"]]
                at = n.below + float(r["upto"])
                below = at - float(r["w"])
                n.below, n.lo, n.hi = below, n.lo + r["bin"] * step, min(n.hi, n.lo + (r["bin"] + 1) * step - 1)
                if step == 1 or at - below <= tolerance * n.total:
                    n.open = False
                    # the nearer end of the bin
                    n.hi = n.hi if at - n.goal <= n.goal - below else n.lo - 1
        cuts, level_next = [], []
        for n in level:
            if n.leaves == 1:
                level_next.append(n)
                continue
            upper = n.first + n.half
            key = n.hi if n.first in live else LOW
            cuts.append((n.first, n.dim, key, upper))
            level_next += [Node(n.first, n.half), Node(upper, n.leaves - n.half)]
        cut = F.broadcast(spark.createDataFrame(cuts, "leaf int, _dim int, _key long, _upper int"))  # one row per node
        moved = base.join(cut, "leaf", "left").withColumn("leaf", F.when(key_of > F.col("_key"), F.col("_upper")).otherwise(F.col("leaf")))
        moved = table(moved.select(base.columns), "kd-points")
        discard(base)
        base, level = moved, level_next
    return base.drop(*names)


def kd_shards(docs: DataFrame, shards: int | None = 8, target_bytes: int | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of docs: key, size (UTF-8 bytes + 1), text_crc32, shard, slot. Give `shards`, or `target_bytes` of a leaf."""
    t = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(key).alias(key), (F.octet_length(t) + 1).cast("long").alias("size"), F.crc32(F.encode(t, "utf-8")).alias("text_crc32"), F.xxhash64(t).alias("g"), *[c.alias(n) for n, c in coordinates().items()])
    rows = table(rows.withColumn("row", F.xxhash64(key, "g")), "shard-rows")
    total, count = rows.agg(F.sum("size"), F.count(F.lit(1))).head()
    total = total or 0
    if target_bytes is not None:
        shards = max(1, -(-total // target_bytes))
    target = max(1, total / shards)
    group = ["g", "text_crc32", "size"]
    # groups of more bytes than a shard are dealt to several points by row hash
    weight = F.col("c") * F.col("size")
    parts = rows.groupBy(*group).agg(F.count(F.lit(1)).alias("c")).where(weight > target).select(*group, F.ceil(weight / (target * PART)).cast("int").alias("parts"))
    few = table(parts, "shard-large-groups")  # at most `shards` groups
    rows = rows.join(F.broadcast(few), group, "left").withColumn("part", F.coalesce(F.pmod("row", F.col("parts")).cast("int"), F.lit(0))).drop("parts")
    dims = [c for c in coordinates()]
    points = rows.groupBy(*group, "part").agg(F.sum("size").alias("w"), F.min(F.struct(key, *dims)).alias("m"))
    h = F.xxhash64("g", "part", "text_crc32").bitwiseAND(HASH_SPAN - 1)
    end = F.when(F.col("w") <= target * LARGE, 0).when(h.bitwiseAND(1) == 0, -1).otherwise(1)
    points = points.select(*group, "part", "w", h.alias("h"), end.alias("end"), *[F.col(f"m.{d}").alias(d) for d in dims])
    leaves = kd_leaves(points, dims, shards).select(*group, "part", F.col("leaf").alias("shard"))
    placed = rows.join(leaves, [*group, "part"]).select(key, "size", "text_crc32", "shard", "row", F.lit(1).alias("one"))
    return prefix_sums(placed, ["shard"], "row", "one", "slot", hash_bucket(F.col("row"), bucket_bits(count))).drop("one", "row")
