"""Exact nearest neighbours with pruning: vectors stored by their nearest pivot and their distance to it.

Pivots are a bounded sample of the vectors. A shard is a ring around a pivot: the vectors nearest to it, between two distances. By the triangle inequality
no vector of a ring [lo, hi] is nearer to a query than max(lo - d, d - hi, 0), d being the query's distance to the pivot. A search scans for each query the shards
around it until they hold k vectors, takes the k-th distance found as a bound, and then the shards that this bound does not rule out. Every vector is
stored and every shard is either scanned or ruled out, so results are those of comparing all.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..scratch import fresh_path, table

#: Pivots (a sample of so many vectors, whatever the corpus), rings per mean distance, queries searched at once.
PIVOTS, RINGS, QUERIES = 64, 4, 1024


@dataclass
class VectorIndex:
    """Where the vectors lie; pivots (one row each); shards (pivot, ring, n, lo, hi), at most PIVOTS times some rings."""

    path: str
    key: str
    kind: str
    pivots: object
    shards: object


def build(spark: SparkSession, vectors: DataFrame, key: str = "chunk_id", vector: str = "embedding", pivots: int = PIVOTS, path: str | None = None) -> VectorIndex:
    """Store the vectors (null ones have no place) by pivot and ring."""
    import numpy as np

    d = vectors.where(F.col(vector).isNotNull()).select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("v"))
    kind = dict(d.dtypes)["key"]
    sample = d.dropDuplicates(["v"]).orderBy(F.xxhash64("v", "key")).limit(pivots).collect()  # a bounded sample; any would do
    centres = np.array([r["v"] for r in sample], np.float64)
    sent = spark.sparkContext.broadcast(centres)

    def place(batches):
        import pyarrow as pa

        for batch in batches:
            x = np.array(batch.column(1).to_pylist(), np.float64)
            if not len(x):
                continue
            near, best = np.zeros(len(x), np.int32), np.full(len(x), np.inf)
            for i, c in enumerate(sent.value):
                dist = np.sqrt(((x - c) ** 2).sum(axis=1))
                near, best = np.where(dist < best, i, near).astype(np.int32), np.minimum(dist, best)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(near), pa.array(best)], names=["key", "v", "pivot", "dist"])

    placed = table(d.mapInArrow(place, f"key {kind}, v array<double>, pivot int, dist double"), "vectors-placed")
    width = (placed.agg(F.avg("dist")).head()[0] or 1.0) / RINGS
    path = path or fresh_path(spark, "vector-index")
    ringed = placed.withColumn("ring", F.floor(F.col("dist") / width).cast("int"))
    # rings that are large are split, small ones lie together; files hold ranges of pivot and ring, which filters skip
    ringed.repartitionByRange("pivot", "ring", F.xxhash64("key")).sortWithinPartitions("pivot", "ring").write.parquet(path)
    shards = spark.read.parquet(path).groupBy("pivot", "ring").agg(F.count(F.lit(1)).alias("n"), F.min("dist").alias("lo"), F.max("dist").alias("hi")).orderBy("pivot", "ring").toPandas()
    return VectorIndex(path, key, kind, centres, shards)


def _scan(spark: SparkSession, index: VectorIndex, ids, vectors, wanted, k: int, query_type: str) -> DataFrame:
    """(query_id, key, dist, rank): the k nearest among the wanted shards of each query. ids: an Arrow array; wanted: bool per query and shard."""
    import numpy as np

    s = index.shards
    asked = {(int(p), int(r)): np.flatnonzero(wanted[:, i]) for i, (p, r) in enumerate(zip(s["pivot"], s["ring"])) if wanted[:, i].any()}
    sent = spark.sparkContext.broadcast((ids, vectors, asked))
    names = spark.createDataFrame(sorted(asked) or [(-1, -1)], "pivot int, ring int")

    def score(batches):
        import pyarrow as pa

        ids, vectors, asked = sent.value
        for batch in batches:
            pivot, ring = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            x, keys = np.array(batch.column(3).to_pylist(), np.float64), batch.column(2)
            found: dict[int, list] = {}
            for p, r in set(zip(pivot.tolist(), ring.tolist())):
                rows = np.flatnonzero((pivot == p) & (ring == r))
                for q in asked.get((p, r), ()):
                    found.setdefault(int(q), []).append((rows, np.sqrt(((x[rows] - vectors[q]) ** 2).sum(axis=1))))
            asking, at, dist = [], [], []
            for q, parts in found.items():
                rows, near = np.concatenate([a for a, _ in parts]), np.concatenate([b for _, b in parts])
                rounded = np.round(near, 9)
                if len(rows) > k:  # all that tie with the k-th stay
                    keep = rounded <= np.partition(rounded, k - 1)[k - 1]
                    rows, near = rows[keep], near[keep]
                asking += [q] * len(rows)
                at.append(rows)
                dist.append(near)
            if at:
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(asking)), keys.take(pa.array(np.concatenate(at))), pa.array(np.concatenate(dist))], names=["query_id", "key", "dist"])

    d = spark.read.parquet(index.path).join(F.broadcast(names), ["pivot", "ring"], "left_semi").where(F.col("pivot").isin(*{p for p, _ in asked} or {-1}))
    d = d.select("pivot", "ring", "key", "v").mapInArrow(score, f"query_id {query_type}, key {index.kind}, dist double")
    w = Window.partitionBy("query_id").orderBy(F.round("dist", 9), "key")
    return d.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def search(spark: SparkSession, index: VectorIndex, queries: DataFrame, k: int = 20, per_block: int = QUERIES) -> tuple[DataFrame, float]:
    """((query_id, key, dist, rank), share of all comparisons that were made). Ties at nine decimals go to the lower key.

    queries: a stated set (query_id, query_vector), searched in blocks that the driver reads, sends and releases one by one.
    """
    import numpy as np
    import pyarrow as pa

    query_type = dict(queries.dtypes)["query_id"]
    q = table(queries.select("query_id", F.col("query_vector").cast("array<double>").alias("v")).where("v is not null"), "vector-queries")
    blocks = max(1, -(-q.count() // per_block))
    s = index.shards
    n, lo, hi, pivot = (s[c].to_numpy() for c in ("n", "lo", "hi", "pivot"))
    parts, compared, pairs = [], 0, 0
    for b in range(blocks):
        rows = q.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b).orderBy("query_id").toArrow()
        if not len(rows) or not len(s):
            continue
        ids, vectors = pa.concat_arrays(rows.column("query_id").chunks), np.array(rows.column("v").to_pylist(), np.float64)
        to = np.sqrt(((vectors[:, None, :] - index.pivots[None, :, :]) ** 2).sum(axis=2))[:, pivot]
        bound = np.maximum(np.maximum(lo[None, :] - to, to - hi[None, :]), 0.0)
        order = np.argsort(bound + 1e-3 * to, axis=1, kind="stable")
        filled = np.cumsum(n[order], axis=1) - n[order]
        first = np.zeros(bound.shape, bool)
        np.put_along_axis(first, order, filled < k, axis=1)
        near = table(_scan(spark, index, ids, vectors, first, k, query_type), "vectors-first")
        kth = {r["query_id"]: r["dist"] for r in near.where(F.col("rank") == k).select("query_id", "dist").collect()}  # a row per query of the block
        reach = np.array([kth.get(i, np.inf) for i in ids.to_pylist()])
        # distances compare at nine decimals; what the bound rules out is farther by more
        rest = (bound <= reach[:, None] + 1e-8) & ~first
        more = _scan(spark, index, ids, vectors, rest, k, query_type)
        w = Window.partitionBy("query_id").orderBy(F.round("dist", 9), "key")
        both = near.drop("rank").unionByName(more.drop("rank")).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
        parts.append(table(both, "vectors-near"))
        compared += int((n[None, :] * (first | rest)).sum())
        pairs += len(ids) * int(n.sum())
    out = reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], f"query_id {query_type}, key {index.kind}, dist double, rank int")
    return out.withColumnRenamed("key", index.key), compared / pairs if pairs else 0.0
