"""Exact nearest neighbours by Euclidean distance for many queries at once.

Queries are a stated set and travel to the data, in blocks of checked size: a block is read by the driver, sent, searched
and released before the next. Each task scores its batches with vector arithmetic and passes on k rows per query (and
group), so what is shuffled is k rows per query and batch, never all pairs.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import table

BLOCK_BYTES = 32 * 2**20


def _scan(chunks: DataFrame, sent, query_type: str, k: int, key: str, vector: str, group: str | None) -> DataFrame:
    """(query_id, key, [group,] dist): the k nearest per query, batch and group; sent: broadcast (ids, vectors)."""
    kinds = dict(chunks.dtypes)
    cols = [F.col(key)] + ([F.col(group)] if group else []) + [F.col(vector)]
    schema = f"query_id {query_type}, {key} {kinds[key]}, " + (f"{group} {kinds[group]}, " if group else "") + "dist double"

    def score(frames):
        import numpy as np
        import pandas as pd

        ids, vectors = sent.value
        for pdf in frames:
            pdf = pdf[pdf[vector].notna()]
            if not len(pdf) or not len(ids):
                continue
            x = np.stack(pdf[vector].to_numpy()).astype(np.float64)
            labels, tie = pdf[key].to_numpy(), np.argsort(pdf[key].to_numpy(), kind="stable")
            x, labels = x[tie], labels[tie]
            groups = pdf[group].to_numpy()[tie] if group else None
            parts = []
            for i, v in enumerate(vectors):
                d = np.sqrt(((x - v) ** 2).sum(axis=1))
                order = np.argsort(np.round(d, 9), kind="stable")
                if group:
                    order = order[pd.Series(groups[order]).groupby(groups[order], dropna=False).cumcount().to_numpy() < k]
                else:
                    order = order[:k]
                parts.append((i, order, d[order]))
            at = np.concatenate([o for _, o, _ in parts])
            out = {"query_id": np.repeat(np.array(ids, dtype=object), [len(o) for _, o, _ in parts]), key: labels[at]}
            if group:
                out[group] = groups[at]
            yield pd.DataFrame(out | {"dist": np.concatenate([d for _, _, d in parts])})

    return chunks.select(*cols).mapInPandas(score, schema)


def knn(chunks: DataFrame, queries: DataFrame, k: int = 20, key: str = "chunk_id", vector: str = "embedding", group: str | None = None) -> DataFrame:
    """(query_id, key, [group,] dist, rank): the k nearest per query, or per query and group. Ties at nine decimals go to the lower key."""
    import numpy as np

    context = chunks.sparkSession.sparkContext
    n, width = queries.agg(F.count(F.lit(1)), F.max(F.size("query_vector"))).head()
    blocks = max(1, -(-n * 8 * (width or 1) // BLOCK_BYTES))
    w = Window.partitionBy("query_id", *([group] if group else [])).orderBy(F.round("dist", 9), key)
    best = lambda d: d.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    parts = []
    for b in range(blocks):
        rows = queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b).select("query_id", "query_vector").collect()
        sent = context.broadcast(([r[0] for r in rows], np.array([r[1] for r in rows], np.float64)))
        near = best(_scan(chunks, sent, dict(queries.dtypes)["query_id"], k, key, vector, group))
        if blocks == 1:
            return near
        parts.append(table(near, "knn-block"))
        sent.destroy()
    return reduce(DataFrame.unionByName, parts)
