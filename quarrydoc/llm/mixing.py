"""Mixing sources to target weights: temperature mixing, natively.

A source's token share p becomes the weight p^a / sum p^a. The exponent a in [0, 1] is
bisected: for a target entropy, the largest a whose weights reach it; for a repetition limit, the smallest a
under which no source is read more than `max_repeats` times. Each pass evaluates `WAYS`
exponents at once in one aggregation over the table of sources, and keeps the interval with
the sign change, so sources are never collected. The budget is given, or the smallest that
reads every source once in full.

The weights are realised as block permutations: source s owns budget * weight tokens, read
in whole passes and a part; each pass is its own permutation, documents by hash of (seed,
pass, document). A document's place in its source's stream is the running sum of tokens before
it; the place's share of the source's total names its block, so every one of `blocks` holds the
target mix up to one document per source. Running sums are taken in hash buckets, so no source is one task.

Defined results: a null source is a source of its own; documents without words count one
token, so that none is lost; repeated rows are separate documents; an empty table gives an empty result; other
columns are carried along.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import NULL_KEY, bucket_bits, hash_bucket, n_words, prefix_sums, table

WAYS = 33


def token_totals(docs: DataFrame, source: str, tokens: str) -> DataFrame:
    """One row per source: tokens t and share p."""
    t = docs.groupBy(F.coalesce(F.col(source), F.lit(NULL_KEY)).alias("__s")).agg(F.sum(tokens).cast("double").alias("t"))
    return t.join(F.broadcast(t.agg(F.sum("t").alias("all"))), how="cross").select("__s", "t", (F.col("t") / F.col("all")).alias("p"))  # one row


def _measures(totals: DataFrame, exponents: list[float], budget: float | None) -> list[tuple[float, float]]:
    """(entropy, most repeats) of the weights at each exponent, in one aggregation."""
    cols: list[Column] = []
    for i, a in enumerate(exponents):
        q = F.pow("p", F.lit(a))
        # weight / t is largest where p is smallest, smallest where p is largest
        cols += [F.sum(q).alias(f"z{i}"), F.sum(q * a * F.log("p")).alias(f"e{i}")]
    r = totals.agg(*cols, F.min("p").alias("lo"), F.max("p").alias("hi"), F.sum("t").alias("all")).head()
    out = []
    for i, a in enumerate(exponents):
        z = r[f"z{i}"]
        entropy = math.log(z) - r[f"e{i}"] / z
        least, most = r["hi"] ** (a - 1), r["lo"] ** (a - 1)  # repeats are proportional to p^(a - 1)
        repeats = most / least if budget is None else budget / r["all"] * most / z
        out.append((entropy, repeats))
    return out


def exponent(totals: DataFrame, entropy: float | None = None, max_repeats: float | None = None, budget: float | None = None, passes: int = 5) -> float:
    """The bisected exponent; entropy falls and repeats fall as it grows."""
    if (entropy is None) == (max_repeats is None):
        raise ValueError("give a target entropy or a repetition limit")
    lo, hi = 0.0, 1.0
    for _ in range(passes):
        grid = [lo + (hi - lo) * i / (WAYS - 1) for i in range(WAYS)]
        got = _measures(totals, grid, budget)
        if entropy is not None:  # the largest exponent with enough entropy
            fits = [i for i, (e, _) in enumerate(got) if e >= entropy - 1e-12]
            i = max(fits, default=0)
            lo, hi = grid[i], grid[min(i + 1, WAYS - 1)]
        else:  # the smallest exponent within the limit
            fits = [i for i, (_, m) in enumerate(got) if m <= max_repeats + 1e-12]
            i = min(fits, default=WAYS - 1)
            lo, hi = grid[max(i - 1, 0)], grid[i]
    return lo if entropy is not None else hi


def weights(totals: DataFrame, a: float, budget: float | None) -> DataFrame:
    """One row per source: t, weight, quota (tokens)."""
    q = totals.withColumn("q", F.pow("p", F.lit(a)))
    z = q.agg(F.sum("q").alias("z"), F.max(F.col("t") / F.col("q")).alias("once"))
    tokens = F.lit(float(budget)) if budget is not None else F.col("once") * F.col("z")
    d = q.join(F.broadcast(z), how="cross")  # one row
    return d.select("__s", "t", (F.col("q") / F.col("z")).alias("weight"), (F.col("q") / F.col("z") * tokens).alias("quota"))


def mix(docs: DataFrame, source: str = "source", key: str = "doc_id", text: str = "text", entropy: float | None = None, max_repeats: float | None = 2.0, budget: float | None = None, blocks: int = 64, seed: int = 17, row: Column | None = None, bucket_rows: int = 2_000) -> DataFrame:
    """Rows (key, __s, __row, tokens, copy, stream_start, block): one per reading of a document, in no physical order.

    row: the hash that tells rows apart and orders them, by default that of key and text.
    """
    tokens = F.greatest(n_words(F.col(text)), F.lit(1)).cast("long")
    d = docs.select(F.col(key), F.coalesce(F.col(source), F.lit(NULL_KEY)).alias("__s"), tokens.alias("tokens"), (F.xxhash64(key, text) if row is None else row).alias("__row"))
    d = table(d, "mix-rows")
    totals = table(token_totals(d, "__s", "tokens"), "mix-totals")
    if not totals.head(1):
        a = 1.0
    else:
        a = exponent(totals, entropy, max_repeats if entropy is None else None, budget)
    quotas = table(weights(totals, a, budget), "mix-weights")
    passes = d.join(quotas.select("__s", "t", "quota"), "__s").withColumn("copy", F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.col("quota") / F.col("t") - 1e-9) - 1, F.lit(0)).cast("int"))))
    passes = passes.withColumn("h", F.xxhash64(F.lit(seed), "copy", "__row"))
    run = prefix_sums(passes, ["__s", "copy"], "h", "tokens", "before", hash_bucket(F.col("h"), bucket_bits(d.count(), bucket_rows)), [key])
    run = run.withColumn("stream_start", (F.col("copy") * F.col("t")).cast("long") + F.col("before"))
    # a reading counts when it starts within the quota; of the first pass of a source read in full all do, whatever the rounding
    whole = (F.col("copy") == 0) & (F.col("quota") >= F.col("t") * (1 - 1e-9))
    run = run.where(whole | (F.col("stream_start") < F.col("quota") - 0.5))
    block = F.least(F.floor(F.col("stream_start") / F.col("quota") * blocks), F.lit(blocks - 1)).cast("int")
    return run.select(key, "__s", "__row", "tokens", "copy", "stream_start", block.alias("block"))
