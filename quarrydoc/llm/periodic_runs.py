"""Periodic runs: stretches of words that repeat with a period, by comparing the words with themselves at every lag.

A run is a stretch of consecutive words whose smallest period is q, at least `min_exponent` periods and
`min_words` words long, that no neighbouring word extends with that period. Words become numbers; for each lag q up to
n / min_exponent the array is compared with itself shifted by q, and true stretches long enough are runs. A
stretch that is found at several lags has the smallest as its period: with two periods or more in it,
another lag can only be a multiple.

The comparisons of a document grow with the square of its words. A document of more than `UNIT` comparisons is cut into ranges of
lags of about that many (or of `SHIFTS` lags, if these are more), which are dealt to tasks one by one; the runs of its ranges
meet again in one row, of which a document has fewer than words. Nothing is cut off: every lag of every document is compared.

Defined results: null text has no words; each row is treated on its own, whatever its id (null or repeated); documents shorter
than `min_words` have no run; an empty table gives no rows; very long texts are read whole; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, table, words

#: Comparisons of one unit of work, and the lags that one has at least.
UNIT, SHIFTS = 2**25, 1024
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


def word_ids(text: str | None):
    """The words of a text (split where `common.words` splits) and their numbers."""
    import numpy as np

    ws = (text or "").encode("utf-8", "surrogatepass").split()
    seen: dict[bytes, int] = {}
    return ws, np.array([seen.setdefault(w, len(seen)) for w in ws], np.int32)


def lag_runs(ids, lags: range, min_exponent: int, min_words: int) -> list[tuple[int, int, int]]:
    """(start, length, lag) of the stretches that repeat at each lag and are long enough for a run."""
    import numpy as np

    out = []
    for q in lags:
        same = ids[q:] == ids[:-q]
        need = max(min_words, min_exponent * q) - q
        if np.count_nonzero(same) < need:
            continue
        edge = np.flatnonzero(np.diff(np.concatenate(([0], same.view(np.int8), [0]))))
        size = edge[1::2] - edge[::2]
        out += [(int(edge[2 * i]), int(size[i]) + q, q) for i in np.flatnonzero(size >= need)]
    return out


def smallest_periods(found: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Runs by start, then period: each stretch once, with its smallest lag."""
    best: dict[tuple[int, int], int] = {}
    for start, length, q in found:
        best[start, length] = min(q, best.get((start, length), q))
    return sorted(((s, n, q) for (s, n), q in best.items()), key=lambda r: (r[0], r[2]))


def collapse(ws: list[bytes], runs: list[tuple[int, int, int]]) -> str:
    """The words that no run repeats: those after a run's first period go."""
    import numpy as np

    edge = np.zeros(len(ws) + 1, np.int64)
    for start, length, q in runs:
        edge[start + q] += 1
        edge[start + length] -= 1
    gone = np.cumsum(edge[:-1]) > 0
    return b" ".join(w for w, g in zip(ws, gone.tolist()) if not g).decode("utf-8", "surrogatepass")


def lag_range(n: int, unit: int, units: int, min_exponent: int) -> range:
    """The lags of one of `units` shares of about equally many comparisons; lag q compares n - q pairs."""
    import numpy as np

    last = n // min_exponent
    done = np.cumsum(n - np.arange(1, last + 1, dtype=np.int64)) if last else np.zeros(0, np.int64)
    lo, hi = (int(np.searchsorted(done, done[-1] * u // units, "right")) if last and u < units else last for u in (unit, unit + 1))
    return range(1 if unit == 0 else lo + 1, hi + 1)


def _summary(items, min_exponent: int):
    import pyarrow as pa

    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
    ids, counts, runs, texts = [], [], [], []
    for doc_id, ws, found in items:
        ids.append(doc_id)
        counts.append(len(ws))
        runs.append([{"start": s, "length": n, "period": q} for s, n, q in found])
        texts.append(collapse(ws, found))
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(counts, pa.int64()), pa.array(runs, kind), pa.array(texts, pa.string())], names=["doc_id", "n_words", "runs", "collapsed"])


def periodic_runs(docs: DataFrame, key: str = "doc_id", text: str = "text", min_exponent: int = 4, min_words: int = 6, unit: int = UNIT) -> DataFrame:
    """doc_id, n_words, runs (by start, then period) and collapsed (the text without what runs repeat) of every row."""
    if min_exponent < 2:
        raise ValueError("a run has two periods at least")
    result = f"doc_id long, n_words long, runs {RUNS}, collapsed string"

    def whole(batches):
        for batch in batches:
            items = []
            for doc_id, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                ws, ids = word_ids(t.as_py())
                found = lag_runs(ids, range(1, len(ids) // min_exponent + 1), min_exponent, min_words)
                items.append((doc_id, ws, smallest_periods(found)))
            yield _summary(items, min_exponent)

    def part(batches):
        import pyarrow as pa

        kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
        for batch in batches:
            found = []
            for t, u, units in zip(batch.column(1), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                ids = word_ids(t.as_py())[1]
                rows = lag_runs(ids, lag_range(len(ids), u, units, min_exponent), min_exponent, min_words)
                found.append([{"start": s, "length": n, "period": q} for s, n, q in smallest_periods(rows)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, kind)], names=["row", "runs"])

    def joined(batches):
        for batch in batches:
            items = []
            for doc_id, t, runs in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                items.append((doc_id, word_ids(t.as_py())[0], smallest_periods([(r["start"], r["length"], r["period"]) for r in runs])))
            yield _summary(items, min_exponent)

    d = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    # a text of c characters has (c + 1) / 2 words at most; words are counted only where that many could be too much work
    work = lambda n: n * n * (2 * min_exponent - 1) / (2 * min_exponent * min_exponent)
    most = F.floor((F.length("text") + 1) / 2)
    n = F.when(work(most) > unit, F.size(words(F.col("text")))).otherwise(F.lit(0)).cast("double")
    units = let(n, lambda n: F.least(F.ceil(work(n) / unit), F.ceil(n / (min_exponent * SHIFTS))).cast("int"))
    sized = d.withColumn("units", units)
    long = table(sized.where("units > 1").select(F.monotonically_increasing_id().alias("row"), "doc_id", "text", "units"), "runs-long")
    short = sized.where("units <= 1").select("doc_id", "text").mapInArrow(whole, result)
    shares = long.select("row", "text", F.explode(F.sequence(F.lit(0), F.col("units") - 1)).alias("unit"), "units").repartition("row", "unit")
    found = shares.mapInArrow(part, f"row long, runs {RUNS}")
    found = found.groupBy("row").agg(F.flatten(F.collect_list("runs")).alias("runs"))
    return short.unionByName(long.join(found, "row").select("doc_id", "text", "runs").mapInArrow(joined, result))


def densest(runs: Column) -> Column:
    """The run with the greatest length / period, compared exactly; of equals the first. Null without runs."""
    denser = lambda a, b: b["length"] * a["period"] > a["length"] * b["period"]
    return F.when(F.size(runs) > 0, F.reduce(runs, F.get(runs, F.lit(0)), lambda a, b: F.when(denser(a, b), b).otherwise(a)))


def runs_text(runs: Column) -> Column:
    """start,length,period and LF for every run."""
    line = lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))
    return F.array_join(F.transform(runs, line), "")


def planted(docs: DataFrame) -> DataFrame:
    """doc_id and text with periods planted by the checksum of the id, in a tenth of the documents; the others stay as they are."""
    h = F.crc32(F.col("doc_id").cast("string"))

    def text(x: Column) -> Column:
        ws, n, g = x["ws"], F.size(x["ws"]), x["g"]
        a = (g % n).cast("int")
        p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
        tail = F.flatten(F.array_repeat(F.slice(ws, a + 1, p), F.ceil((n - a) / p).cast("int")))
        return F.when(n > 0, F.array_join(F.concat(F.slice(ws, F.lit(1), a), F.slice(tail, F.lit(1), n - a)), " "))

    changed = let(F.struct(words(F.col("text")).alias("ws"), F.floor(h / 10).alias("g")), text)
    return docs.select("doc_id", F.coalesce(F.when(h % 10 == 0, changed), F.col("text")).alias("text"))
