"""Line dedup: a suffix array over line-ID sequences by distributed prefix doubling, natively.

A document is its sequence of lines that hold a word. Lines get order-preserving ranks;
each doubling round ranks the prefix of 2^(k+1) lines of every suffix from the pair of
ranks (k at i, k at i + 2^k), so that suffixes sort by their first 2^(k+1) lines, and
equal ranks are the intervals whose longest common prefix reaches that depth. Suffixes
alone in their interval leave at once: they repeat nothing at this depth.

A repeated run counts when it holds at least `min_run_words` words. Such a run is the
union of its minimal windows: the shortest stretches, forwards from a line and backwards
from a line, that reach the limit. (A line p of a run lies in the forward window of p, or
in the last forward window that fits the run, or else between that window and p, and then
in the backward window of p.) A window has at most `min_run_words` lines, so doubling
ends at that depth; deeper intervals name no further line. A window of L lines is known
by the ranks of its first and last 2^floor(log2 L) lines. Windows that occur earlier, in
the order (doc_id, hash of the text, line), are later copies: their lines go, and
neighbouring ones merge into maximal runs with the blank lines between them.

Defined results: null text stays null; texts without lines to delete are unchanged; rows
with equal doc_id and text count as one document and share the verdict; a null doc_id is
the smallest; an empty table gives an empty one; other columns are carried along.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bucket_bits, discard, hash_bucket, hinted, prefix_sums, table, words

DOC = ["__d", "__t"]
MIN_LONG = -(2**63)


def _identity(docs: DataFrame, key: str, text: str) -> dict[str, Column]:
    return {"__d": F.coalesce(F.col(key).cast("long"), F.lit(MIN_LONG)), "__t": F.xxhash64(F.col(text))}


def _reach(lines: Column, start: Column, step: int, limit: int) -> Column:
    """Lines needed from `start` on (step 1) or back (step -1) to hold `limit` words; null when the text ends before."""
    near = F.slice(lines, start + 1, limit) if step > 0 else F.reverse(F.slice(lines, F.greatest(start + 2 - limit, F.lit(1)), F.least(start + 1, F.lit(limit))))
    zero = F.struct(F.lit(0).alias("w"), F.lit(0).alias("n"))
    sums = F.aggregate(near, zero, lambda s, x: F.when(s["w"] >= limit, s).otherwise(F.struct((s["w"] + x["w"]).alias("w"), (s["n"] + 1).alias("n"))))
    return F.transform(F.array(sums), lambda s: F.when(s["w"] >= limit, s["n"]))[0]


def line_table(docs: DataFrame, key: str, text: str, limit: int) -> DataFrame:
    """One row per line with a word: document, position among such lines, line number, hashes, words, window lengths."""
    ids = _identity(docs, key, text)
    lines = F.transform(F.split(F.coalesce(F.col(text), F.lit("")), "\n"), lambda x, i: F.struct(i.alias("no"), F.xxhash64(x).alias("h"), F.hash(x).alias("h2"), F.size(words(x)).alias("w")))
    d = docs.select(*[c.alias(n) for n, c in ids.items()], F.filter(lines, lambda x: x["w"] > 0).alias("__l"))
    marked = F.transform("__l", lambda x, i: F.struct(x["no"].alias("no"), x["h"].alias("h"), x["h2"].alias("h2"), x["w"].alias("w"), _reach(F.col("__l"), i, 1, limit).alias("fw"), _reach(F.col("__l"), i, -1, limit).alias("bw")))
    d = d.select(*DOC, F.posexplode(marked).alias("p", "x"))
    return d.select(*DOC, "p", "x.*")


def repeated_lines(lines: DataFrame) -> DataFrame:
    """Lines that occur twice or more, with rank r: the number of such lines that sort before."""
    classes = lines.groupBy("h", "h2").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    ranked = prefix_sums(classes, [], "h", "c", "r", hash_bucket(F.col("h"), bucket_bits(lines.count())), ["h2"]).select("h", "h2", "r")
    return table(lines.join(ranked, ["h", "h2"]).select(*DOC, "p", "no", "w", "fw", "bw", "r").dropDuplicates([*DOC, "p"]), "line-repeats")


def doubled(level: DataFrame, span: int) -> DataFrame:
    """(document, p, r) for prefixes of `span` lines to the same for 2 * span; prefixes that occur once leave."""
    ahead = level.select(*DOC, (F.col("p") - span).alias("p"), F.col("r").alias("r2"))
    pairs = level.join(ahead, [*DOC, "p"])
    classes = pairs.groupBy("r", "r2").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    ranked = prefix_sums(classes, ["r"], "r2", "c", "before", F.shiftright("r2", 10))
    ranked = ranked.select("r", "r2", (F.col("r") + F.col("before")).alias("new"))
    return pairs.join(ranked, ["r", "r2"]).select(*DOC, "p", F.col("new").alias("r"))


def later_windows(start: DataFrame, limit: int) -> tuple[DataFrame, list[DataFrame]]:
    """Windows (document, s, len) with an earlier equal window, given the repeated lines; and the tables they are read from."""
    levels = [start.select(*DOC, "p", "r")]
    while 2 ** len(levels) <= limit:
        levels.append(table(doubled(levels[-1], 2 ** (len(levels) - 1)), "line-ranks"))
    w = start.select(*DOC, F.explode(F.array_distinct(F.array(F.struct(F.col("p").alias("s"), F.col("fw").alias("len")), F.struct((F.col("p") - F.col("bw") + 1).alias("s"), F.col("bw").alias("len"))))).alias("x"), "p", "r").select(*DOC, "x.*", "p", "r").where("len is not null")
    single = w.where("len = 1").select(*DOC, "s", "len", F.col("r").alias("ra"), F.col("r").alias("rb"))
    wide = w.where("len > 1").select(*DOC, "s", "len").distinct()
    wide = wide.withColumn("k", F.floor(F.log2("len") + 1e-9).cast("int")).withColumn("q", F.col("s") + F.col("len") - F.expr("shiftleft(1, k)"))
    ranks = None
    for k, level in enumerate(levels[1:], 1):
        here = level.withColumn("k", F.lit(k))
        ranks = here if ranks is None else ranks.unionByName(here)
    all_windows = single.distinct()
    if ranks is not None:
        first = ranks.select(*DOC, "k", F.col("p").alias("s"), F.col("r").alias("ra"))
        last = ranks.select(*DOC, "k", F.col("p").alias("q"), F.col("r").alias("rb"))
        wide = wide.join(first, [*DOC, "k", "s"]).join(last, [*DOC, "k", "q"]).select(*DOC, "s", "len", "ra", "rb")
        all_windows = all_windows.unionByName(wide)
    all_windows = table(all_windows, "line-windows")
    discard(*levels[1:])
    at = F.struct(*DOC, "s")
    by = ["len", "ra", "rb"]
    # written on its own, so that the rows of a class that a third of all documents share can be split among tasks
    classes = table(all_windows.groupBy(*by).agg(F.min(at).alias("first"), F.count(F.lit(1)).alias("c")).where("c > 1").drop("c"), "line-window-classes")
    return all_windows.join(hinted(classes), by).where(at > F.col("first")).select(*DOC, "s", "len"), [all_windows, classes]


def repeated_runs(docs: DataFrame, key: str = "doc_id", text: str = "text", min_run_words: int = 10) -> DataFrame:
    """Maximal runs to delete: __d, __t, runs array<struct<from, to (line numbers), lines, words>>, in order."""
    lines = table(line_table(docs, key, text, min_run_words), "lines")
    start = repeated_lines(lines)
    discard(lines)
    later, used = later_windows(start, min_run_words)
    gone = later.select(*DOC, F.explode(F.sequence(F.col("s"), F.col("s") + F.col("len") - 1)).alias("p")).distinct()
    gone = gone.join(start.select(*DOC, "p", "no", "w"), [*DOC, "p"])
    island = F.col("p") - F.row_number().over(Window.partitionBy(*DOC).orderBy("p"))
    runs = gone.withColumn("g", island).groupBy(*DOC, "g").agg(F.min("no").alias("from"), F.max("no").alias("to"), F.count(F.lit(1)).alias("lines"), F.sum("w").alias("words"))
    runs = table(runs.groupBy(*DOC).agg(F.sort_array(F.collect_list(F.struct("from", "to", "lines", "words"))).alias("__runs")), "line-runs")
    discard(start, *used)
    return runs


def line_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", min_run_words: int = 10) -> DataFrame:
    """docs with later copies of repeated line runs deleted from `text`, plus lines_before and lines_removed (lines with a word)."""
    runs = repeated_runs(docs, key, text, min_run_words)
    d = docs.withColumns(_identity(docs, key, text)).join(hinted(runs), DOC, "left")
    lines = F.split(F.col(text), "\n")
    # the stretches between runs: from the end of one to the start of the next
    ends = F.concat(F.array(F.lit(-1)), F.transform("__runs", lambda x: x["to"]))
    starts = F.concat(F.transform("__runs", lambda x: x["from"]), F.array(F.size("__l")))
    d = d.withColumn("__l", F.when(F.col("__runs").isNotNull(), lines)).withColumn("__gaps", F.arrays_zip(ends.alias("e"), starts.alias("s")))
    kept = F.flatten(F.transform("__gaps", lambda g: F.slice(F.col("__l"), g["e"] + 2, g["s"] - g["e"] - 1)))
    removed = F.coalesce(F.aggregate("__runs", F.lit(0).cast("long"), lambda s, x: s + x["lines"]), F.lit(0).cast("long"))
    n = F.size(F.filter(F.split(F.coalesce(F.col(text), F.lit("")), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))).cast("long")
    d = d.withColumns({"lines_before": n, "lines_removed": removed})
    return d.withColumn(text, F.when(F.col("__runs").isNull(), F.col(text)).otherwise(F.array_join(kept, "\n"))).drop(*DOC, "__runs", "__l", "__gaps")
