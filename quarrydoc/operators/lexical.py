"""BM25 over per-session corpora: statistics, a stored index that grows by segments, search by block bounds.

The index is made of tables of a snapshot store (`sources.snapshots`). Chunks come in as segments: only their texts are split into tokens, once. A
session's chunks of a segment are cut into slices of about `SLICE` chunks of similar length. A posting block is a row per term and
slice: the chunks with their counts and lengths, and over them the highest count and the least length, which bound what any of them can score under
whatever statistics are in force. Statistics are sums over segments; a row per session and version gives its chunks, tokens and mean idf.
Deleted sessions are hidden at once and go with `compact_index`.

A search first reads block heads alone. The slices with the highest bounds give each query k scores to beat; blocks of slices whose summed bound stays
below are skipped, as nothing in them can enter the first k. Results are those of scoring every posting.

A few questions need no index: `bm25_search` without one answers them from the texts, with the same results.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..scratch import discard, fresh_path, hinted, is_small, table
from ..sources import snapshots
from ..sources.snapshots import GONE, Snapshot

K1, B, EPSILON = 1.5, 0.75, 0.25
#: Chunks of a slice; folders of a segment's blocks, by session; slices per query that are scored for a first bound, at least.
SLICE, PARTS, SEEDS = 128, 256, 4
#: Tokens of a task of the build: some tasks per core, between these bounds. What a task sorts stays in memory at any size of the collection.
TASK_TOKENS = (250_000, 1_000_000)
#: More names than these are joined, not listed in a filter.
LISTED = 500
POSTINGS = "part int, session string, term string, slice long, n int, max_tf int, min_dl long, docs array<struct<chunk:string,tf:int,dl:bigint>>"
LENGTHS = "session string, chunk string, dl long"
STATS = "session string, n long, tokens long, mean_idf double"
TABLES = ("postings", "lengths", "stats")


#: Rows whose words are counted at once; pairs of a text and a question that are scored at once, about.
COUNTED, CELLS = 256, 2**21
#: What ranks by nine decimals, and sums in another order, can differ from the scores.
TIE = 2e-9


def postings(chunks: DataFrame, session: str = "chat_session_id", key: str = "chunk_id", text: str = "text") -> DataFrame:
    """(session, term, chunk, tf): one row per chunk and distinct term. Texts, not words, are dealt by chunk; words are counted in Arrow where the chunk lies."""
    from pyspark.sql.types import LongType, StringType, StructField, StructType

    kinds = {f.name: f.dataType for f in chunks.select(session, key).schema}
    out = StructType([StructField(session, kinds[session]), StructField("term", StringType()), StructField(key, kinds[key]), StructField("tf", LongType())])

    def count(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        def counted(rows, run):
            words = pc.split_pattern(rows["words"].combine_chunks(), " ")
            coded = words.flatten().dictionary_encode()
            owner = np.repeat(run - run[0], words.value_lengths().to_numpy(zero_copy_only=False))
            pairs, tf = np.unique(owner * len(coded.dictionary) + coded.indices.to_numpy(), return_counts=True)
            at = pa.array(np.searchsorted(run - run[0], pairs // len(coded.dictionary)))
            columns = [rows[session].combine_chunks().take(at), coded.dictionary.take(pa.array(pairs % len(coded.dictionary))), rows[key].combine_chunks().take(at), pa.array(tf.astype(np.int64))]
            return pa.RecordBatch.from_arrays(columns, names=[session, "term", key, "tf"])

        def runs(rows):
            """The number of each row's run of rows with one session and chunk."""
            new = np.zeros(rows.num_rows, bool)
            for name in (session, key):
                codes = rows[name].combine_chunks().dictionary_encode("encode").indices.to_numpy()
                new[1:] |= codes[1:] != codes[:-1]
            return np.cumsum(new).astype(np.int64)

        open_ = None  # the rows of the last chunk seen, which may go on
        for batch in batches:
            for start in range(0, batch.num_rows, COUNTED):
                rows = pa.Table.from_batches([batch.slice(start, COUNTED)])
                rows = rows if open_ is None else pa.concat_tables([open_, rows])
                run = runs(rows)
                cut = int(np.searchsorted(run, run[-1]))
                if cut:
                    yield counted(rows.slice(0, cut), run[:cut])
                open_ = rows.slice(cut)
        if open_ is not None:
            yield counted(open_, runs(open_))

    words = F.coalesce(F.array_join(tokens(F.col(text)), " "), F.lit("")).alias("words")
    d = chunks.repartition(session, key).sortWithinPartitions(session, key).select(session, key, words)
    return d.mapInArrow(count, out).where("term <> ''")


def lengths(chunks: DataFrame, session: str = "chat_session_id", key: str = "chunk_id", text: str = "text") -> DataFrame:
    return chunks.select(session, key, F.size(tokens(F.col(text))).cast("long").alias("dl"))


def corpus_stats(dl: DataFrame, session: str = "chat_session_id") -> DataFrame:
    return dl.groupBy(session).agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"))


def document_frequency(chunks: DataFrame, session: str = "chat_session_id", text: str = "text") -> DataFrame:
    """(session, term, df): each chunk's terms are made distinct where the chunk is, so only counts are shuffled."""
    return chunks.select(session, F.explode(F.array_distinct(tokens(F.col(text)))).alias("term")).groupBy(session, "term").agg(F.count(F.lit(1)).alias("df"))


def plain_idf(n: Column, df: Column) -> Column:
    return F.log(n - df + 0.5) - F.log(df + 0.5)


def floored_idf(idf: Column, mean: Column) -> Column:
    """Negative idf becomes a quarter of the session's mean idf."""
    return F.when(idf < 0, mean * EPSILON).otherwise(idf)


def term_stats(posts: DataFrame, stats: DataFrame, session: str = "chat_session_id") -> DataFrame:
    """(session, term, df, idf); negative idf becomes a quarter of the session's mean idf. posts: postings, or document_frequency."""
    df = posts if "df" in posts.columns else posts.groupBy(session, "term").agg(F.count(F.lit(1)).alias("df"))
    raw = df.join(stats.select(session, "n"), session).withColumn("idf0", plain_idf(F.col("n"), F.col("df")))
    mean = raw.groupBy(session).agg(F.avg("idf0").alias("mean_idf"))
    return raw.join(mean, session).select(session, "term", "df", floored_idf(F.col("idf0"), F.col("mean_idf")).alias("idf"))


def part_score(tf: Column, dl: Column, avgdl: Column) -> Column:
    """A term's part of a score, without its idf: rises with tf, falls with dl."""
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / avgdl))


def _class(dl: Column) -> Column:
    """Chunks of one class differ in length by less than half."""
    return F.floor(2 * F.log2(dl + 1.0)).cast("long")


def _placed(rows: DataFrame, sizes: DataFrame) -> DataFrame:
    """rows (session, chunk, dl, ...) with their slice, dealt so that a slice lies in one task and tasks hold about equally many tokens.

    sizes: a table (session, class, chunks, tokens) over the same chunks.
    """
    part = F.pmod(F.xxhash64("session"), F.lit(PARTS)).cast("int")
    least, most = TASK_TOKENS
    total = sizes.agg(F.sum("tokens")).head()[0] or 0
    share = max(least, min(most, total // (4 * rows.sparkSession.sparkContext.defaultParallelism)))
    shards = sizes.groupBy(part.alias("part")).agg(F.ceil(F.sum("tokens") / share).alias("shards"))  # PARTS rows at most
    known = sizes.select("session", "class", F.greatest(F.lit(1), F.ceil(F.col("chunks") / SLICE)).alias("slices"))
    known = F.broadcast(known) if is_small(sizes) else known
    # every row has its size, so the left join loses none; an inner one would have the class made once more to see that it is not null
    d = rows.where("session is not null").withColumns({"class": _class(F.col("dl")), "part": part}).join(known, ["session", "class"], "left").join(F.broadcast(shards), "part")
    d = d.withColumn("slice", F.col("class") * F.lit(1 << 40) + F.pmod(F.xxhash64("chunk"), F.col("slices")))
    return d.withColumn("shard", F.pmod(F.xxhash64("session", "slice"), F.greatest(F.lit(1), F.col("shards")))).repartition(int(2 * total // share + 1), "part", "shard").drop("class", "slices", "shards")


def _written(blocks: DataFrame) -> Callable[[str], None]:
    return lambda path: blocks.sortWithinPartitions("part", "session", "term", "slice").write.option("compression", "zstd").partitionBy("part").parquet(path)


def _slice_blocks(part: int, session: str | None, slice_: int, chunks, words, dl):
    """The posting blocks of one slice: its chunks, their words (lists) and lengths as Arrow arrays."""
    import numpy as np
    import pyarrow as pa

    coded = words.flatten().dictionary_encode()
    owner = np.repeat(np.arange(len(chunks)), words.value_lengths().to_numpy(zero_copy_only=False))
    pairs, tf = np.unique(coded.indices.to_numpy().astype(np.int64) * len(chunks) + owner, return_counts=True)
    code, at = pairs // len(chunks), pairs % len(chunks)
    first = np.flatnonzero(np.append(True, code[1:] != code[:-1]))
    dl = dl.to_numpy(zero_copy_only=False)[at]
    n, tf = np.diff(np.append(first, len(pairs))).astype(np.int32), tf.astype(np.int32)
    docs = pa.StructArray.from_arrays([chunks.take(pa.array(at)), pa.array(tf), pa.array(dl)], ["chunk", "tf", "dl"])
    docs = pa.ListArray.from_arrays(pa.array(np.append(first, len(pairs)).astype(np.int32)), docs)
    whole = lambda v, kind: pa.repeat(pa.scalar(v, kind), len(first))
    columns = [whole(part, pa.int32()), whole(session, pa.string()), coded.dictionary.take(pa.array(code[first])), whole(slice_, pa.int64()), pa.array(n), pa.array(np.maximum.reduceat(tf, first)), pa.array(np.minimum.reduceat(dl, first)), docs]
    return pa.RecordBatch.from_arrays(columns, names=["part", "session", "term", "slice", "n", "max_tf", "min_dl", "docs"])


def _blocks_of_words(placed: DataFrame) -> Callable[[str], None]:
    """A writer of posting blocks from placed chunks (part, shard, session, slice, chunk, dl, words): words are counted slice by slice, where the slice lies."""

    def build(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        def blocks(rows):
            part, session, at = (rows.column(n)[0].as_py() for n in ("part", "session", "slice"))
            return _slice_blocks(part, session, at, rows["chunk"].combine_chunks(), pc.split_pattern(rows["words"].combine_chunks(), " "), rows["dl"].combine_chunks())

        open_ = None  # the rows of the last slice seen, which may go on in the next batch
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = rows.filter(pc.greater(rows["dl"], 0))
            rows = rows if open_ is None else pa.concat_tables([open_, rows])
            if not rows.num_rows:
                continue
            at = rows["slice"].to_numpy()
            own = pc.fill_null(rows["session"], "").combine_chunks().dictionary_encode().indices.to_numpy()
            cuts = np.flatnonzero((at[1:] != at[:-1]) | (own[1:] != own[:-1])) + 1
            for start, end in zip(np.append(0, cuts), cuts):
                yield blocks(rows.slice(start, end - start))
            open_ = rows.slice(cuts[-1] if len(cuts) else 0)
        if open_ is not None and open_.num_rows:
            yield blocks(open_)

    d = placed.select("part", "session", "slice", "chunk", "dl", "words").sortWithinPartitions("part", "session", "slice")
    return _written(d.mapInArrow(build, POSTINGS))


def _merged_stats(spark: SparkSession, path: str, touched: DataFrame, fresh: DataFrame) -> Callable[[Snapshot, Snapshot], dict[str, DataFrame]]:
    """The rows of `stats` after a segment came in: sums over all segments of the sessions touched; postings give their counts, no text is read.

    touched: a table (session) of the sessions; fresh: (session, n, tokens) of the new segment.
    """

    def derive(base: Snapshot, new: Snapshot) -> dict[str, DataFrame]:
        named = hinted(touched)
        before = in_force(spark, path, _without_gone(base, new), raw=True).join(named, "session", "left_semi").select("session", "n", "tokens")
        sums = before.unionByName(fresh).groupBy("session").agg(F.sum("n").alias("n"), F.sum("tokens").alias("tokens"))
        df = _postings(spark, path, new).select("session", "term", "n").join(named, "session", "left_semi").groupBy("session", "term").agg(F.sum("n").alias("df"))
        mean = df.join(sums, "session").groupBy("session").agg(F.avg(plain_idf(F.col("n"), F.col("df"))).alias("mean_idf"))
        return {"stats": sums.join(mean, "session", "left").select("session", "n", "tokens", "mean_idf")}

    return derive


def _without_gone(base: Snapshot, new: Snapshot) -> Snapshot:
    """The older batches under the deletions of the newer snapshot."""
    return Snapshot(new.version, base.batches | {GONE: new.of(GONE)}, new.done)


def segment(chunks: DataFrame, session: str = "chat_session_id", key: str = "chunk_id", text: str = "text"):
    """(rows for `snapshots.publish`, derive, tables to discard afterwards) that add chunks to the index of a store.

    The first table has a row (session, chunk, dl) per chunk. Texts are read twice, for their lengths and for their words, so that no copy of the words is written.
    """
    # a one-element array binds the tokens to a variable, so that they are made once per text
    found = F.transform(F.array(F.coalesce(tokens(F.col(text)), F.array().cast("array<string>"))), lambda x: F.struct(F.array_join(x, " ").alias("words"), F.size(x).cast("long").alias("dl")))[0]
    c = chunks.select(F.col(session).cast("string").alias("session"), F.col(key).cast("string").alias("chunk"), found.alias("t")).select("session", "chunk", "t.*")
    dl = table(lengths(chunks.select(F.col(session).cast("string").alias("session"), F.col(key).cast("string").alias("chunk"), F.coalesce(text, F.lit("")).alias("text")), "session", "chunk"), "bm25-lengths")
    sizes = table(dl.groupBy("session", _class(F.col("dl")).alias("class")).agg(F.count(F.lit(1)).alias("chunks"), F.sum("dl").alias("tokens")), "bm25-sizes")
    fresh = sizes.groupBy("session").agg(F.sum("chunks").alias("n"), F.sum("tokens").alias("tokens"))
    touched = table(fresh.select("session"), "bm25-sessions")
    rows = {"postings": _blocks_of_words(_placed(c, sizes)), "lengths": dl}
    return rows, lambda path: _merged_stats(chunks.sparkSession, path, touched, fresh), [dl, sizes, touched]


def add_to_index(chunks: DataFrame, path: str, session: str = "chat_session_id", key: str = "chunk_id", text: str = "text", once: tuple[str, int] | None = None, anew: bool = False) -> Snapshot:
    """Add chunks that are not in the index yet as a segment. once: as in `snapshots.publish`. anew: their sessions hold these chunks alone from now on."""
    spark = chunks.sparkSession
    if once and snapshots.current(spark, path).done.get(once[0], -1) >= once[1]:
        return snapshots.current(spark, path)
    rows, derive, used = segment(chunks, session, key, text)
    if anew:
        rows[GONE] = used[-1].select("session")
    s = snapshots.publish(spark, path, rows, derive(path), once)
    discard(*used)
    return s


def build_index(chunks: DataFrame, path: str, session: str = "chat_session_id", key: str = "chunk_id", text: str = "text") -> None:
    """Write, or write anew, the index of all sessions in `chunks` under `path`. Other sessions stay as they are."""
    add_to_index(chunks, path, session, key, text, anew=bool(snapshots.versions(chunks.sparkSession, path)))


def invalidate(spark: SparkSession, path: str, sessions: DataFrame, session: str = "chat_session_id") -> None:
    """Take the sessions named out of the index."""
    snapshots.delete_sessions(spark, path, sessions.select(session))


def _moves(blocks: DataFrame) -> tuple[DataFrame, int]:
    """A table (session, batch, slice, to, alone, postings) of the numbers that slices take in one segment, and the tasks that merge those not alone.

    A slice has as many chunks at least as its commonest term has, and as its postings fill at the greatest length of its class; merged slices
    have about SLICE of these together.
    """
    base = F.lit(1 << 40)
    d = blocks.groupBy("session", "batch", "slice").agg(F.max("n").alias("most"), F.sum("n").alias("postings")).withColumn("class", F.floor(F.col("slice") / base))
    d = d.withColumn("chunks", F.greatest(F.col("most").cast("double"), F.col("postings") / F.pow(F.lit(2.0), (F.col("class") + 1) / 2))).withColumn("whole", F.col("chunks") >= SLICE / 2)
    w = Window.partitionBy("session", "class", "whole").orderBy("batch", "slice")
    before = F.coalesce(F.sum("chunks").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    number = F.when(F.col("whole"), 2 * F.row_number().over(w)).otherwise(2 * F.floor(before / SLICE) + 1)
    d = d.withColumn("to", (F.col("class") * base + number).cast("long"))
    d = table(d.withColumn("alone", F.count(F.lit(1)).over(Window.partitionBy("session", "to")) == 1).select("session", "batch", "slice", "to", "alone", "postings"), "bm25-moves")
    moved = d.where("not alone").agg(F.sum("postings")).head()[0] or 0
    return d, int(2 * moved // TASK_TOKENS[1] + 1)


def rewritten(spark: SparkSession, path: str) -> dict[str, Callable[[Snapshot], snapshots.Rows]]:
    """For `snapshots.compact`: the index tables as one segment. Slices of half the size or more only take new numbers, where they lie; smaller ones of a class are merged whole."""

    def blocks(s: Snapshot) -> Callable[[str], None]:
        moves, n = _moves(_postings(spark, path, s))
        d = _postings(spark, path, s).join(hinted(moves), ["session", "batch", "slice"]).select("part", "session", "term", F.col("to").alias("slice"), "n", "max_tf", "min_dl", "docs", "alone")
        agg = [F.sum("n").cast("int").alias("n"), F.max("max_tf").alias("max_tf"), F.min("min_dl").alias("min_dl"), F.flatten(F.collect_list("docs")).alias("docs")]
        few = d.where("not alone").repartition(n, "part", "session", "slice").groupBy("part", "session", "term", "slice").agg(*agg)
        return _written(d.where("alone").drop("alone").unionByName(few))

    return {
        "postings": blocks,
        "lengths": lambda s: snapshots.scan(spark, path, "lengths", LENGTHS, s).drop("batch", "since"),
        "stats": lambda s: in_force(spark, path, s, raw=True).drop("since"),
    }


def compact_index(spark: SparkSession, path: str, keep: int = 1) -> Snapshot:
    """One segment in place of all; versions but the last `keep`, and what only they name, go."""
    s = snapshots.compact(spark, path, rewritten(spark, path))
    snapshots.vacuum(spark, path, keep)
    return s


def segments(spark: SparkSession, path: str) -> int:
    return len(snapshots.current(spark, path).of("postings"))


def _postings(spark: SparkSession, path: str, s: Snapshot) -> DataFrame:
    return snapshots.scan(spark, path, "postings", POSTINGS, s)


def in_force(spark: SparkSession, path: str, snapshot: Snapshot | None = None, raw: bool = False) -> DataFrame:
    """(session, n, avgdl): the statistics in force of each session that has chunks; raw: with tokens, mean_idf and since in place of avgdl."""
    d = snapshots.scan(spark, path, "stats", STATS, snapshot)
    last = d.groupBy("session").agg(F.max_by(F.struct("n", "tokens", "mean_idf", "since"), "since").alias("x")).select("session", "x.*").where("n > 0")
    return last if raw else last.select("session", "n", (F.col("tokens") / F.col("n")).alias("avgdl"))


def _listed(d: DataFrame, column: str, values: set) -> DataFrame:
    """A filter that reaches the files, where the values are few."""
    return d.where(F.col(column).isin(*sorted(values))) if 0 < len(values) <= LISTED else d


def _asked(queries: DataFrame, session: str) -> DataFrame:
    """(query_id, session, terms) of the questions."""
    return queries.select("query_id", F.col(session).cast("string").alias("session"), F.coalesce(tokens(F.col("question")), F.array().cast("array<string>")).alias("terms"))


def _first(q: DataFrame, scored: DataFrame, every: DataFrame, k: int, key_type: str, small: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(query_id, chunk, score, rank) of the first k; chunks without a match score 0 and fill up. scored: a table (query_id, chunk, score); every: (session, chunk)."""
    found = scored.where("score > 0").groupBy("query_id").agg(F.count(F.lit(1)).alias("positive"))
    short = q.select("query_id", "session").join(small(found), "query_id", "left").where(F.coalesce("positive", F.lit(0)) < k).drop("positive")
    # queries whose positive matches do not fill k ranks: the first k chunks in key order that did not match, cut before they are shuffled
    fill = every.join(small(short), "session").select("query_id", "chunk")
    matched = scored.select("query_id", "chunk").join(small(short.select("query_id")), "query_id", "left_semi")  # of these queries alone
    fill = fill.join(F.broadcast(matched) if is_small(scored) else matched, ["query_id", "chunk"], "left_anti")
    first = Window.partitionBy("query_id").orderBy(F.col("chunk").cast(key_type))
    fill = fill.withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= k).select("query_id", "chunk", F.lit(0.0).alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), F.col("chunk").cast(key_type))
    return scored.unionByName(fill).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


class Search:
    """One search of a stated query set: heads of blocks, bounds, the slices that can matter, scores."""

    def __init__(self, spark: SparkSession, path: str, queries: DataFrame, k: int, session: str):
        self.spark, self.path, self.k = spark, path, k
        self.snapshot = snapshots.current(spark, path)
        self.q = table(_asked(queries, session).join(in_force(spark, path, self.snapshot, raw=True).drop("since"), "session"), "bm25-queries")  # sessions without chunks have no answers
        named = self.q.select("session", F.explode_outer("terms").alias("term")).distinct().collect()  # the stated questions' own words
        self.sessions, self.terms = {r["session"] for r in named}, {r["term"] for r in named if r["term"] is not None}
        self.small = F.broadcast if is_small(self.q) else (lambda d: d)
        self._read_heads()

    def _blocks(self) -> DataFrame:
        d = _postings(self.spark, self.path, self.snapshot)
        if len(self.sessions) <= LISTED:
            parts = self.spark.range(1).select(F.explode(F.array(*[F.pmod(F.xxhash64(F.lit(s)), F.lit(PARTS)).cast("int") for s in sorted(self.sessions)] or [F.lit(-1)])).alias("p"))
            d = d.where(F.col("part").isin(*{r["p"] for r in parts.collect()}))
        return _listed(_listed(d, "session", self.sessions), "term", self.terms)

    def _read_heads(self) -> None:
        """heads (query_id, batch, session, slice, term, weight, avgdl, bound, n): a row per query and block of one of its terms."""
        times = self.q.select("query_id", "session", F.col("n").alias("chunks"), (F.col("tokens") / F.col("n")).alias("avgdl"), "mean_idf", F.explode("terms").alias("term"))
        times = times.groupBy("query_id", "session", "chunks", "avgdl", "mean_idf", "term").agg(F.count(F.lit(1)).alias("times"))
        asked = self.small(times.select("session", "term").distinct())
        self.raw = table(self._blocks().select("batch", "session", "slice", "term", "n", "max_tf", "min_dl").join(asked, ["session", "term"]), "bm25-heads")
        df = self.raw.groupBy("session", "term").agg(F.sum("n").alias("df"))
        weight = F.col("times") * floored_idf(plain_idf(F.col("chunks"), F.col("df")), F.col("mean_idf"))
        weighed = times.join(self.small(df), ["session", "term"]).select("query_id", "session", "term", "avgdl", weight.alias("weight"))
        bound = F.greatest(F.col("weight"), F.lit(0.0)) * part_score(F.col("max_tf"), F.col("min_dl"), F.col("avgdl"))
        self.heads = self.raw.join(self.small(weighed), ["session", "term"]).select("query_id", "batch", "session", "slice", "term", "weight", "avgdl", bound.alias("bound"), "n")

    def slices(self) -> DataFrame:
        """(query_id, batch, slice, bound, n): what the chunks of a slice can score at most, and their postings."""
        return self.heads.groupBy("query_id", "batch", "slice").agg(F.sum("bound").alias("bound"), F.sum("n").alias("n"))

    def scored(self, wanted: DataFrame, few: bool) -> DataFrame:
        """(query_id, chunk, score) of the chunks of wanted slices (query_id, batch, slice). few: whether these are small."""
        heads = self.heads.join(F.broadcast(wanted) if few else wanted, ["query_id", "batch", "slice"]).select("query_id", "batch", "session", "slice", "term", "weight", "avgdl")
        heads = F.broadcast(heads) if is_small(self.raw) and is_small(self.q) else heads
        d = self._blocks().select("batch", "session", "slice", "term", "docs").join(heads, ["batch", "session", "slice", "term"])
        d = d.select("query_id", "weight", "avgdl", F.explode("docs").alias("d"))
        return d.groupBy("query_id", F.col("d.chunk").alias("chunk")).agg(F.sum(F.col("weight") * part_score(F.col("d.tf"), F.col("d.dl"), F.col("avgdl"))).alias("score"))

    def needed(self) -> DataFrame:
        """(query_id, batch, slice, n) of the slices that can hold one of the first k: those whose bound reaches the k-th score of the first slices."""
        self.few = is_small(self.raw) and is_small(self.q)
        slices = table(self.slices(), "bm25-slices")
        first = Window.partitionBy("query_id").orderBy(F.desc("bound"), "batch", "slice")
        # the best chunks may lie in a slice each, so the k-th score is a high one only if so many are looked at
        seeds = slices.withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= max(SEEDS, self.k)).select("query_id", "batch", "slice")
        best = Window.partitionBy("query_id").orderBy(F.desc("score"))
        kth = self.scored(seeds, is_small(self.q)).where("score > 0").withColumn("_r", F.row_number().over(best)).where(F.col("_r") == self.k).select("query_id", F.col("score").alias("beat"))
        # ranks are by nine decimals, and sums differ in their last bits with the order of their parts
        return slices.join(self.small(kth), "query_id", "left").where(F.col("beat").isNull() | (F.col("bound") >= F.col("beat") - 1e-8)).select("query_id", "batch", "slice", "n")

    def ranked(self, key: str, key_type: str) -> DataFrame:
        """(query_id, chunk, score, rank); chunks without a match score 0 and fill up the first k."""
        wanted = self.needed().drop("n")
        scored = table(self.scored(wanted, self.few), "bm25-scored")
        every = _listed(snapshots.scan(self.spark, self.path, "lengths", LENGTHS, self.snapshot), "session", self.sessions).select("session", "chunk")
        return _first(self.q, scored, every, self.k, key_type, self.small).select("query_id", F.col("chunk").cast(key_type).alias(key), "score", "rank")


def search_index(spark: SparkSession, path: str, queries: DataFrame, k: int = 20, session: str = "chat_session_id", key: str = "chunk_id", key_type: str = "string") -> DataFrame:
    """(query_id, chunk, score, rank) of the k best chunks of each query's session; chunks without a match score 0 and fill up.

    queries: a stated set (query_id, session, question); the driver learns its sessions and words. Ties (at nine decimals) go to the lower chunk id.
    """
    return Search(spark, path, queries, k, session).ranked(key, key_type)


def postings_read(spark: SparkSession, path: str, queries: DataFrame, k: int = 20, session: str = "chat_session_id") -> DataFrame:
    """(query_id, postings, read): the postings of a query's terms, and those of the blocks that a search scores."""
    s = Search(spark, path, queries, k, session)
    read = s.needed().groupBy("query_id").agg(F.sum("n").alias("read"))
    return s.slices().groupBy("query_id").agg(F.sum("n").alias("postings")).join(read, "query_id")


def _text_weights(c: DataFrame, q: DataFrame) -> DataFrame:
    """A table (query_id, session, term, weight, avgdl) of a few queries' words, from the texts of c (session, dl, terms). One without words, or without any that a text has, has no term.

    A session needs the counts of all its words for their mean idf. These are shuffled once; what is written is how many words have each count.
    """
    times = q.select("query_id", "session", F.explode("terms").alias("term")).groupBy("query_id", "session", "term").agg(F.count(F.lit(1)).alias("times"))
    first = F.coalesce("pos", F.lit(0)) == 0  # a row per word and chunk; the first one of a chunk, also of one without words, brings its length
    rows = c.select("session", "dl", F.posexplode_outer(F.array_distinct("terms")).alias("pos", "term"))
    agg = [F.count(F.lit(1)).alias("df"), F.count(F.when(first, 1)).alias("n"), F.coalesce(F.sum(F.when(first, F.col("dl"))), F.lit(0)).alias("tokens")]
    asked = times.select("session", "term", F.col("term").alias("word")).distinct()
    counts = rows.groupBy("session", "term").agg(*agg).join(F.broadcast(asked), ["session", "term"], "left")
    counts = counts.groupBy("session", "word", "df", F.col("term").isNull().alias("none")).agg(F.count(F.lit(1)).alias("words"), F.sum("n").alias("n"), F.sum("tokens").alias("tokens"))
    counts = table(counts, "bm25-counts")
    sums = counts.groupBy("session").agg(F.sum("n").alias("n"), F.sum("tokens").alias("tokens"))
    idf = plain_idf(F.col("n"), F.col("df"))
    mean = counts.where("not none").select("session", "df", "words").join(sums, "session").groupBy("session").agg((F.sum(F.col("words") * idf) / F.sum("words")).alias("mean_idf"))
    known = counts.where("word is not null").select("session", F.col("word").alias("term"), "df")
    weighed = times.join(known, ["session", "term"]).join(sums, "session").join(mean, "session")
    return table(weighed.select("query_id", "session", "term", (F.col("times") * floored_idf(idf, F.col("mean_idf"))).alias("weight"), (F.col("tokens") / F.col("n")).alias("avgdl")), "bm25-weights")


def _ranked_matches(found, k: int):
    """(rows, least) of a table (q, score, chunk) of Arrow: those that can be among the first k of q, and the score that further ones must reach (by q; -inf while there are fewer).

    Scores are compared with `TIE` to spare, as ranks are by nine decimals; of equal scores the k lowest chunks stay.
    """
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    keyed = found.append_column("tie", pa.array(-np.round(found["score"].to_numpy(), 12)))
    found = keyed.take(pc.sort_indices(keyed, sort_keys=[("q", "ascending"), ("tie", "ascending"), ("chunk", "ascending")], null_placement="at_start"))
    q, tie, at = found["q"].to_numpy(), found["tie"].to_numpy(), np.arange(found.num_rows)
    new = np.append(True, q[1:] != q[:-1])[: len(q)]
    first = np.flatnonzero(new)
    counts = np.diff(np.append(first, len(q)))
    full = counts >= k
    least = np.full(len(first), -np.inf)
    least[full] = -tie[first[full] + k - 1] - TIE
    equal = np.maximum.accumulate(np.where(new | np.append(True, tie[1:] != tie[:-1])[: len(q)], at, 0))
    stays = (-tie >= np.repeat(least, counts)) & (at - equal < k)
    return found.filter(pa.array(stays)).drop_columns("tie"), dict(zip(q[first].tolist(), least.tolist()))


def _best_matches(split: DataFrame, weights: DataFrame, k: int, kind: str) -> DataFrame:
    """(query_id, chunk, score) of the matches that can be among the first k, each task those of its texts. split: (session, dl, chunk, terms); weights: of `_text_weights`.

    Matches that are summed with others, as their chunk's name is repeated, and those that do not score above 0 are all passed on: the former have no rank yet, the latter are
    matches still, which must not fill up.
    """
    twice = table(split.groupBy("session", "chunk").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("session").alias("_s"), F.col("chunk").alias("_c"), F.lit(False).alias("alone")), "bm25-repeated")
    rows = split.select("session", "chunk", "dl", F.array_join("terms", " ").alias("words"))
    if twice.isEmpty():
        rows = rows.withColumn("alone", F.lit(True))
    else:
        rows = rows.join(hinted(twice), (F.col("session") == F.col("_s")) & F.col("chunk").eqNullSafe(F.col("_c")), "left").withColumn("alone", F.coalesce("alone", F.lit(True)))
    sent = split.sparkSession.sparkContext.broadcast(weights.toArrow())

    def scan(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        class Asked:
            """The questions of one session, by term, and the matches of the task so far."""

            def __init__(self, session):
                t = sent.value.filter(pc.equal(sent.value["session"], session)).combine_chunks()
                one = lambda name: pa.concat_arrays(t[name].chunks) if t.num_rows else pa.array([], t.schema.field(name).type)
                ids, terms = one("query_id").dictionary_encode("encode"), one("term").dictionary_encode()
                order = np.argsort(terms.indices.to_numpy(), kind="stable")
                self.ids, self.terms, self.n = ids.dictionary, terms.dictionary, len(ids.dictionary)
                self.start = np.searchsorted(terms.indices.to_numpy()[order], np.arange(len(self.terms) + 1))
                self.q, self.weight = ids.indices.to_numpy()[order], t["weight"].to_numpy()[order]
                self.avgdl = t["avgdl"][0].as_py() if t.num_rows else 1.0
                self.least, self.best, self.held = np.full(self.n, -np.inf), [], 0
                self.step = max(1, min(COUNTED, CELLS // max(1, self.n), CELLS // max(1, len(order))))

            def out(self, m):
                return pa.RecordBatch.from_arrays([self.ids.take(m["q"].combine_chunks()), m["chunk"].combine_chunks(), m["score"].combine_chunks()], names=["query_id", "chunk", "score"])

            def matches(self, rows):
                """The matches of some texts: those to pass on at once; others are held."""
                words = pc.split_pattern(rows["words"].combine_chunks(), " ")
                code = pc.fill_null(pc.index_in(words.flatten(), value_set=self.terms), -1).to_numpy(zero_copy_only=False).astype(np.int64)
                owner = np.repeat(np.arange(rows.num_rows), words.value_lengths().to_numpy(zero_copy_only=False))
                pairs, tf = np.unique(owner[code >= 0] * len(self.terms) + code[code >= 0], return_counts=True)
                row, term = pairs // len(self.terms), pairs % len(self.terms)
                part = part_score(tf, rows["dl"].to_numpy()[row], self.avgdl)
                n = self.start[term + 1] - self.start[term]  # questions that have the term
                at = np.repeat(self.start[term] - np.cumsum(n) + n, n) + np.arange(n.sum())
                cell = np.repeat(row, n) * self.n + self.q[at]
                score = np.bincount(cell, np.repeat(part, n) * self.weight[at], rows.num_rows * self.n)
                hit = np.flatnonzero(np.bincount(cell, minlength=rows.num_rows * self.n))
                score, row, q = score[hit], hit // self.n, hit % self.n
                whole = (score <= 0) | ~rows["alone"].to_numpy()[row]
                chosen = lambda i: pa.table({"q": pa.array(q[i]), "score": pa.array(score[i]), "chunk": rows["chunk"].combine_chunks().take(pa.array(row[i]))})
                self.best.append(chosen(np.flatnonzero(~whole & (score >= self.least[q]))))
                self.held += self.best[-1].num_rows
                if self.held > 4 * k * self.n + CELLS // 16:
                    self.settle()
                return chosen(np.flatnonzero(whole))

            def settle(self):
                best, least = _ranked_matches(pa.concat_tables(self.best).combine_chunks(), k)
                self.least[list(least)] = list(least.values())
                self.best, self.held = [best], best.num_rows

        asked: dict[str, Asked] = {}
        for batch in batches:
            t = pa.Table.from_batches([batch])
            for session in pc.unique(t["session"]).to_pylist():
                a = asked[session] if session in asked else asked.setdefault(session, Asked(session))
                own = t.filter(pc.equal(t["session"], session))
                for start in range(0, own.num_rows if a.n else 0, a.step):
                    now = a.matches(own.slice(start, a.step))
                    if now.num_rows:
                        yield a.out(now)
        for a in asked.values():
            if a.held:
                a.settle()
                yield a.out(a.best[0])

    rows = rows.select("session", F.col("chunk").cast(kind).alias("chunk"), "dl", "words", "alone")
    out = rows.mapInArrow(scan, f"query_id {dict(weights.dtypes)['query_id']}, chunk {kind}, score double")
    return out.withColumn("chunk", F.col("chunk").cast("string"))


def _search_texts(chunks: DataFrame, q: DataFrame, k: int, session: str, key: str, text: str) -> DataFrame:
    """(query_id, chunk, score, rank) as of `search_index`, from the texts. q: a small table of `_asked`.

    Texts are split where they lie, for the counts of words and for the asked words; neither texts nor postings are shuffled or written, and of the matches those alone that can
    be among the first k.
    """
    kind = dict(chunks.dtypes)[key]
    c = chunks.select(F.col(session).cast("string").alias("session"), F.col(key).cast("string").alias("chunk"), F.col(text).alias("text")).join(F.broadcast(q.select("session").distinct()), "session", "left_semi")
    # a one-element array binds the tokens to a variable, so that they are made once per text
    found = F.transform(F.array(F.coalesce(tokens(F.col("text")), F.array().cast("array<string>"))), lambda x: F.struct(F.size(x).cast("long").alias("dl"), x.alias("terms")))[0]
    split = c.select("session", "chunk", found.alias("t")).select("session", "chunk", "t.*")
    weights = _text_weights(split, q)
    # a chunk is a row, whatever its name; scores of rows of one name are summed
    found = _best_matches(split, weights, k, kind)
    scored = found.groupBy("query_id", "chunk").agg(F.sum("score").alias("score"))
    return _first(q, table(scored, "bm25-scored"), c.select("session", "chunk"), k, kind, F.broadcast).select("query_id", F.col("chunk").cast(kind).alias(key), "score", "rank")


def bm25_search(chunks: DataFrame, queries: DataFrame, k: int = 20, session: str = "chat_session_id", key: str = "chunk_id", text: str = "text", index: str | None = None) -> DataFrame:
    """(query_id, chunk, score, rank) of the k best chunks of each query's session.

    `index` names a folder of `build_index` that holds these chunks; without one, the texts are searched for a few questions, and an index of the queries' sessions
    is made for many.
    """
    if index is None:
        asked = table(_asked(queries, session), "bm25-asked")
        if is_small(asked):
            return _search_texts(chunks, asked, k, session, key, text)
        index = fresh_path(chunks.sparkSession, "bm25-index")
        build_index(chunks.join(queries.select(session).distinct(), session, "left_semi"), index, session, key, text)
    return search_index(chunks.sparkSession, index, queries, k, session, key, dict(chunks.dtypes)[key])
