"""Sources and sinks: the store of documents, chunks, messages and their index, evaluation files, binaries, metrics, validated page sources.

A store is a folder of snapshots (`sources.snapshots`). What belongs together is published in one step: a document with its chunks, their postings and
its session's activity; the deletion of a session from all tables and the index.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import basename, strip
from ..operators import lexical
from ..operators.chunking import chunk_pages
from ..operators.sessions import stale_guests, titles
from ..scratch import discard, table
from . import snapshots
from .snapshots import Snapshot

EVAL = "question string, expected_source string, expected_page int, expected_keywords array<string>"
CHUNKS = "chunk_id string, filename string, page int, text string, embedding array<float>, element_type string, section_title string, chat_session_id string"
#: Tables of a store besides those of its index; all have their session in `chat_session_id`.
TABLES = {
    "chunks": CHUNKS,
    "documents": "chat_session_id string, filename string, display_title string, content_type string, data binary, at timestamp",
    "activity": "chat_session_id string, bytes long, at timestamp",
    "messages": "chat_session_id string, created_at timestamp, role string, content string, sources_json string",
    "sessions": "chat_session_id string, is_guest boolean, user_id string, created_at timestamp",
}


def read_eval(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(EVAL).option("multiLine", True).json(path)


def write_chunks(chunks: DataFrame, path: str) -> None:
    """Append chunks to a plain table, laid out by session so that session filters prune folders; large sessions are split, small ones lie together."""
    chunks.hint("rebalance", "chat_session_id").write.mode("append").partitionBy("chat_session_id").parquet(path)


def rows_of(spark: SparkSession, store: str, name: str, snapshot: Snapshot | None = None) -> DataFrame:
    """The rows of a table of a store that are in force."""
    return snapshots.scan(spark, store, name, TABLES[name], snapshot, "chat_session_id").drop("batch", "since")


def _batch(rows: DataFrame, name: str) -> snapshots.Writer:
    """Rows in the columns of their table; a session's rows lie together in each file, so that session filters skip most of the files' pages. Nothing is shuffled."""
    columns = [F.col(n).cast(kind).alias(n) for n, kind in (c.split() for c in TABLES[name].split(", "))]
    return lambda path: rows.select(*columns).sortWithinPartitions("chat_session_id").write.option("compression", "zstd").parquet(path)


def add_chunks(chunks: DataFrame, store: str, embed: Callable[[Column], Column], more: dict[str, snapshots.Rows] | None = None) -> int:
    """Embed chunks by `embed`, add them and their postings to the store in one step (with rows of other tables, `more`), and return how many there were.

    The chunks are written once, where they stay; their postings are made from what was written.
    """
    d = chunks.withColumn("embedding", embed(F.col("text")).cast("array<float>"))
    batch, written = snapshots.staged(chunks.sparkSession, store, "chunks", _batch(d, "chunks"), CHUNKS)
    rows, derive, used = lexical.segment(written)
    snapshots.publish(chunks.sparkSession, store, {"chunks": batch} | rows | (more or {}), derive(store))
    n = used[0].count()  # a row per chunk
    discard(*used)
    return n


def add_document(document: DataFrame, chunks: DataFrame, store: str, embed: Callable[[Column], Column]) -> int:
    """A document's row, its chunks, their postings and its session's activity, in one step. Returns the number of chunks.

    document: chat_session_id, filename, display_title, content_type, data, at (time).
    """
    activity = document.select("chat_session_id", F.octet_length("data").cast("long").alias("bytes"), "at")
    return add_chunks(chunks, store, embed, {"documents": _batch(document, "documents"), "activity": _batch(activity, "activity")})


def add_sessions(sessions: DataFrame, store: str) -> None:
    """Sessions (chat_session_id, is_guest, user_id, created_at) and their first activity."""
    activity = sessions.select("chat_session_id", F.lit(0).cast("long").alias("bytes"), F.col("created_at").alias("at"))
    snapshots.publish(sessions.sparkSession, store, {"sessions": _batch(sessions, "sessions"), "activity": _batch(activity, "activity")})


def add_messages(messages: DataFrame, store: str) -> None:
    """Messages (chat_session_id, created_at, role, content, sources_json) and the activity of their sessions, in one step. Titles and last activity follow by aggregation."""
    activity = messages.select("chat_session_id", F.lit(0).cast("long").alias("bytes"), F.col("created_at").alias("at"))
    snapshots.publish(messages.sparkSession, store, {"messages": _batch(messages, "messages"), "activity": _batch(activity, "activity")})


def session_state(spark: SparkSession, store: str) -> DataFrame:
    """(chat_session_id, total_bytes, last_active_at, title) from what was appended."""
    s = snapshots.current(spark, store)
    a = rows_of(spark, store, "activity", s).groupBy("chat_session_id").agg(F.sum("bytes").alias("total_bytes"), F.max("at").alias("last_active_at"))
    m = titles(rows_of(spark, store, "messages", s))
    return a.join(m, "chat_session_id", "left").withColumn("title", F.coalesce("title", F.lit("New chat")))


def metadata(spark: SparkSession, store: str) -> DataFrame:
    """(chat_session_id, filename, display_title) of the stored documents."""
    return rows_of(spark, store, "documents").select("chat_session_id", "filename", "display_title")


def delete_sessions(spark: SparkSession, store: str, sessions: DataFrame) -> None:
    """Sessions (chat_session_id) go with their documents, chunks, messages, activity and postings, in one step."""
    snapshots.delete_sessions(spark, store, sessions.select("chat_session_id"))


def expire_guests(spark: SparkSession, store: str, now: Column, hours: int = 24) -> int:
    """Delete the guest sessions without activity for so many hours before `now`; how many went."""
    s = snapshots.current(spark, store)
    last = rows_of(spark, store, "activity", s).groupBy("chat_session_id").agg(F.max("at").alias("last_active_at"))
    known = rows_of(spark, store, "sessions", s).select("chat_session_id", "is_guest").join(last, "chat_session_id")
    gone = table(stale_guests(known, now, hours).select("chat_session_id").distinct(), "stale-guests")
    n = gone.count()
    if n:
        delete_sessions(spark, store, gone)
    discard(gone)
    return n


def compact_store(spark: SparkSession, store: str, keep: int = 1) -> Snapshot:
    """One batch per table in place of all: deleted sessions leave the files, the index becomes one segment; versions but the last `keep` go."""
    rewrite = {name: (lambda s, name=name: _batch(rows_of(spark, store, name, s), name)) for name in TABLES}
    s = snapshots.compact(spark, store, rewrite | lexical.rewritten(spark, store))
    snapshots.vacuum(spark, store, keep)
    return s


def read_chunks(spark: SparkSession, path: str, session: str | None = None, filenames: list[str] | None = None) -> DataFrame:
    d = spark.read.schema(CHUNKS).parquet(path)
    if session is not None:
        d = d.where(F.col("chat_session_id") == session)
    return d if filenames is None else d.where(F.col("filename").isin(filenames))


def write_metrics(metrics: DataFrame, path: str) -> None:
    metrics.coalesce(1).write.mode("overwrite").json(path)


def read_binaries(spark: SparkSession, path: str) -> DataFrame:
    """Stored files with their base name, size and whether they begin as a PDF does."""
    d = spark.read.format("binaryFile").load(path)
    return d.select(basename(F.col("path")).alias("filename"), F.col("length").alias("size"), "content", (F.substring("content", 1, 5) == F.lit(b"%PDF-")).alias("magic_ok"))


def binary_of(documents: DataFrame, session: str, filename: str) -> DataFrame:
    return documents.where((F.col("chat_session_id") == session) & (F.col("filename") == filename)).select("data").limit(1)


def lookup(rows: DataFrame, column: str, value, order: str) -> DataFrame:
    """Point lookup; `order` makes the one row definite where the column is not unique."""
    return rows.where(F.col(column) == value).orderBy(order).limit(1)


class PasswordProtected(Exception):
    """Raised by a parser for a file that opens with a password only."""


def parse_files(files: DataFrame, parser: Callable[[bytes], list[dict]], schema: str) -> DataFrame:
    """Rows a parser finds in each file (spans, words, cells, drawings). A file it refuses gives one row with its error in `status`."""
    out = f"filename string, status string, item struct<{schema}>"

    def run(frames):
        import pandas as pd

        for pdf in frames:
            rows = []
            for name, data in zip(pdf["filename"], pdf["content"]):
                try:
                    rows += [(name, "ok", item) for item in parser(bytes(data))]
                except Exception as e:
                    rows.append((name, type(e).__name__, None))
            yield pd.DataFrame(rows, columns=["filename", "status", "item"])

    return files.select("filename", "content").mapInPandas(run, out)


def page_source(files: DataFrame, parser: Callable[[bytes], list[tuple[str, int, bytes]]], ocr: Callable[[Column], Column]) -> tuple[DataFrame, DataFrame]:
    """(pages, refused): (source, page, text) of each file, numbered from 1 as the file has them, without blank ones; (filename, reason) of the others.

    parser: gives (text, number of images, rendered page) for each page of a file in order; it raises PasswordProtected, or anything else for a file that is corrupt.
    A page without text but with images takes the text that `ocr` reads off it. A file whose pages are all blank is refused as "no_text".
    """

    def numbered(data: bytes) -> list[dict]:
        return [{"page": i, "text": t, "n_images": n, "image": image} for i, (t, n, image) in enumerate(parser(data), 1)]

    found = parse_files(files, numbered, "page int, text string, n_images int, image binary").select("filename", "status", "item.*")
    pages, refused = pages_of(found, ocr)
    silent = files.select("filename").distinct().join(found.select("filename").distinct(), "filename", "left_anti")
    return pages, refused.unionByName(silent.select("filename", F.lit("no_text").alias("reason")))


#: Columns of page items, as the data source `document_items` reads them.
PAGE_ITEMS = "filename string, status string, page int, text string, n_images int, image binary"


def pages_of(found: DataFrame, ocr: Callable[[Column], Column]) -> tuple[DataFrame, DataFrame]:
    """(pages, refused), as `page_source`, of page items (the columns of PAGE_ITEMS)."""
    found = table(found, "parsed-pages")
    ok = found.where("status = 'ok'").select(F.col("filename").alias("source"), "page", "text", "n_images", "image")
    pages = with_ocr(ok, ocr(F.col("image"))).select("source", "page", "text")
    status = found.groupBy("filename").agg(F.max(F.when(~F.col("status").isin("ok", "empty"), F.col("status"))).alias("status"))
    kept = pages.select(F.col("source").alias("filename")).distinct()
    reason = F.when(F.col("status") == "PasswordProtected", "password").when(F.col("status").isNotNull(), "corrupt").otherwise("no_text")
    return pages, status.join(kept, "filename", "left_anti").select("filename", reason.alias("reason"))


def with_ocr(pages: DataFrame, ocr: Column) -> DataFrame:
    """Pages without text but with images take the text of `ocr`; blank pages go."""
    blank = F.length(strip(F.coalesce("text", F.lit("")))) == 0
    d = pages.withColumn("text", F.when(blank & (F.col("n_images") > 0), ocr).otherwise(F.col("text")))
    return d.where(F.length(strip(F.coalesce("text", F.lit("")))) > 0)


def ingested(chunks: DataFrame) -> DataFrame:
    """Chunk counts per file and in all (the row with a null file name)."""
    return chunks.rollup("filename").agg(F.count(F.lit(1)).alias("n_chunks"))


def ingest(pages: DataFrame, store: str, session: str, embed: Callable[[Column], Column], extras: DataFrame | None = None) -> DataFrame:
    """Pages of many files to stored and indexed chunks in one step; their counts per file and in all."""
    chunks = chunk_pages(pages, extras).withColumnRenamed("source", "filename").withColumn("chat_session_id", F.lit(session))
    chunks = table(chunks, "ingest-chunks")
    add_chunks(chunks, store, embed)
    return ingested(chunks)
