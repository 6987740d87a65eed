"""Question routing: modes, mentioned documents, comparison targets, spread samples."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import WS, file_title, question_mode, refers_back, search_query
from ..scratch import table
from .prefix import page_bucket, positions

BLOCK_BYTES = 8 * 2**20


def route(questions: DataFrame, resolver: Callable[[Column], Column] | None = None) -> DataFrame:
    """questions (question, document_count, has_history, resolved) plus mode and search_query; the mode reads the raw question.

    resolver: a model that names what a question refers back to; without one the column `resolved` tells, where it is not null.
    """
    if resolver is not None:
        back = F.col("has_history") & F.coalesce(refers_back(F.col("question")), F.lit(False))
        questions = questions.withColumn("resolved", F.when(back, F.nullif(resolver(F.col("question")), F.lit(""))))
    return questions.withColumn("mode", question_mode(F.col("question"), F.col("document_count"))).withColumn("search_query", search_query(F.col("question"), F.col("has_history"), F.col("resolved")))


def mentions(questions: DataFrame, documents: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(query_id, filename): documents whose file name or display title occurs in the question, as it stands or with all white space left out.

    Names are sought all at once by an automaton over them. It travels to the questions in blocks of at most about `block_bytes` of names, each
    read by the driver, sent and released before the next; no question meets a document whose name it does not hold, but for empty names, which every question holds.
    """
    kind = dict(questions.dtypes)["query_id"]
    spark = questions.sparkSession
    q = questions.select("query_id", F.col("chat_session_id").cast("string").alias("session"), F.lower("question").alias("q"), F.regexp_replace(F.lower("question"), WS, "").alias("qc")).where("q is not null and session is not null")
    name, title = file_title(F.col("filename")), file_title(F.col("display_title"))
    d = documents.select(F.col("chat_session_id").cast("string").alias("session"), "filename", F.explode(F.array_compact(F.array(name, title))).alias("name"))
    d = table(d.where("session is not null and filename is not null").distinct(), "document-names")
    q = table(q, "mention-questions")
    size = d.agg(F.sum(F.octet_length("name") + F.octet_length("filename") + 64)).head()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    found = None
    for b in range(blocks):
        rows = d.where(F.pmod(F.xxhash64("session", "filename", "name"), F.lit(blocks)) == b).select("session", "filename", "name", F.regexp_replace("name", " ", "").alias("compact"))
        sent = spark.sparkContext.broadcast([tuple(r) for r in rows.collect()])
        hits = q.mapInPandas(_finder(sent), f"query_id {kind}, filename string").distinct()
        if blocks == 1:
            return hits
        part = table(hits, "mentions")
        sent.destroy()
        found = part if found is None else found.unionByName(part)
    return found.distinct()


def _finder(sent):
    """Which of the names sent occur in each question of their session."""

    def find(frames):
        import ahocorasick
        import pandas as pd

        whole, compact, always = ahocorasick.Automaton(), ahocorasick.Automaton(), {}
        for session, filename, name, short in sent.value:
            for automaton, pattern in ((whole, name), (compact, short)):
                if pattern == "":
                    always.setdefault(session, set()).add(filename)
                else:
                    if pattern not in automaton:
                        automaton.add_word(pattern, {})
                    automaton.get(pattern).setdefault(session, set()).add(filename)
        whole.make_automaton()
        compact.make_automaton()
        for pdf in frames:
            rows = []
            for query, session, *texts in pdf.itertuples(index=False):
                names = set(always.get(session, ()))
                for automaton, text in zip((whole, compact), texts):
                    for _, holders in automaton.iter(text) if len(automaton) else ():
                        names |= holders.get(session, set())
                rows += [(query, n) for n in names]
            yield pd.DataFrame(rows, columns=["query_id", "filename"])

    return find


def comparison_targets(questions: DataFrame, documents: DataFrame) -> DataFrame:
    """(query_id, filename): the mentioned documents when there are two or more, else all of the session."""
    m = mentions(questions, documents)
    n = m.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")).where("n >= 2").select("query_id")
    every = questions.select("query_id", "chat_session_id").join(documents.select("chat_session_id", "filename").distinct(), "chat_session_id").select("query_id", "filename")
    return every.join(n, "query_id", "left_anti").unionByName(m.join(n, "query_id", "left_semi"))


def spread_sample(chunks: DataFrame, per_document: int = 8, by: tuple[str, ...] = ("chat_session_id", "filename"), order: tuple[str, ...] = ("page", "chunk_id")) -> DataFrame:
    """Every step-th chunk of a document from the first on, at most per_document; step = n div min(8, n). The first column of `order` is a page number."""
    d = positions(chunks, list(by), page_bucket(order[0]), list(order), "i", "n").withColumn("i", F.col("i").cast("int"))
    d = d.withColumn("step", F.greatest(F.lit(1), F.expr(f"n div least({per_document}, n)")).cast("long"))
    return d.where((F.col("i") % F.col("step") == 0) & (F.expr("i div step") < per_document)).drop("n", "step")


def distinct_filenames(chunks: DataFrame) -> DataFrame:
    return chunks.select("chat_session_id", "filename").distinct()


def document_counts(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("chat_session_id").agg(F.countDistinct("filename").alias("n_documents"))
