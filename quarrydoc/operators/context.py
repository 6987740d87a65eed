"""Context assembly: citations, context text, prompts, answer events."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import snippet

#: One instruction per mode; the wording is ours and may be replaced.
MODE_NOTES = {
    "specific": "",
    "broad": "Give a summary of the passages below, which were taken from all parts of the documents.",
    "comparison": "Compare the documents named in the source labels: where they agree, where they differ.",
}
PROMPT = "Use only the passages below. If they hold no answer, say that the documents do not tell.\n%s\n\nPassages:\n%s\n\nQuestion:\n%s\n\nAnswer:"
REFUSAL = "The documents do not tell."
FAILURE = "The answer could not be made. Please ask again."


def citations(candidates: DataFrame) -> DataFrame:
    """First candidate per (query, source, page) in rank order, renumbered, with a snippet."""
    first = Window.partitionBy("query_id", "source", "page").orderBy("rank")
    d = candidates.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    d = d.withColumn("position", F.row_number().over(Window.partitionBy("query_id").orderBy("rank")))
    return d.select("query_id", "position", "source", "page", snippet(F.col("text")).alias("snippet"))


def context_text(candidates: DataFrame) -> DataFrame:
    """One context string per query: labelled passages in rank order, an empty line between."""
    passage = F.concat(F.lit("[Source: "), F.col("source"), F.lit(", Page "), F.col("page").cast("string"), F.lit("]\n"), F.col("text"))
    d = candidates.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", passage.alias("p")))).alias("ps"))
    return d.select("query_id", F.array_join(F.transform("ps", lambda x: x["p"]), "\n\n").alias("context"))


def prompt(question: Column, context: Column, mode: Column) -> Column:
    note = F.lit("")
    for m, text in MODE_NOTES.items():
        note = F.when(mode == m, F.lit(text)).otherwise(note)
    return F.format_string(PROMPT, note, context, question)


def document_prompts(candidates: DataFrame, questions: DataFrame) -> DataFrame:
    """Broad mode: one prompt per query and document, with an ordinal; the document's name is its heading."""
    passage = F.concat(F.lit("[Source: "), F.col("source"), F.lit(", Page "), F.col("page").cast("string"), F.lit("]\n"), F.col("text"))
    d = candidates.groupBy("query_id", "source").agg(F.array_sort(F.collect_list(F.struct("rank", passage.alias("p")))).alias("ps"), F.min("rank").alias("_first"))
    d = d.withColumn("ordinal", F.row_number().over(Window.partitionBy("query_id").orderBy("_first", "source")))
    d = d.join(questions.select("query_id", "question"), "query_id")
    context = F.array_join(F.transform("ps", lambda x: x["p"]), "\n\n")
    return d.select("query_id", "ordinal", F.col("source").alias("heading"), prompt(F.col("question"), context, F.lit("broad")).alias("prompt"))


def sources_json(cites: DataFrame) -> DataFrame:
    """One JSON list of citations per query, fields page, source, text."""
    item = F.struct(F.col("page").alias("page"), F.col("source").alias("source"), F.col("snippet").alias("text"))
    d = cites.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("position", item.alias("s")))).alias("xs"))
    return d.select("query_id", F.to_json(F.transform("xs", lambda x: x["s"])).alias("sources_json"))


def parsed_sources(messages: DataFrame, column: str = "sources_json") -> DataFrame:
    kind = "array<struct<page:int,source:string,text:string>>"
    return messages.withColumn("sources", F.coalesce(F.from_json(column, kind), F.array().cast(kind)))


def refusal_answers(refused: DataFrame) -> DataFrame:
    """(query_id, answer, sources_json) of refused queries: the refusal and no sources."""
    return refused.select("query_id", F.lit(REFUSAL).alias("answer"), F.lit("[]").alias("sources_json"))


def answer_events(answers: DataFrame) -> DataFrame:
    """(query_id, seq, event, data) in the order of the wire: a token event per word, done, then sources.

    answers: query_id, answer, sources_json; where there is a `confidence` it goes with the sources, and where a `failed` is true an error event
    comes after what words there are, in place of done and sources.
    """
    has = answers.columns
    failed = F.coalesce(F.col("failed"), F.lit(False)) if "failed" in has else F.lit(False)
    extra = F.when(F.col("confidence").isNotNull(), F.concat(F.lit(',"confidence":"'), F.col("confidence"), F.lit('"'))).otherwise("") if "confidence" in has else F.lit("")
    words = F.split("answer", " ")
    tokens = answers.select("query_id", F.posexplode(words).alias("seq", "w"))
    tokens = tokens.select("query_id", "seq", F.lit("token").alias("event"), F.to_json(F.struct(F.concat("w", F.lit(" ")).alias("content"))).alias("data"))
    n = F.coalesce(F.nullif(F.size(words), F.lit(-1)), F.lit(0))
    done = answers.where(~failed).select("query_id", n.alias("seq"), F.lit("done").alias("event"), F.lit("{}").alias("data"))
    payload = F.concat(F.lit('{"sources":'), F.coalesce("sources_json", F.lit("[]")), extra, F.lit("}"))
    sources = answers.where(~failed).select("query_id", (n + 1).alias("seq"), F.lit("sources").alias("event"), payload.alias("data"))
    error = answers.where(failed).select("query_id", n.alias("seq"), F.lit("error").alias("event"), F.to_json(F.struct(F.lit(FAILURE).alias("message"))).alias("data"))
    return tokens.unionByName(done).unionByName(sources).unionByName(error)


def flat_contexts(grouped: DataFrame) -> DataFrame:
    """(query_id, rank, chunk fields) from contexts grouped by document: `groups` array<struct<filename, chunks array<struct>>>, in order. Flat contexts pass as they are."""
    if "groups" not in grouped.columns:
        return grouped
    d = grouped.select("query_id", F.posexplode(F.flatten(F.transform("groups", lambda g: g["chunks"]))).alias("i", "c"))
    return d.select("query_id", (F.col("i") + 1).alias("rank"), "c.*")


def generated(prompts: DataFrame, model: Callable[[Column], Column]) -> DataFrame:
    """(query_id, answer) by a text model. Prompts with an ordinal and a heading are one part each, under the heading in bold, with an empty line between."""
    if "ordinal" not in prompts.columns:
        return prompts.select("query_id", model(F.col("prompt")).alias("answer"))
    part = F.concat(F.lit("**"), F.col("heading"), F.lit("**\n\n"), model(F.col("prompt")))
    d = prompts.select("query_id", "ordinal", part.alias("p")).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("ordinal", "p"))).alias("ps"))
    return d.select("query_id", F.array_join(F.transform("ps", lambda x: x["p"]), "\n\n").alias("answer"))


def wire(events: DataFrame) -> DataFrame:
    return events.withColumn("frame", F.concat(F.lit("event: "), F.col("event"), F.lit("\ndata: "), F.col("data"), F.lit("\n\n")))


def parse_wire(stream: DataFrame, column: str = "stream") -> DataFrame:
    """Frames of a text stream back to (seq, event, data); frames without an event are messages."""
    d = stream.select(*[c for c in stream.columns if c != column], F.posexplode(F.filter(F.split(column, "\n\n"), lambda x: x != "")).alias("seq", "frame"))
    event = F.coalesce(F.nullif(F.regexp_extract("frame", r"(?m)^event: ?(.*)$", 1), F.lit("")), F.lit("message"))
    data = F.array_join(F.regexp_extract_all("frame", F.lit(r"(?m)^data: ?(.*)$"), 1), "\n")
    return d.select("*", event.alias("event"), data.alias("data")).drop("frame")


def streamed_answer(events: DataFrame) -> DataFrame:
    """The answer a client shows: contents of token events in order."""
    t = events.where("event = 'token'").select("query_id", "seq", F.get_json_object("data", "$.content").alias("c"))
    return t.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "c"))), lambda x: x["c"]), "").alias("answer"))
