"""The corpus pipeline: quality rules, line dedup, near copies, source mixing, packing.

Each stage takes (spark, docs, sf_dir), works on all rows of docs and returns the columns of
documents, but for the last, which returns the packed pieces. run() writes every
stage's rows to the shared folder before the next one reads them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarrydoc.llm.common import documents, hinted, table
from quarrydoc.llm.line_dedup import MIN_LONG, line_dedup
from quarrydoc.llm.mixing import mix
from quarrydoc.llm.ngram_join import jaccard_join
from quarrydoc.llm.packing import best_fit_packing
from quarrydoc.llm.quality_rules import filter_documents
from quarrydoc.llm.queries import tokenizer_file


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rule or lie far outside their language and source go."""
    return filter_documents(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of line runs of ten words or more go; documents that keep no line of what they had go with them."""
    d = line_dedup(docs, min_run_words=10)
    d = d.where((F.col("lines_removed") == 0) | (F.col("lines_removed") < F.col("lines_before")))
    return d.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of documents linked at 0.8 over five-word shingles the one with the smallest id stays (null ids all stay)."""
    groups = jaccard_join(docs, width=5, percent=80)
    gone = table(groups.where(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias("__gone")), "pipeline-gone")
    return docs.join(hinted(gone), docs["doc_id"] == F.col("__gone"), "left_anti")


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources nearer to equal weights: every document once, small sources up to twice, in block order.

    Rows equal in every column have equal readings, so any of them stands for all: texts move once to
    their readings and once to their places.
    """
    row = F.xxhash64(*docs.columns)
    ident = F.coalesce(F.col("doc_id"), F.lit(MIN_LONG))
    readings = mix(docs, max_repeats=2.0, row=row).select(ident.alias("__id"), "__row", "block", F.xxhash64("__row", "copy").alias("__place"))
    once = Window.partitionBy("__id", "__row").orderBy(F.lit(1))
    rows = docs.withColumns({"__id": ident, "__row": row}).withColumn("__n", F.row_number().over(once)).where("__n = 1").drop("__n")
    return rows.join(readings, ["__id", "__row"]).orderBy("block", "__place").select(docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 2048 tokens."""
    return best_fit_packing(docs, tokenizer_file("word_bpe_49k.json"), 2048)


STAGES = [("quality_rules", quality), ("line_dedup", lines), ("ngram_jaccard_join", near_copies), ("source_mixing", mixing), ("best_fit_packing", packing)]

#: SQL cannot express the robust estimates nor the packing; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = table(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
