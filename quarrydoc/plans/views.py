"""The engine's tables as views of the test data (see the mapping in the README)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import chunk_id, portable_hash
from ..operators import evaluate

#: Questions of the registered retrieval queries, with the session (language) they are asked in.
QUESTIONS = [
    (1, "en", "the and attion to thanedble"),
    (2, "de", "und der schung nicht nicht"),
    (3, "fr", "quevipa la zzzz"),
    (4, "es", "qqqq xxxx"),
]
#: ASCII questions of the routing queries.
ROUTED = [
    (1, "Compare src1 and src2", 3, False),
    (2, "compare these", 1, False),
    (3, "Give me an overview", 2, False),
    (4, "What is this document about?", 2, True),
    (5, "skills", 2, False),
    (6, "Oracle Corporation projects", 1, False),
    (7, "tell it again", 2, True),
    (8, "tell it again", 2, False),
    (9, "", 1, False),
    (10, "one two three four five", 1, False),
    (11, "A vs. B", 5, False),
    (12, "summaries of things", 1, False),
    (13, "What did they conclude?", 1, True),
    (14, "  difference between src10 and src11 , src12 ", 9, False),
    (15, "key points", 1, False),
]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as chunks: language -> session, source -> file, doc_id -> page."""
    d = read(spark, sf_dir, "documents")
    return d.select(chunk_id(F.col("source"), F.col("doc_id"), "c", F.lit(1)).alias("chunk_id"), F.col("lang").alias("chat_session_id"), F.col("source").alias("filename"), F.col("doc_id").cast("int").alias("page"), "text")


def questions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(QUESTIONS, "query_id int, chat_session_id string, question string")


def routed(spark: SparkSession) -> DataFrame:
    d = spark.createDataFrame(ROUTED, "query_id int, question string, document_count int, has_history boolean")
    return d.withColumn("resolved", F.lit(None).cast("string")).withColumn("chat_session_id", F.lit("s"))


#: The questions of conversations as SQL: user turns, most of them led by words that routing looks for.
TURNS_SQL = """r AS (SELECT conv_id * 100 + turn AS query_id, CASE (conv_id * 3 + turn) % 8 WHEN 0 THEN 'Compare ' || left(text, 40) WHEN 1 THEN 'Give me an overview of ' || left(text, 30) WHEN 2 THEN left(text, 15)
WHEN 3 THEN 'tell it again: ' || left(text, 12) WHEN 4 THEN '  ' WHEN 5 THEN 'What is this document about, ' || left(text, 9) WHEN 6 THEN left(text, 10) || ' they?' ELSE text END AS question, conv_id % 3 AS document_count, turn > 0 AS has_history FROM conversations WHERE role = 'user')"""


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The questions of TURNS_SQL."""
    c, t = read(spark, sf_dir, "conversations").where("role = 'user'"), lambda n: F.left("text", F.lit(n))
    k = (F.col("conv_id") * 3 + F.col("turn")) % 8
    led = [F.concat(F.lit("Compare "), t(40)), F.concat(F.lit("Give me an overview of "), t(30)), t(15), F.concat(F.lit("tell it again: "), t(12)), F.lit("  "), F.concat(F.lit("What is this document about, "), t(9)), F.concat(t(10), F.lit(" they?"))]
    question = F.col("text")
    for i, q in enumerate(led):
        question = F.when(k == i, q).otherwise(question)
    return c.select((F.col("conv_id") * 100 + F.col("turn")).alias("query_id"), question.alias("question"), (F.col("conv_id") % 3).cast("int").alias("document_count"), (F.col("turn") > 0).alias("has_history"), F.lit(None).cast("string").alias("resolved"))


def metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of one session: a file per source, titles on every third."""
    d = read(spark, sf_dir, "documents").select("source").distinct()
    title = F.when(F.regexp_extract("source", "[0-9]+", 0).cast("int") % 3 == 0, F.concat(F.lit("Report_on-"), F.col("source")))
    return d.select(F.lit("s").alias("chat_session_id"), F.concat("source", F.lit(".pdf")).alias("filename"), title.alias("display_title"))


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("chat_session_id"), F.col("turn").alias("created_at"), "role", F.col("text").alias("content"))


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events by user as sessions; odd users are guests."""
    e = read(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    d = e.groupBy("user_id").agg(F.max("ts").alias("last_active_at"), F.min("ts").alias("created_at"), F.count(F.lit(1)).alias("n_events"))
    return d.select(F.col("user_id").alias("chat_session_id"), (F.col("user_id") % 2 == 1).alias("is_guest"), F.when(F.col("user_id") % 2 == 0, F.col("user_id") % 10).alias("user_id"), "last_active_at", "created_at", "n_events")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings")


def query_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stated query set: rows whose id is divisible by 100."""
    return vectors(spark, sf_dir).where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").cast("array<double>").alias("query_vector"))


def gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """benchmark items with the documents that hold them."""
    b = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))
    d = read(spark, sf_dir, "documents").select(F.col("source").alias("expected_source"), F.col("doc_id").cast("int").alias("expected_page"), "text")
    return evaluate.holding(d, b, "text", "question").select("query_id", "question", "expected_source", "expected_page")


def pages_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """html pages as page text: the first h1 is a heading line, then the text of the first paragraphs."""
    p = read(spark, sf_dir, "pages")
    h1 = F.regexp_extract("html", "<h1>([^<]*)</h1>", 1)
    body = F.array_join(F.regexp_extract_all("html", F.lit("<p>([^<]*)</p>"), 1), "\n")
    text = F.when(F.col("page_id") % 3 == 0, body).otherwise(F.concat(F.lit("lead of the page\n# "), h1, F.lit("\n"), body))
    return p.select(F.concat(F.lit("site"), (F.col("page_id") % 7).cast("string")).alias("source"), F.col("page_id").cast("int").alias("page"), text.alias("text"))


def text_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc, page, i, line): the lines of documents; source -> file, doc_id -> page."""
    d = read(spark, sf_dir, "documents").where("text is not null")
    return d.select(F.col("source").alias("doc"), F.col("doc_id").cast("int").alias("page"), F.posexplode(F.split("text", "\n")).alias("i", "line"))


def _line_hash() -> Column:
    return portable_hash(F.concat_ws("/", F.col("page").cast("string"), F.col("i").cast("string")))


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as layout spans: three to a block, two spans to a line; sizes, fonts and places come from hashes."""
    block = F.floor(F.col("i") / 3).cast("int")
    hb = portable_hash(F.concat_ws("|", F.col("page").cast("string"), block.cast("string")))
    d = text_lines(spark, sf_dir).withColumns({"h": _line_hash(), "hb": hb, "ws": F.split("line", " ")}).withColumn("s", F.explode(F.array(F.lit(0), F.lit(1))))
    text = F.when(F.col("s") == 0, F.concat(F.get("ws", F.lit(0)), F.lit(" "))).otherwise(F.array_join(F.slice("ws", F.lit(2), F.size("ws")), " "))
    x0, y0 = 10.0 + 120 * (F.col("hb") % 2) + F.col("s"), 12.0 * (F.col("hb") % 40) + F.col("i") % 3
    font = F.when(F.col("h") % 4 == 0, "Serif-Bold").otherwise("Serif")
    return d.select("doc", "page", block.alias("block_no"), (F.col("i") % 3).alias("line_no"), F.col("s").alias("span_no"), x0.alias("x0"), y0.alias("y0"), (9.0 + (F.col("h") + F.col("s")) % 9 * 0.5).alias("size"), font.alias("font"), text.alias("text"), F.lit(200.0).alias("page_width"))


def page_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of lines with their height on the page; a third of the lines begins as table captions do, a third as those of figures."""
    d = text_lines(spark, sf_dir).withColumn("h", _line_hash())
    line = F.concat(F.when(F.col("h") % 3 == 0, "Table ").when(F.col("h") % 3 == 1, "Fig. ").otherwise(""), F.col("line"))
    d = d.select("doc", "page", "i", "h", F.posexplode(F.filter(F.split(line, " "), lambda w: w != "")).alias("j", "text"))
    return d.select("doc", "page", (F.col("i").cast("long") * 100_000 + F.col("j") + 1).alias("seq"), "text", (25.0 * F.col("i") + F.col("h") % 5 / 10.0).alias("top"))


def elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two boxes per page, of height 20."""
    d = read(spark, sf_dir, "documents").where("text is not null").withColumn("elem", F.explode(F.array(F.lit(1), F.lit(2))))
    top = 10 + portable_hash(F.concat(F.col("doc_id").cast("string"), F.col("elem").cast("string"))) % 200
    return d.select(F.col("source").alias("doc"), F.col("doc_id").cast("int").alias("page"), "elem", top.cast("double").alias("top"), (top + 20).cast("double").alias("bottom"))


def line_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc, page, tbl, rows): each four lines of a page as a table, cells between bars."""
    d = text_lines(spark, sf_dir).withColumn("tbl", F.floor(F.col("i") / 4).cast("int"))
    rows = F.transform(F.array_sort(F.collect_list(F.struct("i", F.split("line", r"\|").alias("r")))), lambda x: x["r"])
    return d.groupBy("doc", "page", "tbl").agg(rows.alias("rows"))


def drawings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as drawings of 40 by 30 points, some hundreds to a page."""
    e = read(spark, sf_dir, "events")
    ident = F.col("event_id").cast("string")
    x, y = (portable_hash(ident) % 600).cast("double"), (portable_hash(F.concat("props", ident)) % 800).cast("double")
    return e.select((F.col("user_id") % 5).cast("string").alias("doc"), F.dayofmonth("ts").alias("page"), F.col("event_id").alias("seq"), x.alias("x0"), y.alias("y0"), (x + 40).alias("x1"), (y + 30).alias("y1"))
