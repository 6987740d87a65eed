"""Prefix scans, automata, binned ranges, pivots, the file source and timers, each against the plain way."""

import base64
import random
import time

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from quarrydoc.operators import chunking, layout, pivots, routing
from quarrydoc.operators.prefix import carry_forward, page_bucket, positions
from quarrydoc.sources import files
from quarrydoc.streaming import expiry


def test_prefix_scans(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "b", None]), rng.choice([None, *range(-3, 40)]), i, rng.choice([None, None, f"t{i}"])) for i in range(600)]
    df = spark.createDataFrame(rows, "source string, page int, sec int, title string")
    w = Window.partitionBy("source").orderBy("page", "sec")
    want = df.withColumn("x", F.last("title", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("i", F.row_number().over(w) - 1).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("source")))
    for size in (1, 7, 1000):
        got = carry_forward(df, ["source"], page_bucket(size=size), ["page", "sec"], "title", "x")
        got = positions(got, ["source"], page_bucket(size=size), ["page", "sec"], "i", "n").select(want.columns)
        assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
    assert carry_forward(df.limit(0), ["source"], page_bucket(), ["page", "sec"], "title", "x").count() == 0


def test_one_source_is_many_tasks(spark):
    found = spark.range(20_000).select(F.lit("s").alias("source"), F.col("id").cast("int").alias("page"), F.lit(1).alias("sec"), F.when(F.col("id") % 999 == 5, F.col("id").cast("string")).alias("title"), F.lit("b").alias("body"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        d = chunking.carried(found).withColumn("task", F.spark_partition_id())
        assert d.groupBy("task").count().count() > 1
        d = routing.spread_sample(found.selectExpr("source AS filename", "page", "'x' AS chat_session_id", "string(page) AS chunk_id"))
        assert sorted(r.page for r in d.collect()) == [2500 * i for i in range(8)]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_mentions_by_automaton(spark):
    rng = random.Random(2)
    bits = ["src", "1", "2", "annual", "report", " ", "_", "-", "x"]
    word = lambda n: "".join(rng.choices(bits, k=n))
    docs = [(rng.choice("st"), word(rng.randint(1, 4)) + rng.choice([".pdf", ".PDF", ""]), rng.choice([None, word(3), ""])) for _ in range(120)] + [("s", ".pdf", None), (None, "x.pdf", None), ("s", None, "x")]
    questions = [(i, rng.choice(["s", "t", None]), rng.choice([None, "", word(12), word(30).upper()])) for i in range(80)]
    d = spark.createDataFrame(docs, "chat_session_id string, filename string, display_title string")
    q = spark.createDataFrame(questions, "query_id int, chat_session_id string, question string")
    from quarrydoc.functions.text import WS, file_title

    names = F.array_compact(F.array(file_title(F.col("filename")), file_title(F.col("display_title"))))
    lower = q.select("query_id", "chat_session_id", F.lower("question").alias("q"), F.regexp_replace(F.lower("question"), WS, "").alias("qc"))
    hit = F.exists("names", lambda n: F.col("q").contains(n) | F.col("qc").contains(F.regexp_replace(n, " ", "")))
    want = lower.join(d.select("chat_session_id", "filename", names.alias("names")), "chat_session_id").where(hit).where("filename is not null").select("query_id", "filename").distinct()
    want = sorted(map(tuple, want.collect()))
    for size in (2**23, 700):
        assert sorted(map(tuple, routing.mentions(q, d, size).collect())) == want and len(want) > 100
    assert routing.mentions(q, d.limit(0)).count() == 0


def test_mentions_without_a_nested_loop(spark):
    d = spark.range(100_000).select(F.lit("s").alias("chat_session_id"), F.concat(F.lit("file number "), F.col("id").cast("string"), F.lit(".pdf")).alias("filename"), F.lit(None).cast("string").alias("display_title"))
    q = spark.createDataFrame([(1, "s", "compare File Number 77777 and filenumber 12 please")], "query_id int, chat_session_id string, question string")
    got = sorted(r.filename for r in routing.mentions(q, d).collect())
    assert got == sorted(f"file number {n}.pdf" for n in ("1", "12", "7", "77", "777", "7777", "77777"))


def test_captions_by_bins(spark):
    rng = random.Random(3)
    boxes = [("d", 1, i, *rng.choice([(float(t), float(t) + rng.choice([0, 20, 500])), (t + 0.5, t + 61.25), (None, 10.0), (50.0, None), (-70.0, -10.0)])) for i in range(300) for t in [rng.randint(0, 700)]]
    lines = [("d", 1, i, f"Table {i}", float(rng.randint(-40, 900)) + rng.choice([0.0, 0.4])) for i in range(150)]
    e = spark.createDataFrame(boxes, "doc string, page int, elem int, top double, bottom double")
    w = spark.createDataFrame(lines, "doc string, page int, seq long, text string, top double")
    got = {r.elem: r.caption for r in layout.captions(e, w).collect()}
    by_y = {}
    for _, _, _, text, top in sorted(lines, key=lambda x: x[2]):
        by_y.setdefault(float(round(top)), []).append(text)
    for _, _, elem, top, bottom in boxes:
        near = []
        for y, texts in by_y.items():
            above = top is not None and top - 60 <= y < top
            if above or (bottom is not None and bottom < y <= bottom + 60):
                near.append((0 if above else 1, top - y if above else y - bottom, " ".join(texts)))
        near = [x for x in near if len(x[2].split()) <= 20]
        assert got[elem] == (min(near)[2] if near else None), (top, bottom)


@pytest.mark.parametrize("clustered", [True, False])
def test_pivots(spark, clustered):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(20, 16)) * (10 if clustered else 0)
    x = np.round(centres[rng.integers(0, 20, 2000)] + rng.normal(size=(2000, 16)), 3)
    x[100:110] = x[0]  # ties
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(9999, None)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    asked = [0, 3, 500, 1999]
    q = spark.createDataFrame([(i, x[i].tolist()) for i in asked] + [(5000, [0.0] * 16), (6000, None)], "query_id int, query_vector array<double>")
    index = pivots.build(spark, d, "vec_id", pivots=24)
    near, share = pivots.search(spark, index, q, 15, per_block=3)
    got = {}
    for r in near.orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, round(r.dist, 6)))
    for i in [*asked, 5000]:
        v = x[i] if i != 5000 else np.zeros(16)
        dist = np.sqrt(((x - v) ** 2).sum(axis=1))
        best = sorted(range(2000), key=lambda j: (round(dist[j], 9), j))[:15]
        assert got[i] == [(j, round(dist[j], 6)) for j in best]
    assert set(got) == {*asked, 5000} and (share < 0.35 if clustered else share <= 1.0), share
    few, _ = pivots.search(spark, pivots.build(spark, d.where("vec_id < 5"), "vec_id"), q, 15)
    assert few.count() == 25
    none, share = pivots.search(spark, pivots.build(spark, d.limit(0), "vec_id"), q, 3)
    assert none.count() == 0 and share == 0.0


def word_items(data: bytes, columns: set[str]) -> list[dict]:
    """A parser for the test: words of a text; it says which columns it was asked for."""
    if data == b"bad":
        raise ValueError("corrupt")
    return [{"word": w.decode(), "asked": ",".join(sorted(columns))} for w in data.split()]


def test_file_source(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "in")
    contents = {f"f{i}.txt": f"w{i} common".encode() for i in range(40)} | {"bad.txt": b"bad", "none.txt": b""}
    d = spark.createDataFrame(list(contents.items()), "filename string, content binary")
    files.write_files(d, path)
    files.write_files(d.where("filename = 'f1.txt'"), path)  # written again, as by a task that is repeated
    assert sorted(p.name for p in (tmp_path / "in").iterdir()) == sorted(contents)
    parser = "tests.test_structures:word_items"
    df = files.read_items(spark, path, parser, "filename string, status string, word string, asked string, size long", 10 * (files.OPEN_BYTES + 10))
    rows = df.collect()
    assert len(rows) == 82 and df.rdd.getNumPartitions() == 5
    assert {r.status for r in rows if r.word is None} == {"ValueError", "empty"} and {r.asked for r in rows if r.word} == {"asked,filename,size,status,word"}
    assert {r.asked for r in files.read_items(spark, "file://" + path, parser, "filename string, asked string").where("filename = 'f7.txt'").collect()} == {"asked,filename"}
    few = files.read_items(spark, path, parser, "filename string, word string").where(F.col("filename").isin("f3.txt", "f4.txt"))
    assert sorted(r.word for r in few.collect()) == ["common", "common", "w3", "w4"]
    reader = files.ItemReader({"path": path, "parser": parser}, df.schema)
    left = list(reader.pushFilters([files.In(("filename",), ("f3.txt", "f4.txt")), files.EqualTo(("filename",), "f4.txt"), files.EqualTo(("word",), "x")]))
    assert [f.attribute for f in left] == [("word",)] and [len(g.paths) for g in reader.partitions()] == [1]


def test_sessions_expire_without_a_later_event(spark, tmp_path):
    """The query stops, the clock moves past the time to live, and the query goes on from its checkpoint: nothing new came in, the sessions expire."""
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "user long, ts timestamp_ntz, other string"
    rows = "SELECT * FROM VALUES (1L, timestamp_ntz'2024-01-01 00:00:00', 'a'), (1L, timestamp_ntz'2024-01-01 05:00:00', 'b'), (2L, timestamp_ntz'2024-01-03 00:00:00', 'c'), (null, timestamp_ntz'2024-01-03 00:00:00', 'd') AS t(user, ts, other)"
    spark.sql(rows).write.parquet(src)
    before = spark.conf.get(expiry.STATE_STORE[0])
    spark.conf.set(*expiry.STATE_STORE)

    def run():
        d = expiry.expired_sessions(spark.readStream.schema(schema).parquet(src), "user", "ts", 30_000)
        return d.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(processingTime="1 second").start()

    def found():
        d = spark.read.schema(f"key long, {expiry.STATE}").parquet(out)
        return sorted((r.key, r.n_events, str(r.first), str(r["last"])) for r in d.collect())

    try:
        began = time.time()
        q = run()
        while time.time() < began + 60 and sum(p["numInputRows"] for p in q.recentProgress) < 3:
            time.sleep(0.5)
        q.stop()
        assert found() == []
        time.sleep(max(0.0, 31 - (time.time() - began)))
        q = run()
        try:
            while time.time() < began + 120 and len(found()) < 2:
                time.sleep(1)
            assert q.exception() is None
        finally:
            q.stop()
        assert found() == [(1, 2, "2024-01-01 00:00:00", "2024-01-01 05:00:00"), (2, 1, "2024-01-03 00:00:00", "2024-01-03 00:00:00")]
    finally:
        spark.conf.set(expiry.STATE_STORE[0], before)


def test_data_url_is_one_line(spark):
    """Addresses of 58 bytes and more took a second line of base64."""
    from quarrydoc.functions.text import data_url

    got = spark.createDataFrame([(n, b"x" * n) for n in (0, 57, 58, 300)], "n int, b binary").select("n", data_url(F.col("b")).alias("u")).collect()
    assert all(r.u == "data:image/png;base64," + base64.b64encode(b"x" * r.n).decode() for r in got)
