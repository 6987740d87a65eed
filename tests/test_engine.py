"""Operators on hand-built inputs with expected results worked out from their rules."""

import json
import math
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from quarrydoc import providers
from quarrydoc.functions import text as T
from quarrydoc.operators import chunking, context, dense, evaluate, fusion, layout, lexical, routing, sessions
from quarrydoc.plans import retrieval
from quarrydoc.sources import stores
from quarrydoc.streaming.sessions import inactivity_sessions, refresh_index


def one(df, c):
    return df.select(c.alias("x")).head().x


def test_heading_score(spark):
    rows = [("Results and Discussion", 13.0, True, 10.0, 5), ("ends with stop.", 10.0, False, 10.0, -1), (" ".join(["w"] * 16), 13.0, False, 10.0, 0), ("ABSTRACT", 10.5, False, 10.0, 3), ("x", 10.0, False, 0.0, 1)]
    df = spark.createDataFrame(rows, "t string, s double, b boolean, y double, want int")
    for r in df.select(T.heading_score(F.col("t"), F.col("s"), F.col("b"), F.col("y")).alias("got"), "want", "t").collect():
        assert r.got == r.want, r.t


def test_text_functions(spark):
    df = spark.range(1)
    assert one(df, T.question_title(F.lit("x" * 50))) == "x" * 50
    assert one(df, T.question_title(F.lit("x" * 51))) == "x" * 47 + "..."
    assert one(df, T.renamed_title(F.lit("   "))) is None
    assert one(df, T.file_title(F.lit("My_report-2.PDF"))) == "my report 2"
    assert one(df, T.basename(F.lit("a\\b/c.pdf"))) == "c.pdf"
    assert one(df, T.iso_z(F.lit("2024-01-02 03:04:05.5").cast("timestamp"))) == "2024-01-02T03:04:05.500000Z"
    assert one(df, T.iso_z(F.lit("2024-01-02 03:04:05").cast("timestamp"))) == "2024-01-02T03:04:05Z"
    assert one(df, T.minutes_left(F.lit(59))) == 1 and one(df, T.minutes_left(F.lit(60))) == 2
    assert one(df, T.confidence(F.lit(0.0))) == "low"
    assert one(df, T.tokens(F.lit("A b\x1cc  D"))) == ["a", "b", "c", "d"]
    assert one(df, T.bare_words(F.lit("(What?) it's"))) == ["what", "it's"]
    assert one(df, T.section_prefix(F.lit("t"), F.lit("S"), F.lit("chart"))) == "[Section: S]\n[Chart]\n\nt"
    assert one(df, T.section_prefix(F.lit("t"), F.lit(None).cast("string"), F.lit("text"))) == "t"
    assert one(df, T.l2(F.array(F.lit(0.0), F.lit(3.0)), F.array(F.lit(4.0), F.lit(0.0)))) == 5.0
    assert one(df, T.question_mode(T.summarised(F.lit("q")), F.lit(1))) == "broad"
    assert one(df, T.refers_back(T.simpler(F.lit("q"))))


def chunks(spark, rows):
    return spark.createDataFrame(rows, "chat_session_id string, chunk_id string, filename string, page int, text string")


def okapi(texts, query):
    docs = [t.lower().split() for t in texts]
    n, avg = len(docs), sum(map(len, docs)) / len(docs)
    df = {w: sum(w in d for d in docs) for d in docs for w in d}
    idf = {w: math.log(n - f + 0.5) - math.log(f + 0.5) for w, f in df.items()}
    mean = sum(idf.values()) / len(idf)
    idf = {w: 0.25 * mean if v < 0 else v for w, v in idf.items()}
    return [sum(idf.get(w, 0) * d.count(w) * 2.5 / (d.count(w) + 1.5 * (0.25 + 0.75 * len(d) / avg)) for w in query.lower().split()) for d in docs]


def test_bm25_fills_ranks_and_keeps_sessions_apart(spark):
    texts = ["cat sat mat", "dog sat", "cat cat dog", "bird", "cat fish pond pond", "cat"]
    a = [("a", f"c{i}", "f", i, t) for i, t in enumerate(texts)]
    q = spark.createDataFrame([(1, "a", "cat pond pond"), (2, "a", "nothing"), (3, "b", "cat"), (4, "none", "cat")], "query_id int, chat_session_id string, question string")
    alone = lexical.bm25_search(chunks(spark, a), q.where("query_id < 3"), 6).collect()
    both = lexical.bm25_search(chunks(spark, a + [("b", "z", "f", 1, "cat"), ("b", "y", "f", 2, "dog dog")]), q, 6).collect()
    want = okapi(texts, "cat pond pond")
    for rows in (alone, both):
        got = {r.chunk_id: r for r in rows if r.query_id == 1}
        assert len(got) == 6
        for i, s in enumerate(want):
            assert got[f"c{i}"].score == pytest.approx(s)
        order = sorted(range(6), key=lambda i: (-round(want[i], 9), f"c{i}"))
        assert [got[f"c{i}"].rank for i in order] == [1, 2, 3, 4, 5, 6]
        assert [(r.chunk_id, r.rank, r.score) for r in sorted(rows, key=lambda r: r.rank) if r.query_id == 2] == [(f"c{i}", i + 1, 0.0) for i in range(6)]
    assert len([r for r in both if r.query_id == 3]) == 2 and not [r for r in both if r.query_id == 4]


def test_knn_ties_and_groups(spark, monkeypatch):
    v = spark.createDataFrame([(i, i % 2, [float(x), 0.0]) for i, x in enumerate([3, 1, 1, 2, 9, 0])] + [(9, 0, None)], "chunk_id int, g int, embedding array<double>")
    q = spark.createDataFrame([(1, [0.0, 0.0]), (2, [9.0, 0.0])], "query_id int, query_vector array<double>")
    got = dense.knn(v, q, 3).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.chunk_id) for r in got] == [(1, 5), (1, 1), (1, 2), (2, 4), (2, 0), (2, 3)]
    got = dense.knn(v, q.where("query_id = 1"), 1, group="g").collect()
    assert {(r.g, r.chunk_id) for r in got} == {(0, 2), (1, 5)}
    assert dense.knn(v, q.limit(0), 3).count() == 0
    named = q.withColumn("query_id", F.concat(F.lit("q"), "query_id"))
    whole = sorted(map(tuple, dense.knn(v, named, 3).collect()))
    assert [x[0] for x in whole] == ["q1"] * 3 + ["q2"] * 3
    monkeypatch.setattr(dense, "BLOCK_BYTES", 16)  # a block per query
    assert sorted(map(tuple, dense.knn(v, named, 3).collect())) == whole


def test_rrf_collisions(spark):
    long = "p" * 80
    rows = [(1, 0, 1, "s", 1, long + "a"), (1, 0, 2, "s", 1, long + "b"), (1, 1, 1, "s", 2, "x"), (1, 1, 2, "s", 1, long + "c"), (1, 0, 3, "s", 2, "y")]
    got = fusion.rrf(spark.createDataFrame(rows, "query_id int, leg int, rank int, source string, page int, text string")).orderBy("rank").collect()
    assert got[0].score == pytest.approx(1 / 61 + 1 / 62 + 1 / 62) and got[0].text == long + "a"
    assert [r.text for r in got] == [long + "a", "x", "y"]


def test_gate(spark):
    q = spark.createDataFrame([(1, "specific"), (2, "specific"), (3, "broad"), (4, "specific")], "query_id int, mode string")
    r = spark.createDataFrame([(1, "specific", -3.0), (1, "specific", -3.1), (2, "specific", -3.5), (3, "broad", -9.0)], "query_id int, mode string, rerank_score double")
    kept, refused = fusion.gate(r, q)
    assert sorted((x.query_id, x.rerank_score) for x in kept.collect()) == [(1, -3.0), (3, -9.0)]
    assert {x.query_id: x.refused for x in refused.collect()} == {1: False, 2: True, 3: False, 4: True}


def test_spread_sample(spark):
    for n, want in ((1, [0]), (7, list(range(7))), (8, list(range(8))), (15, list(range(8))), (16, list(range(0, 16, 2))), (23, list(range(0, 16, 2)))):
        c = chunks(spark, [("s", f"c{i:02d}", "f", i, "") for i in range(n)])
        assert sorted(r.i for r in routing.spread_sample(c).collect()) == want


def test_mentions(spark):
    d = spark.createDataFrame([("s", "annual_report.PDF", None), ("s", "22744iied.pdf", "Global South funds"), ("s", "x.pdf", None), ("t", "annual_report.pdf", None)], "chat_session_id string, filename string, display_title string")
    q = spark.createDataFrame([(1, "s", "compare AnnualReport with global south funds"), (2, "s", "compare 22744iied")], "query_id int, chat_session_id string, question string")
    got = {(r.query_id, r.filename) for r in routing.mentions(q, d).collect()}
    assert got == {(1, "annual_report.PDF"), (1, "22744iied.pdf"), (2, "22744iied.pdf")}
    got = [(r.query_id, r.filename) for r in routing.comparison_targets(q, d).collect()]
    assert len([x for x in got if x[0] == 1]) == 2 and len([x for x in got if x[0] == 2]) == 3


def test_split_text():
    assert chunking.split_text("") == []
    assert chunking.split_text("short") == ["short"]
    assert chunking.split_text("aaa bbb ccc", 7, 4) == ["aaa bbb", "ccc"]
    assert chunking.split_text("aaa bbb ccc", 8, 4) == ["aaa bbb", "bbb ccc"]
    got = chunking.split_text("x" * 25, 10, 4)
    assert got == ["x" * 10, "x" * 10, "x" * 10, "x" * 7] and "".join(got)[:10] == "x" * 10
    text = ". ".join(f"sentence number {i} goes here" for i in range(60)) + "\n\n" + " ".join(f"w{i}" for i in range(400))
    parts = chunking.split_text(text)
    assert all(len(p) <= 512 and p in text for p in parts)
    assert "sentence number 59 goes here" in " ".join(parts) and parts[-1].endswith("w399")


def test_chunk_pages(spark):
    pages = spark.createDataFrame([("s", 1, "lead\n# One \nbody one\n# Two"), ("s", 2, "carried"), ("s", 3, "  \n "), ("t", 1, "# Only")], "source string, page int, text string")
    extras = spark.createDataFrame([("s", 1, 1, "| a |", "table"), ("s", 9, 2, "pic", "image"), ("s", 2, 3, "| b |", "table")], "source string, page int, seq int, text string, element_type string")
    got = {r.chunk_id: r for r in chunking.chunk_pages(pages, extras).collect()}
    sid = "".join(next(iter(got)).split("_")[:1])
    assert {k.split("_", 1)[1]: (r.section_title, r.text) for k, r in got.items()} == {
        "p1_c1": (None, "lead"),
        "p1_c2": ("One", "[Section: One]\n\nbody one"),
        "p2_c1": ("Two", "[Section: Two]\n\ncarried"),
        "p1_tbl1": ("Two", "[Section: Two]\n[Table]\n\n| a |"),
        "p2_tbl2": ("Two", "[Section: Two]\n[Table]\n\n| b |"),
        "p9_vis1": ("Two", "[Section: Two]\n[Image]\n\npic"),
    }
    assert len(sid) == 8


def test_page_text(spark):
    rows = [("d", 1, 0, 0, 0, 10.0, 0.0, 90.0, 9.0, 20.0, "Bold", "Big title", 200.0), ("d", 1, 0, 1, 0, 10.0, 10.0, 90.0, 19.0, 20.0, "Bold", "second half", 200.0), ("d", 1, 1, 0, 0, 10.0, 30.0, 90.0, 40.0, 10.0, "R", "some body text that is long enough to carry the size, with a stop.", 200.0)]
    schema = "doc string, page int, block_no int, line_no int, span_no int, x0 double, y0 double, x1 double, y1 double, size double, font string, text string, page_width double"
    assert layout.page_text(spark.createDataFrame(rows, schema)).head().text == "# Big title second half\nsome body text that is long enough to carry the size, with a stop."


def test_drawing_clusters(spark):
    row = [("d", 1, i, 20.0 * i, 0.0, 20.0 * i + 10, 10.0) for i in range(8)]
    far = [("d", 1, 100 + i, 20.0 * i, 200.0, 20.0 * i + 10, 210.0) for i in range(7)]
    got = layout.drawing_clusters(spark.createDataFrame(row + far, "doc string, page int, seq int, x0 double, y0 double, x1 double, y1 double")).collect()
    assert [(r.x0, r.x1, r.n) for r in got] == [(0.0, 150.0, 8)]


def test_visual_limits(spark):
    v = spark.createDataFrame([("d", i // 3, "chart" if i % 2 else "image", i, 149 + i % 2, 150) for i in range(30)], "doc string, page int, kind string, seq int, width int, height int")
    assert layout.raster_candidates(v).count() == 15
    assert layout.first_visuals(v).count() == 20
    t = spark.createDataFrame([("d", 1, [["a"], ["b"]], 3), ("d", 2, [["a", "b"]], 5)], "doc string, page int, rows array<array<string>>, n_rects int")
    assert {r.page: r.retry for r in layout.needs_text_columns(t).collect()} == {1: True, 2: False}


def test_table_chunks(spark):
    t = spark.createDataFrame([("d", 1, 1, [["a", "b"], ["1", "2"]], "Table 1"), ("d", 1, 2, [["a"], ["1"]], None)], "doc string, page int, tbl int, rows array<array<string>>, caption string")
    assert [r.text for r in layout.table_chunks(t).collect()] == ["Table 1\n\n| a | b |\n| --- | --- |\n| 1 | 2 |"]


def test_sessions(spark):
    s = spark.createDataFrame([(1, True, None, datetime(2024, 1, 1)), (2, True, None, datetime(2024, 1, 2)), (3, False, 7, datetime(2023, 1, 1))], "chat_session_id int, is_guest boolean, user_id int, last_active_at timestamp")
    gone = sessions.stale_guests(s, F.lit("2024-01-03 00:00:00").cast("timestamp"))
    assert [r.chat_session_id for r in gone.collect()] == [1]
    assert {r.chat_session_id for r in sessions.without_sessions(s, gone).collect()} == {2, 3}
    assert {r.chat_session_id for r in sessions.visible(s, F.lit(8)).collect()} == {1, 2}


def test_uploads(spark):
    mb = 2**20
    rows = [("a", 1, 20 * mb, True, "application/pdf"), ("a", 2, 20 * mb + 1, True, "application/pdf"), ("a", 3, 20 * mb, False, "application/pdf"), ("a", 4, 20 * mb, True, "application/pdf"), ("a", 5, 10 * mb, True, "application/pdf"), ("a", 6, 1, True, "application/pdf"), ("a", 7, 1, True, "text/plain")]
    u = spark.createDataFrame(rows, "chat_session_id string, seq int, size long, magic_ok boolean, content_type string").withColumns({"session_exists": F.lit(True), "owner_id": F.lit(None).cast("int"), "user_id": F.lit(None).cast("int")})
    bad = sessions.reject_reason(u).select("reason").distinct().collect()
    assert {r.reason for r in bad} == {"bad_id"}
    u = u.withColumn("chat_session_id", F.lit("0" * 32))
    got = {r.seq: (r.accepted, r.reason, r.used) for r in sessions.admit_uploads(sessions.reject_reason(u)).collect()}
    assert [got[i][1] for i in range(1, 8)] == [None, "too_large", "bad_signature", None, None, "quota", "not_pdf"]
    assert got[5] == (True, None, 50 * mb)


def test_events_round_trip(spark):
    a = spark.createDataFrame([(1, "two words", '[{"page":1}]')], "query_id int, answer string, sources_json string")
    ev = context.answer_events(a)
    got = [(r.seq, r.event, r.data) for r in ev.orderBy("seq").collect()]
    assert got == [(0, "token", '{"content":"two "}'), (1, "token", '{"content":"words "}'), (2, "done", "{}"), (3, "sources", '{"sources":[{"page":1}]}')]
    wire = context.wire(ev).orderBy("seq").select("frame").collect()
    stream = spark.createDataFrame([("".join(r.frame for r in wire),)], "stream string")
    back = context.parse_wire(stream).withColumn("query_id", F.lit(1))
    assert [(r.event, r.data) for r in back.orderBy("seq").collect()] == [x[1:] for x in got]
    assert context.streamed_answer(back).head().answer == "two words "
    parsed = context.parsed_sources(spark.createDataFrame([(None,), ('[{"page":2,"source":"s","text":"t"}]',)], "sources_json string"))
    assert [len(r.sources) for r in parsed.collect()] == [0, 1]


def test_prompts(spark):
    c = spark.createDataFrame([(1, "specific", 2, "s", 5, "later"), (1, "specific", 1, "t", 4, "first")], "query_id int, mode string, rank int, source string, page int, text string")
    q = spark.createDataFrame([(1, "why")], "query_id int, question string")
    p = retrieval.prompts(c, q).head().prompt
    assert "[Source: t, Page 4]\nfirst\n\n[Source: s, Page 5]\nlater" in p and "why" in p
    assert [(r.ordinal, r.heading) for r in context.document_prompts(c, q).orderBy("ordinal").collect()] == [(1, "t"), (2, "s")]


def test_dense_leg_reaches_hybrid_and_comparison(spark):
    """Chunk z shares no word with the question and comes last by id, but is nearest; x is nearer still and of another session."""
    rows = [(f"c{i:02}", "s", "a" if i % 2 else "b", i, "word here") for i in range(40)] + [("z", "s", "a", 90, "nothing alike"), ("x", "t", "a", 91, "other session")]
    c = spark.createDataFrame(rows, "chunk_id string, chat_session_id string, filename string, page int, text string")
    v = spark.createDataFrame([(r[0], r[1], [{"z": 0.1, "x": 0.0}.get(r[0], 5.0 + r[3])]) for r in rows], "chunk_id string, chat_session_id string, embedding array<double>")
    q = spark.createDataFrame([(1, "s", "What is the word", 2, False, None), (2, "s", "Compare the word", 2, False, None)], "query_id int, chat_session_id string, question string, document_count int, has_history boolean, resolved string")
    qv = spark.createDataFrame([(1, [0.0]), (2, [0.0])], "query_id int, query_vector array<double>")
    pages = [r.page for r in retrieval.hybrid(c, q.where("query_id = 1"), 60, v, qv).collect()]
    assert 90 in pages and 91 not in pages
    docs = c.select("chat_session_id", "filename").distinct().withColumn("display_title", F.lit(None).cast("string"))
    got = retrieval.answer_contexts(c, q, docs, v, qv, 3).where("mode = 'comparison'").orderBy("rank").collect()
    assert [(r.query_id, r.source, r.page) for r in got] == [(2, "a", 90), (2, "a", 1), (2, "a", 3), (2, "b", 0), (2, "b", 2), (2, "b", 4)]


def test_metrics(spark):
    gold = spark.createDataFrame([(1, "s", 1), (2, "s", 2), (3, "s", 3)], "query_id int, expected_source string, expected_page int")
    c = spark.createDataFrame([("x", 1, 2, "s", 1), ("x", 2, 1, "s", 2), ("x", 3, 1, "t", 3), ("y", 1, 9, "s", 1)], "config string, query_id int, rank int, source string, page int")
    r = evaluate.first_rank(c, gold, (F.col("source") == F.col("expected_source")) & (F.col("page") == F.col("expected_page")))
    got = {x.config: (x.n, x.recall, x.mrr) for x in evaluate.recall_mrr(r, 5).collect()}
    assert got["x"] == (3, pytest.approx(2 / 3), pytest.approx(0.5)) and got["y"] == (3, 0.0, 0.0)
    df = spark.range(1)
    kws = F.array(F.lit("Aa"), F.lit("bb"), F.lit("cc"), F.lit("dd"))
    assert one(df, evaluate.keyword_match(F.lit("xx aa BB"), kws)) and not one(df, evaluate.majority_match(F.lit("xx aa BB"), kws))


def test_stores(spark, tmp_path):
    c = spark.createDataFrame([("c1", "f", 1, "t", [0.0], "text", None, "a"), ("c2", "g", 1, "t", [0.0], "text", None, "b")], stores.CHUNKS)
    stores.write_chunks(c, str(tmp_path / "chunks"))
    assert [r.chunk_id for r in stores.read_chunks(spark, str(tmp_path / "chunks"), "a").collect()] == ["c1"]
    assert stores.read_chunks(spark, str(tmp_path / "chunks"), None, ["g"]).count() == 1
    assert {r.filename: r.n_chunks for r in stores.ingested(c).collect()} == {"f": 1, "g": 1, None: 2}
    (tmp_path / "e.json").write_text(json.dumps([{"question": "q", "expected_source": "s", "expected_page": 1, "expected_keywords": ["k"]}]))
    assert stores.read_eval(spark, str(tmp_path / "e.json")).head().expected_keywords == ["k"]
    (tmp_path / "bin").mkdir()
    (tmp_path / "bin" / "a.pdf").write_bytes(b"%PDF-1 two words")
    (tmp_path / "bin" / "b.pdf").write_bytes(b"no")
    files = stores.read_binaries(spark, str(tmp_path / "bin"))
    assert {r.filename: r.magic_ok for r in files.collect()} == {"a.pdf": True, "b.pdf": False}

    def parser(data):
        if not data.startswith(b"%PDF-"):
            raise ValueError("corrupt")
        return [{"page": i, "text": w.decode()} for i, w in enumerate(data.split())]

    got = stores.parse_files(files, parser, "page int, text string").collect()
    assert sorted((r.filename, r.status) for r in got) == [("a.pdf", "ok")] * 3 + [("b.pdf", "ValueError")]
    p = spark.createDataFrame([("", 1), ("x", 0), (None, 0)], "text string, n_images int")
    assert sorted(r.text for r in stores.with_ocr(p, F.lit("seen")).collect()) == ["seen", "x"]
    stores.write_metrics(spark.range(1), str(tmp_path / "m"))
    assert stores.lookup(c, "filename", "f", "chunk_id").count() == 1


def test_providers(spark):
    df = spark.createDataFrame([("a b a",), ("",)], "t string")
    v = [r.v for r in df.select(providers.hashing_embedder(F.col("t"), 8).alias("v")).collect()]
    assert sum(x * x for x in v[0]) == pytest.approx(1.0) and v[1] == [0.0] * 8
    model = providers.model_column(lambda: lambda xs: [x.upper() for x in xs], "string")
    assert one(df.limit(1), providers.display_title(F.col("t"), F.lit("f"), model)) == "A B A"
    assert one(df.limit(1), providers.display_title(F.col("t"), F.lit("f"))) == "f"
    with pytest.raises(KeyError):
        providers.provider("none")


def test_streaming_refresh(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.createDataFrame([("a", "x")], "chat_session_id string, text string").write.parquet(src)
    seen = []
    stream = spark.readStream.schema("chat_session_id string, text string").parquet(src)
    refresh_index(stream, str(tmp_path / "cp"), lambda b, i: seen.append(b.count())).awaitTermination()
    assert seen == [1]
    e = spark.createDataFrame([(1, datetime(2024, 1, 1)), (1, datetime(2024, 1, 1, 5)), (1, datetime(2024, 1, 3))], "user_id long, ts timestamp")
    assert sorted(r.n_events for r in inactivity_sessions(e).collect()) == [1, 2]


def test_titles_mentions_and_sections_follow_the_rules(spark):
    df = spark.range(1)
    assert one(df, T.file_title(F.lit("my.pdfs notes.pdf"))) == "my.pdfs notes"
    d = spark.createDataFrame([("s", "annual_report.pdf", None)], "chat_session_id string, filename string, display_title string")
    q = spark.createDataFrame([(1, "s", "compare annual\treport"), (2, "s", "compare annual\n report"), (3, "s", "annual reports? no: annualrep ort"), (4, "s", "anual report")], "query_id int, chat_session_id string, question string")
    assert {r.query_id for r in routing.mentions(q, d).collect()} == {1, 2, 3}
    text = "x\r# y # z\n# Real\rtitle   more\nbody\u0085# no"
    got = [(r.title, r.body) for r in chunking.sections(spark.createDataFrame([("s", 1, text)], "source string, page int, text string")).orderBy("sec").collect()]
    assert got == [(None, "x\r# y # z"), ("Real\rtitle   more", "body\u0085# no")]


def test_drawing_clusters_merge_until_stable(spark):
    import random

    boxes = lambda rows: spark.createDataFrame([("d", 1, i, *map(float, b)) for i, b in enumerate(rows)], "doc string, page int, seq int, x0 double, y0 double, x1 double, y1 double")
    got = layout.drawing_clusters(boxes([(100, 100, 110, 110), (50, 0, 60, 200), (60, 210, 200, 215)]), least=1).collect()
    assert [(r.x0, r.y0, r.x1, r.y1, r.n) for r in got] == [(50, 0, 200, 215, 3)]
    got = layout.drawing_clusters(boxes([(0, 0, 10, 10), (25, 0, 25, 0), (41, 0, 50, 10)]), least=1).collect()  # touching merges, a point counts, 16 apart stay apart
    assert [r.n for r in got] == [2, 1]
    rnd = random.Random(3)
    for _ in range(3):
        rows = [(x, y, x + rnd.randint(0, 60), y + rnd.randint(0, 40)) for x, y in ((rnd.randint(0, 900), rnd.randint(0, 900)) for _ in range(80))]
        parts = [[r] for r in rows]
        box = lambda p: (min(r[0] for r in p), min(r[1] for r in p), max(r[2] for r in p), max(r[3] for r in p))
        merged = True
        while merged:
            merged = False
            for i in range(len(parts)):
                for j in range(i + 1, len(parts)):
                    a, b = box(parts[i]), box(parts[j])
                    if a[0] - 15 <= b[2] and b[0] <= a[2] + 15 and a[1] - 15 <= b[3] and b[1] <= a[3] + 15:
                        parts[i] += parts.pop(j)
                        merged = True
                        break
                if merged:
                    break
        want = sorted((*box(p), len(p)) for p in parts)
        got = layout.drawing_clusters(boxes(rows), least=1).collect()
        assert sorted((r.x0, r.y0, r.x1, r.y1, r.n) for r in got) == want


def test_table_markdown_of_odd_tables(spark):
    tables = {
        1: ([["a", "b"], ["1", None], ["", ""], ["x\ny", " 2 "]], True, "| a | b |\n| --- | --- |\n| 1 |  |\n| x y | 2 |"),
        2: ([["only"], ["one"]], False, "| only |\n| --- |\n| one |"),
        3: ([[str(i) for i in range(13)]] * 2, False, "\n".join(["| " + " | ".join(str(i) for i in range(13)) + " |", "| " + " | ".join(["---"] * 13) + " |", "| " + " | ".join(str(i) for i in range(13)) + " |"])),
        4: ([["a", "b"], ["c", None]], False, "| a | b |\n| --- | --- |\n| c |  |"),
        5: ([["a", "b", "c"], ["1"], ["2", "3", "4", "5"]], True, "| a | b | c |\n| --- | --- | --- |\n| 1 |  |  |\n| 2 | 3 | 4 |"),
        6: ([["", None]], False, ""),
    }
    df = spark.createDataFrame([(t, r[0]) for t, r in tables.items()], "tbl int, rows array<array<string>>")
    for r in df.select("tbl", layout.plausible_table(F.col("rows")).alias("ok"), layout.table_markdown(F.col("rows")).alias("m")).collect():
        assert (r.ok, r.m) == tables[r.tbl][1:]


def test_page_tables_retry(spark):
    p = spark.createDataFrame([("d", 1, 3), ("d", 2, 2), ("d", 3, 3), ("d", 4, 5)], "doc string, page int, n_rects int")
    lines = F.when(F.col("page") < 3, F.array(F.array(F.array(F.lit("a b"))))).when(F.col("page") == 3, F.array(F.array(F.array(F.lit("a"), F.lit("b"))))).otherwise(F.array().cast("array<array<array<string>>>"))
    text = F.array(F.array(F.array(F.lit("a"), F.lit("b"))), F.array(F.array(F.lit("c"))))
    got = sorted((r.page, r.tbl, r.rows) for r in layout.page_tables(p, lines, text).collect())
    assert got == [(1, 1, [["a", "b"]]), (1, 2, [["c"]]), (2, 1, [["a b"]]), (3, 1, [["a", "b"]])]


def test_holding_equals_all_pairs(spark):
    import random

    rnd = random.Random(2)
    ws = ["aa", "b", "cc.", "d", "ee"]
    texts = [" ".join(rnd.choice(ws) for _ in range(rnd.randint(0, 60))) for _ in range(60)] + [None, "", "x\ny  z"]
    items = [t[a : a + rnd.randint(1, 60)] for t in texts[:40] if t for a in [rnd.randint(0, len(t))]] + ["", "b d", "aa b cc. d ee"]
    t = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "t int, text string")
    q = spark.createDataFrame([(i, x) for i, x in enumerate(items)], "q int, item string")
    got = sorted((r.t, r.q) for r in evaluate.holding(t, q, "text", "item").collect())
    assert got == sorted((i, j) for i, x in enumerate(texts) if x is not None for j, y in enumerate(items) if y in x)


def test_holding_repeated_rows_and_blocks_of_short_items(spark, monkeypatch):
    """Repeated texts and items each give their pairs; short items beyond the broadcast bound come in blocks; no items, no pairs."""
    from quarrydoc import scratch

    texts = ["a b c d e f g", "a b c d e f g", "a b", "c d e", None]
    items = ["b c d e f g", "b c d e f g", "b", "b", "d e", "c d e", None, "b c"]
    t = spark.createDataFrame([(x,) for x in texts], "text string")
    q = spark.createDataFrame([(x,) for x in items], "item string")
    want = sorted((x, y) for x in texts if x for y in items if y and y in x)
    for bytes_ in (scratch.BROADCAST_BYTES, 700):
        monkeypatch.setattr(evaluate, "BROADCAST_BYTES", bytes_)
        assert sorted((r.text, r.item) for r in evaluate.holding(t, q, "text", "item").collect()) == want
    assert evaluate.holding(t, q.limit(0), "text", "item").count() == 0


def test_index_versions(spark, tmp_path):
    rows = [("a", f"c{i}", "f", i, f"word{i} cat") for i in range(5)] + [("b", "z", "f", 1, "cat dog")]
    q = spark.createDataFrame([(1, "a", "cat word9"), (2, "b", "dog")], "query_id int, chat_session_id string, question string")
    index = str(tmp_path / "index")
    lexical.build_index(chunks(spark, rows), index)
    ask = lambda: sorted((r.query_id, r.chunk_id, round(r.score, 9), r.rank) for r in lexical.search_index(spark, index, q, 3).collect())
    fresh = lambda rs: sorted((r.query_id, r.chunk_id, round(r.score, 9), r.rank) for r in lexical.bm25_search(chunks(spark, rs), q, 3).collect())
    assert ask() == fresh(rows) and len(ask()) == 4
    more = rows + [("a", "c9", "f", 9, "word9 word9 cat")]
    lexical.build_index(chunks(spark, [r for r in more if r[0] == "a"]), index)  # session a anew, b as it was
    assert ask() == fresh(more) and [x[1] for x in ask() if x[0] == 1 and x[3] == 1] == ["c9"]
    lexical.invalidate(spark, index, spark.createDataFrame([("b",)], "chat_session_id string"))
    assert ask() == [x for x in fresh(more) if x[0] == 1]


def test_error_and_refusal_events(spark):
    a = spark.createDataFrame([(1, "two words", None, True, "high"), (2, None, None, True, None), (3, "x", '[{"page":1}]', None, "low")], "query_id int, answer string, sources_json string, failed boolean, confidence string")
    got = [(r.query_id, r.seq, r.event, r.data) for r in context.answer_events(a).orderBy("query_id", "seq").collect()]
    error = '{"message":"' + context.FAILURE + '"}'
    assert got == [(1, 0, "token", '{"content":"two "}'), (1, 1, "token", '{"content":"words "}'), (1, 2, "error", error), (2, 0, "error", error), (3, 0, "token", '{"content":"x "}'), (3, 1, "done", "{}"), (3, 2, "sources", '{"sources":[{"page":1}],"confidence":"low"}')]
    r = context.answer_events(context.refusal_answers(spark.createDataFrame([(7,)], "query_id int"))).orderBy("seq").collect()
    assert "".join(json.loads(x.data)["content"] for x in r if x.event == "token") == context.REFUSAL + " "
    flat = spark.createDataFrame([(1, 1, "t")], "query_id int, rank int, text string")
    assert context.flat_contexts(flat).collect() == flat.collect()


def test_model_threads(spark):
    df = spark.createDataFrame([(i, str(i)) for i in range(20)], "i int, t string")
    for threads in (0, 1, 5):
        load = (lambda: lambda x: x + "!") if threads else (lambda: lambda xs: [x + "!" for x in xs])
        got = df.select("i", providers.model_column(load, "string", threads)(F.col("t")).alias("m")).collect()
        assert all(r.m == f"{r.i}!" for r in got)
    assert one(df.limit(1), providers.provider("stream")(F.lit("two  words"))) == ["two ", " ", "words"]


def test_run_available_writes_a_table(spark, tmp_path):
    from quarrydoc.streaming.sessions import run_available

    src = str(tmp_path / "in")
    spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "k string, v int").write.parquet(src)
    stream = lambda: spark.readStream.schema("k string, v int").parquet(src)
    got = run_available(stream().groupBy("k").agg(F.sum("v").alias("s")), "sums")
    assert sorted((r.k, r.s) for r in got.collect()) == [("a", 3), ("b", 3)]
    assert run_available(stream(), "rows", "append").count() == 3
