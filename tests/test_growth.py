"""Steps whose cost must not outgrow their input."""

import math
from collections import Counter

from pyspark.sql import functions as F

from quarrydoc.operators import lexical
from quarrydoc.sources import snapshots


def test_blocks_of_words(spark, tmp_path, monkeypatch):
    """Postings of a segment over many small tasks and slices: counts, bounds and lengths as of the texts."""
    monkeypatch.setattr(lexical, "TASK_TOKENS", (50, 50))
    monkeypatch.setattr(lexical, "SLICE", 4)
    texts = {f"c{i}": " ".join(f"w{(i * j) % 7}" for j in range(i % 9)) + (" Ä　ss" if i % 5 == 0 else "") for i in range(60)}
    df = spark.createDataFrame([("s" + k[-1], k, v) for k, v in texts.items()] + [("s1", "cn", None)], "chat_session_id string, chunk_id string, text string")
    path = str(tmp_path / "index")
    lexical.build_index(df, path)
    rows = lexical._postings(spark, path, snapshots.current(spark, path)).collect()
    got = {(r.session, r.term, d.chunk, d.tf, d.dl) for r in rows for d in r.docs}
    words = {k: [w.lower() for w in v.split()] for k, v in texts.items()}
    assert got == {("s" + k[-1], w, k, n, len(ws)) for k, ws in words.items() for w, n in Counter(ws).items()}
    assert sum(len(r.docs) for r in rows) == len(got)
    assert all((r.n, r.max_tf, r.min_dl) == (len(r.docs), max(d.tf for d in r.docs), min(d.dl for d in r.docs)) for r in rows)
    assert {r.session: r.n for r in lexical.in_force(spark, path).collect()}["s1"] == 7


def test_build_tasks_do_not_grow():
    """A task of the build sorts a million tokens at most; four times as many spilled."""
    assert lexical.TASK_TOKENS[1] <= 1_000_000


def test_large_rows_share_no_row_group(spark):
    """Rows of a megabyte: a row group holds few of them, however many a task writes."""
    import glob

    import pyarrow.parquet as pq

    from quarrydoc.scratch import table

    rows = spark.range(0, 40, 1, 1).select("id", F.transform(F.sequence(F.lit(1), F.lit(250_000)), lambda i: F.hash(F.col("id"), i)).alias("x"))
    t = table(rows, "large-rows", "zstd", 4 * 2**20)
    files = glob.glob(t.scratch_path.removeprefix("file://") + "/*.parquet")
    groups = [pq.ParquetFile(f).metadata for f in files]
    assert max(m.row_group(i).num_rows for m in groups for i in range(m.num_row_groups)) <= 8
    assert t.count() == 40


def test_own_phrases_come_as_rows(spark, monkeypatch):
    """Beyond a broadcast, a block's frequent phrases are rows of its task; no row or group holds all of them."""
    from quarrydoc.llm import phrases

    docs = spark.createDataFrame([(f"a b c d{i % 3} e", "en") for i in range(300)], "text string, lang string")
    sent = sorted(map(tuple, phrases.collocations(docs, block_words=40).collect()))
    monkeypatch.setattr(phrases, "is_small", lambda *_: False)
    assert sorted(map(tuple, phrases.collocations(docs, block_words=40).collect())) == sent and sent
    posts = phrases.table(phrases.word_lists(docs, 40), "posts")
    found = phrases.numbered(posts.select("lang", F.explode("words").alias("word"), F.lit(1).alias("n")), ["lang", "word"], 1, "found")
    rows, _ = phrases.with_known(posts, posts.select("block", "lang", F.explode("words").alias("word")), found, ["lang", "word"], found.select("lang", "word", "id"))
    assert not [n for n, kind in rows.dtypes if kind.startswith("array<struct")]
    assert rows.groupBy(F.spark_partition_id()).agg(F.countDistinct("block").alias("n")).agg(F.max("n")).head()[0] <= 8 * phrases.TASK_BLOCKS


def test_gold_is_verified_without_a_search(spark, data, monkeypatch):
    """The check of the items needs no index."""
    from quarrydoc.plans import catalog

    monkeypatch.setattr(catalog, "index_of", None)
    assert catalog.QUERIES["gold_verify"](spark, data).select("query_id", "n_found", "status").collect() is not None



def test_splitting_holds_few_parts(spark, monkeypatch):
    """Parts become Arrow's every few texts; the pieces are those of splitting each text alone."""
    from quarrydoc.operators import chunking

    texts = [None, "", "a b " * 300, "x" * 700, "ä\n\nb. c"] * 5
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    monkeypatch.setattr(chunking, "HELD", 10)
    got = df.select("i", chunking.split_column(50, 10)(F.col("t")).alias("p")).collect()
    assert all(r.p == chunking.split_text(texts[r.i] or "", 50, 10) for r in got) and len(got) == 25


def test_store_keeps_one_copy_of_texts(spark, tmp_path, monkeypatch):
    """Texts and words are written where they stay, not to tables beside the store."""
    from quarrydoc.providers import provider
    from quarrydoc.sources import stores

    made = []
    for module in (lexical, stores):
        monkeypatch.setattr(module, "table", lambda df, name, *a, f=module.table: (made.extend(df.columns), f(df, name, *a))[1])
    rows = [(f"c{i}", "f", i, t, "text", None, "s") for i, t in enumerate(["Cat dog", "", None, "cat", "  "])]
    c = spark.createDataFrame(rows, "chunk_id string, filename string, page int, text string, element_type string, section_title string, chat_session_id string")
    assert stores.add_chunks(c, str(tmp_path), provider("embedder")) == 5
    assert made and not {"text", "words", "embedding"} & set(made)
    assert stores.rows_of(spark, str(tmp_path), "chunks").count() == 5 and lexical.in_force(spark, str(tmp_path)).head().n == 5


def test_compaction_moves_whole_slices(spark, tmp_path, monkeypatch):
    """Slices of half the size or more keep their chunks and are not shuffled; small ones are merged; postings and answers stay."""
    monkeypatch.setattr(lexical, "SLICE", 8)
    path, schema = str(tmp_path / "index"), "chat_session_id string, chunk_id string, text string"
    text = lambda i: " ".join(f"w{(i * j) % 11}" for j in range(6))
    for part in (range(0, 60), range(60, 62), range(62, 64), range(64, 66)):
        lexical.add_to_index(spark.createDataFrame([("s", f"c{i:03d}", "every " + text(i)) for i in part], schema), path)

    def slices():
        rows = lexical._postings(spark, path, snapshots.current(spark, path)).where("term = 'every'").collect()
        assert all(r.n == len(r.docs) for r in rows) and len({(r.batch, r.slice) for r in rows}) == len(rows)
        return {frozenset(d.chunk for d in r.docs) for r in rows}

    q = spark.createDataFrame([(1, "s", "w3 w5"), (2, "s", "every w10")], "query_id int, chat_session_id string, question string")
    ask = lambda: sorted((r.query_id, r.rank, r.chunk_id, round(r.score, 8)) for r in lexical.search_index(spark, path, q, 9).collect())
    before, answers = slices(), ask()
    lexical.compact_index(spark, path)
    after = slices()
    assert {x for x in before if len(x) >= 4} <= after and ask() == answers
    assert frozenset(f"c{i:03d}" for i in range(60, 66)) <= max((x for x in after if "c060" in x), key=len)
    assert sorted(c for x in after for c in x) == [f"c{i:03d}" for i in range(66)]


def test_spread_samples_travel_without_texts(spark, monkeypatch):
    """A broad question's sample is placed by ids, of its sessions alone; texts are read for the chunks taken, alike ones as often as sampled."""
    from quarrydoc.plans import retrieval

    rows = [(f"c{i:02d}", s, "f", i, f"text {i}") for i in range(20) for s in "ab"] + [("c00", "a", "f", 0, "other"), ("n", "a", None, None, "null")]
    c = spark.createDataFrame(rows, "chunk_id string, chat_session_id string, filename string, page int, text string")
    seen, sample = [], retrieval.routing.spread_sample
    monkeypatch.setattr(retrieval.routing, "spread_sample", lambda d: (seen.append((set(d.columns), d.count())), sample(d))[1])
    got = retrieval.spread_texts(c, spark.createDataFrame([("a",)], "chat_session_id string")).collect()
    assert seen == [({"chunk_id", "chat_session_id", "filename", "page"}, 22)]
    want = sorted((r.page or -1) for r in sample(c.where("chat_session_id = 'a'")).collect())
    assert sorted((r.page or -1) for r in got) == want and len(got) == 9 and "null" in {r.text for r in got}


def test_words_are_counted_without_a_shuffle_of_words(spark, monkeypatch):
    """Texts are dealt by chunk; chunks of several rows, across slices and batches, are counted as one, nulls and blanks have no postings."""
    monkeypatch.setattr(lexical, "COUNTED", 3)
    rows = [("s", f"c{i % 7}", f"A b{i % 3}  a") for i in range(40)] + [("s", "n", None), ("s", "e", " \t"), (None, "c1", "x"), ("s", None, "y y")]
    c = spark.createDataFrame(rows, "chat_session_id string, chunk_id string, text string")
    d = lexical.postings(c)
    want = Counter((s, w, k) for s, k, t in rows for w in (t or "").lower().split())
    assert Counter({tuple(r)[:3]: r.tf for r in d.collect()}) == want and d.count() == len(want)
    plan = d._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan and "Generate" not in plan


def test_lines_too_long_for_captions_are_not_shuffled(spark):
    """A long line is one row before the shuffle, one out of all elements' reach none; captions are those of all words, also of lines in parts."""
    from quarrydoc.operators import layout

    line = lambda seq, top, n: [("d", 1, seq + j, "Table" if j == 0 else ("" if j % 2 else f"w{j}"), top) for j in range(n)]
    words = line(0, 50.0, 60) + line(100, 60.0, 30) + line(200, 400.0, 5) + line(300, 55.0, 30)[15:] + line(300, 55.0, 15) + line(400, 58.0, 25) + line(425, 58.0, 25)
    schema = "doc string, page int, seq long, text string, top double"
    w = spark.createDataFrame(words, schema).coalesce(1)
    marked = layout._marked(w.withColumn("_y", F.bround("top")).select("doc", "page", "_y", "seq", "text"))
    assert marked.where("_y = 50").count() == 1 and marked.where("_y = 60").count() == 30
    e = spark.createDataFrame([("d", 1, 1, 70.0, 90.0), ("d", 1, 2, 56.0, 57.0), ("d", 2, 1, 70.0, 90.0)], "doc string, page int, elem int, top double, bottom double")
    got = {(r.page, r.elem): r.caption for r in layout.captions(e, w).collect()}
    assert got[1, 1].startswith("Table ") and got[1, 1] == " ".join(x[3] for x in line(100, 60.0, 30)).strip()
    assert got[1, 2] == " ".join(x[3] for x in line(300, 55.0, 30)).strip() and got[2, 1] is None


def test_cells_of_a_table_are_looked_at_once(spark):
    """A table is judged from counts per row: the plan has the test of a cell once; nulls and blanks are empty, rows without a filled cell do not count."""
    from quarrydoc.operators import layout

    full = ["a", "b"]
    cases = [([full, full], True), ([full], False), ([full, full, [None, None]], True), ([[" ", "\t"], full, full], True), ([full, ["a"], ["b"]], False), ([["a"], full, full], False), ([full, full, ["a", "", " ", None, " ", "\x1c"]], True), ([full, full, ["a"] + [""] * 9], False), ([["a"] * 13, full], False), ([None, full, full], True), ([], False), (None, False)]
    d = spark.createDataFrame([(i, rows) for i, (rows, _) in enumerate(cases)], "i int, rows array<array<string>>").select("i", layout.plausible_table(F.col("rows")).alias("p"))
    assert {r.i: r.p for r in d.collect()} == {i: want for i, (_, want) in enumerate(cases)}
    assert d._jdf.queryExecution().optimizedPlan().toString().lower().count("rlike") == 1


def test_few_questions_are_answered_from_texts(spark, tmp_path, monkeypatch):
    """Without an index a few questions make none; ranks and scores are those of an index over the same chunks, as are those of many questions."""
    texts = ["Cat dog cat", "dog", "", None, " \t", "bird the the", "the cat"] + [f"the w{i % 4} w{i}" for i in range(12)]
    rows = [(s, i, t) for i, t in enumerate(texts) for s in "ab"] + [("a", 3, "cat cat again"), ("a", 1, "dog"), (None, 99, "cat"), ("c", 5, "bird"), ("e", 1, None)]
    c = spark.createDataFrame(rows, "chat_session_id string, chunk_id int, text string").repartition(5)
    asked = [(1, "a", "cat the CAT"), (2, "b", "the"), (3, "a", ""), (4, "b", "zzz w1 w1"), (5, "c", "bird"), (6, "d", "cat"), (7, "a", None), (8, "a", "the dog w3"), (9, "e", "cat")]
    q = spark.createDataFrame(asked, "query_id int, chat_session_id string, question string")
    path = str(tmp_path / "index")
    lexical.build_index(c, path)
    plain = lambda d: sorted((r.query_id, r["rank"], r.chunk_id, round(r.score, 9)) for r in d.collect())
    made, build = [], lexical.build_index
    monkeypatch.setattr(lexical, "build_index", lambda *a: (made.append(a), build(*a)))
    for k in (3, 30):
        want = plain(lexical.search_index(spark, path, q, k, key_type="int"))
        assert plain(lexical.bm25_search(c, q, k)) == want and want and not made
    with monkeypatch.context() as m:
        m.setattr(lexical, "is_small", lambda *_: False)
        assert plain(lexical.bm25_search(c, q, 30)) == want and len(made) == 1
    with monkeypatch.context() as m:
        m.setattr(lexical, "is_small", lambda side, *_: "score" not in side.columns)
        assert plain(lexical.bm25_search(c, q, 30)) == want and len(made) == 1


def test_reranking_builds_no_index(spark, data, monkeypatch):
    """Four questions alone are answered from the texts, with the rows of the SQL; an index that is there is used."""
    import duckdb

    from quarrydoc.plans import catalog, registry

    c = duckdb.connect()
    for t in ("documents", "embeddings"):
        c.execute(f"create view {t} as select * from read_parquet('{data}/{t}.parquet')")
    monkeypatch.setattr(registry, "_INDEXES", {})
    columns = ["query_id", "rerank_rank", "rerank_score", "source", "page"]
    ask = lambda: sorted(tuple(r[n] for n in columns) for r in catalog.QUERIES["rerank_lexical"](spark, data).collect())
    with monkeypatch.context() as m:
        m.setattr(lexical, "build_index", None)
        got = ask()
    want = c.execute(f"SELECT {', '.join(columns)} FROM ({catalog.ORACLES['rerank_lexical']})").fetchall()
    assert got == sorted(want) and got
    registry.index_of(spark, data)
    with monkeypatch.context() as m:
        m.setattr(lexical, "_search_texts", None)
        assert ask() == got


def test_matches_are_cut_where_the_texts_lie(spark, monkeypatch):
    """Tasks pass on k matches per question, not all of them, and ranks are those of all: ties, copies, repeated and null names, and scores not above 0."""
    import random

    rng = random.Random(3)
    words = [f"w{min(rng.randrange(30), rng.randrange(30))}" for _ in range(4000)]
    rows = [("s", f"c{i}", " ".join(words[9 * i % 3900 :][: rng.randrange(1, 40)])) for i in range(600)] + [("s", f"x{i}", "w0 w1 rare") for i in range(300)]
    more = [("s", "c7", "w0 rare"), ("s", "c7", "rare"), ("s", None, "rare w3"), ("s", None, "w1"), ("s", "n", None), *[("t", f"t{i}", "all of it" if i else "all") for i in range(8)]]
    asked = [(i, "s", " ".join(rng.choices(words, k=6))) for i in range(20)] + [(90, "s", "rare"), (91, "s", "w0 rare w0"), (92, "s", "none"), (93, "t", "all"), (94, "t", "of it"), (95, "u", "all"), (96, "s", "")]
    q = spark.createDataFrame(asked, "query_id int, chat_session_id string, question string")
    seen, best = [], lexical._best_matches
    monkeypatch.setattr(lexical, "_best_matches", lambda *a: seen.append(best(*a)) or seen[-1])
    monkeypatch.setattr(lexical, "CELLS", 500)
    for given, k in ((rows, 3), (rows + more, 3), (rows + more, 40)):
        c = spark.createDataFrame(given, "chat_session_id string, chunk_id string, text string").repartition(3)
        got = sorted((r.query_id, r["rank"], r.chunk_id or "", round(r.score, 8)) for r in lexical.bm25_search(c, q, k).collect())
        texts = {}
        for s, name, t in given:
            texts.setdefault(s, []).append((name, (t or "").split()))
        want = []
        for i, s, question in asked:
            here = texts.get(s, [])
            df = Counter(w for _, ws in here for w in set(ws))
            idf = {w: math.log(len(here) - n + 0.5) - math.log(n + 0.5) for w, n in df.items()}
            mean = sum(idf.values()) / len(idf) if idf else 0
            avgdl = sum(len(ws) for _, ws in here) / len(here) if here else 0
            score, names = {}, set()
            for at, (name, ws) in enumerate(here):
                for w in question.split():
                    if w in ws:
                        x = mean * 0.25 if idf[w] < 0 else idf[w]
                        score[name] = score.get(name, 0) + x * ws.count(w) * 2.5 / (ws.count(w) + 1.5 * (0.25 + 0.75 * len(ws) / avgdl))
            full = list(score.items()) + [(name, 0.0) for name, _ in here if name is None or name not in score] * (sum(x > 0 for x in score.values()) < k)
            first = sorted(full, key=lambda x: (-round(x[1], 9), x[0] is not None, x[0] or ""))[:k]
            want += [(i, r, name or "", round(x, 8)) for r, (name, x) in enumerate(first, 1)]
        assert got == sorted(want)
        if given is rows and k == 3:
            assert 0 < seen[-1].count() <= 3 * k * len(asked)


def test_evaluation_builds_no_index(spark, data, monkeypatch):
    """The few items are answered from the texts, with the rows of the SQL."""
    import duckdb

    from quarrydoc.plans import catalog

    c = duckdb.connect()
    for t in ("documents", "benchmark"):
        c.execute(f"create view {t} as select * from read_parquet('{data}/{t}.parquet')")
    monkeypatch.setattr(lexical, "build_index", None)
    for name in ("eval_recall_mrr", "eval_keyword"):
        got = [tuple(r) for r in catalog.QUERIES[name](spark, data).collect()]
        assert got == c.execute(catalog.ORACLES[name]).fetchall() and got


def test_extensions_travel_as_arrays(spark, monkeypatch):
    """Counts of extensions are a row per block and part, not one each, and blocks learn their numbers from the sums, without a join of counts; results are those of sending."""
    from quarrydoc.llm import phrases

    docs = spark.createDataFrame([(f"a b c d{i % 3} e, Ä {'b c ' * (i % 4)}x{i % 50} y{i % 7}\x0bz", "en" if i % 3 else "de") for i in range(400)], "text string, lang string")
    plain = lambda: sorted(map(tuple, phrases.collocations(docs, min_count=30, block_words=100).collect()))
    sent, summed, owns = plain(), phrases.summed, []
    monkeypatch.setattr(phrases, "PART_POSITIONS", 200)
    monkeypatch.setattr(phrases, "summed", lambda *a: owns.append(a[3]) or summed(*a))
    assert plain() == sent and sent and not any(owns)
    monkeypatch.setattr(phrases, "is_small", lambda *_: False)
    for many, want in ((10**9, [False, True] * 4), (0, [True] * 4)):
        monkeypatch.setattr(phrases, "MANY", many)
        owns.clear()
        assert plain() == sent and owns == want
    posts = phrases.table(phrases.word_lists(docs, 100), "posts")
    found = phrases.numbered(posts.select("lang", F.explode("words").alias("word"), F.lit(1).alias("n")), ["lang", "word"], 1, "found")
    blocks = phrases.table(phrases.first_lists(posts, found), "lists")
    rows = phrases.extensions(blocks, 5).collect()
    assert blocks.count() > 5 and len(rows) == len({(r.block, r.part) for r in rows}) <= 5 * blocks.count() < sum(len(r.n) for r in rows)
