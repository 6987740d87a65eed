"""Snapshot stores and the segmented index: one publish, deletion at rest, compaction, refresh, block bounds."""

import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from quarrydoc.operators import lexical
from quarrydoc.providers import provider
from quarrydoc.scratch import hadoop
from quarrydoc.sources import snapshots, stores
from quarrydoc.streaming.sessions import refresh_lexical

CHUNK = "chunk_id string, filename string, page int, text string, element_type string, section_title string, chat_session_id string"
DOCUMENT = "chat_session_id string, filename string, display_title string, content_type string, data binary, at timestamp"


def document(spark, session, name, texts, day=1):
    d = spark.createDataFrame([(session, name, None, "application/pdf", b"12345", datetime(2024, 1, day))], DOCUMENT)
    c = spark.createDataFrame([(f"{name}-{i}", name, i, t, "text", None, session) for i, t in enumerate(texts)], CHUNK)
    return d, c


def folders(spark, store, table):
    path, fs = hadoop(spark, f"{store}/{table}")
    return sorted(s.getPath().getName() for s in fs.listStatus(path)) if fs.exists(path) else []


def found(spark, index, session, question, k=3):
    q = spark.createDataFrame([(1, session, question)], "query_id int, chat_session_id string, question string")
    return [(r.chunk_id, round(r.score, 9)) for r in lexical.search_index(spark, index, q, k).orderBy("rank").collect()]


def test_publish_is_seen_whole_or_not_at_all(spark, tmp_path, monkeypatch):
    store = str(tmp_path / "store")
    assert stores.add_document(*document(spark, "a", "f", ["cat dog", "cat"]), store, provider("embedder")) == 2
    assert snapshots.current(spark, store).version == 1
    before = {t: stores.rows_of(spark, store, t).count() for t in ("chunks", "documents", "activity")}
    assert before == {"chunks": 2, "documents": 1, "activity": 1} and lexical.in_force(spark, store).head().n == 2

    def stop(*_):
        raise RuntimeError("the job was stopped")

    monkeypatch.setattr(snapshots, "_put", stop)  # everything is written, the manifest is not
    with pytest.raises(RuntimeError):
        stores.add_document(*document(spark, "a", "g", ["bird"]), store, provider("embedder"))
    monkeypatch.undo()
    assert {t: stores.rows_of(spark, store, t).count() for t in before} == before and found(spark, store, "a", "bird") == [("f-0", 0.0), ("f-1", 0.0)]
    assert len(folders(spark, store, "chunks")) == 2
    assert snapshots.vacuum(spark, store, orphans_after=0) > 0 and len(folders(spark, store, "chunks")) == 1
    stores.add_document(*document(spark, "a", "g", ["bird"]), store, provider("embedder"))
    assert [x[0] for x in found(spark, store, "a", "bird", 1)] == ["g-0"] and stores.metadata(spark, store).count() == 2


def test_writers_that_meet(spark, tmp_path):
    """A writer that finds its version taken publishes upon the newer one; what it derived is made anew; a step known by its number counts once."""
    store, tries = str(tmp_path / "store"), []
    row = lambda x: spark.createDataFrame([(x,)], "session string")

    def derive(base, new):
        if not tries:
            snapshots.publish(spark, store, {"t": row("other")})
        tries.append(base.version)
        return {"seen": row(f"{snapshots.scan(spark, store, 't', 'session string', new).count()} rows")}

    s = snapshots.publish(spark, store, {"t": row("own")}, derive)
    assert tries == [0, 1] and s.version == 2
    read = lambda t: sorted(r.session for r in snapshots.scan(spark, store, t, "session string").collect())
    assert read("t") == ["other", "own"] and read("seen") == ["2 rows"] and len(folders(spark, store, "seen")) == 1
    for _ in range(2):
        snapshots.publish(spark, store, {"t": row("step")}, once=("series", 7))
    assert read("t") == ["other", "own", "step"]
    old = snapshots.at(spark, store, 1)
    assert snapshots.scan(spark, store, "t", "session string", old).count() == 1
    with pytest.raises(ValueError):
        snapshots.compact(spark, store, {"t": lambda s: row("x")})
    assert snapshots.scan(spark, store, "none", "session string").count() == 0


def test_deleted_sessions_leave_store_index_and_files(spark, tmp_path):
    store = str(tmp_path / "store")
    who = [("a", True, None, datetime(2024, 1, 1)), ("b", True, None, datetime(2024, 1, 1)), ("c", False, "u", datetime(2024, 1, 1))]
    stores.add_sessions(spark.createDataFrame(who, "chat_session_id string, is_guest boolean, user_id string, created_at timestamp"), store)
    for s, day in (("a", 1), ("b", 9), ("c", 1)):
        stores.add_document(*document(spark, s, f"{s}.pdf", ["cat dog", "cat"], day), store, provider("embedder"))
    stores.add_messages(spark.createDataFrame([("a", datetime(2024, 1, 1), "user", "hi", "[]"), ("c", datetime(2024, 1, 2), "user", "ho", "[]")], stores.TABLES["messages"]), store)
    assert stores.expire_guests(spark, store, F.lit(datetime(2024, 1, 9, 12))) == 1
    assert stores.expire_guests(spark, store, F.lit(datetime(2024, 1, 9, 12))) == 0
    state = lambda: {t: sorted({r.chat_session_id for r in stores.rows_of(spark, store, t).collect()}) for t in stores.TABLES}
    want = {"chunks": ["b", "c"], "documents": ["b", "c"], "activity": ["b", "c"], "messages": ["c"], "sessions": ["b", "c"]}
    assert state() == want and found(spark, store, "a", "cat") == [] and len(found(spark, store, "b", "cat")) == 2
    assert sorted(r.session for r in lexical.in_force(spark, store).collect()) == ["b", "c"]
    was = found(spark, store, "c", "dog cat")
    stores.compact_store(spark, store)
    assert state() == want and found(spark, store, "a", "cat") == [] and found(spark, store, "c", "dog cat") == was
    for t in [*stores.TABLES, *lexical.TABLES]:
        assert len(folders(spark, store, t)) == 1
    assert folders(spark, store, "gone") == [] and len(folders(spark, store, "manifests")) == 1
    assert spark.read.parquet(f"{store}/chunks").where("chat_session_id = 'a'").count() == 0
    stores.add_document(*document(spark, "a", "new.pdf", ["dog"]), store, provider("embedder"))  # the id again, afterwards
    assert found(spark, store, "a", "dog cat") == found(spark, store, "a", "dog") and state()["chunks"] == ["a", "b", "c"]


def corpus(spark, rng, sessions, n):
    words = [f"w{int(rng.paretovariate(0.7))}" for _ in range(4000)]
    rows = [(f"s{i % sessions}", f"c{i:05d}", " ".join(rng.choices(words, k=rng.randint(0, 40)))) for i in range(n)]
    return rows + [("s0", "none", None), ("s0", "empty", "")]


def test_refresh_makes_segments(spark, tmp_path, monkeypatch):
    """Batches become segments, only new chunks are split into tokens, folders stay bounded, answers are those of an index made at once."""
    rng = random.Random(3)
    rows = corpus(spark, rng, 3, 240)
    src, index, whole = (str(tmp_path / x) for x in ("chunks", "index", "whole"))
    schema = "chat_session_id string, chunk_id string, text string"
    split = []
    segment = lexical.segment
    monkeypatch.setattr(lexical, "segment", lambda chunks, *a: (split.append(chunks.count()), segment(chunks, *a))[1])
    for i in range(6):
        spark.createDataFrame(rows[i::6], schema).coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(schema).parquet(src)
        refresh_lexical(stream, str(tmp_path / "checkpoint"), index, most_segments=2).awaitTermination()
        assert lexical.segments(spark, index) <= 2 and len(folders(spark, index, "postings")) <= 3 and len(folders(spark, index, "manifests")) <= 3
    assert sum(split) == len(rows)
    monkeypatch.undo()
    lexical.add_to_index(spark.createDataFrame(rows[:5], schema), index, once=(str(tmp_path / "checkpoint"), 0))  # a batch sent again
    lexical.build_index(spark.createDataFrame(rows, schema), whole)
    questions = [(i, f"s{i % 3}", " ".join(rng.choices(["w1", "w2", "w3", "w9", "w31", "zz"], k=3))) for i in range(12)]
    q = spark.createDataFrame(questions, "query_id int, chat_session_id string, question string")
    ask = lambda p: sorted((r.query_id, r.rank, r.chunk_id, round(r.score, 8)) for r in lexical.search_index(spark, p, q, 7).collect())
    assert ask(index) == ask(whole) and len(ask(whole)) == 84
    stats = lambda p: sorted((r.session, r.n, round(r.avgdl, 9)) for r in lexical.in_force(spark, p).collect())
    assert stats(index) == stats(whole)


def brute(rows, session, question, k):
    """BM25 from the texts."""
    from collections import Counter
    from math import log

    docs = {c: Counter((t or "").lower().split()) for s, c, t in rows if s == session}
    n, avgdl = len(docs), sum(sum(d.values()) for d in docs.values()) / len(docs)
    df = Counter(w for d in docs.values() for w in d)
    idf0 = {w: log(n - x + 0.5) - log(x + 0.5) for w, x in df.items()}
    mean = sum(idf0.values()) / len(idf0)
    idf = {w: 0.25 * mean if x < 0 else x for w, x in idf0.items()}
    score = {c: sum(idf[w] * d[w] * 2.5 / (d[w] + 1.5 * (0.25 + 0.75 * sum(d.values()) / avgdl)) for w in question.split() if w in d) for c, d in docs.items()}
    best = sorted(score, key=lambda c: (-round(score[c], 9), c))[:k]
    return [(c, round(score[c], 6)) for c in best]


def test_blocks_that_cannot_matter_are_skipped(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(lexical, "SLICE", 8)
    rng = random.Random(4)
    rows, index = corpus(spark, rng, 2, 3000), str(tmp_path / "index")
    schema = "chat_session_id string, chunk_id string, text string"
    for part in (rows[:1500], rows[1500:]):
        lexical.add_to_index(spark.createDataFrame(part, schema), index)
    often = {s: [w for w in {w for x, _, t in rows if x == s for w in (t or "").split()} if 15 <= sum(w in (t or "").split() for x, _, t in rows if x == s) <= 60] for s in ("s0", "s1")}
    questions = [(1, "s0", f"w1 w2 {min(often['s0'])}"), (2, "s1", f"w1 w1 {max(often['s1'])} w3"), (3, "s1", min(often["s1"])), (4, "s0", "w1 w2 w3 w4 w5"), (5, "s1", "nothing")]
    q = spark.createDataFrame(questions, "query_id int, chat_session_id string, question string")
    got = {}
    for r in lexical.search_index(spark, index, q, 3).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.chunk_id, round(r.score, 6)))
    for i, session, question in questions:
        assert got[i] == brute(rows, session, question, 3), question
    read = {r.query_id: (r.postings, r.read) for r in lexical.postings_read(spark, index, q, 3).collect()}
    texts = {i: sum(len(set((t or "").split()) & set(x.split())) for s, _, t in rows if s == session) for i, session, x in questions}
    assert {i: n for i, (n, _) in read.items()} == {i: n for i, n in texts.items() if n}
    assert all(read[i][1] < 0.5 * read[i][0] for i in (1, 2, 3)) and read[4][1] <= read[4][0], read
