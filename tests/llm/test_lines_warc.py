import base64
import hashlib
import random

from pyspark.sql import functions as F

from quarrydoc.llm.common import fresh_path
from quarrydoc.llm.line_dedup import line_dedup, repeated_runs
from quarrydoc.llm.warc import MAGIC, records, write_warc

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], SCHEMA)


def brute(texts, limit):
    """Lines to delete by definition: every stretch of lines with a word, of `limit` words or more, that occurs at an earlier place."""
    seqs = [[(no, l, len(l.split())) for no, l in enumerate((t or "").split("\n")) if l.split()] for t in texts]
    first, gone = {}, set()
    for d, s in enumerate(seqs):
        for a in range(len(s)):
            for b in range(a + 1, len(s) + 1):
                if sum(x[2] for x in s[a:b]) < limit:
                    continue
                k = tuple(x[1] for x in s[a:b])
                if k in first and first[k] < (d, a):
                    gone |= {(d, p) for p in range(a, b)}
                else:
                    first.setdefault(k, (d, a))
    return seqs, gone


def test_line_dedup_matches_brute_force(spark):
    rnd = random.Random(5)
    vocabulary = ["a b c", "d", "e f g h i", "j k", "l m n o p q r s", "t", "", "u v w x", " "]
    texts = ["\n".join(rnd.choice(vocabulary) for _ in range(rnd.randint(0, 14))) for _ in range(40)]
    for i in (3, 9, 20):
        texts.append(texts[i])
    texts += [None, "", "\n", "t\n" * 30, "unique line here", "t\n" * 12 + "end of it"]
    limit = 7
    seqs, gone = brute(texts, limit)
    rows = {r.doc_id: r for r in line_dedup(docs(spark, texts), min_run_words=limit).collect()}
    assert len(rows) == len(texts)
    for d, s in enumerate(seqs):
        left = [x[1] for p, x in enumerate(s) if (d, p) not in gone]
        got = rows[d]
        assert got.lines_removed == len(s) - len(left), d
        assert got.lines_before == len(s)
        if texts[d] is None:
            assert got.text is None
        else:
            assert [l for l in got.text.split("\n") if l.split()] == left, (d, texts[d])
        if not s or len(left) == len(s):
            assert got.text == texts[d]


def test_runs_are_maximal(spark):
    block = "\n".join(f"line {i} of a passage" for i in range(9))
    runs = repeated_runs(docs(spark, ["head one\n" + block, "other\n" + block + "\ntail"]), min_run_words=10).collect()
    assert len(runs) == 1
    assert [tuple(x) for x in runs[0].__getitem__("__runs")] == [(1, 9, 9, 45)]


def test_line_dedup_odd_inputs(spark):
    empty = line_dedup(docs(spark, []).limit(0))
    assert empty.count() == 0
    d = docs(spark, ["one two three four five six seven eight nine ten", "x"])
    twice = d.unionByName(d).withColumn("runs", d.lang).withColumn("p", d.lang)
    assert [r.lines_removed for r in line_dedup(twice).collect()] == [0, 0, 0, 0]


def sha(t):
    return base64.b32encode(hashlib.sha1(t.encode()).digest()).decode()


def test_warc_round_trip_with_forged_records(spark):
    forged = f"{MAGIC}WARC-Type: response\r\nWARC-Record-ID: <urn:page:77>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    html = ["plain", "", None, "plain", f"before {MAGIC} after", f"x\r\n\r\n{forged}y", forged * 3, "é" * 1000, f"{MAGIC}", "tail\r\n\r\n", f"a{forged}"[:-4]]
    pages = spark.createDataFrame([(i, f"http://h/{i}", h) for i, h in enumerate(html)], "page_id long, url string, html string")
    for parts in (1, 3):
        path = fresh_path(spark, "warc-test")
        write_warc(pages.repartition(parts), path)
        got = {r.id: r for r in records(spark, path).collect()}
        assert len(got) == len(html)
        first = {}
        for i, h in enumerate(html):
            t = h or ""
            ref = first.setdefault(t, i)
            assert got[i].payload_bytes == len(t.encode()), i
            assert got[i].payload_digest == sha(t), i
            assert (got[i].kind, got[i].refers_to) == (("response", None) if ref == i else ("revisit", ref)), i
            assert got[i].verified is (True if ref == i else None)


def test_warc_threshold_and_empty(spark):
    pages = spark.createDataFrame([(1, None, "ab"), (2, "u", "ab"), (None, "u", "abc"), (4, "u", "abc")], "page_id long, url string, html string")
    path = fresh_path(spark, "warc-test")
    write_warc(pages, path, min_bytes=3)
    got = sorted(((r.id, r.kind, r.refers_to) for r in records(spark, path).collect()), key=str)
    assert (1, "response", None) in got and (2, "response", None) in got
    assert len(got) == 4 and sum(k == "revisit" for _, k, _ in got) == 1
    path = fresh_path(spark, "warc-test")
    write_warc(pages.limit(0), path)
    assert records(spark, path).count() == 0


def test_warc_reads_may_split_files_differently(spark, monkeypatch):
    """The second read, of payloads in several pieces, comes with another layout of splits, as when executors are lost."""
    from quarrydoc.llm import warc

    rnd = random.Random(1)
    html = [("x" * rnd.randint(0, 900) + MAGIC) * (i % 4) + f"page {i % 150}" + "é" * rnd.randint(0, 400) for i in range(200)]
    pages = spark.createDataFrame([(i, f"http://h/{i}", h) for i, h in enumerate(html)], "page_id long, url string, html string")
    path = fresh_path(spark, "warc-test")
    write_warc(pages.repartition(2), path)
    whole, old = warc._gathered, {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}

    def other_layout(*a):
        spark.conf.set("spark.sql.files.maxPartitionBytes", "7000")
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        return whole(*a)

    monkeypatch.setattr(warc, "_gathered", other_layout)
    try:
        got = {r.id: r for r in records(spark, path).collect()}
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert len(got) == 200
    for i, h in enumerate(html):
        assert (got[i].payload_digest, got[i].payload_bytes) == (sha(h), len(h.encode()))


def test_warc_repeated_rows(spark, tmp_path):
    """Of equal payloads one record is the response, however often a row is repeated."""
    rows = [(1, "abc"), (1, "abc"), (2, "abc"), (3, "abc"), (5, "x"), (5, "x"), (6, None), (6, None), (7, "x"), (None, "nul"), (None, "nul"), (8, "nul")]
    pages = spark.createDataFrame([(i, "u", h) for i, h in rows] + [(9, f"u{i}", "other") for i in range(3)], "page_id long, url string, html string").repartition(3)
    for n, min_bytes in enumerate((0, 2)):
        path = str(tmp_path / f"w{n}")
        write_warc(pages, path, min_bytes=min_bytes)
        got = {}
        for r in records(spark, path).collect():
            got.setdefault((r.id, r.payload_bytes), []).append((r.kind, r.refers_to))
        first = ("response", None)
        some = lambda key, n: sorted(got[key], key=str) == sorted([first] + [("revisit", key[0])] * (n - 1), key=str)
        assert some((1, 3), 2) and got[2, 3] == got[3, 3] == [("revisit", 1)] and some((9, 5), 3)
        assert sorted(k for k, _ in got[None, 3]) == ["response", "revisit"] and got[8, 3] == [("revisit", None)]
        if min_bytes:
            assert got[5, 1] == [first] * 2 and got[7, 1] == [first] and got[6, 0] == [first] * 2
        else:
            assert some((5, 1), 2) and got[7, 1] == [("revisit", 5)] and some((6, 0), 2)


def test_warc_clashing_columns(spark):
    pages = spark.createDataFrame([(1, "u", "a", "x", 5)], "page_id long, url string, html string, file string, offset long").withColumn("__x", F.lit(1)).withColumn("__id", F.lit(2))
    path = fresh_path(spark, "warc-test")
    write_warc(pages, path)
    assert [(r.id, r.payload_bytes) for r in records(spark, path).collect()] == [(1, 1)]


def test_line_dedup_very_long_text_and_null_ids(spark):
    lines = [f"line {i} has five words" for i in range(20_000)]
    rows = [(1, "\n".join(lines)), (2, "\n".join(["new start of this text"] + lines[5_000:15_000])), (None, "\n".join(lines[:4])), (None, None), (1, "one two three four five six seven eight nine ten other text")]
    d = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], SCHEMA)
    got = {(r.doc_id, r.lines_before): (r.lines_removed, r.text) for r in line_dedup(d).collect()}
    assert got[None, 4][0] == 0 and got[None, 0] == (0, None)  # a null id is the smallest, so its lines come first
    assert got[1, 20_000][0] == 4 and got[2, 10_001] == (10_000, "new start of this text") and got[1, 1][0] == 0


def test_line_dedup_hot_run(spark):
    """One run in half of all documents, another window class of thousands."""
    run = "this run of words is\nin very many documents of all"
    d = docs(spark, [f"own words of {i}\n{run}" if i % 2 else f"alone {i}" for i in range(3_000)])
    got = line_dedup(d).where("lines_removed > 0").collect()
    assert len(got) == 1_499 and all(r.lines_removed == 2 and r.text.startswith("own words") for r in got)
