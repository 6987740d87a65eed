import math
import random
import zlib

import corpus_pipeline
from pyspark.sql import functions as F
from quarrydoc.llm import queries
from quarrydoc.llm.kd_sharding import kd_shards
from quarrydoc.llm.mixing import exponent, mix, token_totals

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def corpus(n=400):
    rnd = random.Random(11)
    rows = []
    for i in range(n):
        t = " ".join(rnd.choice(["alpha", "beta", "gamma", "delta", "été"]) + str(rnd.randint(0, 99)) for _ in range(rnd.randint(1, 200)))
        rows.append((i * 3, t, rnd.choice(["en", "de", None]), rnd.choice(["hot"] * 5 + [f"s{k}" for k in range(6)] + [None]), len(t)))
    return rows


def test_shards_are_near_equal_and_slots_gapless(spark):
    rows = corpus() + [(5000 + i, "same text in many rows", "en", "hot", 22) for i in range(60)] + [(None, None, None, None, None), (3, "twice", None, "x", 5), (3, "twice", None, "x", 5)]
    df = frame(spark, rows).withColumn("shard", F.lit("clash")).withColumn("x0", F.lit(1))
    for shards in (8, 5, 1):
        got = kd_shards(df, shards).collect()
        assert len(got) == len(rows)
        sizes, slots, by_text = [0] * shards, [[] for _ in range(shards)], {}
        for r in got:
            sizes[r.shard] += r["size"]
            slots[r.shard].append(r.slot)
            by_text.setdefault((r.text_crc32, r["size"]), set()).add(r.shard)
        assert all(sorted(s) == list(range(len(s))) for s in slots)
        assert max(sizes) <= 1.15 * min(sizes)
        assert sum(sizes) == sum(len((r[1] or "").encode()) + 1 for r in rows)
        crc = zlib.crc32(b"same text in many rows")
        assert len(by_text[crc, 23]) <= max(1, shards)
    assert kd_shards(frame(spark, []), 4).count() == 0


def test_equal_texts_stay_together_unless_larger_than_a_shard(spark):
    rnd = random.Random(6)
    rows = [(i, " ".join(str(rnd.random()) for _ in range(rnd.randint(5, 40))), "en", f"s{i % 5}", 0) for i in range(3_000)]
    big = "copy " * 800  # 24 copies are about 5 % of all bytes, less than a shard of 8
    rows += [(10_000 + i, big, "de", "s1", 0) for i in range(24)] + [(20_000 + i, "pair " * 2_000, "de", "s2", 0) for i in range(2)]
    got = kd_shards(frame(spark, rows), 8).collect()
    sizes, by_text = [0] * 8, {}
    for r in got:
        sizes[r.shard] += r["size"]
        by_text.setdefault((r.text_crc32, r["size"]), set()).add(r.shard)
    assert all(len(s) == 1 for s in by_text.values())
    assert max(sizes) <= 1.05 * min(sizes)
    rows += [(30_000 + i, big, "fr", "s3", 0) for i in range(300)]  # now larger than a shard
    sizes = [0] * 8
    for r in kd_shards(frame(spark, rows), 8).collect():
        sizes[r.shard] += r["size"]
    assert max(sizes) <= 1.15 * min(sizes)


def test_tree_against_brute_force(spark):
    """Weighted medians along the widest dimension, recursively, on distinct coordinates."""
    from quarrydoc.llm.kd_sharding import kd_leaves

    rnd = random.Random(9)
    pts = [(i, rnd.random() * 50, rnd.random() * 80, rnd.randint(1, 9)) for i in range(500)]
    lo, hi = [min(p[k] for p in pts) for k in (1, 2)], [max(p[k] for p in pts) for k in (1, 2)]

    def cut(part, n):
        if n == 1:
            return [part]
        wide = max((0, 1), key=lambda k: (max(p[k + 1] for p in part) - min(p[k + 1] for p in part)) / (hi[k] - lo[k]))
        part = sorted(part, key=lambda p: p[wide + 1])
        total, goal, run, at = sum(p[3] for p in part), sum(p[3] for p in part) * (n // 2) / n, 0, 0
        while run < goal:
            run, at = run + part[at][3], at + 1
        if abs(run - goal) > abs(run - part[at - 1][3] - goal):
            at -= 1
        return cut(part[:at], n // 2) + cut(part[at:], n - n // 2)

    df = spark.createDataFrame([(i, x, y, w, i, 0) for i, x, y, w in pts], "id int, x double, y double, w long, h long, end int")
    for leaves in (2, 8, 5, 30):
        want = {p[0]: k for k, part in enumerate(cut(pts, leaves)) for p in part}
        got = {r.id: r.leaf for r in kd_leaves(df, ["x", "y"], leaves, tolerance=0.0).collect()}
        assert got == want


def test_target_bytes_decide_the_number_of_shards(spark):
    rows = corpus()
    total = sum(len((r[1] or "").encode()) + 1 for r in rows)
    got = kd_shards(frame(spark, rows), target_bytes=total // 11).collect()
    assert {r.shard for r in got} == set(range(12))


def test_blocks_hold_the_target_mix(spark):
    """Brute force over the readings: every block has each source's share of tokens, up to a document or two."""
    rows = corpus(3_000)
    got = mix(frame(spark, rows), max_repeats=2.0, blocks=8).collect()
    sources = {r["__s"] for r in got}
    whole = {s: sum(r.tokens for r in got if r["__s"] == s) for s in sources}
    for b in range(8):
        for s in sources:
            part = sum(r.tokens for r in got if r.block == b and r["__s"] == s)
            assert abs(part - whole[s] / 8) <= 2 * 200 + 0.02 * whole[s], (b, s)


def test_exponent_meets_the_target(spark):
    df = spark.createDataFrame([("a", 10_000), ("b", 1_000), ("c", 100), (None, 50)], "source string, n long")
    t = token_totals(df, "source", "n")
    total = 11_150
    share = [x / total for x in (10_000, 1_000, 100, 50)]

    def entropy(a):
        z = sum(s**a for s in share)
        return -sum(s**a / z * math.log(s**a / z) for s in share)

    a = exponent(t, entropy=1.0)
    assert abs(entropy(a) - 1.0) < 1e-3
    a = exponent(t, max_repeats=3.0)
    repeats = [s ** (a - 1) for s in share]
    assert abs(max(repeats) / min(repeats) - 3.0) < 1e-3
    assert exponent(t, max_repeats=1e9) == 0.0


def test_mix_reads_every_document_and_meets_weights(spark):
    rows = corpus(600) + [(7, "again and again", None, "s1", 15)] * 2 + [(9_999, None, "en", "s2", None)]
    df = frame(spark, rows).withColumn("copy", F.lit("clash")).withColumn("tokens", F.lit("clash"))
    got = mix(df, max_repeats=2.0, blocks=8).collect()
    base = [r for r in got if r.copy == 0]
    assert sorted(r.doc_id for r in base) == sorted(r[0] for r in rows)
    tokens, own = {}, {}
    for r in got:
        tokens[r["__s"]] = tokens.get(r["__s"], 0) + r.tokens
        own[r["__s"]] = own.get(r["__s"], 0) + (r.tokens if r.copy == 0 else 0)
        assert 0 <= r.block < 8
    biggest = max(own, key=own.get)
    assert tokens[biggest] == own[biggest]
    assert max(tokens[s] / own[s] for s in own) <= 2.2
    # within a source the stream has neither gap nor overlap
    for s in own:
        at = sorted((r.stream_start, r.tokens) for r in got if r["__s"] == s)
        end = 0
        for a, n in at:
            assert a == end
            end = a + n
    assert mix(frame(spark, [])).count() == 0
    assert [r.block for r in mix(df, max_repeats=2.0, blocks=8).collect()].count(0) > 0


def test_pipeline_stages(spark, data):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    rnd = random.Random(4)
    clean = [" ".join("".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 8))) for _ in range(rnd.randint(60, 90))) for _ in range(60)]
    passage = " ".join(f"word{i}" for i in range(60))
    texts = clean + [clean[0], clean[1]] + [c + "\n" + passage for c in clean[5:8]]
    edited = clean[9].split()
    edited[30] = "changed"
    texts += [" ".join(edited), "too short", " ".join(w + "###" for w in clean[12].split())]
    df = frame(spark, [(i, t, "en", f"s{i % 3}", len(t)) for i, t in enumerate(texts)]).withColumn("doc", F.lit(1)).withColumn("__row", F.lit(1)).drop("doc", "__row")
    out = corpus_pipeline.quality(spark, df, data)
    assert out.columns == df.columns
    assert {r.doc_id for r in out.collect()} == set(range(66))
    out = corpus_pipeline.lines(spark, out, data)
    kept = {r.doc_id: r.text for r in out.collect()}
    assert out.columns == df.columns and 60 not in kept and 61 not in kept
    assert passage in kept[62] and all(passage not in kept.get(i, "") for i in (63, 64))
    out = corpus_pipeline.near_copies(spark, out, data)
    left = {r.doc_id for r in out.collect()}
    assert 65 not in left and 9 in left and set(range(60)) <= left
    mixed = corpus_pipeline.mixing(spark, out, data)
    assert {r.doc_id for r in mixed.collect()} == left and mixed.columns == df.columns
    packed = corpus_pipeline.packing(spark, mixed, data)
    assert {r.doc_id for r in packed.select("doc_id").collect()} == left
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, frame(spark, []), data).count() == 0, name


def test_run_equals_its_stages_one_by_one(spark, tmp_path):
    """run() over a small documents table with nulls, repeated rows and equal ids, against the stages applied by hand."""
    rnd = random.Random(7)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 8)))
    rows = [(i, " ".join(word() for _ in range(rnd.randint(30, 80))), rnd.choice(["en", None]), rnd.choice(["s0", "s1", None]), 5) for i in range(80)]
    rows += [rows[3], rows[3], (None, rows[4][1], None, None, None), (None, None, None, None, None), (7, "another text with the id seven that has enough words to be kept by the rules", "en", "s0", 1), (500, "", "en", "s0", 0)]
    df = frame(spark, rows)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    docs_, counts = df, []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs_, str(tmp_path))
        if name != "best_fit_packing":
            assert out.columns == df.columns
        docs_ = spark.createDataFrame(out.collect(), out.schema)
        counts.append(docs_.count())
    want = sorted((r.doc_id if r.doc_id is not None else -1, r.piece, r.start, r.length, r.ids_crc32) for r in docs_.collect())
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.piece, r.start, r.length, r.ids_crc32) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    assert got == want and len(got) > 80
    assert {r[0] for r in got} >= set(range(80)) - {4}  # the null id is the smallest, so its copy of 4 comes first


def test_mixing_keeps_the_columns_of_each_row(spark, data):
    """Rows with one id and text but other columns are rows of their own."""
    rows = [(1, "same text here", "en", "a", 1), (1, "same text here", "de", "b", 2), (1, "same text here", "en", "a", 1), (None, "x", None, None, None), (2, None, "en", "a", None)]
    got = corpus_pipeline.mixing(spark, frame(spark, rows), data).distinct().collect()
    assert sorted(map(str, {tuple(r) for r in got})) == sorted(map(str, set(rows)))


def test_registered_queries():
    q = queries.queries()
    assert [next(n for n in q if n.startswith(f"op{i}_")) for i in range(1, 11)]
    assert set(queries.oracle_sql()) <= set(q)
