import random

import numpy as np

from quarrydoc.llm.components import components
from quarrydoc.llm.ngram_join import CountTree, jaccard_join

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def shingles(t, width):
    ws = "".join(c.lower() if "A" <= c <= "Z" else c for c in (t or "")).split()
    return {tuple(ws[i : i + width]) for i in range(max(1, len(ws) - width + 1))} if ws else set()


def brute(rows, width, percent):
    sets = {i: shingles(t, width) for i, t in rows}
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            i = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * i >= percent * (len(sets[a]) + len(sets[b]) - i):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def corpus(seed=3):
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    phrase = [rnd.choice(vocabulary) for _ in range(30)]
    rows = []
    for _ in range(40):
        ws = [rnd.choice(vocabulary) for _ in range(rnd.randint(3, 120))]
        if rnd.random() < 0.5:
            ws[5:5] = phrase
        rows.append(ws)
        for _ in range(rnd.choice([0, 0, 1, 3, 9])):
            v = list(ws)
            for _ in range(rnd.randint(0, 6)):
                v[rnd.randrange(len(v))] = rnd.choice(vocabulary)
            rows.append(v)
    # a chain: each linked to the next only
    chain = [rnd.choice(vocabulary) for _ in range(100)]
    for i in range(12):
        chain = list(chain)
        chain[8 * i % 100] = f"x{i}"
        rows.append(chain)
    texts = [" ".join(r) for r in rows]
    rnd.shuffle(texts)
    return [*texts, "", None, " \n\t", "One", "one", "two words", "TWO  words", "a b c", "é è"]


def test_components_match_brute_force(spark):
    rows = list(enumerate(corpus()))
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], SCHEMA).withColumnRenamed("lang", "doc").withColumnRenamed("source", "comp")
    for width, percent in ((4, 85), (5, 80)):
        want = brute(rows, width, percent)
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join(df, width=width, percent=percent, tasks=3).collect()}
        assert got == want


def test_empty_and_null_ids(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert jaccard_join(df).count() == 0
    df = spark.createDataFrame([(None, "a b c d e f g", None, None, 0), (4, "a b c d e f g", None, None, 0), (4, "a b c d e f g", None, None, 0)], SCHEMA)
    got = {r.doc_id: r.component_id for r in jaccard_join(df).collect()}
    assert set(got) == {None, 4} and len(set(got.values())) == 1


def test_tree_prunes_nothing_within_the_bound():
    rnd = np.random.default_rng(1)
    base = rnd.poisson(2.0, (20, 128))
    vec = np.concatenate([np.maximum(base + rnd.integers(-1, 2, base.shape) * (rnd.random(base.shape) < 0.1), 0) for _ in range(20)]).astype(np.int32)
    n = vec.sum(1).astype(np.int64)
    comp = rnd.integers(0, 30, len(n))
    tree = CountTree(n, vec, comp, 85)
    over = np.minimum(vec[:, None], vec[None]).sum(2)
    want = {(i, j) for i in range(len(n)) for j in range(i) if 100 * over[i, j] >= 85 * (n[i] + n[j] - over[i, j])}
    for across in (False, True):
        got = set()
        for i, j, _ in tree.pairs(across):
            got |= {(max(a, b), min(a, b)) for a, b in zip(tree.order[i].tolist(), tree.order[j].tolist())}
        assert got == ({(i, j) for i, j in want if comp[i] != comp[j]} if across else want)


def test_components_of_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(1, 60)] + [(100, 90), (90, 95)], "a long, b long")
    got = {r.node: r.comp for r in components(links).collect()}
    assert got == {**{i: 1 for i in range(1, 61)}, 100: 90, 90: 90, 95: 90}


def test_large_cells_in_units_match_brute_force(spark, monkeypatch):
    """With units of four points most shared cells are large, of one component or of several."""
    from quarrydoc.llm import ngram_join

    monkeypatch.setattr(ngram_join, "UNIT", 4)
    rnd = random.Random(8)
    passage = [f"p{i}" for i in range(60)]
    rows = []
    for g in range(12):
        ws = passage + [f"g{g}w{i}" for i in range(rnd.randint(10, 60))]
        for _ in range(rnd.choice([1, 2, 7])):
            v = list(ws)
            for _ in range(rnd.randint(0, 3)):
                v[rnd.randrange(len(v))] = f"x{rnd.random()}"
            rows.append(" ".join(v))
    rnd.shuffle(rows)
    rows = list(enumerate(rows))
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], SCHEMA)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join(df, tasks=3).collect()}
    assert got == brute(rows, 5, 80)


def test_hot_hashes_come_last_and_lose_no_link(spark, monkeypatch):
    """Passages that most documents hold are hot, so prefixes are built anew; documents that hold little else still link."""
    from quarrydoc.llm import ngram_join

    monkeypatch.setattr(ngram_join, "UNIT", 3)
    monkeypatch.setattr(ngram_join, "HOT_SHARE", 0.1)
    monkeypatch.setattr(ngram_join, "CHUNK", 2_000)
    rnd = random.Random(5)
    passages = [[f"p{k}w{i}" for i in range(40)] for k in range(3)]
    rows = []
    for g in range(50):
        own = [f"g{g}w{i}" for i in range(rnd.choice([0, 2, 5, 30, 80]))]
        ws = [w for p in passages[: rnd.randint(0, 3)] for w in p] + own
        for _ in range(rnd.choice([1, 1, 3])):
            v = list(ws)
            for _ in range(rnd.randint(0, 2)):
                if v:
                    v[rnd.randrange(len(v))] = f"x{rnd.random()}"
            rows.append(" ".join(v))
    rows = list(enumerate(rows))
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], SCHEMA)
    seen = []
    plain = ngram_join.hot_hashes
    monkeypatch.setattr(ngram_join, "hot_hashes", lambda *a: seen.append(plain(*a)) or seen[-1])
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join(df, tasks=3).collect()}
    assert len(seen[0]) >= 70  # those of two passages at least
    assert got == brute(rows, 5, 80)


def test_very_long_text(spark):
    long = " ".join(f"w{i % 70_000}" for i in range(200_000))
    df = spark.createDataFrame([(2, long, "en", "s", 0), (1, long + " one more", "en", "s", 0), (3, "w1 w2 w3 w4 w5 w6", "en", "s", 0)], SCHEMA)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join(df).collect()}
    assert got == {1: (70_002, 1), 2: (70_000, 1), 3: (2, 3)}
