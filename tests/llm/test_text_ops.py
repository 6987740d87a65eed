import hashlib
import json
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest

from quarrydoc.llm import pii
from quarrydoc.llm.fingerprints import as_string, containment, distinct_count, edited_text, fingerprint_pairs, merge, resemblance, sketch, with_next
from quarrydoc.llm.packing import pack, pieces, plan, sum_of_squares
from quarrydoc.llm.quality_rules import filter_documents, quality_rules, statistics
from quarrydoc.llm.token_counts import attribute, token_counts
from quarrydoc.llm.tokenizing import WordTokenizer
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORD_FILE = public_tokenizers.path("word_bpe_49k.json")


def docs(spark, texts, lang="en", source="s"):
    return spark.createDataFrame([(i, t, lang, source, len(t or "")) for i, t in enumerate(texts)], SCHEMA)


def odd_texts():
    rnd = random.Random(2)
    ws = ["the", "And", "naïve", "Straße", "été", "x1y22", "don't", "it's", "...", "a.b", "😀", "日本", "#$%", "Über", "no", "12.5"]
    return [" ".join(rnd.choice(ws) for _ in range(rnd.randint(0, 60))) for _ in range(30)] + ["", None, " ", "a\x1cb", "<|endoftext|>", "é", "İ Σ", "x" * 3000, "\x01", "tab\tvt\x0bff\x0c", "a\x85b", "'s't", "<|startoftext|> a"]


def test_word_tokenizer_equals_file():
    w = WordTokenizer(WORD_FILE)
    for t in odd_texts():
        t = t or ""
        assert w.encode(t) == np.array(w.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes(), repr(t)
    vocabulary = json.load(open(WORD_FILE, encoding="utf-8"))["model"]["vocab"]
    for t, i in vocabulary.items():  # the condition under which both ways of merging agree
        if t.endswith("</w>"):
            assert [x.id for x in w.tokenizer.model.tokenize(t[:-4])] == [i]


def test_word_tokenizer_equals_file_for_every_latin_letter():
    w = WordTokenizer(WORD_FILE)
    for c in map(chr, range(0xC0, 0x250)):
        for t in (c, f"{c}LI GELDI", f"ab{c}cd", f"AB{c}"):
            assert w.encode(t) == np.array(w.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes(), repr(t)


def test_packing_round_trip(spark):
    rnd = random.Random(3)
    texts = odd_texts() + [" ".join("word" for _ in range(rnd.randint(1, 5000))) for _ in range(30)]
    df = docs(spark, texts)
    df = df.unionByName(df.limit(3)).withColumn("piece", F.lit("clash"))
    found = pieces(df, WORD_FILE)
    for grain in (64, 1):  # pieces of a length one by one, and all at once
        rows = pack(found, grain=grain).collect()
        assert len(rows) == found.count()
        by_seq, by_doc = {}, {}
        for r in rows:
            by_seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
            by_doc.setdefault(r.doc_id, []).append(r)
        for places in by_seq.values():
            end = 0
            for off, n in sorted(places):
                assert off == end
                end += n
            assert end <= 2048
        w = WordTokenizer(WORD_FILE)
        for i, t in enumerate(texts):
            ids = np.append(np.frombuffer(w.encode(t or ""), "<u4"), np.uint32(0))
            for r in by_doc[i]:
                part = ids[r.start : r.start + r.length]
                assert r.ids_crc32 == zlib.crc32(part.tobytes()) and r.start == 2048 * r.piece
            assert {r.piece for r in by_doc[i]} == set(range(-(-len(ids) // 2048)))
        total = sum(r.length for r in rows)
        assert len(by_seq) <= total / 2048 * 1.02 + 2


def test_sum_of_squares_follows_the_rule():
    rnd = random.Random(1)
    sizes = [rnd.randint(1, 20) for _ in range(300)]
    seq, off, fill = sum_of_squares(sizes, 20)
    gaps = {}
    for i, s in enumerate(sizes):
        def cost(g):
            n = {}
            for v in gaps.values():
                if v:
                    n[v] = n.get(v, 0) + 1
            if g < 20:
                n[g] -= 1
            if g > s:
                n[g - s] = n.get(g - s, 0) + 1
            return sum(x * x for x in n.values())

        choices = {g: cost(g) for g in {v for v in gaps.values() if v >= s} | {20}}
        took = gaps.get(seq[i], 20)
        assert choices[took] == min(choices.values())
        gaps[seq[i]] = took - s
    assert max(fill) <= 20
    empty = sum_of_squares([], 20)
    assert len(empty[0]) == 0


def test_plan_places_every_piece_once_and_follows_the_rule():
    rnd = random.Random(2)
    counts = {s: rnd.randint(1, 60) for s in rnd.sample(range(1, 129), 70)}
    steps = plan(counts, 128)  # no length has more pieces than the grain, so each goes alone or as the rule would place it in turn
    sizes = [s for s in sorted(counts, reverse=True) for _ in range(counts[s])]
    fill = sum_of_squares(sizes, 128)[2]
    used, places = {}, {}
    for s, first, k, seq, off in steps:
        assert first == places.get(s, 0)
        places[s] = first + k
        for i in range(seq, seq + k):
            assert used.get(i, 0) == off
            used[i] = off + s
    assert places == counts and max(used.values()) <= 128
    assert abs(len(used) - len(fill)) <= 2


def test_plan_does_not_grow_with_the_corpus(spark):
    counts = {s: 1 + 5000 // s for s in range(1, 2049, 7)}
    small, large = plan(counts, 2048), plan({s: n * 10**9 for s, n in counts.items()}, 2048)
    assert len(large) <= 64 * 6 * len(counts) and len(small) <= len(large)
    total = sum(s * n for s, n in counts.items()) * 10**9
    assert max(x[3] + x[2] for x in large) <= 1.01 * total / 2048
    assert plan({1100: 1200}, 2048) == [(1100, 0, 1200, 0, 0)]  # none fits beside another: one step, one sequence each
    found = spark.range(1200).selectExpr("id as doc_id", "0 as piece", "0L as start", "1100L as length", "id as ids_crc32")
    assert pack(found).select("sequence_id").distinct().count() == 1200


def test_one_order_is_the_rule_piece_by_piece():
    rnd = random.Random(4)
    counts = {s: rnd.randint(1, 40) for s in rnd.sample(range(1, 257), 90)}
    seq, off, fill = sum_of_squares([s for s in sorted(counts, reverse=True) for _ in range(counts[s])], 256)
    steps = plan(counts, 256, orders=[(1, 0.0)])
    assert max(x[3] + x[2] for x in steps) == len(fill)
    assert [s for x in steps for s in [x[4]] * x[2]] == off.tolist()


@pytest.mark.parametrize("times", [1, 100, 10**7])
def test_plan_stays_near_the_lower_bound(times):
    """Prose-like lengths: within a fifth of a percent of the lower bound at any size."""
    rnd = random.Random(5)
    counts = {}
    for _ in range(9000):
        s = 2048 if rnd.random() < 0.15 else min(2048, max(1, int(rnd.lognormvariate(5.6, 1.1))))
        counts[s] = counts.get(s, 0) + times
    bound = -(-sum(s * n for s, n in counts.items()) // 2048)
    steps = plan(counts, 2048)
    placed, used = {}, max(x[3] + x[2] for x in steps)
    for s, first, k, _, _ in steps:
        assert first == placed.get(s, 0)
        placed[s] = first + k
    assert placed == counts
    longest_first = plan(counts, 2048, orders=[(1, 0.0)])
    assert used <= max(x[3] + x[2] for x in longest_first)
    assert used <= bound * 1.002 + 1


def test_packing_empty(spark):
    assert pack(pieces(docs(spark, []), WORD_FILE)).count() == 0


def test_token_counts_against_offsets(spark):
    from tokenizers import Tokenizer

    hf = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    hf.encode_special_tokens = True
    texts = ["one line", "two\nlines here", "été\n\n\nnaïve 😀\n", "", None, "\n", "a  \n  b\n"]
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    rows = token_counts(docs(spark, texts).withColumn("section", F.lit(1)), path, pattern).orderBy("doc_id", "section").collect()
    for i, t in enumerate(texts):
        t = t or ""
        own = [r for r in rows if r.doc_id == i]
        assert "".join(t[r.char_start : r.char_end] for r in own) == t
        spans = hf.encode(t, add_special_tokens=False).offsets
        assert sum(r.n_tokens for r in own) == len(spans)
        if t.isascii():
            for r in own:
                assert r.n_tokens == sum(r.char_start <= a < r.char_end for a, _ in spans)
    for rule in ("most", "share"):
        got = token_counts(docs(spark, texts), path, pattern, rule).groupBy("doc_id").agg(F.sum("n_tokens").alias("n")).collect()
        assert {r.doc_id: round(r.n, 6) for r in got} == {i: sum(r.n_tokens for r in rows if r.doc_id == i) for i in range(len(texts))}
    with pytest.raises(ValueError):
        token_counts(docs(spark, texts), path, pattern, "none")


def test_boundary_rules():
    lengths, ends = np.array([4, 6, 2]), np.array([5, 8, 12])  # the second token holds bytes 4-9: one, three and two of them per section
    assert attribute(lengths, ends, "start")[0].tolist() == [2, 0, 1]
    assert attribute(lengths, ends, "most")[0].tolist() == [1, 1, 1]
    assert np.allclose(attribute(lengths, ends, "share")[0], [1 + 1 / 6, 3 / 6, 1 + 2 / 6])
    assert attribute(lengths, ends, "start")[1].tolist() == [1, 0, 0]


def base_by_patterns(t):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t):
        if all(int(p) <= 255 for p in m.group().split(".")):
            out.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m.group())
        if 12 <= len(d) <= 19 and pii.luhn(d):
            out.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t):
        if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def test_base_spans_equal_the_patterns():
    rnd = random.Random(8)
    parts = ["a@b.co", "x_", "@", ".", "1.2.3.4", "256.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (017) 555-7713", "+49.", "123", " ", "-", "é", "a@b", "0004.3.2.1.9.9.9", "999999999999999", "+", "%", "b.c@d.e_f@g.h", "\n", "(", "5"]
    for _ in range(3000):
        t = "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 12)))
        assert pii.base_spans(t) == base_by_patterns(t), repr(t)
    assert pii.base_spans("9" * 100_000 + "a" * 100_000 + "@") == []


def test_pii_method_adds_and_keeps(spark):
    token = "5d190bd7c06284de91015a36974748794293dd8a"
    texts = [f'api token = "{token}" here, call (017) 555-7713 or mail jo (at) mail dot com'] * 5 + ["plain words only", None, "mail a@b.co ip 1.2.3.4 card 4111 1111 1111 1111 tel +1 (017) 555-7713"]
    rows = {r.doc_id: r for r in pii.find_pii(docs(spark, texts).withColumn("base", F.lit(1))).collect()}
    assert len(rows) == len(texts)
    for i, t in enumerate(texts):
        base = [(s.start, s.kind, s.end) for s in rows[i].base]
        assert base == base_by_patterns(t or "")
        assert set(base) <= {(s.start, s.kind, s.end) for s in rows[i].spans}
    found = {texts[0][s.start : s.end] for s in rows[0].spans}
    assert token in found
    assert rows[5].spans == [] and rows[6].spans == []
    spans = sorted((s.start, s.end) for s in rows[0].spans)
    assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))
    assert pii.find_pii(docs(spark, [])).count() == 0


def test_obfuscated_emails_need_nothing_else_in_the_text():
    for mail in ("joe {at} example.com", "joe [AT] example.com", "joe (AT) example.org", "joe at example.com", "joe(At)example {Dot} net"):
        for rest in ("", " an anecdote"):
            t = f"write to {mail} ,{rest}"
            assert mail in [t[a:b] for a, k, b in pii.candidate_spans(t) if k == 0], t


def test_em_recovers_reliable_labelers():
    rnd = random.Random(4)
    counts = {}
    truth = {}
    for _ in range(4000):
        y = rnd.random() < 0.4
        v = [(2 if (rnd.random() < q) == y else 1) if rnd.random() < 0.8 else 0 for q in (0.95, 0.9, 0.85, 0.8, 0.6)]
        code = 4
        for x in v:
            code = code * 3 + x
        code = ((code * 4 + 1) * 4 + 1) * 2
        counts[code] = counts.get(code, 0) + 1
        truth.setdefault(code, []).append(y)
    accepted = set(pii.train(counts))
    right = sum((c in accepted) == y for c, ys in truth.items() for y in ys)
    assert right / 4000 > 0.93
    assert pii.train({}) == []


def test_pii_accepts_nothing_where_there_is_nothing(spark):
    for t in ("see the-2024-annual-report-on-climate-change for more", "on 2024-01-02 12 people came", "the sum is 123 456 789 in all", "we met in John Street and James Road", "version 10_20_30/build-2024-01-05-nightly-x", "look at the end. Of it and at that. Then"):
        got = pii.find_pii(docs(spark, [t] * 50)).where("size(spans) > 0").collect()
        assert not got, (t, got[0].spans)


def test_pii_recall_on_planted_spans(spark):
    rnd = random.Random(11)
    word = lambda: "".join(rnd.choice("abcdefghi") for _ in range(rnd.randint(2, 8)))
    hexes = lambda n: "".join(rnd.choice("0123456789abcdef") for _ in range(n))
    num = lambda n: "".join(rnd.choice("0123456789") for _ in range(n))
    makers = {
        "secret": lambda: f'token = "{hexes(40)}"',
        "key": lambda: "AKIA" + "".join(rnd.choice("ABCDEFGHIJ0123456789") for _ in range(16)),
        "phone": lambda: f"call ({num(3)}) 555-{num(4)}",
        "email": lambda: f"mail {word()} (at) {word()} dot com",
        "name": lambda: rnd.choice(["Dr. Müller", "Prof. Jürgen Weiß", "signed María González", "dear Juan Pérez", "Frau Schröder", "by John Smith"]),
        "base": lambda: rnd.choice([f"{word()}@{word()}.com", f"{rnd.randint(1, 255)}.1.2.3", f"+1 ({num(3)}) 555-{num(4)}", "4111 1111 1111 1111"]),
    }
    noise = [lambda: "the-2024-annual-report-on-climate-change", lambda: "2024-01-02 12", lambda: "James Road", lambda: num(9), lambda: "it ended at noon. Then", lambda: "https://a.org/one/two-three/four_five/six7"]
    plain = lambda: [rnd.choice(noise)() if rnd.random() < 0.02 else word() for _ in range(60)]
    texts, kinds = [], []
    for i in range(900):
        ws, kind = plain(), None
        if i % 3 == 0:
            kind = rnd.choice(list(makers))
            ws.insert(rnd.randint(0, 60), makers[kind]())
        texts.append(" ".join(ws))
        kinds.append(kind)
    found = {r.doc_id: len(r.spans) > 0 for r in pii.find_pii(docs(spark, texts)).collect()}
    for kind in makers:
        own = [found[i] for i, k in enumerate(kinds) if k == kind]
        assert sum(own) >= 0.9 * len(own), kind
    clean = [found[i] for i, k in enumerate(kinds) if k is None]
    assert sum(clean) <= 0.02 * len(clean)


def test_pii_gazetteer_tables_and_odd_rows(spark):
    more = spark.createDataFrame([("name", "Quintus"), ("name", None), ("email", "museum")], "kind string, entry string")
    rows = [(None, "dear Quintus Fabius of Rome", "en", "s", 0), (None, "dear Quintus Fabius of Rome", "en", "s", 0), (4, "plain " * 50_000 + "by Quintus Fabius", "en", "s", 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = sorted(len(r.spans) for r in pii.find_pii(df, gazetteer=more).collect())
    assert got == [1, 1, 1]
    with pytest.raises(ValueError):
        pii.gazetteers(spark.range(pii.GAZETTEER_ROWS + 1).selectExpr("'name' as kind", "string(id) as entry"))


def words_of(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def brute_stats(t):
    t = t or ""
    w = words_of(t)
    seen, dup = set(), 0
    for line in t.split("\n"):
        if words_of(line):
            dup += line in seen
            seen.add(line)
    wins = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    many = {x for x in wins if wins.count(x) > 1}
    hit = {i + j for i, x in enumerate(wins) if x in many for j in range(5)}
    return len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), dup, len(hit)


def test_statistics_match_brute_force(spark):
    rnd = random.Random(6)
    texts = ["\n".join(" ".join(rnd.choice("ab#c d*é") + rnd.choice(["", "x"]) for _ in range(rnd.randint(0, 9))) for _ in range(rnd.randint(0, 9))) for _ in range(60)]
    texts += [None, "", "a b c d e a b c d e", "a a a a a a a", "p q r s t u p q r s t v p q r s t", "x\n \nx\nx"]
    rows = {r.doc_id: r for r in statistics(docs(spark, texts), ["doc_id"]).collect()}
    for i, t in enumerate(texts):
        r = rows[i]
        n, chars, symbols, dup, repeat = brute_stats(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, dup, repeat), repr(t)
        assert r.base_failed == (n < 10 or 100 * repeat > 20 * n)


def quality_corpus():
    rnd = random.Random(9)
    clean = [" ".join("".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 8))) for _ in range(rnd.randint(40, 90))) for _ in range(120)]
    junk = [" ".join(w + "###$$$"[: rnd.randint(2, 6)] for w in c.split()) for c in clean[:6]]
    return clean, junk


def test_outliers_go_and_clean_documents_stay(spark):
    clean, junk = quality_corpus()
    df = docs(spark, clean + junk + ["too short", None])
    df = df.withColumn("lang", F.when(F.col("doc_id") % 2 == 0, "en")).withColumn("source", F.when(F.col("doc_id") % 3 == 0, "s"))
    df = df.withColumn("m0", F.lit(1)).withColumn("kept", F.lit("clash"))
    rows = {r.doc_id: r for r in quality_rules(df).collect()}
    assert len(rows) == 128
    assert all(rows[i].kept for i in range(120)) and not any(rows[i].kept for i in range(120, 128))
    assert rows[127].distance is None and rows[127].base_failed
    left = filter_documents(df)
    assert left.columns == df.columns
    assert sorted(r.doc_id for r in left.select("doc_id").collect()) == list(range(120))
    assert quality_rules(docs(spark, [])).count() == 0 and filter_documents(docs(spark, [])).count() == 0


def test_small_groups_have_estimates_of_their_own(spark):
    """A long tail: a small language whose words are long is not held against the others, and its junk still goes."""
    rnd = random.Random(12)
    word = lambda a, b: "".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(a, b)))
    en = [" ".join(word(2, 8) for _ in range(rnd.randint(40, 90))) for _ in range(400)]
    long_ = [" ".join(word(60, 140) for _ in range(rnd.randint(20, 40))) for _ in range(24)]
    rows = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in enumerate(en)]
    for n in (6, 24):  # too few to sway the estimate over all rows
        rows += [(1000 * n + i, t, f"long{n}", "s0", len(t)) for i, t in enumerate(long_[:n])]
        t = " ".join(w + "###$$$" * 5 for w in long_[n - 1].split())
        rows.append((1000 * n + 999, t, f"long{n}", "s0", len(t)))
    kept = {r.doc_id: r.kept for r in quality_rules(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert {i for i, k in kept.items() if not k} == {6999, 24999}


def test_mcd_counts_the_rows_of_the_group(spark):
    from quarrydoc.llm.quality_rules import DIMS, mcd

    rows = [(0, float(i % 7), float(i % 5), float(i % 3)) for i in range(40)]
    df = spark.createDataFrame(rows, "k int, " + ", ".join(f"{d} double" for d in DIMS)).withColumn("k", F.col("k") + F.floor(F.rand() * 0).cast("int"))
    assert mcd(df, ["k"], 0.75, 3).head().n == 40


def test_mcd_finds_the_smallest_determinant(spark):
    """A third of the rows lie in one far cluster: the estimate's determinant is as small as the best of many random starts in numpy."""
    from quarrydoc.llm.quality_rules import CONSISTENCY, DIMS, VAR_FLOOR, mcd

    rnd = np.random.default_rng(3)
    p = len(DIMS)
    x = np.concatenate([rnd.normal(size=(210, p)), rnd.normal(size=(70, p)) * 0.6 + 5])
    df = spark.createDataFrame([(i % 2, *map(float, r)) for i, r in enumerate(np.repeat(x, 2, axis=0))], "k int, " + ", ".join(f"{d} double" for d in DIMS))
    best = np.inf
    for _ in range(200):
        s = x[rnd.choice(len(x), p + 2, replace=False)]
        for _ in range(30):
            mean, cov = s.mean(0), np.cov(s.T, bias=True) * CONSISTENCY + VAR_FLOOR * np.eye(p)
            d = np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(cov), x - mean)
            s = x[d <= np.quantile(d, 0.75, method="lower")]
        best = min(best, np.linalg.slogdet(np.cov(s.T, bias=True) * CONSISTENCY + VAR_FLOOR * np.eye(p))[1])
    got = mcd(df, ["k"], 0.75, 30).collect()
    assert len(got) == 2
    for r in got:
        assert r.n == 280
        assert 2 * sum(np.log(r[f"l{i}{i}"]) for i in range(p)) <= best + 0.05
        assert all(abs(r[f"m{i}"]) < 0.4 for i in range(p))


def test_mcd_distance_against_numpy(spark):
    """The column arithmetic of one fit against the same steps in numpy."""
    from quarrydoc.llm.quality_rules import CONSISTENCY, DIMS, VAR_FLOOR, _distance, mcd

    rnd = np.random.default_rng(5)
    x = rnd.normal(size=(400, len(DIMS))) @ rnd.normal(size=(len(DIMS), len(DIMS)))
    df = spark.createDataFrame([(0, *map(float, r)) for r in x], "k int, " + ", ".join(f"{d} double" for d in DIMS)).withColumn("k", F.col("k") + F.floor(F.rand() * 0).cast("int"))
    p = mcd(df, ["k"], 0.75, 3).head()
    dims, med = len(DIMS), np.median(x, axis=0)
    scale = np.sqrt((1.4826 * np.median(np.abs(x - med), axis=0)) ** 2 + VAR_FLOOR)
    z = (x - med) / scale
    size = np.sqrt((z**2).sum(1))
    unit, near = z / size[:, None], x[size <= np.quantile(size, 0.5, method="lower")]
    starts = [(med, np.diag(scale**2)), (med, unit.T @ unit / len(x) * dims * np.outer(scale, scale) + VAR_FLOOR * np.eye(dims)), (near.mean(0), np.cov(near.T, bias=True) + VAR_FLOOR * np.eye(dims))]
    ends = []
    for mean, cov in starts:
        for _ in range(3):
            d = np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(cov), x - mean)
            s = x[d <= np.quantile(d, 0.75, method="lower")]
            mean, cov = s.mean(0), np.cov(s.T, bias=True) * CONSISTENCY + VAR_FLOOR * np.eye(dims)
        ends.append((np.linalg.slogdet(cov)[1], mean, cov))
    _, mean, cov = min(ends, key=lambda e: e[0])
    low = np.array([[p[f"l{i}{j}"] if j <= i else 0.0 for j in range(len(DIMS))] for i in range(len(DIMS))])
    assert np.allclose(low @ low.T, cov, rtol=0.15, atol=0.05)
    assert np.allclose([p[f"m{i}"] for i in range(len(DIMS))], mean, atol=0.1)


def shingles(t, width=5):
    w = words_of(t)
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def test_fingerprints(spark):
    rnd = random.Random(7)
    vocabulary = [f"v{i}" for i in range(400)]
    base = [rnd.choice(vocabulary) for _ in range(900)]
    texts = [" ".join(base), " ".join(base[300:] + [rnd.choice(vocabulary) for _ in range(300)]), "a b", "", None, "a b", "ünï 😀 text of a few words here"]
    df = docs(spark, texts).withColumn("sketch", F.lit(1)).withColumn("edited", F.lit(1))
    ids = [5 * i for i in range(len(texts))]
    df = df.withColumn("doc_id", F.col("doc_id") * 5)
    for buckets in (1, 3):
        rows = sorted(fingerprint_pairs(df, buckets=buckets).select("*", resemblance(F.col("sketch"), F.col("edited_sketch")).alias("near"), resemblance(F.col("sketch"), F.col("next_sketch")).alias("near_next"), distinct_count(F.col("sketch")).alias("n"), containment(F.col("sketch"), F.col("next_sketch")).alias("inside")).collect(), key=lambda r: r.doc_id)
        assert [r.doc_id for r in rows] == ids
        for i, r in enumerate(rows):
            t, nxt = texts[i] or "", texts[(i + 1) % len(texts)] or ""
            cut = len(t) // 4
            assert r.n_chars == len(t)
            assert r.edited == t[: len(t) - cut] + nxt[:cut]
            a, b = shingles(t), shingles(r.edited)
            exact = len(a & b) / len(a | b) if a | b else 1.0
            assert abs(r.near - exact) < 0.15
            assert abs(r.n - len(a)) <= 0.25 * len(a)
        a, b = shingles(texts[0]), shingles(texts[1])
        assert abs(rows[0].near_next - len(a & b) / len(a | b)) < 0.15 and abs(rows[0].inside - len(a & b) / len(a)) < 0.15
        assert rows[2].sketch == rows[5].sketch and rows[3].sketch == rows[4].sketch == []
    parts = spark.createDataFrame([("a b c d e f g h", "e f g h i j k l", "a b c d e f g h i j k l")], "x string, y string, z string")
    r = parts.select(merge(sketch(F.col("x"), 4), sketch(F.col("y"), 4), 4).alias("m"), sketch(F.col("z"), 4).alias("z"), as_string(sketch(F.col("z"), 4)).alias("s")).head()
    assert r.m == r.z and len(r.s) == 64
    assert with_next(docs(spark, []), "doc_id", ["text"], 3).count() == 0


def test_ranges_hold_about_as_many_bytes_each(spark):
    from quarrydoc.llm.fingerprints import place_key, range_heads, range_of

    df = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 400, 1000).otherwise(10).cast("long").alias("_size"))
    df = df.withColumn("_key", place_key("doc_id", F.xxhash64("doc_id")))
    heads = range_heads(df, 10**9, 8)
    sums = [r.s for r in df.groupBy(range_of(F.col("_key"), heads).alias("b")).agg(F.sum("_size").alias("s")).collect()]
    assert 6 <= len(sums) <= 12 and max(sums) <= 2 * 436_000 / 8
    assert len(range_heads(df, 4360, 1)) >= 60
    assert len(range_heads(df, 4360, 1, most=10)) <= 20  # larger ranges then
    assert range_heads(df.limit(0), 100, 4) == []
    rows = spark.createDataFrame([(None,), (1,), (5,), (5,), (9,)], "x long").select(range_of(place_key("x", F.lit(0).cast("long")), [(0, 0, 0), (1, 5, 0), (1, 7, 0)]).alias("b")).collect()
    assert sorted(r.b for r in rows) == [0, 0, 1, 1, 2]


def test_null_ids_are_split_and_plans_do_not_grow_with_ranges(spark):
    """Rows without an id, and those of one id, lie in many ranges, ordered by the hash of their text; every row has its successor."""
    from quarrydoc.llm.fingerprints import place_key, range_heads, range_of, with_next

    df = spark.range(3000).select(F.when(F.col("id") % 3 == 0, None).when(F.col("id") % 3 == 1, F.lit(7)).otherwise(F.col("id")).cast("long").alias("doc_id"), F.concat(F.lit("t"), "id").alias("text"))
    key = place_key("doc_id", F.xxhash64("text"))
    heads = range_heads(df.select(key.alias("_key"), F.lit(1).cast("long").alias("_size")), 10, 1)
    per = df.groupBy("doc_id", range_of(key, heads).alias("b")).count().collect()
    assert len({r.b for r in per if r.doc_id is None}) > 50 and len({r.b for r in per if r.doc_id == 7}) > 50 and max(r["count"] for r in per) <= 40
    out = with_next(df, "doc_id", ["text"], heads=heads)
    order = [r.text for r in df.orderBy(key).collect()]
    follows = dict(zip(order, order[1:] + order[:1]))
    rows = out.collect()
    assert len(rows) == 3000 and all(r.next_text == follows[r.text] for r in rows)
    few = with_next(df, "doc_id", ["text"], heads=heads[:3])._jdf.queryExecution().logical().toString()
    assert out._jdf.queryExecution().logical().toString().count("\n") == few.count("\n")


def test_edited_hash(spark):
    r = spark.createDataFrame([("abcdefgh", "12")], "t string, n string").select(F.sha2(edited_text(F.col("t"), F.col("n")), 256).alias("h")).head()
    assert r.h == hashlib.sha256(b"abcdef12").hexdigest()
