"""Odd rows through the operators: null ids and texts, empty and very long texts, ties, repeated rows, clashing columns."""

import hashlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from quarrydoc.llm.fingerprints import fingerprint_pairs, resemblance, sketch
from quarrydoc.llm.kd_sharding import kd_shards
from quarrydoc.llm.mixing import mix
from quarrydoc.llm.packing import best_fit_packing
from quarrydoc.llm.quality_rules import filter_documents, quality_rules
from quarrydoc.llm.token_counts import _encoding, token_counts

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"word{i}" + ("\n" if i % 1000 == 999 else "") for i in range(150_000))
ROWS = [(1, LONG, "en", "hot", 1), (None, "a null id", "en", "hot", 1), (None, None, None, None, None), (2, "", "en", "hot", 0), (3, "twice the same text", "de", "s", 1), (3, "twice the same text", "de", "s", 1), (3, "one id, another text", "de", "s", 1), (4, "été 😀 naïve", "fr", None, 1)]


@pytest.fixture(scope="module")
def odd(spark):
    d = spark.createDataFrame(ROWS, SCHEMA)
    return d.withColumns({c: F.lit("clash") for c in ("h", "row", "shard", "sketch", "_b", "copy", "tokens", "kept", "m0", "section", "piece")})


def test_token_counts(odd):
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    rows = token_counts(odd, path, pattern).collect()
    long = [r for r in rows if r.doc_id == 1]
    assert len(long) == 150 and max(r.char_end for r in long) == len(LONG)
    assert sum(r.n_tokens for r in long) == len(_encoding(path, pattern)[0].encode_ordinary(LONG))
    assert sorted(r.n_tokens > 0 for r in rows if r.doc_id is None) == [False, True]
    assert len([r for r in rows if r.doc_id == 3]) == 3


def test_token_rules_against_bytes(spark):
    """Every rule against a count byte by byte, on texts with characters of several bytes."""
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    enc = _encoding(path, pattern)[0]
    texts = ["été\n\n\nnaïve 😀\n", "a\n\n\n  \n b", "日本\n語  \n\n", "\n\n\n\n", "no break", "x\r\n\r\ny"]

    def ends(data):  # sections of three bytes, so that most tokens cross
        return np.append(np.arange(3, len(data), 3), len(data)) if len(data) else np.array([0])

    df = spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(texts)], SCHEMA)
    for rule in ("start", "most", "share"):
        got = token_counts(df, path, pattern, rule, ends=ends).collect()
        for i, t in enumerate(texts):
            data = t.encode()
            want, at = [0.0] * len(ends(data)), 0
            for token in enc.encode_ordinary(t):
                n = len(enc.decode_single_token_bytes(token))
                own = [0] * len(want)
                for b in range(at, at + n):
                    own[min(b // 3, len(want) - 1)] += 1
                if rule == "share":
                    want = [w + o / n for w, o in zip(want, own)]
                else:
                    want[own.index(max(own)) if rule == "most" else next(k for k, o in enumerate(own) if o)] += 1
                at += n
            assert np.allclose([r.n_tokens for r in sorted((r for r in got if r.doc_id == i), key=lambda r: r.section)], want), (rule, t)


def test_mixing(odd):
    got = mix(odd, max_repeats=2.0).where("copy = 0").collect()
    assert len(got) == len(ROWS) and sorted(r.tokens for r in got)[-1] == 150_000
    assert {r["__s"] for r in got if r.doc_id == 4} == {"\u0000null"}


def test_sharding(odd):
    got = kd_shards(odd, 3).collect()
    assert len(got) == len(ROWS) and max(r["size"] for r in got) == len(LONG) + 1
    for s in range(3):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(len([r for r in got if r.shard == s])))
    assert len({r.shard for r in got if r["size"] == 20}) == 1


def test_fingerprints_of_odd_rows(spark, odd):
    """Null ids first, then by id; rows with one id follow each other; the last is followed by the first."""
    for buckets in (1, 4):
        got = fingerprint_pairs(odd, buckets=buckets).select("*", resemblance(F.col("sketch"), F.col("next_sketch")).alias("near")).collect()
        assert len(got) == len(ROWS)
        own = {r.t: r.s for r in spark.createDataFrame([(t or "",) for t in {r[1] for r in ROWS}], "t string").select("t", sketch(F.col("t")).alias("s")).collect()}
        twice = [r for r in got if r.doc_id == 3]
        assert sorted(tuple(r.sketch) for r in twice) == sorted(tuple(own[t]) for t in ("twice the same text", "twice the same text", "one id, another text"))
        (last,) = [r for r in got if r.doc_id == 4]
        assert tuple(last.next_sketch) in {tuple(own["a null id"]), tuple(own[""])}
        (long,) = [r for r in got if r.doc_id == 1]
        cut = len(LONG) // 4
        assert long.n_chars == len(LONG) and hashlib.sha256(long.edited.encode()).digest() == hashlib.sha256(LONG[: len(LONG) - cut].encode()).digest()
    assert fingerprint_pairs(odd.limit(0)).count() == 0
    one = fingerprint_pairs(spark.createDataFrame([(9, "abcd", None, None, None)], SCHEMA)).head()
    assert one.edited == "abca" and one.sketch == one.next_sketch


def test_quality(odd):
    rows = quality_rules(odd).collect()
    assert len(rows) == len(ROWS)
    (long,) = [r for r in rows if r.doc_id == 1]
    assert long.n_words == 150_000 and long.n_repeat_words == 0 and not long.base_failed
    assert all(r.base_failed and not r.kept for r in rows if r.doc_id != 1)
    assert filter_documents(odd).columns == odd.columns


def test_packing(odd):
    rows = best_fit_packing(odd, public_tokenizers.path("word_bpe_49k.json")).collect()
    assert sum(r.doc_id == 3 for r in rows) == 3 and sum(r.doc_id is None for r in rows) == 2
    long = sorted((r for r in rows if r.doc_id == 1), key=lambda r: r.piece)
    assert [r.start for r in long] == [2048 * i for i in range(len(long))] and all(r.length == 2048 for r in long[:-1])
    places = {}
    for r in rows:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for p in places.values():
        at = 0
        for off, n in sorted(p):
            assert off == at
            at += n
        assert at <= 2048
