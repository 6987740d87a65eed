"""Secrets against keys made here, periodic runs and phrases against brute force, and odd rows through all three."""

import base64
import hashlib
import json
import random
import re
from collections import Counter, defaultdict
from fractions import Fraction
from zlib import crc32

import pytest
from pyspark.sql import functions as F

from quarrydoc.llm import queries
from quarrydoc.llm.periodic_runs import lag_range, periodic_runs, planted
from quarrydoc.llm.phrases import collocations, floor_ratio, frequent_phrases
from quarrydoc.llm.secret_scan import KEY_OIDS, KINDS, confirmed_spans, find_secrets

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def tlv(tag, *parts):
    body = b"".join(parts)
    n = len(body)
    size = bytes([n]) if n < 128 else (bytes([0x81, n]) if n < 256 else b"\x82" + n.to_bytes(2, "big"))
    return bytes([tag]) + size + body


def integer(rng, bits):
    n = rng.getrandbits(bits) | 1 << (bits - 1)
    return tlv(2, n.to_bytes(bits // 8 + 1, "big").lstrip(b"\0") if bits % 8 else b"\0" + n.to_bytes(bits // 8, "big"))


def keys(rng):
    """A private key of each structure, and what looks like one and is none."""
    zero, one = tlv(2, b"\0"), tlv(2, b"\1")
    rsa = tlv(0x30, zero, integer(rng, 1024), tlv(2, b"\1\0\1"), integer(rng, 1024), *[integer(rng, 512) for _ in range(5)])
    oid = tlv(6, bytes.fromhex("2a864886f70d010101"))
    pkcs8 = tlv(0x30, zero, tlv(0x30, oid, tlv(5)), tlv(4, rsa))
    ed = tlv(0x30, zero, tlv(0x30, tlv(6, bytes.fromhex("2b6570"))), tlv(4, tlv(4, rng.randbytes(32))))
    ec = tlv(0x30, one, tlv(4, rng.randbytes(32)), tlv(0xA0, tlv(6, bytes.fromhex("2a8648ce3d030107"))), tlv(0xA1, tlv(3, b"\0" + rng.randbytes(65))))
    pbes = tlv(0x30, tlv(0x30, tlv(6, bytes.fromhex("2a864886f70d01050d")), tlv(0x30, tlv(4, rng.randbytes(16)))), tlv(4, rng.randbytes(160)))
    dsa = tlv(0x30, zero, integer(rng, 1024), integer(rng, 160), integer(rng, 1024), integer(rng, 1024), integer(rng, 152))
    public = tlv(0x30, tlv(0x30, oid, tlv(5)), tlv(3, b"\0" + tlv(0x30, integer(rng, 1024), tlv(2, b"\1\0\1"))))
    other = tlv(0x30, zero, tlv(0x30, tlv(6, b"\x2a\x03\x04"), tlv(5)), tlv(4, tlv(0x31, rng.randbytes(300))))
    return {"rsa": rsa, "pkcs8": pkcs8, "ed": ed, "ec": ec, "pbes": pbes, "dsa": dsa}, {"public": public, "cut": pkcs8[:-1], "other": other, "random": b"\x30\x82" + rng.randbytes(300)}


def openssh(rng, bad=False):
    s = lambda b: len(b).to_bytes(4, "big") + b
    public = s(b"ssh-ed25519") + s(rng.randbytes(32))
    check = rng.randbytes(4)
    secret = check + (rng.randbytes(4) if bad else check) + public + s(rng.randbytes(64)) + s(b"me")
    secret += bytes(range(1, 1 + -len(secret) % 8))
    return b"openssh-key-v1\0" + s(b"none") + s(b"none") + s(b"") + (1).to_bytes(4, "big") + s(public) + s(secret)


def url64(b):
    return base64.urlsafe_b64encode(b).decode().rstrip("=")


def jwt(rng, alg="HS256", size=32, header=None):
    return ".".join([url64(json.dumps(header or {"alg": alg, "typ": "JWT"}).encode()), url64(b'{"sub":"1"}'), url64(rng.randbytes(size))])


def armour(label, data, width=64):
    b = base64.b64encode(data).decode()
    return f"-----BEGIN {label}-----\n" + "\n".join(b[i : i + width] for i in range(0, len(b), width)) + f"\n-----END {label}-----"


def found(t):
    return [(KINDS[k], t[a:e]) for a, k, e in confirmed_spans(t)]


def test_secrets_are_decoded():
    rng = random.Random(5)
    for _ in range(10):
        good, bad = keys(rng)
        for name, data in good.items():
            for t in (base64.b64encode(data).decode(), base64.urlsafe_b64encode(data).decode(), url64(data)):
                assert found(f"über key: {t} und") == [("der", t)], name
                assert found("x" + t)[0][0] == "der", name  # glued to a letter before it
            assert found(f"hex {data.hex()}.") == [("der", data.hex())] and found(data.hex().upper()) == [("der", data.hex().upper())]
            pem = armour("PRIVATE KEY", data)
            assert found(f"a\n{pem}\nb") == [("pem", pem)]
            assert found(pem.replace("\n", "\\n")) == [("pem", pem.replace("\n", "\\n"))]
            twice = base64.b64encode((pem + "\n").encode()).decode()
            assert found(f"data: {twice} end") == [("pem", twice)]
        for name, data in bad.items():
            assert found(base64.b64encode(data).decode()) == [] and found(data.hex()) == [] and found(armour("PRIVATE KEY", data)) == [], name
        ssh = openssh(rng)
        assert found(base64.b64encode(ssh).decode())[0][0] == "ssh" and found(ssh.hex()) == [("ssh", ssh.hex())]
        assert found(armour("OPENSSH PRIVATE KEY", ssh, 70))[0][0] == "pem"
        assert found(base64.b64encode(openssh(rng, bad=True)).decode()) == [] and found(base64.b64encode(ssh[:-8]).decode()) == []
    locked = "-----BEGIN RSA PRIVATE KEY-----\nProc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,00112233445566778899AABBCCDDEEFF\n\n" + base64.b64encode(rng.randbytes(608)).decode() + "\n-----END RSA PRIVATE KEY-----"
    assert found(locked) == [("pem", locked)] and found(locked.replace("AABB", "AAB")) == []
    assert len(KEY_OIDS) == 9


def test_signed_tokens():
    rng = random.Random(6)
    for alg, n in (("HS256", 32), ("RS256", 256), ("ES256", 64), ("XX1", 20)):
        t = jwt(rng, alg, n)
        assert found(f"auth: {t}. Next") == [("jwt", t)] and found(f'see="{t}".com') == [("jwt", t)]
    jwe = ".".join([url64(b'{"alg":"dir","enc":"A128GCM"}'), "", url64(rng.randbytes(12)), url64(rng.randbytes(40)), url64(rng.randbytes(16))])
    assert found(jwe) == [("jwt", jwe)]
    for t in (jwt(rng, "HS256", 31), jwt(rng, "RS256", 64), jwt(rng, header={"typ": "JWT"}), jwt(rng)[:-43], "eyJub3QganNvbi4uLi4.eyJhIjoxfQ.c2lnbmF0dXJl", "www.example-of-a-long-name.com/path.to.something.else"):
        assert found(t) == [], t


def brute_base(t):
    """Base spans by the contract's own words: every match in order, failing ones dropped."""
    out = []
    for m in re.finditer(r"(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", t):
        out += [(m.start(), 0, m.end())] if len(m[1]) >= 8 else []
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m.group()) >= 16]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m.group()) >= 32]
    return sorted(out)


def test_base_secrets(spark, data):
    rng = random.Random(7)
    bits = ["password", "PassWd", "secret", "toKen", "api_key", "ApiKey", "toſen", '"', "'", " ", "  ", ":", "=", ": ", "abcdefgh", "A1b2C3d4E5", "x", "AKIA", "AKIAABCDEFGHIJKL", "ÄKIA", "0123456789abcdef" * 2, "deadbeef" * 5, "é", "\n", "api__key", "F" * 40]
    texts = ["".join(rng.choices(bits, k=rng.randint(0, 12))) for _ in range(800)]
    rows = [(i, t, None, None, None) for i, t in enumerate(texts)]
    got = {r.doc_id: r for r in find_secrets(spark.createDataFrame(rows, SCHEMA)).collect()}
    for i, t in enumerate(texts):
        assert [tuple(s) for s in got[i].base] == brute_base(t) and [s for s in got[i].spans if s["kind"] < 3] == got[i].base, t
    assert sum(len(r.base) for r in got.values()) > 300
    docs = spark.read.parquet(f"{data}/documents.parquet").collect()
    query = {r.doc_id: r for r in queries.op11_secret_scan(spark, data).collect()}
    for r in docs:
        spans = brute_base(r.text or "")
        digest = hashlib.sha256(",".join(f"{KINDS[k]}:{a}:{e}" for a, k, e in spans).encode()).hexdigest()
        q = query[r.doc_id]
        assert q.base_sha256 == digest and (q.n_assign, q.n_access, q.n_hex) == tuple(sum(k == x for _, k, _ in spans) for x in range(3))


def test_planted_secrets(spark, data):
    """Keys planted in clean documents are all found, and nothing else."""
    rng = random.Random(8)
    docs = [r for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect() if r.text][:120]
    rows, want = [], {}
    for r in docs:
        good, _ = keys(rng)
        secret = rng.choice([base64.b64encode(good["pkcs8"]).decode(), armour("PRIVATE KEY", good["ec"]), jwt(rng), base64.b64encode(openssh(rng)).decode().rstrip("="), None])
        at = r.text.find(" ", len(r.text) // 2)
        text = r.text if secret is None or at < 0 else f"{r.text[: at + 1]}{secret}{r.text[at:]}"
        want[r.doc_id] = [] if text == r.text else [(at + 1, at + 1 + len(secret))]
        rows.append((r.doc_id, text, None, None, None))
    for r in find_secrets(spark.createDataFrame(rows, SCHEMA)).collect():
        assert [(s["start"], s["end"]) for s in r.spans if s["kind"] > 2] == want[r.doc_id]
    assert sum(map(len, want.values())) > 50


def brute_runs(ws, min_exponent=4, min_words=6):
    """Every stretch by its own smallest period: no array, no lag scan."""
    n, out = len(ws), {}
    for q in range(1, n // min_exponent + 1):
        i = 0
        while i < n - q:
            if ws[i] != ws[i + q]:
                i += 1
                continue
            j = i
            while j < n - q and ws[j] == ws[j + q]:
                j += 1
            length = j - i + q
            if length >= max(min_words, min_exponent * q) and not any(all(ws[x] == ws[x + p] for x in range(i, i + length - p)) for p in range(1, q)):
                out[i, length] = q
            i = j
    return sorted((s, length, q) for (s, length), q in out.items())


def brute_collapsed(ws, runs):
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    return " ".join(w for i, w in enumerate(ws) if i not in gone)


def run_texts(rng):
    out = ["", "a", "a a a a a a", "a a a a a", "a b a b a b a b", "a b a b a b a", "x a a a a a a a b b b b b b y", " ".join("abcabcabcabcabcabcabcab"), "      \x1c \x85"]
    for _ in range(150):
        parts = []
        for _ in range(rng.randint(1, 4)):
            block = rng.choices("abc", k=rng.randint(1, 7))
            parts += block * rng.randint(1, 7) + rng.choices("abcd", k=rng.randint(0, 5))
        out.append(rng.choice([" ", "\t", " \n"]).join(parts))
    return out


def test_runs_against_brute_force(spark):
    texts = run_texts(random.Random(9))
    df = spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(texts)], SCHEMA)
    for unit in (2**25, 16):  # whole documents; shares of a few lags each
        import quarrydoc.llm.periodic_runs as module

        shifts, module.SHIFTS = module.SHIFTS, 1024 if unit > 16 else 1
        try:
            got = {r.doc_id: r for r in periodic_runs(df, unit=unit).collect()}
        finally:
            module.SHIFTS = shifts
        assert len(got) == len(texts)
        for i, t in enumerate(texts):
            ws = WORDS.findall(t)
            runs = brute_runs(ws)
            assert [tuple(r) for r in got[i].runs] == sorted(runs, key=lambda r: (r[0], r[2])) and got[i].n_words == len(ws), t
            assert got[i].collapsed == brute_collapsed(ws, runs), t
    two = periodic_runs(df, min_exponent=2, min_words=2).collect()
    assert all([tuple(r) for r in row.runs] == sorted(brute_runs(WORDS.findall(texts[row.doc_id]), 2, 2), key=lambda r: (r[0], r[2])) for row in two)


def test_lag_ranges():
    for n in (0, 3, 4, 100, 12_345):
        for units in (1, 2, 7, 40):
            lags = [q for u in range(units) for q in lag_range(n, u, units, 4)]
            assert lags == list(range(1, n // 4 + 1))
    shares = [sum(10_000 - q for q in lag_range(10_000, u, 8, 4)) for u in range(8)]
    assert max(shares) < 1.01 * min(shares)


def test_runs_of_the_contract(spark, data):
    """Planting, digests and the densest run by the contract's own words."""
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{data}/documents.parquet").collect() if len(r.text or "") < 6000}
    got = {r.doc_id: r for r in queries.op12_periodic_runs(spark, data).collect()}
    changed = {r.doc_id: r.text for r in planted(spark.read.parquet(f"{data}/documents.parquet")).collect()}
    for doc_id, text in docs.items():
        h, ws = crc32(str(doc_id).encode()), WORDS.findall(text or "")
        n, g = len(ws), h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            ws = [ws[a + (i - a) % p] if i >= a else ws[i] for i in range(n)]
            assert changed[doc_id] == " ".join(ws)
        else:
            assert changed[doc_id] == text
        runs, r = sorted(brute_runs(ws), key=lambda r: (r[0], r[2])), got[doc_id]
        assert r.n_runs == len(runs) and r.runs_sha256 == hashlib.sha256("".join("%d,%d,%d\n" % x for x in runs).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(brute_collapsed(ws, runs).encode()).hexdigest()
        if runs:
            s, length, q = min(runs, key=lambda x: (-Fraction(x[1], x[2]), x[0], x[2]))
            assert (r.start, r.length, r.period, r.exponent_milli) == (s, length, q, 1000 * length // q)
        else:
            assert (r.start, r.length, r.period, r.exponent_milli) == (None,) * 4


def brute_phrases(rows, min_count, top=2000, inside=100, longest=5):
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        t = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", t):
            ws = re.findall("[^\x20\x09]+", piece)
            n[lang or "und"] += len(ws)
            for k in range(1, longest + 1):
                f[lang or "und"].update(tuple(ws[i : i + k]) for i in range(len(ws) - k + 1))
    out = []
    for lang, c in f.items():
        cand = {p: a for p, a in c.items() if len(p) > 1 and a >= min_count}
        best = []
        for p, a in cand.items():
            if any(len(q) > len(p) and 100 * b >= inside * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in cand.items()):
                continue
            score, _, l, r = min((1000 * a * n[lang] // (c[p[:k]] * c[p[k:]]), k, c[p[:k]], c[p[k:]]) for k in range(1, len(p)))
            best.append((-score, -a, " ".join(p).encode(), a, l, r, n[lang], score))
        out += [(lang, i, b[2].decode(), *b[3:]) for i, b in enumerate(sorted(best)[:top], 1)]
    return sorted(out)


@pytest.mark.parametrize("broadcast", [True, False])
def test_phrases_against_brute_force(spark, broadcast, monkeypatch):
    from quarrydoc.llm import phrases

    rng = random.Random(10)
    vocabulary = [*"ABCdefg", "é", "É", "😀", "\x1c", "\x00z", "a b"]
    rows = [("".join(w + rng.choice([" ", " ", "\t", "  ", ", ", ".", "\n", "\r", "\x0b"]) for w in rng.choices(vocabulary, weights=[9, 7, 5, 4, 3, 2, 2, 2, 1, 1, 1, 1, 1], k=rng.randint(0, 60))), rng.choice(["en", "de", None])) for _ in range(300)]
    rows += [("a a a a a a a a", "en"), (None, "en"), ("", None), ("over the hill we go again over the hill we go", "fr")] * 8
    df = spark.createDataFrame([(1, t, lang, None, None) for t, lang in rows], SCHEMA).repartition(3)
    if not broadcast:
        monkeypatch.setattr(phrases, "is_small", lambda *_: False)
    for top, inside in ((2000, 100), (7, 80)):
        got = sorted(tuple(r) for r in collocations(df, min_count=8, top=top, inside=inside, block_words=300).collect())
        assert got == brute_phrases(rows, 8, top, inside) and len(got) > 10
    _, every = frequent_phrases(df, 3, 8, 500)
    assert every.where("k = 3").count() == len({(r.lang, r.phrase) for r in every.where("k = 3").collect()}) > 0


def test_scores_beyond_64_bits(spark):
    rows = [(10**13, 10**14, 3 * 10**12, 7 * 10**13), (101, 10**15, 103, 107), (100, 100, 100, 100), (9 * 10**15, 9 * 10**18, 9 * 10**18, 10**16)]
    df = spark.createDataFrame(rows, "a long, n long, l long, r long")
    got = df.select(floor_ratio(*(F.col(c) for c in "anlr")).alias("s")).collect()
    assert [r.s for r in got] == [1000 * a * n // (l * r) for a, n, l, r in rows]


def test_long_texts_are_cut_at_pieces():
    from quarrydoc.llm.phrases import slices

    t = "one two, three four five. six " * 50 + "seven eight"
    for size in (1, 10, 64, 10**6):
        assert "".join(slices(t, size)) == t and all(p[-1] in ",." for p in list(slices(t, size))[:-1])


LONG = " ".join(f"word{i % 977}" + (".\n" if i % 1000 == 999 else "") for i in range(150_000))


def test_odd_rows(spark):
    rows = [(1, LONG, "en", "hot", 1), (None, "a null id token = 0123456789abcdef", "en", "hot", 1), (None, None, None, None, None), (2, "", "en", "hot", 0), (3, "go " * 9, "de", "s", 1), (3, "go " * 9, "de", "s", 1), (3, "one id, another text", "de", "s", 1)]
    odd = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("clash") for c in ("row", "runs", "units", "unit", "base", "spans", "block", "word", "phrase", "positions", "k", "f", "id", "n", "h", "ws")})
    secrets = find_secrets(odd).collect()
    assert len(secrets) == 7 and sorted(len(r.base) for r in secrets) == [0] * 6 + [1] and sum(r.doc_id is None for r in secrets) == 2
    runs = periodic_runs(planted(odd)).collect()
    assert len(runs) == 7 and [tuple(x) for r in runs if r.doc_id == 3 and r.runs for x in r.runs] == [(0, 9, 1)] * 2
    (long,) = [r for r in runs if r.doc_id == 1]
    assert long.n_words == 150_000 and all(x["length"] >= 4 * x["period"] for x in long.runs)
    got = collocations(odd, min_count=10).collect()
    assert {r.lang for r in got} == {"en", "de"} and sorted(tuple(r) for r in got) == brute_phrases([(r[1], r[2]) for r in rows], 10)
    none = odd.limit(0)
    assert find_secrets(none).count() == 0 and periodic_runs(planted(none)).count() == 0 and collocations(none).count() == 0
