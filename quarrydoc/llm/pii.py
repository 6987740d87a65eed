"""PII: base patterns plus spans found by weak supervision.

Base spans (e-mail, IP address, card, phone) follow fixed patterns and always stay. Further
candidates (phones without a plus, secrets, obfuscated e-mails, titled, listed or announced names) get votes from regex, gazetteer and
context labelers: for, against, or none. Votes are counted by pattern over the whole corpus
in the executors; expectation-maximisation on these counts (two classes, labelers
independent given the class) estimates each labeler's reliability and the class of every pattern.
The classes are anchored: every labeler starts from, and is drawn to with the weight of the data themselves, a prior under which a
vote for is likelier on personal data and a vote against likelier on the rest (`PRIOR`). So a corpus that only holds
slugs, dates and street names cannot turn them into the class that is found.
A logistic classifier over votes and span features is then trained on all candidates, as
counts per distinct feature code weighted by the estimated classes, and decides every span. The driver holds one
row per distinct code, of which there are at most `MAX_CODES`, whatever the corpus.

Gazetteers are small built-in lists; a table (kind, entry) of up to `GAZETTEER_ROWS` rows adds to them.

Matching is linear in the text: e-mails are found from their @ sign, addresses and cards from the start of
their digit runs. Offsets are code points, ends exclusive.

Defined results: null text is empty and has no spans; each row is treated on its own, whatever its id (null too);
added spans never overlap base spans or each other (the earlier, then the longer one stays); with no
candidates nothing is trained and nothing added; an empty table gives no rows; very long texts are read whole; other columns are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table

#: Base kinds in their listed order, then the kinds that only the method finds.
KINDS = ("email", "ip", "card", "phone", "secret", "name")
#: Cue words of the context labeler, by kind.
CUES = {
    "email": ("mail", "email", "e-mail", "contact", "write", "courriel", "correo"),
    "phone": ("phone", "tel", "call", "mobile", "fax", "cell", "telefon", "téléphone", "teléfono"),
    "secret": ("token", "key", "secret", "password", "passwd", "pwd", "api", "apikey", "api_key", "auth", "bearer", "credential", "credentials"),
    "name": ("name", "dear", "by", "from", "signed", "author", "contact", "mr", "mrs", "ms"),
}
#: Gazetteers by kind; top-level domains, word parts of phone numbers, secret prefixes, given names, and words that follow a name in a place.
GAZETTEER = {
    "email": ("com", "org", "net", "edu", "gov", "io", "de", "fr", "es", "uk", "info", "eu", "ch", "at", "it", "nl", "ca", "us", "co", "dev"),
    "phone": ("555", "800", "888", "877", "866", "900"),
    "secret": ("AKIA", "ghp_", "gho_", "sk-", "pk-", "xox", "eyJ", "AIza", "-----"),
    "name": ("James", "Mary", "John", "Patricia", "Robert", "Jennifer", "Michael", "Linda", "David", "Elizabeth", "William", "Barbara", "Richard", "Susan", "Joseph", "Jessica", "Thomas", "Sarah", "Charles", "Karen", "Anna", "Peter", "Hans", "Marie", "Pierre", "Carlos", "Maria", "María", "Juan", "Sofia", "Jürgen", "José", "François", "Julia", "Paul", "Laura", "Daniel", "Emma", "Lucas", "Louis"),
    "place": ("Street", "Road", "Avenue", "Lane", "Square", "Park", "Bridge", "Church", "School", "University", "College", "Hospital", "River", "Airport", "Station", "Straße", "Strasse", "Platz", "Weg", "Rue", "Calle", "Plaza"),
}
GAZETTEER_ROWS = 100_000
#: Titles before a name.
TITLES = "Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Monsieur|Madame|Mme|Mlle|Señor|Señora|Sr|Sra|Don|Doña"
#: Prior of the votes (none, against, for) by labeler: on personal data, and on the rest.
PRIOR = {
    "strict": ((0.30, 0.02, 0.68), (0.80, 0.15, 0.05)),
    "plausible": ((0.04, 0.06, 0.90), (0.04, 0.46, 0.50)),
    "listed": ((0.50, 0.10, 0.40), (0.75, 0.15, 0.10)),
    "cue": ((0.45, 0.05, 0.50), (0.85, 0.05, 0.10)),
    "around": ((0.55, 0.05, 0.40), (0.70, 0.15, 0.15)),
}
#: Prior share of personal data among candidates, and its weight as a share of them.
SHARE, SHARE_WEIGHT = 0.3, 0.1
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++\.([0-9]++)\.([0-9]++)\.([0-9]++)", re.A)
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile("[0-9]")
NOT_DIGIT = re.compile("[^0-9]")
LOOSE_PHONE = re.compile(r"(?<![0-9+.-])\(?[0-9]{2,4}\)?[ ./-][0-9]{2,4}[ ./-][0-9]{2,6}(?:[ ./-][0-9]{2,6})*(?![0-9])")
STRICT_PHONE = re.compile(r"\(?[0-9]{3}\)?[ -][0-9]{3}-[0-9]{4}")
LONG_WORD = re.compile(r"(?<![A-Za-z0-9_+/-])[A-Za-z0-9_+/-]{20,}={0,2}")
HEX = re.compile(r"[0-9a-f]{32,128}|[0-9A-F]{32,128}")
KEY = re.compile(r"AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{20,}|sk-[A-Za-z0-9-]{20,}|xox[abprs]-[A-Za-z0-9-]{10,}|AIza[A-Za-z0-9_-]{30,}|eyJ[A-Za-z0-9_-]{20,}")
SLUG = re.compile(r"(?:[A-Za-z]+[-_/+]|[0-9]{1,4}[-_/+]){2,}[A-Za-z0-9]*")
DATE = re.compile(r"(?:19|20)[0-9]{2}[ ./-][0-9]{1,2}[ ./-][0-9]{1,2}(?![0-9])|[0-9]{1,2}[./-][0-9]{1,2}[./-](?:19|20)[0-9]{2}(?![0-9])")
AT = re.compile(r"[ ]?(?:\(at\)|\[at\]|\{at\})[ ]?|[ ]at[ ]", re.I)
BEFORE_AT = re.compile(r"[A-Za-z0-9._%+-]{1,64}\Z")
AFTER_AT = re.compile(r"[A-Za-z0-9-]+(?:(?:[ ]?(?:\(dot\)|\[dot\]|\{dot\})[ ]?|[ ]dot[ ]|\.)[A-Za-z0-9-]+)+", re.I)
CAPITAL = r"[A-ZÀ-ÖØ-Þ][^\W\d_]+"
TITLED = re.compile(rf"\b(?:{TITLES})\b\.?[ ](?:{CAPITAL}[ ])?{CAPITAL}")
PAIR = re.compile(rf"\b({CAPITAL})[ ]{CAPITAL}")
ANNOUNCED = re.compile(rf"\b(?:[Dd]ear|[Ss]igned(?: by)?:?|[Aa]uthor:)[ ]({CAPITAL}(?:[ ]{CAPITAL})?)")
WORDS_BEFORE = re.compile(r"[\w-]+")
VOTES = 5
MAX_CODES = 6 * 3**VOTES * 4 * 4 * 2
SPAN = "struct<start:int,kind:int,end:int>"
ROW = f"doc_id long, base array<{SPAN}>, found array<struct<start:int,kind:int,end:int,code:int>>"


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (d * 2 - 9 if d > 4 else d * 2)
    return total % 10 == 0


def emails(t: str):
    end, at = 0, t.find("@")
    while at >= 0:
        start = at
        while start > end and t[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(t, at) if start < at else None
        if m:
            end = m.end()
            yield start, end
        at = t.find("@", max(at + 1, end))


def base_spans(t: str) -> list[tuple[int, int, int]]:
    """(start, kind, end), ascending."""
    out = [(a, 0, b) for a, b in emails(t)]
    if DIGIT.search(t):
        for m in IP.finditer(t):
            parts = m.group().split(".")
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in parts):
                out.append((m.start(), 1, m.end()))
        for m in CARD.finditer(t):
            d = NOT_DIGIT.sub("", m.group())
            if 12 <= len(d) <= 19 and luhn(d):
                out.append((m.start(), 2, m.end()))
        for m in PHONE.finditer(t):
            if 9 <= len(NOT_DIGIT.sub("", m.group())) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


def candidate_spans(t: str, lists: dict = GAZETTEER) -> list[tuple[int, int, int]]:
    out, names = [], lists["name"]
    if DIGIT.search(t):
        out += [(m.start(), 3, m.end()) for m in LOOSE_PHONE.finditer(t) if 7 <= len(NOT_DIGIT.sub("", m.group())) <= 15]
        out += [(m.start(), 4, m.end()) for m in LONG_WORD.finditer(t) if DIGIT.search(m.group()) and not m.group().isdigit()]
    for m in AT.finditer(t):
        before = BEFORE_AT.search(t, max(0, m.start() - 64), m.start())
        after = AFTER_AT.match(t, m.end(), m.end() + 256)
        if before and after:
            out.append((before.start(), 0, after.end()))
    out += [(m.start(), 5, m.end()) for m in TITLED.finditer(t)]
    out += [(m.start(), 5, m.end()) for m in PAIR.finditer(t) if m.group(1) in names]
    out += [(m.start(1), 5, m.end(1)) for m in ANNOUNCED.finditer(t)]
    return out


def entropy(s: str) -> float:
    from collections import Counter
    from math import log2

    n = len(s)
    return -sum(c / n * log2(c / n) for c in Counter(s).values())


def votes(t: str, start: int, kind: int, end: int, lists: dict = GAZETTEER) -> list[int]:
    """0 none, 1 against, 2 for; labelers: strict pattern, plausibility, gazetteer, words before, surroundings."""
    s, name = t[start:end], KINDS[kind]
    before = WORDS_BEFORE.findall(t[max(0, start - 32) : start].lower())[-4:]
    if name == "phone":
        strict = 2 if STRICT_PHONE.fullmatch(s) else (1 if DATE.match(s) else 0)
        digits = NOT_DIGIT.sub("", s)
        plain = 2 if 9 <= len(digits) <= 12 else 1
        listed = 2 if any(p in digits[:6] for p in lists[name]) else 0
        around = 1 if start and t[start - 1] in "$€#%/=" or t[end : end + 1] in ("%", "€", "$", "/") else 0
    elif name == "secret":
        strict = 2 if HEX.fullmatch(s) or KEY.fullmatch(s) else (1 if SLUG.fullmatch(s) or s.count("/") > 2 else 0)
        plain = 2 if entropy(s) >= 3.2 else 1
        listed = 2 if s.startswith(tuple(lists[name])) else 0
        around = 2 if start and t[start - 1] in "\"'=:" else 0
    elif name == "email":
        strict = 2 if re.search(r"[(\[{]at[)\]}]|[ ]at[ ].*[ (\[{]dot[ )\]}]", s, re.I) else 0
        plain = 1 if "." not in s and "dot" not in s.lower() else 2
        listed = 2 if re.split(r"[^A-Za-z]+", s.rstrip(")]}"))[-1].lower() in lists[name] else 1
        around = 0
    else:
        place = s.rsplit(" ", 1)[-1] in lists["place"]
        strict = 1 if place else (2 if TITLED.fullmatch(s) else 0)
        plain = 2 if len(s) <= 40 else 1
        listed = 1 if place else (2 if any(w in lists[name] for w in s.split(" ")) else 0)
        around = 0 if start == 0 or t[start - 1].isspace() else 1
    cue = 2 if any(w in CUES[name] for w in before) else 0
    return [strict, plain, listed, cue, around]


def feature_code(t: str, start: int, kind: int, end: int, lists: dict = GAZETTEER) -> int:
    """Votes and coarse features of a span as one number below MAX_CODES."""
    s, code = t[start:end], kind
    for v in votes(t, start, kind, end, lists):
        code = code * 3 + v
    size = min(3, (end - start) // 12)
    digits = min(3, 4 * len(DIGIT.findall(s)) // max(1, len(s)))
    return ((code * 4 + size) * 4 + digits) * 2 + (start > 0 and t[start - 1] in "\"'")


def decode(code: int) -> tuple[int, list[int], list[int]]:
    """kind, votes, features"""
    code, quoted = divmod(code, 2)
    code, digits = divmod(code, 4)
    code, size = divmod(code, 4)
    v = []
    for _ in range(VOTES):
        code, x = divmod(code, 3)
        v.append(x)
    return code, v[::-1], [size, digits, quoted]


def gazetteers(table_: DataFrame | None = None) -> dict[str, frozenset]:
    """The built-in lists and the entries of a table (kind, entry) as sets; the table is read whole, as it is small by its check."""
    out = {k: set(v) for k, v in GAZETTEER.items()}
    if table_ is not None:
        rows = table_.select("kind", "entry").where("entry is not null").limit(GAZETTEER_ROWS + 1).collect()
        if len(rows) > GAZETTEER_ROWS:
            raise ValueError(f"a gazetteer has {GAZETTEER_ROWS} entries at most")
        for r in rows:
            out[r["kind"]].add(r["entry"])
    return {k: frozenset(v) for k, v in out.items()}


def spans(docs: DataFrame, key: str = "doc_id", text: str = "text", gazetteer: DataFrame | None = None) -> DataFrame:
    """Per row: base spans and the candidates that keep clear of them, with their feature codes."""
    sent = docs.sparkSession.sparkContext.broadcast(gazetteers(gazetteer))

    def scan(batches):
        import pyarrow as pa

        schema = pa.schema([("doc_id", pa.int64()), ("base", pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))), ("found", pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32()), ("code", pa.int32())])))])
        lists = sent.value
        for batch in batches:
            base, found = [], []
            for t in batch.column(1):
                t = t.as_py() or ""
                b = base_spans(t)
                taken, out, last = sorted((x[0], x[2]) for x in b), [], 0
                i, reach = 0, 0
                for a, k, e in sorted(candidate_spans(t, lists), key=lambda x: (x[0], -x[2], x[1])):
                    while i < len(taken) and taken[i][0] < e:
                        reach = max(reach, taken[i][1])
                        i += 1
                    if a >= last and a >= reach:
                        out.append({"start": a, "kind": k, "end": e, "code": feature_code(t, a, k, e, lists)})
                        last = e
                base.append([{"start": a, "kind": k, "end": e} for a, k, e in b])
                found.append(out)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(base, schema.field(1).type), pa.array(found, schema.field(2).type)], schema=schema)

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(scan, ROW)


def expectation_maximisation(counts: dict[int, int], rounds: int = 50):
    """code -> probability of being personal data, and reliabilities {kind: P(vote | class)}: labelers are independent given the class.

    The votes' tables are posterior means under PRIOR with the weight of half the kind's candidates, 50 at least, for either class.
    """
    import numpy as np

    prior = np.array([[PRIOR[name][c] for name in PRIOR] for c in (1, 0)])  # classes, labelers, votes
    prob, reliability = {}, {}
    for kind in range(len(KINDS)):
        codes = [c for c in counts if decode(c)[0] == kind]
        if not codes:
            continue
        v = np.array([decode(c)[1] for c in codes])
        n = np.array([counts[c] for c in codes], float)
        weight = max(50.0, 0.5 * n.sum())
        share, tables = SHARE, prior
        for _ in range(rounds):
            log = np.log(tables)
            zero, one = (sum(log[c, j, v[:, j]] for j in range(VOTES)) for c in (0, 1))
            p = 1 / (1 + np.exp(np.clip(zero + np.log(1 - share) - one - np.log(share), -30, 30)))
            share = ((n * p).sum() + SHARE * SHARE_WEIGHT * n.sum()) / (n.sum() * (1 + SHARE_WEIGHT))
            seen = np.stack([[[(n * w * (v[:, j] == x)).sum() for x in range(3)] for j in range(VOTES)] for w in (1 - p, p)])
            tables = seen + weight * prior
            tables /= tables.sum(2, keepdims=True)
        reliability[kind] = tables
        prob |= dict(zip(codes, p.tolist()))
    return prob, reliability


def _design(codes: list[int]):
    import numpy as np

    rows = np.zeros((len(codes), len(KINDS) * (1 + 2 * VOTES) + 4 + 4 + 1))
    for r, c in enumerate(codes):
        kind, v, (size, digits, quoted) = decode(c)
        at = kind * (1 + 2 * VOTES)
        rows[r, at] = 1
        for j, x in enumerate(v):
            if x:
                rows[r, at + 2 * j + x] = 1
        rows[r, -9 + size] = 1
        rows[r, -5 + digits] = 1
        rows[r, -1] = quoted
    return rows


def train(counts: dict[int, int], threshold: float = 0.5) -> list[int]:
    """Codes of the spans that the final classifier accepts; trained on every candidate, by counts."""
    import numpy as np

    if not counts:
        return []
    prob, _ = expectation_maximisation(counts)
    codes = sorted(counts)
    x, y, n = _design(codes), np.array([prob[c] for c in codes]), np.array([counts[c] for c in codes], float)
    n = n / n.sum()
    w = np.zeros(x.shape[1])
    for _ in range(25):  # Newton steps with a small ridge
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (n * (p - y)) + 1e-4 * w
        hess = (x * (n * p * (1 - p))[:, None]).T @ x + 1e-4 * np.eye(x.shape[1])
        w -= np.linalg.solve(hess, grad)
    p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
    return [c for c, q in zip(codes, p) if q >= threshold]


def joined(spans_: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans_, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def find_pii(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = 0.5, gazetteer: DataFrame | None = None) -> DataFrame:
    """Per row: doc_id, base and all spans as array<struct<start, kind (place in KINDS), end>>, ascending."""
    got = table(spans(docs, key, text, gazetteer), "pii-spans")
    codes = got.select(F.explode("found.code").alias("code")).groupBy("code").agg(F.count(F.lit(1)).alias("n"))
    accepted = train({r["code"]: r["n"] for r in codes.collect()}, threshold)  # at most MAX_CODES rows
    ok = F.array(*[F.lit(c) for c in accepted]).cast("array<int>")
    more = F.transform(F.filter("found", lambda s: F.array_contains(ok, s["code"])), lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))
    return got.select("doc_id", "base", F.sort_array(F.concat("base", more)).alias("spans"))
