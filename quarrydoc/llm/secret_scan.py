"""Secrets: base patterns plus encoded keys and signed tokens that hold together when they are decoded.

Base spans (assigned values, access key ids, long hex) follow fixed patterns and always stay. Candidates for more are runs of base64,
base64url or hex characters. None is reported by its looks: it is decoded and must be, to its last byte,

* `pem`: an armoured private key whose body is one of the structures below (or the encrypted form that its header names),
* `der`: a private key as nested tag-length-value elements (PKCS#1, PKCS#8, plain or encrypted, SEC1, DSA), base64 or hex,
* `ssh`: an OpenSSH private key, whose lengths nest to its end, base64 or hex,
* `jwt`: a signed or encrypted compact token, whose header names an algorithm and whose signature has that algorithm's length.

Base64 of an armoured key counts as `pem`. Public keys, certificates and random bytes are no secrets of these kinds.
A key that stands inside other characters of the same alphabet is found from where its encoding begins. What follows a beginning is
decoded up to the length that it claims, and only if that fits, its first element does too, and it is no more than `KEY_BYTES`.

Offsets are code points, ends exclusive. Defined results: null text is empty and has no spans; each row is treated on its own, whatever its id
(null or repeated); added spans may lie over base spans but not over each other (the earlier, then the longer one stays);
an empty table gives no rows; very long texts are read whole; other columns are ignored.
"""

from __future__ import annotations

import base64
import binascii
import json
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Base kinds in their listed order, then the kinds that only the method finds.
KINDS = ("assign", "access", "hex", "pem", "der", "ssh", "jwt")
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}")
ANY_HEX = re.compile(r"(?<![0-9A-Fa-f])[0-9A-Fa-f]{64,}")
PEM = re.compile(r"-----BEGIN ((?:[A-Z0-9]+ )*PRIVATE KEY)-----((?:[^-]|-(?!----))*)-----END \1-----")
PEM_HEADER = re.compile(r"\s*Proc-Type: *4, *ENCRYPTED\s+DEK-Info: *([A-Z0-9-]+), *([0-9A-Fa-f]+)\s+")
#: Where a key's encoding can begin: a DER sequence (0x30 and a length of one, two or three bytes), the OpenSSH magic, an armour, a header.
BEGINS = re.compile(r"M[A-P]|b3BlbnNzaC1rZXktdjE|LS0tLS1CRUdJTi")
BASE64 = re.compile(r"[A-Za-z0-9+/_-]{32,}={0,2}")
#: A JSON object's brace and what may follow it, in base64url, and up to four further parts.
JWT = re.compile(r"(?<![A-Za-z0-9_-])e[wy][A-Za-z0-9_-]{10,}(?:\.[A-Za-z0-9_-]*){2,4}")
OPENSSH = b"openssh-key-v1\x00"
#: Bytes of a signature by algorithm (RSA: at least so many).
SIGNATURES = {"HS256": 32, "HS384": 48, "HS512": 64, "ES256": 64, "ES256K": 64, "ES384": 96, "ES512": 132, "EdDSA": 64}
RSA_ALGORITHMS = ("RS256", "RS384", "RS512", "PS256", "PS384", "PS512")
RSA_BYTES = 128
#: Object identifiers of private keys (RSA, RSASSA-PSS, DSA, DH, EC, X25519, X448, Ed25519, Ed448) and of password-based encryption.
KEY_OIDS = {bytes.fromhex(x) for x in ("2a864886f70d010101", "2a864886f70d01010a", "2a8648ce380401", "2a864886f70d010301", "2a8648ce3d0201", "2b656e", "2b656f", "2b6570", "2b6571")}
PBE_PREFIXES = (bytes.fromhex("2a864886f70d0105"), bytes.fromhex("2a864886f70d010c01"))
#: No private key is longer, so no more is decoded from any beginning.
KEY_BYTES = 2**16
WORD = bytes(b if chr(b).isalnum() and b < 128 or b in b"+/_-=." else 32 for b in range(256))
LOWER_HEX = bytes(104 if b in b"0123456789abcdef" else 32 for b in range(256))
SPAN = "struct<start:int,kind:int,end:int>"


class Broken(Exception):
    """What was read is not the structure looked for."""


class Elements:
    """Nested tag-length-value elements of `data[at:end]`, read one by one; every length must fit into its surroundings."""

    def __init__(self, data: bytes, at: int, end: int):
        self.data, self.at, self.end = data, at, end

    def next(self, tag: int | None = None) -> tuple[int, int, int]:
        """(tag, start, end) of the next element's content."""
        d, at = self.data, self.at
        if at + 2 > self.end or (tag is not None and d[at] != tag):
            raise Broken
        found, n, at = d[at], d[at + 1], at + 2
        if n >= 0x80:
            size = n & 0x7F
            if not 1 <= size <= 3 or at + size > self.end:
                raise Broken
            n, at = int.from_bytes(d[at : at + size], "big"), at + size
            if n < 0x80 or n < 1 << 8 * (size - 1):  # lengths have no other form
                raise Broken
        if at + n > self.end:
            raise Broken
        self.at = at + n
        return found, at, at + n

    def inner(self, tag: int) -> Elements:
        _, a, b = self.next(tag)
        return Elements(self.data, a, b)

    def number(self) -> int:
        """A non-negative INTEGER in its shortest form: its bits."""
        _, a, b = self.next(0x02)
        if a == b or self.data[a] & 0x80 or (b - a > 1 and self.data[a] == 0 and not self.data[a + 1] & 0x80):
            raise Broken
        return int.from_bytes(self.data[a:b], "big").bit_length()

    def octets(self, tag: int = 0x04) -> bytes:
        _, a, b = self.next(tag)
        return self.data[a:b]

    @property
    def over(self) -> bool:
        return self.at == self.end

    def done(self) -> None:
        if not self.over:
            raise Broken


def private_key(data: bytes) -> str:
    """Which private key `data` is, from its first to its last byte."""
    whole = Elements(data, 0, len(data))
    seq = whole.inner(0x30)
    whole.done()
    if seq.at < seq.end and data[seq.at] == 0x30:
        algorithm = seq.inner(0x30)
        if not algorithm.octets(0x06).startswith(PBE_PREFIXES):
            raise Broken
        algorithm.inner(0x30)
        algorithm.done()
        if len(seq.octets()) < 16:
            raise Broken
        seq.done()
        return "encrypted"
    version = seq.next(0x02)
    if version[2] - version[1] != 1 or data[version[1]] > 1:
        raise Broken
    version = data[version[1]]
    if seq.over:
        raise Broken
    tag = data[seq.at]
    if tag == 0x30:
        algorithm = seq.inner(0x30)
        if algorithm.octets(0x06) not in KEY_OIDS:
            raise Broken
        while not algorithm.over:
            algorithm.next()
        key = seq.octets()
        if len(key) < 16:
            raise Broken
        if key[0] in (0x30, 0x04, 0x02):  # RSA and EC keys are sequences, Edwards and Montgomery keys octets, the others numbers
            inner = Elements(key, 0, len(key))
            inner.next()
            inner.done()
        else:
            raise Broken
        while not seq.over:
            if seq.next()[0] not in (0xA0, 0xA1, 0x81):
                raise Broken
        return "pkcs8"
    if tag == 0x04:
        if version != 1 or not 20 <= len(seq.octets()) <= 72 or seq.over:
            raise Broken
        while not seq.over:
            if seq.next()[0] not in (0xA0, 0xA1):
                raise Broken
        return "sec1"
    numbers = []
    while not seq.over and data[seq.at] == 0x02:
        numbers.append(seq.number())
    if version == 1 and numbers and not seq.over:
        seq.inner(0x30)  # further primes
    seq.done()
    if len(numbers) == 8 and numbers[0] >= 512 and abs(numbers[3] + numbers[4] - numbers[0]) <= 1:
        return "rsa"
    if len(numbers) == 5 and numbers[0] >= 512 and numbers[1] <= 512 and numbers[4] <= numbers[1]:
        return "dsa"
    raise Broken


def openssh_key(data: bytes) -> int:
    """Bytes of the OpenSSH private key at the start of `data`."""

    def string(at: int) -> tuple[bytes, int]:
        n = int.from_bytes(data[at : at + 4], "big")
        if at + 4 > len(data) or at + 4 + n > len(data):
            raise Broken
        return data[at + 4 : at + 4 + n], at + 4 + n

    if not data.startswith(OPENSSH):
        raise Broken
    cipher, at = string(len(OPENSSH))
    kdf, at = string(at)
    options, at = string(at)
    keys, at = int.from_bytes(data[at : at + 4], "big"), at + 4
    if keys != 1 or not cipher.isascii() or (cipher == b"none") != (kdf == b"none") or (kdf == b"none") != (options == b""):
        raise Broken
    public, at = string(at)
    secret, at = string(at)
    kind = int.from_bytes(public[:4], "big")
    if not 4 <= kind <= 64 or not public[4 : 4 + kind].isascii() or len(secret) < 16 or len(secret) % 8:
        raise Broken
    if cipher == b"none" and (secret[:4] != secret[4:8] or secret[8 : 12 + kind] != public[: 4 + kind]):
        raise Broken
    return at


def decoded(s: str) -> bytes:
    """Bytes of base64 or base64url; the padding may be left away."""
    s = s.rstrip("=")
    if len(s) % 4 == 1:
        raise Broken
    try:
        return base64.b64decode(s.translate({45: 43, 95: 47}) + "=" * (-len(s) % 4), validate=True)
    except (binascii.Error, ValueError):
        raise Broken from None


def armoured(label: str, body: str) -> None:
    """The body of an armoured private key is a private key."""
    header = PEM_HEADER.match(body)
    if header:
        data = decoded("".join(body[header.end() :].split()))
        if len(data) < 32 or len(data) % 8 or len(header[2]) not in (16, 32):
            raise Broken
        return
    if "\\n" in body or "\\r" in body:  # as in JSON
        body = body.replace("\\r", "").replace("\\n", " ")
    data = decoded("".join(body.split()))
    if label.startswith("OPENSSH "):
        if openssh_key(data) != len(data):
            raise Broken
    else:
        private_key(data)


def key_at(s: str, at: int) -> tuple[str, int]:
    """(kind, end) of the key whose base64 begins at `at` of a run of base64 characters."""
    head = s[at : at + 32]
    if head.startswith("LS0t"):
        text = decoded(_whole(s[at : at + 4 * KEY_BYTES // 3])).decode("latin-1")
        m = PEM.match(text)
        if not m:
            raise Broken
        armoured(m[1], m[2])
        size, kind = m.end() + len(text[m.end() :]) - len(text[m.end() :].lstrip()), "pem"
    elif head.startswith("b3Bl"):
        data = decoded(_whole(s[at : at + 4 * KEY_BYTES // 3]))
        size, kind = openssh_key(data), "ssh"
    else:
        front = decoded(_whole(head))
        size = front[1] + 2
        if front[1] >= 0x80:
            n = front[1] & 0x7F
            size = int.from_bytes(front[2 : 2 + n], "big") + 2 + n
            if not 1 <= n <= 2 or size > KEY_BYTES:
                raise Broken
        if size < 40 or front[0] != 0x30 or 4 * size > 3 * (len(s) - at) + 6:
            raise Broken
        first = 2 + (front[1] & 0x7F if front[1] >= 0x80 else 0)
        if front[first] not in (0x02, 0x30) or (front[first] == 0x02 and front[first + 1] != 1):
            raise Broken
        private_key(decoded(s[at : at + (4 * size + 2) // 3])[:size])
        kind = "der"
    end = at + (4 * size + 2) // 3
    while end < len(s) and s[end] == "=":
        end += 1
    return kind, end


def _whole(s: str) -> str:
    s = s.rstrip("=")
    return s[: len(s) - (len(s) % 4 == 1)]


def signed_token(parts: list[str]) -> None:
    """A compact token: header, payload and signature (or the five parts of an encrypted one) decode to what they must be."""
    try:
        header = json.loads(decoded(parts[0]).decode())
    except (ValueError, RecursionError):
        raise Broken from None
    if not isinstance(header, dict) or not isinstance(header.get("alg"), str):
        raise Broken
    if len(parts) == 5:
        if not isinstance(header.get("enc"), str) or any(not x and i != 1 for i, x in enumerate(parts)):
            raise Broken
        for x in parts[1:]:
            decoded(x)
    elif len(parts) == 3:
        signature, alg = len(decoded(parts[2])), header["alg"]
        if parts[1] and header.get("b64", True) is not False:
            decoded(parts[1])
        if signature == 0 or SIGNATURES.get(alg, signature) != signature or (alg in RSA_ALGORITHMS and signature < RSA_BYTES):
            raise Broken
    else:
        raise Broken


def base_spans(t: str, b: bytes) -> list[tuple[int, int, int]]:
    """(start, kind, end), ascending. b: the text's bytes in lower case."""
    out = []
    if any(w in b for w in (b"passw", b"secret", b"token", b"api")):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 8]
    if "AKIA" in t:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(t) if m.end() - m.start() >= 16]
    if b"h" * 32 in t.encode("utf-8", "surrogatepass").translate(LOWER_HEX):
        out += [(m.start(), 2, m.end()) for m in HEX.finditer(t)]
    return sorted(out)


def confirmed_spans(t: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of what decodes to a secret, ascending and without overlap."""
    found = []

    def confirm(kind: str, start: int, end: int, check, *args) -> None:
        try:
            check(*args)
        except (Broken, IndexError):
            return
        found.append((start, KINDS.index(kind), end))

    for m in PEM.finditer(t) if "-----BEGIN " in t else ():
        confirm("pem", m.start(), m.end(), armoured, m[1], m[2])
    for m in JWT.finditer(t) if "." in t else ():
        parts = m.group().split(".")
        for n in (5, 3):  # what follows the last part, as the end of a sentence does, is no part
            if len(parts) >= n:
                confirm("jwt", m.start(), m.start() + len(".".join(parts[:n])), signed_token, parts[:n])
    for m in BASE64.finditer(t):
        s, at = m.group(), 0
        while begin := BEGINS.search(s, at):
            at = begin.start() + 1
            try:
                kind, end = key_at(s, begin.start())
            except (Broken, IndexError):
                continue
            found.append((m.start() + begin.start(), KINDS.index(kind), m.start() + end))
            at = end
    for m in ANY_HEX.finditer(t):
        for begin in re.finditer(r"30|6f70656e7373682d6b65792d763100", m.group(), re.I):
            s = m.group()[begin.start() : begin.start() + 2 * KEY_BYTES]
            s = s[: len(s) // 2 * 2]
            try:
                if begin.group() != "30":
                    found.append((m.start() + begin.start(), KINDS.index("ssh"), m.start() + begin.start() + 2 * openssh_key(bytes.fromhex(s))))
                else:
                    size = hex_key(s)
                    found.append((m.start() + begin.start(), KINDS.index("der"), m.start() + begin.start() + 2 * size))
            except (Broken, IndexError):
                continue
    out, last = [], 0
    for a, k, e in sorted(found, key=lambda x: (x[0], -x[2], x[1])):
        if a >= last:
            out.append((a, k, e))
            last = e
    return out


def hex_key(s: str) -> int:
    """Bytes of the private key whose hex begins `s`."""
    front = bytes.fromhex(s[:16])
    size, first = front[1] + 2, 2
    if front[1] >= 0x80:
        n = front[1] & 0x7F
        if not 1 <= n <= 2:
            raise Broken
        size, first = int.from_bytes(front[2 : 2 + n], "big") + 2 + n, 2 + n
    if not 40 <= size <= len(s) // 2 or front[first] not in (0x02, 0x30) or (front[first] == 0x02 and front[first + 1] != 1):
        raise Broken
    private_key(bytes.fromhex(s[: 2 * size]))
    return size


def secret_spans(t: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(base, added) spans of a text as (start, kind, end). Long words alone are decoded; most texts have none."""
    b = t.encode("utf-8", "surrogatepass")
    base = base_spans(t, b.lower())
    long = max(map(len, b.translate(WORD).split()), default=0) >= 32 or "-----BEGIN " in t
    return base, confirmed_spans(t) if long else []


def find_secrets(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, base and all spans as array<struct<start, kind (place in KINDS), end>>, ascending."""

    def scan(batches):
        import pyarrow as pa

        kind = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))
        as_rows = lambda spans: [{"start": a, "kind": k, "end": e} for a, k, e in spans]
        for batch in batches:
            base, every = [], []
            for t in batch.column(1):
                own, added = secret_spans(t.as_py() or "")
                base.append(as_rows(own))
                every.append(as_rows(sorted(own + added)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(base, kind), pa.array(every, kind)], names=["doc_id", "base", "spans"])

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(scan, f"doc_id long, base array<{SPAN}>, spans array<{SPAN}>")


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
