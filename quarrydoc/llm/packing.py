"""Best-fit packing of token sequences by the sum-of-squares rule.

Every document becomes its token ids and a closing id; only documents longer than a
sequence are cut, into full pieces and one tail. Each piece goes where the sum over gaps g of
N(g)^2 becomes smallest, N(g) being the number of open sequences with g free tokens (a new
sequence is one of the choices, and full ones do not count).

Only counts steer the choice, and pieces of one length are alike: so the whole corpus is packed from its
counts per length, at most `length` numbers on the driver. Up to `grain` * `length` pieces are placed one by one. Of larger corpora
the rule places lumps: so many pieces of one length at once, a power of two, that no more than `grain` * `length` lumps are
made; what that leaves of each length follows in lumps a 32nd of the size, down to single pieces. A lump is placed by the change
that all its pieces make. So there are at most (grain + 32 * rounds) * length lumps, and rounds grow with the logarithm of the
corpus. The rule does not say in which order pieces come; the plan is made in each of ORDERS, and the one with fewest sequences holds.
Sequences of equal gap are intervals of numbers, so a step is one row: (length, first piece, how many, first sequence, offset). Pieces find
their step by their place among those of their length: running counts in hash buckets, so that no length is one task.

Defined results: null text is an empty document, one closing id; pieces of one length take their places by
(hash, id, piece, checksum); repeated rows are packed each on their own; an empty table gives no
sequences; very long texts are cut into pieces; other columns are ignored.
"""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucket_bits, hash_bucket, prefix_sums, table
from .tokenizing import word_tokenizer

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
BIG = 2**62
#: Orders in which a plan is tried, as (share, tail) of `lumps`.
ORDERS = ((1, 0.0), (4, 0.1), (6, 0.1), (8, 0.1))
#: Lumps become smaller by this factor from round to round.
FALL = 32


def pieces(docs: DataFrame, tokenizer: str, length: int = 2048, end_id: int = 0, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per piece of each document."""
    closing = end_id.to_bytes(4, "little")

    def cut(batches):
        import pyarrow as pa

        encode = word_tokenizer(tokenizer).encode
        for batch in batches:
            ids, nos, starts, sizes, crcs = [], [], [], [], []
            for doc, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                data = encode(t.as_py() or "") + closing
                for no, at in enumerate(range(0, len(data), 4 * length)):
                    part = data[at : at + 4 * length]
                    ids.append(doc)
                    nos.append(no)
                    starts.append(at // 4)
                    sizes.append(len(part) // 4)
                    crcs.append(zlib.crc32(part))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(nos, pa.int32()), pa.array(starts, pa.int64()), pa.array(sizes, pa.int64()), pa.array(crcs, pa.int64())], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(cut, PIECES)


class _Open:
    """Open sequences: how many per gap, and which, as intervals of numbers."""

    def __init__(self, length: int) -> None:
        import numpy as np

        self.length, self.counts = length, np.zeros(length + 1, np.int64)
        self.intervals: list[list[tuple[int, int]]] = [[] for _ in range(length + 1)]

    def put(self, gap: int, start: int, n: int) -> None:
        if gap:
            self.counts[gap] += n
            self.intervals[gap].append((start, n))

    def take(self, gap: int, n: int):
        """Intervals of n sequences of that gap, no longer open."""
        self.counts[gap] -= n
        while n:
            start, have = self.intervals[gap].pop()
            got = min(n, have)
            if have > got:
                self.intervals[gap].append((start + got, have - got))
            yield start, got
            n -= got


def _choice(at: _Open, s: int, k: int = 1) -> int:
    """The gap that k pieces of size s go to, so that the sum of squares becomes smallest; a gap of `length` is k new sequences."""
    n, length = at.counts, at.length
    # half the change over k: N(g) falls by k, N(g - s) rises by k (not at 0)
    change = 2 * (n[: length + 1 - s] - n[s:]) + 2 * k
    change[0] = k - 2 * n[s]
    change[n[s:] == 0] = BIG
    best = int(change.argmin())
    fresh = 2 * int(n[length - s]) + k if s < length else 0
    return length if change[best] > fresh else best + s


def sum_of_squares(sizes, length: int):
    """Sequence number and offset for each of `sizes`, in the order given, and how full each sequence is."""
    import numpy as np

    at, seqs, offsets, fill = _Open(length), [], [], []
    for s in map(int, sizes):
        gap = _choice(at, s)
        if gap == length:
            fill.append(0)
            seq = len(fill) - 1
        else:
            ((seq, _),) = at.take(gap, 1)
        seqs.append(seq)
        offsets.append(length - gap)
        fill[seq] += s
        at.put(gap - s, seq, 1)
    return np.array(seqs, np.int64), np.array(offsets, np.int64), np.array(fill, np.int64)


def lumps(counts: dict[int, int], unit: int, length: int, share: int, tail: float):
    """(size, unit) for every `unit` pieces of a size: sizes above length / share longest first, the others evenly mixed, but for their
    last `tail`, longest first again. A share of 1 is longest first throughout."""
    out = []
    for s, n in counts.items():
        many = n // unit
        for i in range(many):
            at = (2 * i + 1) / (2 * many)
            out.append((0, 0.0, -s) if share == 1 or s * share > length else (1, at, -s) if at < 1 - tail else (2, 0.0, -s))
    return [(-s, unit) for _, _, s in sorted(out)]


def _planned(counts: dict[int, int], length: int, grain: int, share: int, tail: float) -> tuple[int, list[tuple[int, int, int, int, int]]]:
    """Sequences used, and the steps of `plan`, in one order."""
    at, fresh, steps = _Open(length), 0, []
    unit, placed = 1, dict.fromkeys(counts, 0)
    while sum(counts.values()) > unit * grain * length:
        unit *= 2
    while unit:
        for s, k in lumps({s: n - placed[s] for s, n in counts.items()}, unit, length, share, tail):
            # counts of open sequences are multiples of the unit, so the gap has room for all k
            gap = _choice(at, s, k)
            if gap == length:
                taken = [(fresh, k)]
                fresh += k
            else:
                taken = list(at.take(gap, k))
            for start, got in taken:
                at.put(gap - s, start, got)
                last = steps[-1] if steps else None
                if last and last[0] == s and last[1] + last[2] == placed[s] and last[3] + last[2] == start and last[4] == length - gap:
                    steps[-1] = (s, last[1], last[2] + got, last[3], last[4])
                else:
                    steps.append((s, placed[s], got, start, length - gap))
                placed[s] += got
        unit = unit // FALL or (1 if unit > 1 else 0)
    return fresh, steps


def plan(counts: dict[int, int], length: int, grain: int = 32, orders=ORDERS) -> list[tuple[int, int, int, int, int]]:
    """Steps (size, first piece, how many, first sequence, offset) that place counts[size] pieces of each size, in the order of `orders` that takes fewest sequences."""
    return min((_planned(counts, length, grain, *o) for o in orders), key=lambda p: p[0])[1]


def pack(found: DataFrame, length: int = 2048, grain: int = 32) -> DataFrame:
    """found (PIECES) plus sequence_id and offset."""
    import numpy as np

    sizes = {r["length"]: r["n"] for r in found.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most `length` rows
    steps = plan(sizes, length, grain)
    # one key for size and place among its pieces, so that one search finds the step
    rows = np.array([(s << 44) + first for s, first, *_ in steps], np.int64)
    order = np.argsort(rows, kind="stable")
    sent = found.sparkSession.sparkContext.broadcast((rows[order], np.array([x[3] for x in steps], np.int64)[order], np.array([x[4] for x in steps], np.int64)[order]))

    def place(batches):
        import numpy as np
        import pyarrow as pa

        first, seq, offset = sent.value
        for batch in batches:
            key = (np.asarray(batch.column(3)) << 44) + np.asarray(batch.column(5))
            step = np.searchsorted(first, key, "right") - 1
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(seq[step] + key - first[step]), pa.array(offset[step])], names=[*batch.schema.names[:5], "sequence_id", "offset"])

    d = found.withColumns({"_h": F.xxhash64("doc_id", "piece", "ids_crc32"), "_one": F.lit(1).cast("long")})
    bits = bucket_bits(sum(sizes.values()))
    d = prefix_sums(d, ["length"], "_h", "_one", "_place", hash_bucket(F.col("_h"), bits), ["doc_id", "piece", "ids_crc32"])
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    return d.select(*names, F.col("_place").cast("long")).mapInArrow(place, PIECES + ", sequence_id long, offset long")


def best_fit_packing(docs: DataFrame, tokenizer: str, length: int = 2048, end_id: int = 0, **options) -> DataFrame:
    """Pieces of all documents with their sequence and place in it."""
    return pack(table(pieces(docs, tokenizer, length, end_id), "pieces"), length, **options)
