"""N-gram Jaccard join by count-vector R-trees: exact links, components of near copies.

Every document's word shingles are hashed; its set of hashes is a point whose coordinates
are the numbers of hashes in groups, `GROUPS` or as many more as leave about `PER_GROUP` hashes to each. For two points the summed coordinate minima
bound the overlap from above, and for two tree nodes the minima of their upper corners do so
for all pairs below, so an R-tree packed by size and widest coordinate prunes what cannot reach the similarity.
Trees stand on `GROUPS` coordinates; pairs that pass are bounded again on all that both points have.

The forest. Equal sets are one point (the smallest id stands for all). Sets that reach the
similarity share one of their first n - ceil(s n) + 1 hashes in any one order of all hashes, so each of those
hashes is a cell, and points are compared only within cells; cells of one point vanish. The order is that of the hashes, but hot
ones come last: those that at least half of `HOT_SHARE` of all documents hold. The first scan counts the hashes of all documents, chunk by chunk, and names those held by `HOT_SHARE` of a chunk,
so none with that share of the whole is missed; documents with a hot hash among their first are scanned again. So a passage that a third
of all documents share makes no cell, but in documents that hold little else. Cells of
more than `UNIT` points are dealt out in units of about so many, by hash of the id, so no hash is one task's work.

Round one pairs each point with its nearest earlier point in a unit (a forest of pairs,
not all of a group's); the first points of a large cell's units meet in one unit more. The pairs are verified on the full sets, and links give components.
Round two searches again for every pair within the bound whose ends are not yet
connected (nodes that hold one and the same component are skipped whole), verifies them,
and joins the components. In a large cell the points of its largest component need no comparison with each
other: each of their units meets each unit of the other points, and those meet among themselves. A pair that links is thus either verified or inside a component
already, so components are exact, and a group of g near copies costs about g pairs.

Verification reads documents a second time: a fixed-size bitmap (`BITS`) of the ids in
question, whatever the corpus, lets most others pass by unhashed; the joins after it are exact.

Defined results: null text, or text without words, has an empty set and no links; texts of fewer words than
`width` are one shingle; rows with one id are one document (its text the one with the smallest
hash); null ids are taken as the smallest id; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import functools
import zlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, hinted, table
from .components import components

#: Coordinates of the tree's points; hashes per group beyond which a set gets more groups.
GROUPS, PER_GROUP = 128, 8
#: Points of a unit of a large cell; rows of cells that one task of the search takes.
UNIT, TASK_ROWS = 2048, 200_000
#: Share of documents from which a hash is hot; hashes of a chunk.
HOT_SHARE, CHUNK = 0.004, 2_000_000
LEAF = 32
FANOUT = 8
BITS = 2**22
MIN_LONG = -(2**63)
MULT = 0x9E3779B97F4A7C15
CACHE_WORDS = 400_000


class _WordHashes(dict):
    """64-bit hashes of words, each computed once per worker; starts afresh when full."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= CACHE_WORDS:
            self.clear()
        h = xxhash.xxh64_intdigest(word)
        if len(word) <= 64:
            self[word] = h
        return h


@functools.lru_cache(maxsize=1)
def _hashes() -> _WordHashes:
    return _WordHashes()


def shingle_set(text: str | None, width: int):
    """Ascending distinct 64-bit hashes of the text's shingles (A-Z lower-cased, ASCII white space between words)."""
    import numpy as np

    ws = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not ws:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_hashes().__getitem__, ws), np.uint64, len(ws))
    k = min(width, len(ws))
    out = np.full(len(ws) - k + 1, k, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(k):
            out = (out ^ h[i : len(h) - k + 1 + i]) * np.uint64(MULT)
            out ^= out >> np.uint64(29)
        out *= np.uint64(0xBF58476D1CE4E5B9)
        out ^= out >> np.uint64(32)
    return np.unique(out)


def packed_counts(hashes) -> bytes:
    """Counts per group, as many groups as the size calls for; coarser ones are sums of strides of them."""
    import numpy as np

    size = GROUPS
    while size * PER_GROUP < len(hashes):
        size *= 2
    return zlib.compress(np.bincount((hashes >> np.uint64(17)).astype(np.int64) % size, minlength=size).astype("<u4").tobytes(), 1)


def counts_of(data: bytes):
    import numpy as np

    return np.frombuffer(zlib.decompress(data), "<u4").astype(np.int32)


def folded(counts, size: int):
    """The counts of `size` groups, a divisor of theirs."""
    return counts if len(counts) == size else counts.reshape(-1, size).sum(axis=0, dtype=counts.dtype)


def prefix_size(n: int, percent: int) -> int:
    return n + (-percent * n // 100) + 1 if n else 0


def points(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """doc, th (hash of the text), n, s1, s2 (signature of the set), vec (group counts), prefix (hashes); packed as little-endian bytes.

    Rows with n = -1 are no documents: they hold hashes (prefix) that many documents of a chunk hold, and their numbers (vec).
    """
    share, chunk = HOT_SHARE, CHUNK

    def scan(batches):
        import numpy as np
        import pyarrow as pa
        import xxhash

        names = ["doc", "th", "n", "s1", "s2", "vec", "prefix"]
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
        held, size = [], 0

        def heavy():
            h, c = np.unique(np.concatenate(held), return_counts=True)
            ok = c >= max(2, share * len(held))
            row = (None, None, -1, None, None, c[ok].astype("<i8").tobytes(), h[ok].tobytes())
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], names=names)

        for batch in batches:
            n, s1, s2, vec, prefix = [], [], [], [], []
            for t in batch.column(2):
                s = shingle_set(t.as_py(), width)
                n.append(len(s))
                d = xxhash.xxh128_intdigest(s.tobytes())
                s1.append((d >> 64) - 2**63)
                s2.append((d & (2**64 - 1)) - 2**63)
                vec.append(packed_counts(s))
                prefix.append(s[: prefix_size(len(s), percent)].tobytes())
                held.append(s)
                size += len(s)
                if size >= chunk:
                    yield heavy()
                    held, size = [], 0
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array(v, k) for v, k in zip((n, s1, s2, vec, prefix), kinds[2:])]], names=names)
        if size:
            yield heavy()

    return docs.mapInArrow(scan, "doc long, th long, n int, s1 long, s2 long, vec binary, prefix binary")


def hot_hashes(every: DataFrame, n_docs: int):
    """Ascending hashes (unsigned) that at least half of HOT_SHARE of all documents hold, two at least.

    There are at most 2 / HOT_SHARE times as many as an average set has hashes, however many documents there are.
    """
    import numpy as np

    def unpack(batches):
        import pyarrow as pa

        for batch in batches:
            for c, h in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(h, np.int64)), pa.array(np.frombuffer(c, np.int64))], names=["h", "c"])

    found = every.where("n < 0").select("vec", "prefix").mapInArrow(unpack, "h long, c long")
    rows = found.groupBy("h").agg(F.sum("c").alias("c")).where(F.col("c") >= max(2, HOT_SHARE * n_docs / 2)).collect()
    return np.sort(np.array([r["h"] for r in rows], np.int64).view(np.uint64))


def _among(values, ascending):
    import numpy as np

    if not len(ascending):
        return np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(ascending, values), len(ascending) - 1)
    return ascending[at] == values


def cells(reps: DataFrame, hot=None, touched: bool = False) -> DataFrame:
    """(h, doc): one row per point and prefix hash, without the points that have hot ones; or, if touched, (doc) of just those."""
    sent = reps.sparkSession.sparkContext.broadcast(hot) if hot is not None and len(hot) else None

    def spread(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            docs = np.asarray(batch.column(0))
            hs = [np.frombuffer(p, np.int64) for p in batch.column(1).to_pylist()]
            flat = np.concatenate(hs) if hs else np.empty(0, np.int64)
            at = np.repeat(np.arange(len(hs)), [len(x) for x in hs])
            if sent is not None:
                hit = np.bincount(at, _among(flat.view(np.uint64), sent.value), minlength=len(hs)) > 0
                if touched:
                    yield pa.RecordBatch.from_arrays([pa.array(docs[hit])], names=["doc"])
                    continue
                flat, at = flat[~hit[at]], at[~hit[at]]
            yield pa.RecordBatch.from_arrays([pa.array(flat), pa.array(docs[at])], names=["h", "doc"])

    return reps.select("doc", "prefix").mapInArrow(spread, "doc long" if touched else "h long, doc long")


def ordered_cells(vectors: DataFrame, base: DataFrame, live: DataFrame, hot, width: int, percent: int) -> DataFrame:
    """(h, doc) with hot hashes last in the order: points without any among their first keep them, the others are scanned again."""
    if not len(hot):
        return cells(vectors)
    sent = vectors.sparkSession.sparkContext.broadcast(hot)

    def first(s):
        import numpy as np

        late = _among(s, sent.value)
        return np.concatenate([s[~late], s[late]])[: prefix_size(len(s), percent)]

    ids = table(cells(vectors, hot, touched=True), "ngram-touched")
    again = sets_of(base, ids, width, first).join(hinted(ids), "doc", "left_semi").join(live, ["doc", "th"], "left_semi").dropDuplicates(["doc"])
    again = table(again.select(F.explode("set").alias("h"), "doc"), "ngram-late-cells")
    discard(ids)
    return cells(vectors, hot).unionByName(again)


def shared_cells(emitted: DataFrame) -> DataFrame:
    """(h, doc, c, first): rows of cells of c points, two or more; first is the smallest of them.

    Counted with map-side combine and joined back, so that a hot cell's rows can be split among tasks.
    """
    by = emitted.groupBy("h").agg(F.count(F.lit(1)).alias("c"), F.min("doc").alias("first")).where("c > 1")
    return emitted.join(by, "h")


def _part(c: Column, doc: str = "doc") -> Column:
    return F.pmod(F.xxhash64(doc, F.lit(7)), F.ceil(c / UNIT)).cast("int")


def _whole_cells(shared: DataFrame) -> DataFrame:
    spread = F.col("h").bitwiseAND(F.when(F.col("c") <= LEAF, 1).otherwise(15).cast("long"))
    return shared.where(F.col("c") <= UNIT).select(F.col("h").alias("u"), "doc", F.col("first").bitwiseXOR(spread).alias("g"))


def units_of_one(shared: DataFrame) -> DataFrame:
    """(u, doc, g) for the first round: small cells whole, large ones in parts whose first points meet again.

    g leads units with the same first point (most cells of a group of near copies) to the same two tasks of the search, or sixteen if they are not small.
    """
    small = _whole_cells(shared)
    large = shared.where(F.col("c") > UNIT).select("h", "doc", _part(F.col("c")).alias("i"))
    parts = large.select(F.xxhash64("h", "i").alias("u"), "doc").withColumn("g", F.col("u"))
    heads = large.groupBy("h", "i").agg(F.min("doc").alias("doc")).select(F.xxhash64("h", F.lit(-1)).alias("u"), "doc").withColumn("g", F.col("u"))
    return small.unionByName(parts).unionByName(heads)


def units_of_two(shared: DataFrame, comp: DataFrame) -> DataFrame:
    """(u, doc, g) for the second round; comp is (doc, comp). Large cells of one component vanish."""
    small = _whole_cells(shared)
    large = shared.where(F.col("c") > UNIT).select("h", "doc").join(comp, "doc")
    by = large.groupBy("h", "comp").agg(F.count(F.lit(1)).alias("k"))
    top = by.groupBy("h").agg(F.max(F.struct("k", "comp")).alias("m"), F.sum("k").alias("c")).where("m.k < c")
    top = top.select("h", F.col("m.comp").alias("most"), F.ceil(F.col("m.k") / UNIT).cast("int").alias("p"), F.ceil((F.col("c") - F.col("m.k")) / UNIT).cast("int").alias("q"))
    d = large.join(top, "h").withColumn("own", F.col("comp") == F.col("most"))
    own = F.pmod(F.xxhash64("doc", F.lit(7)), F.when(F.col("own"), F.col("p")).otherwise(F.col("q"))).cast("int")
    d = d.withColumn("i", own)
    span = lambda n: F.sequence(F.lit(0), n - 1)
    # points of the largest component: a unit with each part of the others; the others: with each of its parts and among themselves
    across = F.transform(span(F.col("q")), lambda j: F.xxhash64("h", F.col("i"), j, F.lit(1)))
    back = F.transform(span(F.col("p")), lambda j: F.xxhash64("h", j, F.col("i"), F.lit(1)))
    among = F.transform(span(F.col("q")), lambda j: F.xxhash64("h", F.least(j, F.col("i")), F.greatest(j, F.col("i")), F.lit(2)))
    units = F.when(F.col("own"), across).otherwise(F.concat(back, among))
    large = d.select("doc", F.explode(units).alias("u")).select("u", "doc", F.col("u").alias("g"))
    return small.unionByName(large)


class CountTree:
    """R-tree over count vectors, packed by size, then by the widest coordinate within slabs of equal size rank."""

    def __init__(self, n, vec, comp, percent: int) -> None:
        import numpy as np

        self.np, self.percent = np, percent
        order = np.argsort(n, kind="stable")
        slab = LEAF * FANOUT
        for a in range(0, len(order), slab):
            part = order[a : a + slab]
            wide = int(vec[part].std(axis=0).argmax()) if len(part) > 1 else 0
            order[a : a + slab] = part[np.argsort(vec[part, wide], kind="stable")]
        self.order, self.n, self.vec, self.comp = order, n[order], vec[order], comp[order]
        # levels: (first point, last point, upper corner, least n, most n, the one component or -1)
        self.levels = []
        step = LEAF
        while True:
            starts = np.arange(0, len(order), step)
            ends = np.minimum(starts + step, len(order))
            upper = np.maximum.reduceat(self.vec, starts, axis=0)
            lo, hi = np.minimum.reduceat(self.n, starts), np.maximum.reduceat(self.n, starts)
            clo, chi = np.minimum.reduceat(self.comp, starts), np.maximum.reduceat(self.comp, starts)
            self.levels.append((starts, ends, upper, lo, hi, np.where(clo == chi, clo, -1)))
            if len(starts) == 1:
                break
            step *= FANOUT

    def reaches(self, overlap, na, nb):
        """100 * overlap >= percent * union for the largest possible overlap."""
        union = na + nb - overlap
        return 100 * overlap >= self.percent * union

    def pairs(self, across: bool):
        """(i, j) of points within the bound, i < j in the tree's order; across: only of different components."""
        np = self.np
        stack = [(len(self.levels) - 1, 0, 0)]
        while stack:
            depth, x, y = stack.pop()
            starts, ends, upper, lo, hi, one = self.levels[depth]
            if across and one[x] >= 0 and one[x] == one[y]:
                continue
            # the smallest sets below need the least overlap; sizes too far apart need more than the smaller has
            small, large = min(hi[x], hi[y]), max(lo[x], lo[y])
            if 100 * small < self.percent * large:
                continue
            best = min(int(np.minimum(upper[x], upper[y]).sum()), int(small))
            if not self.reaches(best, int(lo[x]), max(int(lo[y]), 0)):
                continue
            if depth:
                below = self.levels[depth - 1][0]
                a = np.searchsorted(below, [starts[x], ends[x]])
                b = np.searchsorted(below, [starts[y], ends[y]])
                stack += [(depth - 1, i, j) for i in range(a[0], a[1]) for j in range(b[0], b[1]) if i <= j]
                continue
            i0, i1, j0, j1 = starts[x], ends[x], starts[y], ends[y]
            over = np.minimum(self.vec[i0:i1, None, :], self.vec[None, j0:j1, :]).sum(axis=2, dtype=np.int64)
            ok = self.reaches(over, self.n[i0:i1, None].astype(np.int64), self.n[None, j0:j1].astype(np.int64))
            if across:
                ok &= self.comp[i0:i1, None] != self.comp[None, j0:j1]
            if x == y:
                ok &= np.triu(np.ones(ok.shape, bool), 1)
            i, j = np.nonzero(ok)
            if len(i):
                yield i + i0, j + j0, over[i, j]


def _first_best(late, early, score, np):
    """Per late point the earlier one of the greatest score, of equal scores the smallest."""
    order = np.lexsort((early, -score, late))
    late, early, score = late[order], early[order], score[order]
    first = np.flatnonzero(np.concatenate([[True], late[1:] != late[:-1]])) if len(late) else np.empty(0, int)
    return late[first], early[first], score[first]


def _blocks(members, n, size: int):
    """Stretches of at most `size` members in order of n; for round one only, as any forest will do there."""
    return [members[a : a + size] for a in range(0, len(members), size)]


def candidate_pairs(units: DataFrame, known: DataFrame, percent: int, tasks: int, across: bool, block: int = 512) -> DataFrame:
    """(a, b), a < b: pairs within the bound; units is (u, doc, g), known is (doc, n, vec, comp)."""

    def search(key, cells_, docs_):
        import numpy as np
        import pandas as pd

        found = [np.empty((0, 2), np.int64)]
        near = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
        if len(cells_) and len(docs_):
            docs_ = docs_.sort_values("doc")
            ids, n, comp = docs_["doc"].to_numpy(), docs_["n"].to_numpy().astype(np.int64), docs_["comp"].to_numpy()
            raw = docs_["vec"].to_numpy()
            vec = np.stack([folded(counts_of(v), GROUPS) for v in raw])
            full = functools.lru_cache(maxsize=4096)(lambda i: counts_of(raw[i]))
            label = np.unique(comp, return_inverse=True)[1]
            cells_ = cells_.sort_values(["u", "doc"])
            u, at = cells_["u"].to_numpy(), np.searchsorted(ids, cells_["doc"].to_numpy())
            cut = np.flatnonzero(np.concatenate([[True], u[1:] != u[:-1]]))
            seen = set()

            def within(i, j, over):
                """The pairs of points i, j that pass the finer bound too, and their bounds."""
                over = over.copy()
                for k in np.flatnonzero(np.minimum(n[i], n[j]) > GROUPS * PER_GROUP):
                    a, b = full(int(i[k])), full(int(j[k]))
                    size = min(len(a), len(b))
                    over[k] = min(over[k], int(np.minimum(folded(a, size), folded(b, size)).sum()))
                ok = 100 * over >= percent * (n[i] + n[j] - over)
                return i[ok], j[ok], over[ok]

            for a, b in zip(cut, np.append(cut[1:], len(u))):
                members = np.unique(at[a:b])
                if across and (label[members] == label[members[0]]).all():
                    continue
                k = members.tobytes()
                if k in seen:
                    continue
                seen.add(k)
                parts = [members] if across or len(members) <= block else _blocks(members, n, block)
                if len(parts) > 1:  # the first of each block meet in one more
                    parts.append(np.array([p[0] for p in parts]))
                for part in parts:
                    tree = CountTree(n[part], vec[part], label[part], percent)
                    for i, j, over in tree.pairs(across):
                        x, y, over = within(part[tree.order[i]], part[tree.order[j]], over)
                        early, late = np.minimum(x, y), np.maximum(x, y)
                        if across:
                            found.append(np.stack([ids[early], ids[late]], axis=1))
                        else:
                            near.append(_first_best(late, early, over / (n[x] + n[y] - over), np))
                if len(found) > 1000:
                    found = [np.unique(np.concatenate(found), axis=0)]
                if len(near) > 1000:
                    near = [_first_best(*(np.concatenate(c) for c in zip(*near)), np)]
            late, early, _ = _first_best(*(np.concatenate(c) for c in zip(*near)), np)
            found.append(np.stack([ids[early.astype(int)], ids[late.astype(int)]], axis=1))
        pairs = np.unique(np.concatenate(found), axis=0)
        return pd.DataFrame({"a": pairs[:, 0], "b": pairs[:, 1]})

    dealt = units.withColumn("_g", F.pmod(F.xxhash64("g"), F.lit(tasks))).drop("g")
    needed = dealt.select(F.col("_g").alias("_to"), F.col("doc").alias("_doc")).distinct()
    needed = needed.join(known, needed["_doc"] == known["doc"]).select("_to", F.col("_doc").alias("doc"), "n", "vec", "comp")
    found = dealt.groupBy("_g").cogroup(needed.groupBy("_to")).applyInPandas(search, "a long, b long")
    return found.distinct()


def _bitmap(ids: DataFrame):
    """Fixed-size bitmap of the ids' hashes: at most BITS / 64 words reach the driver."""
    import numpy as np

    at = F.pmod(F.xxhash64("doc"), F.lit(BITS))
    words = ids.select(at.alias("p")).groupBy(F.expr("p div 32").cast("int").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, int(p % 32))")).alias("m")).collect()
    bits = np.zeros(BITS // 32, np.uint32)
    for r in words:
        bits[r["w"]] = r["m"]
    return bits


def sets_of(docs: DataFrame, ids: DataFrame, width: int, part=lambda s: s) -> DataFrame:
    """(doc, th, set array<long>) of the documents in `ids` (doc), or a part of the set; the bitmap may let others through."""
    bits = docs.sparkSession.sparkContext.broadcast(_bitmap(ids))  # BITS / 8 bytes

    def scan(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            p = np.asarray(batch.column(3)).astype(np.int64)
            hit = np.flatnonzero((bits.value[p >> 5] >> (p & 31).astype(np.uint32)) & 1)
            text = batch.column(2)
            sets = [part(shingle_set(text[int(i)].as_py(), width)).view(np.int64) for i in hit]
            offsets = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
            flat = np.concatenate(sets) if sets else np.empty(0, np.int64)
            take = pa.array(hit)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], names=["doc", "th", "set"])

    d = docs.withColumn("p", F.pmod(F.xxhash64("doc"), F.lit(BITS)))
    return d.mapInArrow(scan, "doc long, th long, set array<long>")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b, overlap, na, nb) of the pairs whose full sets reach the similarity."""
    left = sets.select(F.col("doc").alias("a"), F.col("set").alias("sa"))
    right = sets.select(F.col("doc").alias("b"), F.col("set").alias("sb"))
    d = pairs.join(left, "a").join(right, "b").select("a", "b", F.size(F.array_intersect("sa", "sb")).alias("overlap"), F.size("sa").alias("na"), F.size("sb").alias("nb"))
    return d.where(100 * F.col("overlap") >= percent * (F.col("na") + F.col("nb") - F.col("overlap")))


def jaccard_join(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80, tasks: int | None = None) -> DataFrame:
    """Per document (doc_id): n_shingles, rep_id (smallest id with an equal set), component_id (smallest id reachable by links).

    tasks: of the search; by default the shuffle partitions, and more where cells have more than TASK_ROWS rows for each.
    """
    spark = docs.sparkSession
    base = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(MIN_LONG)).alias("doc"), F.xxhash64(text).alias("th"), F.col(text).alias("text"))
    every = table(points(base, width, percent), "ngram-points")
    real = every.where("n >= 0")
    one = real.groupBy("doc").agg(F.min("th").alias("th"))  # rows with one id are one document
    flat = table(real.select("doc", "th", "n", "s1", "s2").join(one, ["doc", "th"]).dropDuplicates(["doc"]), "ngram-sets-known")
    same = table(flat.where("n > 0").groupBy("n", "s1", "s2").agg(F.min("doc").alias("rep"), F.count(F.lit(1)).alias("c")).where("c > 1").drop("c"), "ngram-same")
    known = table(flat.join(hinted(same), ["n", "s1", "s2"], "left").select("doc", "th", "n", F.coalesce("rep", "doc").alias("rep")), "ngram-docs")
    live = known.where("doc = rep and n > 0").select("doc", "th")
    vectors = table(real.select("doc", "th", "n", "vec", "prefix").join(live, ["doc", "th"]).dropDuplicates(["doc"]).drop("th"), "ngram-vectors")
    hot = hot_hashes(every, known.count())
    discard(every, flat, same)
    shared = table(shared_cells(ordered_cells(vectors, base, live, hot, width, percent)), "ngram-cells")
    vectors_ = vectors.select("doc", "n", "vec")
    parts = tasks or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-shared.count() // TASK_ROWS))
    pairs = table(candidate_pairs(units_of_one(shared), vectors_.withColumn("comp", F.col("doc")), percent, parts, False), "ngram-pairs")

    def links_of(p: DataFrame) -> DataFrame:
        ids = table(p.select(F.col("a").alias("doc")).unionByName(p.select(F.col("b").alias("doc"))).distinct(), "ngram-ids")
        sets = table(sets_of(base, ids, width).join(ids, "doc", "left_semi").join(live, ["doc", "th"], "left_semi").dropDuplicates(["doc"]).select("doc", "set"), "ngram-sets")
        links = table(verified(p, sets, percent).select("a", "b"), "ngram-links")
        discard(ids, sets)
        return links

    links = links_of(pairs)
    first = components(links)
    labelled = table(vectors_.join(first, vectors_.doc == first.node, "left").select("doc", "n", "vec", F.coalesce("comp", "doc").alias("comp")), "ngram-labelled")
    units = units_of_two(shared, labelled.select("doc", "comp"))
    rest = table(candidate_pairs(units, labelled, percent, parts, True).join(pairs, ["a", "b"], "left_anti"), "ngram-open")
    discard(vectors, shared, labelled, pairs)
    final = first
    if rest.head(1):
        more = links_of(rest)
        final = components(links.unionByName(more))
        discard(first, more)
    discard(rest, links)
    out = known.join(final, known.rep == final.node, "left").select("doc", "n", "rep", F.coalesce("comp", "rep").alias("comp"))
    keyed = F.when(F.col("doc") == MIN_LONG, F.lit(None)).otherwise(F.col("doc"))
    return out.select(keyed.alias(key), F.col("n").cast("long").alias("n_shingles"), F.col("rep").alias("rep_id"), F.col("comp").alias("component_id"))
