"""Phrase collocations: frequent phrases grown word by word over vertical positional lists.

The corpus is cut into blocks of about `BLOCK_WORDS` words of one language, at the ends of pieces. A block is a row: an inverted list per phrase, which holds the
ascending positions of the phrase, and the phrase's last word. Phrases of k words are extended by merging positions: where one stands at p
and another at p + 1, the first goes on with the last word of the second, and all other extensions hold a rarer phrase. A first pass
over the blocks counts the extensions, by the lengths of their lists; sums over the blocks are exact frequencies, and those of `min_count` or more in the
whole corpus of their language get a number. A second pass keeps their lists as the blocks of the next level. Only counts are shuffled, summed per block before,
as arrays per block and part of the extensions.

Frequent phrases are sent to all blocks where their table is small; beyond, each block is preceded in its task by rows of those of its own phrases that are frequent,
so that no task holds more than a block's. For extensions these rows come out of the sums, where each block's counts lie, so that counts are not joined with what is frequent.
Numbers become words again for frequent phrases alone, of which there are at most n / min_count per length.

Defined results: null text is empty, null language is `und`; repeated rows count each time, whatever their ids; pieces without words are nothing;
an empty table gives no rows; very long texts are read whole (a piece longer than a block lies in one block); ties follow the order of the phrases' bytes;
other columns are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, is_small, table

BLOCK_WORDS = 1_000_000
#: Bytes of a row group of a table of blocks; blocks of a task in which they meet their own phrases, about.
GROUP_BYTES, TASK_BLOCKS = 16 * 2**20, 2
#: Bytes of text that are split at once; positions whose extensions are summed in one group, about; positions from which blocks' own extensions are kept with the sums.
HELD_BYTES, PART_POSITIONS, MANY = 2**21, 2**22, 2**28
#: Bytes that end a piece (become LF) and the tab that separates words as a space does.
ENDS = b".,;:!?\x0a\x0b\x0c\x0d"
PIECES = bytes(10 if b in ENDS else (32 if b == 9 else b) for b in range(256))
PIECE_END = re.compile("[.,;:!?\x0a-\x0d]")
WORD_LISTS = "block long, lang string, words array<string>, sizes array<int>, gaps array<int>"
LISTS = "block long, phrases array<bigint>, lasts array<bigint>, sizes array<int>, gaps array<int>"
COUNTS = "part int, block long, phrases array<bigint>, words array<bigint>, n array<int>"
SUMS = "part int, block long, phrases array<bigint>, words array<bigint>, f array<bigint>, ids array<int>"
UNKNOWN = "und"


def slices(text: str, size: int = 2**22):
    """A text in parts of about `size` characters, each with the end of a piece as its last, so that no phrase is cut."""
    at = 0
    while at < len(text):
        end = PIECE_END.search(text, at + size)
        to = end.end() if end else len(text)
        yield text[at:to]
        at = to


def piece_bytes(text: str) -> bytes:
    """Words between spaces, with LF as one wherever a piece ends; letters A to Z in lower case."""
    return text.encode().lower().translate(PIECES).replace(b"\n", b" \n ")


def lists_of(ids, positions):
    """(distinct ids, sizes of their lists, gaps) of parallel arrays with ascending positions. The lists stand one after the other; gaps are small numbers."""
    import numpy as np

    order = np.argsort(ids, kind="stable")
    ids, positions = ids[order], positions[order]
    last = np.flatnonzero(np.append(ids[1:] != ids[:-1], True)) if len(ids) else np.zeros(0, np.int64)
    return ids[last], np.diff(last, prepend=-1).astype(np.int32), np.diff(positions, prepend=0).astype(np.int32)


def word_lists(docs: DataFrame, block_words: int) -> DataFrame:
    """A row per block: its words and their inverted lists. Positions of two pieces never follow each other."""

    def scan(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc
        from pyspark import TaskContext

        block = TaskContext.get().partitionId() << 32
        most = min(HELD_BYTES, 4 * block_words)
        open_: dict[str, tuple[list, list]] = {}  # language -> arrays of words, texts that are not split yet

        def split(lang):
            """Turn the held texts into an array of words, with LF where a piece ends."""
            parts, held = open_[lang]
            if held:
                words = pc.split_pattern(pa.array([b" \n ".join(held) + b" \n"]), b" ").flatten()
                parts.append(words.filter(pc.greater(pc.binary_length(words), 0)))
                held.clear()

        def row(lang):
            nonlocal block
            split(lang)
            every = pa.concat_arrays(open_.pop(lang)[0]).dictionary_encode()
            codes = every.indices.to_numpy()
            at = np.flatnonzero(codes != pc.index(every.dictionary, b"\n").as_py())
            used, sizes, gaps = lists_of(codes[at], at)
            spelt = every.dictionary.take(pa.array(used)).cast(pa.string())
            block += 1
            return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([lang]), one(spelt), one(pa.array(sizes)), one(pa.array(gaps))], names=["block", "lang", "words", "sizes", "gaps"])

        waiting: dict[str, int] = {}  # bytes held
        for batch in batches:
            for lang, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                for part in slices(t.as_py()):
                    parts, held = open_.setdefault(lang, ([], []))
                    held.append(piece_bytes(part))
                    waiting[lang] = waiting.get(lang, 0) + len(held[-1])
                    if waiting[lang] >= most:
                        split(lang)
                        waiting[lang] = 0
                        if sum(map(len, parts)) >= block_words:
                            yield row(lang)
        for lang in list(open_):
            yield row(lang)

    d = docs.select(F.coalesce(F.col("lang"), F.lit(UNKNOWN)).alias("lang"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return d.mapInArrow(scan, WORD_LISTS)


def one(values):
    """A list array of one list."""
    import pyarrow as pa

    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def arrays(batch, names: list[str]):
    """The named list columns of each row as numpy arrays."""
    for i in range(batch.num_rows):
        yield [batch.column(n)[i].values.to_numpy(zero_copy_only=False) for n in names]


def neighbours(lasts, sizes, gaps):
    """(position, phrase there, last word of the phrase one further) wherever two phrases follow each other; phrases and words by their place in the block."""
    import numpy as np

    owner, positions = np.repeat(np.arange(len(lasts)), sizes), np.cumsum(gaps)
    order = np.argsort(positions, kind="stable")
    at, owner = positions[order], owner[order]
    i = np.flatnonzero(at[1:] == at[:-1] + 1)
    words, place = np.unique(lasts, return_inverse=True)
    return at[i], owner[i], place[owner[i + 1]], words


def numbered(keys: DataFrame, by: list[str], min_count: int, name: str) -> DataFrame:
    """A table (by, f, id) of the keys whose counts n sum up to min_count or more."""
    f = keys.groupBy(*by).agg(F.sum("n").alias("f")).where(F.col("f") >= min_count)
    return table(f.withColumn("id", F.monotonically_increasing_id()), name)


def with_known(blocks: DataFrame, keys: DataFrame, found: DataFrame, by: list[str], known: DataFrame):
    """(rows, what is sent to all of them): frequent keys that are few are sent, else each block gets those of its own keys, as rows before its own (`own_keys`).

    keys: (block, by) of the blocks; known: the columns of `found` that blocks need.
    """
    if is_small(found):
        return blocks, blocks.sparkSession.sparkContext.broadcast(known.toArrow())
    return with_own(blocks, keys.join(known, by).select("block", *known.columns)), None


def with_own(blocks: DataFrame, own: DataFrame) -> DataFrame:
    """Each block after the rows of `own` (block, ...) that are its own."""
    rows = own.select("block", *[F.col(c).alias(f"own_{c}") for c in own.columns if c != "block"], F.lit(0).alias("_last"))
    tasks = -(-blocks.count() // TASK_BLOCKS) or 1
    rows = blocks.withColumn("_last", F.lit(1)).unionByName(rows, allowMissingColumns=True)
    return rows.repartition(tasks, "block").sortWithinPartitions("block", "_last")


def own_keys(batches, columns: list[str]):
    """(batch, place of a block in it, the block's own frequent keys) of the rows of `with_known`."""
    import numpy as np
    import pyarrow as pa

    parts = []
    for batch in batches:
        own = batch.select([f"own_{c}" for c in columns]).rename_columns(columns)
        start = 0
        for i in np.flatnonzero(batch.column("_last").to_numpy()).tolist():
            parts.append(own.slice(start, i - start))
            yield batch, i, pa.Table.from_batches(parts)
            parts, start = [], i + 1
        parts.append(own.slice(start))


def first_lists(posts: DataFrame, found: DataFrame) -> DataFrame:
    """Blocks of frequent words under their numbers."""
    keys = posts.select("block", "lang", F.explode("words").alias("word"))
    blocks, sent = with_known(posts, keys, found, ["lang", "word"], found.select("lang", "word", "id"))

    def renumber(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        every: dict[str, pa.Table] = {}

        def of(lang):
            if lang not in every:
                every[lang] = sent.value.filter(pc.equal(sent.value["lang"], lang))
            return every[lang]

        each_block = ((b, i, of(b.column("lang")[i].as_py())) for b in batches for i in range(b.num_rows)) if sent else own_keys(batches, ["lang", "word", "id"])
        for batch, i, known in each_block:
            at = pc.index_in(batch.column("words")[i].values, value_set=known["word"].combine_chunks())
            new = pc.fill_null(known["id"].combine_chunks().take(at), -1).to_numpy(zero_copy_only=False)
            sizes, gaps = (batch.column(n)[i].values.to_numpy(zero_copy_only=False) for n in ("sizes", "gaps"))
            each = np.repeat(new, sizes)
            phrases, sizes, gaps = lists_of(each[each >= 0], np.cumsum(gaps)[each >= 0])
            if len(phrases):
                yield pa.RecordBatch.from_arrays([batch.column("block").slice(i, 1), one(pa.array(phrases)), one(pa.array(phrases)), one(pa.array(sizes)), one(pa.array(gaps))], names=["block", "phrases", "lasts", "sizes", "gaps"])

    return blocks.mapInArrow(renumber, LISTS)


def part_of(phrase, word, parts: int):
    """The part of 0 to parts - 1 in which an extension is summed."""
    import numpy as np

    h = phrase.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + word.astype(np.uint64)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return ((h ^ (h >> np.uint64(32))) % np.uint64(parts)).astype(np.int64)


def block_pairs(phrases, lasts, sizes, gaps, parts: int):
    """(positions, their extensions' places, phrases, words, counts, parts, order by part) of a block; the distinct extensions in a definite order."""
    import numpy as np

    at, a, b, words = neighbours(lasts, sizes, gaps)
    width = max(1, len(words))
    pairs, place, n = np.unique(a.astype(np.int64) * width + b, return_inverse=True, return_counts=True)
    phrase, word = phrases[pairs // width], words[pairs % width]
    part = part_of(phrase, word, parts)
    return at, place, phrase, word, n, part, np.argsort(part, kind="stable")


def extensions(blocks: DataFrame, parts: int) -> DataFrame:
    """(part, block, phrases, words, n): how often each phrase of a block goes on with which word, as a row of arrays per block and part."""

    def count(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for i, columns in enumerate(arrays(batch, ["phrases", "lasts", "sizes", "gaps"])):
                _, _, phrase, word, n, part, order = block_pairs(*columns, parts)
                own, start = np.unique(part[order], return_index=True)
                offsets = pa.array(np.append(start, len(order)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(offsets, pa.array(v[order])) for v in (phrase, word, n.astype(np.int32))]
                block = np.full(len(own), batch.column("block")[i].as_py(), np.int64)
                if len(own):
                    yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), pa.array(block), *lists], names=["part", "block", "phrases", "words", "n"])

    return blocks.mapInArrow(count, COUNTS)


def summed(blocks: DataFrame, parts: int, min_count: int, own: bool) -> DataFrame:
    """Sums over the blocks, part by part: a row without block (phrases, words, f) of the extensions of `min_count` or more, numbered in that order.

    own: also a row (block, ids) per block: the numbers of its extensions in their order in `extensions`, -1 for rarer ones; a block without frequent ones has no row.
    """

    def add(t):
        import numpy as np
        import pyarrow as pa

        flat = lambda name: pa.concat_arrays([c.flatten() for c in t[name].chunks]).to_numpy(zero_copy_only=False)
        phrase, word, n = flat("phrases"), flat("words"), flat("n").astype(np.int64)
        order = np.lexsort((word, phrase))
        phrase, word = phrase[order], word[order]
        first = np.flatnonzero(np.append(True, (phrase[1:] != phrase[:-1]) | (word[1:] != word[:-1])))
        f = np.add.reduceat(n[order], first)
        frequent = f >= min_count
        part, at = t["part"][0].as_py(), first[frequent]
        rows = [[part], [None], [phrase[at]], [word[at]], [f[frequent]], [None]]
        if own:
            ids = np.empty(len(order), np.int32)
            ids[order] = np.repeat(np.where(frequent, np.cumsum(frequent) - 1, -1), np.diff(np.append(first, len(order))))
            lists = np.split(ids, np.cumsum(np.concatenate([c.value_lengths().to_numpy(zero_copy_only=False) for c in t["n"].chunks]))[:-1])
            for block, x in zip(t["block"].to_pylist(), lists):
                if (x >= 0).any():
                    for column, value in zip(rows, [part, block, None, None, None, x]):
                        column.append(value)
        longs = pa.list_(pa.int64())
        kinds = [pa.int32(), pa.int64(), longs, longs, longs, pa.list_(pa.int32())]
        return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds)], names=["part", "block", "phrases", "words", "f", "ids"])

    return extensions(blocks, parts).repartition(parts, "part").groupBy("part").applyInArrow(add, SUMS)


class Extensions:
    """The frequent extensions of all blocks: a table `found` (phrase, word, f, id), and each block's own numbers where `found` is not small."""

    def __init__(self, blocks: DataFrame, min_count: int, k: int):
        positions = blocks.agg(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x))).head()[0] or 0
        self.parts, self.made, own = positions // PART_POSITIONS + 1, [], positions >= MANY
        sums = self._kept(blocks, min_count, k, own)
        at = F.posexplode(F.arrays_zip(F.col("phrases").alias("phrase"), F.col("words").alias("word"), "f")).alias("_at", "x")
        found = sums.where("block is null").select("part", at).select("x.*", (F.shiftleft(F.col("part").cast("long"), 32) + F.col("_at")).alias("id"))
        self.found = table(found, f"phrase-frequent-{k}")
        self.small = is_small(self.found)
        sums = sums if own or self.small else self._kept(blocks, min_count, k, True)
        self.own = sums.where("block is not null").select("block", "part", "ids")

    def _kept(self, blocks: DataFrame, min_count: int, k: int, own: bool) -> DataFrame:
        self.made.append(table(summed(blocks, self.parts, min_count, own), f"phrase-sums-{k}", "zstd", GROUP_BYTES))
        return self.made[-1]


def longer_lists(blocks: DataFrame, known: Extensions) -> DataFrame:
    """Blocks of the frequent extensions under their numbers."""
    parts = known.parts
    if known.small:
        sent = blocks.sparkSession.sparkContext.broadcast(known.found.select("phrase", "word", "id").toArrow())
    else:
        sent, blocks = None, with_own(blocks, known.own)

    def grow(batches):
        import numpy as np
        import pyarrow as pa

        def index(phrase, word, new):
            heads, tails = np.unique(phrase), np.unique(word)
            keys = np.searchsorted(heads, phrase) * len(tails) + np.searchsorted(tails, word)
            order = np.argsort(keys)
            return heads, tails, keys[order], new[order]

        def find(values, where):
            i = np.minimum(np.searchsorted(where, values), max(0, len(where) - 1))
            return i, (where[i] == values if len(where) else np.zeros(len(values), bool))

        def sought(phrase, word):
            """Numbers of extensions among those sent, -1 for others."""
            h, ok_h = find(phrase, heads)
            t, ok_t = find(word, tails)
            k, ok = find(h * len(tails) + t, keys)
            ok &= ok_h & ok_t
            return np.where(ok, numbers[k], -1) if len(numbers) else np.full(len(phrase), -1)

        def given(own, part, order):
            """Numbers of a block's extensions from its own rows."""
            new, dealt = np.full(len(part), -1, np.int64), part[order]
            for p, x in zip(own["part"].to_pylist(), own["ids"]):
                ids = x.values.to_numpy(zero_copy_only=False).astype(np.int64)
                start = np.searchsorted(dealt, p)
                new[order[start : start + len(ids)]] = np.where(ids >= 0, (p << 32) + ids, -1)
            return new

        heads, tails, keys, numbers = index(*[sent.value[c].to_numpy() for c in ("phrase", "word", "id")]) if sent else [None] * 4
        each_block = ((b, i, None) for b in batches for i in range(b.num_rows)) if sent else own_keys(batches, ["part", "ids"])
        for batch, i, own in each_block:
            at, place, phrase, word, _, part, order = block_pairs(*next(arrays(batch.slice(i, 1), ["phrases", "lasts", "sizes", "gaps"])), parts)
            new = sought(phrase, word) if sent else given(own, part, order)
            each = new[place]
            ids, sizes, gaps = lists_of(each[each >= 0], at[each >= 0])
            last = np.empty(len(ids), np.int64)
            last[np.searchsorted(ids, new[new >= 0])] = word[new >= 0]
            if len(ids):
                yield pa.RecordBatch.from_arrays([batch.column("block").slice(i, 1), one(pa.array(ids)), one(pa.array(last)), one(pa.array(sizes)), one(pa.array(gaps))], names=["block", "phrases", "lasts", "sizes", "gaps"])

    return blocks.mapInArrow(grow, LISTS)


def frequent_phrases(docs: DataFrame, max_words: int = 5, min_count: int = 100, block_words: int = BLOCK_WORDS) -> tuple[DataFrame, DataFrame]:
    """((lang, n): words per language, (lang, phrase, k, f): all phrases of up to max_words words with min_count occurrences)."""
    posts = table(word_lists(docs, block_words), "phrase-words", "zstd", GROUP_BYTES)
    totals = table(posts.groupBy("lang").agg(F.sum(F.size("gaps").cast("long")).alias("n")), "phrase-totals")
    size = F.arrays_zip(F.col("words").alias("word"), F.col("sizes").alias("n"))
    found = numbered(posts.select("lang", F.explode(size).alias("w")).select("lang", "w.*"), ["lang", "word"], min_count, "phrase-frequent-1")
    words = found.select(F.col("id").alias("word"), F.col("word").alias("spelt"))
    words = F.broadcast(words) if is_small(found) else words
    names = found.select("id", "lang", F.col("word").alias("text"), F.lit(1).alias("k"), "f")
    levels, blocks = [names], table(first_lists(posts, found), "phrase-lists-1", "zstd", GROUP_BYTES)
    discard(posts)
    for k in range(2, max_words + 1):
        grown = Extensions(blocks, min_count, k)
        found = grown.found
        parent = names.select(F.col("id").alias("phrase"), "lang", F.col("text").alias("head"))
        named = found.join(parent, "phrase").join(words, "word")
        names = table(named.select("id", "lang", F.concat_ws(" ", "head", "spelt").alias("text"), F.lit(k).alias("k"), "f"), f"phrase-names-{k}")
        levels.append(names)
        longer = table(longer_lists(blocks, grown), f"phrase-lists-{k}", "zstd", GROUP_BYTES) if k < max_words else None
        discard(blocks, *grown.made)
        blocks = longer
    every = levels[0]
    for level in levels[1:]:
        every = every.unionByName(level)
    return totals, every.select("lang", F.col("text").alias("phrase"), "k", "f")


def floor_ratio(a: Column, n: Column, l: Column, r: Column, times: int = 1000) -> Column:
    """floor(times * a * n / (l * r)) of longs, exactly: products are decimals of 38 digits."""
    wide = lambda c: c.cast("decimal(19,0)")
    top = (wide(F.lit(times) * a) * wide(n)).cast("decimal(38,0)")
    low = (wide(l) * wide(r)).cast("decimal(38,0)")
    return F.call_function("div", top, low)


def pieces_of(phrase: Column, k: Column, least: int) -> Column:
    """The contiguous parts of at least `least` words of a phrase of k words, without itself."""
    ws = F.split(phrase, " ")
    parts = lambda n: F.transform(F.sequence(F.lit(1), k - n + 1), lambda i: F.array_join(F.slice(ws, i, n), " "))
    return F.flatten(F.transform(F.sequence(F.lit(least), k - 1), parts))


def collocations(docs: DataFrame, max_words: int = 5, min_count: int = 100, inside: int = 100, top: int = 2000, block_words: int = BLOCK_WORDS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's best collocations of 2 to max_words words.

    score: floor(1000 a n / (l r)) at the weakest cut into two parts (ties: the shortest first part). A phrase is dropped
    where a longer frequent phrase holds it and has at least `inside` hundredths of its count.
    """
    totals, every = frequent_phrases(docs, max_words, min_count, block_words)
    every = table(every, "phrase-all")
    f = every.select("lang", "phrase", "f")
    candidates = every.where("k > 1").withColumnRenamed("f", "a")
    ws = F.split("phrase", " ")
    cut = F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut")
    cuts = candidates.select("lang", "phrase", "a", "k", cut)
    cuts = cuts.select("*", F.array_join(F.slice(ws, F.lit(1), F.col("cut")), " ").alias("head"), F.array_join(F.slice(ws, F.col("cut") + 1, F.col("k")), " ").alias("tail"))
    cuts = cuts.join(f.select("lang", F.col("phrase").alias("head"), F.col("f").alias("l")), ["lang", "head"]).join(f.select("lang", F.col("phrase").alias("tail"), F.col("f").alias("r")), ["lang", "tail"])
    scored = cuts.join(F.broadcast(totals), "lang") if is_small(totals) else cuts.join(totals, "lang")
    scored = scored.withColumn("score", floor_ratio(F.col("a"), F.col("n"), F.col("l"), F.col("r")))
    weakest = scored.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "cut", "l", "r")).alias("w")).select("lang", "phrase", "a", "n", "w.score", "w.l", "w.r")
    holders = candidates.where("k > 2").select("lang", F.explode(pieces_of(F.col("phrase"), F.col("k"), 2)).alias("phrase"), F.col("a").alias("longer"))
    most = holders.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    left = weakest.join(most, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < inside * F.col("a")))
    w = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = left.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
