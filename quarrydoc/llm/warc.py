"""WARC archives: native writer, split reader and boundary-chain verification.

Writing. A record is one string: header lines, an empty line, the payload. Spark's text
writer puts the record end (CR LF CR LF) after each, so files are committed by Spark's own
protocol on whatever store the path names. Of equal payloads of at least `min_bytes`, the
smallest id is written as `response`, the others as `revisit` that refer to it.

Reading. The text reader splits files at the magic `WARC/1.0 CR LF` in parallel over byte
ranges; every piece is a candidate record and its header names the offset of its
successor. Payloads may hold the magic, even whole forged headers, so candidates prove
nothing. Chains are verified by pointer jumping from the start of each file: tasks first
contract stretches, block by block, in which each candidate's successor is the next candidate and no other
candidate points into, then successors of successors are followed in logarithmically many
rounds, and only candidates reached from offset 0 are records. Pieces of payloads that hold the magic are
fetched in a second read by file, size and hash, so that nothing hangs on how a read splits the files.

Defined results: null html is an empty payload; pages with a null id are written with an
empty id and read as null; repeated rows are separate records of which one, the first by (id, row hash) or any of
several equal to it, is the response; an empty table gives an empty archive and no rows; archives that break
off keep the records before the break.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, fresh_path, hinted, prefix_sums, table

MAGIC = "WARC/1.0\r\n"
END = "\r\n\r\n"
#: Digits of Spark's conv in base 32, and the base32 alphabet.
CONV32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
BROADCAST_ROWS = 100_000
BIN_BYTES = 2**20


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 of the SHA-1: 160 bits as 60 + 60 + 40."""
    h = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(h, at, n), 16, 32), n * 4 // 5, "0") for at, n in ((1, 15), (16, 15), (31, 10))]
    return F.translate(F.concat(*parts), CONV32, BASE32)


def record_kinds(pages: DataFrame, key: str, payload: str, min_bytes: int) -> DataFrame:
    """key, __x (row hash), refers_to for the pages that revisit another; rows equal to the first are not among them."""
    p = pages.select(F.col(key).alias("id"), "__x", F.octet_length(payload).alias("n"), base32_sha1(F.col(payload)).alias("digest")).where(F.col("n") >= min_bytes)
    first = p.groupBy("digest", "n").agg(F.min(F.struct("id", "__x")).alias("first"), F.count(F.lit(1)).alias("c")).where("c > 1").drop("c")
    d = p.join(first, ["digest", "n"]).where(~(F.col("first.id").eqNullSafe(F.col("id")) & (F.col("first.__x") == F.col("__x"))))
    return d.select(F.col("id").alias("__id"), "__x", F.col("first.id").alias("__refers"), F.lit(True).alias("__hit")).distinct()


def numbered_copies(p: DataFrame, key: str, payload: str, min_bytes: int) -> DataFrame:
    """Pages plus __later: whether an equal row (key, url and payload) was taken for the first already.

    Only rows that are repeated are numbered: within the part they were read in, then the first ones of the parts, so that no task gets all copies of a row.
    """
    many = p.where(F.octet_length(payload) >= min_bytes).groupBy(F.col(key).alias("__k"), F.col("__x").alias("__y")).agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("__k", "__y")
    many = table(many, "warc-repeated")
    if not many.head(1):
        return p.withColumn("__later", F.lit(False))
    on = p[key].eqNullSafe(many["__k"]) & (p["__x"] == many["__y"])
    by, any_order = [F.col(key), F.col("__x")], F.lit(1)
    d = p.join(hinted(many), on).drop("__k", "__y").withColumn("__part", F.spark_partition_id())
    d = d.withColumn("__n", F.row_number().over(Window.partitionBy(*by, "__part").orderBy(any_order)))
    heads = d.where("__n = 1").withColumn("__later", F.row_number().over(Window.partitionBy(*by).orderBy(any_order)) > 1)
    rest = d.where("__n > 1").withColumn("__later", F.lit(True))
    return p.join(hinted(many), on, "left_anti").withColumn("__later", F.lit(False)).unionByName(heads.unionByName(rest).drop("__part", "__n"))


def write_warc(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", payload: str = "html", min_bytes: int = 0) -> None:
    """One record per row of pages into uncompressed WARC files under `path`."""
    spark = pages.sparkSession
    p = pages.select(F.col(key).alias(key), F.coalesce(F.col(url).cast("string"), F.lit("")).alias(url), F.coalesce(F.col(payload), F.lit("")).alias(payload))
    p = p.withColumn("__x", F.xxhash64(url, payload))
    revisits = table(record_kinds(p, key, payload, min_bytes), "warc-revisits")
    p = numbered_copies(p, key, payload, min_bytes)
    small = revisits.count() <= BROADCAST_ROWS  # a few MB; else both sides are dealt by key
    on = p[key].eqNullSafe(F.col("__id")) & (p["__x"] == revisits["__x"])
    d = p.join(F.broadcast(revisits) if small else revisits, on, "left").drop(revisits["__x"])
    again = F.coalesce("__hit", "__later")
    refers = F.coalesce("__refers", F.when(F.col("__hit").isNull(), F.col(key)))
    body = F.when(again, F.lit("")).otherwise(F.col(payload))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    clean = F.regexp_replace(F.col(url), r"[\r\n]", "%0A")
    ident = F.coalesce(F.col(key).cast("string"), F.lit(""))
    head = F.concat(
        F.lit(MAGIC),
        line("WARC-Type", F.when(again, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", F.concat(F.lit("<urn:page:"), ident, F.lit(">"))),
        line("WARC-Target-URI", clean),
        F.when(again, line("WARC-Refers-To", F.concat(F.lit("<urn:page:"), F.coalesce(refers.cast("string"), F.lit("")), F.lit(">")))).otherwise(F.lit("")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), base32_sha1(F.col(payload)))),
        line("WARC-Payload-Length", F.octet_length(payload).cast("string")),
        line("Content-Length", F.octet_length(body).cast("string")),
        F.lit("\r\n"),
    )
    d.select(F.concat(head, body).alias("value")).write.option("lineSep", END).text(path)


def _field(head: Column, name: str) -> Column:
    return F.nullif(F.regexp_extract(head, rf"(?i)(?:^|\n){name}:[ \t]*([^\r\n]*)", 1), F.lit(""))


def pieces(spark: SparkSession, path: str) -> DataFrame:
    """file, blk, row, value, hash: the files cut at every magic. blk and row tell the order, within one read only; file, size and hash tell the content."""
    raw = spark.read.option("lineSep", MAGIC).text(path)
    return raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("blk"), F.monotonically_increasing_id().alias("row"), "value", F.xxhash64("value").alias("hash"))


def candidates(spark: SparkSession, path: str) -> DataFrame:
    """One row per magic found: file, blk and row (order of the pieces within one read), size (bytes up to the next magic), hash, header fields, own digest."""
    raw = pieces(spark, path)
    cut = F.instr("value", END)
    d = raw.withColumn("head", F.when(cut > 0, F.substring("value", F.lit(1), cut - 1))).withColumn("size", F.octet_length("value").cast("long"))
    d = d.withColumn("hbytes", (F.octet_length("head") + 4).cast("long")).withColumn("clen", F.expr("try_cast(regexp_extract(head, '(?i)(?:^|\\n)Content-Length:[ \\t]*([0-9]+)', 1) as bigint)"))
    whole = F.col("size") >= F.col("hbytes") + F.col("clen")
    body = F.substring(F.encode("value", "utf-8"), (F.col("hbytes") + 1).cast("int"), F.col("clen").cast("int"))
    names = {"kind": "WARC-Type", "id": "WARC-Record-ID", "uri": "WARC-Target-URI", "refers": "WARC-Refers-To", "digest": "WARC-Payload-Digest", "plen": "WARC-Payload-Length"}
    return d.select("file", "blk", "row", "size", "hash", "hbytes", "clen", *[_field(F.col("head"), n).alias(a) for a, n in names.items()], F.when(whole, base32_sha1(body)).alias("own"))


def with_links(found: DataFrame) -> DataFrame:
    """candidates with their offset in the file and that of their successor; only those whose header parses."""
    d = prefix_sums(found.withColumn("_bytes", F.col("size") + len(MAGIC)), ["file"], "row", "_bytes", "_before", F.col("blk"))
    # the piece before the first magic is no candidate; a magic ends where its piece begins
    d = d.where("_before > 0").withColumn("offset", F.col("_before") - len(MAGIC)).drop("_bytes", "_before")
    return d.withColumn("next", F.col("offset") + len(MAGIC) + F.col("hbytes") + F.col("clen") + len(END))


def reachable(links: DataFrame) -> DataFrame:
    """Rows of links (file, blk, offset, next, ...) on the chain from offset 0 of their file, by pointer jumping over stretches contracted within a block."""
    good = links.where("clen is not null")
    w = Window.partitionBy("file", "blk").orderBy("offset")
    d = good.select("file", "blk", "offset", "next").withColumn("_prev", F.lag("next").over(w)).withColumn("_far", F.col("next") != F.coalesce(F.lead("offset").over(w), F.lit(-1)))
    aimed = d.where("_far").select("file", F.col("next").alias("offset"), F.lit(1).alias("_aim")).distinct()
    d = d.join(aimed, ["file", "offset"], "left")
    head = F.col("_aim").isNotNull() | ~F.coalesce(F.col("_prev") == F.col("offset"), F.lit(False))
    d = d.withColumn("_run", F.max(F.when(head, F.col("offset"))).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    d = table(d.select("file", "offset", "next", "_run"), "warc-links")
    jump = table(d.groupBy("file", F.col("_run").alias("at")).agg(F.max_by("next", "offset").alias("to")), "warc-jumps")
    starts = jump.select("file", "at")
    seen = table(starts.where("at = 0"), "warc-seen")
    used, jump = [jump], jump.join(starts.withColumnRenamed("at", "to"), ["file", "to"])  # arrows into the void end a chain
    count = seen.count()
    while True:
        step = seen.join(jump, ["file", "at"]).select("file", F.col("to").alias("at"))
        reached = table(seen.unionByName(step).distinct(), "warc-seen")
        discard(seen)
        seen, now = reached, reached.count()
        if now == count:
            break
        count = now
        over = jump.select("file", F.col("at").alias("to"), F.col("to").alias("far"))
        jump = table(jump.join(over, ["file", "to"]).select("file", "at", F.col("far").alias("to")), "warc-jumps")
        used.append(jump)
    on_chain = table(d.join(seen.withColumnRenamed("at", "_run"), ["file", "_run"]).select("file", "offset"), "warc-chain")
    discard(d, seen, *used)
    return links.join(on_chain, ["file", "offset"])


def records(spark: SparkSession, path: str, key_type: str = "bigint") -> DataFrame:
    """The verified records under `path`: id, uri, kind, refers_to, payload_bytes, payload_digest, file, offset, verified.

    payload_bytes: the stored bytes; of revisits, which store none, as their header names them.
    verified: the stored bytes hash to the recorded digest (null for revisits). Payloads
    that hold the magic lie in several pieces; those, and only those, are gathered in a second read.
    """
    links = table(with_links(candidates(spark, path)), "warc-candidates")
    chain = table(reachable(links), "warc-records")
    broken = chain.where("own is null and kind <> 'revisit'")
    spans = table(broken.select("file", "offset", "next", "hbytes", "clen"), "warc-spanning")
    own = chain.select("*", F.col("own").alias("_own"))
    if spans.head(1):
        own = chain.join(_gathered(spark, path, links, spans), ["file", "offset"], "left").withColumn("_own", F.coalesce("own", "_late"))
    urn = lambda c: F.nullif(F.regexp_extract(c, r"^<urn:page:(.*)>$", 1), F.lit("")).cast(key_type)
    return own.select(
        urn("id").alias("id"), "uri", "kind", urn("refers").alias("refers_to"), F.when(F.col("kind") == "revisit", F.coalesce(F.col("plen").cast("bigint"), F.col("clen"))).otherwise(F.col("clen")).alias("payload_bytes"),
        F.when(F.col("kind") == "revisit", F.regexp_extract("digest", "^sha1:(.*)$", 1)).otherwise(F.col("_own")).alias("payload_digest"),
        "file", "offset", F.when(F.col("kind") != "revisit", F.col("_own") == F.regexp_extract("digest", "^sha1:(.*)$", 1)).alias("verified"),
    )


def _gathered(spark: SparkSession, path: str, links: DataFrame, spans: DataFrame) -> DataFrame:
    """file, offset, _late: digests of payloads that several pieces hold, joined from their pieces in order."""
    # a piece lies in one bin of its file, a record in as many as it reaches into
    reach = spans.select("file", F.col("offset").alias("of"), F.col("next").alias("until"), F.col("hbytes").alias("hb"), F.col("clen").alias("cl"), F.explode(F.expr(f"sequence(offset div {BIN_BYTES}, (next - 1) div {BIN_BYTES})")).alias("bin"))
    parts = links.withColumn("bin", F.expr(f"offset div {BIN_BYTES}")).join(reach, ["file", "bin"]).where("offset >= of and offset < until")
    parts = table(parts.select("file", "size", "hash", "offset", "of", "hb", "cl"), "warc-parts")
    by = ["file", "size", "hash"]
    raw = pieces(spark, path).select("file", F.octet_length("value").cast("long").alias("size"), "hash", F.encode("value", "utf-8").alias("value"))
    wanted = table(parts.select(*by).distinct(), "warc-wanted")
    raw = raw.join(hinted(wanted), by, "left_semi").dropDuplicates(by)  # equal pieces of a file are one text
    got = parts.join(raw, by).groupBy("file", "of", "hb", "cl").agg(F.sort_array(F.collect_list(F.struct("offset", F.hex("value").alias("v")))).alias("ps"))
    joined = F.unhex(F.array_join(F.transform("ps", lambda p: p["v"]), MAGIC.encode().hex().upper()))
    body = F.substring(joined, (F.col("hb") + 1).cast("int"), F.col("cl").cast("int"))
    return got.select("file", F.col("of").alias("offset"), base32_sha1(body).alias("_late"))
