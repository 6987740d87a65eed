"""The registered queries of the thirteen operators: thin digests of the operators' own outputs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, fresh_path
from .fingerprints import as_string, fingerprint_pairs, resemblance
from .kd_sharding import kd_shards
from .line_dedup import line_dedup
from .mixing import mix
from .ngram_join import jaccard_join
from .packing import best_fit_packing
from .periodic_runs import densest, periodic_runs, planted, runs_text
from .phrases import collocations
from .pii import KINDS, find_pii, joined
from .quality_rules import quality_rules
from .secret_scan import KINDS as SECRET_KINDS
from .secret_scan import find_secrets
from .secret_scan import joined as joined_secrets
from .token_counts import token_counts
from .warc import records, write_warc


def tokenizer_file(name: str) -> str:
    """Where the public vocabulary files are; every operator takes the path as a parameter."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = line_dedup(documents(spark, sf_dir))
    return d.select("doc_id", "lines_before", "lines_removed", "text")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_packing(documents(spark, sf_dir), tokenizer_file("word_bpe_49k.json"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(documents(spark, sf_dir), tokenizer_file("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = mix(documents(spark, sf_dir), max_repeats=2.0)
    return d.select("doc_id", F.col("__s").alias("source"), "tokens", "copy", "stream_start", "block")


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = find_pii(documents(spark, sf_dir))
    count = lambda k, of="base": F.size(F.filter(of, lambda s: s["kind"] == KINDS.index(k))).cast("long").alias(f"n_{k}")
    own = [count("email"), count("ip"), count("card"), count("phone")]
    added = [count("secret", "spans"), count("name", "spans"), F.size("spans").cast("long").alias("n_spans")]
    return d.select("doc_id", *own, F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), *added)


def op6_kd_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = kd_shards(documents(spark, sf_dir), shards=8)
    return d.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(documents(spark, sf_dir), width=4, percent=85).select("doc_id", "n_shingles", "component_id")


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = fingerprint_pairs(documents(spark, sf_dir))
    return d.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        as_string(F.col("sketch")).alias("fingerprint"),
        as_string(F.col("edited_sketch")).alias("edited_fingerprint"),
        resemblance(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        resemblance(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
    )


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = quality_rules(documents(spark, sf_dir))
    return d.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "warc")
    write_warc(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    r = records(spark, path)
    return r.select(F.col("id").alias("page_id"), "payload_bytes", "payload_digest", F.col("kind").alias("record_type"), "refers_to")


def op11_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = find_secrets(documents(spark, sf_dir))
    count = lambda k, of="base": F.size(F.filter(of, lambda s: s["kind"] == SECRET_KINDS.index(k))).cast("long").alias(f"n_{k}")
    own = [count(k) for k in ("assign", "access", "hex")]
    added = [count(k, "spans") for k in ("pem", "der", "ssh", "jwt")]
    return d.select("doc_id", *own, F.sha2(joined_secrets(F.col("base")), 256).alias("base_sha256"), joined_secrets(F.col("spans")).alias("spans"), *added)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periods of the texts, with those planted that the contract asks for."""
    d = periodic_runs(planted(documents(spark, sf_dir))).withColumn("best", densest(F.col("runs")))
    return d.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.floor(F.expr("1000 * best.length div best.period")).cast("long").alias("exponent_milli"),
        F.sha2(runs_text(F.col("runs")), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_dedup": op1_line_dedup,
    "op2_packing": op2_packing,
    "op3_token_counts": op3_token_counts,
    "op4_source_mixing": op4_source_mixing,
    "op5_pii": op5_pii,
    "op6_kd_sharding": op6_kd_sharding,
    "op7_ngram_join": op7_ngram_join,
    "op8_fingerprints": op8_fingerprints,
    "op9_quality_rules": op9_quality_rules,
    "op10_warc": op10_warc,
    "op11_secret_scan": op11_secret_scan,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_phrases": op13_phrases,
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def line_dedup_sql(limit: int = 10) -> str:
    """Every stretch of up to `limit` lines that holds `limit` words and occurs at an earlier place goes."""
    frames = " UNION ALL ".join(
        f"SELECT doc_id, p, {k} AS k, list(line) OVER w AS key, sum(n) OVER w AS words, count(*) OVER w AS c FROM q WINDOW w AS (PARTITION BY doc_id ORDER BY p ROWS BETWEEN CURRENT ROW AND {k - 1} FOLLOWING)" for k in range(1, limit + 1)
    )
    return f"""WITH l AS (SELECT doc_id, unnest(s) AS line, generate_subscripts(s, 1) AS no FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS s FROM documents)),
q AS (SELECT doc_id, no, line, n, row_number() OVER (PARTITION BY doc_id ORDER BY no) AS p FROM (SELECT *, len(list_filter(regexp_split_to_array(line, '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS n FROM l) WHERE n > 0),
win AS ({frames}),
later AS (SELECT doc_id, p, k FROM (SELECT *, min((doc_id, p)) OVER (PARTITION BY key) AS first FROM win WHERE c = k AND words >= {limit}) WHERE (doc_id, p) > first),
gone AS (SELECT DISTINCT doc_id, unnest(range(p, p + k)) AS p FROM later),
isle AS (SELECT g.doc_id, q.no, g.p - row_number() OVER (PARTITION BY g.doc_id ORDER BY g.p) AS g FROM gone g JOIN q USING (doc_id, p)),
runs AS (SELECT doc_id, min(no) AS a, max(no) AS b FROM isle GROUP BY doc_id, g),
kept AS (SELECT l.doc_id, string_agg(line, chr(10) ORDER BY l.no) AS text FROM l LEFT JOIN runs r ON r.doc_id = l.doc_id AND l.no BETWEEN a AND b WHERE r.doc_id IS NULL GROUP BY 1),
n AS (SELECT doc_id, count(*) AS c FROM q GROUP BY 1), g AS (SELECT doc_id, count(*) AS c FROM gone GROUP BY 1)
SELECT d.doc_id, coalesce(n.c, 0) AS lines_before, coalesce(g.c, 0) AS lines_removed, CASE WHEN d.text IS NULL THEN NULL WHEN g.c IS NULL THEN d.text ELSE coalesce(kept.text, '') END AS text
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN g USING (doc_id) LEFT JOIN kept USING (doc_id)"""


WARC_SQL = """WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages), d AS (SELECT page_id, strlen(h) AS n, sha1(h) AS x, min(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, n::BIGINT AS payload_bytes,
array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr(x, (1 + 5 * (i // 4))::INT, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31) + 1)::INT, 1)), '') AS payload_digest,
CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM d"""

NGRAM_SQL = """WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')] ELSE list_distinct(list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' '))) END AS sh FROM w),
t AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS g FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS c FROM t a JOIN t b USING (g) WHERE a.doc_id < b.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM p WHERE 100 * c >= 85 * (na + nb - c)), e AS (FROM link UNION ALL SELECT b, a FROM link),
reach AS (SELECT a AS doc_id, b AS r FROM e UNION SELECT reach.doc_id, e.b FROM reach JOIN e ON e.a = reach.r)
SELECT s.doc_id, len(sh)::BIGINT AS n_shingles, least(s.doc_id, coalesce(min(r), s.doc_id)) AS component_id FROM s LEFT JOIN reach ON reach.doc_id = s.doc_id GROUP BY s.doc_id, sh"""

RUNS_SQL = """WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws,
xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))), lambda s, x: CASE WHEN x >= 0 THEN xor(s, x) WHEN s % 2 = 1 THEN xor(s >> 1, 3988292384) ELSE s >> 1 END), 4294967295) AS h FROM documents),
a AS (SELECT *, len(ws) AS n, CASE WHEN h % 10 = 0 AND len(ws) > 0 THEN (h // 10) % len(ws) END AS a, (h // 10) % 8 AS g8 FROM d),
p AS (SELECT doc_id, n, CASE WHEN a IS NULL THEN ws ELSE list_transform(range(n), lambda i: ws[1 + CASE WHEN i >= a THEN a + (i - a) % (1 + (n - a) // (3 + g8)) ELSE i END]) END AS ws FROM a),
w AS (SELECT doc_id, n, unnest(ws) AS w, generate_subscripts(ws, 1) - 1 AS i FROM p),
e AS (SELECT x.doc_id, x.n, y.i - x.i AS q, x.i FROM w x JOIN w y ON x.doc_id = y.doc_id AND x.w = y.w AND y.i > x.i AND 4 * (y.i - x.i) <= x.n),
s AS (SELECT doc_id, q, min(i) AS start, count(*) + q AS length FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS g FROM e) GROUP BY doc_id, q, g HAVING count(*) + q >= greatest(6, 4 * q)),
r AS (SELECT doc_id, start, length, min(q) AS period FROM s GROUP BY 1, 2, 3),
best AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY length::DOUBLE / period DESC, start, period) = 1),
n AS (SELECT doc_id, count(*) AS n, string_agg(concat_ws(',', start, length, period) || chr(10), '' ORDER BY start, period) AS t FROM r GROUP BY 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM r),
c AS (SELECT w.doc_id, string_agg(w, ' ' ORDER BY w.i) AS t FROM w ANTI JOIN gone USING (doc_id, i) GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0) AS n_runs, start::BIGINT AS start, length::BIGINT AS length, period::BIGINT AS period, (1000 * length // period)::BIGINT AS exponent_milli, sha256(coalesce(n.t, '')) AS runs_sha256, sha256(coalesce(c.t, '')) AS collapsed_sha256
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN best USING (doc_id) LEFT JOIN c USING (doc_id)"""

PHRASES_SQL = """WITH t AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\\x20\\x09]+'), lambda x: x <> '') AS ws FROM t),
n AS (SELECT lang, sum(len(ws))::BIGINT AS n FROM w GROUP BY 1),
g AS (SELECT lang, k, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: array_to_string(ws[i:i + k - 1], ' '))) AS phrase FROM w, range(1, 6) r(k) WHERE len(ws) >= k),
f AS (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 100),
c AS (SELECT lang, k, phrase, f AS a, unnest(range(1, k)) AS cut FROM f WHERE k > 1),
h AS (SELECT *, array_to_string(string_split(phrase, ' ')[1:cut], ' ') AS head, array_to_string(string_split(phrase, ' ')[cut + 1:], ' ') AS tail FROM c),
s AS (SELECT h.*, l.f AS l, r.f AS r, n.n, (1000 * a::HUGEINT * n.n // (l.f::HUGEINT * r.f))::BIGINT AS score FROM h JOIN f l ON l.lang = h.lang AND l.phrase = head JOIN f r ON r.lang = h.lang AND r.phrase = tail JOIN n ON n.lang = h.lang),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
o AS (SELECT * FROM b WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.lang = b.lang AND f.k > b.k AND f.f >= b.a AND contains(' ' || f.phrase || ' ', ' ' || b.phrase || ' ')))
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM o QUALIFY rank <= 2000"""

#: The others have no SQL: their tests hold them against brute force, exact round trips or known outcomes.
ORACLES: dict[str, str] = {"op1_line_dedup": line_dedup_sql(), "op7_ngram_join": NGRAM_SQL, "op10_warc": WARC_SQL, "op12_periodic_runs": RUNS_SQL, "op13_phrases": PHRASES_SQL}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
