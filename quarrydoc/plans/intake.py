"""Queries of sources, stores, layout and chunking, each with the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import chunking, layout, lexical
from ..providers import provider
from ..scratch import fresh_path
from ..sources import files, stores
from ..streaming.sessions import refresh_lexical
from . import views
from .catalog import CLUSTERS_SQL, FULL, HASH, MARKDOWN_SQL, PAGES, PLAUSIBLE, TEXT_LINES, bm25_sql, caption_sql
from .registry import query


@query("SELECT page_id::INT AS page, CASE WHEN page_id % 3 = 0 THEN 'seen ' || url ELSE url END AS text FROM pages WHERE page_id % 3 <> 0 OR page_id % 2 = 1")
def ocr_pages(spark, d):
    """Every third page has no text; those with images are read by OCR, the others go."""
    p = views.read(spark, d, "pages").withColumn("text", F.when(F.col("page_id") % 3 == 0, F.lit(" \n")).otherwise(F.col("url")))
    p = p.select(F.col("page_id").cast("int").alias("page"), "text", (F.col("page_id") % 2).cast("int").alias("n_images"), "url")
    return stores.with_ocr(p, provider("ocr")(F.encode(F.concat(F.lit("seen "), "url"), "UTF-8"))).select("page", "text")


def _files(spark, d):
    p = views.read(spark, d, "pages")
    head = F.when(F.col("page_id") % 7 == 0, "LOCKED").when(F.col("page_id") % 7 == 1, "BROKEN").otherwise("%PDF-")
    body = F.when(F.col("page_id") % 7 == 2, F.lit("")).otherwise(F.concat("url", F.lit("\n \n"), F.reverse("url")))
    return p.select(F.concat(F.lit("f"), F.col("page_id").cast("string")).alias("filename"), F.encode(F.concat(head, body), "UTF-8").alias("content"))


def _items(spark, d):
    """Page items of files written from `pages`, as the data source reads them."""
    path = fresh_path(spark, "page-files")
    files.write_files(_files(spark, d), path)
    return files.read_items(spark, path, "quarrydoc.plans.parsers:line_pages", stores.PAGE_ITEMS)


@query("WITH f AS (SELECT 'f' || page_id AS source, url FROM pages WHERE page_id % 7 > 2) SELECT source, 1 AS page, url AS text FROM f UNION ALL SELECT source, 2, 'image 1' FROM f UNION ALL SELECT source, 3, reverse(url) FROM f UNION ALL SELECT 'f' || page_id, 1, 'image 0' FROM pages WHERE page_id % 7 = 2")
def parsed_pages(spark, d):
    """Pages of files numbered from 1; pages without text are read by OCR."""
    return stores.pages_of(_items(spark, d), provider("ocr"))[0]


@query("SELECT 'f' || page_id AS filename, CASE page_id % 7 WHEN 0 THEN 'password' ELSE 'corrupt' END AS reason FROM pages WHERE page_id % 7 < 2")
def refused_files(spark, d):
    return stores.pages_of(_items(spark, d), provider("ocr"))[1]


@query(f"""WITH {TEXT_LINES}, pg AS (SELECT doc, page, page % 5 AS n_rects, list(line ORDER BY i) AS ls FROM tl GROUP BY ALL),
one AS (SELECT *, CASE WHEN page % 2 = 0 THEN list_transform(ls, lambda l: [l]) ELSE list_transform(ls, lambda l: string_split(l, '|')) END AS a, list_transform(ls, lambda l: string_split(l, ' ')) AS b FROM pg),
tb AS (SELECT doc, page, 1 AS tbl, CASE WHEN n_rects >= 3 AND len(a[1]) <= 1 THEN b ELSE a END AS rows FROM one), {FULL}
SELECT doc AS source, page, tbl AS seq, md5(CASE WHEN page % 3 = 0 THEN 'Table of ' || doc || chr(10) || chr(10) ELSE '' END || {MARKDOWN_SQL}) AS text, 'table' AS element_type FROM kept WHERE {PLAUSIBLE}""")
def table_source(spark, d):
    """A table per page; where ruling lines give one column among three row bands or more, text columns are taken."""
    path = fresh_path(spark, "table-files")
    t = views.read(spark, d, "documents").where("text is not null")
    head = F.concat_ws(" ", "source", F.col("doc_id").cast("string"))
    files.write_files(t.select(F.concat_ws("_", "source", F.col("doc_id").cast("string")).alias("filename"), F.encode(F.concat_ws("\n", head, "text"), "UTF-8").alias("content")), path)
    cells = "array<array<array<string>>>"
    p = files.read_items(spark, path, "quarrydoc.plans.parsers:line_tables", f"doc string, page int, n_rects int, by_lines {cells}, by_text {cells}")
    found = layout.page_tables(p, F.col("by_lines"), F.col("by_text"))
    found = found.withColumn("caption", F.when(F.col("page") % 3 == 0, F.concat(F.lit("Table of "), F.col("doc"))))
    return layout.table_chunks(found).withColumn("text", F.md5("text"))


IMAGES_SQL = f"images AS (SELECT (user_id % 5)::VARCHAR AS doc, dayofmonth(ts)::INT AS page, event_id AS seq, CASE WHEN event_id % 13 <> 0 THEN event_id % 400 END AS width, 100 + user_id * 7 % 300 AS height, CASE WHEN event_id % 5 <> 0 THEN ({HASH.format('event_id::VARCHAR')} % 600)::DOUBLE END AS top, props AS image FROM events)"
NOTES_SQL = f"w AS (SELECT (user_id % 5)::VARCHAR AS doc, dayofmonth(ts)::INT AS page, event_id AS seq, CASE event_id % 3 WHEN 0 THEN 'Figure ' ELSE 'Note ' END || event_id AS text, ({HASH.format('event_id::VARCHAR')} % 700)::DOUBLE AS top FROM events)"


def _render(doc, page, x0, y0, x1, y1, scale):
    """Stand-in for a drawing: its box as text."""
    box = [F.concat_ws("x", a.cast("int").cast("string"), b.cast("int").cast("string")) for a, b in ((x0, y0), (x1, y1))]
    return F.encode(F.concat_ws(" ", *box, F.lit(f"at {scale}")), "UTF-8")


@query(f"""WITH {CLUSTERS_SQL}, {IMAGES_SQL}, {NOTES_SQL},
cand AS (SELECT doc, page, 0 AS k, seq, top, top + 40 AS bottom, octet_length(image::BLOB) AS bytes, 'image' AS kind FROM images WHERE width >= 150 AND height >= 150
UNION ALL SELECT doc, page, 1, cluster, y0, y1, length(x0::INT || 'x' || y0::INT || ' ' || x1::INT || 'x' || y1::INT || ' at 2'), 'chart' FROM clusters),
e AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY page, k, seq)::INT AS elem FROM cand QUALIFY elem <= 20), {caption_sql('figure|fig\\.|chart|diagram')}
SELECT e.doc AS source, e.page, e.elem AS seq, coalesce(line || chr(10) || chr(10) || line, 'image of ' || bytes || ' bytes') AS text, e.kind AS element_type FROM e LEFT JOIN m ON e.doc = m.doc AND e.page = m.page AND e.elem = m.elem""")
def visual_source(spark, d):
    """Images and charts of each document, the first twenty by page, captioned and described."""
    ev = views.read(spark, d, "events")
    at = [(F.col("user_id") % 5).cast("string").alias("doc"), F.dayofmonth("ts").alias("page"), F.col("event_id").alias("seq")]
    h = T.portable_hash(F.col("event_id").cast("string"))
    top = F.when(F.col("event_id") % 5 != 0, (h % 600).cast("double"))
    images = ev.select(*at, F.when(F.col("event_id") % 13 != 0, F.col("event_id") % 400).alias("width"), (100 + F.col("user_id") * 7 % 300).alias("height"), top.alias("top"), (top + 40).alias("bottom"), F.encode("props", "UTF-8").alias("image"))
    text = F.concat(F.when(F.col("event_id") % 3 == 0, "Figure ").otherwise("Note "), F.col("event_id").cast("string"))
    notes = ev.select(*at, text.alias("text"), (h % 700).cast("double").alias("top"))
    charts = layout.chart_candidates(layout.drawing_clusters(views.drawings(spark, d)), _render)
    return layout.visual_chunks(images, charts, notes, provider("vision"))


@query(f"""WITH {PAGES}, c AS (SELECT *, last_value(title IGNORE NULLS) OVER (PARTITION BY source ORDER BY page, sec ROWS UNBOUNDED PRECEDING) AS s FROM secs),
x AS (SELECT source, page, kind FROM pt, (VALUES ('table'), ('image')) v(kind) WHERE page % 5 = 0), known AS (SELECT source, page, arg_max_null(s, sec) AS s FROM c GROUP BY 1, 2), lst AS (SELECT source, arg_max_null(s, (page, sec)) AS l FROM c GROUP BY 1),
y AS (SELECT x.source, x.page, kind, CASE WHEN known.page IS NOT NULL THEN known.s ELSE l END AS s, row_number() OVER (PARTITION BY x.source, kind ORDER BY x.page) AS n FROM x LEFT JOIN known USING (source, page) LEFT JOIN lst USING (source)),
z AS (SELECT source, page, '_c' || row_number() OVER (PARTITION BY source, page ORDER BY sec) AS id, s, 'text' AS kind, NULL AS label, body AS text FROM c WHERE body <> '' UNION ALL SELECT source, page, CASE kind WHEN 'table' THEN '_tbl' ELSE '_vis' END || n, s, kind, CASE kind WHEN 'table' THEN '[Table]' ELSE '[Image]' END, kind || ' of ' || page FROM y)
SELECT left(md5(source), 8) || '_p' || page || id AS chunk_id, page, source, s AS section_title, kind AS element_type, md5(CASE WHEN coalesce(s, '') = '' AND label IS NULL THEN text ELSE concat_ws(chr(10), CASE WHEN s <> '' THEN '[Section: ' || s || ']' END, label) || chr(10) || chr(10) || text END) AS text FROM z""")
def page_chunks(spark, d):
    """The whole chunker over pages, with a table and an image on every fifth: sections stay whole, as no limit cuts them."""
    pages = views.pages_text(spark, d)
    extras = pages.where("page % 5 = 0").withColumn("element_type", F.explode(F.array(F.lit("table"), F.lit("image"))))
    extras = extras.select("source", "page", F.lit(1).alias("seq"), F.concat(F.col("element_type"), F.lit(" of "), F.col("page").cast("string")).alias("text"), "element_type")
    return chunking.chunk_pages(pages, extras, size=10**9, overlap=0).withColumn("text", F.md5("text"))


@query("""WITH n AS (SELECT doc_id, text, length(text) AS n FROM documents WHERE text <> ''), w AS (SELECT doc_id, text, unnest(range(CASE WHEN n <= 200 THEN 1 ELSE 1 + ceil((n - 200) / 150)::BIGINT END)) AS k FROM n)
SELECT doc_id, md5(regexp_replace(substr(text, (1 + 150 * k)::BIGINT, 200), '^\\s+|\\s+$', '', 'g')) AS part, count(*) AS n FROM w GROUP BY ALL HAVING any_value(regexp_replace(substr(text, (1 + 150 * k)::BIGINT, 200), '^\\s+|\\s+$', '', 'g')) <> ''""")
def character_windows(spark, d):
    """Splitting by characters alone: windows of 200 that share 50 with the one before."""
    t = views.read(spark, d, "documents").select("doc_id", F.explode(chunking.split_column(200, 50, ("",))(F.col("text"))).alias("part"))
    return t.groupBy("doc_id", F.md5("part").alias("part")).agg(F.count(F.lit(1)).alias("n"))


@query("""WITH RECURSIVE q AS (SELECT doc_id, generate_subscripts(ws, 1) AS i, unnest(ws) AS w FROM (SELECT doc_id, string_split(text, ' ') AS ws FROM documents WHERE text <> '')),
n AS (SELECT doc_id, i, length(w) + CASE WHEN i > 1 THEN 1 ELSE 0 END AS n FROM q WHERE i > 1 OR w <> ''),
c AS (SELECT doc_id, i, sum(n) OVER (PARTITION BY doc_id ORDER BY i) AS e, sum(n) OVER (PARTITION BY doc_id ORDER BY i) - n AS s FROM n),
win AS (SELECT doc_id, min(s) AS s, max(e) AS e FROM c WHERE e <= 512 GROUP BY 1
UNION ALL (WITH nxt AS (SELECT w.doc_id, min(c.s) AS s FROM win w JOIN c f ON f.doc_id = w.doc_id AND f.s = w.e JOIN c ON c.doc_id = w.doc_id AND c.s >= w.s AND c.s <= w.e WHERE w.e - c.s <= 100 AND f.e - c.s <= 512 GROUP BY 1)
SELECT nxt.doc_id, any_value(nxt.s), max(c.e) FROM nxt JOIN c ON c.doc_id = nxt.doc_id AND c.s >= nxt.s AND c.e - nxt.s <= 512 GROUP BY 1)),
t AS (SELECT doc_id, regexp_replace(substr(text, (s + 1)::BIGINT, (e - s)::BIGINT), '^\\s+|\\s+$', '', 'g') AS part FROM win JOIN documents USING (doc_id))
SELECT doc_id, md5(part) AS part, count(*) AS n FROM t WHERE part <> '' GROUP BY ALL""")
def word_windows(spark, d):
    """Splitting at spaces: greedy windows of 512 characters that share up to 100 with the one before."""
    t = views.read(spark, d, "documents").select("doc_id", F.explode(chunking.split_column(512, 100, (" ",))(F.col("text"))).alias("part"))
    return t.groupBy("doc_id", F.md5("part").alias("part")).agg(F.count(F.lit(1)).alias("n"))


@query("""WITH RECURSIVE q AS (SELECT doc_id, generate_subscripts(ls, 1) AS i, unnest(ls) AS l FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text <> '')),
n AS (SELECT doc_id, i, length(l) + CASE WHEN i > 1 THEN 1 ELSE 0 END AS n FROM q WHERE i > 1 OR l <> ''),
c AS (SELECT doc_id, n, sum(n) OVER w AS e, sum(n) OVER w - n AS s, sum(CASE WHEN n >= 256 THEN 1 ELSE 0 END) OVER w AS g FROM n WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
r AS (SELECT doc_id, g, s, e FROM c WHERE n < 256), o AS (SELECT doc_id, g, min(s) AS s FROM r GROUP BY ALL),
win AS (SELECT doc_id, g, o.s AS s, max(r.e) AS e FROM o JOIN r USING (doc_id, g) WHERE r.e - o.s <= 256 GROUP BY ALL
UNION ALL (WITH nxt AS (SELECT w.doc_id, w.g, min(r.s) AS s FROM win w JOIN r f ON f.doc_id = w.doc_id AND f.g = w.g AND f.s = w.e JOIN r ON r.doc_id = w.doc_id AND r.g = w.g AND r.s >= w.s AND r.s <= w.e WHERE w.e - r.s <= 50 AND f.e - r.s <= 256 GROUP BY 1, 2)
SELECT nxt.doc_id, nxt.g, any_value(nxt.s), max(r.e) FROM nxt JOIN r ON r.doc_id = nxt.doc_id AND r.g = nxt.g AND r.s >= nxt.s AND r.e - nxt.s <= 256 GROUP BY 1, 2)),
long AS (SELECT doc_id, s, e, unnest(range(CASE WHEN n = 256 THEN 1 ELSE 1 + ceil((n - 256) / 206)::BIGINT END)) AS k FROM c WHERE n >= 256),
cut AS (SELECT doc_id, s, e FROM win UNION ALL SELECT doc_id, s + 206 * k, least(e, s + 206 * k + 256) FROM long),
t AS (SELECT doc_id, regexp_replace(substr(text, (s + 1)::BIGINT, (e - s)::BIGINT), '^\\s+|\\s+$', '', 'g') AS part FROM cut JOIN documents USING (doc_id))
SELECT doc_id, md5(part) AS part, count(*) AS n FROM t WHERE part <> '' GROUP BY ALL""")
def line_windows(spark, d):
    """The splitter's recursion: greedy windows of lines, and lines of 256 characters or more split by characters."""
    t = views.read(spark, d, "documents").select("doc_id", F.explode(chunking.split_column(256, 50, ("\n", ""))(F.col("text"))).alias("part"))
    return t.groupBy("doc_id", F.md5("part").alias("part")).agg(F.count(F.lit(1)).alias("n"))


@query("""WITH w AS (SELECT doc_id, unnest(list_filter(string_split_regex(lower(text), '\\s+'), lambda x: x <> '')) AS w FROM documents),
u AS (SELECT w, hex(w) AS h FROM (SELECT DISTINCT w FROM w)), b AS (SELECT w, flatten(list_transform(range(len(h) // 2), lambda i: [('0x' || substr(h, (2 * i + 1)::INT, 2))::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1])) AS b FROM u),
k AS (SELECT w, xor(list_reduce(list_concat([4294967295::BIGINT], b), lambda s, x: CASE WHEN x >= 0 THEN xor(s, x) WHEN s % 2 = 1 THEN xor(s >> 1, 3988292384) ELSE s >> 1 END), 4294967295) % 64 AS dim FROM b),
n AS (SELECT doc_id, dim, count(*) AS n FROM w JOIN k USING (w) GROUP BY ALL)
SELECT doc_id, dim::INT AS dim, round(n / sqrt(sum(n * n) OVER (PARTITION BY doc_id)), 6) AS value FROM n""")
def chunk_vectors(spark, d):
    """The embedder's vectors, one row per dimension that is not 0."""
    v = views.read(spark, d, "documents").select("doc_id", F.posexplode(provider("embedder")(F.col("text"))).alias("dim", "value"))
    return v.where("value <> 0").withColumn("value", F.round("value", 6))


@query("SELECT 'en' AS chat_session_id, source AS filename, left(md5(source), 8) || '_p' || doc_id || '_c1' AS chunk_id, CASE WHEN regexp_replace(text, '\\s+', '', 'g') = '' THEN 0.0 ELSE 1.0 END AS length, (SELECT count(*) FROM documents WHERE text IS NOT NULL) AS stored FROM documents WHERE lang = 'en' AND source IN ('src1', 'src2', 'src3') AND text IS NOT NULL")
def chunk_store(spark, d):
    """Chunks embedded and stored, then read back for one session and three files."""
    path = fresh_path(spark, "chunk-store")
    c = views.chunks(spark, d).where("text is not null").withColumns({"element_type": F.lit("text"), "section_title": F.lit(None).cast("string")})
    stored = stores.add_chunks(c, path, provider("embedder"))
    r = stores.rows_of(spark, path, "chunks").where(F.col("chat_session_id") == "en").where(F.col("filename").isin("src1", "src2", "src3"))
    size = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x * x))
    return r.select("chat_session_id", "filename", "chunk_id", F.round(size, 4).alias("length"), F.lit(stored).cast("long").alias("stored"))


@query("SELECT lang AS chat_session_id, count(*) AS n_documents, sum(strlen(coalesce(text, '')))::BIGINT AS total_bytes, (SELECT count(*) FROM documents) AS stored, string_agg(source || '_' || doc_id, ',' ORDER BY doc_id) AS names FROM documents GROUP BY 1")
def document_store(spark, d):
    """Every row a document of its session: chunks, document rows and activity are stored; what a listing shows."""
    store = fresh_path(spark, "document-store")
    rows = views.read(spark, d, "documents").withColumn("t", F.coalesce("text", F.lit("")))
    name = F.concat_ws("_", "source", F.col("doc_id").cast("string"))
    docs = rows.select(F.col("lang").alias("chat_session_id"), name.alias("filename"), F.lit(None).cast("string").alias("display_title"), F.lit("application/pdf").alias("content_type"), F.encode("t", "UTF-8").alias("data"), F.timestamp_seconds("doc_id").alias("at"))
    c = views.chunks(spark, d).withColumns({"element_type": F.lit("text"), "section_title": F.lit(None).cast("string"), "text": F.coalesce("text", F.lit(""))})
    stored = stores.add_document(docs, c, store, provider("embedder"))
    by = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.regexp_extract("filename", "_([0-9]+)$", 1).cast("long").alias("i"), "filename"))), lambda x: x["filename"]), ",")
    listed = stores.metadata(spark, store).groupBy("chat_session_id").agg(F.count(F.lit(1)).alias("n_documents"), by.alias("names"))
    size = stores.rows_of(spark, store, "activity").groupBy("chat_session_id").agg(F.sum("bytes").alias("total_bytes"))
    return listed.join(size, "chat_session_id").withColumn("stored", F.lit(stored).cast("long"))


@query("SELECT md5(html) AS content, length(html) AS n FROM pages WHERE page_id = 3")
def document_bytes(spark, d):
    """One stored file read back by session and name."""
    p = views.read(spark, d, "pages").select(F.lit("s").alias("chat_session_id"), F.col("page_id").cast("string").alias("filename"), F.encode("html", "UTF-8").alias("data"))
    return stores.binary_of(p, "s", "3").select(F.md5("data").alias("content"), F.length(F.decode("data", "UTF-8")).cast("long").alias("n"))


@query("SELECT min(doc_id) AS doc_id, source FROM documents WHERE source = 'src1' GROUP BY 2")
def point_lookup(spark, d):
    return stores.lookup(views.read(spark, d, "documents"), "source", "src1", "doc_id").select("doc_id", "source")


@query("SELECT text AS question, 'src' || item_id AS expected_source, item_id::INT AS expected_page, list_slice(string_split(text, ' '), 1, 3) AS expected_keywords FROM benchmark")
def eval_file(spark, d):
    """The evaluation set written as one JSON list and read back."""
    path = fresh_path(spark, "eval-file")
    b = views.read(spark, d, "benchmark")
    item = F.struct(F.col("text").alias("question"), F.concat(F.lit("src"), F.col("item_id").cast("string")).alias("expected_source"), F.col("item_id").cast("int").alias("expected_page"), F.slice(F.split("text", " "), 1, 3).alias("expected_keywords"))
    b.agg(F.to_json(F.collect_list(item)).alias("value")).write.text(path)  # a stated, small set of questions
    return stores.read_eval(spark, path)


@query("SELECT lang AS config, count(*) AS n, round(avg(n_chars), 6) AS mean FROM documents GROUP BY 1")
def metrics_file(spark, d):
    path = fresh_path(spark, "metrics-file")
    m = views.read(spark, d, "documents").groupBy(F.col("lang").alias("config")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("n_chars"), 6).alias("mean"))
    stores.write_metrics(m, path)
    return spark.read.schema("config string, n long, mean double").json(path)


@query("SELECT 'site' || page_id % 7 AS filename, count(*) AS n_chunks FROM pages GROUP BY 1 UNION ALL SELECT NULL, count(*) FROM pages")
def ingest_counts(spark, d):
    """Many files to chunks, store and index in one job; a page's text is its address, which makes one chunk."""
    store = fresh_path(spark, "ingest")
    p = views.read(spark, d, "pages").select(F.concat(F.lit("site"), (F.col("page_id") % 7).cast("string")).alias("source"), F.col("page_id").cast("int").alias("page"), F.col("url").alias("text"))
    counts = stores.ingest(p, store, "all", provider("embedder"))
    indexed = lexical.in_force(spark, store).agg(F.sum("n").alias("n")).head()["n"] or 0
    return counts.where(F.col("filename").isNotNull() | (F.col("n_chunks") == indexed))


STORED_SQL = "st AS (SELECT source AS s, doc_id AS i, coalesce(text, '') AS t, regexp_extract(source, '[0-9]+')::INT AS no FROM documents), act AS (SELECT s, any_value(no) % 2 = 1 AS guest, max(i) AS last FROM st GROUP BY 1), keep AS (SELECT s FROM act WHERE NOT (guest AND last < (SELECT max(i) FROM st) - 10))"


def _stored(spark, d):
    """A store that documents entered in two steps, every source a session and odd ones guests; a third step stopped before it was published."""
    store = fresh_path(spark, "session-store")
    rows = views.read(spark, d, "documents").withColumns({"chat_session_id": F.col("source"), "t": F.coalesce("text", F.lit("")), "at": F.timestamp_seconds(F.col("doc_id") * 3600)})
    name = F.concat_ws("_", "source", F.col("doc_id").cast("string"))
    docs = rows.select("chat_session_id", name.alias("filename"), F.lit(None).cast("string").alias("display_title"), F.lit("application/pdf").alias("content_type"), F.encode("t", "UTF-8").alias("data"), "at", "doc_id")
    chunks = rows.select(T.chunk_id(F.col("source"), F.col("doc_id"), "c", F.lit(1)).alias("chunk_id"), name.alias("filename"), F.col("doc_id").cast("int").alias("page"), F.col("t").alias("text"), F.lit("text").alias("element_type"), F.lit(None).cast("string").alias("section_title"), "chat_session_id", "doc_id")
    no = F.regexp_extract("chat_session_id", "[0-9]+", 0).cast("int")
    who = rows.groupBy("chat_session_id").agg(F.min("at").alias("created_at")).select("chat_session_id", (no % 2 == 1).alias("is_guest"), F.lit(None).cast("string").alias("user_id"), "created_at")
    stores.add_sessions(who, store)
    for part in (0, 1):
        half = F.col("doc_id") % 2 == part
        stores.add_document(docs.where(half), chunks.where(half), store, provider("embedder"))
    docs.where("doc_id < 50").write.parquet(f"{store}/documents/batch=stopped")
    return store, rows.agg(F.max("at").alias("now")).head()["now"]


def _contents(spark, store):
    """Per session what each table of the store and its index hold."""
    tables = [stores.rows_of(spark, store, "chunks").select("chat_session_id", F.lit("chunks").alias("what")), stores.rows_of(spark, store, "documents").select("chat_session_id", F.lit("documents").alias("what"))]
    counts = tables[0].unionByName(tables[1]).groupBy("chat_session_id").pivot("what", ["chunks", "documents"]).count()
    size = stores.session_state(spark, store).select("chat_session_id", "total_bytes")
    indexed = lexical.in_force(spark, store).select(F.col("session").alias("chat_session_id"), F.col("n").alias("indexed"), F.round("avgdl", 6).alias("avgdl"))
    return counts.join(size, "chat_session_id").join(indexed, "chat_session_id")


CONTENTS_SQL = "SELECT s AS chat_session_id, count(*) AS chunks, count(*) AS documents, sum(strlen(t))::BIGINT AS total_bytes, count(*) AS indexed, round(avg(len(list_filter(regexp_split_to_array(lower(t), '\\s+'), lambda x: x <> ''))), 6) AS avgdl FROM st"


@query(f"WITH {STORED_SQL} {CONTENTS_SQL} GROUP BY 1")
def store_after_commit(spark, d):
    """Documents, chunks, activity and postings of a store: all of each published step, nothing of the one that stopped."""
    return _contents(spark, _stored(spark, d)[0])


@query(f"WITH {STORED_SQL} {CONTENTS_SQL} WHERE s IN (FROM keep) GROUP BY 1")
def store_after_deletion(spark, d):
    """Guests without activity in the last ten hours are gone from every table and the index, and from the files after compaction."""
    store, now = _stored(spark, d)
    stores.expire_guests(spark, store, F.lit(now), 10)
    stores.compact_store(spark, store)
    return _contents(spark, store)


@query(bm25_sql(views.QUESTIONS, 20) + " SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM bm25")
def index_refresh(spark, d):
    """A lexical index over half of the chunks, brought up to date by a stream when the other half arrives: a second segment, no chunk is read twice."""
    store = fresh_path(spark, "refresh")
    c = views.chunks(spark, d).select("chat_session_id", "chunk_id", "text")
    half = F.pmod(F.xxhash64("chunk_id"), F.lit(2)) == 0
    c.where(half).write.parquet(f"{store}/chunks")
    stream = lambda: spark.readStream.schema(c.schema).parquet(f"{store}/chunks")
    refresh_lexical(stream(), f"{store}/checkpoint", f"{store}/index").awaitTermination()
    c.where(~half).write.mode("append").parquet(f"{store}/chunks")
    refresh_lexical(stream(), f"{store}/checkpoint", f"{store}/index").awaitTermination()
    return lexical.search_index(spark, f"{store}/index", views.questions(spark)).withColumn("score", F.round("score", 6))


@query("SELECT page_id, 'Describe the figure. ' || CASE WHEN page_id % 2 = 0 THEN 'Text near it: \"' || url || '\". ' ELSE '' END AS prompt, 'data:image/png;base64,' || base64(url::BLOB) AS image FROM pages")
def vision_requests(spark, d):
    from ..providers import vision_request

    p = views.read(spark, d, "pages")
    prompt, image = vision_request(F.encode("url", "UTF-8"), F.when(F.col("page_id") % 2 == 0, F.col("url")))
    return p.select("page_id", prompt.alias("prompt"), image.alias("image"))


@query("WITH f AS (SELECT source, arg_min(text, doc_id) AS t FROM documents WHERE regexp_replace(text, '\\s+', '', 'g') <> '' GROUP BY 1) SELECT source, coalesce(nullif(trim(array_to_string(string_split(left(t, 1500), ' ')[1:3], ' '), '\"'), ''), source) AS title FROM f")
def display_titles(spark, d):
    """Titles of files from their first page by a stand-in for the model: its first three words."""
    from ..providers import display_title

    p = views.read(spark, d, "documents").where(F.length(T.strip(F.coalesce("text", F.lit("")))) > 0)
    first = p.groupBy("source").agg(F.min_by("text", "doc_id").alias("t"))
    model = lambda c: F.substring_index(c, " ", 3)
    return first.select("source", display_title(F.col("t"), F.col("source"), model).alias("title"))


@query("SELECT page_id, regexp_extract(replace(url, 'page', '\\'), '[^/\\\\]*$') AS name FROM pages")
def basenames(spark, d):
    return views.read(spark, d, "pages").select("page_id", T.basename(F.replace("url", F.lit("page"), F.lit("\\"))).alias("name"))
