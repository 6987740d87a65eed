"""Queries of sessions, messages, prompts and answers, each with the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import context, routing, sessions
from ..providers import provider
from ..scratch import fresh_path
from ..sources import stores
from . import retrieval, views
from .catalog import BARE, MODE, SESSIONS
from .registry import query

STRIPPED = "regexp_replace({}, '^\\s+|\\s+$', '', 'g')"
NOW = "2024-01-20 00:00:00"


@query("""WITH m AS (SELECT conv_id AS s, turn, role, text FROM conversations), t AS (SELECT s, arg_min(text, turn) FILTER (role = 'user') AS q, max(turn) AS n FROM m GROUP BY 1)
SELECT s AS chat_session_id, 0::BIGINT AS total_bytes, strftime(make_timestamp((n * 1000000)::BIGINT), '%Y-%m-%d %H:%M:%S') AS last_active_at, coalesce(CASE WHEN length(x) > 50 THEN left(x, 47) || '...' ELSE x END, 'New chat') AS title FROM (SELECT *, """ + STRIPPED.format("q") + """ AS x FROM t)""")
def message_store(spark, d):
    """Messages appended turn by turn in two batches; sessions' activity and titles follow from them."""
    store = fresh_path(spark, "message-store")
    m = views.messages(spark, d).withColumn("created_at", F.timestamp_seconds("created_at")).withColumn("sources_json", F.lit("[]"))
    late = F.unix_timestamp("created_at") > 2
    stores.add_messages(m.where(~late), store)
    stores.add_messages(m.where(late), store)
    s = stores.session_state(spark, store).withColumn("chat_session_id", F.col("chat_session_id").cast(m.schema["chat_session_id"].dataType))
    return s.withColumn("last_active_at", F.date_format("last_active_at", "yyyy-MM-dd HH:mm:ss"))


UPLOADS_SQL = "u AS (SELECT event_id, CASE WHEN event_id % 6 = 0 THEN 'no-id' || event_id ELSE md5(event_id::VARCHAR) END AS s, event_id % 7 <> 0 AS there, CASE WHEN event_id % 5 = 0 THEN user_id % 3 END AS owner, CASE WHEN event_id % 4 > 0 THEN user_id % 4 END AS usr, CASE WHEN event_id % 11 = 0 THEN 'text/plain' ELSE 'application/pdf' END AS kind, floor(abs(value) * 1000000)::BIGINT AS size FROM events)"


@query(f"WITH {UPLOADS_SQL} SELECT event_id, CASE WHEN NOT regexp_full_match(s, '[0-9a-fA-F]{{8}}-?([0-9a-fA-F]{{4}}-?){{3}}[0-9a-fA-F]{{12}}') THEN 'bad_id' WHEN NOT there THEN 'no_session' WHEN owner IS NOT NULL AND owner IS DISTINCT FROM usr THEN 'forbidden' WHEN kind <> 'application/pdf' THEN 'not_pdf' WHEN size > 20971520 THEN 'too_large' END AS reason FROM u")
def upload_reasons(spark, d):
    """Uploads with the first rule each breaks."""
    e, i = views.read(spark, d, "events"), F.col("event_id")
    u = e.select(
        i, F.when(i % 6 == 0, F.concat(F.lit("no-id"), i.cast("string"))).otherwise(F.md5(i.cast("string"))).alias("chat_session_id"), (i % 7 != 0).alias("session_exists"),
        F.when(i % 5 == 0, F.col("user_id") % 3).alias("owner_id"), F.when(i % 4 > 0, F.col("user_id") % 4).alias("user_id"),
        F.when(i % 11 == 0, "text/plain").otherwise("application/pdf").alias("content_type"), F.floor(F.abs("value") * 1_000_000).cast("long").alias("size"),
    )
    return sessions.reject_reason(u).select("event_id", "reason")


@query(f"SELECT event_id, ts < TIMESTAMP '{NOW}' AS code_expired, event_id % 9 >= 5 AS locked_out, coalesce(CASE WHEN event_id % 3 = 0 THEN ts + INTERVAL 90 MINUTE > TIMESTAMP '{NOW}' END, false) AS lockout_active, CASE WHEN event_id % 3 = 0 THEN greatest(1, (floor((epoch(ts) - epoch(TIMESTAMP '{NOW}')) / 60) + 1)::INT) END AS minutes_left, lpad((event_id * 7919 % 1000000)::VARCHAR, 6, '0') AS code FROM events")
def login_states(spark, d):
    """Identity state: expired codes, too many attempts, active lockouts and the minutes they last, six-digit codes."""
    e = views.read(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    now = F.lit(NOW).cast("timestamp")
    u = e.select("event_id", F.col("ts").alias("code_expires_at"), (F.col("event_id") % 9).alias("attempts"), F.when(F.col("event_id") % 3 == 0, F.col("ts") + F.expr("INTERVAL 90 MINUTES")).alias("lockout_until"))
    s = sessions.login_state(u, now)
    left = F.unix_micros("code_expires_at") / 1_000_000 - F.unix_timestamp(now)
    minutes = F.when(F.col("lockout_until").isNotNull(), T.minutes_left(left))
    return s.select("event_id", "code_expired", "locked_out", "lockout_active", minutes.alias("minutes_left"), T.six_digits(F.col("event_id") * 7919).alias("code"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN date_part('microseconds', ts) % 1000000 <> 0 THEN strftime(ts, '.%f') ELSE '' END || 'Z' AS at FROM events")
def iso_times(spark, d):
    return views.read(spark, d, "events").select("event_id", T.iso_z(F.col("ts").cast("timestamp")).alias("at"))


@query("SELECT conv_id, turn, nullif(left(" + STRIPPED.format("CASE WHEN turn % 5 = 0 THEN '  ' ELSE '  ' || text || '  ' END") + ", 100), '') AS title FROM conversations")
def renamed_titles(spark, d):
    raw = F.when(F.col("turn") % 5 == 0, F.lit("  ")).otherwise(F.concat(F.lit("  "), "text", F.lit("  ")))
    return views.read(spark, d, "conversations").select("conv_id", "turn", T.renamed_title(raw).alias("title"))


@query("SELECT conv_id, turn, text || ' — explain it in simpler terms' AS simpler, 'Summarize the answer to: ' || text AS summarised, 'broad' AS mode, true AS refers_back FROM conversations WHERE role = 'user'")
def rewritten_questions(spark, d):
    """What the answer's buttons ask; a summary is a broad question, and a simpler wording refers back."""
    q = views.read(spark, d, "conversations").where("role = 'user'")
    d_ = q.select("conv_id", "turn", T.simpler(F.col("text")).alias("simpler"), T.summarised(F.col("text")).alias("summarised"))
    return d_.select("*", T.question_mode(F.col("summarised"), F.lit(1)).alias("mode"), T.refers_back(F.col("simpler")).alias("refers_back"))


WORDS_OF_REFUSAL = f"string_split('{context.REFUSAL}', ' ')"


@query(f"WITH r AS (SELECT DISTINCT conv_id AS query_id FROM conversations WHERE conv_id % 3 = 0), w AS (SELECT query_id, unnest(range(len({WORDS_OF_REFUSAL}))) AS seq FROM r) SELECT query_id, seq::INT AS seq, 'token' AS event, '{{\"content\":\"' || {WORDS_OF_REFUSAL}[seq + 1] || ' \"}}' AS data FROM w UNION ALL SELECT query_id, len({WORDS_OF_REFUSAL})::INT, 'done', '{{}}' FROM r UNION ALL SELECT query_id, len({WORDS_OF_REFUSAL})::INT + 1, 'sources', '{{\"sources\":[]}}' FROM r")
def refusal_events(spark, d):
    r = views.read(spark, d, "conversations").where("conv_id % 3 = 0").select(F.col("conv_id").alias("query_id")).distinct()
    return context.answer_events(context.refusal_answers(r))


@query(f"WITH a AS (SELECT conv_id AS query_id, arg_min(text, turn) AS t FROM conversations WHERE role = 'assistant' GROUP BY 1), n AS (SELECT *, len(string_split(t, ' ')) AS n FROM a) SELECT query_id, n::INT AS seq, 'error' AS event, '{{\"message\":\"{context.FAILURE}\"}}' AS data FROM n WHERE query_id % 4 = 0 UNION ALL SELECT query_id, n::INT, 'done', '{{}}' FROM n WHERE query_id % 4 <> 0 UNION ALL SELECT query_id, n::INT + 1, 'sources', '{{\"sources\":[],\"confidence\":\"' || CASE WHEN n > 20 THEN 'high' ELSE 'low' END || '\"}}' FROM n WHERE query_id % 4 <> 0")
def closing_events(spark, d):
    """How answers end: an error for those that fail, else done and the sources with their confidence."""
    m = views.messages(spark, d).where("role = 'assistant'").groupBy(F.col("chat_session_id").alias("query_id")).agg(F.min_by("content", "created_at").alias("answer"))
    n = F.size(F.split("answer", " "))
    m = m.select("*", F.lit(None).cast("string").alias("sources_json"), (F.col("query_id") % 4 == 0).alias("failed"), T.confidence(n - 20).alias("confidence"))
    return context.answer_events(m).where("event <> 'token'")


@query("SELECT conv_id AS query_id, arg_min(text, turn) || ' ' AS answer, len(string_split(arg_min(text, turn), ' '))::INT AS pieces FROM conversations WHERE role = 'assistant' GROUP BY 1")
def streamed_answers(spark, d):
    """Answers sent piece by piece by a text model, and put together again from their events."""
    m = views.messages(spark, d).where("role = 'assistant'").groupBy(F.col("chat_session_id").alias("query_id")).agg(F.min_by("content", "created_at").alias("answer")).withColumn("sources_json", F.lit(None).cast("string"))
    pieces = m.select("query_id", F.size(provider("stream")(F.concat("answer", F.lit(" ")))).alias("pieces"))
    return context.streamed_answer(context.answer_events(m)).join(pieces, "query_id")


@query(f"WITH {SESSIONS} SELECT c.conv_id AS chat_session_id, c.turn AS created_at, c.role FROM conversations c JOIN s ON s.chat_session_id = c.conv_id WHERE s.user_id IS NULL OR s.user_id = 4")
def visible_messages(spark, d):
    """Messages of the sessions that a user may see: their own and those of guests."""
    mine = sessions.visible(views.sessions(spark, d), F.lit(4)).select("chat_session_id")
    return views.messages(spark, d).join(mine, "chat_session_id", "left_semi").select("chat_session_id", "created_at", "role")


#: The first two documents by id of three sources in each session, as contexts grouped by document.
GROUPED_SQL = "p AS (SELECT lang AS query_id, source, doc_id::INT AS page, left(text, 300) AS text, row_number() OVER (PARTITION BY lang, source ORDER BY doc_id) AS i FROM documents WHERE text <> '' QUALIFY i <= 2), g AS (SELECT *, dense_rank() OVER (PARTITION BY query_id ORDER BY source) AS k FROM p QUALIFY k <= 3)"


def _grouped(spark, d):
    p = views.read(spark, d, "documents").where("text <> ''")
    first = Window.partitionBy("lang", "source").orderBy("doc_id")
    p = p.withColumn("i", F.row_number().over(first)).where("i <= 2")
    chunk = F.struct("source", F.col("doc_id").cast("int").alias("page"), F.left("text", F.lit(300)).alias("text"))
    by = p.groupBy("lang", "source").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", chunk.alias("c")))), lambda x: x["c"]).alias("chunks"))
    by = by.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("source"))).where("k <= 3")
    groups = F.transform(F.array_sort(F.collect_list(F.struct("k", F.struct(F.col("source").alias("filename"), "chunks").alias("g")))), lambda x: x["g"])
    return by.groupBy(F.col("lang").alias("query_id")).agg(groups.alias("groups"))


@query(f"WITH {GROUPED_SQL} SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY k, i)::INT AS rank, source, page, md5(text) AS text FROM g")
def grouped_contexts(spark, d):
    return context.flat_contexts(_grouped(spark, d)).withColumn("text", F.md5("text"))


FIRST_LINE = "nullif(regexp_replace(string_split(text, chr(10))[1], '^\\s+|\\s+$', '', 'g'), '')"


@query(f"WITH {GROUPED_SQL}, a AS (SELECT query_id, k, '**' || source || '**' || chr(10) || chr(10) || coalesce({FIRST_LINE}, 'Use only the passages below. If they hol') AS part FROM g WHERE i = 1) SELECT query_id, string_agg(part, chr(10) || chr(10) ORDER BY k) AS answer FROM a GROUP BY 1")
def document_answers(spark, d):
    """Broad answers: one prompt per document to a text model, each part under its document's name."""
    flat = context.flat_contexts(_grouped(spark, d))
    q = flat.select("query_id").distinct().withColumn("question", F.lit("overview"))
    return context.generated(context.document_prompts(flat, q), provider("text"))


def _prompt_sql(note: str) -> str:
    head, rest = context.PROMPT.replace("'", "''").split("%s", 1)
    passages, question, _ = rest.split("%s")
    parts = [f"'{head}'", note, f"'{passages}'", "string_agg('[Source: ' || source || ', Page ' || page || ']' || chr(10) || text, chr(10) || chr(10) ORDER BY k, i)", f"'{question}'", "'Ask ' || query_id", "'" + context.PROMPT.rsplit("%s", 1)[1] + "'"]
    return " || ".join(parts)


NOTE_SQL = "CASE query_id " + " ".join(f"WHEN '{q}' THEN '{context.MODE_NOTES[m]}'" for q, m in (("en", "specific"), ("de", "broad"))) + f" ELSE '{context.MODE_NOTES['comparison']}' END"


@query(f"WITH {GROUPED_SQL} SELECT query_id, CASE query_id WHEN 'en' THEN 'specific' WHEN 'de' THEN 'broad' ELSE 'comparison' END AS mode, {_prompt_sql(NOTE_SQL)} AS prompt FROM g GROUP BY query_id")
def answer_prompts(spark, d):
    """One prompt per query from its contexts, with the note of its mode."""
    flat = context.flat_contexts(_grouped(spark, d))
    mode = F.when(F.col("query_id") == "en", "specific").when(F.col("query_id") == "de", "broad").otherwise("comparison")
    q = flat.select("query_id").distinct().withColumn("question", F.concat(F.lit("Ask "), "query_id"))
    return retrieval.prompts(flat.withColumn("mode", mode), q)


@query(f"WITH {views.TURNS_SQL}, w AS (SELECT *, {BARE.format('question')} AS w FROM r) SELECT query_id, {MODE} AS mode, CASE WHEN has_history AND list_has_any(w, {T.REFERENCE_WORDS!r}) THEN 'Of ' || question ELSE NULL END AS resolved FROM w")
def resolved_questions(spark, d):
    """Questions of conversations that refer back, resolved by a model: here one that puts a word before them."""
    model = lambda c: F.concat(F.lit("Of "), c)
    r = routing.route(views.turns(spark, d).drop("resolved"), model)
    return r.select("query_id", "mode", "resolved")
