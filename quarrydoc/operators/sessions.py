"""Sessions and messages: history, titles, rollups, expiry, deletion, upload rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import question_title

FILE_BYTES, SESSION_BYTES = 20 * 2**20, 50 * 2**20


def history(messages: DataFrame, n: int = 4, session: str = "chat_session_id", order: str = "created_at") -> DataFrame:
    """The last n messages of each session, in order."""
    w = Window.partitionBy(session)
    d = messages.withColumn("_r", F.row_number().over(w.orderBy(F.desc(order)))).where(F.col("_r") <= n)
    return d.withColumn("position", F.row_number().over(w.orderBy(order))).drop("_r")


def titles(messages: DataFrame, session: str = "chat_session_id", order: str = "created_at") -> DataFrame:
    """A title per session from its first user message; "New chat" where there is none."""
    first = F.min_by(F.when(F.col("role") == "user", F.col("content")), F.when(F.col("role") == "user", F.col(order)))
    return messages.groupBy(session).agg(F.coalesce(question_title(first), F.lit("New chat")).alias("title"))


def date_separators(rows: DataFrame, by: str, ts: str, key: str) -> DataFrame:
    """Rows whose day differs from the previous row's of the same `by`."""
    day = F.to_date(ts)
    w = Window.partitionBy(by).orderBy(ts, key)
    return rows.withColumn("day", day).withColumn("_p", F.lag("day").over(w)).where(F.col("_p").isNull() | (F.col("_p") != F.col("day"))).drop("_p")


def rollup(activity: DataFrame, session: str, ts: str, size: str) -> DataFrame:
    return activity.groupBy(session).agg(F.sum(size).alias("total_bytes"), F.max(ts).alias("last_active_at"), F.count(F.lit(1)).alias("n"))


def listing(sessions: DataFrame, owner: Column | None = None) -> DataFrame:
    """Sessions of an owner (guest sessions are open to all), latest first."""
    d = sessions if owner is None else sessions.where(F.col("user_id").isNull() | (F.col("user_id") == owner))
    return d.withColumn("position", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("last_active_at"), "chat_session_id")))


def stale_guests(sessions: DataFrame, now: Column, hours: int = 24) -> DataFrame:
    return sessions.where(F.col("is_guest") & (F.col("last_active_at") < now - F.expr(f"INTERVAL {hours} HOURS")))


def without_sessions(children: DataFrame, gone: DataFrame, session: str = "chat_session_id") -> DataFrame:
    """Cascade: the child rows of sessions that stay."""
    return children.join(gone.select(session), session, "left_anti")


def visible(rows: DataFrame, user: Column) -> DataFrame:
    return rows.where(F.col("user_id").isNull() | (F.col("user_id") == user))


def reject_reason(u: DataFrame) -> DataFrame:
    """First rule an upload breaks, without the quota: id, session, owner, type, size, signature."""
    uuid = r"^[0-9a-fA-F]{8}-?([0-9a-fA-F]{4}-?){3}[0-9a-fA-F]{12}$"
    first = (
        F.when(~F.col("chat_session_id").rlike(uuid), "bad_id")
        .when(~F.col("session_exists"), "no_session")
        .when(F.col("owner_id").isNotNull() & ~F.col("owner_id").eqNullSafe(F.col("user_id")), "forbidden")
        .when(F.col("content_type") != "application/pdf", "not_pdf")
        .when(F.col("size") > FILE_BYTES, "too_large")
    )
    return u.withColumn("reason", first)


def admit_uploads(uploads: DataFrame, session: str = "chat_session_id", order: str = "seq", limit: int = SESSION_BYTES) -> DataFrame:
    """accepted, reason and used (bytes accepted so far) per upload in order; rejected files do not count.

    The quota is a recurrence over accepted uploads, so sessions are walked in order, each
    session's rows in one task: a session holds at most some thousands of uploads.
    """
    schema = ", ".join(f"{n} {k}" for n, k in uploads.dtypes if n != "reason") + ", accepted boolean, reason string, used bigint"
    names = [n for n in uploads.columns if n != "reason"]

    def walk(pdf):
        pdf = pdf.sort_values(order)
        used, rows = 0, []
        for size, magic, reason in zip(pdf["size"], pdf["magic_ok"], pdf["reason"]):
            why = reason if isinstance(reason, str) else ("quota" if used + size > limit else (None if magic else "bad_signature"))
            used += 0 if why else int(size)
            rows.append((why is None, why, used))
        out = pdf[names].copy()
        out["accepted"], out["reason"], out["used"] = [r[0] for r in rows], [r[1] for r in rows], [r[2] for r in rows]
        return out

    return uploads.groupBy(session).applyInPandas(walk, schema)


def login_state(users: DataFrame, now: Column, max_attempts: int = 5) -> DataFrame:
    """Predicates over identity state: expired code, too many attempts, active lockout."""
    return users.select("*", (F.col("code_expires_at") < now).alias("code_expired"), (F.col("attempts") >= max_attempts).alias("locked_out"), F.coalesce(F.col("lockout_until") > now, F.lit(False)).alias("lockout_active"))
