"""The registered queries, the SQL that must give the same rows, and the stored indexes they share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..operators import lexical
from ..scratch import fresh_path, hadoop
from . import views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


#: Lexical indexes made by this process: (application, files of the chunks) -> path.
_INDEXES: dict[tuple, str] = {}


def _files(spark: SparkSession, path: str) -> tuple:
    """Names, sizes and times of the files of a table: another table at the same path has others."""
    hpath, fs = hadoop(spark, path)
    return tuple(sorted((s.getPath().toString(), s.getLen(), s.getModificationTime()) for s in fs.listStatus(hpath)))


def _state(spark: SparkSession, d: str) -> tuple:
    return spark.sparkContext.applicationId, _files(spark, f"{d}/documents.parquet")


def index_there(spark: SparkSession, d: str) -> str | None:
    """The stored index by session where one was built for these files; a few questions alone are no reason to build it."""
    return _INDEXES.get(_state(spark, d))


def index_of(spark: SparkSession, d: str) -> str:
    """The stored index over the chunks of `d` by session, built once while their files stay."""
    at = _state(spark, d)
    if at not in _INDEXES:
        path = fresh_path(spark, "bm25-index")
        lexical.build_index(views.chunks(spark, d), path)
        _INDEXES[at] = path
    return _INDEXES[at]


def query(sql: str | None = None):
    """Register a function under its own name, with its SQL."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


def values(rows: list[tuple]) -> str:
    lit = lambda v: "NULL" if v is None else (str(v).lower() if isinstance(v, bool) else (str(v) if isinstance(v, (int, float)) else "'" + v.replace("'", "''") + "'"))
    return ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows)
