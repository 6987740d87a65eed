"""Page text to chunks: sections, recursive splitting, numbering, prefixes."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import chunk_id, section_prefix, strip
from .prefix import carry_forward, page_bucket

#: Separators from coarse to fine, characters of a chunk, characters shared with the one before.
SEPARATORS = ("\n\n", "\n", ". ", " ", "")
SIZE, OVERLAP = 512, 100
#: Characters of parts that a worker holds as Python strings.
HELD = 2**20


def sections(pages: DataFrame) -> DataFrame:
    """(source, page, sec, title, body): text before the first `# ` heading has a null title; an empty lead is dropped."""
    heading = r"(?md)^# (.+)$"  # lines end with LF alone
    titles = F.concat(F.array(F.lit(None).cast("string")), F.regexp_extract_all("text", F.lit(heading), 1))
    bodies = F.split("text", r"(?md)^# (?:.+)$")
    d = pages.where(F.length(strip(F.col("text"))) > 0)
    d = d.select("source", "page", F.posexplode(F.arrays_zip(titles.alias("t"), bodies.alias("b"))).alias("sec", "x"))
    d = d.select("source", "page", "sec", strip(F.col("x.t")).alias("title"), strip(F.col("x.b")).alias("body"))
    return d.where((F.col("sec") > 0) | (F.col("body") != ""))


def carried(found: DataFrame) -> DataFrame:
    """Sections with the title in force: the latest one before, over the pages of a source, which many tasks share."""
    return carry_forward(found, ["source"], page_bucket(), ["page", "sec"], "title", "section_title")


def page_sections(found: DataFrame) -> DataFrame:
    """(source, page, section_title): the last title in force on each page."""
    return carried(found).groupBy("source", "page").agg(F.max_by("section_title", "sec").alias("section_title"))


def with_sections(extras: DataFrame, found: DataFrame) -> DataFrame:
    """Tables and visuals with their page's section; pages without one take the last section of the source."""
    last = carried(found).groupBy("source").agg(F.max_by("section_title", F.struct("page", "sec")).alias("_last"))
    by_page = page_sections(found).withColumn("_known", F.lit(True))
    d = extras.join(by_page, ["source", "page"], "left").join(last, "source", "left")
    return d.withColumn("section_title", F.when(F.col("_known"), F.col("section_title")).otherwise(F.col("_last"))).drop("_known", "_last")


def _cut(text: str, seps: tuple[str, ...]) -> tuple[list[str], tuple[str, ...]]:
    """Pieces of text at the first separator that occurs, each separator heading the piece it precedes; and the finer separators."""
    for i, sep in enumerate(seps):
        if sep == "":
            return list(text), ()
        if sep in text:
            head, *rest = text.split(sep)
            return [p for p in [head, *(sep + r for r in rest)] if p], seps[i + 1 :]
    return [text], ()


def _windows(pieces: list[str], size: int, overlap: int) -> Iterator[str]:
    """Greedy windows of at most `size` characters that share up to `overlap` with the one before."""
    window: list[str] = []
    total = 0
    for piece in pieces:
        n = len(piece)
        if window and total + n > size:
            yield "".join(window).strip()
            while total > overlap or (total + n > size and total > 0):
                total -= len(window.pop(0))
        window.append(piece)
        total += n
    if window:
        yield "".join(window).strip()


def split_text(text: str, size: int = SIZE, overlap: int = OVERLAP, seps: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Recursive character splitting: coarse separators first, pieces that stay too long are split finer."""
    pieces, finer = _cut(text, seps)
    out: list[str] = []
    run: list[str] = []
    for p in pieces:
        if len(p) < size:
            run.append(p)
            continue
        out += _windows(run, size, overlap)
        run = []
        out += split_text(p, size, overlap, finer) if finer else [p.strip()]
    out += _windows(run, size, overlap)
    return [c for c in out if c]


def split_column(size: int = SIZE, overlap: int = OVERLAP, seps: tuple[str, ...] = SEPARATORS):
    """Texts become Python strings one at a time, and their parts Arrow's after every few, so that a worker holds a batch's bytes and little more."""
    from pyspark.sql.functions import arrow_udf

    @arrow_udf("array<string>")
    def split_texts(texts: pa.Array) -> pa.Array:
        kind = pa.list_(pa.string())
        done, parts, held = [], [], 0
        for t in texts:
            parts.append(split_text(t.as_py() or "", size, overlap, seps))
            held += sum(map(len, parts[-1]))
            if held >= HELD:
                done.append(pa.array(parts, kind))
                parts, held = [], 0
        return pa.concat_arrays([*done, pa.array(parts, kind)])

    return split_texts


def chunk_pages(pages: DataFrame, extras: DataFrame | None = None, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """pages (source, page, text) and extras (source, page, seq, text, element_type) to chunks.

    Titles are carried before blank sections go; numbers restart on every page; tables and visuals are not split and are
    numbered per source and kind.
    """
    found = sections(pages)
    body = carried(found).where(F.length(strip(F.col("body"))) > 0)
    parts = body.select("source", "page", "sec", "section_title", F.posexplode(split_column(size, overlap)(F.col("body"))).alias("pos", "part"))
    n = F.row_number().over(Window.partitionBy("source", "page").orderBy("sec", "pos"))
    text = section_prefix(F.col("part"), F.col("section_title"), F.lit("text"))
    chunks = parts.withColumn("number", n).select(chunk_id(F.col("source"), F.col("page"), "c", F.col("number")).alias("chunk_id"), text.alias("text"), "page", "source", "section_title", F.lit("text").alias("element_type"))
    if extras is None:
        return chunks
    kind = F.when(F.col("element_type") == "table", "tbl").otherwise("vis")
    d = with_sections(extras, found).withColumn("kind", kind)
    d = d.withColumn("number", F.row_number().over(Window.partitionBy("source", "kind").orderBy("page", "seq")))
    ident = F.when(F.col("kind") == "tbl", chunk_id(F.col("source"), F.col("page"), "tbl", F.col("number"))).otherwise(chunk_id(F.col("source"), F.col("page"), "vis", F.col("number")))
    more = d.select(ident.alias("chunk_id"), section_prefix(F.col("text"), F.col("section_title"), F.col("element_type")).alias("text"), "page", "source", "section_title", "element_type")
    return chunks.unionByName(more)
