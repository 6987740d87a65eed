"""Layout spans to page text: body size, headings, reading order, captions, tables, drawing clusters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import WS, heading_score, strip, tokens

PAGE = ("doc", "page")
#: A text with a character that is no white space.
NOT_BLANK = "[^" + WS[1:-2] + "]"
#: Score and most words of a heading, body size where there is none.
HEADING_SCORE, HEADING_WORDS, DEFAULT_SIZE = 3, 20, 10.0
#: Caption prefixes.
TABLE_CAPTIONS = ("table", "tab.", "tbl")
FIGURE_CAPTIONS = ("figure", "fig.", "chart", "diagram")
#: Limits of captions, tables and visuals.
CAPTION_WORDS, CAPTION_REACH = 20, 60.0
MIN_ROWS, MAX_COLS, EMPTY_SHARE, MIN_FULL_ROWS, ROW_BANDS = 2, 12, 0.5, 2, 3
MIN_IMAGE, MERGE, MIN_DRAWINGS, MAX_VISUALS = 150, 15.0, 8, 20


def body_size(spans: DataFrame) -> DataFrame:
    """(doc, page, body_size): the rounded size that carries most characters; ties to the first seen."""
    seen = F.struct("block_no", "line_no", "span_no")
    by = spans.groupBy(*PAGE, F.bround("size").alias("s")).agg(F.sum(F.length("text")).alias("n"), F.min(seen).alias("seen"))
    w = Window.partitionBy(*PAGE).orderBy(F.desc("n"), "seen")
    return by.withColumn("r", F.row_number().over(w)).where("r = 1").select(*PAGE, F.col("s").alias("body_size"))


def lines(spans: DataFrame) -> DataFrame:
    """One row per line: text, unweighted mean size, bold, block box and order."""
    block = Window.partitionBy(*PAGE, "block_no")
    d = spans.withColumns({"bx0": F.min("x0").over(block), "by0": F.min("y0").over(block)})
    d = d.groupBy(*PAGE, "block_no", "line_no", "bx0", "by0", "page_width").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("span_no", "text"))), lambda x: x["text"]), "").alias("raw"),
        F.avg("size").alias("size"),
        F.bool_or(F.lower("font").contains("bold")).alias("bold"),
    )
    return d.withColumn("text", strip(F.col("raw"))).drop("raw").where("text <> ''")


def reading_order(found: DataFrame) -> DataFrame:
    """lines plus ordinal: two columns are read left then right, else top down; a page has two columns when two blocks start on either side of its middle."""
    blocks = found.select(*PAGE, "block_no", "bx0", "by0", "page_width").distinct()
    left = F.col("bx0") < F.col("page_width") / 2
    sides = blocks.groupBy(*PAGE).agg(F.sum(left.cast("int")).alias("l"), F.sum((~left).cast("int")).alias("r"))
    blocks = blocks.join(sides, list(PAGE)).withColumn("two", (F.col("l") >= 2) & (F.col("r") >= 2))
    key = F.when(F.col("two"), F.struct((~left).cast("double").alias("a"), F.col("by0").alias("b"), F.lit(0.0).alias("c"))).otherwise(F.struct(F.lit(0.0).alias("a"), F.col("by0").alias("b"), F.col("bx0").alias("c")))
    blocks = blocks.withColumn("block_order", F.row_number().over(Window.partitionBy(*PAGE).orderBy(key, "block_no"))).select(*PAGE, "block_no", "block_order")
    d = found.join(blocks, [*PAGE, "block_no"])
    return d.withColumn("ordinal", F.row_number().over(Window.partitionBy(*PAGE).orderBy("block_order", "line_no")))


def headings(spans: DataFrame) -> DataFrame:
    """Ordered lines plus is_heading."""
    d = reading_order(lines(spans)).join(body_size(spans), list(PAGE), "left").withColumn("body_size", F.coalesce("body_size", F.lit(DEFAULT_SIZE)))
    return d.withColumn("is_heading", heading_score(F.col("text"), F.col("size"), F.col("bold"), F.col("body_size")) >= HEADING_SCORE)


def page_text(spans: DataFrame) -> DataFrame:
    """(doc, page, text): runs of heading lines of one block become a `# ` line, unless they have more than 20 words."""
    w = Window.partitionBy(*PAGE).orderBy("ordinal")
    d = headings(spans)
    same = F.col("is_heading") & F.lag("is_heading").over(w) & (F.lag("block_no").over(w) == F.col("block_no"))
    d = d.withColumn("run", F.sum(F.when(F.coalesce(same, F.lit(False)), 0).otherwise(1)).over(w))
    joined = lambda sep: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "text"))), lambda x: x["text"]), sep)
    runs = d.groupBy(*PAGE, "run").agg(F.bool_or("is_heading").alias("h"), joined(" ").alias("title"), joined("\n").alias("body"))
    shown = F.when(F.col("h") & (F.size(tokens(F.col("title"))) <= HEADING_WORDS), F.concat(F.lit("# "), F.col("title"))).otherwise(F.col("body"))
    runs = runs.withColumn("t", shown)
    return runs.groupBy(*PAGE).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("run", "t"))), lambda x: x["t"]), "\n").alias("text"))


def _marked(words: DataFrame) -> DataFrame:
    """words (doc, page, _y, seq, text), where a run of one line with more words than a caption has is one row, a text of too many words.

    So a line too long for a caption is not shuffled. A run shorter than that stays as it is, so lines that come in parts lose nothing.
    """
    schema = words.schema

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        for batch in batches:
            if not batch.num_rows:
                continue
            new = np.ones(batch.num_rows, bool)
            new[1:] = False
            for name in (*PAGE, "_y"):
                codes = batch[name].dictionary_encode("encode").indices.to_numpy()
                new[1:] |= codes[1:] != codes[:-1]
            at = np.cumsum(new) - 1
            full = pc.fill_null(pc.greater(pc.utf8_length(pc.utf8_trim_whitespace(batch["text"])), 0), False).to_numpy(zero_copy_only=False)
            long = (np.bincount(at, weights=full) > CAPTION_WORDS)[at]
            text = pc.if_else(pa.array(long), pa.scalar("- " * (CAPTION_WORDS + 1), batch["text"].type), batch["text"])
            yield batch.set_column(batch.schema.get_field_index("text"), "text", text).filter(pa.array(~long | new))

    return words.mapInArrow(run, schema)


def captions(elements: DataFrame, words: DataFrame, prefixes: tuple[str, ...] = TABLE_CAPTIONS) -> DataFrame:
    """elements plus caption: the nearest caption-like line within 60 points above, else below. A range join by bins of a page's height."""
    # lines out of the reach of all elements go before words are shuffled
    span = elements.agg((F.min("top") - CAPTION_REACH).alias("_low"), (F.max(F.greatest("top", "bottom")) + CAPTION_REACH).alias("_high"))
    words = words.withColumn("_y", F.bround("top")).join(F.broadcast(span), F.col("_y").between(F.col("_low"), F.col("_high"))).drop("_low", "_high")
    text = _marked(words.select(*PAGE, "_y", "seq", "text")).groupBy(*PAGE, F.col("_y").alias("y")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"]), " ").alias("line"))
    text = text.withColumn("line", strip(F.col("line")))
    starts = None
    for p in prefixes:
        hit = F.startswith(F.lower("line"), F.lit(p))
        starts = hit if starts is None else starts | hit
    text = text.where(starts & (F.size(tokens(F.col("line"))) <= CAPTION_WORDS))
    above = (F.col("y") >= F.col("top") - CAPTION_REACH) & (F.col("y") < F.col("top"))
    below = (F.col("y") > F.col("bottom")) & (F.col("y") <= F.col("bottom") + CAPTION_REACH)
    # a line lies in one bin of the reach's height; what is near an element's top or bottom lies in two bins at each
    place = lambda y: F.floor(y / CAPTION_REACH).cast("long")
    edges = F.array_compact(F.array(F.col("top").cast("double"), F.col("bottom").cast("double") + CAPTION_REACH))
    near = F.array_distinct(F.flatten(F.transform(edges, lambda y: F.array(place(y) - 1, place(y)))))
    boxes = elements.select(*PAGE, "elem", "top", "bottom", F.explode(near).alias("bin"))
    d = boxes.join(text.withColumn("bin", place(F.col("y"))), [*PAGE, "bin"]).where(above | below)
    d = d.withColumn("side", F.when(above, 0).otherwise(1)).withColumn("dist", F.when(above, F.col("top") - F.col("y")).otherwise(F.col("y") - F.col("bottom")))
    w = Window.partitionBy(*PAGE, "elem").orderBy("side", "dist", "line")
    best = d.withColumn("r", F.row_number().over(w)).where("r = 1").select(*PAGE, "elem", F.col("line").alias("caption"))
    return elements.join(best, [*PAGE, "elem"], "left")


def _filled(c: Column) -> Column:
    return F.coalesce(F.rlike(c, F.lit(NOT_BLANK)), F.lit(False))


def plausible_table(rows: Column) -> Column:
    """Two rows or more, 2 to 12 columns in the first, at most half the cells empty, two rows with two filled cells. Each cell is looked at once."""
    counts = F.transform(rows, lambda r: F.struct(F.size(r).alias("n"), F.size(F.filter(r, _filled)).alias("filled")))

    def plausible(counts: Column) -> Column:
        total = lambda part: F.aggregate(counts, F.lit(0), lambda a, x: a + part(x))
        cols = F.get(counts, 0)["n"]
        cells, filled, full = total(lambda x: x["n"]), total(lambda x: x["filled"]), total(lambda x: (x["filled"] >= 2).cast("int"))
        return F.coalesce((F.size(counts) >= MIN_ROWS) & (cols >= 2) & (cols <= MAX_COLS) & (cells - filled <= EMPTY_SHARE * cells) & (full >= MIN_FULL_ROWS), F.lit(False))

    # a one-element array binds the counts of the rows with a filled cell to a variable
    return F.transform(F.array(F.filter(counts, lambda x: x["filled"] > 0)), plausible)[0]


def table_markdown(rows: Column) -> Column:
    """Pipe table: header, rule, rows padded or cut to the header's width; empty string without rows."""
    clean = F.filter(F.transform(rows, lambda r: F.transform(r, lambda c: F.regexp_replace(strip(F.coalesce(c, F.lit(""))), "\n", " "))), lambda r: F.exists(r, lambda c: c != ""))
    head = F.get(clean, 0)
    n = F.size(head)
    line = lambda r: F.concat(F.lit("| "), F.array_join(r, " | "), F.lit(" |"))
    body = F.transform(F.slice(clean, 2, F.greatest(F.size(clean) - 1, F.lit(0))), lambda r: line(F.slice(F.concat(r, F.array_repeat(F.lit(""), n)), F.lit(1), n)))
    out = F.concat(F.array(line(head), line(F.array_repeat(F.lit("---"), n))), body)
    return F.when(F.size(clean) > 0, F.array_join(out, "\n")).otherwise("")


def needs_text_columns(tables: DataFrame) -> DataFrame:
    """Pages to parse again with text columns: only tables of one column (by their first row) were found and three row bands or more were drawn."""
    narrow = F.bool_and(F.when(F.size("rows") > 0, F.size(F.get("rows", F.lit(0))) <= 1))
    return tables.groupBy(*PAGE).agg((F.coalesce(narrow, F.lit(True)) & (F.max("n_rects") >= ROW_BANDS)).alias("retry"))


def page_tables(pages: DataFrame, by_lines: Column, by_text: Column) -> DataFrame:
    """(doc, page, tbl, rows): the tables a detector finds on each page, numbered from 1.

    by_lines and by_text: what the detector gives for a page, array<array<array<string>>>, by ruling lines and by text columns. The
    second is asked only for pages where the first found tables, all of one column, among three row bands or more (n_rects).
    """
    found = pages.withColumn("_t", by_lines)
    narrow = F.forall("_t", lambda t: (F.size(t) == 0) | (F.size(F.get(t, F.lit(0))) <= 1))
    retry = (F.size("_t") > 0) & (F.col("n_rects") >= ROW_BANDS) & narrow
    d = found.withColumn("_t", F.when(F.coalesce(retry, F.lit(False)), by_text).otherwise(F.col("_t")))
    return d.select(*PAGE, F.posexplode("_t").alias("_i", "rows")).select(*PAGE, (F.col("_i") + 1).alias("tbl"), "rows")


def table_chunks(tables: DataFrame) -> DataFrame:
    """Plausible tables as extras of the chunker: caption, empty line, Markdown."""
    d = tables.where(plausible_table(F.col("rows")))
    return d.select(F.col("doc").alias("source"), "page", F.col("tbl").alias("seq"), F.concat_ws("\n\n", "caption", table_markdown(F.col("rows"))).alias("text"), F.lit("table").alias("element_type"))


def drawing_clusters(drawings: DataFrame, merge: float = MERGE, least: int = MIN_DRAWINGS) -> DataFrame:
    """(doc, page, cluster, x0, y0, x1, y1, n): clusters of `least` drawings or more, numbered by their first drawing.

    Two clusters merge when the box of one, widened by `merge` on all sides, meets that of the other; boxes grow as they
    merge, and all are compared again until no two merge. Boxes that only touch the widened one merge too, and boxes
    without height or width count as others do. The end is the same in whatever order clusters merge, as boxes only grow.
    A page is one task's group and holds some thousands of drawings at most.
    """
    schema = "doc string, page int, cluster int, x0 double, y0 double, x1 double, y1 double, n int"

    def grow(key, pdf):
        import numpy as np
        import pandas as pd

        pdf = pdf.sort_values("seq")
        low, high = pdf[["x0", "y0"]].to_numpy(float), pdf[["x1", "y1"]].to_numpy(float)
        n, first = np.ones(len(pdf), int), np.arange(len(pdf))
        i = 0
        while i < len(n):
            near = ((low[i] - merge <= high) & (low <= high[i] + merge)).all(axis=1)
            near[i] = True
            if near.sum() == 1:
                i += 1
                continue
            keep = ~near
            low = np.vstack([low[near].min(axis=0), low[keep]])
            high = np.vstack([high[near].max(axis=0), high[keep]])
            n, first = np.append(n[near].sum(), n[keep]), np.append(first[near].min(), first[keep])
            i = 0  # the grown box may reach any other, and any other it
        order = np.argsort(first)
        kept = [k for k in order if n[k] >= least]
        return pd.DataFrame([(key[0], key[1], c, *low[k], *high[k], n[k]) for c, k in enumerate(kept)], columns=["doc", "page", "cluster", "x0", "y0", "x1", "y1", "n"])

    return drawings.groupBy(*PAGE).applyInPandas(grow, schema)


def raster_candidates(images: DataFrame, least: int = MIN_IMAGE) -> DataFrame:
    """Images of at least `least` pixels both ways; those that could not be decoded have no size and go."""
    return images.where((F.col("width") >= least) & (F.col("height") >= least))


def chart_candidates(clusters: DataFrame, render: Callable[..., Column]) -> DataFrame:
    """(doc, page, kind, seq, top, bottom, image): each drawing cluster as a chart, its box drawn at twice the size by `render`(doc, page, x0, y0, x1, y1, scale)."""
    image = render(*[F.col(c) for c in ("doc", "page", "x0", "y0", "x1", "y1")], 2)
    return clusters.select(*PAGE, F.lit("chart").alias("kind"), F.col("cluster").cast("long").alias("seq"), F.col("y0").alias("top"), F.col("y1").alias("bottom"), image.alias("image"))


def visual_chunks(images: DataFrame, charts: DataFrame, words: DataFrame, describe: Callable[[Column, Column], Column]) -> DataFrame:
    """(source, page, seq, text, element_type): the first visuals of each document as extras of the chunker.

    images: doc, page, seq, width, height, top, bottom (null without a place on the page), image; charts: chart_candidates;
    words: doc, page, seq, text, top. The text is the caption, where there is one, and what `describe`(image, caption) says.
    """
    raster = raster_candidates(images).select(*PAGE, F.lit("image").alias("kind"), "seq", "top", "bottom", "image")
    chosen = first_visuals(raster.unionByName(charts)).withColumn("elem", F.col("position"))
    d = captions(chosen, words, FIGURE_CAPTIONS)
    text = F.concat_ws("\n\n", "caption", describe(F.col("image"), F.col("caption")))
    return d.select(F.col("doc").alias("source"), "page", F.col("position").alias("seq"), text.alias("text"), F.col("kind").alias("element_type"))


def first_visuals(visuals: DataFrame, most: int = MAX_VISUALS) -> DataFrame:
    """The first visuals of each document in page order, images before charts on a page."""
    kind = F.when(F.col("kind") == "image", 0).otherwise(1)
    w = Window.partitionBy("doc").orderBy("page", kind, "seq")
    return visuals.withColumn("position", F.row_number().over(w)).where(F.col("position") <= most)
