"""Scalar text expressions; everything stays inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Python's str.split() sees it; Java's \s alone misses part of it.
WS = r"[\s\x0B\x1c-\x1f\x85\p{Z}]+"
#: Punctuation stripped from both ends of a word.
STRIP_CHARS = ".,!?;:\"'()[]{}"
#: Words that make a query well formed, and words that refer back.
QUESTION_WORDS = ["what", "who", "how", "why", "when", "where", "which"]
ACTION_WORDS = ["summarize", "summarise", "summary", "explain", "describe", "compare", "contrast", "list", "show", "tell", "give", "define", "definition", "extract", "find", "identify", "mention", "provide", "details", "overview"]
REFERENCE_WORDS = ["it", "that", "this", "he", "she", "they", "him", "her", "them", "its", "his", "their"]
#: Patterns of the question modes.
BROAD = [r"\bsummar(y|ize|ise)\b", r"\bkey points?\b", r"\bmain points?\b", r"\boverview\b", r"\bwhat.*(document|pdf|this).*about\b", r"\bconclu(de|sion)\b"]
COMPARISON = [r"\bcompare\b", r"\bcomparison\b", r"\bdifference(s)? between\b", r"\bvs\.?\b", r"\bversus\b", r"\bsimilarit(y|ies)\b", r"\bcontrast\b"]
#: Labels of element types and prefixes of captions.
LABELS = {"table": "[Table]", "image": "[Image]", "chart": "[Chart]", "figure": "[Figure]"}
SHORT_QUERY_WORDS = 4
#: The question templates; their words decide the mode a rewritten question takes.
BARE_TEMPLATE = "What does the document say about {}?"
SIMPLER = " — explain it in simpler terms"
SUMMARISED = "Summarize the answer to: "


def strip(c: Column) -> Column:
    return F.regexp_replace(c, f"^{WS}|{WS}$", "")


def tokens(c: Column) -> Column:
    """Lower-cased tokens between white space, none empty."""
    return F.filter(F.split(F.lower(c), WS), lambda x: x != "")


def bare_words(c: Column) -> Column:
    """Lower-cased words without punctuation at their ends."""
    return F.transform(tokens(c), lambda w: F.btrim(w, F.lit(STRIP_CHARS)))


def is_upper(c: Column) -> Column:
    return (c == F.upper(c)) & (c != F.lower(c))


def heading_score(text: Column, size: Column, bold: Column, body: Column) -> Column:
    """Points for size against the body, weight, length, closing punctuation and capitals."""
    n = F.size(tokens(text))
    ratio = F.coalesce(F.try_divide(size, body), F.lit(0.0))
    big = F.when(ratio >= 1.3, 3).when(ratio >= 1.15, 2).when(ratio >= 1.05, 1).otherwise(0)
    length = F.when(n <= 8, 1).when(n > 15, -3).otherwise(0)
    closing = F.when(F.regexp_replace(text, f"{WS}$", "").rlike(r"[.,;:]$"), -2).otherwise(0)
    return big + F.when(bold, 1).otherwise(0) + length + closing + F.when(is_upper(text) & (n <= 10), 1).otherwise(0)


def section_prefix(text: Column, title: Column, element: Column) -> Column:
    """[Section: T], the element's label, an empty line, the text; a chunk with neither is its text."""
    label = F.lit(None).cast("string")
    for kind, shown in LABELS.items():
        label = F.when(element == kind, F.lit(shown)).otherwise(label)
    head = F.concat_ws("\n", F.when(F.length(title) > 0, F.concat(F.lit("[Section: "), title, F.lit("]"))), label)
    return F.when(head == "", text).otherwise(F.concat(head, F.lit("\n\n"), text))


def document_id(source: Column) -> Column:
    return F.substring(F.md5(source), 1, 8)


def chunk_id(source: Column, page: Column, kind: str, number: Column) -> Column:
    return F.concat(document_id(source), F.lit("_p"), page.cast("string"), F.lit(f"_{kind}"), number.cast("string"))


def question_title(question: Column) -> Column:
    q = strip(question)
    return F.when(F.length(q) > 50, F.concat(F.left(q, F.lit(47)), F.lit("..."))).otherwise(q)


def renamed_title(title: Column) -> Column:
    """Stripped, at most 100 characters; null when nothing is left."""
    return F.nullif(F.left(strip(title), F.lit(100)), F.lit(""))


def file_title(name: Column) -> Column:
    """A file name as words: no .pdf at its end, separators as spaces, lower case."""
    bare = F.regexp_replace(F.regexp_replace(name, r"\.(pdf|PDF)$", ""), "[_-]+", " ")
    return F.lower(strip(bare))


def confidence(score: Column) -> Column:
    return F.when(score > 0, "high").otherwise("low")


def fusion_key(source: Column, page: Column, text: Column) -> Column:
    return F.concat_ws("|", source, page.cast("string"), F.left(text, F.lit(80)))


def snippet(text: Column) -> Column:
    return F.left(text, F.lit(200))


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, r"[\\/]"), -1)


def iso_z(ts: Column) -> Column:
    """ISO 8601 with a literal Z; fractions only where there are any."""
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.date_format(ts, "SSSSSS")
    return F.concat(whole, F.when(micros != "000000", F.concat(F.lit("."), micros)).otherwise(F.lit("")), F.lit("Z"))


def six_digits(n: Column) -> Column:
    return F.lpad(F.pmod(n, F.lit(1_000_000)).cast("string"), 6, "0")


def minutes_left(seconds: Column) -> Column:
    return F.greatest(F.lit(1), (F.floor(seconds / 60) + 1).cast("int"))


def l2(a: Column, b: Column) -> Column:
    square = F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: (x - y) * (x - y))
    return F.sqrt(F.aggregate(square, F.lit(0.0), lambda s, x: s + x))


def any_match(text: Column, patterns: list[str]) -> Column:
    return F.coalesce(F.lower(text).rlike("|".join(f"(?:{p})" for p in patterns)), F.lit(False))


def question_mode(question: Column, documents: Column) -> Column:
    return F.when((documents > 1) & any_match(question, COMPARISON), "comparison").when(any_match(question, BROAD), "broad").otherwise("specific")


def _around(template: str) -> list[str]:
    """The parts of a template, an empty one in place of its {}."""
    head, tail = template.split("{}")
    return [head, "", tail]


def search_query(question: Column, has_history: Column, resolved: Column) -> Column:
    """What to search with: the question, its resolved form (where it refers back), or a template around a bare phrase."""
    q = strip(question)
    w = bare_words(q)
    in_list = lambda words: F.arrays_overlap(w, F.array(*[F.lit(x) for x in words]))
    formed = in_list(QUESTION_WORDS + ACTION_WORDS) | (F.size(w) > SHORT_QUERY_WORDS)
    return F.when(q == "", q).when(has_history & in_list(REFERENCE_WORDS), F.coalesce(resolved, q)).when(formed, q).otherwise(F.concat(*[F.lit(x) if x else q for x in _around(BARE_TEMPLATE)]))


def refers_back(question: Column) -> Column:
    return F.arrays_overlap(bare_words(strip(question)), F.array(*[F.lit(x) for x in REFERENCE_WORDS]))


def simpler(question: Column) -> Column:
    return F.concat(question, F.lit(SIMPLER))


def summarised(question: Column) -> Column:
    return F.concat(F.lit(SUMMARISED), question)


def data_url(image: Column, mime: str = "image/png") -> Column:
    """Spark breaks base64 at 76 characters; a data URL is one line."""
    return F.concat(F.lit(f"data:{mime};base64,"), F.translate(F.base64(image), "\r\n", ""))


def portable_hash(c: Column) -> Column:
    """The first 32 bits of md5 as a number, the same in every engine."""
    return F.conv(F.substring(F.md5(c), 1, 8), 16, 10).cast("long")
