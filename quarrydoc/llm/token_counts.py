"""Token counts: tokens of whole documents attributed to sections by their character spans.

A document is encoded once, whole, with a byte-level vocabulary: the bytes of its tokens
laid end to end are the text, so token spans are running sums of token lengths. Sections
are spans that cover the text; by default the lines of a document, each with its line
break. Spans and sections are joined as intervals by binary search; a token that
crosses a boundary is allocated by `rule`:

- "start": to the section that holds its first byte (the default);
- "most": to the section that holds most of its bytes, the earlier one when equal;
- "share": to each section in proportion to its bytes.

Defined results: null or empty text is one empty section with no tokens; every section has a row even if it holds no
token's start; counts of a document sum to its tokens under every rule;
rows are treated on their own, so repeated rows repeat; other columns are ignored.
"""

from __future__ import annotations

import base64
import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "doc_id long, section int, char_start long, char_end long, n_tokens double, crossing long"
RULES = ("start", "most", "share")


@functools.lru_cache(maxsize=2)
def _encoding(path: str, pattern: str):
    import numpy as np
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    lengths = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, rank in ranks.items():
        lengths[rank] = len(token)
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), lengths


def line_ends(data: bytes):
    """End offsets of the sections of a text: after every line break, and at its end."""
    import numpy as np

    ends = np.flatnonzero(np.frombuffer(data, np.uint8) == 10) + 1
    return ends if len(ends) and ends[-1] == len(data) else np.append(ends, len(data))


def attribute(token_lengths, ends, rule: str):
    """Tokens per section and the number of tokens that cross out of it; `ends` are ascending byte offsets, the last is the text's end."""
    import numpy as np

    stop = np.cumsum(token_lengths)
    start = stop - token_lengths
    first = np.searchsorted(ends, start, "right")
    last = np.searchsorted(ends, stop - 1, "right")
    counts = np.bincount(first, minlength=len(ends)).astype(np.float64)
    across = np.flatnonzero(last > first)
    crossing = np.bincount(first[across], minlength=len(ends))
    for i in across if rule != "start" else ():
        a, b = int(first[i]), int(last[i])
        edges = np.concatenate([[start[i]], ends[a:b], [stop[i]]])
        share = np.diff(edges) / token_lengths[i]
        counts[a] -= 1
        if rule == "most":
            counts[a + int(share.argmax())] += 1
        else:
            counts[a : b + 1] += share
    return counts, crossing


def token_counts(docs: DataFrame, vocabulary: str, pattern: str, rule: str = "start", key: str = "doc_id", text: str = "text", ends=line_ends) -> DataFrame:
    """One row per document and section: span in code points, tokens, tokens that cross its end."""
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")

    def count(batches):
        import numpy as np
        import pyarrow as pa

        enc, lengths = _encoding(vocabulary, pattern)
        for batch in batches:
            parts: list[list] = [[], [], [], [], [], []]

            def flush():
                a = [np.concatenate(p) if p else np.zeros(0) for p in parts[1:]]
                ids = pa.array([x for doc, n in parts[0] for x in [doc] * n], pa.int64())
                kinds = (np.int32, np.int64, np.int64, np.float64, np.int64)
                return pa.RecordBatch.from_arrays([ids, *[pa.array(x.astype(k)) for x, k in zip(a, kinds)]], names=["doc_id", "section", "char_start", "char_end", "n_tokens", "crossing"])

            for doc, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                t = t.as_py() or ""
                data = t.encode()
                ids = np.array(enc.encode_ordinary(t), np.int64)
                stops = ends(data)
                counts, crossing = attribute(lengths[ids], stops, rule)
                if len(data) != len(t):  # code points are the bytes that continue none
                    chars = np.concatenate([[0], np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)])
                    stops = chars[stops]
                begins = np.concatenate([[0], stops[:-1]])
                parts[0].append((doc, len(stops)))
                for p, x in zip(parts[1:], (np.arange(len(stops)), begins, stops, counts, crossing)):
                    p.append(x)
            yield flush()

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(count, SCHEMA)
