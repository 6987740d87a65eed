"""Model interfaces with deterministic defaults that stand in for models: embedder, reranker, text, vision and OCR models.

A provider is a function of columns to a column: a pandas UDF around a model (iterator form, so that a
worker loads it once), or the plain expressions below.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .functions.text import data_url, strip, tokens

Provider = Callable[..., Column]


def model_column(load: Callable[[], Callable], kind: str, threads: int = 0) -> Provider:
    """A column function around a model: `load` is called once per worker and returns a function of a list of inputs.

    With `threads`, it returns a function of one input instead, called one by one (1, as for a model on this machine) or so many at once (a hosted one).
    """
    from pyspark.sql.pandas.functions import pandas_udf

    @pandas_udf(kind)
    def apply(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        from concurrent.futures import ThreadPoolExecutor

        model = load()
        with ThreadPoolExecutor(max(1, threads)) as pool:
            for texts in batches:
                yield pd.Series(list(pool.map(model, texts.tolist()) if threads else model(texts.tolist())))

    return apply


def hashing_embedder(text: Column, dims: int = 64) -> Column:
    """Unit vector of token counts by hash; a stand-in for a sentence model, with the batches and the one load per worker that such a model has."""

    from pyspark.sql.functions import arrow_udf

    @arrow_udf("array<double>")
    def embed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        import zlib

        import numpy as np

        for batch in batches:
            out = np.zeros((len(batch), dims))
            for i, words in enumerate(batch):  # one list of words at a time becomes Python's
                found = words.as_py()
                if found:
                    out[i] = np.bincount([zlib.crc32(w.encode()) % dims for w in found], minlength=dims)
            out /= np.sqrt((out * out).sum(axis=1, keepdims=True)).clip(min=1e-300)
            yield pa.ListArray.from_arrays(np.arange(len(batch) + 1, dtype=np.int32) * dims, pa.array(out.ravel()))

    return embed(F.coalesce(tokens(text), F.array().cast("array<string>")))


def described(image: Column, caption: Column) -> Column:
    """Stand-in for a vision model: the caption, or the image's size."""
    return F.coalesce(caption, F.concat(F.lit("image of "), F.length(image).cast("string"), F.lit(" bytes")))


def vision_request(image: Column, caption: Column) -> tuple[Column, Column]:
    """(prompt, data URL) of a request to a hosted vision model."""
    hint = F.when(F.length(caption) > 0, F.concat(F.lit('Text near it: "'), caption, F.lit('". '))).otherwise("")
    return F.concat(F.lit("Describe the figure. "), hint), data_url(image)


def display_title(first_page: Column, filename: Column, model: Provider | None = None) -> Column:
    """Title of the first 1500 characters by `model` without quotes around it, else the file name."""
    if model is None:
        return filename
    return F.coalesce(F.nullif(F.btrim(model(F.left(first_page, F.lit(1500))), F.lit('"')), F.lit("")), filename)


def resolved_reference(question: Column, model: Provider | None = None) -> Column:
    """The question with references resolved by `model`; the question itself where it gives nothing."""
    return question if model is None else F.coalesce(F.nullif(model(question), F.lit("")), question)


def first_passage(prompt: Column) -> Column:
    """Stand-in for a text model: the first line of the first passage in the prompt, else the first 40 characters of the prompt."""
    line = F.regexp_extract(prompt, r"\[Source: [^\]]*\]\n([^\n]*)", 1)
    return F.coalesce(F.nullif(strip(line), F.lit("")), F.left(prompt, F.lit(40)))


def streamed(text: Column) -> Column:
    """array<string>: what a text model sends piece by piece; here a word and its space each. Empty pieces are dropped."""
    words = F.split(text, r"(?<= )")
    return F.filter(words, lambda w: w != "")


def read_as_text(image: Column) -> Column:
    """Stand-in for OCR: the image's bytes as text."""
    return F.decode(image, "UTF-8")


def coverage(question: Column, text: Column) -> Column:
    """Stand-in for a cross-encoder."""
    from .operators.fusion import coverage_score

    return coverage_score(question, text)


REGISTRY: dict[str, Provider] = {"embedder": hashing_embedder, "vision": described, "text": first_passage, "stream": streamed, "ocr": read_as_text, "reranker": coverage}


def provider(name: str) -> Provider:
    if name not in REGISTRY:
        raise KeyError(f"no provider {name!r}; known: {sorted(REGISTRY)}")
    return REGISTRY[name]
