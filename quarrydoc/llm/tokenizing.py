"""Exact tokenizing with a word-level vocabulary file (word_bpe_49k.json), fast enough for whole corpora.

The file's merges are handed to a faster merge engine. There a pair merges when its bytes
together are a token, first come the lower ranks; that equals merging listed pairs as
long as every token, taken alone, merges to itself, which the tests check for the file. The end-of-word mark is one control character after each word. Texts of ASCII and
Latin letters, which normalisation leaves alone but for case, go this way; all other texts are
encoded by the file's own tokenizer.
"""

from __future__ import annotations

import functools
import json
import re

MARK = "\x01"
#: Letters that are their own normal form and lower to one character each (U+0130 does not).
LATIN = "À-ÖØ-öø-įı-ɏ"
UNUSUAL = re.compile(rf"[^\t\n\x0b\x0c\r\x20-\x7e{LATIN}]|<\|")
#: The pattern of the file's pre-tokenizer, for such texts in lower case.
WORD = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[a-z{LATIN}]+|[0-9]|[^\sa-z0-9{LATIN}]+")


def _byte_symbols() -> dict[str, int]:
    """The printable symbols that stand for bytes in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class WordTokenizer:
    def __init__(self, path: str) -> None:
        import numpy as np
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        byte = _byte_symbols()

        def raw(token: str) -> bytes:
            end = token.endswith("</w>")
            return bytes(byte[c] for c in (token[:-4] if end else token)) + (MARK.encode() if end else b"")

        ranks: dict[bytes, int] = {}
        ids: dict[int, int] = {}
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        # the mark joins the last byte before anything else merges
        for c in byte:
            if (t := f"{c}</w>") in model["vocab"] and byte[c] != ord(MARK):
                ids[ranks.setdefault(raw(t), len(ranks))] = model["vocab"][t]
        for a, b in merges:
            data = raw(a + b)
            if data not in ranks:
                ids[ranks.setdefault(data, len(ranks))] = model["vocab"][a + b]
        for c, b in byte.items():
            ranks[bytes([b])] = len(ranks)
            ids[ranks[bytes([b])]] = model["vocab"].get(c, 0)
        self.table = np.zeros(len(ranks), "<u4")
        for r, i in ids.items():
            self.table[r] = i
        self.engine = tiktoken.Encoding("words", pat_str=rf"[^{MARK}]*{MARK}", mergeable_ranks=ranks, special_tokens={})

    def whole(self, text: str) -> bytes:
        """By the file's own tokenizer."""
        import numpy as np

        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit bytes."""
        low = text.lower()
        # some capitals of LATIN lower to letters outside it (U+018F to U+0259)
        if UNUSUAL.search(text) or not text.isascii() and UNUSUAL.search(low):
            return self.whole(text)
        words = WORD.findall(low)
        if not words:
            return b""
        words.append("")
        return self.table[self.engine.encode_ordinary(MARK.join(words))].tobytes()


@functools.lru_cache(maxsize=2)
def word_tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)
