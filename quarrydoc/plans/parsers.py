"""Parsers of plain files for the data source `document_items`; a PDF library's functions take their place."""

from __future__ import annotations

from ..operators.layout import ROW_BANDS
from ..sources.stores import PasswordProtected


def line_pages(data: bytes, columns: set[str]) -> list[dict]:
    """A line is a page, one without text is an image that says so."""
    if data.startswith(b"LOCKED"):
        raise PasswordProtected
    if not data.startswith(b"%PDF-"):
        raise ValueError("no PDF")
    texts = data[5:].decode().split("\n")
    return [{"page": i, "text": t, "n_images": 0 if t.strip() else 1, "image": f"image {i - 1}".encode() if "image" in columns and not t.strip() else b""} for i, t in enumerate(texts, 1)]


def line_tables(data: bytes, columns: set[str]) -> list[dict]:
    """The first line is the page's source and number; the others are its table's rows: on even pages whole lines by ruling, else cut at bars; words by text, where ruling lines give one column among enough row bands."""
    head, *lines = data.decode().split("\n")
    doc, page = head.rsplit(" ", 1)
    item = {"doc": doc, "page": int(page), "n_rects": int(page) % 5}
    rows = [[x] if int(page) % 2 == 0 else x.split("|") for x in lines]
    if "by_lines" in columns:
        item["by_lines"] = [rows]
    if "by_text" in columns and rows and item["n_rects"] >= ROW_BANDS and len(rows[0]) <= 1:
        item["by_text"] = [[x.split(" ") for x in lines]]
    return [item]
