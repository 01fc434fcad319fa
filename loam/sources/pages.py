"""Web pages as documents: title, headings and plain text."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

_BLOCK = re.compile(r"</?(?:p|div|br|li|ul|ol|h[1-6]|tr|table|section|article|title)\b[^>]*>", re.IGNORECASE)
_TAG, _TITLE = re.compile(r"<[^>]*>"), re.compile(r"<title[^>]*>(.*?)</title>", re.IGNORECASE | re.DOTALL)
_SPACES, _BLANKS = re.compile(r"[ \t]+"), re.compile(r"\n\s*\n+")


def page_text(raw: str, name: str) -> tuple[str, str]:
    """Title (of the page, else its name) and text: block tags end lines, entities are read, blank runs collapse."""
    found = _TITLE.search(raw)
    title = html.unescape(_TAG.sub("", found.group(1))).strip() if found else name
    lines = html.unescape(_TAG.sub("", _BLOCK.sub("\n", raw))).split("\n")
    text = _BLANKS.sub("\n\n", "\n".join(_SPACES.sub(" ", line).strip() for line in lines)).strip()
    return title, f"# {title}\n\n{text}"


def extract(pages: DataFrame) -> DataFrame:
    """page_id, title and text of pages (page_id, url, html); null html: the url as the title of an empty page."""

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [page_text(raw or "", url or "") for url, raw in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([t for t, _ in found], pa.string()), pa.array([x for _, x in found], pa.string())], ["page_id", "title", "text"])

    return pages.select("page_id", "url", "html").mapInArrow(tasks, "page_id bigint, title string, text string")
