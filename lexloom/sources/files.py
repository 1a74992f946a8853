"""Files as sources: markup files, and pluggable text extraction."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.sources.markup import html_blocks

PAGES = "page string, page_no int, text string, error string"


def read_blocks(spark: SparkSession, path: str, layout: str = "code") -> DataFrame:
    """Block stream ``(page, pos, kind, depth, text, anchor, label, extra)`` of the markup files that
    ``path`` names (a folder or pattern on any storage Spark reads). Files are listed and packed into
    tasks by the engine; bytes that are no UTF-8 are replaced."""
    files = spark.read.format("binaryFile").load(path)
    return html_blocks(files.select(F.col("path").alias("page"), F.make_valid_utf8(F.col("content").cast("string")).alias("html")), layout)


def extract_pages(files: DataFrame, extract: Callable[[bytes], list[str]] | None, ocr: Callable[[bytes], str] | None = None) -> DataFrame:
    """Pages of ``files (path string, content binary)`` by a text extractor; where it gives no text, by
    OCR, whose text is page 1; else no page. A failure is a row with its message and null text, and
    stops nothing else. Null content gives nothing."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, content in zip(b["path"], b["content"]):
                if content is None:
                    continue
                try:
                    texts = list(extract(content)) if extract else []
                    if not any(t.strip() for t in texts):
                        texts = [ocr(content)] if ocr else []
                    rows += [(path, i + 1, t, None) for i, t in enumerate(texts)]
                except Exception as e:
                    rows.append((path, 0, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["page", "page_no", "text", "error"])

    return files.select("path", "content").mapInPandas(run, PAGES)
