"""Any supported file to pages of text: one table function dispatches on the extension and never fails the job.

Text and Markdown are cut every 50 lines, pretty-printed JSON every 100, CSV every 50
rows with the line of columns on each page; HTML is reduced to its text lines by
expressions first; office files have pages of their own. A file that cannot be read,
or of a kind not known, gives one row with a status and the error.
"""

from __future__ import annotations

import csv
import io
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from lorestream.sources import files, office

SUPPORTED = ("txt", "md", "markdown", "csv", "json", "html", "htm", *office.KINDS)
_LINES, _JSON_LINES, _ROWS = 50, 100, 50


def _decoded(content: bytes) -> str:
    try:
        return content.decode()
    except UnicodeDecodeError:
        return content.decode("latin-1")


def _cut(lines: list[str], size: int) -> list[list[str]]:
    return [lines[i : i + size] for i in range(0, len(lines), size)]


def _csv(text: str) -> list[list[str]]:
    rows = [r for r in csv.reader(io.StringIO(text), strict=True) if r]
    if not rows:
        raise ValueError("no columns")
    head, told = rows[0], []
    for n, row in enumerate(rows[1:], 1):
        if len(row) > len(head):
            raise ValueError(f"row {n} has {len(row)} values for {len(head)} columns")
        told.append(f"Row {n}: " + " | ".join(f"{c}: {v}" for c, v in zip(head, row + [""] * len(head))))
    return [["Columns: " + ", ".join(head), "", *page] for page in _cut(told, _ROWS)]


def _pages(content: bytes, extension: str) -> list[list[str]]:
    text = _decoded(content)
    if extension == "csv":
        return _csv(text)
    if extension == "json":
        return _cut(json.dumps(json.loads(text), indent=2, ensure_ascii=False).split("\n"), _JSON_LINES)
    return _cut(text.split("\n"), _LINES) if text else []


def read(content: bytes | None, extension: str | None) -> Iterator[tuple]:
    """Rows of office.SCHEMA for a file of any kind."""
    if extension not in ("txt", "md", "markdown", "csv", "json"):
        yield from office.read(content, extension)
        return
    try:
        pages = _pages(content or b"", extension)
    except Exception as e:  # whatever a broken file brings about is its status
        yield None, None, None, None, None, "corrupt", f"{type(e).__name__}: {e}"[:200]
        return
    if not pages:
        yield 1, 0, "", None, None, "empty", None
    for n, lines in enumerate(pages, 1):
        yield n, len(lines), "\n".join(lines), None, None, "ok", None


class FilePages:
    def eval(self, content: bytes, extension: str) -> Iterator[tuple]:
        yield from read(content, extension)


def file_pages(found: DataFrame) -> DataFrame:
    """found(content, extension, ...) with a row for each page: page_number, n_lines, text, title, author, status, error."""
    html = F.col("extension").isin("html", "htm")
    plain = F.encode(F.array_join(files.html_lines(files.decoded(F.col("content"))), "\n"), "UTF-8")
    rows = found.withColumns({"content": F.when(html, plain).otherwise(F.col("content")), "kind_": F.when(html, "txt").otherwise(F.col("extension"))})
    pages = F.udtf(FilePages, returnType=office.SCHEMA)
    return rows.lateralJoin(pages(F.col("content").outer(), F.col("kind_").outer())).drop("content", "kind_")


def load(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Pages of all files below a folder, those of unknown kinds with their status. Spark lists no files of zero bytes."""
    return file_pages(files.listing(spark, path, pattern).select("path", "modified", "size", "extension", "content"))


def outline(value: object, depth: int = 0) -> list[str]:
    """A JSON value as indented lines: keys with values, `[i]:` before nested items of lists, `- ` before plain ones."""
    pad, out = "  " * depth, []
    items = value.items() if isinstance(value, dict) else [(f"[{i}]", v) for i, v in enumerate(value)] if isinstance(value, list) else [("", value)]
    for key, x in items:
        if isinstance(x, dict | list):
            out += [f"{pad}{key}:", *outline(x, depth + 1)]
        else:
            out.append(f"{pad}{key}: {x}" if isinstance(value, dict) else f"{pad}- {x}" if isinstance(value, list) else f"{pad}{x}")
    return out


@F.pandas_udf(StringType())
def json_outline(texts: pd.Series) -> pd.Series:
    """JSON texts as outlines; null for what is no JSON."""

    def one(text: str | None) -> str | None:
        try:
            return "\n".join(outline(json.loads(text)))
        except (TypeError, ValueError):
            return None

    return pd.Series([one(t) for t in texts], dtype="object")
