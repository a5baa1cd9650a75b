"""Word documents read with the standard library: paragraphs with heading levels, and Markdown."""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The name space of the format, and headings of a list of contents, whose section is left out.
_NS = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
CONTENTS = ("contents", "table of contents")
_ROWS = "array<struct<level:int,text:string>>"


def paragraphs(content: bytes | None) -> list[dict]:
    """The paragraphs of a document's body, then its tables as rows of cells between bars; ``level`` is that of a heading, or None.

    Blank paragraphs are left out, and bytes that are no document have none.
    """
    try:
        body = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(content or b"")).read("word/document.xml")).find(f"{_NS}body")
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
        return []
    out, tables = [], []
    for part in body if body is not None else ():
        if part.tag == f"{_NS}p":
            text = "".join(t.text or "" for t in part.iter(f"{_NS}t")).strip()
            style = part.find(f"{_NS}pPr/{_NS}pStyle")
            found = re.fullmatch(r"heading\s*([1-6])", (style.get(f"{_NS}val") or "") if style is not None else "", re.I)
            if text:
                out.append({"level": int(found[1]) if found else None, "text": text})
        elif part.tag == f"{_NS}tbl":
            for row in part.iter(f"{_NS}tr"):
                cells = ["".join(t.text or "" for t in cell.iter(f"{_NS}t")).strip() for cell in row.iter(f"{_NS}tc")]
                tables.append({"level": None, "text": "| " + " | ".join(cells) + " |"})
    return out + tables


def markdown(content: bytes | None) -> str:
    """Headings as lines of ``#``, paragraphs a blank line apart, without the list of contents."""
    lines, skipped = [], None
    for p in paragraphs(content):
        if p["level"] is not None:
            if skipped is not None and p["level"] <= skipped:
                skipped = None
            if p["text"].strip().lower() in CONTENTS:
                skipped = p["level"]
                continue
        if skipped is None:
            lines.append(f"{'#' * p['level']} {p['text']}" if p["level"] else p["text"])
    return "\n\n".join(lines)


def document_paragraphs(files: DataFrame) -> DataFrame:
    """(doc, pos, level, text) of ``files(doc, content)``."""

    @F.pandas_udf(_ROWS)
    def read(contents: pd.Series) -> pd.Series:
        return pd.Series([paragraphs(c) for c in contents])

    return files.select("doc", F.posexplode(read("content")).alias("pos", "p")).select("doc", "pos", "p.level", "p.text")


def document_markdown(files: DataFrame) -> DataFrame:
    """(doc, text) of ``files(doc, content)``."""

    @F.pandas_udf("string")
    def read(contents: pd.Series) -> pd.Series:
        return pd.Series([markdown(c) for c in contents])

    return files.select("doc", read("content").alias("text"))


def written(rows: list[tuple[int | None, str]]) -> bytes:
    """A document of (heading level, text) paragraphs, the least that a reader needs."""
    escape = lambda t: t.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")
    style = lambda n: f'<w:pPr><w:pStyle w:val="Heading{n}"/></w:pPr>' if n else ""
    body = "".join(f"<w:p>{style(n)}<w:r><w:t>{escape(t)}</w:t></w:r></w:p>" for n, t in rows)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{_NS[1:-1]}"><w:body>{body}</w:body></w:document>')
    return out.getvalue()
