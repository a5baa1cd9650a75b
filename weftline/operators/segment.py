"""Text segmentation: packed segments, heading outlines, wrapped spans; as Python table functions."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAST, GREATEST = 2_000, 20_000


def segments(text: str | None, limit: int) -> list[str]:
    """Pieces of at most ``limit`` characters (between 2,000 and 20,000): paragraphs, long ones cut, packed in order.

    A long paragraph is cut at its last line end within the limit, else after its last sentence, if that lies
    in the second half, else at the limit.
    """
    limit = max(LEAST, min(GREATEST, limit))
    queue = [p.strip() for p in re.split(r"\n\s*\n", text or "") if p.strip()]
    out: list[str] = []
    room = ""
    while queue:
        piece = queue.pop(0)
        if len(piece) > limit:
            at = piece.rfind("\n", 0, limit)
            if at < limit // 2:
                at = piece.rfind(". ", 0, limit) + 1
            if at < limit // 2 + (at > 0):
                at = limit
            tail = piece[at:].strip()
            if tail:
                queue.insert(0, tail)
            piece = piece[:at].strip()
        if room and len(room) + 2 + len(piece) > limit:
            out.append(room)
            room = piece
        else:
            room = f"{room}\n\n{piece}" if room else piece
    return [*out, room] if room else out


def outline(text: str | None) -> list[dict]:
    """Markdown headings with level, label, start, end and parent; nothing for fewer than two."""
    raw = (text or "").replace("\r\n", "\n").replace("\r", "\n")
    heads = [{"level": len(m[1]), "label": m[2].strip(" #\t*"), "start": m.start(), "body": m.end()} for m in re.finditer(r"^(#{1,6})[ \t]+(.+)$", raw, re.M)]
    heads = [h for h in heads if h["label"]]
    if len(heads) < 2:
        return []
    open_: list[int] = []
    for i, h in enumerate(heads):
        while open_ and heads[open_[-1]]["level"] >= h["level"]:
            heads[open_.pop()]["end"] = h["start"]
        h |= {"idx": i, "parent": open_[-1] if open_ else None, "end": len(raw)}
        open_.append(i)
    return heads


def spans(text: str | None) -> list[dict]:
    """Parts of a text inside single asterisks and outside; ``**`` is plain text, an unclosed part runs to the end."""
    out: list[dict] = []
    kind, part, i = "plain", "", 0
    text = text or ""

    def end(kind: str, part: str) -> None:
        if part.strip():
            out.append({"kind": kind, "text": part.strip()})

    while i < len(text):
        if text.startswith("**", i):
            part += "**"
            i += 2
        elif text[i] == "*":
            end(kind, part)
            kind, part = ("span" if kind == "plain" else "plain"), ""
            i += 1
        else:
            part += text[i]
            i += 1
    end("tail" if kind == "span" else kind, part)
    return out


def _exploded(df: DataFrame, column: str, schema: str, f) -> DataFrame:
    @F.pandas_udf(f"array<struct<{schema}>>")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([f(t) for t in texts])

    keep = [c for c in df.columns if c != column]
    return df.select(*keep, F.explode(run(F.col(column))).alias("x")).select(*keep, "x.*")


def segmented(df: DataFrame, limit: int, column: str = "text") -> DataFrame:
    """Rows (…, segment, part) of each text."""
    return _exploded(df, column, "segment:int,part:string", lambda t: [{"segment": i, "part": p} for i, p in enumerate(segments(t, limit))])


def outlined(df: DataFrame, column: str = "text") -> DataFrame:
    """Rows (…, idx, level, label, start, end, parent) of each text's headings."""
    fields = ("idx", "level", "label", "start", "end", "parent")
    return _exploded(df, column, "idx:int,level:int,label:string,start:int,end:int,parent:int", lambda t: [{k: h[k] for k in fields} for h in outline(t)])


def spanned(df: DataFrame, column: str = "text") -> DataFrame:
    """Rows (…, kind, text) of each text's spans."""
    return _exploded(df.withColumnRenamed(column, "__raw"), "__raw", "kind:string,text:string", spans)


def wraps(text: str | None) -> tuple[list[str], str, str | None]:
    """What stands in single asterisks, the text outside them joined by blanks, and the end that an open one begins.

    ``**`` is plain text, a wrap of white space alone is plain with its asterisks, and an open end counts as plain too.
    """
    pieces = re.split(r"(\*\*|\*)", text or "")
    found, plain, held, inner = [], [], "", None

    def close() -> None:
        nonlocal held
        if held:
            plain.append(held)
        held = ""

    for piece in pieces:
        if piece != "*":
            if inner is None:
                held += piece
            else:
                inner += piece
        elif inner is None:
            close()
            inner = ""
        else:
            if inner.strip():
                found.append(inner.strip())
            else:
                held += f"*{inner}*"
            inner = None
    tail = (inner or "").strip() or None
    held += tail or ""
    close()
    return found, " ".join(plain).strip(), tail
