"""Conversation exports in several formats, as rows (role, content, index)."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Role labels of transcripts, and openings of user rows that are no messages.
USER_LABELS = ("human", "user", "me")
ROLE_LABELS = ("User", "Human", "Me", "Assistant", "AI", "Claude", "Bot")
HEADER_LABELS = ("Human", "User", "Assistant", "Claude")
NO_MESSAGE = ("@", "Base directory for this skill")
_EXCHANGE = "array<struct<role:string,content:string,index:int>>"
_LEAST_PIECE, _SHORT_TEXT = 100, 200


def _parsed(raw: str):
    try:
        return json.loads(raw)
    except ValueError:
        return None


def export_format(raw: str) -> str:
    """transcript_jsonl, messages_export, mapping_export, markdown or plaintext."""
    text = (raw or "").strip()
    objects = []
    for line in text.split("\n")[:5]:
        if line.strip():
            found = _parsed(line)
            if found is None:
                break
            objects.append(found)
    if len(objects) >= 2 and any(isinstance(o, dict) and o.get("type") in ("user", "assistant", "queue-operation") for o in objects):
        return "transcript_jsonl"
    data = _parsed(text) if text[:1] in ("{", "[") else None
    first = data[0] if isinstance(data, list) and data else data
    if isinstance(first, dict):
        if "chat_messages" in first:
            return "messages_export"
        if "mapping" in first or ("messages" in first and isinstance(data, dict)) or ("role" in first and isinstance(data, list)):
            return "mapping_export"
    names = "|".join(HEADER_LABELS)
    if re.search(rf"^(?:#{{1,3}}\s*(?:{names})\b|\*\*(?:{names})\*\*:)", text, re.M):
        return "markdown"
    return "plaintext"


def _dicts(items) -> list[dict]:
    return [x for x in items if isinstance(x, dict)] if isinstance(items, list) else []


def _blocks(content, between: str = " ") -> str:
    """Text of a message whose content is a string or a list of typed blocks, joined by ``between``."""
    if isinstance(content, str):
        return content
    return between.join(b["text"] for b in _dicts(content) if b.get("type") == "text" and isinstance(b.get("text"), str))


def _from_messages(data) -> Iterator[tuple[str, str]]:
    for conv in _dicts(data if isinstance(data, list) else [data]):
        for m in _dicts(conv.get("chat_messages")):
            yield ("user" if str(m.get("sender") or "").lower() in ("human", "user") else "assistant"), (m.get("text") or _blocks(m.get("content")))


def _from_mapping(data) -> Iterator[tuple[str, str]]:
    """Nodes of mapping trees by time; every role but user and system counts as the assistant."""
    for conv in _dicts(data if isinstance(data, list) else [data]):
        found = [n["message"] for n in (conv.get("mapping") or {}).values() if isinstance(n, dict) and isinstance(n.get("message"), dict)]
        for m in sorted(found, key=lambda m: m.get("create_time") or 0):
            role, content = (m.get("author") or {}).get("role"), m.get("content")
            text = " ".join(p for p in content.get("parts") or [] if isinstance(p, str)) if isinstance(content, dict) else content
            if role != "system" and isinstance(text, str):
                yield ("user" if role == "user" else "assistant"), text


def _from_array(data) -> list[dict]:
    """A plain array of messages: roles stay as they are, and numbers are those of the array."""
    out = []
    for i, m in enumerate(data.get("messages") or [] if isinstance(data, dict) else data):
        content = m.get("content") if isinstance(m, dict) else None
        text = " ".join(map(str, content)) if isinstance(content, list) else content
        if isinstance(text, str) and text.strip() and m.get("role") != "system":
            out.append({"role": m.get("role") or "user", "content": text.strip(), "index": i})
    return out


def _from_jsonl(text: str) -> Iterator[tuple[str, str]]:
    seen = set()
    for line in text.split("\n"):
        row = _parsed(line) if line.strip() else None
        if not isinstance(row, dict) or row.get("type") not in ("user", "assistant"):
            continue
        message = row.get("message")
        content = message.get("content") if isinstance(message, dict) else None
        if isinstance(content, list):
            texts = [b if isinstance(b, str) else b.get("text") for b in content if isinstance(b, str) or (isinstance(b, dict) and b.get("type") == "text")]
            content = "\n".join(t.strip() for t in texts if isinstance(t, str) and t.strip())
        body = content if isinstance(content, str) else ""
        if len(body.strip()) < 10 or (row["type"] == "user" and body.startswith(NO_MESSAGE)) or body[:200] in seen:
            continue
        seen.add(body[:200])
        yield row["type"], body


def _labelled(text: str, pattern: str) -> list[tuple[str, str]]:
    parts = re.split(pattern, text, flags=re.I)
    return [("user" if label.strip().lower() in USER_LABELS else "assistant", body) for label, body in zip(parts[1::2], parts[2::2], strict=False)]


def _from_plain(text: str) -> list[tuple[str, str]]:
    marked = _labelled(text, rf"\n({'|'.join(ROLE_LABELS)})\s*:\s*")
    if any(body.strip() for _, body in marked):
        return marked
    text = text.strip()
    if len(text) < _SHORT_TEXT:
        return [("user", text)]
    pieces = re.split(r"\n\s*\n", text)
    if len(pieces) == 1:
        pieces = re.split(r"(?<=[.!?,;])\s+(?=(?:then|next|finally|and then|also|so|but|now)\b)|->|→|>>|,\s*then\s", text, flags=re.I)
    merged: list[str] = []
    held = ""
    for p in (p.strip() for p in pieces):
        held = f"{held} {p}".strip() if held else p
        if len(held) >= _LEAST_PIECE:
            merged.append(held)
            held = ""
    if held and merged:
        merged[-1] += f" {held}"
    elif held:
        merged.append(held)
    return [("user", m) for m in merged]


def exchanges(raw: str | None) -> list[dict]:
    """The messages of one export, blank ones left out, numbered from 0."""
    text = raw or ""
    kind = export_format(text)
    if kind == "transcript_jsonl":
        rows = list(_from_jsonl(text))
    elif kind == "messages_export":
        rows = list(_from_messages(_parsed(text.strip())))
    elif kind == "mapping_export":
        data = _parsed(text.strip())
        first = data[0] if isinstance(data, list) else data
        if "mapping" not in first:
            return _from_array(data)
        rows = list(_from_mapping(data))
    elif kind == "markdown":
        rows = _labelled(text, rf"(?:^|\n)(?:#{{1,3}}\s*|\*\*)({'|'.join(HEADER_LABELS)})(?:\*\*)?[:\s]*\n?")
    else:
        rows = _from_plain(text)
    kept = [(r, c if kind == "transcript_jsonl" else c.strip()) for r, c in rows if c and c.strip()]
    return [{"role": r, "content": c, "index": i} for i, (r, c) in enumerate(kept)]


def normalised(raws: DataFrame, column: str = "raw") -> DataFrame:
    """Rows (…, role, content, index) of the export in each row; null and empty ones have none."""

    @F.pandas_udf(_EXCHANGE)
    def parse(texts: pd.Series) -> pd.Series:
        return pd.Series([exchanges(t) for t in texts])

    keep = [c for c in raws.columns if c != column]
    return raws.select(*keep, F.explode(parse(F.col(column))).alias("x")).select(*keep, "x.role", "x.content", "x.index")


def rendered(rows: DataFrame, key: str) -> DataFrame:
    """(key, text): ``[turn i] [role]`` lines of each conversation."""
    line = F.format_string("[turn %d] [%s] %s", F.col("index").cast("int"), F.col("role"), F.col("content"))
    ordered = F.array_sort(F.collect_list(F.struct("index", line.alias("line"))))
    return rows.groupBy(key).agg(F.array_join(F.transform(ordered, lambda x: x["line"]), "\n\n").alias("text"))


def event_tail(events: DataFrame, n: int, order: list[Column]) -> DataFrame:
    """The last n rows of a log, oldest first."""
    back = [o.desc() for o in order]
    return events.orderBy(*back).limit(n).orderBy(*[o.asc() for o in order])


def read_log(spark, path: str, schema: str, strict: bool = False) -> DataFrame:
    """JSON lines; bad ones are dropped, or fail the read if strict."""
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)


def newest_by_id(spark, path: str, schema: str, key: str = "id", pattern: str = "*.json") -> DataFrame:
    """Rows of JSON files, of each id that of the newest file."""
    rows = spark.read.schema(schema).option("multiLine", True).option("mode", "DROPMALFORMED").option("pathGlobFilter", pattern).json(path)
    stamped = rows.select("*", F.col("_metadata.file_modification_time").alias("__t"), F.col("_metadata.file_path").alias("__f"))
    best = stamped.groupBy(key).agg(F.max_by(F.struct(*rows.columns), F.struct("__t", "__f")).alias("r"))
    return best.select("r.*")
