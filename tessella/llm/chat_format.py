"""Chat formatting by event-sourced reconstruction.

A log of events is partitioned by conversation and sorted by sequence; a fold over the sorted rows makes the final
messages, which are rendered to one text with a loss mask. The fold holds one conversation at a time and streams
over Arrow batches, so memory is bounded by the longest conversation and any number of them may share a partition.

Events (kind): `message` starts a message with its whole text, `delta` appends to a message (starting it if need
be), `edit` replaces a message's text, `regenerate` empties a message, so that later deltas rebuild it, and drops
all messages after it, `delete` removes a message. A null kind is a `message`. Messages stay in the order in
which they started. message_id null: `message` and `delta` start one of their own, other kinds change the last one.

Defined results: null texts and roles are empty; a null conversation id is a conversation of its own; events with
equal sequence numbers (repeated rows too) are all kept, ordered by message id, role and text, a null sequence
number comes first; kinds that are not known are an error; an empty log gives an empty table.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pick

TURN, END = "<|turn|>", "<|end|>"
#: Strings that chat templates in common use give a meaning; a backslash after the first character escapes them.
CONTROL = ("<|", "<<SYS>>", "<</SYS>>", "<s>", "</s>", "[INST]", "[/INST]")
_ESCAPE = re.compile("|".join(re.escape(c) for c in ("\\", *CONTROL)))
_UNESCAPE = re.compile(r"\\(.)", re.S)
_TURNS = re.compile(re.escape(TURN) + r"((?:\\.|[^\\\n])*)\n((?:\\.|[^\\])*?)" + re.escape(END) + "\n", re.S)


def escape(text: str) -> str:
    return _ESCAPE.sub(lambda m: "\\\\" if m[0] == "\\" else f"{m[0][0]}\\{m[0][1:]}", text)


def escape_role(role: str) -> str:
    return escape(role).replace("\n", "\\\n")


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1", text)


def render(messages: list[tuple[str, str]], trained: str = "assistant") -> tuple[str, list[tuple[int, int]]]:
    """The formatted text and the spans of it (code points) that the loss covers: the texts of the trained role."""
    parts, spans, at = [], [], 0
    for role, text in messages:
        head, body = f"{TURN}{escape_role(role)}\n", escape(text)
        if role == trained:
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, END, "\n"]
        at += len(head) + len(body) + len(END) + 1
    return "".join(parts), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The messages that render() was given."""
    out, at = [], 0
    for m in _TURNS.finditer(formatted):
        if m.start() != at:
            break
        out.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    if at != len(formatted):
        raise ValueError("not a formatted conversation")
    return out


def fold(events: Iterator[tuple]) -> list[tuple[str, str]]:
    """Final messages of one conversation; events: (kind, message id, role, text) in order."""
    roles: dict = {}
    texts: dict = {}
    last = None
    for n, (kind, message, role, text) in enumerate(events):
        kind = kind or "message"
        own = message if message is not None else (("own", n) if kind in ("message", "delta") else last)
        if kind == "message":
            own = own if own not in texts else ("again", n)
            roles[own], texts[own] = role or "", [text or ""]
        elif kind == "delta":
            roles.setdefault(own, role or "")
            texts.setdefault(own, []).append(text or "")
        elif kind == "edit":
            if own in texts:
                texts[own] = [text or ""]
        elif kind == "regenerate":
            if own in texts:
                order = list(texts)
                for later in order[order.index(own) + 1 :]:
                    del roles[later], texts[later]
                texts[own] = []
        elif kind == "delete":
            roles.pop(own, None)
            texts.pop(own, None)
        else:
            raise ValueError(f"unknown kind of event: {kind}")
        last = own
    return [(roles[k], "".join(v)) for k, v in texts.items()]


_OUT = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("formatted", pa.string()), ("loss_spans", pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())])))])


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def done(conv, events):
        messages = fold(events)
        text, spans = render(messages)
        return {"conv_id": conv, "n_turns": len(messages), "formatted": text, "loss_spans": [{"begin": a, "end": b} for a, b in spans]}

    current, events, out, held = None, [], [], 0
    for batch in batches:
        columns = [batch.column(i).to_pylist() for i in range(batch.num_columns)]
        for conv, kind, message, role, text in zip(*columns, strict=True):
            if events and conv != current:
                out.append(done(current, events))
                held += len(out[-1]["formatted"])
                events = []
                if held > 1 << 22:
                    yield pa.RecordBatch.from_pylist(out, schema=_OUT)
                    out, held = [], 0
            current = conv
            events.append((kind, message, role, text))
    if events:
        out.append(done(current, events))
    if out:
        yield pa.RecordBatch.from_pylist(out, schema=_OUT)


def format_chats(log: DataFrame, conv_col: str = "conv_id", seq_col: str = "turn", role_col: str = "role", text_col: str = "text", kind_col: str | None = None, message_col: str | None = None) -> DataFrame:
    """One row per conversation: conv_id, n_turns, formatted, loss_spans (code points of formatted under the loss)."""
    names = {"conv_id": conv_col, "seq": seq_col, "role": role_col, "text": text_col} | ({"kind": kind_col} if kind_col else {}) | ({"message": message_col} if message_col else {})
    events = pick(log, **names)
    events = events.select(
        F.col("conv_id").cast("long").alias("conv_id"), "seq", (F.col("kind") if kind_col else F.lit("message")).cast("string").alias("kind"),
        (F.col("message") if message_col else F.lit(None)).cast("string").alias("message"), "role", "text",
    )
    events = events.repartition("conv_id").sortWithinPartitions("conv_id", "seq", "message", "role", "text")
    return events.select("conv_id", "kind", "message", "role", "text").mapInArrow(_conversations, "conv_id long, n_turns long, formatted string, loss_spans array<struct<begin:long,end:long>>")


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for conv, formatted, spans in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            turns = parse(formatted)
            loss = "".join(unescape(formatted[s["begin"] : s["end"]]) for s in spans)
            rows.append({
                "conv_id": conv, "n_turns": len(turns), "turns_sha256": hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(),
                "loss_chars": len(loss), "loss_sha256": hashlib.sha256(loss.encode()).hexdigest(), "formatted_chars": len(formatted),
            })
        yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())]))


def op5_chat_format(spark, sf_dir: str) -> DataFrame:
    log = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    log = log.unionByName(spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string"))
    chats = format_chats(log).select("conv_id", "formatted", "loss_spans")
    return chats.mapInArrow(_read_back, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def _sql_escaped(column: str) -> str:
    out = f"replace({column}, '\\', '\\\\')"
    for c in CONTROL:
        out = f"replace({out}, '{c}', '{c[0]}\\{c[1:]}')"
    return out


QUERIES = {"op5_chat_format": op5_chat_format}
ORACLES = {
    "op5_chat_format": f"""
        WITH log AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')))
        SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
               CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
               CAST(sum({len(TURN) + len(END) + 2} + length({_sql_escaped("replace(role, chr(10), chr(10) || chr(10))")}) + length({_sql_escaped("text")})) AS BIGINT) AS formatted_chars
        FROM log GROUP BY conv_id"""
}
