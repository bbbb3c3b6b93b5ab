"""Chat formatting from event logs.

Events ``(conv_id, msg, seq, kind, role, text)``: ``open`` starts a message with a
role, ``delta`` appends streamed text, ``edit`` replaces the text, ``regenerate``
drops what was streamed so far. A log is partitioned by conversation, sorted by
message and sequence, and folded in one streaming pass: a task holds one message at
a time, so a conversation of any number of events needs no more memory than its
largest message.

Template, a piece per message: ``[INST]role[/INST]text</s>``, and ``<s>`` before the
first. Control strings inside roles and texts get one backslash after their first
character (``</s>`` -> ``<\\/s>``); what already has n backslashes there gets n + 1,
so taking one away restores every text exactly. The loss mask is the escaped text
of assistant messages: ``loss_start .. loss_end`` in code points of the piece.

The output is a Parquet table of pieces ``(conv_id, piece, formatted, loss_start,
loss_end)``; ``digests`` reads it back, in order, with running hashes: no
conversation is ever whole in memory.

Cases: null text or role: empty. Null conv_id: one conversation of its own. Null
turn: before all others. Rows of equal turn: a message each, in order of role and
text. A message of no text: an empty message. Empty table: empty result. Extra
columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.shared import run_folder, written

BEGIN, OPEN, CLOSE, END = "<s>", "[INST]", "[/INST]", "</s>"
LOSS_ROLE = "assistant"
DELTA_CHARS = 400

_REST = "|".join(re.escape(c[1:]) for c in (END, BEGIN, CLOSE, OPEN))
_ESCAPE = re.compile(rf"([<\[])(?=\\*(?:{_REST}))")
_UNESCAPE = re.compile(rf"([<\[])\\(?=\\*(?:{_REST}))")
_PIECE = re.compile(rf"(?:{re.escape(BEGIN)})?{re.escape(OPEN)}(.*?){re.escape(CLOSE)}(.*){re.escape(END)}", re.S)

EVENTS = "conv_id long, msg long, seq long, kind string, role string, text string"


def escape(text: str) -> str:
    return _ESCAPE.sub(r"\1\\", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1", text)


def fold(events: Iterator[tuple[str, str | None]]) -> str:
    """The final text of one message from its (kind, text) events in order."""
    parts: list[str] = []
    for kind, text in events:
        if kind in ("edit", "regenerate", "open"):
            parts = []
        if kind != "regenerate" and text:
            parts.append(text)
    return "".join(parts)


# ------------------------------------------------------------------ the log
def as_events(conversations: DataFrame) -> DataFrame:
    """``conversations(conv_id, turn, role, text)`` as an event log with the same
    final messages: user and other turns arrive whole; assistant turns are streamed
    in deltas, every third of them after a draft that is generated anew, every
    fifth as a draft that is edited."""
    order = [F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first()]
    c = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", F.coalesce("text", F.lit("")).alias("text"))
    c = c.withColumn("msg", F.row_number().over(Window.partitionBy("conv_id").orderBy(*order)).cast("long"))
    event = lambda kind, text: F.struct(F.lit(kind).alias("kind"), text.alias("text"))
    none, text = F.lit(None).cast("string"), F.col("text")
    n = F.ceil(F.length(text) / DELTA_CHARS).cast("int")
    cuts = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    deltas = F.transform(cuts, lambda i: event("delta", F.substring(text, i * DELTA_CHARS + 1, F.lit(DELTA_CHARS))))
    draft = F.array(event("delta", F.substring(text, 1, DELTA_CHARS // 2)))
    key = F.pmod(F.xxhash64("conv_id", "msg"), F.lit(15))
    streamed = F.when(key % 3 == 0, F.concat(draft, F.array(event("regenerate", none)), deltas)).when(key % 5 == 0, F.concat(draft, F.array(event("edit", text)))).otherwise(deltas)
    log = F.when(F.col("role") == LOSS_ROLE, F.concat(F.array(event("open", none)), streamed)).otherwise(F.array(event("open", text)))
    rows = c.select("conv_id", "msg", "role", F.posexplode(log).alias("seq", "e"))
    return rows.select("conv_id", "msg", F.col("seq").cast("long").alias("seq"), "e.kind", F.when(F.col("e.kind") == "open", F.col("role")).alias("role"), "e.text")


# ------------------------------------------------------------------ rendering
def render(events: DataFrame) -> DataFrame:
    """One row per message: conv_id, piece, formatted, loss_start, loss_end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held, last, piece = 0, (), 0
        key, role, log = None, "", []

        def message() -> None:
            nonlocal held, last, piece
            piece = piece + 1 if last == (key[0],) else 0
            last = (key[0],)
            body = escape(fold(iter(log)))
            head = (BEGIN if piece == 0 else "") + OPEN + escape(role) + CLOSE
            loss = (len(head), len(head) + len(body)) if role == LOSS_ROLE else (None, None)
            rows.append((key[0], piece, head + body + END, *loss))
            held += len(body)

        def batch_of() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["conv_id", "piece", "formatted", "loss_start", "loss_end"])

        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
        for batch in batches:
            for conv, msg, _, kind, who, text in zip(*(c.to_pylist() for c in batch.columns)):
                if (conv, msg) != key:
                    if key is not None:
                        message()
                    key, role, log = (conv, msg), "", []
                if kind == "open":
                    role = who or ""
                log.append((kind, text))
            if held > 4 << 20 or len(rows) > 20_000:
                yield batch_of()
                rows, held = [], 0
        if key is not None:
            message()
        if rows:
            yield batch_of()

    order = [F.col(c).asc_nulls_first() for c in ("conv_id", "msg", "seq")]
    log = events.select("conv_id", "msg", "seq", "kind", "role", "text").repartition("conv_id").sortWithinPartitions(*order)
    return log.mapInArrow(run, "conv_id long, piece long, formatted string, loss_start long, loss_end long")


def digests(pieces: DataFrame) -> DataFrame:
    """Read formatted conversations back: a row per conversation."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        rows: list[tuple] = []
        conv, state = None, None

        def close() -> None:
            turns, loss, n, chars, size = state
            rows.append((conv, n, turns.hexdigest(), chars, loss.hexdigest(), size))

        for batch in batches:
            for c, _, text, a, b in zip(*(x.to_pylist() for x in batch.columns)):
                if state is None or c != conv:
                    if state is not None:
                        close()
                    conv, state = c, [hashlib.sha256(), hashlib.sha256(), 0, 0, 0]
                role, body = _PIECE.fullmatch(text).groups()
                state[0].update(f"{unescape(role)}\n{unescape(body)}\n".encode())
                state[2] += 1
                if a is not None:
                    learned = unescape(text[a:b])
                    state[1].update(learned.encode())
                    state[3] += len(learned)
                state[4] += len(text)
            if len(rows) > 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), kinds)], names=names)
                rows = []
        if state is not None:
            close()
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), kinds)], names=names)

    order = [F.col(c).asc_nulls_first() for c in ("conv_id", "piece")]
    rows = pieces.select("conv_id", "piece", "formatted", "loss_start", "loss_end").repartition("conv_id").sortWithinPartitions(*order)
    return rows.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def format_conversations(conversations: DataFrame) -> DataFrame:
    """Event log -> final messages -> formatted pieces on disk -> digests read back."""
    pieces = written(render(as_events(conversations)), run_folder(conversations.sparkSession, "chat"))
    return digests(pieces)
