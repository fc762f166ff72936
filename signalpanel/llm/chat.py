"""Chat formatting with typed content parts.

A message's content is an ordered list of parts (text, image, audio, document). A
visitor flattens it: text is escaped and kept, every other part becomes a placeholder
control string, its reference is recorded as an attachment, and the number of tokens
that it expands to is added up. A turn is written

    <|im_start|>ROLE\\nCONTENT<|im_end|>\\n

and the loss mask covers the content of the assistant's turns. Inside texts the
escape character and the opening of a control string are escaped, so that no text
can forge a control string and reading back is exact.

Turns are formatted row by row; ``read_back`` follows one conversation at a time in
order and holds one turn in memory, however long the conversation is.

A part without a type is text, one of another type a placeholder ``other``, recorded under its
own type; a further column named ``parts`` that does not hold typed parts is ignored like others.
Null text or content is empty; a null role is the empty role and never under the
mask; turns are ordered by turn (nulls first), then by what they are written as, so ties
have one order; repeated rows are turns of their own; rows with a null conv_id form one
conversation; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from .common import bound_batches

START, END = "<|im_start|>", "<|im_end|>"
ESCAPE = "\\"
#: Tokens that one part of each kind expands to for each unit of its size.
EXPANSION = {"image": 256, "audio": 50, "document": 512, "other": 1}
KINDS = ("text", "image", "audio", "document")


def escape(text: str) -> str:
    return text.replace(ESCAPE, ESCAPE * 2).replace("<|", "<" + ESCAPE + "|")


def escape_role(role: str) -> str:
    """A role ends at the first newline, so its own newlines are escaped too."""
    return escape(role).replace("\n", ESCAPE + "n")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], text, flags=re.S)


class Flatten:
    """The visitor: one method for each kind of part."""

    def __init__(self):
        self.out: list[str] = []
        self.attachments: list[tuple[int, str, str]] = []
        self.tokens = 0

    def visit(self, parts: list[dict]) -> Flatten:
        for part in parts:
            kind = part.get("type") or "text"
            getattr(self, f"visit_{kind if kind in KINDS else 'other'}")(part)
        return self

    def visit_text(self, part):
        self.out.append(escape(part.get("text") or ""))

    def _attach(self, part, kind=None):
        kind, n = kind or part["type"], len(self.attachments)
        size = int(part.get("size") or 1)
        self.out.append(f"<|{kind}:{n}|>")
        self.attachments.append((n, part["type"], part.get("ref") or ""))
        self.tokens += size * EXPANSION[kind]

    visit_image = visit_audio = visit_document = _attach

    def visit_other(self, part):
        self._attach(part, "other")


def flatten(parts: list[dict]) -> tuple[str, list[tuple[int, str, str]], int]:
    """Content text with placeholders in order, attachment records, tokens that the placeholders expand to."""
    v = Flatten().visit(parts)
    return "".join(v.out), v.attachments, v.tokens


FORMATTED = "conv_id long, turn long, formatted string, loss_start int, loss_end int, attachments array<struct<slot:int,kind:string,ref:string>>, expanded_tokens long"


def format_turns(df: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """Each turn's formatted text, its span under the loss mask (start = end: none), attachments and expanded tokens.

    Content is the column ``parts`` (array of struct type, text, ref, size) if there is one, else ``text``."""
    bound_batches(df.sparkSession)
    kept = [F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string")]
    kind = df.schema["parts"].dataType if "parts" in df.columns else None
    typed = isinstance(kind, ArrayType) and isinstance(kind.elementType, StructType) and "type" in kind.elementType.names
    content = F.col("parts") if typed else F.col("text").cast("string")

    def run(batches):
        for batch in batches:
            rows = []
            for role, c in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                parts = [p for p in c or [] if p] if typed else [{"type": "text", "text": c}]
                body, attached, tokens = flatten(parts)
                head = f"{START}{escape_role(role or '')}\n"
                masked = role == loss_role
                rows.append((head + body + END + "\n", len(head) if masked else 0, len(head) + len(body) if masked else 0, [{"slot": n, "kind": k, "ref": r} for n, k, r in attached], tokens))
            cols = list(zip(*rows)) if rows else [()] * 5
            struct = pa.list_(pa.struct([("slot", pa.int32()), ("kind", pa.string()), ("ref", pa.string())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int32()), pa.array(cols[3], struct), pa.array(cols[4], pa.int64())],
                ["conv_id", "turn", "formatted", "loss_start", "loss_end", "attachments", "expanded_tokens"],
            )

    return df.select(*kept, content.alias("content")).mapInArrow(run, FORMATTED)


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a formatted text; placeholders stay as they are."""
    turns, at = [], 0
    while at < len(formatted):
        if not formatted.startswith(START, at):
            raise ValueError(f"no turn starts at {at}")
        end = formatted.index(END, at)
        role, body = formatted[at + len(START) : end].split("\n", 1)
        turns.append((unescape(role), unescape(body)))
        at = end + len(END) + 1
    return turns


DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, expanded_tokens long"


def read_back(formatted: DataFrame) -> DataFrame:
    """Reads conversations back from formatted turns: counts and digests of turns and of all text under the mask.

    Rows of one conversation are dealt to one task and streamed in order; a task holds a turn, not a conversation."""

    def run(batches):
        now, out = None, []

        def close():
            if now:
                out.append((now["id"], now["n"], now["turns"].hexdigest(), now["loss_n"], now["loss"].hexdigest(), now["chars"], now["tokens"]))

        def flush():
            cols = list(zip(*out))
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names)

        names = [c.split()[0] for c in DIGESTS.split(", ")]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
        for batch in batches:
            for conv, text, lo, hi, tokens in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if now is None or now["id"] != conv:
                    close()
                    now = {"id": conv, "n": 0, "turns": hashlib.sha256(), "loss_n": 0, "loss": hashlib.sha256(), "chars": 0, "tokens": 0}
                for role, said in parse(text):
                    now["n"] += 1
                    now["turns"].update(f"{role}\n{said}\n".encode())
                masked = unescape(text[lo:hi])
                now["loss_n"] += len(masked)
                now["loss"].update(masked.encode())
                now["chars"] += len(text)
                now["tokens"] += tokens
            if len(out) > 10_000:
                yield flush()
        close()
        if out:
            yield flush()

    n = int(formatted.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = formatted.select("conv_id", "formatted", "loss_start", "loss_end", "expanded_tokens", "turn").repartition(n, "conv_id")
    return dealt.sortWithinPartitions("conv_id", "turn", "formatted").mapInArrow(run, DIGESTS)
