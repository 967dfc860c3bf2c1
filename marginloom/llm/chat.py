"""Chat formatting with typed content parts.

A turn is a list of parts: text, image, audio, document, or any other kind with a reference. A visitor goes through the parts of all
turns in order and writes them flat: text is escaped and copied, any other part becomes a numbered
placeholder, its reference goes to the list of attachments, and its token count is what the
placeholder will expand to.

The template puts `<|turn|>role<|body|>` before and `<|end|>` after the parts of a turn. Control strings
start with `<|`. In texts and roles, every `<` that is followed by any number of backslashes and a `|`
gets one more backslash, so no text can hold a control string; taking one backslash away again
restores it. The mask of the loss covers what the assistant says, without the marks.

Every turn is formatted on its own, so long conversations spread over all tasks. What needs the
turns of a conversation in order reads them as a sorted stream and holds one turn at a time.

Unusual rows: a null text or part list is empty, a part without a kind is text, a null role is written as an empty one, turns with
equal numbers are ordered by role and text, a null turn number comes first, and rows with a null
conversation id are one conversation.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN, BODY, END = "<|turn|>", "<|body|>", "<|end|>"
LOSS_ROLE = "assistant"
# Tokens of one unit (a tile, a second, a page) of each kind of part; one of a kind not listed here.
TOKENS_PER_UNIT = {"image": 256, "audio": 25, "document": 512}
PARTS = "array<struct<type:string,text:string,ref:string,units:int>>"


def escape(text: Column) -> Column:
    """Java's replacement text needs a backslash doubled."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"<(\\*)\|", r"<\\$1|")


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def text_part(text: Column) -> Column:
    """A list with one text part."""
    return F.array(F.struct(F.lit("text").alias("type"), text.alias("text"),
                            F.lit(None).cast("string").alias("ref"), F.lit(0).alias("units"))).cast(PARTS)


def _attached(part: Column) -> Column:
    """Whether a part is anything but text."""
    return F.coalesce(part["type"], F.lit("text")) != "text"


def _visit(part: Column, number: Column) -> Column:
    """What one part becomes: string written, attachment (null for text), expanded tokens."""
    kind = part["type"]
    tokens = F.coalesce(part["units"], F.lit(1)) * F.coalesce(
        *[F.when(kind == k, F.lit(n)) for k, n in TOKENS_PER_UNIT.items()], F.lit(1))
    mark = F.concat(F.lit("<|"), escape(kind), F.lit(":"), number.cast("string"), F.lit("|>"))
    return F.struct(F.when(_attached(part), mark).otherwise(escape(part["text"])).alias("out"),
                    F.when(_attached(part), F.struct(kind.alias("kind"), part["ref"].alias("ref"),
                                           tokens.alias("tokens"))).alias("attachment"))


def format_turns(turns: DataFrame, parts: str = "parts", role: str = "role") -> DataFrame:
    """Add `formatted`, `loss_start`, `loss_length` and `attachments` to every turn; columns of these
    names must not be there.

    The loss span counts code points of `formatted`; its length is 0 for other roles. Parts that are
    no text are numbered from 0 in the turn, in their order; attachments have kind, ref, tokens.
    """
    listed = F.coalesce(F.col(parts), F.array().cast(PARTS))
    visited = F.transform(listed, lambda p, i: _visit(p, F.size(F.filter(
        F.slice(listed, F.lit(1), i), _attached))))
    shown = F.coalesce(F.col(role), F.lit(""))
    head = F.concat(F.lit(TURN), escape(shown), F.lit(BODY))
    rows = turns.withColumn("_v", visited).withColumn("_head", head).withColumn(
        "_body", F.array_join(F.transform("_v", lambda v: v["out"]), ""))
    return rows.withColumns({
        "formatted": F.concat("_head", "_body", F.lit(END)),
        "loss_start": F.char_length("_head"),
        "loss_length": F.when(shown == LOSS_ROLE, F.char_length("_body")).otherwise(0),
        "attachments": F.filter(F.transform("_v", lambda v: v["attachment"]), lambda a: a.isNotNull()),
    }).drop("_v", "_head", "_body")


def parse_turn(formatted: str) -> tuple[str, str]:
    """(role, text) of one formatted turn."""
    head, _, body = formatted.partition(BODY)
    return unescape(head.removeprefix(TURN)), unescape(body.removesuffix(END))


def read_back(formatted: DataFrame, conversation: str, order: list[str]) -> DataFrame:
    """Digests of every conversation, read from its formatted turns and their loss spans.

    The turns of a conversation arrive sorted; one turn is held at a time.
    """
    rows = formatted.select(conversation, "formatted", "loss_start", "loss_length", *order).repartition(
        conversation).sortWithinPartitions(conversation, *order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None

        def close() -> pa.RecordBatch:
            key, n, turns, chars, loss, size = state
            return pa.RecordBatch.from_arrays(
                [pa.array([key], pa.int64()), pa.array([n]), pa.array([turns.hexdigest()]),
                 pa.array([chars]), pa.array([loss.hexdigest()]), pa.array([size])],
                ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

        for batch in batches:
            done = []
            for key, text, start, length in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if state is None or state[0] != key:
                    if state is not None:
                        done.append(close())
                    state = [key, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                role, body = parse_turn(text)
                state[1] += 1
                state[2].update(f"{role}\n{body}\n".encode())
                said = unescape(text[start:start + length])
                state[3] += len(said)
                state[4].update(said.encode())
                state[5] += len(text)
            if done:
                yield pa.Table.from_batches(done).combine_chunks().to_batches()[0]
        if state is not None:
            yield close()

    return rows.mapInArrow(run, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, "
                                "loss_sha256 string, formatted_chars bigint")
