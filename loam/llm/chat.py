"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it as context, and only its own text trainable.
A conversation that doesn't end with an assistant turn gives one more example, of all its turns and with nothing
trainable, so that no turn is lost. A turn is written as

    <turn>role LF text</turn> LF

with a backslash put before every backslash and `<` of the text (and of the role, whose line feeds become `\\n`), so
that a marker never stands inside a text, and reading is exact. The trainable part is given as code points from
`loss_start` to `loss_end` (both null without one).

Turns are sorted by turn (null last), role, then text; null role and text count as empty; rows with a null conv_id
are one conversation. Repeated rows are repeated turns. A conversation is written out once for each of its replies:
an example is as long as what it holds, and one row at a time is made from it.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loam.llm._common import prepare

TARGET = "assistant"
#: conv_id, role and text of the conversation that every run adds.
ADDED = -7
ADDED_TEXT = "\\### Assistant: </turn> ok"

_TURN = re.compile(r"<turn>((?:[^<\\\n]|\\.)*)\n((?:[^<\\]|\\.)*)</turn>\n", re.DOTALL)
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)


def _escape(value: Column) -> Column:
    return F.replace(F.replace(value, F.lit("\\"), F.lit("\\\\")), F.lit("<"), F.lit("\\<"))


def format_examples(conversations: DataFrame) -> DataFrame:
    """conv_id, turns (in the example), is_last, formatted, loss_start, loss_end; one row for each example."""
    prepare(conversations.sparkSession)
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    head = F.concat(F.lit("<turn>"), F.replace(_escape(role), F.lit("\n"), F.lit("\\n")), F.lit("\n"))
    rows = conversations.select("conv_id", F.col("turn").isNull().alias("late"), "turn", role.alias("role"), text.alias("text"), head.alias("head"), _escape(text).alias("body"))
    turns = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("late", "turn", "role", "text", "head", "body"))).alias("t"))
    ends = F.filter(F.sequence(F.lit(1), F.size("t")), lambda k: (k == F.size("t")) | (F.get("t", k - 1)["role"] == TARGET))
    shown = turns.select("conv_id", F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["head"].alias("head"), x["body"].alias("body"))).alias("t"), ends.alias("ends"))
    shown = shown.select("conv_id", "t", F.explode("ends").alias("turns"))
    text = lambda part: F.array_join(F.transform(part, lambda x: F.concat(x["head"], x["body"], F.lit("</turn>\n"))), "")
    last = F.get("t", F.col("turns") - 1)
    shown = shown.select("conv_id", "turns", (F.col("turns") == F.size("t")).alias("is_last"), text(F.slice("t", F.lit(1), F.col("turns"))).alias("formatted"), last.alias("last"))
    stop = F.length("formatted") - len("</turn>\n")
    trained = F.col("last.role") == TARGET
    return shown.select("conv_id", F.col("turns").cast("long").alias("turns"), "is_last", "formatted", F.when(trained, stop - F.length("last.body")).cast("long").alias("loss_start"), F.when(trained, stop).cast("long").alias("loss_end"))


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """Role and text of every turn of a formatted example. Anything else than whole turns is an error."""
    out, at = [], 0
    while at < len(formatted):
        if not (found := _TURN.match(formatted, at)):
            raise ValueError("not a formatted conversation")
        out.append((unescape(found[1]), unescape(found[2])))
        at = found.end()
    return out


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: "\n" if m[1] == "n" else m[1], text)


def digest(examples: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars: what the formatted examples say."""
    kind = examples.schema["conv_id"].dataType.simpleString()

    def batches(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in given:
            for row in range(batch.num_rows):  # an example may be long: one at a time
                one = {c: batch.column(c)[row].as_py() for c in ("turns", "is_last", "formatted", "loss_start", "loss_end")}
                loss = unescape(one["formatted"][one["loss_start"] : one["loss_end"]]) if one["loss_end"] is not None else ""
                turns = read_turns(one["formatted"]) if one["is_last"] else []
                said = hashlib.sha256("".join(f"{role}\n{text}\n" for role, text in turns).encode()).hexdigest() if turns else None
                yield pa.RecordBatch.from_pydict({
                    "conv_id": batch.column("conv_id").slice(row, 1), "turns": pa.array([one["turns"]], pa.int64()), "n_turns": pa.array([len(turns) if turns else None], pa.int64()),
                    "turns_sha256": pa.array([said], pa.string()), "loss": pa.array([loss], pa.string()), "chars": pa.array([len(one["formatted"])], pa.int64()),
                })

    parts = examples.mapInArrow(batches, f"conv_id {kind}, turns bigint, n_turns bigint, turns_sha256 string, loss string, chars bigint")
    whole = parts.groupBy("conv_id").agg(
        F.max("n_turns").alias("n_turns"),
        F.max("turns_sha256").alias("turns_sha256"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turns", "loss"))), lambda x: x["loss"]), "").alias("loss"),
        F.sum("chars").alias("formatted_chars"),
    )
    return whole.select("conv_id", "n_turns", "turns_sha256", F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")


def with_added(conversations: DataFrame) -> DataFrame:
    """The conversations, and one whose texts look like markers."""
    rows = [(ADDED, 0, "user", ADDED_TEXT), (ADDED, 1, TARGET, ADDED_TEXT)]
    added = conversations.sparkSession.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    return conversations.select("conv_id", "turn", "role", "text").union(added)
