"""Chat formatting in budgeted, turn-aligned windows with a loss mask.

Template. A window starts with ``<s>``. A user's turn is ``[INST]text[/INST]``, an assistant's
``text</s>``, any other ``[ROLE]role[/ROLE]text</s>``. Control strings inside texts and roles get a
backslash behind their first character (one more if they have some), so raw ones are marks only
and ``unescape`` gives the text back.

Windows. The prefix sum of a conversation's turn tokens says where a turn lies. A conversation within
the budget is one window. Of a longer one the first window may take the whole budget, each later one
the budget less history and system turn. Borders lie at equal distances, by ``cross`` tokens closer
than that share: turns that begin between two borders share a window, and its last turn may reach
over the border by that much. A turn that reaches further has a window of its own. So the windows
of one conversation are found without walking through it, and all but a single overlong turn
fit the budget. Each window but the first also repeats the leading system turn, and the latest turns before it that
start at most ``history`` tokens earlier.

Loss. Spans of characters over the assistants' texts of a window's own turns; repeated turns are
masked. So each assistant text is a target exactly once.

Turns are ordered by ``turn`` (null last), then role and text; repeated rows are turns of their
own. Null text or role counts as empty. Turns with a null ``conv_id`` form one conversation. An
overlong turn is kept whole, in a window marked ``over``. A long conversation is dealt by ranges of
turn numbers and by windows; only ``read_back`` passes it through one task, as a digest over a
sequence asks, and holds one window. An empty table gives an empty table; further columns are not
read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowspark.llm.chunktable import encoder
from flowspark.session import cut_lineage

CONTROL = re.compile(r"([<\[])(\\*)(/?(?:s>|INST\]|ROLE\]))")
ESCAPED = re.compile(r"([<\[])\\(\\*/?(?:s>|INST\]|ROLE\]))")
BEGIN, END = "<s>", "</s>"


@dataclass(frozen=True)
class Budget:
    tokens: int = 2048  # of a window
    history: int = 384  # of repeated turns
    least: int = 256  # of own turns, however long the system turn is
    cross: int = 256  # by which a window's last turn may reach over its border
    chunk: int = 256  # turn numbers a task's share of a conversation


def escape(text: str) -> str:
    return CONTROL.sub(r"\1\\\2\3", text)


def unescape(text: str) -> str:
    return ESCAPED.sub(r"\1\2", text)


def turn_parts(role: str, text: str) -> tuple[str, str, str]:
    """What stands before the text, the escaped text, and what stands behind it."""
    if role == "user":
        return "[INST]", escape(text), "[/INST]"
    if role == "assistant":
        return "", escape(text), END
    return f"[ROLE]{escape(role)}[/ROLE]", escape(text), END


def parse(window: str) -> Iterator[tuple[str, str, int, int]]:
    """The turns of a formatted window: role, text, and the span of the escaped text."""
    if not window.startswith(BEGIN):
        raise ValueError("not a window")
    at = len(BEGIN)
    while at < len(window):
        role, close = "assistant", END
        if window.startswith("[INST]", at):
            role, close, at = "user", "[/INST]", at + 6
        elif window.startswith("[ROLE]", at):
            stop = window.index("[/ROLE]", at)
            role, at = unescape(window[at + 6 : stop]), stop + 7
        stop = window.index(close, at)
        yield role, unescape(window[at:stop]), at, stop
        at = stop + len(close)


def counted(turns: DataFrame, ranks: str) -> DataFrame:
    """Adds ``tokens``: the ids of the formatted turn."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder("byte", ranks)
        for b in batches:
            n = [len(x) for x in enc.encode("".join(turn_parts(r, t)) for r, t in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True))]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(n, pa.int64())], [*b.schema.names, "tokens"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in turns.schema)
    return turns.mapInArrow(run, f"{kinds}, tokens long")


def placed(conversations: DataFrame, ranks: str, b: Budget) -> DataFrame:
    """Turns with their tokens and where they lie in their conversation: ``begin``, and ``window``."""
    turns = conversations.select(
        "conv_id",
        "turn",
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
        F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("null")).alias("_c"),
        F.coalesce(F.floor(F.col("turn") / b.chunk), F.lit(2**62)).alias("_k"),
    )
    turns = counted(turns, ranks)
    order = [F.col("turn").asc_nulls_last(), "role", "text"]
    own = Window.partitionBy("_c", "_k").orderBy(*order)
    turns = turns.withColumn("_in", F.sum("tokens").over(own.rowsBetween(Window.unboundedPreceding, 0)) - F.col("tokens")).withColumn("_r", F.row_number().over(own))
    first = F.struct("_k", "_r", "role", "tokens")
    parts = turns.groupBy("_c", "_k").agg(F.sum("tokens").alias("_n"), F.min(first).alias("_f"))
    over = Window.partitionBy("_c").orderBy("_k")
    system = F.first("_f").over(over.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    parts = parts.select(
        "_c",
        "_k",
        (F.sum("_n").over(over.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")).alias("_before"),
        F.when(system["role"] == "system", system["tokens"]).otherwise(0).alias("_system"),
        F.sum("_n").over(over.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("_all"),
    )
    share = F.greatest(F.lit(b.tokens - b.history - 1) - F.col("_system"), F.lit(b.least))
    cross = F.least(F.lit(b.cross), F.floor(share / 4))
    begin, step, more = F.col("_before") + F.col("_in"), share - cross, F.lit(b.tokens - 1) - share  # more: of the first window
    nth = F.floor(F.greatest(begin - more, F.lit(0)) / step)
    reaches = begin + F.col("tokens") > more + (nth + 1) * step + cross
    window = F.when(F.col("_all") < b.tokens, 0).otherwise(2 * nth + reaches.cast("long"))
    return turns.join(parts, ["_c", "_k"]).select("_c", "conv_id", "role", "text", "tokens", "_system", begin.alias("begin"), window.cast("long").alias("window"))


def windows(conversations: DataFrame, ranks: str, budget: Budget | None = None) -> DataFrame:
    """Formatted windows: conv_id, window, text, loss (spans), repeated and turns (counts), tokens, over."""
    b = budget or Budget()
    turns = cut_lineage(placed(conversations, ranks, b))  # read four times below
    cols = ["_c", "conv_id", "window", "begin", "role", "text", "tokens"]
    new = turns.select(*cols, F.lit(False).alias("repeated"))
    starts = turns.groupBy("_c", "window").agg(F.min("begin").alias("start"))
    # a turn is history of the windows that start behind it, at most ``history`` tokens after its start
    near = starts.select("_c", F.col("window").alias("_w"), "start", F.floor(F.col("start") / b.history).alias("_h"))
    at = F.floor(F.col("begin") / b.history)
    reach = turns.withColumn("_h", F.explode(F.array(at, at + 1)))
    history = reach.join(near, ["_c", "_h"]).where((F.col("start") > F.col("begin")) & (F.col("start") <= F.col("begin") + b.history) & (F.col("_w") > F.col("window")))
    history = history.where((F.col("begin") > 0) | (F.col("role") != "system")).withColumn("window", F.col("_w")).select(*cols, F.lit(True).alias("repeated"))
    leading = turns.where((F.col("begin") == 0) & (F.col("role") == "system")).withColumnRenamed("window", "_w")
    system = leading.join(starts.select("_c", "window"), "_c").where(F.col("window") > F.col("_w")).select(*cols, F.lit(True).alias("repeated"))
    every = new.unionByName(history).unionByName(system)
    kind = conversations.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, text, size, loss, counts, tokens, conv = None, [], 0, [], [0, 0], 0, None

        def row() -> dict:
            return {"conv_id": conv, "window": key[1], "text": "".join(text), "loss": loss, "repeated": counts[1], "turns": counts[0], "tokens": tokens, "over": tokens > b.tokens}

        schema = None
        for batch in batches:
            schema = schema or pa.schema([("conv_id", batch.schema.field("conv_id").type), ("window", pa.int64()), ("text", pa.string()), ("loss", pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))), ("repeated", pa.int64()), ("turns", pa.int64()), ("tokens", pa.int64()), ("over", pa.bool_())])
            out = []
            for r in batch.to_pylist():
                if (r["_c"], r["window"]) != key:
                    if key is not None:
                        out.append(row())
                    key, conv = (r["_c"], r["window"]), r["conv_id"]
                    text, size, loss, counts, tokens = [BEGIN], len(BEGIN), [], [0, 0], 1
                before, body, after = turn_parts(r["role"], r["text"])
                text += (before, body, after)
                if r["role"] == "assistant" and not r["repeated"]:
                    loss.append({"begin": size, "end": size + len(body)})
                size += len(before) + len(body) + len(after)
                counts[r["repeated"]] += 1
                tokens += r["tokens"]
            yield pa.RecordBatch.from_pylist(out, schema)
        if key is not None:
            yield pa.RecordBatch.from_pylist([row()], schema)

    made = "window long, text string, loss array<struct<begin:long,end:long>>, repeated long, turns long, tokens long, over boolean"
    dealt = every.repartition("_c", "window").sortWithinPartitions("_c", "window", "begin")
    return dealt.mapInArrow(run, f"conv_id {kind}, {made}")


def read_back(formatted: DataFrame) -> DataFrame:
    """Per conversation, from its windows alone: digests of the turns and of the text under the mask.

    conv_id, n_turns, turns_sha256 (role, line end, text, line end of each turn), loss_chars,
    loss_sha256, formatted_chars.
    """
    kind = formatted.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        state, key = None, object()
        schema = None
        for b in batches:
            schema = schema or pa.schema([(n, b.schema.field("conv_id").type if n == "conv_id" else pa.string() if "sha" in n else pa.int64()) for n in names])
            out = []
            for r in b.to_pylist():
                if r["conv_id"] != key:
                    if state is not None:
                        out.append(state)
                    key, state = r["conv_id"], [r["conv_id"], 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                text = r["text"]
                for i, (role, body, _, _) in enumerate(parse(text)):
                    if i >= r["repeated"]:
                        state[1] += 1
                        state[2].update(f"{role}\n{body}\n".encode("utf-8", "surrogatepass"))
                for s in r["loss"]:
                    target = unescape(text[s["begin"] : s["end"]])
                    state[3] += len(target)
                    state[4].update(target.encode("utf-8", "surrogatepass"))
                state[5] += len(text)
            yield done(out, schema)
        if state is not None:
            yield done([state], schema)

    def done(rows: list[list], schema: pa.Schema) -> pa.RecordBatch:
        plain = [[x.hexdigest() if hasattr(x, "hexdigest") else x for x in r] for r in rows]
        return pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in plain], schema)

    dealt = formatted.select("conv_id", "window", "text", "loss", "repeated").repartition("conv_id").sortWithinPartitions("conv_id", "window")
    return dealt.mapInArrow(run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
