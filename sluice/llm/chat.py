"""Chat formatting in budgeted windows with a loss mask.

Turns of a conversation get prefix sums of their tokens.  What a window may hold, ``BUDGET``
tokens, is dealt out beforehand: ``HISTORY`` for repeated turns, ``SYSTEM`` for the system turn,
the rest for targets.  A turn belongs to the span that its prefix falls into, spans being half
of that rest wide, so a span's turns fit even where the last one reaches into the next span; a
turn longer than half of the rest is a span of its own.  Spans are aligned to turns and need no
sequential packing.  A window is one span's turns, its targets, after

* the conversation's system turn, if it opens with one of at most ``SYSTEM`` tokens and the
  window does not hold it anyway (system turns at other places are turns like any other),
* the turns directly before the span, as many as fit ``HISTORY`` tokens, repeated as context.

A turn that does not fit the rest alone stands alone and whole, without anything repeated:
the only windows over the budget.

Every turn is a target exactly once.  The loss mask covers the texts of assistant turns
among the targets only; repeated ones are masked out.  ``repeated`` says how many
turns at the head of a window are repeats.

Template: ``### role: text</turn>\\n`` per turn.  A backslash goes before the control
strings inside texts and before backslashes themselves (in roles before colons too),
so windows can be read back exactly: ``read_window``.

A conversation may hold a third of all rows: prefix sums are taken per block of
``BLOCK`` turn numbers first and over the blocks after that, windows gather one span
(each turn counts ``TURN_COST`` tokens at least, so a span is bounded), and the system
turn comes by a join that adaptive execution can split.  Only the digest of a
conversation is sequential by nature: it streams through one task that holds one batch.

Defined cases: NULL text and NULL role are empty; NULL conv_id is one conversation;
NULL turns come first, ties go by role and text; repeated rows are turns of their
own; an empty text is a turn like any other; an empty table has no windows; other
columns of the table are not part of a window and are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluice.llm.common import cut

BUDGET = 2048
HISTORY = 256
SYSTEM = 512
TURN_COST = 4
BLOCK = 64
# Tokens are counted with a tokenizer file where one is given, in pieces of this size.
PIECE = 8192

_TURN = re.compile(r"### ((?:[^\\:]|\\.)*+): ((?:[^\\<]|\\.|<(?!/turn>))*+)</turn>\n", re.S)
_UNESCAPE = re.compile(r"\\(.)", re.S)


def escape(text: Column) -> Column:
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    text = F.replace(text, F.lit("###"), F.lit("\\###"))
    return F.replace(text, F.lit("</turn>"), F.lit("\\</turn>"))


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1", text)


def simple_tokens(text: Column) -> Column:
    """Words and single punctuation marks: a count without a tokenizer file."""
    return F.regexp_count(text, F.lit(r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]")).cast("bigint")


def tokenizer_tokens(text: Column, path: str) -> Column:
    """Tokens by a tokenizer file at ``path``, which every executor can read."""
    held = {}

    def count(texts: pd.Series) -> pd.Series:
        from tokenizers import Tokenizer
        if not held:
            held["it"] = Tokenizer.from_file(path)
            held["it"].encode_special_tokens = True
        out = []
        for t in texts:
            pieces = [t[i:i + PIECE] for i in range(0, len(t), PIECE)]
            out.append(sum(len(e.ids) for e in held["it"].encode_batch(
                pieces, add_special_tokens=False)))
        return pd.Series(out, dtype="int64")
    return F.pandas_udf(count, "bigint")(text)


def placed_turns(turns: DataFrame, wide: int, tokenizer: str | None = None) -> DataFrame:
    """Turns with ``pos`` (1-based), ``before`` (tokens before them) and ``bigs`` (turns of more
    than ``wide`` tokens up to them)."""
    text, role = F.coalesce("text", F.lit("")), F.coalesce("role", F.lit(""))
    rows = turns.select("conv_id", "turn", role.alias("role"), text.alias("text"))
    counted = tokenizer_tokens(F.col("text"), tokenizer) if tokenizer else (
        simple_tokens(F.col("text")))
    rows = (rows.withColumn("tokens", counted + TURN_COST)
            .withColumn("block", F.floor(F.col("turn") / BLOCK)))
    big = (F.col("tokens") > wide).cast("int")
    keys = ["conv_id", "block"]
    within = Window.partitionBy(*keys).orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    # Running sums over rows, not over ties.
    up_to = within.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({
        "pos": F.row_number().over(within),
        "before": F.sum("tokens").over(up_to) - F.col("tokens"), "bigs": F.sum(big).over(up_to)})
    blocks = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum("tokens").alias("t"),
                                     F.sum(big).alias("g"))
    earlier = (Window.partitionBy("conv_id").orderBy(F.col("block").asc_nulls_first())
               .rowsBetween(Window.unboundedPreceding, -1))
    offsets = blocks.select(
        F.col("conv_id").alias("_c"), F.col("block").alias("_b"),
        *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"_{c}") for c in ("n", "t", "g")])
    same = F.col("conv_id").eqNullSafe(F.col("_c")) & F.col("block").eqNullSafe(F.col("_b"))
    return (rows.join(offsets, same)
            .select("conv_id", "role", "text", "tokens",
                    (F.col("pos") + F.col("_n")).cast("bigint").alias("pos"),
                    (F.col("before") + F.col("_t")).cast("bigint").alias("before"),
                    (F.col("bigs") + F.col("_g")).cast("bigint").alias("bigs")))


def windows(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY,
            system: int = SYSTEM, tokenizer: str | None = None) -> DataFrame:
    """One row per window: conv_id, span (tokens before its first target), text, repeated, loss
    (array of start, end in code points of text), tokens."""
    rest = budget - history - system
    wide = rest // 2
    if wide < TURN_COST:
        raise ValueError("history and system leave no room for targets")
    placed = cut(placed_turns(turns, wide, tokenizer), "placed")
    big = F.col("tokens") > wide
    turn = F.struct("pos", F.lit(False).alias("again"), "role",
                    escape(F.col("text")).alias("text"), "tokens")
    spans = cut(placed.groupBy(
        "conv_id", F.floor(F.col("before") / wide).alias("part"), "bigs", big.alias("big")).agg(
        F.min("before").alias("span"), F.array_sort(F.collect_list(turn)).alias("ts"),
        F.sum("tokens").alias("t")).select(
        "conv_id", "span", "ts", (F.col("t") > rest).alias("alone")), "spans")
    # What precedes a span by at most ``history`` tokens lies in its bucket or the one before.
    near = spans.filter(~F.col("alone") & (F.col("span") > 0)).select(
        F.col("conv_id").alias("_c"), F.col("span").alias("_s"), F.explode(F.array(
            F.floor(F.col("span") / history), F.floor(F.col("span") / history) - 1)).alias("_b"))
    again = F.struct("pos", F.lit(True).alias("again"), "role",
                     escape(F.col("text")).alias("text"), "tokens")
    gap = F.col("_s") - F.col("before")
    repeats = (placed.filter(F.col("tokens") <= history)
               .withColumn("bucket", F.floor(F.col("before") / history))
               .join(near, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("bucket") == F.col("_b")))
               .filter((gap > 0) & (gap <= history))
               .groupBy("_c", "_s").agg(F.array_sort(F.collect_list(again)).alias("old")))
    joined = spans.join(repeats, F.col("conv_id").eqNullSafe(F.col("_c"))
                        & (F.col("span") == F.col("_s")), "left").drop("_c", "_s")
    first = (placed.filter((F.col("pos") == 1) & (F.col("role") == "system")
                           & (F.col("tokens") <= system))
             .select(F.col("conv_id").alias("_c"), F.struct(
                 escape(F.col("text")).alias("text"), "tokens").alias("system")))
    joined = joined.join(first, F.col("conv_id").eqNullSafe(F.col("_c")), "left").drop("_c")
    whole = F.concat(F.coalesce("old", F.array().cast(joined.schema["ts"].dataType)), "ts")
    made = F.pandas_udf(_format, "text string, repeated int, loss array<struct<start:int,end:int>>,"
                                 " tokens bigint")
    return (joined.withColumn("w", made(whole, F.when(~F.col("alone"), F.col("system"))))
            .select("conv_id", "span", "w.text", "w.repeated", "w.loss", "w.tokens"))


def _format(spans: pd.Series, systems: pd.DataFrame) -> pd.DataFrame:
    out = []
    for turns, text, cost in zip(spans, systems["text"], systems["tokens"], strict=True):
        used = list(turns)
        repeated = next(i for i, t in enumerate(used) if not t["again"])
        if text is not None and used[0]["pos"] > 1:
            used = [{"role": "system", "text": text, "again": True, "tokens": int(cost)}, *used]
            repeated += 1
        parts, loss, at = [], [], 0
        for t in used:
            role = t["role"].replace("\\", "\\\\").replace(":", "\\:")
            lead = f"### {role}: "
            if not t["again"] and t["role"] == "assistant" and t["text"]:
                loss.append({"start": at + len(lead), "end": at + len(lead) + len(t["text"])})
            parts += [lead, t["text"], "</turn>\n"]
            at += len(lead) + len(t["text"]) + len("</turn>\n")
        out.append(("".join(parts), repeated, loss, sum(t["tokens"] for t in used)))
    return pd.DataFrame(out, columns=["text", "repeated", "loss", "tokens"])


def read_window(text: str, repeated: int = 0) -> list[tuple[str, str]]:
    """(role, text) of a window's targets, read back from its formatted text."""
    found, at = [], 0
    while at < len(text):
        m = _TURN.match(text, at)
        if m is None:
            raise ValueError("not a formatted window")
        found.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return found[repeated:]


DIGEST = ("conv_id string, n_turns bigint, turns_sha256 string, loss_chars bigint, "
          "loss_sha256 string, formatted_chars bigint")


def _digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Windows sorted by conversation and span, to one row per conversation."""
    columns = [c.split()[0] for c in DIGEST.split(", ")]
    key, state = object(), None

    def row():
        return (key, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4])

    for batch in batches:
        done = []
        for conv, text, repeated, loss in zip(batch["conv_id"], batch["text"], batch["repeated"],
                                              batch["loss"], strict=True):
            conv = None if pd.isna(conv) else conv
            if state is None or conv != key:
                if state is not None:
                    done.append(row())
                key, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            for role, said in read_window(text, repeated):
                state[0] += 1
                state[1].update(f"{role}\n{said}\n".encode())
            for s in loss:
                target = unescape(text[s["start"]:s["end"]])
                state[2] += len(target)
                state[3].update(target.encode())
            state[4] += len(text)
        yield pd.DataFrame(done, columns=columns)
    if state is not None:
        yield pd.DataFrame([row()], columns=columns)


def digests(made: DataFrame) -> DataFrame:
    """Per conversation, what its windows hold, read back from their texts."""
    kind = made.schema["conv_id"].dataType
    rows = (made.withColumn("conv_id", F.col("conv_id").cast("string"))
            .repartition("conv_id").sortWithinPartitions("conv_id", "span")
            .select("conv_id", "text", "repeated", "loss"))
    found = rows.mapInPandas(_digest, DIGEST)
    return found.withColumn("conv_id", F.col("conv_id").cast(kind))
