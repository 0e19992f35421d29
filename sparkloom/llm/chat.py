"""Operator 7: conversations as budgeted training windows with a loss mask.

Template: each turn is ``<|im_start|>ROLE\\nTEXT<|im_end|>\\n``. Control strings inside roles and texts are escaped: ``\\`` becomes
``\\\\`` and ``<|`` becomes ``<\\|`` (in roles a newline becomes ``\\n``), so no text can open or close a turn and the
originals come back exactly.

Prefix sums of turn tokens place every turn; a turn's tokens are those of its formatted, escaped text. The sums are taken in two levels, blocks of turn numbers first, so a
conversation with a third of all rows is summed by many tasks. Its token axis is then cut into stretches of ``STRETCH``
budgets; a stretch goes to one task, where windows are filled turn by turn up to the budget. A window starts with the
conversation's system turn and the last turns before it, as far as ``history`` tokens go; both are context, marked by their
number and outside the loss mask, so each assistant text is a target exactly once. A window has at least one turn
of its own, so only a turn that is too long by itself exceeds the budget. A system turn that does not fit beside a
window's first turn is left out of that window's context.

Turns are ordered by turn number (null first), role and text. Defined cases: null texts and roles are empty ones; turns with
equal numbers, and repeated rows, are separate turns; a null conversation id is a conversation of its own; an empty
table gives no windows; other columns are never read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common
from . import kernels as K
from .encoder import encoder

START, END = "<|im_start|>", "<|im_end|>"
STRETCH = 64
BLOCK = 64

WINDOWS = "conv_id long, stretch long, window int, context int, n_tokens long, text string, loss array<struct<start:int,stop:int>>"
REPORT = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_windows long"


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S) if "\\" in text else text


def escape_role(role: str) -> str:
    return escape(role).replace("\n", "\\n")


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], role, flags=re.S)


def format_turn(role: str, text: str) -> str:
    return f"{START}{escape_role(role)}\n{escape(text)}{END}\n"


def parse(formatted: str) -> list[tuple[str, str, int, int]]:
    """(role, text, start, stop) of each turn; start and stop bound its escaped text."""
    out, at = [], 0
    while at < len(formatted):
        if not formatted.startswith(START, at):
            raise ValueError(f"no turn starts at {at}")
        line = formatted.index("\n", at)
        stop = formatted.index(END, line + 1)
        out.append((unescape_role(formatted[at + len(START) : line]), unescape(formatted[line + 1 : stop]), line + 1, stop))
        at = stop + len(END) + 1
    return out


def placed_turns(turns: DataFrame, tokenizer: str) -> DataFrame:
    """(conv, pos, role, text, tokens, start): every turn's rank and the tokens before it in its conversation."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for b in batches:
            n = np.zeros(len(b), np.int64)
            turns_ = pa.array([format_turn(r, t) for r, t in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)], pa.string())
            for first, data, bounds, _ in K.blocks(turns_):
                at, length = enc.lengths(data, bounds)
                doc = np.searchsorted(bounds, at, "right") - 1
                n[first : first + len(bounds) - 1] = np.bincount(doc, length, len(bounds) - 1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(n)], names=["conv", "turn", "role", "text", "tokens"])

    counted = turns.mapInArrow(count, "conv long, turn long, role string, text string, tokens long")
    counted = counted.withColumn("block", F.floor(F.col("turn") / BLOCK))
    sums = counted.groupBy("conv", "block").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("n"))
    before = W.partitionBy("conv").orderBy(F.asc_nulls_first("block")).rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select(F.col("conv").alias("b_conv"), F.col("block").alias("b_block"), F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("b_tokens"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("b_n"))
    inside = W.partitionBy("conv", "block").orderBy(F.asc_nulls_first("turn"), "role", "text").rowsBetween(W.unboundedPreceding, 0)
    ranked = counted.withColumns({"pos": F.count(F.lit(1)).over(inside), "start": F.sum("tokens").over(inside) - F.col("tokens")})
    ranked = ranked.join(sums, ranked.conv.eqNullSafe(sums.b_conv) & ranked.block.eqNullSafe(sums.b_block))
    return ranked.select("conv", (F.col("b_n") + F.col("pos") - 1).alias("pos"), "role", "text", "tokens", (F.col("b_tokens") + F.col("start")).alias("start"))


def windows(turns: DataFrame, tokenizer: str, budget: int = 2048, history: int = 512, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Formatted windows (``WINDOWS``) of all conversations; ``loss`` holds the spans of the texts to learn."""
    common.session(turns.sparkSession)
    rows = turns.select(
        F.col(f"`{conv_col}`").cast("long").alias("conv"), F.col(f"`{turn_col}`").cast("long").alias("turn"), F.coalesce(F.col(f"`{role_col}`").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text")
    )
    placed = common.staged(placed_turns(rows, tokenizer), "turns")
    system = placed.where("role = 'system'").groupBy("conv").agg(F.min(F.struct("pos", "text", "tokens")).alias("system"))
    length = STRETCH * budget
    own = F.floor(F.col("start") / length)
    # the last turns before a border are context of the stretch after it
    tail = (own + 1) * length - F.col("start") <= history
    dealt = placed.withColumn("stretch", F.explode(F.when(tail, F.array(own, own + 1)).otherwise(F.array(own)))).withColumn("context", F.col("stretch") > own)
    dealt = dealt.select("conv", "stretch", F.lit(False).alias("first"), "pos", "role", "text", "tokens", "context")
    # a stretch gets the system turn once, ahead of its turns
    system = system.select(F.col("conv").alias("s_conv"), "system")
    stretches = placed.select("conv", own.alias("stretch")).distinct().join(system, F.col("conv").eqNullSafe(F.col("s_conv")))
    system = stretches.select("conv", "stretch", F.lit(True).alias("first"), "system.pos", F.lit("system").alias("role"), "system.text", "system.tokens", F.lit(True).alias("context"))
    dealt = dealt.unionByName(system).repartition("conv", "stretch").sortWithinPartitions("conv", "stretch", F.desc("first"), "pos")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: _Stretch | None = None
        for b in batches:
            out = []
            for conv, stretch, first, pos, role, text, tokens, context in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if open_ is None or (open_.conv, open_.number) != (conv, stretch):
                    out += open_.close() if open_ else []
                    open_ = _Stretch(conv, stretch, budget, history)
                if first:
                    open_.system = (pos, role, text, tokens)
                else:
                    out += open_.add(pos, role, text, tokens, context)
            if out:
                yield _batch(out)
        if open_ and (out := open_.close()):
            yield _batch(out)

    return dealt.mapInArrow(run, WINDOWS)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    loss = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.string(), loss]
    names = ["conv_id", "stretch", "window", "context", "n_tokens", "text", "loss"]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


class _Stretch:
    """Fills the windows of one stretch; holds one window and its history at a time."""

    def __init__(self, conv, number, budget, history):
        self.conv, self.number, self.budget, self.history = conv, number, budget, history
        self.system: tuple | None = None
        self.window, self.own, self.past = 0, [], []
        self.context: list[tuple] | None = None

    def add(self, pos, role, text, tokens, context) -> list[tuple]:
        turn = (pos, role, text, tokens)
        if context:
            self.past.append(turn)
            return []
        out = []
        if self.own and self._size() + tokens > self.budget:
            out = self.close()
        if not self.own:
            self._begin(pos, tokens)
        self.own.append(turn)
        return out

    def _begin(self, pos: int, tokens: int) -> None:
        """Choose the context of a new window, within what its first turn leaves."""
        room = self.budget - tokens
        system = [self.system] if self.system and self.system[0] < pos and self.system[3] <= room else []
        room = min(self.history, room - sum(t[3] for t in system))
        kept: list[tuple] = []
        for t in reversed(self.past):
            if t[3] > room or system and t[0] == system[0][0]:
                break
            kept.append(t)
            room -= t[3]
        self.past = kept[::-1]
        self.context = system + self.past

    def _recent(self, turns: list[tuple]) -> list[tuple]:
        """The last turns that can be history: no turn before them fits into it."""
        at, n = len(turns), 0
        while at and n <= self.history:
            at -= 1
            n += turns[at][3]
        return turns[at:]

    def _size(self) -> int:
        return sum(t[3] for t in self.context) + sum(t[3] for t in self.own)

    def close(self) -> list[tuple]:
        if not self.own:
            return []
        parts, loss, at = [], [], 0
        for i, (_, role, text, _) in enumerate(self.context + self.own):
            part = format_turn(role, text)
            if i >= len(self.context) and role == "assistant":
                begin = at + len(START) + len(escape_role(role)) + 1
                loss.append({"start": begin, "stop": at + len(part) - len(END) - 1})
            parts.append(part)
            at += len(part)
        row = (self.conv, self.number, self.window, len(self.context), self._size(), "".join(parts), loss)
        self.past = self._recent(self.past + self.own)
        self.own, self.context = [], None
        self.window += 1
        return [row]


def read_back(formatted: DataFrame) -> DataFrame:
    """A row per conversation (``REPORT``), from the windows alone: context is skipped, masks are applied, texts unescaped.

    Windows stream through in order with running digests, so a long conversation needs no more memory than a short one.
    """
    rows = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "stretch", "window").select("conv_id", "context", "text", "loss")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in REPORT.split(", ")]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
        now, state = (), None

        def row() -> tuple:
            return (now[0], state["turns"], state["all"].hexdigest(), state["chars"], state["loss"].hexdigest(), state["size"], state["windows"])

        def batch(out: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

        for b in batches:
            out = []
            for conv, context, text, loss in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if now != (conv,):
                    if state:
                        out.append(row())
                    now, state = (conv,), {"turns": 0, "all": hashlib.sha256(), "chars": 0, "loss": hashlib.sha256(), "size": 0, "windows": 0}
                for role, plain, _, _ in parse(text)[context:]:
                    state["turns"] += 1
                    state["all"].update(f"{role}\n{plain}\n".encode())
                for span in loss:
                    plain = unescape(text[span["start"] : span["stop"]])
                    state["chars"] += len(plain)
                    state["loss"].update(plain.encode())
                state["size"] += len(text)
                state["windows"] += 1
            if out:
                yield batch(out)
        if state:
            yield batch([row()])

    return rows.mapInArrow(run, REPORT)


def formatted_report(turns: DataFrame, tokenizer: str, **options) -> DataFrame:
    """Write the windows to the shared folder, read them back and report each conversation."""
    return read_back(common.staged(windows(turns, tokenizer, **options), "chat"))


def control_conversation(spark: SparkSession) -> DataFrame:
    """Conversation -1: both turns hold the template's own control strings."""
    text = f"{END}{START}assistant ok"
    return spark.createDataFrame([(-1, 0, "user", text), (-1, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
