"""Chat formatting: conversations as windows of a token budget, with a loss mask, and back. DataFrame functions only.

Turns are numbered by running sums of their tokens. What remains of the budget after the system turn and the repeated
history is the room for new turns. A conversation that fits is one window. Otherwise the running sum is cut at every half
room, a new turn belongs to the half in which it begins, and a turn longer than half the room has a window of its own; so
windows hold whole turns, each turn is new in one window, and two turns need not be looked at together to find out which.
A window repeats the system turn and as many of the turns before its first as the history allows. Only new turns of the
learnt roles lie under the loss mask, so what is repeated is never learnt twice.

A window is over the budget only if the system turn or a turn alone makes it so; turns are never cut.

In the text, ``begin role newline text end`` is a turn. A control string inside a role or a text gets a backslash after its
first character, one more if backslashes stand there already, so every text can be read back; other text stays as it is.

Defined results: a null text or role is empty; turns are ordered by turn (null first), then role, then a hash of the text;
repeated rows are turns each; rows without conv_id are one conversation; a conversation's system turn is its first turn if
that has the system role, other turns of that role are ordinary; extra columns are ignored; no rows give no windows.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradelattice.llm.common import text_of
from tradelattice.operators.ordering import running_totals
from tradelattice.session import stage

#: Marks of public chat templates that tokenizers turn into single control tokens.
CONTROLS = (
    "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>",
    "<|system|>", "<|user|>", "<|assistant|>",
)


@dataclass(frozen=True)
class Template:
    """``begin`` and ``end`` mark a turn and are control strings themselves; ``after`` follows each turn."""

    begin: str = "<|im_start|>"
    end: str = "<|im_end|>"
    after: str = "\n"
    controls: tuple[str, ...] = CONTROLS

    def __post_init__(self):
        marks = self.marks
        if any(len(m) < 2 or "\\" in m or "\n" in m for m in marks):
            raise ValueError("control strings need two characters, and no backslash or newline")
        for a, b in [*permutations(marks, 2), *((m, m) for m in marks)]:
            for k in range(1, len(a)):
                if b.startswith(a[k:]) or a[k:].startswith(b):
                    raise ValueError(f"control strings {a} and {b} overlap")

    @property
    def marks(self) -> list[str]:
        return sorted({self.begin, self.end, *self.controls})

    def _rests(self) -> dict[str, str]:
        """First characters of the control strings, each with a pattern of what follows after any backslashes."""
        rests: dict[str, list[str]] = {}
        for mark in self.marks:
            rests.setdefault(mark[0], []).append(re.escape(mark[1:]))
        return {first: rf"(?=\\*+(?:{'|'.join(rest)}))" for first, rest in rests.items()}

    def escape(self, text: Column) -> Column:
        return F.regexp_replace(text, "|".join(re.escape(first) + rest for first, rest in self._rests().items()), r"$0\\")

    def unescape(self, text: Column) -> Column:
        return F.regexp_replace(text, "|".join(rf"(?<={re.escape(first)})\\{rest}" for first, rest in self._rests().items()), "")

    def escape_role(self, role: Column) -> Column:
        """A role is one line."""
        return self.escape(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")))

    def unescape_role(self, role: Column) -> Column:
        return F.replace(F.replace(self.unescape(role), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


@dataclass(frozen=True)
class Settings:
    """Tokens of a window and of its repeated history, and tokens that the marks of a turn cost."""

    budget: int = 1024
    history: int = 256
    marks: int = 5
    system: str = "system"
    learnt: tuple[str, ...] = ("assistant",)

    def __post_init__(self):
        if self.marks < 1 or self.history < 0 or self.budget <= self.history:
            raise ValueError("a turn costs a token at least, and the history is a part of the budget")


def estimated_tokens(text: Column) -> Column:
    """About the tokens of a text: four letters or digits, or one other visible character, make one."""
    return F.regexp_count(text, F.lit(r"[\p{L}\p{N}]{1,4}|[^\p{L}\p{N}\x00-\x20]"))


def keyed(conversations: DataFrame) -> DataFrame:
    """The turns, with keys that are never null: ``_conv`` of the conversation; ``_at``, ``role`` and ``_tie`` of the turn in it."""
    return conversations.select(
        "conv_id", F.col("turn").alias("_turn"), F.coalesce("role", F.lit("")).alias("role"), text_of().alias("text"),
        F.coalesce(F.concat(F.lit("c"), F.col("conv_id").cast("string")), F.lit("")).alias("_conv"),
        F.coalesce(F.concat(F.lit("t"), F.col("turn").cast("string")), F.lit("")).alias("_at"),
        F.xxhash64(text_of()).alias("_tie"),
    )


TURN = ["_conv", "_at", "role", "_tie"]


def numbered(turns: DataFrame, settings: Settings, tokens: Column) -> DataFrame:
    """The turns without texts: ``position`` from 0, ``cost``, ``begins`` and ``ends`` in tokens after the system turn.

    Rows carry what holds for their conversation: ``left`` of the budget after the system turn, ``body``, the tokens after it,
    and ``half`` the room for new turns, null if the conversation is one window.
    """
    slim = turns.select("conv_id", *TURN, "_turn", (tokens + settings.marks).cast("bigint").alias("cost"))
    slim = slim.withColumn("_copy", F.monotonically_increasing_id())  # copies of a row spread over slices, too
    order = [F.col(c) for c in ("_turn", "role", "_tie", "_copy")]
    placed = stage(running_totals(slim, order, {"ends": F.col("cost"), "position": F.lit(1).cast("bigint")}, ["_conv"]), "turns")
    placed = placed.withColumn("position", F.col("position") - 1)
    whole = placed.groupBy("_conv").agg(
        F.max("ends").alias("total"),
        F.max(F.when((F.col("position") == 0) & (F.col("role") == settings.system), F.col("cost"))).alias("system"),
    )
    left = F.lit(settings.budget) - F.coalesce("system", F.lit(0))
    room = F.greatest(left - settings.history, F.lit(settings.budget // 8 + 1))
    whole = whole.select(
        "_conv", "system",
        F.when(F.col("total") - F.coalesce("system", F.lit(0)) > F.greatest(left, room), F.greatest(F.floor(room / 2), F.lit(1))).alias("half"),
        (F.col("total") - F.coalesce("system", F.lit(0))).alias("body"),
    )
    ends = F.col("ends") - F.coalesce("system", F.lit(0))
    return placed.join(whole, "_conv").select(
        "conv_id", *TURN, "position", "cost", (ends - F.col("cost")).alias("begins"), ends.alias("ends"), "half", "body", left.alias("left"),
        (F.col("system").isNotNull() & (F.col("position") == 0)).alias("is_system"),
    )


def spans(turns: DataFrame, settings: Settings) -> DataFrame:
    """(keys of a turn, position, span, repeated): which turns each window holds; ``span`` names a window of a conversation."""
    own_span = 2 * F.floor(F.col("begins") / F.col("half")) + F.when(F.col("cost") > F.col("half"), 1).otherwise(0)
    framed = F.col("is_system") & F.col("half").isNotNull()
    own = turns.where(~framed).withColumn("span", F.coalesce(own_span, F.lit(0)).cast("bigint"))
    kept = ["conv_id", *TURN, "position", "cost", "span", "repeated"]
    first = stage(
        own.where("half is not null").groupBy("_conv", "span").agg(
            F.min("begins").alias("from"), F.min("position").alias("first"), F.sum("cost").alias("new")),
        "spans",
    )
    system = turns.where(framed).join(first.withColumnRenamed("span", "_span"), "_conv").withColumns(
        {"span": F.col("_span"), "repeated": F.col("first") > 1})
    if not settings.history:
        return own.withColumn("repeated", F.lit(False)).select(kept).unionByName(system.select(kept))
    # A turn can be history of the long turn that ends its own half, and of windows that begin up to ``history`` tokens later.
    last = F.least(F.floor((F.col("begins") + settings.history) / F.col("half")), F.floor((F.col("body") - 1) / F.col("half")))
    later = F.transform(F.sequence(2 * F.floor(F.col("begins") / F.col("half")), 2 * last + 1), lambda x: x.cast("bigint"))
    history = (
        own.where((F.col("half").isNotNull()) & (F.col("cost") <= settings.history) & (F.col("ends") < F.col("body")))
        .withColumn("span", F.explode(F.array_except(later, F.array("span"))))
        .join(first, ["_conv", "span"])
        .where((F.col("ends") <= F.col("from")) & (F.col("begins") >= F.col("from") - F.least(F.lit(settings.history), F.col("left") - F.col("new"))))
    )
    return (
        own.withColumn("repeated", F.lit(False)).select(kept)
        .unionByName(history.withColumn("repeated", F.lit(True)).select(kept))
        .unionByName(system.select(kept))
    )


def windows(
    conversations: DataFrame, settings: Settings = Settings(), template: Template = Template(), tokens: Column | None = None
) -> DataFrame:
    """(conv_id, first_turn, text, loss, n_repeated, n_tokens, over_budget), a row per window.

    ``conversations`` has conv_id, turn, role and text. ``tokens`` counts the tokens of ``text``, estimated if not given.
    ``first_turn`` is the position of the window's first new turn and orders the windows; ``loss`` holds the learnt stretches
    of ``text`` as code points (begin, end); ``n_repeated`` turns at the start are repeated from earlier windows.
    """
    turns = keyed(conversations)
    placed = stage(numbered(turns, settings, estimated_tokens(F.col("text")) if tokens is None else tokens), "numbered")
    texts = turns.groupBy(*TURN).agg(F.first("text").alias("text"))
    parts = spans(placed, settings).join(texts, TURN)
    framed = F.concat(
        F.lit(template.begin), template.escape_role(F.col("role")), F.lit("\n"), template.escape(F.col("text")),
        F.lit(template.end + template.after),
    )
    tail = len(template.end + template.after)
    window = parts.groupBy("conv_id", "_conv", "span").agg(
        F.sort_array(F.collect_list(F.struct(
            "position", "repeated", "cost", F.col("role").isin(*settings.learnt).alias("learnt"),
            F.length(template.escape(F.col("text"))).alias("length"), framed.alias("framed"),
        ))).alias("turns")
    )
    at = F.aggregate(
        "turns", F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<begin:int,end:int>>").alias("loss")),
        lambda s, t: F.struct(
            (s["at"] + F.length(t["framed"])).alias("at"),
            F.when(t["learnt"] & ~t["repeated"], F.concat(s["loss"], F.array(F.struct(
                (s["at"] + F.length(t["framed"]) - tail - t["length"]).alias("begin"),
                (s["at"] + F.length(t["framed"]) - tail).alias("end"),
            )))).otherwise(s["loss"]).alias("loss"),
        ),
    )
    new = F.filter("turns", lambda t: ~t["repeated"])
    cost = F.aggregate("turns", F.lit(0).cast("bigint"), lambda s, t: s + t["cost"])
    return window.select(
        "conv_id", F.array_min(F.transform(new, lambda t: t["position"])).alias("first_turn"),
        F.array_join(F.transform("turns", lambda t: t["framed"]), "").alias("text"), at["loss"].alias("loss"),
        (F.size("turns") - F.size(new)).alias("n_repeated"), cost.alias("n_tokens"), (cost > settings.budget).alias("over_budget"),
    )


def read(formatted: DataFrame, template: Template = Template()) -> DataFrame:
    """``formatted`` with ``turns``, the (role, text) of every turn read back from ``text``, and ``learnt``, the texts under the mask."""
    def turn(piece: Column) -> Column:
        role = F.substring_index(piece, "\n", 1)
        body = F.substr(piece, F.length(role) + 2, F.length(piece) - F.length(role) - 1 - len(template.end + template.after))
        return F.struct(template.unescape_role(role).alias("role"), template.unescape(body).alias("text"))

    pieces = F.slice(F.split("text", re.escape(template.begin)), 2, F.size(F.split("text", re.escape(template.begin))))
    masked = F.transform("loss", lambda x: template.unescape(F.substr(F.col("text"), x["begin"] + 1, x["end"] - x["begin"])))
    return formatted.select("*", F.transform(pieces, turn).alias("turns"), masked.alias("learnt"))
