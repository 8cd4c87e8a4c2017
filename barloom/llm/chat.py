"""Chat formatting from a declarative template: DataFrame functions only.

A finite-state machine over roles validates the turn order. The output is the formatted text and its segments, each
with a loss flag. Control strings inside texts are escaped so that they can't be taken for the template's own.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """Marks, the roles under the loss, and the moves of the state machine. Marks begin with `<|`; no text can hold that once escaped."""

    open: str = "<|im_start|>"
    close: str = "<|im_end|>\n"
    after_role: str = "\n"
    role_newline: str = "<|nl|>"
    loss_roles: tuple[str, ...] = ("assistant",)
    start: str = "start"
    moves: Mapping[tuple[str, str], str] = field(
        default_factory=lambda: {("start", "system"): "system", ("start", "user"): "user", ("system", "user"): "user", ("user", "assistant"): "assistant", ("assistant", "user"): "user"}
    )
    final: tuple[str, ...] = ("assistant",)


CHATML = Template()


def escape(text: Column) -> Column:
    """`<`, any backslashes, `|` gets one more backslash: `<|` no longer occurs, and each step can be undone."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\\\|", "<$1|")


def role_out(role: Column, t: Template) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit(t.role_newline))


def role_in(role: Column, t: Template) -> Column:
    return unescape(F.replace(role, F.lit(t.role_newline), F.lit("\n")))


def machine(turns: Column, t: Template) -> Column:
    """The state after the turns; `reject` once a move isn't allowed."""
    moves = F.create_map(*(F.lit(x) for (state, role), to in t.moves.items() for x in (f"{state}\n{role}", to)))
    step = lambda state, x: F.coalesce(F.try_element_at(moves, F.concat(state, F.lit("\n"), x["role"])), F.lit("reject"))
    return F.aggregate(turns, F.lit(t.start), step)


def format_chats(rows: DataFrame, t: Template = CHATML, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, n_turns, state, valid, segments array<struct<text, loss>>, formatted): one row for each conversation.

    Turns are ordered by turn, then role and text, so ties have one result; repeated rows are turns of their own. NULL
    roles and texts count as empty. Rows with a NULL conv_id form one conversation. Conversations that the machine
    rejects, or that end in no final state, are formatted too and marked as not valid. One shuffle on conv_id; each
    conversation becomes one string, so it must fit in a task, whatever the number of conversations.
    """
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    flat = rows.select(F.col(conv_id).alias("_conv_"), F.struct(F.col(turn).alias("turn"), blank(role).alias("role"), blank(text).alias("text")).alias("_turn_"))
    chats = flat.groupBy("_conv_").agg(F.array_sort(F.collect_list("_turn_")).alias("_turns_"))
    piece = lambda x, loss: F.struct(x.alias("text"), loss.alias("loss"))
    no, loss = F.lit(False), F.lit(list(t.loss_roles))
    segments = F.flatten(F.transform("_turns_", lambda x: F.array(piece(F.concat(F.lit(t.open), role_out(x["role"], t), F.lit(t.after_role)), no), piece(escape(x["text"]), F.array_contains(loss, x["role"])), piece(F.lit(t.close), no))))
    out = chats.select(F.col("_conv_").alias(conv_id), F.size("_turns_").cast("long").alias("n_turns"), machine(F.col("_turns_"), t).alias("state"), segments.alias("segments"))
    return out.withColumn("valid", F.col("state").isin(list(t.final))).withColumn("formatted", F.array_join(F.transform("segments", lambda s: s["text"]), ""))


def read_turns(formatted: Column, t: Template = CHATML) -> Column:
    """array<struct<role, text>> read back from a formatted text."""
    pieces = F.filter(F.split(formatted, rf"\Q{t.open}\E", -1), lambda _, i: i > 0)
    at = lambda p: F.instr(p, t.after_role)  # noqa: E731  the first: roles hold no newline
    rest = lambda p: F.substring(p, at(p) + len(t.after_role), F.length(p) - at(p) + 1 - len(t.after_role) - len(t.close))
    return F.transform(pieces, lambda p: F.struct(role_in(F.substring(p, F.lit(1), at(p) - 1), t).alias("role"), unescape(rest(p)).alias("text")))


def read_loss(segments: Column) -> Column:
    """The text under the loss mask, unescaped, nothing between."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"])), "")
