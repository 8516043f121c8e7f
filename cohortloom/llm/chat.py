"""Chat formatting from event logs.

A log holds events of conversations: `message` begins a turn, `delta` appends to
it, `edit` replaces what it says so far, `regenerate` begins it anew. Events are
applied by sequence number. The final messages of a conversation, by turn, are
rendered with a template:

    user       [INST] text [/INST]
    assistant  text</s>
    others     <<role>>text<</role>>

In texts and roles every backslash, `<`, `[` and `>` gets a backslash in front,
so no text can hold a mark of the template, and `parse` gives every text back.

Events fold within a turn before turns meet in their conversation, so a long
conversation is worked on by many tasks until its one formatted row is put
together.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KINDS = ("message", "regenerate", "edit", "delta")
_ESCAPED = r"([\\<>\[])"
_PIECE = r"(?:[^\\<>\[]|\\.)*"
_TURN = re.compile(
    rf"\[INST\] (?P<user>{_PIECE}) \[/INST\]"
    rf"|<<(?P<role>{_PIECE})>>(?P<other>{_PIECE})<</(?P=role)>>"
    rf"|(?P<assistant>{_PIECE})</s>",
    re.DOTALL,
)


def escape(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPED, r"\\$1")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


def parse(formatted: str) -> Iterator[tuple[str, str, tuple[int, int]]]:
    """(role, text, span of the escaped text) of every turn; raises if the string is no rendering."""
    at = 0
    while at < len(formatted):
        found = _TURN.match(formatted, at)
        if found is None:
            raise ValueError(f"no turn at {at}")
        group = found.lastgroup if found.lastgroup != "role" else "other"
        if found["other"] is not None:
            role, group = unescape(found["role"]), "other"
        else:
            role = group = "user" if found["user"] is not None else "assistant"
        yield role, unescape(found[group]), found.span(group)
        at = found.end()


def fold_events(events: DataFrame) -> DataFrame:
    """Final messages (conv_id, turn, role, text) of a log (conv_id, turn, seq, kind, role, text).

    An event delivered twice counts once. Events with equal sequence numbers
    apply in the order message, regenerate, edit, delta, then by text. Unknown
    kinds and events without a sequence number or turn are left out. NULL texts
    are empty; the role is that of the last event that names one. Deltas before
    any other event of a turn are applied to an empty text. NULL is a
    conversation of its own.
    """
    rank = F.array_position(F.array(*(F.lit(k) for k in KINDS)), F.col("kind"))
    log = events.select(
        "conv_id",
        "turn",
        F.struct(
            F.col("seq").alias("seq"), rank.alias("rank"), F.coalesce("text", F.lit("")).alias("text")
        ).alias("at"),
        "role",
        (F.col("kind") != "delta").alias("fresh"),
    )
    log = log.filter("at.rank > 0 AND at.seq IS NOT NULL AND turn IS NOT NULL").distinct()
    # What an edit or a new version replaces is dropped before texts are gathered.
    since = log.groupBy("conv_id", "turn").agg(
        F.max(F.when(F.col("fresh"), F.struct("at.seq", "at.rank", "at.text"))).alias("since"),
        F.max_by("role", F.when(F.col("role").isNotNull(), F.col("at"))).alias("role"),
    )
    same = F.col("l.conv_id").eqNullSafe(F.col("s.conv_id")) & (F.col("l.turn") == F.col("s.turn"))
    left = log.alias("l").join(since.alias("s"), same)
    left = left.filter(F.col("since").isNull() | (F.col("l.at") >= F.col("since")))
    texts = F.transform(F.sort_array(F.collect_list("l.at")), lambda e: e["text"])
    return left.groupBy(F.col("l.conv_id").alias("conv_id"), F.col("l.turn").alias("turn")).agg(
        F.first("s.role").alias("role"), F.array_join(texts, "").alias("text")
    )


def render(messages: DataFrame) -> DataFrame:
    """conv_id, n_turns, formatted, loss: one row per conversation, its turns in order.

    `loss` lists the spans (start, end, in code points) of the escaped texts of
    assistant turns. NULL roles and texts are empty; equal turns are ordered by
    role and text. An empty table gives no row.
    """
    role = F.coalesce("role", F.lit(""))
    text = F.coalesce("text", F.lit(""))
    turns = messages.select("conv_id", "turn", role.alias("role"), text.alias("text"))
    marked = turns.withColumn("shown", escape(F.col("text")))
    user, assistant = F.col("role") == "user", F.col("role") == "assistant"
    other = escape(F.col("role"))
    marked = marked.withColumn(
        "piece",
        F.when(user, F.concat(F.lit("[INST] "), "shown", F.lit(" [/INST]")))
        .when(assistant, F.concat("shown", F.lit("</s>")))
        .otherwise(F.concat(F.lit("<<"), other, F.lit(">>"), "shown", F.lit("<</"), other, F.lit(">>"))),
    )
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    placed = marked.select(
        "conv_id",
        F.row_number().over(order).alias("place"),
        F.coalesce(F.sum(F.length("piece").cast("long")).over(before), F.lit(0)).alias("begin"),
        F.when(assistant, F.length("shown")).alias("n_loss"),
        "piece",
    )
    loss = F.when(
        F.col("n_loss").isNotNull(),
        F.struct(F.col("begin").alias("start"), (F.col("begin") + F.col("n_loss")).alias("end")),
    )
    return placed.groupBy("conv_id").agg(
        F.count("*").alias("n_turns"),
        F.array_join(
            F.transform(F.sort_array(F.collect_list(F.struct("place", "piece"))), lambda p: p["piece"]), ""
        ).alias("formatted"),
        F.sort_array(F.collect_list(loss)).alias("loss"),
    )


def format_log(events: DataFrame) -> DataFrame:
    """Fold a log and render its conversations."""
    return render(fold_events(events))
