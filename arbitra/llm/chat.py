"""Chat formatting with Spark expressions only, reversible, with a loss mask.

A conversation's turns are collected as structs and sorted; adjacent turns of one role become one
message; messages are concatenated:

    <|im_start|>ROLE\\nTEXT<|im_next|>TEXT<|im_end|>\\n

Inside texts and roles every ``<|`` is written ``<||``, so a mark can't occur in them and the
original comes back by writing ``<|`` for ``<||``.  A line break in a role is ``<|im_line|>``.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, NEXT, END, LINE = "<|im_start|>", "<|im_next|>", "<|im_end|>\n", "<|im_line|>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, also if the body uses it inside lambdas."""
    return F.transform(F.array(value), body)[0]


def escaped(text: Column) -> Column:
    return F.replace(text, F.lit("<|"), F.lit("<||"))


def unescaped(text: Column) -> Column:
    return F.replace(text, F.lit("<||"), F.lit("<|"))


def _role_mark(role: Column) -> Column:
    return F.concat(F.lit(START), F.replace(escaped(role), F.lit("\n"), F.lit(LINE)), F.lit("\n"))


def _literal(mark: str) -> str:
    return "\\Q" + mark + "\\E"


def messages(turns: Column) -> Column:
    """Array of messages (role, texts) from sorted turns: adjacent turns of one role merged."""

    def merge(t: Column) -> Column:
        n = F.size(t)
        changes = F.filter(
            F.sequence(F.lit(1), n),
            lambda i: (i == 1) | (F.get(t, i - 1)["role"] != F.get(t, i - 2)["role"]),
        )
        return let(changes, lambda starts: F.transform(
            starts,
            lambda s, k: F.struct(
                F.get(t, s - 1)["role"].alias("role"),
                F.slice(t["text"], s, F.coalesce(F.get(starts, k + 1), n + 1) - s).alias("texts"),
            ),
        ))

    return let(turns, merge)


def _joined(message: Column) -> Column:
    return F.concat(
        _role_mark(message["role"]), F.array_join(F.transform(message["texts"], escaped), NEXT), F.lit(END)
    )


def _spans(message: Column, loss_roles: Sequence[str]) -> Column:
    """(skip, take) for every text of a message; take is 0 outside the loss roles."""
    learned = message["role"].isin(*loss_roles)

    def span(text: Column, i: Column) -> Column:
        n = F.length(escaped(text))
        lead = F.when(i == 0, F.length(_role_mark(message["role"]))).otherwise(len(NEXT))
        tail = F.when(i == F.size(message["texts"]) - 1, len(END)).otherwise(0)
        return F.struct(
            lead.cast("long").alias("lead"),
            F.when(learned, n).otherwise(0).cast("long").alias("take"),
            (tail + F.when(learned, 0).otherwise(n)).cast("long").alias("tail"),
        )

    return F.transform(message["texts"], span)


def loss_spans(formatted_messages: Column, loss_roles: Sequence[str]) -> Column:
    """Array of (start, length), in code points from 0, of what the loss is taken over."""
    runs = F.flatten(F.transform(formatted_messages, lambda m: _spans(m, loss_roles)))
    span = F.struct(F.lit(0).cast("long").alias("start"), F.lit(0).cast("long").alias("length"))
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.filter(F.array(span), lambda x: F.lit(False)).alias("spans"))

    def add(acc: Column, run: Column) -> Column:
        start = acc["at"] + run["lead"]
        found = F.array(F.struct(start.alias("start"), run["take"].alias("length")))
        return F.struct(
            (start + run["take"] + run["tail"]).alias("at"),
            F.when(run["take"] > 0, F.concat(acc["spans"], found)).otherwise(acc["spans"]).alias("spans"),
        )

    return F.aggregate(runs, zero, add, lambda acc: acc["spans"])


def format_conversations(
    rows: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    loss_roles: Sequence[str] = ("assistant",),
) -> DataFrame:
    """One row per conversation: conv_id, formatted, loss_spans.

    Turns are in order of turn, role and text, nulls first; a null role or text is empty; repeated
    rows are turns of their own.  Rows with a null conv_id form one conversation.  Other columns
    are ignored.  An empty table gives no rows.  A conversation becomes one string, so it must fit
    in one row (2 GB); conversations are spread by their id.
    """
    turn = F.struct(
        F.col(turn_col).alias("turn"),
        F.coalesce(F.col(role_col), F.lit("")).alias("role"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    turns = (
        rows.select(F.col(conv_col).alias("conv_id"), turn.alias("t"))
        .groupBy("conv_id")
        .agg(F.array_sort(F.collect_list("t")).alias("turns"))
    )
    return turns.select("conv_id", messages(F.col("turns")).alias("messages")).select(
        "conv_id",
        F.array_join(F.transform("messages", _joined), "").alias("formatted"),
        loss_spans(F.col("messages"), loss_roles).alias("loss_spans"),
    )


def read_turns(formatted: Column) -> Column:
    """Array of (role, text) of the turns that a formatted conversation was made of."""

    def turns(message: Column) -> Column:
        head = F.substring_index(message, "\n", 1)
        role = unescaped(F.replace(F.substr(head, F.lit(len(START) + 1)), F.lit(LINE), F.lit("\n")))
        texts = F.split(F.substr(message, F.length(head) + 2), _literal(NEXT), -1)
        return let(role, lambda r: F.transform(texts, lambda t: F.struct(r.alias("role"), unescaped(t).alias("text"))))

    pieces = F.split(formatted, _literal(END), -1)
    return F.flatten(F.transform(F.filter(pieces, lambda p: p != ""), turns))


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    taken = F.transform(spans, lambda s: unescaped(F.substr(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int"))))
    return F.array_join(taken, "")
