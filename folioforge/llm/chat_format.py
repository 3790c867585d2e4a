"""Chat formatting: budgeted, turn-aligned windows of conversations with a loss mask, in DataFrame functions only.

A turn is written as ``<|turn|>role\\ntext<|end|>\\n``. In roles and texts ``&``, ``<`` and ``[`` become
``&amp;``, ``&lt;`` and ``&lbr;``, so that no control string (of this template or of any that is built with angle
or square brackets) can be spoken; unescaping restores the text exactly.

Windows: prefix sums of the turns' tokens cut a conversation, always between turns, so that each window's new
turns fit the budget left beside the system turn and the history; a turn larger than that has a window alone. A
window starts with the system turn, if the conversation's first turn is one, then repeats the last turns of the
history within ``history_tokens``, then holds its new turns. The loss mask marks the text of the new assistant
turns; repeated ones are masked, so that each assistant text is a target exactly once.

Edge cases: null roles and texts are empty; a turn number that occurs again is ordered by role and text; a
conversation of one turn has one window; an empty table gives none. Rows with a null conversation form one
conversation. Memory: one conversation's turns are one row, as its windows and digest need them together; whoever
has conversations of unbounded length cuts them beforehand. Windows themselves are bounded by the budget.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

TURN, END = "<|turn|>", "<|end|>"
#: In this order; unescaping goes backwards.
ESCAPES = (("&", "&amp;"), ("<", "&lt;"), ("[", "&lbr;"))
NEWLINE = ("\n", "&nl;")  # in roles besides


def escape(c: Column) -> Column:
    for a, b in ESCAPES:
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def unescape(c: Column) -> Column:
    for a, b in reversed(ESCAPES):
        c = F.replace(c, F.lit(b), F.lit(a))
    return c


def format_chats(turns: DataFrame, *, budget: int = 512, history_tokens: int = 96, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", chars_per_token: int = 4, overhead: int = 4) -> DataFrame:
    """(conv_id, window, n_context, n_turns, formatted, loss array<struct<start, length>>) of each window.

    A turn's tokens are estimated as its code points over ``chars_per_token`` plus ``overhead``. ``n_context`` counts
    the repeated leading turns, ``n_turns`` all turns of the window; loss spans count code points from 0.
    """
    t = turns.select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    t = t.withColumn("tokens", F.ceil(F.length("text") / chars_per_token) + overhead)
    t = t.select(
        "conv_id",
        F.struct(
            (F.row_number().over(order) - 1).alias("i"),
            F.sum("tokens").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("sum"),  # with this turn
            "tokens",
            (F.col("role") == "assistant").alias("target"),
            (F.col("role") == "system").alias("system"),
            F.concat(F.lit(TURN), F.replace(escape(F.col("role")), F.lit(NEWLINE[0]), F.lit(NEWLINE[1])), F.lit("\n")).alias("head"),
            escape(F.col("text")).alias("body"),
        ).alias("t"),
    )
    c = t.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    c = c.withColumn("s", F.expr("if(t[0].system, 1, 0)"))
    c = c.withColumns({"room": F.expr(f"{int(budget)} - {int(history_tokens)} - if(s = 1, t[0].tokens, 0)"), "n": F.size("t")})
    # where windows start: each cut is the first turn whose prefix sum leaves the room that the last cut opened
    c = c.withColumn(
        "cuts",
        F.expr(
            """aggregate(t, struct(array(0) as cuts, if(s = 1, t[0].tokens, 0L) as base),
                 (a, x) -> if(x.i > s and x.sum - a.base > room, struct(concat(a.cuts, array(x.i)) as cuts, x.sum - x.tokens as base), a),
                 a -> a.cuts)"""
        ),
    )
    most = max(1, history_tokens // max(1, overhead)) + 1  # turns of the history at most
    before = "(x.sum - x.tokens)"
    c = c.withColumn(
        "w",
        F.expr(
            f"""transform(cuts, (f, k) -> struct(k as window, f as new_from, coalesce(get(cuts, k + 1), n) as new_to,
                  if(k = 0, 0, size(filter(slice(t, greatest(s, f - {most}) + 1, least(f - s, {most})), x -> t[f].sum - t[f].tokens - {before} <= {int(history_tokens)}))) as repeated))"""
        ),
    )
    c = c.withColumn(
        "w",
        F.expr(
            """transform(w, x -> struct(x.window as window, if(x.window = 0, 0, s + x.repeated) as n_context,
                 concat(if(x.window = 0, slice(t, 1, 0), slice(t, 1, s)), slice(t, x.new_from - x.repeated + 1, x.repeated + x.new_to - x.new_from)) as turns))"""
        ),
    )
    w = c.select("conv_id", F.explode("w").alias("w")).select("conv_id", "w.*")
    w = w.withColumn("formatted", F.expr(f"array_join(transform(turns, x -> concat(x.head, x.body, '{END}\\n')), '')"))
    w = w.withColumn(
        "loss",
        F.expr(
            f"""aggregate(turns, struct(0L as at, 0 as k, cast(array() as array<struct<start: bigint, length: bigint>>) as spans),
                  (a, x) -> struct(a.at + length(x.head) + length(x.body) + {len(END) + 1} as at, a.k + 1 as k,
                    if(x.target and a.k >= n_context, concat(a.spans, array(struct(a.at + length(x.head) as start, cast(length(x.body) as bigint) as length))), a.spans) as spans),
                  a -> a.spans)"""
        ),
    )
    return w.select("conv_id", "window", "n_context", F.size("turns").alias("n_turns"), "formatted", "loss")


def read_chats(windows: DataFrame) -> DataFrame:
    """(conv_id, turns array<struct<role, text>>, losses array<string>, formatted_chars), parsed from the formatted text.

    Repeated turns are left out, escapes undone; losses are the texts under the mask.
    """
    w = windows.withColumn("parts", F.expr(f"slice(split(formatted, '<\\\\|turn\\\\|>'), n_context + 2, n_turns)"))
    w = w.withColumn("raw", F.expr(f"transform(parts, x -> struct(substring_index(x, '\\n', 1) as role, substring(x, length(substring_index(x, '\\n', 1)) + 2, length(x) - length(substring_index(x, '\\n', 1)) - {len(END) + 2}) as text))"))
    turns = F.transform("raw", lambda x: F.struct(unescape(F.replace(x["role"], F.lit(NEWLINE[1]), F.lit(NEWLINE[0]))).alias("role"), unescape(x["text"]).alias("text")))
    losses = F.transform("loss", lambda x: unescape(F.substring(F.col("formatted"), (x["start"] + 1).cast("int"), x["length"].cast("int"))))
    w = w.select("conv_id", F.length("formatted").alias("chars"), F.struct("window", turns.alias("turns"), losses.alias("losses")).alias("w"))
    c = w.groupBy("conv_id").agg(F.sort_array(F.collect_list("w")).alias("w"), F.sum("chars").alias("formatted_chars"))
    return c.select("conv_id", F.flatten("w.turns").alias("turns"), F.flatten("w.losses").alias("losses"), "formatted_chars")
