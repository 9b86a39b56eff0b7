"""Chat formatting in budgeted windows, JVM side only.

Prefix sums of turn tokens cut a conversation into turn-aligned spans of at most `span` tokens, the
system turn included, which every window repeats. With half of what the system turn leaves as the unit,
a turn longer than a unit is a span of its own and the others that start in the same unit between two
such turns are one span: it holds less than two units. So only a single turn that is too long by itself (or
a system turn that leaves no room) exceeds the budget; such windows say so in `over_budget`. Each window
repeats the last turns of the span before it that fit in `history` tokens; only its own assistant texts
are under the loss mask, so repeated targets are masked and every assistant text is a target once.

Tokens are those of the column `tokens` (of a turn as it is formatted), if one is named; else a turn
counts a token for each four code points of its formatted text, rounded up.

Template: `<turn ROLE>TEXT</turn>` and a line feed. In roles and texts `\\`, `<` and `>` become
`\\b`, `\\l` and `\\g`, so no text can hold a control string and unescaping gives it back exactly.

A window row is bounded by the budgets and its longest turn; no row holds a whole conversation (only
`read_back`, whose digests are of whole conversations, puts one together). A conversation with a
large share of the rows is one key of a window function, which sorts with spill and streams.

Defined cases: null text and null role are empty; a null id is a conversation of its own; a null or
negative token count is 0; turns are ordered by turn (nulls first), then role, then text, so ties and
repeated rows have one order and are all kept; very long texts are kept whole, a turn is never cut; an
empty table gives no windows; other input columns aren't read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm._common import whole


def escape(x: Column) -> Column:
    for a, b in (("\\", "\\b"), ("<", "\\l"), (">", "\\g")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


def unescape(x: Column) -> Column:
    for a, b in (("<", "\\l"), (">", "\\g"), ("\\", "\\b")):
        x = F.replace(x, F.lit(b), F.lit(a))
    return x


def format_chat(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", span: int = 512, history: int = 128, tokens: str | None = None) -> DataFrame:
    """One row per window: conv, window (0, 1, …), formatted text, n_tokens (at most span + history unless
    over_budget), over_budget, new_from (code points of repeated turns before the first new one) and
    loss_spans (start, length in code points)."""
    if span < 1 or history < 0:
        raise ValueError("span must be positive and history not negative")
    given = F.greatest(F.coalesce(F.col(f"`{tokens}`").cast("long"), F.lit(0)), F.lit(0)) if tokens else F.lit(None)
    t = turns.select(F.col(f"`{conv}`").alias("_c"), F.col(f"`{turn}`").alias("_n"), whole(F.col(f"`{role}`")).alias("_r"), whole(F.col(f"`{text}`")).alias("_x"), given.cast("long").alias("_given"))
    head = F.concat(F.lit("<turn "), escape(F.col("_r")), F.lit(">"))
    t = t.select("_c", "_n", "_r", "_x", "_given", F.char_length(head).alias("_h"), F.concat(head, escape(F.col("_x")), F.lit("</turn>\n")).alias("_s"))
    t = t.withColumns({"_len": F.char_length("_s").cast("long"), "_all": F.coalesce("_given", F.ceil(F.char_length("_s") / 4).cast("long"))})
    order = Window.partitionBy("_c").orderBy(F.col("_n").asc_nulls_first(), "_r", "_x")
    running = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    t = t.withColumn("_pos", F.row_number().over(order))
    t = t.withColumn("_sys", (F.col("_pos") == 1) & (F.col("_r") == "system"))
    t = t.withColumns({"_cost": F.when(F.col("_sys"), 0).otherwise(F.col("_all")), "_head": F.first(F.when(F.col("_sys"), F.col("_all")).otherwise(0)).over(running)})
    t = t.withColumn("_unit", F.greatest((span - F.col("_head")) / 2, F.lit(0.5)))
    t = t.withColumn("_big", (F.col("_cost") > F.col("_unit")).cast("int"))
    t = t.withColumns({"_from": F.sum("_cost").over(running) - F.col("_cost"), "_at": F.sum("_len").over(running) - F.col("_len"), "_bigs": F.sum("_big").over(running)})
    t = t.withColumn("_w", F.struct(F.col("_bigs") * 2 - F.col("_big"), F.when(F.col("_big") == 1, 0).otherwise(F.floor(F.col("_from") / F.col("_unit")))))
    item = F.struct(*[F.col(c).alias(c[1:]) for c in ("_pos", "_r", "_h", "_s", "_len", "_cost", "_from", "_at", "_sys")])
    g = t.groupBy("_c", "_w").agg(F.sort_array(F.collect_list(item)).alias("own"), F.max(F.when(F.col("_sys"), F.col("_s"))).alias("sys"), F.max(F.col("_from") + F.col("_cost")).alias("end"), F.min("_from").alias("start"), F.max("_head").alias("head"))
    carry = F.filter("own", lambda x: ~x["sys"] & (F.col("end") - x["from"] <= history))
    by = Window.partitionBy("_c").orderBy("_w")
    g = g.withColumns({"carry": F.transform(carry, lambda x: x["s"]), "more": F.aggregate(carry, F.lit(0).cast("long"), lambda n, x: n + x["cost"])})
    g = g.withColumns({"k": F.row_number().over(by) - 1, "old": F.coalesce(F.lag("carry").over(by), F.array().cast("array<string>")), "again": F.coalesce(F.lag("more").over(by), F.lit(0)), "sys": F.first("sys", ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow))})
    repeated = F.concat(F.when(F.col("k") > 0, F.coalesce("sys", F.lit(""))).otherwise(F.lit("")), F.array_join("old", ""))
    g = g.withColumn("rep", repeated).withColumn("new_from", F.char_length("rep"))
    first = F.get(F.col("own"), 0)["at"]
    spans = F.transform(F.filter("own", lambda x: x["r"] == "assistant"), lambda x: F.struct((F.col("new_from") + x["at"] - first + x["h"]).cast("int").alias("start"), (x["len"] - x["h"] - len("</turn>\n")).cast("int").alias("length")))
    formatted = F.concat("rep", F.array_join(F.transform("own", lambda x: x["s"]), ""))
    used = F.col("head") + F.col("end") - F.col("start")
    return g.select(F.col("_c").alias(conv), F.col("k").cast("int").alias("window"), formatted.alias("text"), (used + F.col("again")).cast("int").alias("n_tokens"), (used > span).alias("over_budget"), "new_from", spans.alias("loss_spans"))


def read_back(windows: DataFrame, conv: str = "conv_id") -> DataFrame:
    """Parses formatted windows: per conversation its turns (role, text), each once, and its loss text."""
    new = F.expr("substring(text, new_from + 1)")
    parts = F.filter(F.split(new, "</turn>\n"), lambda x: x != "")
    turn = F.transform(parts, lambda x: F.struct(unescape(F.substr(x, F.lit(7), F.instr(x, ">") - 7)).alias("role"), unescape(F.substr(x, F.instr(x, ">") + 1)).alias("text")))
    loss = F.transform("loss_spans", lambda s: unescape(F.substr(F.col("text"), s["start"] + 1, s["length"])))
    w = windows.select(F.col(f"`{conv}`").alias("_c"), "window", turn.alias("turns"), F.array_join(loss, "").alias("loss"), F.char_length("text").cast("long").alias("chars"))
    g = w.groupBy("_c").agg(F.sort_array(F.collect_list(F.struct("window", "turns", "loss"))).alias("ws"), F.sum("chars").alias("formatted_chars"))
    return g.select(F.col("_c").alias(conv), F.flatten(F.transform("ws", lambda x: x["turns"])).alias("turns"), F.array_join(F.transform("ws", lambda x: x["loss"]), "").alias("loss_text"), "formatted_chars")
