"""Chat formatting in budgeted windows.

A conversation's turns, in order, become training windows of at most `budget` tokens; a turn is never cut. Prefix sums
of the turns' tokens choose turn-aligned spans: with room = budget - system turn and stride = room - history, a turn
belongs to the stride in which its first token lies, so at most the last turn of a stride reaches into the next one.
Where the stride's turns exceed the room, that last turn is a span of its own. Every window starts with the system
turn, if the conversation starts with one, and repeats the last turns before its span, of at most `history` tokens and
no more than the budget leaves. So a window exceeds the budget only if one turn, or it and the system turn, do. The
loss mask covers the texts of assistant turns in the span only: repeated turns are masked, so each assistant text is a
target once.

A turn is written `### role: text</turn>` and a line break. Inside roles and texts `\\`, `<`, `#` and, in roles, `:`
are written `\\b`, `\\l`, `\\h`, `\\c`, so no text can hold a mark, and reading them back is exact. A turn's tokens are
a quarter of its code points, rounded up.

Everything is DataFrame functions, linear in the turns. windows() takes sums over a conversation's ordered rows, which
Spark sorts and spills, and gathers no more than a window and the history before a turn in one row; a conversation of
any length is one sorted partition. read_back() has a digest over all of a conversation's text, so it holds that text.

Defined cases: null texts and roles count as empty; all rows of a null conv_id are one conversation; turns of one number
are ordered by role and text, and repeated rows are turns of their own; an empty table gives an empty result; other
columns are never read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUDGET, HISTORY = 512, 128
CLOSE = "</turn>\n"


def escaped(text: Column, role: bool = False) -> Column:
    for plain, code in (("\\", "\\b"), ("<", "\\l"), ("#", "\\h"), *[(":", "\\c")] * role):
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescaped(text: Column) -> Column:
    for plain, code in ((":", "\\c"), ("#", "\\h"), ("<", "\\l"), ("\\", "\\b")):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def windows(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """conv_id, window, text, n_context (turns repeated at its start), n_new, loss (spans of code points in text)."""
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.select("conv_id", "turn", "role", "text", F.concat(F.lit("### "), escaped(F.col("role"), True), F.lit(": ")).alias("head"), escaped(F.col("text")).alias("body"))
    rows = rows.withColumn("whole", F.concat("head", "body", F.lit(CLOSE))).withColumn("tokens", F.ceil(F.length("whole") / 4))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = rows.withColumn("place", F.row_number().over(order)).withColumn("first", F.first(F.struct("role", "tokens")).over(order))
    rows = rows.withColumn("upto", F.sum("tokens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    kept = F.when(F.col("first.role") == "system", F.col("first.tokens")).otherwise(0)
    rows = rows.select("conv_id", "place", "role", "tokens", kept.alias("kept"), (F.col("upto") - F.col("tokens")).alias("at"), F.length("head").alias("head"), F.length("body").alias("body"), "whole")

    # Spans are named by the place of their first turn. A system turn has part in the first span only.
    room = F.greatest(F.lit(1), F.lit(budget) - F.col("kept"))
    stride = F.greatest(F.lit(1), room - history)
    rows = rows.withColumn("stride", F.when(F.col("at") < F.col("kept"), F.lit(0)).otherwise(F.floor((F.col("at") - F.col("kept")) / stride)))
    own = Window.partitionBy("conv_id", "stride")
    used = F.sum(F.when(F.col("at") >= F.col("kept"), F.col("tokens")).otherwise(0)).over(own)
    rows = rows.withColumn("alone", (used > room) & (F.col("place") == F.max("place").over(own)))
    by_place = Window.partitionBy("conv_id").orderBy("at")
    changed = F.coalesce(F.lag("stride").over(by_place), F.lit(-1)) != F.col("stride")
    rows = rows.withColumn("opens", changed | (F.col("alone") & (F.col("place") > 1 + (F.col("kept") > 0).cast("int"))))
    upto = by_place.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("window", F.sum(F.col("opens").cast("int")).over(upto) - 1)

    # What may be repeated before a turn: those that start at most `history` tokens before it.
    turn = F.struct("at", "whole")
    past = F.collect_list(turn).over(by_place.rangeBetween(-history, -1))
    system = F.first(F.when(F.col("kept") > 0, F.col("whole"))).over(upto)
    rows = rows.withColumn("past", F.filter(past, lambda x: x["at"] >= F.col("kept"))).withColumn("system", F.when(F.col("place") > 1, system))
    rows = rows.withColumn("past", F.when(F.col("opens"), F.col("past"))).withColumn("system", F.when(F.col("opens"), F.col("system")))

    new = F.struct("place", "whole", (F.col("role") == "assistant").alias("target"), "head", "body")
    spans = rows.groupBy("conv_id", "window").agg(F.array_sort(F.collect_list(new)).alias("t"), F.min("at").alias("at"), F.sum("tokens").alias("used"), F.max("kept").alias("kept"), F.first("past", True).alias("past"), F.first("system", True).alias("system"))
    left = F.least(F.lit(history), F.lit(budget) - F.col("used") - F.when(F.col("at") >= F.col("kept"), F.col("kept")).otherwise(0))
    spans = spans.withColumn("from", F.col("at") - left).withColumn("context", F.concat(F.expr("if(system is null, array(), array(system))"), F.expr("transform(array_sort(filter(past, x -> x.at >= from)), x -> x.whole)")))
    # A window has few turns, so its fold over them is short.
    loss = """aggregate(t, named_struct('at', aggregate(context, 0, (n, x) -> n + length(x)), 'spans', cast(array() as array<struct<start: int, end: int>>)),
        (a, x) -> named_struct('at', a.at + length(x.whole), 'spans', if(x.target, concat(a.spans, array(named_struct('start', a.at + x.head, 'end', a.at + x.head + x.body))), a.spans)),
        a -> a.spans)"""
    text = F.array_join(F.concat("context", F.transform("t", lambda x: x["whole"])), "")
    return spans.select("conv_id", "window", text.alias("text"), F.size("context").alias("n_context"), F.size("t").alias("n_new"), F.expr(loss).alias("loss"))


def read_back(formatted: DataFrame) -> DataFrame:
    """Per conversation, from its windows alone: n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    pieces = F.split("text", CLOSE, -1)
    turns = F.slice(pieces, F.col("n_context") + 1, F.size(pieces) - 1 - F.col("n_context"))
    mark = F.lit(": ")

    def turn(p: Column) -> Column:
        at = F.instr(p, ": ")
        return F.concat(unescaped(F.substring(p, F.lit(5), at - 5)), F.lit("\n"), unescaped(F.substring(p, at + F.length(mark), F.length(p))), F.lit("\n"))

    said = F.array_join(F.transform(turns, turn), "")
    target = F.array_join(F.transform("loss", lambda s: unescaped(F.substring(F.col("text"), s["start"] + 1, s["end"] - s["start"]))), "")
    rows = formatted.select("conv_id", F.struct("window", said.alias("said"), target.alias("target")).alias("w"), F.size(turns).alias("n"), F.length("text").alias("chars"))
    talks = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("w")).alias("w"), F.sum("n").alias("n_turns"), F.sum("chars").alias("formatted_chars"))
    targets = F.array_join(F.transform("w", lambda x: x["target"]), "")
    return talks.select("conv_id", "n_turns", F.sha2(F.array_join(F.transform("w", lambda x: x["said"]), ""), 256).alias("turns_sha256"), F.length(targets).cast("long").alias("loss_chars"), F.sha2(targets, 256).alias("loss_sha256"), "formatted_chars")
