"""Chat formatting in budgeted windows, with DataFrame functions only.

A window is the conversation's system turn (its first turn with that role), up to ``HISTORY`` turns just before a span,
then the span.  Spans are aligned with turns and chosen from prefix sums of turn tokens.  What the budget leaves beside
the system turn is the room, and three quarters of it are a span's capacity; the rest is for history.  The prefix sums
cut a conversation into blocks of that capacity.  Turns inside a block are one span; a turn that crosses into a block
leads the block's span if both fit the capacity, else it is a span of its own.  History is repeated, nearest turn first, as
far as it fits.  So no window passes the budget, unless one turn and the system turn do alone.  (A system turn that fills
the budget by itself is still repeated, and spans are then cut as if there were none.)

Repeated turns carry no loss; an assistant turn has loss in the window of its own span only.  A turn has one token for each
word, and one for its marks.

A turn is written ``<|turn|>role:n<|text|>text<|end|>``, where n is the turn's place in the conversation and ``*`` follows
n where loss applies.  Inside roles and texts ``&`` becomes ``&amp;`` and ``<|`` becomes ``&lt;|``; the usual control strings
of other templates (``[INST]``, ``[/INST]``, ``<s>``, ``</s>``, ``<<SYS>>``, ``<</SYS>>``) lose their first character to a
reference as well (``&lb;`` or ``&lt;``).  Reading undoes it in the opposite order, so texts come back whole.

All turns of one conversation meet in one task, since prefix sums and digests are of whole conversations; a window itself is
bounded by the budget.

Defined results: null text and null role are empty; null turns come first; turns of equal number are ordered by role,
then text; repeated rows are turns of their own; a null conversation id is a conversation; an empty table gives only
what is added; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm import common

BUDGET, HISTORY = 512, 2
#: Part of the room that a span may fill.
SHARE = 0.75
#: Control strings and what they become.
CONTROL = [("&", "&amp;"), ("<|", "&lt;|"), ("[INST]", "&lb;INST]"), ("[/INST]", "&lb;/INST]"), ("</s>", "&lt;/s>"), ("<s>", "&lt;s>"),
           ("<<SYS>>", "&lt;<SYS>>"), ("<</SYS>>", "&lt;</SYS>>")]


def escape(c):
    for raw, safe in CONTROL:
        c = F.replace(c, F.lit(raw), F.lit(safe))
    return c


def unescape(c):
    c = F.replace(F.replace(c, F.lit("&lb;"), F.lit("[")), F.lit("&lt;"), F.lit("<"))
    return F.replace(c, F.lit("&amp;"), F.lit("&"))


def windows(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
            budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """(conv, span, tokens, formatted): one row per window; ``span`` is the place of the span's first turn."""
    base = turns.select(F.col(conv_id).alias("conv"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"),
                        F.coalesce(F.col(text), F.lit("")).alias("text"))
    base = base.withColumn("tokens", F.regexp_count("text", F.lit(r"\S+")).cast("long") + 1)
    order, whole = Window.partitionBy("conv").orderBy("turn", "role", "text"), Window.partitionBy("conv")
    base = base.withColumn("place", F.row_number().over(order)).withColumn("upto", F.sum("tokens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    base = base.withColumn("system", F.min(F.when(F.col("role") == "system", F.struct("place", "tokens"))).over(whole))
    kept, kept_at = F.coalesce(F.col("system.tokens"), F.lit(0)), F.col("system.place")
    room = F.lit(budget) - F.when(kept < budget, kept).otherwise(0)
    capacity = F.greatest(F.floor(room * SHARE), F.lit(1))
    before = F.col("upto") - F.col("tokens")
    base = base.withColumn("block", F.floor((F.col("upto") - 1) / capacity)).withColumn("crosses", F.floor(before / capacity) < F.col("block"))
    inside = F.coalesce(F.sum(F.when(~F.col("crosses"), F.col("tokens"))).over(Window.partitionBy("conv", "block")), F.lit(0))
    base = base.withColumn("alone", F.col("crosses") & (F.col("tokens") + inside > capacity))
    one = Window.partitionBy("conv", "block", "alone")
    base = base.withColumn("span", F.min("place").over(one)).withColumn("total", F.sum("tokens").over(one))

    # the spans that begin just after a turn, and have room for it and the turns between
    goes = [F.col("span")]
    for k in range(1, history + 1):
        after = F.lead(F.struct("place", "span", "total", before.alias("before")), k).over(Window.partitionBy("conv").orderBy("place"))
        base = base.withColumn(f"after{k}", after)
        then = F.col(f"after{k}")
        between = then["before"] - before - F.when((kept_at > F.col("place")) & (kept_at < then["place"]), kept).otherwise(0)
        fits = F.when(kept_at < then["place"], kept).otherwise(0) + then["total"] + between <= budget
        goes.append(F.when((then["place"] == then["span"]) & fits & ~F.col("place").eqNullSafe(kept_at), then["span"]))
    placed = base.withColumn("own", F.col("span")).withColumn("span", F.explode(F.array_compact(F.array(*goes))))
    loss = F.when((F.col("role") == "assistant") & (F.col("span") == F.col("own")), "*").otherwise("")
    line = F.concat(F.lit("<|turn|>"), escape(F.col("role")), F.lit(":"), F.col("place"), loss, F.lit("<|text|>"), escape(F.col("text")), F.lit("<|end|>"))
    placed = placed.withColumn("line", line)
    made = placed.groupBy("conv", "span").agg(
        F.sort_array(F.collect_list(F.struct("place", "line"))).alias("lines"), F.sum("tokens").alias("tokens"),
        F.max(F.when(F.col("place") == kept_at, F.struct("line", "tokens"))).alias("system"))
    earlier = F.last("system", ignorenulls=True).over(Window.partitionBy("conv").orderBy("span").rowsBetween(Window.unboundedPreceding, -1))
    lines = F.array_join(F.transform("lines", lambda x: x["line"]), "")
    return made.withColumn("earlier", earlier).select(
        "conv", "span", (F.col("tokens") + F.coalesce("earlier.tokens", F.lit(0))).alias("tokens"), F.concat(F.coalesce("earlier.line", F.lit("")), lines).alias("formatted"))


def read_back(made: DataFrame) -> DataFrame:
    """(conv, turns, formatted_chars): from formatted windows, each turn once, with its loss mark."""
    lines = made.select("conv", F.explode(F.filter(F.split("formatted", r"<\|end\|>"), lambda x: x != "")).alias("line"))
    head = F.substring_index(F.substring_index("line", "<|text|>", 1), "<|turn|>", -1)
    mark = F.substring_index(head, ":", -1)
    body = F.expr("substring(line, instr(line, '<|text|>') + 8)")
    read = lines.select(
        "conv", (F.length("line") + len("<|end|>")).alias("chars"), F.regexp_extract(mark, r"\d+", 0).cast("long").alias("place"), F.endswith(mark, F.lit("*")).alias("loss"),
        unescape(F.substr(head, F.lit(1), F.length(head) - F.length(mark) - 1)).alias("role"), unescape(body).alias("text"))
    each = read.groupBy("conv", "place").agg(F.max("loss").alias("loss"), F.first("role").alias("role"), F.first("text").alias("text"), F.sum("chars").alias("chars"))
    return each.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("place", "loss", "role", "text"))).alias("turns"), F.sum("chars").alias("formatted_chars"))


ADDED = -7


def op6_chat(spark, sf_dir: str) -> DataFrame:
    turns = common.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    says = "</s>[INST] ok [/INST]"
    turns = turns.unionByName(spark.range(2).select(
        F.lit(ADDED).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(says).alias("text")))
    found = read_back(windows(turns))
    said = F.array_join(F.transform(F.filter("turns", lambda t: t["loss"]), lambda t: t["text"]), "")
    every = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return found.select(
        F.col("conv").alias("conv_id"), F.size("turns").cast("long").alias("n_turns"), F.sha2(F.encode(every, "utf-8"), 256).alias("turns_sha256"),
        F.length(said).cast("long").alias("loss_chars"), F.sha2(F.encode(said, "utf-8"), 256).alias("loss_sha256"),
        F.col("formatted_chars").cast("long").alias("formatted_chars"))


def _sql_escape(column: str) -> str:
    for raw, safe in CONTROL:
        column = f"replace({column}, '{raw}', '{safe}')"
    return column


#: The same rows in DuckDB: who is in which window comes from a join of turns and spans.
ORACLE_SQL = f"""WITH a AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT {ADDED}, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT {ADDED}, 1, 'assistant', '</s>[INST] ok [/INST]'),
 b AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS place, len(regexp_extract_all(text, '\\S+')) + 1 AS tokens FROM a),
 y AS (SELECT conv_id, min(place) AS sp, arg_min(tokens, place) AS st FROM b WHERE role = 'system' GROUP BY conv_id),
 c AS (SELECT b.*, coalesce(sp, 2000000000) AS sp, coalesce(st, 0) AS st, greatest(1, (3 * ({BUDGET} - CASE WHEN coalesce(st, 0) < {BUDGET} THEN coalesce(st, 0) ELSE 0 END)) // 4) AS cap,
  coalesce(sum(tokens) OVER (PARTITION BY b.conv_id ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM b LEFT JOIN y ON y.conv_id IS NOT DISTINCT FROM b.conv_id),
 d AS (SELECT *, before // cap AS s, (before + tokens - 1) // cap AS e FROM c),
 f AS (SELECT *, s < e AND tokens + coalesce(sum(CASE WHEN s = e THEN tokens END) OVER (PARTITION BY conv_id, e), 0) > cap AS alone FROM d),
 g AS (SELECT *, min(place) OVER (PARTITION BY conv_id, e, alone) AS span FROM f),
 w AS (SELECT conv_id, span, sum(tokens)::BIGINT AS total, min(before) AS before, any_value(CASE WHEN sp < span THEN st ELSE 0 END) AS kept FROM g GROUP BY conv_id, span),
 l AS (SELECT *, length({_sql_escape('role')}) + length({_sql_escape('text')}) + length(place::VARCHAR) + length('<|turn|>:<|text|><|end|>') AS chars FROM g),
 h AS (SELECT l.conv_id, sum(l.chars + CASE WHEN l.role = 'assistant' AND l.span = w.span THEN 1 ELSE 0 END)::BIGINT AS formatted_chars FROM l JOIN w ON w.conv_id IS NOT DISTINCT FROM l.conv_id AND (w.span = l.span
   OR (l.place = l.sp AND w.span > l.place)
   OR (l.place <> l.sp AND w.span - l.place BETWEEN 1 AND {HISTORY} AND w.kept + w.total + w.before - l.before - CASE WHEN l.sp > l.place AND l.sp < w.span THEN l.st ELSE 0 END <= {BUDGET}))
  GROUP BY l.conv_id),
 t AS (SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY place)) AS turns_sha256,
  coalesce(string_agg(text, '' ORDER BY place) FILTER (WHERE role = 'assistant'), '') AS said FROM b GROUP BY conv_id)
 SELECT t.conv_id, n_turns, turns_sha256, length(said)::BIGINT AS loss_chars, sha256(said) AS loss_sha256, formatted_chars FROM t JOIN h ON h.conv_id IS NOT DISTINCT FROM t.conv_id"""
