"""Mixing sources to target weights, with DataFrame functions only.

Words are counted per document and summed per source.  Sources in code-point order (null last) weigh 1, 2, 3,
repeating, and share all words; no target exceeds ``most`` times its source's size, and what is cut off goes to the
others by weight.  That water level is found in closed form: with caps sorted by cap / weight, the capped sources are a
prefix.  A document is then taken floor(rate) times plus once more with probability equal to the fraction, decided by
a hash of its id, its text and a seed, so that rows without an id, or with one id and other texts, are drawn each on their own.

Defined results: null text has size 0 and is taken 0 words; a null source is a source of its own, the last; a null id
is hashed as empty; rows that repeat both id and text are each mixed and get the same draw; a source without words has target 0; an empty
table gives an empty result; extra columns are kept by ``mixed``, but one
with the name of the added column is replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm import common

WORD = r"[^\x20\x09-\x0D]+"
MOST = 3
SEED = 20240611
#: Sources whose sums may be broadcast; more are joined by a shuffle.
BROADCAST_SOURCES = 20_000


def sized(docs: DataFrame, text: str = "text"):
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def digested(text: str = "text"):
    return F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary"))


def targets(sizes: DataFrame, most: float = MOST) -> DataFrame:
    """sizes: (source, source_size), one row per source.  Adds weight and target."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    by_cap = Window.orderBy("full", F.col("source").asc_nulls_last())
    upto = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    table = sizes.withColumn("weight", ((F.row_number().over(order) - 1) % 3 + 1).cast("double"))
    table = table.withColumn("cap", F.col("source_size") * F.lit(float(most))).withColumn("full", F.col("cap") / F.col("weight"))
    before = lambda c: F.coalesce(F.sum(c).over(upto), F.lit(0.0))
    table = table.withColumn("level", (F.sum("source_size").over(whole) - before("cap"))
                             / (F.sum("weight").over(whole) - before("weight")))
    # the first source, in order of cap / weight, that the level of the rest does not fill
    level = F.min(F.when(F.col("level") <= F.col("full"), F.struct("full", "level"))).over(whole)["level"]
    table = table.withColumn("water", level)
    return table.select("source", "source_size", "weight", F.least("cap", F.col("water") * F.col("weight")).alias("target"))


def mixed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", most: float = MOST,
          seed: int = SEED, as_column: str = "mix", size: str | None = None, digest: str | None = None) -> DataFrame:
    """``docs`` with one more column, struct(size, source_size, target, copies).

    ``size`` names a column of sizes that are known (null counts as 0), ``digest`` one of the texts' MD5 sums; with both no text is read.
    """
    docs = docs.drop(as_column)
    words = F.coalesce(F.col(size).cast("long"), F.lit(0)) if size else sized(docs, text)
    sizes = docs.select(F.col(source).alias("source"), words.alias("n")).groupBy("source").agg(F.sum("n").alias("source_size"))
    sizes = common.checkpoint(sizes)
    goal_name, goal_of = common.fresh(docs, "mix_goal"), common.fresh(docs, "mix_source")
    goal = targets(sizes, most).select(F.col("source").alias(goal_of), F.struct("source_size", "target").alias(goal_name))
    if sizes.count() <= BROADCAST_SOURCES:  # beyond it a shuffle, whose hot sources Spark splits
        goal = F.broadcast(goal)
    name = common.fresh(docs, "mix_size")
    joined = docs.withColumn(name, words).join(goal, F.col(source).eqNullSafe(F.col(goal_of)), "left")
    full, target = F.col(goal_name)["source_size"], F.col(goal_name)["target"]
    rate = F.when(full > 0, F.least(target / full, F.lit(float(most)))).otherwise(0.0)
    body = F.coalesce(F.col(digest), F.lit("")) if digest else digested(text)
    name_of = F.concat(F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.lit(f":{seed}:"), body)
    draw = F.conv(F.substring(F.md5(name_of), 1, 13), 16, 10).cast("long") / F.lit(float(2**52))
    copies = F.floor(rate) + (draw < rate - F.floor(rate)).cast("long")
    return joined.withColumn(as_column, F.struct(F.col(name).alias("size"), full.alias("source_size"), target.alias("target"), copies.alias("copies"))).drop(
        name, goal_name, goal_of)


def emitted(docs: DataFrame, copy: str = "mix_copy", **kw) -> DataFrame:
    """Every document as often as the mix takes it, with the columns of ``docs`` and the number of the copy."""
    name, copy = common.fresh(docs, "mix"), common.fresh(docs, copy)
    found = mixed(docs, as_column=name, **kw).where(F.col(name)["copies"] > 0)
    return found.withColumn(copy, F.explode(F.sequence(F.lit(1).cast("long"), F.col(name)["copies"]))).select(*docs.columns, copy)


def op8_mixing(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    docs = common.checkpoint(docs.select("doc_id", "source", sized(docs).alias("size"), digested().alias("digest")))  # texts are read once
    mix = F.col("mix")
    return mixed(docs, size="size", digest="digest").select(
        "doc_id", mix["size"].alias("size"), mix["source_size"].alias("source_size"), mix["target"].alias("target"),
        (mix["size"] * mix["copies"]).alias("taken"))


#: The same rows in DuckDB.
ORACLE_SQL = f"""WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{WORD}')), 0)::BIGINT AS size, md5(coalesce(text, '')) AS digest FROM documents),
 s AS (SELECT source, sum(size)::BIGINT AS whole FROM d GROUP BY source), w AS (SELECT *, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::DOUBLE AS weight FROM s),
 c AS (SELECT *, {MOST}::DOUBLE * whole AS cap, {MOST}::DOUBLE * whole / weight AS r FROM w),
 l AS (SELECT *, (sum(whole) OVER () - coalesce(sum(cap) OVER p, 0))::DOUBLE / (sum(weight) OVER () - coalesce(sum(weight) OVER p, 0)) AS level FROM c WINDOW p AS (ORDER BY r, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
 t AS (SELECT source, whole, least(cap, (SELECT arg_min(level, r) FROM l WHERE level <= r) * weight) AS target FROM l),
 k AS (SELECT d.doc_id, d.size, t.whole, t.target, CASE WHEN t.whole > 0 THEN least(t.target / t.whole, {MOST}::DOUBLE) ELSE 0 END AS rate,
  ('0x' || substr(md5(coalesce(d.doc_id::VARCHAR, '') || ':{SEED}:' || digest), 1, 13))::BIGINT / pow(2, 52) AS draw FROM d JOIN t ON t.source IS NOT DISTINCT FROM d.source)
 SELECT doc_id, size, whole AS source_size, target, (size * (floor(rate) + (draw < rate - floor(rate))::INT))::BIGINT AS taken FROM k"""
