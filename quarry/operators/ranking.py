"""Scores, ranked lists, shards, verdicts and clusters.

Ranked heads are taken with orderBy + limit (a distributed top-K), so numbering only sees K rows; no global window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HINT = r"(?i)@(task|tool|job|command|action|route|entry|op)(?![A-Za-z0-9_])"
SHARD, SHARDS = 12, 20
#: Rows of a numbered head that may be broadcast; a longer one is joined by a shuffle.
BROADCAST_ROWS = 1_000_000


def function_score(docstring, signature, name, path, calls, is_async) -> Column:
    c = lambda x: F.col(x) if isinstance(x, str) else x
    docstring, signature, name, path, calls, is_async = map(c, (docstring, signature, name, path, calls, is_async))
    add = lambda cond, n: F.when(F.coalesce(cond, F.lit(False)), n).otherwise(0)
    return (add(F.length(docstring) > 20, 3) + add(signature.contains(":"), 2) + add(signature.rlike(r"->\s*[A-Za-z0-9_\[\]]+"), 2)
            + add(signature.rlike(HINT), 3) + F.least(F.coalesce(calls, F.lit(0)), F.lit(5)) + add(name.startswith("_"), -5)
            + add(path.rlike(r"(?i)(?<![A-Za-z0-9_])tests?(?![A-Za-z0-9_])"), -5) + add(F.length(name) < 3, -2) + add(is_async, 1)).cast("int")


def numbered_head(rows: DataFrame, order: list, k: int, out: str) -> DataFrame:
    """The first k rows in order, numbered from 1.  ``order`` must be a total order."""
    return rows.orderBy(*order).limit(k).withColumn(out, F.row_number().over(Window.orderBy(*order)))


def _small(head: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(head) if rows <= BROADCAST_ROWS else head


def rank_topk(rows: DataFrame, score: str, ordinal: str, k: int = 200) -> DataFrame:
    """All rows with ``rank`` (null beyond k) and ``kept``."""
    head = numbered_head(rows.select(ordinal, score), [F.col(score).desc(), F.col(ordinal)], k, "rank").select(F.col(ordinal).alias("_o"), "rank")
    return rows.join(_small(head, k), F.col(ordinal) == F.col("_o"), "left").drop("_o").withColumn("kept", F.col("rank").isNotNull())


def shards(rows: DataFrame, ordinal: str, size: int = SHARD, most: int = SHARDS) -> DataFrame:
    """All rows with shard and place in it; rows beyond the last shard have neither and are ``dropped``."""
    head = numbered_head(rows.select(ordinal), [F.col(ordinal)], size * most, "n").select(
        F.col(ordinal).alias("_o"), F.floor((F.col("n") - 1) / size).cast("int").alias("shard"), ((F.col("n") - 1) % size).alias("place"))
    return rows.join(_small(head, size * most), F.col(ordinal) == F.col("_o"), "left").drop("_o").withColumn("dropped", F.col("shard").isNull())


def complete_verdicts(rows: DataFrame, verdicts: DataFrame, key: str, band: str = "band") -> DataFrame:
    """Every row gets a band; invalid and missing ones are LOW."""
    good = verdicts.where(F.col(band).isin("HIGH", "MEDIUM", "LOW", "SKIP")).select(key, band)
    return rows.join(good, key, "left").withColumn(band, F.coalesce(band, F.lit("LOW")))


def kept_verdicts(rows: DataFrame, verdicts: DataFrame, key: str, band: str = "band") -> DataFrame:
    """Rows whose band is HIGH or MEDIUM; without any verdict all rows."""
    none = verdicts.agg((F.count("*") == 0).alias("_none"))
    whole = complete_verdicts(rows, verdicts, key, band).join(F.broadcast(none))
    return whole.where(F.col("_none") | F.col(band).isin("HIGH", "MEDIUM")).select(*rows.columns)


def with_calls(rows: DataFrame, calls: DataFrame, name: str) -> DataFrame:
    """rows with the call sites of their name, 0 without any."""
    return rows.join(calls.select(name, F.col("calls")), name, "left").withColumn("calls", F.coalesce("calls", F.lit(0)))


def clusters(verdicts: DataFrame, hint: str, module: str, name: str, most: int = 5) -> DataFrame:
    """Workflows by hint, else by module, else one of all; at least two members; the most confident first."""
    m = F.coalesce(F.col(module), F.lit(""))
    hints = verdicts.where(F.coalesce(hint, F.lit("")) != "").groupBy(F.concat(F.col(hint), F.lit("_workflow")).alias("cluster")).agg(
        F.count("*").alias("n"), F.min(name).alias("first")).where("n >= 2").select(
        "cluster", "n", F.least(F.lit(1.0), 0.5 + 0.1 * F.col("n")).alias("confidence"), "first")
    modules = verdicts.groupBy(F.regexp_replace(F.when(m == "", "root").otherwise(m), r"[^A-Za-z0-9_]+", "_").alias("cluster")).agg(
        F.count("*").alias("n"), F.min(name).alias("first")).where("n >= 2").select(
        F.concat("cluster", F.lit("_workflow")).alias("cluster"), "n", F.lit(0.6).alias("confidence"), "first")
    every = verdicts.agg(F.count("*").alias("n"), F.min(name).alias("first")).where("n >= 2").select(
        F.lit("combined_workflow").alias("cluster"), "n", F.lit(0.5).alias("confidence"), "first")
    return first_tier(hints, modules, every).orderBy(F.desc("confidence"), "first", "cluster").limit(most)


def first_tier(*tiers: DataFrame, start: int = 1) -> DataFrame:
    """The rows of the first table that has any, with its number as ``tier``; the plan holds no other one.

    One row at most of each table before it is looked for, so a later table is not even planned if an earlier one serves.
    """
    for k, rows in enumerate(tiers[:-1]):
        if rows.limit(1).count():
            return rows.withColumn("tier", F.lit(start + k))
    return tiers[-1].withColumn("tier", F.lit(start + len(tiers) - 1))


def call_sites(files: DataFrame, text: str, names: list[str], declared: str = "def") -> DataFrame:
    """(name, calls): hits of ``name(`` less declarations of it, never below 0.  Names are words of letters, digits and underscores.

    What is called and what is declared is extracted once from each text, so the cost does not grow with the number of names.
    """
    known = lambda found: F.filter(found, lambda x: x.isin(*names))
    words = lambda lead: F.regexp_extract_all(F.col(text), F.lit(rf"(?<![A-Za-z0-9_]){lead}([A-Za-z0-9_]++)\s*+\("), F.lit(1))
    some = files.where(F.contains(F.col(text), F.lit("(")))
    hits = some.select(F.explode(known(words(""))).alias("name"), F.lit(1).alias("n"))
    less = some.where(F.contains(F.col(text), F.lit(declared))).select(F.explode(known(words(rf"{declared}\s++"))).alias("name"), F.lit(-1).alias("n"))
    sums = hits.unionByName(less).groupBy("name").agg(F.sum("n").alias("n"))
    asked = files.sparkSession.createDataFrame([(n,) for n in dict.fromkeys(names)], "name string")
    return asked.join(sums, "name", "left").select("name", F.greatest(F.coalesce("n", F.lit(0)), F.lit(0)).cast("long").alias("calls"))
