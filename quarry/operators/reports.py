"""Reports over scanned tables: statistics, groups in order, counts as text, listings cut for display."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def counted_text(counts: DataFrame, label: str, n: str = "n", out: str = "text") -> DataFrame:
    """One row: "Go (12), Python (1)", the most frequent first, equal ones by name.  ``counts`` has one row per label."""
    each = F.sort_array(F.collect_list(F.struct((-F.col(n)).alias("m"), F.col(label).alias("label"))))
    return counts.agg(F.array_join(F.transform(each, lambda x: F.concat(x["label"], F.lit(" ("), -x["m"], F.lit(")"))), ", ").alias(out))


def statistics(files: DataFrame, language: str, lines: Column, **others: tuple[DataFrame, Column]) -> DataFrame:
    """One row: files, lines, languages as text, and one aggregate of each other table."""
    per = files.groupBy(language).agg(F.count("*").alias("n"), F.sum(lines).alias("l"))
    out = per.agg(F.sum("n").alias("files"), F.sum("l").alias("lines")).join(F.broadcast(counted_text(per.where(F.col(language).isNotNull()), language, out="languages")))
    for name, (table, value) in others.items():
        out = out.join(F.broadcast(table.agg(value.alias(name))))  # one row each
    return out


def grouped(rows: DataFrame, group: Column, value: str, order: str, most: int | None = None, out: str = "listed") -> DataFrame:
    """(module, items, listed): values of each group in order; an empty group is ``root``.

    ``most`` cuts the list for display: only the first values are gathered, so no group is larger than that.
    """
    named = rows.select(F.when(F.coalesce(group, F.lit("")) == "", "root").otherwise(group).alias("module"), F.struct(order, value).alias("v"))
    if most is None:
        listed = F.sort_array(F.collect_list("v"))
        made = named.groupBy("module").agg(F.count("*").alias("items"), listed.alias("v"))
    else:
        from pyspark.sql import Window

        n = F.row_number().over(Window.partitionBy("module").orderBy("v"))
        sizes = named.groupBy("module").agg(F.count("*").alias("items"))
        made = named.withColumn("n", n).where(F.col("n") <= most).groupBy("module").agg(F.sort_array(F.collect_list("v")).alias("v")).join(sizes, "module")
    return made.select("module", "items", F.transform("v", lambda x: x[value]).alias(out))


def filled(modules: DataFrame, *counts: str) -> DataFrame:
    """Modules with something in one of the counts."""
    some = F.lit(False)
    for c in counts:
        some = some | (F.coalesce(c, F.lit(0)) > 0)
    return modules.where(some)


def valid_manifest(language: str, framework: str, endpoints: str, functions: str, root: str) -> Column:
    """Whether a manifest row has what it must; a framework may be missing."""
    return F.col(language).isNotNull() & F.col(endpoints).isNotNull() & F.col(functions).isNotNull() & F.col(root).isNotNull()


def missing_keys(json_text: str, required: list[str]) -> Column:
    """Required keys that a JSON object lacks, in order; text that is no object lacks them all."""
    have = F.coalesce(F.json_object_keys(F.when(F.trim(json_text).startswith("{"), F.col(json_text))), F.array().cast("array<string>"))
    return F.filter(F.array(*[F.lit(k) for k in required]), lambda k: ~F.array_contains(have, k))
