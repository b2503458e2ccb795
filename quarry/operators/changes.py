"""What changed: incremental skips, snapshot merges, reconciliation plans, selections and audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Names that a body may call without being listed.
ALLOWED_CALLS = "print len str int float bool dict list tuple set range enumerate zip sorted sum min max any all isinstance getattr setattr hasattr type Exception ValueError TypeError KeyError RuntimeError os json re datetime logging".split()


def incremental(current: DataFrame, previous: DataFrame, key: str, sha: str) -> DataFrame:
    """(key, action): replay (same content), parse (changed), new, deleted."""
    now = current.select(F.col(key), F.col(sha).alias("now"))
    was = previous.select(F.col(key), F.col(sha).alias("was"))
    both = now.join(was, key, "full")
    return both.select(key, F.when(F.col("now").isNull(), "deleted").when(F.col("was").isNull(), "new").when(F.col("now") == F.col("was"), "replay").otherwise("parse").alias("action"))


def merge_snapshot(previous: DataFrame, seen: DataFrame, scanned: DataFrame, key: str) -> DataFrame:
    """Previous rows whose key was seen, overridden by what was scanned now."""
    kept = previous.join(seen.select(key).distinct(), key, "left_semi").join(scanned.select(key), key, "left_anti")
    return kept.unionByName(scanned)


def usable_cache(files: DataFrame, endpoints: Column, functions: Column, captured: bool, by: list[str] = ()) -> DataFrame:
    """(by..., auto, custom): whether a snapshot serves either use."""
    return files.groupBy(*by).agg(F.coalesce(F.bool_or(endpoints > 0), F.lit(False)).alias("auto"),
                     (F.lit(captured) & F.coalesce(F.bool_or((endpoints > 0) | (functions > 0)), F.lit(False))).alias("custom"))


def sync_plan(existing: DataFrame, desired: DataFrame, key: list[str], fields: list[str], existing_order: str, desired_order: str,
              existing_id: str, payload: str | None = None, partial: bool = False) -> DataFrame:
    """(action, id, ord, fields): pairs rows of equal key one to one in order; leftovers are created or removed.

    A payload that must be cleared is a removal and a creation.  A partial scan never removes.
    """
    nth = lambda *order: F.row_number().over(Window.partitionBy(*key).orderBy(F.coalesce(order[0], F.lit(0)), *order[1:]))
    old = existing.withColumn("_n", nth(existing_order, existing_id)).select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(key)], "_n", F.col(existing_id).alias("id"),
                                                                *[F.col(f).alias(f"_old_{f}") for f in fields])
    new = desired.withColumn("_n", nth(desired_order)).select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(key)], "_n", F.col(desired_order).alias("ord"),
                                                              *[F.col(f).alias(f"_new_{f}") for f in fields])
    both = old.join(new, [f"_k{i}" for i in range(len(key))] + ["_n"], "full")
    changed = F.array_compact(F.array(*[
        F.when(~F.col(f"_old_{f}").eqNullSafe(F.col(f"_new_{f}")) & (F.lit(f != payload) | F.col(f"_new_{f}").isNotNull()), F.lit(f)) for f in fields]))
    cleared = F.lit(False) if payload is None else F.col(f"_new_{payload}").isNull() & F.col(f"_old_{payload}").isNotNull()
    step = lambda a, i, o, f: F.struct(F.lit(a).alias("action"), i.alias("id"), o.alias("ord"), f.alias("fields"))
    none_id, none_ord, none = F.lit(None).cast(existing.schema[existing_id].dataType), F.lit(None).cast(desired.schema[desired_order].dataType), F.array().cast("array<string>")
    pair = F.col("id").isNotNull() & F.col("ord").isNotNull()
    steps = (F.when(F.col("id").isNull(), F.array(step("create", none_id, F.col("ord"), none)))
             .when(F.col("ord").isNull(), F.array(step("remove", F.col("id"), none_ord, none)))
             .when(pair & cleared, F.array(step("remove", F.col("id"), none_ord, none), step("create", none_id, F.col("ord"), none)))
             .when(F.size(changed) > 0, F.array(step("update", F.col("id"), F.col("ord"), changed)))
             .otherwise(F.array(step("unchanged", F.col("id"), F.col("ord"), none))))
    out = both.select(F.explode(steps).alias("s")).select("s.*")
    return out.where("action <> 'remove'") if partial else out


def positioned(desired: DataFrame, by: list[str], order: list[str], out: str = "display_order") -> DataFrame:
    """desired with the place of each row in its group, from 0; what ``sync_plan`` compares as the order that is shown."""
    return desired.withColumn(out, (F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1).cast("int"))


def tokens(spec: str) -> list[str]:
    return [t for t in (" ".join(x.split()) for x in spec.split(",")) if t]


def select_tokens(rows: DataFrame, method: str, path: str, name: str, spec: str) -> tuple[DataFrame, DataFrame]:
    """Rows that a token picks ("METHOD /path", "/path" or a name), and (place, token) of tokens without a hit."""
    spark = rows.sparkSession
    import re

    kinds = []
    for k, t in enumerate(tokens(spec)):
        m = re.fullmatch(r"([A-Za-z]+) (/\S*)", t)
        kinds.append((k, t, m[1].upper() if m else None, m[2] if m else t if t.startswith("/") else None, None if m or t.startswith("/") else t.lower()))
    table = spark.createDataFrame(kinds, "place int, token string, m string, p string, n string")
    # three equi-joins against a literal list instead of one join with an OR
    by_name = rows.join(F.broadcast(table.where("n is not null")), F.lower(name) == F.col("n"))
    by_path = rows.join(F.broadcast(table.where("p is not null and m is null")), F.col(path) == F.col("p"))
    by_both = rows.join(F.broadcast(table.where("m is not null")), (F.upper(method) == F.col("m")) & (F.col(path) == F.col("p")))
    hits = by_name.unionByName(by_path).unionByName(by_both)
    picked = hits.select(*rows.columns).distinct()
    return picked, table.select("place", "token").join(hits.select("place").distinct(), "place", "left_anti")


def unknown_calls(calls: DataFrame, known: DataFrame, name: str, allowed=ALLOWED_CALLS) -> DataFrame:
    """Distinct called names that are neither known nor allowed."""
    return calls.select(name).where(F.col(name).isNotNull() & ~F.col(name).isin(*allowed)).distinct().join(known.select(name).distinct(), name, "left_anti")


def sync_summary(plan: DataFrame) -> DataFrame:
    """One row: how many are added, updated, removed and unchanged."""
    return plan.agg(*[F.count_if(F.col("action") == a).alias(name) for a, name in (("create", "added"), ("update", "updated"), ("remove", "removed"), ("unchanged", "unchanged"))])


def apply_order(plan: DataFrame) -> DataFrame:
    """The steps of a plan in the order in which they are applied: creations, updates, removals."""
    place = F.when(F.col("action") == "create", 1).when(F.col("action") == "update", 2).when(F.col("action") == "remove", 3)
    return plan.where("action <> 'unchanged'").withColumn("step", place).orderBy("step", "ord", "id")


def names_back(rows: DataFrame, names: DataFrame, key: str, name: str, mechanical: Column) -> DataFrame:
    """rows with the name found for them; without one they keep the mechanical name."""
    found = names.select(F.col(key).alias("_key"), F.col(name).alias("_name"))
    return rows.join(found, F.col(key) == F.col("_key"), "left").withColumn(name, F.coalesce("_name", mechanical)).drop("_key", "_name")


def duplicates(rows: DataFrame, digest: Column, key: str) -> DataFrame:
    """(sha, copies, first): contents that occur more than once."""
    return rows.groupBy(digest.alias("sha")).agg(F.count("*").alias("copies"), F.min(key).alias("first")).where("copies > 1")


def import_audit(imports: DataFrame, items: DataFrame, module: str, item: str, root: str | None = None) -> DataFrame:
    """imports that fail, with the reason: unknown module, or unknown item of a known module.

    With a root only imports of modules whose name begins with it are looked at; an empty root passes everything.
    """
    if root is not None:
        imports = imports.where(F.col(module).startswith(root) & F.lit(root != ""))
    modules = items.select(F.col(module).alias("_m")).distinct().withColumn("_mod", F.lit(True))
    pairs = items.select(F.col(module).alias("_pm"), F.col(item).alias("_pi")).distinct().withColumn("_pair", F.lit(True))
    out = imports.join(modules, F.col(module) == F.col("_m"), "left").join(pairs, (F.col(module) == F.col("_pm")) & (F.col(item) == F.col("_pi")), "left")
    return out.where("_pair is null").withColumn("reason", F.when(F.col("_mod").isNull(), "unknown module").otherwise("unknown item")).select(*imports.columns, "reason")


def package_root(modules: DataFrame, by: list[str], module: str, ordinal: str) -> DataFrame:
    """The longest common dotted prefix, else the first segment of the first module.  Prefixes of the least and greatest suffice."""
    parts = F.split(module, r"\.")
    ends = modules.where(F.coalesce(module, F.lit("")) != "").groupBy(*by).agg(F.min(parts).alias("lo"), F.max(parts).alias("hi"), F.min_by(module, ordinal).alias("first"))
    same = F.aggregate(F.arrays_zip("lo", "hi"), F.struct(F.lit(True).alias("go"), F.array().cast("array<string>").alias("p")),
                       lambda a, x: F.when(a["go"] & x["lo"].eqNullSafe(x["hi"]) & x["lo"].isNotNull(), F.struct(F.lit(True).alias("go"), F.concat(a["p"], F.array(x["lo"])).alias("p"))).otherwise(
                           F.struct(F.lit(False).alias("go"), a["p"].alias("p"))), lambda a: F.array_join(a["p"], "."))
    return ends.select(*by, F.when(same != "", same).otherwise(F.substring_index("first", ".", 1)).alias("root"))
