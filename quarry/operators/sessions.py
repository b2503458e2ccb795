"""Event-log operators: last records, resume state, terminal state, streaks, baselines, layered settings, budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import classify, scalars


def latest(rows: DataFrame, key: list[str], order: str, value) -> DataFrame:
    return rows.groupBy(*key).agg(F.max_by(value, order).alias("last"))


def terminal_state(events: DataFrame, session: str, kind: str, order: str, labels: dict[str, str], default: str = "in-progress") -> DataFrame:
    """(session, state): the label of the last record of a terminal kind."""
    label = F.create_map(*[F.lit(x) for kv in labels.items() for x in kv])[F.col(kind)]
    return events.groupBy(session).agg(F.coalesce(F.max_by(label, F.when(label.isNotNull(), F.col(order))), F.lit(default)).alias("state"))


def resumable(events: DataFrame, session: str, kind: str, order: str, opened: str, done: str, repo: tuple[str, str] | None = None) -> DataFrame:
    """Sessions with an opening and no end, with the time of the last opening.

    ``repo``: (column, value); only sessions whose last opening is of that repository.
    """
    opens = F.col(kind) == opened
    which = F.max_by(F.col(repo[0]), F.when(opens, F.col(order))) if repo else F.lit(None)
    found = events.groupBy(session).agg(F.max(F.when(opens, F.col(order))).alias("opened"), F.bool_or(F.col(kind) == done).alias("done"), which.alias("_repo"))
    found = found.where("opened is not null and not done")
    return (found.where(F.col("_repo") == repo[1]) if repo else found).select(session, "opened")


def resume_state(ledger: DataFrame, session: str = "session_id") -> tuple[DataFrame, DataFrame]:
    """Per session: last open, last pause, completed.  Per session and path: last scan and last skip reason."""
    when = lambda t, v: F.max_by(F.when(F.col("type") == t, v), F.when(F.col("type") == t, F.col("line_no")))
    one = ledger.groupBy(session).agg(when("session_open", F.col("repo_hash")).alias("repo_hash"), when("session_paused", F.col("reason")).alias("paused"),
                                      F.bool_or(F.col("type") == "session_done").alias("completed"), F.count_if(F.col("type") == "file_scanned").alias("scanned"),
                                      F.count_if(F.col("type") == "file_skipped").alias("skipped"))
    paths = ledger.where("path is not null").groupBy(session, "path").agg(when("file_scanned", F.col("sha")).alias("sha"), when("file_skipped", F.col("reason")).alias("skip_reason"))
    return one, paths


def expired(rows: DataFrame, at: str, now, days: int = 30) -> Column:
    return F.col(at) <= now - F.expr(f"INTERVAL {days} DAYS")


def sweep(rows: DataFrame, by: list[str], old: Column, size: Column) -> DataFrame:
    """What a retention sweep removes: rows, and their bytes."""
    return rows.groupBy(*by).agg(F.count_if(old).alias("removed"), F.coalesce(F.sum(F.when(old, size)), F.lit(0)).cast("long").alias("bytes"))


def newest(sessions: DataFrame, at: str, key: str, most: int | None = None) -> DataFrame:
    """Sessions, the latest first; the first one is what a run resumes."""
    out = sessions.orderBy(F.col(at).desc(), F.col(key))
    return out if most is None else out.limit(most)


def call_totals(calls: DataFrame, by: list[str], sums: dict[str, Column], order: Column, last: str) -> DataFrame:
    """Calls, sums of what they used, and the last value of a column."""
    return calls.groupBy(*by).agg(F.count("*").alias("calls"), *[F.sum(c).alias(name) for name, c in sums.items()], F.max_by(last, order).alias("last"))


def source_of_truth(resume: DataFrame, discovered: DataFrame, cached: DataFrame, scanned: DataFrame) -> DataFrame:
    """Rows of the first table that has any: a resumed session, a discovered one, the snapshot, a new scan."""
    from quarry.operators.ranking import first_tier

    return first_tier(resume, discovered, cached, scanned, start=0)


def streaks(calls: DataFrame, session: str, order: str, outcome: str, task: str, limit: int = 3, good: str = "ok", bad: str = "overloaded") -> DataFrame:
    """calls with ``streak`` (bad outcomes since the last good one) and ``degraded`` (a limit was reached on an earlier
    or this generate/verify call of the session; it stays)."""
    w = Window.partitionBy(session).orderBy(order)
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    marked = calls.withColumn("_island", F.sum(F.when(F.col(outcome) == good, 1).otherwise(0)).over(run))
    island = Window.partitionBy(session, "_island").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    counted = marked.withColumn("streak", F.sum(F.when(F.col(outcome) == bad, 1).otherwise(0)).over(island).cast("long"))
    reached = (F.col("streak") >= limit) & F.col(task).isin("generate", "verify") & (F.col(outcome) == bad)
    return counted.withColumn("degraded", F.max(reached.cast("int")).over(run) == 1).drop("_island")


def baseline(*keys: str) -> Column:
    """The greatest of legacy values, given as JSON; what is no positive number (quoted ones are none) counts 0."""
    number = lambda k: F.when(F.col(k).cast("string").rlike(r"^-?[0-9.]+([eE][+-]?[0-9]+)?$"), F.col(k).try_cast("double"))
    whole = [F.coalesce(F.floor(F.when(number(k) > 0, number(k))), F.lit(0)) for k in keys]
    return (F.greatest(*whole) if len(whole) > 1 else whole[0]).cast("long")


def high_water(runs: DataFrame, key: str, order: str, total: str, accepted: Column) -> DataFrame:
    """runs with the baseline and the growth over it: the highest total of an earlier run that was ``accepted``.

    A run without growth sends nothing, and its total would not move the baseline anyway.
    """
    before = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    was = F.coalesce(F.max(F.when(accepted, F.greatest(F.floor(total), F.lit(0)))).over(before), F.lit(0)).cast("long")
    return runs.withColumn("baseline", was).withColumn("delta", scalars.lines_delta(F.col(total), F.col("baseline")))


def upsert(table: DataFrame, rows: DataFrame, key: list[str], created: str, updated: str) -> DataFrame:
    """rows replace those of equal key but keep their created stamp."""
    old = table.select(*key, F.col(created).alias("_created"))
    new = rows.join(old, key, "left").withColumn(created, F.coalesce("_created", created)).drop("_created")
    return table.join(rows.select(*key), key, "left_anti").unionByName(new.select(*table.columns))


def layered(settings: DataFrame, key: list[str], value: str, priority: str, tie: str) -> DataFrame:
    """The first non-empty value by priority."""
    full = F.when(F.coalesce(F.trim(value), F.lit("")) != "", F.col(value))
    return settings.groupBy(*key).agg(F.min_by(full, F.when(full.isNotNull(), F.struct(priority, tie))).alias("value"))


def resolved(settings: DataFrame, field: str, value: str, priority: str, provider: str, chosen: str, conditional: DataFrame, pin: str | None = None, pinned: DataFrame | None = None) -> DataFrame:
    """(field, value): layered settings of the chosen provider.

    Conditional fields (stored models and limits) count only where their row's provider is the chosen one; a pinned
    model is the value of all pinned fields.  Both lists are tables with a column ``field``.
    """
    named = lambda table: table.select(F.col(field)).where(F.col(field).isNotNull()).distinct()
    ours = F.col(provider).eqNullSafe(F.lit(chosen))
    fits = settings.where(ours).unionByName(settings.where(~ours).join(named(conditional), field, "left_anti"))
    out = layered(fits, [field], value, priority, value)
    if pin is None or pinned is None:
        return out
    return out.join(named(pinned), field, "left_anti").unionByName(named(pinned).withColumn("value", F.lit(pin)))


def appended_lines(existing: DataFrame, wanted: DataFrame, key: str, value: str) -> DataFrame:
    """(key, line): KEY=value lines of the keys that are not there yet; values with blanks, #, = or quotes are quoted."""
    quoted = F.when(F.col(value).rlike("[\\s#=\"']"), F.concat(F.lit('"'), value, F.lit('"'))).otherwise(F.col(value))
    return wanted.join(existing.select(key), key, "left_anti").select(key, F.concat(F.col(key), F.lit("="), quoted).alias("line"))


def moved_baselines(table: DataFrame, sent: DataFrame, key: str, total: str, fields: list[str]) -> DataFrame:
    """The baseline table after accepted sends: the named fields take the total, other fields stay."""
    new = sent.groupBy(key).agg(F.max(total).alias("_total"))
    out = table.join(new, key, "full")
    return out.select(*[F.coalesce("_total", c).alias(c) if c in fields else F.col(c) for c in table.columns])


def merge_lines(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """KEY=value rows; the first table wins."""
    return first.unionByName(second.join(first.select(key), key, "left_anti"))


def char_budget(docs: DataFrame, key: list[str], order: list[str], text: str, each: int = 3000, whole: int = 6000) -> DataFrame:
    """docs with ``taken``: characters within the budget of each document and what is left of the whole one."""
    before = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    size = F.least(F.coalesce(F.length(text), F.lit(0)), F.lit(each)).cast("long")
    return docs.withColumn("taken", F.greatest(F.lit(0).cast("long"), F.least(size, F.lit(whole).cast("long") - F.coalesce(F.sum(size).over(before), F.lit(0).cast("long")))))


def lines_report(total, base, has_key, status, detail) -> Column:
    return classify.lines_outcome(scalars.lines_delta(total, base), has_key, status, detail)
