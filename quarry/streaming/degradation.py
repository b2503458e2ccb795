"""Streaming forms of the stateful operators: sticky degradation of a session, and growth over a high-water mark.

Both give the rows of their batch forms in ``operators.sessions`` when a session's calls arrive in order.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

LIMIT = 3


def _in_order(batches: Iterator[pd.DataFrame]):
    """The rows of one key in one trigger, in order; a key may come in several batches."""
    return pd.concat(list(batches), ignore_index=True).sort_values("ord", kind="stable").itertuples()


def growth(runs: DataFrame, key: str = "key", order: str = "ord", total: str = "total", accepted: str = "accepted") -> DataFrame:
    """(key, ord, baseline, delta) of a stream of runs: only an accepted run moves the baseline, and never down."""
    rows = runs.select(F.col(key).cast("string").alias("key"), F.col(order).cast("long").alias("ord"), F.greatest(F.col(total).cast("long"), F.lit(0)).alias("total"), F.col(accepted).alias("accepted"))

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        baseline = state.get[0] if state.exists else 0
        out = []
        for r in _in_order(batches):
            out.append((key[0], r.ord, baseline, max(r.total - baseline, 0)))
            baseline = max(baseline, r.total) if r.accepted else baseline
        state.update((int(baseline),))
        yield pd.DataFrame(out, columns=["key", "ord", "baseline", "delta"])

    return rows.groupBy("key").applyInPandasWithState(step, "key string, ord long, baseline long, delta long", "baseline long", "append", GroupStateTimeout.NoTimeout)


def degradation(calls: DataFrame, session: str = "session", order: str = "ord", outcome: str = "outcome", task: str = "task") -> DataFrame:
    """(session, ord, streak, degraded) of a stream of calls; the state is two small numbers per session."""
    rows = calls.select(F.col(session).cast("string").alias("session"), F.col(order).cast("long").alias("ord"), F.col(outcome).alias("outcome"), F.col(task).alias("task"))

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        streak, sticky = state.get if state.exists else (0, False)
        out = []
        for r in _in_order(batches):
            streak = 0 if r.outcome == "ok" else streak + (r.outcome == "overloaded")
            sticky = sticky or (r.outcome == "overloaded" and streak >= LIMIT and r.task in ("generate", "verify"))
            out.append((key[0], r.ord, streak, sticky))
        state.update((int(streak), bool(sticky)))
        yield pd.DataFrame(out, columns=["session", "ord", "streak", "degraded"])

    return rows.groupBy("session").applyInPandasWithState(step, "session string, ord long, streak long, degraded boolean", "streak long, sticky boolean", "append", GroupStateTimeout.NoTimeout)


def matched_lines(files: DataFrame, text: str, needles, by: str) -> DataFrame:
    """Running scan summary of a stream of files: matched files and their lines."""
    from quarry.functions.scalars import line_count
    from quarry.operators.files import sniff

    return files.where(sniff(text, needles)).groupBy(by).agg(F.count("*").alias("matched"), F.sum(line_count(text)).alias("lines"))
