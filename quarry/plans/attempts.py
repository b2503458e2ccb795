"""Work that may fail: shards that fail alone, and attempts that are bounded and only repeat what was rejected."""

from __future__ import annotations

import multiprocessing
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from quarry.operators import ranking
from quarry.operators.candidates import BANDS, numbered_batches
from quarry.operators.cut import checkpoint

SECONDS, ATTEMPTS = 30.0, 3
#: Endpoints that are named in one call, and its time limit.
NAMED, NAMING_SECONDS = 30, 12.0
#: Named batches that are given back to Spark at once.
TOLD = 1_000


class _Apart:
    """Calls of a function in a process of their own, which serves one after another; each gives (outcome, result).

    A call whose time is over, or that ends the process, costs the process: it is ended, and the next call gets a new one.
    """

    def __init__(self, function: Callable):
        self.function, self.child, self.pipe = function, None, None

    def __enter__(self) -> _Apart:
        return self

    def __exit__(self, *_) -> None:
        if self.child:
            self.child.kill()
            self.child.join()
            self.pipe.close()
        self.child = None

    def _start(self) -> None:
        context = multiprocessing.get_context("fork")
        here, there = context.Pipe()

        def work():
            here.close()  # so that the pipe ends with the task, and this process with it
            while True:
                try:
                    rows = there.recv()
                except EOFError:
                    return
                try:
                    there.send(("ok", self.function(rows)))
                except BaseException as error:  # noqa: BLE001  (whatever a call raises, only its rows are lost)
                    there.send(("failed", type(error).__name__))

        self.pipe, self.child = here, context.Process(target=work, daemon=True)
        self.child.start()
        there.close()

    def __call__(self, rows: pd.DataFrame, seconds: float) -> tuple[str, object]:
        if not (self.child and self.child.is_alive()):
            self.__exit__()
            self._start()
        try:
            self.pipe.send(rows)
            if self.pipe.poll(seconds):
                return self.pipe.recv()
            outcome = "timeout", None
        except (EOFError, OSError):  # the process ended without an answer
            outcome = "failed", "EOFError"
        self.__exit__()
        return outcome


def scored_shards(head: DataFrame, name: str, scorer: Callable[[pd.DataFrame], pd.DataFrame], shard: str = "shard", seconds: float = SECONDS) -> tuple[DataFrame, DataFrame]:
    """Verdicts (name, band) of the shards that were scored, and (shard, outcome, detail) of all: ok, failed, timeout or invalid.

    ``scorer`` gets the rows of one shard and gives a frame with the columns ``name`` and ``band``.  A shard's answer counts as a whole:
    one that fails, takes longer, lacks a column or has a name that the shard has not gives no verdict.  Bands that are none are left to
    ``ranking.complete_verdicts``, which also makes LOW of what has no verdict.
    """
    kinds = f"shard {head.schema[shard].dataType.simpleString()}, outcome string, detail string, name string, band string"

    def run(key, rows):
        with _Apart(scorer) as call:
            outcome, found = call(rows, seconds)
        if outcome == "ok":
            if isinstance(found, pd.DataFrame) and {name, "band"} <= set(found.columns) and set(found[name]) <= set(rows[name]) and not found[name].duplicated().any():
                verdicts = [(key[0], "ok", None, n, b) for n, b in zip(found[name].astype(str), found["band"], strict=True)]
                return pd.DataFrame(verdicts or [(key[0], "ok", None, None, None)], columns=["shard", "outcome", "detail", "name", "band"])
            outcome, found = "invalid", type(found).__name__
        return pd.DataFrame([(key[0], outcome, found, None, None)], columns=["shard", "outcome", "detail", "name", "band"])

    made = checkpoint(head.groupBy(shard).applyInPandas(run, kinds))
    verdicts = made.where("name is not null").select(F.col("name").cast(head.schema[name].dataType).alias(name), "band")
    return verdicts, made.select("shard", "outcome", "detail").distinct()


def classified(rows: DataFrame, name: str, order: list, scorer: Callable[[pd.DataFrame], pd.DataFrame], size: int = ranking.SHARD, shards: int = ranking.SHARDS, seconds: float = SECONDS) -> tuple[DataFrame, DataFrame]:
    """rows with a band each, and the outcome of every shard.  Only the first size * shards rows are scored, as a budget."""
    head = checkpoint(ranking.numbered_head(rows, order, size * shards, "_n").withColumn("shard", F.floor((F.col("_n") - 1) / size)))
    verdicts, outcomes = scored_shards(head, name, scorer, seconds=seconds)
    return ranking.complete_verdicts(rows, verdicts.where(F.col("band").isin(*BANDS)), name), outcomes


def _batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The batches of a sorted partition: each begins where ``local`` is 0, and may go on in the next part."""
    held: list[pa.RecordBatch] = []
    for part in parts:
        last = 0
        for start in [*np.flatnonzero(part.column("local").to_numpy() == 0).tolist(), part.num_rows]:
            if start > last:
                held.append(part.slice(last, start - last))
            if start < part.num_rows and held:
                yield pa.Table.from_batches(held)
                held = []
            last = start
    if held:
        yield pa.Table.from_batches(held)


def _answers(size: int, found: object) -> dict[int, tuple[str, str]]:
    """By index: the name and the description of a namer's answer that count."""
    if not (isinstance(found, pd.DataFrame) and {"index", "tool_name", "description"} <= set(found.columns)):
        return {}
    rows = zip(*(found[c].tolist() for c in ("index", "tool_name", "description")), strict=True)
    return {k: (n, d) for k, n, d in rows if isinstance(k, int) and 0 <= k < size and isinstance(n, str) and n and isinstance(d, str)}


def named(endpoints: DataFrame, by: list[str], order: list[str], namer: Callable[[pd.DataFrame], pd.DataFrame], name: str = "suggested_tool_name", description: str = "description", size: int = NAMED,
          seconds: float = NAMING_SECONDS, tries: int = 2) -> DataFrame:
    """endpoints with the names and descriptions that a namer gives them; without one they keep their own.

    The endpoints of a group (``by``) go to the namer in batches, in order.  It gets a batch with ``index`` from 0 and gives (index, tool_name, description);
    what it says of an index that the batch has not, or without a name, does not count, and of several answers to one the last does.  A batch whose calls fail or
    take too long is left as it is.  The batches of a task are named one after another in one process beside it, so a namer may keep what it opened; one that
    fails has the process for its next batch, one that takes too long has not.
    """
    texts = {c: F.col(c).cast("string").alias(c) for c in (name, description)}
    rows = numbered_batches(endpoints.select(*[texts.get(c, c) for c in endpoints.columns]), by, order, size)
    keys = [*by, "batch"]
    kinds = StructType([StructField(f.name, f.dataType) for f in rows.select(*endpoints.columns).schema])

    def run(parts):
        done: list[pa.Table] = []
        with _Apart(lambda asked: _answers(len(asked), namer(asked))) as call:
            for part in _batches(parts):
                own = part.select(kinds.names)
                asked = own.select([c for c in kinds.names if c != "index"]).append_column("index", part.column("local")).to_pandas(use_threads=False, maps_as_pydicts="strict")
                for field in own.schema:
                    if field.name != "index" and pa.types.is_timestamp(field.type) and field.type.tz:  # as in other pandas functions of Spark
                        asked[field.name] = asked[field.name].dt.tz_localize(None)
                for _ in range(tries):
                    outcome, found = call(asked, seconds)
                    if outcome == "ok":
                        break
                answers = found if outcome == "ok" else {}
                for column, k in ((name, 0), (description, 1)):
                    at = own.schema.get_field_index(column)
                    told = [answers[i][k] if i in answers else v for i, v in enumerate(own.column(at).to_pylist())]
                    own = own.set_column(at, own.schema.field(at), pa.array(told, own.schema.field(at).type)) if answers else own
                done.append(own)
                if len(done) >= TOLD:
                    yield from pa.concat_tables(done).combine_chunks().to_batches()
                    done = []
        if done:
            yield from pa.concat_tables(done).combine_chunks().to_batches()

    # a number of partitions, as Spark would else join those that are small in bytes, though their calls take long
    tasks = int(endpoints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return checkpoint(rows.repartition(tasks, *keys).sortWithinPartitions(*keys, "local").mapInArrow(run, kinds))


def attempted(rows: DataFrame, key: str, generate: Callable[[DataFrame, int], DataFrame], check: Callable[[DataFrame], DataFrame], most: int = ATTEMPTS) -> DataFrame:
    """(key, made, attempt, accepted, issues): what was made of every row, and at which attempt.

    ``generate`` gets the rows that are to be made, with ``issues`` (what was wrong with the last attempt, an empty list at first) and the
    number of the attempt, and gives (key, made).  ``check`` gets (key, made) and gives (key, issue) for what is wrong.  Only rejected rows go
    round again, at most ``most`` times; a row for which nothing is made has the issue ``nothing was made``.
    """
    none = F.array().cast("array<string>")
    pending, done = rows.withColumn("issues", none), []
    for n in range(1, most + 1):
        made = checkpoint(generate(pending, n).select(key, F.col("made").cast("string").alias("made")))
        wrong = check(made).select(key, "issue").groupBy(key).agg(F.sort_array(F.collect_set("issue")).alias("_wrong"))
        keys = pending.select(key)
        judged = keys.join(made, key, "left").join(wrong, key, "left")
        issues = F.when(F.col("made").isNull(), F.array(F.lit("nothing was made"))).otherwise(F.coalesce("_wrong", none))
        judged = checkpoint(judged.select(key, "made", F.lit(n).alias("attempt"), issues.alias("issues")).withColumn("accepted", F.size("issues") == 0))
        done.append(judged.where("accepted") if n < most else judged)
        if n == most or not judged.where("not accepted").limit(1).count():
            break
        pending = rows.join(judged.where("not accepted").select(key, "issues"), key)
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.select(key, "made", "attempt", "accepted", "issues")
