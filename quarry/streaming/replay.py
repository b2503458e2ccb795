"""Replay of the session log as a stream: what a resumed session needs, kept as state.

A session has a value state (its last opening and pause, whether it is done, counts) and a map state (the last scan and
skip of each path).  Records may come late: a value is only replaced by one with a higher place in the log.  A timer ends a
session that has been quiet for the time to live; its state is dropped and it is reported as expired.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

OUT = "session_id string, kind string, path string, repo_hash string, paused string, completed boolean, scanned long, skipped long, sha string, skip_reason string"
COLUMNS = [c.split()[0] for c in OUT.split(", ")]
SESSION = "repo_hash string, opened long, paused string, paused_at long, completed boolean, scanned long, skipped long"
PATH = "sha string, sha_at long, reason string, reason_at long"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Replay(StatefulProcessor):
    def __init__(self, ttl_ms: int | None):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.session = handle.getValueState("session", SESSION, self.ttl_ms)
        self.paths = handle.getMapState("paths", "path string", PATH, self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        repo, opened, paused, paused_at, done, scanned, skipped = self.session.get() if self.session.exists() else (None, -1, None, -1, False, 0, 0)
        touched: dict[str, list] = {}
        for r in (r for part in rows for r in part.itertuples()):
            if r.type == "session_open" and r.line_no > opened:
                repo, opened = r.repo_hash, r.line_no
            elif r.type == "session_paused" and r.line_no > paused_at:
                paused, paused_at = r.reason, r.line_no
            elif r.type == "session_done":
                done = True
            scanned += r.type == "file_scanned"
            skipped += r.type == "file_skipped"
            if r.path is not None and r.type in ("file_scanned", "file_skipped"):
                if r.path not in touched:
                    touched[r.path] = list(self.paths.getValue((r.path,)) if self.paths.containsKey((r.path,)) else (None, -1, None, -1))
                at = 0 if r.type == "file_scanned" else 2
                if r.line_no > touched[r.path][at + 1]:
                    touched[r.path][at : at + 2] = (r.sha if at == 0 else r.reason), r.line_no
        for path, value in touched.items():
            self.paths.updateValue((path,), (value[0], int(value[1]), value[2], int(value[3])))
        self.session.update((repo, int(opened), paused, int(paused_at), bool(done), int(scanned), int(skipped)))
        if self.ttl_ms:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.ttl_ms)
        out = [(key[0], "session", None, repo, paused, bool(done), int(scanned), int(skipped), None, None)]
        out += [(key[0], "path", path, None, None, None, None, None, v[0], v[2]) for path, v in touched.items()]
        yield pd.DataFrame(out, columns=COLUMNS).astype({"completed": "boolean", "scanned": "Int64", "skipped": "Int64"})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.session.clear()
        self.paths.clear()
        yield pd.DataFrame([(key[0], "expired", *[None] * (len(COLUMNS) - 2))], columns=COLUMNS).astype({"completed": "boolean", "scanned": "Int64", "skipped": "Int64"})

    def close(self) -> None:
        pass


def resume_state(records: DataFrame, session: str = "session_id", ttl_ms: int | None = None) -> DataFrame:
    """Changes of the resume state by a stream of records (session_id, line_no long, type, path, repo_hash, sha, reason).

    Rows of kind ``session`` and ``path`` hold the state as it now is, as ``operators.sessions.resume_state`` has it at the end;
    ``expired`` says that a session was quiet for ``ttl_ms``.  Needs the state store of RocksDB (``ROCKS``).
    """
    rows = records.select(F.col(session).alias("session_id"), F.col("line_no").cast("long").alias("line_no"), "type", "path", "repo_hash", "sha", "reason")
    return rows.groupBy("session_id").transformWithStateInPandas(Replay(ttl_ms), OUT, "Update", "ProcessingTime" if ttl_ms else "None")
