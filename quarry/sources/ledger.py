"""The session log (JSON lines) and the snapshot of a scan: readers, writers, retention."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.sources import snapshots

ENDPOINT = "struct<method:string,path:string,handler_module:string,handler_qualname:string,description:string,payload_example:string,headers_hint:array<struct<key:string,value:string>>,suggested_tool_name:string,file_path:string,start_line:int,end_line:int>"
FUNCTION = "struct<module:string,qualname:string,signature:string,docstring:string,is_async:boolean,is_public:boolean,file_path:string,start_line:int,end_line:int>"
#: One wide record for all types; ``functions`` stays text since its form depends on the type.
RECORD = f"type string, session_id string, mode string, repo_hash string, working_dir string, cli_version string, started_at long, deadline_at long, path string, sha string, endpoints array<{ENDPOINT}>, functions string, scanned_at long, elapsed_ms long, reason string, at long, shard_id int, name string, purpose string, confidence double, cursor string, note string, endpoints_count int, functions_count int, code string, stage string, message string, hint string, technical string, missing_fields array<string>"
TERMINAL = {"session_done": "done", "session_paused": "paused", "session_error": "errored"}
VERSION = 3


APPENDED = "appended-"


def read(spark: SparkSession, path: str) -> DataFrame:
    """Records of all logs below ``path``, with session (the record's, else the file's name), order and modification time.

    ``line_no`` orders the records of a session: a log's own lines by their place in the file, then what ``append`` added,
    in the order of the appends.  Logs are split like any text, so their size does not matter; bad and blank lines are skipped.
    """
    found = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json*").text(path)
    file = F.col("_metadata.file_path")
    later = F.regexp_extract(file, rf"/{APPENDED}(\d+)/", 1)
    place = F.struct(later.alias("appended"), file.alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    name = F.regexp_replace(F.element_at(F.split(file, "/"), -1), r"\.json.*$", "")
    lines = found.select("value", name.alias("file_session"), place.alias("line_no"), F.col("_metadata.file_modification_time").alias("modificationTime"), F.col("_metadata.file_size").alias("file_size"))
    parsed = lines.where(F.trim("value") != "").withColumn("r", F.from_json("value", RECORD))
    return parsed.where("r.type is not null").select(F.coalesce("r.session_id", "file_session").alias("session_id"), "line_no", "modificationTime", "file_size", *[
        f"r.{c.split()[0]}" for c in ("type x", "mode x", "repo_hash x", "started_at x", "path x", "sha x", "endpoints x", "functions x", "scanned_at x", "reason x", "at x", "endpoints_count x", "functions_count x", "code x", "message x")])


def append(records: DataFrame, path: str) -> None:
    """Append records (with their session_id) as JSON lines in a folder of their own, which ``read`` finds.

    Spark writes whole files, so readers never see half a record; appends are ordered by the time of the call, and the
    records of one append by their order in ``records``.  No length cap.
    """
    records.write.mode("error").json(f"{path.rstrip('/')}/{APPENDED}{time.time_ns():020d}")


def counts(ledger: DataFrame) -> DataFrame:
    """Per session: scanned, skipped, endpoints and functions found."""
    n = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    scanned = F.col("type") == "file_scanned"
    functions = F.when(scanned, F.size(F.from_json("functions", f"array<{FUNCTION}>")))
    return ledger.groupBy("session_id").agg(F.count_if(scanned).alias("scanned"), F.count_if(F.col("type") == "file_skipped").alias("skipped"),
                                            n(F.when(scanned, F.greatest(F.size("endpoints"), F.lit(0)))).alias("endpoints"), n(F.greatest(functions, F.lit(0))).alias("functions"))


def expired(ledger: DataFrame, now_ms: int, repo_hash: str, days: int = 30) -> DataFrame:
    """Sessions of a repository whose log is older than the limit, with its size; the caller deletes them."""
    old = F.unix_millis("modificationTime") <= now_ms - days * 86_400_000
    files = ledger.groupBy("session_id", "line_no.file").agg(F.max("modificationTime").alias("modificationTime"), F.max("file_size").alias("size"), F.max("repo_hash").alias("repo_hash"))
    return files.groupBy("session_id").agg(F.max("modificationTime").alias("modificationTime"), F.max("repo_hash").alias("repo_hash"), F.sum("size").alias("bytes")).where(
        old & (F.col("repo_hash") == repo_hash))


HEAD = "version int, repo_hash string, language string, framework string, package_import_root string, captured_functions boolean, lines_scanned long, updated_at long"
CACHE = f"{HEAD}, files map<string, struct<sha:string,endpoints:array<{ENDPOINT}>,functions:array<{FUNCTION}>>>"
COLUMNS = ("rel_path", "sha", "endpoints", "functions", "language", "framework", "package_import_root", "captured_functions", "lines_scanned")


def read_cache(spark: SparkSession, path: str, repo_hash: str) -> DataFrame:
    """(rel_path, sha, endpoints, functions, language, framework, ...): empty if any part of the snapshot is wrong.

    A path that ends in ``.json`` is one document with a map of files; any other is what ``write_cache`` wrote, of which
    the last version is read.
    """
    if not path.endswith(".json"):
        return _checked(snapshots.read(spark, path), repo_hash)
    one = spark.read.schema(CACHE).option("multiLine", "true").option("mode", "PERMISSIVE").json(path)
    rows = one.where("files is not null").select("*", F.explode_outer("files").alias("rel_path", "f")).select(*one.columns[:-1], "rel_path", "f.sha", "f.endpoints", "f.functions")
    return _checked(rows, repo_hash)


def _checked(rows: DataFrame, repo_hash: str) -> DataFrame:
    """The files of a snapshot of this version and repository; none if one of its rows is not whole."""
    head = (F.col("version") == VERSION) & (F.col("repo_hash") == repo_hash) & F.col("language").isNotNull()
    file = F.col("rel_path").isNull() | F.col("sha").isNotNull() & F.col("endpoints").isNotNull() & F.col("functions").isNotNull()
    bad = rows.where(~F.coalesce(head & file, F.lit(False))).limit(1).agg((F.count("*") > 0).alias("_bad"))
    return rows.join(F.broadcast(bad)).where(~F.col("_bad") & F.col("rel_path").isNotNull()).select(*COLUMNS)


def write_cache(table: DataFrame, path: str, repo_hash: str, now_ms: int, base: int | None = None) -> int:
    """Write a snapshot, one row per file, with the columns that ``read_cache`` gives, and give its version.

    ``table`` may be made from the version before; ``base`` as in ``snapshots.write``.
    """
    return snapshots.write(table.select(*COLUMNS).withColumns({"version": F.lit(VERSION), "repo_hash": F.lit(repo_hash), "updated_at": F.lit(now_ms).cast("long")}), path, base)


def manifest(cache: DataFrame, functions: bool = True) -> tuple[DataFrame, DataFrame]:
    """The endpoints and the functions of a snapshot, one row each; without ``functions`` the second table is empty."""
    ends = cache.select("rel_path", F.posexplode("endpoints").alias("ord", "e")).select("rel_path", "ord", "e.*")
    kept = cache if functions else cache.where(F.lit(False))
    return ends, kept.select("rel_path", F.posexplode("functions").alias("ord", "f")).select("rel_path", "ord", "f.*")


def scanned_records(cache: DataFrame, session_id: str, updated_at: int) -> DataFrame:
    """A snapshot as the records of a session that has scanned its files, which ``append`` writes and a resumed run replays."""
    return cache.select(F.lit(session_id).alias("session_id"), F.lit("file_scanned").alias("type"), F.col("rel_path").alias("path"), "sha", "endpoints", F.to_json("functions").alias("functions"),
                        F.lit(updated_at).cast("long").alias("scanned_at"), F.lit(0).cast("long").alias("elapsed_ms"))


def snapshot_of(ledger: DataFrame, previous: DataFrame, seen: DataFrame, **head) -> DataFrame:
    """The next snapshot: the last scan of every path of a session's log, and of the snapshot before what was seen but not scanned again.

    ``head``: language, framework, package_import_root, captured_functions, lines_scanned of the new snapshot.
    """
    from quarry.operators.changes import merge_snapshot

    scan = ledger.where("type = 'file_scanned' and path is not null").groupBy(F.col("path").alias("rel_path")).agg(F.max_by(F.struct("sha", "endpoints", "functions"), "line_no").alias("s"))
    empty = lambda c, kind: F.coalesce(c, F.array().cast(f"array<{kind}>"))
    scan = scan.select("rel_path", "s.sha", empty(F.col("s.endpoints"), ENDPOINT).alias("endpoints"), empty(F.from_json("s.functions", f"array<{FUNCTION}>"), FUNCTION).alias("functions"))
    whole = merge_snapshot(previous.select(*scan.columns), seen.select("rel_path"), scan, "rel_path")
    given = {c: F.lit(head.get(c)) for c in COLUMNS[4:]}
    return whole.withColumns(given).select(*COLUMNS)
