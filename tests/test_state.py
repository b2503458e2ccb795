"""Versioned snapshots, a scan that goes on where it stopped, and the replay of the session log as a stream."""

import json
import os
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quarry.operators import changes, sessions
from quarry.plans import parsers
from quarry.sources import ledger, snapshots, trees
from quarry.streaming import replay, scan


def values(df):
    return sorted(r.v for r in df.collect())


def table(spark, *v):
    return spark.createDataFrame([(x,) for x in v], "v int")


def test_versions(spark, tmp_path):
    path = str(tmp_path / "snap")
    assert snapshots.versions(spark, path) == [] and snapshots.latest(spark, path)["version"] == 0
    with pytest.raises(FileNotFoundError):
        snapshots.read(spark, path)
    assert snapshots.write(table(spark, 1, 2), path) == 1
    first = snapshots.read(spark, path)
    assert snapshots.write(first.select((F.col("v") * 10).alias("v")), path, base=1) == 2  # reads and replaces the same snapshot
    assert values(first) == [1, 2] and values(snapshots.read(spark, path)) == [10, 20] and values(snapshots.read(spark, path, 1)) == [1, 2]
    assert snapshots.write(table(spark, 3), path, append=True) == 3 and values(snapshots.read(spark, path)) == [3, 10, 20]
    assert snapshots.write(table(spark), path) == 4 and values(snapshots.read(spark, path)) == []


def test_of_two_writers_one_has_a_conflict(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "snap")
    snapshots.write(table(spark, 1), path)
    with pytest.raises(snapshots.Conflict):
        snapshots.write(table(spark, 2), path, base=0)
    real, raced = snapshots.Files.create, []

    def late(self, name, text):  # another writer commits just before
        if not raced:
            raced.append(name)
            snapshots.write(table(spark, 7), path)
        return real(self, name, text)

    monkeypatch.setattr(snapshots.Files, "create", late)
    with pytest.raises(snapshots.Conflict):
        snapshots.write(table(spark, 8), path, base=1)
    assert values(snapshots.read(spark, path)) == [7] and len(os.listdir(tmp_path / "snap" / "data")) == 2
    raced.clear()
    assert snapshots.write(table(spark, 9), path, append=True) == 4 and values(snapshots.read(spark, path)) == [7, 9]  # without a base it follows


def test_a_killed_writer_leaves_the_old_version(spark, tmp_path):
    path = str(tmp_path / "snap")
    snapshots.write(table(spark, 1), path)
    boom = table(spark, 1, 2).select(F.when(F.col("v") == 2, F.raise_error(F.lit("killed"))).otherwise(F.col("v")).cast("int").alias("v"))
    with pytest.raises(Exception, match="killed"):
        snapshots.write(boom, path)
    (tmp_path / "snap" / "_commits" / snapshots._name(2)).write_text('{"version": 2, "fold')  # killed within the commit file
    assert snapshots.versions(spark, path) == [1] and values(snapshots.read(spark, path)) == [1]
    assert snapshots.write(table(spark, 3), path, base=1) == 3 and values(snapshots.read(spark, path)) == [3]
    snapshots.write(table(spark, 4), path)
    assert snapshots.clean(spark, path, keep=1) == 0 and snapshots.clean(spark, path, keep=1, grace_ms=-5000) >= 2
    assert snapshots.versions(spark, path) == [4] and values(snapshots.read(spark, path)) == [4] and len(os.listdir(tmp_path / "snap" / "data")) == 1


def test_a_cache_is_merged_into_itself(spark, tmp_path):
    path = str(tmp_path / "cache")
    row = lambda p, sha: (p, sha, [], [], "go", "gin", "x", False, 3)
    kinds = f"rel_path string, sha string, endpoints array<{ledger.ENDPOINT}>, functions array<{ledger.FUNCTION}>, language string, framework string, package_import_root string, captured_functions boolean, lines_scanned long"
    assert ledger.write_cache(spark.createDataFrame([row("a", "1"), row("b", "1")], kinds), path, "r", 5) == 1
    old = ledger.read_cache(spark, path, "r")
    new = spark.createDataFrame([row("b", "2"), row("c", "1")], kinds)
    assert ledger.write_cache(old.join(new, "rel_path", "left_anti").unionByName(new), path, "r", 6, base=1) == 2
    assert {r.rel_path: r.sha for r in ledger.read_cache(spark, path, "r").collect()} == {"a": "1", "b": "2", "c": "1"}
    assert changes.usable_cache(ledger.read_cache(spark, path, "r"), F.size("endpoints"), F.size("functions"), False).first() is not None


def test_a_killed_scan_goes_on(spark, tmp_path):
    root, out, mark = tmp_path / "src", str(tmp_path / "out"), str(tmp_path / "mark")
    for k in range(12):
        (root / f"p{k % 3}").mkdir(parents=True, exist_ok=True)
        (root / f"p{k % 3}" / f"m{k}.py").write_text(f"@app.get('/r{k}')\ndef h{k}(): pass\n")
    (root / "tests").mkdir()
    (root / "tests" / "t.py").write_text("@app.get('/no')\ndef t(): pass\n")
    parsed = []

    def dies(rows):
        parsed.append(sorted(r.rel_path for r in rows.select("rel_path").collect()))
        if len(parsed) == 3:
            raise RuntimeError("killed")
        return parsers.extract(rows)

    with pytest.raises(Exception, match="killed"):
        scan.scan(spark, str(root), "python", out, mark, per_batch=4, parse=dies).awaitTermination()
    half = snapshots.read(spark, out).where("kind is null").count()
    assert 0 < half < 12
    scan.scan(spark, str(root), "python", out, mark, per_batch=4, parse=lambda rows: parsed.append(sorted(r.rel_path for r in rows.select("rel_path").collect())) or parsers.extract(rows)).awaitTermination()
    found = snapshots.read(spark, out)
    assert Counter(r.rel_path for r in found.where("kind is null").collect()) == Counter(f"p{k % 3}/m{k}.py" for k in range(12))
    assert sorted(r.path for r in found.where("kind = 'endpoint'").collect()) == sorted(f"/r{k}" for k in range(12))
    assert all(n == 1 for n in Counter(p for k, some in enumerate(parsed) if k != 2 for p in some).values())  # only the killed batch is read again
    want = parsers.extract(trees.sources(trees.scan(spark, str(root), "python"), "python"))
    key = lambda df: sorted((r.rel_path, r.kind, r.method or "", r.path or "", r.start_line) for r in df.where("kind is not null").collect())
    assert key(found) == key(want)
    version = snapshots.latest(spark, out)
    again = max(version["tags"].values())
    assert snapshots.write(found, out, append=True, tag=(mark, again)) == version["version"]  # a batch that comes again changes nothing
    (root / "p0" / "new.py").write_text("@app.get('/new')\ndef n(): pass\n")
    scan.scan(spark, str(root), "python", out, mark, per_batch=4).awaitTermination()
    assert snapshots.read(spark, out).where("kind is null").count() == 13


LOG = [("a", 0, "session_open", None, "r", None, None), ("a", 1, "file_scanned", "x.py", None, "1", None), ("a", 2, "file_scanned", "y.py", None, "1", None), ("a", 3, "session_paused", None, None, None, "first"),
       ("b", 0, "session_open", None, "q", None, None), ("b", 1, "file_skipped", "x.py", None, None, "big"), ("a", 4, "session_open", None, "r2", None, None), ("a", 5, "file_scanned", "x.py", None, "2", None),
       ("b", 2, "session_done", None, None, None, None), ("a", 6, "session_paused", None, None, None, "second"), ("c", 0, "file_scanned", "z", None, "9", None), ("a", 7, "file_skipped", "x.py", None, None, "gone")]
FIELDS = ("session_id", "line_no", "type", "path", "repo_hash", "sha", "reason")
KINDS = "session_id string, line_no long, type string, path string, repo_hash string, sha string, reason string"


def test_replay_as_a_stream(spark, tmp_path):
    was = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", replay.ROCKS)
    try:
        (tmp_path / "in").mkdir()
        order = [0, 6, 10, 3, 7, 4, 1, 2, 5, 9, 8, 11]  # late records, over two runs
        state, paths = {}, {}

        def keep(batch, _):
            for r in batch.collect():
                if r.kind == "session":
                    state[r.session_id] = (r.repo_hash, r.paused, r.completed, r.scanned, r.skipped)
                elif r.kind == "path":
                    paths[r.session_id, r.path] = (r.sha, r.skip_reason)

        for run, part in enumerate((order[:5], order[5:])):
            for k, at in enumerate(part):
                (tmp_path / "in" / f"{run}-{k}.json").write_text(json.dumps(dict(zip(FIELDS, LOG[at], strict=True))))
            stream = spark.readStream.schema(KINDS).option("maxFilesPerTrigger", 3).json(str(tmp_path / "in"))
            replay.resume_state(stream).writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", str(tmp_path / "mark")).trigger(availableNow=True).start().awaitTermination()
        one, each = sessions.resume_state(spark.createDataFrame(LOG, KINDS))
        assert state == {r.session_id: (r.repo_hash, r.paused, r.completed, r.scanned, r.skipped) for r in one.collect()}
        assert paths == {(r.session_id, r.path): (r.sha, r.skip_reason) for r in each.collect()}
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", was)


def test_quiet_sessions_expire(spark, tmp_path):
    was = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", replay.ROCKS)
    try:
        (tmp_path / "in").mkdir()
        gone, seen = [], []

        def keep(batch, _):
            rows = batch.collect()
            gone.extend(r.session_id for r in rows if r.kind == "expired")
            seen.extend(r.session_id for r in rows if r.kind == "session")

        for k, record in enumerate((LOG[0], LOG[4])):
            (tmp_path / "in" / f"{k}.json").write_text(json.dumps(dict(zip(FIELDS, record, strict=True))))
        stream = spark.readStream.schema(KINDS).json(str(tmp_path / "in"))
        running = replay.resume_state(stream, ttl_ms=1000).writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", str(tmp_path / "mark")).trigger(processingTime="1 second").start()
        for _ in range(60):
            running.awaitTermination(1)
            if len(gone) == 2:
                break
        running.stop()
        assert sorted(gone) == ["a", "b"] and sorted(seen) == ["a", "b"]
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", was)


def test_snapshot_records_and_manifest(spark, tmp_path):
    end, fun = {"method": "GET", "path": "/a"}, {"module": "m", "qualname": "f", "is_async": True}
    kinds = f"rel_path string, sha string, endpoints array<{ledger.ENDPOINT}>, functions array<{ledger.FUNCTION}>"
    pad = lambda d, kind: tuple(d.get(c.split(":")[0]) for c in kind.removeprefix("struct<").removesuffix(">").replace("array<struct<key:string,value:string>>", "x").split(","))
    old = spark.createDataFrame([("a", "1", [pad(end, ledger.ENDPOINT)] * 2, [pad(fun, ledger.FUNCTION)]), ("b", "1", [], []), ("gone", "1", [], [])], kinds)
    ends, functions = ledger.manifest(old)
    assert [(r.rel_path, r.ord, r.path) for r in ends.orderBy("ord").collect()] == [("a", 0, "/a"), ("a", 1, "/a")] and [(r.qualname, r.is_async) for r in functions.collect()] == [("f", True)]
    assert ledger.manifest(old, functions=False)[1].count() == 0
    ledger.append(ledger.scanned_records(old, "s1", 77), str(tmp_path))
    log = ledger.read(spark, str(tmp_path))
    one, paths = sessions.resume_state(log)
    assert one.first().scanned == 3 and {r.path: r.sha for r in paths.collect()} == {"a": "1", "b": "1", "gone": "1"}
    more = spark.createDataFrame([("b", "2", [pad(end, ledger.ENDPOINT)], [])], kinds)
    ledger.append(ledger.scanned_records(more, "s2", 78), str(tmp_path))
    again = ledger.read(spark, str(tmp_path)).where("session_id = 's2'")
    whole = ledger.snapshot_of(again, old, old.where("rel_path <> 'gone'"), language="go", lines_scanned=5)
    assert {(r.rel_path, r.sha, len(r.endpoints), len(r.functions), r.language, r.lines_scanned) for r in whole.collect()} == {("a", "1", 2, 1, "go", 5), ("b", "2", 1, 0, "go", 5)}
    ledger.write_cache(whole.withColumn("lines_scanned", F.col("lines_scanned").cast("long")), str(tmp_path / "cache"), "r", 9)
    assert ledger.read_cache(spark, str(tmp_path / "cache"), "r").count() == 2
