"""Failing shards, bounded attempts, and the description of a project."""

import json
import time

import pandas as pd
from pyspark.sql import functions as F

from quarry.plans import attempts, project


def test_shards_fail_alone(spark):
    rows = spark.createDataFrame([(f"f{k}", k) for k in range(70)], "name string, ord int")

    def scorer(part: pd.DataFrame) -> pd.DataFrame:
        first = int(part["ord"].min())
        if first == 12:
            raise ValueError("no")
        if first == 24:
            time.sleep(600)
        if first == 36:
            return pd.DataFrame({"name": ["else"], "band": ["HIGH"]})
        return pd.DataFrame({"name": part["name"], "band": ["HIGH" if n % 2 else "odd" for n in part["ord"]]})

    began = time.perf_counter()
    whole, outcomes = attempts.classified(rows, "name", [F.col("ord")], scorer, size=12, shards=5, seconds=3)
    assert {r.shard: (r.outcome, r.detail) for r in outcomes.collect()} == {0: ("ok", None), 1: ("failed", "ValueError"), 2: ("timeout", None), 3: ("invalid", "DataFrame"), 4: ("ok", None)}
    assert {r.name: r.band for r in whole.collect()} == {f"f{k}": "HIGH" if k % 2 and (k < 12 or 48 <= k < 60) else "LOW" for k in range(70)}
    assert time.perf_counter() - began < 100


def test_attempts_are_bounded(spark):
    rows = spark.createDataFrame([(k, k % 4 + 1) for k in range(40)], "id int, need int")
    seen = []

    def generate(pending, n):
        seen.append({r.id: list(r.issues) for r in pending.collect()})
        return pending.where("id <> 7").select("id", F.concat(F.lit(f"body {n} needs "), "need").alias("made"))

    def check(made):
        short = F.regexp_extract("made", r"body (\d+)", 1).cast("int") < F.regexp_extract("made", r"needs (\d+)", 1).cast("int")
        return made.where(short).select("id", F.explode(F.array(F.lit("too short"), F.lit("too short"), F.lit("again"))).alias("issue"))

    got = {r.id: r for r in attempts.attempted(rows, "id", generate, check).collect()}
    assert len(got) == 40
    for k in range(40):
        need = k % 4 + 1
        if k == 7:
            assert (got[k].made, got[k].attempt, got[k].accepted, got[k].issues) == (None, 3, False, ["nothing was made"])
        else:
            assert (got[k].attempt, got[k].accepted, got[k].issues) == (min(need, 3), need < 4, [] if need < 4 else ["again", "too short"])
    assert [len(s) for s in seen] == [40, 30, 20] and set(map(tuple, seen[0].values())) == {()} and seen[1][1] == ["again", "too short"] and seen[1][7] == ["nothing was made"]
    assert len({r.id for r in attempts.attempted(rows.limit(0), "id", generate, check).collect()}) == 0


FILES = {
    "app/core.py": 'import os, sys\nimport os\nfrom .util import x\nclass Cat(Base, metaclass=M):\n    """A cat.\n    More."""\n    def purr(self): pass\n    async def run(self): pass\nclass Dog: pass\nasync def go(a: int, b=1, *args, c, **kw) -> Dict[str, int]:\n    \'Goes.\'\n    import late\ndef plain(): pass\n',
    "app/empty.py": "import os\n", "app/sub/deep.py": "\n".join(f"import m{k}" for k in range(13)) + "\ndef f(): pass\n", "app/bad.py": "def (", "main.go": "package main\nfunc main() {}\n", "web/x.js": "1\n2\n", "web/y.rb": "1", "README.md": "x", "zed.py": "def z(): pass",
}


def test_project_text_and_statistics(spark, tmp_path):
    paths = spark.createDataFrame(list(FILES.items()), "rel_path string, source string")
    found = project.modules(paths.where("rel_path like '%.py'"))
    project.save(paths, found, str(tmp_path / "out"), "demo")
    text = "".join(p.read_text() for p in sorted((tmp_path / "out" / "project_schema").glob("part-*"))).removesuffix("\n").split("\n")
    assert text[:6] == ["=" * 80, "PROJECT SCHEMA", "=" * 80, "", "DIRECTORY STRUCTURE:", "-" * 80]
    assert text[6:19] == ["├── app/", "│   ├── sub/", "│   │   └── deep.py", "│   ├── bad.py", "│   ├── core.py", "│   └── empty.py", "├── web/", "│   ├── x.js", "│   └── y.rb", "├── README.md", "├── main.go", "└── zed.py", ""]
    rest = text[19:]
    assert rest[:4] == ["=" * 80, "MODULE DETAILS:", "=" * 80, ""]
    assert rest[4:13] == ["Module: deep", "File: app/sub/deep.py", "-" * 80, "Imports: " + ", ".join(f"m{k}" for k in range(10)), "  ... and 3 more", "", "Functions (1):", "  • f() -> Any", ""]
    assert rest[13:] == ["", "Module: core", "File: app/core.py", "-" * 80, "Imports: os, sys, .util, late", "", "Classes (2):", "  • Cat(Base, metaclass=M) [line 4]", "    A cat.", "    Methods: purr, run", "  • Dog [line 9]", "",
                         "Functions (2):", "  • async go(a, b, *args, c, **kw) -> Dict[str, int]", "    Goes.", "  • plain() -> Any", "", "", "Module: zed", "File: zed.py", "-" * 80, "Functions (1):", "  • z() -> Any", "", ""]
    told = json.loads("".join(p.read_text() for p in (tmp_path / "out" / "statistics").glob("part-*")))
    assert told == {"project_name": "demo", "directory_count": 4, "file_count": 6, "total_lines_analyzed": 13 + 1 + 14 + 1 + 2 + 1, "module_count": 3, "class_count": 2, "function_count": 4, "method_count": 2, "total_callable_count": 6,
                    "languages": {"Go": 1, "Python": 5}, "unsupported_languages": {"JavaScript": 1, "Ruby": 1}}
    assert {(r.name, r.file, r.classes, r.functions, r.imports) for r in spark.read.json(str(tmp_path / "out" / "modules")).collect()} == {("deep", "app/sub/deep.py", 0, 1, 13), ("core", "app/core.py", 2, 2, 4), ("zed", "zed.py", 0, 1, 0)}


def test_a_long_text_is_in_order_in_many_parts(spark, tmp_path):
    was = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        lines = spark.range(5000).select(F.lit(1).alias("part"), F.array(F.format_string("%06d", (F.col("id") * 7919) % 5000)).alias("key"), F.lit(0).alias("n"), F.format_string("%06d", (F.col("id") * 7919) % 5000).alias("line"))
        project.write_text(lines, str(tmp_path / "t"))
        parts = sorted((tmp_path / "t").glob("part-*"))
        text = "".join(p.read_text() for p in parts).split()
        assert len(parts) > 2 and text == [f"{k:06d}" for k in range(5000)]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", was)


def test_empty_project(spark):
    paths = spark.createDataFrame([], "rel_path string, source string")
    found = project.modules(paths)
    assert project.schema_lines(paths.select("rel_path"), found).count() == 11
    row = project.statistics(paths, found, "e").first()
    assert (row.directory_count, row.file_count, row.total_callable_count, row.languages) == (1, 0, 0, {})


def test_settings_files_are_layered(spark, tmp_path):
    from quarry.sources import settings

    (tmp_path / "p.json").write_text('{"llm": {"model": "a", "deep": {"x": 1, "y": null}, "empty": {}, "over": {"z": 1}}, "plain": 1.50, "list": [1, {"k": 2}], "blank": " "}')
    (tmp_path / "g.json").write_text('{"llm": {"model": "b", "deep": {"x": 2, "y": [3], "w": true}, "over": 5}, "blank": "g", "plain": {"inner": 1}}')
    (tmp_path / "bad.json").write_text('{"llm": ')
    (tmp_path / "list.json").write_text("[1]")
    docs = settings.read(spark, {str(tmp_path / n): k for k, n in enumerate(("p.json", "none.json", "bad.json", "list.json", "g.json"))})
    got = {".".join(r.path): (r.value, r.kind, r.layer.rpartition("/")[2]) for r in settings.layered(docs).collect()}
    assert got == {"llm.model": ('"a"', "STRING", "p.json"), "llm.deep.x": ("1", "BIGINT", "p.json"), "llm.deep.y": ("[3]", "ARRAY<BIGINT>", "g.json"), "llm.deep.w": ("true", "BOOLEAN", "g.json"), "llm.empty": ("{}", "OBJECT<>", "p.json"),
                   "llm.over.z": ("1", "BIGINT", "p.json"), "plain": ("1.5", got["plain"][1], "p.json"), "list": ('[1,{"k":2}]', got["list"][1], "p.json"), "blank": ('"g"', "STRING", "g.json")}
    lacks = {r.layer.rpartition("/")[2]: r.m for r in docs.select("layer", settings.missing(docs, ["llm.deep.y", "llm.model", "plain.inner", "no"]).alias("m")).collect()}
    assert lacks == {"p.json": ["llm.deep.y", "plain.inner", "no"], "bad.json": ["llm.deep.y", "llm.model", "plain.inner", "no"], "list.json": ["llm.deep.y", "llm.model", "plain.inner", "no"], "g.json": ["no"]}
    assert settings.layered(settings.read(spark, {str(tmp_path / "none"): 1})).count() == 0


def test_json_equality(spark):
    from quarry.functions import scalars

    cases = [('{"a":1,"b":[1,2]}', ' { "a" : 1.0 , "b":[ 1e0,2] }\n', True), ('{"a":1,"b":2}', '{"b":2,"a":1}', False), ('{"a":"1 2"}', '{"a":"12"}', False), ('{"a":"x1.0"}', '{"a":"x1"}', False), (None, "null", True), (None, None, True),
             ('[1,2]', '[2,1]', False), ('{"a":{"b":1},"b":{"a":1}}', '{"b":{"a":1},"a":{"b":1}}', False), ('"q\\"1"', '"q\\"1"', True), ("bad {", "bad {", True), ("bad {", "bad  {", False), ("[-0.5,10]", "[-5e-1, 1E+1]", True), ("true", "true ", True), ("1", '"1"', False)]
    rows = spark.createDataFrame(cases, "a string, b string, same boolean")
    assert [tuple(r) for r in rows.where(scalars.same_json("a", "b") != F.col("same")).collect()] == []


def test_endpoints_are_named_in_batches(spark):
    rows = spark.createDataFrame([(k, f"r{k // 40}", f"own{k}", "was") for k in range(70)], "ord int, repo string, suggested_tool_name string, description string")

    def namer(part):
        first = int(part["ord"].iloc[0])
        if first == 30:
            time.sleep(600)
        if first == 40:
            return "nothing"
        return pd.DataFrame({"index": [0, 1, 2, 99, -1, 1], "tool_name": ["zero", "one", "", "far", "back", "last"], "description": ["a", "b", "c", "d", "e", "f"]})

    got = {r.ord: (r.suggested_tool_name, r.description) for r in attempts.named(rows, ["repo"], ["ord"], namer, seconds=2).collect()}
    assert got == {k: {0: ("zero", "a"), 1: ("last", "f")}.get(k, (f"own{k}", "was")) for k in range(70)}


def test_batches_of_a_task_share_a_process(spark):
    import os
    from datetime import datetime

    kinds = "ord long, repo string, suggested_tool_name string, description string, size int, tags array<string>, at timestamp"
    # 300 batches; a group without a name is one too, and a null in one batch does not change the numbers of another
    rows = spark.createDataFrame([(2**53 + k, None if k % 3 == 0 else f"r{k % 3}", f"own{k}", None, None if k == 5 else k, [f"t{k}"], datetime(2024, 1, 1, k % 24) if k % 2 else None) for k in range(1200)], kinds)

    def namer(part):
        place = int(part["ord"].iloc[0] - 2**53)
        if place == 1 + 3 * 40:
            os._exit(1)
        if place == 1 + 3 * 80:
            time.sleep(600)
        if place == 1 + 3 * 120:
            raise SystemExit
        return pd.DataFrame({"index": part["index"], "tool_name": [f"n{o}" for o in part["ord"]], "description": [f"{os.getpid()} {s} {t[0]}" for s, t in zip(part["size"], part["tags"], strict=True)]})

    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")  # batches begin in one record batch and end in another
    try:
        out = attempts.named(rows, ["repo"], ["ord"], namer, size=4, seconds=2)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert [(f.name, f.dataType) for f in out.schema] == [(f.name, f.dataType) for f in rows.schema]
    got, was = {r.ord - 2**53: r for r in out.collect()}, {r.ord - 2**53: r for r in rows.collect()}
    assert out.count() == len(got) == 1200 and all((got[k].repo, got[k].size, got[k].tags, got[k].at) == (was[k].repo, was[k].size, was[k].tags, was[k].at) for k in was)
    lost = {1 + 3 * (b + i) for b in (40, 80, 120) for i in range(4)}
    assert {k for k in got if got[k].suggested_tool_name == f"own{k}" and got[k].description is None} == lost
    named = {k: got[k].description.split() for k in got if k not in lost}
    with_null = {5 - 3 * ((5 // 3) % 4) + 3 * i for i in range(4)}
    assert all(got[k].suggested_tool_name == f"n{2**53 + k}" and (named[k][1:] == [str(k), f"t{k}"] or k in with_null) for k in named)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert 1 < len({n[0] for n in named.values()}) <= tasks + 4  # two calls each of two batches cost a process
