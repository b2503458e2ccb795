"""File and text filters: path rules, size limits, needle sniffing, scan counters, dominant language."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.scalars import line_count
from quarry.sources import languages

#: Fixed values of the scan rules.
SKIP_DIRS = ("__pycache__", ".git", ".venv", "venv", "node_modules", "env", ".env", "tests", "test", "testing", "dist", "build", ".egg-info", ".pytest_cache", ".mypy_cache", ".tox", "mcp")
SKIP_FILES = ("mcp_server.py", "setup.py", "conftest.py", "noxfile.py")
SKIP_PARTS = ("test_", "_test.py", "tests.py")
HEAD_BYTES, MAX_BYTES = 65_536, 2_097_152
COUNT_IGNORES = ("node_modules", ".git", ".venv", "venv", "dist", "build", "__pycache__", "target", "bin", "obj", "vendor")
LANGUAGES = ("python", "typescript", "java", "csharp", "go", "rust")
EXTENSIONS = {end: language for language in LANGUAGES for end in languages.EXTENSIONS[language]}
MARKERS = {"python": ("pyproject.toml", "setup.py", "requirements.txt"), "typescript": ("tsconfig.json", "package.json"), "java": ("pom.xml", "build.gradle"), "go": ("go.mod",), "rust": ("Cargo.toml",)}


def path_verdict(path, extensions=None, dirs=SKIP_DIRS, names=SKIP_FILES, partials=SKIP_PARTS) -> Column:
    """'kept', or the first rule against a relative path: directory, extension, name, partial."""
    path = F.col(path) if isinstance(path, str) else path
    parts = F.split(path, "/")
    name = F.element_at(parts, -1)
    folders = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    bad_dir = F.exists(folders, lambda d: d.isin(*dirs) | d.startswith("."))
    out = F.when(bad_dir, "directory")
    if extensions is not None:
        out = out.when(~F.coalesce(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1).isin(*extensions), F.lit(False)), "extension")
    out = out.when(name.isin(*names), "name")
    for p in partials:
        out = out.when(name.contains(p), "partial")
    return out.otherwise("kept")


def underscore_folder(path) -> Column:
    parts = F.split(F.col(path) if isinstance(path, str) else path, "/")
    return F.exists(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), lambda d: d.startswith("_"))


def within_size(size, max_bytes: int = MAX_BYTES) -> Column:
    return (F.col(size) if isinstance(size, str) else size) <= max_bytes


def sniff(text, needles, extra=(), head: int = HEAD_BYTES) -> Column:
    """Whether a needle (or an extra one) lies in the head; empty needles are ignored.  Bytes or characters, as the column."""
    body = F.col(text) if isinstance(text, str) else text
    top = F.substring(body, 1, head)
    out = F.lit(False)
    for n in [*needles, *extra]:
        if n:
            out = out | F.contains(top, F.lit(n))
    return F.coalesce(out, F.lit(False))


def scan_totals(files: DataFrame, cached: DataFrame, key: str, sha: str, text: str) -> DataFrame:
    """One row: files parsed and replayed (those with the content that the snapshot has), and the lines of both."""
    was = cached.select(F.col(key).alias("_key"), F.col(sha).alias("_sha")).distinct()
    whole = files.select(key, sha, line_count(text).alias("lines")).join(was, F.col(key) == F.col("_key"), "left")
    same = F.coalesce(F.col(sha) == F.col("_sha"), F.lit(False))
    return whole.agg(F.count_if(~same).alias("parsed"), F.count_if(same).alias("unchanged"), F.coalesce(F.sum("lines"), F.lit(0)).cast("long").alias("lines_scanned"))


def scan_counts(files: DataFrame, by: list[str], text: str, needles, head: int = HEAD_BYTES, max_bytes: int = MAX_BYTES) -> DataFrame:
    """Files seen, skipped for size, matched, and lines of the matched ones."""
    small = within_size(F.octet_length(text), max_bytes)
    hit = small & sniff(text, needles, head=head)
    return files.groupBy(*by).agg(
        F.count("*").alias("seen"), F.count_if(~F.coalesce(small, F.lit(True))).alias("skipped"), F.count_if(hit).alias("matched"),
        F.coalesce(F.sum(F.when(hit, line_count(text))), F.lit(0)).cast("long").alias("lines"))


def dominant(rows: DataFrame, by: list[str], label: str, order: list[str], out: str) -> DataFrame:
    """The most frequent label per group; ties go to the first in ``order``, unlisted labels come last by name."""
    place = F.lit(len(order))
    for k, name in enumerate(order):
        place = F.when(F.col(label) == name, k).otherwise(place)
    counted = rows.where(F.col(label).isNotNull()).groupBy(*by, label).agg(F.count("*").alias("n")).withColumn("place", place)
    return counted.groupBy(*by).agg(F.min(F.struct((-F.col("n")).alias("n"), "place", F.col(label).alias("label")))["label"].alias(out))


def detect_language(tree: DataFrame, path: str = "rel_path") -> DataFrame:
    """One row (language): marked languages with files, else any with files, else the first marked; null if none."""
    parts = F.split(F.col(path), "/")
    ignored = F.exists(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), lambda d: d.isin(*COUNT_IGNORES) | d.startswith("."))
    kind = F.create_map(*[F.lit(x) for kv in EXTENSIONS.items() for x in kv])
    counts = tree.where(~ignored).select(kind[F.regexp_extract(path, r"\.([A-Za-z]+)$", 1)].alias("language")).where("language is not null").groupBy("language").agg(F.count("*").alias("n"))
    spark = tree.sparkSession
    marks = spark.createDataFrame([(lang, m) for lang, ms in MARKERS.items() for m in ms], "language string, marker string")
    marked = tree.join(F.broadcast(marks), F.col(path) == F.col("marker")).select("language").distinct().withColumn("marked", F.lit(True))
    known = spark.createDataFrame([(lang, k) for k, lang in enumerate(LANGUAGES)], "language string, place int")
    all_ = known.join(counts, "language", "left").join(marked, "language", "left").withColumn("n", F.coalesce("n", F.lit(0))).withColumn("marked", F.coalesce("marked", F.lit(False)))
    tier = F.when(F.col("marked") & (F.col("n") > 0), 1).when(F.col("n") > 0, 2).when(F.col("marked"), 3)
    return all_.withColumn("tier", tier).where("tier is not null").agg(F.min(F.struct("tier", (-F.col("n")).alias("n"), "place", "language"))["language"].alias("language"))


def frameworks(files: DataFrame, text: str, hints: list[tuple[str, str]], keep: list[str]) -> DataFrame:
    """(keep..., framework, place): each framework of which a hint occurs in the text.  The hints are a literal list."""
    names = list(dict.fromkeys(name for name, _ in hints))
    found = [F.when(F.exists(F.array(*[F.lit(h) for n, h in hints if n == name]), lambda h: F.contains(F.col(text), h)), F.struct(F.lit(name).alias("framework"), F.lit(k).alias("place"))) for k, name in enumerate(names)]
    return files.select(*keep, F.explode(F.array_compact(F.array(*found))).alias("f")).select(*keep, "f.framework", "f.place")


def top_framework(hits: DataFrame, by: list[str], ordinal: str) -> DataFrame:
    """The framework with most files; ties go to the one met first."""
    counted = hits.groupBy(*by, "framework").agg(F.count("*").alias("n"), F.min(F.struct(ordinal, "place")).alias("first"))
    return counted.groupBy(*by).agg(F.min(F.struct((-F.col("n")).alias("m"), "first", "framework", "n")).alias("b")).select(*by, "b.framework", F.col("b.n").alias("files"))


def unique_names(rows: DataFrame, name: str, order: list[str], out: str) -> DataFrame:
    """The second and later uses of a name get _2, _3, ..."""
    n = F.row_number().over(Window.partitionBy(name).orderBy(*order))
    return rows.withColumn(out, F.when(n == 1, F.col(name)).otherwise(F.concat(F.col(name), F.lit("_"), n)))
