"""Source trees as tables: files, documents of a tree, snippets, settings files.

``binaryFile`` prunes the content column, so listings never read files, and pushes size limits to the listing.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import scalars
from quarry.functions.needles import search
from quarry.operators import files
from quarry.sources import languages
from quarry.sources import walk as walk_source

#: With more needles than these one automaton is cheaper than a search for each.
AUTOMATON_FROM = 40
#: Well-known documents, in the order in which they are read.
DOCUMENTS = ("README.md", "README.rst", "README.txt", "README", "CONTEXT.md", "AGENTS.md", "docs/README.md")


def listing(spark: SparkSession, root: str) -> DataFrame:
    """(rel_path, size, modified) of every file; no content is read."""
    top = root.rstrip("/")
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(top)
    plain = F.regexp_replace("path", r"^file:/+", "/")
    cut = F.lit(top.split("://")[-1].replace("file:", ""))
    rel = F.substr(plain, F.instr(plain, cut) + F.length(cut) + 1)
    return found.select(rel.alias("rel_path"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"), "content")


def repo(spark: SparkSession, root: str, extensions: list[str], needles: list[str], extra: list[str] = (), max_bytes: int = files.MAX_BYTES,
         head_only: bool = False, most: int | None = None, pruned: bool = False, inspected: int | None = None) -> DataFrame:
    """Files that pass the path rules, the size limit and the needle sniff, with their hash.

    (rel_path, size, content, sha).  ``head_only`` hashes the head alone; ``most`` bounds the files by path order, ``inspected`` those that are looked into;
    ``pruned`` reads by ``walk.tree``, which does not enter excluded folders.  Many needles are searched by one automaton.
    """
    if pruned:
        found = walk_source.tree(spark, root, walk_source.Rules(extensions=tuple(extensions), max_bytes=max_bytes))
    else:
        found = listing(spark, root).where((F.col("size") <= max_bytes) & (files.path_verdict("rel_path", extensions) == "kept"))
    if inspected is not None:
        found = found.orderBy("rel_path").limit(inspected)
    if len(wanted := [n for n in (*needles, *extra) if n]) > AUTOMATON_FROM:
        found = search(found, "content", wanted, files.HEAD_BYTES, as_column="needle_hits")
        hit = F.size("needle_hits") > 0
    else:
        hit = files.sniff("content", [n.encode() for n in wanted])
    body = F.substring("content", 1, files.HEAD_BYTES) if head_only else F.col("content")
    out = found.where(hit).select("rel_path", "size", "content", F.sha2(body, 256).alias("sha"))
    return out if most is None else out.orderBy("rel_path").limit(most)


def scan(spark: SparkSession, root: str, language: str, functions: bool = False, **more) -> DataFrame:
    """``repo`` with what the library knows of a language."""
    return repo(spark, root, list(languages.EXTENSIONS[language]), list(languages.needles(language, functions)), **more)


def walk(spark: SparkSession, root: str, language: str, most: int | None = None) -> DataFrame:
    """All files of a language outside the folders that its own walk leaves out, without sniffing; ``most`` bounds them by path order."""
    kept = files.path_verdict("rel_path", languages.EXTENSIONS[language], languages.left_out(language), (), ()) == "kept"
    found = listing(spark, root).where(kept).select("rel_path", "size", "content")
    return found if most is None else found.orderBy("rel_path").limit(most)


def tree_lines(paths: DataFrame, path: str = "rel_path") -> DataFrame:
    """(sort_key, depth, line): the tree as lines, folders first, then files, by name; ``orderBy("sort_key")`` prints it."""
    parts = F.split(path, "/")
    # each level sorts by (file or folder, name); a folder line is the prefix of the keys of what is in it
    ups = paths.select(F.explode(F.sequence(F.lit(1), F.size(parts))).alias("depth"), parts.alias("parts")).select(
        "depth", F.slice("parts", 1, "depth").alias("parts"), (F.col("depth") < F.size("parts")).alias("folder")).groupBy("depth", "parts").agg(F.max("folder").alias("folder"))
    key = F.transform("parts", lambda name, k: F.concat(F.when((k + 1 < F.col("depth")) | F.col("folder"), "0").otherwise("1"), name))
    line = F.concat(F.repeat(F.lit("    "), F.col("depth") - 1), F.element_at("parts", -1), F.when(F.col("folder"), "/").otherwise(""))
    return ups.select(key.alias("sort_key"), "depth", line.alias("line"))


def sources(found: DataFrame, language: str) -> DataFrame:
    """What the parsers read: (rel_path, language, module, source)."""
    return found.select("rel_path", F.lit(language).alias("language"), scalars.module_name("rel_path", language).alias("module"), F.decode("content", "utf-8").alias("source"))


def modified_index(spark: SparkSession, root: str, extension: str = "py") -> DataFrame:
    return listing(spark, root).where(F.endswith("rel_path", F.lit(f".{extension}"))).select("rel_path", F.unix_seconds("modified").alias("modified"))


def folders(paths: DataFrame, path: str = "rel_path") -> DataFrame:
    """(folder): every ancestor of every file."""
    parts = F.split(path, "/")
    ups = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    return paths.where(F.size(parts) > 1).select(F.explode(ups).alias("folder")).distinct()


def documents(tree: DataFrame, each: int = 3000, whole: int = 6000) -> DataFrame:
    """The well-known documents of a tree (rel_path, source) within a running budget of characters."""
    place = F.array_position(F.array(*[F.lit(d) for d in DOCUMENTS]), F.col("rel_path"))
    from quarry.operators.sessions import char_budget

    known = tree.where(F.col("rel_path").isin(*DOCUMENTS)).withColumn("place", place).withColumn("one", F.lit(1))
    return char_budget(known, ["one"], ["place"], "source", each, whole).where("taken > 0").select("rel_path", "place", F.expr("substring(source, 1, int(taken))").alias("source"))


def snippets(endpoints: DataFrame, tree: DataFrame, most: int = 3000) -> DataFrame:
    """endpoints with the text of their lines, cut at ``most`` characters."""
    text = F.array_join(F.slice(F.split("source", "\n"), F.col("start_line"), F.greatest(F.col("end_line") - F.col("start_line") + 1, F.lit(0))), "\n")
    return endpoints.join(tree.select(F.col("rel_path").alias("_p"), "source"), F.col("file_path") == F.col("_p"), "left").withColumn(
        "snippet", F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("\n# ..."))).otherwise(F.coalesce(text, F.lit("")))).drop("_p", "source")


def dotenv(lines: DataFrame, line: str = "value") -> DataFrame:
    """(key, value) of KEY=VALUE lines; comments and other lines are skipped, quotes stripped."""
    t: Column = F.trim(line)
    key = F.regexp_extract(t, r"^(?:export\s+)?([A-Za-z_][A-Za-z0-9_]*)\s*=", 1)
    value = F.trim(F.regexp_replace(t, r"^[^=]*=", ""))
    bare = F.regexp_replace(value, r"""^(["'])(.*)\1$""", "$2")
    return lines.where(~t.startswith("#") & (key != "")).select(key.alias("key"), bare.alias("value"))


def free_name(existing: DataFrame, name: str, base: str, ext: str) -> str:
    """<base>_server.<ext>, or with the next free number; one aggregate, one row to the driver."""
    base_, ext_ = re.escape(base), re.escape(ext)
    n = F.regexp_extract(name, rf"^{base_}_server(?:_([0-9]+))?\.{ext_}$", 1)
    hit = F.col(name).rlike(rf"^{base_}_server(?:_[0-9]+)?\.{ext_}$")
    top = existing.where(hit).agg(F.max(F.when(n == "", 1).otherwise(n.try_cast("int")))).first()[0]
    return f"{base}_server.{ext}" if top is None else f"{base}_server_{top + 1}.{ext}"
