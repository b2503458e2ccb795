"""The description of a project as text and statistics: its tree, its modules, and counts.

Lines are rows with a key; the text is written in the order of the keys by range partitions, so a text of any size is
in order without one task that holds it.
"""

from __future__ import annotations

import ast

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.scalars import line_count
from quarry.plans.parsers import Source

#: Languages by extension, those that are read and those that are only named.
SUPPORTED = {"py": "Python", "ts": "TypeScript", "tsx": "TypeScript", "java": "Java", "cs": "C#", "go": "Go", "rs": "Rust"}
UNSUPPORTED = {"js": "JavaScript", "jsx": "JavaScript", "mjs": "JavaScript", "cjs": "JavaScript", "php": "PHP", "rb": "Ruby", "kt": "Kotlin", "kts": "Kotlin", "scala": "Scala", "swift": "Swift", "c": "C", "h": "C/C++",
               "cc": "C++", "cpp": "C++", "cxx": "C++", "hpp": "C++", "m": "Objective-C", "ex": "Elixir", "exs": "Elixir", "dart": "Dart", "lua": "Lua"}
WIDE, THIN, IMPORTS, PREVIEW = "=" * 80, "-" * 80, 10, 60
FUNCTION = pa.struct([("name", pa.string()), ("parameters", pa.list_(pa.string())), ("returns", pa.string()), ("is_async", pa.bool_()), ("docstring", pa.string())])
CLASS = pa.struct([("name", pa.string()), ("bases", pa.list_(pa.string())), ("line", pa.int32()), ("docstring", pa.string()), ("methods", pa.list_(pa.string()))])
MODULE = [("rel_path", pa.string()), ("module", pa.string()), ("parse_ok", pa.bool_()), ("imports", pa.list_(pa.string())), ("classes", pa.list_(CLASS)), ("functions", pa.list_(FUNCTION))]
DDL = ("rel_path string, module string, parse_ok boolean, imports array<string>, classes array<struct<name:string,bases:array<string>,line:int,docstring:string,methods:array<string>>>, "
       "functions array<struct<name:string,parameters:array<string>,returns:string,is_async:boolean,docstring:string>>")


def module_of(source: str | None, path: str) -> dict:
    """Imports at any depth, classes and functions at the top of a Python file; a file that does not parse has none."""
    out = {"rel_path": path, "module": path.rpartition("/")[2].removesuffix(".py"), "parse_ok": True, "imports": [], "classes": [], "functions": []}
    try:
        tree, text = ast.parse(source or ""), Source(source or "")
        imports: dict[str, None] = {}
        todo = [tree]
        while todo:
            n = todo.pop()
            if isinstance(n, ast.Import):
                imports |= dict.fromkeys(a.name for a in n.names)
            elif isinstance(n, ast.ImportFrom):
                imports["." * n.level + (n.module or "")] = None
            todo.extend(reversed(list(ast.iter_child_nodes(n))))
        out["imports"] = list(imports)
        for n in tree.body:
            if isinstance(n, ast.ClassDef):
                own = [f.name for f in n.body if isinstance(f, ast.FunctionDef | ast.AsyncFunctionDef)]
                out["classes"].append({"name": n.name, "bases": [text.of(b) for b in [*n.bases, *n.keywords]], "line": n.lineno, "docstring": text.docstring(n), "methods": own})
            elif isinstance(n, ast.FunctionDef | ast.AsyncFunctionDef):
                a = n.args
                names = [x.arg for x in (*a.posonlyargs, *a.args)] + ([f"*{a.vararg.arg}"] if a.vararg else []) + [x.arg for x in a.kwonlyargs] + ([f"**{a.kwarg.arg}"] if a.kwarg else [])
                out["functions"].append({"name": n.name, "parameters": names, "returns": text.of(n.returns) if n.returns else "Any", "is_async": isinstance(n, ast.AsyncFunctionDef), "docstring": text.docstring(n)})
    except (Exception, MemoryError):  # whatever a file holds, the others are described
        out |= {"parse_ok": False, "imports": [], "classes": [], "functions": []}
    return out


def modules(files: DataFrame) -> DataFrame:
    """files (rel_path, source) to one row per file: module, imports, classes and functions."""

    def run(batches):
        for batch in batches:
            found = [module_of(s, p or "") for p, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_pylist(found, schema=pa.schema(MODULE))

    return files.select("rel_path", "source").mapInArrow(run, DDL)


def tree(paths: DataFrame, path: str = "rel_path") -> DataFrame:
    """(sort_key, line) of the tree, folders before files, by name, with lines that join what is in one folder."""
    parts = F.split(path, "/")
    nodes = paths.select(F.explode(F.sequence(F.lit(1), F.size(parts))).alias("depth"), parts.alias("parts")).select(
        F.slice("parts", 1, "depth").alias("parts"), (F.col("depth") < F.size("parts")).alias("folder")).groupBy("parts").agg(F.max("folder").alias("folder"))
    depth = F.size("parts")
    nodes = nodes.select("parts", "folder", F.array_join(F.slice("parts", 1, depth - 1), "/").alias("parent"), F.concat(F.when(F.col("folder"), "0").otherwise("1"), F.element_at("parts", -1)).alias("own"))
    last = nodes.groupBy("parent").agg(F.max("own").alias("last"))
    nodes = nodes.join(last, "parent").select("parts", "folder", (F.col("own") == F.col("last")).alias("is_last"))
    # what stands before a line says of each folder above whether it is its folder's last entry
    ups = nodes.select("parts", "folder", "is_last", F.explode(F.sequence(F.lit(1), depth)).alias("up")).withColumn("above", F.slice("parts", 1, "up"))
    ends = nodes.where("folder").select(F.col("parts").alias("above"), F.col("is_last").alias("ends"))
    piece = F.struct("up", F.when(F.col("up") == depth, F.when(F.col("is_last"), "└── ").otherwise("├── ")).when(F.col("ends"), "    ").otherwise("│   ").alias("t"))
    lines = ups.join(ends, "above", "left").groupBy("parts", "folder").agg(F.sort_array(F.collect_list(piece)).alias("lead"))
    key = F.transform("parts", lambda name, k: F.concat(F.when((k + 1 < depth) | F.col("folder"), "0").otherwise("1"), name))
    return lines.select(key.alias("sort_key"), F.concat(F.array_join(F.col("lead")["t"], ""), F.element_at("parts", -1), F.when(F.col("folder"), "/").otherwise("")).alias("line"))


def _preview(docstring: Column) -> Column:
    return F.when(docstring != "", F.array(F.concat(F.lit("    "), F.substring(F.split(docstring, "\n")[0], 1, PREVIEW)))).otherwise(F.array().cast("array<string>"))


def _module_lines() -> Column:
    line = lambda *x: F.array(F.concat(*[F.lit(c) if isinstance(c, str) else c for c in x]))
    none = F.array().cast("array<string>")
    some = lambda c, lines: F.when(F.size(c) > 0, lines).otherwise(none)
    imports = F.concat(line("Imports: ", F.array_join(F.slice("imports", 1, IMPORTS), ", ")),
                       F.when(F.size("imports") > IMPORTS, line("  ... and ", (F.size("imports") - IMPORTS).cast("string"), " more")).otherwise(none), line(""))
    one_class = lambda c: F.concat(line("  • ", c["name"], F.when(F.size(c["bases"]) > 0, F.concat(F.lit("("), F.array_join(c["bases"], ", "), F.lit(")"))).otherwise(""), " [line ", c["line"].cast("string"), "]"),
                                   _preview(c["docstring"]), some(c["methods"], line("    Methods: ", F.array_join(c["methods"], ", "))))
    one_function = lambda f: F.concat(line("  • ", F.when(f["is_async"], "async ").otherwise(""), f["name"], "(", F.array_join(f["parameters"], ", "), ") -> ", f["returns"]), _preview(f["docstring"]))
    return F.concat(line("Module: ", F.col("module")), line("File: ", F.col("rel_path")), line(THIN), some("imports", imports),
                    some("classes", F.concat(line("Classes (", F.size("classes").cast("string"), "):"), F.flatten(F.transform("classes", one_class)), line(""))),
                    some("functions", F.concat(line("Functions (", F.size("functions").cast("string"), "):"), F.flatten(F.transform("functions", one_function)), line(""))), line(""))


def schema_lines(paths: DataFrame, found: DataFrame) -> DataFrame:
    """(part, key, n, line): the tree of ``paths`` and what ``found`` (``modules``) has; in the order of (part, key, n) they are the text.

    Modules come in the order of the tree; one without classes and functions is left out.
    """
    empty = F.array().cast("array<string>")
    given = lambda part, lines: paths.sparkSession.range(1).select(F.lit(part).alias("part"), empty.alias("key"), F.posexplode(F.array(*[F.lit(x) for x in lines])).alias("n", "line"))
    head = given(0, [WIDE, "PROJECT SCHEMA", WIDE, "", "DIRECTORY STRUCTURE:", THIN])
    middle = given(2, ["", WIDE, "MODULE DETAILS:", WIDE, ""])
    body = tree(paths).select(F.lit(1).alias("part"), F.col("sort_key").alias("key"), F.lit(0).alias("n"), "line")
    parts = F.split("rel_path", "/")
    key = F.transform(parts, lambda name, k: F.concat(F.when(k + 1 < F.size(parts), "0").otherwise("1"), name))
    told = found.where((F.size("classes") > 0) | (F.size("functions") > 0)).select(F.lit(3).alias("part"), key.alias("key"), F.posexplode(_module_lines()).alias("n", "line"))
    return head.unionByName(body).unionByName(middle).unionByName(told)


def write_text(lines: DataFrame, path: str, order: tuple[str, ...] = ("part", "key", "n")) -> None:
    """Text files whose concatenation by name is the text; every file is a range of the order."""
    lines.orderBy(*order).select("line").write.mode("error").text(path)


def _language(path: str, known: dict[str, str]) -> Column:
    extension = F.regexp_extract(F.element_at(F.split(path, "/"), -1), r".\.([A-Za-z0-9]+)$", 1)
    return F.create_map(*[F.lit(x) for kv in known.items() for x in kv])[extension]


def statistics(paths: DataFrame, found: DataFrame, name: str, text: str = "source") -> DataFrame:
    """One row of counts: folders (with the root), files and lines of the supported languages, modules, classes, functions, methods, languages.

    ``paths``: (rel_path, source) of all files.  Maps of languages have as many entries as there are languages.
    """
    from quarry.sources.trees import folders

    each = paths.select(_language("rel_path", SUPPORTED).alias("language"), _language("rel_path", UNSUPPORTED).alias("other"), line_count(F.col(text)).alias("lines"))
    per = each.groupBy("language", "other").agg(F.count("*").alias("n"), F.sum("lines").alias("lines"))
    pairs = lambda c: F.coalesce(F.map_from_entries(F.sort_array(F.collect_list(F.when(F.col(c).isNotNull(), F.struct(c, "n"))))), F.create_map().cast("map<string,bigint>"))
    total = lambda c: F.coalesce(F.sum(F.when(F.col("language").isNotNull(), F.col(c))), F.lit(0)).cast("long")
    by_file = per.agg(total("n").alias("file_count"), total("lines").alias("total_lines_analyzed"), pairs("language").alias("languages"), pairs("other").alias("unsupported_languages"))
    sums = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    methods = F.aggregate("classes", F.lit(0), lambda a, c: a + F.size(c["methods"]))
    by_module = found.agg(F.count_if((F.size("classes") > 0) | (F.size("functions") > 0)).alias("module_count"), sums(F.size("classes")).alias("class_count"), sums(F.size("functions")).alias("function_count"), sums(methods).alias("method_count"))
    dirs = folders(paths).agg((F.count("*") + 1).alias("directory_count"))
    one = dirs.join(F.broadcast(by_file)).join(F.broadcast(by_module))  # one row each
    return one.select(F.lit(name).alias("project_name"), "directory_count", "file_count", "total_lines_analyzed", "module_count", "class_count", "function_count", "method_count",
                      (F.col("function_count") + F.col("method_count")).alias("total_callable_count"), "languages", "unsupported_languages")


def module_counts(found: DataFrame) -> DataFrame:
    """The statistics of each module that has something."""
    return found.where((F.size("classes") > 0) | (F.size("functions") > 0)).select(
        F.col("module").alias("name"), F.col("rel_path").alias("file"), F.size("classes").alias("classes"), F.size("functions").alias("functions"), F.size("imports").alias("imports"))


def save(paths: DataFrame, found: DataFrame, folder: str, name: str, text: str = "source") -> None:
    """``project_schema`` (text), ``statistics`` (one JSON row) and ``modules`` (a JSON row for each) below a folder."""
    write_text(schema_lines(paths.select("rel_path"), found), f"{folder}/project_schema")
    statistics(paths, found, name, text).coalesce(1).write.json(f"{folder}/statistics")
    module_counts(found).write.json(f"{folder}/modules")
