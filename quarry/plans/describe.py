"""Descriptions of Python files: code chunks, functions with their parameters, and checks of generated bodies and files.

All run in Arrow batches; a file that does not parse gives one row with ``parse_ok`` false.
"""

from __future__ import annotations

import ast

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators.candidates import DECORATORS, LIFECYCLE, PREFIXES
from quarry.operators.changes import ALLOWED_CALLS
from quarry.plans.parsers import Source, decorator_simple

FUNCTION = ast.FunctionDef | ast.AsyncFunctionDef


def _parsed(source: str | None):
    return ast.parse(source or ""), Source(source or "")


def chunks_of(source: str | None) -> list[dict]:
    """Every function and class at any depth, with its whole code, from the top down."""
    tree, text = _parsed(source)
    out, todo = [], [tree]
    while todo:
        n = todo.pop()
        if isinstance(n, FUNCTION | ast.ClassDef):
            out.append({"kind": "class" if isinstance(n, ast.ClassDef) else "function", "name": n.name, "signature": text.first_line(n), "code": text.of(n),
                        "start_line": n.lineno, "end_line": n.end_lineno})
        todo.extend(reversed(list(ast.iter_child_nodes(n))))
    return out


def functions_of(source: str | None) -> list[dict]:
    """Candidate functions (by name and decorators) with parameters, types and defaults, and a rebuilt signature."""
    tree, text = _parsed(source)
    out, todo = [], [tree]
    while todo:
        n = todo.pop()
        todo.extend(reversed(list(ast.iter_child_nodes(n))))
        if not isinstance(n, FUNCTION):
            continue
        decorators = [decorator_simple(text.of(d)) for d in n.decorator_list]
        low = n.name.lower()
        if low.startswith(("_", "test", *PREFIXES)) or n.name in LIFECYCLE or low in LIFECYCLE or any(d.lower() in DECORATORS for d in decorators):
            continue
        a = n.args
        plain = [*a.posonlyargs, *a.args]
        given = [*[None] * (len(plain) - len(a.defaults)), *a.defaults]
        rows = [("", x, d) for x, d in zip(plain, given, strict=True)] + ([("*", a.vararg, None)] if a.vararg else [])
        rows += [("", x, d) for x, d in zip(a.kwonlyargs, a.kw_defaults, strict=True)] + ([("**", a.kwarg, None)] if a.kwarg else [])
        names = [p + x.arg for p, x, _ in rows]
        types = [text.of(x.annotation) if x.annotation else "" for _, x, _ in rows]
        defaults = [text.of(d) if d is not None else None for *_, d in rows]
        shown = [m + (f": {t}" if t else "") + (f" = {d}" if d is not None else "") for m, t, d in zip(names, types, defaults, strict=True) if m not in ("self", "cls")]
        returns = text.of(n.returns) if n.returns else ""
        awaits = isinstance(n, ast.AsyncFunctionDef)
        kind = next((k for d in decorators if (k := {"route": "flask"}.get(d) or ("fastapi" if d in ("get", "post", "put", "delete", "patch", "api_route") else None))), None)
        out.append({"name": n.name, "signature": f"{'async ' if awaits else ''}def {n.name}({', '.join(shown)}){f' -> {returns}' if returns else ''}", "docstring": text.docstring(n),
                    "return_type": returns, "is_async": awaits, "start_line": n.lineno, "param_names": names, "param_types": types, "param_defaults": defaults,
                    "endpoint_type": kind or ("method" if {"self", "cls"} & set(names) else "function")})
    return out


def body_issues(body: str | None, known: set[str], allowed=frozenset(ALLOWED_CALLS)) -> list[dict]:
    """What is wrong with a generated function body: it does not parse, holds a function, or calls an unknown name."""
    lines = "\n".join("    " + x for x in (body or "").split("\n"))
    try:
        tree = ast.parse(f"def _wrapper():\n{lines if lines.strip() else '    pass'}\n")
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return [{"kind": "syntax_error", "detail": "the body does not parse"}]
    out, todo = [], [tree]
    while todo:
        n = todo.pop()
        todo.extend(reversed(list(ast.iter_child_nodes(n))))
        if isinstance(n, FUNCTION) and n.name != "_wrapper":
            out.append({"kind": "inline_helper", "detail": n.name})
        elif isinstance(n, ast.Call) and isinstance(n.func, ast.Name) and n.func.id not in known and n.func.id not in allowed:
            out.append({"kind": "unknown_callee", "detail": n.func.id})
    return out


def _kinds(fields: dict[str, pa.DataType]) -> str:
    names = {pa.string(): "string", pa.int32(): "int", pa.bool_(): "boolean", pa.list_(pa.string()): "array<string>"}
    return ", ".join(f"{k} {names[t]}" for k, t in fields.items())


CHUNK = {"kind": pa.string(), "name": pa.string(), "signature": pa.string(), "code": pa.string(), "start_line": pa.int32(), "end_line": pa.int32()}
INFO = {"name": pa.string(), "signature": pa.string(), "docstring": pa.string(), "return_type": pa.string(), "is_async": pa.bool_(), "start_line": pa.int32(),
        "param_names": pa.list_(pa.string()), "param_types": pa.list_(pa.string()), "param_defaults": pa.list_(pa.string()), "endpoint_type": pa.string()}


def _described(files: DataFrame, of, fields: dict[str, pa.DataType]) -> DataFrame:
    kinds = pa.schema([("rel_path", pa.string()), ("parse_ok", pa.bool_()), *fields.items(), ("ord", pa.int32())])

    def run(batches):
        for batch in batches:
            rows = []
            for path, source in zip(batch.column("rel_path").to_pylist(), batch.column("source").to_pylist(), strict=True):
                try:
                    rows += [{"rel_path": path, "parse_ok": True, **r, "ord": k} for k, r in enumerate(of(source))]
                except (Exception, MemoryError):  # whatever a file holds, the others are described
                    rows.append({"rel_path": path, "parse_ok": False})
            yield pa.RecordBatch.from_pylist(rows, schema=kinds)

    return files.select("rel_path", "source").mapInArrow(run, f"rel_path string, parse_ok boolean, {_kinds(fields)}, ord int")


def chunks(files: DataFrame) -> DataFrame:
    """files (rel_path, source) to one row per function and class at any depth, with its code."""
    return _described(files, chunks_of, CHUNK)


def function_info(files: DataFrame) -> DataFrame:
    """files (rel_path, source) to one row per candidate function, with parameters, types and defaults."""
    return _described(files, functions_of, INFO)


def audited(bodies: DataFrame, functions: DataFrame, key: str, body: str, name: str) -> DataFrame:
    """(key, kind, detail): what is wrong with each body.

    Calls are found in tasks; which of them are known is an anti join, so the list of functions is not sent around.
    """
    kinds = f"{key} {bodies.schema[key].dataType.simpleString()}, kind string, detail string"

    def run(batches):
        for batch in batches:
            rows = [(k, i["kind"], i["detail"]) for k, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for i in body_issues(b, set())]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], batch.schema.field(0).type), *[pa.array([r[k] for r in rows], pa.string()) for k in (1, 2)]], names=[key, "kind", "detail"])

    found = bodies.select(key, body).mapInArrow(run, kinds)
    known = functions.select(F.col(name).alias("_known")).distinct()
    return found.join(known, (F.col("kind") == "unknown_callee") & (F.col("detail") == F.col("_known")), "left_anti")


def verified(files: DataFrame, items: DataFrame, root: str) -> DataFrame:
    """(rel_path, check, detail): generated files that do not parse, or import what a module under the root does not have."""
    from quarry.operators.changes import import_audit
    from quarry.plans.parsers import extract

    rows = extract(files.select("rel_path", F.lit("python").alias("language"), F.lit("").alias("module"), "source"))
    broken = rows.where("not parse_ok").select("rel_path", F.lit("parse").alias("check"), F.lit("the file does not parse").alias("detail"))
    imports = rows.where("kind = 'import' and module <> ''").select("rel_path", F.col("module").alias("m"), F.col("qualname").alias("q"))
    bad = import_audit(imports, items.select(F.col("module").alias("m"), F.col("qualname").alias("q")), "m", "q", root)
    return broken.unionByName(bad.select("rel_path", F.lit("import_audit").alias("check"), F.concat_ws(" ", "reason", "m", "q").alias("detail")))
