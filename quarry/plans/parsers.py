"""Parsers of source files, run in Arrow batches by one mapInPandas-like stage; a file that fails gives no rows.

Python is parsed with the standard library's ``ast``; the other languages by ``grammars``.  The registry maps a language to ``parse(source, rel_path, module) -> list of row dicts`` and takes further languages.
"""

from __future__ import annotations

import ast
import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.plans import grammars
from quarry.plans.grammars import _row

FIELDS = ("kind", "method", "path", "module", "qualname", "signature", "docstring", "payload", "start_line", "end_line", "is_async", "is_public", "ord")
SCHEMA = "rel_path string, language string, parse_ok boolean, kind string, method string, path string, module string, qualname string, signature string, docstring string, payload string, start_line int, end_line int, is_async boolean, is_public boolean, ord int"
REGISTRY: dict = {}
VERBS = "get|post|put|patch|delete"


def register(language: str):
    def add(f):
        REGISTRY[language] = f
        return f

    return add


#: Annotations that are no request body.
NO_BODY = frozenset("Request Response BackgroundTasks Depends Header Query Path Cookie Form File UploadFile HTTPException str int float bool None Optional List Dict Any datetime date UUID".split())
#: Examples of request fields by a part of their type.
EXAMPLES = (("int", 0), ("float", 0.0), ("bool", False), ("list", []), ("List", []), ("dict", {}), ("Dict", {}))


class Source:
    """Text of syntax nodes, from lines that are split once."""

    def __init__(self, source: str):
        self.lines = [x.encode() for x in re.split(r"(?<=\n)|(?<=\r)(?!\n)", source)]

    def of(self, node) -> str:
        a, b = node.lineno - 1, node.end_lineno - 1
        if a == b:
            return self.lines[a][node.col_offset : node.end_col_offset].decode()
        return b"".join([self.lines[a][node.col_offset :], *self.lines[a + 1 : b], self.lines[b][: node.end_col_offset]]).decode()

    def first_line(self, node) -> str:
        return self.lines[node.lineno - 1][node.col_offset :].decode().rstrip("\r\n").strip()

    def docstring(self, node) -> str:
        """The first statement if it is a string, without its quotes, trimmed; other lines keep their indent."""
        first = node.body[0] if node.body else None
        if not (isinstance(first, ast.Expr) and isinstance(first.value, ast.Constant) and isinstance(first.value.value, str)):
            return ""
        raw = self.of(first.value)
        for quote in ('"""', "'''", '"', "'"):
            if raw.startswith(quote) and raw.endswith(quote) and len(raw) >= 2 * len(quote):
                raw = raw[len(quote) : -len(quote)]
                break
        return raw.strip()[:500]


def _model_fields(cls: ast.ClassDef, text: Source) -> dict:
    """Fields of a class with a default or an example by type."""
    out = {}
    for n in cls.body:
        if not (isinstance(n, ast.AnnAssign) and isinstance(n.target, ast.Name)):
            continue
        name, kind = n.target.id, text.of(n.annotation)
        if name.startswith("_") or name == "model_config" or "ClassVar" in kind:
            continue
        given = n.value
        if isinstance(given, ast.Constant) and given.value is not ...:
            out[name] = given.value
        elif given is not None and not (isinstance(given, ast.Constant) or text.of(given).startswith("Field(")):
            out[name] = 0 if "int" in kind else ""
        else:
            out[name] = next((x for part, x in EXAMPLES if part in kind), "")
    return out


def _body_example(f, path: str, models: dict, text: Source):
    """The fields of the first parameter that is a class of this file, and neither in the path nor the framework's."""
    inside = set(re.findall(r"\{(\w+)\}", path))
    for a in [*f.args.posonlyargs, *f.args.args, *f.args.kwonlyargs]:
        if a.annotation is None or a.arg == "self" or a.arg in inside:
            continue
        kind = re.sub(r"Optional\[([^\]]+)\]", r"\1", text.of(a.annotation)).strip()
        if kind not in NO_BODY and not kind.startswith("Annotated") and models.get(kind):
            return json.dumps(models[kind])
    return None


def decorator_simple(text: str) -> str:
    found = re.match(r"@?\s*(?:[A-Za-z_]\w*\s*\.\s*)*([A-Za-z_]\w*)", text)
    return found[1] if found else ""


def _python_route(text: str):
    """(method, path) of a decorator's text: a verb with a path, or a route with the first of its listed methods."""
    path = re.search(r"\(\s*[\"']([^\"']+)[\"']", text)
    name = decorator_simple(text).lower()
    if not path:
        return None
    if name in VERBS.split("|"):
        return name.upper(), path[1]
    if name in ("route", "api_route"):
        listed = re.search(r"(?i)methods\s*=\s*\[\s*[\"'](\w+)[\"']", text)
        method = listed[1].upper() if listed else "GET"
        return method if method.lower() in VERBS.split("|") else "GET", path[1]
    return None


@register("python")
def parse_python(source: str, rel_path: str, module: str) -> list[dict]:
    tree, text, out, imported = ast.parse(source), Source(source), [], set()
    models = {n.name: _model_fields(n, text) for n in ast.walk(tree) if isinstance(n, ast.ClassDef)}
    todo = [(n, "", True) for n in reversed(list(ast.iter_child_nodes(tree)))]  # node, class around it, top level
    while todo:
        n, inside, top = todo.pop()
        within, go = inside, True
        if isinstance(n, ast.FunctionDef | ast.AsyncFunctionDef):
            common = {"signature": text.first_line(n), "docstring": text.docstring(n), "is_async": isinstance(n, ast.AsyncFunctionDef)}
            route = next((r for d in n.decorator_list if (r := _python_route(text.of(d)))), None)
            private = n.name.startswith("_")
            if route and not private:
                method, path = route
                payload = None if method in ("GET", "DELETE") else _body_example(n, path, models, text)
                out.append(_row("endpoint", module, n.name, n.lineno, n.end_lineno, method=method, path=path, payload=payload, **common))
            if not route and not private and not inside:
                out.append(_row("function", module, n.name, n.lineno, n.end_lineno, **common))
            go = not n.decorator_list  # what a decorated function holds is not looked at
            top = False
        elif isinstance(n, ast.ClassDef):
            if top:
                out.append(_row("class", module, n.name, n.lineno, n.end_lineno, docstring=text.docstring(n), signature=", ".join(text.of(b) for b in n.bases)))
                out.extend(_row("method", module, f"{n.name}.{f.name}", f.lineno, f.end_lineno, signature=text.first_line(f), docstring=text.docstring(f), is_async=isinstance(f, ast.AsyncFunctionDef))
                           for f in n.body if isinstance(f, ast.FunctionDef | ast.AsyncFunctionDef))
            within, top = n.name, False
        elif isinstance(n, ast.Import | ast.ImportFrom):
            base = getattr(n, "module", None) or ""
            for a in n.names:
                if (base, a.name) not in imported:
                    imported.add((base, a.name))
                    out.append(_row("import", base, a.name, n.lineno, n.end_lineno))
        if go:
            todo.extend((c, within, top and isinstance(n, ast.If | ast.Try)) for c in reversed(list(ast.iter_child_nodes(n))))
    return out


REGISTRY |= grammars.PARSERS


def extract(files: DataFrame) -> DataFrame:
    """files (rel_path, language, module, source) to one row per endpoint, function, class or import, numbered per file."""
    kinds = pa.schema([("rel_path", pa.string()), ("language", pa.string()), ("parse_ok", pa.bool_()), *[(f, pa.int32() if f in ("start_line", "end_line", "ord") else pa.bool_() if f.startswith("is_") else pa.string()) for f in FIELDS]])

    def run(batches):
        for batch in batches:
            rows = []
            for path, language, module, source in zip(*(batch.column(c).to_pylist() for c in ("rel_path", "language", "module", "source")), strict=True):
                parse = REGISTRY.get(language)
                try:
                    found = parse(source or "", path or "", module or "") if parse else []
                except (Exception, MemoryError):  # whatever a file holds, the scan goes on
                    rows.append({"rel_path": path, "language": language, "parse_ok": False})
                    continue
                rows += [{"rel_path": path, "language": language, "parse_ok": True, **r, "ord": k} for k, r in enumerate(found)]
            yield pa.RecordBatch.from_pylist(rows, schema=kinds)

    return files.select("rel_path", "language", "module", "source").mapInArrow(run, SCHEMA)


_PIECE = re.compile(r'"(?:[^"\\]|\\.)*+(?:"|\Z)|[{}]', re.DOTALL)


def _strict(text: str):
    def no_constant(name):
        raise ValueError(name)

    return json.loads(text, parse_constant=no_constant)


def first_object(text: str | None) -> str | None:
    """The object from the first brace to the one that closes it, braces in strings aside; null if that is no JSON."""
    text, depth = text or "", 0
    start = text.find("{")
    if start < 0:
        return None
    for m in _PIECE.finditer(text, start):
        depth += {"{": 1, "}": -1}.get(m[0], 0)
        if depth == 0:
            try:
                _strict(text[start : m.end()])
            except (ValueError, RecursionError):
                return None
            return text[start : m.end()]
    return None


def reply_object(text: str | None) -> str | None:
    """A blank reply is {}; JSON is taken if it is an object; else the first object in the prose."""
    text = (text or "").strip()
    if not text:
        return "{}"
    try:
        return text if isinstance(_strict(text), dict) else None
    except (ValueError, RecursionError):
        return first_object(text)


def recover_json(rows: DataFrame, text: str, out: str) -> DataFrame:
    """rows with the JSON object of a reply, as text."""
    at = rows.columns.index(text)

    def run(batches):
        for batch in batches:
            found = [reply_object(t) for t in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.string())], names=[*batch.schema.names, out])

    return rows.mapInArrow(run, rows.limit(0).withColumn(out, F.lit(None).cast("string")).schema)
