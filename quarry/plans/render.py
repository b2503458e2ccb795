"""Rendering of manifests and tools as text, with expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry.functions import scalars


def wire(columns: list[str], clips: dict[str, int] | None = None, optional: tuple[str, ...] = ()) -> Column:
    """A JSON object: nulls stay unless the column is optional; long strings are clipped."""
    clips = clips or {}
    value = lambda c: (scalars.clip(c, clips[c]) if c in clips else F.col(c)).alias(c)
    needed = F.to_json(F.struct(*[value(c) for c in columns if c not in optional]), {"ignoreNullFields": "false"})
    if not optional:
        return needed
    extra = F.to_json(F.struct(*[value(c) for c in optional]))
    return F.when(extra == "{}", needed).otherwise(F.concat(F.regexp_replace(needed, r"\}$", ","), F.regexp_replace(extra, r"^\{", "")))


def tool(name, params, types, purpose, body) -> Column:
    """A Python function; a blank body returns ok."""
    body = F.col(body) if isinstance(body, str) else body
    text = F.when(F.trim(F.coalesce(body, F.lit(""))) == "", F.lit('return {"ok": True}')).otherwise(body)
    head = F.concat(F.lit("def "), scalars.identifier(name), F.lit("("), scalars.typed_parameters(params, types), F.lit("):"))
    doc = F.concat(F.lit('    """'), F.replace(F.col(purpose) if isinstance(purpose, str) else purpose, F.lit('"""'), F.lit("'''")), F.lit('"""'))
    return F.concat_ws("\n", head, doc, scalars.indent(text, 4))


def _quoted(text: Column) -> Column:
    """A JSON string."""
    return F.regexp_replace(F.to_json(F.array(text)), r"^\[|\]$", "")


def endpoint_tool(name, method, path, description, payload, headers, base: str = "ENDPOINT_BASE_URL") -> Column:
    """A Python function that forwards a call to an endpoint; its parameters are those of the path, then the payload's keys."""
    c = lambda x: F.col(x) if isinstance(x, str) else x
    name, method, path, description, payload, headers = map(c, (name, method, path, description, payload, headers))
    none = F.array().cast("array<string>")
    keys = F.when(F.upper(method).isin("GET", "DELETE"), none).otherwise(F.coalesce(F.json_object_keys(F.when(F.trim(payload).startswith("{"), payload)), none))
    params = F.array_distinct(F.concat(scalars.path_parameters(path), keys))
    variable = lambda h: F.regexp_extract(h["value"], r"\$\{([A-Z_][A-Z0-9_]*)\}", 1)
    line = lambda h: F.concat(F.lit("        "), _quoted(h["key"]), F.lit(": "), F.when(variable(h) != "", F.concat(F.lit("os.environ.get("), _quoted(variable(h)), F.lit(', "")'))).otherwise(_quoted(h["value"])))
    lines = F.array_join(F.transform(headers, line), ",\n")
    block = F.when(F.coalesce(F.size(headers), F.lit(0)) > 0, F.concat(F.lit("    headers = {\n"), lines, F.lit("\n    }\n"))).otherwise("    headers = {}\n")
    sent = F.when(F.size(keys) > 0, F.concat(F.lit("    payload = {"), F.array_join(F.transform(keys, lambda k: F.concat(_quoted(k), F.lit(": "), k)), ", "), F.lit("}\n"))).otherwise("")
    about = F.when(F.coalesce(description, F.lit("")) != "", description).otherwise(F.concat_ws(" ", method, path))
    return F.concat(
        F.lit("@mcp.tool(name="), _quoted(name), F.lit(", description="), _quoted(about), F.lit(")\ndef "), name, F.lit("("),
        F.array_join(F.transform(params, lambda p: F.concat(p, F.lit(": Any = None"))), ", "), F.lit(") -> dict:\n"),
        F.lit(f'    url = f"{{os.environ[\'{base}\']}}'), path, F.lit('"\n'), block, sent,
        F.lit("    resp = requests."), F.lower(method), F.lit("(url, headers=headers"), F.when(F.size(keys) > 0, ", json=payload").otherwise(""), F.lit(")\n"),
        F.lit('    resp.raise_for_status()\n    try:\n        return resp.json()\n    except ValueError:\n        return {"status_code": resp.status_code, "text": resp.text}\n'))


def server(endpoints: DataFrame, title: str, order: str = "ord", base: str = "ENDPOINT_BASE_URL") -> DataFrame:
    """One row (source, variables): a server of one tool per endpoint, in order; equal names get _2, _3, ...

    endpoints: method, path, description, payload, headers, name and the order.  One file is one row, as it must be.
    """
    from quarry.operators.files import unique_names

    raw = F.when(F.coalesce("name", F.lit("")) != "", F.col("name")).otherwise(F.concat_ws("_", "method", "path"))
    named = unique_names(endpoints.withColumn("_raw", scalars.identifier(raw)), "_raw", [order], "_tool")
    tool_text = endpoint_tool("_tool", "method", "path", "description", "payload", "headers", base)
    used = scalars.header_variables(F.transform("headers", lambda h: h["value"]))
    rows = named.select(F.struct(F.col(order).alias("o"), tool_text.alias("text"), F.coalesce(used, F.array().cast("array<string>")).alias("used")).alias("t"))
    whole = rows.agg(F.sort_array(F.collect_list("t")).alias("t"))
    variables = F.array_distinct(F.concat(F.array(F.lit(base)), F.flatten(F.transform("t", lambda x: x["used"]))))
    head = F.concat(F.lit('"""Forwards calls to an API.  Set '), F.array_join("variables", ", "), F.lit(' before running."""\nfrom __future__ import annotations\n\nimport os\nfrom typing import Any\n\n'
                    'import requests\nfrom mcp.server.fastmcp import FastMCP\n\nmcp = FastMCP('), _quoted(F.lit(title)), F.lit(")\n\n\n"))
    tools = F.array_join(F.transform("t", lambda x: x["text"]), "\n\n")
    return whole.withColumn("variables", variables).select(F.concat(head, tools, F.lit('\n\n\nif __name__ == "__main__":\n    mcp.run()\n')).alias("source"), "variables")
