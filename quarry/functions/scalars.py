"""Scalar column functions (strings, numbers, dates, hashes, JSON, arrays, versions).

All are built-in expressions, so they stay inside whole-stage code generation.  Lengths are in code points.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ELLIPSIS = "…"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def clip(text, n: int) -> Column:
    """At most n characters, an ellipsis where something was cut off; null becomes empty."""
    t = F.coalesce(_c(text), F.lit(""))
    return F.when(F.length(t) > n, F.concat(F.substring(t, 1, n), F.lit(ELLIPSIS))).otherwise(t)


def truncate(text, n: int) -> Column:
    return F.substring(_c(text), 1, n)


def line_count(text) -> Column:
    """Newlines, and one for an unterminated last line; empty and null texts have none."""
    t = F.coalesce(_c(text), F.lit(""))
    newlines = F.length(t) - F.length(F.replace(t, F.lit("\n"), F.lit("")))
    return (newlines + F.when((t == "") | F.endswith(t, F.lit("\n")), 0).otherwise(1)).cast("long")


def last_segment(text, by: str = ".") -> Column:
    return F.substring_index(_c(text), by, -1)


def display_name(text) -> Column:
    """snake_case to words with a capital first letter; the rest of a word stays as it is."""
    words = F.filter(F.split(_c(text), "_"), lambda w: w != "")
    return F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1 << 20))), " ")


def mask_key(text, shown: int = 5, width: int = 20) -> Column:
    t = _c(text)
    return F.when(F.coalesce(t, F.lit("")) == "", "(not set)").otherwise(F.rpad(F.substring(t, 1, shown), width, "*"))


def indent(text, by: int) -> Column:
    """Indent non-blank lines."""
    return F.regexp_replace(_c(text), r"(?m)^(?=[^\n])", " " * by)


def literal_pattern(text) -> Column:
    return F.regexp_replace(_c(text), r"([\\^$.|?*+()\[\]{}])", r"\\$1")


def word_pattern(name) -> str:
    """A word between ASCII boundaries, whatever the engine's idea of a word character."""
    return rf"(?<![A-Za-z0-9_]){name}(?![A-Za-z0-9_])"


def slug(path, parameter: str, becomes: str) -> Column:
    """Lower-case words of a route joined by underscores; parameters are rewritten first."""
    t = F.regexp_replace(_c(path), r"^/+|/+$", "")
    t = F.regexp_replace(t, parameter, becomes)
    return F.lower(F.regexp_replace(F.regexp_replace(t, r"[^a-zA-Z0-9]+", "_"), r"_+", "_"))


#: Verb words, and handler names that say nothing.
VERBS = {"GET": "get", "POST": "create", "PUT": "update", "PATCH": "patch"}
GENERIC = {
    "python": ("handler", "handle", "index", "root", "endpoint", "view", "func"),
    "typescript": ("handler", "handle", "index", "root", "endpoint", "default"),
    "other": ("handler", "handle", "index", "root", "endpoint"),
}
PARAMETERS = {"python": (r"\{([^}]+)\}", "by_$1"), "java": (r"\{[^}]+\}", "by_param"), "csharp": (r"\{[^}]+\}", "by_param")}


def tool_name(method, path, handler, language: str = "other", width: int = 60) -> Column:
    """The handler's name unless it is generic; else a verb and the route's slug."""
    method, handler = _c(method), F.coalesce(_c(handler), F.lit(""))
    generic = GENERIC.get(language, GENERIC["other"])
    parameter, becomes = PARAMETERS.get(language, (r":[^/]+", "by_param"))
    verb = F.lit("delete")
    for name, word in VERBS.items():
        verb = F.when(method == name, word).otherwise(verb)
    base = slug(path, parameter, becomes)
    fallback = handler if language == "python" else F.when(handler != "", handler).otherwise("route")
    made = F.concat(verb, F.lit("_"), F.when(base != "", base).otherwise(fallback))
    named = ~F.lower(handler).isin(*generic)
    if language != "python":
        named = named & (handler != "")
    return F.substring(F.when(named, handler).otherwise(made), 1, width)


def identifier(text) -> Column:
    """A valid lower-case identifier: runs of other characters become one underscore, none at the ends; a leading digit gets one before it."""
    t = F.regexp_replace(F.lower(F.trim(_c(text))), r"[^a-z0-9_]+", "_")
    t = F.regexp_replace(t, r"^_+|_+$", "")
    t = F.when(t == "", "tool").otherwise(t)
    return F.when(t.rlike("^[0-9]"), F.concat(F.lit("_"), t)).otherwise(t)


def path_parameters(path) -> Column:
    return F.regexp_extract_all(_c(path), F.lit(r"\{([a-zA-Z_][A-Za-z0-9_]*)\}"), F.lit(1))


def environment_names(text) -> Column:
    """Names in os.getenv("X") calls, each once, in order."""
    return F.array_distinct(F.regexp_extract_all(_c(text), F.lit(r"""os\.getenv\(["']([A-Z_][A-Z0-9_]*)["']"""), F.lit(1)))


def header_variables(values) -> Column:
    """The first ${NAME} of each header value, each once, in order."""
    found = F.transform(_c(values), lambda v: F.regexp_extract(v, r"\$\{([A-Z_][A-Z0-9_]*)\}", 1))
    return F.array_distinct(F.filter(found, lambda v: v != ""))


def confidence_band(x) -> Column:
    return F.when(_c(x) >= 0.8, "HIGH").when(_c(x) >= 0.5, "MEDIUM").otherwise("LOW")


def backoff_seconds(attempt, base: float = 0.4, most: float = 20.0, retry_after=None, least: float = 0.05) -> Column:
    """Capped exponential delay without jitter, at least ``least``; a server's wish wins, capped as well."""
    wait = F.greatest(F.least(F.lit(base) * F.pow(F.lit(2.0), _c(attempt) - 1), F.lit(most)), F.lit(least))
    if retry_after is not None:
        wait = F.when(_c(retry_after).isNotNull(), F.least(_c(retry_after).cast("double"), F.lit(most))).otherwise(wait)
    return wait


def lines_delta(total, baseline) -> Column:
    return F.greatest(_c(total) - _c(baseline), F.lit(0).cast("long"))


def human_number(n) -> Column:
    n = _c(n)
    return F.when(n >= 1_000_000, F.concat(F.format_string("%.1f", n / 1_000_000), F.lit("M"))).when(
        n >= 1_000, F.concat(F.format_string("%.1f", n / 1_000), F.lit("K"))).otherwise(n.cast("string"))


def remaining(most, used) -> Column:
    return F.greatest(F.lit(0).cast("long"), _c(most) - _c(used))


def relative_time(ms_ago) -> Column:
    """Age in seconds, minutes, hours or days; the unit goes by the milliseconds, which are rounded once."""
    ms = _c(ms_ago)
    part = lambda size, u: F.concat(F.floor(ms / size + 0.5).cast("string"), F.lit(f"{u} ago"))
    return F.when(ms < 60_000, part(1000, "s")).when(ms < 3_600_000, part(60_000, "m")).when(ms < 86_400_000, part(3_600_000, "h")).otherwise(part(86_400_000, "d"))


def deadline_ms(started_ms, minutes=None, least_ms: int = 30_000, default: float = 15) -> Column:
    """Start plus the cap: minutes, fifteen if not given, never under half a minute."""
    cap = F.lit(default) if minutes is None else F.coalesce(_c(minutes), F.lit(default))
    return _c(started_ms) + F.greatest(cap * 60_000, F.lit(least_ms)).cast("long")


def day_part(iso) -> Column:
    return F.substring(_c(iso), 1, 10)


def check_due(now_ms, checked_ms, every_ms: int = 86_400_000) -> Column:
    """Whether the last check is a day old, or never was."""
    return F.coalesce(_c(now_ms) - _c(checked_ms) >= every_ms, F.lit(True))


def redacted(key) -> Column:
    """A key for display: five characters, never more."""
    return mask_key(F.substring(_c(key), 1, 5))


def same_json(a, b) -> Column:
    """Equality of JSON texts as values: the order of keys matters; blanks and how a number is spelled do not.  Null is JSON's null.

    What is no JSON is compared as it is written.
    """
    string, number = r'"(?:[^"\\]|\\.)*+"', r"-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?"

    def parts(c):
        bare = F.regexp_replace(c, rf"({string})|\s+", "$1")
        found = F.filter(F.regexp_extract_all(bare, F.lit(rf"{string}|({number})"), F.lit(1)), lambda x: x != "")
        return F.regexp_replace(bare, rf"({string})|{number}", "$1#"), F.transform(found, lambda x: x.cast("double"))

    a, b = (F.coalesce(_c(x), F.lit("null")) for x in (a, b))
    (shape_a, numbers_a), (shape_b, numbers_b) = parts(a), parts(b)
    valid = F.try_parse_json(a).isNotNull() & F.try_parse_json(b).isNotNull()
    return F.when(valid, (shape_a == shape_b) & (numbers_a == numbers_b)).otherwise(a == b)


def merged_map(*maps) -> Column:
    """One map; later ones win."""
    entries = F.concat(*[F.map_entries(F.coalesce(_c(m), F.create_map().cast("map<string,string>"))) for m in maps])
    keys = F.array_distinct(F.transform(entries, lambda e: e["key"]))
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.element_at(F.filter(entries, lambda e: e["key"] == k), -1)["value"]))


def hmac_sha256(message, key: bytes) -> Column:
    """HMAC-SHA256 as an expression; the key's pads are literals."""
    import hashlib

    key = hashlib.sha256(key).digest() if len(key) > 64 else key
    key = key.ljust(64, b"\0")
    inner, outer = bytes(b ^ 0x36 for b in key), bytes(b ^ 0x5C for b in key)
    first = F.sha2(F.concat(F.lit(inner), F.encode(_c(message), "utf-8")), 256)
    return F.sha2(F.concat(F.lit(outer), F.unhex(first)), 256)


def repo_hash(head, path) -> Column:
    return F.sha2(F.coalesce(_c(head), _c(path)), 256)


def session_id(key8, started_ms, random6) -> Column:
    return F.concat_ws("_", F.lit("sess"), _c(key8), F.lower(F.conv(_c(started_ms).cast("string"), 10, 36)), _c(random6))


def headers(json_text) -> Column:
    """A JSON list of {key, value}; anything else is empty."""
    t = _c(json_text)
    kind = "array<struct<key:string,value:string>>"
    return F.coalesce(F.when(F.trim(t).startswith("["), F.from_json(t, kind)), F.array().cast(kind))


def key_id(token) -> Column:
    """The api_key_id claim, a string, of a syn_live_<id>.<payload>.<signature> token; else null."""
    parts = F.split(_c(token), r"\.")
    body = F.translate(F.get(parts, 1), "-_", "+/")
    padded = F.concat(body, F.repeat(F.lit("="), (4 - F.length(body) % 4) % 4))
    claims = F.try_to_binary(padded, F.lit("base64")).cast("string")
    good = _c(token).startswith("syn_live_") & (F.size(parts) == 3) & claims.rlike(r'"api_key_id"\s*:\s*"')
    return F.when(good, F.get_json_object(claims, "$.api_key_id"))


def typed_parameters(names, types) -> Column:
    return F.array_join(F.zip_with(_c(names), _c(types), lambda a, b: F.concat(a, F.lit(": "), b)), ", ")


def version_newer(a, b) -> Column:
    """Whether dotted version a is later than b (three parts)."""
    parts = lambda x: F.transform(F.slice(F.concat(F.split(_c(x), r"\."), F.array(F.lit("0"), F.lit("0"), F.lit("0"))), 1, 3), lambda p: F.coalesce(p.try_cast("int"), F.lit(0)))
    return parts(a) > parts(b)


def url_scheme_allowed(url) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(_c(url), r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1)).isin("http", "https", "ftp"), F.lit(False))


def module_name(path, language: str = "python") -> Column:
    """Dotted module of a relative path; python drops __init__, rust joins with ::, go takes the last directory."""
    bare = F.regexp_replace(_c(path), r"\.[A-Za-z]+$", "")
    parts = F.filter(F.split(bare, "/"), lambda s: s != "")
    if language == "go":
        return F.coalesce(F.try_element_at(parts, F.lit(-2)), F.lit("main"))
    if language == "python":
        parts = F.filter(parts, lambda s: s != "__init__")
    return F.array_join(parts, "::" if language == "rust" else ".")


def decorator_name(text) -> Column:
    """The last name of a decorator: @a.b.c(x) gives c."""
    return F.regexp_extract(_c(text), r"^@?(?:[A-Za-z_][A-Za-z0-9_]*\.)*([A-Za-z_][A-Za-z0-9_]*)", 1)


def decorator_route(text) -> Column:
    """struct(method, path) of a route decorator: a verb with a path, or a route with the first of its listed methods; nulls if it is none."""
    t = _c(text)
    name = F.lower(decorator_name(t))
    path = F.regexp_extract(t, r"\(\s*[\"']([^\"']+)[\"']", 1)
    listed = F.upper(F.regexp_extract(t, r"(?i)methods\s*=\s*\[\s*[\"'](\w+)[\"']", 1))
    verbs = ("get", "post", "put", "patch", "delete")
    general = F.when(listed.isin(*[v.upper() for v in verbs]), listed).otherwise("GET")
    method = F.when(path == "", None).when(name.isin(*verbs), F.upper(name)).when(name.isin("route", "api_route"), general)
    return F.struct(method.alias("method"), F.when(method.isNotNull(), path).alias("path"))


def go_pattern(text) -> Column:
    """struct(method, path) of a mux pattern such as "POST host/path"; a method outside the five gives nulls."""
    t = _c(text)
    method = F.regexp_extract(t, r"^([A-Z]+)\s+", 1)
    rest = F.regexp_replace(t, r"^[A-Z]+\s+", "")
    path = F.regexp_extract(rest, r"(/.*)$", 1)
    ok = (path != "") & ((method == "") | method.isin("GET", "POST", "PUT", "PATCH", "DELETE"))
    return F.struct(F.when(ok, F.when(method == "", "GET").otherwise(method)).alias("method"), F.when(ok, path).alias("path"))
