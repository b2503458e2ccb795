"""Classification of failures and outcomes, as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Programming errors of a server, status names, signs of a lost connection, marks of an overlong prompt.
BUGS = ("TypeError", "AttributeError", "NameError", "ImportError", "ModuleNotFoundError", "UnboundLocalError", "AssertionError", "RecursionError")
STATUS = {"UNKNOWN": 2, "DEADLINE_EXCEEDED": 4, "PERMISSION_DENIED": 7, "RESOURCE_EXHAUSTED": 8, "INTERNAL": 13, "UNAVAILABLE": 14, "UNAUTHENTICATED": 16}
NETWORK = r"(?i)^timeout after|timed out|ECONNREFUSED|ENOTFOUND|fetch failed"
OVERFLOW = ("context length", "context_length_exceeded", "maximum context", "context window", "reduce the length", "too many tokens", "prompt is too long", "string too long")
RETRYABLE = (4, 8, 10, 13, 14, 15)


def status_number(name_or_number: Column) -> Column:
    out = F.coalesce(name_or_number.try_cast("int"), F.lit(2))
    for name, n in STATUS.items():
        out = F.when(name_or_number == name, n).otherwise(out)
    return out


def wire_error(raw: Column) -> Column:
    """struct(error_code, technical) of a JSON object whose error_code is a string; else null."""
    body = F.from_json(F.when(raw.startswith("{"), raw), "struct<error_code:string,technical:string>")
    return F.when(body["error_code"].isNotNull() & raw.rlike(r'"error_code"\s*:\s*"'), body)


def error_code(raw, local=None) -> Column:
    """Wire JSON, then gRPC status, missing key, local mode, lost connection, else a server error."""
    raw = F.trim(F.coalesce(F.col(raw) if isinstance(raw, str) else raw, F.lit("")), F.lit(" \t\r\n"))
    local = F.lit(False) if local is None else local
    wire = wire_error(raw)
    code = wire["error_code"]
    bug = (code == "LLM_OUTPUT_INVALID") & F.coalesce(F.trim(wire["technical"]).rlike("^(" + "|".join(BUGS) + r")(?![A-Za-z0-9_])"), F.lit(False))
    status = F.regexp_extract(raw, r"gRPC error: (\d+|[A-Z_]+):", 1)
    n = status_number(status)
    grpc = F.when(n == 16, "AUTH_INVALID").when(n == 8, "QUOTA_EXCEEDED").when(n.isin(4, 14), "BACKEND_UNAVAILABLE").otherwise("SERVER_ERROR")
    return (F.when(code.isNotNull() & bug, "SERVER_ERROR").when(code.isNotNull(), code)
            .when(status != "", grpc)
            .when(raw.rlike("(?i)missing api key"), "MISSING_API_KEY")
            .when(local, "LOCAL_BUILD_FAILED")
            .when(raw.rlike(NETWORK), "BACKEND_UNAVAILABLE").otherwise("SERVER_ERROR"))


def http_code(status) -> Column:
    """By status; a null one is a host that was not reached."""
    s = F.col(status) if isinstance(status, str) else status
    return (F.when(s.isNull(), "BACKEND_UNAVAILABLE").when(s == 401, "AUTH_INVALID").when(s.isin(403, 429), "QUOTA_EXCEEDED")
            .when(s >= 500, "SERVER_ERROR").otherwise("REQUEST_INVALID"))


def retryable_http(status, text=None, connection=None) -> Column:
    """Connection errors, 408, 429 and 5xx; never an overlong prompt."""
    s = F.col(status) if isinstance(status, str) else status
    lost = F.lit(False) if connection is None else F.coalesce(connection, F.lit(False))
    return (lost | F.coalesce(s.isin(408, 429) | s.between(500, 599), F.lit(False))) & ~context_overflow(F.lit("") if text is None else text)


def retryable_status(code, text=None) -> Column:
    """Transient stream errors; an exhausted resource only if its text names no quota or credit."""
    c = F.col(code) if isinstance(code, str) else code
    hard = F.lower(F.coalesce(F.lit("") if text is None else text, F.lit(""))).rlike("quota|credit")
    return F.coalesce(c.isin(*RETRYABLE) & ~((c == 8) & hard), F.lit(False))


def quota_block(status, detail) -> Column:
    s, d = (F.col(x) if isinstance(x, str) else x for x in (status, detail))
    return (s == 429) & d.rlike(r"(?i)(?<![A-Za-z0-9_])quota(?![A-Za-z0-9_])") & ~d.rlike(r"(?i)rate[\s_-]*limit")


def context_overflow(text) -> Column:
    t = F.lower(F.col(text) if isinstance(text, str) else text)
    out = F.lit(False)
    for mark in OVERFLOW:
        out = out | t.contains(mark)
    return F.coalesce(out, F.lit(False))


def lines_outcome(delta, has_key, status, detail) -> Column:
    delta, has_key, status, detail = (F.col(x) if isinstance(x, str) else x for x in (delta, has_key, status, detail))
    return (F.when(delta == 0, "unchanged").when(~has_key, "skipped").when(status.between(200, 299), "sent")
            .when(quota_block(status, detail), "quota_exceeded").otherwise("failed"))


def geography(region) -> Column:
    r = F.col(region) if isinstance(region, str) else region
    return (F.when(r.startswith("us-gov-"), "us-gov").when(r.startswith("us-") | r.startswith("ca-"), "us").when(r.startswith("eu-"), "eu")
            .when(r.startswith("ap-"), "apac").otherwise("global"))


def model_family(model) -> Column:
    """struct(forced_tool, cache, claude): what a model's family can do, by its id."""
    m = F.col(model) if isinstance(model, str) else model
    return F.struct(m.rlike(r"(^|\.)(anthropic\.claude|amazon\.nova|mistral\.)").alias("forced_tool"), m.rlike(r"(^|\.)(anthropic\.claude|amazon\.nova)").alias("cache"),
                    m.rlike(r"^claude[-_]").alias("claude"))
