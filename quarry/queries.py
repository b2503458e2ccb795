"""Registered queries: name -> (function of a session and a folder, SQL with the same rows or None).

Each applies an operator of the library to a whole driver table.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import classify, scalars
from quarry.functions.needles import search
from quarry.operators import candidates, changes, files, ranking, reports, sessions
from quarry.plans import attempts, describe, parsers, pipeline, project, render
from quarry.sources import ledger, settings, trees

QUERIES: dict = {}
HOST = r"^[^:/?#]+://([^/?#]*)"
PATH = r"^[^:/?#]+://[^/?#]*([^?#]*)"
SQL_HOST, SQL_PATH = f"regexp_extract(url, '{HOST}', 1)", f"regexp_extract(url, '{PATH}', 1)"
SQL_LINES = "length({0}) - length(replace({0}, chr(10), '')) + CASE WHEN {0} = '' OR right({0}, 1) = chr(10) THEN 0 ELSE 1 END"
NEEDLES = ["License", "worthless", "entre ", "@"]
GROUPS = {"script": ["<script"], "landmarks": ["<nav", "<aside"], "advert": ['class="ad"'], "comment": ["<!-- "]}
HINTS = [("quiet", "<table"), ("quiet", "worthless"), ("french", 'lang="fr"'), ("german", 'lang="de"'), ("spanish", 'lang="es"'), ("english", 'lang="en"')]
LANGS = ["en", "fr", "de", "es"]


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = (f, sql)
        return f

    return add


def read(spark, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def paged(spark, sf: str, *more: str) -> DataFrame:
    return read(spark, sf, "pages").select("page_id", "url", *more, F.regexp_extract("url", HOST, 1).alias("host"), F.regexp_extract("url", PATH, 1).alias("path"))


def _like(column: str, needles, head: int = files.HEAD_BYTES) -> str:
    return "(" + " OR ".join(f"contains(left({column}, {head}), '{n}')" for n in needles) + ")"


@query(f"""WITH s AS (SELECT source, count(*) AS seen, count(*) FILTER (WHERE strlen(text) > {files.MAX_BYTES}) AS skipped,
  count(*) FILTER (WHERE strlen(text) <= {files.MAX_BYTES} AND {_like('text', NEEDLES)}) AS matched,
  coalesce(sum({SQL_LINES.format('text')}) FILTER (WHERE strlen(text) <= {files.MAX_BYTES} AND {_like('text', NEEDLES)}), 0)::BIGINT AS lines FROM documents GROUP BY source),
 l AS (SELECT source, lang, row_number() OVER (PARTITION BY source ORDER BY count(*) DESC, list_position(['en','fr','de','es'], lang)) AS r FROM documents WHERE lang IS NOT NULL GROUP BY source, lang)
 SELECT s.*, l.lang AS language FROM s LEFT JOIN l ON l.source = s.source AND r = 1""")
def scan_summary(spark, sf):
    docs = read(spark, sf, "documents")
    return files.scan_counts(docs, ["source"], "text", NEEDLES).join(files.dominant(docs, ["source"], "lang", LANGS, "language"), "source", "left")


@query(" UNION ALL ".join(f"SELECT '{g}' AS needle_group, count(*) FILTER (WHERE {_like('html', ns)}) AS hits, count(*) AS total FROM pages" for g, ns in GROUPS.items()))
def needle_sniff(spark, sf):
    pages = read(spark, sf, "pages")
    one = pages.agg(F.count("*").alias("total"), *[F.count_if(files.sniff("html", ns)).alias(g) for g, ns in GROUPS.items()])
    return one.select("total", F.explode(F.array(*[F.struct(F.lit(g).alias("needle_group"), F.col(g).alias("hits")) for g in GROUPS])).alias("r")).select("r.needle_group", "r.hits", "total")


@query(f"""WITH p AS (SELECT page_id, ltrim({SQL_PATH}, '/') AS path FROM pages), q AS (SELECT *, string_split(path, '/') AS parts FROM p)
 SELECT page_id, path, CASE WHEN len(list_filter(parts[1:len(parts)-1], lambda d: d IN ('de', 'tests') OR starts_with(d, '.'))) > 0 THEN 'directory'
  WHEN parts[-1] IN ('825', '25') THEN 'name' WHEN contains(parts[-1], '77') THEN 'partial' ELSE 'kept' END AS verdict FROM q""")
def path_filter(spark, sf):
    pages = paged(spark, sf).select("page_id", F.ltrim("path", F.lit("/")).alias("path"))
    return pages.withColumn("verdict", files.path_verdict("path", dirs=("de", "tests"), names=("825", "25"), partials=("77",)))


@query("""SELECT doc_id, strlen(text)::BIGINT AS bytes, strlen(text) <= 4000 AS kept FROM documents""")
def size_budget(spark, sf):
    size = F.octet_length("text").cast("long")
    return read(spark, sf, "documents").select("doc_id", size.alias("bytes"), files.within_size(size, 4000).alias("kept"))


@query(f"SELECT doc_id, ({SQL_LINES.format('text')})::BIGINT AS lines FROM documents")
def line_count(spark, sf):
    return read(spark, sf, "documents").select("doc_id", scalars.line_count("text").alias("lines"))


@query("""SELECT source, lang AS language FROM (SELECT source, lang, row_number() OVER (PARTITION BY source ORDER BY count(*) DESC, list_position(['es','de','fr','en'], lang)) AS r
 FROM documents WHERE lang IS NOT NULL GROUP BY source, lang) WHERE r = 1""")
def dominant_language(spark, sf):
    return files.dominant(read(spark, sf, "documents"), ["source"], "lang", LANGS[::-1], "language")


def _hint_rows() -> str:
    names = list(dict.fromkeys(n for n, _ in HINTS))
    return " UNION ALL ".join(f"SELECT {SQL_HOST} AS host, page_id, '{n}' AS framework, {k} AS place FROM pages WHERE " + " OR ".join(f"contains(html, '{h}')" for m, h in HINTS if m == n) for k, n in enumerate(names))


@query(f"""WITH h AS ({_hint_rows()}), c AS (SELECT host, framework, count(*) AS n, min(page_id * 100 + place) AS first FROM h GROUP BY host, framework)
 SELECT host, framework, n AS files FROM (SELECT *, row_number() OVER (PARTITION BY host ORDER BY n DESC, first) AS r FROM c) WHERE r = 1""")
def framework_top(spark, sf):
    hits = files.frameworks(paged(spark, sf, "html"), "html", HINTS, ["host", "page_id"])
    return files.top_framework(hits, ["host"], "page_id")


SQL_DECORATOR = """CASE page_id % 8 WHEN 0 THEN concat('@app.get("', p, '")') WHEN 1 THEN concat('@a.b.Post( ', chr(39), p, chr(39), ')') WHEN 2 THEN concat('@route("', p, '", methods=["PUT", "GET"])')
 WHEN 3 THEN concat('@x.api_route("', p, '", methods=["HEAD"])') WHEN 4 THEN '@app.delete()' WHEN 5 THEN concat('@cache("', p, '")') WHEN 6 THEN concat('@app.route("', p, '", methods=("POST",))') ELSE 'app.patch' END"""


@query(f"""SELECT page_id, CASE page_id % 8 WHEN 0 THEN 'get' WHEN 1 THEN 'Post' WHEN 2 THEN 'route' WHEN 3 THEN 'api_route' WHEN 4 THEN 'delete' WHEN 5 THEN 'cache' WHEN 6 THEN 'route' ELSE 'patch' END AS decorator,
 CASE WHEN p = '' THEN NULL WHEN page_id % 8 IN (0, 3, 6) THEN 'GET' WHEN page_id % 8 = 1 THEN 'POST' WHEN page_id % 8 = 2 THEN 'PUT' END AS method, CASE WHEN p <> '' AND page_id % 8 IN (0, 1, 2, 3, 6) THEN p END AS path
 FROM (SELECT page_id, replace({SQL_PATH}, chr(39), '') AS p FROM pages)""")
def decorator_route(spark, sf):
    rows = paged(spark, sf).select("page_id", F.replace("path", F.lit("'")).alias("p")).select("page_id", F.expr(SQL_DECORATOR).alias("t"))
    return rows.select("page_id", scalars.decorator_name("t").alias("decorator"), scalars.decorator_route("t")["method"].alias("method"), scalars.decorator_route("t")["path"].alias("path"))


@query("""SELECT host, name, count(DISTINCT page_id) AS pages FROM (SELECT regexp_extract(url, '^[^:/?#]+://([^/?#]*)', 1) AS host, page_id,
 unnest(regexp_extract_all(translate(html, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ'), 'HREF="/([A-Z_][A-Z0-9_]*)"', 1)) AS name FROM pages) GROUP BY host, name""")
def env_vars(spark, sf):
    """Links of pages, written as reads of the environment."""
    upper = F.translate("html", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
    names = scalars.environment_names(F.replace(upper, F.lit('HREF="/'), F.lit('os.getenv("')))
    return paged(spark, sf, "html").select("host", F.explode(names).alias("name")).groupBy("host", "name").agg(F.count("*").alias("pages"))


@query(f"""SELECT page_id, p AS path, regexp_extract_all(p, '\\{{([a-zA-Z_][A-Za-z0-9_]*)\\}}', 1) AS params, CASE WHEN i = '' THEN 'tool' WHEN regexp_matches(i, '^[0-9]') THEN '_' || i ELSE i END AS ident,
 left(CASE WHEN page_id % 3 = 0 THEN 'show' ELSE CASE page_id % 5 WHEN 0 THEN 'get' WHEN 1 THEN 'create' WHEN 2 THEN 'update' WHEN 3 THEN 'patch' ELSE 'delete' END || '_' || CASE WHEN s <> '' THEN s ELSE CASE WHEN page_id % 2 = 0 THEN 'view' ELSE 'Index' END END END, 60) AS tool FROM
 (SELECT page_id, p, regexp_replace(regexp_replace(lower(trim(p)), '[^a-z0-9_]+', '_', 'g'), '^_+|_+$', '', 'g') AS i,
  lower(regexp_replace(regexp_replace(regexp_replace(regexp_replace(p, '^/+|/+$', '', 'g'), '\\{{([^}}]+)\\}}', 'by_\\1', 'g'), '[^a-zA-Z0-9]+', '_', 'g'), '_+', '_', 'g')) AS s FROM
  (SELECT page_id, regexp_replace({SQL_PATH}, '/([0-9]+)', '/{{id_\\1}}', 'g') AS p FROM pages))""")
def path_params(spark, sf):
    n = F.col("page_id")
    p = paged(spark, sf).select("page_id", F.regexp_replace("path", "/([0-9]+)", "/{id_$1}").alias("path"))
    method = F.when(n % 5 == 0, "GET").when(n % 5 == 1, "POST").when(n % 5 == 2, "PUT").when(n % 5 == 3, "PATCH").otherwise("DELETE")
    handler = F.when(n % 3 == 0, "show").when(n % 2 == 0, "view").otherwise("Index")
    return p.select("page_id", "path", scalars.path_parameters("path").alias("params"), scalars.identifier("path").alias("ident"), scalars.tool_name(method, "path", handler, "python").alias("tool"))


@query(f"""SELECT page_id, array_to_string(list_filter(string_split(regexp_replace({SQL_PATH}, '\\.[A-Za-z]+$', ''), '/'), lambda s: s <> ''), '.') AS module,
 list_filter(string_split(regexp_replace({SQL_PATH}, '\\.[A-Za-z]+$', ''), '/'), lambda s: s <> '')[-1] AS last FROM pages""")
def module_name(spark, sf):
    p = paged(spark, sf).select("page_id", scalars.module_name("path", "other").alias("module"))
    return p.withColumn("last", F.when(F.col("module") != "", scalars.last_segment("module")))


@query(f"""WITH m AS (SELECT {SQL_HOST} AS host, page_id, array_to_string(list_reverse(string_split({SQL_HOST}, '.')), '.') || '.' || array_to_string(list_filter(string_split({SQL_PATH}, '/'), lambda s: s <> ''), '.') AS module FROM pages),
 e AS (SELECT host, min(string_split(module, '.')) AS lo, max(string_split(module, '.')) AS hi, arg_min(module, page_id) AS first FROM m GROUP BY host),
 g AS (SELECT host, first, array_to_string(lo[1:coalesce(list_position(list_transform(generate_series(1, greatest(len(lo), len(hi))), lambda i: lo[i] IS DISTINCT FROM hi[i]), true) - 1, len(lo))], '.') AS p FROM e)
 SELECT host, CASE WHEN p <> '' THEN p ELSE split_part(first, '.', 1) END AS root FROM g""")
def package_root(spark, sf):
    p = paged(spark, sf)
    module = F.concat_ws(".", F.array_join(F.reverse(F.split("host", r"\.")), "."), F.array_join(F.filter(F.split("path", "/"), lambda s: s != ""), "."))
    return changes.package_root(p.select("host", "page_id", module.alias("module")), ["host"], "module", "page_id")


@query("""SELECT p_partkey, split_part(p_name, ' ', 1) || CASE WHEN n = 1 THEN '' ELSE '_' || n END AS tool FROM
 (SELECT p_partkey, p_name, row_number() OVER (PARTITION BY split_part(p_name, ' ', 1) ORDER BY p_partkey) AS n FROM part)""")
def tool_names_unique(spark, sf):
    rows = read(spark, sf, "part").select("p_partkey", F.split_part("p_name", F.lit(" "), F.lit(1)).alias("name"))
    return files.unique_names(rows, "name", ["p_partkey"], "tool").select("p_partkey", "tool")


@query("""SELECT p_partkey, array_to_string(list_transform(list_filter(string_split(replace(p_name, ' ', '_'), '_'), lambda w: w <> ''), lambda w: upper(left(w, 1)) || substring(w, 2)), ' ') AS title FROM part""")
def display_name(spark, sf):
    return read(spark, sf, "part").select("p_partkey", scalars.display_name(F.replace("p_name", F.lit(" "), F.lit("_"))).alias("title"))


@query("""SELECT doc_id, CASE WHEN length(text) > 200 THEN left(text, 200) || '…' ELSE coalesce(text, '') END AS clipped, sha256(left(text, 500)) AS head_sha FROM documents""")
def clip_text(spark, sf):
    return read(spark, sf, "documents").select("doc_id", scalars.clip("text", 200).alias("clipped"), F.sha2(scalars.truncate("text", 500), 256).alias("head_sha"))


SQL_SCORE = r"""(CASE WHEN length(text) > 2000 THEN 3 ELSE 0 END + CASE WHEN contains(text, ':') THEN 2 ELSE 0 END + CASE WHEN regexp_matches(text, '->\s*[A-Za-z0-9_\[\]]+') THEN 2 ELSE 0 END
 + CASE WHEN regexp_matches(text, '(?i)@(task|tool|job|command|action|route|entry|op)\b') THEN 3 ELSE 0 END + least(doc_id % 7, 5)
 + CASE WHEN starts_with(lang, '_') THEN -5 ELSE 0 END + CASE WHEN regexp_matches(source, '(?i)\btests?\b') THEN -5 ELSE 0 END + CASE WHEN length(source) < 5 THEN -2 ELSE 0 END + CASE WHEN lang = 'en' THEN 1 ELSE 0 END)::INTEGER"""


def _scored(spark, sf):
    d = read(spark, sf, "documents").select("doc_id", "text", "lang", "source")
    # thresholds of a function's record, moved to the sizes of documents
    return d.select("doc_id", ranking.function_score(F.when(F.length("text") > 2000, F.repeat(F.lit("x"), 21)).otherwise(""), F.col("text"), F.when(
        F.length("source") < 5, F.substring("lang", 1, 2)).otherwise(F.concat("lang", F.lit("___"))), "source", (F.col("doc_id") % 7).cast("int"), F.col("lang") == "en").alias("raw"), "source", "lang")


@query(f"SELECT doc_id, {SQL_SCORE} AS score FROM documents")
def function_score(spark, sf):
    return _scored(spark, sf).select("doc_id", F.col("raw").alias("score"))


@query(f"""SELECT doc_id, score, CASE WHEN r <= 200 THEN r END::INTEGER AS rank, r <= 200 AS kept FROM (SELECT doc_id, {SQL_SCORE} AS score, row_number() OVER (ORDER BY {SQL_SCORE} DESC, doc_id) AS r FROM documents)""")
def rank_topk(spark, sf):
    return ranking.rank_topk(function_score(spark, sf), "score", "doc_id", 200).select("doc_id", "score", "rank", "kept")


CALLS = ["the", "and", "der", "que"]


@query(" UNION ALL ".join(rf"""SELECT '{n}' AS name, greatest(coalesce(sum(len(regexp_extract_all(text, '\b{n}\s*\('))), 0) - coalesce(sum(len(regexp_extract_all(text, '\bdef\s+{n}\s*\('))), 0), 0)::BIGINT AS calls FROM (SELECT replace(text, ' ', '( ') AS text FROM documents)""" for n in CALLS))
def call_sites(spark, sf):
    docs = read(spark, sf, "documents").select(F.replace("text", F.lit(" "), F.lit("( ")).alias("text"))
    return ranking.call_sites(docs, "text", CALLS)


#: Two letters between blanks, and what other queries look for.
MANY = [f" {a}{b} " for a in "abcdeilnotsu" for b in "abcdefghilmnoprstuvy"] + NEEDLES


@query("SELECT n.needle, count(*) AS docs, min(d.doc_id) AS first FROM documents d JOIN (SELECT unnest([" + ", ".join(f"'{n}'" for n in MANY) + "]) AS needle) n ON contains(d.text, n.needle) GROUP BY n.needle")
def needle_automaton(spark, sf):
    """Documents that hold each of many needles, found by one automaton in one pass over the texts."""
    found = search(read(spark, sf, "documents").select("doc_id", "text"), "text", MANY).select("doc_id", F.explode("hits").alias("n"))
    names = F.array(*[F.lit(n) for n in MANY])
    return found.groupBy("n").agg(F.count("*").alias("docs"), F.min("doc_id").alias("first")).select(names[F.col("n")].alias("needle"), "docs", "first")


@query("""SELECT doc_id, CASE WHEN r <= 240 THEN (r - 1) // 12 END::INTEGER AS shard, CASE WHEN r <= 240 THEN (r - 1) % 12 END::INTEGER AS place, r > 240 AS dropped FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS r FROM documents)""")
def shards(spark, sf):
    return ranking.shards(read(spark, sf, "documents").select("doc_id"), "doc_id").select("doc_id", "shard", F.col("place").cast("int").alias("place"), "dropped")


SQL_BAND = "CASE WHEN quality = 1 AND toxic = 0 THEN 'HIGH' WHEN quality = 1 THEN 'MEDIUM' WHEN toxic = 1 THEN 'BAD' ELSE 'LOW' END"


def _verdicts(spark, sf):
    q, t = F.col("quality") == 1, F.col("toxic") == 1
    return read(spark, sf, "labels").select("doc_id", F.when(q & ~t, "HIGH").when(q, "MEDIUM").when(t, "BAD").otherwise("LOW").alias("band"))


@query(f"""SELECT d.doc_id, coalesce(v.band, 'LOW') AS band, coalesce(v.band, 'LOW') IN ('HIGH', 'MEDIUM') AS kept FROM documents d
 LEFT JOIN (SELECT doc_id, {SQL_BAND} AS band FROM labels WHERE {SQL_BAND} <> 'BAD') v ON v.doc_id = d.doc_id""")
def verdicts_complete(spark, sf):
    out = ranking.complete_verdicts(read(spark, sf, "documents").select("doc_id"), _verdicts(spark, sf), "doc_id")
    return out.withColumn("kept", F.col("band").isin("HIGH", "MEDIUM"))


@query(f"""WITH v AS (SELECT d.doc_id, d.lang, d.source FROM documents d JOIN labels l ON l.doc_id = d.doc_id WHERE {SQL_BAND} IN ('HIGH', 'MEDIUM'))
 SELECT source || '_workflow' AS cluster, count(*) AS n, least(1.0::DOUBLE, 0.5::DOUBLE + 0.1::DOUBLE * count(*)) AS confidence FROM v GROUP BY source HAVING count(*) >= 2
 ORDER BY confidence DESC, min(doc_id), cluster LIMIT 5""")
def clusters(spark, sf):
    v = ranking.kept_verdicts(read(spark, sf, "documents").select("doc_id", "lang", "source"), _verdicts(spark, sf), "doc_id")
    return ranking.clusters(v, "source", "lang", "doc_id").select("cluster", "n", "confidence")


SQL_PREV = "SELECT doc_id, sha256(CASE WHEN doc_id % 7 = 3 THEN text || '!' ELSE text END) AS sha FROM documents WHERE doc_id % 5 <> 0 UNION ALL SELECT doc_id + 1000000000 AS doc_id, sha256(text) AS sha FROM documents WHERE doc_id % 50 = 1"


def _previous(spark, sf):
    d = read(spark, sf, "documents").select("doc_id", "text")
    edited = d.where("doc_id % 5 <> 0").select("doc_id", F.sha2(F.when(F.col("doc_id") % 7 == 3, F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256).alias("sha"))
    return edited.unionByName(d.where("doc_id % 50 = 1").select((F.col("doc_id") + 1_000_000_000).alias("doc_id"), F.sha2("text", 256).alias("sha")))


@query(f"""WITH prev AS ({SQL_PREV}), now AS (SELECT doc_id, sha256(text) AS sha FROM documents)
 SELECT coalesce(n.doc_id, p.doc_id) AS doc_id, CASE WHEN n.doc_id IS NULL THEN 'deleted' WHEN p.doc_id IS NULL THEN 'new' WHEN n.sha = p.sha THEN 'replay' ELSE 'parse' END AS action
 FROM now n FULL JOIN prev p ON p.doc_id = n.doc_id""")
def incremental_skip(spark, sf):
    now = read(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("sha"))
    return changes.incremental(now, _previous(spark, sf), "doc_id", "sha")


@query(f"""WITH prev AS ({SQL_PREV}), scanned AS (SELECT doc_id, sha256(text) AS sha FROM documents WHERE doc_id % 3 = 0)
 SELECT * FROM prev WHERE doc_id IN (SELECT doc_id FROM documents) AND doc_id NOT IN (SELECT doc_id FROM scanned) UNION ALL SELECT * FROM scanned""")
def cache_merge(spark, sf):
    d = read(spark, sf, "documents")
    return changes.merge_snapshot(_previous(spark, sf), d.select("doc_id"), d.where("doc_id % 3 = 0").select("doc_id", F.sha2("text", 256).alias("sha")), "doc_id")


@query("SELECT sha256(text) AS sha, count(*) AS copies, min(doc_id) AS first FROM documents GROUP BY 1 HAVING count(*) > 1")
def duplicate_content(spark, sf):
    return changes.duplicates(read(spark, sf, "documents"), F.sha2("text", 256), "doc_id")


def _pads(key: bytes):
    key = key.ljust(64, b"\0")
    return [("".join(f"\\x{b ^ p:02X}" for b in key)) for p in (0x36, 0x5C)]


@query(f"SELECT c_custkey, sha256('{_pads(b'salt')[1]}'::BLOB || unhex(sha256('{_pads(b'salt')[0]}'::BLOB || encode(c_name)))) AS mac FROM customer")
def keyed_hash(spark, sf):
    return read(spark, sf, "customer").select("c_custkey", scalars.hmac_sha256("c_name", b"salt").alias("mac"))


SQL_LEDGER = """SELECT user_id || strftime(ts, ' %Y-%m-%d') AS session_id, event_id AS line_no, CASE event_type WHEN 'view' THEN 'file_scanned' WHEN 'error' THEN 'file_skipped' WHEN 'purchase' THEN 'session_done' WHEN 'click' THEN 'session_paused' ELSE 'session_open' END AS type,
 CASE WHEN event_type IN ('view', 'error') THEN concat('f', event_id % 7) END AS path, concat('h', event_id % 11) AS repo_hash, concat('s', event_id % 13) AS sha, concat('r', event_id % 5) AS reason FROM events"""


def _ledger(spark, sf):
    e, n, kind = read(spark, sf, "events"), F.col("event_id"), F.col("event_type")
    types = F.when(kind == "view", "file_scanned").when(kind == "error", "file_skipped").when(kind == "purchase", "session_done").when(kind == "click", "session_paused").otherwise("session_open")
    tag = lambda x, m: F.concat(F.lit(x), n % m)
    return e.select(F.concat("user_id", F.date_format("ts", " yyyy-MM-dd")).alias("session_id"), n.alias("line_no"), types.alias("type"), F.when(kind.isin("view", "error"), tag("f", 7)).alias("path"), tag("h", 11).alias("repo_hash"),
                    tag("s", 13).alias("sha"), tag("r", 5).alias("reason"))


@query(f"""SELECT session_id, arg_max(repo_hash, line_no) FILTER (WHERE type = 'session_open') AS repo_hash, arg_max(reason, line_no) FILTER (WHERE type = 'session_paused') AS paused, bool_or(type = 'session_done') AS completed,
 count(*) FILTER (WHERE type = 'file_scanned') AS scanned, count(*) FILTER (WHERE type = 'file_skipped') AS skipped FROM ({SQL_LEDGER}) GROUP BY session_id""")
def resume_state(spark, sf):
    return sessions.resume_state(_ledger(spark, sf))[0]


@query(f"""SELECT session_id, path, arg_max(sha, line_no) FILTER (WHERE type = 'file_scanned') AS sha, arg_max(reason, line_no) FILTER (WHERE type = 'file_skipped') AS skip_reason FROM ({SQL_LEDGER}) WHERE path IS NOT NULL GROUP BY session_id, path""")
def resume_paths(spark, sf):
    return sessions.resume_state(_ledger(spark, sf))[1]


@query("""SELECT user_id, coalesce(arg_max(CASE event_type WHEN 'purchase' THEN 'done' WHEN 'logout' THEN 'paused' WHEN 'error' THEN 'errored' END, ts) FILTER (WHERE event_type IN ('purchase', 'logout', 'error')), 'in-progress') AS state FROM events GROUP BY user_id""")
def terminal_state(spark, sf):
    return sessions.terminal_state(read(spark, sf, "events"), "user_id", "event_type", "ts", {"purchase": "done", "logout": "paused", "error": "errored"})


@query("""SELECT session, max(ts) FILTER (WHERE event_type = 'view') AS opened FROM (SELECT user_id || ' ' || strftime(ts, '%Y-%m-%d') AS session, event_type, ts FROM events) GROUP BY session
 HAVING max(ts) FILTER (WHERE event_type = 'view') IS NOT NULL AND NOT bool_or(event_type = 'purchase') ORDER BY opened DESC, session""")
def resumable(spark, sf):
    """A user's day is a session; the latest come first."""
    days = read(spark, sf, "events").select(F.concat_ws(" ", "user_id", F.date_format("ts", "yyyy-MM-dd")).alias("session"), "event_type", "ts")
    return sessions.newest(sessions.resumable(days, "session", "event_type", "ts", "view", "purchase"), "opened", "session")


@query("""SELECT user_id, count(*) FILTER (WHERE ts <= TIMESTAMP '2024-02-10' - INTERVAL 30 DAY) AS removed,
 coalesce(sum(strlen(props)) FILTER (WHERE ts <= TIMESTAMP '2024-02-10' - INTERVAL 30 DAY), 0)::BIGINT AS bytes FROM events GROUP BY user_id""")
def retention(spark, sf):
    old = sessions.expired(None, "ts", F.lit("2024-02-10").cast("timestamp_ntz"))
    return sessions.sweep(read(spark, sf, "events"), ["user_id"], old, F.octet_length("props"))


@query("""WITH r AS (SELECT user_id, event_id, ts, floor(value)::BIGINT AS total, event_id % 5 <> 0 AND event_id % 3 = 0 AS ok FROM events),
 b AS (SELECT a.user_id, a.event_id, a.total, coalesce(max(p.total), 0) AS baseline FROM r a LEFT JOIN r p ON p.user_id = a.user_id AND p.ok AND p.ts < a.ts GROUP BY ALL)
 SELECT user_id, event_id, baseline, greatest(total - baseline, 0) AS delta, CASE WHEN total <= baseline THEN 'unchanged' WHEN event_id % 5 = 0 THEN 'skipped' WHEN event_id % 3 = 0 THEN 'sent'
  WHEN event_id % 3 = 1 AND event_id % 2 = 0 THEN 'quota_exceeded' ELSE 'failed' END AS outcome FROM b""")
def lines_delta(spark, sf):
    """Only runs with a key and an accepted send move the baseline."""
    r = read(spark, sf, "events").select("user_id", "event_id", "ts", F.floor("value").cast("long").alias("total"))
    e = F.col("event_id")
    has_key, status = e % 5 != 0, F.when(e % 3 == 0, 200).when(e % 3 == 1, 429).otherwise(503)
    out = sessions.high_water(r, "user_id", "ts", "total", has_key & status.between(200, 299))
    detail = F.when(e % 2 == 0, "line quota reached").otherwise("Rate-limit, see your quota")
    return out.select("user_id", "event_id", "baseline", "delta", sessions.lines_report("total", "baseline", has_key, status, detail).alias("outcome"))


SQL_OLD = f"SELECT page_id, {SQL_HOST} AS host, substring({SQL_PATH}, 1, 4) AS title, page_id AS ord FROM pages WHERE page_id % 3 <> 0"
SQL_NEW = f"SELECT {SQL_HOST} AS host, CASE WHEN page_id % 4 = 0 THEN substring({SQL_PATH}, 1, 3) ELSE substring({SQL_PATH}, 1, 4) END AS title, page_id AS ord FROM pages WHERE page_id % 5 <> 0"


@query(f"""WITH o AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY ord, page_id) AS n FROM ({SQL_OLD})), d AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY ord) AS n FROM ({SQL_NEW}))
 SELECT CASE WHEN o.page_id IS NULL THEN 'create' WHEN d.ord IS NULL THEN 'remove' WHEN o.title IS DISTINCT FROM d.title OR o.ord <> d.ord THEN 'update' ELSE 'unchanged' END AS action, o.page_id AS id, d.ord AS ord,
 CASE WHEN o.page_id IS NULL OR d.ord IS NULL THEN '' ELSE array_to_string(list_filter([CASE WHEN o.title IS DISTINCT FROM d.title THEN 'title' END, CASE WHEN o.ord <> d.ord THEN 'ord' END], lambda x: x IS NOT NULL), ',') END AS fields
 FROM o FULL JOIN d ON o.host = d.host AND o.n = d.n""")
def sync_plan(spark, sf):
    p = paged(spark, sf)
    old = p.where("page_id % 3 <> 0").select("page_id", "host", F.substring("path", 1, 4).alias("title"), F.col("page_id").alias("ord"))
    new = p.where("page_id % 5 <> 0").select("host", F.when(F.col("page_id") % 4 == 0, F.substring("path", 1, 3)).otherwise(F.substring("path", 1, 4)).alias("title"), F.col("page_id").alias("ord"))
    out = changes.sync_plan(old, new, ["host"], ["title", "ord"], "ord", "ord", "page_id")
    return out.withColumn("fields", F.array_join("fields", ","))


SPEC = "get /en/825, /en/25 , spam-farm.example.org,/nope"


@query(f"""SELECT page_id, {SQL_PATH} AS path, {SQL_HOST} AS host FROM pages WHERE {SQL_PATH} IN ('/en/825', '/en/25') OR lower({SQL_HOST}) = 'spam-farm.example.org'""")
def select_tokens(spark, sf):
    p = paged(spark, sf).select("page_id", "path", "host", F.lit("GET").alias("method"))
    return changes.select_tokens(p, "method", "path", "host", SPEC)[0].drop("method")


@query("""SELECT p.page_id, coalesce(d.source, 'page_' || p.page_id) AS source FROM pages p LEFT JOIN documents d ON d.doc_id = p.page_id * 7""")
def names_back(spark, sf):
    pages = read(spark, sf, "pages").select("page_id", (F.col("page_id") * 7).alias("doc_id"))
    return changes.names_back(pages, read(spark, sf, "documents"), "doc_id", "source", F.concat(F.lit("page_"), "page_id")).select("page_id", "source")


@query("""SELECT DISTINCT w AS name FROM (SELECT unnest(regexp_extract_all(text, '[a-z]+')) AS w FROM benchmark) WHERE w NOT IN ('print', 'len', 'str', 'int', 'all', 'any', 'set', 'os', 're', 'type', 'range', 'list', 'sum', 'min', 'max')
 AND w NOT IN (SELECT unnest(regexp_extract_all(text, '[a-z]+')) FROM documents)""")
def call_audit(spark, sf):
    words = lambda t: t.select(F.explode(F.regexp_extract_all("text", F.lit("[a-z]+"), F.lit(0))).alias("name"))
    allowed = ("print", "len", "str", "int", "all", "any", "set", "os", "re", "type", "range", "list", "sum", "min", "max")
    return changes.unknown_calls(words(read(spark, sf, "benchmark")), words(read(spark, sf, "documents")), "name", allowed)


@query(f"""WITH i AS (SELECT DISTINCT {SQL_HOST} || CASE WHEN page_id % 5 = 0 THEN '.sub' ELSE '' END AS module, unnest(regexp_extract_all(html, 'href="(/[^"]*)"', 1)) AS item FROM pages), k AS (SELECT DISTINCT {SQL_HOST} AS module, {SQL_PATH} AS item FROM pages)
 SELECT module, item, CASE WHEN module NOT IN (SELECT module FROM k) THEN 'unknown module' ELSE 'unknown item' END AS reason FROM i WHERE starts_with(module, 'www.') AND (module, item) NOT IN (SELECT module, item FROM k)""")
def import_audit(spark, sf):
    p = paged(spark, sf, "html")
    module = F.concat("host", F.when(F.col("page_id") % 5 == 0, ".sub").otherwise(""))
    imports = p.select(module.alias("module"), F.explode(F.regexp_extract_all("html", F.lit('href="(/[^"]*)"'), F.lit(1))).alias("item")).distinct()
    return changes.import_audit(imports, p.select(F.col("host").alias("module"), F.col("path").alias("item")), "module", "item", "www.")


@query("""WITH k AS (SELECT c_custkey, left(c_name, 12 + c_custkey % 7) AS prefix FROM customer) SELECT c.c_custkey AS token_id, CASE WHEN c.c_custkey % 4 = 0 THEN c.c_custkey WHEN c.c_custkey % 4 = 1 THEN NULL WHEN count(k.c_custkey) = 1 THEN min(k.c_custkey) END AS owner
 FROM customer c LEFT JOIN k ON starts_with(c.c_name, k.prefix) GROUP BY c.c_custkey""")
def key_in_use(spark, sf):
    """Prefixes of several lengths share their first characters; a token may embed an id, known or not."""
    c, k = read(spark, sf, "customer"), F.col("c_custkey")
    keys = c.select("c_custkey", F.expr("left(c_name, int(12 + c_custkey % 7))").alias("prefix"))
    tokens = c.select(k.alias("token_id"), F.when(k % 4 == 0, k).when(k % 4 == 1, -k).alias("embedded"), F.col("c_name").alias("shown"))
    return candidates.key_owner(keys, tokens, "c_custkey", "prefix").select("token_id", "owner")


@query("""SELECT conv_id, turn, greatest(0, least(least(length(text), 300), 600 - coalesce(sum(least(length(text), 300)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)))::BIGINT AS taken FROM conversations""")
def char_budget(spark, sf):
    return sessions.char_budget(read(spark, sf, "conversations"), ["conv_id"], ["turn"], "text", 300, 600).select("conv_id", "turn", "taken")


SQL_CALLS = "SELECT user_id, ts, event_id, CASE WHEN event_id % 4 = 0 THEN 'ok' WHEN event_id % 4 IN (1, 2) THEN 'overloaded' ELSE 'other' END AS outcome, CASE WHEN event_id % 3 = 0 THEN 'triage' ELSE 'generate' END AS task FROM events"


@query(f"""WITH c AS ({SQL_CALLS}), i AS (SELECT *, sum((outcome = 'ok')::INT) OVER (PARTITION BY user_id ORDER BY ts) AS island FROM c),
 s AS (SELECT *, sum((outcome = 'overloaded')::INT) OVER (PARTITION BY user_id, island ORDER BY ts)::BIGINT AS streak FROM i)
 SELECT event_id, streak, bool_or(streak >= 3 AND task = 'generate' AND outcome = 'overloaded') OVER (PARTITION BY user_id ORDER BY ts) AS degraded FROM s""")
def overload_streak(spark, sf):
    e = F.col("event_id")
    calls = read(spark, sf, "events").select("user_id", "ts", "event_id", F.when(e % 4 == 0, "ok").when((e % 4).isin(1, 2), "overloaded").otherwise("other").alias("outcome"),
                                             F.when(e % 3 == 0, "triage").otherwise("generate").alias("task"))
    return sessions.streaks(calls, "user_id", "ts", "outcome", "task").select("event_id", "streak", "degraded")


@query("""SELECT o_custkey, count(*) AS calls, sum(l_quantity::BIGINT)::BIGINT AS input, sum(l_linenumber)::BIGINT AS output, arg_max(l_shipmode, k) AS last FROM
 (SELECT o_custkey, l_quantity, l_linenumber, l_returnflag AS l_shipmode, (l_orderkey * 100 + l_linenumber) * 1000 + ascii(l_returnflag) AS k FROM lineitem JOIN orders ON o_orderkey = l_orderkey) GROUP BY o_custkey""")
def token_totals(spark, sf):
    lines = read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag")
    both = lines.join(read(spark, sf, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    used = {"input": F.col("l_quantity").cast("long"), "output": F.col("l_linenumber").cast("long")}
    return sessions.call_totals(both, ["o_custkey"], used, F.struct("l_orderkey", "l_linenumber", "l_returnflag"), "l_returnflag")


@query("""SELECT conv_id, arg_min(text, CASE role WHEN 'system' THEN 0 WHEN 'user' THEN 1000000 ELSE 2000000 END + turn) FILTER (WHERE trim(text) <> '') AS value FROM conversations GROUP BY conv_id""")
def config_layers(spark, sf):
    layer = F.when(F.col("role") == "system", 0).when(F.col("role") == "user", 1).otherwise(2)
    return sessions.layered(read(spark, sf, "conversations").withColumn("layer", layer), ["conv_id"], "text", "layer", "turn")


#: (a failure's text, its code)
FAILURES = [
    ('{"error_code": "QUOTA_EXCEEDED"}', "QUOTA_EXCEEDED"), ("gRPC error: 16: no", "AUTH_INVALID"), ("gRPC error: UNAVAILABLE: later", "BACKEND_UNAVAILABLE"), ("Missing API key", "MISSING_API_KEY"),
    ("fetch failed", "BACKEND_UNAVAILABLE"), ('{"error_code": "LLM_OUTPUT_INVALID", "technical": "TypeError: x"}', "SERVER_ERROR"), ("gRPC error: 8: quota", "QUOTA_EXCEEDED"), ("boom", "SERVER_ERROR"),
    ('{"error_code": "LLM_OUTPUT_INVALID", "technical": "KeyError: x"}', "LLM_OUTPUT_INVALID"), ('{"error_code": "LLM_OUTPUT_INVALID", "technical": " RecursionError"}', "SERVER_ERROR"),
    ("the request timed out", "BACKEND_UNAVAILABLE"), ("network down", "SERVER_ERROR"), ("timeout after 3 s", "BACKEND_UNAVAILABLE"), ("a timeout after 3 s", "SERVER_ERROR"),
    ('{"error_code": 7}', "SERVER_ERROR"), ("  gRPC error: PERMISSION_DENIED: x", "SERVER_ERROR"), ("gRPC error: 4: late", "BACKEND_UNAVAILABLE"), ('{"error_code": "NEW_CODE"}', "NEW_CODE"), ("", "SERVER_ERROR")]
SQL_FAILURES = ", ".join(f"({k}, '{text}', '{code}')" for k, (text, code) in enumerate(FAILURES))


@query(f"""SELECT event_id, f.code, CASE WHEN s IS NULL THEN 'BACKEND_UNAVAILABLE' WHEN s = 401 THEN 'AUTH_INVALID' WHEN s IN (403, 429) THEN 'QUOTA_EXCEEDED' WHEN s >= 500 THEN 'SERVER_ERROR' ELSE 'REQUEST_INVALID' END AS http,
 s IS NULL OR s IN (408, 429) OR (s >= 500 AND s < 600) AS retry, g IN (4, 8, 10, 13, 14, 15) AND NOT (g = 8 AND event_id % 2 = 0) AS stream FROM
 (SELECT event_id, CASE WHEN event_id % 23 <> 0 THEN 400 + 3 * (json_extract_string(props, '$.k'))::INT + event_id % 3 END AS s, event_id % 18 AS g FROM events) JOIN (VALUES {SQL_FAILURES}) f(k, raw, code) ON f.k = event_id % {len(FAILURES)}""")
def error_codes(spark, sf):
    n = F.col("event_id")
    status = F.when(n % 23 != 0, 400 + 3 * F.get_json_object("props", "$.k").cast("int") + n % 3)
    raw = F.element_at(F.array(*[F.lit(text) for text, _ in FAILURES]), (n % len(FAILURES) + 1).cast("int"))
    e = read(spark, sf, "events").select("event_id", raw.alias("raw"), status.alias("s"))
    detail = F.when(n % 2 == 0, "Credits exhausted").otherwise("slow down")
    return e.select("event_id", classify.error_code("raw").alias("code"), classify.http_code("s").alias("http"), classify.retryable_http("s", connection=F.col("s").isNull()).alias("retry"),
                    classify.retryable_status(n % 18, detail).alias("stream"))


@query("SELECT event_id, greatest(least(0.4::DOUBLE * power(2.0::DOUBLE, (event_id % 9)::DOUBLE), 20.0::DOUBLE), 0.05::DOUBLE) AS seconds FROM events")
def backoff(spark, sf):
    return read(spark, sf, "events").select("event_id", scalars.backoff_seconds((F.col("event_id") % 9 + 1).cast("double")).alias("seconds"))


@query("""SELECT event_id, CASE WHEN ms < 60000 THEN floor(ms / 1000.0 + 0.5)::BIGINT || 's ago' WHEN ms < 3600000 THEN floor(ms / 60000.0 + 0.5)::BIGINT || 'm ago' WHEN ms < 86400000 THEN floor(ms / 3600000.0 + 0.5)::BIGINT || 'h ago'
 ELSE floor(ms / 86400000.0 + 0.5)::BIGINT || 'd ago' END AS age FROM (SELECT event_id, CASE event_id % 4 WHEN 0 THEN event_id * 37 % 120000 WHEN 1 THEN event_id * 3701 % 7200000 WHEN 2 THEN event_id * 86413 % 180000000 ELSE event_id * 86400013 % 900000000 END AS ms FROM events)""")
def relative_time(spark, sf):
    """Ages in milliseconds on both sides of every edge."""
    n = F.col("event_id")
    ms = F.when(n % 4 == 0, n * 37 % 120_000).when(n % 4 == 1, n * 3701 % 7_200_000).when(n % 4 == 2, n * 86_413 % 180_000_000).otherwise(n * 86_400_013 % 900_000_000)
    return read(spark, sf, "events").select("event_id", scalars.relative_time(ms).alias("age"))


@query(f"""WITH l AS (SELECT lang, count(*) AS n FROM documents WHERE lang IS NOT NULL GROUP BY lang), a AS (SELECT string_agg(lang || ' (' || n || ')', ', ' ORDER BY n DESC, lang) AS languages FROM l)
 SELECT (SELECT count(*) FROM documents) AS files, (SELECT sum({SQL_LINES.format('text')})::BIGINT FROM documents) AS lines, (SELECT count(*) FROM pages) AS modules, (SELECT count(*) FROM conversations) AS functions, (SELECT count(DISTINCT conv_id) FROM conversations) AS classes, languages FROM a""")
def statistics(spark, sf):
    talk = read(spark, sf, "conversations").select("conv_id")
    return reports.statistics(read(spark, sf, "documents"), "lang", scalars.line_count("text"), modules=(read(spark, sf, "pages").select("page_id"), F.count("*")),
                              functions=(talk, F.count("*")), classes=(talk, F.countDistinct("conv_id"))).select("files", "lines", "modules", "functions", "classes", "languages")


@query(f"""SELECT module, count(*) AS items, string_agg(path, ' ' ORDER BY page_id) FILTER (WHERE n <= 12) AS listed FROM (SELECT page_id, {SQL_PATH} AS path, CASE WHEN page_id % 9 = 0 THEN 'root' ELSE {SQL_HOST} END AS module,
 row_number() OVER (PARTITION BY CASE WHEN page_id % 9 = 0 THEN 'root' ELSE {SQL_HOST} END ORDER BY page_id) AS n FROM pages) GROUP BY 1""")
def module_groups(spark, sf):
    """Pages without a host go to the root; a group lists its first twelve."""
    module = F.when(F.col("page_id") % 9 == 0, "").otherwise(F.col("host"))
    return reports.grouped(paged(spark, sf), module, "path", "page_id", 12).withColumn("listed", F.array_join("listed", " "))


@query("SELECT event_id, CASE WHEN event_id % 6 IN (0, 1, 2) THEN (json_extract_string(props, '$.k'))::INTEGER END AS k, event_id % 6 <> 3 AND event_id % 6 <> 5 AS found FROM events")
def json_recover(spark, sf):
    """JSON alone, in prose, after a string with a brace; a list; a blank reply; a first brace that opens no JSON."""
    n, fence = F.col("event_id") % 6, F.lit("```json\n")
    reply = (F.when(n == 0, F.concat(F.lit(" "), "props")).when(n == 1, F.concat(F.lit("Sure, here it is:\n"), fence, "props", F.lit("\n``` done }"))).when(n == 2, F.concat(F.lit('He said "so": '), "props"))
             .when(n == 3, F.concat(F.lit("["), "props", F.lit("]"))).when(n == 4, F.lit(" \n")).otherwise(F.concat(F.lit('Sure, {here "} it is:\n'), fence, "props", F.lit("\n``` done }"))))
    out = parsers.recover_json(read(spark, sf, "events").select("event_id", reply.alias("reply")), "reply", "found")
    return out.select("event_id", F.get_json_object("found", "$.k").cast("int").alias("k"), F.col("found").isNotNull().alias("found"))


@query("""SELECT doc_id, lang AS language, CASE WHEN length(text) > 240 THEN left(text, 240) || '…' ELSE coalesce(text, '') END AS description, doc_id % 2 = 0 AS has_framework FROM documents""")
def wire_json(spark, sf):
    docs = read(spark, sf, "documents").select("doc_id", F.col("lang").alias("language"), F.col("text").alias("description"), F.when(F.col("doc_id") % 2 == 0, "x").alias("framework"))
    wire = docs.select("doc_id", render.wire(docs.columns[1:], clips={"description": 240}).alias("w"))
    back = F.from_json("w", "language string, description string, framework string")
    return wire.select("doc_id", back["language"].alias("language"), back["description"].alias("description"), (back["framework"].isNotNull() & F.contains("w", F.lit('"framework":"x"'))).alias("has_framework"))


SQL_QUOTES = "repeat(chr(34), 3)"


@query(f"""SELECT p_partkey, 'def ' || CASE WHEN i = '' THEN 'tool' WHEN regexp_matches(i, '^[0-9]') THEN '_' || i ELSE i END || '():' || chr(10) || '    ' || {SQL_QUOTES} || p_name || {SQL_QUOTES} || chr(10) || '    return {{"ok": True}}' AS source FROM
 (SELECT p_partkey, p_name, regexp_replace(regexp_replace(lower(trim(CASE p_partkey % 4 WHEN 0 THEN '  ' || p_name || '!' WHEN 1 THEN p_partkey || ' ' || p_name WHEN 2 THEN '--' ELSE p_name END)), '[^a-z0-9_]+', '_', 'g'), '^_+|_+$', '', 'g') AS i FROM part)""")
def render_tools(spark, sf):
    n = F.col("p_partkey") % 4
    name = F.when(n == 0, F.concat(F.lit("  "), "p_name", F.lit("!"))).when(n == 1, F.concat_ws(" ", "p_partkey", "p_name")).when(n == 2, "--").otherwise(F.col("p_name"))
    part = read(spark, sf, "part").select("p_partkey", name.alias("name"), F.col("p_name").alias("purpose"), F.lit("").alias("body"))
    return part.select("p_partkey", render.tool("name", F.array().cast("array<string>"), F.array().cast("array<string>"), "purpose", "body").alias("source"))


@query(r"""SELECT page_id, len(regexp_extract_all(html, '<a href="/[^"\\\n]*"'))::BIGINT AS routes FROM pages WHERE regexp_matches(html, '<a href="/[^"\\\n]*"')""")
def parse_routes(spark, sf):
    """A TypeScript file of each page: a route for each link, once more in a comment and in a template, and the page as a comment."""
    links = F.regexp_extract_all("html", F.lit(r'<a href="(/[^"\\\n]*)"'), F.lit(1))
    lines = F.transform(links, lambda x: F.concat(F.lit('app.get("'), x, F.lit('", handler); // app.get("'), x, F.lit('")\n`app.put("'), F.replace(x, F.lit("`")), F.lit('")`\n')))
    text = F.concat(F.lit("/* "), F.replace("html", F.lit("*/")), F.lit(" */\n"), F.array_join(lines, ""))
    pages = read(spark, sf, "pages").select(F.col("page_id").cast("string").alias("rel_path"), F.lit("typescript").alias("language"), F.lit("").alias("module"), text.alias("source"))
    found = parsers.extract(pages).where("kind = 'endpoint' and method = 'GET'")
    return found.groupBy(F.col("rel_path").cast("long").alias("page_id")).agg(F.count("*").alias("routes"))


@query("""WITH d AS (SELECT d.doc_id, d.source, coalesce(l.quality, 0) AS quality FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id), r AS (SELECT *, row_number() OVER (ORDER BY quality DESC, doc_id) AS r FROM d),
 v AS (SELECT *, CASE WHEN r > 240 THEN 'LOW' WHEN quality = 1 THEN 'HIGH' ELSE 'LOW' END AS band FROM r), c AS (SELECT source, count(*) AS n, min(doc_id) AS first FROM v WHERE band = 'HIGH' GROUP BY source HAVING count(*) >= 2)
 SELECT source || '_workflow' AS cluster, n, least(1.0::DOUBLE, 0.5::DOUBLE + 0.1::DOUBLE * n) AS confidence FROM c ORDER BY confidence DESC, first, cluster LIMIT 5""")
def compose(spark, sf):
    """Rank, shard, classify with a pluggable scorer, complete, promote, cluster, propose."""
    docs = read(spark, sf, "documents").select("doc_id", "source", "lang").join(read(spark, sf, "labels").select("doc_id", "quality"), "doc_id", "left")
    rows = docs.select("doc_id", "source", "lang", F.coalesce("quality", F.lit(0)).alias("quality"))
    scorer = F.when(F.col("quality") == 1, "HIGH").otherwise("LOW")
    return pipeline.propose(rows, name="doc_id", hint="source", module="lang", order=[F.col("quality").desc(), F.col("doc_id")], scorer=scorer).select("cluster", "n", "confidence")


@query("SELECT c_custkey, rpad(left(c_name, 5), 20, '*') AS masked, CASE WHEN c_acctbal >= 0.8 THEN 'HIGH' WHEN c_acctbal >= 0.5 THEN 'MEDIUM' ELSE 'LOW' END AS band, greatest(0, 5000 - floor(c_acctbal)::BIGINT) AS remaining FROM customer")
def small_scalars(spark, sf):
    c = read(spark, sf, "customer")
    return c.select("c_custkey", scalars.mask_key("c_name").alias("masked"), scalars.confidence_band("c_acctbal").alias("band"), scalars.remaining(F.lit(5000), F.floor("c_acctbal").cast("long")).alias("remaining"))


@query("SELECT page_id, regexp_matches(lower(url), '^(https?|ftp)://') AS allowed, sha256(coalesce(CASE WHEN page_id % 2 = 0 THEN url END, html)) AS repo FROM pages")
def url_and_repo_hash(spark, sf):
    p = read(spark, sf, "pages")
    return p.select("page_id", scalars.url_scheme_allowed("url").alias("allowed"), scalars.repo_hash(F.when(F.col("page_id") % 2 == 0, F.col("url")), F.col("html")).alias("repo"))



@query("""SELECT user_id, event_id, (n // 30)::INTEGER AS batch, (n % 30)::INTEGER AS local FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts) - 1 AS n FROM events)""")
def batches(spark, sf):
    e = read(spark, sf, "events").select("user_id", "event_id", "ts")
    return candidates.numbered_batches(e, ["user_id"], ["ts"], 30).select("user_id", "event_id", "batch", "local")


@query(f"""SELECT page_id, CASE WHEN {SQL_PATH} LIKE '/es/%' THEN 1 WHEN split_part(p, '/', 2) LIKE '%test_%' THEN 2 WHEN starts_with(h, 'm.') THEN 4 WHEN starts_with(h, 'blog') THEN 5 WHEN starts_with(h, 'www') THEN 6 END AS tier
 FROM (SELECT page_id, url, {SQL_PATH} AS p, {SQL_HOST} AS h FROM pages)""")
def candidate_functions(spark, sf):
    p = paged(spark, sf)
    path = F.when(p.path.startswith("/es/"), F.concat(F.lit("tests"), "path")).otherwise(F.concat(F.lit("app"), "path"))
    name = F.when(p.host.startswith("m."), F.concat(F.lit("_"), "host")).when(p.host.startswith("www"), F.concat(F.lit("is_"), "host")).otherwise(F.concat(F.lit("x"), "host"))
    return p.select("page_id", candidates.rejected_tier(path, name, F.when(p.host.startswith("blog"), F.array(F.lit("property")))).alias("tier"))


@query(f"""SELECT page_id AS ord, CASE WHEN page_id % 5 = 4 THEN 'POST' ELSE 'GET' END AS method, '${{ENDPOINT_BASE_URL}}' || {SQL_PATH} AS url, 'Get ' || upper(left(l, 1)) || substring(l, 2) AS name,
 CASE WHEN page_id % 2 = 0 THEN 'page' ELSE CASE WHEN page_id % 5 = 4 THEN 'PATCH' ELSE 'GET' END || ' ' || {SQL_PATH} END AS description FROM (SELECT *, split_part({SQL_PATH}, '/', 2) AS l FROM pages)""")
def endpoint_view(spark, sf):
    p = paged(spark, sf)
    e = p.select(F.col("page_id").alias("ord"), F.when(F.col("page_id") % 5 == 4, "PATCH").otherwise("GET").alias("method"), "path",
                 F.concat(F.lit("get_"), F.split_part("path", F.lit("/"), F.lit(2))).alias("name"), F.when(F.col("page_id") % 2 == 0, "page").alias("description"))
    return candidates.published(e)


@query("""SELECT DISTINCT d.doc_id, w AS name FROM (SELECT doc_id, unnest(regexp_extract_all(replace(text, ' ', '('), '\\b([A-Za-z_][A-Za-z0-9_]*)\\(', 1)) AS w FROM documents) d
 WHERE w IN (SELECT split_part(text, ' ', 1) FROM benchmark)""")
def called_functions(spark, sf):
    docs = read(spark, sf, "documents").select("doc_id", F.replace("text", F.lit(" "), F.lit("(")).alias("body"))
    return candidates.called_functions(docs, read(spark, sf, "benchmark").select(F.split_part("text", F.lit(" "), F.lit(1)).alias("name")), "doc_id", "body", "name")


@query("""SELECT s_suppkey AS token_id, CASE WHEN s_suppkey % 3 = 0 THEN s_suppkey WHEN s_suppkey % 3 = 1 THEN s_suppkey END AS owner FROM supplier""")
def key_owner(spark, sf):
    s = read(spark, sf, "supplier")
    keys = s.select("s_suppkey", F.sha2("s_name", 256).alias("prefix"))
    tokens = keys.select(F.col("s_suppkey").alias("token_id"), F.when(F.col("s_suppkey") % 3 == 0, F.col("s_suppkey")).alias("embedded"), F.when(
        F.col("s_suppkey") % 3 == 1, F.concat("prefix", F.lit(".rest"))).otherwise("none").alias("shown"))
    return candidates.key_owner(keys, tokens, "s_suppkey", "prefix").select("token_id", "owner")


@query("""SELECT c_custkey, CASE WHEN n >= 1000000 THEN printf('%.1fM', n / 1000000.0) WHEN n >= 1000 THEN printf('%.1fK', n / 1000.0) ELSE n::VARCHAR END AS shown, n % 7 > 3 AS newer FROM (SELECT c_custkey, c_custkey * 700 + 1 AS n FROM customer)""")
def numbers_and_versions(spark, sf):
    c = read(spark, sf, "customer").select("c_custkey", (F.col("c_custkey") * 700 + 1).alias("n"))
    return c.select("c_custkey", scalars.human_number("n").alias("shown"), scalars.version_newer(F.concat(F.lit("1."), F.col("n") % 7, F.lit(".0")), F.lit("1.3")).alias("newer"))


@query("""SELECT n_nationkey, n_name, CASE WHEN n_nationkey % 3 = 0 THEN 1 ELSE 5 END AS created, CASE WHEN n_nationkey % 2 = 0 THEN 5 ELSE 1 END AS updated FROM nation WHERE n_nationkey % 2 = 0 OR n_nationkey % 3 = 0""")
def binding_upsert(spark, sf):
    n = read(spark, sf, "nation").select("n_nationkey", "n_name")
    old = n.where("n_nationkey % 3 = 0").withColumn("created", F.lit(1)).withColumn("updated", F.lit(1))
    new = n.where("n_nationkey % 2 = 0").withColumn("created", F.lit(5)).withColumn("updated", F.lit(5))
    return sessions.upsert(old, new, ["n_nationkey", "n_name"], "created", "updated")


@query("""SELECT n_name AS key, 'a' || n_nationkey AS value FROM nation WHERE n_regionkey < 3 UNION ALL SELECT n_name, 'b' || n_nationkey FROM nation WHERE n_regionkey >= 3""")
def merged_settings(spark, sf):
    n = read(spark, sf, "nation")
    row = lambda t, x: t.select(F.col("n_name").alias("key"), F.concat(F.lit(x), "n_nationkey").alias("value"))
    return sessions.merge_lines(row(n.where("n_regionkey < 3"), "a"), row(n, "b"), "key")


@query(f"""WITH o AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY ord, page_id) AS n FROM ({SQL_OLD})), d AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY ord) AS n FROM ({SQL_NEW}))
 SELECT count(*) FILTER (WHERE o.page_id IS NULL) AS added, count(*) FILTER (WHERE o.page_id IS NOT NULL AND d.ord IS NOT NULL AND (o.title IS DISTINCT FROM d.title OR o.ord <> d.ord)) AS updated,
 count(*) FILTER (WHERE d.ord IS NULL) AS removed, count(*) FILTER (WHERE o.title IS NOT DISTINCT FROM d.title AND o.ord = d.ord) AS unchanged FROM o FULL JOIN d ON o.host = d.host AND o.n = d.n""")
def sync_summary(spark, sf):
    return changes.sync_summary(sync_plan(spark, sf))


@query("""SELECT source, lang, n, calls FROM (SELECT source, lang, count(*) AS n FROM documents GROUP BY ALL) d JOIN (SELECT x.lang AS l, coalesce(c.calls, 0) AS calls FROM (SELECT DISTINCT lang FROM documents) x
 LEFT JOIN (SELECT role AS lang, count(*) AS calls FROM (SELECT CASE role WHEN 'user' THEN 'en' WHEN 'assistant' THEN 'de' ELSE role END AS role FROM conversations) GROUP BY role) c ON c.lang = x.lang) ON l IS NOT DISTINCT FROM lang""")
def with_calls(spark, sf):
    rows = read(spark, sf, "documents").groupBy("source", "lang").agg(F.count("*").alias("n"))
    role = F.when(F.col("role") == "user", "en").when(F.col("role") == "assistant", "de").otherwise(F.col("role"))
    return ranking.with_calls(rows, read(spark, sf, "conversations").groupBy(role.alias("lang")).agg(F.count("*").alias("calls")), "lang")


@query("""SELECT s_suppkey AS key, CASE WHEN s_suppkey % 5 = 0 THEN 'k' || s_suppkey || '="' || v || '"' ELSE 'k' || s_suppkey || '=' || v END AS line FROM (SELECT s_suppkey, CASE WHEN s_suppkey % 5 = 0 THEN 'a b' ELSE 'x' || s_suppkey END AS v FROM supplier) WHERE s_suppkey % 3 <> 0""")
def appended_lines(spark, sf):
    s = read(spark, sf, "supplier").select("s_suppkey", F.concat(F.lit("k"), "s_suppkey").alias("key"), F.when(F.col("s_suppkey") % 5 == 0, "a b").otherwise(F.concat(F.lit("x"), "s_suppkey")).alias("value"))
    out = sessions.appended_lines(s.where("s_suppkey % 3 = 0"), s, "key", "value")
    return out.select(F.substring("key", 2, 20).cast("long").alias("key"), "line")


@query("""SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_custkey * 2 ELSE 1 END AS lines, c_custkey % 7 AS other FROM customer""")
def moved_baselines(spark, sf):
    c = read(spark, sf, "customer")
    table = c.select("c_custkey", F.lit(1).cast("long").alias("lines"), (F.col("c_custkey") % 7).alias("other"))
    return sessions.moved_baselines(table, c.where("c_custkey % 3 = 0").select("c_custkey", (F.col("c_custkey") * 2).alias("total")), "c_custkey", "total", ["lines"])


@query("""SELECT n_name AS field, CASE WHEN n_regionkey = 4 THEN 'pinned' WHEN n_regionkey IN (1, 2) AND n_nationkey % 2 = 0 THEN 'global' ELSE 'flag' END AS value FROM nation""")
def config_resolved(spark, sf):
    """A flag wins over a global value; conditional fields of another provider do not count; a pin wins over all."""
    n = read(spark, sf, "nation").select("n_nationkey", "n_regionkey", F.col("n_name").alias("field"))
    provider = F.when(F.col("n_nationkey") % 2 == 0, "other").otherwise("mine")
    rows = n.select("field", F.lit("flag").alias("value"), F.lit(1).alias("priority"), provider.alias("provider")).unionByName(n.select("field", F.lit("global").alias("value"), F.lit(4).alias("priority"), F.lit("mine").alias("provider")))
    return sessions.resolved(rows, "field", "value", "priority", "provider", "mine", n.where("n_regionkey in (1, 2)"), "pinned", n.where("n_regionkey = 4"))


@query("""SELECT source, CASE WHEN bool_or(lang = 'en') THEN 'a' ELSE 'b' END AS key_wins, count(*) FILTER (WHERE lang IS NOT NULL) > 0 AS filled FROM documents GROUP BY source""")
def merged_map(spark, sf):
    """Of two maps the later one wins; a module counts as filled if one of its counts is."""
    g = read(spark, sf, "documents").groupBy("source").agg(F.bool_or(F.col("lang") == "en").alias("en"), F.count("lang").alias("n"))
    later = F.when(F.col("en"), F.create_map(F.lit("k"), F.lit("a")))
    merged = g.withColumn("m", scalars.merged_map(F.create_map(F.lit("k"), F.lit("b"), F.lit("z"), F.lit("c")), later))
    filled = reports.filled(g, "n").select(F.col("source").alias("s"), F.lit(True).alias("f"))
    return merged.join(filled, F.col("source").eqNullSafe(F.col("s")), "left").select("source", F.col("m")["k"].alias("key_wins"), F.coalesce("f", F.lit(False)).alias("filled"))


@query("""SELECT event_id, event_id * 1000 + greatest(CASE WHEN event_id % 3 = 0 THEN 15 ELSE (event_id % 4) / 4.0 END * 60000, 30000)::BIGINT AS deadline, strftime(ts, '%Y-%m-%d') AS day, coalesce(event_id % 5 <> 1 AND event_id % 5 >= 3, true) AS due FROM events""")
def deadlines(spark, sf):
    n = F.col("event_id")
    e = read(spark, sf, "events").withColumn("iso", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"))
    checked = F.lit(10**12) - F.when(n % 5 >= 3, 86_400_000).otherwise(86_399_999)
    return e.select("event_id", scalars.deadline_ms((n * 1000).cast("long"), F.when(n % 3 != 0, (n % 4) / 4)).alias("deadline"), scalars.day_part("iso").alias("day"), scalars.check_due(F.lit(10**12), checked).alias("due"))


@query("""SELECT s_suppkey, list_filter(['a', 'b', 'c'], lambda k: NOT list_contains([['a', 'b', 'c'][1 + s_suppkey % 3], ['a', 'b', 'c'][1 + s_suppkey % 2]], k)) AS missing FROM supplier""")
def missing_keys(spark, sf):
    pick = lambda m: F.element_at(F.array(F.lit("a"), F.lit("b"), F.lit("c")), (F.col("s_suppkey") % m + 1).cast("int"))
    text = F.concat(F.lit('{"'), pick(3), F.lit('": 1, "'), pick(2), F.lit('": {"c": 2}}'))
    return read(spark, sf, "supplier").select("s_suppkey", text.alias("t")).select("s_suppkey", reports.missing_keys("t", ["a", "b", "c"]).alias("missing"))


@query("""SELECT doc_id, coalesce(m.name, 'x') || ' | ' || left(replace(coalesce(text, ''), chr(10), ' '), 180) || ' | ' || left(replace(coalesce(lang, ''), chr(10), ' '), 200) AS summary, len(m.hints) AS hints FROM documents d
 LEFT JOIN (SELECT doc_id AS id, 'f' || doc_id AS name, ['toxic'] AS hints FROM labels WHERE toxic = 1) m ON m.id = d.doc_id""")
def manifest_view(spark, sf):
    d = read(spark, sf, "documents").select("doc_id", F.lit("m").alias("module"), F.concat(F.lit("f"), "doc_id").alias("qualname"), F.col("text").alias("signature"), F.col("lang").alias("docstring"), F.lit(False).alias("is_async"))
    toxic = read(spark, sf, "labels").select(F.concat(F.lit("f"), "doc_id").alias("qualname"), F.when(F.col("toxic") == 1, F.array(F.lit("toxic"))).otherwise(F.array().cast("array<string>")).alias("workflow_hints"))
    view = candidates.manifest_view(d, toxic, "qualname").withColumn("shown", F.when(F.col("workflow_hints").isNotNull(), F.col("qualname")).otherwise("x"))
    return view.select(F.substring("qualname", 2, 20).cast("long").alias("doc_id"), candidates.summary("shown", "signature", "docstring").alias("summary"), F.size("workflow_hints").cast("long").alias("hints")).withColumn(
        "hints", F.when(F.col("hints") > 0, F.col("hints")))


@query("""SELECT c_custkey, c_custkey % 3 <> 0 AND c_custkey % 5 <= 2 AS valid, CASE c_custkey % 6 WHEN 0 THEN 'us-gov' WHEN 1 THEN 'us' WHEN 2 THEN 'us' WHEN 3 THEN 'eu' WHEN 4 THEN 'apac' ELSE 'global' END AS geo,
 c_custkey % 8 < 4 AS overflow, c_custkey % 2 = 0 AS cache, CASE WHEN c_custkey % 4 = 0 THEN 'V' END AS variable FROM customer""")
def proposal_checks(spark, sf):
    k = F.col("c_custkey")
    c = read(spark, sf, "customer").select("c_custkey", F.when(k % 3 != 0, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array(F.lit("a"))).alias("f"), (k % 5 / 2).alias("confidence"))
    region = F.element_at(F.array(*[F.lit(r) for r in ("us-gov-1", "us-east", "ca-1", "eu-x", "ap-2", "me-1")]), (k % 6 + 1).cast("int"))
    mark = F.element_at(F.array(*[F.lit(t) for t in ("Reduce the LENGTH", "string too long", "Prompt is too long", "context_length_exceeded", "fine", "exceeds the maximum", "", "input is too long")]), (k % 8 + 1).cast("int"))
    model = F.when(k % 2 == 0, "eu.amazon.nova-1").otherwise("xamazon.nova")
    values = F.when(k % 4 == 0, F.array(F.lit("a ${V} ${W}"))).otherwise(F.array(F.lit("$V")))
    return c.select("c_custkey", candidates.valid_proposals(c, "f", "confidence").alias("valid"), classify.geography(region).alias("geo"), classify.context_overflow(mark).alias("overflow"),
                    classify.model_family(model)["cache"].alias("cache"), F.get(scalars.header_variables(values), 0).alias("variable"))


@query("""SELECT source, bool_or(toxic = 1) AS auto, bool_or(toxic = 1 OR quality = 1) AS custom FROM documents JOIN labels USING (doc_id) GROUP BY source""")
def usable_cache(spark, sf):
    """For every source: whether its rows would serve either use."""
    rows = read(spark, sf, "documents").select("doc_id", "source").join(read(spark, sf, "labels"), "doc_id")
    return changes.usable_cache(rows, F.col("toxic"), F.col("quality"), True, ["source"])


@query("""SELECT page_id, 'function' AS kind, 'f' || page_id AS name, 2 AS start_line FROM pages UNION ALL SELECT page_id, 'class', 'C', 1 FROM pages WHERE page_id % 2 = 0""")
def code_chunks(spark, sf):
    """Pages as the documentation of generated files with a class or without, and a function."""
    doc = F.regexp_replace(F.coalesce("url", F.lit("")), r'["\\]', "")
    n = F.col("page_id").cast("string")
    text = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("class C:\n    def f"), n, F.lit('(self):\n        """'), doc, F.lit('"""\n'))).otherwise(F.concat(F.lit("x = 1\ndef f"), n, F.lit('():\n    """'), doc, F.lit('"""\n')))
    files_ = read(spark, sf, "pages").select(n.alias("rel_path"), text.alias("source"))
    return describe.chunks(files_).select(F.col("rel_path").cast("long").alias("page_id"), "kind", "name", "start_line")


@query("""SELECT page_id, 'unknown_callee' AS kind, 'g' || page_id AS detail FROM pages WHERE page_id % 3 = 0 AND page_id % 4 <> 2 UNION ALL SELECT page_id, 'inline_helper', 'h' FROM pages WHERE page_id % 4 = 1 UNION ALL SELECT page_id, 'syntax_error', 'the body does not parse' FROM pages WHERE page_id % 4 = 2""")
def body_audit(spark, sf):
    """Bodies that call an own name or a listed one, hold a function, or do not parse."""
    n, k = F.col("page_id").cast("string"), F.col("page_id")
    call = F.concat(F.lit("x = g"), n, F.lit("(len([1]))\n"))
    body = F.when(k % 4 == 1, F.concat(F.lit("def h():\n    return 1\n"), call)).when(k % 4 == 2, "x = (").otherwise(F.concat(call, F.lit("return a.b(x)")))
    pages = read(spark, sf, "pages")
    known = pages.where("page_id % 3 <> 0").select(F.concat(F.lit("g"), n).alias("qualname"))
    found = describe.audited(pages.select("page_id", body.alias("body")), known, "page_id", "body", "qualname")
    return found


@query("""SELECT list_aggregate(list_transform(list_sort(list(struct_pack(o := n_nationkey, t := 'def get_' || n_nationkey || '_' || lower(replace(n_name, ' ', '_')) || '(id: Any = None'))), lambda x: x.t), 'string_agg', '; ') AS heads, list_sort(list_distinct(list(CASE WHEN n_nationkey % 2 = 0 THEN 'TOKEN_' || n_regionkey END) || ['ENDPOINT_BASE_URL'])) AS variables FROM nation""")
def endpoint_server(spark, sf):
    """A server of one tool for each nation: the heads of its functions, and the variables that it reads."""
    n = read(spark, sf, "nation")
    header = F.array(F.struct(F.lit("Authorization").alias("key"), F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit("Bearer ${TOKEN_"), "n_regionkey", F.lit("}"))).otherwise("x").alias("value")))
    rows = n.select(F.col("n_nationkey").alias("ord"), F.lit("GET").alias("method"), F.concat(F.lit("/n/{id}/"), "n_nationkey").alias("path"), F.lit(None).cast("string").alias("description"), F.lit(None).cast("string").alias("payload"),
                    header.alias("headers"), F.concat_ws(" ", F.lit("get"), "n_nationkey", "n_name").alias("name"))
    made = render.server(rows, "nations")
    heads = F.regexp_extract_all("source", F.lit(r"(def [^)]*)\)"), F.lit(1))
    return made.select(F.array_join(heads, "; ").alias("heads"), F.sort_array("variables").alias("variables"))


@query(r"""SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'id' || c_custkey END AS claim, left(c_name, 5) || repeat('*', 15) AS shown, c_custkey % 2 = 0 AS same, 'a\.b\(' || c_custkey || '\)' AS pattern, c_custkey % 3 <> 0 AS word FROM customer""")
def key_claims(spark, sf):
    """The claim of a well-formed token, a key for display, equal serialised values, and patterns of literals and words."""
    k = F.col("c_custkey")
    claims = F.when(k % 4 == 3, F.concat(F.lit('{"api_key_id":'), k, F.lit("}"))).otherwise(F.concat(F.lit('{"api_key_id":"id'), k, F.lit('"}')))
    body = F.regexp_replace(F.translate(F.base64(F.encode(claims, "utf-8")), "+/", "-_"), "=", "")
    token = F.concat(F.when(k % 4 == 1, "syn_test_x.").otherwise("syn_live_x."), body, F.when(k % 4 == 2, ".s.s").otherwise(".s"))
    same = scalars.same_json(F.lit('{"a":1,"b":2}'), F.when(k % 4 == 0, '{"a":1,"b":2}').when(k % 4 == 2, ' { "a" : 1.0, "b":2e0}\n').otherwise('{"b":2,"a":1}'))
    worded = F.concat(F.when(k % 3 == 0, "x_").otherwise("x "), "c_name").rlike(scalars.word_pattern("Customer"))
    return read(spark, sf, "customer").select("c_custkey", scalars.key_id(token).alias("claim"), scalars.redacted("c_name").alias("shown"), same.alias("same"),
                                             scalars.literal_pattern(F.concat(F.lit("a.b("), k, F.lit(")"))).alias("pattern"), worded.alias("word"))


@query(f"""SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'POST' WHEN 2 THEN 'GET' END AS method, CASE WHEN page_id % 4 IN (0, 2) THEN coalesce({SQL_PATH}, '') || '/p' END AS path, page_id % 3 = 0 AS hidden FROM pages""")
def mux_patterns(spark, sf):
    """Patterns with a method, with one that is not routed, with a path alone and with none; folders that begin with an underscore."""
    p, k = paged(spark, sf), F.col("page_id")
    path = F.concat(F.coalesce("path", F.lit("")), F.lit("/p"))
    pattern = F.when(k % 4 == 0, F.concat(F.lit("POST h.example"), path)).when(k % 4 == 1, F.concat(F.lit("HEAD "), path)).when(k % 4 == 2, path).otherwise("none")
    file = F.concat(F.lit("a/"), F.when(k % 3 == 0, "_b").otherwise("b"), F.lit("/_c"), k.cast("string"), F.lit(".py"))
    made = scalars.go_pattern(pattern)
    return p.select("page_id", made["method"].alias("method"), made["path"].alias("path"), files.underscore_folder(file).alias("hidden"))


@query("""SELECT DISTINCT '0d' || page_id % 7 AS sort_key, 1::INTEGER AS depth, 'd' || page_id % 7 || '/' AS line FROM pages UNION ALL
 SELECT DISTINCT '0d' || page_id % 7 || '|1f' || page_id % 50 || '.py', 2::INTEGER, '    f' || page_id % 50 || '.py' FROM pages""")
def project_tree(spark, sf):
    """The tree of a project as lines, folders before files."""
    k = F.col("page_id")
    paths = read(spark, sf, "pages").select(F.concat(F.lit("d"), k % 7, F.lit("/f"), k % 50, F.lit(".py")).alias("rel_path"))
    return trees.tree_lines(paths).select(F.array_join("sort_key", "|").alias("sort_key"), "depth", "line")


@query(f"""SELECT action, id, ord, fields, CASE action WHEN 'create' THEN 1 WHEN 'update' THEN 2 ELSE 3 END::INTEGER AS step FROM ({QUERIES['sync_plan'][1]}) WHERE action <> 'unchanged'""")
def apply_order(spark, sf):
    return changes.apply_order(sync_plan(spark, sf))


@query("""SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)""")
def promoted(spark, sf):
    """The functions that a verdict names; verdicts without a name are none."""
    name = F.concat(F.lit("f"), "doc_id")
    verdicts = read(spark, sf, "labels").select(F.when(F.col("toxic") == 1, name).otherwise("").alias("name"))
    return candidates.promoted(read(spark, sf, "documents").select("doc_id", name.alias("name")), verdicts, "name").select("doc_id")


@query("""SELECT r.name, r.ord, w.place FROM (SELECT 'n' || p_partkey % 500 AS name, max(p_partkey) AS ord FROM part GROUP BY ALL) r JOIN (SELECT 'n' || p_partkey % 500 AS name, min(p_partkey) AS place FROM part WHERE p_partkey % 7 = 3 GROUP BY ALL) w ON w.name = r.name""")
def chosen(spark, sf):
    """The wanted functions in the order asked, the last of each name."""
    part = read(spark, sf, "part").select(F.concat(F.lit("n"), F.col("p_partkey") % 500).alias("name"), F.col("p_partkey").alias("ord"))
    wanted = part.where("ord % 7 = 3").select("name", F.col("ord").alias("place"))
    return candidates.chosen(part, wanted, part.where("ord % 2 = 0"), "name", "ord")


@query("""SELECT doc_id, 2::INTEGER AS tier FROM labels WHERE quality = 1 AND EXISTS (SELECT 1 FROM labels WHERE quality = 1) UNION ALL SELECT doc_id, 3::INTEGER FROM documents WHERE NOT EXISTS (SELECT 1 FROM labels WHERE quality = 1)""")
def source_of_truth(spark, sf):
    """Neither a session nor a discovered one: the snapshot, else a new scan."""
    docs, labels = read(spark, sf, "documents").select("doc_id"), read(spark, sf, "labels")
    none = docs.where("doc_id is null and doc_id is not null")
    return sessions.source_of_truth(none, none, labels.where("quality = 1").select("doc_id"), docs)


@query("""SELECT CASE WHEN count(*) FILTER (WHERE page_id % 5 = 2) > 0 THEN 'go' WHEN count(*) > 0 THEN 'python' ELSE 'go' END AS language FROM pages""")
def detect_language(spark, sf):
    """The marked language with files wins over one with more files."""
    k = F.col("page_id")
    ext = F.when(k % 5 == 2, ".go").when(k % 5 == 4, ".md").otherwise(".py")
    tree = read(spark, sf, "pages").select(F.concat(F.lit("src/f"), k, ext).alias("rel_path"))
    return files.detect_language(tree.unionByName(read(spark, sf, "region").select(F.lit("go.mod").alias("rel_path")).limit(1)))


#: A file of two routes in each language, with routes in comments and strings that are none, and a second class with its own prefix.
_FILES = {
    "python": '# @app.get("/no<n>")\n@app.post("/r<n>")\ndef h<n>(a: int):\n    return """@app.get("/no")"""\n@app.route("/s<n>")\ndef g<n>():\n    pass\n',
    "typescript": "// app.get('/no<n>', h)\napp.route('/r<n>').post(h<n>);\nconst s = \"app.put('/no', h)\";\n@Controller('s<n>')\nclass C { @Get() g<n>() { return `x.get('/no')`; } }\n",
    "java": '/* @GetMapping("/no") */\n@RequestMapping("/r<n>")\nclass C {\n    @PostMapping\n    public String h<n>() { return "@GetMapping(\'/no\')"; }\n}\n@RequestMapping("/s<n>")\nclass D { @GetMapping("/") int g<n>() { return \'"\'; } }\n',
    "csharp": '[Route("r<n>")]\nclass C { // [HttpGet]\n    [HttpPost, Authorize]\n    public string h<n>() => @"[HttpGet(""no"")]";\n}\n[Route("s<n>")] class D { [HttpGet] int g<n>() { return 1; } }\n',
    "go": '// r.GET("/no", h)\nfunc main() {\n\tr.POST("/r<n>", h<n>)\n\tx := `r.GET("/no", h)`\n\tmux.HandleFunc("GET example.com/s<n>", g<n>)\n}\n',
    "rust": '/* /* #[get("/no")] */ */\n#[rocket::post("/r<n>")]\nfn h<n>() { r#"#[get("/no")] fn x()"#; }\nfn m() { Router::new().route("/s<n>", get(g<n>)) }\n',
}


@query("""SELECT page_id, m.method, m.path || page_id AS path, ['python','typescript','java','csharp','go','rust'][page_id % 6 + 1] AS language,
  CASE WHEN m.method = 'POST' AND page_id % 6 = 1 THEN '' ELSE m.name || page_id END AS handler FROM pages, (VALUES ('POST', '/r', 'h'), ('GET', '/s', 'g')) m(method, path, name)""")
def route_files(spark, sf):
    """A file of two routes for each page, in one of six languages."""
    k = F.col("page_id")
    languages = F.array(*[F.lit(x) for x in _FILES])
    n = F.pmod(k, F.lit(len(_FILES))).cast("int")
    made = F.array(*[F.replace(F.lit(t), F.lit("<n>"), k.cast("string")) for t in _FILES.values()])
    found = parsers.extract(read(spark, sf, "pages").select(k.cast("string").alias("rel_path"), F.get(languages, n).alias("language"), F.lit("").alias("module"), F.get(made, n).alias("source")))
    return found.where("kind = 'endpoint'").select(F.col("rel_path").cast("long").alias("page_id"), "method", "path", "language", F.col("qualname").alias("handler"))


@query("""SELECT page_id, page_id % 3 <> 0 AS parse_ok, CASE WHEN page_id % 3 <> 0 THEN 'f' || page_id END AS name, CASE WHEN page_id % 3 <> 0 THEN 'a,b' END AS params, CASE WHEN page_id % 3 <> 0 THEN page_id::VARCHAR END AS default_b FROM pages""")
def function_info(spark, sf):
    """Parameters, and the default of the second, of a generated function; every third file does not parse."""
    n = F.col("page_id").cast("string")
    text = F.concat(F.lit("def f"), n, F.lit("(a: int, b="), n, F.when(F.col("page_id") % 3 == 0, "").otherwise(")"), F.lit(":\n    return a\n"))
    made = describe.function_info(read(spark, sf, "pages").select(n.alias("rel_path"), text.alias("source")))
    return made.select(F.col("rel_path").cast("long").alias("page_id"), "parse_ok", "name", F.array_join("param_names", ",").alias("params"), F.get("param_defaults", F.lit(1)).alias("default_b"))


@query("""SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'parse' ELSE 'import_audit' END AS "check", CASE page_id % 4 WHEN 0 THEN 'the file does not parse' WHEN 1 THEN 'unknown item pkg.m x' || page_id ELSE 'unknown module pkg.no y' END AS detail FROM pages WHERE page_id % 4 <> 3""")
def verified(spark, sf):
    """Generated files that do not parse, import an unknown item, or import an unknown module."""
    n, k = F.col("page_id").cast("string"), F.col("page_id") % 4
    text = F.when(k == 0, "x = (").when(k == 1, F.concat(F.lit("from pkg.m import x"), n, F.lit("\n"))).when(k == 2, "from pkg.no import y\n").otherwise("from pkg.m import known\nimport os\n")
    items = read(spark, sf, "region").select(F.lit("pkg.m").alias("module"), F.lit("known").alias("qualname")).distinct()
    found = describe.verified(read(spark, sf, "pages").select(n.alias("rel_path"), text.alias("source")), items, "pkg")
    return found.select(F.col("rel_path").cast("long").alias("page_id"), "check", "detail")


@query("""WITH n AS (SELECT n_nationkey AS k, n_name FROM nation) SELECT k, 'llm.model' AS path, '"m' || k || '"' AS value, 'project' AS layer FROM n UNION ALL SELECT k, 'llm.limits.max', k::VARCHAR, 'project' FROM n
 UNION ALL SELECT k, 'llm.limits.min', '2', 'global' FROM n UNION ALL SELECT k, 'name', '"' || n_name || '"', 'global' FROM n UNION ALL SELECT k, 'tags', '["a"]', 'global' FROM n""")
def settings_layers(spark, sf):
    """Two documents of every nation, resolved per nested field; null and blank values say nothing."""
    k = F.col("n_nationkey").cast("string")
    mine = F.concat(F.lit('{"llm": {"model": "m'), k, F.lit('", "limits": {"max": '), k, F.lit('}}, "name": null, "tags": "  "}'))
    every = F.concat(F.lit('{"llm": {"model": "g", "limits": {"max": 1, "min": 2}}, "name": "'), F.col("n_name"), F.lit('", "tags": ["a"]}'))
    nations = read(spark, sf, "nation")
    layer = lambda name, priority, text: nations.select(F.col("n_nationkey").alias("k"), F.lit(name).alias("layer"), F.lit(priority).alias("priority"), F.try_parse_json(text).alias("doc"))
    found = settings.layered(layer("project", 1, mine).unionByName(layer("global", 2, every)), ["k"])
    return found.select("k", F.array_join("path", ".").alias("path"), "value", "layer")


@query("""WITH d AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS r FROM documents), s AS (SELECT *, (r - 1) // 12 AS shard FROM d)
 SELECT doc_id, CASE WHEN shard >= 20 OR shard % 4 = 1 OR shard % 4 = 2 THEN 'LOW' WHEN doc_id % 3 = 0 THEN 'HIGH' WHEN doc_id % 3 = 1 THEN 'MEDIUM' ELSE 'LOW' END AS band,
  CASE WHEN shard >= 20 THEN NULL WHEN shard % 4 = 1 THEN 'failed' WHEN shard % 4 = 2 THEN 'invalid' ELSE 'ok' END AS outcome FROM s""")
def shard_verdicts(spark, sf):
    """Documents in shards of which every fourth fails and every fourth gives names that it has not; both are LOW, the others stand."""
    docs = read(spark, sf, "documents").select("doc_id")
    head = ranking.numbered_head(docs, [F.col("doc_id")], 240, "n").withColumn("shard", F.floor((F.col("n") - 1) / 12))

    def scorer(rows):
        kind = int(rows["shard"].iloc[0]) % 4
        if kind == 1:
            raise RuntimeError("no answer")
        bands = rows[["doc_id"]].assign(band=[("HIGH", "MEDIUM", "none")[d % 3] for d in rows["doc_id"]])
        return bands.assign(doc_id=-1 - bands["doc_id"]) if kind == 2 else bands

    verdicts, outcomes = attempts.scored_shards(head, "doc_id", scorer)
    whole = ranking.complete_verdicts(docs, verdicts, "doc_id")
    return whole.join(head.select("doc_id", "shard").join(outcomes.select("shard", "outcome"), "shard").drop("shard"), "doc_id", "left")


@query("""SELECT p_partkey, least(p_partkey % 5 + 1, 3)::INTEGER AS attempt, p_partkey % 5 < 3 AS accepted, CASE WHEN p_partkey % 5 < 3 THEN '' ELSE 'unknown_callee missing' END AS issues FROM part""")
def tool_attempts(spark, sf):
    """Bodies that call an unknown name until an attempt that differs by part; two of five parts never get there."""
    parts = read(spark, sf, "part").select("p_partkey")
    names = spark.createDataFrame([("known",)], "name string")

    def generate(pending, n):
        return pending.select("p_partkey", F.when(F.col("p_partkey") % 5 < n, "return known(1)").otherwise("return missing(1)").alias("made"))

    def check(made):
        return describe.audited(made, names, "p_partkey", "made", "name").select("p_partkey", F.concat_ws(" ", "kind", "detail").alias("issue"))

    found = attempts.attempted(parts, "p_partkey", generate, check)
    return found.select("p_partkey", "attempt", "accepted", F.array_join("issues", ",").alias("issues"))


@query("""WITH p AS (SELECT page_id AS i, 'd' || page_id % 7 AS d, 'f' || page_id || '.py' AS f FROM pages), x AS (SELECT max(d) AS top FROM p), m AS (SELECT d, max(f) AS last FROM p GROUP BY d)
 SELECT 'd/' || d AS key, CASE WHEN d = top THEN '└── ' ELSE '├── ' END || d || '/' AS line FROM m, x UNION ALL
 SELECT 'f/' || p.d || '/' || f, CASE WHEN p.d = top THEN '    ' ELSE '│   ' END || CASE WHEN f = last THEN '└── ' ELSE '├── ' END || f FROM p JOIN m ON m.d = p.d, x UNION ALL
 SELECT 'm/' || d || '/' || f, 'Functions (1):' FROM p WHERE i % 3 <> 0 UNION ALL SELECT 'm/' || d || '/' || f, '  • go' || i || '(a, *rest) -> int' FROM p WHERE i % 3 <> 0""")
def project_schema(spark, sf):
    """The text of a project with a file for each page: its tree, and the functions of its modules."""
    n = F.col("page_id").cast("string")
    path = F.concat(F.lit("d"), (F.col("page_id") % 7).cast("string"), F.lit("/f"), n, F.lit(".py"))
    text = F.when(F.col("page_id") % 3 == 0, "x = 1\n").otherwise(F.concat(F.lit("def go"), n, F.lit("(a, *rest) -> int:\n    return 1\n")))
    paths = read(spark, sf, "pages").select(path.alias("rel_path"), text.alias("source"))
    lines = project.schema_lines(paths.select("rel_path"), project.modules(paths))
    kind = F.when(F.col("part") == 3, "m/").when(F.size("key") == 1, "d/").otherwise("f/")
    shown = F.transform("key", lambda x: F.substring(x, 2, 10_000))
    told = (F.col("part") == 1) | F.col("line").startswith("Functions") | F.col("line").startswith("  •")
    return lines.where(told).select(F.concat(kind, F.array_join(shown, "/")).alias("key"), "line")


@query(f"""WITH d AS (SELECT doc_id, coalesce(lang, 'none') AS lang, {SQL_LINES.format("coalesce(text, '')")} AS lines FROM documents)
 SELECT count(*) FILTER (WHERE lang IN ('en', 'fr')) AS file_count, coalesce(sum(lines) FILTER (WHERE lang IN ('en', 'fr')), 0)::BIGINT AS total_lines_analyzed, count(DISTINCT lang) + 1 AS directory_count, 0::BIGINT AS total_callable_count,
  count(*) FILTER (WHERE lang = 'en') AS go, count(*) FILTER (WHERE lang = 'fr') AS rust, count(*) FILTER (WHERE lang = 'de') AS ruby, count(*) FILTER (WHERE lang = 'es') AS php FROM d""")
def project_statistics(spark, sf):
    """Documents as files of four languages, two of which are only named, in a folder for each language."""
    lang = F.coalesce("lang", F.lit("none"))
    end = F.when(lang == "en", "go").when(lang == "fr", "rs").when(lang == "de", "rb").when(lang == "es", "php").otherwise("txt")
    paths = read(spark, sf, "documents").select(F.concat(lang, F.lit("/"), F.col("doc_id").cast("string"), F.lit("."), end).alias("rel_path"), F.coalesce("text", F.lit("")).alias("source"))
    one = project.statistics(paths, project.modules(paths.limit(0)), "documents")
    n = lambda column, key: F.coalesce(F.col(column)[key], F.lit(0)).alias({"Go": "go", "Rust": "rust", "Ruby": "ruby", "PHP": "php"}[key])
    return one.select("file_count", "total_lines_analyzed", "directory_count", "total_callable_count", n("languages", "Go"), n("languages", "Rust"), n("unsupported_languages", "Ruby"), n("unsupported_languages", "PHP"))


@query("""WITH p AS (SELECT page_id, regexp_extract(url, '^[^:/?#]+://([^/?#]*)', 1) AS host FROM pages), n AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY page_id) - 1 AS r FROM p)
 SELECT page_id, CASE WHEN (r // 3) % 3 = 1 OR r % 3 = 2 THEN 'own' || page_id ELSE 'tool_' || page_id || '_' || r % 3 END AS name, CASE WHEN (r // 3) % 3 = 1 OR r % 3 = 2 THEN '' ELSE 'text ' || page_id END AS description FROM n""")
def endpoint_names(spark, sf):
    """Endpoints of every host, named three at a time; the namer fails on every third batch, and leaves the third of each out."""
    k = F.col("page_id")
    rows = paged(spark, sf).select("page_id", "host", F.concat(F.lit("own"), k).alias("suggested_tool_name"), F.lit("").alias("description"),
                                   F.floor((F.row_number().over(Window.partitionBy("host").orderBy("page_id")) - 1) / 3).alias("part"))

    def namer(batch):
        if batch["part"].iloc[0] % 3 == 1:
            raise RuntimeError("no answer")
        rows = list(zip(batch["index"].tolist(), batch["page_id"].tolist(), strict=True))
        return pd.DataFrame({"index": [i if i < 2 else 9 for i, _ in rows], "tool_name": [f"tool_{p}_{i}" for i, p in rows], "description": [f"text {p}" for _, p in rows]})

    return attempts.named(rows, ["host"], ["page_id"], namer, size=3).select("page_id", F.col("suggested_tool_name").alias("name"), "description")


@query(f"""SELECT count(*) FILTER (WHERE doc_id % 3 <> 0) AS parsed, count(*) FILTER (WHERE doc_id % 3 = 0) AS unchanged, coalesce(sum({SQL_LINES.format("text")}), 0)::BIGINT AS lines_scanned FROM documents""")
def scan_totals(spark, sf):
    """A scan of documents of which the snapshot has a third as they are and a third with other contents."""
    docs = read(spark, sf, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("sha"), "text")
    cached = docs.where("doc_id % 3 <> 1").select("doc_id", F.when(F.col("doc_id") % 3 == 0, F.col("sha")).otherwise("old").alias("sha"))
    return files.scan_totals(docs, cached, "doc_id", "sha", "text")


@query("""SELECT page_id, page_id % 5 <> 4 AS valid FROM pages""")
def valid_manifests(spark, sf):
    """Manifests that lack their language, endpoints, functions or root, each in turn, or only a framework."""
    k = F.col("page_id") % 20
    lacks = lambda n, value: F.when(k == n, F.lit(None)).otherwise(value)
    none = F.array().cast("array<string>")
    rows = read(spark, sf, "pages").select("page_id", lacks(4, F.lit("go")).alias("language"), lacks(0, F.lit("gin")).alias("framework"), lacks(9, none).alias("endpoints"), lacks(14, none).alias("functions"), lacks(19, F.lit("r")).alias("root"))
    return rows.select("page_id", reports.valid_manifest("language", "framework", "endpoints", "functions", "root").alias("valid"))


@query("""WITH d AS (SELECT user_id || ' ' || strftime(ts, '%Y-%m-%d') AS session, event_type, ts, CASE WHEN event_id % 3 = 0 THEN 'b' ELSE 'a' END AS repo FROM events)
 SELECT session, max(ts) FILTER (WHERE event_type = 'view') AS opened FROM d GROUP BY session HAVING NOT bool_or(event_type = 'purchase') AND arg_max(repo, ts) FILTER (WHERE event_type = 'view') = 'a'""")
def resumable_of_repository(spark, sf):
    """Sessions whose last opening is of one of two repositories."""
    days = read(spark, sf, "events").select(F.concat_ws(" ", "user_id", F.date_format("ts", "yyyy-MM-dd")).alias("session"), "event_type", "ts", F.when(F.col("event_id") % 3 == 0, "b").otherwise("a").alias("repo"))
    return sessions.resumable(days, "session", "event_type", "ts", "view", "purchase", ("repo", "a"))


@query("""WITH d AS (SELECT page_id, regexp_extract(url, '^[^:/?#]+://([^/?#]*)', 1) AS host FROM pages) SELECT page_id, (row_number() OVER (PARTITION BY host ORDER BY page_id DESC) - 1)::INTEGER AS display_order FROM d""")
def display_order(spark, sf):
    """The place of each page among those of its host, the latest first."""
    pages = paged(spark, sf).select("page_id", F.coalesce("host", F.lit("")).alias("host"), (-F.col("page_id")).alias("o"))
    return changes.positioned(pages, ["host"], ["o"]).select("page_id", "display_order")


@query("""SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'new' ELSE 'old' END AS sha, CASE WHEN doc_id % 2 = 0 THEN 'POST' ELSE 'GET' END AS method, '/d' || doc_id AS path FROM documents WHERE doc_id % 5 <> 4""")
def next_snapshot(spark, sf):
    """A snapshot of documents, half of which a session has scanned again and a fifth of which are gone; read back as its endpoints."""
    docs = read(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("rel_path"), "doc_id")
    route = lambda method: F.from_json(F.concat(F.lit(f'[{{"method":"{method}","path":"/d'), "rel_path", F.lit('"}]')), f"array<{ledger.ENDPOINT}>")
    previous = docs.select("rel_path", F.lit("old").alias("sha"), route("GET").alias("endpoints"), F.array().cast(f"array<{ledger.FUNCTION}>").alias("functions"))
    scanned = docs.where("doc_id % 2 = 0 and doc_id % 5 <> 4").select("rel_path", F.lit("new").alias("sha"), route("POST").alias("endpoints"), F.array().cast(f"array<{ledger.FUNCTION}>").alias("functions"))
    log = ledger.scanned_records(scanned, "s", 1).withColumn("line_no", F.lit(1))
    whole = ledger.snapshot_of(log, previous, docs.where("doc_id % 5 <> 4"), language="go")
    ends, _ = ledger.manifest(whole)
    return ends.join(whole.select("rel_path", "sha"), "rel_path").select(F.col("rel_path").cast("long").alias("doc_id"), "sha", "method", "path")
