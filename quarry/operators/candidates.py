"""Which functions are candidates, and the tables around composing tools of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import scalars
from quarry.operators.files import SKIP_DIRS, SKIP_FILES

#: Fixed values of the six tiers.
FILE_PARTS = ("test_", "_test.py", "tests.py", "fixtures.py", "test.py")
SEGMENTS = ("/tests/", "/test/", "/_tests/", "/testing/", "/test_", "/_async/", "/_sync/", "/client/", "/clients/", "/plugins/", "/plugin/", "/transport/", "/transports/", "/connection/",
            "/connections/", "/compat/", "/serializer/", "/serializers/", "/exceptions/")
DECORATORS = ("validator", "field_validator", "property", "cached_property", "staticmethod", "abstractmethod", "classmethod", "dataclass", "fixture", "mock", "patch", "pytest")
PREFIXES = ("is_", "has_", "can_")
LIFECYCLE = ("setup", "teardown", "configure", "initialize", "setUp", "tearDown", "setUpClass", "tearDownClass", "setUpModule", "tearDownModule")
BANDS = ("HIGH", "MEDIUM", "LOW", "SKIP")


def rejected_tier(path, name, decorators) -> Column:
    """The first tier against a function, 1 to 6; null for a candidate.

    1 directory, 2 file name, 3 path segment, 4 private or test name, 5 decorator, 6 helper name.
    """
    path, name, decorators = (F.col(x) if isinstance(x, str) else x for x in (path, name, decorators))
    parts = F.split(path, "/")
    last = F.element_at(parts, -1)
    any_of = lambda test, values: F.array_contains(F.array(*[F.coalesce(test(v), F.lit(False)) for v in values]), True)
    folders = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    return (F.when(F.exists(folders, lambda d: d.isin(*SKIP_DIRS) | d.startswith("_")), 1)
            .when(last.isin(*SKIP_FILES, "__init__.py") | any_of(lambda v: F.contains(last, F.lit(v)), FILE_PARTS), 2)
            .when(any_of(lambda v: F.contains(F.concat(F.lit("/"), path), F.lit(v)), SEGMENTS), 3)
            .when(name.startswith("_") | name.startswith("test"), 4)
            .when(F.arrays_overlap(F.coalesce(decorators, F.array().cast("array<string>")), F.array(*[F.lit(d) for d in DECORATORS])), 5)
            .when(any_of(lambda v: name.startswith(v), PREFIXES) | name.isin(*LIFECYCLE), 6))


def numbered_batches(rows: DataFrame, by: list[str], order: list[str], size: int) -> DataFrame:
    """rows with batch and local index, per group."""
    n = F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1
    return rows.withColumn("batch", F.floor(n / size).cast("int")).withColumn("local", (n % size).cast("int"))


def valid_proposals(rows: DataFrame, functions: str, confidence: str) -> Column:
    """At least two members and a confidence between 0 and 1."""
    return F.coalesce((F.size(functions) >= 2) & F.col(confidence).between(0, 1), F.lit(False))


def chosen(rows: DataFrame, wanted: DataFrame, kept: DataFrame, name: str, ordinal: str) -> DataFrame:
    """The wanted rows in the order asked (a repeated name: the last row); none found: the kept ones; else all."""
    from quarry.operators.ranking import first_tier

    last = rows.groupBy(name).agg(F.max_by(F.struct(*rows.columns), ordinal).alias("r")).select("r.*")
    own = F.col(ordinal).cast("long").alias("place")
    return first_tier(last.join(wanted.groupBy(name).agg(F.min("place").cast("long").alias("place")), name),
                      last.join(kept.select(name).distinct(), name, "left_semi").select("*", own), last.select("*", own)).drop("tier")


def called_functions(bodies: DataFrame, functions: DataFrame, key: str, body: str, name: str) -> DataFrame:
    """(key, name): functions that a body calls.  Called names are extracted and joined by equality."""
    calls = bodies.select(key, F.explode(F.array_distinct(F.regexp_extract_all(body, F.lit(r"(?<![A-Za-z0-9_.])([A-Za-z_][A-Za-z0-9_]*)\s*\("), F.lit(1)))).alias(name))
    return calls.join(functions.select(name).distinct(), name)


def key_owner(keys: DataFrame, tokens: DataFrame, key_id: str, prefix: str, least: int = 12) -> DataFrame:
    """tokens (token_id, embedded, shown) with ``owner``: by the embedded id; without one, by the only key whose prefix the token begins with.

    An embedded id that no key has gives no owner.  Prefixes of fewer than ``least`` characters are not looked at.
    """
    by_id = keys.select(F.col(key_id).alias("_id")).distinct()
    plain = tokens.where("embedded is null").select("token_id", "shown")
    long = keys.where(F.length(prefix) >= least).groupBy(F.col(prefix).alias("_prefix")).agg(F.count("*").alias("_keys"), F.min(key_id).alias("_key"))
    # every beginning of a token that is long enough meets at most one row, however many keys begin alike
    begins = F.explode(F.transform(F.sequence(F.lit(least), F.length("shown")), lambda n: F.substring(F.col("shown"), F.lit(1), n))).alias("_begin")
    met = plain.where(F.length("shown") >= least).select("token_id", begins).join(long, F.col("_begin") == F.col("_prefix"))
    single = met.groupBy(F.col("token_id").alias("_token")).agg(F.sum("_keys").alias("_n"), F.min("_key").alias("_key")).where("_n = 1")
    out = tokens.join(by_id, F.col("embedded") == F.col("_id"), "left").join(single, F.col("token_id") == F.col("_token"), "left")
    return out.withColumn("owner", F.coalesce("_id", "_key")).drop("_id", "_token", "_n", "_key")


def manifest_view(functions: DataFrame, hints: DataFrame, name: str) -> DataFrame:
    """What a composer sees of each function; hints only where there are some."""
    some = hints.where(F.size("workflow_hints") > 0).groupBy(name).agg(F.first("workflow_hints").alias("workflow_hints"))
    return functions.select("module", name, "signature", "docstring", "is_async").join(some, name, "left")


def promoted(functions: DataFrame, verdicts: DataFrame, name: str) -> DataFrame:
    """The functions that a verdict names."""
    return functions.join(verdicts.where(F.coalesce(name, F.lit("")) != "").select(name).distinct(), name, "left_semi")


def published(endpoints: DataFrame, base: str = "${ENDPOINT_BASE_URL}") -> DataFrame:
    """What is published of an endpoint: PATCH becomes POST, a display name, a url, a description."""
    method = F.when(F.col("method") == "PATCH", "POST").otherwise(F.col("method"))
    about = F.when(F.coalesce("description", F.lit("")) != "", F.col("description")).otherwise(F.concat_ws(" ", "method", "path"))
    return endpoints.select("ord", method.alias("method"), F.concat(F.lit(base), "path").alias("url"), scalars.display_name("name").alias("name"), about.alias("description"))


def summary(name: str, signature: str, docstring: str) -> Column:
    flat = lambda c, n: F.substring(F.regexp_replace(F.coalesce(F.col(c), F.lit("")), r"\n", " "), 1, n)
    return F.concat_ws(" | ", F.col(name), flat(signature, 180), flat(docstring, 200))
