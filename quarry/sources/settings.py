"""Settings files as VARIANT: JSON documents in layers, resolved per nested field.

A document is parsed once; its fields are rows of a path and a typed value, so that layers of any shape are resolved by one
aggregate.  A document that is no JSON object counts as an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators.cut import checkpoint

#: Objects within objects that are opened; deeper ones are one value.
DEPTH = 12


def read(spark: SparkSession, layers: dict[str, int]) -> DataFrame:
    """(layer, priority, doc): the documents of the paths, a missing one as none.  ``layers``: path -> priority, the least first."""
    out = None
    for path, priority in layers.items():
        one = spark.read.option("wholetext", "true").option("ignoreMissingFiles", "true")
        try:
            text = one.text(path).agg(F.first("value").alias("text"))
        except Exception as error:  # noqa: BLE001  (only a path that is not there has no rows)
            if "PATH_NOT_FOUND" not in str(error):
                raise
            continue
        row = text.select(F.lit(path).alias("layer"), F.lit(priority).alias("priority"), F.try_parse_json("text").alias("doc"))
        out = row if out is None else out.unionByName(row)
    return out if out is not None else spark.sql("SELECT '' AS layer, 0 AS priority, parse_json('{}') AS doc WHERE false")


def _is_object(doc: Column) -> Column:
    return F.coalesce(F.schema_of_variant(doc).startswith("OBJECT<"), F.lit(False))


def fields(docs: DataFrame, doc: str = "doc") -> DataFrame:
    """docs with one row per field that is no object: ``path`` (array of names), ``value`` (variant), ``kind`` (its type).

    An empty object is a field of its own, unless it is the document; null values are no fields, as they say nothing.
    """
    keep = [c for c in docs.columns if c != doc]
    level = docs.select(*keep, F.array().cast("array<string>").alias("path"), F.col(doc).alias("value")).where(_is_object(F.col("value")))
    out = None
    for depth in range(DEPTH):
        inside = docs.sparkSession.tvf.variant_explode(F.col("t.value").outer()).select(F.col("key").alias("_key"), F.col("value").alias("_value"))
        opened = level.alias("t").lateralJoin(inside).select(*[F.col(f"t.`{c}`") for c in keep], F.concat(F.col("t.path"), F.array("_key")).alias("path"), F.col("_value").alias("value"))
        inner = _is_object(F.col("value")) & (F.schema_of_variant("value") != "OBJECT<>")
        flat = opened.where(~inner if depth + 1 < DEPTH else F.lit(True)).where(~F.is_variant_null("value"))
        out = flat if out is None else out.unionByName(flat)
        level = opened.where(inner)
        if not level.limit(1).count():  # no document is deeper
            break
    return out.withColumn("kind", F.schema_of_variant("value"))


def layered(docs: DataFrame, by: list[str] = ()) -> DataFrame:
    """(by, path, value as JSON, kind, layer): for every nested field the value of the first layer that has it; blank strings are none.

    A field that is an object in one layer and a value in another is taken from the layer that comes first, whole.
    """
    rows = fields(docs).withColumn("json", F.to_json("value")).where(~((F.col("kind") == "STRING") & (F.trim(F.expr("try_variant_get(value, '$', 'string')")) == "")))
    best = rows.groupBy(*by, "path").agg(F.min_by(F.struct("json", "kind", "layer", "priority"), F.struct("priority", "layer")).alias("b"))
    found = checkpoint(best.select(*by, "path", "b.*"))
    # a value hides what layers after it have below or above its path
    ups = found.where(F.size("path") > 1).select(*by, "path", "priority", F.explode(F.sequence(F.lit(1), F.size("path") - 1)).alias("n"))
    above = ups.select(*by, F.slice("path", 1, "n").alias("up"), F.col("path").alias("low"), F.col("priority").alias("low_priority"))
    met = found.select(*by, F.col("path").alias("up"), F.col("priority").alias("up_priority")).join(above, [*by, "up"])
    hidden = met.select(*by, F.when(F.col("up_priority") <= F.col("low_priority"), F.col("low")).otherwise(F.col("up")).alias("path")).distinct()
    return found.join(hidden, [*by, "path"], "left_anti").select(*by, "path", F.col("json").alias("value"), "kind", "layer")


def missing(docs: DataFrame, required: list[str], doc: str = "doc") -> Column:
    """The required fields (``a.b.c``) that a document lacks or has as null, in order; text that is no object lacks all."""
    have = [F.expr(f"`{doc}`:{'.'.join(f'`{p}`' for p in name.split('.'))}") for name in required]
    return F.array_compact(F.array(*[F.when(~_is_object(F.col(doc)) | v.isNull() | F.is_variant_null(v), F.lit(name)) for name, v in zip(required, have, strict=True)]))
