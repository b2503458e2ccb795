"""Sharding by a hierarchical weighted hash tree, with DataFrame functions.

A tree has regions, racks and shards.  An id descends from the root: at each node every child draws -ln(u) / weight,
u from a hash of the id and the child's path, and the least draw wins, so a child is chosen in proportion to its weight.
A draw depends on nothing else; raising a child's weight (or adding it) only takes ids from its siblings' subtrees,
lowering it (or removing it) only gives ids to them, and no other subtree is touched.  ``layout`` adds each further shard
as a new leaf whose ancestors keep their weights, or as the only leaf of a new rack or region, so one more shard takes
rows only into itself.

Within a shard rows are numbered without a gap: they are cut by a hash into groups of about ``GROUP_ROWS``, numbered in
each, and the groups' sizes summed up, so that no shard meets in one task.

Defined results: the size of a null text is 0 bytes (plus the fixed 16); null ids are hashed as empty and share a shard;
rows that repeat an id share a shard, each with a slot of its own; equal rows, and those
whose hash falls into one group with very many equal ones, may swap slots; an empty table gives an
empty result; extra columns are kept, but one with the name of the added column is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm import common

SHARDS, REGIONS, RACKS = 40, 4, 2
#: Bytes of a row beside its text.
ROW_BYTES = 16
#: Rows that are numbered in one group, and the least number of groups of a shard.
GROUP_ROWS, GROUPS = 100_000, 64
#: Groups whose sizes may be broadcast; more are joined by a shuffle.
BROADCAST_GROUPS = 500_000


class Tree:
    """leaves: (region, rack, name) -> number of the shard.  weights: (region,), (region, rack) or a leaf's path -> weight, 1 where none is given."""

    def __init__(self, leaves: dict[tuple, int], weights: dict[tuple, float] | None = None):
        self.leaves, self.weights = dict(leaves), dict(weights or {})

    def children(self, depth: int) -> dict[str, list[tuple[str, float]]]:
        """Path of every node of a level -> its children's paths and weights (those of weight 0 are never chosen)."""
        out: dict = {}
        for path in sorted({leaf[: depth + 1] for leaf in self.leaves}, key=str):
            if (weight := float(self.weights.get(path, 1))) > 0:
                out.setdefault(_name(path[:-1]), []).append((_name(path), weight))
        return out

    def shard(self, doc_id: Column) -> Column:
        """The shard of an id."""
        text, at = F.coalesce(doc_id.cast("string"), F.lit("")), F.lit("")
        for depth in range(3):
            level = self.children(depth)
            kids = F.create_map(*[x for parent, some in level.items() for x in (F.lit(parent), F.array(*[F.struct(F.lit(p).alias("path"), F.lit(w).alias("weight")) for p, w in some]))])
            at = F.array_min(F.transform(kids[at], lambda c: F.struct((_draw(text, c["path"]) / c["weight"]).alias("draw"), c["path"].alias("path"))))["path"]
        return F.create_map(*[F.lit(x) for path, n in self.leaves.items() for x in (_name(path), n)])[at].cast("int")


def _name(path: tuple) -> str:
    return "/".join(map(str, path))


def _draw(text: Column, path: Column) -> Column:
    return -F.log((F.conv(F.substring(F.md5(F.concat_ws(":", text, path)), 1, 13), 16, 10).cast("double") + 0.5) / float(2**52))


def layout(shards: int, regions: int = REGIONS, racks: int = RACKS) -> Tree:
    """Shard s is dealt to rack s mod (regions * racks); racks are dealt to regions likewise."""
    whole = regions * racks
    return Tree({(s % whole % regions, s % whole // regions, s): s for s in range(shards)})


def placed(docs: DataFrame, tree: Tree, doc_id: str = "doc_id", by: tuple[str, ...] = (), as_column: str = "place") -> DataFrame:
    """``docs`` with one more column, struct(shard, slot).  Slots follow a hash of the id and of the columns ``by``."""
    docs = docs.drop(as_column)
    spark = docs.sparkSession
    shard, key, row, bucket, piece, slot, start = (common.fresh(docs, f"place_{x}") for x in ("shard", "key", "row", "bucket", "piece", "slot", "start"))
    name = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (doc_id, *by)])
    keyed = common.checkpoint(docs.withColumns({shard: tree.shard(F.col(doc_id)), key: F.md5(name), row: F.monotonically_increasing_id()}))
    rows, leaves = keyed.count(), max(1, len(tree.leaves))
    groups = max(GROUPS, -(-common.partitions(spark) // leaves), -(-rows // (leaves * GROUP_ROWS)))
    keyed = keyed.withColumn(bucket, F.shiftright(F.conv(F.substring(key, 1, 8), 16, 10).cast("long") * groups, 32))
    # rows that are equal meet in one group however many there are; such a group is dealt further by its rows' places
    limit = max(GROUP_ROWS, 8 * rows // (leaves * groups))
    full = keyed.groupBy(shard, bucket).count().where(F.col("count") > limit).select(shard, bucket, F.ceil(F.col("count") / GROUP_ROWS).alias(piece))
    dealt = keyed.join(_small(full, rows // limit), [shard, bucket], "left").withColumn(piece, F.coalesce(F.pmod(F.xxhash64(row), F.col(piece)), F.lit(0)))
    keys = [shard, bucket, piece]
    upto = Window.partitionBy(shard).orderBy(bucket, piece).rowsBetween(Window.unboundedPreceding, -1)
    starts = common.checkpoint(dealt.groupBy(*keys).count().select(*keys, F.coalesce(F.sum("count").over(upto), F.lit(0)).alias(start)))
    numbered = dealt.withColumn(slot, F.row_number().over(Window.partitionBy(*keys).orderBy(key, row)) - 1)
    out = numbered.join(_small(starts, starts.count()), keys)
    return out.withColumn(as_column, F.struct(F.col(shard).alias("shard"), (F.col(start) + F.col(slot)).cast("long").alias("slot"))).select(*docs.columns, as_column)


def _small(df: DataFrame, most: int) -> DataFrame:
    """Broadcast what has at most that many rows, if they are few."""
    return F.broadcast(df) if most <= BROADCAST_GROUPS else df


def write(found: DataFrame, path: str, place: str = "place", rows: int = GROUP_ROWS) -> None:
    """One folder per shard and run of ``rows`` slots, whose rows are in the order of their slots."""
    shard, part = common.fresh(found, "shard"), common.fresh(found, "part")
    cut = found.withColumns({shard: F.col(place)["shard"], part: F.floor(F.col(place)["slot"] / rows)})
    cut.repartition(shard, part).sortWithinPartitions(shard, F.col(place)["slot"]).write.partitionBy(shard, part).parquet(path)


def op13_sharding(spark, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    docs = common.table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(text).cast("long") + ROW_BYTES).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    found = placed(docs, layout(SHARDS), by=("text_crc32", "size"))
    return found.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "place.shard", "place.slot", layout(SHARDS + 1).shard(F.col("doc_id")).alias("grown_shard"))


def _sql_descend(tree: Tree) -> str:
    """The shard of ``i`` in DuckDB."""
    at = "''"
    for depth in range(3):
        kids = "MAP {" + ", ".join(f"'{parent}': [{', '.join(f"{{p: '{p}', w: {w}}}" for p, w in some)}]" for parent, some in tree.children(depth).items()) + "}"
        draw = "-ln((('0x' || substr(md5(i || ':' || c.p), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496) / c.w"
        at = f"list_sort(list_transform(({kids})[{at}], lambda c: {{d: {draw}, p: c.p}}))[1].p"
    return f"(MAP {{{', '.join(f"'{_name(p)}': {n}" for p, n in tree.leaves.items())}}})[{at}]"


#: The same rows in DuckDB; CRC-32 byte by byte, with its table from the polynomial.
ORACLE_SQL = f"""WITH t AS (SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, x: CASE WHEN c % 2 = 1 THEN xor(3988292384, c // 2) ELSE c // 2 END)) AS tab),
 d AS (SELECT doc_id, coalesce(doc_id::VARCHAR, '') AS i, coalesce(text, '') AS x FROM documents),
 b AS (SELECT doc_id, i, strlen(x)::BIGINT + {ROW_BYTES} AS size, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode(x)), '..'), lambda h: ('0x' || h)::BIGINT)),
  lambda c, v: xor(c // 256, tab[xor(c % 256, v) + 1]))) AS text_crc32 FROM d, t),
 s AS (SELECT *, {_sql_descend(layout(SHARDS))}::INT AS shard, {_sql_descend(layout(SHARDS + 1))}::INT AS grown_shard FROM b)
 SELECT doc_id, size, text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY md5(concat_ws(':', i, text_crc32, size))) - 1 AS slot, grown_shard FROM s"""
