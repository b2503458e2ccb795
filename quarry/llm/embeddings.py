"""Near-duplicate embeddings by lattice hashing.

Random projections of the unit vectors, in blocks of eight, are decoded to the nearest point of the E8 lattice; the
points of ``BLOCKS`` blocks are a table's cell.  Each vector is filed under its cell in ``TABLES`` tables and looked up
there and in the ``PROBES`` nearest neighbouring cells of each block.  Pairs that meet are verified by cosine in double
precision.  Equal vectors are one class throughout, so copies are never expanded into pairs; links are counted with the
sizes of the classes, and what leaves a verifying task are counts and a forest, not links.  The expected share of pairs at the threshold that meet is over 0.99; a test measures recall
against brute force.

Defined results: a vector that is null, empty, zero, or holds null or non-finite components links with nothing and is
its own component; vectors of different lengths never link; a null id has a null component, and is kept; repeated rows
count as vectors of their own; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from itertools import combinations, product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm import common
from quarry.llm.components import Forest, components

COSINE = 0.95
TABLES, BLOCKS, PROBES, WIDTH = 14, 2, 3, 1.6


def _minimal_vectors() -> np.ndarray:
    """The 240 shortest vectors of E8, in half units."""
    out = []
    for i, j in combinations(range(8), 2):
        for s, t in product((2, -2), repeat=2):
            v = [0] * 8
            v[i], v[j] = s, t
            out.append(v)
    out += [s for s in product((1, -1), repeat=8) if sum(x < 0 for x in s) % 2 == 0]
    return np.array(out, dtype=np.float64) / 2


NEAR = _minimal_vectors()


def _d8(x: np.ndarray) -> np.ndarray:
    """The nearest integer points whose coordinates have an even sum."""
    r = np.rint(x)
    e = x - r
    odd = np.flatnonzero(r.sum(axis=1) % 2 != 0)
    worst = np.abs(e[odd]).argmax(axis=1)
    r[odd, worst] += np.where(e[odd, worst] >= 0, 1.0, -1.0)
    return r


def decode(x: np.ndarray) -> np.ndarray:
    """The nearest points of E8 (rows of eight)."""
    whole, half = _d8(x), _d8(x - 0.5) + 0.5
    closer = ((x - whole) ** 2).sum(axis=1) <= ((x - half) ** 2).sum(axis=1)
    return np.where(closer[:, None], whole, half)


def _projections(dim: int) -> np.ndarray:
    return np.random.default_rng(1000 + dim).normal(size=(TABLES, BLOCKS, dim, 8))


_ROWS = np.random.default_rng(5).integers(1, 2**63, (TABLES, BLOCKS, 8), dtype=np.uint64) | np.uint64(1)


def _block_hash(points: np.ndarray, table: int, block: int) -> np.ndarray:
    return ((2 * points).astype(np.int64).view(np.uint64) * _ROWS[table, block]).sum(axis=-1, dtype=np.uint64)


def cells(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cell keys (n, TABLES) and the keys to look up (n, TABLES * (1 + BLOCKS * PROBES)) of unit vectors."""
    own, look = [], []
    for t, blocks in enumerate(_projections(unit.shape[1])):
        at, beside = [], []
        for b, p in enumerate(blocks):
            x = unit @ p / WIDTH
            c = decode(x)
            gap = ((NEAR**2).sum(axis=1) - 2 * (x - c) @ NEAR.T)  # squared distance less a constant
            near = np.argsort(gap, axis=1, kind="stable")[:, :PROBES]
            at.append(_block_hash(c, t, b))
            beside.append(_block_hash(c[:, None, :] + NEAR[near], t, b))
        total = np.sum(at, axis=0, dtype=np.uint64)
        key = lambda x, t=t: common.mix(x + np.array([t + 1], np.uint64) * np.uint64(0x9E3779B97F4A7C15))  # noqa: E731  (arrays wrap without a warning)
        own.append(key(total))
        look.append(key(total)[:, None])
        look += [key((total - a)[:, None] + n) for a, n in zip(at, beside, strict=True)]
    return np.stack(own, axis=1), np.concatenate(look, axis=1)


def _encode(batches):
    for batch in batches:
        digests, raws = [], []
        for v in batch.column("v").to_pylist():
            x = None
            if v and None not in v:
                x = np.array(v, dtype=np.float64)
                if not np.isfinite(x).all() or not x.any():
                    x = None
            raw = None if x is None else (x + 0.0).tobytes()
            raws.append(raw)
            digests.append(None if raw is None else hashlib.blake2b(raw, digest_size=16).digest())
        yield pa.RecordBatch.from_arrays([batch.column("vec"), pa.array(digests, pa.binary()), pa.array(raws, pa.binary())], names=["vec", "digest", "raw"])


def _unit(raw: bytes) -> np.ndarray:
    x = np.frombuffer(raw, np.float64)
    x = x / np.abs(x).max()
    return x / np.sqrt((x * x).sum())


def _near(left: list[bytes], right: list[bytes], cosine: float) -> np.ndarray:
    """Whether the vectors of each pair have the same length and at least that cosine."""
    sizes = np.array([len(x) if len(x) == len(y) else 0 for x, y in zip(left, right, strict=True)], np.int64)
    out = np.zeros(len(left), bool)
    for size in set(sizes.tolist()) - {0}:
        at = np.flatnonzero(sizes == size)
        x, y = (np.frombuffer(b"".join([side[k] for k in at.tolist()]), np.float64).reshape(len(at), -1) for side in (left, right))
        x, y = x / np.abs(x).max(axis=1, keepdims=True), y / np.abs(y).max(axis=1, keepdims=True)
        x, y = x / np.sqrt((x * x).sum(axis=1, keepdims=True)), y / np.sqrt((y * y).sum(axis=1, keepdims=True))
        out[at] = (x * y).sum(axis=1) >= cosine
    return out


def _keys(batches):
    for batch in batches:
        unit = [_unit(r) for r in batch.column("raw").to_pylist()]
        own, look = [None] * len(unit), [None] * len(unit)
        for dim in {len(u) for u in unit}:
            rows = [k for k, u in enumerate(unit) if len(u) == dim]
            for a in range(0, len(rows), 2000):
                part = rows[a : a + 2000]
                o, q = cells(np.stack([unit[k] for k in part]))
                for k, x, y in zip(part, o.view(np.int64), q.view(np.int64), strict=True):
                    own[k], look[k] = x.tolist(), np.unique(y).tolist()
        yield pa.RecordBatch.from_arrays([batch.column("rep"), pa.array(own, pa.list_(pa.int64())), pa.array(look, pa.list_(pa.int64()))], names=["rep", "own", "look"])


def near_duplicates(table: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", cosine: float = COSINE) -> DataFrame:
    """(vec, n_links, component): one row per row of ``table``."""
    base = table.select(F.col(vec_id).cast("long").alias("vec"), F.col(embedding).alias("v"))
    coded = common.checkpoint(base.mapInArrow(_encode, "vec long, digest binary, raw binary"))
    classes = common.checkpoint(coded.where("digest is not null and vec is not null").groupBy("digest").agg(
        F.min("vec").alias("rep"), F.count("*").alias("size"), F.first("raw").alias("raw")))
    filed = common.checkpoint(classes.select("rep", "raw").mapInArrow(_keys, "rep long, own array<long>, look array<long>"))
    shelf = filed.select(F.col("rep").alias("x"), F.explode("own").alias("cell"))
    asked = filed.select(F.col("rep").alias("y"), F.explode("look").alias("cell"))
    met = shelf.join(asked, "cell").where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    side = lambda c: classes.select(F.col("rep").alias(c), F.col("raw").alias(f"raw{c}"), F.col("size").alias(f"size{c}"))

    def judge(batches):
        """Of the pairs of a task that reach the cosine: how many vectors each is linked with (b null), and a forest (n null)."""
        others, forest, edges = Counter(), Forest(), []
        for batch in batches:
            a, b, size_a, size_b = (batch.column(c).to_numpy() for c in ("a", "b", "sizea", "sizeb"))
            for k in np.flatnonzero(_near(batch.column("rawa").to_pylist(), batch.column("rawb").to_pylist(), cosine)).tolist():
                x, y = int(a[k]), int(b[k])
                others[x] += int(size_b[k])
                others[y] += int(size_a[k])
                if forest.join(x, y):
                    edges.append((x, y))
        left = [*others, *(x for x, _ in edges)]
        yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array([None] * len(others) + [y for _, y in edges], pa.int64()),
                                          pa.array([*others.values(), *[None] * len(edges)], pa.int64())], names=["a", "b", "n"])

    found = common.checkpoint(met.join(side("a"), "a").join(side("b"), "b").select("a", "b", "rawa", "rawb", "sizea", "sizeb").mapInArrow(judge, "a long, b long, n long"))
    degree = found.where("b is null").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("others"))
    comps = components(found.where("b is not null")).select(F.col("node").alias("rep"), "component")
    named = classes.select("digest", "rep", "size").join(degree, "rep", "left").join(comps, "rep", "left").select(
        "digest", (F.coalesce("others", F.lit(0)) + F.col("size") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component"))
    out = coded.select("vec", "digest").join(named, "digest", "left")
    known = F.col("vec").isNotNull()
    return out.select("vec", F.when(known, F.coalesce("n_links", F.lit(0))).otherwise(0).cast("long").alias("n_links"),
                      F.when(known, F.coalesce("component", "vec")).alias("component"))


def op4_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(common.table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    return found.select(F.col("vec").alias("vec_id"), "n_links", F.col("component").alias("component_id"),
                        F.col("vec").eqNullSafe(F.col("component")).alias("kept"))


#: The same rows in DuckDB by comparing all pairs (small tables only; lattice hashing may miss a pair at the threshold).
ORACLE_SQL = f"""WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings WHERE embedding IS NOT NULL
  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
 l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= {COSINE}),
 r(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b), c AS (SELECT a, min(b) AS component FROM r GROUP BY a), n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
 SELECT vec_id, coalesce(n.n, 0)::BIGINT AS n_links, c.component AS component_id, vec_id = c.component AS kept FROM embeddings e JOIN c ON c.a = e.vec_id LEFT JOIN n ON n.a = e.vec_id"""
