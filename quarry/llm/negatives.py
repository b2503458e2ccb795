"""Hard-negative mining by a Voronoi-partition distributed kNN join.

Components become whole numbers floor(scale * x); the score of two vectors is their inner product, exact.  A vector x
gets one more component, sqrt(M^2 - |x|^2) with M the greatest norm, and an anchor q gets 0 there, so that a higher score
is a smaller distance.  Pivots cut that space into Voronoi cells.  Cells are joined into anchor groups, cut by their
number of anchors.  For every group and cell the least distance from the pivot is kept at which a row of the cell can
still reach, by the triangle inequality, a score that one of the group's anchors asks for; rows nearer to their pivot are
not sent to the group.  What an anchor asks for is first learned from the cells of its own group.  Each group's rows are dealt into
slices, every slice is searched exactly, and the best of the slices are merged.

Positives: an anchor's first ``positives`` other rows of its label.  Negatives, for each positive: the first ``negatives`` rows
of other labels whose score lies between ``low`` percent of the positive's and the positive's.  Higher scores come first, ties by smaller id.

Defined results: rows with a null id or label, a null vector or a component that is null or not finite take no part, nor do
vectors whose squared norm passes 2^62, as scores would not fit a long; vectors of different lengths never meet; an
empty vector has score 0 with another; each of several rows with one id is a row of its own, as anchor (which repeats its
result rows) and as candidate; a positive of negative score has no negatives; an empty table gives an empty result;
extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm import common

SCALE, POSITIVES, NEGATIVES, LOW, EVERY = 256, 5, 5, 80, 100
#: Anchors of a group, rows of a slice, the least and greatest number of pivots, rows from which pivots are learned.
GROUP, SLICE, PIVOTS, MOST_PIVOTS, SAMPLE = 4096, 8192, 32, 1024, 4096
#: Rows of a table of bounds that may be broadcast; a longer one is joined by a shuffle.
BROADCAST_BOUNDS = 500_000
LEAST, GREATEST = -(2**63), 2**63 - 1
CODED = "uid long, vec long, label long, dim int, norm double, raw binary"


def _encode(scale: int):
    def run(batches):
        for batch in batches:
            v = batch.column("v").cast(pa.list_(pa.float64()))
            ends = v.offsets.to_numpy()
            whole = np.floor(scale * v.values.to_numpy(zero_copy_only=False))  # null components are NaN
            size = np.diff(ends)
            bad = np.cumsum(np.concatenate([[0], ~np.isfinite(whole)]))
            bad = (bad[ends[1:]] > bad[ends[:-1]]) | v.is_null().to_numpy(zero_copy_only=False)
            raw, norm = [None] * len(v), np.zeros(len(v))
            for k in np.flatnonzero(~bad).tolist():
                x = whole[ends[k] : ends[k + 1]]
                if float((x * x).sum()) > 2.0**62:
                    continue
                x = x.astype(np.int64)
                most = int(np.abs(x).max(initial=0))
                raw[k] = x.astype(np.int16 if most < 2**15 else np.int32).tobytes()
                norm[k] = float((x * x).sum())
            yield pa.RecordBatch.from_arrays([batch.column("uid"), batch.column("vec"), batch.column("label"), pa.array(size, pa.int32()), pa.array(norm), pa.array(raw, pa.binary())],
                                             names=["uid", "vec", "label", "dim", "norm", "raw"])

    return run


def _matrix(raw: list[bytes], dim: int) -> np.ndarray:
    """Whole numbers of vectors of one length."""
    out = np.empty((len(raw), dim), np.int64)
    wide = np.array([len(r) for r in raw]) > 2 * dim
    for at, kind in ((np.flatnonzero(~wide), np.int16), (np.flatnonzero(wide), np.int32)):
        out[at] = np.frombuffer(b"".join([raw[k] for k in at.tolist()]), kind).reshape(len(at), dim)
    return out


def _by_length(dims: np.ndarray):
    for dim in np.unique(dims).tolist():
        yield dim, np.flatnonzero(dims == dim)


@dataclass(frozen=True)
class Cells:
    """Pivots in the augmented space (last component: what the norm lacks to ``most``) and the group of each cell."""

    pivots: np.ndarray
    most: float
    group: tuple[int, ...]

    def distances(self, raw: list[bytes], dims: np.ndarray, norms: np.ndarray, anchors: bool) -> np.ndarray:
        """Distance of each vector to each pivot; a vector of another length has zeros where one is shorter."""
        p = self.pivots
        out = np.empty((len(raw), len(p)))
        for dim, at in _by_length(dims):
            n = min(dim, p.shape[1] - 1)
            x = _matrix([raw[k] for k in at.tolist()], dim).astype(np.float64)
            rest = 0.0 if anchors else np.sqrt(np.maximum(self.most**2 - norms[at], 0))[:, None]
            whole = norms[at, None] + np.square(rest)
            out[at] = whole + (p * p).sum(axis=1) - 2 * (x[:, :n] @ p[:, :n].T + rest * p[:, -1])
        return np.sqrt(np.maximum(out, 0))

    @property
    def slack(self) -> float:
        """More than what rounding changes in a distance."""
        return 1e-6 * self.most + 1e-6


def _means(x: np.ndarray, k: int, rounds: int = 5) -> np.ndarray:
    """Centres of x, from its first k distinct rows."""
    p = x[np.sort(np.unique(x, axis=0, return_index=True)[1])[:k]]
    for _ in range(rounds):
        near = ((p * p).sum(axis=1) - 2 * x @ p.T).argmin(axis=1)
        n = np.bincount(near, minlength=len(p))
        sums = np.zeros_like(p)
        np.add.at(sums, near, x)
        p = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], p)
    return p


def _cells(coded: DataFrame, anchors: int, group: int) -> Cells:
    """Pivots from the ``SAMPLE`` rows with the smallest hashes of their ids."""
    most = float(np.sqrt(coded.agg(F.max("norm")).first()[0] or 0.0))
    rows = coded.select("raw", "dim", "norm", F.xxhash64("vec", "uid").alias("h")).orderBy("h").limit(SAMPLE).collect()
    dims = np.array([r.dim for r in rows])
    dim = int(np.bincount(dims).argmax())
    some = [r for r in rows if r.dim == dim]
    x = _matrix([bytes(r.raw) for r in some], dim).astype(np.float64)
    x = np.hstack([x, np.sqrt(np.maximum(most**2 - np.array([r.norm for r in some]), 0))[:, None]])
    pivots = _means(x, min(MOST_PIVOTS, max(PIVOTS, 4 * -(-anchors // group))))
    heads = _means(pivots, min(len(pivots), max(1, -(-anchors // group))))
    near = ((heads * heads).sum(axis=1) - 2 * pivots @ heads.T).argmin(axis=1)
    return Cells(pivots, most, tuple(near.tolist()))


def _assign(cells: Cells, anchors: bool):
    """Adds the nearest cell and the distance to its pivot, or an anchor's group and its distances to all pivots."""

    def run(batches):
        for batch in batches:
            d = cells.distances(batch.column("raw").to_pylist(), batch.column("dim").to_numpy(), batch.column("norm").to_numpy(), anchors)
            near = d.argmin(axis=1) if len(d) else np.zeros(0, np.int64)
            if anchors:
                more = [pa.array(np.array(cells.group)[near], pa.int32()), pa.array(d.tolist(), pa.list_(pa.float64()))]
            else:
                more = [pa.array(near, pa.int32()), pa.array(d[np.arange(len(d)), near])]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, *(("grp", "reach") if anchors else ("cell", "d"))])

    return run


def _best(scores: np.ndarray, ids: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """The places among ``at`` of the first k by higher score, then smaller id."""
    if len(at) > k:
        s = scores[at]
        at = at[s >= np.partition(s, len(s) - k)[len(s) - k]]
    return at[np.lexsort((ids[at], -scores[at]))[:k]]


def _local(same: bool, k: int):
    """Exact search of a slice: for each range of scores that an anchor asks for the first k rows of its label, or of others."""

    def run(table: pa.Table) -> pa.Table:
        asks = table.column("lows").is_valid().to_numpy()
        uid, vec, label, dims, norm = (table.column(c).to_numpy() for c in ("uid", "vec", "label", "dim", "norm"))
        raw, lows, highs = (table.column(c).to_pylist() for c in ("raw", "lows", "highs"))
        out: list[tuple] = []
        for dim, at in _by_length(dims):
            q, c = at[asks[at]], at[~asks[at]]
            if not len(q) or not len(c):
                continue
            x = _matrix([raw[j] for j in c.tolist()], dim)
            exact = norm[c].max() * norm[q].max() < 2.0**104  # products then are whole in double precision
            x = x.astype(np.float64) if exact else x
            for a in range(0, len(q), 256):
                part = q[a : a + 256]
                y = _matrix([raw[j] for j in part.tolist()], dim)
                for row, s in zip(part.tolist(), (y.astype(x.dtype) @ x.T).astype(np.int64), strict=True):
                    fits = (label[c] == label[row]) & (uid[c] != uid[row]) if same else label[c] != label[row]
                    for n, (lo, hi) in enumerate(zip(lows[row], highs[row], strict=True)):
                        for j in _best(s, vec[c], np.flatnonzero(fits & (s >= lo) & (s <= hi)), k).tolist():
                            out.append((uid[row], n, vec[c[j]], s[j]))
        cols = list(zip(*out, strict=True)) or [[], [], [], []]
        return pa.table({"uid": pa.array(cols[0], pa.int64()), "n": pa.array(cols[1], pa.int32()), "vec": pa.array(cols[2], pa.int64()), "score": pa.array(cols[3], pa.int64())})

    return run


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_BOUNDS else df


def routes(asked: DataFrame, cells: Cells) -> DataFrame:
    """(grp, part, cell, least, own): the distance from the cell's pivot from which on a row may serve the anchors."""
    lo = F.array_min("lows").cast("double")
    far = F.when(lo <= float(LEAST), F.lit(float("inf"))).otherwise(F.sqrt(F.greatest(F.col("norm") + F.lit(cells.most**2) - 2 * lo, F.lit(0.0))))
    each = asked.select("grp", "part", far.alias("far"), F.posexplode("reach").alias("cell", "reach"))
    own = F.array(*[F.lit(g) for g in cells.group])[F.col("cell")] == F.col("grp")
    return each.groupBy("grp", "part", "cell").agg((F.min(F.col("reach") - F.col("far")) - 2 * cells.slack).alias("least")).withColumn("own", own)


def _search(asked: DataFrame, rows: DataFrame, cells: Cells, own: bool, same: bool, k: int) -> DataFrame:
    """(uid, n, vec, score): for the n-th range of scores of anchor uid, the first k of every slice of the cells of its own group, or of all others."""
    bounds = common.checkpoint(routes(asked, cells).where(F.col("own") if own else ~F.col("own")))
    bounds = _small(bounds, bounds.count())
    serves = lambda df: df.join(bounds, "cell").where("d >= least")
    counts = common.checkpoint(serves(rows.select("cell", "d")).groupBy("grp", "part").agg(F.ceil(F.count("*") / SLICE).alias("slices")))
    counts = _small(counts, counts.count())
    none = F.lit(None).cast("array<long>")
    sent = serves(rows).join(counts, ["grp", "part"]).withColumn("slice", F.pmod(F.xxhash64("uid"), F.col("slices")))
    asks = asked.join(counts, ["grp", "part"]).withColumn("slice", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slices") - 1)))
    columns = ["grp", "part", "slice", "uid", "vec", "label", "dim", "norm", "raw"]
    fed = sent.select(*columns, none.alias("lows"), none.alias("highs")).unionByName(asks.select(*columns, "lows", "highs"))
    return fed.groupBy("grp", "part", "slice").applyInArrow(_local(same, k), "uid long, n int, vec long, score long")


def _first(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("uid", "n").orderBy(F.desc("score"), "vec")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _exact(asked: DataFrame, rows: DataFrame, cells: Cells, same: bool, k: int) -> DataFrame:
    """(uid, n, rank, vec, score): the first k rows of all, by way of what the own group's cells give."""
    near = common.checkpoint(_first(_search(asked, rows, cells, True, same, k), k).drop("rank"))
    floor = near.groupBy("uid", "n").agg(F.count("*").alias("c"), F.min("score").alias("kth")).where(F.col("c") >= k)
    floors = floor.groupBy("uid").agg(F.map_from_entries(F.collect_list(F.struct("n", "kth"))).alias("floors"))
    raised = F.transform("lows", lambda lo, n: F.greatest(lo, F.coalesce(F.col("floors")[n], lo)))
    more = asked.join(floors, "uid", "left").withColumn("lows", F.when(F.col("floors").isNull(), F.col("lows")).otherwise(raised)).drop("floors")
    return _first(near.unionByName(_search(more, rows, cells, False, same, k)), k)


def hard_negatives(table: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", anchor=None, scale: int = SCALE, positives: int = POSITIVES,
                   negatives: int = NEGATIVES, low: int = LOW, group: int = GROUP) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).  ``anchor``: a condition on the id ``vec``."""
    anchor = F.col("vec") % EVERY == 0 if anchor is None else anchor
    base = table.select(F.col(vec_id).cast("long").alias("vec"), F.col(label).cast("long").alias("label"), F.col(embedding).cast("array<double>").alias("v")).where("vec is not null and label is not null")
    coded = base.select(F.monotonically_increasing_id().alias("uid"), "vec", "label", "v").mapInArrow(_encode(scale), CODED)
    coded = common.checkpoint(coded.where("raw is not null"))
    some = coded.where(anchor)
    count = some.count()
    if not count:
        return table.sparkSession.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    cells = _cells(coded, count, group)
    rows = common.checkpoint(coded.mapInArrow(_assign(cells, False), f"{CODED}, cell int, d double"))
    homes = some.mapInArrow(_assign(cells, True), f"{CODED}, grp int, reach array<double>")
    sizes = homes.groupBy("grp").agg(F.ceil(F.count("*") / group).alias("parts"))  # at most as many rows as pivots
    homes = common.checkpoint(homes.join(F.broadcast(sizes), "grp").withColumn("part", F.pmod(F.xxhash64("uid"), F.col("parts"))).drop("parts"))
    asked = homes.withColumns({"lows": F.array(F.lit(LEAST)), "highs": F.array(F.lit(GREATEST))})
    near = common.checkpoint(_exact(asked, rows, cells, True, positives))
    # the range of scores of each positive; the lower end is the least whole number that is high enough
    windows = near.where("score >= 0").groupBy("uid").agg(F.sort_array(F.collect_list(F.struct("rank", "score", F.col("vec").alias("positive")))).alias("asks"))
    asked = homes.join(windows, "uid").withColumns({"lows": F.transform("asks", lambda w: F.ceil(w["score"].cast("decimal(20,0)") * low / 100).cast("long")), "highs": F.col("asks")["score"]})
    found = _exact(asked, rows, cells, False, negatives)
    who = asked.select("uid", F.col("vec").alias("anchor_id"), F.posexplode("asks").alias("n", "w"))
    return found.join(who, ["uid", "n"]).select("anchor_id", F.col("w.positive").alias("positive_id"), F.col("rank").cast("int").alias("rank"), F.col("vec").alias("negative_id"),
                                                F.col("w.score").alias("positive_score"), F.col("score").alias("negative_score"))


def op11_hard_negatives(spark, sf_dir: str) -> DataFrame:
    rows = common.table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.select("vec_id", "embedding", moved.alias("label")))


#: The same rows in DuckDB, every anchor against all rows.
ORACLE_SQL = f"""WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
 s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, list_inner_product(a.e, b.e)::BIGINT AS score FROM v a JOIN v b ON a.vec_id % {EVERY} = 0 AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)),
 p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= {POSITIVES}),
 n AS (SELECT p.anchor_id, p.other AS positive_id, p.score AS positive_score, s.other AS negative_id, s.score AS negative_score FROM p JOIN s USING (anchor_id) WHERE NOT s.same AND {LOW} * p.score <= 100 * s.score AND s.score <= p.score),
 r AS (SELECT *, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY negative_score DESC, negative_id)::INT AS rank FROM n)
 SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM r WHERE rank <= {NEGATIVES}"""
