"""MinHash near-duplicates with sequential Bayesian verification.

1. Every text becomes a set of 64-bit shingle hashes, a digest of the set, band keys, and one byte of each of
   ``HASHES`` minhashes.  Texts with equal sets are one class from here on, whatever their number; ``rep`` is the number
   of a class, as an id may occur with texts of several classes.  Links and components are of ids.
2. Classes that share a band key are candidates.  A bucket is not expanded into pairs: its members are compared with its
   hub, the member that shares most buckets with others.
3. Signatures of ``LONG`` bytes, made for candidate classes only, are compared in batches; a pair is pruned as soon as
   the posterior probability that its similarity reaches the threshold falls below ``MISS``.  Survivors are verified on
   the full sets, and give components.
4. Buckets that still hold several components get the comparisons that hubs cannot decide: members outside the bucket's
   largest component against all its members, as joined pairs in buckets of at most ``SMALL`` members, and block against
   block in larger ones (those with one hub together).  Of the links found, a task only gives a forest.  So a link is lost only if its pair shares no band
   (probability under 1e-7 at the threshold) or by ``MISS``.

Sets are sent only for candidate classes.  Components are found by star steps on DataFrames.

Defined results: null, empty and blank texts have the empty set, link with nothing and are their own component; a text
with fewer words than a shingle has its whole sequence as one shingle; a null id has a null component and is kept;
rows that repeat an id share a component, whatever their texts; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm import common
from quarry.llm.components import Forest, components

SHINGLE = 2
THRESHOLD = 80  # per cent
BANDS, ROWS = 32, 4
HASHES = BANDS * ROWS
#: Bytes of the signatures that are compared, how many at once, and the chosen miss probability.
LONG, BATCH, MISS = 512, 32, 1e-5
#: Members of a bucket that is still joined into pairs, and of a block of a larger one.
SMALL, BLOCK = 48, 512
#: Bytes of sets and signatures on either side of a verifying task.
BLOCK_BYTES = 8_000_000
#: Ids that may be broadcast to pick out texts (8 MB); more are joined by a shuffle.
BROADCAST_IDS = 1_000_000

_A = np.random.default_rng(7).integers(1, 2**63, LONG, dtype=np.uint64) | np.uint64(1)
_B = np.random.default_rng(11).integers(0, 2**63, LONG, dtype=np.uint64)
_C = np.random.default_rng(13).integers(1, 2**63, (2, ROWS), dtype=np.uint64) | np.uint64(1)


def shingle_sets(column, size: int):
    """For each chunk of texts: the first row, the sorted distinct hashes of all texts, and where each text's begin."""
    data, bounds = common.utf8(column)
    for a, b in common.chunks(bounds):
        part, edge = common.LOWER[data[bounds[a] : bounds[b]]], bounds[a : b + 1] - bounds[a]
        starts, ends, first = common.word_spans(part, edge, common.NONSPACE)
        word = common.hash_spans(part, starts, ends)
        sets = []
        for k in range(b - a):
            w = word[first[k] : first[k + 1]]
            n = max(1, min(size, len(w)))
            key = w[: len(w) - n + 1]
            for j in range(1, n):
                key = common.join_hash(key, w[j : len(w) - n + 1 + j])
            sets.append(np.unique(key))
        yield a, sets


def signatures(sets: list[np.ndarray], hashes: int = HASHES) -> np.ndarray:
    """Minhashes (rows: texts) of non-empty sets; empty ones get zeros."""
    out = np.zeros((len(sets), hashes), dtype=np.uint64)
    full = [k for k, s in enumerate(sets) if len(s)]
    if not full:
        return out
    sizes = np.array([len(sets[k]) for k in full])
    every, first = np.concatenate([sets[k] for k in full]), np.cumsum(sizes) - sizes
    buffer = np.empty_like(every)
    for j in range(hashes):
        np.multiply(every, _A[j], out=buffer)
        buffer += _B[j]
        out[full, j] = np.minimum.reduceat(buffer, first)
    return out


def _digests(sets: list[np.ndarray]) -> list[tuple[int, int]]:
    return [(int(common.mix(s).sum().view(np.int64)), int(common.mix(s ^ _C[1][0]).sum().view(np.int64))) if len(s) else (0, 0) for s in sets]


def _encode(size: int):
    def run(batches):
        for batch in batches:
            ids = batch.column("doc")
            for a, sets in shingle_sets(batch.column("body"), size):
                mins = signatures(sets) >> np.uint64(32)
                shape = mins.reshape(len(sets), BANDS, ROWS)
                band = common.mix((shape * _C[0]).sum(axis=2) + np.arange(BANDS, dtype=np.uint64)).view(np.int64)
                digest = _digests(sets)
                yield pa.RecordBatch.from_arrays([
                    ids.slice(a, len(sets)), pa.array([len(s) for s in sets], pa.int64()), pa.array([d[0] for d in digest], pa.int64()),
                    pa.array([d[1] for d in digest], pa.int64()),
                    pa.ListArray.from_arrays(np.arange(0, band.size + 1, BANDS, dtype=np.int32), pa.array(band.ravel()))],
                    names=["doc", "n", "d1", "d2", "bands"])

    return run


def needed_matches(threshold: float, hashes: int = LONG, batch: int = BATCH, miss: float = MISS) -> np.ndarray:
    """For each count of compared hashes: the fewest matches at which P(similarity >= threshold) is still at least miss."""
    s = (np.arange(2_000) + 0.5) / 2_000
    p = s + (1 - s) / 256  # bytes also agree by chance
    out = []
    for t in range(batch, hashes + 1, batch):
        m = np.arange(t + 1)[:, None]
        like = m * np.log(p) + (t - m) * np.log1p(-np.minimum(p, 1 - 1e-12))
        like = np.exp(like - like.max(axis=1, keepdims=True))
        tail = like[:, s >= threshold].sum(axis=1) / like.sum(axis=1)
        out.append(int(np.argmax(tail >= miss)))
    return np.array(out)


def _survivors(x: np.ndarray, y: np.ndarray, least: np.ndarray) -> np.ndarray:
    """Rows of two signature tables that the sequential comparison does not prune."""
    live, matches = np.arange(len(x)), np.zeros(len(x), dtype=np.int64)
    for k, need in enumerate(least):
        part = slice(k * BATCH, (k + 1) * BATCH)
        matches[live] += (x[live, part] == y[live, part]).sum(axis=1)
        live = live[matches[live] >= need]
    return live


def _table(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), LONG)


def _reach(u: np.ndarray, v: np.ndarray, percent: int) -> bool:
    """Whether two full sets reach the threshold."""
    both = len(np.intersect1d(u, v, assume_unique=True))
    return 100 * both >= percent * (len(u) + len(v) - both)


def _mixed(rows: DataFrame) -> DataFrame:
    """rows (key, rep, component) of groups with several components, with the largest and the numbers of blocks."""
    shares = rows.groupBy("key", "component").agg(F.count("*").alias("size"))
    mixed = shares.groupBy("key").agg(F.max(F.struct("size", "component")).alias("top"), F.count("*").alias("parts"), F.sum("size").alias("all")).where("parts > 1").select(
        "key", F.col("top.component").alias("main"), F.ceil((F.col("all") - F.col("top.size")) / BLOCK).alias("few_blocks"), F.ceil(F.col("all") / BLOCK).alias("whole_blocks"))
    return common.checkpoint(rows.join(mixed, "key"))


def _blocks(rows: DataFrame, full: DataFrame, percent: int) -> DataFrame:
    """(a, b): links of ids in large groups, by blocks of members outside the main component against blocks of all members.

    Only links that join what a task's earlier links do not leave it.
    """
    least, limit = needed_matches(percent / 100), percent / 100
    data = full.select("rep", "doc", "n", "sig", "grams")
    spread = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    own = lambda n: F.pmod(F.xxhash64("rep"), F.col(n))
    left = rows.where("component <> main").select("key", "rep", "component", own("few_blocks").alias("i"), spread("whole_blocks").alias("j")).join(data, "rep")
    right = rows.select("key", "rep", "component", own("whole_blocks").alias("j"), spread("few_blocks").alias("i")).join(data, "rep")
    names = ("key", "doc", "component", "i", "j", "n", "sig", "grams")
    left, right = left.select(*names), right.select(*[F.col(c).alias(f"{c}_") for c in names])  # the two sides have a common origin

    def run(key, x, y):
        a, b = [], []
        if x.num_rows and y.num_rows:
            xs, ys = _table(x.column("sig")), _table(y.column("sig_"))
            xg, yg = ([np.frombuffer(g.as_buffer(), np.uint64) for g in c] for c in (x.column("grams"), y.column("grams_")))
            xd, xc, xn = (x.column(c).to_numpy() for c in ("doc", "component", "n"))
            yd, yc, yn = (y.column(c).to_numpy() for c in ("doc_", "component_", "n_"))
            forest = Forest()
            for k in range(len(xd)):
                near = np.flatnonzero((yc != xc[k]) & (np.minimum(yn, xn[k]) >= limit * np.maximum(yn, xn[k]) - 1e-6))
                for m in near[_survivors(ys[near], np.broadcast_to(xs[k], (len(near), LONG)), least)].tolist():
                    u, v = int(xd[k]), int(yd[m])
                    if not forest.joined(u, v) and _reach(xg[k], yg[m], percent):
                        forest.join(u, v)
                        a.append(u)
                        b.append(v)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return left.groupBy("key", "i", "j").cogroup(right.groupBy("key_", "i_", "j_")).applyInArrow(run, "a long, b long")


def _linked(pairs: DataFrame, full: DataFrame, percent: int, blocks: int) -> DataFrame:
    """The ids of the pairs (a, b) of classes that survive the sequential comparison and reach the threshold on their full sets.

    Pairs meet in tasks by the blocks of their ends, and a class is sent to a task once, not once for each pair.  Only links
    that join what a task's earlier links do not leave it.
    """
    least, limit = needed_matches(percent / 100), percent / 100
    block = lambda c: F.pmod(F.xxhash64(c), F.lit(blocks))
    placed = pairs.select(block("a").alias("i"), block("b").alias("j"), "a", "b").distinct()
    sent = placed.select("i", "j", F.explode(F.array("a", "b")).alias("rep")).distinct().join(full, "rep").select(
        *[F.col(c).alias(f"{c}_") for c in ("i", "j", "rep", "doc", "n", "grams", "sig")])

    def run(key, x, y):
        a, b = x.column("a").to_numpy(), x.column("b").to_numpy()
        reps, docs = y.column("rep_").to_numpy(), y.column("doc_").to_numpy()
        order = np.argsort(reps)
        grams = [np.frombuffer(g.as_buffer(), np.uint64) for g in y.column("grams_")]
        sigs, n = _table(y.column("sig_")), y.column("n_").to_numpy()
        at = lambda v: order[np.minimum(np.searchsorted(reps, v, sorter=order), len(order) - 1)]
        if not len(docs):
            a = b = a[:0]
        left, right = at(a), at(b)
        fits = np.flatnonzero(np.minimum(n[left], n[right]) >= limit * np.maximum(n[left], n[right]) - 1e-6)
        good, forest = [], Forest()
        for start in range(0, len(fits), 20_000):
            part = fits[start : start + 20_000]
            for k in part[_survivors(sigs[left[part]], sigs[right[part]], least)].tolist():
                u, v = int(docs[left[k]]), int(docs[right[k]])
                if not forest.joined(u, v) and _reach(grams[left[k]], grams[right[k]], percent):
                    forest.join(u, v)
                    good.append(k)
        return pa.table({"a": pa.array(docs[left[good]], pa.int64()), "b": pa.array(docs[right[good]], pa.int64())})

    return placed.groupBy("i", "j").cogroup(sent.groupBy("i_", "j_")).applyInArrow(run, "a long, b long")


def _full(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """(rep, doc, n, grams, sig) of the classes wanted: the sorted set, and the signature that is compared."""
    ids = common.checkpoint(wanted.select("doc").distinct())
    picked = ids if ids.count() > BROADCAST_IDS else F.broadcast(ids)

    def run(batches):
        for batch in batches:
            for _, sets in shingle_sets(batch.column("body"), size):
                low = common.mix(signatures(sets, LONG).ravel()).reshape(len(sets), LONG).astype(np.uint8)
                digest = _digests(sets)
                yield pa.RecordBatch.from_arrays([
                    pa.array([len(s) for s in sets], pa.int64()), pa.array([d[0] for d in digest], pa.int64()), pa.array([d[1] for d in digest], pa.int64()),
                    pa.array([s.tobytes() for s in sets], pa.binary()), pa.array([x.tobytes() for x in low], pa.binary())], names=["n", "d1", "d2", "grams", "sig"])

    # an id may have other texts than that of the class
    found = docs.join(picked, "doc", "left_semi").select("body").mapInArrow(run, "n long, d1 long, d2 long, grams binary, sig binary")
    return common.checkpoint(found.dropDuplicates(["n", "d1", "d2"]).join(wanted.select("rep", "doc", "n", "d1", "d2"), ["n", "d1", "d2"]).select("rep", "doc", "n", "grams", "sig"))


def _same_ids(coded: DataFrame, classes: DataFrame) -> DataFrame | None:
    """(a, b): links of an id that occurs with several sets to the ids of their classes; None if no id does."""
    sides = [f(c).alias(f"{k}_{c}") for c in ("n", "d1", "d2") for k, f in (("least", F.min), ("most", F.max))]
    several = coded.where("doc is not null").groupBy("doc").agg(*sides).where("least_n <> most_n or least_d1 <> most_d1 or least_d2 <> most_d2").select("doc")
    several = common.checkpoint(several)
    n = several.count()
    if not n:
        return None
    rows = coded.where("n > 0").select("doc", "n", "d1", "d2").join(several if n > BROADCAST_IDS else F.broadcast(several), "doc")
    return common.checkpoint(rows.join(classes.select("n", "d1", "d2", F.col("doc").alias("a")), ["n", "d1", "d2"]).select("a", F.col("doc").alias("b")).distinct())


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 5, percent: int = THRESHOLD) -> DataFrame:
    """(doc, n_shingles, component): one row per row of ``docs``."""
    base = docs.select(F.col(doc_id).cast("long").alias("doc"), F.col(text).alias("body"))
    coded = common.checkpoint(base.mapInArrow(_encode(shingle), "doc long, n long, d1 long, d2 long, bands array<long>"))
    classes = common.checkpoint(coded.where("n > 0 and doc is not null").groupBy("n", "d1", "d2").agg(F.min("doc").alias("doc"), F.first("bands").alias("bands")).withColumn(
        "rep", F.monotonically_increasing_id()))
    rows = classes.select("rep", F.explode("bands").alias("band"))
    sizes = rows.groupBy("band").agg(F.count("*").alias("members")).where("members > 1")
    buckets = common.checkpoint(rows.join(sizes, "band"))
    degree = buckets.groupBy("rep").agg(F.sum("members").alias("degree"))
    wanted = common.checkpoint(degree.join(classes.drop("bands"), "rep"))
    full = _full(base, wanted, shingle)

    known = buckets.join(wanted.select("rep", "degree", "d1"), "rep")
    hubs = known.groupBy("band").agg(F.max(F.struct("degree", "d1", "rep"))["rep"].alias("hub"))
    hubs = common.checkpoint(hubs)
    star = buckets.select("rep", "band").join(hubs, "band").where("rep <> hub").select(F.least("rep", "hub").alias("a"), F.greatest("rep", "hub").alias("b")).distinct()
    star = common.checkpoint(star)
    weight = full.agg(F.sum(F.octet_length("grams") + F.octet_length("sig"))).first()[0] or 0
    blocks = max(1, -(-weight // BLOCK_BYTES))
    edges = common.checkpoint(_linked(star, full, percent, blocks))
    same = _same_ids(coded, classes)
    if same is not None:
        edges = edges.unionByName(same)
    comps = common.checkpoint(components(edges))

    # what hubs cannot decide: members outside the largest component of their bucket
    where = wanted.select("rep", "doc").join(comps.select(F.col("node").alias("doc"), "component"), "doc", "left").select("rep", F.coalesce("component", "doc").alias("component"))
    placed = buckets.join(where, "rep")
    small = _mixed(placed.where(F.col("members") <= SMALL).select(F.col("band").alias("key"), "rep", "component"))
    end = lambda t, x: t.select("key", F.col("rep").alias(x), F.col("component").alias(f"c{x}"))
    pairs = end(small.where("component <> main"), "x").join(end(small, "y"), "key").where("cx <> cy").select(
        F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    # large buckets with one hub are one group, so that what shares many bands meets once
    large = _mixed(placed.where(F.col("members") > SMALL).join(hubs, "band").select(F.col("hub").alias("key"), "rep", "component").distinct())
    comps = components(edges.unionByName(_linked(pairs, full, percent, blocks)).unionByName(_blocks(large, full, percent)))

    comps = comps.select(F.col("node").alias("doc"), "component")
    named = classes.select("n", "d1", "d2", "doc").join(comps, "doc", "left").select("n", "d1", "d2", F.coalesce("component", "doc").alias("component"))
    out = coded.select("doc", "n", "d1", "d2").join(named, ["n", "d1", "d2"], "left").select("doc", "n", "component")
    if same is not None:  # a row without words goes with the other rows of its id
        out = out.where("n > 0").unionByName(coded.where("n = 0").select("doc", "n").join(comps, "doc", "left"))
    return out.select("doc", F.col("n").alias("n_shingles"), F.when(F.col("doc").isNotNull(), F.coalesce("component", "doc")).alias("component"))


def op9_minhash(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(common.table(spark, sf_dir, "documents"), shingle=SHINGLE)
    return found.select(F.col("doc").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"),
                        F.col("doc").eqNullSafe(F.col("component")).alias("kept"))


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"
#: The same rows in DuckDB, by joining the shingles (small tables only).
ORACLE_SQL = f"""WITH RECURSIVE d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
 s AS (SELECT doc_id, list_distinct(list_transform(generate_series(1, greatest(len(w) - {SHINGLE - 1}, 1)), lambda a: array_to_string(w[a:a + {SHINGLE - 1}], ' '))) AS g FROM d WHERE len(w) > 0),
 k AS (SELECT min(doc_id) AS rep, list_sort(g) AS g FROM s GROUP BY list_sort(g)), x AS (SELECT rep, len(g) AS n, unnest(g) AS t FROM k),
 j AS (SELECT a.rep AS a, b.rep AS b, count(*) AS met, any_value(a.n) AS na, any_value(b.n) AS nb FROM x a JOIN x b ON a.t = b.t AND a.rep < b.rep AND 100 * least(a.n, b.n) >= {THRESHOLD} * greatest(a.n, b.n) GROUP BY ALL),
 l AS (SELECT a, b FROM j WHERE 100 * met >= {THRESHOLD} * (na + nb - met)), e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
 r(a, b) AS (SELECT rep, rep FROM k UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b), c AS (SELECT a AS rep, min(b) AS component FROM r GROUP BY a),
 m AS (SELECT s.doc_id, len(s.g) AS n, c.component FROM s JOIN k ON k.g = list_sort(s.g) JOIN c ON c.rep = k.rep)
 SELECT d.doc_id, coalesce(m.n, 0)::BIGINT AS n_shingles, coalesce(m.component, d.doc_id) AS component_id, coalesce(m.component, d.doc_id) = d.doc_id AS kept FROM d LEFT JOIN m ON m.doc_id = d.doc_id"""
