"""Fill-in-middle, sharding and hard negatives against plain versions, with hostile rows."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import common, fim, negatives, sharding

TEXTS = [None, "", " ", "one", " one", "one ", "\t a \x0b b\n", "x<P>y", "<S>", "ends <M>", "ünï cödé 漢字   nbsp 😀 é", "a" * 200_000, "word " * 40_000, " " * 50_000 + "w", "a\x00b c", "<", "<P", "P> <S", "same text", "same text"]
DOCS = "doc_id long, text string, FIM string, place string, place_key string, size string, Form int"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "x", "x", "x", "x", 1) for i, t in rows], DOCS)


def plain_fim(i, t, unit):
    t = t or ""
    u = list(t) if unit == "character" else re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", t)
    g = hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()
    h = [int(g[k : k + 8], 16) for k in (0, 8, 16, 24)]
    a, b = sorted((h[0] % (len(u) + 1), h[1] % (len(u) + 1)))
    p, m, s = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
    if not t or any(x in t for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return ("plain", len(u), None, None, t)
    form = "spm" if h[3] % 100 < 80 else "psm"
    return (form, len(u), len(p), len(m), f"<P>{p}<S>{s}<M>{m}" if form == "psm" else f"<S>{s}<P>{p}<M>{m}")


@pytest.mark.parametrize("unit", ["token", "character"])
def test_fim_against_a_plain_version(spark, unit):
    rows = [(k * 100 + j, t) for j in range(6) for k, t in enumerate(TEXTS)] + [(None, "null id text"), (3, "again"), (3, "again")]
    found = fim.transformed(docs(spark, rows), unit=unit).withColumn("back", fim.restored(F.col("fim.output"), F.col("fim.form"))).collect()
    want = Counter((i, t, *plain_fim(i, t, unit)) for i, t in rows)
    assert Counter((r.doc_id, r.text, *r.fim) for r in found) == want
    assert all(r.back == (r.text or "") for r in found)
    assert {r.fim.form for r in found} == {"plain", "spm", "psm"} and found[0].place == "x" and found[0].Form == 1


def test_fim_chunks_and_empty(spark, monkeypatch):
    assert fim.transformed(docs(spark, [])).count() == 0
    texts = ["", "a b", " c", "dé e ", "", "f"]
    data, bounds = common.utf8(__import__("pyarrow").array(texts))
    runs = fim.Runs(data, bounds)
    assert runs.count().tolist() == [0, 2, 1, 3, 0, 1]
    for k in range(4):
        cut = np.minimum(runs.count(), k)
        for t, c, at in zip(texts, cut, runs.offset(cut), strict=True):
            u = re.findall(r"\s*\S+|\s+", t)
            assert t[:at] == "".join(u[:c])


def plain_shard(tree, i):
    def draw(path):
        u = (int(hashlib.md5(f"{'' if i is None else i}:{path}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
        return -math.log(u)

    at = ()
    for depth in range(3):
        kids = {p[: depth + 1] for p in tree.leaves if p[:depth] == at and tree.weights.get(p[: depth + 1], 1) > 0}
        at = min(kids, key=lambda p: draw("/".join(map(str, p))) / tree.weights.get(p, 1))
    return tree.leaves[at]


def shards_of(spark, tree, ids):
    return {r.doc_id: r.s for r in spark.createDataFrame([(i,) for i in ids], "doc_id long").select("doc_id", tree.shard(F.col("doc_id")).alias("s")).collect()}


def test_tree_against_a_plain_descent(spark):
    tree = sharding.Tree(sharding.layout(13).leaves, {(0,): 2.5, (1, 0): 0.5, (2, 0, 2): 4.0, (3,): 0.0})
    assert shards_of(spark, tree, [*range(300), None]) == {i: plain_shard(tree, i) for i in [*range(300), None]}


@pytest.mark.parametrize("shards", [1, 2, 4, 5, 8, 9, 40])
def test_one_more_shard_takes_rows_only_into_itself(spark, shards):
    ids = range(4000)
    before, after = (shards_of(spark, sharding.layout(n), ids) for n in (shards, shards + 1))
    moved = {i for i in ids if before[i] != after[i]}
    assert moved and {after[i] for i in moved} == {shards} and set(before.values()) == set(range(shards))


@pytest.mark.parametrize(("path", "weight"), [((1,), 3.0), ((1, 1), 0.25), ((2, 0, 18), 5.0), ((0,), 0.0)])
def test_a_changed_weight_moves_rows_only_at_its_subtree(spark, path, weight):
    base = sharding.layout(40)
    inside = {n for leaf, n in base.leaves.items() if leaf[: len(path)] == path}
    near = {n for leaf, n in base.leaves.items() if leaf[: len(path) - 1] == path[:-1]}
    ids = range(6000)
    before, after = shards_of(spark, base, ids), shards_of(spark, sharding.Tree(base.leaves, {path: weight}), ids)
    moved = [(before[i], after[i]) for i in ids if before[i] != after[i]]
    assert moved and all(a in near and b in near and ((b in inside) if weight > 1 else (a in inside)) for a, b in moved)


def test_shares_follow_the_weights(spark):
    base = sharding.layout(8)
    got = Counter(shards_of(spark, sharding.Tree(base.leaves, {(0,): 3.0, (0, 1): 2.0}), range(20_000)).values())
    region = sum(n for s, n in got.items() if s in (0, 4))
    assert region / 20_000 == pytest.approx(0.5, abs=0.02) and got[4] / region == pytest.approx(2 / 3, abs=0.02)


@pytest.mark.parametrize("group", [100_000, 40])
def test_slots_have_no_gap(spark, group, monkeypatch, tmp_path):
    monkeypatch.setattr(sharding, "GROUP_ROWS", group)
    rows = [(k, f"text {k}") for k in range(900)] + [(7, "hot")] * 500 + [(8, f"hot id {k}") for k in range(300)] + [(None, None)] * 40 + [(5000, ""), (5001, "long " * 50_000)]
    found = sharding.placed(docs(spark, rows), sharding.layout(5), by=("text",))
    got = found.collect()
    assert Counter((r.doc_id, r.text) for r in got) == Counter(rows) and got[0].place_key == "x"
    by = defaultdict(list)
    for r in got:
        by[r.place.shard].append(r.place.slot)
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    tree = sharding.layout(5)
    assert {r.doc_id: r.place.shard for r in got} == {i: plain_shard(tree, i) for i, _ in rows}
    if group == 40:  # rows in the order of their slots, in files of some rows
        sharding.write(found, str(tmp_path / "out"), rows=100)
        back = spark.read.parquet(str(tmp_path / "out"))
        assert back.count() == len(rows)
        parts = defaultdict(list)
        for r in back.where("shard = 2").select("part", F.col("place.slot").alias("slot"), F.input_file_name().alias("f")).collect():
            assert r.slot // 100 == r.part
            parts[r.f].append(r.slot)
        assert all(s == sorted(s) for s in parts.values())


def test_slots_agree_between_runs(spark):
    rows = docs(spark, [(k % 300, f"text {k % 400}") for k in range(2000)])
    one, two = (sorted((r.doc_id, r.text, *r.place) for r in sharding.placed(d, sharding.layout(7), by=("text",)).collect()) for d in (rows, rows.repartition(7)))
    assert one == two
    assert sharding.placed(docs(spark, []), sharding.layout(3)).count() == 0


def test_shard_digests(spark, tmp_path):
    rows = [(1, None), (2, ""), (3, "é" * 10), (3, "é" * 10)]
    docs(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = Counter((r.doc_id, r["size"], r.text_crc32) for r in sharding.op13_sharding(spark, str(tmp_path)).collect())
    assert got == Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in rows)


def vectors():
    rng = np.random.default_rng(11)
    centres = rng.normal(size=(6, 8)) * 4
    rows = []
    for k in range(700):
        x = centres[k % 6] + rng.normal(size=8) * (0.02 if k % 3 else 0.6)
        rows.append((k, x.tolist(), int(rng.integers(3))))
    rows += [(1000 + k, rows[5][1], k % 3) for k in range(120)]  # copies, also anchors
    rows += [(2000, None, 1), (2100, [1.0, None] * 4, 1), (2200, [float("nan")] * 8, 1), (2300, [float("inf")] * 8, 0), (2400, rows[0][1], None), (None, rows[0][1], 1), (2500, [1e30] * 8, 1),
             (2600, [0.0] * 8, 2), (2700, [], 0), (2701, [], 0), (2702, [], 1), (2800, [1.0, 2.0], 0), (2801, [1.5, 2.0], 0), (2802, [1.1, 2.1], 1), (2900, [150.0] * 8, 1), (2901, [140.0] * 8, 1), (2902, [139.0] * 8, 0),
             (3000, [3e6] * 8, 1), (3001, [2.9e6] * 8, 1), (3002, [2.5e6] * 8, 2), (100, rows[100][1], 2), (100, rows[100][1], 2), (101, rows[101][1], rows[101][2])]
    return rows


def plain_negatives(rows, positives=5, k=5):
    part = []
    for i, v, label in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        q = [math.floor(256 * x) for x in v]
        if sum(x * x for x in q) <= 2**62:
            part.append((i, q, label))
    out = []
    for a, (i, q, label) in enumerate(part):
        if i % 100:
            continue
        score = [(-sum(x * y for x, y in zip(q, r, strict=True)), j, y) for b, (j, r, y) in enumerate(part) if b != a and len(r) == len(q)]
        for s, j, _ in sorted((s, j, y) for s, j, y in score if y == label)[:positives]:
            some = sorted((t, n) for t, n, y in score if y != label and -80 * s <= -100 * t <= -100 * s)[:k]
            out += [(i, j, rank + 1, n, -s, -t) for rank, (t, n) in enumerate(some)]
    return Counter(out)


@pytest.mark.parametrize(("group", "size"), [(4096, 8192), (3, 50)])
def test_hard_negatives_against_all_pairs(spark, group, size, monkeypatch):
    monkeypatch.setattr(negatives, "SLICE", size)
    rows = vectors()
    table = spark.createDataFrame([(i, v, y, "x", 1, "x", "x") for i, v, y in rows], "vec_id long, embedding array<double>, label int, VEC string, raw int, lows string, rank string")
    got = negatives.hard_negatives(table, group=group)
    want = plain_negatives(rows)
    assert Counter(map(tuple, got.collect())) == want and len(want) > 60


def test_bounds_replicate_rows_only_to_groups_that_they_might_serve(spark):
    rows = [(i, v, y) for i, v, y in vectors() if i is not None and i < 2000 and v is not None]
    table = spark.createDataFrame([(i, v, y) for i, v, y in rows], "vec long, v array<double>, label long").select(F.monotonically_increasing_id().alias("uid"), "vec", "label", "v")
    coded = common.checkpoint(table.mapInArrow(negatives._encode(256), negatives.CODED))
    some = coded.where("vec % 25 = 0")
    cells = negatives._cells(coded, some.count(), 4)
    assert len(set(cells.group)) > 3
    placed = coded.mapInArrow(negatives._assign(cells, False), f"{negatives.CODED}, cell int, d double")
    homes = some.mapInArrow(negatives._assign(cells, True), f"{negatives.CODED}, grp int, reach array<double>").withColumn("part", F.lit(0))
    asked = homes.withColumns({"lows": F.array((F.col("norm") * 0.9).cast("long")), "highs": F.array(F.lit(negatives.GREATEST))})
    sent = placed.join(negatives.routes(asked, cells), "cell").where("d >= least")
    assert sent.count() < placed.count() * asked.select("grp").distinct().count() / 2


def test_hard_negatives_without_anchors_or_rows(spark):
    kind = "vec_id long, embedding array<float>, label int"
    for rows in ([], [(1, [1.0], 1), (2, [1.0], 0)], [(100, None, 1)], [(100, [1.0], 1)], [(100, [1.0], 1), (200, [1.0], 1)]):
        assert negatives.hard_negatives(spark.createDataFrame(rows, kind)).count() == 0
