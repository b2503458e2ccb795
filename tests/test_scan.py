"""The automaton against plain search, and the tree source against the listing."""

import os
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.functions import needles
from quarry.operators import files
from quarry.sources import languages, trees, walk


def plain(text: bytes, wanted):
    return sorted((m.start(), k) for k, n in enumerate(wanted) if n for m in re.finditer(b"(?=" + re.escape(n) + b")", text))


def found(auto, texts):
    data = np.frombuffer(b"".join(texts), np.uint8)
    bounds = np.cumsum([0, *map(len, texts)])
    out = [[] for _ in texts]
    for t, k, at in zip(*auto.hits(data, bounds), strict=True):
        out[t].append((at, k))
    return [sorted(x) for x in out]


@pytest.mark.parametrize("lane", [1, 7, 4096])
def test_automaton_against_plain_search(lane, monkeypatch):
    monkeypatch.setattr(needles, "LANE", lane)
    rng = random.Random(3)
    wanted = [b"he", b"she", b"his", b"hers", b"", b"e", b"aaaa", b"aa", b"\x00\xff", "ü".encode(), b"he"]
    texts = [b"", b"ushers", b"h", b"aaaaaaaa", "süß he\x00\xff".encode("latin-1") + "ü".encode(), bytes(rng.choice(b"aehirs") for _ in range(3000))]
    assert found(needles.Automaton(wanted), texts) == [plain(t, wanted) for t in texts]


def test_five_thousand_needles(spark, monkeypatch):
    rng = random.Random(5)
    words = sorted({"".join(rng.choice("abcdef") for _ in range(rng.randint(3, 7))) for _ in range(9000)})[:5000]
    texts = ["".join(rng.choice("abcdef ") for _ in range(rng.randint(0, 6000))) for _ in range(60)] + [None, ""]
    rows = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], "k int, t string, HITS_ string")
    want = {k: [n for n, w in enumerate(words) if w in (t or "")] for k, t in enumerate(texts)}
    assert len(words) == 5000 and {r.k: list(r.hits) for r in needles.search(rows, "t", words).collect()} == want
    monkeypatch.setattr(needles, "CELLS", 300_000)  # several automata
    assert len(needles.automata([w.encode() for w in words])) > 10
    got = needles.search(rows, "t", words, positions=True).collect()
    assert {r.k: sorted({h.needle for h in r.hits}) for r in got} == want
    assert all(texts[r.k][h.at : h.at + len(words[h.needle])] == words[h.needle] for r in got for h in r.hits)


def test_search_equals_sniff(spark):
    for language in languages.EXTENSIONS:
        listed = [*languages.needles(language, True), ""]
        texts = ["", "plain", *[f"x{n}y" for n in listed], "ü" * 70_000 + listed[0], "x" * 65_530 + listed[0], None]
        rows = spark.createDataFrame([(t,) for t in texts], "t string")
        for column in (F.col("t"), F.col("t").cast("binary")):
            both = needles.search(rows.select(column.alias("t")), "t", listed, files.HEAD_BYTES).select((F.size("hits") > 0).alias("a"), files.sniff("t", listed if column is not None and "CAST" not in str(column) else [n.encode() for n in listed]).alias("b"))
            assert both.where("a <> b").count() == 0
    assert needles.search(rows, "t", []).where("size(hits) > 0").count() == 0


@pytest.fixture()
def project(tmp_path):
    rng = random.Random(2)
    for k in range(60):
        folder = tmp_path / rng.choice(["", "a", "a/b", "c/d/e", "node_modules/x", ".git/o", "src/tests", "src/venv/lib", "f"])
        folder.mkdir(parents=True, exist_ok=True)
        (folder / f"{rng.choice(['m', 'test_m', 'x.y', 'setup'])}{k}.{rng.choice(['py', 'ts', 'txt'])}").write_text(rng.choice(["@app.get('/x')", "nothing", "def f(): pass"]) * rng.randint(1, 400))
    (tmp_path / "setup.py").write_text("@app.get")
    (tmp_path / "a" / "big.py").write_bytes(b"@app.get" + b" " * files.MAX_BYTES)
    (tmp_path / "a" / "empty.py").write_text("")
    return tmp_path


def test_excluded_folders_are_not_opened(project, monkeypatch):
    os.symlink(project, project / "a" / "loop")
    opened = []
    real = os.scandir
    monkeypatch.setattr(os, "scandir", lambda path: opened.append(os.path.relpath(path, project)) or real(path))
    listed = list(walk.kept(walk.Tree(str(project)), walk.Rules(("py",))))
    assert listed and not [o for o in opened if re.search(r"node_modules|\.git|tests|venv|loop", o)] and len(opened) == len(set(opened))
    assert {p.rpartition("/")[0] for p, *_ in walk.kept(walk.Tree(f"file://{project}"), walk.Rules())} <= {o if o != "." else "" for o in opened}


def test_partitions_are_balanced():
    rng = random.Random(1)
    listed = [(f"f{k}", int(rng.paretovariate(1.2) * 1000), 0.0) for k in range(3000)]
    parts = walk.packed(listed, sum(f[1] for f in listed) // 20)
    sizes = [sum(f[1] for f in p) for p in parts]
    assert sorted(f for p in parts for f in p) == sorted(listed) and max(sizes) - min(sizes) <= max(f[1] for f in listed)
    assert len(walk.packed([(f"e{k}", 0, 0.0) for k in range(5000)], most=100)) == 50 and walk.packed([]) == []


def test_tree_source_equals_the_listing(spark, project):
    key = lambda df: sorted((r.rel_path, r["size"], bytes(r.content), r.sha) for r in df.collect())
    for more in ([], [f"needle{k}" for k in range(60)]):  # by patterns, and by one automaton
        one, two = (key(trees.repo(spark, str(project), ["py", "ts"], ["@app.", *more], ["def "], pruned=p)) for p in (False, True))
        assert one == two and len(one) > 5
    whole = walk.tree(spark, str(project), walk.Rules(None, (), (), (), None), content=False, part_bytes=5000)
    assert whole.rdd.getNumPartitions() > 3 and whole.where("content is not null").count() == 0
    listed = trees.listing(spark, str(project)).where("rel_path not like '%/.%' and rel_path not like '.%'")
    whole = whole.where("size > 0")  # the listing leaves empty files out
    assert sorted(map(tuple, whole.select("rel_path", "size").collect())) == sorted(map(tuple, listed.select("rel_path", "size").collect()))
    assert walk.tree(spark, str(project / "none")).count() == 0
