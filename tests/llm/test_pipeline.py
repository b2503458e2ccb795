import collections
import re

import pytest

import corpus_pipeline
from quarry.llm import common, mixing

from test_ops import corpus, docs, exact_components, labelled


@pytest.fixture()
def folder(spark, tmp_path):
    rows, labels = labelled()
    clean = [(k + 5000 if k is not None else None, t, s) for k, t, s in corpus()]
    table = [*rows, *clean]
    docs(spark, table).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, clean[5][1])], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    return str(tmp_path), table, labels, clean


def test_stages(spark, folder):
    sf, table, labels, clean = folder
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "near duplicates", "benchmark decontamination", "mixing"]
    now = common.table(spark, sf, "documents")
    toxic = {i for i, y in labels if y}
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, now, sf)
        before = [(r.doc_id, r.text, r.source) for r in now.collect()]
        kept = [(r.doc_id, r.text, r.source) for r in after.collect()]
        if name == "toxicity":
            assert not toxic & {k[0] for k in kept} and len(kept) >= len(before) - len(toxic)
        elif name == "near duplicates":
            want = sorted(repr(k) for k, _, c in exact_components(before, 5) if k is None or k == c)
            assert sorted(repr(k[0]) for k in kept) == want
        elif name == "benchmark decontamination":
            assert {k[0] for k in before} - {k[0] for k in kept} == {clean[5][0]}
        else:
            assert {k[0] for k in kept} <= {k[0] for k in before}
            copies = collections.Counter(kept)
            want = {(r.doc_id, r.text, r.source): r.mix.copies for r in mixing.mixed(now).collect()}
            assert copies == collections.Counter({k: n for k, n in want.items() if n})
            words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
            sizes, taken = collections.Counter(), collections.Counter()
            for _, t, s in before:
                sizes[s] += words(t)
            for _, t, s in kept:
                taken[s] += words(t)
            whole = sum(sizes.values())
            most = max(words(t) for _, t, _ in before)
            assert kept and abs(sum(taken.values()) - whole) <= 0.1 * whole + 2 * most and all(taken[s] <= 3 * sizes[s] for s in sizes)
        if name != "mixing":
            assert after.columns == now.columns
        now = after
    assert corpus_pipeline.run(spark, sf).count() == now.count()
