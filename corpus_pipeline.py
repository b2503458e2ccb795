"""The corpus pipeline: toxicity, near-duplicates, benchmark passages, then the mix.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.
Null, empty and repeated rows follow the stages' operators: a document without text is never toxic by evidence, a
near-duplicate or contaminated; rows without an id are no one's duplicate and stay; rows that repeat an id stay together.
"""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import functions as F

from quarry.llm import common, decontaminate, minhash, mixing, toxicity


def toxic(spark, docs, sf_dir):
    """Documents that the grammar rejects go."""
    name = common.fresh(docs, "toxicity")
    found = toxicity.scored(docs, common.table(spark, sf_dir, "labels"), as_column=name)
    return found.where(F.col(name) < toxicity.THRESHOLD).select(*docs.columns)


def near_duplicates(spark, docs, sf_dir):
    """One document of each group stays, the one with the smallest id."""
    found, name = minhash.near_duplicates(docs), common.fresh(docs, "dropped_id")
    dropped = common.checkpoint(found.where("doc <> component").select(F.col("doc").alias(name)).distinct())
    if dropped.count() <= minhash.BROADCAST_IDS:  # texts then stay where they are; beyond it they are shuffled
        dropped = F.broadcast(dropped)
    return docs.join(dropped, F.col("doc_id") == F.col(name), "left_anti")


def benchmark(spark, docs, sf_dir):
    """Documents that the contamination rule finds go; the others stay as they are."""
    name = common.fresh(docs, "decon")
    found = decontaminate.find(docs, common.table(spark, sf_dir, "benchmark"), as_column=name)
    return found.where(~decontaminate.contaminated(F.col(name))).select(*docs.columns)


def mix(spark, docs, sf_dir):
    """One row per copy that the mix takes."""
    return mixing.emitted(docs)


STAGES = [("toxicity", toxic), ("near duplicates", near_duplicates), ("benchmark decontamination", benchmark), ("mixing", mix)]


def run(spark, sf_dir):
    docs = common.table(spark, sf_dir, "documents")
    folder = f"{common.shared_dir(spark)}/pipeline-{uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs.write.parquet(f"{folder}/{k}")
            docs = spark.read.parquet(f"{folder}/{k}")
            if k:  # the stage before has been read for the last time
                common.remove(spark, f"{folder}/{k - 1}")
    return docs


#: The stages learn from data and draw by hashes of Spark's own; they are tested against brute-force versions.
ORACLE_SQL = None
