"""From ranked rows to proposed workflows: rank, shard, classify, complete, promote, cluster, propose."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators import ranking


def propose(rows: DataFrame, name: str, hint: str, module: str, order: list, scorer, size: int = ranking.SHARD, shards: int = ranking.SHARDS, most: int = 5) -> DataFrame:
    """``scorer`` is a column that gives a band, or a function of a table of classified rows that returns (name, band).

    Only the first size * shards rows are classified, as a budget; the others get LOW.  An invalid band counts as LOW.
    """
    head = ranking.numbered_head(rows, order, size * shards, "_n").withColumn("shard", F.floor((F.col("_n") - 1) / size))
    verdicts = scorer(head) if callable(scorer) else head.select(name, scorer.alias("band"))
    whole = ranking.complete_verdicts(rows, verdicts, name)
    return ranking.clusters(whole.where(F.col("band").isin("HIGH", "MEDIUM")), hint, module, name, most)
