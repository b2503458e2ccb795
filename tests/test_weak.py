"""Plans that stay small: key owners, tiers, call sites."""

from pyspark.sql import functions as F

from quarry.operators import candidates, ranking, sessions


def test_key_owner_is_linear_in_equal_prefixes(spark):
    n = 20_000  # all keys begin alike: one row for each pair would be 400 million
    keys = spark.range(n).select(F.col("id").alias("key_id"), F.when(F.col("id") == 7, "single-prefix-7").otherwise("shared-prefix").alias("prefix"))
    tokens = spark.range(n).select(F.col("id").alias("token_id"), F.lit(None).cast("long").alias("embedded"), F.when(F.col("id") == 3, "single-prefix-7.xyz").otherwise(F.concat(F.lit("shared-prefix."), "id")).alias("shown"))
    found = candidates.key_owner(keys, tokens, "key_id", "prefix")
    assert [(r.token_id, r.owner) for r in found.where("owner is not null").collect()] == [(3, 7)] and found.count() == n


def test_a_resumed_run_plans_no_scan(spark):
    t = lambda name, *v: spark.createDataFrame([(x,) for x in v], "v int").withColumn(name, F.lit(1)).drop(name).where(F.lit(name) != F.col("v").cast("string"))
    empty, cached, scanned = t("a"), t("the_snapshot", 1, 2), t("the_scan", 3)
    found = sessions.source_of_truth(empty, empty, cached, scanned)
    plan = found._jdf.queryExecution().toString()
    assert "the_snapshot" in plan and "the_scan" not in plan and sorted(map(tuple, found.collect())) == [(1, 2), (2, 2)]
    assert [tuple(r) for r in ranking.first_tier(empty, empty).collect()] == [] and [tuple(r) for r in ranking.first_tier(empty, scanned).collect()] == [(3, 2)]


def test_call_sites_of_many_names(spark):
    names = [f"name{k}" for k in range(500)]
    texts = ["name1(name2 (x), my_name3(), name30())\ndef name4(): pass\nname4()\nasync def  name5 (a): name5(name5(1))", "undef name6()\nobj.name7()", "def name8(): pass", None, ""]
    got = {r.name: r.calls for r in ranking.call_sites(spark.createDataFrame([(t,) for t in texts], "t string"), "t", names).collect()}
    assert len(got) == 500 and {n: c for n, c in got.items() if c} == {"name1": 1, "name2": 1, "name30": 1, "name4": 1, "name5": 2, "name6": 1, "name7": 1}
