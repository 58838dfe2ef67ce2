"""Items meet software by product: pairs of one set over several tasks, equal hashes, odd rows, CPE texts split once."""

from pyspark.sql import functions as F

from vigil.operators import assets, experiments


def test_pairs_of_one_set_are_made_by_several_tasks_from_narrow_rows(spark):
    products = spark.range(200).selectExpr("id vuln_id", "'v' v", "'p' p")
    software = spark.range(500).selectExpr("id asset_id", "'v' v", "'p' p", "id / 1000 confidence")
    pairs = experiments.product_matches(products, software)
    made = pairs.groupBy(F.spark_partition_id().alias("task")).agg(F.count("*").alias("n")).collect()
    assert sum(r.n for r in made) == 200 * 500 and len(made) > 1
    plan = pairs._jdf.queryExecution().optimizedPlan()
    while plan.nodeName() != "Join":
        plan = plan.children().apply(0)
    kinds = [[side.schema().apply(i).dataType().simpleString() for i in range(side.schema().length())] for side in (plan.left(), plan.right())]
    assert not {k for side in kinds for k in side} - {"bigint", "int", "double"}


def test_sets_of_one_hash_and_odd_rows(spark, monkeypatch):
    """Sets whose hashes meet stay apart; items and assets without an id, names that are null and software given twice match as in a plain join."""
    monkeypatch.setattr(F, "xxhash64", lambda *columns: F.lit(7).cast("long"))
    named = [(1, "v", "a"), (1, "v", "b"), (2, "v", "a"), (3, "v", "b"), (4, "v", "b"), (4, "v", "a"), (5, "v", "c"), (None, "v", "c"), (6, None, "a"), (7, "none", "a"), (7, "v", "b"), (7, "v", "b")]
    runs = [(i % 9, "v", "abc"[i % 3], None if i % 4 == 0 else i / 100) for i in range(40)] + [(None, "v", "c", 0.3), (None, "v", "a", None), (30, None, "a", 0.9), (31, "v", None, 0.9), (32, "other", "a", 0.9), (33, "v", "b", None)]
    products = spark.createDataFrame(named, "vuln_id long, v string, p string")
    software = spark.createDataFrame(runs, "asset_id long, v string, p string, confidence double")
    plain = products.join(software, ["v", "p"]).groupBy("asset_id", "vuln_id").agg(F.coalesce(F.max("confidence"), F.lit(0.8)).alias("best"))
    shown = lambda df: sorted(map(str, df.collect()))
    assert shown(experiments.product_matches(products, software)) == shown(plain)


def test_a_cpe_is_split_once(spark):
    cpe = "cpe:2.3:a:"
    rows = [(1, "V", " p ", f"{cpe}v:p:1"), (2, "x", "p", f"{cpe}V:P:1"), (3, "x", "p", "cpe:2.3:a:v"), (4, None, "p", f"{cpe}v:p"), (5, None, None, None), (6, "v", None, f"{cpe}:p:1"), (7, "v", "p", "")]
    keys = assets.software_keys(spark.createDataFrame(rows, "asset_id long, vendor string, product string, cpe string").withColumn("confidence", F.lit(0.5)))
    assert keys.columns == ["asset_id", "v", "p", "by", "confidence"]
    want = [(1, "v", "p", "name"), (2, "v", "p", "cpe"), (2, "x", "p", "name"), (3, "x", "p", "name"), (4, None, "p", "name"), (4, "v", "p", "cpe"), (5, None, None, "name"), (6, "", "p", "cpe"), (6, "v", None, "name"), (7, "v", "p", "name")]
    assert sorted((tuple(r)[:4] for r in keys.collect()), key=str) == sorted(want, key=str)
    assert keys._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1
