"""A join of rows with an aggregate of theirs, of which one key holds a third of the rows."""

from pyspark.sql import functions as F

from millrace.llm import common


def test_frequent_keys_are_dealt_over_tasks(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT", 100)
    rows = spark.range(6000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 1000 + 10).alias("key"), "id")
    own = rows.groupBy("key").agg(F.min("id").alias("least"), F.count("*").alias("n"))
    want = sorted(map(tuple, rows.join(own, "key").select("key", "id", "least", "n").collect()))
    set_ = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in set_}
    try:
        for k, v in set_.items():
            spark.conf.set(k, v)
        met = common.meet(rows, own, ["key"], "id", 6000).withColumn("task", F.spark_partition_id())
        got = met.collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sorted((r.key, r.id, r.least, r.n) for r in got) == want
    tasks = [r.task for r in got if r.key == 7]
    assert len(set(tasks)) > 1 and max(map(tasks.count, set(tasks))) < 0.6 * len(tasks)


def test_no_rows(spark):
    rows = spark.createDataFrame([], "key long, id long")
    own = rows.groupBy("key").agg(F.min("id").alias("least"), F.count("*").alias("n"))
    assert common.meet(rows, own, ["key"], "id", 0).collect() == []


def test_components_of_hubs(spark, tmp_path, monkeypatch):
    """Stars about the largest and the least of their nodes, joined by one edge, and a star of their own."""
    from millrace.llm import simhash

    monkeypatch.setattr(common, "HOT", 16)
    pairs = [(k, 500) for k in range(100)] + [(700, k) for k in range(701, 800)] + [(40, 750)] + [(k, 999) for k in range(900, 960)]
    roots = {r.node: r.root for r in simhash.components(spark.createDataFrame(pairs, "u long, v long"), str(tmp_path)).collect()}
    assert roots == {x: 900 if x >= 900 else 0 for pair in pairs for x in pair}
