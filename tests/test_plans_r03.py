"""What the plans of changed queries hold."""

from pyspark.sql import functions as F

from kelpforge.operators import features


def test_training_rows_never_sort_labels(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        labels = spark.createDataFrame([(1, 2, 1), (1, 3, 0), (9, 2, 1), (None, 3, 1)], "user_id long, item_id long, label int")
        users, items = spark.createDataFrame([(1, 0.5)], "user_id long, a double"), spark.createDataFrame([(2, 1.5), (3, 2.5)], "item_id long, b double")
        one = users.select("user_id", F.array("a", F.lit(2.0)).alias("vector"))
        two = items.select("item_id", F.array("b", F.lit(1.0)).alias("vector"))
        out = features.assemble_training_rows(labels, users, items, one, two)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert out.columns == ["item_id", "user_id", "label", "a", "b", "retrieval_score"]
        assert sorted(map(tuple, out.collect()), key=str) == [(2, 1, 1, 0.5, 1.5, 2.75), (2, 9, 1, None, 1.5, 0.0), (3, 1, 0, 0.5, 2.5, 3.25), (3, None, 1, None, 2.5, 0.0)]
        assert "SortMergeJoin" not in plan and plan.count("Exchange hashpartitioning") == 6
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
