import pytest
from pyspark.sql import functions as F

from galeframe.operators.quantiles import exact_percentiles


@pytest.fixture
def groups(spark):
    """Six groups of 2,000 rows."""
    return spark.range(12_000).select((F.col("id") % 6).cast("int").alias("site"), (F.floor(F.col("id") / 6) * 0.5).alias("v"))


def test_rows_are_not_shuffled_by_their_group(spark, groups):
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = exact_percentiles(groups, ["site"], {"p": ("v", 0.9)})
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
        shuffled = exact_percentiles(groups, ["site"], {"p": ("v", 0.9)}, few_groups=False)
        assert sorted(found.collect()) == sorted(shuffled.collect()) == [(k, pytest.approx(899.55)) for k in range(6)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_between_equal_values_a_percentile_is_that_value(spark):
    rows = spark.createDataFrame([(29.27,)] * 14, "v double")
    assert exact_percentiles(rows, [], {"p": ("v", 0.9)}).first().p == 29.27
