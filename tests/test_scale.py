import pytest
from pyspark.sql import functions as F

from cellwarden import scale, session
from tests.conftest import rows


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_lookup_join_is_the_same_broadcast_and_salted(spark, how):
    facts = spark.range(400).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), (F.col("id") % 20).cast("string"))).alias("k"),
        "id",
    )
    table = spark.createDataFrame([("hot", 1), ("k1", 2), ("k1", 3), ("zzz", 4)], "k string, v int")
    small = scale.lookup_join(facts, table, ["k"], how)
    wide = scale.lookup_join(facts, table, ["k"], how, max_rows=0, salts=5)
    assert rows(small, *sorted(small.columns)) == rows(wide, *sorted(wide.columns))
    assert "BroadcastHashJoin" in small._jdf.queryExecution().executedPlan().toString()


def test_a_lookup_is_evaluated_once(spark):
    """Measured by the job that writes it: the join reads the written table, not the aggregate behind it."""
    facts = spark.range(100).select((F.col("id") % 7).alias("k"))
    table = spark.range(1000).groupBy((F.col("id") % 10).alias("k")).agg(F.sum("id").alias("s"))
    for bound in (1000, 0):
        joined = scale.lookup_join(facts, table, ["k"], max_rows=bound)
        assert joined.count() == 100 and joined.agg(F.sum("s")).first()[0] is not None
        plan = joined._jdf.queryExecution().optimizedPlan().toString()
        assert "sum(id" not in plan
    written, small = scale.measured(table, 10)
    assert small and written.count() == 10 and not scale.measured(table, 9)[1]
    assert scale.measured(table.where("false"), 0)[1]


def test_only_hot_keys_are_salted(spark):
    facts = spark.range(3000).select(
        "id", F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 3 == 1, None).otherwise(F.col("id").cast("string")).alias("k")
    )
    table = spark.createDataFrame([("hot", 1), ("5", 2), (None, 3)], "key string, v int")
    assert sorted(str(r[0]) for r in scale.hot_keys(facts, ["k"]).collect()) == ["None", "hot"]
    left, right = scale.salt_hot_keys(facts, table, [("k", "key")], 16)
    assert left.count() == 3000 and right.where("key = '5'").count() == 1
    assert right.where("key = 'hot'").count() == 16
    spread = left.groupBy("k").agg(F.countDistinct("_salt").alias("n"))
    assert {r.n for r in spread.where("k = 'hot' or k is null").collect()} == {16}
    assert spread.where("k <> 'hot'").agg(F.max("n")).first()[0] == 1


def test_global_rank_counts_all_rows_in_order(spark):
    df = spark.range(5000).select(F.lit(1).alias("tie"), F.expr("pmod(id * 7919, 5000)").alias("v"))
    ranked = scale.with_global_rank(df, [F.col("tie").asc(), F.col("v").desc()], "rank", partitions=7)
    assert ranked.where(F.col("rank") != 5000 - F.col("v")).count() == 0
    assert ranked.count() == 5000


def test_literal_rows_are_a_local_relation(spark):
    import pyarrow as pa

    df = scale.literal_rows(spark, [("a", 1.5), ("b", None)], pa.schema([("k", pa.string()), ("v", pa.float64())]))
    assert rows(df) == [("a", 1.5), ("b", None)]
    assert "LocalTableScan" in df._jdf.queryExecution().executedPlan().toString()


def test_scratch_is_below_the_shared_folder_and_new_each_time(spark):
    first, second = session.scratch_path(spark, "x"), session.scratch_path(spark, "x")
    assert first != second and first.startswith(session.shared_dir(spark).rstrip("/"))
