from pyspark.sql import functions as F

from pagemill.operators.order import numbered


def test_numbers_are_places_in_order(spark):
    df = spark.range(5000).select(((F.col("id") * 7919) % 5003).alias("a"), F.when(F.col("id") % 10 > 0, F.concat(F.lit("k"), (F.col("id") % 13).cast("string"))).alias("b"), F.lit("clash").alias("c")).repartition(7)
    for rows in (50_000, 100, 2):  # one range, fifty, and the most there can be
        got = numbered(df, "place", "b", -F.col("a"), range_rows=rows).collect()
        expected = sorted(got, key=lambda r: (r.b is not None, r.b or "", -r.a))
        assert [r.place for r in expected] == list(range(5000)) and got[0].asDict().keys() == {"a", "b", "c", "place"}


def test_few_rows_and_none(spark):
    assert [r.n for r in numbered(spark.createDataFrame([("x",)], "a string"), "n", "a").collect()] == [0]
    assert numbered(spark.createDataFrame([], "a string"), "n", "a").count() == 0
    same = numbered(spark.range(100).select(F.lit("x").alias("a"), "id"), "n", "a", "id", range_rows=7).collect()
    assert sorted((r.id, r.n) for r in same) == [(i, i) for i in range(100)]
