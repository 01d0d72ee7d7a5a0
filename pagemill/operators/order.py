"""Numbering of rows in a total order without a task that holds all of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

RANGE_ROWS, MOST_RANGES = 50_000, 1024  # rows of a range, roughly; of more rows than both allow, ranges have more
LOOKED_AT = 4  # rows of the sample for each bound there can be; neither these nor the ranges change a result


def numbered(df: DataFrame, number: str, *order: Column | str, range_rows: int = RANGE_ROWS) -> DataFrame:
    """``df`` with the rows' places from 0: ranges between bounds from a sample, as many as the rows ask for, places within each, and the ranges' counts added up.

    Rows equal in ``order`` are numbered in any order, so it should tell all rows apart. The bounds are literals, found by
    halving, so a row's range is the same however often the plan runs.
    """
    ks = [f"__k{i}" for i in range(len(order))]
    keyed = df.withColumns({k: F.col(c) if isinstance(c, str) else c for k, c in zip(ks, order)})
    seen = Observation()  # the rows are counted as the sample is taken
    sample = keyed.select(*ks).observe(seen, F.count(F.lit(1)).alias("rows")).orderBy(F.xxhash64(*ks), *ks).limit(LOOKED_AT * MOST_RANGES).collect()
    sample = sample and keyed.sparkSession.createDataFrame(sample, keyed.select(*ks).schema).orderBy(*ks).collect()
    ranges = min(MOST_RANGES, -(-seen.get["rows"] // range_rows))
    bounds = [sample[len(sample) * i // ranges] for i in range(1, ranges)]
    types = keyed.select(*ks).schema
    key = F.struct(*ks)
    literal = lambda row: F.struct(*[F.lit(row[k]).cast(types[k].dataType).alias(k) for k in ks])

    def place(first: int, last: int) -> Column:
        """Of a key behind bounds[:first] and not behind bounds[last]: how many bounds it is behind."""
        if first == last:
            return F.lit(first)
        middle = (first + last) // 2
        return F.when(key > literal(bounds[middle]), place(middle + 1, last)).otherwise(place(first, middle))

    dealt = keyed.withColumn("__range", place(0, len(bounds)))
    counts = dict(dealt.groupBy("__range").count().collect())  # a row a range
    before = F.array(*[F.lit(sum(n for r, n in counts.items() if r < i)).cast("long") for i in range(len(bounds) + 1)])
    own = F.row_number().over(Window.partitionBy("__range").orderBy(*ks)) - 1
    return dealt.withColumn(number, (F.get(before, F.col("__range")) + own).cast("int")).drop("__range", *ks)
