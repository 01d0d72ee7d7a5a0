"""Mixing sources to target weights along a curriculum, with DataFrame functions only.

Each source has a weight schedule, linear between its values at the begin and
the end of training; its mean is the source's weight. A source's demand is the
integral of its share; a copy of a document stands at the time when the demand
of its source reaches the middle of the words taken before and within it, and
documents are range-sorted by that position.

Word targets: the sources share ``total`` (by default all words) by weight; a
target stops at ``cap`` times the source's words, and the excess is shared by
weight among the others until none is above. A source then repeats: each
document floor(target / words) times, and once more those first in a hash order,
until the target is reached (whole documents: off by less than one document).

Defined cases: a null text has no words; a null source is a source of its own,
last in order; documents without words are taken 0 times and have no position;
repeated rows are mixed each by itself; an empty table gives an empty one.
The text is dropped, extra columns are kept, and names that clash with the added
ones are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill.llm.work import written

WORD = r"[^\x20\x09-\x0D]+"
LEVEL = 256  # buckets of a level of the prefix sums


def cyclic_weights(place: Column) -> Column:
    """1, 2, 3, repeating, by a source's place in order (from 0)."""
    return place % 3 + 1


def _in_order(sources: DataFrame) -> DataFrame:
    """Sources by code point, null last, with ``__place`` from 0: a range sort and the partitions' row counts, so no task holds all."""
    order = [F.col("source").isNull(), "source"]
    there = written(sources.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__id", F.monotonically_increasing_id()), "sources")
    part = F.shiftright("__id", 33)
    count = there.groupBy(part.alias("__part")).count().collect()  # a row a partition
    first, base = {}, 0
    for r in sorted(count):
        first[r[0]] = base
        base += r[1]
    known = F.create_map(*[F.lit(x) for pair in (first or {0: 0}).items() for x in pair])
    return there.withColumn("__place", known[part] + F.col("__id").bitwiseAND((1 << 33) - 1)).drop("__id")


def with_targets(sources: DataFrame, cap: float = 3.0, total: float | None = None) -> DataFrame:
    """``sources`` (words, weight) with ``target``: shares of ``total`` by weight, at most cap times the words each; the excess goes to those below, by weight.

    Rounds of one aggregate: those above their cap are filled, the rest share what is left, until none is above.
    """
    full_at, open_ = F.col("words") * cap, F.col("weight") > 0
    first = sources.agg(F.sum("words"), F.sum(F.when(open_, F.col("weight")))).first()
    left, spent, filled, whole = float(first[0] or 0 if total is None else total), 0.0, 0, first[1]
    while whole:
        share = F.lit(left - spent) * F.col("weight") / F.lit(float(whole))
        full = open_ & (share > full_at)
        n, words, rest = sources.agg(F.count_if(full), F.sum(F.when(full, full_at)), F.sum(F.when(open_ & ~full, F.col("weight")))).first()
        if n == filled:
            return sources.withColumn("target", F.when(full, full_at).when(open_, share).otherwise(0.0).cast("double"))
        filled, spent, whole = n, float(words), rest
    return sources.withColumn("target", F.when(open_, full_at).otherwise(0.0).cast("double"))


def _when_at(demand: Column, begin: Column, end: Column) -> Column:
    """The time t in [0, 1] at which the integral of begin + (end - begin) s over s in [0, t] is ``demand``."""
    slope = end - begin
    root = F.sqrt(F.greatest(begin * begin + 2 * slope * demand, F.lit(0.0)))
    return F.least(F.greatest(2 * demand / (begin + root), F.lit(0.0)), F.lit(1.0))


def plan(documents: DataFrame, weights=cyclic_weights, tilt: float = 0.5, cap: float = 3.0, total: float | None = None) -> DataFrame:
    """``documents`` with size, source_size, target, copies, taken and the positions of its copies (array<double>).

    weights: a function from a source's place in order (a column, from 0) to its mean weight. Schedules lean
    by ``tilt`` of the weight, alternate sources from early to late and from late to early. Sources stay a table, however many they are.
    """
    added = ["size", "source_size", "target", "copies", "taken", "positions"]
    docs = documents.drop(*added).withColumn("size", F.coalesce(F.regexp_count("text", F.lit(WORD)).cast("long"), F.lit(0).cast("long")))
    # Texts are read once; the order within a source is that of a hash of doc_id and text, so rows without an id are spread too.
    docs = written(docs.withColumn("__h3", F.xxhash64("doc_id", "text", F.lit(8))).drop("text"), "sizes")
    h = F.col("__h3")
    sources = _in_order(docs.groupBy("source").agg(F.sum("size").alias("words"))).withColumn("weight", weights(F.col("__place")))
    sources = with_targets(sources, cap, total)
    lean = F.when(F.col("__place") % 2 == 1, tilt).otherwise(-tilt)
    whole = F.when(F.col("words") > 0, F.floor(F.col("target") / F.col("words") + 1e-12)).otherwise(0).cast("long")
    sources = sources.select(F.col("source").alias("__name"), F.col("words").alias("source_size"), "target", whole.alias("__whole"), (1 - lean).alias("__begin"), (1 + lean).alias("__end"))
    keyed = docs.withColumn("__h1", F.pmod(h, F.lit(LEVEL))).withColumn("__h2", F.pmod(F.shiftright(h, 8), F.lit(LEVEL)))

    # Prefix sums of the words in hash order within each source, by two levels of buckets: no window holds a whole source.
    fine = keyed.groupBy("source", "__h1", "__h2").agg(F.sum("size").alias("__w"))
    coarse = fine.groupBy("source", "__h1").agg(F.sum("__w").alias("__w"))
    before = lambda *by: Window.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    coarse = coarse.select(F.col("source").alias("__s"), F.col("__h1").alias("__c1"), zero(F.sum("__w").over(before("source", "__h1"))).alias("__b1"))
    fine = fine.withColumn("__b2", zero(F.sum("__w").over(before("source", "__h1", "__h2"))))
    fine = fine.join(coarse, F.col("source").eqNullSafe(F.col("__s")) & (F.col("__h1") == F.col("__c1")))
    fine = fine.select(F.col("source").alias("__fs"), F.col("__h1").alias("__f1"), F.col("__h2").alias("__f2"), (F.col("__b1") + F.col("__b2")).alias("__base"))
    inner = Window.partitionBy("source", "__h1", "__h2").orderBy("__h3", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = keyed.withColumn("__in", zero(F.sum("size").over(inner)))
    placed = placed.join(fine, F.col("source").eqNullSafe(F.col("__fs")) & (F.col("__h1") == F.col("__f1")) & (F.col("__h2") == F.col("__f2"))).withColumn("__before", F.col("__in") + F.col("__base"))
    placed = placed.join(sources, F.col("source").eqNullSafe(F.col("__name")))  # Spark broadcasts the sources if they are small

    extra = F.col("target") - F.col("__whole") * F.col("source_size")  # words of the last, partial round
    more = (F.col("__before") + F.col("size") / 2 < extra) & (F.col("size") > 0)
    placed = placed.withColumn("copies", F.when(F.col("size") == 0, 0).otherwise(F.col("__whole") + F.when(more, 1).otherwise(0)).cast("int"))
    placed = placed.withColumn("taken", F.col("size") * F.col("copies"))
    share = lambda k: F.least((k * F.col("source_size") + F.col("__before") + F.col("size") / 2) / F.col("target"), F.lit(1.0))
    positions = F.when(F.col("copies") > 0, F.transform(F.sequence(F.lit(0), F.col("copies") - 1), lambda k: _when_at(share(k), F.col("__begin"), F.col("__end")))).otherwise(F.array().cast("array<double>"))
    return placed.withColumn("positions", positions).drop("__h1", "__h2", "__h3", "__in", "__base", "__before", "__fs", "__f1", "__f2", "__whole", "__begin", "__end", "__name")


def mix(documents: DataFrame, **how) -> DataFrame:
    """The training order: one row for each copy of a document, range-sorted by ``position``."""
    planned = plan(documents, **how)
    return planned.withColumn("position", F.explode("positions")).drop("positions").orderBy("position", "doc_id")


def in_order(documents: DataFrame, **how) -> DataFrame:
    """One row a document, range-sorted by its first position; documents that aren't taken come last."""
    planned = plan(documents, **how).withColumn("first_position", F.try_element_at("positions", F.lit(1)))
    return planned.orderBy(F.col("first_position").asc_nulls_last(), "doc_id")
