"""Line deduplication by an exact set-similarity join over all lines of all documents.

A line's tokens are its distinct k-word shingles (fewer words: the whole
sequence), ordered by rarity. A line is removed if it matches a line before it,
by doc_id, then line number: equal sets, or Jaccard similarity of at least
num / den. Lines are judged on the input, so a match counts even where the
earlier line is removed itself.

Defined cases: lines end at each newline; lines without words always stay; a
null text stays null; where all lines go, the text is empty; a null doc_id
comes before all others; different texts under one doc_id (or null) are
documents of their own, in the order of a fingerprint of the text; rows alike in
doc_id and text keep and lose the same lines and never remove each other's. Extra
columns are kept; names that clash with the added ones are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.setjoin import Spec, links, scan
from pagemill.llm.work import NO_ID, removed, row_key, written


def removed_lines(docs: DataFrame, k: int = 5, num: int = 8, den: int = 10) -> tuple[DataFrame, DataFrame]:
    """(doc, text_id, unit) of every line that goes, doc being doc_id or NO_ID for null; and all lines (doc, text_id, unit, node)."""
    spec = Spec(k, num, den, True, 1)
    rows, counts = scan(docs, spec)
    lines = rows.select(F.coalesce("doc_id", F.lit(NO_ID).cast("long")).alias("doc"), "text_id", "unit", "node", "n")
    place = F.struct("doc", "text_id", "unit")
    classes = lines.filter("node is not null").groupBy("node").agg(F.min(place).alias("home"), F.first("n").alias("n"), F.count("*").alias("copies"))
    classes = written(classes.select("node", "home.*", "n", "copies"), "line-classes")
    late = links(docs, spec, classes.drop("copies"), counts, later=True).select(F.col("a").alias("node")).distinct()
    repeats = classes.filter("copies > 1").select("node", F.struct("doc", "text_id", "unit").alias("home"))
    again = lines.join(repeats, "node").filter(place != F.col("home")).select("doc", "text_id", "unit")
    near = classes.join(late, "node", "left_semi").select("doc", "text_id", "unit")  # first of a set that comes after a similar one
    return again.union(near), lines.drop("n")


def deduplicated(docs: DataFrame, k: int = 5, num: int = 8, den: int = 10) -> DataFrame:
    """``docs`` with the kept text, n_lines and n_removed (both long)."""
    gone, _ = removed_lines(docs, k, num, den)
    units = F.sort_array(F.collect_list("unit"))  # at most a document's lines
    by_row = written(gone.distinct().groupBy(F.col("doc").alias("__of_doc"), F.col("text_id").alias("__of_text")).agg(units.alias("__gone")), "removed-lines")
    removed(gone)
    docs = docs.drop("n_lines", "n_removed")
    # The lines' marks, from the gaps between the removed ones, so that a line's mark is found by its number.
    before = F.concat(F.array(F.lit(-1)), F.slice("__gone", F.lit(1), F.size("__gone") - 1))
    by_row = by_row.withColumn("__marks", F.flatten(F.zip_with("__gone", before, lambda x, was: F.concat(F.array_repeat(F.lit(False), x - was - 1), F.array(F.lit(True))))))
    keyed = docs.withColumns(row_key())
    # Texts are streamed past a hash table of the removed lines, so that they aren't sorted.
    some = keyed.join(by_row.hint("shuffle_hash"), (F.col("__doc") == F.col("__of_doc")) & (F.col("__text") == F.col("__of_text")), "left")
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(F.length("text") - F.length(F.replace("text", F.lit("\n"))) + 1).cast("long")
    keep = F.array_join(F.filter(F.split("text", "\n", -1), lambda _, i: ~F.coalesce(F.get("__marks", i), F.lit(False))), "\n")
    some = some.withColumn("n_lines", n_lines).withColumn("text", F.when(F.col("__gone").isNull(), F.col("text")).otherwise(keep))
    return some.withColumn("n_removed", F.coalesce(F.array_size("__gone"), F.lit(0)).cast("long")).select(*docs.columns, "n_lines", "n_removed")
