"""What filters remove in every order in which they could be applied.

Texts are scanned as Arrow buffers in blocks of whole documents: a table of byte classes
marks code points, capitals and symbols, whose prefix sums give a document's counts; runs of
word bytes give words. A document's word hashes are sorted; equal neighbours are compared byte by byte,
and a document in which equal hashes belong to different words is counted from the words themselves.
Spark then turns counts into a mask of failed filters a document, adds the mask's last bit (a copy of a text with a smaller doc_id)
from digests, and reduces the table to counts by part and mask. Everything about orders is computed from these
at most 32 counts a part.

Copies are combined before they meet: first the rows alike in text, part and doc_id, then all
of a text, part and label, of which only the smallest doc_id and its rows are kept.

Defined cases: a null text is an empty one (0 words, fails A only, and E behind a smaller doc_id);
a null part is the empty string; a row without a doc_id has no label, never fails E and fails no other row; rows
that share a doc_id are rows of their own, and those with the smallest doc_id of a text all pass E; of several
labels of a doc_id the larger value counts; empty tables give an empty result; extra columns are
ignored.
"""

from __future__ import annotations

import hashlib
from itertools import permutations
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill.llm.blocks import text_blocks, words
from pagemill.llm.work import bounded_batches

LETTERS = "ABCDE"
COMPARED = 1 << 20  # bytes of words that are compared at once
COUNTS = ("n_chars", "n_words", "n_distinct", "n_capitals", "n_symbols")

CLASSES = np.zeros((3, 256), bool)
CLASSES[0] = (np.arange(256) & 0xC0) != 0x80  # first bytes of code points
CLASSES[1, 65:91] = True


class Limits(NamedTuple):
    """A: fewer than ``words``; B: fewer distinct words than ``distinct`` percent; C: more capitals than ``capitals`` percent of the code points; D: any of ``symbols``."""

    words: int = 100
    distinct: int = 80
    capitals: int = 10
    symbols: str = "#$%&*|"


def _same(data: np.ndarray, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Whether the n bytes at a and at b are equal, for many pairs."""
    out = np.ones(len(n), bool)
    ends = np.cumsum(n)
    i = 0
    while i < len(n):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + COMPARED, "right")))
        k = n[i:j]
        first = np.cumsum(k) - k
        step = np.arange(int(k.sum())) - np.repeat(first, k)
        differ = data[np.repeat(a[i:j], k) + step] != data[np.repeat(b[i:j], k) + step]
        out[i:j] = ~np.logical_or.reduceat(differ, first)
        i = j
    return out


def distinct_words(data: np.ndarray, bounds: np.ndarray, hashes=None) -> tuple[np.ndarray, np.ndarray]:
    """Words and distinct words of each document of a block; ``hashes`` may replace the words' hashes."""
    w = words(data, bounds, lower=False)
    count = np.diff(w.first)
    doc = np.repeat(np.arange(len(count)), count)
    hash_ = w.hash if hashes is None else hashes(w)
    order = np.lexsort((hash_, doc)) if len(count) > 1 else np.argsort(hash_, kind="stable")
    a, b = order[:-1], order[1:]
    equal = (hash_[a] == hash_[b]) & (doc[a] == doc[b])
    a, b = a[equal], b[equal]
    size = w.end - w.start
    same = size[a] == size[b]
    same[same] = _same(data, w.start[a[same]], w.start[b[same]], size[a[same]])
    found = count - np.bincount(doc[b], minlength=len(count))
    for i in np.unique(doc[b[~same]]).tolist():  # hashes that collide
        text = data[bounds[i] : bounds[i + 1]].tobytes()
        found[i] = len({text[s:e] for s, e in zip((w.start[w.first[i] : w.first[i + 1]] - bounds[i]).tolist(), (w.end[w.first[i] : w.first[i + 1]] - bounds[i]).tolist())})
    return count, found


def _scan(symbols: str):
    classes = CLASSES.copy()
    classes[2, list(symbols.encode("ascii"))] = True

    def run(batches):
        for batch in batches:
            sums, digests = [], []
            for block in text_blocks(batch.column(0)):
                ends = block.bounds
                counts = []
                for c in classes:
                    total = np.concatenate([[0], np.cumsum(c[block.data], dtype=np.int64)])
                    counts.append(total[ends[1:]] - total[ends[:-1]])
                n, distinct = distinct_words(block.data, ends)
                sums.append(np.stack([counts[0], n, distinct, counts[1], counts[2]]))
                view = memoryview(np.ascontiguousarray(block.data))
                digests += [hashlib.sha256(view[a:b]).digest() for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
            made = np.concatenate(sums, axis=1) if sums else np.zeros((len(COUNTS), 0), np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *(pa.array(x) for x in made), pa.array(digests, pa.binary())], [*batch.schema.names[1:], *COUNTS, "digest"])

    return run


def measured(docs: DataFrame, part: str = "lang", limits: Limits = Limits()) -> DataFrame:
    """doc_id, part, COUNTS and the text's SHA-256 of every document."""
    bounded_batches(docs.sparkSession)
    rows = docs.select("text", F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"))
    return rows.mapInArrow(_scan(limits.symbols), "doc_id long, part string, " + ", ".join(f"{c} long" for c in COUNTS) + ", digest binary")


def _mask(conditions: list[Column]) -> Column:
    out = F.lit(0)
    for k, c in enumerate(conditions):
        out = out + F.when(c, 1 << k).otherwise(0)
    return out


def failures(docs: DataFrame, labels: DataFrame, part: str = "lang", limits: Limits = Limits()) -> DataFrame:
    """part, mask (bit k: fails the filter LETTERS[k]), n, good, toxic: counts of documents, of those labelled quality 1 and toxic 1."""
    col = F.col
    bits = _mask([col("n_words") < limits.words, 100 * col("n_distinct") < limits.distinct * col("n_words"), 100 * col("n_capitals") > limits.capitals * col("n_chars"), col("n_symbols") > 0])
    alike = measured(docs, part, limits).groupBy("digest", "part", bits.alias("bits"), "doc_id").agg(F.count("*").alias("n"))
    known = labels.filter("doc_id is not null").groupBy(col("doc_id").cast("long").alias("doc_id")).agg((F.max("quality") == 1).alias("good"), (F.max("toxic") == 1).alias("toxic"))
    # rows without an id are dealt out by their text, not by the null that they share
    salt = F.when(col("doc_id").isNull(), F.xxhash64("digest")).otherwise(F.lit(0).cast("long"))
    labelled = alike.withColumns({"__id": F.coalesce("doc_id", F.lit(0).cast("long")), "__salt": salt, "__none": col("doc_id").isNull()}).join(
        known.select(col("doc_id").alias("__id"), F.lit(0).cast("long").alias("__salt"), F.lit(False).alias("__none"), "good", "toxic"), ["__id", "__salt", "__none"], "left"
    )
    yes = lambda c: F.coalesce(col(c), F.lit(False)).alias(c)
    one = labelled.groupBy("digest", "part", "bits", yes("good"), yes("toxic")).agg(
        F.sum("n").alias("n"), F.sum(F.when(col("doc_id").isNull(), col("n")).otherwise(0)).alias("without_id"), F.min(F.when(col("doc_id").isNotNull(), F.struct("doc_id", "n"))).alias("least")
    )  # of a text: a row a part and label
    first = F.min("least.doc_id").over(Window.partitionBy("digest"))
    passing = col("without_id") + F.coalesce(F.when(col("least.doc_id") == first, col("least.n")), F.lit(0))
    split = one.withColumn("passing", passing).select("part", "good", "toxic", F.explode(F.array(F.struct(col("bits").alias("mask"), col("passing").alias("n")), F.struct((col("bits") + 16).alias("mask"), (col("n") - col("passing")).alias("n")))).alias("x"))
    return split.filter("x.n > 0").groupBy("part", "x.mask").agg(F.sum("x.n").alias("n"), *[F.sum(F.when(col(c), col("x.n")).otherwise(0)).alias(c) for c in ("good", "toxic")])


def _bits(letters: Column) -> Column:
    return _mask([F.instr(letters, x) > 0 for x in LETTERS])


def orders(counts: DataFrame) -> DataFrame:
    """For each part, order of all filters and step: documents kept, removed, redundant, unique_fails, good_lost, toxic_lost, and the filter's shapley sum, from the counts of :func:`failures`."""
    every = range(1 << len(LETTERS))
    table = counts.groupBy("part").agg(*[F.array(*[F.sum(F.when(F.col("mask") == k, F.col(c)).otherwise(0)) for k in every]).alias(c) for c in ("n", "good", "toxic")])
    names = ["".join(p) for p in permutations(LETTERS)]
    steps = table.withColumn("filter_order", F.explode(F.array(*map(F.lit, names)))).withColumn("step", F.explode(F.array(*[F.lit(k + 1) for k in range(len(LETTERS))])))
    steps = steps.withColumns({"before": _bits(F.substring("filter_order", F.lit(1), F.col("step") - 1)), "own": _bits(F.substring("filter_order", F.col("step"), F.lit(1)))})
    masks = F.array(*map(F.lit, every))
    before = lambda k: k.bitwiseAND(F.col("before")) != 0  # noqa: E731  whether an earlier filter removes documents of mask k
    own = lambda k: k.bitwiseAND(F.col("own")) != 0

    def total(c: str, fits, times=lambda k: F.lit(1).cast("long")) -> Column:
        return F.aggregate(F.filter(masks, fits), F.lit(0).cast("long"), lambda s, k: s + F.element_at(F.col(c), k + 1) * times(k))

    removed = lambda k: own(k) & ~before(k)
    return steps.select(
        "part", "filter_order", "step", total("n", lambda k: ~own(k) & ~before(k)).alias("kept"), total("n", removed).alias("removed"), total("n", lambda k: own(k) & before(k)).alias("redundant"),
        total("n", lambda k: k == F.col("own")).alias("unique_fails"), total("good", removed).alias("good_lost"), total("toxic", removed).alias("toxic_lost"),
        # of the filters that a document fails, each comes first in as many orders as any other
        total("n", own, lambda k: F.floor(F.lit(len(names)) / F.bit_count(k))).alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame, part: str = "lang", limits: Limits = Limits()) -> DataFrame:
    return orders(failures(docs, labels, part, limits))
