"""Benchmark decontamination: size-partitioned MinHash containment search, verified exactly.

An item is the set of its distinct k-word shingles (fewer words: its whole word
sequence). Items are partitioned by the size of that set, by powers of two; each
partition keeps bottom MinHash sketches as long as its largest item needs: of
the u - ceil(t u) + 1 smallest hashes of an item at least one is in every
document that holds a share t of its shingles. So documents of any length are
probed with the sketches, without windows or loss.

One plan serves every size. A pass over the texts keeps the shingles that may be
an item's (a Bloom filter of bounded size thins them out, the joins below are exact);
a join with the sketches finds candidate pairs; only for these all of the item's
shingles in the document are counted.

Defined cases: an item without words matches nothing; an item of fewer than k
words matches where its word sequence stands in a document; null texts are
empty; items that repeat an item_id are one item each; a null doc_id or item_id
is kept as it is; different texts under one doc_id (or null) are documents of their
own, rows alike in both give one match; extra columns are ignored by ``matches``
and kept by ``decontaminated``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.blocks import distinct, mix, shingles, signed, text_blocks, words
from pagemill.llm.bloom import Bloom
from pagemill.llm.work import NO_ID, row_key, without, written

SHINGLES = "item long, item_id long, words int, size int, value long, sketch boolean"


def item_shingles(benchmark: DataFrame, k: int = 5, num: int = 8, den: int = 10) -> DataFrame:
    """Every item's distinct shingles; ``item`` numbers the items, ``words`` is the shingles' length, ``sketch`` marks the MinHash sketch."""
    names = [x.split()[0] for x in SHINGLES.split(", ")]

    def run(batches):
        for b in batches:
            for block in text_blocks(b.column(2)):
                w = words(block.data, block.bounds)
                for i in range(len(block.bounds) - 1):
                    h = w.hash[w.first[i] : w.first[i + 1]]
                    if not len(h):
                        continue
                    m = min(k, len(h))
                    values = np.unique(shingles(w._replace(hash=h, first=np.array([0, len(h)])), m)[0])
                    n = len(values)
                    widest = (1 << n.bit_length()) - 1  # the partition's largest size
                    keep = widest - -(-num * widest // den) + 1
                    low = np.zeros(n, bool)
                    low[np.argsort(mix(values))[:keep]] = True
                    at = block.first + i
                    same = [pa.array(np.full(n, x)) for x in (m, n)]
                    ids = pa.array([b.column(1)[at].as_py()] * n, pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array([b.column(0)[at].as_py()] * n, pa.int64()), ids, same[0].cast(pa.int32()), same[1].cast(pa.int32()), signed(values), pa.array(low)], names)

    numbered = benchmark.select(F.xxhash64("item_id", "text").alias("item"), F.col("item_id").cast("long").alias("item_id"), "text").dropDuplicates(["item_id", "text"])
    return written(numbered.mapInArrow(run, SHINGLES), "benchmark")


def _values(sizes: list[int], test):
    """(doc, text_id, words, value) of the distinct shingles that may be an item's."""
    names = ["doc", "text_id", "words", "value"]

    def run(batches):
        for b in batches:
            for block in text_blocks(b.column(2)):
                w = words(block.data, block.bounds)
                for m in sizes:
                    values, first = distinct(*shingles(w, m))
                    near = np.flatnonzero(test(values.view(np.int64)))
                    doc = np.searchsorted(first, near, "right") - 1
                    ok = np.diff(w.first)[doc] >= m  # a shorter document's only shingle isn't m words
                    near, doc = near[ok], pa.array(block.first + doc[ok])
                    yield pa.RecordBatch.from_arrays([b.column(0).take(doc), b.column(1).take(doc), pa.array(np.full(len(near), m), pa.int32()), signed(values[near])], names)

    return run


def matches(docs: DataFrame, benchmark: DataFrame, k: int = 5, num: int = 8, den: int = 10) -> DataFrame:
    """doc (NO_ID for a null doc_id), text_id, doc_id, item_id, n_found, n_item: documents with at least num / den of an item's shingles."""
    items = item_shingles(benchmark, k, num, den)
    sizes = sorted(r[0] for r in items.select("words").distinct().collect())  # 1 to k
    key = row_key()
    rows = docs.select(key["__doc"].alias("doc"), key["__text"].alias("text_id"), "text")
    found = written(rows.mapInArrow(_values(sizes, Bloom(items.select("value")).test()), "doc long, text_id long, words int, value long"), "item-values")
    sketches = items.filter("sketch").select("words", "value", "item")
    candidates = found.join(sketches, ["words", "value"]).select("doc", "text_id", "item").distinct()
    exact = found.join(items.drop("sketch"), ["words", "value"]).join(candidates, ["doc", "text_id", "item"])
    counted = exact.groupBy("doc", "text_id", "item", "item_id", "size").agg(F.count_distinct("value").cast("int").alias("n_found"))
    doc_id = F.when(F.col("doc") != NO_ID, F.col("doc")).alias("doc_id")
    return counted.filter(F.col("n_found") * den >= num * F.col("size")).select("doc", "text_id", doc_id, "item_id", "n_found", F.col("size").alias("n_item"))


def decontaminated(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """``docs`` without the documents that match an item; what shares a doc_id with one but has another text is judged by itself."""
    return without(docs, written(matches(docs, benchmark, **how).select("doc", "text_id").distinct(), "contaminated"))
