"""Exact removal of repeated byte strings by distributed prefix doubling.

A position's rank at length h is the name of its next h bytes; a rank pair
(rank at p, rank at p + h) names 2h bytes. Ranks that are unique are done with:
their positions repeat nothing. Spark groups and sorts (rank, position) rows at
length ``least`` / 2, then pairs at ``least``, where doubling stops, because all
strings of interest are ``least`` bytes.

The first level isn't taken over all positions but over anchors: of the ranks
that start in a string of ``least`` bytes and end in it, the smallest one's
position. Equal strings have the same anchor, so a string whose anchor's rank is
unique is unique. Neighbouring strings mostly share an anchor; such a run is one
row with a name of all its bytes, and of equal runs all but the earliest are
repeats as a whole. Only the earliest runs of anchors that occur in unequal runs
are expanded to pairs for each position, and only pairs that occur twice become rows.

Runs are equal if their anchors' ranks and their names are (128 bits), strings if two
fingerprints are that don't depend on each other (96 bits). Tasks combine what they have read before they
pass it on (of equal runs in a batch, the earliest goes on), so a string in a
third of all documents gives a row for each batch.

Defined cases: positions order by doc_id (null first), then start; rows that
repeat a doc_id take the same place, so that equal strings at equal starts don't remove
each other, and rows alike in doc_id and text keep the same bytes; a null text is empty; texts shorter than ``least`` bytes stay whole.
Extra columns are kept, names that clash with the added ones are replaced.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagemill.llm.blocks import BLOCK, OTHER_POWERS, POWERS, Block, mix, signed, spans_hash, text_blocks
from pagemill.llm.bloom import Bloom, Test, parted, shared_ids, text_of
from pagemill.llm.work import freed, removed, row_key, written

LEAST = 100
HELD = 1 << 19  # names that a task holds before it combines them
_PLACE = np.uint64((1 << 21) - 1)  # low bits of a rank that hold its position in a segment
_PAIR = np.uint64(0xC2B2AE3D27D4EB4F)


def ranks(data: np.ndarray, h: int) -> np.ndarray:
    """The name of data[i:i + h] for each i."""
    n = len(data)
    if n < h:
        return np.zeros(0, np.uint64)
    up, down = POWERS.get(n)
    total = np.zeros(n + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:n], out=total[1:])
        return mix((total[h:] - total[:-h]) * down[: n - h + 1])


def pairs(rank: np.ndarray, offset: int) -> np.ndarray:
    """Ranks of twice the length, from those at a position and at ``offset`` after it."""
    with np.errstate(over="ignore"):
        return mix(rank[:-offset] * _PAIR + rank[offset:])


class Runs(NamedTuple):
    """Runs of strings that share an anchor: strings start at p ... p + n - 1 in the block."""

    rank: np.ndarray
    p: np.ndarray
    n: np.ndarray
    doc: np.ndarray  # index in the block


def runs(block: Block, least: int = LEAST) -> Runs:
    h = least // 2
    width = least - h + 1  # ranks that start in a string
    data, bounds = block.data, block.bounds
    out = []
    for lo in range(0, max(len(data) - least + 1, 0), BLOCK):
        hi = min(lo + BLOCK, len(data) - least + 1)  # string starts lo ... hi - 1
        rank = ranks(data[lo : hi + least - 1], h)
        low = (rank & ~_PLACE) | np.arange(len(rank), dtype=np.uint64)
        size = 1
        while size * 2 <= width:
            low = np.minimum(low[:-size], low[size:])
            size *= 2
        if size < width:
            low = np.minimum(low[: len(low) - (width - size)], low[width - size :])
        anchor = (low & _PLACE).astype(np.int64)
        fits = np.zeros(hi - lo + 1, np.int32)  # strings that cross no document's end
        a, b = np.clip(bounds[:-1] - lo, 0, hi - lo), np.clip(bounds[1:] - least + 1 - lo, 0, hi - lo)
        ok = b > a
        np.add.at(fits, a[ok], 1)
        np.add.at(fits, b[ok], -1)
        fits = np.cumsum(fits[:-1]) > 0
        new = fits.copy()
        new[1:] &= (anchor[1:] != anchor[:-1]) | ~fits[:-1]
        new[a[ok]] = True  # documents may follow each other without a gap
        ends = fits.copy()
        ends[:-1] &= new[1:] | ~fits[1:]
        p, last = np.flatnonzero(new), np.flatnonzero(ends)
        out.append((rank[anchor[p]], p + lo, last - p + 1))
    rank, p, n = (np.concatenate(x) if out else np.zeros(0, t) for x, t in zip(list(zip(*out)) or [()] * 3, (np.uint64, np.int64, np.int64)))
    return Runs(rank, p, n, np.searchsorted(bounds, p, "right") - 1)


def _buckets(values: np.ndarray, buckets: int):
    by = (values % np.uint64(buckets)).astype(np.int64)
    turn = np.argsort(by, kind="stable")
    values, by = values[turn], by[turn]
    cut = np.flatnonzero(np.diff(by, prepend=-1))
    ends = np.append(cut[1:], len(by))
    return pa.RecordBatch.from_arrays([pa.array(by[cut], pa.int32()), pa.array([values[i:j].tobytes() for i, j in zip(cut, ends)], pa.binary())], ["bucket", "ranks"])


def twice_at_most(parts, buckets: int):
    """Names by bucket; of those that occur more often in a stretch of HELD, two go on."""
    held, size = [], 0
    for part in parts:
        held.append(part)
        size += len(part)
        if size > HELD:
            v, n = np.unique(np.concatenate(held), return_counts=True)
            yield _buckets(np.repeat(v, np.minimum(n, 2)), buckets)
            held, size = [], 0
    if size:
        v, n = np.unique(np.concatenate(held), return_counts=True)
        yield _buckets(np.repeat(v, np.minimum(n, 2)), buckets)


def repeated(key, table):
    v, n = np.unique(np.concatenate([np.frombuffer(x.as_py(), np.uint64) for x in table.column("ranks")]), return_counts=True)
    return pa.table({"rank": signed(v[n > 1])})


def repeated_ranks(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """Ranks of anchors that occur twice or more."""
    buckets = 4 * max(8, docs.rdd.getNumPartitions())

    def run(batches):
        ranks_of = (runs(block, least).rank for b in batches for block in text_blocks(b.column(0)))
        yield from twice_at_most(ranks_of, buckets)

    return written(docs.select("text").mapInArrow(run, "bucket int, ranks binary").groupBy("bucket").applyInArrow(repeated, "rank long"), "ranks")


def _ids(b: pa.RecordBatch, block: Block, shared: Test) -> tuple[np.ndarray, np.ndarray]:
    """Each document's place in the order, and its text's fingerprint, which keeps rows apart that share an id (0 where none does)."""
    ids, text = (b.column(c).slice(block.first, len(block.bounds) - 1).to_numpy() for c in (0, 1))
    return ids, text_of(shared, ids, text)


RUNS = "rank long, name long, doc long, text_id long, p int, n int, local boolean"


_NAMES = [x.split()[0] for x in RUNS.split(", ")]


def _earliest_first(parts, least: int):
    """Rows as RUNS: of equal names in a stretch of HELD / 4 rows the earliest place goes on, the bytes of the others are merged to local ranges."""
    held, size = [], 0
    for part in parts:
        held.append(part)
        size += len(part[0])
        if size > HELD // 4:
            yield from _split(held, least)
            held, size = [], 0
    if size:
        yield from _split(held, least)


def _split(held: list[tuple], least: int):

    def table(rank, name, doc, text, p, n, local):
        return pa.RecordBatch.from_arrays([signed(rank), signed(name), pa.array(doc), pa.array(text), pa.array(p, pa.int32()), pa.array(n, pa.int32()), pa.array(np.full(len(p), local))], _NAMES)

    rank, name, doc, text, p, n = (np.concatenate(x) for x in zip(*held))
    turn = np.lexsort((p, doc, name, rank))
    rank, name, doc, text, p, n = (x[turn] for x in (rank, name, doc, text, p, n))
    lead = np.ones(len(p), bool)
    lead[1:] = (rank[1:] != rank[:-1]) | (name[1:] != name[:-1])
    at = np.flatnonzero(lead)[np.cumsum(lead) - 1]
    earliest = (doc == doc[at]) & (p == p[at])
    yield table(*(x[earliest] for x in (rank, name, doc, text, p, n)), False)
    if not earliest.all():
        doc, text, p, n = (x[~earliest] for x in (doc, text, p, n))
        turn = np.lexsort((p, text, doc))
        doc, text, p, n = (x[turn] for x in (doc, text, p, n))
        cut = np.ones(len(p), bool)
        cut[1:] = (doc[1:] != doc[:-1]) | (text[1:] != text[:-1]) | (p[1:] > p[:-1] + n[:-1] + least - 1)
        first = np.flatnonzero(cut)
        end = np.maximum.reduceat(p + n + least - 1, first)
        none = np.zeros(len(first), np.uint64)
        yield table(none, none, doc[first], text[first], p[first], end - p[first], True)


def surviving_runs(docs: DataFrame, test, shared: Test, least: int = LEAST) -> DataFrame:
    """Runs whose anchor's rank passes ``test``; local: not the earliest of its name in its batch, then n is the bytes it covers."""

    def surviving(batches):
        for b in batches:
            for block in text_blocks(b.column(2)):
                r = runs(block, least)
                keep = np.flatnonzero(test(r.rank.view(np.int64)))
                if len(keep):
                    rank, p, n, doc = (x[keep] for x in r)
                    ids, text = _ids(b, block, shared)
                    yield rank, spans_hash(block.data, p, p + n + least - 1), ids[doc], text[doc], p - block.bounds[doc], n

    def run(batches):
        yield from _earliest_first(surviving(batches), least)

    return written(docs.mapInArrow(run, RUNS), "runs")


def _places(doc: np.ndarray, p: np.ndarray) -> np.ndarray:
    return (doc << 24) ^ p


def _open_strings(batches, in_doc, in_place, shared: Test, least: int):
    """For each block (name, doc, text_id, p, block, at) of the strings of the runs that pass, at being the start in the block; a run more does no harm."""
    h = least // 2
    for b in batches:
        b = b.filter(pa.array(in_doc(b.column(0).to_numpy())))
        for block in text_blocks(b.column(2)):
            r = runs(block, least)
            ids, text = _ids(b, block, shared)
            keep = np.flatnonzero(in_place(_places(ids[r.doc], r.p - block.bounds[r.doc])))
            if not len(keep):
                continue
            p, n, doc = r.p[keep], r.n[keep], r.doc[keep]
            every = np.repeat(p - (np.cumsum(n) - n), n) + np.arange(n.sum())
            doc = np.repeat(doc, n)
            names = np.empty(len(every), np.uint64)
            for lo in range(0, len(block.data), BLOCK):
                i, j = np.searchsorted(every, [lo, lo + BLOCK])
                if i < j:
                    names[i:j] = pairs(ranks(block.data[lo : lo + BLOCK + least], h), least - h)[every[i:j] - lo]
            yield names, ids[doc], text[doc], every - block.bounds[doc], block, every


def _keyed(docs: DataFrame) -> DataFrame:
    key = row_key()
    return docs.select(key["__doc"].alias("doc"), key["__text"].alias("text_id"), "text")


def repeats(docs: DataFrame, least: int = LEAST, shared: Test | None = None) -> DataFrame:
    """(doc, text_id, start, end): byte ranges, maybe overlapping, of all strings that also start earlier; text_id as by ``text_of``."""
    docs = _keyed(docs)
    shared = shared or shared_ids(docs)
    buckets = 4 * max(8, docs.rdd.getNumPartitions())
    anchors = repeated_ranks(docs, least)
    found = surviving_runs(docs, Bloom(anchors).test(), shared, least)
    removed(anchors)
    freed(docs.sparkSession)
    place = F.struct("doc", "p")

    def late(rows: DataFrame, first: DataFrame, by: list[str]) -> DataFrame:
        """Ranges of the rows that aren't the earliest of their name, and those that tasks have merged."""
        again = rows.filter("not local").join(first.filter("times > 1"), by).filter(place > F.col("first"))
        again = again.select("doc", "text_id", F.col("p").alias("start"), (F.col("p") + F.col("n") + (least - 1)).alias("end"))
        return again.union(rows.filter("local").select("doc", "text_id", F.col("p").alias("start"), (F.col("p") + F.col("n")).alias("end")))

    earliest = [F.min(place).alias("first"), F.count("*").alias("times")]
    first = written(found.filter("not local").groupBy("rank", "name").agg(*earliest), "first-runs")
    # Anchors of unequal runs: the pair at each position decides, of the earliest runs only.
    unequal = first.groupBy("rank").count().filter("count > 1").select("rank")
    place_key = F.shiftleft(F.col("first.doc"), 24).bitwiseXOR(F.col("first.p").cast("long"))
    open_runs = written(first.join(unequal, "rank", "left_semi").select(F.col("first.doc").alias("doc"), place_key.alias("place")), "open-runs")
    in_doc, in_place = Bloom(open_runs.select("doc")).test(), Bloom(open_runs.select("place")).test()

    def names(batches):
        yield from twice_at_most((x[0] for x in _open_strings(batches, in_doc, in_place, shared, least)), buckets)

    twice = written(docs.mapInArrow(names, "bucket int, ranks binary").groupBy("bucket").applyInArrow(repeated, "rank long"), "pairs")
    in_twice = Bloom(twice).test()
    removed(twice)
    freed(docs.sparkSession)

    def strings(batches):
        def kept():
            for name, doc, text, p, block, at in _open_strings(batches, in_doc, in_place, shared, least):
                k = np.flatnonzero(in_twice(name.view(np.int64)))
                other = spans_hash(block.data, at[k], at[k] + least, powers=OTHER_POWERS) >> np.uint64(32)
                yield other, name[k], doc[k], text[k], p[k], np.ones(len(k), np.int64)

        yield from _earliest_first(kept(), least)

    single = written(docs.mapInArrow(strings, RUNS), "strings")
    return late(found, first, ["rank", "name"]).union(late(single, single.filter("not local").groupBy("rank", "name").agg(*earliest), ["rank", "name"]))


def without_repeats(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """``docs`` with kept (binary: the remaining bytes), spans (array of maximal removed [start, end)), n_bytes and n_removed."""
    docs = docs.drop("kept", "spans", "n_bytes", "n_removed")
    shared = shared_ids(_keyed(docs))
    found = repeats(docs, least, shared).groupBy(F.col("doc").alias("__doc"), F.col("text_id").alias("__text")).agg(F.collect_set(F.struct("start", "end")).alias("__found"))  # at most a text's length
    found = written(found, "repeats")
    freed(docs.sparkSession)
    rest, some = parted(docs.withColumns(row_key()), Bloom(found.select(F.col("__doc").bitwiseXOR(F.col("__text")))).test(), shared)
    rest, found = rest.drop("__doc", "__text"), found.withColumnsRenamed({"__doc": "__of_doc", "__text": "__of_text"})
    n_bytes = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    span = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    rest = rest.withColumns({"kept": F.encode(F.coalesce("text", F.lit("")), "UTF-8"), "spans": F.array().cast(span), "n_bytes": n_bytes, "n_removed": F.lit(0).cast("long")})
    at = docs.columns.index("text")

    of_row = (F.col("__doc") == F.col("__of_doc")) & (F.col("__text") == F.col("__of_text"))
    some = some.join(found.hint("merge"), of_row, "left").select(*docs.columns, "__found")
    schema = T.StructType([*docs.schema.fields, T.StructField("kept", T.BinaryType()), T.StructField("spans", span), T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType())])

    def cut(batches):
        for b in batches:
            kept, spans, sizes, gone = [], [], [], []
            of = b.column(b.num_columns - 1)
            for block in text_blocks(b.column(at)):
                for i in range(len(block.bounds) - 1):
                    data = block.data[block.bounds[i] : block.bounds[i + 1]]
                    x = of[block.first + i].values
                    s, e = (np.zeros(0, np.int64) if x is None else x.field(n).to_numpy().astype(np.int64) for n in ("start", "end"))
                    cover = np.zeros(len(data) + 1, np.int64)
                    np.add.at(cover, s, 1)
                    np.add.at(cover, e, -1)
                    away = np.concatenate([[False], np.cumsum(cover[:-1]) > 0, [False]])
                    edge = np.flatnonzero(away[1:] != away[:-1])
                    kept.append(data[~away[1:-1]].tobytes())
                    spans.append([{"start": int(p), "end": int(q)} for p, q in zip(edge[::2], edge[1::2])])
                    sizes.append(len(data))
                    gone.append(int(away.sum()))
            extra = [pa.array(kept, pa.binary()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(sizes, pa.int64()), pa.array(gone, pa.int64())]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *extra], schema.fieldNames())

    return rest.unionByName(some.mapInArrow(cut, schema))
