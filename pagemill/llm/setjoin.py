"""Exact set-similarity self-join of documents or lines, by prefix filters under global token orders.

A unit (document or line) is the set of its distinct k-word shingles. Two units
link if the Jaccard similarity of their sets is at least num / den. Equal sets
are one node, known by a 64-bit fingerprint, so that copies aren't multiplied.

1. ``scan`` reads all texts once: a row for each unit and, for tokens seen
   twice or more in a task, counts that make up the order of tokens. A document's
   row has a sketch of its set: the parity of the number of tokens in each of n to 2 n cells.
2. ``candidates``: a token order puts common tokens last and the rest by hash. A
   linking pair shares a token among each one's first n - ceil(t n) + 1. Executors
   group packed (token, node) records by bucket and drop tokens of one node;
   small groups give pairs, thinned by length and position; large groups give
   only their members, so no group is expanded. With several orders, a pair must
   be found under each. With ``apart``, tokens of one node alone, as far as the half of all tokens that is looked
   through beforehand tells, come first in every order and aren't sent: prefixes of unlike documents are made of them, however
   large the table, while tokens that are rare, but not alone, make the more pairs the larger it is. Sketches differ in no more cells than sets do in tokens, so pairs
   of documents whose sketches differ in more than a link allows go: else chance pairs,
   which are the more the larger the table, would connect unlike documents to one cluster.
3. The candidates' connected clusters are cut into blocks; each two
   blocks of a cluster meet in one task. Blocks have BLOCK_NODES nodes, but a cluster has no more than
   MEETINGS blocks unless they would hold more than BLOCK_TOKENS tokens, since a text is sent once for each. There, too, two nodes are compared only if they
   share a prefix token under every order; what is left gets an exact overlap.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.blocks import Block, distinct, mix, shingles, signed, text_blocks, words
from pagemill.llm.bloom import Bloom, Test, bit_places
from pagemill.llm.components import components
from pagemill.llm.repeats import repeated, twice_at_most
from pagemill.llm.work import NO_ID, freed, removed, row_key, written

SMALL_GROUP = 32
SEEN_BITS = 1 << 26
BLOCK_NODES = 256
MEETINGS = 6
BLOCK_TOKENS = 1 << 20
LEAST_BITS = 64  # cells of a sketch at least
GROUP_NODES = 1024
FEW = 8  # sets that are compared one by one
LEVELS = 1 << 24  # bytes at most of the table of token counts, of which half is filled at most, by the most frequent tokens; it only affects cost
_PART = 1 << 13
APART_BITS = 1 << 29  # of the filter of tokens that several nodes hold, at most: 64 MB
HOT = 17  # as a power of two: tokens counted more often are dealt out by node
FLUSH = 1 << 18  # records held before they are passed on
RECORD = np.dtype([("token", "<u8"), ("node", "<u8"), ("n", "<u4"), ("at", "<u4")])


class Spec(NamedTuple):
    k: int = 5
    num: int = 8
    den: int = 10
    lines: bool = False
    orders: int = 1
    apart: bool = False


class Units(NamedTuple):
    doc: np.ndarray  # index of its document in the batch
    no: np.ndarray  # line number, from 0
    values: np.ndarray  # distinct tokens of unit i are values[first[i]:first[i + 1]], ascending
    first: np.ndarray
    node: np.ndarray
    start: np.ndarray  # unit i is data[start[i]:start[i + 1]] of the block, with the line's end


def units(block: Block, spec: Spec) -> Units:
    bounds, docs = block.bounds, len(block.bounds) - 1
    doc, no = np.arange(docs), np.zeros(docs, np.int64)
    if spec.lines:
        breaks = np.flatnonzero(block.data == 10)
        count = 1 + np.diff(np.searchsorted(breaks, bounds))
        doc = np.repeat(doc, count)
        no = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
        bounds = np.append(np.sort(np.concatenate([bounds[:-1], breaks + 1])), bounds[-1])
    values, first = distinct(*shingles(words(block.data, bounds), spec.k))
    return Units(doc + block.first, no, values, first, set_hash(values, first), bounds)


def set_hash(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A fingerprint of each set that doesn't depend on order."""
    with np.errstate(over="ignore"):
        total = np.concatenate([[np.uint64(0)], np.cumsum(mix(values), dtype=np.uint64)])
        return mix(total[first[1:]] - total[first[:-1]] + np.diff(first).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def sketches(values: np.ndarray, first: np.ndarray) -> pa.Array:
    """Of each set, cells (a power of two) that hold the parity of how many of its tokens fall into each."""
    n = np.diff(first)
    cells = np.maximum(LEAST_BITS, 1 << np.ceil(np.log2(np.maximum(n, 1))).astype(np.int64))
    at = np.concatenate([[0], np.cumsum(cells)])
    within = (mix(values ^ np.uint64(0xD1B54A32D192ED03)) & (np.repeat(cells, n) - 1).astype(np.uint64)).astype(np.int64)
    odd = np.bincount(np.repeat(at[:-1], n) + within, minlength=at[-1]) & 1
    return pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer((at // 8).astype(np.int32)), pa.py_buffer(np.packbits(odd.astype(bool)))])


def differing(a: pa.Array, b: pa.Array) -> np.ndarray:
    """In how many cells two sketches differ, the longer one folded to the shorter one's length; sets differ in as many tokens at least."""
    out = np.zeros(len(a), np.int64)
    sizes = np.stack([pc.binary_length(x).to_numpy() for x in (a, b)]).astype(np.int64)
    for m, n in np.unique(sizes, axis=1).T.tolist():
        i = np.flatnonzero((sizes[0] == m) & (sizes[1] == n))
        x, y = (np.frombuffer(b"".join(c.take(pa.array(i)).to_pylist()), np.uint8).reshape(len(i), -1, min(m, n)) for c in (a, b))
        out[i] = np.bitwise_count(np.bitwise_xor.reduce(x, axis=1) ^ np.bitwise_xor.reduce(y, axis=1)).sum(axis=1, dtype=np.int64)
    return out


def scan(docs: DataFrame, spec: Spec) -> tuple[DataFrame, DataFrame]:
    """Units (doc_id, text_id, unit, n, node, sketch; node null where n is 0, sketch null for lines) and token counts (token, seen)."""
    schema = "doc_id long, text_id long, unit int, n int, node long, sketch binary, token long, seen long"
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches):
        seen = np.zeros(SEEN_BITS // 8, np.uint8)  # a Bloom filter of the task's tokens so far
        held, size = [], 0

        def counts():
            v, n = np.unique(np.concatenate(held), return_counts=True)
            places = bit_places(v.view(np.int64), SEEN_BITS)
            before = np.ones(len(v), bool)
            for at in places:
                before &= (seen[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
            for at in places:
                np.bitwise_or.at(seen, at >> 3, np.left_shift(1, at & 7).astype(np.uint8))
            n = n + before
            v, n = v[n > 1], n[n > 1]
            none = pa.nulls(len(v))
            return pa.RecordBatch.from_arrays([*(none.cast(t) for t in (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary())), signed(v), pa.array(n)], names)

        for b in batches:
            for block in text_blocks(b.column(2)):
                u = units(block, spec)
                n, none = np.diff(u.first), pa.nulls(len(u.node), pa.int64())
                node, doc = pa.array(u.node.view(np.int64), mask=n == 0), pa.array(u.doc)
                sketch = pa.nulls(len(u.node), pa.binary()) if spec.lines else sketches(u.values, u.first)
                yield pa.RecordBatch.from_arrays([b.column(0).take(doc), b.column(1).take(doc), pa.array(u.no, pa.int32()), pa.array(n, pa.int32()), node, sketch, none, none], names)
                held.append(u.values)
                size += len(u.values)
                if size > 2 * FLUSH:
                    yield counts()
                    held, size = [], 0
        if size:
            yield counts()

    rows = written(docs.select(F.col("doc_id").cast("long"), row_key()["__text"], "text").mapInArrow(run, schema), "units")
    return rows.filter("token is null").drop("token", "seen"), rows.filter("token is not null").select("token", "seen")


def _levels(key, table):
    out = np.zeros(_PART, np.uint8)
    at = (table.column("token").to_numpy().view(np.uint64) & np.uint64(_PART - 1)).astype(np.int64)
    np.maximum.at(out, at, np.log2(table.column("seen").to_numpy()).astype(np.uint8))
    return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "levels": pa.array([out.tobytes()], pa.binary())})


def token_levels(counts: DataFrame):
    """A broadcast table: for the low bits of a token, the power of two of how often it was counted; 0 for others."""
    counts = counts.groupBy("token").agg(F.sum("seen").alias("seen"))
    by_level = sorted(((r[0], r[1]) for r in counts.groupBy(F.log2("seen").cast("int")).count().collect()), reverse=True)  # at most 64 rows
    least, held = 64, 0
    for level, n in by_level:  # whole levels from the top, as long as the table stays thinly filled
        if held and held + n > LEVELS // 2:
            break
        least, held = level, held + n
    size = min(LEVELS, max(_PART, 1 << (4 * held).bit_length()))
    part = F.shiftright("token", _PART.bit_length() - 1).bitwiseAND(size // _PART - 1).cast("int").alias("part")
    rows = counts.filter(F.log2("seen") >= least).select("token", "seen", part).groupBy("part").applyInArrow(_levels, "part int, levels binary").collect()
    out = np.zeros(size, np.uint8)
    for r in rows:  # at most LEVELS / _PART rows
        out[r["part"] * _PART : (r["part"] + 1) * _PART] = np.frombuffer(r["levels"], np.uint8)
    return counts.sparkSession.sparkContext.broadcast(out.tobytes())


def ordered(values: np.ndarray, first: np.ndarray, levels: np.ndarray, order: int, alone: np.ndarray | None = None) -> np.ndarray:
    """Each unit's tokens as keys of the order, ascending: by count level (the top 6 bits: 0 for tokens that are ``alone``, else from 1), then by hash."""
    with np.errstate(over="ignore"):
        key = mix(values + np.uint64((order + 1) * 0xA24BAED4963EE407 & (1 << 64) - 1)) >> np.uint64(6)
    level = levels[(values & np.uint64(len(levels) - 1)).astype(np.int64)].astype(np.uint64) + np.uint64(1)
    key |= (level if alone is None else np.where(alone, np.uint64(0), level)) << np.uint64(58)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        key[a:b].sort()
    return key


class Fresh:
    """Of the units of a block those that have tokens and whose set isn't among the latest ones: a copy adds nothing."""

    def __init__(self) -> None:
        self.seen: set[int] = set()

    def __call__(self, u: Units) -> np.ndarray:
        _, once = np.unique(u.node, return_index=True)
        once = np.sort(once[np.diff(u.first)[once] > 0])
        fresh = u.node[once].tolist()
        once = once[[x not in self.seen for x in fresh]] if fresh else once
        self.seen.update(fresh)
        if len(self.seen) > 2 * FLUSH:
            self.seen.clear()
        return once


def _looked_through(values: np.ndarray) -> np.ndarray:
    """The half of all tokens of which it is known whether several nodes hold them."""
    return values >> np.uint64(63) == 1


def shared_tokens(docs: DataFrame, spec: Spec, buckets: int) -> Test:
    """A test for the tokens, of those looked through, that two nodes or more hold; it passes some others."""

    def run(batches):
        def of_blocks():
            fresh = Fresh()
            for b in batches:
                for block in text_blocks(b.column(0)):
                    u = units(block, spec)
                    own = np.zeros(len(u.node), bool)
                    own[fresh(u)] = True
                    yield u.values[np.repeat(own, np.diff(u.first)) & _looked_through(u.values)]

        yield from twice_at_most(of_blocks(), buckets)

    twice = written(docs.select("text").mapInArrow(run, "bucket int, ranks binary").groupBy("bucket").applyInArrow(repeated, "rank long"), "shared-tokens")
    freed(docs.sparkSession)
    shared = Bloom(twice, APART_BITS).test()
    removed(twice)
    freed(docs.sparkSession)
    return shared


def packed(docs: DataFrame, spec: Spec, levels, buckets: int, shared: Test | None = None) -> DataFrame:
    """Prefix records by order and bucket; with ``shared`` without those of tokens that one node alone holds. Hot tokens are dealt out by node, since their groups aren't looked at as a whole."""

    def run(batches):
        table = np.frombuffer(levels.value, np.uint8)
        fresh = Fresh()
        held = {o: [] for o in range(spec.orders)}
        size = 0

        def flush():
            for o, parts in held.items():
                r = np.concatenate(parts)
                by = np.where(r["token"] >> np.uint64(58) > HOT, buckets + r["node"] % np.uint64(buckets), r["token"] % np.uint64(buckets)).astype(np.int64)
                turn = np.argsort(by.astype(np.uint16) if 2 * buckets < 1 << 16 else by, kind="stable")
                r, by = r[turn], by[turn]
                cut = np.flatnonzero(np.diff(by, prepend=-1))
                ends = np.append(cut[1:], len(by))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(cut), o), pa.int32()), pa.array(by[cut], pa.int32()), pa.array([r[i:j].tobytes() for i, j in zip(cut, ends)], pa.binary())], ["ord", "bucket", "records"]
                )
                parts.clear()

        for b in batches:
            for block in text_blocks(b.column(0)):
                u = units(block, spec)
                n = np.diff(u.first)
                once = fresh(u)
                if not len(once):
                    continue
                alone = None
                if shared is not None:
                    alone = _looked_through(u.values)
                    alone[alone] = ~shared(u.values[alone].view(np.int64))
                take = n[once] - -(-spec.num * n[once] // spec.den) + 1
                start = u.first[once]
                within = np.arange(take.sum()) - np.repeat(np.cumsum(take) - take, take)
                for o in range(spec.orders):
                    key = ordered(u.values, u.first, table, o, alone)
                    r = np.empty(len(within), RECORD)
                    r["token"] = key[np.repeat(start, take) + within]
                    r["node"], r["n"], r["at"] = np.repeat(u.node[once], take), np.repeat(n[once], take), within
                    held[o].append(r if alone is None else r[r["token"] >> np.uint64(58) > 0])
                size += len(held[0][-1])
                if size > FLUSH:
                    yield from flush()
                    size = 0
        if size:
            yield from flush()

    return docs.select("text").mapInArrow(run, "ord int, bucket int, records binary")


def _grouped(spec: Spec, buckets: int):
    def run(key, table):
        r = np.concatenate([np.frombuffer(x.as_py(), RECORD) for x in table.column("records")])
        r = r[np.lexsort((r["node"], r["token"]))]
        new = np.ones(len(r), bool)
        new[1:] = (r["token"][1:] != r["token"][:-1]) | (r["node"][1:] != r["node"][:-1])
        r = r[new]
        cut = np.flatnonzero(np.concatenate([[True], r["token"][1:] != r["token"][:-1]]))
        size = np.diff(np.append(cut, len(r)))
        group, size = np.repeat(np.arange(len(cut)), size), np.repeat(size, size)
        large = np.full(len(r), True) if key[1].as_py() >= buckets else size > SMALL_GROUP
        few = np.flatnonzero(~large & (size > 1))
        s, g = r[few], group[few]
        n, at = s["n"].astype(np.int64), s["at"].astype(np.int64)
        found = [np.zeros((0, 2), np.uint64)]
        for d in range(1, min(SMALL_GROUP, len(s))):
            i = np.flatnonzero(g[d:] == g[:-d])
            j = i + d
            most = np.minimum(at[i], at[j]) + 1 + np.minimum(n[i] - at[i], n[j] - at[j]) - 1
            ok = (np.minimum(n[i], n[j]) * spec.den >= spec.num * np.maximum(n[i], n[j])) & (most * (spec.den + spec.num) >= spec.num * (n[i] + n[j]))
            found.append(np.stack([s["node"][i[ok]], s["node"][j[ok]]], axis=1))
        pairs = np.unique(np.concatenate(found), axis=0)
        members = r[large]
        return pa.table({
            "ord": pa.array(np.full(len(pairs) + len(members), key[0].as_py()), pa.int32()),
            "a": signed(np.concatenate([pairs[:, 0], members["node"]])),
            "b": signed(np.concatenate([pairs[:, 1], members["token"]])),
            "large": pa.array(np.arange(len(pairs) + len(members)) >= len(pairs)),
        })

    return run


def buckets_of(docs: DataFrame) -> int:
    """Groups that work is dealt to, several a task."""
    return 4 * max(8, docs.rdd.getNumPartitions())


def alike(pairs: DataFrame, units: DataFrame, spec: Spec) -> DataFrame:
    """The pairs of nodes (a, b) but those that surely don't link, since their sketches differ in more cells than the sets of a link do in tokens."""
    pairs = written(pairs, "pairs")
    asked = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    of_node = written(units.select("node", "n", "sketch").join(asked, "node", "left_semi").dropDuplicates(["node"]), "sketches")

    def run(batches):
        for b in batches:
            n = b.column(2).to_numpy().astype(np.int64) + b.column(4).to_numpy()
            ok = differing(b.column(3), b.column(5)) * (spec.den + spec.num) <= n * (spec.den - spec.num)
            yield b.select([0, 1]).filter(pa.array(ok))

    both = pairs.join(of_node.toDF("a", "n_a", "sketch_a"), "a").join(of_node.toDF("b", "n_b", "sketch_b"), "b")
    out = written(both.select("a", "b", "n_a", "sketch_a", "n_b", "sketch_b").mapInArrow(run, "a long, b long"), "alike")
    removed(pairs)
    removed(of_node)
    return out


def candidates(docs: DataFrame, spec: Spec, levels, units: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Edges (a, b) whose connected clusters hold every pair of nodes that links; and the table that they are made from. With ``units`` (of documents, as by ``scan``), pairs are held against sketches."""
    buckets = buckets_of(docs)
    shared = shared_tokens(docs, spec, buckets) if spec.apart else None
    found = packed(docs, spec, levels, buckets, shared).groupBy("ord", "bucket").applyInArrow(_grouped(spec, buckets), "ord int, a long, b long, large boolean")
    found = written(found, "candidates")
    freed(docs.sparkSession)  # the records
    pairs = lambda o: found.filter((F.col("ord") == o) & ~F.col("large")).select("a", "b").distinct()
    kept = pairs(0)
    for o in range(1, spec.orders):
        # A pair may also meet in a large group of the other order, whose members aren't paired.
        free = found.filter((F.col("ord") == o) & F.col("large")).select(F.col("a").alias("node")).distinct()
        both = kept.join(free.withColumnRenamed("node", "a"), "a", "left_semi").join(free.withColumnRenamed("node", "b"), "b", "left_semi").select("a", "b")
        kept = kept.join(pairs(o), ["a", "b"], "left_semi").union(both).distinct()
    crowd = found.filter((F.col("ord") == 0) & F.col("large")).select("a", "b")
    for o in range(1, spec.orders):
        rows = found.filter(F.col("ord") == o)
        there = rows.select("a").union(rows.filter("not large").select("b")).distinct()
        crowd = crowd.join(there, "a", "left_semi")
    star = crowd.join(crowd.groupBy("b").agg(F.min("a").alias("least")), "b").select("a", F.col("least").alias("b"))
    return (kept if units is None else alike(kept, units, spec)).union(star).distinct(), found


def _texts(spec: Spec, in_row, in_node):
    """(node, doc, text_id, unit, text) of the units that pass; text is shipped since it packs better than its set."""

    def run(batches):
        seen = set()  # latest units: a row that is repeated adds nothing
        for b in batches:
            b = b.filter(pa.array(in_row(b.column(0).to_numpy() ^ b.column(1).to_numpy())))
            rows = b.column(0).to_numpy() ^ b.column(1).to_numpy()
            for block in text_blocks(b.column(2)):
                u = units(block, spec)
                hit = np.flatnonzero(in_node(u.node.view(np.int64)) & (np.diff(u.first) > 0))
                marks = mix(u.node[hit] ^ rows[u.doc[hit]].view(np.uint64)).tolist()
                hit = hit[[not (x in seen or seen.add(x)) for x in zip(marks, u.no[hit].tolist())]] if len(hit) else hit
                if len(seen) > 2 * FLUSH:
                    seen.clear()
                if len(hit):
                    text = pa.array([block.data[u.start[i] : u.start[i + 1]].tobytes() for i in hit], pa.binary())
                    doc = pa.array(u.doc[hit])
                    yield pa.RecordBatch.from_arrays([signed(u.node[hit]), b.column(0).take(doc), b.column(1).take(doc), pa.array(u.no[hit], pa.int32()), text], ["node", "doc", "text_id", "unit", "text"])

    return run


class Against:
    """Sizes of intersections with each of several sets."""

    def __init__(self, sets: list[np.ndarray]) -> None:
        self.owner, self.count = np.repeat(np.arange(len(sets)), [len(x) for x in sets]), len(sets)
        self.table, self.code = np.unique(np.concatenate(sets), return_inverse=True)
        self.flag = np.zeros(len(self.table), bool)

    def __call__(self, one: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.table, one), len(self.table) - 1)
        at = at[self.table[at] == one]
        self.flag[at] = True
        out = np.bincount(self.owner[self.flag[self.code]], minlength=self.count)
        self.flag[at] = False
        return out


def _common(a: np.ndarray, b: np.ndarray) -> int:
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    return int((b[at] == a).sum())


def _verify(spec: Spec, later: bool, levels):
    """Of a table of cluster blocks that meet (root, p, q), the links, or the nodes that link to an earlier one."""

    def meet(block, p, q, tokens, prefixes, n, place, node):
        left, right = np.flatnonzero(block == p), np.flatnonzero(block == q)
        up = list(range(len(node)))
        gone = np.zeros(len(node), bool)

        def top(x):
            while up[x] != x:
                up[x] = up[up[x]]
                x = up[x]
            return x

        filters = [Against([prefix[j] for j in right]) for prefix in prefixes] if len(left) and len(right) else []
        whole = None
        for i in left if filters else ():
            # The filters of length and of all orders are intersected before overlaps are counted.
            may = (np.minimum(n[i], n[right]) * spec.den >= spec.num * np.maximum(n[i], n[right])) & (right != i)
            for against, prefix in zip(filters, prefixes):
                may &= against(prefix[i]) > 0
            js = right[may]
            if len(js) > FEW:
                whole = whole or Against([tokens[j] for j in right])
                common = whole(tokens[i])[may]
            else:
                common = np.array([_common(tokens[i], tokens[j]) for j in js], np.int64)
            hits = js[common * (spec.den + spec.num) >= spec.num * (n[i] + n[js])]
            if later:
                gone[hits[place[hits] > place[i]]] = True
                gone[i] |= bool((place[hits] < place[i]).any())
            else:
                for j in hits:
                    if top(i) != top(j):
                        up[top(i)] = top(j)
                        yield node[i], node[j]
        if later:
            yield from ((x, x) for x in node[gone])

    def run(key, table):
        names = ["root", "p", "q", "block", "node", "unit", "doc", "text_id"]
        cols = {n: table.column(n).to_numpy() for n in names}
        order = np.lexsort((cols["unit"], cols["text_id"], cols["doc"], cols["node"], cols["q"], cols["p"], cols["root"]))
        cols = {n: c[order] for n, c in cols.items()}
        same = lambda *of: np.concatenate([[False], np.all([cols[n][1:] == cols[n][:-1] for n in of], axis=0)])
        once = np.flatnonzero(~same("root", "p", "q", "node"))  # repeated rows give a text twice
        cols = {n: c[once] for n, c in cols.items()}
        texts = [table.column("text")[int(i)].as_py() for i in order[once]]
        bounds = np.concatenate([[0], np.cumsum([len(x) for x in texts])]).astype(np.int64)
        values, first = distinct(*shingles(words(np.frombuffer(b"".join(texts), np.uint8), bounds), spec.k))
        n = np.diff(first)
        take = n - -(-spec.num * n // spec.den) + 1
        keys = [ordered(values, first, np.frombuffer(levels.value, np.uint8), o) for o in range(spec.orders)]
        place = np.argsort(np.lexsort((cols["node"], cols["unit"], cols["text_id"], cols["doc"])))
        starts = np.append(np.flatnonzero(~same("root", "p", "q")), len(once))
        out = []
        for a, b in zip(starts[:-1], starts[1:]):
            tokens = [values[first[i] : first[i + 1]] for i in range(a, b)]
            prefixes = [[key[first[i] : first[i] + take[i]] for i in range(a, b)] for key in keys]
            out += meet(cols["block"][a:b], cols["p"][a], cols["q"][a], tokens, prefixes, n[a:b], place[a:b], cols["node"][a:b])
        return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())})

    return run


def links(docs: DataFrame, spec: Spec, classes: DataFrame, counts: DataFrame, later: bool = False, units: DataFrame | None = None) -> DataFrame:
    """Of the join's pairs, enough to connect every component: (a, b), nodes; with ``later`` the nodes that link to an earlier one, as a.

    classes: node, doc, text_id, unit and n of each node's first unit (doc NO_ID for a null doc_id); the order of nodes is theirs.
    """
    key = row_key()
    docs = docs.select(key["__doc"].alias("doc"), key["__text"].alias("text_id"), "text")
    levels = token_levels(counts)
    edges, found = candidates(docs, spec, levels, units)
    cluster = written(components(edges), "clusters")
    removed(found)
    freed(docs.sparkSession)
    cluster_of = classes.join(cluster, "node")
    fewest = F.least(F.ceil(F.count("*") / BLOCK_NODES), F.lit(MEETINGS))
    blocks = cluster_of.groupBy("root").agg(F.greatest(fewest, F.ceil(F.sum("n") / BLOCK_TOKENS)).cast("int").alias("blocks"))
    home = written(cluster_of.join(blocks, "root").select("node", "doc", "text_id", "unit", "root", "blocks"), "homes")
    removed(cluster)
    in_row, in_node = Bloom(home.select(F.col("doc").bitwiseXOR(F.col("text_id")))).test(), Bloom(home.select("node")).test()
    texts = docs.mapInArrow(_texts(spec, in_row, in_node), "node long, doc long, text_id long, unit int, text binary")
    one = texts.join(home.hint("merge"), ["node", "doc", "text_id", "unit"])  # texts are dealt out alike at every size
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    met = one.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    # Small clusters go together to groups of some GROUP_NODES nodes; what two large blocks hold is a group of its own.
    share = max(buckets_of(docs), home.count() // GROUP_NODES)
    pair = F.xxhash64("root", F.least("block", "other"), F.greatest("block", "other"))
    met = met.withColumn("part", F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("root"), F.lit(share))).otherwise(pair))
    met = met.select("part", "root", F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q"), "block", "node", "doc", "text_id", "unit", "text")
    out = written(met.groupBy("part").applyInArrow(_verify(spec, later, levels), "a long, b long").distinct(), "links")
    removed(home)
    freed(docs.sparkSession)
    return out
