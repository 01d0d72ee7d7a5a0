"""A Bloom filter of bounded size, built by the executors.

It only thins out what a later exact join has to shuffle: its size has a bound
whatever the data, and what passes wrongly is dropped by that join. It grows with its keys up to some
90 million, since a filter that fills lets through what it should keep from being shuffled.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from pagemill.llm.blocks import mix

MOST_BITS, LEAST_BITS, BITS_A_KEY = 1 << 30, 1 << 16, 12
SLICE_BITS = 1 << 22  # a slice's bits, about; a key has all its bits in one slice, which one group builds
PROBES = 4


def bit_places(keys: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    h = mix(keys.astype(np.int64).view(np.uint64) + np.uint64(0x2545F4914F6CDD1D))
    return (h & np.uint64(size - 1)).astype(np.int64), ((h >> np.uint64(32)) & np.uint64(size - 1)).astype(np.int64)


def _hashes(keys: np.ndarray) -> np.ndarray:
    return mix(keys.astype(np.int64).view(np.uint64) + np.uint64(0x2545F4914F6CDD1D))


def _slice(h: np.ndarray, slices: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(slices) >> np.uint64(32)).astype(np.int64)


def _place(h: np.ndarray, probe: int, bits: int) -> np.ndarray:
    """A bit of the key's slice."""
    with np.errstate(over="ignore"):
        again = mix(h + np.uint64(probe // 2 + 1) * np.uint64(0x9E3779B97F4A7C15))
    half = again >> np.uint64(32) if probe % 2 else again & np.uint64(0xFFFFFFFF)
    return (half * np.uint64(bits) >> np.uint64(32)).astype(np.int64)


def _dealt(slices: int):
    def run(batches):
        for b in batches:
            h = _hashes(b.column(0).drop_null().to_numpy(zero_copy_only=False))
            at = _slice(h, slices)
            turn = np.argsort(at, kind="stable")
            h, at = h[turn], at[turn]
            cut = np.flatnonzero(np.diff(at, prepend=-1))
            ends = np.append(cut[1:], len(at))
            yield pa.RecordBatch.from_arrays([pa.array(at[cut], pa.int32()), pa.array([h[i:j].tobytes() for i, j in zip(cut, ends)], pa.binary())], ["part", "bits"])

    return run


def _built(bits: int):
    def run(key, table):
        h = np.concatenate([np.frombuffer(x.as_py(), np.uint64) for x in table.column("bits")])
        on = np.zeros(bits, bool)
        for probe in range(PROBES):
            on[_place(h, probe, bits)] = True
        return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "bits": pa.array([np.packbits(on, bitorder="little").tobytes()], pa.binary())})

    return run


class Bloom:
    """Of the long values in the first column of ``df``; BITS_A_KEY bits a key, ``most`` (128 MB) at most. Keys, not filters, are dealt out to build it."""

    def __init__(self, df: DataFrame, most: int = MOST_BITS) -> None:
        size = min(most, max(LEAST_BITS, BITS_A_KEY * df.count()))
        slices = -(-size // SLICE_BITS)
        bits = 8 * -(-size // slices // 8)
        parts = df.mapInArrow(_dealt(slices), "part int, bits binary").groupBy("part").applyInArrow(_built(bits), "part int, bits binary").collect()
        out = np.zeros((slices, bits // 8), np.uint8)
        for r in parts:  # MOST_BITS in all
            out[r["part"]] = np.frombuffer(r["bits"], np.uint8)
        self.shared, self.slices = df.sparkSession.sparkContext.broadcast(out.tobytes()), slices

    def test(self) -> "Test":
        return Test(self.shared, self.slices)


class Test:
    """What executors get: a vectorised membership test."""

    __test__ = False

    def __init__(self, shared, slices: int) -> None:
        self.shared, self.slices = shared, slices

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        table = np.frombuffer(self.shared.value, np.uint8)
        size = len(table) // self.slices
        h = _hashes(keys)
        start = _slice(h, self.slices) * size
        left = np.arange(len(h))
        for probe in range(PROBES):
            at = _place(h, probe, 8 * size)
            on = (table[start + (at >> 3)] >> (at & 7).astype(np.uint8) & 1).astype(bool)
            h, start, left = h[on], start[on], left[on]
        out = np.zeros(len(keys), bool)
        out[left] = True
        return out


def shared_ids(docs: DataFrame) -> Test:
    """A test for the ids that several rows of ``docs`` (column doc) may have: only these need a text's fingerprint beside the id."""
    return Bloom(docs.groupBy("doc").count().filter("count > 1").select("doc")).test()


def text_of(shared: Test, doc: np.ndarray, text: np.ndarray) -> np.ndarray:
    """The fingerprints where an id may be shared, 0 elsewhere, where they would only take up room."""
    return np.where(shared(doc), text, 0)


def parted(df: DataFrame, test: Test, shared: Test) -> tuple[DataFrame, DataFrame]:
    """The rows whose key (columns __doc and __text, as by ``text_of``) surely isn't in the filter, and the others."""
    schema, (doc_at, text_at) = df.schema, (df.columns.index(c) for c in ("__doc", "__text"))

    def side(which: bool):
        def run(batches):
            for b in batches:
                doc = b.column(doc_at).to_numpy()
                text = text_of(shared, doc, b.column(text_at).to_numpy())
                yield b.set_column(text_at, "__text", pa.array(text)).filter(pa.array(test(doc ^ text) == which))

        return df.mapInArrow(run, schema)

    return side(False), side(True)
