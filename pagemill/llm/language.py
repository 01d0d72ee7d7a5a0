"""Language identification: known words first, then shorter and shorter character n-grams.

The model has, for each language, how often the words of a bounded sample occur,
and n-gram counts made from them. A word of the table scores by its log frequency in each
language; another by the mean log frequency of its longest n-grams that are known (ORDER
letters, then one less, and so on), at BACKOFF of a word's weight for each step.

Words are a letter and the letters and marks that follow it, in lower case. The sample is
about ``per_language`` documents of each language (all where there are fewer), those lowest
in a hash order of doc_id and text and the very lowest of a language in any case, so that a language is never lost
because its rows are alike; the executors count them whole. The driver gets their words, the most frequent of each language first, up to an equal
share of TABLE_BYTES and one at least, and what n-grams these have, as arrays sorted by 64-bit fingerprints.

Texts are scored by the distinct tokens between white space of a block of documents, gathered by index.

Defined cases: a null text, or one without a letter, is ``und`` with score 0; so
is every text where no language could be learned; ties go to the first language in
order; repeated rows get equal results; extra columns stay.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagemill.llm.blocks import Block, spans_hash, text_blocks, words
from pagemill.llm.work import bounded_batches, removed, written

PER_LANGUAGE = 5_000
ORDER = 4
BACKOFF = 0.7
SMOOTH = 0.5
CACHE_BYTES = 32 << 20
TABLE_BYTES = 64 << 20  # of words, 24 bytes each and their letters, that reach the driver
PIECE = 1 << 16  # tokens looked up at a time
WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*")
UNKNOWN = "und"


def _points(strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The code points of all strings, and where each begins (and the last ends)."""
    points = np.frombuffer("".join(strings).encode("utf-32-le", "surrogatepass"), np.uint32)
    return points, np.concatenate([[0], np.cumsum([len(x) for x in strings], dtype=np.int64)])


def names_of(strings: list[str]) -> np.ndarray:
    points, at = _points(strings)
    return spans_hash(points, at[:-1], at[1:])


def gram_names(found: list[str], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Names of the n-grams of ^word$, and the index of each one's word."""
    points, at = _points([f"^{w}$" for w in found])
    count = np.maximum(np.diff(at) - n + 1, 0)
    owner = np.repeat(np.arange(len(found)), count)
    start = np.repeat(at[:-1] - (np.cumsum(count) - count), count) + np.arange(count.sum())
    return spans_hash(points, start, start + n), owner


class Counts(NamedTuple):
    """An entry for each name and language, sorted by name; a name's score in a language is ``rest`` plus ``gain``, 0 where it has no entry."""

    names: np.ndarray
    langs: np.ndarray
    gain: np.ndarray
    rest: np.ndarray  # by language

    def add(self, out: np.ndarray, names: np.ndarray, owner: np.ndarray) -> np.ndarray:
        """Adds the scores of known names to the rows ``owner`` of ``out``; returns the number found by row."""
        first, last = self.names.searchsorted(names), self.names.searchsorted(names, "right")
        count = last - first
        entry = np.repeat(first - (np.cumsum(count) - count), count) + np.arange(count.sum())
        place = np.repeat(owner, count) * out.shape[1] + self.langs[entry]
        found = np.bincount(owner, count > 0, minlength=len(out))
        out += np.bincount(place, self.gain[entry], minlength=out.size).reshape(out.shape) + found[:, None] * self.rest
        return found


def counts_of(names: np.ndarray, langs: np.ndarray, n: np.ndarray, languages: int) -> Counts:
    turn = np.lexsort((langs, names))
    whole = np.bincount(langs, n, languages) + SMOOTH * (len(np.unique(names)) + 1)
    return Counts(names[turn], langs[turn], np.log(n[turn] + SMOOTH) - math.log(SMOOTH), math.log(SMOOTH) - np.log(whole))


class Model(NamedTuple):
    languages: list[str]
    words: Counts
    grams: list[Counts]  # by length, the shortest first


def model_of(word_counts: pa.Table, gram_counts: pa.Table) -> Model:
    """From (lang, text, n) of words, and of n-grams with their ``size``."""
    languages = sorted(set(pc.unique(word_counts["lang"]).to_pylist()))

    def counts(table: pa.Table) -> Counts:
        langs = pc.index_in(table["lang"], pa.array(languages, pa.string())).to_numpy().astype(np.int32)
        return counts_of(names_of(table["text"].to_pylist()), langs, table["n"].to_numpy().astype(np.float64), len(languages))

    return Model(languages, counts(word_counts), [counts(gram_counts.filter(pc.equal(gram_counts["size"], k + 1))) for k in range(ORDER)])


def _gram_counts(table: DataFrame) -> DataFrame:
    """(lang, size, text, n): a word counts for its n-grams 1 + log of its own count, in millionths."""
    padded = F.concat(F.lit("^"), "text", F.lit("$"))
    none = F.array().cast("array<struct<size:int,text:string>>")
    of = lambda k: F.transform(F.sequence(F.lit(1), F.length(padded) - (k - 1)), lambda i: F.struct(F.lit(k).alias("size"), F.substring(padded, i, F.lit(k)).alias("text")))
    every = F.concat(*[F.when(F.length(padded) >= k, of(k)).otherwise(none) for k in range(1, ORDER + 1)])
    weight = F.round((1 + F.log("n")) * 1_000_000).cast("long").alias("weight")
    rows = table.select("lang", weight, F.explode(every).alias("gram")).groupBy("lang", "gram.size", "gram.text").agg(F.sum("weight").alias("n"))
    return rows.withColumn("n", F.col("n") / 1_000_000)


def learned(docs: DataFrame, usable: Column, per_language: int = PER_LANGUAGE) -> Model:
    """A model of text and lang of the documents whose doc_id meets ``usable``, a condition on doc_id."""
    bounded_batches(docs.sparkSession)
    docs = docs.filter(usable & F.col("lang").isNotNull() & F.col("doc_id").isNotNull())
    place = F.pmod(F.xxhash64("doc_id", "text", F.lit(5)), F.lit(1 << 31)) / (1 << 31)
    share = docs.groupBy(F.col("lang").alias("__lang")).agg((per_language / F.count("*")).alias("share"), F.min(place).alias("least"))
    share = written(share, "language-shares")  # Spark broadcasts it if it is small
    sample = docs.join(share, F.col("lang") == F.col("__lang")).filter((place < F.col("share")) | (place == F.col("least"))).select("lang", "text")

    def count(batches):
        for b in batches:
            seen: dict[str, Counter] = defaultdict(Counter)
            for lang, text in zip(b.column(0).to_pylist(), b.column(1)):
                seen[lang].update(WORD.findall((text.as_py() or "").lower()))
            rows = [(lang, w, n) for lang, c in seen.items() for w, n in c.items()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.string(), pa.int64()))], ["lang", "text", "n"])

    table = written(sample.mapInArrow(count, "lang string, text string, n long").groupBy("lang", "text").agg(F.sum("n").alias("n")), "language-words")
    budget = TABLE_BYTES // max(1, share.count())
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "text").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = table.withColumns({"bytes": F.sum(F.octet_length("text") + 24).over(order), "place": F.count("*").over(order)})
    kept = written(ranked.filter((F.col("bytes") <= budget) | (F.col("place") == 1)).drop("bytes", "place"), "language-table")
    removed(table)
    return model_of(kept.toArrow(), _gram_counts(kept).toArrow())


class Scorer:
    """Scores blocks of texts; remembers tokens that it has met, of CACHE_BYTES at most."""

    def __init__(self, model: Model) -> None:
        self.model = model
        self.width = len(model.languages)
        self.most = max(16, CACHE_BYTES // (8 * (self.width + 1)))
        self.at: dict[int, int] = {}
        self.table = np.zeros((min(self.most, 1 << 18), self.width + 1))

    def words(self, found: list[str]) -> np.ndarray:
        """A row of scores for each word."""
        out = np.zeros((len(found), self.width))
        left = np.arange(len(found))
        known = self.model.words.add(out, names_of(found), left)
        left = left[known == 0]
        for n in range(ORDER, 0, -1):
            if not len(left):
                break
            part = np.zeros((len(left), self.width))
            names, owner = gram_names([found[i] for i in left], n)
            known = self.model.grams[n - 1].add(part, names, owner)
            some = known > 0
            out[left[some]] = part[some] * (BACKOFF ** (ORDER + 1 - n) / known[some])[:, None]
            left = left[~some]
        return out

    def tokens(self, raw: list[bytes]) -> np.ndarray:
        """A row for each token: the sums of its words' scores, and their number."""
        found = [WORD.findall(x.decode("utf-8", "replace").lower()) for x in raw]
        count = np.array([len(x) for x in found], np.int64)
        out = np.zeros((len(raw), self.width + 1))
        out[:, -1] = count
        scores = self.words([w for x in found for w in x])
        some = np.flatnonzero(count)
        if len(some):
            out[some, :-1] = np.add.reduceat(scores, (np.cumsum(count) - count)[some], axis=0)
        return out

    def __call__(self, block: Block) -> tuple[np.ndarray, np.ndarray]:
        """For each document the sums of its words' scores, and the number of words."""
        w = words(block.data, block.bounds)
        total = np.zeros((len(block.bounds) - 1, self.width + 1))
        for k in range(0, len(w.hash), PIECE):
            names, example, turn = np.unique(w.hash[k : k + PIECE], return_index=True, return_inverse=True)
            place = np.array([self.at.get(x, -1) for x in names.tolist()], np.int64)
            rows = self.table[place]
            new = np.flatnonzero(place < 0)
            if len(new):
                rows[new] = self.tokens([block.data[w.start[k + i] : w.end[k + i]].tobytes() for i in example[new]])
                if len(self.at) + len(new) > len(self.table):
                    self.at.clear()
                keep = new[: len(self.table)]
                base = len(self.at)
                self.table[base : base + len(keep)] = rows[keep]
                self.at.update(zip(names[keep].tolist(), range(base, base + len(keep))))
            doc = np.searchsorted(w.first, np.arange(k, k + len(turn)), "right") - 1
            first = np.flatnonzero(np.diff(doc, prepend=-1))
            total[doc[first]] += np.add.reduceat(rows[turn], first, axis=0)
        return total[:, :-1], total[:, -1]

    def predict(self, block: Block) -> tuple[list[str], np.ndarray]:
        n = len(block.bounds) - 1
        if not self.width:
            return [UNKNOWN] * n, np.zeros(n)
        total, count = self(block)
        # Words of a text aren't independent, so the evidence grows with the root of their number.
        share = np.exp((total - total.max(axis=1, keepdims=True)) / np.sqrt(np.maximum(count, 1))[:, None])
        score = np.round(share.max(axis=1) / share.sum(axis=1), 9)
        return [self.model.languages[i] if c else UNKNOWN for i, c in zip(np.round(total, 6).argmax(axis=1), count)], np.where(count > 0, score, 0.0)


def identified(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with lang_pred and score."""
    docs = docs.drop("lang_pred", "score")
    at = docs.columns.index("text")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        scorer = Scorer(shared.value)
        for b in batches:
            found = [scorer.predict(block) for block in text_blocks(b.column(at))]
            lang, score = [x for f, _ in found for x in f], np.concatenate([np.zeros(0)] + [s for _, s in found])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64())], [*b.schema.names, "lang_pred", "score"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))
