import hashlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pagemill.llm import bloom, components, decontaminate, line_dedup, ngram_join, repeats, setjoin, work

from .fixtures import DOCS, documents, shingle_set, words


@pytest.fixture(scope="module")
def docs(spark):
    return documents(spark)


def plain_components(rows, k, num, den):
    sets = [shingle_set(r[1], k) for r in rows]
    up = list(range(len(rows)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and den * both >= num * (len(sets[i]) + len(sets[j]) - both):
                up[top(i)] = top(j)
    least = defaultdict(list)
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[top(i)].append(r[0])
    return sorted(((r[0], len(sets[i]), min(least[top(i)], default=None)) for i, r in enumerate(rows)), key=str)


@pytest.mark.parametrize("k,num,den", [(3, 9, 10), (5, 8, 10)])
def test_ngram_join_matches_all_pairs(spark, docs, k, num, den):
    df, rows = docs
    got = sorted((tuple(r) for r in ngram_join.groups(df, k=k, num=num, den=den).collect()), key=str)
    assert got == plain_components(rows, k, num, den)


def test_join_is_the_same_with_small_limits(spark, docs, monkeypatch):
    df, rows = docs
    monkeypatch.setattr(setjoin, "SMALL_GROUP", 3)
    monkeypatch.setattr(setjoin, "BLOCK_NODES", 4)
    monkeypatch.setattr(components, "ONE_TASK", 5)
    got = sorted((tuple(r) for r in ngram_join.groups(df, k=3, num=8, den=10).collect()), key=str)
    assert got == plain_components(rows, 3, 8, 10)


def test_one_document_of_each_group_stays(spark, docs):
    df, rows = docs
    kept = ngram_join.deduplicated(df)
    assert kept.columns == df.columns
    found = plain_components(rows, 5, 8, 10)
    expected = {(i, c) for i, _, c in found if i is not None and i == c}
    got = [r.doc_id for r in kept.collect()]
    assert {i for i in got if i is not None} == {i for i, _ in expected}
    assert got.count(None) == 1 and got.count(rows[4][0]) == 1  # one of them copies a text that stays


def test_rows_without_an_id_are_documents_of_their_own(spark):
    body = "one two three four five six seven eight nine ten eleven twelve"
    rows = [(None, body), (None, body + " "), (None, "something else entirely is said in this text"), (5, "a b c d e f g"), (5, "h i j k l m n"), (5, "h i j k l m n"), (7, None), (7, None), (None, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted((tuple(r) for r in ngram_join.deduplicated(df).collect()), key=str)
    assert len(kept) == 7 and sum(r[0] is None for r in kept) == 3 and [r for r in kept if r[0] == 5] == rows[3:5]


def plain_lines(rows, k=5, mark=hash):
    """Numbers of removed lines by (doc_id or -1, text); ``mark`` orders the texts of one id."""
    order = sorted({(r[0] if r[0] is not None else -1, mark(r[1]), r[1]) for r in rows if r[1] is not None})
    seen, gone = [], defaultdict(set)
    for doc, at, text in order:
        for no, line in enumerate(text.split("\n")):
            s = shingle_set(line, k)
            if s and any(p < (doc, at, no) and 10 * len(s & t) >= 8 * len(s | t) for p, t in seen):
                gone[doc, text].add(no)
            seen.append(((doc, at, no), s))
    return gone


def test_line_dedup_matches_all_pairs(spark):
    rows = documents(spark, 2, 30)[1]
    rows += [(3, rows[8][1] + "\nthis line stands under an id that has another text", "en", "a", 1, 1, "x"), (None, "no id here at all\nbut a second line of its own", "en", "a", 1, 1, "x")]
    df = spark.createDataFrame(rows, DOCS)
    marks = {r[0]: r[1] for r in df.filter("text is not null").select("text", F.xxhash64("text")).distinct().collect()}
    gone = plain_lines(rows, mark=marks.get)
    got = line_dedup.deduplicated(df).collect()
    expected = []
    for r in rows:
        lines = r[1].split("\n") if r[1] is not None else []
        away = gone[r[0] if r[0] is not None else -1, r[1]]
        expected.append((r[0], "\n".join(x for i, x in enumerate(lines) if i not in away) if r[1] is not None else None, len(lines), len(away)))
    assert sorted(((r.doc_id, r.text, r.n_lines, r.n_removed) for r in got), key=str) == sorted(expected, key=str)


def test_lines_of_other_texts_under_an_id_stay(spark):
    rows = [(1, "the same first line of words in both\na line that repeats in this corpus"), (2, "a line that repeats in this corpus\nunique to the second"), (2, "something only this text says\nand nobody repeats this one here"), (None, "a line that repeats in this corpus\nx y z"), (None, "p q r\ns t u")]
    got = {tuple(r) for r in line_dedup.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "text", "n_removed").collect()}
    assert (2, "something only this text says\nand nobody repeats this one here", 0) in got and (None, "p q r\ns t u", 0) in got and sum(n for *_, n in got) == 2


def plain_repeats(rows, least=100):
    seen, out = {}, []
    order = sorted(((r[0] if r[0] is not None else -1), (r[1] or "").encode()) for r in rows)
    for doc, b in order:
        for i in range(len(b) - least + 1):
            seen[b[i : i + least]] = min(seen.get(b[i : i + least], (doc, i)), (doc, i))
    for r in rows:
        doc, b = r[0] if r[0] is not None else -1, (r[1] or "").encode()
        cover = bytearray(len(b))
        for i in range(len(b) - least + 1):
            if seen[b[i : i + least]] < (doc, i):
                cover[i : i + least] = b"\1" * least
        runs = sum(1 for i in range(len(b)) if cover[i] and not (i and cover[i - 1]))
        out.append((r[0], len(b), sum(cover), runs, hashlib.sha256(bytes(c for c, x in zip(b, cover) if not x)).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("block", [1 << 20, 700])
def test_repeated_bytes_match_all_positions(spark, monkeypatch, block):
    rows = documents(spark, 3, 40)[1]
    rows = [r for r in rows if r[1] is None or len(r[1]) < 20000]
    monkeypatch.setattr(repeats, "BLOCK", block)
    df = spark.createDataFrame(rows, DOCS).repartition(4)
    got = repeats.without_repeats(df.withColumn("spans", F.lit("clash")))
    got = got.select("doc_id", "n_bytes", "n_removed", F.size("spans"), F.sha2("kept", 256)).collect()
    assert sorted((tuple(r) for r in got), key=str) == plain_repeats(rows)


ITEMS = "item_id long, text string, doc string"


def plain_matches(rows, items, k=5):
    out = set()
    for item, text, *_ in items:
        w = words(text)
        if not w:
            continue
        m = min(k, len(w))
        s = {tuple(w[i : i + m]) for i in range(len(w) - m + 1)}
        for r in rows:
            d = words(r[1])
            t = {tuple(d[i : i + m]) for i in range(len(d) - m + 1)}
            if 10 * len(s & t) >= 8 * len(s):
                out.add((r[0], item, len(s & t), len(s)))
    return out


def test_decontamination_matches_all_pairs(spark, docs):
    df, rows = docs
    long = [r for r in rows if r[1] and len(words(r[1])) > 60][:6]
    items = [(i, " ".join(words(r[1])[10 : 20 + 5 * i]), "x") for i, r in enumerate(long)]
    w = words(long[0][1])[3:43]
    w[20] = "altered"
    items += [(50, " ".join(w), "x"), (51, "one", "x"), (52, "", "x"), (53, None, "x"), (54, "b c", "x"), (None, items[1][1], "x"), (54, "b c", "x")]
    bench = spark.createDataFrame(items, ITEMS)
    got = decontaminate.matches(df, bench).select("doc_id", "item_id", "n_found", "n_item")
    assert {tuple(r) for r in got.collect()} == plain_matches(rows, items)
    kept = decontaminate.decontaminated(df, bench)
    assert kept.columns == df.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted((r[0] for r in rows if not plain_matches([r], items)), key=str)


def test_rows_are_judged_one_by_one(spark):
    words_ = [f"w{i}" for i in range(14)]  # an item of 10 shingles
    half = " ".join(words_[:9])  # has 5 of them
    most = " ".join(words_[:12])  # has 8 of them
    rows = [(1, half), (1, half), (2, half), (2, " ".join(words_[5:])), (3, most), (None, most), (None, "clean text without an id"), (3, "clean text under a used id"), (4, " ".join(words_[:11]))]
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(9, " ".join(words_), "x")], ITEMS)
    got = sorted((r.doc_id or 0, r.n_found, r.n_item) for r in decontaminate.matches(docs, bench).collect())
    assert got == [(0, 8, 10), (3, 8, 10)]
    kept = sorted((tuple(r) for r in decontaminate.decontaminated(docs, bench).collect()), key=str)
    assert kept == sorted((r for r in rows if r[1] != most), key=str)


def test_empty_tables(spark, docs):
    none = docs[0].limit(0)
    bench = spark.createDataFrame([], ITEMS)
    assert ngram_join.groups(none).count() == 0
    assert line_dedup.deduplicated(none).count() == 0
    assert repeats.without_repeats(none).count() == 0
    assert decontaminate.matches(docs[0], bench).count() == 0
    assert decontaminate.decontaminated(none, bench).count() == 0


def test_components_by_rounds_and_in_one_task(spark, monkeypatch):
    edges = [(i, i + 1) for i in range(50)] + [(1000, 1000 + i) for i in range(1, 40)] + [(7, 7), (500, 501), (501, 500)]
    df = spark.createDataFrame(edges, "a long, b long")
    one = {tuple(r) for r in components.components(df).collect()}
    monkeypatch.setattr(components, "ONE_TASK", 3)
    assert {tuple(r) for r in components.components(df).collect()} == one
    assert one == {(i, 0) for i in range(51)} | {(1000 + i, 1000) for i in range(40)} | {(500, 500), (501, 500)}


def test_sketches_differ_in_no_more_cells_than_sets_in_tokens():
    draw = np.random.default_rng(5)
    sets = [np.unique(draw.integers(0, 1 << 63, n).astype(np.uint64)) for n in (0, 1, 60, 64, 65, 300, 1000, 1020, 1030)]
    sets += [np.sort(np.concatenate([s[len(s) // 10 :], draw.integers(0, 1 << 63, len(s) // 10).astype(np.uint64)])) for s in sets]
    sketch = setjoin.sketches(np.concatenate(sets), np.cumsum([0, *map(len, sets)]))
    i, j = (x.ravel() for x in np.indices((len(sets), len(sets))))
    found = setjoin.differing(sketch.take(pa.array(i)), sketch.take(pa.array(j)))
    apart = np.array([len(np.setxor1d(sets[a], sets[b])) for a, b in zip(i, j)])
    assert (found <= apart).all() and found[i == j].sum() == 0
    unlike = (apart > 500) & (np.minimum([len(sets[a]) for a in i], [len(sets[b]) for b in j]) > 500)
    assert (3 * found[unlike & (apart > 1500)] > 900).all()  # far more than the tenth or so that a link allows


def test_chance_pairs_connect_no_unlike_documents(spark):
    """Each document shares a few shingles with the next one, and a full table of counts doesn't tell these from unique ones."""
    rows = [(i, " ".join([*(f"w{i}x{j}" for j in range(12)), *(f"own{i}x{j}" for j in range(40)), *(f"w{i + 1}x{j}" for j in range(12))])) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    spec = setjoin.Spec(1, 8, 10, False, 2)
    units, _ = setjoin.scan(df, spec)
    levels = spark.sparkContext.broadcast(bytes(1 << 13))
    assert setjoin.candidates(df, spec, levels)[0].count() > 0
    assert setjoin.candidates(df, spec, levels, units.filter("node is not null"))[0].count() == 0
    assert ngram_join.groups(df, k=1, num=8, den=10).filter("doc_id = component_id").count() == 200


def test_tokens_of_one_node_come_first_and_are_not_sent(spark):
    """Of each document a third of the tokens is shared with unlike ones, and a full table of counts doesn't tell; copies, near copies and short texts still link."""
    rows = [(i, " ".join([*(f"w{i}x{j}" for j in range(20)), *(f"own{i}x{j}" for j in range(80)), *(f"w{i + 1}x{j}" for j in range(20))])) for i in range(150)]
    spec, levels = setjoin.Spec(1, 8, 10, False, 2, True), spark.sparkContext.broadcast(bytes(1 << 13))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    _, found = setjoin.candidates(df, spec._replace(apart=False), levels)
    assert found.count() > 100
    _, found = setjoin.candidates(df, spec, levels)
    assert found.count() == 0
    rows += [(1000 + i, f"more{i} " * 2 + t) for i, t in rows[:40]] + [(2000, rows[3][1]), (2001, rows[4][1].replace("own4x1 ", "other ")), (2002, "a b c d"), (2003, "d c b a"), (2004, "a b c e"), (2005, "a"), (2006, "A"), (2007, None), (2008, " ")]
    rows += [(3000 + i, " ".join(f"f{j}" for j in range(i % 7, 40 + i % 5))) for i in range(60)]  # a large group
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept = {r.doc_id for r in ngram_join.deduplicated(df, k=1).collect()}
    assert kept == {i for i, _, c in plain_components(rows, 1, 8, 10) if i == c} and len(kept) < 170


def test_finished_tables_of_lines_and_near_copies_go(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(work, "shared_dir", lambda spark: f"file://{tmp_path}")
    rows = [(i, "\n".join(f"a{i % 4}x{j} " * 3 + " ".join(f"w{i % 20}x{j}x{k}" for k in range(12)) for j in range(5))) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for dedup in (line_dedup.deduplicated, ngram_join.deduplicated):
        assert dedup(df).count() == (40 if dedup is line_dedup.deduplicated else 20)
        assert not {p.name.split("-")[0] for p in (tmp_path / "pagemill").iterdir()} & {"units", "classes", "line", "shared"}


def test_filters_stay_thin_with_many_keys(spark):
    n = 6_000_000
    test = bloom.Bloom(spark.range(0, n, 1, 8).select(F.col("id") * 3)).test()
    there, other = np.arange(0, 3 * n, 300), np.arange(1, 3 * n, 30)
    assert test(there).all() and test(other).mean() < 0.01
    few = bloom.Bloom(spark.range(0)).test()
    assert not few(there).any() and len(few(there[:0])) == 0
