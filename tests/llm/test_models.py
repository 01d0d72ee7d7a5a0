import hashlib
import math
import re
import zlib

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

from pagemill.llm import ball_tree, curriculum, language, pii, quality_mil, queries, warc

from tests.conftest import DATA

from .fixtures import documents, words

PAGES = "page_id long, url string, html string, digest string"


def test_warc_round_trip(spark, tmp_path):
    long = "<p>" + "é" * 3_000_000 + "</p>"
    same = "x" * 200
    rows = [(1, "http://a/\r\nb", same, "k"), (5, None, same, "k"), (3, "u", same, "k"), (4, "u", "", "k"), (6, "u", None, "k"), (7, "u", "small", "k"), (8, "u", "small", "k"), (9, "u", long, "k"), (None, "u", same, "k"), (1, "u", same, "k")]
    rows += [(100 + i, "u", f"page {i} " + "y" * i, None) for i in range(50)]
    manifest = warc.write_archives(spark.createDataFrame(rows, PAGES).repartition(3), f"file://{tmp_path}")
    chunks = warc.read_chunks(manifest, chunk_bytes=1 << 16)
    got = {}
    for r in chunks.orderBy("record_id", "chunk_no").collect():
        got.setdefault((r.page_id, r.record_type, r.target_uri), []).append(r)
    assert len(got[9, "response", "u"]) == -(-len(long.encode()) // (1 << 16))
    whole = hashlib.sha256()
    for r in got[9, "response", "u"]:
        whole.update(r.data)
        assert r.digest_so_far == whole.hexdigest()
    assert b"".join(r.data for r in got[9, "response", "u"]) == long.encode()
    last = {(r.page_id, r.target_uri): r for rs in got.values() for r in rs if r.is_last}
    assert all(r.digest_ok for r in last.values())
    assert last[1, "http://a/%0D%0Ab"].record_type == "response" and last[1, "u"].record_type == "response"
    assert (last[5, "about:blank"].record_type, last[5, "about:blank"].refers_to, last[5, "about:blank"].total_bytes) == ("revisit", 1, 200)
    assert last[3, "u"].refers_to == 1 and last[7, "u"].record_type == last[8, "u"].record_type == "response"
    assert last[4, "u"].total_bytes == last[6, "u"].total_bytes == 0
    assert warc.records(chunks).count() == len(rows)
    archive = next(tmp_path.glob("*.gz")).read_bytes()
    assert zlib.decompressobj(31).decompress(archive).startswith(b"WARC/1.1\r\n")
    assert warc.write_archives(spark.createDataFrame([], PAGES)).count() == 0


BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def plain_spans(text):
    out = []
    for k, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text or "", re.ASCII):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".") if x) if kind == "ip" else True, "card": 12 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]
            if ok:
                out.append((m.start(), k, m.end(), kind))
    return ",".join(f"{kind}:{s}:{e}" for s, _, e, kind in sorted(out))


def test_base_spans_match_the_patterns(spark):
    texts = [
        "mail a.b+c@ex-1.com.org, x@y, @z.com a@b.c+d@e.f a@bb@c.d", "1.2.3.4.5.6.7.8 and 999.1.2.3 0255.1.1.1 1.2.3 300.1.1.1.1", "4111 1111-1111 1111 and 4111111111111112 5 12", "+1 (555) 123-4567, +12, +49 30 1234567890123456, +1--2", "é漢 a@b.co é 10.0.0.1",
        None, "", "1" * 5000, "a@" * 3000, "4111111111111111 " * 700, "+1 5551234567 " * 10, "mail: x@y.zz." * 3, "\U0001d11e a@b.cc",
    ]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)] + [(1, texts[1], 1)], "doc_id long, text string, start int")
    found = pii.find(df).select("doc_id", pii.digest(F.col("base")).alias("spans"), pii.digest(F.concat("base", "added")).alias("every")).collect()
    assert len(found) == len(texts) + 1
    for r in found:
        assert r.spans == plain_spans(texts[r.doc_id]), r.doc_id
        assert set(filter(None, r.spans.split(","))) <= set(filter(None, r.every.split(",")))
    assert pii.find(df.limit(0)).count() == 0


def test_boosting_learns_and_spares_plain_numbers(spark):
    rows = [(i, f"call +1 555 {i:03d} 4567 or write user{i}@mail.example.com today", 0) for i in range(60)] + [(100 + i, f"chapter {i} of {i + 3} has 12 pages", 0) for i in range(60)]
    found = pii.candidates(spark.createDataFrame(rows, "doc_id long, text string, x int"))
    model = pii.fit(found)
    assert model.trees and all(t >= 0.5 for t in model.thresholds)
    out = pii.select(found, model).collect()
    assert all(not r.base and not r.added for r in out if r.doc_id >= 100)
    assert all(len(r.base) == 2 for r in out if r.doc_id < 100)


PERSONAL = "call +1 (743) 555-{0} or write user{1}@mail.example.com from 10.0.{1}.7 with 4111 1111 1111 1111 today"
#: forms that aren't rewritten base spans, without a word that tells what they are
DISGUISED = {
    "email": ["john.doe [at] example.com", "john.doe(at)example(dot)com", "amy at example dot com", "b_c [at] sub.example.org"],
    "ip": ["2001:0db8:85a3:0000:0000:8a2e:0370:7334", "fe80:0:0:0:202:b3ff:fe1e:8329"],
    "card": ["4111.1111.1111.1111", "5500/0000/0000/0004", "4111_1111_1111_1111"],
    "phone": ["(743) 555-3824", "1 743 555 3824", "030 1234 5678", "743.555.3824", "212-555-0147"],
}
LOOK_ALIKE = [
    "chapter 5 of 8 has 12 pages, rows 10 20 30 40 56", "on 2024-01-02 10:30 and 01.02.2023 10", "1 234 567 890 in all", "ids 4111.1111.1111.1112", "1:2:3:4:5:6:7:8", "me@host", "ISBN 123.456.7890", "version 100.200.3000",
    "part no 555 123 4567", "coords 123-456-7890", "digest ab:cd:ef:01:23:45:67:89", "order 4111.1111.1111.1111", "meet at noon dot", "checksum 2001:0db8:85a3:0000:0000:8a2e:0370:7334",
]


def test_each_kind_gains_loose_forms_and_plain_numbers_gain_none(spark):
    base = [(i, PERSONAL.format(3000 + i, i)) for i in range(60)]
    planted = [(k, x) for k, xs in DISGUISED.items() for x in xs]
    rows = base + [(1000 + i, f"the {t}.") for i, t in enumerate(LOOK_ALIKE * 5)] + [(2000 + i, f"we saw {x} here. Then 5 more") for i, (_, x) in enumerate(planted)]
    rows += [(3000, "1-2 " * 20_000 + "we saw (743) 555-3824 here"), (3001, None), (3002, "")]
    df = spark.createDataFrame([(i, t, 1, "x", 2) for i, t in rows], "doc_id long, text string, kind int, made string, held int")
    found = pii.candidates(df)
    model = pii.fit(found)
    used = {f for trees in model.trees for t in trees for f, v in (t[0:2], t[2:4], t[4:6]) if v < 99}
    assert "check" not in pii.FEATURES and len(used) >= 3 and pii.FEATURES.index("context") in used
    assert all(h.positives and h.caught >= 0.9 * h.positives and h.taken <= 0.02 * (h.caught + h.taken) for h in model.held)
    out = {r.doc_id: r for r in pii.select(found, model).select("doc_id", pii.digest(F.col("base")).alias("base"), pii.digest(F.col("added")).alias("added")).collect()}
    assert [out[2000 + i].added for i in range(len(planted))] == [f"{k}:7:{7 + len(x)}" for k, x in planted]
    assert all(out[i].added == "" and out[i].base.count(",") == 3 for i in range(60))
    assert {(rows[60 + i][1], out[1000 + i].added) for i in range(len(LOOK_ALIKE))} == {(f"the {t}.", "") for t in LOOK_ALIKE}
    assert out[3000].added == "phone:80007:80021" and out[3001].added == out[3002].added == ""


def test_candidates_that_look_like_positives_have_no_label(spark):
    """A text's own loose forms may be as many as the disguised ones, and are still found."""
    rows = [(i, PERSONAL.format(3000 + i, i)) for i in range(60)] + [(1000 + i, f"we saw (743) 555-{4000 + i} here") for i in range(60)]
    out = pii.find(spark.createDataFrame(rows, "doc_id long, text string")).filter("doc_id >= 1000").select(F.size("added").alias("n")).collect()
    assert {r.n for r in out} == {1}


def test_mixing_targets_and_positions(spark):
    df, rows = documents(spark)
    out = curriculum.in_order(df.withColumn("size", F.lit("clash"))).collect()
    assert len(out) == len(rows)
    size = {}
    for r in rows:
        size[r[3]] = size.get(r[3], 0) + len(words(r[1]))
    order = sorted(size, key=lambda s: (s is None, s or ""))
    targets = dict(zip(order, fill_targets([size[s] for s in order], [i % 3 + 1 for i in range(len(order))])))
    taken, largest = {}, {}
    for r in out:
        assert r.source_size == size[r.source] and abs(r.target - targets[r.source]) < 1e-6
        assert r.taken == r.size * r.copies and r.copies <= 3 and len(r.positions) == r.copies
        assert all(0 <= p <= 1 for p in r.positions) and list(r.positions) == sorted(r.positions)
        taken[r.source] = taken.get(r.source, 0) + r.taken
        largest[r.source] = max(largest.get(r.source, 0), r.size)
    assert all(abs(taken[s] - targets[s]) <= largest[s] for s in order)
    first = [r.first_position for r in out if r.first_position is not None]
    assert first == sorted(first)
    again = curriculum.in_order(df.repartition(5)).collect()
    key = lambda r: (str(r.doc_id), r.size, r.taken, str(r.positions))
    assert sorted(map(key, out)) == sorted(map(key, again))
    assert curriculum.mix(df).count() == sum(r.copies for r in out)
    assert curriculum.in_order(df.limit(0)).count() == 0


def fill_targets(sizes, weights, cap=3.0, total=None):
    """Plainly: fill what is above its cap, share the rest, again."""
    left = float(sum(sizes) if total is None else total)
    target, open_ = [0.0] * len(sizes), [i for i, w in enumerate(weights) if w > 0]
    while open_:
        whole = sum(weights[i] for i in open_)
        full = [i for i in open_ if left * weights[i] / whole > cap * sizes[i]]
        if not full:
            for i in open_:
                target[i] = left * weights[i] / whole
            break
        for i in full:
            target[i] = cap * sizes[i]
        left -= sum(target[i] for i in full)
        open_ = [i for i in open_ if i not in full]
    return target


@pytest.mark.parametrize("sizes,weights,total", [
    ([100, 100, 100], [1, 2, 3], None), ([10, 1000, 1000], [3, 1, 1], None), ([0, 0], [1, 2], None), ([1, 2, 4, 8, 16, 1000, 7], [9, 8, 7, 6, 5, 1, 0], None), ([5, 50, 7], [1, 1, 1], 10_000), ([3], [0], None), ([1, 10, 100, 1000, 10000], [1, 1, 1, 1, 1], 3000),
])
def test_targets_share_the_excess(spark, sizes, weights, total):
    df = spark.createDataFrame([(i, n, float(w)) for i, (n, w) in enumerate(zip(sizes, weights))], "i int, words long, weight double")
    got = [r.target for r in curriculum.with_targets(df, 3.0, total).orderBy("i").collect()]
    assert got == pytest.approx(fill_targets(sizes, weights, 3.0, total))
    assert curriculum.with_targets(df.limit(0)).count() == 0


def test_many_sources_and_rows_without_an_id(spark):
    rows = [(i if i % 3 else None, f"word {i} " * (1 + i % 5), f"s{i % 700:04d}" if i % 50 else None) for i in range(3000)]
    out = curriculum.plan(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(7)).collect()
    order = sorted({r[2] for r in rows}, key=lambda s: (s is None, s or ""))
    size = {s: sum(len(words(t)) for _, t, x in rows if x == s) for s in order}
    expected = dict(zip(order, fill_targets([size[s] for s in order], [i % 3 + 1 for i in range(len(order))])))
    assert len(out) == 3000 and all(r.target == pytest.approx(expected[r.source]) and r.source_size == size[r.source] for r in out)


def plain_top(vectors, k, every):
    x = {i: np.floor(1024 * np.array(v, dtype=np.float64)) for i, v in vectors if i is not None and v is not None and all(c is not None and np.isfinite(c) for c in v)}
    out = set()
    for q in x:
        if q % every == 0:
            best = sorted((-int(sum(int(a) * int(b) for a, b in zip(x[q], v))), i) for i, v in x.items() if i != q and len(v) == len(x[q]))[:k]
            out |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(best)}
    return out


@pytest.mark.parametrize("scale", [1, 3e5])
def test_ball_trees_match_all_products(spark, monkeypatch, scale):
    monkeypatch.setattr(ball_tree, "LEAF", 8)
    rnd = np.random.default_rng(5)
    rows = [(i, [float(np.float32(v)) for v in rnd.normal(size=6) * scale]) for i in range(300)]
    rows += [(400 + i, rows[3][1]) for i in range(60)]  # one vector many times
    rows += [(900, None), (901, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (902, [float("nan")] * 6), (903, [float("inf")] * 6), (None, rows[0][1]), (905, [1.0, 2.0]), (1000, [2.0, 1.0]), (910, [])]
    df = spark.createDataFrame(rows + rows[:2], "vec_id long, embedding array<float>").withColumn("score", F.lit("clash"))
    got = {tuple(r) for r in ball_tree.top_k(df, F.col("vec_id") % 50 == 0, k=7, shard_rows=70).collect()}
    assert got == plain_top(rows, 7, 50)
    assert ball_tree.top_k(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_products_are_exact_beyond_doubles():
    q = np.array([[2.0**40, 1.0]])
    assert ball_tree.products(q, np.array([[2.0**20, 1.0]]))[0, 0] == 2**60 + 1
    assert ball_tree.products(q, np.array([[2.0**30, 1.0]]))[0, 0] == ball_tree.LONG


def test_quality_is_learned_from_labels(spark):
    rnd = np.random.default_rng(1)
    good = lambda: " ".join("".join(rnd.choice(list("abcdefghij"), rnd.integers(2, 9))) for _ in range(300)) + "."
    bad = lambda: " ".join(["word!!"] * 300)
    rows = [(i, good() if i % 2 else bad(), "x") for i in range(200)] + [(500, None, "x"), (501, "", "x"), (502, " \n", "x"), (None, good(), "x"), (1, good(), "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(150)] + [(160, None), (None, 1), (7777, 1)], "doc_id long, quality int")
    model = quality_mil.learned(docs, labels, ~queries._fold(3, 1))
    out = quality_mil.scored(docs, model).collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 for r in out)
    tested = [r for r in out if r.doc_id is not None and 150 <= r.doc_id < 200]
    assert all((r.score >= 0.5) == bool(r.doc_id % 2) for r in tested)
    one = quality_mil.learned(docs, labels.filter("quality = 1"), F.lit(True))
    assert {r.score for r in quality_mil.scored(docs, one).collect()} == {1.0}
    nothing = quality_mil.learned(docs, labels.limit(0), F.lit(True))
    assert quality_mil.scored(docs.limit(0), nothing).count() == 0


def test_attention_is_learned():
    rnd = np.random.default_rng(0)
    bags = [rnd.normal(size=(n, quality_mil.MEASURES)).astype(np.float32) for n in (1, 3, 5, 2) * 20]
    labels = np.array([float(b.max() > 2.8) for b in bags])
    model = quality_mil.fit(bags, labels, epochs=60)
    first = np.concatenate([[0], np.cumsum([len(b) for b in bags])])
    p = quality_mil.predict(model, np.concatenate(bags), first)
    assert ((p >= 0.5) == labels).mean() > 0.9


def test_gradients_match_differences():
    rnd = np.random.default_rng(0)
    m = quality_mil.start(rnd, 5, 3)
    sizes = [1, 4, 2]
    x, first, y = rnd.normal(size=(7, quality_mil.MEASURES)), np.concatenate([[0], np.cumsum(sizes)]), np.array([1.0, 0.0, 1.0])

    def loss():
        p = quality_mil._forward(m, x, first)["p"]
        return -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()

    for n, grad in quality_mil.gradients(m, x, first, y).items():
        for at in [tuple(rnd.integers(0, d) for d in m[n].shape) for _ in range(8)]:
            was = m[n][at]
            m[n][at] = was + 1e-5
            up = loss()
            m[n][at] = was - 1e-5
            down = loss()
            m[n][at] = was
            assert grad[at] == pytest.approx((up - down) / 2e-5, abs=1e-7), n


def plain_score(model, text):
    """Word by word: passages of PASSAGE words, gated attention, the logistic function of the weighted encoding."""
    w = words(text)
    parts = [w[i : i + quality_mil.PASSAGE] for i in range(0, len(w), quality_mil.PASSAGE)] or [[]]
    bytes_ = [(" ".join(p) + " " * (k + 1 < len(parts))).encode() for k, p in enumerate(parts)]  # white space goes with the word before
    x = np.concatenate([quality_mil.passages(np.frombuffer(b, np.uint8), np.array([0, len(b)]))[0] for b in bytes_])
    m = model.weights
    encoded = [np.tanh(((v - model.mean) / model.scale) @ m["W"] + m["b"]) for v in x]
    force = [float((np.tanh(h @ m["V"]) / (1 + np.exp(-(h @ m["U"])))) @ m["w"]) for h in encoded]
    weight = [math.exp(f - max(force)) for f in force]
    z = sum(a * h for a, h in zip(weight, encoded)) / sum(weight)
    return 1 / (1 + math.exp(-float(z @ m["c"] + m["d"][0])))


def test_scores_match_the_plain_version(spark):
    rnd = np.random.default_rng(3)
    texts_ = [" ".join("".join(rnd.choice(list("abcdefg,."), rnd.integers(1, 9))) for _ in range(n)) for n in (1, 5, 127, 128, 129, 700, 2000)] + ["", None]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts_)], "doc_id long, text string")
    model = quality_mil.learned(docs, spark.createDataFrame([(i, i % 2) for i in range(6)], "doc_id long, quality int"), F.lit(True), epochs=3)
    for r in quality_mil.scored(docs, model).collect():
        assert r.score == pytest.approx(plain_score(model, r.text), abs=1e-5)


def test_language_backs_off_to_shorter_grams(spark):
    rows = [(i, ("the house and the garden " if i % 2 else "das haus und der garten ") * 5, "en" if i % 2 else "de", "s") for i in range(40)]
    rows += [(100, "the gardens", None, "s"), (101, "hausgarten underten", None, "s"), (102, None, "en", "s"), (103, "123 !?", "en", "s"), (104, "", None, "s"), (None, "the house", "en", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    model = language.learned(docs, ~queries._fold(4, 2))
    out = {r.doc_id: r for r in language.identified(docs, model).collect()}
    assert out[100].lang_pred == "en" and out[101].lang_pred == "de" and out[None].lang_pred == "en"
    assert all((out[i].lang_pred, out[i].score) == ("und", 0.0) for i in (102, 103, 104))
    assert all(out[i].lang_pred == rows[i][2] and 0.5 < out[i].score <= 1 for i in range(40))
    blank = language.learned(docs.filter("lang is null"), F.lit(True))
    assert {r.lang_pred for r in language.identified(docs, blank).collect()} == {"und"}


def test_all_words_of_the_sample_are_known(spark):
    name = lambda i: "".join("abcdefghij"[int(d)] for d in f"{i:05d}")
    rows = [(k, " ".join(f"{name(i)} {name(i)}" for i in range(k * 7000, k * 7000 + 7000)), "en") for k in range(9)] + [(9, "zwrot rzadki żółty", "pl")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.learned(docs, F.lit(True))
    assert model.languages == ["en", "pl"]
    known = np.isin(language.names_of([name(0), name(62_999), "rzadki", "unseen"]), model.words.names)
    assert known.tolist() == [True, True, True, False]
    ask = spark.createDataFrame([(1, "zwrot żółty"), (2, name(62_999))], "doc_id long, text string")
    assert {r.doc_id: r.lang_pred for r in language.identified(ask, model).collect()} == {1: "pl", 2: "en"}
    few = language.learned(docs, F.lit(True), per_language=1)
    assert "pl" in few.languages  # the sample is taken language by language


def plain_language(rows, ask):
    """(lang_pred, score) of each text, word by word."""
    letters = lambda t: regex.findall(r"\p{L}[\p{L}\p{M}]*", (t or "").lower())
    count, grams = {}, [{} for _ in range(language.ORDER)]
    for text, lang in rows:
        for w in letters(text):
            count.setdefault(w, {}).setdefault(lang, 0)
            count[w][lang] += 1
    langs = sorted({x for c in count.values() for x in c})
    pieces = lambda w, n: [f"^{w}$"[i : i + n] for i in range(len(w) + 3 - n)]
    for w, c in count.items():
        for lang, n in c.items():
            for k in range(language.ORDER):
                for g in pieces(w, k + 1):
                    at = grams[k].setdefault(g, {})
                    at[lang] = at.get(lang, 0) + 1 + math.log(n)

    def logs(table, key):
        whole = {x: sum(c.get(x, 0) for c in table.values()) + 0.5 * (len(table) + 1) for x in langs}
        return [math.log((table[key].get(x, 0) + 0.5) / whole[x]) for x in langs]

    def word(w):
        if w in count:
            return logs(count, w)
        for n in range(language.ORDER, 0, -1):
            found = [logs(grams[n - 1], g) for g in pieces(w, n) if g in grams[n - 1]]
            if found:
                return [language.BACKOFF ** (language.ORDER + 1 - n) * sum(x) / len(found) for x in zip(*found)]
        return [0.0] * len(langs)

    out = []
    for text in ask:
        found = [word(w) for w in letters(text)]
        if not found:
            out.append(("und", 0.0))
            continue
        total = [sum(x) for x in zip(*found)]
        share = [math.exp((x - max(total)) / math.sqrt(len(found))) for x in total]
        out.append((langs[total.index(max(total))], max(share) / sum(share)))
    return out


def test_language_matches_the_plain_version(spark, monkeypatch):
    monkeypatch.setattr(language, "CACHE_BYTES", 800)
    monkeypatch.setattr(language, "PIECE", 16)
    rows = [("the house and the garden, the end", "en"), ("das Haus und der Garten", "de"), ("हिन्दी भाषा के शब्द", "hi"), ("la maison et le jardin ½ ²", "fr"), ("the", "en"), ("maison blanche", "fr")]
    ask = ["The gardens' housing", "Häuser und Gärten", "हिन्दी", "½ ² ①", "42 -- _", None, "", "jardins maisonnette thé", "und", "xq zzzz", "漢字", "a\u0301b ©", "house " * 40 + "Garten", "the-end/house_das"]
    docs = spark.createDataFrame([(i, t, x) for i, (t, x) in enumerate(rows)], "doc_id long, text string, lang string")
    got = language.identified(spark.createDataFrame([(i, t) for i, t in enumerate(ask)], "doc_id long, text string").repartition(2), language.learned(docs, F.lit(True))).orderBy("doc_id").collect()
    for r, (lang, score) in zip(got, plain_language(rows, ask)):
        assert r.lang_pred == lang and r.score == pytest.approx(score, abs=1e-6), r
    assert [r.lang_pred for r in got[2:7]] == ["hi", "und", "und", "und", "und"]


def test_held_out_languages_and_labels(spark):
    read = lambda name: spark.read.parquet(f"{DATA}/{name}.parquet")
    found = queries.op5_language_backoff(spark, DATA).filter("held_out").join(read("documents").select("doc_id", "lang"), "doc_id").filter("lang is not null and lang_pred <> 'und'")
    assert found.filter("lang = lang_pred").count() >= 0.95 * found.count() > 0
    scored = queries.op2_quality_mil(spark, DATA).filter("held_out").join(read("labels").select("doc_id", "quality"), "doc_id")
    assert scored.filter("quality = predicted").count() >= 0.95 * scored.count() > 0


def test_no_language_is_lost(spark, monkeypatch):
    rows = [(7, "le chat et la souris", "fr")] * 60 + [(i, f"the house number {i}", "en") for i in range(200)] + [(900 + i, f"das haus {i}", "de") for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    model = language.learned(docs, F.lit(True), per_language=20)
    assert model.languages == ["de", "en", "fr"]
    ask = spark.createDataFrame([(1, "le chat"), (2, "the house"), (3, "das haus")], "doc_id long, text string")
    assert [r.lang_pred for r in language.identified(ask, model).orderBy("doc_id").collect()] == ["fr", "en", "de"]
    monkeypatch.setattr(language, "TABLE_BYTES", 3 * 120)  # four words of each
    small = language.learned(docs, F.lit(True))
    assert small.languages == ["de", "en", "fr"] and len(small.words.names) <= 12
    monkeypatch.setattr(language, "TABLE_BYTES", 1)
    assert len(language.learned(docs, F.lit(True)).words.names) == 3


def test_very_long_texts_are_scored(spark):
    long = "the house and the garden " * 60_000
    docs = spark.createDataFrame([(1, long, "en"), (2, "das haus", "de"), (3, "x" * 300_000, None), (4, long, None)], "doc_id long, text string, lang string")
    out = {r.doc_id: r for r in language.identified(docs, language.learned(docs, F.lit(True))).collect()}
    assert out[1].lang_pred == out[4].lang_pred == "en" and out[1].score == out[4].score and out[2].lang_pred == "de"
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    scores = {r.doc_id: r.score for r in quality_mil.scored(docs, quality_mil.learned(docs, labels, F.lit(True))).collect()}
    assert scores[1] == scores[4] and all(0 <= x <= 1 for x in scores.values())
