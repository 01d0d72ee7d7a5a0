"""Personal data by candidate gradient boosting, with DataFrame functions only.

Generators propose spans that may overlap: the four base patterns and looser
ones. Boosted trees, a set for each kind, score a loose candidate by its format and its context; a
threshold for each kind, calibrated on held-out documents, selects the loose
candidates that become spans beside the base ones. The trees are fitted to a
table of counts, one row for each combination of the (coarse) features, so the
driver gets a table whose size has a bound whatever the number of documents,
and scoring is a column expression.

There are no labels for personal data, and none are made by rules for candidates. Positives are base
spans in disguise: each that passes its check is rewritten into loose forms where it stands, once with the context
that it has and once without. Negatives are taught too: the same forms behind words that tell of other numbers
(ISBN, version, part), and forms that are spoilt (a wrong check digit, dates, short hexadecimal groups). The
candidates that texts have by themselves are unlabelled: a first fit takes them as negatives, a second one
only those that the first finds unlikely.

Defined cases: a null text is empty; empty texts have no spans; repeated rows
give repeated results; extra columns are dropped.
"""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.llm.work import written

KINDS = ["email", "ip", "card", "phone"]

# Possessive forms of the base patterns: they match the same spans, without a
# stack of choices, and each starts at the left end of its run, where the plain form starts.
_LOCAL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]"
BASE = {
    "email": _LOCAL + r"++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])[0-9]++(?:[\x20-][0-9]++)*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
LOOSE = {
    "email": _LOCAL + r"++(?:@[A-Za-z0-9-]++|\x20?[\[(]at[\])]\x20?[A-Za-z0-9-]++(?:(?:\.|\x20\.\x20|\x20?[\[(]dot[\])]\x20?)[A-Za-z0-9-]++)++|\x20at\x20[A-Za-z0-9-]++(?:\x20dot\x20[A-Za-z0-9-]++)++)",
    "ip": r"(?<![0-9A-Fa-f:])[0-9A-Fa-f]{1,4}+(?::[0-9A-Fa-f]{1,4}+){7}+",
    "card": r"(?<![0-9])[0-9]++(?:[\x20./_-]{1,2}+[0-9]++)*+",
    "phone": r"(?<![0-9])\(?[0-9]++(?:[\x20().-]{1,3}+[0-9]++)++",
}
CONTEXT = {
    "email": r"(?i)(?:mail|contact|kontakt|correo|courriel)\W*$",
    "ip": r"(?i)(?:ip|host|server|address|adresse)\W*$",
    "card": r"(?i)(?:card|visa|karte|carte|tarjeta|iban|account)\W*$",
    "phone": r"(?i)(?:phone|tel|call|fax|mobil\w*)\W*$",
}
# Words in front of numbers and names that are none of a kind's.
OTHER = (
    r"(?i)(?:isbn|issn|doi|version|ver|release|build|part|item|serial|order|invoice|ref|reference|sku|lot|no|nr|num|number|coords|coordinates|lat|lon|page|chapter|section|rows?|id|"
    r"digest|hash|checksum|sha|md5|mac|uuid|key|port|ratio|score|total|sum|price)\.?\W{0,3}$"
)
_OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"
FEATURES = ["digits", "marks", "left", "right", "context", "a", "b", "c", "d"]
POSITIVE, NEGATIVE = 1, 2  # of made candidates; 0: as the text has it
_RUN = 256


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Of at most 19 digits; longer ones aren't looked at."""
    back = F.split(F.reverse(digits), "")
    doubled = F.transform(back, lambda d, i: F.when(i % 2 == 1, F.when(d.cast("int") > 4, d.cast("int") * 2 - 9).otherwise(d.cast("int") * 2)).otherwise(d.cast("int")))
    return F.when((F.length(digits) > 0) & (F.length(digits) <= 19), F.aggregate(doubled, F.lit(0), lambda a, x: a + x) % 10 == 0).otherwise(F.lit(False))


def _passes(kind: str, m: Column) -> Column:
    n = F.length(_digits(m))
    if kind == "email":
        return m.contains(".")
    if kind == "ip":
        return m.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")
    if kind == "card":
        return n.between(12, 19) & _luhn(_digits(m))
    return n.between(9, 15)


def _rewritten(kind: str, m: Column) -> list[Column]:
    """A base span that passes, in loose forms."""
    if kind == "email":
        name, host = F.substring_index(m, "@", 1), F.substring_index(m, "@", -1)
        return [F.concat(name, F.lit(" [at] "), host), F.concat(name, F.lit("(at)"), F.replace(host, F.lit("."), F.lit("(dot)"))), F.concat(name, F.lit(" at "), F.replace(host, F.lit("."), F.lit(" dot ")))]
    if kind == "ip":
        octets = F.transform(F.split(m, r"\."), lambda x: F.lpad(F.lower(F.hex(x.cast("int"))), 2, "0"))
        last = F.concat(octets[0], octets[1], F.lit(":"), octets[2], octets[3])
        return [F.concat(F.lit("0:0:0:0:0:ffff:"), last), F.concat(F.lit("2001:0db8:0000:0000:0000:0000:"), last), F.concat(F.lit("fe80:0:0:0:"), last, F.lit(":"), last)]
    if kind == "card":
        return [F.regexp_replace(_digits(m), "([0-9]{4})(?=[0-9])", f"$1{c}") for c in "./"]
    d = F.right(_digits(m), F.lit(10))
    cut = lambda *sizes: [F.substring(d, 1 + sum(sizes[:i]), n) for i, n in enumerate(sizes)]
    return [
        F.regexp_replace(m, r"^\+", ""), F.regexp_replace(m, r"^\+1[\x20.-]*", ""), F.concat(F.lit("0"), F.concat_ws(" ", *cut(2, 4, 4))),
        *[F.concat_ws(c, *cut(3, 3, 4)) for c in "-. "], F.concat(F.lit("1 "), F.concat_ws(" ", *cut(3, 3, 4))),
    ]


def _spoilt(kind: str, m: Column) -> list[Column]:
    """What looks like a loose form of a base span and is none."""
    d = _digits(m)
    if kind == "email":
        return [F.concat(F.substring_index(m, "@", 1), F.lit("@"), F.substring_index(F.substring_index(m, "@", -1), ".", 1))]
    if kind == "ip":
        octets = F.transform(F.split(m, r"\."), lambda x: F.lpad(F.lower(F.hex(x.cast("int"))), 2, "0"))
        return [F.concat_ws(":", octets, octets), F.concat(F.concat_ws(":", *[F.substring(F.rpad(d, 8, "7"), i, 1) for i in range(1, 9)]))]
    if kind == "card":
        wrong = F.concat(F.left(d, F.length(d) - 1), ((F.right(d, F.lit(1)).cast("int") + 1) % 10).cast("string"))
        return [F.regexp_replace(wrong, "([0-9]{4})(?=[0-9])", f"$1{c}") for c in "./"]
    return [
        F.concat(F.lit("20"), F.substring(d, 1, 2), F.lit("-0"), F.substring(d, 3, 1), F.lit("-1"), F.substring(d, 4, 1)), F.concat(F.lit("0"), F.substring(d, 3, 1), F.lit(".1"), F.substring(d, 4, 1), F.lit(".20"), F.substring(d, 1, 2), F.lit(" 10")),
        F.regexp_replace(F.left(d, F.lit(10)), "([0-9]{2})(?=[0-9])", "$1 "), F.concat(F.left(d, F.lit(1)), F.regexp_replace(F.substring(d, 2, 9), "([0-9]{3})", " $1")), F.concat(F.lit("20"), F.substring(d, 1, 2), F.lit("-0"), F.substring(d, 3, 1), F.lit("-1"), F.substring(d, 4, 1), F.lit(" 1"), F.substring(d, 5, 1)),
    ]


def _shape(kind: str, m: Column, after: Column) -> list[Column]:
    """Four small numbers that tell a kind's forms apart."""
    groups = F.regexp_extract_all(m, F.lit("[0-9A-Za-z]+"), F.lit(0))
    size = lambda x, most: F.least(F.length(x), F.lit(most))
    n, first, last = F.least(F.size(groups), F.lit(9)), size(F.coalesce(F.get(groups, F.lit(0)), F.lit("")), 6), size(F.coalesce(F.get(groups, F.size(groups) - 1), F.lit("")), 6)
    if kind == "email":
        ends = F.when(m.rlike(r"[^A-Za-z0-9-][A-Za-z]{2,}$"), 1).otherwise(0)
        return [F.when(m.rlike(r"[\[(]at[\])]"), 2).when(m.rlike(r"\x20at\x20"), 1).otherwise(0), ends, F.when(m.rlike(r"[\[(]dot[\])]|\x20dot\x20|\x20\.\x20"), 1).otherwise(0), F.lit(0)]
    if kind == "ip":
        wide = F.aggregate(groups, F.lit(0), lambda a, x: F.greatest(a, F.length(x)))
        return [m.rlike("[A-Fa-f]").cast("int"), wide, after.rlike(r"^(?:[0-9A-Fa-f]|:[0-9A-Fa-f:])").cast("int"), F.lit(0)]
    if kind == "card":
        return [_luhn(_digits(m)).cast("int"), n, first, last]
    lead = F.when(m.startswith("("), 0).when(m.startswith("0"), 1).when(m.startswith("1"), 2).otherwise(3)
    year = m.rlike(r"(?<![0-9])(?:19|20)[0-9]{2}(?![0-9])").cast("int")
    return [n, first, last, lead + 4 * year]


def _matches(text: Column, pattern: str, make) -> Column:
    """The arrays make(match, start, text before it, text after it) of all matches; starts are sums of lengths, in runs of _RUN."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def placed(z: Column) -> Column:
        m, gaps = z["m"], z["g"]
        steps = F.transform(m, lambda x, i: F.length(x) + F.length(gaps[i]))
        add = lambda a, x: a + x
        part = lambda k, n: F.aggregate(F.slice(steps, k * _RUN + 1, n), F.lit(0), add)
        runs = F.transform(F.sequence(F.lit(0), ((F.size(m) - 1) / _RUN).cast("int")), lambda k: part(k, F.lit(_RUN)))
        bases = F.transform(F.sequence(F.lit(0), F.size(runs) - 1), lambda k: F.aggregate(F.slice(runs, F.lit(1), k), F.lit(0), add))
        start = lambda i: bases[(i / _RUN).cast("int")] + part((i / _RUN).cast("int"), i % _RUN) + F.length(gaps[i])
        return F.transform(m, lambda x, i: make(x, start(i), gaps[i], gaps[i + 1]))

    gaps = F.split(text, pattern, -1)
    # A one-row array binds what is used several times, so that it is computed once.
    made = F.flatten(F.flatten(F.transform(F.array(F.struct(found.alias("m"), gaps.alias("g"))), placed)))
    return F.when(text.rlike(pattern), made)


def _span(kind: str, loose: bool):
    """Makes the candidate of a match; behind a base one that passes, what is learned from it."""

    def one(m: Column, start: Column, before: Column, after: Column, loose: bool = loose, made: int = 0, context: int | None = None) -> Column:
        n = F.length(_digits(m))
        side = lambda c: F.when(F.length(c) == 0, 0).when(c.rlike(r"^\s"), 1).when(c.rlike(r"^[\p{L}\p{N}]"), 2).otherwise(3)
        marks = m.rlike(r"[()\[\]]").cast("int") + 2 * m.rlike(r"[./_]").cast("int") + 4 * m.contains(" ").cast("int") + 8 * m.contains("-").cast("int")
        near = F.right(before, F.lit(24))
        a, b, c, d = _shape(kind, m, after) if loose else [F.lit(0)] * 4
        return F.struct(
            start.cast("int").alias("start"),
            F.lit(KINDS.index(kind)).alias("kind"),
            (start + F.length(m)).cast("int").alias("end"),
            F.lit(int(loose)).alias("loose"),
            F.least(n, F.lit(20)).alias("digits") if kind in ("card", "phone") else F.lit(0).alias("digits"),
            marks.alias("marks") if kind in ("card", "phone") else F.lit(0).alias("marks"),
            (F.lit(False) if loose else _passes(kind, m)).cast("int").alias("check"),
            side(F.right(before, F.lit(1))).alias("left"),
            side(F.left(after, F.lit(1))).alias("right"),
            (F.when(near.rlike(CONTEXT[kind]), 1).when(near.rlike(OTHER), 2).otherwise(0) if context is None else F.lit(context)).alias("context"),
            a.alias("a"), b.alias("b"), c.alias("c"), d.alias("d"),
            F.lit(made).alias("made"),
        )

    def make(m: Column, start: Column, before: Column, after: Column) -> Column:
        own = F.array(one(m, start, before, after))
        if loose:
            return own
        fits = lambda forms: F.filter(F.array(*forms), lambda x: x.rlike(f"^{LOOSE[kind]}$"))
        good = F.flatten(F.transform(fits(_rewritten(kind, m)), lambda x: F.array(one(x, start, before, after, True, POSITIVE), one(x, start, before, after, True, POSITIVE, 0), one(x, start, before, after, True, NEGATIVE, 2))))
        bad = F.flatten(F.transform(fits(_spoilt(kind, m)), lambda x: F.array(one(x, start, before, after, True, NEGATIVE, 0), one(x, start, before, after, True, NEGATIVE, 1))))
        return F.when(_passes(kind, m), F.concat(own, good, bad)).otherwise(own)

    return make


def candidates(documents: DataFrame) -> DataFrame:
    """doc_id, ``base`` (spans of the base patterns that pass), ``loose`` (candidates of the loose patterns) and ``made`` (what is learned from base spans)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    kind = "array<struct<start:int,kind:int,end:int,loose:int,digits:int,marks:int,check:int,left:int,right:int,context:int,a:int,b:int,c:int,d:int,made:int>>"
    none = F.array().cast(kind)
    every = [F.coalesce(_matches(text, p, _span(k, loose)), none).cast(kind) for loose, table in ((False, BASE), (True, LOOSE)) for k, p in table.items()]
    docs = documents.select("doc_id", F.concat(*every).alias("all"))
    good = lambda c: (c["loose"] == 0) & (c["check"] == 1)
    loose = lambda made: F.filter("all", lambda c: (c["loose"] == 1) & ((c["made"] > 0) == made))
    return docs.select("doc_id", F.filter("all", good).alias("base"), loose(False).alias("loose"), loose(True).alias("made"))


def _apart(c: Column) -> Column:
    """Touches no base span."""
    return ~F.exists("base", lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"]))


class Held(NamedTuple):
    """What a kind's threshold does on documents held out: disguised base spans and how many are caught; taught negatives, and natural candidates that the first fit finds unlikely, and how many of both are taken."""

    positives: int
    caught: int
    negatives: int
    taken: int


class Model(NamedTuple):
    """By kind: a bias, trees of depth 2 (feature, value, feature, value, feature, value, four leaves; a node asks whether the feature is at most the value), a threshold, and its figures."""

    bias: list[float]
    trees: list[list[tuple]]
    thresholds: list[float]
    held: list[Held]


def _boosted(rows: list[tuple], rounds: int, rate: float) -> tuple[float, list[tuple]]:
    """rows: features, label, weight."""
    ones, whole = sum(n for _, y, n in rows if y), sum(n for *_, n in rows)
    bias = math.log((ones + 1) / (whole - ones + 1))
    x, y, n = np.array([r[0] for r in rows], np.int64).reshape(len(rows), len(FEATURES)), np.array([r[1] for r in rows], float), np.array([r[2] for r in rows], float)
    score, trees = np.full(len(rows), bias), []

    def best(idx, g, h):
        """The feature and value that part rows ``idx`` best, by the sums of gradients and hessians."""
        top, gs, hs = (1e-9, None, None), g[idx].sum(), h[idx].sum()
        for f in range(len(FEATURES)):
            v = x[idx, f]
            gl, hl = np.cumsum(np.bincount(v, g[idx])), np.cumsum(np.bincount(v, h[idx]))
            gain = gl**2 / (hl + 1) + (gs - gl) ** 2 / (hs - hl + 1) - gs**2 / (hs + 1)
            k = int(gain[:-1].argmax()) if len(gain) > 1 else -1
            if k >= 0 and gain[k] > top[0]:
                top = (float(gain[k]), f, k)
        return top[1:]

    for _ in range(rounds if 0 < ones < whole else 0):
        p = 1 / (1 + np.exp(-np.clip(score, -30, 30)))
        g, h = n * (y - p), n * p * (1 - p)
        every = np.arange(len(rows))
        f0, v0 = best(every, g, h)
        if f0 is None:
            break
        left, splits, leaves = x[:, f0] <= v0, [], []
        for side in (every[left], every[~left]):
            f1, v1 = best(side, g, h)
            f1, v1 = (0, 99) if f1 is None else (f1, v1)
            splits += [f1, v1]
            for leaf in (side[x[side, f1] <= v1], side[x[side, f1] > v1]):
                leaves.append(float(rate * g[leaf].sum() / (h[leaf].sum() + 1)))
                score[leaf] += leaves[-1]
        trees.append((f0, v0, *splits, *leaves))
    return bias, trees


def _probability(bias: float, trees: list[tuple], x) -> float:
    s = bias
    for f0, v0, f1, v1, f2, v2, *leaf in trees:
        s += (leaf[0] if x[f1] <= v1 else leaf[1]) if x[f0] <= v0 else (leaf[2] if x[f2] <= v2 else leaf[3])
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, s))))


def fit(found: DataFrame, rounds: int = 40, rate: float = 0.4, precision: float = 0.98) -> Model:
    """Fitted to counts by feature values; documents with crc32(doc_id) % 5 = 0 calibrate the thresholds, all where these have no positive of a kind.

    A kind whose base spans the texts don't have has nothing to learn from and adds no span.
    """
    fold = (F.coalesce(F.crc32(F.col("doc_id").cast("string")), F.lit(0)) % 5 == 0).alias("held")
    counted = found.filter("size(made) + size(loose) > 0").select(fold, F.explode(F.concat("made", F.filter("loose", _apart))).alias("c")).select("held", *[f"c.{f}" for f in ("kind", "made", *FEATURES)])
    rows = counted.groupBy(*counted.columns).count().orderBy(*counted.columns).collect()
    model = Model([], [], [], [])
    for k in range(len(KINDS)):
        own = [(tuple(r[f] for f in FEATURES), r["made"], r["count"], r["held"]) for r in rows if r["kind"] == k]
        if not any(made == POSITIVE for _, made, *_ in own):
            for part, value in zip(model, (-30.0, [], 1.0, Held(0, 0, 0, 0))):
                part.append(value)
            continue
        learn = [r for r in own if not r[3]] if any(r[1] == POSITIVE and not r[3] for r in own) else own
        first = _boosted([(x, int(made == POSITIVE), n) for x, made, n, _ in learn], rounds, rate)
        sure = lambda r: r[1] != 0 or _probability(*first, r[0]) < 0.5  # noqa: E731  what texts have by themselves and looks like a positive has no label
        bias, trees = _boosted([(x, int(made == POSITIVE), n) for x, made, n, _ in filter(sure, learn)], rounds, rate)
        held = [r for r in own if r[3] and sure(r)]
        held = held if any(made == POSITIVE for _, made, *_ in held) else [r for r in own if sure(r)]
        seen = sorted(((_probability(bias, trees, x), int(made == POSITIVE), n) for x, made, n, _ in held), reverse=True)
        limit, good, out = 1.0, 0, 0
        for j, (p, y, n) in enumerate(seen):
            good, out = good + n * y, out + n
            if good / out >= precision and (j + 1 == len(seen) or seen[j + 1][0] < p):
                limit = (p + (seen[j + 1][0] if j + 1 < len(seen) else 0)) / 2  # half way to the next, so that no more is asked than the precision needs
        limit = max(0.5, limit)
        total = lambda test: sum(n for p, y, n in seen if test(p, y))
        figures = Held(total(lambda p, y: y), total(lambda p, y: y and p >= limit), total(lambda p, y: not y), total(lambda p, y: not y and p >= limit))
        for part, value in zip(model, (bias, trees, limit, figures)):
            part.append(value)
    return model


def probability(model: Model, c: Column) -> Column:
    """That of a candidate; trees of other kinds aren't asked."""
    at = lambda f, v: c[FEATURES[f]] <= v
    out = F.lit(0.0)
    for k, (bias, trees) in enumerate(zip(model.bias, model.trees)):
        s = F.lit(bias)
        for f0, v0, f1, v1, f2, v2, *leaf in trees:
            s = s + F.when(at(f0, v0), F.when(at(f1, v1), leaf[0]).otherwise(leaf[1])).otherwise(F.when(at(f2, v2), leaf[2]).otherwise(leaf[3]))
        out = F.when(c["kind"] == k, 1 / (1 + F.exp(-s))).otherwise(out)
    return out


def select(found: DataFrame, model: Model) -> DataFrame:
    """doc_id, ``base`` and ``added``: the loose candidates above their kind's threshold that touch no base span.

    Of added spans of a kind that overlap, all stay: a redaction covers their union.
    """
    limit = F.array(*[F.lit(t) for t in model.thresholds])
    chosen = F.filter("loose", lambda c: (c["loose"] == 1) & (probability(model, c) >= limit[c["kind"]]) & _apart(c))
    return found.select("doc_id", "base", F.when(F.size("loose") > 0, chosen).otherwise(F.col("loose")).alias("added"))


def find(documents: DataFrame) -> DataFrame:
    """doc_id, base and added spans of every document."""
    found = written(candidates(documents), "candidates")  # texts are read once
    return select(found, fit(found))


def digest(spans: Column) -> Column:
    """kind:start:end by start, then kind; comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    order = F.array_sort(F.transform(spans, lambda c: F.struct(c["start"].alias("start"), c["kind"].alias("kind"), c["end"].alias("end"))))
    return F.array_join(F.transform(order, lambda c: F.concat_ws(":", names[c["kind"]], c["start"].cast("string"), c["end"].cast("string"))), ",")
