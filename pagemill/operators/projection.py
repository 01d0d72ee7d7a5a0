"""Text of whole documents, in columns: pages become text each by itself, and neighbours merge.

A page is one row. Its lines are put into reading order, cleaned, rendered and joined inside
that row. What a page needs of its document is small: the running headers' keys and the words that undo
hyphens, both counted over pages first. Page texts then merge like summaries: a summary is a text with the
first and the last line below it, and two that follow each other make one. Pages of a task merge in runs
of RUN, runs merge into the document, so a long document is spread over tasks.

Python is used for the clean-up alone, and gets only lines that it can change.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import pandas as pd
from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagemill.functions import normalize as N
from pagemill.functions import text as X
from pagemill.operators.layout import (
    BODY_LETTERS, BODY_SIZE, COLUMN_GAP, COLUMN_NEAR, DEFAULT_FONT, HEADER_PAGES, LINE, MOSTLY_VERTICAL, PAGE_NUMBER, PARAGRAPH, ROW_NEAR, SOFT_HYPHEN, STEP_OF_SIZE, STEP_RANGE, separator, trimmed,
)
from pagemill.schema import TextSettings

RUN = 256
SHORT = 32  # Java's sort inserts one by one below this length, as the order of near lines asks for
PROJECTION = "task_id string, text string, html string, raw string, joined int, legacy boolean, unread boolean, unmatched int, estimated boolean"


def once(build: Callable[..., Column]) -> Callable[..., Column]:
    """Large expressions are built once a Spark application; building one takes longer than running it on a page."""
    built: dict[tuple, Column] = {}

    @wraps(build)
    def get(*args) -> Column:
        key = (SparkContext._active_spark_context.applicationId, *args)
        if key not in built:
            built.clear() if built and next(iter(built))[0] != key[0] else None
            built[key] = build(*args)
        return built[key]

    return get


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is computed once, however often it is used."""
    return F.transform(F.array(value), then)[0]


# --- reading order ---


def _compare(a: Column, b: Column) -> Column:
    """Lines (struct<k, o, font>) whose edges k are nearer than the smaller font allows go by o; the relation isn't transitive."""
    near = F.abs(a["k"] - b["k"]) < F.least(a["font"], b["font"])
    order = F.when(near, a["o"] - b["o"]).otherwise(a["k"] - b["k"])
    return F.when(order < 0, -1).when(order > 0, 1).otherwise(0)


def inserted(lines: Column, compare: Callable[[Column, Column], Column]) -> Column:
    """Lines one by one, each put behind the last one that doesn't have to follow it."""

    def put(done: Column, x: Column) -> Column:
        place = F.coalesce(F.array_max(F.transform(done, lambda e, i: F.when(compare(x, e) >= 0, i + 1).otherwise(0))), F.lit(0))
        return let(place, lambda p: F.concat(F.slice(done, F.lit(1), p), F.array(x), F.slice(done, p + 1, F.size(done))))

    return F.aggregate(lines, F.slice(lines, 1, 0), put)


def near_sorted(rows: Column) -> Column:
    """Rows of struct<k, o, font, i, ...>, i their place, by a comparison with a tolerance.

    Fewer than SHORT are sorted by insertion as they come. More are first cut into chains: between neighbours by k that are further
    apart than the largest font allows, no two lines are near, so chains follow each other; within a chain lines are inserted in the
    order in which they came.
    """
    reach = F.array_max(F.transform(rows, lambda b: b["font"]))

    def chained(s: Column, r: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (s[i]["k"] - s[F.greatest(i - 1, F.lit(0))]["k"] >= r))
        in_turn = lambda c: F.array_sort(c, lambda a, b: a["i"] - b["i"])
        chain = lambda at: F.transform(at, lambda a, j: F.slice(s, a + 1, F.coalesce(F.get(at, j + 1), F.size(s)) - a))
        return let(starts, lambda at: F.flatten(F.transform(chain(at), lambda c: F.when(F.size(c) == 1, c).otherwise(inserted(in_turn(c), _compare)))))

    by_edge = F.array_sort(rows, lambda a, b: F.when(a["k"] < b["k"], -1).when(a["k"] > b["k"], 1).otherwise(a["i"] - b["i"]))
    return F.when(F.size(rows) < SHORT, F.array_sort(rows, _compare)).otherwise(let(reach, lambda r: let(by_edge, lambda s: chained(s, r))))


def _by(edge: int):
    return lambda a, b: F.when(a["box"][edge] < b["box"][edge], -1).when(a["box"][edge] > b["box"][edge], 1).otherwise(0)


def _columns(blocks: Column) -> Column:
    """Blocks of two columns, one after the other; null where there is no gap between columns."""

    def halves(across: Column) -> Column:
        n = F.size(across)

        def step(s: Column, i: Column) -> Column:
            b = across[i]
            gap = b["box"][0] - s["reach"] > F.coalesce(b["font_size"], F.lit(float(DEFAULT_FONT))) * COLUMN_GAP
            found = F.when(s["cut"].isNull() & (i >= 2) & (n - i >= 2) & gap, i).otherwise(s["cut"])
            return F.struct(F.greatest(s["reach"], b["box"][2]).alias("reach"), found.alias("cut"))

        start = F.struct(across[0]["box"][2].alias("reach"), F.lit(None).cast("int").alias("cut"))
        cut = F.aggregate(F.sequence(F.lit(0), n - 1), start, step)["cut"]
        down = lambda c: F.concat(F.array_sort(F.slice(across, F.lit(1), c), _by(1)), F.array_sort(F.slice(across, c + 1, n), _by(1)))
        return let(cut, lambda c: F.when(c.isNotNull(), down(c)))

    return let(F.array_sort(blocks, _by(0)), halves)


def reading_order(blocks: Column) -> Column:
    """array<struct<box, direction, font_size, ...>> in reading order: vertical pages by columns from the right, pages of two columns one after
    the other, else by rows. Unchanged where a block has no box of four numbers."""

    def near(rows: Column, vertical: Column) -> Column:
        tolerance = F.when(vertical, COLUMN_NEAR).otherwise(ROW_NEAR)
        x, y = (lambda b: b["box"][0]), (lambda b: b["box"][1])
        keyed = F.transform(rows, lambda b, i: F.struct(F.when(vertical, -x(b)).otherwise(y(b)).alias("k"), F.when(vertical, y(b)).otherwise(x(b)).alias("o"), (F.coalesce(b["font_size"], F.lit(0.0)) * tolerance).alias("font"), i.alias("i"), b.alias("b")))
        return F.transform(let(keyed, near_sorted), lambda k: k["b"])

    def order(rows: Column) -> Column:
        boxed = F.forall(rows, lambda b: F.coalesce(F.size(b["box"]) == 4, F.lit(False)))
        vertical = F.size(F.filter(rows, lambda b: b["direction"] == "vertical")) > F.size(rows) * MOSTLY_VERTICAL
        found = lambda v: let(F.when(~v, _columns(rows)), lambda c: F.when(c.isNotNull(), c).otherwise(near(rows, v)))
        return F.when((F.size(rows) < 2) | ~boxed, rows).otherwise(let(vertical, found))

    return let(blocks, order)


# --- lines ---


@F.pandas_udf(T.ArrayType(T.StringType()))
def _cleaned(lines: pd.Series) -> pd.Series:
    return lines.map(lambda x: None if x is None else [None if t is None else N.normalize_text(t) for t in x])


@F.pandas_udf(T.ArrayType(T.ArrayType(T.IntegerType())))
def _places(lines: pd.Series) -> pd.Series:
    return lines.map(lambda x: None if x is None else [None if t is None else N.rewrite(t, track=True).place for t in x])


def rendered(base: Column, glosses: Column, style: str) -> Column:
    """struct<text, html> of a line with its readings (start, end in code points, text); overlapping or invalid spans are skipped."""

    def add(s: Column, g: Column) -> Column:
        fits = (g["start"] >= s["at"]) & (g["start"] < g["end"]) & (g["end"] <= F.length(base))
        plain, own = F.substring(base, s["at"] + 1, g["start"] - s["at"]), F.substring(base, g["start"] + 1, g["end"] - g["start"])
        note = F.lit("") if style == "ignore" else F.concat(F.lit("（"), g["text"], F.lit("）"))
        marked = F.concat(F.lit("<ruby>"), X.escape_html(own), F.lit("<rt>"), X.escape_html(g["text"]), F.lit("</rt></ruby>")) if style == "ruby" else X.escape_html(F.concat(own, note))
        more = F.struct(g["end"].alias("at"), F.concat(s["text"], plain, own, note).alias("text"), F.concat(s["html"], X.escape_html(plain), marked).alias("html"))
        return F.when(F.coalesce(fits, F.lit(False)), more).otherwise(s)

    by_start = F.array_sort(glosses, lambda a, b: a["start"] - b["start"])
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("text"), F.lit("").alias("html"))
    rest = lambda s: F.substring(base, s["at"] + 1, F.length(base))
    done = let(F.aggregate(by_start, start, add), lambda s: F.struct(F.concat(s["text"], rest(s)).alias("text"), F.concat(s["html"], X.escape_html(rest(s))).alias("html")))
    return F.when(F.coalesce(F.size(glosses) > 0, F.lit(False)), done).otherwise(F.struct(base.alias("text"), X.escape_html(base).alias("html")))


def _moved(spans: Column, place: Column) -> Column:
    """Spans at their places after the clean-up; those left empty go. A line without ``place`` hasn't changed."""
    there = lambda at: (at >= 0) & (at < F.size(place))
    inside = F.filter(spans, lambda s: there(s["start"]) & there(s["end"]))
    moved = F.transform(inside, lambda s: F.struct(place[s["start"]].alias("start"), place[s["end"]].alias("end"), s["text"].alias("text")))
    same = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["text"].alias("text")))
    return F.when(place.isNull(), same).otherwise(F.filter(moved, lambda s: s["start"] < s["end"]))


def _lines(pages: DataFrame, settings: TextSettings, glossed: bool) -> DataFrame:
    """``kept`` blocks as ``lines``: struct<base, text, html, box, direction, font_size>."""
    plain = settings.text_mode == "original"
    send = F.transform("kept", lambda b: F.when(N.changeable(b["text"]), b["text"]))
    some = lambda a: F.when(F.exists(a, lambda t: t.isNotNull()), a)
    nothing = F.lit(None)
    rows = pages.withColumn("clean", nothing.cast("array<string>") if plain else _cleaned(some(send)))
    with_spans = F.transform("kept", lambda b: F.when(N.changeable(b["text"]) & (F.size(b["ruby"]) > 0), b["text"])) if glossed else None
    rows = rows.withColumn("places", _places(some(with_spans)) if glossed and not plain else nothing.cast("array<array<int>>"))

    return rows.withColumn("lines", _line_column(settings.ruby_format, glossed)).drop("clean", "places", "kept")


@once
def _line_column(style: str, glossed: bool) -> Column:
    def line(b: Column, i: Column) -> Column:
        base = F.coalesce(F.get(F.col("clean"), i), b["text"], F.lit(""))

        def made(t: Column) -> Column:
            out = rendered(t, let(F.coalesce(b["ruby"], F.slice(b["ruby"], 1, 0)), lambda s: _moved(s, F.get(F.col("places"), i))), style) if glossed else F.struct(t.alias("text"), X.escape_html(t).alias("html"))
            return let(out, lambda r: F.struct(t.alias("base"), r["text"].alias("text"), r["html"].alias("html"), b["box"].alias("box"), b["direction"].alias("direction"), b["font_size"].alias("font_size")))

        return let(base, made)

    return F.transform("kept", line)


def _metrics(lines: Column) -> Column:
    """struct<size, step> of a page's body."""
    n = F.size(lines)
    sizes = lambda rows: F.transform(rows, lambda x: F.coalesce(x["font_size"], F.lit(0.0)))
    body = F.filter(lines, lambda x: F.length(trimmed(x["base"])) >= BODY_LETTERS)
    size = let(body, lambda b: let(F.when(F.size(b) > 0, sizes(b)).otherwise(sizes(lines)), lambda v: X.upper_median(v, F.lit(float(BODY_SIZE)))))

    def move(a: Column, b: Column) -> Column:
        same = (F.size(a["box"]) == 4) & (F.size(b["box"]) == 4) & (a["direction"] == b["direction"])
        return F.when(same, F.when(a["direction"] == "vertical", a["box"][0] - b["box"][0]).otherwise(b["box"][1] - a["box"][1]))

    moves = F.when(n > 1, F.zip_with(F.slice(lines, F.lit(1), n - 1), F.slice(lines, F.lit(2), n - 1), move)).otherwise(F.array().cast("array<double>"))
    step = lambda s: let(F.filter(moves, lambda m: (m > s * STEP_RANGE[0]) & (m < s * STEP_RANGE[1])), lambda v: X.upper_median(v, s * STEP_OF_SIZE))
    return let(size, lambda s: F.struct(s.alias("size"), step(s).alias("step")))


def _tight(sep: Column) -> Column:
    """Whether a separator lets what stands before it run on."""
    return F.coalesce(~F.contains(sep, F.lit(LINE)), F.lit(False))


def _cut(text: Column, end: str) -> Column:
    return F.when(F.endswith(text, F.lit(end)), F.left(text, F.length(text) - 1)).otherwise(text)


_EDGE = "struct<base:string,text:string,box:array<double>,direction:string,font_size:double>"


@once
def _page_text(mode: str) -> Column:
    """struct<text, html, first, last> of a page's ``lines``: separators put in, soft hyphens and those that ``words`` undo taken out."""
    words = F.col("words")

    def of(ls: Column) -> Column:
        n = F.size(ls)
        seps = lambda m: F.when(n > 1, F.zip_with(F.slice(ls, F.lit(1), n - 1), F.slice(ls, F.lit(2), n - 1), lambda a, b: separator(a, b, m["size"], m["step"], mode, "base"))).otherwise(F.array().cast("array<string>"))

        def pieces(s: Column) -> Column:
            def piece(x: Column, i: Column) -> Column:
                sep = F.get(s, i)
                soft = _tight(sep) & F.endswith(x["text"], F.lit(SOFT_HYPHEN))
                own = F.when(soft, F.struct(_cut(x["text"], SOFT_HYPHEN).alias("text"), _cut(x["html"], SOFT_HYPHEN).alias("html"))).otherwise(F.struct(x["text"].alias("text"), x["html"].alias("html")))
                whole = F.lower(F.concat(F.regexp_extract(x["base"], r"([A-Za-z]{2,})-\z", 1), F.regexp_extract(F.get(ls, i + 1)["base"], "^([a-z]{2,})", 1)))
                split = _tight(sep) & x["base"].rlike(r"[A-Za-z]{2,}-\z") & F.get(ls, i + 1)["base"].rlike("^[a-z]{2,}") & F.array_contains(words, whole)
                undone = lambda o: F.when(F.coalesce(split, F.lit(False)) & F.endswith(o["text"], F.lit("-")) & F.endswith(o["html"], F.lit("-")), F.struct(_cut(o["text"], "-").alias("text"), _cut(o["html"], "-").alias("html"))).otherwise(o)
                after = F.coalesce(sep, F.lit(""))
                return let(let(own, undone), lambda o: F.struct(F.concat(o["text"], after).alias("text"), F.concat(o["html"], after).alias("html")))

            return F.transform(ls, piece)

        edge = lambda x: F.when(x.isNotNull(), F.struct(*[x[f].alias(f) for f in ("base", "text", "box", "direction", "font_size")])).cast(_EDGE)
        return let(let(_metrics(ls), lambda m: let(seps(m), pieces)), lambda p: F.struct(
            F.array_join(F.transform(p, lambda x: x["text"]), "").alias("text"), F.array_join(F.transform(p, lambda x: x["html"]), "").alias("html"),
            edge(F.get(ls, F.lit(0))).alias("first"), edge(F.get(ls, n - 1)).alias("last"),
        ))

    return let(F.col("lines"), of)


# --- documents ---


@once
def _merged(mode: str, cross_page: bool) -> Column:
    """One summary of the summaries ``parts`` in order: struct<text, html, first, last, from, to, joined>; pages of consecutive numbers may join if the document is ``complete``."""
    follows = F.col("complete") & F.lit(cross_page)

    def of(ps: Column) -> Column:
        n = F.size(ps)

        def seam(a: Column, b: Column) -> Column:
            on = follows & (b["from"] == a["to"] + 1) & a["last"].isNotNull() & b["first"].isNotNull()
            return F.when(F.coalesce(on, F.lit(False)), separator(a["last"], b["first"], None, None, mode, "base")).otherwise(PARAGRAPH)

        seps = F.when(n > 1, F.zip_with(F.slice(ps, F.lit(1), n - 1), F.slice(ps, F.lit(2), n - 1), seam)).otherwise(F.array().cast("array<string>"))

        def whole(s: Column) -> Column:
            piece = lambda f: F.transform(ps, lambda p, i: F.concat(F.when(_tight(F.get(s, i)) & F.endswith(p["text"], F.lit(SOFT_HYPHEN)), _cut(p[f], SOFT_HYPHEN)).otherwise(p[f]), F.coalesce(F.get(s, i), F.lit(""))))
            inner = F.aggregate(ps, F.lit(0), lambda t, p: t + p["joined"])
            return F.struct(
                F.array_join(piece("text"), "").alias("text"), F.array_join(piece("html"), "").alias("html"), ps[0]["first"].alias("first"), ps[n - 1]["last"].alias("last"), ps[0]["from"].alias("from"), ps[n - 1]["to"].alias("to"),
                (inner + F.size(F.filter(s, _tight))).alias("joined"),
            )

        return let(seps, whole)

    return let(F.col("parts"), of)


def nested_pages(pages: DataFrame, blocks: DataFrame, tables: DataFrame | None = None) -> DataFrame:
    """One row a page, its blocks as an array in their order; shuffles by (task_id, page_index)."""
    by = ["task_id", "page_index"]
    fields = [c for c in ("block_ord", "text", "box", "direction", "font_size", "role", "ruby") if c in blocks.columns]
    grouped = blocks.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(*fields)), lambda a, b: F.when(a["block_ord"] < b["block_ord"], -1).when(a["block_ord"] > b["block_ord"], 1).otherwise(0)).alias("blocks"))
    out = pages.join(grouped, by, "left").withColumn("blocks", F.coalesce("blocks", F.array().cast(dict(grouped.dtypes)["blocks"])))
    if tables is not None:
        return out.join(tables.groupBy(*by).agg(F.count("*").cast("int").alias("n_tables")), by, "left").fillna({"n_tables": 0})
    return out.withColumn("n_tables", F.lit(0))


def _heads(tasks: DataFrame) -> DataFrame:
    shape = {"text": "''", "result_type": "'text'", "partial": "false", "cancelled": "false", "selected": "cast(null as int)", "total": "cast(null as int)", "text_edited": "false", "edited_pages": "cast(null as int)"}
    return tasks.select(F.col("task_id").alias("task_id"), *[(F.coalesce(F.col(k), F.expr(v)) if k in tasks.columns else F.expr(v)).alias(k) for k, v in shape.items()])


def _behind_edits(pages: DataFrame, heads: DataFrame) -> DataFrame:
    """``pages`` without those that an edited text stands for: of such tasks the first edited_pages by number, or all."""
    edited = heads.filter("text_edited").select("task_id", "edited_pages")
    turn = F.row_number().over(Window.partitionBy("task_id").orderBy("page_index"))  # numbers of edited tasks' pages only
    done = pages.select("task_id", "page_index").join(edited, "task_id").withColumn("turn", turn).filter(F.col("edited_pages").isNull() | (F.col("turn") <= F.col("edited_pages")))
    return pages.join(done.select("task_id", "page_index"), ["task_id", "page_index"], "left_anti")


def _facts(heads: DataFrame, pages: DataFrame, mode: str) -> DataFrame:
    """task_id, pages, complete, whole and ``gone``, the margin keys on enough pages of a whole document, of tasks with pages; one pass over ``pages``, whose counts pre-aggregate."""
    keys = F.filter(F.array_distinct(F.transform("body", lambda b: X.margin_key(b["text"], b["box"], F.col("height")))), lambda k: k != "")
    every = F.array(F.lit("")) if mode == "original" else F.concat(F.array(F.lit("")), F.when(F.col("laid_out"), keys).otherwise(F.array().cast("array<string>")))  # "" counts pages
    counted = pages.select("task_id", F.explode(every).alias("key")).groupBy("task_id", "key").agg(F.count("*").alias("n"))
    counted = counted.withColumn("pages", F.max(F.when(F.col("key") == "", F.col("n"))).over(Window.partitionBy("task_id")))
    enough = (F.col("pages") >= HEADER_PAGES) & (F.col("n") >= F.greatest(F.lit(HEADER_PAGES), F.floor((F.col("pages") * 6 + 9) / 10)))
    found = counted.filter(F.col("key").isin("", PAGE_NUMBER) | enough).groupBy("task_id").agg(F.max("pages").alias("pages"), F.collect_set(F.nullif("key", F.lit(""))).alias("keys"))
    wanted = F.when(F.col("text_edited"), F.col("pages")).otherwise(F.coalesce("selected", "total"))
    complete = ~F.col("partial") & ~F.col("cancelled") & F.coalesce(F.col("pages") >= wanted, F.lit(False))
    out = heads.filter("result_type <> 'table'").join(found, "task_id").withColumn("complete", complete).withColumn("whole", F.col("complete") & F.lit(mode != "original"))
    return out.select("task_id", "complete", "whole", F.when(F.col("whole"), F.col("keys")).otherwise(F.slice("keys", 1, 0)).alias("gone"))


@once
def _stays() -> Column:
    """The blocks of laid out pages in reading order without running headers."""
    stays = F.filter(reading_order(F.col("body")), lambda b: (F.size("gone") == 0) | ~F.coalesce(F.array_contains("gone", X.margin_key(b["text"], b["box"], F.col("height"))), F.lit(False)))
    return F.when(F.col("laid_out"), stays).otherwise(F.slice("body", 1, 0))


def _known_words(pages: DataFrame, facts: DataFrame, stays: Column) -> DataFrame:
    """task_id and ``words``: what lines split by a hyphen would make, if the document has it as a word. Only pages with a line that ends so are put in order."""

    def pair(a: Column, b: Column) -> Column:
        head, tail = F.regexp_extract(a["text"], rf"([A-Za-z]{{2,}})-[{N.WHITE}]*\z", 1), F.regexp_extract(b["text"], "^([a-z]{2,})", 1)
        return F.when((head != "") & (tail != ""), F.lower(F.concat(head, tail)))

    n = F.size("kept")
    split = pages.select("task_id", "body", "laid_out", "height").filter(F.exists("body", lambda b: F.endswith(trimmed(b["text"]), F.lit("-"))))
    seams = split.join(facts.filter("whole"), "task_id").withColumn("kept", stays).filter(n > 1).select("task_id", F.explode(F.zip_with(F.slice("kept", F.lit(1), n - 1), F.slice("kept", F.lit(2), n - 1), pair)).alias("word"))
    asked = seams.filter("word is not null").distinct()
    own = asked.groupBy("task_id").agg(F.collect_set("word").alias("asked"))  # as many words as lines end in hyphens
    there = pages.select("task_id", "raw").join(own, "task_id").select("task_id", F.explode(F.array_intersect("asked", X.words_of(F.col("raw")))).alias("word"))
    return there.groupBy("task_id").agg(F.collect_set("word").alias("words"))


def page_texts(pages: DataFrame, heads: DataFrame, settings: TextSettings) -> DataFrame:
    """A summary of each page: task_id, page_index, complete, raw, page struct<text, html, first, last, from, to, joined> and what is lacking."""
    fields = pages.schema["blocks"].dataType.elementType.names
    mode, glossed = settings.text_mode, "ruby" in fields
    role = (lambda b: F.coalesce(b["role"], F.lit(""))) if "role" in fields else (lambda b: F.lit(""))
    body = F.filter("blocks", lambda b: ~role(b).isin("ruby", "ruby-unmatched"))
    laid_out = (F.coalesce("schema_version", F.lit(0)) != 0) & (F.size("blocks") > 0) & (F.col("n_tables") == 0)
    rows = pages.withColumns({
        "laid_out": laid_out, "body": body, "unmatched": F.size(F.filter("blocks", lambda b: role(b) == "ruby-unmatched")),
        "estimated": F.exists("blocks", lambda b: F.exists(F.coalesce(b["ruby"], F.slice(b["ruby"], 1, 0)), lambda r: F.coalesce(r["alignment"] == "estimated", F.lit(False)))) if glossed and settings.ruby_format != "ignore" else F.lit(False),
    }).drop("blocks")
    facts = _facts(heads, rows, mode)
    none = F.array().cast("array<string>")
    if mode == "original":
        kept = rows.join(facts, "task_id").withColumns({"kept": F.col("body"), "words": none})
    else:
        stays = _stays()
        kept = rows.join(facts, "task_id").withColumn("kept", stays).join(_known_words(rows, facts, stays), "task_id", "left").withColumn("words", F.coalesce("words", none))
    made = _lines(kept.drop("body"), settings, glossed).withColumn("own", F.when(F.col("laid_out"), _page_text(mode)))
    text = F.coalesce("text", F.lit(""))
    page = F.struct(
        F.coalesce("own.text", text).alias("text"), F.coalesce("own.html", X.escape_html(text)).alias("html"), F.col("own.first").alias("first"), F.col("own.last").alias("last"),
        F.col("page_index").alias("from"), F.col("page_index").alias("to"), F.lit(0).alias("joined"),
    )
    return made.select("task_id", "page_index", "complete", "raw", page.alias("page"), (~F.col("laid_out")).alias("legacy"), (~F.coalesce("ruby_enabled", F.lit(False))).alias("unread"), "unmatched", "estimated")


def _in_order(column: str) -> Column:
    return F.transform(F.array_sort(F.collect_list(F.struct("at", column)), lambda a, b: F.when(a["at"] < b["at"], -1).when(a["at"] > b["at"], 1).otherwise(0)), lambda x: x[column])


def merged_pages(summaries: DataFrame, settings: TextSettings) -> DataFrame:
    """Summaries of documents from those of their pages, first in runs of RUN page numbers."""
    merged = _merged(settings.text_mode, settings.cross_page)
    lacking = [F.max("legacy").alias("legacy"), F.max("unread").alias("unread"), F.sum("unmatched").cast("int").alias("unmatched"), F.max("estimated").alias("estimated")]
    parts = [_in_order("page").alias("parts"), F.array_join(_in_order("raw"), PARAGRAPH).alias("raw")]
    runs = summaries.withColumn("at", F.col("page_index")).groupBy("task_id", "complete", F.floor(F.col("page_index") / RUN).alias("run")).agg(*parts, *lacking)
    runs = runs.withColumn("page", merged).withColumn("at", F.col("run"))
    whole = runs.groupBy("task_id", "complete").agg(*parts, *lacking)
    return whole.withColumn("page", merged).select("task_id", "page.text", "page.html", "page.joined", "raw", "legacy", "unread", "unmatched", "estimated")


def _raw(pages: DataFrame) -> DataFrame:
    run = pages.withColumn("at", F.col("page_index")).groupBy("task_id", F.floor(F.col("page_index") / RUN).alias("run")).agg(F.array_join(_in_order("raw"), PARAGRAPH).alias("raw"))
    return run.withColumn("at", F.col("run")).groupBy("task_id").agg(F.array_join(_in_order("raw"), PARAGRAPH).alias("raw"))


def project(tasks: DataFrame, pages: DataFrame, settings: TextSettings | None = None, raw_view: bool = False) -> DataFrame:
    """Text of every task (columns PROJECTION). tasks: task_id and any of text, result_type, partial, cancelled, selected, total, text_edited, edited_pages; pages: as by ``nested_pages``.

    Where the number of selected pages is unknown, a document is complete once it has its total; where both are, it isn't.
    """
    settings = (settings or TextSettings()).normalised()
    heads = _heads(tasks)
    raw_text = F.coalesce(F.col("raw_text"), F.col("text")) if "raw_text" in pages.columns else F.col("text")
    lacking = {"ruby_enabled": F.lit(False), "n_tables": F.lit(0), "height": F.lit(None).cast("double"), "schema_version": F.lit(None).cast("int")}
    sheets = pages.withColumns({"raw": F.coalesce(raw_text, F.lit("")), **{k: v for k, v in lacking.items() if k not in pages.columns}})
    own = F.col("h.text")
    if raw_view:
        out = heads.alias("h").join(_raw(sheets).alias("r"), "task_id", "left").withColumn("raw", F.coalesce(F.nullif("r.raw", F.lit("")), own))
        nothing = [F.lit(0).alias("joined"), F.lit(False).alias("legacy"), F.lit(False).alias("unread"), F.lit(0).alias("unmatched"), F.lit(False).alias("estimated")]
        return out.select("task_id", F.col("raw").alias("text"), X.escape_html(F.col("raw")).alias("html"), "raw", *nothing)
    edits = {"text_edited", "result_type"} & set(tasks.columns)  # else all pages flow, and their raw texts come with them
    flow = _behind_edits(sheets, heads) if "text_edited" in edits else sheets
    done = merged_pages(page_texts(flow, heads, settings), settings)
    out = heads.alias("h").join(done.drop("raw").alias("d") if edits else done.alias("d"), "task_id", "left")
    out = out.join(_raw(sheets).alias("r"), "task_id", "left") if edits else out
    raw = F.col("r.raw") if edits else F.col("d.raw")
    table = own if settings.text_mode == "original" else N.normalized(F.when(F.col("h.result_type") == "table", own), table=True)
    both = lambda a, b: F.concat_ws(PARAGRAPH, F.nullif(a, F.lit("")), F.nullif(b, F.lit("")))
    edited, is_table = F.col("h.text_edited"), F.col("h.result_type") == "table"
    choose = lambda plain, flow_: F.when(edited, both(plain(own), F.col(flow_))).when(is_table, plain(table)).when(F.col(flow_).isNotNull(), F.col(flow_)).otherwise(plain(own))
    fact = lambda c, none: F.coalesce(F.col(f"d.{c}"), F.lit(none)).alias(c)
    return out.select(
        "task_id", choose(lambda t: t, "d.text").alias("text"), choose(X.escape_html, "d.html").alias("html"), F.coalesce(F.nullif(raw, F.lit("")), own).alias("raw"),
        fact("joined", 0), fact("legacy", False), (fact("unread", False) & F.lit(settings.ruby_enabled)).alias("unread"), fact("unmatched", 0), fact("estimated", False),
    )
