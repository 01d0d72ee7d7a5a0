import random
import re

from pyspark.sql import functions as F

from pagemill.functions import html as H
from pagemill.operators import ruby, tables
from pagemill.plans import catalog, goldens  # noqa: F401
from pagemill.schema import RUBY

from .conftest import DATA

CELLS = "task_id string, page_index int, table_index int, row_ord int, cell_ord int, row int, column int, row_span int, col_span int, text string"


def table(value, head="项目", rows=2):
    return {"table_index": 0, "rows": [[{"row": i, "column": 0, "row_span": 1, "col_span": 1, "text": head if i == 0 else value}] for i in range(rows)]}


def frame(spark, pages, task="t"):
    rows = [(task, p, t["table_index"], i, j, c["row"], c["column"], c["row_span"], c["col_span"], c["text"]) for p, ts in pages for t in ts for i, row in enumerate(t["rows"]) for j, c in enumerate(row)]
    return spark.createDataFrame(rows, CELLS)


def merged(spark, pages):
    """(page, end page, sources, [(row_ord, row, text)]) of the merged tables."""
    empty = spark.createDataFrame([("t", p) for p, _ in pages], "task_id string, page_index int")
    out = {}
    for r in tables.merged(frame(spark, pages), empty).orderBy("page_index", "table_index", "row_ord", "cell_ord").collect():
        out.setdefault((r.page_index, r.table_index, r.end_page_index, r.source_table_count), []).append((r.row_ord, r.row, r.text))
    return [(p, e, n, rows) for (p, _, e, n), rows in out.items()]


def issues(spark, pages):
    return sorted((r.page_index, r.reason) for r in tables.issues(frame(spark, pages)).collect())


def test_merge_needs_neighbours_with_one_table_each(spark):
    assert len(merged(spark, [(1, [table("a")]), (4, [table("b")])])) == 2
    assert merged(spark, [(3, [table("a")]), (4, [table("b")])]) == [(3, 4, 2, [(0, 0, "项目"), (1, 1, "a"), (2, 2, "b")])]
    assert len(merged(spark, [(0, [table("a")]), (1, []), (2, [table("b")])])) == 2
    assert len(merged(spark, [(0, [table("a"), {**table("b"), "table_index": 1}]), (1, [table("c")])])) == 3
    ((_, end, sources, rows),) = merged(spark, [(i, [table(f"v{i}")]) for i in range(50)])
    assert (end, sources) == (49, 50) and rows == [(0, 0, "项目"), *((i + 1, i + 1, f"v{i}") for i in range(50))]
    def tall(value):
        cell = lambda row, span, text: [{"row": row, "column": 0, "row_span": span, "col_span": 1, "text": text}]
        return {"table_index": 0, "rows": [cell(4, 2, "项目"), cell(6, 3, value)]}

    assert merged(spark, [(0, [tall("x")]), (1, [table("y")]), (2, [tall("z")])]) == [(0, 2, 3, [(0, 4, "项目"), (1, 6, "x"), (2, 9, "y"), (3, 10, "z")])]


def test_header_is_compared_with_the_grown_table(spark):
    # The head has one row; the second row compared is the first continuation's.
    pages = [(0, [table("", rows=1)]), (1, [table("same")]), (2, [table("same")])]
    assert [len(rows) for *_, rows in merged(spark, pages)] == [2]


def test_rows_match_by_similarity_and_digits():
    def row(*texts):
        key = lambda t: "".join(c for c in t.lower() if c.isalnum())
        return [{"column": i, "span": 1, "digits": re.findall("[0-9０-９]+", t), "key": key(t)} for i, t in enumerate(texts)]

    assert tables.same_header(row("Amount", "Name"), row("amount.", "NAME"))
    assert not tables.same_header(row("Amount 1"), row("Amount 2")) and not tables.same_header(row("Nr １"), row("Nr 1"))
    assert not tables.same_header(row(""), row("")) and not tables.same_header(row("a"), row("a", "b")) and not tables.same_header([], [])
    assert tables.same_header(row("a" * 41 + "b" * 9), row("a" * 50)) and not tables.same_header(row("a" * 40 + "b" * 10), row("a" * 50))  # .82 and .80
    wide = row("a")
    wide[0]["span"] = 2
    assert not tables.same_header(wide, row("a"))


def test_issues(spark):
    wide = table("b")
    wide["rows"][0][0]["col_span"] = 2
    other = table("b", "别的标题")
    two = [table("a"), {**table("b"), "table_index": 1}]
    assert issues(spark, [(0, [table("a")]), (1, [other])]) == [(1, "no-header")]
    assert issues(spark, [(0, [table("a")]), (1, [wide])]) == [(1, "column-mismatch")]
    assert issues(spark, [(0, [table("a")]), (1, two)]) == [(1, "not-one-table")]
    assert issues(spark, [(0, [table("a")]), (2, [table("a")])]) == [(2, "non-consecutive")]
    assert issues(spark, [(0, [table("a")]), (1, [table("b")])]) == []


def test_frames(spark):
    cells = frame(spark, [(0, [table("甲")]), (1, [table("乙")]), (3, [table("丙")])]).union(frame(spark, [(0, [table("x")])], "u"))
    out = tables.merged(cells).groupBy("task_id", "page_index", "end_page_index").agg(F.count("*").alias("n")).orderBy("task_id", "page_index").collect()
    assert [tuple(r) for r in out] == [("t", 0, 1, 3), ("t", 3, 3, 2), ("u", 0, 0, 2)]
    assert tables.issues(cells).collect()[0].reason == "non-consecutive"
    assert tables.displayed(cells, False).count() == cells.count()
    batch = spark.createDataFrame([("b", 0, "t"), ("b", 1, "gap"), ("b", 2, "u")], "batch_id string, batch_index int, task_id string")
    placed = tables.batch_positions(batch, cells.filter("page_index = 0"))
    assert sorted((r.page_index, r.text) for r in placed.collect()) == [(0, "甲"), (0, "项目"), (1, None), (2, "x"), (2, "项目")] or placed.count() == 5


def test_tsv_and_html(spark):
    rows = [("t", 0, 0, 0, 0, 0, 0, 2, 1, " a\tb\n"), ("t", 0, 0, 0, 1, 0, 1, 1, 2, "<c>"), ("t", 0, 0, 1, 0, 1, 1, 1, 1, "d"), ("t", 0, 0, 1, 1, 1, 2, 1, 1, "e'")]
    cells = spark.createDataFrame(rows, CELLS)
    assert tables.to_tsv(cells).first().tsv == "a b\t<c>\t\n\td\te'"
    assert tables.to_html(cells).first().html == '<table><tbody><tr><td rowspan="2"> a\tb\n</td><td colspan="2">&lt;c&gt;</td></tr><tr><td>d</td><td>e&#x27;</td></tr></tbody></table>'
    assert tables.to_html(cells, True).first().html.count('rowspan="1"') == 3
    e = tables.extents(cells).first()
    assert (e.height, e.width, e.first_row) == (2, 3, 0)
    assert [r.text for r in tables.cleaned(spark.createDataFrame([("t", 0, 0, 0, 0, 0, 0, 1, 1, " 中 文 ( 注 ) ")], CELLS)).collect()] == ["中文（注）"]


def test_html_grid():
    rows = H.parse_table("<table><tr><td rowspan='2'>a <b>x</b>\n y</td><td>b</td></tr><tr><td>c<td>no</td></tr><tr></tr><tr><th colspan='x'>d</th><td>open</table>", [[1, 2], [3, 4]])
    assert [[(c["row"], c["column"], c["text"]) for c in row] for row in rows] == [[(0, 0, "a x y"), (0, 1, "b")], [(1, 1, "cno")], [(3, 0, "d")]]
    assert rows[0][0]["box"] == [1.0, 2.0] and rows[1][0]["box"] == []
    assert H.parse_table("<td>x</td>") == [] and H.parse_table(None) == [] and H.parse_table("<tr><td rowspan=500 colspan=-3>x</td>")[0][0]["rowSpan"] == 100


def test_sanitiser():
    assert H.sanitize('<ruby onclick="x">漢<rt>か</rt></ruby><img src=a><script>1<2</script></p>') == "<ruby>漢<rt>か</rt></ruby>1&lt;2"
    assert H.sanitize('<td rowspan="3" colspan="0" style=x>a') == '<td rowspan="3">a</td>'
    assert H.sanitize("</ruby>a</rt>") == "a" and H.sanitize(None) is None


def test_table_function(spark):
    H.register_table_cells(spark)
    got = spark.sql("SELECT * FROM table_cells('<tr><td>a</td><td colspan=2>b</td></tr>')").collect()
    assert [(r.row, r.column, r.col_span, r.text) for r in got] == [(0, 0, 1, "a"), (0, 1, 2, "b")]
    spark.createDataFrame([(1, "<tr><td>x</td></tr><tr><td>y</td></tr>"), (2, None), (3, "<p>")], "id int, html string").createOrReplaceTempView("marked_up")
    got = spark.sql("SELECT id, row_ord, text FROM marked_up, LATERAL table_cells(html)").collect()
    assert sorted((r.id, r.row_ord, r.text) for r in got) == [(1, 0, "x"), (1, 1, "y")]


LINES = "task_id string, page_index int, block_ord int, text string, box array<double>, font_size double, direction string, candidate boolean, chars array<struct<text:string,box:array<double>,offset:int>>"


def bound(spark, *lines):
    """(role, parent, glosses as (start, end, text, alignment)) of a page's lines (text, box, size and more)."""
    rows = [("t", 0, i, text, [float(v) for v in box], float(size), more.get("direction", "horizontal"), more.get("candidate", False), more.get("chars")) for i, (text, box, size, more) in enumerate(lines)]
    return [(r.role, r.parent, [(g.start, g.end, g.text, g.alignment) for g in r.ruby]) for r in ruby.bound(spark.createDataFrame(rows, LINES)).orderBy("block_ord").collect()]


def test_binding(spark):
    out = bound(spark, ("漢字語", [10, 30, 70, 50], 20, {}), ("かんじ", [10, 18, 70, 27], 9, {}), ("too", [10, 17, 70, 26], 9, {}), ("far", [300, 400, 330, 409], 9, {"candidate": True}), (" ", [10, 18, 70, 27], 9, {}))
    assert out == [("body", None, [(0, 3, "かんじ", "estimated")]), ("ruby", 0, []), ("ruby-unmatched", None, []), ("ruby-unmatched", None, []), ("body", None, [])]
    tall = {"direction": "vertical"}
    assert bound(spark, ("縦書き", [10, 10, 30, 70], 20, tall), ("たて", [33, 10, 42, 70], 9, tall)) == [("body", None, [(0, 3, "たて", "estimated")]), ("ruby", 0, [])]
    chars = [(c, [10.0 + 20 * i, 30.0, 30.0 + 20 * i, 50.0], i) for i, c in enumerate("漢字語")]
    assert bound(spark, ("漢字語", [10, 30, 70, 50], 20, {"chars": chars}), ("じ", [30, 18, 50, 27], 9, {}))[0][2] == [(1, 2, "じ", "characters")]
    # A gloss can't be glossed: the third line's nearest body is the second, which is a gloss itself by then.
    stack = bound(spark, ("漢字語漢字語", [10, 30, 130, 70], 40, {}), ("よみかた", [10, 10, 130, 28], 18, {}), ("tiny", [10, 4, 130, 9], 5, {}))
    assert [(role, parent) for role, parent, _ in stack] == [("body", None), ("ruby", 0), ("body", None)]


def glyph_lines(spark, glyphs):
    rows = [("t", 0, i, text, [float(x), float(y), float(x + 20), float(y + 20)], 20.0) for i, (text, x, y) in enumerate(glyphs)]
    return ruby.grouped_lines(spark.createDataFrame(rows, "task_id string, page_index int, ord int, text string, box array<double>, size double")).orderBy("block_ord").collect()


def test_glyph_lines(spark):
    out = glyph_lines(spark, [("a", 0, 0), ("b", 22, 1), ("c", 50, 0), ("d", 120, 0), ("e", 0, 60)])
    assert [b.text for b in out] == ["ab c", "d", "e"] and [c["offset"] for c in out[0].chars] == [0, 1, 3] and out[0].box == [0.0, 0.0, 70.0, 21.0]
    assert [(b.text, b.direction) for b in glyph_lines(spark, [("漢", 0, 20 * i) for i in range(3)])] == [("漢漢漢", "vertical")]


def test_glyph_frames(spark):
    rows = [("t", 0, i, c, [0.0, 20.0 * i, 20.0, 20.0 * i + 20], 20.0) for i, c in enumerate("縦書き")]
    g = spark.createDataFrame(rows, "task_id string, page_index int, ord int, text string, box array<double>, size double")
    out = ruby.grouped_lines(g).collect()
    assert [(r.text, r.direction) for r in out] == [("縦書き", "vertical")]
    b = spark.createDataFrame([("t", 0, 0, "漢字", [10.0, 30.0, 70.0, 50.0], "horizontal", 20.0, "body"), ("t", 0, 1, "かんじ", [10.0, 18.0, 70.0, 27.0], "horizontal", 9.0, "body")], "task_id string, page_index int, block_ord int, text string, box array<double>, direction string, font_size double, role string")
    assert [(r.role, r.parent) for r in ruby.bound(b).orderBy("block_ord").collect()] == [("body", None), ("ruby", 0)]
    assert [(r.small, r.body, r.gap) for r in ruby.nearest_bodies(b).collect()] == [(1, 0, 3.0)]
    assert ruby.distinct_regions([[0, 0, 1, 1], [5, 5, 6, 6], [50, 0, 1, 1]], 10) == [[0, 0, 1, 1], [50, 0, 1, 1]]


def test_references_without_a_semicolon():
    page = "<title>a &amp; b &amp</title><script>x && y &amp</script><p>&copy; 1 & 2 &#65 &#65; &am<!-- &amp -->"
    assert H.sanitize(page, True) == "a &amp; b &amp;ampx &amp;&amp; y &amp;amp© 1 &amp; 2 &amp;#65 A &amp;am"
    assert H.sanitize(page) == "a &amp; b &amp;x &amp;&amp; y &amp;amp© 1 &amp; 2 A A &amp;am"


def test_axis_of_a_very_long_line(spark):
    lines = spark.createDataFrame([("t", 0, "vertical", "x" * 50_000), ("t", 0, "horizontal", "x" * 49_000), ("t", 1, "horizontal", "abc")], "task_id string, page_index int, direction string, text string")
    assert {(r.page_index, r.direction) for r in ruby.dominant_axis(lines).collect()} == {(0, "vertical"), (1, "horizontal")}


def test_glyphs_are_joined_to_nothing(spark):
    glyphs = spark.range(10).selectExpr("'t' AS task_id", "0 AS page_index", "CAST(id AS INT) AS ord", "'a' AS text", "array(id * 10D, 0D, id * 10D + 10, 10D) AS box", "10D AS size")
    lines = ruby.grouped_lines(glyphs)
    assert "Join" not in lines._jdf.queryExecution().executedPlan().toString() and [r.text for r in lines.collect()] == ["a" * 10]


def test_pairs_are_made_once(spark):
    lines = spark.createDataFrame([("t", 0, 0, "ab", [10.0, 30.0, 70.0, 50.0], 20.0, "horizontal"), ("t", 0, 1, "r", [10.0, 18.0, 70.0, 27.0], 9.0, "horizontal")], "task_id string, page_index int, block_ord int, text string, box array<double>, font_size double, direction string")
    out = ruby.bound(lines)
    assert [r.role for r in out.orderBy("block_ord").collect()] == ["body", "ruby"]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    # pairs join twice, for roles and for glosses; glosses join what they say, and lines join both
    assert plan.count("Join ") == 5


def test_pages_bind_as_lines_do(spark):
    rnd = random.Random(5)
    rows = []
    for page in range(30):
        for i in range(rnd.randrange(1, 25)):
            x, y, size = rnd.randrange(0, 60, 5), rnd.randrange(0, 90, 6), rnd.choice([5, 9, 9, 20, 20, 40, 0])
            chars = [("字", [x + 10.0 * k, float(y), x + 10.0 * k + 10, y + 20.0], k) for k in range(3)] if rnd.random() < 0.3 else None
            glosses = [(0, 1, "old", None, [0.0, 0.0, 1.0, 1.0], "estimated")] if rnd.random() < 0.1 else None
            box = [float(x), float(y), x + rnd.choice([20.0, 40.0]), y + float(size)] if rnd.random() < 0.95 else None
            rows.append(("t", page, 3 * i + 1, rnd.choice(["漢字語", "かん", " "]), box, float(size), rnd.choice(["horizontal", "horizontal", "vertical", None]), rnd.choice([True, False]), chars, rnd.choice(["body", "body", "ruby", None]), glosses, rnd.random()))
    lines = spark.createDataFrame(rows, LINES + f", role string, ruby {RUBY}, score double").repartition(3)
    got, want = ruby.bound_pages(lines), ruby.bound(lines)
    assert got.schema.simpleString() == want.schema.simpleString()
    order = ["page_index", "block_ord"]
    assert got.orderBy(order).collect() == want.orderBy(order).collect()
    assert {r.role for r in got.collect()} == {"body", "ruby", "ruby-unmatched"}


def test_a_page_s_lines_are_shuffled_once(spark):
    plan = catalog.QUERIES["ruby_page_binding"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    # the line items, and then a row a task
    assert "Join" not in plan and plan.count("Exchange hashpartitioning") == 2
