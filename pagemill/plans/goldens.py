"""Queries whose expected rows are written down, for rules that SQL can't say, and more queries over the driver's tables.

Where a query's inputs are literals, its oracle is a table of VALUES, worked out by hand.
"""

from __future__ import annotations

import gc
import io
import json
import os
import re
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagemill.functions import geometry as G
from pagemill.functions import html as H
from pagemill.functions import normalize as N
from pagemill.functions import text as X
from pagemill.operators import exports, pages, projection, queue, ruby, tables
from pagemill.operators.order import numbered
from pagemill.plans.catalog import _FILES, _ITEM_ROWS, _JOINS, _page_tables, _cells, _items, _table, _tasks, _turns, case, query
from pagemill.schema import EDITS, EVENTS, ExportOptions, TextSettings
from pagemill.sources import files, payloads
from pagemill.sources.store import Conflict, SaveChain, Store
from pagemill.streaming import exports as E
from pagemill.streaming import pages as S


def values(columns: str, rows: list[tuple]) -> str:
    """SQL for a table of literals; columns as "name TYPE, ..."."""

    def literal(v) -> str:
        return "NULL" if v is None else str(v).upper() if isinstance(v, bool) else repr(v) if isinstance(v, (int, float)) else "'" + v.replace("'", "''") + "'"

    named = [c.split() for c in columns.split(", ")]
    body = ", ".join("(" + ", ".join(map(literal, r)) + ")" for r in rows)
    return f"SELECT {', '.join(f'CAST({n} AS {t}) AS {n}' for n, t in named)} FROM (VALUES {body}) AS v({', '.join(n for n, _ in named)})"


def folder(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share: under spark.checkpoint.dir, in local mode otherwise a temporary one."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        shared = tempfile.mkdtemp(prefix="pagemill-")
    path = f"{shared.removeprefix('file://').rstrip('/')}/{name}-{uuid.uuid4().hex}"
    os.makedirs(path)
    return path


# --- the normaliser ---

# fixed values: texts and what the clean-up makes of them
CLEANED = [
    ("1.我们几乎不会说一个完全没有历史知识的人是“受过教育”的，", "1．我们几乎不会说一个完全没有历史知识的人是“受过教育”的，"),
    ("2. 下一项\n3.14 是小数\n1.2.3 版本", "2． 下一项\n3.14 是小数\n1.2.3 版本"),
    ("中文...继续", "中文……继续"), ("说明(English)", "说明（English）"), ("日本語 ( テスト )", "日本語（テスト）"), ("Hello（world）！", "Hello(world)!"),
    ("时间9：00，数值3．14", "时间9:00，数值3.14"), ("说明https://例子.com/a?x=1，邮箱 a@example.com", "说明https://例子.com/a?x=1，邮箱 a@example.com"),
    ("文档说明.pdf，版本v1.2", "文档说明.pdf，版本v1.2"), ("a   b   c   d", "a b c d"), ("漢 字 と仮名", "漢字と仮名"), ("かな の あいだ", "かな の あいだ"),
    ("甲\n  新段落\n \t\n\n乙", "甲\n  新段落\n\n乙"), ("`print( 中文 , 1.2 )`", "`print( 中文 , 1.2 )`"), ("```\n中文 ,  x   y\n\n\n```", "```\n中文 ,  x   y\n\n\n```"),
    ("Hello ,world!Next", "Hello, world! Next"), ("Plato, *Phaedo*, 70c–72e", "Plato, *Phaedo*, 70c–72e"), ("Plato,*Phaedo*,70c–72e", "Plato, *Phaedo*, 70c–72e"),
    ("Plato,   **Phaedo**,   70c–72e", "Plato, **Phaedo**, 70c–72e"), ("An _English_   phrase", "An _English_ phrase"), ("Wait?!Next;then,finish", "Wait?! Next; then, finish"),
    ("word . Next : example ; test ? Yes !", "word. Next: example; test? Yes!"), ("English   text", "English text"), ("*Hello,*World", "*Hello,*World"), ("*Hello,* **world**", "*Hello,* **world**"),
    ("3.14 / 1,000 / 12:30 / func(a,b)", "3.14 / 1,000 / 12:30 / func(a,b)"), ('Call outer(inner(a,b),"x,y") now', 'Call outer(inner(a,b),"x,y") now'),
    ("`Hello ,world` and https://example.com/a,b?x=y", "`Hello ,world` and https://example.com/a,b?x=y"), ("Email a@example.com;next", "Email a@example.com; next"),
    ("See /usr/local/a,b/file.txt", "See /usr/local/a,b/file.txt"), ("Hello.World Time:12:30 Name:Value", "Hello.World Time:12:30 Name:Value"), ("Hello,\nworld!\nNext", "Hello,\nworld!\nNext"),
    ("Hello,  \n  world", "Hello,\n  world"), ("他说，Hello,world!", "他说，Hello, world!"),
    ("中文 , 测试 !\n\n\nEnglish   text 2.5\n日本語 ( テスト )", "中文，测试！\n\nEnglish text 2.5\n日本語（テスト）"),
]
# end of fixed values
MORE_CLEANED = [  # brackets left open, nested, over lines; far beyond the basic plane; protected text next to a change
    ("甲(乙\n丙)", "甲(乙\n丙)"), ("甲((乙)丙", "甲(（乙）丙"), ("𠮷 , 𠮷", "𠮷，𠮷"), ("漢 `a , b` 字", "漢 `a , b` 字"), ("見 f(x, y) , 次", "見 f(x, y) ，次"), ("一\r\n\r\n\r\n二\r三", "一\n\n二\n三"), ("（abc）", "(abc)"),
]


@case(values("id INTEGER, text VARCHAR, again BOOLEAN", [(i, out, True) for i, (_, out) in enumerate(CLEANED + MORE_CLEANED)]))
def normalize_cases(spark, sf_dir):
    """All passes, protected text, neighbours and brackets; the result doesn't change again."""
    df = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(CLEANED + MORE_CLEANED)], "id int, text string")
    once = df.select("id", N.normalized(F.col("text")).alias("text"))
    return once.select("id", "text", (N.normalized(F.col("text")) == F.col("text")).alias("again"))


_CELLS_CLEANED = [(" 中 文 ( 说明 )\n\nHello,world\t3.14 ", "中文（说明）\n\nHello, world\t3.14"), ("call(a,b) 3.14 https://a.example/a,b <script>", "call(a,b) 3.14 https://a.example/a,b <script>"), (" a \r\n b ", "a\r\nb"), ("1.说明\n", "1．说明\n")]


@case(values("id INTEGER, text VARCHAR, html VARCHAR", [(i, out, '<table><tr><td rowspan="1" colspan="2">' + out.replace("<", "&lt;").replace(">", "&gt;") + "</td></tr></table>") for i, (_, out) in enumerate(_CELLS_CLEANED)]))
def table_text_cases(spark, sf_dir):
    """Cells cleaned piece by piece, and the HTML made of them anew, always with spans."""
    cells = spark.createDataFrame([(str(i), 0, i, 0, 0, 0, 0, 1, 2, a) for i, (a, _) in enumerate(_CELLS_CLEANED)], "task_id string, page_index int, table_index int, row_ord int, cell_ord int, row int, column int, row_span int, col_span int, text string")
    done = tables.cleaned(cells)
    return done.join(tables.to_html(done, True), tables.TABLE).select(F.col("table_index").alias("id"), "text", "html")


_SPANS = [("𠮷... 薔 薇,中文", 5, 8, "𠮷…… 薔薇，中文", "4:6"), ("Hello,world 薔薇", 12, 14, "Hello, world 薔薇", "13:15"), ("漢字", 0, 2, "漢字", "0:2"), ("漢 字", 1, 2, "漢字", "")]


@case(values("id INTEGER, text VARCHAR, spans VARCHAR", [(i, t, s) for i, (*_, t, s) in enumerate(_SPANS)]))
def moved_span_cases(spark, sf_dir):
    """Places of glosses after the clean-up, seen through the projection: a gloss that is left empty goes."""
    rows = [(i, *N.moved_spans(t, [{"start": a, "end": b, "text": "x"}])) for i, (t, a, b, *_) in enumerate(_SPANS)]
    return spark.createDataFrame([(i, t, ",".join(f"{s['start']}:{s['end']}" for s in spans)) for i, t, spans in rows], "id int, text string, spans string")


# --- projection ---


def _block(text, y=100, x=20, width=400, **more):
    return {"text": text, "box": [float(x), float(y), float(x + width), float(y + 20)], "direction": "horizontal", "font_size": 20.0, "role": "body", "ruby": None, **more}


def _gloss(start, end, text, alignment="characters"):
    return [(start, end, text, None, None, alignment)]


_TWO = [[_block("开始")], [_block("继续")]]
_LONG = "这是一段尚未结束的长句，应该结合版面判断是否连接"
_HEADED = [[_block("书名", 20), _block(f"正文{c}。", 300), _block(str(i + 1), 770)] for i, c in enumerate("甲乙丙")]
_ROSE = [[_block("𠮷薔薇色<script>", ruby=_gloss(1, 4, "ばらいろ", "estimated")), _block("ばらいろ", 126, role="ruby"), _block("注", 152, role="ruby-unmatched")]]
#: case, settings, facts of the task, pages of blocks, expected text, seams joined over pages, unmatched, estimated
PROJECTED = [
    ("cleaned", {}, {}, [[_block("中文 , 测试"), _block("第二 行", 126)]], "中文，测试第二行", 0, 0, False),
    ("original", {"text_mode": "original"}, {}, [[_block("中文 , 测试"), _block("第二 行", 126)]], "中文 , 测试\n第二 行", 0, 0, False),
    ("continuous", {"text_mode": "continuous"}, {}, [[_block("结束。", 100, 20, 60), _block("下一句", 126, 20, 60)]], "结束。下一句", 0, 0, False),
    ("latin", {}, {}, [[_block("English text"), _block("continues here.", 126)]], "English text continues here.", 0, 0, False),
    ("kana", {}, {}, [[_block("日本語の"), _block("続きです。", 126)]], "日本語の続きです。", 0, 0, False),
    ("soft hyphen", {}, {}, [[_block("recog­"), _block("nition", 126)]], "recognition", 0, 0, False),
    ("compound", {}, {}, [[_block("well-"), _block("known", 126)]], "well-known", 0, 0, False),
    ("dictionary", {}, {}, [[_block("recog-"), _block("nition improves recognition", 126), _block("keep recog-nition unchanged", 152)]], "recognition improves recognition keep recog-nition unchanged", 0, 0, False),
    ("indent", {}, {}, [[_block("正文"), _block("新段落", 126, 60)]], "正文\n\n新段落", 0, 0, False),
    ("poem", {}, {}, [[_block("诗句", 100, 20, 60), _block("下一句", 126, 20, 60)]], "诗句\n下一句", 0, 0, False),
    ("list", {}, {}, [[_block("1.我们是第一项"), _block("2.我们是第二项", 126)]], "1．我们是第一项\n\n2．我们是第二项", 0, 0, False),
    ("dialogue", {}, {}, [[_block("正文"), _block("「对话」", 126)]], "正文\n\n「对话」", 0, 0, False),
    ("heading", {}, {}, [[_block(_LONG), _block("第二章 新章", 126)]], _LONG + "\n\n第二章新章", 0, 0, False),
    ("column", {}, {}, [[_block(_LONG), _block("另一栏正文", 126, 500)]], _LONG + "\n\n另一栏正文", 0, 0, False),
    ("distant", {}, {}, [[_block(_LONG), _block("独立段落", 250)]], _LONG + "\n\n独立段落", 0, 0, False),
    ("large", {}, {}, [[_block(_LONG), _block("大标题", 126, font_size=32.0)]], _LONG + "\n\n大标题", 0, 0, False),
    ("runs on", {}, {}, [[_block(_LONG, 100, 20, 600), _block("是坏。", 126, 20, 60, font_size=16.0), _block("后面的段落从这里开始", 180, 20, 600)]], _LONG + "是坏。\n\n后面的段落从这里开始", 0, 0, False),
    ("pages", {}, {}, _TWO, "开始继续", 1, 0, False),
    ("partial", {}, {"partial": True}, _TWO, "开始\n\n继续", 0, 0, False),
    ("cancelled", {}, {"cancelled": True}, _TWO, "开始\n\n继续", 0, 0, False),
    ("by total", {}, {"selected": None, "total": 2}, _TWO, "开始继续", 1, 0, False),
    ("below total", {}, {"selected": None, "total": 3}, _TWO, "开始\n\n继续", 0, 0, False),
    ("gap", {}, {"indices": [0, 3]}, _TWO, "开始\n\n继续", 0, 0, False),
    ("pages apart", {"cross_page": False}, {}, _TWO, "开始\n\n继续", 0, 0, False),
    ("headers", {}, {}, _HEADED, "正文甲。\n\n正文乙。\n\n正文丙。", 0, 0, False),
    ("headers stay", {}, {"partial": True}, _HEADED, "书名\n\n正文甲。\n\n1\n\n书名\n\n正文乙。\n\n2\n\n书名\n\n正文丙。\n\n3", 0, 0, False),
    ("vertical", {}, {}, [[_block("左列", direction="vertical", box=[20.0, 20.0, 40.0, 500.0]), _block("右列", direction="vertical", box=[50.0, 20.0, 70.0, 500.0])]], "右列左列", 0, 0, False),
    ("columns", {}, {}, [[_block("甲一。", 100, 20, 100), _block("乙一。", 100, 300, 100), _block("甲二。", 126, 20, 100), _block("乙二。", 126, 300, 100)]], "甲一。\n甲二。\n\n乙一。\n乙二。", 0, 0, False),
    ("glosses", {}, {}, _ROSE, "𠮷薔薇色（ばらいろ）<script>", 0, 1, True),
    ("no glosses", {"ruby_format": "ignore"}, {}, _ROSE, "𠮷薔薇色<script>", 0, 1, False),
    ("edited", {}, {"text": "My , own", "text_edited": True, "edited_pages": 1}, [[_block("旧")], [_block("中文 , 新")]], "My , own\n\n中文，新", 0, 0, False),
    ("table", {}, {"result_type": "table", "text": "表 格 , 内容\n\n\n1.说明"}, [[_block("x")]], "表格，内容\n\n\n1．说明", 0, 0, False),
    ("no layout", {}, {"schema": None}, [[_block("原 始"), _block("换行", 126)]], "原 始\n换行", 0, 0, False),
    ("no pages", {}, {"text": "只有 , 文本"}, [], "只有 , 文本", 0, 0, False),
]
_HTML = {"glosses": "𠮷薔薇色（ばらいろ）&lt;script&gt;", "ruby": "𠮷<ruby>薔薇色<rt>ばらいろ</rt></ruby>&lt;script&gt;"}


def _projected(spark, cases) -> dict[tuple, DataFrame]:
    """The projection of cases (case, settings, facts, pages) for each of the settings."""
    by: dict[tuple, list] = {}
    for name, settings, facts, pages_, *_ in cases:
        by.setdefault(tuple(sorted(settings.items())), []).append((name, facts, pages_))
    ruby_type = "array<struct<start:int,end:int,text:string,score:double,box:array<double>,alignment:string>>"
    out = {}
    for settings, part in by.items():
        heads, sheets, blocks = [], [], []
        for name, f, pages_ in part:
            heads.append((name, f.get("text", ""), f.get("result_type", "text"), f.get("partial", False), f.get("cancelled", False), f.get("selected", len(pages_)), f.get("total"), f.get("text_edited", False), f.get("edited_pages")))
            for i, page in enumerate(pages_):
                index = f.get("indices", range(len(pages_)))[i]
                whole = "\n".join(b["text"] for b in page)
                sheets.append((name, index, whole, whole, f.get("schema", 1), 800.0, False))
                blocks += [(name, index, j, b["text"], b["box"], b["direction"], b["font_size"], b["role"], b["ruby"]) for j, b in enumerate(page)]
        heads = spark.createDataFrame(heads, "task_id string, text string, result_type string, partial boolean, cancelled boolean, selected int, total int, text_edited boolean, edited_pages int")
        sheets = spark.createDataFrame(sheets, "task_id string, page_index int, text string, raw_text string, schema_version int, height double, ruby_enabled boolean")
        blocks = spark.createDataFrame(blocks, f"task_id string, page_index int, block_ord int, text string, box array<double>, direction string, font_size double, role string, ruby {ruby_type}")
        out[settings] = projection.project(heads, projection.nested_pages(sheets, blocks), TextSettings(**dict(settings)))
    return out


@case(values("task_id VARCHAR, text VARCHAR, joined INTEGER, unmatched INTEGER, estimated BOOLEAN", [(c, *rest) for c, _, _, _, *rest in PROJECTED]))
def project_cases(spark, sf_dir):
    """The whole projection: reading order, line and page seams, headers, hyphens, glosses, edits, and which documents count as complete."""
    parts = [df.select("task_id", "text", "joined", "unmatched", "estimated") for df in _projected(spark, PROJECTED).values()]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


@case(values("style VARCHAR, html VARCHAR, raw VARCHAR, unread BOOLEAN", [("parentheses", _HTML["glosses"], "𠮷薔薇色<script>\nばらいろ\n注", False), ("ruby", _HTML["ruby"], "𠮷薔薇色<script>\nばらいろ\n注", True)]))
def gloss_html(spark, sf_dir):
    """HTML of glosses in two styles; what is lacking glosses counts only where they are asked for."""
    styles = [("parentheses", {}), ("ruby", {"ruby_format": "ruby", "ruby_enabled": True})]
    out = [next(iter(_projected(spark, [("t", s, {}, _ROSE)]).values())).select(F.lit(n).alias("style"), "html", "raw", "unread") for n, s in styles]
    return out[0].union(out[1])


@query(f"""
    WITH p AS (SELECT conv_id AS task_id, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS raw FROM conversations GROUP BY conv_id)
    SELECT CAST(task_id AS VARCHAR) AS task_id, raw AS text, raw, TRUE AS legacy FROM p""")
def project_without_layout(spark, sf_dir):
    """Pages without layout stay as they are, a blank line between them."""
    t = _turns(spark, sf_dir).groupBy("task_id", "page_index").agg(F.min("text").alias("text")).withColumn("task_id", F.col("task_id").cast("string"))
    none = spark.createDataFrame([], "task_id string, page_index int, block_ord int, text string, box array<double>, direction string, font_size double, role string")
    heads = t.groupBy("task_id").agg(F.count("*").cast("int").alias("selected"))
    sheets = t.withColumns({"raw_text": F.col("text"), "schema_version": F.lit(None).cast("int"), "height": F.lit(800.0), "ruby_enabled": F.lit(False)})
    return projection.project(heads, projection.nested_pages(sheets, none)).select("task_id", "text", "raw", "legacy")


# --- glosses and glyphs ---

_RUBY_LINES = "task_id string, page_index int, block_ord int, text string, box array<double>, font_size double, direction string, candidate boolean, chars array<struct<text:string,box:array<double>,offset:int>>"
_BODY = ("薔薇色", [10.0, 30.0, 70.0, 50.0], 20.0)
BINDINGS = {
    "across": [(*_BODY, "horizontal"), ("ばらいろ", [10.0, 18.0, 70.0, 27.0], 9.0, "horizontal")],
    "down": [("薔薇色", [10.0, 10.0, 30.0, 70.0], 20.0, "vertical"), ("ばらいろ", [33.0, 10.0, 42.0, 70.0], 9.0, "vertical")],
    "taken": [("本文", [10.0, 30.0, 50.0, 50.0], 20.0, "horizontal"), ("よみ", [10.0, 18.0, 50.0, 27.0], 9.0, "horizontal"), ("別", [10.0, 18.0, 30.0, 27.0], 9.0, "horizontal"), ("孤立", [300.0, 300.0, 330.0, 309.0], 9.0, "horizontal", True)],
    "part": [(*_BODY, "horizontal"), ("ば", [30.0, 18.0, 50.0, 27.0], 9.0, "horizontal")],
    "exact": [(*_BODY, "horizontal", False, [(c, [10.0 + 20 * i, 30.0, 30.0 + 20 * i, 50.0], i) for i, c in enumerate("薔薇色")]), ("いろ", [50.0, 18.0, 70.0, 27.0], 9.0, "horizontal")],
    "nearest": [("上の行", [10.0, 60.0, 70.0, 80.0], 20.0, "horizontal"), ("下の行", [10.0, 52.0, 70.0, 72.0], 20.0, "horizontal"), ("よみ", [10.0, 40.0, 70.0, 49.0], 9.0, "horizontal")],
    "too large": [(*_BODY, "horizontal"), ("大きい", [10.0, 14.0, 70.0, 29.0], 15.0, "horizontal")],
}
_BOUND = [
    ("across", 0, "body", "", "0:3:ばらいろ:estimated"), ("across", 1, "ruby", "0", ""), ("down", 0, "body", "", "0:3:ばらいろ:estimated"), ("down", 1, "ruby", "0", ""),
    ("taken", 0, "body", "", "0:2:よみ:estimated"), ("taken", 1, "ruby", "0", ""), ("taken", 2, "ruby-unmatched", "", ""), ("taken", 3, "ruby-unmatched", "", ""),
    ("part", 0, "body", "", "1:2:ば:estimated"), ("part", 1, "ruby", "0", ""), ("exact", 0, "body", "", "2:3:いろ:characters"), ("exact", 1, "ruby", "0", ""),
    ("nearest", 0, "body", "", ""), ("nearest", 1, "body", "", "0:3:よみ:estimated"), ("nearest", 2, "ruby", "1", ""), ("too large", 0, "body", "", ""), ("too large", 1, "body", "", ""),
]


@case(values("task_id VARCHAR, block_ord INTEGER, role VARCHAR, parent VARCHAR, glosses VARCHAR", _BOUND))
def binding_cases(spark, sf_dir):
    rows = [(t, 0, i, x[0], x[1], x[2], x[3], x[4] if len(x) > 4 else False, x[5] if len(x) > 5 else None) for t, lines in BINDINGS.items() for i, x in enumerate(lines)]
    text = F.transform("ruby", lambda r: F.concat_ws(":", r["start"].cast("string"), r["end"].cast("string"), r["text"], r["alignment"]))
    return ruby.bound(spark.createDataFrame(rows, _RUBY_LINES)).select("task_id", "block_ord", "role", F.coalesce(F.col("parent").cast("string"), F.lit("")).alias("parent"), F.array_join(text, ",").alias("glosses"))


@query("""
    WITH i AS (SELECT l_suppkey, l_orderkey * 10 + l_linenumber AS k, min(l_partkey) AS p FROM lineitem GROUP BY ALL),
    n AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY k) - 1 AS r FROM i)
    SELECT CAST(l_suppkey AS VARCHAR) AS task_id, count(*) AS blocks, count(*) FILTER (WHERE r % 2 = 1 AND p % 3 > 0) AS glosses, count(*) FILTER (WHERE r % 2 = 1 AND p % 3 = 0) AS plain FROM n GROUP BY l_suppkey""")
def ruby_page_binding(spark, sf_dir):
    """Every line item a line, hundreds to a page: each odd one stands over the even one before it, unless it is set too far off."""
    dealt = _table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").cast("string").alias("task_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("k"), "l_partkey").repartition("task_id")  # the only shuffle
    i = dealt.groupBy("task_id", "k").agg(F.min("l_partkey").alias("p"))
    r = i.withColumn("r", F.row_number().over(Window.partitionBy("task_id").orderBy("k")) - 1)
    small = F.col("r") % 2 == 1
    y = F.floor(F.col("r") / 2) * 60.0 + F.when(small & (F.col("p") % 3 > 0), -10.0).when(small, -32.0).otherwise(0.0)
    h = F.when(small, 9.0).otherwise(20.0)
    lines = r.select("task_id", F.lit(0).alias("page_index"), F.col("r").cast("int").alias("block_ord"), F.lit("text").alias("text"), F.array(F.lit(10.0), y, F.lit(90.0), y + h).alias("box"), F.lit("horizontal").alias("direction"), h.alias("font_size"))
    return ruby.bound_pages(lines).groupBy("task_id").agg(F.count("*").alias("blocks"), F.count_if(F.col("role") == "ruby").alias("glosses"), F.count_if((F.col("role") == "body") & (F.col("block_ord") % 2 == 1)).alias("plain"))


_GLYPHS = {
    "down": [(c, 10.0, 10.0 + 20 * i, 18.0) for i, c in enumerate("日本語")],
    "across": [("a", 0.0, 0.0, 20.0), ("b", 22.0, 1.0, 20.0), ("c", 50.0, 0.0, 20.0), ("d", 120.0, 0.0, 20.0), ("e", 0.0, 60.0, 20.0), (" ", 0.0, 120.0, 20.0)],
    "kanji": [("漢", 0.0, 0.0, 20.0), ("字", 26.0, 0.0, 20.0), ("x", 52.0, 0.0, 20.0), ("1", 78.0, 0.0, 20.0)],
    "sizes": [("大", 0.0, 0.0, 20.0), ("小", 24.0, 5.0, 10.0)],
}


def _glyph_rows(spark):
    rows = [(t, 0, i, c, [x, y, x + s, y + s], s) for t, gs in _GLYPHS.items() for i, (c, x, y, s) in enumerate(gs)]
    return spark.createDataFrame(rows, "task_id string, page_index int, ord int, text string, box array<double>, size double")


@case(values("task_id VARCHAR, block_ord INTEGER, text VARCHAR, direction VARCHAR, box VARCHAR, font_size DOUBLE, offsets VARCHAR", [
    ("down", 0, "日本語", "vertical", "10.0,10.0,28.0,68.0", 18.0, "0,1,2"), ("across", 0, "ab c", "horizontal", "0.0,0.0,70.0,21.0", 20.0, "0,1,3"), ("across", 1, "d", "horizontal", "120.0,0.0,140.0,20.0", 20.0, "0"), ("across", 2, "e", "horizontal", "0.0,60.0,20.0,80.0", 20.0, "0"),
    ("kanji", 0, "漢字x 1", "horizontal", "0.0,0.0,98.0,20.0", 20.0, "0,1,2,4"), ("sizes", 0, "大", "horizontal", "0.0,0.0,20.0,20.0", 20.0, "0"), ("sizes", 1, "小", "horizontal", "24.0,5.0,34.0,15.0", 10.0, "0"),
]))
def glyph_line_cases(spark, sf_dir):
    out = ruby.grouped_lines(_glyph_rows(spark))
    return out.select("task_id", "block_ord", "text", "direction", F.array_join(F.transform("box", lambda v: v.cast("string")), ",").alias("box"), "font_size", F.array_join(F.transform("chars", lambda c: c["offset"].cast("string")), ",").alias("offsets"))


@query("""
    WITH g AS (SELECT p_partkey, p_name, length(p_name) AS n, p_partkey % 2 AS down FROM part)
    SELECT CAST(p_partkey AS VARCHAR) AS task_id, CASE down WHEN 1 THEN 'vertical' ELSE 'horizontal' END AS direction, replace(p_name, ' ', '') AS text FROM g""")
def glyph_directions(spark, sf_dir):
    """Part names set glyph by glyph, every second one downwards; the blanks aren't glyphs. One line each."""
    p = _table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("task_id"), (F.col("p_partkey") % 2 == 1).alias("down"), F.posexplode(F.split(F.replace("p_name", F.lit(" ")), "")).alias("ord", "text"))
    a = F.col("ord") * 10.0
    x, y = F.when(F.col("down"), 50.0).otherwise(a), F.when(F.col("down"), a).otherwise(50.0)
    return ruby.grouped_lines(p.select("task_id", F.lit(0).alias("page_index"), "ord", "text", F.array(x, y, x + 10, y + 10).alias("box"), F.lit(10.0).alias("size"))).select("task_id", "direction", "text")


@query("""
    WITH g AS (SELECT conv_id * 100 + turn AS line_id, unnest(range(length(text))) AS ord, text FROM conversations),
    c AS (SELECT line_id, ord, substr(text, CAST(ord AS INTEGER) + 1, 1) AS ch, ord * 10 + (ord // 7) * 5 + (ord // 31) * 40 AS s FROM g),
    l AS (SELECT *, s - lag(s + 9) OVER w AS gap, lag(ch) OVER w AS pc FROM c WINDOW w AS (PARTITION BY line_id ORDER BY ord)),
    t AS (SELECT *, sum(CASE WHEN gap > 17 THEN 1 ELSE 0 END) OVER (PARTITION BY line_id ORDER BY ord) AS segment, CASE WHEN gap > 2.2 AND gap <= 17 AND pc <> ' ' AND ch <> ' ' AND ascii(pc) < 128 AND ascii(ch) < 128 THEN 1 ELSE 0 END AS lead FROM l)
    SELECT line_id, CAST(segment AS BIGINT) AS segment, CAST(max(o) AS INTEGER) AS last_offset FROM (SELECT *, sum(lead + 1) OVER (PARTITION BY line_id, segment ORDER BY ord) - 1 AS o FROM t) GROUP BY line_id, segment""")
def glyph_offsets(spark, sf_dir):
    turns = _table(spark, sf_dir, "conversations").filter("text <> ''")
    docs = turns.select((F.col("conv_id") * 100 + F.col("turn")).alias("line_id"), F.posexplode(F.split("text", "")).alias("ord", "text"))
    s = F.col("ord") * 10 + F.floor(F.col("ord") / 7) * 5 + F.floor(F.col("ord") / 31) * 40
    return ruby.segments(docs.withColumns({"start": s, "end": s + 9, "size": F.lit(10.0)})).groupBy("line_id", "segment").agg(F.max("offset").alias("last_offset"))


@query(f"""
    WITH l0 AS (SELECT doc_id AS task_id, string_split(text, chr(10)) AS parts FROM documents), l AS (SELECT task_id, unnest(range(len(parts))) AS ord, unnest(parts) AS text FROM l0),
    w AS (SELECT task_id, CASE ord % 3 WHEN 0 THEN 'vertical' ELSE 'horizontal' END AS direction, sum(length(text) * length(text)) AS weight FROM l WHERE length(text) >= 3 GROUP BY ALL)
    SELECT task_id, arg_max(direction, (weight, direction)) AS direction FROM w GROUP BY task_id""")
def page_axis(spark, sf_dir):
    lines = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("task_id"), F.posexplode(F.split("text", "\n", -1)).alias("ord", "text"))
    lines = lines.select("task_id", F.lit(0).alias("page_index"), F.when(F.col("ord") % 3 == 0, "vertical").otherwise("horizontal").alias("direction"), "text")
    return ruby.dominant_axis(lines).select("task_id", "direction")


@case(values("reading INTEGER", [(1,), (3,), (4,)]))
def kept_reading_cases(spark, sf_dir):
    """Readings on a long line of their direction go: overlaps of more than 0.3 of the reading across the line."""
    readings = spark.createDataFrame([("t", 0, "horizontal", 0, [0.0, 12.0, 50.0, 22.0]), ("t", 0, "horizontal", 1, [0.0, 0.0, 50.0, 10.0]), ("t", 0, "horizontal", 2, [0.0, 6.0, 50.0, 16.0]), ("t", 0, "vertical", 3, [0.0, 12.0, 50.0, 22.0]), ("t", 1, "horizontal", 4, [0.0, 12.0, 50.0, 22.0])], "task_id string, page_index int, direction string, reading int, box array<double>")
    bodies = spark.createDataFrame([("t", 0, "horizontal", "六文字以上の行", [0.0, 10.0, 200.0, 30.0]), ("t", 1, "horizontal", "短い行", [0.0, 10.0, 200.0, 30.0])], "task_id string, page_index int, direction string, text string, box array<double>")
    return ruby.kept_readings(readings, bodies).select("reading")


@case(values("x DOUBLE, y DOUBLE", [(0.0, 0.0), (50.0, 0.0), (9.0, 30.0)]))
def region_cases(spark, sf_dir):
    kept = ruby.distinct_regions([[0.0, 0.0, 1, 1], [5.0, 5.0, 6, 6], [50.0, 0.0, 51, 1], [9.0, 9.0, 10, 10], [9.0, 30.0, 10, 31]], 10)
    return spark.createDataFrame([(r[0], r[1]) for r in kept], "x double, y double")


@case(values("page_index INTEGER, visible BIGINT", [(0, 3)]))
def text_layer_cases(spark, sf_dir):
    """Only the first page's embedded text can be used: the others are turned, cropped, covered, unreadable, empty or too short."""
    sheets = [(0, 0, False, 0.01), (1, 90, False, 0.0), (2, 0, True, 0.0), (3, 0, False, 0.026), (4, 0, False, None), (5, 0, False, None), (6, 0, False, None), (7, 0, False, None)]
    glyphs = [(p, ord(c), c, [0.0, 0.0, 5.0, 5.0], 5.0) for p in (0, 1, 2, 3, 5) for c in "ab c\n"] + [(4, 0xFFFD, "�", [0.0, 0.0, 5.0, 5.0], 5.0)] + [(4, ord(c), c, [0.0, 0.0, 5.0, 5.0], 5.0) for c in "abc"]
    glyphs += [(5, ord("d"), "d", [0.0, 0.0, 0.0, 5.0], 5.0), (6, ord("e"), "e", [0.0, 0.0, 5.0, 5.0], 5.0)]
    out = ruby.text_layer_pages(
        spark.createDataFrame([("t", *g) for g in glyphs], "task_id string, page_index int, code int, text string, box array<double>, size double"),
        spark.createDataFrame([("t", *s) for s in sheets], "task_id string, page_index int, rotation int, cropped boolean, image_share double"),
    )
    return out.select("page_index", "visible")


# --- geometry ---


@query("""
    WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
    b AS (SELECT vec_id, [least(e[1], e[2]), least(e[3], e[4]), greatest(e[1], e[2]), greatest(e[3], e[4])] AS p, [least(e[5], e[6]), least(e[7], e[8]), greatest(e[5], e[6]), greatest(e[7], e[8])] AS q FROM v)
    SELECT vec_id, round(least(p[3], q[3]) - greatest(p[1], q[1]), 6) AS across, round(least(p[4], q[4]) - greatest(p[2], q[2]), 6) AS down, round((p[3] - p[1]) * (p[4] - p[2]) / 8, 6) AS share,
      CASE WHEN p[4] - p[2] > (p[3] - p[1]) * 1.8 THEN 'vertical' ELSE 'horizontal' END AS direction, round(least(p[3] - p[1], p[4] - p[2]), 6) AS font_size FROM b""")
def box_measures(spark, sf_dir):
    e = F.col("e")
    pair = lambda i: F.array(F.least(e[i], e[i + 1]), F.least(e[i + 2], e[i + 3]), F.greatest(e[i], e[i + 1]), F.greatest(e[i + 2], e[i + 3]))
    b = _table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e")).select("vec_id", pair(0).alias("p"), pair(4).alias("q"))
    p, q = F.col("p"), F.col("q")
    r = lambda c: F.round(c, 6)
    return b.select("vec_id", r(G.overlap(p, q, 0)).alias("across"), r(G.overlap(p, q, 1)).alias("down"), r(G.area_share(p, F.lit(2.0), F.lit(4.0))).alias("share"), G.direction(p).alias("direction"), r(G.font_size(p)).alias("font_size"))


@case(values("id INTEGER, box VARCHAR", [(0, "1.0,2.0,3.0,4.0"), (1, "0.0,1.0,5.0,9.0"), (2, ""), (3, "0.0,1.0,5.0,9.0")]))
def block_bound_cases(spark, sf_dir):
    polygon = [[0.0, 1.0], [5.0, 2.0], [4.0, 9.0]]
    rows = [(0, [1.0, 2.0, 3.0, 4.0], polygon), (1, [1.0, 2.0], polygon), (2, [], []), (3, [1.0, float("nan"), 3.0, 4.0], polygon)]
    df = spark.createDataFrame(rows, "id int, box array<double>, polygon array<array<double>>")
    return df.select("id", F.array_join(F.transform(G.block_bounds(F.col("box"), F.col("polygon")), lambda v: v.cast("string")), ",").alias("box"))


# --- pages, queue and store ---

_BAD_RANGES = ["0", "-1", "3-1", "11", "1,,2", "1,", "1.5", "1-999999999", "a", "1-2-3", "1234567890", "2" * 2001]


@case(values("value VARCHAR, selected VARCHAR, reason VARCHAR", [*((v, None, "too-long" if len(v) > 2000 else "bad-token") for v in _BAD_RANGES), ("8， 3-5,1,3", "0,2,3,4,7", None), ("10-10", "9", None)]))
def page_range_cases(spark, sf_dir):
    """Invalid ranges have a reason; none is filtered away."""
    df = spark.createDataFrame([("a.pdf", v, 10) for v in [*_BAD_RANGES, "8， 3-5,1,3", "10-10"]], "path string, page_range string, total int")
    return pages.selected_pages(df).select(F.col("page_range").alias("value"), F.array_join(F.transform("selected", lambda p: p.cast("string")), ",").alias("selected"), F.col("range_error").alias("reason"))


@query("""
    WITH t AS (SELECT o_orderkey AS id, 1 + o_custkey % 9 AS n, o_orderkey % 4 AS done, o_orderkey % 5 = 0 AS skips FROM orders)
    SELECT id AS task_id, CASE WHEN NOT skips AND done <= n THEN array_to_string(list_transform(range(done, n), lambda p: CAST(p * 2 AS VARCHAR)), ',') END AS pending FROM t""")
def resume_prefixes(spark, sf_dir):
    """Every second page is selected; done pages must be the first of them."""
    n, done = 1 + F.col("o_custkey") % 9, (F.col("o_orderkey") % 4).cast("int")
    selected = F.transform(F.sequence(F.lit(0), (n - 1).cast("int")), lambda p: p * 2)
    first = F.when(done > 0, F.transform(F.sequence(F.lit(0), F.greatest(done - 1, F.lit(0))), lambda p: p * 2)).otherwise(F.array().cast("array<int>"))
    completed = F.when(F.col("o_orderkey") % 5 == 0, F.array(F.lit(1))).otherwise(first)
    t = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("task_id"), selected.alias("s"), completed.alias("c"))
    return t.select("task_id", F.array_join(F.transform(X.resume_prefix(F.col("s"), F.col("c")), lambda p: p.cast("string")), ",").alias("pending"))


_SCANS = """
    f AS (SELECT o_orderkey AS id, 'scans/' || o_orderkey || CASE o_orderkey % 3 WHEN 0 THEN '.PDF' WHEN 1 THEN '.png' ELSE '.pdf' END AS path, 1 + o_custkey % 12 AS total, CASE o_custkey % 4 WHEN 0 THEN '' WHEN 1 THEN '1' WHEN 2 THEN '2-3' ELSE 'x' END AS page_range FROM orders)"""


def _scans(spark, sf_dir):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    path = F.concat(F.lit("scans/"), k.cast("string"), F.when(k % 3 == 0, ".PDF").when(k % 3 == 1, ".png").otherwise(".pdf"))
    chosen = F.when(c % 4 == 0, "").when(c % 4 == 1, "1").when(c % 4 == 2, "2-3").otherwise("x")
    return _table(spark, sf_dir, "orders").select(k.alias("task_id"), path.alias("path"), (1 + c % 12).cast("int").alias("total"), chosen.alias("page_range"))


def _disk(spark, sf_dir):
    """A listing of every second file."""
    return _scans(spark, sf_dir).filter("task_id % 2 = 0").select("path", (F.col("task_id") * 10).alias("length"), F.col("task_id").alias("modification_time"))


@query(f"""
    WITH {_SCANS} SELECT id AS task_id, total, CASE page_range WHEN '' THEN total WHEN '1' THEN 1 WHEN '2-3' THEN CASE WHEN total >= 3 THEN 2 ELSE -1 END ELSE -1 END AS selected_count,
      CASE WHEN page_range = 'x' OR (page_range = '2-3' AND total < 3) THEN 'bad-token' END AS range_error, CASE WHEN id % 2 = 0 THEN id * 10 ELSE -1 END AS source_size FROM f WHERE lower(path) LIKE '%.pdf'""")
def document_facts(spark, sf_dir):
    return pages.document_info(_scans(spark, sf_dir), _disk(spark, sf_dir)).select("task_id", "total", "selected_count", "range_error", "source_size").fillna(-1, ["selected_count", "source_size"])


@query(f"WITH {_SCANS} SELECT id AS task_id, CAST(CASE WHEN lower(path) LIKE '%.pdf' THEN total ELSE 1 END AS INTEGER) AS pages FROM f")
def document_page_count(spark, sf_dir):
    return _scans(spark, sf_dir).select("task_id", pages.page_count(F.col("path"), F.col("total")).alias("pages"))


@query(f"WITH {_SCANS} SELECT id AS task_id, path, id % 2 = 0 AS \"exists\", CASE WHEN id % 2 = 0 THEN id * 10 ELSE -1 END AS length FROM f")
def path_checks(spark, sf_dir):
    return queue.checked_paths(_scans(spark, sf_dir), _disk(spark, sf_dir)).select("task_id", "path", "exists", "length").fillna(-1, ["length"])


@query("""
    SELECT o_orderkey AS task_id, CASE o_orderstatus WHEN 'P' THEN 'queued' ELSE o_orderstatus END AS status, o_orderstatus = 'P' AS partial, o_orderstatus = 'P' AS resume_eligible, length(repeat('1,', CAST(1 + o_custkey % 2000 AS BIGINT))) > 2000 AS long,
      least(2 * (1 + o_custkey % 2000), 2000) AS range_length FROM orders""")
def restored_tasks(spark, sf_dir):
    """Tasks in work are queued again; page ranges are cut to 2000 characters."""
    work = F.when(F.col("o_orderstatus") == "P", F.when(F.col("o_orderkey") % 2 == 0, "running").otherwise("paused")).otherwise(F.col("o_orderstatus"))
    t = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("task_id"), F.lit("/scan").alias("path"), work.alias("status"), F.repeat(F.lit("1,"), (1 + F.col("o_custkey") % 2000).cast("int")).alias("page_range"))
    out = queue.restored(t.withColumn("was", F.length("page_range")))
    return out.select(F.col("task_id").cast("long").alias("task_id"), "status", "partial", "resume_eligible", (F.col("was") > 2000).alias("long"), F.length("page_range").cast("long").alias("range_length"))


@query("""
    WITH p AS (SELECT conv_id, turn, min(text) AS text FROM conversations GROUP BY ALL)
    SELECT CAST(conv_id AS VARCHAR) AS task_id, CASE WHEN conv_id % 3 = 0 THEN 'own' ELSE coalesce(string_agg(text, chr(10) || chr(10) ORDER BY turn) FILTER (WHERE text <> ''), '') END AS text, CAST(count(*) AS INTEGER) AS page_count, TRUE AS partial,
      CASE WHEN conv_id % 3 = 0 THEN 'own' END AS header_text FROM p GROUP BY conv_id""")
def begun_results(spark, sf_dir):
    """Results at the start of a run, and what the store keeps of them in front: text only where it has been edited."""
    t = _turns(spark, sf_dir).withColumn("task_id", F.col("task_id").cast("string")).groupBy("task_id", "page_index").agg(F.min("text").alias("text")).withColumns({"n_blocks": F.lit(1), "n_tables": F.lit(0)})
    edited = F.col("task_id").cast("long") % 3 == 0
    none = {n: F.lit(None).cast(k) for n, k in (("profile", "string"), ("result_type", "string"), ("task_mode", "string"), ("edited_pages", "int"), ("total_count", "int"), ("selected_count", "int"), ("rotation", "int"), ("elapsed_ms", "int"))}
    heads = t.select("task_id").distinct().withColumns({**none, "text": F.when(edited, "own"), "text_edited": edited})
    out = pages.begun(heads.select("task_id", "text_edited", "selected_count"), heads, t)
    stored = pages.headers(out).select("task_id", F.col("text").alias("header_text"))
    return out.join(stored, "task_id").select("task_id", "text", "page_count", "partial", "header_text")


@query("SELECT l_orderkey AS task_id, min(l_discount) AS least FROM lineitem GROUP BY l_orderkey UNION ALL SELECT -1, 0.0")
def reading_scores(spark, sf_dir):
    """The least score of a reading's blocks; 0 where there is none."""
    s = _table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("task_id")).agg(F.collect_list("l_discount").alias("s"))
    none = spark.range(1).select(F.lit(-1).cast("long").alias("task_id"), F.array().cast("array<double>").alias("s"))
    return s.union(none).select("task_id", pages.least_score(F.col("s")).alias("least"))


@query("""
    SELECT 'current' AS scope, count(*) FILTER (WHERE o_orderkey = (SELECT min(o_orderkey) FROM orders)) AS tasks FROM orders UNION ALL SELECT 'checked', count(*) FILTER (WHERE o_custkey % 3 = 0) FROM orders UNION ALL SELECT 'all', count(*) FROM orders""")
def export_scopes(spark, sf_dir):
    t = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("task_id"), (F.col("o_custkey") % 3 == 0).alias("checked"))
    first = t.agg(F.min("task_id")).first()[0]
    out = [queue.export_scope(t, s, first).agg(F.count("*").alias("tasks")).select(F.lit(s).alias("scope"), "tasks") for s in ("current", "checked", "all")]
    return out[0].union(out[1]).union(out[2])


@query("""
    WITH n AS (SELECT o_orderkey AS id, row_number() OVER (ORDER BY o_orderkey) - 1 AS place, o_orderstatus FROM orders), m AS (SELECT id, CASE place WHEN 100 THEN 7 ELSE CASE WHEN place BETWEEN 7 AND 99 THEN place + 1 ELSE place END END AS place, o_orderstatus FROM n)
    SELECT 'next' AS kind, id AS task_id, place FROM (SELECT * FROM m WHERE o_orderstatus = 'P' ORDER BY place LIMIT 1) UNION ALL SELECT 'moved', id, place FROM m""")
def moved_queue(spark, sf_dir):
    """The hundredth task is moved to place 7; the next one in the queue is the first in its status."""
    t = numbered(_table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("task_id"), "o_orderkey", F.when(F.col("o_orderstatus") == "P", "queued").otherwise("done").alias("status")), "place", "o_orderkey")
    mover = t.filter("place = 100").first()["task_id"]
    m = queue.moved(t, mover, 7)
    one = lambda df, kind: df.select(F.lit(kind).alias("kind"), F.col("task_id").cast("long").alias("task_id"), F.col("place").cast("long").alias("place"))
    return one(queue.next_task(m), "next").union(one(m, "moved"))


@query("SELECT n AS step, (SELECT count(*) FROM orders WHERE o_orderkey % 10 = n AND o_orderstatus = 'P') = 0 AS deletable FROM range(10) g(n)")
def delete_guard(spark, sf_dir):
    t = _tasks(spark, sf_dir).select("task_id", "status")
    active, out = t.filter("status = 'P'"), None
    for step in range(10):
        one = queue.deletable(t.filter(F.col("task_id") % 10 == step), active).select(F.lit(step).cast("long").alias("step"), "deletable")
        out = one if out is None else out.union(one)
    return out


@case("SELECT 2 * n AS entries, greatest(1, CAST(ceil(2 * n / 20.0) AS BIGINT)) AS pages FROM range(50) r(n)")
def history_page_counts(spark, sf_dir):
    return spark.range(50).select((F.col("id") * 2).alias("entries"), queue.history_pages(F.col("id") * 2).cast("long").alias("pages"))


@query("""
    WITH c AS (SELECT conv_id, turn, min(text) AS text FROM conversations WHERE conv_id = (SELECT max(conv_id) FROM conversations) GROUP BY ALL)
    SELECT CAST(conv_id AS VARCHAR) AS task_id, CAST(turn AS INTEGER) AS page_index, text, 'f' || conv_id AS file_name FROM c""")
def history_entry_pages(spark, sf_dir):
    p = _turns(spark, sf_dir).withColumn("task_id", F.col("task_id").cast("string")).groupBy("task_id", "page_index").agg(F.min("text").alias("text"))
    history = p.select("task_id").distinct().withColumn("file_name", F.concat(F.lit("f"), "task_id"))
    last = str(_turns(spark, sf_dir).agg(F.max("task_id")).first()[0])
    return queue.history_entry(history, p, last).select("task_id", "file_name", F.inline("pages"))


@query("""
    WITH p AS (SELECT conv_id, turn, min(text) AS text FROM conversations GROUP BY ALL),
    k AS (SELECT *, CASE WHEN conv_id % 4 = 1 AND turn >= 2 THEN 'again ' || text ELSE text END AS now FROM p WHERE NOT (conv_id % 4 = 2 AND turn < 3) AND conv_id % 4 <> 3)
    SELECT CAST(conv_id AS VARCHAR) AS task_id, CAST(count(*) AS INTEGER) AS pages, CAST(sum(length(now)) AS BIGINT) AS chars, arg_min(now, turn) AS first_text FROM k GROUP BY conv_id
    UNION ALL SELECT CAST(conv_id AS VARCHAR), 0, 0, NULL FROM p WHERE conv_id % 4 = 2 GROUP BY conv_id HAVING max(turn) < 3""")
def store_round_trip(spark, sf_dir):
    """A store is written three times: pages overlaid (residue 1), reset to later pages (2), tasks gone with their pages (3); a writer of an old version fails."""
    store = Store(spark, folder(spark, "store"))
    p = _turns(spark, sf_dir).withColumn("task_id", F.col("task_id").cast("string")).groupBy("task_id", "page_index").agg(F.min("text").alias("text"))
    p = p.withColumn("text", F.coalesce("text", F.lit("")))
    rest = F.col("task_id").cast("long") % 4
    heads = p.select("task_id").distinct()
    first = store.save(heads, p, None)
    second = store.save(heads, p.filter((rest == 1) & (F.col("page_index") >= 2)).withColumn("text", F.concat(F.lit("again "), "text")).union(p.filter((rest == 2) & (F.col("page_index") >= 3))), first, reset=heads.filter(rest == 2))
    try:
        store.save(heads, p, first)
        raise AssertionError("a writer of an old version was let through")
    except Conflict:
        pass
    store.remove(heads.filter(rest == 3), heads.limit(0), second)
    out = store.load()
    return out.select("task_id", F.size("pages").alias("pages"), F.aggregate("pages", F.lit(0).cast("long"), lambda a, x: a + F.length(x["text"])).alias("chars"), F.get("pages", F.lit(0))["text"].alias("first_text"))


@query("""
    WITH p AS (SELECT conv_id, turn, min(text) AS text, CAST(conv_id AS INTEGER) + turn AS k FROM conversations GROUP BY ALL)
    SELECT CAST(conv_id AS VARCHAR) AS task_id, CAST(turn AS INTEGER) AS page_index, 'save ' || CASE WHEN k % 2 = 0 THEN 4 WHEN k % 3 = 0 THEN 3 WHEN k % 5 = 0 THEN 2 ELSE 1 END AS text FROM p""")
def save_chain(spark, sf_dir):
    """Five saves of ever fewer pages, three of which fail at first: all pages arrive, and none over a newer one."""
    at = folder(spark, "chain")
    store = Store(spark, f"{at}/store")
    chain, good = SaveChain(store, f"{at}/log"), store.save
    p = _turns(spark, sf_dir).withColumn("task_id", F.col("task_id").cast("string")).groupBy("task_id", "page_index").agg(F.count("*").alias("n")).drop("n")
    k, heads = F.col("task_id").cast("int") + F.col("page_index"), p.select("task_id").distinct()
    steps = [F.lit(True), F.lit(True), k % 5 == 0, k % 3 == 0, k % 2 == 0]

    def broken(*args, **more):
        raise OSError("the folder can't be reached")

    for i, part in enumerate(steps):
        store.save = broken if i in (0, 2, 3) else good
        try:
            chain.save(heads, p.filter(part).withColumns({"text": F.lit(f"save {i}"), "arrival": F.lit(i).cast("long")}))
        except OSError:
            assert i in (0, 2, 3)
    assert not chain.pending()
    return store.pages().select("task_id", "page_index", "text")


@query("SELECT 'refused' AS outcome, count(DISTINCT conv_id) AS tasks FROM conversations UNION ALL SELECT 'removed', count(DISTINCT conv_id) FILTER (WHERE conv_id % 2 = 0) FROM conversations")
def history_deletion(spark, sf_dir):
    """Entries that are in the queue can't be deleted; the others can."""
    store = Store(spark, folder(spark, "history"), "history")
    p = _turns(spark, sf_dir).withColumn("task_id", F.col("task_id").cast("string")).groupBy("task_id", "page_index").agg(F.min("text").alias("text"))
    heads = p.select("task_id").distinct()
    odd = heads.filter(F.col("task_id").cast("long") % 2 == 1)
    version = store.save(heads, p, None)
    try:
        store.remove(odd, odd, version)
    except ValueError:
        left = store.headers()
        before = left.agg(F.count("*").alias("tasks")).select(F.lit("refused").alias("outcome"), "tasks")
    store.remove(odd, heads.limit(0), version)
    return before.union(store.headers().agg(F.count("*").alias("tasks")).select(F.lit("removed").alias("outcome"), "tasks"))


@case(values("installed BOOLEAN, size_bytes BIGINT, models BIGINT, installed_models BIGINT", [(False, 21, 4, 1)]))
def cache_total(spark, sf_dir):
    required = queue.required_models(spark.createDataFrame([("fast", "table")], "profile string, mode string"))
    return queue.cache_totals(queue.model_states(required, spark.createDataFrame(_FILES, "name string, file string, size long")))


_PACK = {"schema": 2, "runtime": "r", "capabilities": [{"profile": "fast", "mode": "text"}, {"profile": "fast", "mode": "text"}], "files": [{"path": "a/inference.yml", "size": 3, "sha256": "x"}]}


@case(values("kind VARCHAR, first VARCHAR, second VARCHAR, failed BIGINT", [("capability", "fast", "text", 3), ("file", "a/inference.yml", "x", 3)]))
def pack_manifests(spark, sf_dir):
    """Capabilities and files of a pack; three manifests of another kind fail."""
    read = lambda text: queue.manifest(spark.createDataFrame([(text,)], "json string"), 2, "r")
    failed = 0
    for bad in (json.dumps(_PACK | {"schema": 1}), json.dumps(_PACK | {"capabilities": []}), '{"schema": 2, "files": "no"}'):
        try:
            read(bad)[1].collect()
        except Exception:  # noqa: BLE001
            failed += 1
    caps, entries = read(json.dumps(_PACK))
    n = F.lit(failed).cast("long").alias("failed")
    return caps.select(F.lit("capability").alias("kind"), F.col("profile").alias("first"), F.col("mode").alias("second"), n).union(entries.select(F.lit("file"), "path", "sha256", n))


@case(values("app_version VARCHAR, profile VARCHAR, mode VARCHAR", [("1", "fast", None), ("2", None, "table")]))
def safe_reports(spark, sf_dir):
    """Only fields that may leave the machine; values outside their domain are blanked."""
    r = spark.createDataFrame([("1", "fast", "secret", "/home/x"), ("2", "C:\\x", "table", "y")], "app_version string, profile string, mode string, path string")
    return queue.safe_report(r)


@case(values("free BIGINT, enough BOOLEAN", [(67108864, True), (67108863, False)]))
def space_checks(spark, sf_dir):
    df = spark.createDataFrame([(67108864,), (67108863,)], "free long")
    return df.select("free", queue.enough_space(F.col("free"), F.lit(0)).alias("enough"))


@case(values("given VARCHAR, mode VARCHAR, ruby VARCHAR, source VARCHAR, cross_page BOOLEAN", [("default", "smart", "parentheses", "auto", True), ("valid", "continuous", "ruby", "ocr", False), ("odd", "smart", "parentheses", "auto", True)]))
def text_settings(spark, sf_dir):
    """Settings outside their domains become the defaults."""
    given = {"default": TextSettings(), "valid": TextSettings("ocr", True, "ruby", "continuous", False), "odd": TextSettings("pdf", "yes", "bold", "fast", "no")}
    rows = [(k, s.text_mode, s.ruby_format, s.pdf_source, s.cross_page) for k, s in ((k, s.normalised()) for k, s in given.items())]
    return spark.createDataFrame(rows, "given string, mode string, ruby string, source string, cross_page boolean")


@case(values("given VARCHAR, formats VARCHAR", [("html,txt,html", "html,txt"), ("", "error"), ("txt,pdf", "error")]))
def format_checks(spark, sf_dir):
    def of(given: str) -> str:
        try:
            return ",".join(exports.checked_formats([f for f in given.split(",") if f]))
        except ValueError:
            return "error"

    return spark.createDataFrame([(g, of(g)) for g in ("html,txt,html", "", "txt,pdf")], "given string, formats string")


# --- tables and payloads ---

_TABLE_JSON = json.dumps({"res": {
    "page_index": 1,
    "overall_ocr_res": {"rec_texts": ["部门", " ", "姓名"], "rec_scores": [0.99, 0.1, 0.98], "rec_polys": [[], [], []], "rec_boxes": [[0, 0, 40, 20], [0, 0, 1, 1], [40, 0, 80, 20]]},
    "layout_det_res": {"boxes": [{"label": "text", "score": 0.5, "coordinate": [9, 9, 9, 9]}, {"label": "Table", "score": 0.91, "coordinate": [0, 0, 80, 41]}]},
    "table_res_list": [
        {"cell_box_list": [[0, 0, 40, 0, 40, 20, 0, 20], [40, 0, 80, 0, 80, 20, 40, 20], [0, 20, 40, 20, 40, 40, 0, 40]], "pred_html": "<table><tr><td rowspan='2'>部门</td><td>姓名</td></tr><tr><td><script>x</script>张三</td></tr></table>"},
        {"cell_box_list": [], "pred_html": "<table><tr><td>无框</td></tr></table>"},
    ],
}})


@case(values("page_index INTEGER, table_index INTEGER, score DOUBLE, box VARCHAR, cells VARCHAR, page_text VARCHAR", [
    (1, 0, 0.91, "0.0,0.0,80.0,40.0", "0:0:部门|0:1:姓名|1:1:x张三", "部门\n姓名"), (1, 1, None, "", "0:0:无框", "部门\n姓名"),
]))
def table_payload(spark, sf_dir):
    """Tables of a recognition payload with their layout's score and the union of their cells' boxes; the page's text, blank readings dropped."""
    raw = spark.createDataFrame([("t", _TABLE_JSON)], "task_id string, payload string")
    found = payloads.tables(raw)
    cells = payloads.cells(found).groupBy("table_index").agg(F.array_sort(F.collect_list(F.struct("row_ord", "cell_ord", F.concat_ws(":", F.col("row").cast("string"), F.col("column").cast("string"), "text").alias("c")))).alias("cs"))
    flat = cells.select("table_index", F.array_join(F.transform("cs", lambda c: c["c"]), "|").alias("cells"))
    box = F.array_join(F.transform("box", lambda v: v.cast("string")), ",").alias("box")
    text = payloads.pages(raw).select("task_id", F.col("text").alias("page_text"))
    return found.select("task_id", "page_index", "table_index", "score", box).join(flat, "table_index").join(text, "task_id").drop("task_id")


def _grid(task, page, table, *rows):
    return [(task, page, table, i, j, i, j, 1, 1, text) for i, row in enumerate(rows) for j, text in enumerate(row)]


_GRID = "task_id string, page_index int, table_index int, row_ord int, cell_ord int, row int, column int, row_span int, col_span int, text string"
_SHEETS = [
    *_grid("chain", 0, 0, ["部门", "姓名"], ["一", "甲"]), *_grid("chain", 1, 0, ["部门", "姓名"], ["二", "乙"]), *_grid("chain", 2, 0, ["部门", "姓名"], ["三", "丙"]),
    *_grid("other", 0, 0, ["部门", "姓名"], ["一", "甲"]), *_grid("other", 1, 0, ["年份", "数量"], ["二", "乙"]),
    *_grid("wide", 0, 0, ["部门", "姓名"], ["一", "甲"]), *_grid("wide", 1, 0, ["部门", "姓名", "电话"], ["二", "乙", "1"]),
    *_grid("apart", 1, 0, ["项目"], ["甲"]), *_grid("apart", 4, 0, ["项目"], ["乙"]), *_grid("apart", 5, 0, ["项目"], ["丙"]),
    *_grid("two", 0, 0, ["项目"], ["甲"]), *_grid("two", 1, 0, ["项目"], ["乙"]), *_grid("two", 1, 1, ["项目"], ["丙"]), *_grid("two", 2, 0, ["项目"], ["丁"]),
    *_grid("near", 0, 0, ["a" * 41 + "b" * 9], ["甲"]), *_grid("near", 1, 0, ["a" * 50], ["乙"]), *_grid("far", 0, 0, ["a" * 40 + "b" * 10], ["甲"]), *_grid("far", 1, 0, ["a" * 50], ["乙"]),
    *_grid("digits", 0, 0, ["Q1 sales"], ["甲"]), *_grid("digits", 1, 0, ["Q2 sales"], ["乙"]),
]


@case(values("task_id VARCHAR, page_index INTEGER, end_page_index INTEGER, sources INTEGER, n_rows INTEGER, last_row INTEGER", [
    ("chain", 0, 2, 3, 4, 3), ("other", 0, 0, 1, 2, 1), ("other", 1, 1, 1, 2, 1), ("wide", 0, 0, 1, 2, 1), ("wide", 1, 1, 1, 2, 1), ("apart", 1, 1, 1, 2, 1), ("apart", 4, 5, 2, 3, 2),
    ("two", 0, 0, 1, 2, 1), ("two", 1, 1, 1, 2, 1), ("two", 2, 2, 1, 2, 1), ("near", 0, 1, 2, 3, 2), ("far", 0, 0, 1, 2, 1), ("far", 1, 1, 1, 2, 1), ("digits", 0, 0, 1, 2, 1), ("digits", 1, 1, 1, 2, 1),
]))
def merge_cases(spark, sf_dir):
    m = tables.merged(spark.createDataFrame(_SHEETS, _GRID)).filter("table_index = 0")
    return m.groupBy("task_id", "page_index", "end_page_index", F.col("source_table_count").alias("sources")).agg(F.count_distinct("row_ord").cast("int").alias("n_rows"), F.max("row").alias("last_row"))


@case(values("task_id VARCHAR, page_index INTEGER, reason VARCHAR", [
    ("other", 1, "no-header"), ("wide", 1, "column-mismatch"), ("apart", 4, "non-consecutive"), ("two", 1, "not-one-table"), ("far", 1, "no-header"), ("digits", 1, "no-header"),
]))
def merge_reasons(spark, sf_dir):
    """All four reasons."""
    return tables.issues(spark.createDataFrame(_SHEETS, _GRID))


@query(f"""
    WITH {_JOINS}, m AS (SELECT conv_id, min(turn) AS first, max(turn) AS last, count(*) AS n FROM s GROUP BY conv_id, run)
    SELECT CAST(conv_id AS VARCHAR) AS task_id, count(*) AS tables, CAST(sum(1 + n) AS BIGINT) AS n_rows FROM m GROUP BY conv_id
    UNION ALL SELECT 'raw ' || conv_id, count(*), 2 * count(*) FROM p GROUP BY conv_id""")
def displayed_tables(spark, sf_dir):
    """Tables to show, merged and as recognised."""
    c = _page_tables(spark, sf_dir)

    def count(df, name):
        return df.groupBy("task_id").agg(F.count_distinct("page_index", "table_index").alias("tables"), F.count_distinct("page_index", "table_index", "row_ord").alias("n_rows")).withColumn("task_id", name)

    return count(tables.displayed(c, True), F.col("task_id")).union(count(tables.displayed(c, False), F.concat(F.lit("raw "), "task_id")))


@query(f"""
    WITH {_ITEM_ROWS}, b AS (SELECT o_custkey AS batch, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS place FROM orders),
    h AS (SELECT DISTINCT task_id FROM i)
    SELECT batch AS task_id, count(*) AS members, CAST(sum(CASE WHEN h.task_id IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS gaps, CAST(max(CASE WHEN h.task_id IS NOT NULL THEN place END) AS INTEGER) AS last_table FROM b LEFT JOIN h ON h.task_id = b.o_orderkey GROUP BY batch""")
def image_batches(spark, sf_dir):
    """Tables of image batches on one sequence of pages; members without tables are gaps."""
    batch = _table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("batch_id"), F.col("o_orderkey").alias("batch_index"), F.col("o_orderkey").alias("task_id"))
    p = tables.batch_positions(batch, _cells(spark, sf_dir))
    return p.groupBy("task_id").agg(F.count_distinct("page_index").alias("members"), F.count_if(F.col("text").isNull() & F.col("row").isNull()).alias("gaps"), F.max(F.when(F.col("row").isNotNull(), F.col("page_index"))).alias("last_table"))


# --- exports ---


@case(values("id INTEGER, safe VARCHAR", [
    (0, "<ruby>薔薇色<rt>ばらいろ</rt></ruby>alert(1)"), (1, '<td rowspan="3">a</td>'), (2, "a"), (3, "<table><tbody><tr><th colspan=\"2\">1&lt;2 &amp; &quot;x&quot;</th></tr></tbody></table>"), (4, "<ruby>a<rt>b</rt></ruby>c"), (5, "bold"), (6, "<td>x</td>"),
]))
def sanitize_cases(spark, sf_dir):
    """Only gloss and table markup stays, without attributes but spans; end tags are matched, open tags closed."""
    rows = ['<ruby onclick="bad()">薔薇色<rt>ばらいろ</rt></ruby><img src="https://example.com"><script>alert(1)</script>', '<td rowspan="3" colspan="0" style=x>a', "</ruby>a</rt>", '<table><tbody><tr><th colspan="2">1&lt;2 &amp; "x"</th></tr></tbody></table>', "<ruby>a<rt>b</rt></ruby>c</ruby>", "<b>bold</b><!-- x -->", '<td rowspan="10001" colspan="-1">x</td>']
    return spark.createDataFrame(list(enumerate(rows)), "id int, html string").select("id", H.sanitized(F.col("html")).alias("safe"))


@query("""
    SELECT page_id, replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;') AS safe FROM pages""")
def sanitize_escaped_pages(spark, sf_dir):
    """Escaped markup is text: it comes out as it went in."""
    return _table(spark, sf_dir, "pages").select("page_id", H.sanitized(X.escape_html(F.col("html"))).alias("safe"))


@query("""
    SELECT doc_id, 'd' || doc_id || '.txt' AS name, sha256(coalesce(text, '')) AS sha256 FROM documents""")
def text_exports(spark, sf_dir):
    d = _table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("in\\d"), "doc_id", F.lit(".pdf")).alias("file_name"), "text")
    return exports.text_files(d, "doc_id").select("doc_id", "name", F.sha2("content", 256).alias("sha256"))


@query("""
    WITH i AS (SELECT o_orderkey AS id, 'f' || o_orderkey AS f, o_orderkey % 3 = 0 AS tab, o_orderkey % 4 = 0 AS grid FROM orders),
    b AS (SELECT 'txt' AS format, 0 AS late, id, '—— ' || f || ' ——' || chr(10) || 'text of ' || id AS body FROM i UNION ALL SELECT 'html', 0, id, f || chr(10) || 'text of ' || id FROM i WHERE NOT tab UNION ALL SELECT 'html', 1, id, f || chr(10) || '<table></table>' FROM i WHERE grid)
    SELECT format, sha256(string_agg(body, chr(10) || chr(10) ORDER BY late, id)) AS sha256, CAST(count(*) AS BIGINT) AS parts FROM b GROUP BY format""")
def combined_exports(spark, sf_dir):
    """Bodies of the files that hold a whole batch: labelled texts in the queue's order, then tables."""
    k = F.col("o_orderkey")
    o = _table(spark, sf_dir, "orders").select(k.alias("ord"), F.concat(F.lit("f"), k.cast("string")).alias("file_name"), F.concat(F.lit("text of "), k.cast("string")).alias("text"), F.when(k % 3 == 0, "table").otherwise("text").alias("mode"), F.lit(None).cast("string").alias("html"))
    grids = o.filter("ord % 4 = 0").select("ord", F.lit(0).alias("table_ord"), "file_name", F.lit("<table></table>").alias("html"))
    out = exports.combined(o, grids)
    return out.select("format", F.sha2(F.encode("text", "UTF-8"), 256).alias("sha256"), F.size(F.split("text", "\n\n", -1)).cast("long").alias("parts"))


@query(f"""
    WITH i AS (SELECT o_orderkey AS id, o_orderkey % 3 = 0 AS tab, o_orderkey % 4 AS n FROM orders)
    SELECT 'txt' AS format, 'all.txt' AS name, sha256(string_agg(CAST(id AS VARCHAR), ',' ORDER BY id)) AS ids FROM i UNION ALL
    SELECT 'xlsx', 'all.xlsx', sha256(string_agg(CAST(id AS VARCHAR), ',' ORDER BY id)) FROM i WHERE n > 0 UNION ALL
    SELECT 'html', 'all.html', sha256(string_agg(CAST(id AS VARCHAR), ',' ORDER BY late, id)) FROM (SELECT id, 0 AS late FROM i WHERE NOT tab UNION ALL SELECT id, 1 FROM i WHERE n > 0)""")
def combined_plan(spark, sf_dir):
    p = exports.planned(_items(spark, sf_dir), ["txt", "xlsx", "html"], ExportOptions(grouping="combined", name="all"))
    return p.select("format", "name", F.sha2(F.array_join(F.transform("ids", lambda i: i.cast("string")), ","), 256).alias("ids"))


@case(values("rule VARCHAR, place INTEGER, name VARCHAR, action VARCHAR", [
    ("rename", 0, "a (2).txt", "create"), ("rename", 1, "a (4).txt", "create"), ("rename", 2, "b.text.html", "create"), ("rename", 3, "b.text (2).html", "create"), ("rename", 4, "a (3) (2).txt", "create"),
    ("overwrite", 0, "a.txt", "overwrite"), ("overwrite", 1, "a (2).txt", "create"), ("overwrite", 2, "b.text.html", "create"), ("overwrite", 3, "b.text (2).html", "create"), ("overwrite", 4, "a (3).txt", "overwrite"),
    ("skip", 0, "a.txt", "skip"), ("skip", 1, "a (2).txt", "create"), ("skip", 2, "b.text.html", "create"), ("skip", 3, "b.text (2).html", "create"), ("skip", 4, "a (3).txt", "skip"),
]))
def collision_cases(spark, sf_dir):
    """Files on disk and files of the same run, under each rule."""
    at = folder(spark, "names")
    for name in ("a.txt", "a (3).txt"):
        open(f"{at}/{name}", "w").close()
    names = ["a.txt", "a.txt", "b.text.html", "b.text.html", "a (3).txt"]
    return spark.createDataFrame([(rule, i, *x) for rule in ("rename", "overwrite", "skip") for i, x in enumerate(exports.resolve(names, at, rule))], "rule string, place int, name string, action string")


AT_ONCE = 1 << 15  # files that a query has on disk at one time, roughly: a block of 4 KB each, however short they are


def _in_rounds(orders: DataFrame, name: str, read_back: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """Rows that ``read_back`` makes of orders' keys and priorities and of a new folder for a file an order.

    All orders take their turn, dealt out by key; a round's rows are written, and its folder goes before the next round, so that disk
    holds the files of one round only.
    """
    spark = orders.sparkSession
    own = folder(spark, name)
    rounds = max(1, -(-orders.count() // AT_ONCE))
    dealt = orders.select("o_orderkey", "o_orderpriority", F.pmod(F.xxhash64("o_orderkey"), F.lit(rounds)).cast("int").alias("round"))
    dealt.repartition("round").write.partitionBy("round").parquet(f"file://{own}/orders")
    dealt = spark.read.schema(dealt.schema).parquet(f"file://{own}/orders")
    for n in range(rounds):
        at = folder(spark, name)
        # A file an order is the tasks' work, however small the table.
        rows = read_back(dealt.filter(F.col("round") == n).drop("round").repartition(spark.sparkContext.defaultParallelism, "o_orderkey"), at)
        rows.write.mode("append").parquet(f"file://{own}/rows")
        files.removed(spark, at)
        if n % 16 == 15:  # shuffle files of rounds that are over go with the driver's garbage
            gc.collect()
            spark.sparkContext._jvm.System.gc()
    shutil.rmtree(f"{own}/orders")
    return spark.read.schema(rows.schema).parquet(f"file://{own}/rows")

@query("""
    SELECT CAST(o_orderkey AS VARCHAR) || '.txt' AS name, CASE o_orderkey % 3 WHEN 0 THEN 'old' ELSE 'text ' || o_orderkey END AS content FROM orders""")
def published_files(spark, sf_dir):
    """A file an order, written by the executors into folders and read back: new, replaced and skipped ones."""

    def read_back(orders, at):
        k = F.col("o_orderkey")
        o = orders.select(F.concat(k.cast("string"), F.lit(".txt")).alias("name"), F.encode(F.concat(F.lit("text "), k.cast("string")), "UTF-8").alias("content"), F.when(k % 3 == 0, "skip").when(k % 3 == 1, "overwrite").otherwise("create").alias("action"))
        exports.publish(o.filter("action <> 'create'").withColumns({"content": F.encode(F.lit("old"), "UTF-8"), "action": F.lit("create")}), at)
        exports.publish(o, at)
        return files.contents(spark, f"file://{at}").select(F.regexp_extract("path", "([^/]+)$", 1).alias("name"), F.decode("content", "UTF-8").alias("content"))

    return _in_rounds(_table(spark, sf_dir, "orders"), "published", read_back)


@case(values("case_id INTEGER, title VARCHAR", [(0, "P1-T5"), (1, "P2-4-T2"), (2, "a_b_cxxxxxxxxxxx-P2-4-T2"), (3, "a_b_cxxxxxxxxxxx-P2-4-T2-2"), (4, "P3-T1"), (5, "P3-T1-2")]))
def sheet_title_cases(spark, sf_dir):
    """A table number, an end or a page of 0 counts as missing; illegal characters go, sources are cut, titles made distinct."""
    long = "a/b:c" + "x" * 30
    label = exports.page_label(0, 0, 4, 0)[0]
    t = {"page_index": 1, "end_page_index": 3, "table_index": 1}
    titles = exports.sheet_titles([t, {**t, "source": long}, {**t, "source": long}])
    same = exports.sheet_titles([{"page_index": 2, "end_page_index": 0, "table_index": 0}, {"page_index": 2, "end_page_index": 2, "table_index": 0, "source": ""}])
    # The second table's number is its place, since 0 counts as missing.
    named = [label, *titles, same[0], exports.sheet_titles([{"page_index": 2, "table_index": 0}, {"page_index": 2, "table_index": 0}])[0] + "-2"]
    return spark.createDataFrame(list(enumerate(named)), "case_id int, title string")


@query("SELECT CAST(o_orderkey AS VARCHAR) || '.txt' AS name, CAST(length(o_orderpriority) AS BIGINT) AS length, sha256(o_orderpriority) AS sha256, 'txt' AS extension FROM orders")
def listed_files(spark, sf_dir):
    """Folders of a file an order: their listing, which reads no contents, and the contents' digests."""

    def read_back(orders, at):
        exports.publish(orders.select(F.concat(F.col("o_orderkey").cast("string"), F.lit(".txt")).alias("name"), F.encode("o_orderpriority", "UTF-8").alias("content"), F.lit("create").alias("action")), at)
        both = files.listing(spark, f"file://{at}", "*.txt").select("path", "length").join(files.digests(spark, f"file://{at}").select("path", "sha256").hint("merge"), "path")
        return both.select(X.base_name(F.col("path")).alias("name"), "length", "sha256", X.extension(F.col("path")).alias("extension"))

    return _in_rounds(_table(spark, sf_dir, "orders"), "listed", read_back)


@query("""
    WITH p AS (SELECT DISTINCT l_suppkey AS s, l_orderkey % 40 AS p FROM lineitem WHERE l_linenumber = 7),
    t AS (SELECT s, p, CASE WHEN (s + p) % 7 = 0 THEN 2 ELSE 1 END AS tables, CASE WHEN p % 5 = 0 THEN 3 ELSE 2 END AS width, (s + p // 2) % 3 = 0 AS other FROM p),
    b AS (SELECT *, lag(p) OVER w AS q, lag(tables) OVER w AS before, lag(width) OVER w AS was, lag(other) OVER w AS had FROM t WINDOW w AS (PARTITION BY s ORDER BY p)),
    r AS (SELECT s, p, CASE WHEN tables <> 1 THEN 'not-one-table' WHEN before = 1 AND p <> q + 1 THEN 'non-consecutive' WHEN before = 1 AND width <> was THEN 'column-mismatch' WHEN before = 1 AND other <> had THEN 'no-header' END AS reason FROM b)
    SELECT CAST(s AS VARCHAR) AS task_id, CAST(p AS INTEGER) AS page_index, reason FROM r WHERE reason IS NOT NULL""")
def merge_reason_pages(spark, sf_dir):
    """Pages of a supplier with one table or two, of two or three columns, under one header or another, some missing: every reason not to merge."""
    p = _table(spark, sf_dir, "lineitem").filter("l_linenumber = 7").select(F.col("l_suppkey").alias("s"), (F.col("l_orderkey") % 40).cast("int").alias("page_index")).distinct()
    s, page = F.col("s"), F.col("page_index")
    tables_ = p.select(
        s.cast("string").alias("task_id"), "page_index", F.explode(F.when((s + page) % 7 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("table_index"), F.when(page % 5 == 0, 3).otherwise(2).alias("width"),
        F.when((s + F.floor(page / 2)) % 3 == 0, "weather").otherwise("amount").alias("header"),
    )
    rows = tables_.withColumn("row", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("column", F.explode(F.sequence(F.lit(0), F.col("width") - 1)))
    text = F.when(F.col("row") == 1, F.concat(F.lit("value "), "page_index")).when(F.col("column") == 0, F.col("header")).otherwise("name")
    cells = rows.select("task_id", "page_index", "table_index", F.col("row").alias("row_ord"), F.col("column").alias("cell_ord"), "row", "column", F.lit(1).alias("row_span"), F.lit(1).alias("col_span"), text.alias("text"), F.lit(None).cast("array<double>").alias("box"))
    return tables.issues(cells)


@query(f"""
    WITH {_ITEM_ROWS}, d AS (SELECT task_id, r, arg_max(f, n) AS f, arg_max(q, n) AS q FROM i GROUP BY ALL)
    SELECT CAST(task_id AS VARCHAR) AS task_id, 1 AS sheets, CAST(2 * count(*) AS INTEGER) AS cells, 0 AS formulas FROM d GROUP BY task_id""")
def workbook_cells(spark, sf_dir):
    """Workbooks made by the executors, opened again: sheets, cells with a text, and formulas (never any)."""
    c = _cells(spark, sf_dir).withColumns({"task_id": F.col("task_id").cast("string"), "end_page_index": F.lit(0)})

    def opened(frames):
        for f in frames:
            out = []
            for task, content in zip(f["task_id"], f["content"]):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    sheets = [z.read(n).decode() for n in z.namelist() if n.startswith("xl/worksheets/")]
                out.append((task, len(sheets), sum(len(re.findall("<c ", s)) for s in sheets), sum(s.count("<f>") for s in sheets)))
            yield pd.DataFrame(out, columns=["task_id", "sheets", "cells", "formulas"])

    return exports.workbooks(c).mapInPandas(opened, "task_id string, sheets int, cells int, formulas int")


@case(values("outcome VARCHAR, files INTEGER", [("copied", 2), ("refused", 2)]))
def pack_copies(spark, sf_dir):
    """A pack is copied and verified; one with another digest is refused, and what stood there stays."""
    at = folder(spark, "pack")
    os.makedirs(f"{at}/from/m")
    for name in ("inference.json", "inference.yml"):
        with open(f"{at}/from/m/{name}", "wb") as f:
            f.write(b"abc")
    good = "ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad"
    entries = lambda digest: spark.createDataFrame([("m/inference.json", 3, good), ("m/inference.yml", 3, digest)], "path string, size long, sha256 string")
    exports.copy_pack(entries(good), f"{at}/from", f"{at}/to")
    rows = [("copied", len(os.listdir(f"{at}/to/m")))]
    try:
        exports.copy_pack(entries("0" * 64), f"{at}/from", f"{at}/to")
    except Exception:  # noqa: BLE001
        rows.append(("refused", len(os.listdir(f"{at}/to/m"))))
    return spark.createDataFrame(rows, "outcome string, files int")


# --- logs and streams ---


@query("""
    SELECT CASE WHEN event_id % 3 = 0 THEN 'recognize' ELSE 'other' END AS method, CASE WHEN event_id % 2 = 0 THEN 'ok' ELSE 'unknown' END AS category, count(*) AS n FROM events GROUP BY ALL""")
def event_log_lines(spark, sf_dir):
    """Events written as JSON lines with fields that must not be read, and lines that are no JSON; read back safely."""
    at = folder(spark, "log")
    k = F.col("event_id")
    e = _table(spark, sf_dir, "events").select(F.col("ts").cast("string").alias("time"), F.when(k % 3 == 0, "recognize").otherwise(F.col("event_type")).alias("method"), F.when(k % 2 == 0, "ok").otherwise("secret").alias("category"), F.col("props").alias("path"))
    e.select(F.to_json(F.struct("*")).alias("value")).union(spark.createDataFrame([("broken {",), ("",)], "value string")).write.text(f"file://{at}/lines")
    return queue.safe_events(files.event_log(spark, [f"file://{at}/lines"])).groupBy("method", "category").agg(F.count("*").alias("n"))


def _page_events(spark, sf_dir) -> tuple[DataFrame, str]:
    """The events as page events of two processes, written as JSON lines to six files in no order, two of which make a batch: page event_id % 50 of the user's document."""
    at = folder(spark, "events")
    k = F.col("event_id")
    e = _table(spark, sf_dir, "events").select((1 + (k % 11 > 0).cast("long")).alias("generation"), F.col("user_id").cast("string").alias("task_id"), (k % 50).cast("int").alias("page_index"), F.concat(F.lit("text "), k.cast("string")).alias("text"), (k % 9).cast("int").alias("n_blocks"), (k % 2).cast("int").alias("n_tables"), k.alias("arrival"))
    e.select([c.split()[0] for c in EVENTS.split(", ")]).repartition(6, F.xxhash64("arrival")).write.json(f"file://{at}/in")
    return S.current(files.event_stream(spark, f"file://{at}/in", 2), 2), at


_FIRST = "f AS (SELECT user_id, event_id % 50 AS page, min(event_id) AS first FROM events WHERE event_id % 11 > 0 GROUP BY ALL)"


@query(f"""
    WITH {_FIRST}, o AS (SELECT *, max(page) OVER (PARTITION BY user_id ORDER BY first ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM f)
    SELECT CAST(user_id AS VARCHAR) AS task_id, CAST(count(*) AS INTEGER) AS pages, CAST(sum(first % 9) AS INTEGER) AS blocks, CAST(sum(first % 2) AS INTEGER) AS tables, count(*) FILTER (WHERE reach IS NULL OR page > reach) AS in_order FROM o GROUP BY user_id""")
def stream_running_totals(spark, sf_dir):
    """A stream of page events with keyed state: running totals of first copies and of pages that came in order, corrected where an earlier copy comes later; events of the earlier process don't count."""
    S.keyed_state(spark)
    events, at = _page_events(spark, sf_dir)
    writer = S.progress(events).writeStream.format("parquet").option("path", f"file://{at}/totals").option("checkpointLocation", f"file://{at}/checkpoint")
    writer.outputMode("append").trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.parquet(f"file://{at}/totals")
    last = F.max_by(F.struct("pages", "blocks", "tables", "ordered"), "seq")
    return rows.groupBy("task_id").agg(last.alias("t")).select("task_id", "t.pages", "t.blocks", "t.tables", F.col("t.ordered").cast("long").alias("in_order"))


@query(f"""
    WITH {_FIRST} SELECT CAST(user_id AS VARCHAR) AS task_id, CAST(page AS INTEGER) AS page_index, 'text ' || first AS text, first AS arrival FROM f""")
def stream_equals_batch(spark, sf_dir):
    """Pages stored from a stream whose files and batches mix early and late copies: of every page the first to arrive."""
    events, at = _page_events(spark, sf_dir)
    S.store_pages(events, f"file://{at}/pages", f"file://{at}/checkpoint").awaitTermination()
    return S.stored_pages(spark, f"file://{at}/pages").select("task_id", "page_index", "text", "arrival")


@query(f"""
    WITH {_FIRST} SELECT CAST(user_id AS VARCHAR) AS task_id, CAST(page AS INTEGER) AS page_index, TRUE AS ascending, first AS arrival FROM f""")
def stream_corrections(spark, sf_dir):
    """What the stream has emitted for each page: versions from 0 without a gap, each earlier than the one before, the last the first copy."""
    events, at = _page_events(spark, sf_dir)
    S.store_pages(events, f"file://{at}/pages", f"file://{at}/checkpoint").awaitTermination()
    rows = spark.read.parquet(f"file://{at}/pages").groupBy("task_id", "page_index").agg(F.array_sort(F.collect_list(F.struct("version", "arrival"))).alias("v"))
    falls = F.forall(F.sequence(F.lit(0), F.size("v") - 1), lambda i: (F.col("v")[i]["version"] == i) & ((i == 0) | (F.col("v")[i]["arrival"] < F.col("v")[F.greatest(i - 1, F.lit(0))]["arrival"])))
    return rows.select("task_id", "page_index", falls.alias("ascending"), F.element_at("v", -1)["arrival"].alias("arrival"))


@query(f"""
    WITH {_FIRST}, w AS (SELECT user_id, count(*) AS n FROM f GROUP BY user_id)
    SELECT CAST(user_id AS VARCHAR) AS task_id, CASE WHEN user_id % 7 = 0 THEN 'exists' ELSE 'written' END AS state FROM w WHERE n >= 1 + user_id % 3""")
def auto_exports(spark, sf_dir):
    """Documents exported as soon as their pages are there, never over a file that exists."""
    events, at = _page_events(spark, sf_dir)
    users = _table(spark, sf_dir, "events").select("user_id").distinct()
    selected = users.select(F.col("user_id").cast("string").alias("task_id"), (1 + F.col("user_id") % 3).alias("selected_count"), F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit(".pdf")).alias("file_name"))
    os.makedirs(f"{at}/out")
    E.export_completed(selected.filter("task_id % 7 = 0").withColumn("text", F.lit("mine")), f"{at}/out").write.format("noop").mode("overwrite").save()
    S.store_pages(events, f"file://{at}/pages", f"file://{at}/checkpoint").awaitTermination()
    E.export_as_completed(spark, f"file://{at}/pages", selected, f"{at}/out", f"file://{at}/states", f"file://{at}/exported").awaitTermination()
    return spark.read.parquet(f"file://{at}/states").select("task_id", "state")


@query(f"""
    WITH {_FIRST} SELECT CAST(user_id AS VARCHAR) AS task_id, count(*) AS pages, string_agg('text ' || first, chr(10) || chr(10) ORDER BY page) AS text FROM f GROUP BY user_id HAVING count(*) >= 3""")
def stream_completed_texts(spark, sf_dir):
    """Texts of the documents that a stream has finished, three pages or more, each once, from the folders that hold their pages."""
    events, at = _page_events(spark, sf_dir)
    S.store_pages(events, f"file://{at}/pages", f"file://{at}/checkpoint").awaitTermination()
    users = _table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("task_id"), F.lit(3).alias("selected_count")).distinct()
    done = S.completions(spark, f"file://{at}/pages", users).writeStream.format("parquet").option("path", f"file://{at}/done").option("checkpointLocation", f"file://{at}/done-checkpoint")
    done.trigger(availableNow=True).start().awaitTermination()
    finished = spark.read.parquet(f"file://{at}/done")
    return pages.document_text(S.pages_of(spark, f"file://{at}/pages", finished)).select("task_id", "pages", "text")


@query("SELECT conv_id AS task_id, count(*) FILTER (WHERE turn % 2 = 0) AS cheap, count(*) FILTER (WHERE turn % 2 = 1) AS rest FROM (SELECT DISTINCT conv_id, turn FROM conversations WHERE turn > 2) GROUP BY conv_id")
def page_hand_off(spark, sf_dir):
    """Pages with embedded text go first; what is stored already is in neither pass."""
    p = _turns(spark, sf_dir).select("task_id", "page_index").distinct().withColumn("source", F.when(F.col("page_index") % 2 == 0, "pdf-text").when(F.col("page_index") % 3 == 0, "ocr"))
    cheap, rest = S.hand_off(p, p.filter("page_index <= 2"))
    both = cheap.withColumn("cheap", F.lit(True)).union(rest.withColumn("cheap", F.lit(False)))
    return both.groupBy("task_id").agg(F.count_if("cheap").alias("cheap"), F.count_if(~F.col("cheap")).alias("rest"))


@query("""
    WITH e AS (SELECT *, event_id % 17 = 0 AS edit FROM events WHERE event_id % 11 > 0),
    f AS (SELECT user_id, event_id % 50 AS page, min(event_id) AS first FROM e WHERE NOT edit GROUP BY ALL),
    l AS (SELECT user_id, max(event_id) AS last FROM e WHERE edit GROUP BY user_id),
    n AS (SELECT f.*, last, row_number() OVER (PARTITION BY f.user_id ORDER BY page) - 1 AS place FROM f LEFT JOIN l ON l.user_id = f.user_id),
    t AS (SELECT user_id, any_value(last) AS last, string_agg('text ' || first, chr(10) || chr(10) ORDER BY page) FILTER (WHERE last IS NULL OR place >= last % 5) AS tail FROM n GROUP BY user_id)
    SELECT CAST(user_id AS VARCHAR) AS task_id, CASE WHEN last IS NULL THEN tail ELSE concat_ws(chr(10) || chr(10), 'edit ' || last, tail) END AS text FROM t""")
def stream_edited_prefix(spark, sf_dir):
    """Pages and edits in one stream, in no order: of a task the latest edit stands for its first pages, the others come behind it."""
    at = folder(spark, "edits")
    k = F.col("event_id")
    is_edit = k % 17 == 0
    e = _table(spark, sf_dir, "events").filter(k % 11 > 0).select(
        F.lit(2).cast("long").alias("generation"), F.col("user_id").cast("string").alias("task_id"), F.when(~is_edit, (k % 50).cast("int")).alias("page_index"), F.concat(F.when(is_edit, "edit ").otherwise("text "), k.cast("string")).alias("text"),
        F.lit(1).alias("n_blocks"), F.lit(0).alias("n_tables"), k.alias("arrival"), F.when(is_edit, "edit").otherwise("page").alias("kind"), F.when(is_edit, (k % 5).cast("int")).alias("edited_pages"),
    )
    e.repartition(6, F.xxhash64("arrival", F.lit(1))).write.json(f"file://{at}/in")
    events = files.event_stream(spark, f"file://{at}/in", 2, EDITS)
    S.store_pages(events.filter("kind = 'page'").drop("kind", "edited_pages"), f"file://{at}/pages", f"file://{at}/c1").awaitTermination()
    S.store_edits(events, f"file://{at}/edits", f"file://{at}/c2").awaitTermination()
    return S.current_texts(spark, f"file://{at}/pages", f"file://{at}/edits")


@query("""
    WITH p AS (SELECT conv_id, turn, any_value(CASE WHEN turn % 2 = 0 THEN 'pdf-text' ELSE 'ocr' END) AS source FROM conversations GROUP BY ALL)
    SELECT CAST(conv_id AS VARCHAR) AS task_id, count(*) AS pages, count(*) AS rows, count(*) FILTER (WHERE source = 'ocr') AS recognised FROM p GROUP BY conv_id""")
def stream_hand_off(spark, sf_dir):
    """Two passes with a log between them; the second is stopped and started again as more comes: every page once."""
    at = folder(spark, "hand-off")
    shape = "task_id string, page_index int, source string, text string"
    p = _turns(spark, sf_dir).select(F.col("task_id").cast("string").alias("task_id"), "page_index", F.when(F.col("page_index") % 2 == 0, "pdf-text").otherwise("ocr").alias("source"), "text")
    seen = lambda df: df.withColumn("text", F.lit("recognised"))
    for part in range(2):
        p.filter(F.abs(F.xxhash64("task_id", "page_index")) % 2 == part).write.mode("append").json(f"file://{at}/in")
        requests = spark.readStream.schema(shape).json(f"file://{at}/in")
        S.first_pass(requests, f"file://{at}/pages", f"file://{at}/log", f"file://{at}/c1").awaitTermination()
        S.second_pass(spark, f"file://{at}/log", shape, seen, f"file://{at}/pages", f"file://{at}/c2").awaitTermination()
    rows = spark.read.parquet(f"file://{at}/pages")
    return rows.groupBy("task_id").agg(F.count_distinct("page_index").alias("pages"), F.count("*").alias("rows"), F.count_if(F.col("text").eqNullSafe("recognised")).alias("recognised"))


@query("""
    SELECT CAST(user_id AS VARCHAR) AS task_id, count(*) AS events, CAST(sum(event_id) AS BIGINT) AS total, count(DISTINCT event_id % 50) AS pages FROM events GROUP BY user_id""")
def stream_growing_files(spark, sf_dir):
    """Events in files that grow by pieces cut within lines, read after each piece: each event once, when its line is complete."""
    at = folder(spark, "growing")
    k = F.col("event_id")
    row = F.struct(F.lit(1).alias("generation"), F.col("user_id").cast("string").alias("task_id"), (k % 50).cast("int").alias("page_index"), F.col("event_type").alias("text"), k.alias("arrival"))
    _table(spark, sf_dir, "events").select(F.to_json(row)).repartition(4).write.text(f"file://{at}/whole")
    os.makedirs(f"{at}/in")

    def grow(share: float):
        def append(files_):
            for f in files_:
                target = f"{at}/in/{os.path.basename(f['path'])}"
                size = os.path.getsize(target) if os.path.exists(target) else 0
                with open(target, "ab") as out:
                    out.write(f["content"][size : int(len(f["content"]) * share)])

        spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(f"file://{at}/whole").foreachPartition(append)

    for share in (0.3, 0.300001, 0.71, 1.0):
        grow(share)
        lines = files.event_lines(spark, f"{at}/in").writeStream.format("parquet").option("path", f"file://{at}/events").option("checkpointLocation", f"file://{at}/checkpoint")
        lines.trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"file://{at}/events").groupBy("task_id").agg(F.count("*").alias("events"), F.sum("arrival").alias("total"), F.count_distinct("page_index").alias("pages"))


@query(f"""
    WITH {_FIRST} SELECT CAST(user_id AS VARCHAR) AS task_id, count(*) AS pages, count(*) AS rows, 'cancelled' AS state FROM f GROUP BY user_id""")
def stream_pause_and_resume(spark, sf_dir):
    """A run that is paused, resumed on its checkpoint as more events arrive, and cancelled: every page once, and no way on."""
    k = F.col("event_id")
    at = folder(spark, "paused")
    e = _table(spark, sf_dir, "events").filter(k % 11 > 0).select(F.lit(1).cast("long").alias("generation"), F.col("user_id").cast("string").alias("task_id"), (k % 50).cast("int").alias("page_index"), F.lit("x").alias("text"), F.lit(1).alias("n_blocks"), F.lit(0).alias("n_tables"), k.alias("arrival"))
    run = S.Run(lambda: S.store_pages(files.event_stream(spark, f"file://{at}/in"), f"file://{at}/pages", f"file://{at}/checkpoint"))
    for part in range(3):
        e.filter(F.col("arrival") % 3 == part).write.mode("append").json(f"file://{at}/in")
        run.resume()
        run.query.awaitTermination()
        run.pause()
    run.cancel()
    try:
        run.resume()
    except RuntimeError:
        pass
    stored = S.stored_pages(spark, f"file://{at}/pages")
    return stored.groupBy("task_id").agg(F.count_distinct("page_index").alias("pages"), F.count("*").alias("rows")).withColumn("state", F.lit(run.state))


class _Numbered(files.DocumentSource):
    """Pages that say their number."""

    @classmethod
    def name(cls) -> str:
        return "numbered_documents"

    @staticmethod
    def decode(path, pages_):
        return ((path, p, f"page {p + 1}", 600.0, 800.0) for p in pages_)


@case("""
    SELECT 'x.pdf' AS path, CAST(p AS INTEGER) AS page_index, 'page ' || p + 1 AS text, 600.0 AS width, 3 AS parts FROM range(0, 40, 2) r(p)""")
def document_source(spark, sf_dir):
    """Only selected pages are opened, a partition for each 8 of them."""
    spark.dataSource.register(_Numbered)
    df = spark.read.format("numbered_documents").option("path", "x.pdf").option("pages", ",".join(map(str, range(0, 40, 2)))).option("per_partition", "8").load()
    return df.select("path", "page_index", "text", "width", F.lit(df.rdd.getNumPartitions()).alias("parts"))


@case(values("given VARCHAR, grouping VARCHAR, collision VARCHAR, lengths VARCHAR", [("default", "separate", "rename", "0,0,0"), ("odd", "separate", "rename", "100,100,100"), ("valid", "combined", "skip", "1,2,3")]))
def export_settings(spark, sf_dir):
    given = {"default": ExportOptions(), "odd": ExportOptions("by page", "ask", "p" * 200, "s" * 101, "n" * 100), "valid": ExportOptions("combined", "skip", "a", "bb", "ccc")}
    rows = [(k, o.grouping, o.collision, f"{len(o.prefix)},{len(o.suffix)},{len(o.name)}") for k, o in ((k, o.normalised()) for k, o in given.items())]
    return spark.createDataFrame(rows, "given string, grouping string, collision string, lengths string")


@case(values("id INTEGER, text VARCHAR, html VARCHAR", [
    (0, "本（ほん）を読（よ）む", "<ruby>本<rt>ほん</rt></ruby>を<ruby>読<rt>よ</rt></ruby>む"), (1, "本（ほん）を読む", "<ruby>本<rt>ほん</rt></ruby>を読む"), (2, "本を読む", "本を読む"), (3, "a&b（&lt;）", "<ruby>a&amp;b<rt>&amp;lt;</rt></ruby>"),
]))
def rendered_glosses(spark, sf_dir):
    """Readings by their start; spans that overlap an earlier one or leave the text are skipped."""
    cases = [("本を読む", [(2, 3, "よ"), (0, 1, "ほん")]), ("本を読む", [(0, 1, "ほん"), (0, 2, "no"), (3, 9, "no")]), ("本を読む", [(2, 2, "no"), (-1, 1, "no")]), ("a&b", [(0, 3, "&lt;")])]
    rows = spark.createDataFrame([(i, t, spans) for i, (t, spans) in enumerate(cases)], "id int, base string, glosses array<struct<start:int,end:int,text:string>>")
    return rows.select("id", projection.rendered(F.col("base"), F.col("glosses"), "ruby").alias("m")).select("id", "m.*")
