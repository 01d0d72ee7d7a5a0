import random

import pytest
from pyspark.sql import functions as F

from pagemill.operators import projection
from pagemill.schema import TextSettings

from . import plain_projection as plain
from .conftest import DATA

RUBY = "array<struct<start:int,end:int,text:string,score:double,box:array<double>,alignment:string>>"
HEADS = "task_id string, text string, result_type string, partial boolean, cancelled boolean, selected int, total int, text_edited boolean, edited_pages int"
SHEETS = "task_id string, page_index int, text string, raw_text string, schema_version int, height double, ruby_enabled boolean"
BLOCKS = f"task_id string, page_index int, block_ord int, text string, box array<double>, direction string, font_size double, role string, ruby {RUBY}"


def block(text, y=100, x=20, width=400, **more):
    return {"text": text, "box": [float(v) for v in (x, y, x + width, y + 20)], "direction": "horizontal", "font_size": 20.0, "role": "body", "ruby": None, **more}


def projected(spark, cases, settings=TextSettings(), raw_view=False):
    """Rows of the projection by case; cases: name to (pages as lists of blocks, facts)."""
    heads, sheets, blocks = [], [], []
    for name, (pages, facts) in cases.items():
        heads.append((name, facts.get("text", ""), facts.get("result_type"), facts.get("partial", False), facts.get("cancelled", False), facts.get("selected", len(pages)), facts.get("total"), facts.get("text_edited", False), facts.get("edited_pages")))
        for i, page in enumerate(pages):
            index, whole = facts.get("indices", range(len(pages)))[i], "\n".join(b["text"] for b in page)
            sheets.append((name, index, whole, whole, (facts.get("schemas") or [1] * len(pages))[i], 800.0, False))
            blocks += [(name, index, j, b["text"], b["box"], b["direction"], b["font_size"], b["role"], [(*r, None, None, "characters") for r in b["ruby"]] if b["ruby"] else None) for j, b in enumerate(page)]
    frames = [spark.createDataFrame(rows, schema) for rows, schema in ((heads, HEADS), (sheets, SHEETS), (blocks, BLOCKS))]
    return {r.task_id: r for r in projection.project(frames[0], projection.nested_pages(frames[1], frames[2]), settings, raw_view).collect()}


LONG = "这一行有足够多的文字而且没有句号所以应该继续"
AFTER = [block("后面还有很长的一行文字在这里", 152), block("以及更多的文字在这一行里面", 178)]
TWO = [[block("前半")], [block("后半")]]
TITLED = [[block("Header 7", 20), block("Header 7", 300), block(str(i), 770)] for i in range(4)]
#: name: pages, facts, text
CASES = {
    **{f"pair {i}": ([[block(a), block(b, 126)]], {}, want) for i, (a, b, want) in enumerate([
        ("文字开头", "继续下去。", "文字开头继续下去。"), ("An open line", "goes on here.", "An open line goes on here."), ("ひらがな", "つづく。", "ひらがなつづく。"), ("dis\u00ad", "cover", "discover"), ("self-", "made", "self-made"),
        ("para", "- item", "para\n\n- item"), ("para", "-\u3000item", "para\n\n-\u3000item"), ("para", "“Speech”", "para\n\n“Speech”"), ("para", "Chapter 4", "para\n\nChapter 4"), ("para", "\u3000indent", "para\n\n\u3000indent"),
    ])},
    **{f"break {i}": ([[block("a line that ends here."), b]], {}, f"a line that ends here.\n\n{b['text']}") for i, b in enumerate([block("elsewhere", 126, 500), block("far below", 250), block("huge", 126, font_size=40.0), block("indented", 126, 60), block("turned", 126, direction="vertical")])},
    "short": ([[block("诗", 100, 20, 60), block("句", 126, 20, 60)]], {}, "诗\n句"),
    "words": ([[block("inter-"), block("national news are international", 126), block("keep inter-national", 152)]], {}, "international news are international keep inter-national"),
    "words elsewhere": ([[block("inter-"), block("national news", 126)], [block("it was international here", 100)], [block("inter-"), block("net", 126)]], {}, "international news it was international here inter-net"),
    "soft end of a page": ([[block("dis\u00ad")], [block("cover")]], {}, "discover"),
    "pages": (TWO, {}, "前半后半"), "partial": (TWO, {"partial": True}, "前半\n\n后半"), "cancelled": (TWO, {"cancelled": True}, "前半\n\n后半"), "gap": (TWO, {"indices": [0, 2]}, "前半\n\n后半"), "lacking": (TWO, {"selected": 3}, "前半\n\n后半"),
    "no selection": (TWO, {"selected": None}, "前半\n\n后半"), "total": (TWO, {"selected": None, "total": 2}, "前半后半"), "ended": ([[block("完了。")], [block("后半")]], {}, "完了。\n\n后半"),
    "headers": (TITLED, {}, "\n\n".join(["Header 7"] * 4).replace("\n\n", " ")), "headers stay": (TITLED, {"partial": True}, "\n\n".join(f"Header 7\n\nHeader 7\n\n{i}" for i in range(4))), "one page number": ([[block("text"), block("12", 770)]], {}, "text"),
    "legacy": ([[block("旧"), block("文", 126)]], {"schemas": [None]}, "旧\n文"), "edited": ([[block("旧")]], {"text_edited": True, "text": "mine , own"}, "mine , own"),
    "edited behind": ([[block("旧")], [block("新 页")], [block("三")]], {"text_edited": True, "text": "mine", "edited_pages": 1}, "mine\n\n新页三"), "edited table": ([[block("旧")]], {"text_edited": True, "text": "mine", "result_type": "table", "edited_pages": 0}, "mine"),
    "edited numbers": ([[block("旧")], [block("新")]], {"text_edited": True, "text": "mine", "edited_pages": 1, "indices": [5, 9]}, "mine\n\n新"),
    "no pages": ([], {"text": "kept"}, "kept"), "table": ([[block("x")]], {"result_type": "table", "text": "表 格 , 内\n\n\n1.说明"}, "表格，内\n\n\n1．说明"),
    "vertical": ([[block("左", direction="vertical", box=[20.0, 20.0, 40.0, 500.0]), block("右", direction="vertical", box=[60.0, 20.0, 80.0, 500.0])]], {}, "右左"),
    "columns": ([[block("B1", 100, 500, 200), block("A1", 100, 20, 200), block("B2", 126, 500, 200), block("A2", 126, 20, 200)]], {}, "A1\nA2\n\nB1\nB2"),
    "rows": ([[block("2", 103, 300, 50), block("3", 140), block("1", 100, 20, 50)]], {}, None), "no box": ([[block("x", box=[]), block("y", 1)]], {}, "x y"),
    "glosses": ([[block("漢字<b>", ruby=[(0, 2, "か&"), (1, 2, "no"), (5, 99, "no")]), block("gone", 126, role="ruby")]], {}, "漢字（か&）<b>"),
    "moved gloss": ([[block("Hello,world 薔薇", ruby=[(12, 14, "ばら")])]], {}, "Hello, world 薔薇（ばら）"), "lost gloss": ([[block("漢 字", ruby=[(1, 2, "no")])]], {}, "漢字"),
    "empty lines": ([[block("a\u00ad"), block("", 126), block("b", 152)], [block("")]], {}, None),
}


def test_cases(spark):
    got = projected(spark, {n: (p, f) for n, (p, f, _) in CASES.items()})
    assert {n: got[n].text for n, (*_, want) in CASES.items() if want is not None} == {n: want for n, (*_, want) in CASES.items() if want is not None}
    assert [x for x in got["rows"].text if x in "123"] == ["1", "2", "3"] and got["legacy"].legacy and got["pages"].joined == 1 and got["words elsewhere"].joined == 2


def test_unfinished_long_lines_run_on_despite_small_doubts(spark):
    changes = [{"font_size": 16.0}, {"box": [40.0, 126.0, 420.0, 146.0]}, {"box": [20.0, 145.0, 420.0, 165.0]}]
    got = projected(spark, {str(i): ([[block(LONG), {**block("下一行。", 126), **c}, *AFTER]], {}) for i, c in enumerate(changes)})
    assert all(r.text.startswith(LONG + "下一行。") for r in got.values())


def test_modes_and_styles(spark):
    pages = [[block("甲 , 乙"), block("丙 丁", 126)], [block("漢字<b>", ruby=[(0, 2, "か&")])]]
    text = lambda settings, **more: projected(spark, {"t": (pages, {})}, settings, **more)["t"]
    assert text(TextSettings(text_mode="original", cross_page=False)).text == "甲 , 乙\n丙 丁\n\n漢字（か&）<b>"
    assert text(TextSettings(text_mode="continuous", ruby_format="ignore")).text == "甲，乙丙丁漢字<b>"
    assert text(TextSettings(ruby_format="ruby", ruby_enabled=True, cross_page=False)).html == "甲，乙丙丁\n\n<ruby>漢字<rt>か&amp;</rt></ruby>&lt;b&gt;"
    assert text(TextSettings(), raw_view=True).text == "甲 , 乙\n丙 丁\n\n漢字<b>"


def messy(rnd, n):
    """Pages of lines of several sizes, places and directions, in no order."""
    words = ["inter-", "national", "international", "news", "漢字", "かな", "。", "Chapter", "3", "- item", "well\u00ad", "come", "“Speech”", "end.", "a  b", "x ,y", "甲 , 乙", "　indent"]
    pages = []
    for i in range(n):
        lines = [block(f"Title {i}", 10), block(str(i + 1), 770)] if rnd.random() < 0.8 else []
        for k in range(rnd.randint(0, 45)):
            text = " ".join(rnd.choice(words) for _ in range(rnd.randint(0, 6)))
            font = rnd.choice([20.0, 20.0, 20.0, 18.0, 30.0, 0.0, None])
            lines.append(block(text, 60 + 26 * k * rnd.choice([0.3, 1]) + rnd.choice([0, 0, 3, 7]), rnd.choice([20, 20, 20, 30, 300]), rnd.choice([60, 380, 400]), font_size=font, direction="vertical" if rnd.random() < rnd.choice([0.05, 0.9]) else "horizontal"))
        if rnd.random() < 0.1 and lines:
            lines[0]["box"] = []
        rnd.shuffle(lines)
        pages.append(lines)
    return pages


@pytest.mark.parametrize("mode", ["smart", "continuous", "original"])
def test_whole_projection_matches_the_plain_version(spark, mode):
    rnd = random.Random(11)
    docs = {f"d{i}": (messy(rnd, rnd.choice([0, 1, 2, 5])), {"indices": sorted(rnd.sample(range(9), 9)), "selected": rnd.choice([None, 0, 99])}) for i in range(25)}
    docs |= {"far": (messy(rnd, 4), {"indices": [255, 256, 257, 512]})}  # over the ends of runs
    got = projected(spark, {n: (p, {**f, "selected": 0 if f.get("selected") is None else f["selected"]}) for n, (p, f) in docs.items()}, TextSettings(text_mode=mode))
    for name, (pages, f) in docs.items():
        want = plain.document([(f["indices"][i], 800.0, p) for i, p in enumerate(pages)], mode, 0 if f.get("selected") is None else f["selected"])
        assert (got[name].text, got[name].joined) == want, name


def test_projection_of_a_whole_table(spark):
    """The query project_text against the plain version, all documents."""
    from pagemill.plans import catalog

    pages = {}
    for d in spark.read.parquet(f"{DATA}/documents.parquet").collect():
        lines = [block(t, 26 * k, 20, min(len(t), 60) * 10) for k, t in enumerate((d.text or "").split("\n"))]
        pages.setdefault(str(d.doc_id // 5), []).append((d.doc_id % 5, 800.0, lines))
    got = {r.task_id: (r.text, r.joined) for r in catalog.QUERIES["project_text"](spark, DATA).collect()}
    assert got == {t: plain.document(p) for t, p in pages.items()}


def test_a_long_document_is_spread_over_runs(spark):
    n = 3000
    pages = spark.range(n).select(F.lit("t").alias("task_id"), F.col("id").cast("int").alias("page_index"), F.concat(F.lit("line of page "), "id").alias("text"))
    pages = pages.withColumns({"raw_text": F.col("text"), "schema_version": F.lit(1), "height": F.lit(800.0), "blocks": F.array(F.struct(F.lit(0).alias("block_ord"), "text", F.array(*map(F.lit, (20.0, 100.0, 420.0, 120.0))).alias("box"), F.lit("horizontal").alias("direction"), F.lit(20.0).alias("font_size")))})
    r = projection.project(pages.select("task_id").distinct().withColumn("selected", F.lit(n)), pages).first()
    assert (r.text, r.joined) == (" ".join(f"line of page {i}" for i in range(n)), n - 1)
    assert r.raw == "\n\n".join(f"line of page {i}" for i in range(n))


def test_reading_order_inserts_near_lines(spark):
    """Chains of lines that are near their neighbours, not each other, on pages of any length."""
    rnd = random.Random(2)
    pages = []
    for n in (2, 5, 31, 32, 60, 150):
        for kind in range(6):
            rows = []
            for i in range(n):
                x, y = (rnd.uniform(0, 300), 7.0 * rnd.randrange(3 * n)) if kind < 2 else (20.0 * rnd.randrange(3), 30.0 * rnd.randrange(n)) if kind < 4 else (9.0 * rnd.randrange(2 * n), rnd.uniform(0, 300))
                rows.append({"box": [x, y, x + rnd.choice([40, 400]), y + 20], "direction": "vertical" if kind >= 4 else "horizontal", "font_size": rnd.choice([20.0, 20.0, 10.0, None]), "text": str(i)})
            pages.append(rows)
    frame = spark.createDataFrame([(i, p) for i, p in enumerate(pages)], "id int, blocks array<struct<box:array<double>,direction:string,font_size:double,text:string>>")
    got = {r.id: [b.text for b in r.b] for r in frame.select("id", projection.reading_order(F.col("blocks")).alias("b")).collect()}
    for i, p in enumerate(pages):
        want = [b["text"] for b in plain.order(p)]
        if len(p) < projection.SHORT:  # a binary insertion may compare other lines where the relation isn't transitive
            close = lambda a, b: abs(a["box"][k] - b["box"][k]) < min(a["font_size"] or 0, b["font_size"] or 0) * (0.5 if k == 0 else 0.4)
            k = 0 if p[0]["direction"] == "vertical" else 1
            transitive = all(close(a, c) for a in p for b in p for c in p if close(a, b) and close(b, c) and a is not c)
            assert sorted(got[i]) == sorted(want) and (not transitive or got[i] == want), i
        else:
            assert got[i] == want, i


def test_settings_outside_their_domain():
    assert TextSettings("x", 1, "y", "z", None).normalised() == TextSettings()


def test_project_over_frames(spark):
    pages_, blocks = [], []
    for task in ("t1", "t2"):
        for i in (1, 0):
            pages_.append((task, i, f"raw{i}", f"raw{i}", 1, 800.0, False))
            blocks += [(task, i, k, f"{task} line {k} of page {i} runs on", [20.0, 100.0 + 26 * k, 420.0, 120.0 + 26 * k], "horizontal", 20.0, "body") for k in range(2)]
    pages_.append(("t3", 0, "only raw", "only raw", None, None, False))
    p = spark.createDataFrame(pages_, "task_id string, page_index int, text string, raw_text string, schema_version int, height double, ruby_enabled boolean")
    b = spark.createDataFrame(blocks, "task_id string, page_index int, block_ord int, text string, box array<double>, direction string, font_size double, role string")
    tasks = p.groupBy("task_id").count().selectExpr("task_id", "cast(count as int) as selected")
    out = {r.task_id: r for r in projection.project(tasks, projection.nested_pages(p, b)).collect()}
    assert out["t1"].text == " ".join(f"t1 line {k} of page {i} runs on" for i in (0, 1) for k in (0, 1)) and out["t1"].joined == 1
    assert out["t3"].text == "only raw" and out["t3"].legacy
