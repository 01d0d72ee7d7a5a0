import pytest
from pyspark.sql import functions as F

from pagemill.functions import normalize as N
from pagemill.functions import text as X
from pagemill.plans import catalog

CASES = [
    ("3.今天天气很好", "3．今天天气很好"),
    ("12． 项目\n2.50 元\n4.5.6 版", "12． 项目\n2.50 元\n4.5.6 版"),
    ("等等....好", "等等……好"),
    ("wait... what", "wait... what"),
    ("参见(Note)", "参见（Note）"),
    ("日本 ( かな )", "日本（かな）"),
    ("Good（day）！", "Good(day)!"),
    ("共8：30，约2．5", "共8:30，约2.5"),
    ("は,い", "は、い"),
    ("网站https://a.b/c?d=1,2，好", "网站https://a.b/c?d=1,2，好"),
    ("信箱 x.y@z.org，完", "信箱 x.y@z.org，完"),
    ("文件报告.docx，版本v2.0.1", "文件报告.docx，版本v2.0.1"),
    ("one    two\tthree", "one two three"),
    ("文 字 か な", "文字か な"),
    ("末尾  \n\n\n\n  缩进", "末尾\n\n  缩进"),
    ("`a ,b` , c", "`a ,b` , c"),
    ("Yes ,no!Or", "Yes, no! Or"),
    ("Homer,*Iliad*,1", "Homer, *Iliad*, 1"),
    ("*Stop,*now", "*Stop,*now"),
    ("f(x,g(y,'z)')) done,ok", "f(x,g(y,'z)')) done, ok"),
    ("see /etc/a,b/c and D:\\x,y", "see /etc/a,b/c and D:\\x,y"),
    ("1,000 12:30 a:b a.b", "1,000 12:30 a:b a.b"),
    ("𠮷 , 好", "𠮷，好"),
    ("((中)a)", "（（中）a）"),
    ("(未闭 , 合", "(未闭，合"),
    ("", ""),
]


@pytest.mark.parametrize("before,after", CASES)
def test_normalize(before, after):
    assert N.normalize_text(before) == after
    assert N.normalize_text(after) == after


def test_table_text_keeps_lines_and_tabs():
    assert N.normalize_table_text(" 单 元 ( 格 )\r\n\n A,b\t2.5 ") == "单元（格）\r\n\nA, b\t2.5"


def test_spans_move_with_edits():
    text = "Oh,my 漢 字..."
    out, spans = N.moved_spans(text, [{"start": 6, "end": 9, "text": "かんじ"}, {"start": 0, "end": 2}, {"start": 2, "end": 2}])
    assert out == "Oh, my 漢字……"
    assert [out[s["start"] : s["end"]] for s in spans] == ["漢字", "Oh"]


def test_column_equals_function_and_prefilter_is_safe(spark):
    texts = [t for pair in CASES for t in pair] + ["plain text only.", "a b", "x  y", "é, a", None, "tail "]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    rows = df.select("text", N.changeable(F.col("text")).alias("may"), N.normalized(F.col("text")).alias("out"), N.normalized(F.col("text"), True).alias("cell")).collect()
    for r in rows:
        assert r.out == N.normalize_text(r.text) and r.cell == N.normalize_table_text(r.text)
        assert r.may or r.text is None or r.out == r.text


@pytest.mark.parametrize(
    "value,total,expected",
    [
        ("1，3-5, 8", 10, [0, 2, 3, 4, 7]), ("", 3, [0, 1, 2]), (" 2 - 3 ", 3, [1, 2]), ("0", 5, None), ("3-2", 5, None), ("6", 5, None), ("1,,2", 5, None), ("a", 5, None), ("-1", 5, None), ("1-", 5, None),
        ("1-2-3", 5, None), ("1234567890", 5, None), ("1", 0, None), ("1," * 1500 + "1", 5, None), ("2,1,2", 2, [0, 1]), (None, 3, None),
    ],
)
def test_page_range(spark, value, total, expected):
    df = spark.createDataFrame([(value, total)], "v string, t int")
    assert df.select(X.page_range(F.col("v"), F.col("t"))).first()[0] == expected


def test_resume_prefix(spark):
    df = spark.createDataFrame([([0, 2, 4], [0]), ([0, 2, 4], [2]), ([0, 2], []), ([0], [0])], "s array<int>, c array<int>")
    assert [r[0] for r in df.select(X.resume_prefix(F.col("s"), F.col("c"))).collect()] == [[2, 4], None, [0, 2], []]


def test_names(spark):
    names = ["a/b:c?.", "  ", "con.txt", "COM1", "com12", "x" * 200, "ok name. "]
    got = [r[0] for r in spark.createDataFrame([(n,) for n in names], "n string").select(X.safe_name(F.col("n"))).collect()]
    assert got == ["a_b_c_", X.DEFAULT_NAME, "_con.txt", "_COM1", "com12", "x" * 160, "ok name"]
    paths = ["C:\\d\\f.tar.gz", "/a/.hidden", "noext", "a.b/", ""]
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    assert [r[0] for r in df.select(X.stem(X.base_name(F.col("p")))).collect()] == ["f.tar", ".hidden", "noext", "a", ""]
    assert [r[0] for r in df.select(X.extension(F.col("p"))).collect()][:3] == ["gz", "hidden", ""]


def test_similarity_bounds(spark):
    rows = [("abc", "abc"), ("", ""), ("a", ""), ("abcd", "abce")]
    got = [r[0] for r in spark.createDataFrame(rows, "a string, b string").select(X.similarity(F.col("a"), F.col("b"))).collect()]
    assert got == [1.0, 1.0, 0.0, 0.75]


def test_margin_keys(spark):
    rows = [("Title 12", [0.0, 10.0, 9.0, 30.0]), (" – 7 – ", [0.0, 770.0, 9.0, 790.0]), ("body", [0.0, 300.0, 9.0, 320.0]), ("x" * 101, [0.0, 10.0, 9.0, 30.0]), ("no box", [])]
    got = [r[0] for r in spark.createDataFrame(rows, "t string, b array<double>").select(X.margin_key(F.col("t"), F.col("b"), F.lit(800.0))).collect()]
    assert got == ["top:Title #", "page-number", "", "", ""]


def test_whole_texts_are_normalised(spark, tmp_path):
    from pagemill.plans import catalog

    texts = {1: "你好, 世界.", 2: "Hello，world ！", 3: "第 1 章 (附录)\r\n\n\n\nx ", 4: "https://a.b/c,d é 漢字 ( x )", 5: "plain text 12.5", 6: "等等...", 7: "", 8: None}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r.text for r in catalog.QUERIES["normalize_whole_text"](spark, str(tmp_path)).collect()}
    assert got == {k: N.normalize_text(t) for k, t in texts.items()}
    assert (got[1], got[2], got[6]) == ("你好，世界。", "Hello, world!", "等等……")


def test_whole_texts_are_cleaned_as_plainly(spark):
    """The query normalize_whole_text sends only what can change to Python; row by row the same as the plain function."""
    from pagemill.plans import catalog

    from .conftest import DATA

    got = {r.doc_id: r.text for r in catalog.QUERIES["normalize_whole_text"](spark, DATA).collect()}
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()
    assert got == {r.doc_id: N.normalize_text(r.text) for r in docs} and len(got) == len(docs)


def test_sizes_beyond_a_long(spark, tmp_path):
    keys = [1, 3, 128, 524_287, 524_288, 900_000, 899_999, 700_001]
    spark.createDataFrame([(k, k) for k in keys], "o_orderkey long, o_custkey long").write.parquet(str(tmp_path / "orders.parquet"))
    cents = lambda n: (n * 100 + 2**29) // 2**30
    got = {r.task_id: r.size for r in catalog.format_bytes(spark, str(tmp_path)).filter("task_id < 1000000").collect()}
    assert got.pop(1) == "64 B" and got.pop(3) == "1.7 KB" and got.pop(128) == "128.0 MB"
    assert got == {k: f"{cents(k**3 * 64) // 100}.{cents(k**3 * 64) % 100:02d} GB" for k in got} and len(got) == 5
