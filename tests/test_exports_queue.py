import io
import os
import zipfile

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pagemill.operators import exports, pages, queue
from pagemill.plans import catalog, goldens
from pagemill.schema import ExportOptions
from pagemill.sources import payloads

from .conftest import DATA

ITEMS = "id string, file_name string, profile string, mode string, has_text boolean, n_tables int"
TWO = [("a", "d\\scan.pdf", "fast", "text", True, 0), ("b", "/x/scan.pdf", "fast", "table", True, 2)]


def test_separate_and_combined_plans(spark):
    items = spark.createDataFrame(TWO, ITEMS)
    names = sorted((r.name, r.format, r.ids[0]) for r in exports.planned(items, ["txt", "xlsx", "html"], ExportOptions(prefix="{mode}-", date="2024-05-06", suffix="_{date}")).collect())
    assert names == [("文字-scan_2024-05-06.text.html", "html", "a"), ("文字-scan_2024-05-06.txt", "txt", "a"), ("表格-scan_2024-05-06.tables.html", "html", "b"), ("表格-scan_2024-05-06.txt", "txt", "b"), ("表格-scan_2024-05-06.xlsx", "xlsx", "b")]
    one = {r.format: r for r in exports.planned(items, ["txt", "xlsx", "html"], ExportOptions(grouping="combined", name="all", suffix="-{profile}{mode}")).collect()}
    assert {f: r.name for f, r in one.items()} == {"txt": "all-轻量混合.txt", "xlsx": "all-轻量混合.xlsx", "html": "all-轻量文字.html"}
    assert list(one["html"].ids) == ["a", "b"] and list(one["xlsx"].ids) == ["b"]
    three = items.union(spark.createDataFrame([("0", "late.pdf", "fast", "text", True, 1)], ITEMS)).withColumn("ord", F.when(F.col("id") == "0", 9).otherwise(F.ascii("id") - 97))
    assert list(exports.planned(three, ["html"], ExportOptions(grouping="combined")).first().ids) == ["a", "0", "b", "0"]
    for bad in ([], ["pdf"]):
        with pytest.raises(ValueError):
            exports.planned(items, bad)


def test_collisions(tmp_path):
    (tmp_path / "a.txt").write_text("old")
    names = ["a.txt", "a.txt", "b.text.html", "b.text.html"]
    assert exports.resolve(names, tmp_path) == [("a (2).txt", "create"), ("a (3).txt", "create"), ("b.text.html", "create"), ("b.text (2).html", "create")]
    assert exports.resolve(names[:2], tmp_path, "overwrite") == [("a.txt", "overwrite"), ("a (2).txt", "create")]
    assert exports.resolve(names[:1], tmp_path, "skip") == [("a.txt", "skip")]
    (tmp_path / "dir.txt").mkdir()
    os.symlink(tmp_path / "a.txt", tmp_path / "link.txt")
    for bad in ("dir.txt", "link.txt"):
        with pytest.raises(ValueError):
            exports.resolve([bad], tmp_path, "overwrite")


def test_combined_text(spark):
    texts = spark.createDataFrame([(1, "b.png", "<two>", "text", None), (0, "a's.pdf", "one", "table", None), (2, "c", "three", "text", "<ruby>x</ruby>")], "ord int, file_name string, text string, mode string, html string")
    tables_ = spark.createDataFrame([(0, 1, "a's.pdf", "<table>2</table>"), (0, 0, "a's.pdf", "<table>1</table>")], "ord int, table_ord int, file_name string, html string")
    got = {r.format: r.text for r in exports.combined(texts, tables_).collect()}
    assert got["txt"] == "—— a's.pdf ——\none\n\n—— b.png ——\n<two>\n\n—— c ——\nthree"
    assert got["html"] == "b.png\n&lt;two&gt;\n\nc\n<ruby>x</ruby>\n\na&#x27;s.pdf\n<table>1</table>\n\na&#x27;s.pdf\n<table>2</table>"


def test_pack_is_copied_or_the_old_one_stays(spark, tmp_path, monkeypatch):
    source, target = tmp_path / "pack", tmp_path / "models"
    (source / "m").mkdir(parents=True)
    (source / "m" / "inference.yml").write_bytes(b"abc")
    good = "ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad"
    files = lambda digest: spark.createDataFrame([("m/inference.yml", 3, digest)], "path string, size long, sha256 string")
    exports.copy_pack(files(good), str(source), str(target))
    (target / "mark").write_text("old")
    with pytest.raises(Exception):
        exports.copy_pack(files("0" * 64), str(source), str(target))
    assert (target / "mark").exists() and not (tmp_path / "models.staged").exists()
    rename = os.rename
    monkeypatch.setattr(os, "rename", lambda a, b: (_ for _ in ()).throw(OSError("full")) if str(a).endswith(".staged") else rename(a, b))
    with pytest.raises(OSError):
        exports.copy_pack(files(good), str(source), str(target))
    monkeypatch.undo()
    assert (target / "mark").exists()
    exports.copy_pack(files(good), str(source), str(target))
    assert not (target / "mark").exists() and not (tmp_path / "models.old").exists()
    monkeypatch.setattr(exports, "SPARE_BYTES", 1 << 62)
    with pytest.raises(OSError):
        exports.copy_pack(files(good), str(source), str(target))


def test_a_run_publishes_all_or_nothing(spark, tmp_path):
    files = spark.range(40).select(F.concat("id", F.lit(".txt")).alias("name"), F.encode(F.concat(F.lit("new "), "id"), "UTF-8").alias("content"), F.when(F.col("id") % 4 == 0, "overwrite").when(F.col("id") % 4 == 1, "skip").otherwise("create").alias("action")).repartition(8)
    for i in (0, 4):
        (tmp_path / f"{i}.txt").write_text("old")
    before = {p.name: p.read_text() for p in tmp_path.iterdir()}
    broken = files.withColumn("content", F.when(F.col("name") == "22.txt", F.raise_error(F.lit("a task fails")).cast("binary")).otherwise(F.col("content")))
    with pytest.raises(Exception, match="a task fails"):
        exports.publish(broken, str(tmp_path))
    assert {p.name: p.read_text() for p in tmp_path.iterdir()} == before
    (tmp_path / "38.txt").write_text("another's")  # found only when names are given
    with pytest.raises(Exception):
        exports.publish(files, str(tmp_path))
    assert {p.name: p.read_text() for p in tmp_path.iterdir()} == before | {"38.txt": "another's"}
    (tmp_path / "38.txt").unlink()
    for _ in range(2):
        exports.publish(files, str(tmp_path))
        assert {p.name: p.read_text() for p in tmp_path.iterdir()} == {f"{i}.txt": f"new {i}" for i in range(40) if i % 4 != 1}


def test_publish(spark, tmp_path):
    (tmp_path / "o.txt").write_text("old")
    rows = [("n.txt", b"new", "create"), ("o.txt", b"over", "overwrite"), ("s.txt", b"no", "skip")]
    df = spark.createDataFrame(rows, "name string, content binary, action string")
    assert sorted(r.name for r in exports.publish(df, str(tmp_path)).collect()) == ["n.txt", "o.txt"]
    assert {p.name: p.read_text() for p in tmp_path.iterdir()} == {"n.txt": "new", "o.txt": "over"}
    exports.publish(df, str(tmp_path))  # a repeated run finds its own files
    with pytest.raises(Exception):
        exports.publish(df.withColumn("content", F.lit(b"else")), str(tmp_path))


@pytest.mark.parametrize("name", ["listed_files", "published_files"])
def test_files_of_one_round_are_on_disk(spark, monkeypatch, name):
    at_once, folders, publish = [], set(), exports.publish

    def counted(contents, directory):
        out = publish(contents, directory)
        folders.add(directory)
        at_once.append(sum(len(os.listdir(f)) for f in folders if os.path.exists(f)))
        return out

    monkeypatch.setattr(goldens, "AT_ONCE", 400, raising=False)
    monkeypatch.setattr(exports, "publish", counted)
    got = [r.name for r in catalog.QUERIES[name](spark, DATA).select("name").collect()]
    keys = spark.read.parquet(f"{DATA}/orders.parquet").select(F.concat(F.col("o_orderkey").cast("string"), F.lit(".txt"))).collect()
    assert sorted(got) == sorted(k[0] for k in keys) and len(got) == 1500
    assert max(at_once) < 600 and len(folders) == 4 and not any(os.path.exists(f) for f in folders)


def test_exported_ids(spark):
    plan = spark.createDataFrame([(["a"], "create"), (["a"], "skip"), (["b", None], "overwrite"), (["c"], "skip")], "ids array<string>, action string")
    written, whole = exports.exported_ids(plan)
    assert sorted(r.id for r in written.collect()) == ["a", "b"] and [r.id for r in whole.collect()] == ["b"]


def test_workbook(tmp_path):
    cell = {"row": 0, "column": 0, "row_span": 1, "col_span": 2, "text": "=1+1 <&>"}
    path = tmp_path / "t.xlsx"
    exports.write_xlsx(str(path), [{"page_index": 1, "end_page_index": 3, "table_index": 0, "source": "a/b:c" + "x" * 30, "rows": [[cell], [{**cell, "row": 1, "col_span": 1, "column": 27}]]}] * 2)
    with zipfile.ZipFile(path) as z:
        sheet = z.read("xl/worksheets/sheet1.xml").decode()
        book = z.read("xl/workbook.xml").decode()
    assert 't="inlineStr"' in sheet and "=1+1 &lt;&amp;&gt;" in sheet and 'ref="A1:B1"' in sheet and 'r="AB2"' in sheet and "<f>" not in sheet
    assert 'name="a_b_cxxxxxxxxxxx-P2-4-T1"' in book and 'name="a_b_cxxxxxxxxxxx-P2-4-T2"' in book
    assert exports.page_label(0, 0, 4, 0)[0] == "P1-T5"  # a table number of 0 counts as missing


def test_html_pages():
    assert "<script>" not in exports.text_page("<script>x</script><ruby>a<rt>b</rt></ruby>") and "<ruby>a<rt>b</rt></ruby>" in exports.text_page("<ruby>a<rt>b</rt></ruby>")
    assert "&lt;t&gt;" in exports.tables_page("<t>", [("P1", "<table></table>")])


def test_admission_and_natural_order(spark):
    files = spark.createDataFrame([(p, i) for i, p in enumerate(["C:/s/p10.png", "C:/s/p2.png", "C:/s/P1.PNG", "C:/s/p02.png", "c:/S/p10.PNG", "/b/x.txt", "/q/old.pdf"])], "path string, ordinal int")
    out = queue.admit(files, spark.createDataFrame([("/q/old.pdf",)], "path string"), "b1").orderBy("batch_index").collect()
    assert [r.path for r in out] == ["C:/s/P1.PNG", "C:/s/p2.png", "C:/s/p02.png", "C:/s/p10.png"] and [r.batch_index for r in out] == [0, 1, 2, 3]


def test_queue(spark):
    tasks = spark.createDataFrame([("a", 0, "done", "/a"), ("b", 1, "queued", "/b"), ("c", 2, "running", "/c"), ("d", 3, "queued", "/d")], "task_id string, place int, status string, path string").withColumn("page_range", F.lit("1"))
    assert queue.next_task(tasks).first().task_id == "b"
    assert [r.task_id for r in queue.moved(tasks, "a", 2).orderBy("place").collect()] == ["b", "c", "a", "d"]
    assert [r.task_id for r in queue.moved(tasks, "d", 1).orderBy("place").collect()] == ["a", "d", "b", "c"]
    back = {r.task_id: (r.status, r.partial) for r in queue.restored(tasks).collect()}
    assert back["c"] == ("queued", True) and back["a"] == ("done", False)
    with pytest.raises(Exception):
        queue.restored(tasks.union(tasks.limit(1))).collect()


def test_models(spark):
    need = queue.required_models(spark.createDataFrame([("fast", "text"), ("fast", "table")], "profile string, mode string"))
    assert need.count() == 4
    with pytest.raises(Exception):
        queue.required_models(spark.createDataFrame([("slow", "text")], "profile string, mode string")).collect()
    files = spark.createDataFrame([("SLANet_plus", f, 6) for f in ("inference.pdiparams", "inference.pdmodel", "inference.yml")] + [("PP-OCRv5_mobile_det", "inference.yml", 0)], "name string, file string, size long")
    states = {r.name: r.state for r in queue.model_states(need, files).collect()}
    assert states["SLANet_plus"] == "ready" and states["PP-OCRv5_mobile_det"] == "incomplete" and states["PicoDet_layout_1x_table"] == "missing"
    total = queue.cache_totals(queue.model_states(need, files)).first()
    assert (total.installed, total.size_bytes, total.models, total.installed_models) == (False, 18, 4, 1)


def test_resume_needs_known_size(spark):
    cols = "task_id string, page_count int, selected_count int, total_count int, profile string, result_type string, threshold double, page_range string, rotation int, pdf_source string, ruby_enabled boolean, source_size long, source_mtime_ns long"
    good = ("a", 1, 3, 9, "fast", "text", 0.5, None, None, "auto", None, 7, 8)
    variants = {"same": good, "size": (*good[:11], None, 8), "done": ("a", 3, *good[2:]), "empty": ("a", 0, *good[2:]), "threshold": (*good[:6], 0.6, *good[7:]), "ruby": (*good[:10], True, 7, 8)}
    asked = spark.createDataFrame([good], cols).withColumns({"page_range": F.lit(""), "rotation": F.lit(0), "ruby_enabled": F.lit(False)})
    for name, row in variants.items():
        stored = spark.createDataFrame([row], cols)
        got = stored.alias("r").join(asked.drop("page_count", "selected_count", "total_count").alias("o"), F.col("r.task_id") == F.col("o.task_id")).select(pages.can_resume()).first()[0]
        assert got == (name == "same"), name


def test_payloads(spark):
    text = '{"res": {"page_index": 3, "rec_texts": [" a ", " ", "b"], "rec_scores": [0.5, 0.6], "rec_polys": [[[0,0],[1,1]]], "rec_boxes": [[1,2,3,4],[9,9,9,9],[5,6,7,8]]}}'
    table = '{"page_index": 4, "overall_ocr_res": {"rec_texts": ["t"]}, "layout_det_res": {"boxes": [{"label": "text"}, {"label": "Table", "score": 0.7, "coordinate": [0,0,9,9]}]}, "table_res_list": [{"cell_box_list": [[1,2,3,4],[0,5,6,7]], "pred_html": "<tr><td>x</td><td>y</td></tr>"}, {"cell_box_list": [], "pred_html": ""}]}'
    df = spark.createDataFrame([("t", text), ("t", table), ("t", "broken")], "task_id string, payload string")
    out = {r.page_index: r for r in payloads.pages(df).collect()}
    assert out[3].text == "a\nb" and [(b.text, b.score, b.box) for b in out[3].blocks] == [("a", 0.5, [1, 2, 3, 4]), ("b", 0.0, [5, 6, 7, 8])]
    assert out[4].text == "t" and out[None].text == ""
    t = payloads.tables(df)
    got = {r.table_index: r for r in t.collect()}
    assert got[0].score == 0.7 and got[0].box == [0, 2, 6, 7] and got[0].rows[0][1].box == [0, 5, 6, 7]
    assert got[1].score is None and got[1].box == [] and got[1].rows == []
    assert [(r.text, r.row, r.column) for r in payloads.cells(t).orderBy("column").collect()] == [("x", 0, 0), ("y", 0, 1)]


def test_rendered_files(spark):
    texts = spark.createDataFrame([("d\\a.pdf", "x"), ("", None)], "file_name string, text string")
    assert [(r.name, bytes(r.content)) for r in exports.text_files(texts).collect()] == [("a.txt", b"x"), ("识别结果.txt", b"")]
    cells = spark.createDataFrame([("t", 0, 1, 0, 1, 0, 0, 0, 0, 1, 1, "v")], "task_id string, page_index int, end_page_index int, table_index int, source_table_count int, row_ord int, cell_ord int, row int, column int, row_span int, col_span int, text string")
    assert bytes(exports.workbooks(cells).first().content).startswith(b"PK")


def test_manifest_and_history(spark):
    good = '{"schema": 1, "runtime": "r", "capabilities": [{"profile": "fast", "mode": "text"}], "files": [{"path": "p/f", "size": 3, "sha256": "x"}]}'
    packs = lambda *json: spark.createDataFrame([(j,) for j in json], "json string")
    able, files = queue.manifest(packs(good), 1, "r")
    assert able.count() == 1 and files.first().path == "p/f"
    for bad, runtime in ((good, "other"), ("{", "r"), ("{}", "r")):
        with pytest.raises(Exception):
            queue.manifest(packs(bad), 1, runtime)[1].collect()
    history = spark.createDataFrame([("a", "n")], "task_id string, file_name string")
    stored = spark.createDataFrame([("a", 1, "two"), ("a", 0, "one")], "task_id string, page_index int, text string")
    assert [p.text for p in queue.history_entry(history, stored, "a").first().pages] == ["one", "two"]
    with pytest.raises(Exception):
        queue.history_entry(history, stored, "b").collect()


def test_information_and_start(spark):
    tasks = spark.createDataFrame([("a", "/x.pdf", 9, "2-4"), ("b", "/y.PDF", 2, "7"), ("c", "/z.png", 1, "")], "task_id string, path string, total int, page_range string")
    listing = spark.createDataFrame([("/x.pdf", 5)], "path string, length long").withColumn("modification_time", F.lit(None).cast("timestamp"))
    got = {r.task_id: (r.selected_count, r.range_error, r.source_size) for r in pages.document_info(tasks, listing).collect()}
    assert got["a"] == (3, None, 5) and got["b"][1:] == ("bad-token", None) and "c" not in got
    assert spark.range(1).select(pages.least_score(F.array(F.lit(0.4), F.lit(0.2))), pages.least_score(F.array().cast("array<double>"))).first()[:] == (0.2, 0.0)
    results = spark.createDataFrame([("a", "fast", "text", "text", "old", False, None, 9, 3, 0, 10)], "task_id string, profile string, result_type string, task_mode string, text string, text_edited boolean, edited_pages int, total_count int, selected_count int, rotation int, elapsed_ms int")
    stored = spark.createDataFrame([("a", 1, "p1", 2, 1), ("a", 0, "p0", 1, 0)], "task_id string, page_index int, text string, n_blocks int, n_tables int")
    start = pages.begun(tasks.filter("task_id = 'a'"), results, stored).first()
    assert (start.text, start.page_count, start.block_count, start.table_count, start.partial) == ("p0\n\np1", 2, 3, 1, True)
    assert pages.headers(results).first().text is None


def test_workbooks_in_batches(spark):
    cell = "task_id string, page_index int, table_index int, row_ord int, cell_ord int, row int, column int, row_span int, col_span int, text string, end_page_index int"
    rows = [(f"t{i}", p, 0, r, 0, r, 0, 1, 1, None if r else f"p{p}", p) for i in range(600) for p in (1, 0) for r in (1, 0)]
    books = exports.workbooks(spark.createDataFrame(rows, cell).repartition(3))
    assert "InPandas" not in books._jdf.queryExecution().executedPlan().toString() and books.rdd.getNumPartitions() == 4
    got = {r.task_id: bytes(r.content) for r in books.collect()}
    assert len(got) == 600
    with zipfile.ZipFile(io.BytesIO(got["t7"])) as z:
        first, second = (z.read(f"xl/worksheets/sheet{n}.xml").decode() for n in (1, 2))
    assert "p0" in first and "p1" in second and first.count("<c ") == 2 and first.index('r="A1"') < first.index('r="A2"')


def test_names_are_given_and_taken_back_again_by_tasks(spark, tmp_path):
    (tmp_path / "o.txt").write_text("old")
    run = tmp_path / ".run-x"
    run.mkdir()
    rows = pa.RecordBatch.from_pylist([{"name": n, "content": c, "action": a} for n, c, a in (("n.txt", b"new", "create"), ("o.txt", b"over", "overwrite"), ("s.txt", b"no", "skip"))])
    (own,) = [b.column(0)[0].as_py() for b in exports._staged(str(run))([rows])]
    for _ in range(2):  # a naming task that is tried again finds its own names
        exports._name(str(run), own, str(tmp_path))
        assert {p.name: p.read_text() for p in tmp_path.glob("*.txt")} == {"n.txt": "new", "o.txt": "over"}
    for _ in range(2):
        exports._take_back(str(run), own, str(tmp_path))
        assert {p.name: p.read_text() for p in tmp_path.glob("*.txt")} == {"o.txt": "old"}
