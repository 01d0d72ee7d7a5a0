import json
import os
import random
import re

import pytest
from pyspark.sql import functions as F

from pagemill.schema import EDITS, EVENTS
from pagemill.sources import files
from pagemill.sources.store import Conflict, SaveChain, Store
from pagemill.streaming import exports as E
from pagemill.streaming import pages as S

PAGES = "task_id string, page_index int, text string"


def test_store(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    tasks = spark.createDataFrame([("a", "x"), ("b", "y")], "task_id string, path string")
    assert store.load() is None
    v1 = store.save(tasks, spark.createDataFrame([("a", 1, "one"), ("a", 0, "zero")], PAGES), None)
    with pytest.raises(Conflict):
        store.save(tasks, spark.createDataFrame([], PAGES), None)
    v2 = store.save(tasks, spark.createDataFrame([("a", 1, "new"), ("b", 5, "b")], PAGES), v1)
    got = {r.task_id: [(p.page_index, p.text) for p in r.pages] for r in store.load().collect()}
    assert got == {"a": [(0, "zero"), (1, "new")], "b": [(5, "b")]}
    v3 = store.save(tasks, spark.createDataFrame([("a", 9, "again")], PAGES), v2, reset=tasks.filter("task_id = 'a'"))
    assert {(r.task_id, r.page_index) for r in store.pages().collect()} == {("a", 9), ("b", 5)}
    with pytest.raises(ValueError):
        store.remove(tasks.filter("task_id = 'b'"), tasks, v3)
    store.remove(tasks.filter("task_id = 'b'"), tasks.limit(0), v3)
    assert [(r.task_id, len(r.pages)) for r in store.load().collect()] == [("a", 1)]


def stored(store):
    return {(r.task_id, r.page_index): r.text for r in store.pages().collect()}


def test_a_save_writes_what_has_changed(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    tasks = spark.range(100).selectExpr("cast(id as string) as task_id")
    base = tasks.selectExpr("task_id", "explode(sequence(0, 9)) as page_index").selectExpr("task_id", "page_index", "concat(task_id, '/', page_index) as text")
    want = {(r.task_id, r.page_index): r.text for r in base.collect()}
    v = store.save(tasks, base, None)
    for i in range(20):
        v = store.save(tasks, base.filter(f"task_id = '{i % 7}'").selectExpr("task_id", "page_index", f"'save {i}' as text"), v)
        want |= {(str(i % 7), p): f"save {i}" for p in range(10)}
        layers = store.layers()
        assert len(layers) <= 8 and layers[0]["rows"] >= 1000 and sum(x["rows"] for x in layers[1:]) <= 200
        if i == 3:
            assert layers[-1]["rows"] == 10 and len(layers[-1]["there"]) == 1  # 1 % of the pages
    assert stored(store) == want
    v = store.save(tasks.filter("task_id <> '5'"), base.limit(0), v, reset=tasks.filter("task_id = '3'"))
    v = store.save(tasks, base.filter("task_id = '5' and page_index = 2"), v)
    for i in range(9):  # through a compaction of layers with resets
        v = store.save(tasks, base.filter("task_id = '8'").selectExpr("task_id", "page_index", f"'again {i}' as text"), v)
    want = {k: t for k, t in want.items() if k[0] not in ("3", "5")} | {("5", 2): "5/2"} | {("8", p): "again 8" for p in range(10)}
    assert stored(store) == want
    one = store.pages(tasks.filter("task_id = '8'"))
    assert {(r.task_id, r.text) for r in one.collect()} == {("8", "again 8")}
    scans = re.findall(r"FileScan parquet \[([^\]]*)\].*?PartitionFilters: \[([^\]]*)\]", one._jdf.queryExecution().executedPlan().toString())
    pages = [filters for columns, filters in scans if "page_index" in columns]
    assert pages and all("bucket" in f for f in pages)
    assert not [d for d in store.vacuum() if d] and store.vacuum(0) and stored(store) == want


def test_new_columns_and_locks(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    tasks = spark.createDataFrame([("a",), ("b",)], "task_id string")
    v = store.save(tasks, spark.createDataFrame([("a", 0, "x"), ("b", 0, "y")], PAGES), None)
    v = store.save(tasks, spark.createDataFrame([("a", 0, "z", 5)], PAGES + ", score int"), v)
    assert {(r.task_id, r.text, r.score) for r in store.pages().collect()} == {("a", "z", 5), ("b", "y", None)}
    lock = tmp_path / "session.version.lock"
    lock.write_text("alive")
    with pytest.raises(Conflict):
        store.save(tasks, spark.createDataFrame([], PAGES), v)
    assert lock.read_text() == "alive" and store.version() == v
    os.utime(lock, (0, 0))  # its writer died long ago
    assert store.save(tasks, spark.createDataFrame([], PAGES), v) == store.version() and not lock.exists()
    assert len(stored(store)) == 2


def test_failed_saves_go_with_the_next(spark, tmp_path, monkeypatch):
    store = Store(spark, str(tmp_path / "store"))
    chain = SaveChain(store, str(tmp_path / "log"))
    tasks = spark.createDataFrame([("a",), ("b",)], "task_id string")
    pages = lambda *rows: spark.createDataFrame(rows, PAGES + ", arrival long")

    def failing(*args, **more):
        raise OSError("no")

    chain.save(tasks, pages(("a", 0, "first", 1), ("b", 0, "b", 2), ("a", 7, "old", 2)))
    with monkeypatch.context() as m:
        m.setattr(store, "save", failing)
        for rows, reset in (([("a", 0, "failed", 3), ("a", 1, "one", 3)], None), ([("b", 0, "late", 1), ("b", 1, "b1", 4)], None), ([("a", 2, "two", 5)], tasks.filter("task_id = 'a'"))):
            with pytest.raises(OSError):
                chain.save(tasks, pages(*rows), reset)
    assert len(chain.pending()) == 3 and stored(store) == {("a", 0): "first", ("b", 0): "b", ("a", 7): "old"}
    again = SaveChain(store, str(tmp_path / "log"))  # another process
    again.save(tasks, pages(("a", 2, "newer", 6)))
    assert stored(store) == {("a", 2): "newer", ("b", 0): "b", ("b", 1): "b1"} and not again.pending()


def test_lines_of_growing_files(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    line = lambda i, text="x": json.dumps(dict(zip([x.split()[0] for x in EVENTS.split(", ")], (1, "a", i, text, 1, 0, i))))
    big = "é" * 300
    steps = [
        {"1.json": line(0) + "\n" + line(1)[:20], "2.json": "", ".hidden": line(99) + "\n"}, {"1.json": line(1)[20:]}, {"1.json": "\r\n" + line(2) + "\nnot json\n\n{}\n" + line(3, big)[:100]},
        {"1.json": line(3, big)[100:] + "\n", "2.json": line(4) + "\n" + line(5) + "\n" + line(6)}, {"2.json": "\n"}, {},
    ]
    spark.dataSource.register(files.GrowingLines)
    seen = []
    for step in steps:
        for name, text in step.items():
            with open(source / name, "ab") as f:
                f.write(text.encode())
        for q, df in (("out", files.event_lines(spark, str(source))), ("raw", spark.readStream.format("growing_lines").option("path", str(source)).option("piece", "50").load())):
            df.writeStream.format("parquet").option("path", str(tmp_path / q)).option("checkpointLocation", str(tmp_path / f"{q}-check")).trigger(availableNow=True).start().awaitTermination()
        seen.append(sorted(r.page_index for r in spark.read.parquet(str(tmp_path / "out")).collect()))
    assert seen == [[0], [0], [0, 1, 2], [0, 1, 2, 3, 4, 5], list(range(7)), list(range(7))]
    raw = sorted(r.line for r in spark.read.parquet(str(tmp_path / "raw")).collect())  # pieces shorter than lines
    assert raw == sorted([*(line(i, big if i == 3 else "x") for i in range(7)), "not json", "", "{}"])
    reader = files._LinesReader({"path": str(source)})
    at = reader.latestOffset()
    (source / "1.json").write_text(line(8) + "\n")  # begun anew
    assert [x for p in reader.partitions(at, reader.latestOffset()) for _, x in reader.read(p)] == [line(8)]


def test_edits_and_pages_in_any_order(spark, tmp_path):
    names = [x.split()[0] for x in EDITS.split(", ")]
    page = lambda t, p, text, n: (1, t, p, text, 1, 0, n, "page", None)
    edit = lambda t, text, k, n: (1, t, None, text, 0, 0, n, "edit", k)
    rows = [page("a", 0, "a0", 1), page("a", 1, "a1", 2), edit("a", "older", 2, 3), edit("a", "mine", 1, 4), page("a", 2, "a2", 5), page("b", 3, "b3", 6), page("b", 1, "b1", 7), edit("c", "all", None, 8), page("c", 0, "c0", 9), page("a", 1, "again", 10)]
    want = {"a": "mine\n\na1\n\na2", "b": "b1\n\nb3", "c": "all"}
    for turn, order in enumerate([rows, rows[::-1], rows[5:] + rows[:5]]):
        at = tmp_path / str(turn)
        (at / "in").mkdir(parents=True)
        for n in range(0, len(rows), 4):
            (at / "in" / f"{n}.json").write_text("\n".join(json.dumps(dict(zip(names, r))) for r in order[n : n + 4]) + "\n")
        events = files.event_stream(spark, str(at / "in"), 1, EDITS)
        S.store_pages(events.filter("kind = 'page'").drop("kind", "edited_pages"), str(at / "pages"), str(at / "c1")).awaitTermination()
        S.store_edits(events, str(at / "edits"), str(at / "c2")).awaitTermination()
        assert {r.task_id: r.text for r in S.current_texts(spark, str(at / "pages"), str(at / "edits")).collect()} == want


EVENT_ROWS = [(1, "a", 1, "first", 2, 0, 1), (1, "a", 1, "again", 9, 9, 2), (0, "a", 7, "old process", 1, 1, 3), (1, "a", 0, "zero", 1, 1, 4), (1, "b", 0, "b", 3, 0, 5)]


def write_events(folder, rows, name):
    names = [x.split()[0] for x in EVENTS.split(", ")]
    (folder / name).write_text("\n".join(json.dumps(dict(zip(names, r))) for r in rows) + "\nnot json\n")


def test_pages_stream_first_copies_and_equal_a_batch(spark, tmp_path):
    source, out, check = tmp_path / "in", tmp_path / "out", tmp_path / "check"
    source.mkdir()
    write_events(source, EVENT_ROWS[:2], "1.json")
    seen = []

    def after(batch, number):
        seen.append(batch.count())
        raise RuntimeError("an export failed")

    for step in (1, 2):
        stream = S.current(files.event_stream(spark, str(source)), 1)
        S.store_pages(stream, str(out), str(check), after).awaitTermination()
        if step == 1:
            write_events(source, EVENT_ROWS[2:], "2.json")
    stored = S.stored_pages(spark, str(out))
    assert {(r.task_id, r.page_index, r.text) for r in stored.collect()} == {("a", 1, "first"), ("a", 0, "zero"), ("b", 0, "b")} and sum(seen) == 3
    assert spark.read.parquet(f"{out}-failed").count() >= 2


def test_documents_are_exported_once_when_they_are_complete(spark, tmp_path):
    source, out, to = tmp_path / "in", str(tmp_path / "out"), tmp_path / "to"
    source.mkdir()
    to.mkdir()
    selected = spark.createDataFrame([("a", 2, "a.pdf"), ("b", 2, "b.pdf"), ("c", 1, "c.pdf")], "task_id string, selected_count int, file_name string")
    steps = [[(1, "a", 1, "one", 1, 0, 5), (1, "a", 1, "again", 1, 0, 6), (1, "b", 0, "b", 1, 0, 7), (1, "x", 0, "unknown", 1, 0, 8)], [(1, "a", 1, "early", 1, 0, 1), (1, "c", 0, "c", 1, 0, 9)], [(1, "a", 0, "zero", 1, 0, 10)], [(1, "a", 2, "more", 1, 0, 11), (1, "a", 0, "late", 1, 0, 12)]]
    states = []
    for n, rows in enumerate(steps):
        write_events(source, rows, f"{n}.json")
        S.store_pages(files.event_stream(spark, str(source)), out, str(tmp_path / "check")).awaitTermination()
        E.export_as_completed(spark, out, selected, str(to), str(tmp_path / "states"), str(tmp_path / "exported")).awaitTermination()
        got = spark.read.schema("task_id string, name string, state string").parquet(str(tmp_path / "states")).collect() if (tmp_path / "states").exists() else []
        states.append(sorted((r.task_id, r.state) for r in got))
    assert states == [[], [("c", "written")], [("a", "written"), ("c", "written")], [("a", "written"), ("c", "written")]]
    assert (to / "a.txt").read_text(encoding="utf-8-sig").replace("\r", "") == "zero\n\nearly" and len(list(to.iterdir())) == 2
    finished = spark.createDataFrame([("c", [1])], "task_id string, batches array<long>")
    assert [r.text for r in S.pages_of(spark, out, finished).collect()] == ["c"]
    plan = S.pages_of(spark, out, finished)._jdf.queryExecution().executedPlan().toString()
    assert "batch" in plan.split("PartitionFilters:")[1].split("]")[0] and "bucket" in plan.split("PartitionFilters:")[1].split("PushedFilters")[0]


def test_a_later_batch_corrects_a_page(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    parts = [[(1, "a", 1, "third", 5, 2, 30), (1, "a", 1, "second", 3, 1, 20), (1, "a", 300, "far", 1, 0, 25), (1, "a", None, "no page", 1, 1, 1)], [(1, "a", 1, "first", 2, 0, 10), (1, "a", 300, "later", 9, 9, 26)], [(1, "a", 1, "fourth", 7, 7, 40), (1, "a", 2, None, None, None, None)], [(1, "a", 2, "known", 1, 1, 50)]]
    S.keyed_state(spark)
    for n, rows in enumerate(parts):
        write_events(source, rows, f"{n}.json")
        stream = files.event_stream(spark, str(source))
        S.store_pages(stream, str(tmp_path / "out"), str(tmp_path / "c1")).awaitTermination()
        S.progress(stream).writeStream.format("parquet").option("path", str(tmp_path / "totals")).option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start().awaitTermination()
    emitted = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted((r.page_index, r.version, r.text or "") for r in emitted) == [(1, 0, "second"), (1, 1, "first"), (2, 0, ""), (2, 1, "known"), (300, 0, "far")]
    assert {(r.page_index, r.text) for r in S.stored_pages(spark, str(tmp_path / "out")).collect()} == {(1, "first"), (2, "known"), (300, "far")}
    totals = sorted(spark.read.parquet(str(tmp_path / "totals")).collect(), key=lambda r: r.seq)
    assert [(r.page_index, r.version) for r in totals] == [(1, 0), (300, 0), (1, 1), (2, 0), (2, 1)]
    assert (totals[-1].pages, totals[-1].blocks, totals[-1].tables) == (3, 4, 1)


def test_state_ends_with_the_watermark_or_its_time(spark, tmp_path):
    """A copy behind the state's end is emitted anew, and the stored page is still the first."""
    source = tmp_path / "in"
    S.keyed_state(spark)
    schema = EVENTS + ", event_time timestamp"
    rows = lambda *r: spark.createDataFrame([(1, "a", p, t, 1, 0, n, x) for p, t, n, x in r], "generation long, task_id string, page_index int, text string, n_blocks int, n_tables int, arrival long, at string").withColumn("event_time", F.col("at").cast("timestamp")).drop("at")
    steps = [rows((0, "one", 1, "2024-01-01 00:00:00")), rows((500, "other", 2, "2024-01-01 02:00:00")), rows((500, "again", 3, "2024-01-01 02:00:01")), rows((0, "late", 9, "2024-01-01 02:30:00"))]
    for n, step in enumerate(steps):
        step.coalesce(1).write.mode("append").json(str(source))
        stream = spark.readStream.schema(schema).json(str(source))
        S.store_pages(stream, str(tmp_path / "out"), str(tmp_path / "check"), late="10 minutes").awaitTermination()
    emitted = [r.text for r in spark.read.parquet(str(tmp_path / "out")).collect()]
    assert sorted(emitted) == ["late", "one", "other"]  # the state of page 0 had gone, that of page 500 hadn't
    assert {r.page_index: r.text for r in S.stored_pages(spark, str(tmp_path / "out")).collect()} == {0: "one", 500: "other"}
    plain = spark.readStream.schema(schema).json(str(source))
    q = S.first_copies(plain, keep=60_000).writeStream.format("memory").queryName("kept").option("checkpointLocation", str(tmp_path / "c2")).trigger(processingTime="1 second").start()
    for _ in range(60):
        if spark.table("kept").count() >= 2 or not q.isActive:
            break
        q.awaitTermination(1)
    q.stop()
    assert {r.text for r in spark.table("kept").collect()} == {"one", "other"}
    with pytest.raises(ValueError):
        S.first_copies(plain, "1 hour", 5)


def test_running_totals(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    write_events(source, EVENT_ROWS, "1.json")
    stream = S.progress(S.current(files.event_stream(spark, str(source)), 1))
    q = stream.writeStream.format("memory").queryName("totals").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(r.task_id, r.page_index): (r.pages, r.blocks, r.tables, r.in_order) for r in spark.table("totals").collect()}
    assert got == {("a", 1): (1, 2, 0, True), ("a", 0): (2, 3, 1, False), ("b", 0): (1, 3, 0, True)}


def test_hand_off(spark):
    pages = spark.createDataFrame([("a", 0, "pdf-text"), ("a", 1, "ocr"), ("a", 2, "pdf-text")], "task_id string, page_index int, source string")
    cheap, rest = S.hand_off(pages, pages.filter("page_index = 2"))
    assert [r.page_index for r in cheap.collect()] == [0] and [r.page_index for r in rest.collect()] == [1]


def test_listing_log_and_source(spark, tmp_path):
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "a.bin").write_bytes(b"abc")
    assert [r.length for r in files.listing(spark, str(tmp_path / "m")).collect()] == [3]
    assert files.digests(spark, str(tmp_path / "m")).first().sha256 == "ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad"
    log = tmp_path / "events.jsonl"
    log.write_text('{"time": "2024-01-01T00:00:00Z", "method": "ping", "category": "ok", "path": "secret"}\nbroken\n')
    rows = files.event_log(spark, [str(log)])
    assert rows.columns == ["time", "method", "category"] and rows.filter("method = 'ping'").count() == 1

    class Fake(files.DocumentSource):
        @staticmethod
        def decode(path, pages):
            return ((path, p, f"page {p}", 10.0, 20.0) for p in pages)

        @classmethod
        def name(cls):
            return "fake_documents"

    spark.dataSource.register(Fake)
    df = spark.read.format("fake_documents").option("path", "x.pdf").option("pages", "0,2,5").option("per_partition", "2").load()
    assert df.rdd.getNumPartitions() == 2 and sorted(r.page_index for r in df.collect()) == [0, 2, 5]
    assert df.agg(F.max("text")).first()[0] == "page 5"


def test_event_log_rotates(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(files.EventLog, "MOST_BYTES", 200)
    log = files.EventLog(str(tmp_path / "events.jsonl"))
    rows = [(f"2024-01-01T00:00:0{i}Z", "ping" if i % 2 else "/secret/path", "ok") for i in range(9)] + [("no time", "ping", "ok")]
    log.append(spark.createDataFrame(rows, "time string, method string, category string"))
    assert len(log.files()) == 3 and all(len(open(f).read()) <= 200 for f in log.files())
    back = files.event_log(spark, log.files())
    assert {r.method for r in back.collect()} == {"ping", "other"} and back.agg(F.max("time")).first()[0].startswith("2024-01-01T00:00:08")


def test_pages_in_order_are_counted_by_first_arrivals():
    rnd = random.Random(3)
    for _ in range(200):
        first, front = {}, []
        for arrival in rnd.sample(range(60), 40):
            page = rnd.randrange(15)
            if arrival < first.get(page, 99):
                first[page] = arrival
                S.placed(front, arrival, page)
            by_arrival = sorted((a, p) for p, a in first.items())
            assert front == [(a, p) for i, (a, p) in enumerate(by_arrival) if all(p > q for _, q in by_arrival[:i])]


def test_tasks_list_a_folder_themselves(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    for name in ("a.txt", "b.bin", "sub/c.txt", ".hidden.txt", "_left.txt", "_k=1.txt", "d e.txt"):
        (tmp_path / name).write_text(name)
    for at in (str(tmp_path), f"file://{tmp_path}"):
        got = files.listing(spark, at, "*.txt")
        assert "FileScan" not in got._jdf.queryExecution().executedPlan().toString()
        spark_s = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").option("recursiveFileLookup", "true").load(at).select("path", F.col("modificationTime").alias("modification_time"), "length")
        assert sorted(got.collect()) == sorted(spark_s.collect()) and got.count() == 4
    assert {r.path.split("/")[-1]: bytes(r.content).decode() for r in files.contents(spark, str(tmp_path), "b*").collect()} == {"b.bin": "b.bin"}
