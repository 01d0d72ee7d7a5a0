"""Incremental results with Structured Streaming.

Of a page's copies the first to arrive counts, by its ``arrival`` number, whatever files and batches
the copies come in: keyed state holds the best arrival of each page, and a copy that turns out to be earlier is emitted as a
correction with a higher version. When a task is done, its result is made anew from the stored pages,
so it doesn't depend on the order in which they were read.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterator
from functools import reduce

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.types import IntegerType, StructType

from pagemill.operators.pages import document_text, earliest, edited_prefix

BLOCK = 256  # pages of a task that share a state, so that a task of many pages is no single group
NEVER = (1 << 63) - 1  # the arrival of an event without one
PROGRESS = "task_id string, page_index int, pages int, blocks int, tables int, in_order boolean, ordered int, version int, seq int"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def keyed_state(spark: SparkSession) -> None:
    """The state store that keyed state needs."""
    if "RocksDB" not in (spark.conf.get(_PROVIDER, None) or ""):
        spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def bucket(task_id: str, n: int = 16):
    return F.pmod(F.xxhash64(task_id), F.lit(n)).cast("int").alias("bucket")


def current(events: DataFrame, generation: int) -> DataFrame:
    """Without the events of earlier processes."""
    return events.filter(F.col("generation") == generation)


def _turn(r: Row) -> tuple:
    """Copies in order of arrival; equal arrivals by their text."""
    return NEVER if r["arrival"] is None else r["arrival"], r["text"] is None, r["text"] or ""


class _FirstCopies(StatefulProcessor):
    """The first copies of a block of a task's pages; keeps numbers, no texts."""

    def __init__(self, keep: int | None, timed: bool) -> None:
        self.keep, self.timed = keep, timed

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.best = handle.getValueState("best", "pages array<int>, arrivals array<long>, versions array<int>, until long", self.keep)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        pages, arrivals, versions, until = self.best.get() if self.best.exists() else ([], [], [], -1)
        known = {p: (a, v) for p, a, v in zip(pages, arrivals, versions)}
        fresh: dict[int, Row] = {}
        last = until
        for r in rows:
            p = r["page_index"]
            if self.timed:
                last = max(last, r["__time"])
            if (p not in known or _turn(r)[0] < known[p][0]) and (p not in fresh or _turn(r) < _turn(fresh[p])):
                fresh[p] = r
        for p, r in sorted(fresh.items()):
            version = known[p][1] + 1 if p in known else 0
            known[p] = _turn(r)[0], version
            row = r.asDict() | {"version": version}
            yield Row(**{k: v for k, v in row.items() if not k.startswith("__")})
        if self.timed and last > until:
            self.handle.registerTimer(last)
        if fresh or last > until:
            self.best.update((list(known), [a for a, _ in known.values()], [v for _, v in known.values()], last))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self.best.exists() and self.best.get()[3] <= expiredTimerInfo.getExpiryTimeInMs():
            self.best.clear()
        return iter(())

    def close(self) -> None:
        pass


def first_copies(events: DataFrame, late: str | None = None, keep: int | None = None) -> DataFrame:
    """The first copy of each page, with a version: 0, or higher where it corrects a copy that was emitted before.

    A page's state is a few numbers. ``late``, with an event_time column, drops a block's state once the watermark has
    passed all its events; ``keep`` drops it that many milliseconds after its last change (for queries that run on: Spark never ends an
    availableNow trigger with it). A copy that comes later still is
    emitted again, and :func:`stored_pages` decides. Events without a page_index are left out. Needs :func:`keyed_state`.
    """
    if late and keep:
        raise ValueError("state ends by event time or by processing time")
    out = StructType([*events.schema.fields]).add("version", IntegerType())
    rows = events.filter("page_index is not null").withColumn("__block", F.floor(F.col("page_index") / BLOCK).cast("int"))
    if late:
        rows = rows.withWatermark("event_time", late).withColumn("__time", F.unix_millis("event_time"))
    mode = "EventTime" if late else "ProcessingTime" if keep else "None"
    return rows.groupBy("task_id", "__block").transformWithState(_FirstCopies(keep, bool(late)), out, "Append", mode)


def stored_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Pages that :func:`store_pages` has written, each by its earliest arrival; corrections replace what they correct."""
    return _first(spark.read.parquet(folder))


def _first(rows: DataFrame) -> DataFrame:
    return earliest(rows.drop("batch", "bucket"), F.struct(F.coalesce("arrival", F.lit(NEVER)), F.col("text").isNull(), "text"))


def placed(front: list[tuple[int, int]], arrival: int, page: int) -> None:
    """Puts a page into ``front``, those (arrival, page) that come behind all pages of earlier arrivals, ascending in both.

    What another page keeps out of it stays out, since first arrivals only get earlier.
    """
    at = bisect_left(front, (arrival, -1))
    if at and front[at - 1][1] >= page:
        return
    end = at
    while end < len(front) and front[end][1] <= page:
        end += 1
    front[at:end] = [(arrival, page)]


class _Progress(StatefulProcessor):
    """Counts of a task's distinct pages, whether each came behind all before it, and how many did by their first arrivals."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getMapState("seen", "page_index int", "arrival long, blocks int, tables int, version int")
        self.totals = handle.getValueState("totals", "pages int, blocks int, tables int, last int, seq int, arrivals array<long>, front array<int>")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        pages, blocks, tables, last, seq, *front = self.totals.get() if self.totals.exists() else (0, 0, 0, -1, 0, [], [])
        front = list(zip(*front))
        for r in sorted(rows, key=lambda r: (_turn(r)[0], r["page_index"], *_turn(r)[1:])):
            page, own = (r["page_index"],), (_turn(r)[0], r["n_blocks"] or 0, r["n_tables"] or 0)
            old = self.seen.getValue(page) if self.seen.containsKey(page) else None
            if old is not None and old[0] <= own[0]:
                continue
            version = 0 if old is None else old[3] + 1
            self.seen.updateValue(page, (*own, version))
            in_order = old is None and page[0] > last
            pages, last = pages + (old is None), max(last, page[0])
            blocks, tables = blocks + own[1] - (old[1] if old else 0), tables + own[2] - (old[2] if old else 0)
            seq += 1
            placed(front, own[0], page[0])
            yield Row(task_id=key[0], page_index=page[0], pages=pages, blocks=blocks, tables=tables, in_order=in_order, ordered=len(front), version=version, seq=seq)
        self.totals.update((pages, blocks, tables, last, seq, [a for a, _ in front], [p for _, p in front]))

    def close(self) -> None:
        pass


def progress(events: DataFrame) -> DataFrame:
    """Running totals of each task (columns PROGRESS), numbered by seq: a row for each new page, and one, of a higher version, where an earlier copy of a page corrects the totals; ``in_order`` is what the stream saw, ``ordered`` the number of pages behind all earlier ones by first arrivals. Needs :func:`keyed_state`."""
    return events.filter("page_index is not null").groupBy("task_id").transformWithState(_Progress(), PROGRESS, "Append", "None")


def store_pages(events: DataFrame, folder: str, checkpoint: str, after: Callable[[DataFrame, int], None] | None = None, every: str | None = None, late: str | None = None) -> StreamingQuery:
    """Writes first copies and corrections to ``folder``, a subfolder a batch, so that a repeated batch replaces its own rows.

    Rows lie in folders by batch and bucket of the task; ``folder``-counts has a row a task and batch with the number of its new pages,
    which is all that :func:`completions` reads. ``after`` may use what a batch has stored: its failure is recorded in
    ``folder``-failed and doesn't stop the pages.
    """

    def batch(df: DataFrame, number: int) -> None:
        spark = df.sparkSession
        df.withColumn("bucket", bucket("task_id")).write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/batch={number}")
        stored = spark.read.schema(df.schema).parquet(f"{folder}/batch={number}")
        stored.groupBy("task_id").agg(F.count_if(F.col("version") == 0).alias("n")).write.mode("overwrite").parquet(f"{folder}-counts/batch={number}")
        if after is None:
            return
        try:
            after(stored, number)
        except Exception as e:  # noqa: BLE001
            spark.createDataFrame([(number, type(e).__name__)], "batch long, error string").write.mode("overwrite").parquet(f"{folder}-failed/batch={number}")

    keyed_state(events.sparkSession)
    writer = first_copies(events, late).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


class _Completion(StatefulProcessor):
    """Counts a task's new pages and says once that all selected ones are there, and in which batches they are stored."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", "pages long, batches array<long>, done boolean")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        pages, batches, done = self.state.get() if self.state.exists() else (0, [], False)
        if done:
            return
        batches, wanted = set(batches), None
        for r in rows:
            pages += r["n"]
            batches.add(r["batch"])
            wanted = r["selected_count"]
        done = pages >= wanted
        self.state.update((pages, [] if done else sorted(batches), done))
        if done:
            yield Row(task_id=key[0], pages=pages, batches=sorted(batches))

    def close(self) -> None:
        pass


def completions(spark: SparkSession, folder: str, selected: DataFrame) -> DataFrame:
    """A stream of the tasks whose selected pages (task_id, selected_count) have all been stored: task_id, pages, batches; each task once.

    Reads the counts beside ``folder``, not the pages. Corrections don't count.
    """
    keyed_state(spark)
    counts = spark.readStream.schema("task_id string, n long, batch long").option("basePath", f"{folder}-counts").parquet(f"{folder}-counts")
    wanted = selected.select(F.col("task_id").alias("task_id"), F.col("selected_count").cast("long").alias("selected_count"))
    return counts.join(wanted, "task_id").groupBy("task_id").transformWithState(_Completion(), "task_id string, pages long, batches array<long>", "Append", "None")


def pages_of(spark: SparkSession, folder: str, finished: DataFrame) -> DataFrame:
    """Stored pages of the tasks in ``finished`` (task_id, batches); only folders of their batches and buckets are read."""
    there = finished.select(F.explode("batches").alias("batch"), bucket("task_id")).distinct().groupBy("batch").agg(F.collect_set("bucket").alias("buckets")).collect()  # a row a batch
    if not there:
        return stored_pages(spark, folder).limit(0)
    place = reduce(lambda a, b: a | b, [(F.col("batch") == r["batch"]) & F.col("bucket").isin(r["buckets"]) for r in there])
    rows = spark.read.parquet(folder).filter(place).join(finished.select(F.col("task_id").alias("task_id")), "task_id", "left_semi")
    return _first(rows)


class Run:
    """A stream that can be paused, resumed and cancelled between batches.

    ``start`` starts the query, always on one checkpoint: a batch that isn't finished leaves no mark there and is done
    again, so no page is lost or counted twice. A cancelled run can't be resumed.
    """

    def __init__(self, start: Callable[[], StreamingQuery]) -> None:
        self._start, self.query, self.state = start, None, "idle"

    def resume(self) -> None:
        if self.state == "cancelled":
            raise RuntimeError("the run has been cancelled")
        if self.state != "running":
            self.query, self.state = self._start(), "running"

    def pause(self) -> None:
        self._stop("paused")

    def cancel(self) -> None:
        self._stop("cancelled")

    def _stop(self, state: str) -> None:
        if self.query is not None:
            self.query.stop()
        self.query, self.state = None, state


def completed(pages: DataFrame, selected: DataFrame) -> DataFrame:
    """Texts of the tasks all of whose selected pages are stored; selected: task_id, selected_count."""
    whole = pages.groupBy("task_id").agg(F.count("*").alias("n")).join(selected, "task_id").filter("n >= selected_count").select("task_id")
    return document_text(pages.join(whole, "task_id", "left_semi"))


class _LatestEdit(StatefulProcessor):
    """Whether a task's text has been edited, and when last."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.edited = handle.getValueState("edited", "arrival long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        last = max(rows, key=lambda r: (-1 if r["arrival"] is None else r["arrival"], r["text"] or ""))
        arrival = -1 if last["arrival"] is None else last["arrival"]
        if not self.edited.exists() or self.edited.get()[0] < arrival:
            self.edited.update((arrival,))
            yield Row(task_id=key[0], text=last["text"], edited_pages=last["edited_pages"], arrival=arrival)

    def close(self) -> None:
        pass


_EDIT = "task_id string, text string, edited_pages int, arrival long"


def store_edits(events: DataFrame, folder: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Writes the edits among ``events`` (columns of EDITS) to ``folder``; of a task's edits only those later than all before."""

    def batch(df: DataFrame, number: int) -> None:
        df.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    keyed_state(events.sparkSession)
    edits = events.filter("kind = 'edit'").groupBy("task_id").transformWithState(_LatestEdit(), _EDIT, "Append", "None")
    writer = edits.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def current_texts(spark: SparkSession, pages: str, edits: str) -> DataFrame:
    """task_id and text as they stand, from the folders of :func:`store_pages` and :func:`store_edits`.

    A task's latest edit stands for its first edited_pages pages, by their numbers, and stays while later pages come behind it; the result is
    the same for any order in which pages and edits arrive.
    """
    stored = stored_pages(spark, pages)
    last = spark.read.schema(_EDIT).parquet(edits).groupBy("task_id").agg(F.max_by(F.struct("text", "edited_pages"), F.struct("arrival", "text")).alias("e")).select("task_id", "e.*")
    plain = document_text(stored.join(last.select(F.col("task_id").alias("task_id")), "task_id", "left_anti")).select("task_id", "text")
    return edited_prefix(stored, last).unionByName(plain)


def first_pass(requests: DataFrame, folder: str, log: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Stores pages with embedded text at once; the others go to the hand-off ``log`` for :func:`second_pass`. A batch done again replaces both of its parts.

    requests: task_id, page_index, source, text.
    """

    def batch(df: DataFrame, number: int) -> None:
        spark = df.sparkSession
        df.write.mode("overwrite").partitionBy("cheap").parquet(f"{log}-requests/batch={number}")  # read once, then dealt out
        parts = spark.read.schema(df.schema).parquet(f"{log}-requests/batch={number}")
        parts.filter("cheap").drop("cheap").write.mode("overwrite").parquet(f"{folder}/pass=1/batch={number}")
        parts.filter("not cheap").drop("cheap").write.mode("overwrite").parquet(f"{log}/batch={number}")

    asked = requests.withColumn("cheap", F.coalesce(F.col("source") == "pdf-text", F.lit(False)))
    writer = asked.dropDuplicates(["task_id", "page_index"]).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def second_pass(spark: SparkSession, log: str, schema: str, recognise: Callable[[DataFrame], DataFrame], folder: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Recognises the pages of the hand-off log that aren't stored yet. Can be stopped, started later, or run beside the first pass: each page is done once."""

    def batch(df: DataFrame, number: int) -> None:
        recognise(df).write.mode("overwrite").parquet(f"{folder}/pass=2/batch={number}")

    asked = spark.readStream.schema(f"{schema}, batch long").option("basePath", log).parquet(log).drop("batch")
    writer = asked.dropDuplicates(["task_id", "page_index"]).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def hand_off(pages: DataFrame, stored: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pages with embedded text, for the cheap first pass, and those that still need recognition."""
    rest = pages.join(stored.select("task_id", "page_index"), ["task_id", "page_index"], "left_anti")
    return rest.filter("source = 'pdf-text'"), rest.filter("source <> 'pdf-text' or source is null")
