"""A store of task headers and pages in versions.

A version is a manifest: the table of headers, and a list of layers of pages, oldest first. A save writes the
headers, a layer with the pages that it is given, and the ids of tasks whose earlier pages no longer count; older layers stay as
they are. Readers merge: of a page's copies the one in the latest layer counts. Layers lie in folders by
bucket of the task, and only folders that can hold a wanted task are read. When there are many layers, the latest ones of
like size become one, so that each page is written again a few times in all.

The pointer file names the current version and is replaced as a whole; a writer gives the version that it has read
and fails if another one has been published since. The lock that guards this ends by itself after LEASE seconds.
Pointer, lock and manifests are small files on a local or mounted path; tables are Spark's.
"""

from __future__ import annotations

import json
import os
import shutil
import time
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from pagemill.operators.pages import latest

LEASE = 60.0
MOST_LAYERS = 8
BUCKETS, BUCKET_ROWS = 64, 250_000  # folders of a layer; a larger layer has as many as its rows need
KEYS = ["task_id", "page_index"]


class Conflict(RuntimeError):
    """Another writer has published a version since, or is publishing one."""


def bucket(task_id: str, n: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(task_id), F.lit(n)).cast("int").alias("bucket")


class Store:
    def __init__(self, spark: SparkSession, folder: str, name: str = "session") -> None:
        self.spark, self.folder, self.name = spark, folder, name
        os.makedirs(folder, exist_ok=True)

    # --- versions ---

    @property
    def _pointer(self) -> str:
        return f"{self.folder}/{self.name}.version"

    def version(self) -> str | None:
        try:
            with open(self._pointer) as f:
                return f.read().strip() or None
        except FileNotFoundError:
            return None

    def _manifest(self, version: str) -> dict:
        with open(f"{self.folder}/{self.name}.{version}.json") as f:
            return json.load(f)

    def layers(self) -> list[dict]:
        """Layers of the current version, oldest first: dir, buckets (how many), rows, and in which buckets it has pages."""
        v = self.version()
        return self._manifest(v)["layers"] if v else []

    # --- reading ---

    def headers(self) -> DataFrame | None:
        v = self.version()
        return self.spark.read.parquet(f"{self.folder}/{self._manifest(v)['tasks']}") if v else None

    def pages(self, tasks: DataFrame | None = None) -> DataFrame | None:
        """Stored pages, only of ``tasks`` where given: the folders of other buckets aren't read."""
        v = self.version()
        if not v:
            return None
        m = self._manifest(v)
        return self._merged(m["layers"], m["schema"], tasks)

    def load(self) -> DataFrame | None:
        """Headers with their pages as an array in order, empty where there are none."""
        heads = self.headers()
        if heads is None:
            return None
        pages = self.pages()
        fields = [c for c in pages.columns if c != "task_id"]
        nested = pages.groupBy("task_id").agg(F.array_sort(F.collect_list(F.struct("page_index", *[c for c in fields if c != "page_index"]))).alias("pages"))
        out = heads.join(nested, "task_id", "left")
        return out.withColumn("pages", F.coalesce("pages", F.array().cast(dict(nested.dtypes)["pages"])))

    def _rows(self, layer: dict, seq: int, schema: dict, wanted: DataFrame | None) -> DataFrame | None:
        there = set(layer["there"])
        if wanted is not None:
            there &= {r["bucket"] for r in wanted.select(bucket("task_id", layer["buckets"])).distinct().collect()}  # as many as there are folders
        if not there:
            return None
        rows = self.spark.read.schema(StructType.fromJson(schema).add("bucket", "integer")).parquet(f"{self.folder}/{layer['dir']}/pages")
        if len(there) < layer["buckets"]:
            rows = rows.filter(F.col("bucket").isin(sorted(there)))
        return rows.drop("bucket").withColumn("_layer", F.lit(seq))

    def _resets(self, layers: list[dict]) -> DataFrame | None:
        """task_id and the latest layer that has reset the task."""
        found = [self.spark.read.schema("task_id string").parquet(f"{self.folder}/{x['dir']}/resets").withColumn("_reset", F.lit(i)) for i, x in enumerate(layers) if x["resets"]]
        return reduce(DataFrame.union, found).groupBy("task_id").agg(F.max("_reset").alias("_reset")) if found else None

    def _merged(self, layers: list[dict], schema: dict, wanted: DataFrame | None = None) -> DataFrame:
        parts = [p for i, x in enumerate(layers) if (p := self._rows(x, i, schema, wanted)) is not None]
        if not parts:
            return self.spark.createDataFrame([], StructType.fromJson(schema))
        rows, resets = reduce(DataFrame.unionByName, parts), self._resets(layers)
        if wanted is not None:
            rows = rows.join(wanted.select(F.col("task_id").alias("task_id")).distinct(), "task_id", "left_semi")
        if resets is not None:
            rows = rows.join(resets, "task_id", "left").filter("_reset is null or _layer >= _reset").drop("_reset")
        return (latest(rows, "_layer") if len(parts) > 1 else rows).drop("_layer")

    # --- writing ---

    def save(self, tasks: DataFrame, pages: DataFrame, expected: str | None, reset: DataFrame | None = None) -> str:
        """Publishes ``tasks`` and the stored pages overlaid by ``pages``; pages of tasks in ``reset`` and of tasks that are gone go.

        Writes the headers and what is given, a row a page, not what is stored already.
        """
        if self.version() != expected:
            raise Conflict(f"the store is at {self.version()}, not {expected}")
        old = self._manifest(expected) if expected else {"layers": [], "tasks": None, "schema": None}
        new = uuid.uuid4().hex
        tasks.write.parquet(f"{self.folder}/{new}/tasks")
        gone = [reset.select("task_id")] if reset is not None else []
        if old["tasks"]:
            before, now = self.spark.read.parquet(f"{self.folder}/{old['tasks']}"), self.spark.read.parquet(f"{self.folder}/{new}/tasks")
            gone.append(before.select("task_id").join(now.select("task_id"), "task_id", "left_anti"))
        layer = self._layer(new, pages, reduce(DataFrame.union, gone).distinct() if gone else None)
        schema = _with(old["schema"], pages)
        layers = old["layers"] + ([layer] if layer["rows"] or layer["resets"] else [])
        if len(layers) > MOST_LAYERS:
            layers = self._compacted(layers, schema)
        return self._publish(new, {"tasks": f"{new}/tasks", "layers": layers, "schema": schema}, expected)

    def _layer(self, name: str, pages: DataFrame, resets: DataFrame | None, buckets: int = BUCKETS) -> dict:
        at = f"{self.folder}/{name}"
        if resets is not None:
            resets.select(F.col("task_id").cast("string").alias("task_id")).write.parquet(f"{at}/resets")
        some = resets is not None and not self.spark.read.parquet(f"{at}/resets").isEmpty()
        pages.withColumn("bucket", bucket("task_id", buckets)).hint("rebalance", "bucket").write.partitionBy("bucket").parquet(f"{at}/pages")
        there = sorted(int(x.split("=")[1]) for x in os.listdir(f"{at}/pages") if x.startswith("bucket="))
        rows = self.spark.read.schema("page_index int, bucket int").parquet(f"{at}/pages").count() if there else 0
        return {"dir": name, "buckets": buckets, "rows": rows, "there": there, "resets": some}

    def _compacted(self, layers: list[dict], schema: dict) -> list[dict]:
        """The latest layers of like size as one: as many as are at most twice what lies behind them."""
        i = len(layers) - 2
        total = layers[-1]["rows"] + layers[i]["rows"]
        while i and layers[i - 1]["rows"] <= 2 * total:
            i -= 1
            total += layers[i]["rows"]
        part = layers[i:]
        resets = self._resets(part)
        buckets = BUCKETS
        while buckets * BUCKET_ROWS < total:
            buckets *= 2
        made = self._layer(uuid.uuid4().hex, self._merged(part, schema), resets.select("task_id") if resets is not None and i else None, buckets)
        return [*layers[:i], made]

    def _publish(self, version: str, manifest: dict, expected: str | None) -> str:
        owner = self._locked()
        try:
            if self.version() != expected:
                raise Conflict(f"the store is at {self.version()}, not {expected}")
            for path, text in ((f"{self.folder}/{self.name}.{version}.json", json.dumps(manifest)), (self._pointer, version)):
                with open(f"{path}.{version}", "w") as f:
                    f.write(text)
                    f.flush()
                    os.fsync(f.fileno())
                os.replace(f"{path}.{version}", path)
        finally:
            self._unlock(owner)
        return version

    def _locked(self) -> str:
        """Takes the lock; one that has been held for longer than LEASE belongs to a writer that has died."""
        lock, owner = f"{self._pointer}.lock", uuid.uuid4().hex
        for _ in range(2):
            try:
                at = os.open(lock, os.O_CREAT | os.O_EXCL | os.O_WRONLY)
                os.write(at, owner.encode())
                os.close(at)
                return owner
            except FileExistsError:
                try:
                    if time.time() - os.stat(lock).st_mtime <= LEASE:
                        break
                    os.rename(lock, f"{lock}.{owner}")  # only one of several writers gets it
                    os.unlink(f"{lock}.{owner}")
                except FileNotFoundError:
                    pass
        raise Conflict("another writer is publishing")

    def _unlock(self, owner: str) -> None:
        lock = f"{self._pointer}.lock"
        try:
            with open(lock) as f:
                own = f.read() == owner
            if own:
                os.unlink(lock)
        except FileNotFoundError:
            pass

    def remove(self, ids: DataFrame, active: DataFrame, expected: str | None) -> str:
        """A version without the tasks of ``ids``; refused if any of them is in ``active``."""
        if not ids.join(active.select("task_id"), "task_id", "left_semi").isEmpty():
            raise ValueError("a task to delete is in the queue")
        heads = self.headers().join(ids.select("task_id"), "task_id", "left_anti")
        return self.save(heads, self.spark.createDataFrame([], StructType.fromJson(self._manifest(self.version())["schema"])), expected)

    def vacuum(self, older: float = 86_400.0) -> list[str]:
        """Deletes folders and manifests that the current version doesn't name and that are older than ``older`` seconds: longer than any reader or writer takes."""
        v = self.version()
        used = {v, *(x["dir"] for x in self.layers())} if v else set()
        dropped = []
        for entry in os.scandir(self.folder):
            parts = entry.name.split(".")
            is_manifest = len(parts) == 3 and parts[0] == self.name and parts[2] == "json"
            name = parts[1] if is_manifest else entry.name
            if (is_manifest or (entry.is_dir() and len(name) == 32)) and name not in used and time.time() - entry.stat().st_mtime >= older:
                shutil.rmtree(entry.path) if entry.is_dir() else os.unlink(entry.path)
                dropped.append(entry.name)
        return dropped



class SaveChain:
    """Saves one after the other; what can't be saved is kept in a log and goes with the next save, never over a newer page.

    Pages carry ``arrival``, a number that grows with each change of a page. ``log`` is a folder of this writer alone; it
    outlives the process, so a new chain on it takes up where the last one failed.
    """

    def __init__(self, store: Store, log: str) -> None:
        self.store, self.log = store, log
        os.makedirs(log, exist_ok=True)

    def pending(self) -> list[str]:
        """Folders of saves that have failed, oldest first."""
        return sorted(f"{self.log}/{d}" for d in os.listdir(self.log) if os.path.exists(f"{self.log}/{d}/done"))

    def _waiting(self, reset: DataFrame | None) -> tuple[list[DataFrame], DataFrame | None]:
        """Pages of failed saves without those that a later reset drops, and all resets."""
        spark, out, resets = self.store.spark, [], reset
        for at in reversed(self.pending()):
            pages = spark.read.parquet(f"{at}/pages")
            out.append(pages if resets is None else pages.join(resets.select("task_id"), "task_id", "left_anti"))
            own = spark.read.parquet(f"{at}/resets")
            resets = own if resets is None else resets.select("task_id").union(own)
        return out, resets

    def save(self, tasks: DataFrame, pages: DataFrame, reset: DataFrame | None = None) -> str:
        done = self.pending()
        try:
            waiting, resets = self._waiting(reset)
            every = latest(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [pages, *waiting]), "arrival")
            stored = self.store.pages(every) if self.store.version() else None
            if stored is not None and "arrival" in stored.columns:
                newer = stored.select("task_id", "page_index", F.col("arrival").alias("_stored"))
                if resets is not None:  # what a reset drops isn't newer than anything
                    newer = newer.join(resets.select(F.col("task_id").alias("task_id")), "task_id", "left_anti")
                every = every.join(newer, KEYS, "left").filter("_stored is null or _stored < arrival").drop("_stored")
            version = self.store.save(tasks, every, self.store.version(), reset=resets)
        except Exception:
            at = f"{self.log}/{time.time_ns():020d}"
            pages.write.parquet(f"{at}/pages")
            (reset.select(F.col("task_id").cast("string").alias("task_id")) if reset is not None else self.store.spark.createDataFrame([], "task_id string")).write.parquet(f"{at}/resets")
            open(f"{at}/done", "w").close()
            raise
        for at in done:
            shutil.rmtree(at)
        return version


def _with(known: dict | None, pages: DataFrame) -> dict:
    """The stored columns and those that ``pages`` adds, as a schema's JSON."""
    old = known["fields"] if known else []
    names = {f["name"] for f in old}
    return {"type": "struct", "fields": old + [f for f in pages.schema.jsonValue()["fields"] if f["name"] not in names]}
