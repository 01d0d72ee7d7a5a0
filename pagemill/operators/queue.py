"""The task queue, history, file checks, cached models, packs and diagnostics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill.functions import text as X
from pagemill.operators.order import numbered

# --- fixed values ---
PAGE_OF_HISTORY = 20
ACTIVE = ["running", "paused"]
DETECTION = {"fast": ["PP-OCRv5_mobile_det", "PP-OCRv5_mobile_rec"], "accurate": ["PP-OCRv5_server_det", "PP-OCRv5_server_rec"]}
TABLE_MODELS = ["PicoDet_layout_1x_table", "SLANet_plus"]
MODEL_FILES = ["inference.pdiparams", "inference.json", "inference.pdmodel", "inference.yml"]
SPARE_BYTES = 64 * 1024 * 1024
METHODS = ["startup", "shutdown", "recognize", "prepare", "delete_models", "export_results", "export_preview", "validate_paths", "ping"]
CATEGORIES = ["ok", "download", "model", "runtime", "file", "storage", "unknown", "cancelled"]
TOKENS = {
    "download": ["download", "hoster", "model source", "connection", "timeout", "网络", "下载"],
    "runtime": ["dll", ".so", "glibc", "onednn", "pir::", "dynlib"],
    "model": ["model", "pdiparams", "inference", "模型"],
}
REPORT = ["app_version", "os", "os_release", "architecture", "runtime", "frozen", "engine_ready", "profile", "mode", "packages"]
# --- end of fixed values ---


def admit(files: DataFrame, queue: DataFrame, batch_id: str) -> DataFrame:
    """New files in natural order, numbered within the batch; files: path, ordinal. Paths already queued and repeats are dropped."""
    new = files.filter(X.admitted(F.col("path"))).withColumn("key", X.queue_key(F.col("path")))
    new = new.groupBy("key").agg(F.min_by(F.struct("path", "ordinal"), "ordinal").alias("f")).select("key", "f.path", "f.ordinal")
    new = new.join(queue.select(X.queue_key(F.col("path")).alias("key")).distinct(), "key", "left_anti")
    return in_natural_order(new, "batch_index").withColumn("batch_id", F.lit(batch_id)).select("batch_id", "batch_index", "path")


def in_natural_order(files: DataFrame, number: str) -> DataFrame:
    """``files`` (path, ordinal) numbered from 0 by base name, then path, then ordinal."""
    return numbered(files, number, X.natural_key(X.base_name(F.col("path"))), X.natural_key(F.col("path")), "ordinal")


def renumbered(tasks: DataFrame) -> DataFrame:
    return tasks.withColumn("batch_index", F.row_number().over(Window.partitionBy("batch_id").orderBy("batch_index", "task_id")) - 1)


def moved(tasks: DataFrame, task_id: str, to: int) -> DataFrame:
    """The queue with one task at another place; tasks: task_id, place (from 0)."""
    at = tasks.filter(F.col("task_id") == task_id).agg(F.max("place")).scalar()
    shift = F.when(F.col("task_id") == task_id, F.lit(to)).when((F.col("place") > at) & (F.col("place") <= to), F.col("place") - 1).when((F.col("place") < at) & (F.col("place") >= to), F.col("place") + 1)
    return tasks.withColumn("place", F.coalesce(shift, F.col("place")))


def next_task(tasks: DataFrame) -> DataFrame:
    return tasks.filter("status = 'queued'").orderBy("place").limit(1)


def status_counts(tasks: DataFrame) -> DataFrame:
    return tasks.groupBy("status").agg(F.count("*").alias("tasks"))


def batch_totals(results: DataFrame) -> DataFrame:
    return results.groupBy("batch_id").agg(F.sum("page_count").alias("pages"), F.sum("block_count").alias("blocks"), F.sum("elapsed_ms").alias("elapsed_ms"), F.count_if(F.col("revision") != F.coalesce("exported_revision", F.lit(-1))).alias("unexported"))


def export_state(revision: Column, exported: Column) -> Column:
    return F.when(exported.isNull(), "never").when(exported == revision, "current").otherwise("outdated")


def export_scope(tasks: DataFrame, scope: str, current: str | None = None) -> DataFrame:
    if scope == "current":
        return tasks.filter(F.col("task_id") == current)
    return tasks.filter("checked") if scope == "checked" else tasks


def restored(tasks: DataFrame) -> DataFrame:
    """Tasks of a stored session; those in work are queued again. Fails where an id is empty or repeated, or a path is empty."""
    n = F.count("*").over(Window.partitionBy("task_id"))
    bad = F.col("task_id").isNull() | (F.col("task_id") == "") | (n > 1) | F.col("path").isNull() | (F.col("path") == "")
    was = F.col("status").isin(ACTIVE)
    checked = tasks.withColumn("task_id", F.when(bad, F.raise_error(F.lit("a stored task has no path, no id or an id of another"))).otherwise(F.col("task_id")))
    return checked.withColumns({"partial": was, "resume_eligible": was, "status": F.when(was, "queued").otherwise(F.col("status")), "page_range": F.substring("page_range", 1, X.MOST_OF_RANGE)})


def history_page(history: DataFrame, page: int, search: str = "", size: int = PAGE_OF_HISTORY) -> DataFrame:
    """A page (from 1) of history entries, the latest first; ``search`` is part of a file name, whatever its case."""
    return history.filter(F.contains(F.lower("file_name"), F.lower(F.lit(search)))).orderBy(F.desc("saved_at"), "task_id").offset((max(1, page) - 1) * size).limit(size)


def history_pages(entries: Column, size: int = PAGE_OF_HISTORY) -> Column:
    return F.greatest(F.lit(1), F.ceil(entries / size))


def removed_tasks(stored: DataFrame, current: DataFrame) -> DataFrame:
    return stored.join(current.select("task_id"), "task_id", "left_anti")


def deletable(ids: DataFrame, active: DataFrame) -> DataFrame:
    """One row, ``deletable``: whether none of the ids is in the active queue."""
    return ids.join(active.select("task_id"), "task_id", "left_semi").agg((F.count("*") == 0).alias("deletable"))


def checked_paths(tasks: DataFrame, listing: DataFrame) -> DataFrame:
    """tasks with exists, size and modified of their files; listing: path, length, modification_time."""
    return tasks.join(listing, "path", "left").select("task_id", "path", F.col("length").isNotNull().alias("exists"), "length", "modification_time")


def exported_still(exported: DataFrame, tasks: DataFrame) -> DataFrame:
    """Tasks whose export counts: their revision is the one that was exported."""
    return tasks.join(exported.select("task_id", F.col("revision").alias("_r")), "task_id").filter(F.col("revision") == F.col("_r")).drop("_r")


# --- models ---


def required_models(capabilities: DataFrame) -> DataFrame:
    """Distinct model names of (profile, mode) rows, in order; unknown values fail."""
    names = F.when(~F.col("mode").isin("text", "table") | F.col("mode").isNull(), F.raise_error(F.lit("unknown mode")))
    for profile, models in DETECTION.items():
        own = [F.lit(m) for m in models]
        names = names.when(F.col("profile") == profile, F.when(F.col("mode") == "table", F.array(*[F.lit(m) for m in TABLE_MODELS], *own)).otherwise(F.array(*own)))
    names = names.otherwise(F.raise_error(F.lit("unknown profile")))
    return capabilities.select(F.explode(names).alias("name")).distinct().orderBy("name")


def model_states(required: DataFrame, files: DataFrame) -> DataFrame:
    """Each required model's state by the listed files (name, file, size)."""
    has = lambda f: F.coalesce(F.max((F.col("file") == f) & (F.col("size") > 0)), F.lit(False))
    got = required.join(files, "name", "left").groupBy("name").agg(
        (has("inference.pdiparams") & (has("inference.json") | has("inference.pdmodel")) & has("inference.yml")).alias("installed"), F.coalesce(F.sum("size"), F.lit(0)).alias("size_bytes"), F.count("file").alias("file_count")
    )
    return got.withColumn("state", F.when(F.col("installed"), "ready").when(F.col("file_count") > 0, "incomplete").otherwise("missing"))


def cache_totals(states: DataFrame) -> DataFrame:
    return states.agg(F.bool_and("installed").alias("installed"), F.sum("size_bytes").alias("size_bytes"), F.count("*").alias("models"), F.count_if("installed").alias("installed_models"))


def manifest_problems(entries: DataFrame, required: DataFrame, disk: DataFrame) -> DataFrame:
    """(path, problem) of a pack's entries (path, size, sha256) against the required models and the files on disk (path, length, digest or null)."""
    allowed = required.select(F.explode(F.array(*[F.concat("name", F.lit(f"/{f}")) for f in MODEL_FILES])).alias("path"))
    one = entries.withColumn("_n", F.count("*").over(Window.partitionBy("path"))).join(allowed.withColumn("_ok", F.lit(True)), "path", "left").join(disk, "path", "left")
    problem = (
        F.when(F.col("_ok").isNull(), "illegal-path").when(F.col("_n") > 1, "duplicate").when(F.col("size").isNull() | (F.col("size") < 1), "bad-size")
        .when(~F.coalesce(F.col("sha256").rlike("^[0-9a-f]{64}$"), F.lit(False)), "bad-digest").when(F.col("length").isNull() | (F.col("length") != F.col("size")), "size-differs")
        .when(F.col("digest").isNotNull() & (F.col("digest") != F.col("sha256")), "digest-differs")
    )
    found = one.select("path", problem.alias("problem")).filter("problem is not null").distinct()
    names = entries.select(F.regexp_extract("path", "^([^/]+)/", 1).alias("name"), F.regexp_extract("path", "/(.+)$", 1).alias("file"), "size")
    lacking = model_states(required, names).filter(~F.col("installed")).select(F.col("name").alias("path"), F.lit("incomplete-model").alias("problem"))
    return found.union(lacking)


def enough_space(free: Column, needed: Column) -> Column:
    return free >= needed + SPARE_BYTES


# --- diagnostics ---


def error_category(kind: Column, message: Column) -> Column:
    has = lambda name: F.lower(message).rlike("|".join(f"\\Q{t}\\E" for t in TOKENS[name]))
    return (
        F.when(kind == "ModelRequiredError", "model_required").when(kind == "LocalModelsMissingError", "model").when(has("download"), "download").when(has("runtime"), "runtime")
        .when(kind.isin("FileNotFoundError", "IsADirectoryError"), "file").when(kind.isin("PermissionError", "OSError"), "storage").when(has("model"), "model").otherwise("unknown")
    )


def safe_events(events: DataFrame) -> DataFrame:
    """Only time, method and category, values outside their domains masked; rows without a valid time are dropped."""
    time = F.try_to_timestamp(F.col("time"))
    method, category = F.col("method"), F.col("category")
    return events.select(time.alias("time"), F.when(method.isin(METHODS), method).otherwise("other").alias("method"), F.when(category.isin(CATEGORIES), category).otherwise("unknown").alias("category")).filter("time is not null")


def safe_report(report: DataFrame) -> DataFrame:
    """The fields that may leave the machine."""
    out = report.select(*[c for c in REPORT if c in report.columns])
    for name, domain in (("profile", ["fast", "accurate"]), ("mode", ["text", "table"])):
        if name in out.columns:
            out = out.withColumn(name, F.when(F.col(name).isin(domain), F.col(name)))
    return out


MANIFEST = "schema int, runtime string, capabilities array<struct<profile:string,mode:string>>, files array<struct<path:string,size:long,sha256:string>>"


def manifest(packs: DataFrame, schema: int, runtime: str) -> tuple[DataFrame, DataFrame]:
    """Capabilities (profile, mode) and files of pack manifests (column json); malformed or foreign ones fail."""
    m = F.from_json("json", MANIFEST, {"mode": "FAILFAST"})
    fits = (m["schema"] == schema) & (m["runtime"] == runtime) & F.size(m["capabilities"]).between(1, 4) & (F.size(m["files"]) > 0)
    read = packs.select(F.when(F.coalesce(fits, F.lit(False)), m).otherwise(F.raise_error(F.lit("a pack's manifest is of another version or incomplete"))).alias("m"))
    return read.select(F.inline("m.capabilities")).distinct(), read.select(F.inline("m.files"))


def history_entry(history: DataFrame, pages: DataFrame, task_id: str) -> DataFrame:
    """One entry with its pages in order; fails where there is none."""
    nested = pages.filter(F.col("task_id") == task_id).groupBy("task_id").agg(F.array_sort(F.collect_list(F.struct("page_index", "text"))).alias("pages"))
    wanted = history.sparkSession.createDataFrame([(task_id,)], "task_id string")
    found = wanted.join(history.withColumn("_here", F.lit(True)), "task_id", "left").join(nested, "task_id", "left")
    checked = F.when(F.col("_here").isNull(), F.raise_error(F.lit("there is no such entry"))).otherwise(F.col("task_id"))
    return found.withColumn("task_id", checked).drop("_here")
