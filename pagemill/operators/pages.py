"""Pages and results: selection, resuming, duplicate pages, completion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill.functions import text as X

# fixed values
ROTATIONS = [0, 90, 180, 270]
PROFILES, MODES, PDF_SOURCES = ["fast", "accurate"], ["text", "table"], ["auto", "ocr"]


def latest(pages: DataFrame, arrival: str, keys=("task_id", "page_index")) -> DataFrame:
    """Of pages with one key the last to arrive; pre-aggregates, so a hot key gives a row a task."""
    rest = [c for c in pages.columns if c not in keys]
    best = pages.groupBy(*keys).agg(F.max_by(F.struct(*rest), arrival).alias("_p"))
    return best.select(*keys, *[F.col(f"_p.{c}").alias(c) for c in rest])


def earliest(pages: DataFrame, arrival: str | Column, keys=("task_id", "page_index")) -> DataFrame:
    """Of pages with one key the first to arrive, as an incremental result keeps it."""
    rest = [c for c in pages.columns if c not in keys]
    best = pages.groupBy(*keys).agg(F.min_by(F.struct(*rest), arrival).alias("_p"))
    return best.select(*keys, *[F.col(f"_p.{c}").alias(c) for c in rest])


def document_text(pages: DataFrame, key: str = "task_id", index: str = "page_index") -> DataFrame:
    """Text of non-empty pages in order, blank lines between them, with counts."""
    ordered = F.array_sort(F.collect_list(F.struct(index, "text")))
    full = F.filter(F.transform(ordered, lambda p: p["text"]), lambda t: t.isNotNull() & (t != ""))
    return pages.groupBy(key).agg(F.array_join(full, "\n\n").alias("text"), F.count("*").alias("pages"), F.sum(F.length("text")).cast("long").alias("chars"))


def joined(lines: DataFrame, keys: list[str], text: str, order: str, separator: str) -> DataFrame:
    return lines.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda p: p[text]), separator).alias("text"))


def selected_pages(tasks: DataFrame, total: str = "total", value: str = "page_range") -> DataFrame:
    """tasks with ``selected`` (null and ``range_error`` where the range is invalid); other files than PDF have page 0."""
    pages = F.when(X.extension(F.col("path")) == "pdf", X.page_range(F.coalesce(value, F.lit("")), F.col(total))).otherwise(F.array(F.lit(0)))
    out = tasks.withColumn("selected", pages)
    reason = F.when(F.col(total) < 1, "no-pages").when(F.length(value) > X.MOST_OF_RANGE, "too-long").otherwise("bad-token")
    return out.withColumn("range_error", F.when(F.col("selected").isNull(), reason))


def page_count(path: Column, pdf_pages: Column) -> Column:
    return F.when(X.extension(path) == "pdf", pdf_pages).otherwise(1)


def pending(selected: DataFrame, done: DataFrame) -> DataFrame:
    """(task_id, page_index) still to do: selected without done."""
    return selected.select("task_id", F.explode("selected").alias("page_index")).join(done.select("task_id", "page_index"), ["task_id", "page_index"], "left_anti")


def above_threshold(rows: DataFrame, threshold: float, score: str = "score") -> DataFrame:
    """Rows scored at least ``threshold``; rows without a score, from embedded text, are exempt."""
    if not 0 <= threshold <= 1:
        raise ValueError("a threshold is from 0 to 1")
    return rows.filter(F.col(score).isNull() | (F.col(score) >= threshold))


def rotated(rotation: Column, by: int) -> Column:
    return F.pmod(rotation + by + 360, F.lit(360))


def valid_rotation(rotation: Column) -> Column:
    return F.when(rotation.isin(ROTATIONS), rotation).otherwise(F.raise_error("a rotation is 0, 90, 180 or 270"))


def percent_done(done: Column, selected: Column) -> Column:
    return F.when(selected > 0, F.bround(done / selected * 100)).cast("int")


def result_mode(result_type: Column, task_mode: Column, n_tables: Column) -> Column:
    return F.when((result_type == "table") | (task_mode == "table") | (n_tables > 0), "table").otherwise("text")


def is_complete(results: DataFrame) -> DataFrame:
    """``results`` with complete: neither partial nor cancelled and all selected pages there."""
    return results.withColumn("complete", ~F.coalesce("partial", F.lit(False)) & ~F.coalesce("cancelled", F.lit(False)) & (F.col("page_count") >= F.coalesce("selected_count", "total_count")))


def finalized(results: DataFrame, pages: DataFrame) -> DataFrame:
    """Results recomputed from their pages: defaults, clamps and counts. pages: task_id, page_index, text, n_blocks, n_tables (one row a page)."""
    by = pages.groupBy("task_id").agg(
        F.count("*").cast("int").alias("page_count"),
        F.sum("n_blocks").cast("int").alias("block_count"),
        F.sum("n_tables").cast("int").alias("raw_table_count"),
        F.array_join(F.filter(F.transform(F.array_sort(F.collect_list(F.struct("page_index", "text"))), lambda p: p["text"]), lambda t: t != ""), "\n\n").alias("page_text"),
    )
    r = results.join(by, "task_id", "left").fillna({"page_count": 0, "block_count": 0, "raw_table_count": 0, "page_text": ""})
    own = F.coalesce("text", F.lit(""))
    edited = F.coalesce("text_edited", F.lit(False)) & F.col("text").isNotNull()
    return r.select(
        "task_id",
        F.when(F.col("profile") == "accurate", "accurate").otherwise("fast").alias("profile"),
        result_mode(F.col("result_type"), F.col("task_mode"), F.col("raw_table_count")).alias("result_type"),
        F.when(edited, own).when(F.col("page_text") != "", F.col("page_text")).otherwise(own).alias("text"),
        F.when(F.coalesce("text_edited", F.lit(False)), F.least("page_count", F.coalesce("edited_pages", "page_count"))).alias("edited_pages"),
        "page_count", "block_count", "raw_table_count",
        F.greatest("page_count", F.coalesce("total_count", F.lit(0))).alias("total_count"),
        F.greatest("page_count", F.coalesce("selected_count", F.lit(0))).alias("selected_count"),
        F.when(F.col("rotation").isin(ROTATIONS), F.col("rotation")).otherwise(0).alias("rotation"),
        F.greatest(F.lit(0), F.coalesce("elapsed_ms", F.lit(0))).alias("elapsed_ms"),
    )


def can_resume(a: str = "r", b: str = "o") -> Column:
    """Whether a stored result (alias ``a``) can go on under the options (alias ``b``)."""
    p, q = (lambda n: F.col(f"{a}.{n}")), (lambda n: F.col(f"{b}.{n}"))
    equal = lambda n, default=None: (F.coalesce(p(n), F.lit(default)) == F.coalesce(q(n), F.lit(default))) if default is not None else p(n).eqNullSafe(q(n))
    test = (p("page_count") > 0) & (p("page_count") < F.coalesce(p("selected_count"), p("total_count"))) & equal("profile") & equal("result_type") & equal("threshold")
    test &= equal("page_range", "") & equal("rotation", 0) & equal("pdf_source", "ocr") & equal("ruby_enabled", False)
    test &= p("source_size").eqNullSafe(q("source_size")) & p("source_mtime_ns").eqNullSafe(q("source_mtime_ns")) & q("source_size").isNotNull() & q("source_mtime_ns").isNotNull()
    return F.coalesce(test, F.lit(False))


def islands(pages: DataFrame, key: str = "task_id", index: str = "page_index") -> DataFrame:
    """Runs of consecutive pages: key, first_page, last_page, pages."""
    distinct = pages.select(key, index).distinct()
    run = F.col(index) - F.row_number().over(Window.partitionBy(key).orderBy(index))
    return distinct.withColumn("_run", run).groupBy(key, "_run").agg(F.min(index).alias("first_page"), F.max(index).alias("last_page"), F.count("*").alias("pages")).drop("_run")


def edited_prefix(pages: DataFrame, results: DataFrame) -> DataFrame:
    """Edited text and the text of the pages behind the edited ones, joined by a blank line."""
    place = F.row_number().over(Window.partitionBy("task_id").orderBy("page_index")) - 1
    rest = pages.withColumn("place", place).join(results.select("task_id", "edited_pages"), "task_id").filter(F.col("place") >= F.coalesce("edited_pages", F.lit(1 << 30)))
    tail = joined(rest.filter("text <> ''"), ["task_id"], "text", "page_index", "\n\n").withColumnRenamed("text", "tail")
    return results.join(tail, "task_id", "left").select("task_id", F.concat_ws("\n\n", F.nullif("text", F.lit("")), F.nullif("tail", F.lit(""))).alias("text"))


def document_info(tasks: DataFrame, listing: DataFrame) -> DataFrame:
    """task_id, total and selected pages, size and modification time of PDF files; tasks: path, total, page_range."""
    chosen = selected_pages(tasks.filter(X.extension(F.col("path")) == "pdf"))
    return chosen.join(listing, "path", "left").select("task_id", "total", F.size("selected").alias("selected_count"), "range_error", F.col("length").alias("source_size"), "modification_time")


def begun(tasks: DataFrame, results: DataFrame, pages: DataFrame) -> DataFrame:
    """Results at the start of a run: partial, with the options of ``tasks`` and what earlier pages have given; tables stay as recognised until the end."""
    old = finalized(results, pages).select("task_id", "text", "page_count", "block_count", "raw_table_count")
    own = [c for c in tasks.columns if c not in old.columns]
    return tasks.select("task_id", *own).join(old, "task_id", "left").fillna({"text": "", "page_count": 0, "block_count": 0, "raw_table_count": 0}).withColumns({"partial": F.lit(True), "cancelled": F.lit(False), "table_count": F.col("raw_table_count")})


def headers(results: DataFrame) -> DataFrame:
    """What the store keeps in front: without pages and tables, and without text that hasn't been edited."""
    kept = results.drop("pages", "tables")
    return kept.withColumn("text", F.when(F.coalesce("text_edited", F.lit(False)), F.col("text"))) if "text" in kept.columns else kept


def least_score(scores: Column) -> Column:
    """Of a reading's blocks; 0 where there is none."""
    return F.coalesce(F.array_min(scores), F.lit(0.0))
