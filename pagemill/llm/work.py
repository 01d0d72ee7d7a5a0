"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: dict[str, str] = {}
BATCH_BYTES = 4 << 20
NO_ID = -(1 << 63)  # stands for a null doc_id


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``. Where that is unset, a temporary folder, but only in local mode: a cluster's executors don't share one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    if "dir" not in _OWN:
        _OWN["dir"] = "file://" + tempfile.mkdtemp(prefix="pagemill-")
    return _OWN["dir"]


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches of a few MB, however long the texts; the setting stays in the session."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/pagemill/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: cuts the lineage and survives lost executors."""
    bounded_batches(df.sparkSession)
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def row_key() -> dict[str, Column]:
    """What tells rows apart: the doc_id (NO_ID for null) and the text's fingerprint. Rows alike in both share all decisions."""
    return {"__doc": F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID).cast("long")), "__text": F.xxhash64(F.coalesce("text", F.lit("")))}


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """``docs`` without the rows of the keys (doc, text_id) in ``gone``. Spark broadcasts the keys if they are few, else deals out both sides."""
    keys = gone.select(F.col("doc").alias("__gone_doc"), F.col("text_id").alias("__gone_text")).distinct()
    keyed = docs.withColumns(row_key())
    return keyed.join(keys, (F.col("__doc") == F.col("__gone_doc")) & (F.col("__text") == F.col("__gone_text")), "left_anti").drop("__doc", "__text")


def removed(df: DataFrame) -> None:
    """Deletes the table behind a frame of :func:`written` that is no longer needed."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def freed(spark: SparkSession) -> None:
    """Shuffle files of steps that are over go. Spark drops them with the driver's garbage, which a driver that has little to do seldom collects; Python's hold on finished frames ends first, and Spark's on the last step a moment later, so the driver collects twice."""
    gc.collect()
    for _ in range(2):
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.3)
