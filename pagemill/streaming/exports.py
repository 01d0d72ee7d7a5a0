"""Export of documents as they are completed, beside the pages that still arrive."""

from __future__ import annotations

import os
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from pagemill.operators.exports import numbered, text_files
from pagemill.operators.pages import document_text
from pagemill.streaming.pages import completions, pages_of

STATES = "task_id string, name string, state string"


def export_completed(texts: DataFrame, directory: str) -> DataFrame:
    """Writes a text file for each of ``texts`` (task_id, file_name, text); columns STATES: written, exists or failed.

    Executors write; a file that is there is never replaced, and one that fails doesn't keep others from being written.
    Names that meet within the call are numbered by task_id. The directory is one that all executors can reach.
    """
    named = numbered(text_files(texts, "task_id").withColumn("ord", F.col("task_id"))).select("task_id", "final_name", "content")

    def write(batches):
        for b in batches:
            states = []
            for name, content in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                target = Path(directory) / name
                staged = Path(directory) / f".staged-{name}-{os.getpid()}"
                try:
                    staged.write_bytes(content)
                    os.link(staged, target)  # all or nothing, and never over another file
                    states.append("written")
                except FileExistsError:
                    states.append("written" if target.is_file() and target.read_bytes() == content else "exists")  # a repeated task finds its own file
                except OSError:
                    states.append("failed")
                finally:
                    staged.unlink(missing_ok=True)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(states, pa.string())], ["task_id", "name", "state"])

    return named.mapInArrow(write, STATES)


def export_as_completed(spark: SparkSession, stored: str, selected: DataFrame, directory: str, states: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """A query beside that of ``store_pages``: exports each document once, when all its selected pages are stored; what became of it is kept under ``states``.

    selected: task_id, selected_count, file_name; stored: the folder of the stored pages, of which only the batches and
    buckets of finished documents are read. A failure here doesn't touch the pages; a batch done again finds its own files.
    """

    def batch(finished: DataFrame, number: int) -> None:
        finished = finished.persist()
        try:
            texts = document_text(pages_of(spark, stored, finished)).join(selected.select(F.col("task_id").alias("task_id"), "file_name"), "task_id")
            export_completed(texts, directory).write.mode("overwrite").parquet(f"{states}/batch={number}")
        finally:
            finished.unpersist()

    writer = completions(spark, stored, selected).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()
