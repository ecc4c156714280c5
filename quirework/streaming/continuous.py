"""Continuous ingest: an extension that the batch operators make possible.

New files of a folder stream in as micro-batches; each writes a segment of the store with its own rows. Batches that
run again after a failure replace the same keys, so nothing is doubled; files that can't be read go to `failures`.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..sources.formats import source_format


def file_stream(spark: SparkSession, folder: str) -> DataFrame:
    from pyspark.sql.types import StructType

    schema = StructType().add("path", "string").add("modificationTime", "timestamp").add("length", "long").add("content", "binary")
    rows = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").load(folder)
    path = F.regexp_replace("path", "^file:/+", "/")
    return rows.select(path.alias("path"), source_format(path).alias("file_type"), F.sha2("content", 256).alias("content_hash"), "content")


def ingest_stream(kb, folder: str, checkpoint: str, once: bool = True):
    """Starts a query that ingests the files of a folder into a knowledge base; PDF files need their sidecars, which a whole ingest finds."""
    def batch(files: DataFrame, number: int) -> None:
        known = kb.store.table("documents").select("content_hash")
        fresh = files.where("file_type <> 'pdf'").dropDuplicates(["content_hash"]).join(known, "content_hash", "left_anti").persist()
        try:
            if fresh.take(1):
                stage = f"batch-{number}-{uuid.uuid4().hex}"
                try:
                    made = kb.parsed(fresh.select("path", "file_type", "content_hash", "content"), stage)
                    del made["blocks"], made["pieces"]
                    kb.publish(made)
                finally:
                    kb._unstage(stage)
        finally:
            fresh.unpersist()

    writer = file_stream(kb.spark, folder).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def latest_states(events: DataFrame, key: str, state: str, at: str, late: str = "10 minutes", window: str = "5 minutes") -> DataFrame:
    """The last state of each key in each window of a stream with late events."""
    rows = events.withWatermark(at, late)
    return rows.groupBy(F.window(at, window), key).agg(F.max_by(state, at).alias(state), F.max(at).alias(at)).select(F.col("window.start").alias("start"), key, state, at)
