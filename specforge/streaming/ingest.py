"""Incremental ingest with Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from specforge.operators.merge import ROW_KEY, upsert
from specforge.sources.exports import VersionedTable


def file_stream(spark: SparkSession, folder: str, schema, glob: str = "*.parquet",
                max_files: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema).option("pathGlobFilter", glob)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(folder)


def table_stream(spark: SparkSession, path: str, schema) -> DataFrame:
    """A table as a stream, whether it is one file or a folder of part files.

    The path is given as a pattern of itself: a file stream takes a plain path for a folder.
    """
    return spark.readStream.schema(schema).parquet(f"{path[:-1]}[{path[-1]}]")


def ingest(stream: DataFrame, transform: Callable[[DataFrame], DataFrame], table: VersionedTable,
           schema, checkpoint: str, position: str, keys: Sequence[str] = ROW_KEY):
    """Run all available input through `transform` into the table, then stop.

    Each micro-batch upserts the newest complete version into the next one and is
    noted as done, by query and batch number, once that is complete.  A batch that
    comes again is skipped if it is noted; if the driver died between the version
    and the note, the same rows are upserted again, which changes nothing.  No
    complete version is ever written over, whatever checkpoint the query starts from.
    Each version is a whole table; use `merge` of a table format where there is one.
    """
    spark = table.spark

    def apply(batch: DataFrame, epoch: int) -> None:
        run = spark.sparkContext.getLocalProperty("sql.streaming.queryId") or checkpoint
        if table.noted(run, epoch):
            return
        table.write(upsert(table.read(schema), transform(batch), position, keys))
        table.note(run, epoch)

    query = (stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
             .trigger(availableNow=True).start())
    query.awaitTermination()
    return query


def drop_late(stream: DataFrame, created: str, key: str, delay: str) -> DataFrame:
    """Rows behind the watermark are dropped, repeated keys within it too."""
    return stream.withWatermark(created, delay).dropDuplicatesWithinWatermark([key])


def run_to_files(stream: DataFrame, path: str, checkpoint: str):
    """Write all available input of a stream, then stop; the query, for its progress."""
    query = (stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
             .trigger(availableNow=True).start())
    query.awaitTermination()
    return query


def rows_behind_mark(query) -> int:
    """Rows that the stateful steps of a query left out because the watermark had passed them.

    Counted per micro-batch by Spark; a query keeps its last batches
    (`spark.sql.streaming.numRecentProgressUpdates`).
    """
    return sum(step["numRowsDroppedByWatermark"] for p in query.recentProgress for step in p["stateOperators"])


def late_counts(df: DataFrame, created: str, mark) -> DataFrame:
    """Batch form of the late-row rule: one row (accepted, late, new_mark)."""
    late = F.col(created) <= mark
    return df.agg(F.count_if(~late).alias("accepted"), F.count_if(late).alias("late"),
                  F.greatest(F.max(created), mark).alias("new_mark"))
