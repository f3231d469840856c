"""Streams into a table dealt to hash partitions, of which a batch rewrites only those it touches."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from specforge.operators.merge import ROW_KEY, upsert

BUCKET = "bucket"


class PartitionedTable:
    """A parquet table partitioned by a hash of its key columns.

    A batch is merged in three steps: its rows are written aside, merged with the
    partitions they fall into, marked, and then put in place of these partitions by a
    dynamic partition overwrite.  A driver that dies before the mark leaves the table
    as it was; one that dies after it left the merged partitions aside, and the batch,
    when it comes again, puts them in place without reading the table.  Two such
    places are used in turn, so they do not pile up.

    The number of buckets belongs to the table and must stay the same.  Rows that lack
    a key column are not taken; of rows with one key in a batch the last position
    counts, over batches the last batch.
    """

    def __init__(self, spark: SparkSession, path: str, columns: str, position: str, keys: Sequence[str] = ROW_KEY,
                 buckets: int = 64):
        self.spark, self.path, self.columns = spark, path.rstrip("/"), columns
        self.position, self.keys, self.buckets = position, list(keys), buckets
        empty = spark.createDataFrame([], columns).withColumn(BUCKET, F.lit(0))
        self.schema = empty.schema
        empty.write.mode("append").partitionBy(BUCKET).parquet(self.path)     # the folder exists from now on

    def _stored(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)

    def read(self) -> DataFrame:
        return self._stored().drop(BUCKET)

    def _marked(self, place: str) -> int | None:
        try:
            return self.spark.read.schema("batch bigint").json(f"{place}/mark").first()["batch"]
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return None

    def merge(self, rows: DataFrame, run: str, batch: int) -> None:
        """Upsert the rows of a stream's batch; the same batch again changes nothing."""
        place = f"{self.path}-batches/{hashlib.sha256(run.encode()).hexdigest()[:32]}/{batch % 2}"
        if self._marked(place) != batch:
            bucket = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")
            rows.withColumn(BUCKET, bucket).write.mode("overwrite").parquet(f"{place}/rows")
            new = self.spark.read.parquet(f"{place}/rows")
            touched = [r[BUCKET] for r in new.select(BUCKET).distinct().collect()]     # at most as many as buckets
            old = self._stored().where(F.col(BUCKET).isin(touched))
            merged = upsert(old, new, self.position, [BUCKET, *self.keys])
            merged.repartition(BUCKET).write.mode("overwrite").parquet(f"{place}/merged")
            mark = self.spark.createDataFrame([(batch,)], "batch bigint")
            mark.coalesce(1).write.mode("overwrite").json(f"{place}/mark")
        (self.spark.read.schema(self.schema).parquet(f"{place}/merged").repartition(BUCKET)
         .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(self.path))


def ingest(stream: DataFrame, transform: Callable[[DataFrame], DataFrame], table: PartitionedTable, checkpoint: str):
    """Run all available input through `transform` into the table, then stop."""
    def apply(batch: DataFrame, epoch: int) -> None:
        run = table.spark.sparkContext.getLocalProperty("sql.streaming.queryId") or checkpoint
        table.merge(transform(batch), run, epoch)

    query = (stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
             .trigger(availableNow=True).start())
    query.awaitTermination()
    return query
