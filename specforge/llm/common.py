"""Helpers the operators share: shared folders, column hygiene, text chunks."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# A word of the contracts: everything but the blank and the five ASCII controls 09-0D.
WORD = r"[^\x20\x09-\x0D]+"
BLANKS = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def work_dir(spark: SparkSession) -> str:
    """A new path below the folder that the cluster shares (spark.checkpoint.dir).

    Only a local session may leave the setting out; it then gets a temporary
    folder, since its executors run in the driver.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", named)
    return f"{named.rstrip('/')}/{uuid.uuid4().hex}"


def stored(df: DataFrame, compression: str = "zstd") -> DataFrame:
    """Write the rows to the shared folder and read them back: cuts the lineage
    and survives lost executors, since the files do not live on them."""
    path = work_dir(df.sparkSession)
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fresh(df: DataFrame, base: str) -> str:
    """A column name that the frame does not have, whatever its extra columns are."""
    taken = {c.lower() for c in df.columns}
    name = base
    while name.lower() in taken:
        name = "_" + name
    return name


def words(text: Column) -> Column:
    """The words of a text as an array; null has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), BLANKS), lambda w: w != "")


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def chunks(texts: pa.Array, max_bytes: int) -> Iterator[tuple[int, int]]:
    """Row ranges of about so many bytes; a longer text stands alone, whole."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    start = total = 0
    for i, size in enumerate(sizes):
        if i > start and total + size > max_bytes:
            yield start, i
            start = i
            total = 0
        total += int(size)
    if start < len(sizes):
        yield start, len(sizes)


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def strings(batch: pa.RecordBatch, name: str) -> pa.Array:
    """A text column, null as empty."""
    return pc.fill_null(column(batch, name), "")


def batch_of(schema: pa.Schema, columns: Sequence) -> pa.RecordBatch:
    arrays = [c if isinstance(c, pa.Array) else pa.array(c, type=f.type)
              for c, f in zip(columns, schema, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, schema=schema)
