"""Sinks: CSV exports, validation templates, reports, table versions."""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from specforge import rules


def write_csv(df: DataFrame, path: str) -> None:
    """Every cell quoted, quotes doubled, nulls as empty cells."""
    df.write.mode("overwrite").csv(path, header=True, quoteAll=True, escape='"',
                                   emptyValue="", nullValue="")


def latest_export(df: DataFrame) -> DataFrame:
    """The 18 export columns as texts, nulls empty, the date cut to its day."""
    cells = {c: F.col(c).cast("string") for c in rules.LATEST_COLUMNS}
    cells["date"] = F.substring(cells["date"], 1, 10)
    return df.select(*[F.coalesce(v, F.lit("")).alias(c) for c, v in cells.items()])


def validation_set(rows: DataFrame, articles: DataFrame, ids: DataFrame, doc: str,
                   fields: Sequence[str] = tuple(rules.CRITICAL_FIELDS)) -> DataFrame:
    """Rows of the chosen documents with their title ('Unknown' when missing)."""
    chosen = rows.join(ids.select(doc).distinct(), doc, "left_semi")
    titles = articles.select(doc, F.col("title").alias("article_title"))
    return chosen.join(titles, doc, "left").select(
        doc, F.coalesce("article_title", F.lit("Unknown")).alias("article_title"),
        "brand_name", "model", *fields)


def truth_template(validation: DataFrame, doc: str,
                   fields: Sequence[str] = tuple(rules.CRITICAL_FIELDS)) -> DataFrame:
    """The same rows with blank `_CORRECT` columns to fill in."""
    return validation.select(doc, "brand_name", "model",
                             *[F.lit("").alias(f"{f}_CORRECT") for f in fields],
                             F.lit("").alias("notes"))


def write_report(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


# --- table versions -------------------------------------------------------------------

def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the cluster names it; local only in tests."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        master = spark.sparkContext.master
        if not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a shared folder")
        named = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", named)
    return f"{named.rstrip('/')}/{uuid.uuid4().hex}"


class VersionedTable:
    """A parquet table as numbered versions; a reader keeps the one it opened.

    Plain files cannot be overwritten while they are read, so a change writes
    the next version.  A version counts only once its `_SUCCESS` mark exists:
    a job that died leaves no visible trace and may simply run again.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(
            spark.sparkContext._jsc.hadoopConfiguration())

    def current(self) -> int:
        if not self._fs.exists(self._path(self.path)):
            return 0
        done = [0]
        for s in self._fs.listStatus(self._path(self.path)):
            name = s.getPath().getName()
            if name.startswith("v") and self._fs.exists(self._path(s.getPath(), "_SUCCESS")):
                done.append(int(name[1:]))
        return max(done)

    def read(self, schema=None) -> DataFrame:
        v = self.current()
        if v == 0:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.parquet(f"{self.path}/v{v:012d}")

    def write(self, df: DataFrame) -> int:
        """The next version; only what a job that died left there is written over."""
        v = self.current() + 1
        df.write.mode("overwrite").parquet(f"{self.path}/v{v:012d}")
        return v

    def noted(self, run: str, batch: int) -> bool:
        return self._fs.exists(self._path(f"{self.path}/{self._note(run, batch)}/_SUCCESS"))

    def note(self, run: str, batch: int) -> None:
        """Remember that a stream's batch is in the table."""
        done = self.spark.createDataFrame([(run, batch, self.current())], "run string, batch bigint, version bigint")
        done.coalesce(1).write.mode("overwrite").json(f"{self.path}/{self._note(run, batch)}")

    @staticmethod
    def _note(run: str, batch: int) -> str:
        return f"batches/{hashlib.sha256(run.encode()).hexdigest()[:32]}-{batch:012d}"
