"""Article stream into a partitioned table; rows behind the watermark."""

import os

import oracle
import pytest
from pyspark.sql import functions as F

from specforge.catalog.data import articles_of
from specforge.plans import products
from specforge.streaming import ingest, partitions

FOLDER = f"{oracle.BASE}/{os.environ.get('SF', 'sf0.001')}"
COLUMNS = ("doc_id bigint, block_no int, source_id string, brand_name string, model string, model_key string, weight double, price double, "
           "drop double, date string")


def flow(batch):
    return products.article_products(batch).select("doc_id", F.col("block_no").cast("int").alias("block_no"), *COLUMNS.replace(" bigint", "").replace(
        " int", "").replace(" string", "").replace(" double", "").split(", ")[2:])


def files(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_stream_equals_batch_and_rewrites_touched_partitions(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    source, path = str(tmp_path / "in"), str(tmp_path / "table")
    table = partitions.PartitionedTable(spark, path, COLUMNS, "block_no", buckets=16)
    assert table.read().count() == 0
    for k in range(3):
        docs.where(F.col("doc_id") % 3 == k).coalesce(1).write.mode("append").parquet(source)

    def run():
        stream = articles_of(ingest.file_stream(spark, source, docs.schema, max_files=1))
        partitions.ingest(stream, flow, table, str(tmp_path / "cp"))
        return rows(table.read())

    want = rows(flow(articles_of(docs)))
    assert run() == want and len(want) > 100
    before = files(path)
    assert run() == want and files(path) == before                      # nothing new: no batch
    assert len({os.path.dirname(f) for f in before}) == 16
    # One article comes again with other figures: only its partitions are rewritten.
    one = docs.where("doc_id = 1").withColumn("text", F.lit("nothing of note"))
    one.coalesce(1).write.mode("append").parquet(source)
    run()
    new = files(path)
    changed = {os.path.dirname(f) for f in set(new) ^ set(before)}
    found = rows(flow(articles_of(one)).select(F.pmod(F.xxhash64("source_id", "brand_name", "model"), F.lit(16))).distinct())
    assert len(changed) == len(found) < 4


def test_a_batch_that_comes_again_changes_nothing(spark, tmp_path):
    """Also when the driver died while partitions were being replaced, and when it died before the mark."""
    import shutil
    path = str(tmp_path / "t")
    table = partitions.PartitionedTable(spark, path, "id int, v int, pos int", "pos", ["id"], buckets=4)
    frame = lambda *r: spark.createDataFrame(r, "id int, v int, pos int")
    table.merge(frame((1, 1, 1), (2, 1, 1), (3, 1, 1), (None, 9, 9)), "q", 0)
    table.merge(frame((1, 2, 1), (1, 3, 2), (4, 1, 1)), "q", 1)
    want = [(1, 3, 2), (2, 1, 1), (3, 1, 1), (4, 1, 1)]
    assert rows(table.read()) == want
    bucket = table._stored().where("id = 1").first()["bucket"]
    shutil.rmtree(f"{path}/bucket={bucket}")
    table.merge(frame((1, 2, 1), (1, 3, 2), (4, 1, 1)), "q", 1)
    assert rows(table.read()) == want
    table.merge(frame((2, 7, 1)), "q", 2)
    table.merge(frame((2, 7, 1)), "q", 2)
    table.merge(frame((5, 5, 5)), "other", 0)
    assert rows(table.read()) == [(1, 3, 2), (2, 7, 1), (3, 1, 1), (4, 1, 1), (5, 5, 5)]


def test_late_rows_are_counted(spark, tmp_path):
    schema = "event_id bigint, ts timestamp"
    path = str(tmp_path / "in")
    for batch in ([(1, "2024-01-10"), (2, "2024-01-09"), (2, "2024-01-09")], [(6, "2024-01-08")], [(3, "2024-01-01"), (4, "2024-01-02"), (5, "2024-01-09")]):
        spark.createDataFrame(batch, "event_id bigint, ts string").withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1) \
            .write.mode("append").parquet(path)
    stream = ingest.file_stream(spark, path, spark.createDataFrame([], schema).schema, max_files=1)
    query = ingest.run_to_files(ingest.drop_late(stream, "ts", "event_id", "3 days"), str(tmp_path / "out"), str(tmp_path / "cp"))
    assert sorted(r.event_id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [1, 2, 5, 6]
    assert ingest.rows_behind_mark(query) == 2
