"""A load as one version: counters, marks, and what a failure leaves."""

import pytest
from pyspark.sql import functions as F

from specforge.sources import exports, runs

SOURCE = "id bigint, name string, value double, created string, status string"

def how():
    return {"key": "id", "position": "id", "status": "status", "created": "created", "content": F.col("name"),
            "converted": F.col("name") != "bad", "core": F.col("value") > 0}


def load(table, spark, *rows, **more):
    source = spark.createDataFrame(rows, SOURCE).withColumn("created", F.col("created").cast("timestamp"))
    return runs.load_new(table, source, source.drop("status").limit(0), **(how() | more))


def state(table):
    rows = sorted((r.id, r.value) for r in runs.part(table, "rows").collect())
    return rows, {r.id: r.status for r in runs.part(table, "source").collect()}, runs.part(table, "report").first().asDict()


def test_a_load_is_one_version(spark, tmp_path):
    table = exports.VersionedTable(spark, str(tmp_path / "t"))
    assert runs.part(table, "rows") is None
    seen = load(table, spark, (1, "a", 1.0, "2024-01-01", "New"), (2, "bad", 1.0, "2024-01-03", "New"), (3, "c", 0.0, "2024-01-02", "New"),
                (4, "d", 1.0, "2024-01-09", "Held"), (None, "e", 1.0, "2024-01-02", "New"), (6, " ", 1.0, None, "New"))
    rows, status, report = state(table)
    assert rows == [(1, 1.0)] and status == {1: "Synced", 2: "New", 3: "New", 4: "Held", None: "New", 6: "New"}
    assert str(report.pop("last_created_at")) == "2024-01-03 00:00:00"
    assert report == {"n_ok": 1, "n_no_id": 1, "n_no_content": 1, "n_converter_empty": 1, "n_core_empty": 1, "n_late": 0}
    assert seen == {"rows": 1, "rejected": 4, "synced": 1} and table.current() == 1
    # The next load: a known id takes the new values, rows up to the mark are late.
    seen = load(table, spark, (1, "a", 7.0, "2024-01-05", "New"), (3, "c", 5.0, "2024-01-02", "New"))
    rows, status, report = state(table)
    assert rows == [(1, 7.0)] and status == {1: "Synced", 3: "New"} and report["n_late"] == 1
    assert seen == {"rows": 1, "rejected": 1, "synced": 1} and table.current() == 2
    # Nothing accepted: the mark stays.
    load(table, spark, (9, "", 7.0, "2024-02-01", "New"))
    assert str(state(table)[2]["last_created_at"]) == "2024-01-05 00:00:00"


def test_a_failure_leaves_the_old_version(spark, tmp_path):
    table = exports.VersionedTable(spark, str(tmp_path / "t"))
    load(table, spark, (1, "a", 1.0, "2024-01-01", "New"))
    before = state(table)
    broken = F.when(F.col("id") == 3, F.raise_error(F.lit("stopped")).cast("boolean")).otherwise(F.lit(True))
    with pytest.raises(Exception, match="stopped"):
        load(table, spark, *[(k, "a", 1.0, "2024-02-01", "New") for k in range(1, 5)], core=broken)
    assert table.current() == 1 and state(table) == before
    load(table, spark, (2, "b", 1.0, "2024-02-01", "New"))
    assert table.current() == 2 and state(table)[0] == [(1, 1.0), (2, 1.0)]
