"""A load as one published version: rows, source statuses and report together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from specforge.operators.merge import upsert
from specforge.sources import loads, records
from specforge.sources.exports import VersionedTable

START = "1970-01-01"


def part(table: VersionedTable, name: str) -> DataFrame | None:
    """One of the frames of the newest version; None before the first."""
    if table.current() == 0:
        return None
    return table.read().where(F.col("kind") == name).select(f"{name}.*")


def publish(table: VersionedTable, metrics: dict[str, Column], **parts: DataFrame) -> dict:
    """Write several frames as one version, so that all of them count or none does.

    `metrics` are aggregates over (kind and one struct per frame), observed while the
    version is written; they come back as values.
    """
    kinds = {name: df.schema for name, df in parts.items()}
    whole = None
    for name, df in parts.items():
        own = df.select(F.lit(name).alias("kind"), *[
            (F.struct(*[F.col(f"`{c}`") for c in df.columns]) if k == name else F.lit(None).cast(s)).alias(k) for k, s in kinds.items()])
        whole = own if whole is None else whole.unionByName(own)
    seen = Observation()
    table.write(whole.observe(seen, *[c.alias(n) for n, c in metrics.items()]))
    return seen.get


def load_new(table: VersionedTable, source: DataFrame, empty: DataFrame, key: str, position: str, status: str, created: str,
             content: Column, converted: Column, core: Column) -> dict:
    """Take the rows of status `New` behind the mark, upsert those that pass, mark them as
    synced, and publish target, statuses and report as one version.

    The report is one row: the new mark and a count per outcome; the mark moves only if a
    row was accepted.  `empty` gives the target's columns.  Rejected rows keep their status.
    A job that fails leaves the old version in force.  A null stamp is never late.
    Returns what was written: rows of the target, rows newly synced, rows rejected.
    """
    old, state = part(table, "rows"), part(table, "report")
    kind = source.schema[created].dataType
    mark = F.lit(START if state is None else state.select(F.col("last_created_at").cast("string")).first()[0]).cast(kind)
    fresh = records.only_new(source, status)
    outcomes = loads.load_outcomes(fresh, created, mark, F.col(key), content, converted, core)
    accepted = outcomes.where("outcome = 'OK'")
    report = loads.next_state(outcomes, created, mark)
    rejected = F.sum(F.when(F.col("kind") == "report", sum(F.col(f"report.{c}") for c in report.columns if c not in ("last_created_at", "n_ok"))))
    return publish(
        table, {"rows": F.count_if(F.col("kind") == "rows"), "rejected": F.coalesce(rejected, F.lit(0)),
                "synced": F.coalesce(F.sum("report.n_ok"), F.lit(0))},
        rows=upsert(empty if old is None else old, accepted, position, [key]),
        source=records.mark_synced(source, accepted.select(key), key, status), report=report)
