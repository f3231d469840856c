"""Mix sources to target weights by hash thresholds (operator 6), DataFrame operations only.

Sizes (words) are summed by source and hash bucket; the bucket where a source's
running sum crosses its budget is cut into finer buckets, and so on, so a
document is taken when its hash lies below its source's threshold.  Nothing is
sorted but the buckets; hot sources are summed in the map tasks.

A document is taken `floor(target / source size)` times, and once more below the
threshold, unless it has no words.  Targets: the total is shared by weight, a target stops at the ceiling,
the excess goes to the others by weight until none is above.

Null source: a source of its own, last in the order of weights.  Null text: size
0.  Repeated rows have equal hashes and are taken alike.  Empty tables give empty
results, and sources without words get the target 0.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from specforge.llm.common import WORD, fresh, n_words, stored

BITS = 12          # hash bits a level of buckets tells apart
LEVELS = 3
SMALL = 10_000     # sources up to which per-source rows are broadcast


def row_hash(doc: str, text: str) -> Column:
    return F.xxhash64(F.col(doc), F.col(text))


def _bits(h: Column, level: int) -> Column:
    """The first bits of the hash, as many as `level` levels have, as an unsigned number."""
    return F.shiftrightunsigned(h, 64 - BITS * level)


def targets(sizes: DataFrame, weights: Sequence[float], share: float, ceiling: float) -> DataFrame:
    """source, source_size, target from one row per source.

    Sources are ordered by how soon they reach the ceiling; the first ones whose
    share of what the earlier ones leave exceeds it are full.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(order) - 1) % len(weights)
    by_turn = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn.cast("int") + 1)
    weighed = sizes.select("source", "source_size", by_turn.alias("weight"),
                           (ceiling * F.col("source_size")).alias("cap"))
    everything = Window.partitionBy()
    soonest = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = soonest.rowsBetween(Window.unboundedPreceding, -1)
    rest = soonest.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    budget = share * F.sum("source_size").over(everything)
    level = (budget - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(rest)
    full = weighed.withColumn("budget", budget).withColumn("full", level * F.col("weight") > F.col("cap"))
    left = F.col("budget") - F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(everything), F.lit(0.0))
    open_weight = F.sum(F.when(~F.col("full"), F.col("weight"))).over(everything)
    target = F.when(F.col("full"), F.col("cap")).otherwise(left * F.col("weight") / open_weight)
    return full.select("source", "source_size", target.alias("target"))


def attach(rows: DataFrame, per_source: DataFrame, source: str, broadcast: bool,
           how: str = "inner") -> DataFrame:
    """Rows with their source's columns; null meets null."""
    key = fresh(rows, "of")
    right = per_source.withColumnRenamed("source", key)
    right = F.broadcast(right) if broadcast else right
    return rows.join(right, rows[source].eqNullSafe(right[key]), how).drop(key)


def thresholds(narrow: DataFrame, weights: Sequence[float], share: float,
               ceiling: float) -> tuple[DataFrame, bool]:
    """Per source: source_size, target, `whole` (times every document is taken) and
    `below` (hash prefix under which it is taken once more).  Also whether there are
    few enough sources to broadcast them.

    `narrow` has source, size and h; it is read once per level.
    """
    sizes = narrow.groupBy("source").agg(F.sum("size").cast("double").alias("source_size"))
    plan = targets(sizes, weights, share, ceiling)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    plan = plan.withColumn("whole", whole.cast("bigint"))
    plan = stored(plan.withColumn("budget", F.col("target") - F.col("whole") * F.col("source_size"))
                  .withColumn("below", F.lit(0).cast("bigint")))
    few = plan.limit(SMALL + 1).count() <= SMALL
    for level in range(1, LEVELS + 1):
        prefix = _bits(F.col("h"), level)
        inside = attach(narrow.select("source", "size", "h"), plan.select("source", "below"), "source", few)
        cells = (inside.where(_bits(F.col("h"), level - 1) == F.col("below") if level > 1 else F.lit(True))
                 .groupBy("source", prefix.alias("cell")).agg(F.sum("size").alias("n")))
        running = Window.partitionBy("source").orderBy("cell")
        upto = cells.withColumn("upto", F.sum("n").over(running))
        crossing = (attach(upto, plan.select("source", "budget"), "source", few).where("upto > budget")
                    .groupBy("source").agg(F.min_by(F.struct("cell", "n", "upto"), "cell").alias("at")))
        over, gone = F.col("at.upto") - F.col("budget"), F.col("at.upto") - F.col("at.n")
        # In the finest cell the nearer side counts.
        closer = F.when(over < F.col("budget") - gone, 1).otherwise(0) if level == LEVELS else F.lit(0)
        # No crossing: every document left is taken, so the prefix behind the last one.
        beyond = F.shiftleft(F.col("below") + 1, BITS) if level > 1 else F.lit(1 << BITS)
        plan = stored(attach(plan, crossing, "source", few, "left").select(
            "source", "source_size", "target", "whole", (F.col("budget") - F.coalesce(gone, F.lit(0))).alias("budget"),
            F.coalesce(F.col("at.cell") + closer, beyond).cast("bigint").alias("below")))
    return plan.select("source", "source_size", "target", "whole", "below"), few


def copies(h: Column, whole: Column, below: Column) -> Column:
    return whole + F.when(_bits(h, LEVELS) < below, 1).otherwise(0)


def narrowed(docs: DataFrame, doc: str, source: str, text: str) -> DataFrame:
    """The small columns, computed from the texts once and kept."""
    return stored(docs.select(F.col(doc).alias("doc_id"), F.col(source).alias("source"),
                              n_words(F.col(text)).alias("size"), row_hash(doc, text).alias("h")))


def decide(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, ceiling: float = 2.0,
           doc: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """doc_id, size, source_size, target, taken for every row."""
    narrow = narrowed(docs, doc, source, text)
    plan, few = thresholds(narrow, weights, share, ceiling)
    return attach(narrow, plan, "source", few).select(
        "doc_id", "size", F.col("source_size").cast("bigint").alias("source_size"), "target",
        (F.col("size") * copies(F.col("h"), F.col("whole"), F.col("below"))).alias("taken"))


def mix(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, ceiling: float = 2.0,
        doc: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """The rows of the mix, each as often as it is taken, with their columns.

    Texts are not shuffled while the sources are few; beyond that they join by source.
    """
    plan, few = thresholds(narrowed(docs, doc, source, text), weights, share, ceiling)
    h, own, times = (fresh(docs, name) for name in ("h", "own", "times"))
    own_plan = plan.select("source", F.struct("whole", "below").alias(own))
    rows = attach(docs.withColumn(h, row_hash(doc, text)), own_plan, source, few)
    # A text without words adds nothing below the threshold.
    n = F.when(F.coalesce(F.col(text).rlike(WORD), F.lit(False)), copies(F.col(h), F.col(own)["whole"], F.col(own)["below"])) \
        .otherwise(F.col(own)["whole"]).cast("int")
    return (rows.withColumn(times, n).where(F.col(times) > 0)
            .withColumn(times, F.explode(F.sequence(F.lit(1), F.col(times)))).select(*docs.columns))
