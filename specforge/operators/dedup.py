"""Duplicate removal and field merging (D*), newest per key.

Groups may be hot.  Every operator here combines inside the map tasks first:
rank-one windows plan as a partial and a final group limit, merges are ordered
aggregates.  No group is ever collected.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from specforge import rules
from specforge.functions import text


def first_per_key(df: DataFrame, keys: Sequence[Column], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in the given total order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def keep_first(df: DataFrame, doc: str, position: str) -> DataFrame:
    """First row per document, lower(brand) and lower(model)."""
    return first_per_key(df, [F.col(doc), F.lower("brand_name"), F.lower("model")],
                         [F.col(position)])


def richness(numeric=tuple(rules.NUMERIC_FIELDS), flags=tuple(rules.BOOLEAN_FIELDS),
             texts=tuple(rules.TEXT_FIELDS)) -> Column:
    """Numbers and flags count 2, filled texts 1."""
    two = [F.when(F.col(c).isNotNull(), 2).otherwise(0) for c in (*numeric, *flags)]
    one = [F.when(~text.is_blank(F.col(c)), 1).otherwise(0) for c in texts]
    return text.sum_of(two + one)


def keep_richest(df: DataFrame, keys: Sequence[str], position: str,
                 score: Column | None = None) -> DataFrame:
    """Richest row per key, the earlier one on ties."""
    df = df.withColumn("_rich", score if score is not None else richness())
    return first_per_key(df, [F.col(k) for k in keys],
                         [F.col("_rich").desc(), F.col(position)]).drop("_rich")


def merge_first_filled(df: DataFrame, keys: Sequence[str], position: str,
                       fields: Sequence[str], flags: Sequence[str] = ()) -> DataFrame:
    """Per key the first non-empty value of each field.

    Zero and '' count as empty, yet survive as the first value when nothing
    fuller follows; flags only ask for non-null.
    """
    pos = F.col(position)
    types = dict(df.dtypes)

    def first(c):
        col = F.col(c)
        if c in flags:
            filled = col.isNotNull()
        else:
            filled = (col != "") if types[c] == "string" else (col != 0)
        return F.coalesce(F.min_by(col, F.when(filled, pos)),
                          F.min_by(col, pos)).alias(c)
    return df.groupBy(*keys).agg(F.min(pos).alias(position),
                                 *[first(c) for c in (*fields, *flags)])


def merge_richer(df: DataFrame, keys: Sequence[str], position: str,
                 texts: Sequence[str], values: Sequence[str],
                 weight: str | None = "weight") -> DataFrame:
    """Per key: longest text (first on ties), last non-null value, grams before ounces."""
    pos = F.col(position)

    def longest(c):
        size = F.length(text.trim(F.col(c)))
        return F.max_by(c, F.when(F.col(c).isNotNull(), F.struct(size, -pos))).alias(c)

    def last(c, cond=None):
        ok = F.col(c).isNotNull() if cond is None else cond
        return F.max_by(c, F.when(ok, pos))
    aggs = [longest(c) for c in texts] + [last(c).alias(c) for c in values]
    if weight:
        aggs.append(F.coalesce(last(weight, F.col(weight) > 50), last(weight)).alias(weight))
    return df.groupBy(*keys).agg(F.min(pos).alias(position), *aggs)


def richer_scores(candidate: dict[str, Column], existing: dict[str, Column],
                  weights: dict[str, int] = rules.RICHER_WEIGHTS) -> tuple[Column, Column]:
    """Weighted counts of filled fields, with a bonus for a weight in grams."""
    def score(side):
        return text.sum_of([F.when(v.isNotNull(), weights.get(k, 1)).otherwise(0)
                            for k, v in side.items()])
    cand, have = score(candidate), score(existing)
    if "weight" in candidate:
        c, e = candidate["weight"], existing["weight"]
        nz = (c != 0) & (e != 0)
        cand = cand + F.when(nz & (c > 50) & (e <= 50), 2).otherwise(0)
        have = have + F.when(nz & (e > 50) & (c <= 50), 2).otherwise(0)
    return cand, have


def is_richer(candidate: dict[str, Column], existing: dict[str, Column]) -> Column:
    cand, have = richer_scores(candidate, existing)
    return cand > have


# --- similar names --------------------------------------------------------------

def _similar(a: Column, b: Column) -> Column:
    ma, mb = F.lower(a["model"]), F.lower(b["model"])
    near = lambda s, l: F.startswith(l, s) & (F.length(l) - F.length(s) <= 5)  # noqa: E731,E741
    return (F.lower(a["brand_name"]) == F.lower(b["brand_name"])) & (near(ma, mb) | near(mb, ma))


def fold_similar(models: Column, fields: Sequence[str], flags: Sequence[str] = (),
                 keep_zero: Sequence[str] = ("drop",), texts: Sequence[str] = ()) -> Column:
    """Sequential merge inside one document's array of structs.

    Each item joins the first earlier entry of the same brand whose name is a
    prefix (at most five characters apart); the longer name stays, other fields
    take the first filled value.  The order matters, so the fold runs over the
    array of one document row.
    """
    def pick(a, b, f):
        if f in flags or f in keep_zero:
            return F.coalesce(a[f], b[f])
        if f in texts:
            return F.coalesce(F.nullif(a[f], F.lit("")), b[f])
        return F.coalesce(F.when(a[f] != 0, a[f]), b[f])

    def merged(a, b):
        return F.struct(
            a["brand_name"].alias("brand_name"),
            F.when(F.length(a["model"]) >= F.length(b["model"]), a["model"])
            .otherwise(b["model"]).alias("model"),
            *[pick(a, b, f).alias(f) for f in (*fields, *texts, *flags)])

    def step(acc, m):
        first = F.array_position(F.transform(acc, lambda e: _similar(e, m)), True)
        return text.let(first, lambda at: F.when(at > 0, F.transform(
            acc, lambda e, i: F.when(i + 1 == at, merged(e, m)).otherwise(e))
        ).otherwise(F.concat(acc, F.array(m))))
    return F.aggregate(models, F.slice(models, 1, 0), step)


def similar_name_pairs(df: DataFrame, keys: Sequence[str], name: str,
                       max_extra: int = 5) -> DataFrame:
    """(keys, short, long) of distinct names where one extends the other.

    Every name is offered under its own prefixes, so pairs meet by equality:
    at most `max_extra + 1` join rows per distinct name.
    """
    names = df.select(*keys, F.lower(name).alias("long")).distinct()
    cuts = names.select(*keys, "long", F.explode(F.transform(
        F.sequence(F.lit(1), F.lit(max_extra)),
        lambda k: F.when(F.length("long") > k,
                         F.substring("long", 1, F.length("long") - k)))).alias("short"))
    return cuts.filter("short is not null").join(
        names.withColumnRenamed("long", "short"), [*keys, "short"], "left_semi")


# --- newest per key ---------------------------------------------------------------

def latest(df: DataFrame, keys: Sequence[str], created: str, tie: str) -> DataFrame:
    """Newest row per key; a missing stamp counts as newest, `tie` decides."""
    return first_per_key(df, [F.col(k) for k in keys],
                         [F.col(created).desc_nulls_first(), F.col(tie)])


def newest_and_older(df: DataFrame, keys: Sequence[str], created: str,
                     row_id: str) -> tuple[DataFrame, DataFrame]:
    """(kept, dropped): the complement goes by unique row id, not by key."""
    kept = latest(df, keys, created, row_id)
    return kept, df.join(kept.select(row_id), row_id, "left_anti")


def all_true(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)
