"""Table maintenance and joins as whole-table rewrites (L*, J*, U*).

Plain files know no update, so each operator returns the next version of a
table; `sources.exports` writes it beside the old one.  Sources are reduced to
one row per key first, which keeps full joins free of hot keys; on one-sided
joins adaptive execution splits a hot left key.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from specforge import rules
from specforge.functions import keys as keyfn
from specforge.functions import text
from specforge.operators.dedup import first_per_key, is_richer

ROW_KEY = ("source_id", "brand_name", "model")


def one_per_key(df: DataFrame, keys: Sequence[str], position: str) -> DataFrame:
    """Last row per key, since a later upsert of the same key would win."""
    return first_per_key(df, [F.col(k) for k in keys], [F.col(position).desc()])


def _required(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    for k in keys:
        df = df.filter(F.col(k).isNotNull() & (F.col(k).cast("string") != ""))
    return df


def upsert(target: DataFrame, source: DataFrame, position: str,
           keys: Sequence[str] = ROW_KEY) -> DataFrame:
    """Matched rows take the supplied columns, others are inserted.

    Columns the source lacks keep the target's value.
    """
    src = one_per_key(_required(source, keys), keys, position)
    supplied = [c for c in target.columns if c in src.columns and c not in keys]
    s = src.select(*keys, *[F.col(c).alias(f"_s_{c}") for c in supplied],
                   F.lit(True).alias("_in_s"))
    joined = target.join(s, list(keys), "full")
    hit = F.col("_in_s").isNotNull()
    return joined.select(*[
        F.when(hit, F.col(f"_s_{c}")).otherwise(F.col(c)).alias(c) if c in supplied
        else F.col(c) for c in target.columns])


def upsert_outcome(target: DataFrame, source: DataFrame, position: str,
                   keys: Sequence[str] = ROW_KEY) -> DataFrame:
    """Source rows with `outcome`: created, updated or failed (a key is missing)."""
    ok = text.sum_of([F.when(F.col(k).isNull() | (F.col(k).cast("string") == ""), 1)
                      .otherwise(0) for k in keys]) == 0
    have = target.select(*keys).distinct().withColumn("_have", F.lit(True))
    src = one_per_key(source.filter(ok), keys, position)
    marked = src.join(have, list(keys), "left").withColumn(
        "outcome", F.when(F.col("_have"), "updated").otherwise("created")).drop("_have")
    return marked.unionByName(source.filter(~ok).withColumn("outcome", F.lit("failed")))


def created_or_updated(source: DataFrame, existing: DataFrame, source_id: str) -> DataFrame:
    """Flag incoming rows by a case-insensitive key; only their sources are read."""
    k = lambda p: [F.lower(F.col("brand_name")).alias(f"{p}b"),
                   F.lower(F.col("model")).alias(f"{p}m")]
    wanted = existing.join(source.select(source_id).distinct(), source_id, "left_semi")
    have = wanted.select(source_id, *k("_")).distinct().withColumn("_have", F.lit(True))
    return (source.select("*", *k("_")).join(have, [source_id, "_b", "_m"], "left")
            .withColumn("created", F.col("_have").isNull()).drop("_have", "_b", "_m"))


def fill_nulls(target: DataFrame, source: DataFrame, position: str,
               keys: Sequence[str]) -> DataFrame:
    """Matched rows only gain values they lack; new keys are inserted."""
    src = one_per_key(source, keys, position)
    common = [c for c in target.columns if c in src.columns and c not in keys]
    s = src.select(*keys, *[F.col(c).alias(f"_s_{c}") for c in common])
    return target.join(s, list(keys), "full").select(*[
        F.coalesce(F.col(c), F.col(f"_s_{c}")).alias(c) if c in common else F.col(c)
        for c in target.columns])


def upsert_if_richer(target: DataFrame, source: DataFrame, position: str, keys: Sequence[str],
                     fields: Sequence[str]) -> DataFrame:
    """Full join with `outcome`: insert, update, skip or keep; next-version values."""
    src = one_per_key(source, keys, position)
    t = target.select(*keys, *[F.col(c).alias(f"_t_{c}") for c in fields],
                      F.lit(True).alias("_in_t"))
    s = src.select(*keys, *[F.col(c).alias(f"_s_{c}") for c in fields],
                   F.lit(True).alias("_in_s"))
    j = t.join(s, list(keys), "full")
    scored = [*keys, *fields]
    side = lambda p: {c: F.col(c) if c in keys else F.col(f"_{p}_{c}")
                      for c in scored}
    richer = is_richer(side("s"), side("t"))
    outcome = (F.when(F.col("_in_t").isNull(), "insert").when(F.col("_in_s").isNull(), "keep")
               .when(richer, "update").otherwise("skip"))
    j = j.withColumn("outcome", outcome)
    take = F.col("outcome").isin("insert", "update")
    return j.select(*keys, *[F.when(take, F.col(f"_s_{c}")).otherwise(F.col(f"_t_{c}")).alias(c)
                             for c in fields], "outcome")


def stage_insert(staging: DataFrame, source: DataFrame, doc_id: str, position: str,
                 keys: Sequence[str] = ROW_KEY) -> DataFrame:
    """Source rows with `outcome`: created, skipped (key staged) or failed (bad document
    or a key is missing).

    Of a key that comes twice in the batch the first position is created.  Both
    sides are reduced to one row per key before they meet the source; rows without
    a key do not take part in the joins.
    """
    missing = [F.col(k).isNull() | (F.col(k).cast("string") == "") for k in keys]
    keyed = ~reduce(lambda a, b: a | b, missing)
    bad = F.coalesce(F.col(doc_id) <= 0, F.lit(True))
    have = staging.select(*keys).distinct().withColumn("_have", F.lit(True))
    first = source.filter(keyed & ~bad).groupBy(*keys).agg(F.min(position).alias("_first"))
    marked = source.filter(keyed).join(have, list(keys), "left").join(first, list(keys), "left")
    outcome = (F.when(F.col("_have"), "skipped").when(bad, "failed")
               .when(F.col(position) == F.col("_first"), "created").otherwise("skipped"))
    return marked.withColumn("outcome", outcome).drop("_have", "_first").unionByName(
        source.filter(~keyed).withColumn("outcome", F.lit("failed")))


def approve(staging: DataFrame, results: DataFrame, selected: DataFrame, approved_at: Column,
            approved_by: Column, keys: Sequence[str] = ROW_KEY,
            ) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Move selected staging rows: (results, staging, log).

    If any selected key exists already, nothing moves and the log row says
    `conflict`.  `selected` has one column, `id`.  The decision is a scalar
    subquery, so the whole call stays lazy.  Counts per brand are `brand_counts`
    of the moved rows.
    """
    batch = staging.join(selected.select("id").distinct(), "id", "left_semi")
    clash = batch.join(results.select(*keys).distinct(), list(keys), "left_semi")
    free = clash.agg((F.count(F.lit(1)) == 0).alias("free"))
    moved = batch.withColumns({
        "model_key": F.nullif(keyfn.model_key(F.col("brand_name"), F.col("model")), F.lit("")),
        "date": text.to_iso_date(F.col("date").cast("string"))})
    moved = moved.drop(*rules.STAGING_ONLY).filter(free.scalar())
    new_results = results.unionByName(moved, allowMissingColumns=True)
    gone = selected.select("id").distinct().filter(free.scalar())
    new_staging = staging.join(gone, "id", "left_anti")
    # One pass over both tables: rows of the batch and of the results per key, then their sums.
    rows = batch.select(*keys, F.lit(1).alias("b"), F.lit(0).alias("r")).unionAll(
        results.select(*keys, F.lit(0).alias("b"), F.lit(1).alias("r")))
    per_key = rows.groupBy(*keys).agg(F.sum("b").alias("b"), F.sum("r").alias("r"))
    whole = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    taken = F.coalesce(F.bool_or(whole & (F.col("b") > 0) & (F.col("r") > 0)), F.lit(False))
    sums = per_key.agg(F.coalesce(F.sum("b"), F.lit(0)).alias("b"), F.coalesce(F.sum("r"), F.lit(0)).alias("r"),
                       taken.alias("clash"))
    approved = F.when(F.col("clash"), 0).otherwise(F.col("b"))
    log = sums.select(
        approved_at.alias("approved_at"), approved_by.alias("approved_by"),
        approved.alias("total_approved"), (F.col("r") + approved).alias("total_in_results"),
        F.when(F.col("clash"), "conflict").otherwise("moved").alias("status"))
    return new_results, new_staging, log


def brand_counts(df: DataFrame) -> DataFrame:
    """brand_name, n: one row per brand."""
    return df.filter("brand_name is not null").groupBy("brand_name").agg(F.count(F.lit(1)).alias("n"))


def patch(df: DataFrame, patches: DataFrame, key: str, allowed: Sequence[str],
          edited_flag: str | None = None) -> DataFrame:
    """Change allow-listed columns by id; patches carry `fields`, the names they set."""
    p = patches.select(key, F.col("fields").alias("_f"),
                       *[F.col(c).alias(f"_p_{c}") for c in allowed if c in patches.columns])
    j = df.join(p, key, "left")
    out = []
    for c in df.columns:
        if c in allowed and c in patches.columns:
            out.append(F.when(F.array_contains("_f", c), F.col(f"_p_{c}"))
                       .otherwise(F.col(c)).alias(c))
        elif c == edited_flag:
            out.append((F.col(c) | F.col("_f").isNotNull()).alias(c))
        else:
            out.append(F.col(c))
    return j.select(*out)


def delete_ids(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return df.join(ids.select(key).distinct(), key, "left_anti")


def clear(df: DataFrame) -> DataFrame:
    """The empty next version of a table."""
    return df.limit(0)


def rename_backfill(df: DataFrame, old: str, new: str) -> DataFrame:
    """Fold an old column into its successor and drop it."""
    if new not in df.columns:
        return df.withColumnRenamed(old, new)
    return df.withColumn(new, F.coalesce(F.col(new), F.col(old))).drop(old)


# --- joins ------------------------------------------------------------------------

def known_ids(*tables: DataFrame, key: str) -> DataFrame:
    """Distinct union of ids."""
    out = tables[0].select(key)
    for t in tables[1:]:
        out = out.union(t.select(key))
    return out.distinct()


def new_rows(df: DataFrame, known: DataFrame, key: str) -> DataFrame:
    return df.join(known.select(key).distinct(), key, "left_anti")


def blocked_by(df: DataFrame, key: str, **tables: DataFrame) -> DataFrame:
    """One boolean per named table: does it already hold the id?"""
    for name, t in tables.items():
        flag = t.select(key).distinct().withColumn(f"in_{name}", F.lit(True))
        df = df.join(flag, key, "left").withColumn(
            f"in_{name}", F.coalesce(F.col(f"in_{name}"), F.lit(False)))
    return df


def matching_rows(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """One row `n`: the size of the inner join, from counts per key."""
    a = left.groupBy(key).agg(F.count(F.lit(1)).alias("_a"))
    b = right.groupBy(key).agg(F.count(F.lit(1)).alias("_b"))
    return a.join(b, key).agg(F.coalesce(F.sum(F.col("_a") * F.col("_b")), F.lit(0)).alias("n"))


def unmatched_rows(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """One row `n`: left rows with an id that the right side lacks."""
    a = left.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_a"))
    lone = a.join(right.select(key).distinct(), key, "left_anti")
    return lone.agg(F.coalesce(F.sum("_a"), F.lit(0)).alias("n"))


HYBRID_FIELDS = ("cushioning_type", "foot_width", "waterproof")


def hybrid_merge(left: DataFrame, right: DataFrame, doc: str, position: str,
                 scenario: str) -> DataFrame:
    """Fill cushioning, width and waterproof from the other extraction.

    Only in documents about one product with such a gap; numbers stay, the
    right side's first match per name counts.
    """
    lk = {"_b": F.lower("brand_name"), "_m": F.lower("model")}
    gap = (F.col("cushioning_type").isNull() | F.col("foot_width").isNull()
           | F.col("waterproof").isNull())
    wanted = left.filter((F.col(scenario) == "specific") & gap).select(doc).distinct()
    r = right.join(wanted, doc, "left_semi").withColumns(lk)
    r = first_per_key(r, [F.col(doc), F.col("_b"), F.col("_m")], [F.col(position)])
    r = r.select(doc, "_b", "_m", *[F.col(c).alias(f"_r_{c}") for c in HYBRID_FIELDS])
    j = left.withColumns(lk).join(r, [doc, "_b", "_m"], "left")
    return j.withColumns({c: F.coalesce(F.col(c), F.col(f"_r_{c}")) for c in HYBRID_FIELDS}
                         ).drop("_b", "_m", *[f"_r_{c}" for c in HYBRID_FIELDS])


def choose_method(docs: DataFrame, text_rows: DataFrame, response_rows: DataFrame, doc: str,
                  scenario: str, enabled: bool = True) -> DataFrame:
    """Rows of the text path, or of the response path where text gave too few.

    Too few is none, or under three for a brand or general article.  Response
    rows replace the text rows and are not scope-filtered.
    """
    counts = text_rows.groupBy(doc).agg(F.count(F.lit(1)).alias("_n"))
    n = F.coalesce(F.col("_n"), F.lit(0))
    few = (n == 0) | (F.col(scenario).isin("brand-only", "general") & (n < 3))
    pick = docs.select(doc, scenario).join(counts, doc, "left").select(
        doc, (few & F.lit(enabled)).alias("_use_response"))
    keep = text_rows.join(pick.filter("not _use_response").select(doc), doc, "left_semi")
    swap = response_rows.join(pick.filter("_use_response").select(doc), doc, "left_semi")
    return (keep.withColumn("method", F.lit("text"))
            .unionByName(swap.withColumn("method", F.lit("response")), allowMissingColumns=True))


# The same steps on the arrays of one document's row: `items` are structs of names and
# values, `given` structs of a number and such a struct, in order.

def numbered_items(items: Column) -> Column:
    return F.transform(items, lambda m, i: F.struct((i + 1).cast("bigint").alias("no"), m.alias("m")))


def filled_items(items: Column, given: Column, scenario: Column, fields: Sequence[str] = HYBRID_FIELDS) -> Column:
    """Items of a document about one product, their gaps filled from the first given one of the same name."""
    def same(a, b):
        return (F.lower(a["brand_name"]) == F.lower(b["brand_name"])) & (F.lower(a["model"]) == F.lower(b["model"]))

    def filled(m):
        match = F.get(F.filter(given, lambda g: F.coalesce(same(g["m"], m), F.lit(False))), F.lit(0))
        return text.let(match, lambda g: reduce(
            lambda out, f: out.withField(f, F.coalesce(m[f], g["m"][f])), fields, m))
    return F.when(scenario == "specific", F.transform(items, filled)).otherwise(items)


def chosen_items(items: Column, given: Column, scenario: Column) -> Column:
    """Numbered items, or what was given where there are too few of them (see `choose_method`)."""
    few = (F.size(items) == 0) | (scenario.isin("brand-only", "general") & (F.size(items) < 3))
    return F.when(few, given).otherwise(numbered_items(items))


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """UNION ALL of row counts per table."""
    out = None
    for name, t in tables.items():
        one = t.agg(F.count(F.lit(1)).alias("row_count")).select(
            F.lit(name).alias("table_name"), "row_count")
        out = one if out is None else out.unionAll(one)
    return out
