"""Profiles, diagnostics, accuracy and run reports (A*, W2, W4, J7)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from specforge import rules
from specforge.functions import text
from specforge.operators.dedup import all_true, first_per_key


def brand_facets(df: DataFrame, brand: str, order: str) -> DataFrame:
    """(name, count) ignoring case; the first spelling is the label."""
    return (df.filter(F.col(brand).isNotNull() & (F.col(brand) != ""))
            .groupBy(F.lower(brand).alias("_k"))
            .agg(F.min_by(brand, order).alias("name"), F.count(F.lit(1)).alias("count"))
            .orderBy(F.lower("name")).select("name", "count"))


def canonical_brands(df: DataFrame, brand: str, order: str,
                     mapping: dict = rules.BRAND_CANON) -> DataFrame:
    """Rewrite spelling variants: mapped form, else the first one seen."""
    k = F.lower(text.trim(F.col(brand)))
    usable = F.col(brand).isNotNull() & (F.col(brand) != "")
    canon = (df.filter(usable).groupBy(k.alias("_k"))
             .agg(F.min_by(brand, order).alias("_first"))
             .select("_k", text.lookup(F.col("_k"), mapping, F.col("_first")).alias("_canon")))
    return (df.withColumn("_k", k).join(canon, "_k", "left")
            .withColumn(brand, F.coalesce("_canon", brand)).drop("_k", "_canon"))


def table_stats(df: DataFrame, brand: str, model: str, key: str) -> DataFrame:
    """One row: total, distinct brands, models and keys."""
    return df.agg(F.count(F.lit(1)).alias("total_records"),
                  F.count_distinct(brand).alias("unique_brands"),
                  F.count_distinct(model).alias("unique_models"),
                  F.count_distinct(key).alias("unique_keys"))


def table_stats_approx(df: DataFrame, brand: str, model: str, key: str,
                       rsd: float = 0.02) -> DataFrame:
    """The same with sketches: one pass, no shuffle of values."""
    return df.agg(F.count(F.lit(1)).alias("total_records"),
                  *[F.approx_count_distinct(c, rsd).alias(n) for c, n in
                    ((brand, "unique_brands"), (model, "unique_models"),
                     (key, "unique_keys"))])


def breakdown(df: DataFrame, column: str, default: str | None = None) -> DataFrame:
    """(value, n), most frequent first."""
    c = F.col(column) if default is None else F.coalesce(
        F.nullif(F.col(column), F.lit("")), F.lit(default))
    return (df.groupBy(c.alias("value")).agg(F.count(F.lit(1)).alias("n"))
            .orderBy(F.col("n").desc(), "value"))


def stack_counts(df: DataFrame) -> DataFrame:
    heel, drop = F.col("heel_height"), F.col("drop")
    return df.agg(F.count_if(heel.isNotNull() | drop.isNotNull()).alias("with_stack"),
                  F.count_if(heel.isNull() & drop.isNull()).alias("without_stack"))


def column_profile(df: DataFrame, table: str, numeric: Sequence[str] = (),
                   flags: Sequence[str] = (), others: Sequence[str] = ()) -> DataFrame:
    """One row per column: fill rate, numeric range, flag counts.

    All figures come from one aggregate pass; the wide row is then unpivoted.
    """
    cols = [*numeric, *flags, *others]
    aggs = [F.count(F.lit(1)).alias("_n")]
    for c in cols:
        aggs.append(F.count(c).alias(f"{c}__nn"))
    for c in numeric:
        x = F.col(c).cast("double")
        aggs += [F.sum(x).alias(f"{c}__sum"), F.min(x).alias(f"{c}__min"),
                 F.max(x).alias(f"{c}__max")]
    for c in flags:
        aggs += [F.count_if(F.col(c)).alias(f"{c}__t"), F.count_if(~F.col(c)).alias(f"{c}__f")]
    none_d, none_l = F.lit(None).cast("double"), F.lit(None).cast("bigint")

    def row(c):
        nn = F.col(f"{c}__nn")
        num, flag = c in numeric, c in flags
        return F.struct(
            F.lit(table).alias("table_name"), F.lit(c).alias("column_name"),
            F.col("_n").alias("total_rows"), nn.alias("non_null_count"),
            (F.col("_n") - nn).alias("null_count"),
            F.when(F.col("_n") > 0, F.round(100.0 * nn / F.col("_n"), 2)).alias("fill_pct"),
            (F.round(F.col(f"{c}__sum") / nn, 2) if num else none_d).alias("avg_value"),
            (F.col(f"{c}__min") if num else none_d).alias("min_value"),
            (F.col(f"{c}__max") if num else none_d).alias("max_value"),
            (F.col(f"{c}__t") if flag else none_l).alias("true_count"),
            (F.col(f"{c}__f") if flag else none_l).alias("false_count"))
    return df.agg(*aggs).select(F.inline(F.array(*[row(c) for c in cols])))


def duplicate_keys(df: DataFrame, keys: Sequence[str], created: str,
                   top: int | None = None) -> DataFrame:
    """The keys held by more than one row, with count and time span; the `top` largest if given."""
    groups = (df.groupBy(*keys).agg(F.count(F.lit(1)).alias("cnt"),
                                    F.min(created).alias("first_created"),
                                    F.max(created).alias("last_created")).filter("cnt > 1"))
    return groups if top is None else groups.orderBy(F.col("cnt").desc(), *keys).limit(top)


def duplicate_long(df: DataFrame, value: str, row_id: str) -> DataFrame:
    """Long values held by more than one row: digest, count, first and last id.

    Values are grouped by SHA-256 and length, so no shuffle carries them.
    """
    digest = F.sha2(value, 256)
    return (df.select(digest.alias("digest"), F.length(value).alias("chars"), row_id)
            .groupBy("digest", "chars").agg(F.count(F.lit(1)).alias("cnt"), F.min(row_id).alias("first_id"),
                                            F.max(row_id).alias("last_id")).filter("cnt > 1"))


def duplicate_ids(df: DataFrame, keys: Sequence[str], row_id: str, created: str,
                  top: int | None = None) -> DataFrame:
    """The row ids behind `duplicate_keys`, one per row: a key may hold very many."""
    groups = duplicate_keys(df, keys, created, top).select(*keys, "cnt").alias("g")
    same = all_true([F.col(f"g.{k}").eqNullSafe(F.col(f"d.{k}")) for k in keys])
    return (df.select(*keys, row_id).alias("d").join(groups, same)
            .select(*[F.col(f"d.{k}").alias(k) for k in keys], "cnt", F.col(f"d.{row_id}")))


REPORT_FIELDS = ["weight", "drop", "price", "heel_height", "forefoot_height", "primary_use",
                 "surface_type", "cushioning_type"]


def run_report(df: DataFrame, doc: str, created: str, row_id: str,
               newest: int | None = None) -> DataFrame:
    """Per document: products, brands, coverage, issues; of the newest rows only if asked to."""
    top = df if newest is None else df.orderBy(F.col(created).desc(), F.col(row_id).desc()).limit(newest)
    g = top.groupBy(doc).agg(
        F.count(F.lit(1)).alias("products"),
        F.array_sort(F.collect_set("brand_name")).alias("brands"),
        F.count_distinct("model_key").alias("_keys"),
        *[F.count(c).alias(f"with_{c}") for c in REPORT_FIELDS])
    issues = F.filter(F.array(
        F.when(F.size("brands") > 2, F.concat(F.lit("Multiple brands ("), F.size("brands"), F.lit(")"))),
        F.when((F.col("with_weight") == 0) & (F.col("with_drop") == 0) & (F.col("with_price") == 0),
               F.lit("No physical specs")),
        F.when(F.col("_keys") < F.col("products"), F.lit("Duplicate keys"))),
        lambda x: x.isNotNull())
    return g.withColumn("issues", issues).drop("_keys")


def run_totals(report: DataFrame) -> DataFrame:
    return report.agg(
        F.count(F.lit(1)).alias("total_articles"), F.sum("products").alias("total_products"),
        F.round(F.sum("products") / F.count(F.lit(1)), 1).alias("avg_products"),
        *[F.sum(f"with_{c}").alias(f"with_{c}") for c in REPORT_FIELDS],
        F.sum(F.size("issues")).alias("issue_count"))


def coverage(df: DataFrame, fields: Sequence[str] = tuple(rules.SPEC_FIELDS)) -> DataFrame:
    """One row: products, average coverage (names count as two), filled per field."""
    filled = text.sum_of([F.col(c).isNotNull().cast("int") for c in fields])
    return df.agg(
        F.count(F.lit(1)).alias("total_products"),
        F.coalesce(text.round2(F.sum(filled + 2) * 100.0 / (
            F.count(F.lit(1)) * F.lit(float(len(fields) + 2)))), F.lit(0.0)).alias("average_coverage"),
        *[F.count(c).alias(c) for c in fields])


# --- accuracy ---------------------------------------------------------------------

def _plain(c: Column) -> Column:
    """Empty, 'null', 'undefined' and an upper-case FALSE mean: not stated."""
    s = F.coalesce(c, F.lit(""))
    return F.when(s.isin("", "null", "undefined", "FALSE"), "").otherwise(F.lower(text.trim(s)))


def compare_values(extracted: Column, expected: Column, tolerance: float = 0.5) -> Column:
    """correct / incorrect / missing_extracted / missing_gt."""
    a, b = _plain(extracted), _plain(expected)
    num = lambda s: F.nullif(F.regexp_extract(
        s, r"^([-+]?(?:\d+\.?\d*|\.\d+))", 1), F.lit("")).try_cast("double")
    na, nb = num(a), num(b)
    flag = lambda s: s.isin("true", "false")
    say = lambda cond: F.when(cond, "correct").otherwise("incorrect")
    return (F.when((a == "") & (b == ""), "correct").when(b == "", "missing_gt")
            .when(a == "", "missing_extracted")
            .when(na.isNotNull() & nb.isNotNull(), say(F.abs(na - nb) <= tolerance))
            .when(flag(a) & flag(b), say(a == b))
            .otherwise(say(F.contains(a, b) | F.contains(b, a))))


def match_truth(extracted: DataFrame, truth: DataFrame, keys: Sequence[str], line: str,
                fields: Sequence[str], suffix: str = "_correct") -> tuple[DataFrame, DataFrame]:
    """(matched rows, rows without truth); the last duplicate truth line wins."""
    t = first_per_key(truth, [F.col(k) for k in keys], [F.col(line).desc()])
    t = t.select(*keys, *[f"{f}{suffix}" for f in fields], F.lit(True).alias("_t"))
    j = extracted.join(t, list(keys), "left")
    return j.filter("_t").drop("_t"), j.filter("_t is null").select(*extracted.columns)


def field_status(matched: DataFrame, keep: Sequence[str], fields: Sequence[str],
                 suffix: str = "_correct") -> DataFrame:
    """Long form: keep columns, field, extracted, expected, status."""
    items = F.array(*[F.struct(F.lit(f).alias("field"),
                               F.col(f).cast("string").alias("extracted"),
                               F.col(f"{f}{suffix}").cast("string").alias("expected"))
                      for f in fields])
    return matched.select(*keep, F.inline(items)).withColumn(
        "status", compare_values(F.col("extracted"), F.col("expected")))


def accuracy(status: DataFrame) -> DataFrame:
    """Per field: counts and accuracy, recall, precision in percent."""
    n = lambda s: F.count_if(F.col("status") == s)
    g = status.groupBy("field").agg(
        F.count(F.lit(1)).alias("total"), n("correct").alias("correct"),
        n("incorrect").alias("incorrect"), n("missing_extracted").alias("missing_extracted"),
        n("missing_gt").alias("missing_gt"))
    pct = lambda a, b: F.round(F.coalesce(F.try_divide(100.0 * a, b), F.lit(0.0)), 4)
    c = F.col
    return g.withColumns({
        "accuracy": pct(c("correct"), c("total")),
        "recall": pct(c("correct"), c("correct") + c("missing_extracted")),
        "precision": pct(c("correct"), c("correct") + c("incorrect"))})


def overall_accuracy(by_field: DataFrame) -> DataFrame:
    return by_field.agg(F.sum("total").alias("total"), F.sum("correct").alias("correct"),
                        F.round(100.0 * F.sum("correct") / F.sum("total"), 4).alias("accuracy"))


def errors_by_field(status: DataFrame) -> DataFrame:
    return (status.filter(F.col("status").isin("incorrect", "missing_extracted"))
            .groupBy("field").agg(F.count(F.lit(1)).alias("errors"))
            .orderBy(F.col("errors").desc(), "field"))


def top_errors(status: DataFrame, order: Sequence[str], n: int | None = None) -> DataFrame:
    """Wrong fields; the first n of the given order if asked to."""
    wrong = status.filter(F.col("status").isin("incorrect", "missing_extracted"))
    return wrong if n is None else wrong.orderBy(*order, "field").limit(n)


# --- linkage, outcomes, quality ----------------------------------------------------

def linkage_report(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """One row: totals, linked and unlinked rows, percentage and verdict."""
    per_id = left.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    have = right.select(key).distinct().withColumn("_have", F.lit(True))
    j = per_id.join(have, key, "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    out = j.agg(zero(F.sum("_n")).alias("total_rows"),
                zero(F.sum(F.when(F.col(key).isNotNull(), F.col("_n")))).alias("rows_with_id"),
                zero(F.sum(F.when(F.col("_have"), F.col("_n")))).alias("matching_rows"),
                zero(F.sum(F.when(F.col("_have").isNull() & F.col(key).isNotNull(),
                                  F.col("_n")))).alias("unmatched_rows"))
    pct = F.coalesce(F.try_divide(100.0 * F.col("matching_rows"), F.col("total_rows")), F.lit(0.0))
    return out.withColumn("match_pct", F.round(pct, 2)).withColumn(
        "verdict", F.when(pct < 50, "WARNING").when(pct < 80, "CAUTION").otherwise("SUCCESS"))


def outcome_counts(df: DataFrame, outcome: str) -> DataFrame:
    return df.groupBy(F.col(outcome).alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


def token_cost(df: DataFrame, tokens_in: str, tokens_out: str,
               price_in: float = rules.TOKEN_PRICE_IN,
               price_out: float = rules.TOKEN_PRICE_OUT) -> DataFrame:
    """One row: token sums and their price (prices are per thousand)."""
    a, b = F.sum(tokens_in), F.sum(tokens_out)
    return df.agg(a.alias("input_tokens"), b.alias("output_tokens"),
                  F.round(a * F.lit(price_in) / 1000 + b * F.lit(price_out) / 1000, 6).alias("cost"))


def change_counts(normalized: DataFrame) -> DataFrame:
    """(field, reason, n) over the audit trail."""
    return (normalized.select(F.explode("changes").alias("c"))
            .groupBy("c.field", "c.reason").agg(F.count(F.lit(1)).alias("n")))


def warning_counts(normalized: DataFrame) -> DataFrame:
    """(kind, n): warnings by their text before the value."""
    return (normalized.select(F.explode("warnings").alias("w"))
            .groupBy(F.substring_index("w", ":", 1).alias("kind"))
            .agg(F.count(F.lit(1)).alias("n")))


QUALITY_RULES = [("brand_name", "blank", "Missing brand"), ("model", "blank", "Missing model"),
                 ("price", "null", "Missing price"), ("weight", "null", "Missing weight")]


def quality_status(table=tuple(QUALITY_RULES)) -> Column:
    """Label of the first failing check, else OK."""
    out = None
    for column, kind, label in table:
        bad = F.col(column).isNull()
        if kind == "blank":
            bad = bad | (F.col(column) == "")
        out = (F if out is None else out).when(bad, label)
    return out.otherwise("OK")


def recent(df: DataFrame, created: str, asof: Column, minutes: int) -> DataFrame:
    """Rows of the last minutes before `asof` (always given, never the clock)."""
    return df.filter(F.col(created) > asof - F.make_dt_interval(mins=F.lit(minutes)))


def new_or_updated(created: Column, updated: Column) -> Column:
    return F.when(created == updated, "new").otherwise("updated")
