"""Comparison tables to product models."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from specforge import rules
from specforge.functions import regex as rx
from specforge.functions import text, units


def spec_key(cell: Column) -> Column:
    """The value a table row states, by its first cell; a bare stack is the heel."""
    def key(low):
        has = lambda w: F.contains(low, F.lit(w))
        return (F.when(has("weight"), "weight").when(has("drop"), "drop_mm")
                .when(has("heel"), "heel_mm").when(has("forefoot"), "forefoot_mm")
                .when(has("stack"), "stack").when(has("price"), "price_usd"))
    return text.let(F.lower(text.trim(cell)), key)


def cell_weight(cell: Column) -> Column:
    """struct(weight_g, weight_oz)."""
    def weight(grams, oz):
        return F.struct(F.coalesce(grams, units.oz_to_grams(oz, rules.OZ_TO_GRAMS_TEXT)
                                   ).alias("weight_g"), oz.alias("weight_oz"))
    return text.let(rx.pick_num(cell, r"(\d{2,4})\s*(?:g|grams)\b"), lambda grams: text.let(
        F.when(grams.isNull(), rx.pick_num(cell, r"(\d{1,2}(?:\.\d)?)\s*(?:oz|ounces)\b")),
        lambda oz: weight(grams, oz)))


def cell_height(cell: Column) -> Column:
    return rx.pick_num(cell, r"(\d{2})\s*mm")


def cell_drop(cell: Column) -> Column:
    return rx.pick_num(cell, r"(\d{1,2})\s*mm")


def cell_price(cell: Column) -> Column:
    out = None
    for pattern, code in ((r"\$(\d{2,4})", "USD"), (r"€\s?(\d{2,4})", "EUR"),
                          (r"£\s?(\d{2,4})", "GBP")):
        value = rx.pick_num(cell, pattern)
        usd = value if code == "USD" else text.js_round(
            value * F.lit(rules.TABLE_USD_RATES[code]))
        out = usd if out is None else F.coalesce(out, usd)
    return out


def table_score(table: Column) -> Column:
    """Spec rows times header cells; zero for a table that is no candidate."""
    header = F.size(F.get(table, F.lit(0)))
    spec_rows = F.size(F.filter(
        text.tail(table), lambda r: text.contains_any(F.lower(F.get(r, F.lit(0))), rules.TABLE_KEYWORDS)))
    return F.when((F.size(table) >= 2) & (header >= 3), text.let(
        spec_rows, lambda n: F.when(n >= 2, n * header).otherwise(0))).otherwise(0)


def best_table(tables: Column) -> Column:
    """struct(score, table): highest score, first on ties; null without a candidate."""
    scored = F.transform(tables, lambda t, i: F.struct(
        table_score(t).alias("score"), (-i).alias("order"), t.alias("table")))
    return F.aggregate(
        scored, F.lit(None).cast("struct<score:int,order:int,table:array<array<string>>>"),
        lambda acc, x: F.when(acc.isNull() | (x["score"] > acc["score"]), x).otherwise(acc),
        lambda acc: F.when(acc["score"] > 0, acc))


def table_models(table: Column) -> Column:
    """array<struct(model_name, weight_g, weight_oz, heel_mm, forefoot_mm, drop_mm, price_usd)>.

    Columns become models.  Rows with another cell count are skipped, the row
    key decides how a cell is read, the last row of a key wins, a missing drop
    is derived from the heights.
    """
    return text.let(table, _models)


def _models(table: Column) -> Column:
    header = F.get(table, F.lit(0))
    body = F.filter(text.tail(table), lambda r: F.size(r) == F.size(header))
    rows = F.transform(body, lambda r: F.struct(spec_key(F.get(r, F.lit(0))).alias("k"),
                                                r.alias("r")))

    def model(keyed, name, i):
        def cells(keys, parse):
            return F.transform(F.filter(keyed, lambda x: x["k"].isin(keys)),
                               lambda x: parse(text.trim(F.get(x["r"], i + 1))))

        def last(values):
            return F.try_element_at(F.filter(values, lambda v: v.isNotNull()), F.lit(-1))

        def described(v):
            return F.struct(
                text.squeeze(name).alias("model_name"),
                last(v["weights"]["weight_g"]).alias("weight_g"),
                last(v["weights"]["weight_oz"]).alias("weight_oz"),
                v["heel"].alias("heel_mm"), v["fore"].alias("forefoot_mm"),
                F.coalesce(v["drop"], v["heel"] - v["fore"]).alias("drop_mm"),
                v["price"].alias("price_usd"))
        return text.let(F.struct(
            cells(["weight"], cell_weight).alias("weights"),
            last(cells(["heel_mm", "stack"], cell_height)).alias("heel"),
            last(cells(["forefoot_mm"], cell_height)).alias("fore"),
            last(cells(["drop_mm"], cell_drop)).alias("drop"),
            last(cells(["price_usd"], cell_price)).alias("price")), described)
    return text.let(rows, lambda keyed: F.transform(
        text.tail(header), lambda name, i: model(keyed, name, i)))


def comparison(tables: Column) -> Column:
    """struct(confidence, models, labels) of the best table; null without one."""
    return text.let(best_table(tables), lambda best: F.when(best.isNotNull(), text.let(
        table_models(best["table"]), lambda models: _described(best["score"], models))))


def _described(score: Column, models: Column) -> Column:
    given = lambda *fs: F.exists(models, lambda m: F.coalesce(
        *[m[f] for f in fs]).isNotNull())
    labels = F.filter(F.flatten(F.array(
        F.when(given("weight_g"), F.array(F.lit("WEIGHT"))).otherwise(F.array(F.lit(""))),
        F.when(given("heel_mm", "forefoot_mm", "drop_mm"),
               F.array(F.lit("STACK"), F.lit("DROP"))).otherwise(F.array(F.lit(""))),
        F.when(given("price_usd"), F.array(F.lit("PRICE"))).otherwise(F.array(F.lit(""))),
        F.array(F.lit("MULTI_TABLE")))), lambda x: x != "")
    return F.struct(F.least(F.lit(1.0), score / F.lit(20.0)).alias("confidence"),
                    models.alias("models"), labels.alias("labels"))
