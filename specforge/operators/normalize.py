"""Normalization with an audit trail, response items, row building (N*)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from specforge import rules
from specforge.functions import keys, text, units
from specforge.functions import regex as rx

_CHANGE = "struct<field:string,before:string,after:string,reason:string>"


def _change(when: Column, field: str, before: Column, after: Column, reason) -> Column:
    reason = reason if isinstance(reason, Column) else F.lit(reason)
    return F.when(when, F.struct(
        F.lit(field).alias("field"), before.cast("string").alias("before"),
        after.cast("string").alias("after"), reason.alias("reason")))


def _present(items, dtype) -> Column:
    return F.filter(F.array(*items), lambda x: x.isNotNull()).cast(f"array<{dtype}>")


def normalize_specs(df: DataFrame, currency: str | None = None,
                    bounds: dict = rules.BOUNDS) -> DataFrame:
    """Replace the spec columns by their normal form; add `changes`, `warnings`.

    A value out of range becomes null with a warning.  A weight under 20 is read
    as ounces, a missing drop comes from the heights.
    """
    c = {f: F.col(f) for f in ["brand_name", "model", *rules.SPEC_FIELDS]}
    code = units.currency_code(F.col(currency)) if currency else F.lit(None).cast("string")
    grams = F.when(c["weight"] < 20, units.oz_to_grams(c["weight"])).otherwise(c["weight"])
    foreign = code.isNotNull() & (code != "USD")
    usd = F.when(foreign, F.coalesce(units.to_usd(c["price"], code), c["price"])
                 ).otherwise(c["price"])
    brand = F.when(c["brand_name"] != "", units.brand_alias(c["brand_name"]))
    model = F.when(~text.is_blank(c["model"]), keys.strip_model_noise(c["model"]))
    df = df.withColumns({
        "_brand": brand, "_model": model, "_grams": grams, "_usd": usd,
        "_heel": text.round2(units.keep_in_bounds(c["heel_height"], "height", bounds)),
        "_fore": text.round2(units.keep_in_bounds(c["forefoot_height"], "height", bounds))})
    heel, fore, g, u = (F.col(x) for x in ("_heel", "_fore", "_grams", "_usd"))
    out = {
        "brand_name": F.col("_brand"), "model": F.col("_model"),
        "heel_height": heel, "forefoot_height": fore,
        "drop": F.when(c["drop"].isNotNull(), text.round2(
            units.keep_in_bounds(c["drop"], "drop", bounds))
        ).otherwise(text.round2(heel - fore)),
        "weight": text.round2(units.keep_in_bounds(g, "weight", bounds)),
        "price": text.round2(units.keep_in_bounds(u, "price", bounds)),
    }
    out |= {f: text.enum(c[f], allowed) for f, allowed in rules.ENUMS.items()}
    df = df.withColumns({f"_o_{k}": v for k, v in out.items()})
    before = [*rules.SPEC_FIELDS, "brand_name", "model"]
    audit = F.struct(*[F.col(x).alias(x) for x in before],
                     *[F.col(f"_o_{x}").alias(f"_o_{x}") for x in out],
                     g.alias("_g"), u.alias("_u"), code.alias("_code"),
                     units.to_usd(c["price"], code).isNotNull().alias("_rated"))
    # bound once: the trail stays out of the generated row code
    df = df.withColumn("_audit", text.let(audit, lambda r: _audit_trail(r, bounds)))
    return df.withColumns({
        **{k: F.col(f"_o_{k}") for k in out},
        "changes": F.col("_audit.changes"), "warnings": F.col("_audit.warnings"),
    }).drop("_brand", "_model", "_grams", "_usd", "_heel", "_fore", "_audit",
            *[f"_o_{k}" for k in out])


def _audit_trail(r: Column, bounds: dict) -> Column:
    """struct(changes, warnings) of a row's values before and after."""
    new = lambda f: r[f"_o_{f}"]
    g, u, code = r["_g"], r["_u"], r["_code"]
    differs = lambda f: F.coalesce(new(f) != r[f], F.lit(False))

    def outside(value, kind, label, unit):
        low, high = bounds[kind]
        return F.when(~value.between(low, high), F.concat(
            F.lit(f"{label} out of range ({low}-{high}{unit}): "), value.cast("string")))
    simple = [("brand_name", "Applied brand normalization"), ("model", "Removed noise words"),
              ("heel_height", "Rounded to 2 decimals"),
              ("forefoot_height", "Rounded to 2 decimals")]
    changes = [_change(differs(f), f, r[f], new(f), why) for f, why in simple] + [
        _change(r["drop"].isNull() & new("heel_height").isNotNull()
                & new("forefoot_height").isNotNull(), "drop", r["drop"], new("drop"),
                "Calculated from heel - forefoot"),
        _change(r["weight"] < 20, "weight", r["weight"], g, "Converted from oz to grams"),
        _change((code != "USD") & r["_rated"], "price", r["price"], u,
                F.concat(F.lit("Converted from "), code, F.lit(" to USD"))),
    ] + [_change(differs(f), f, r[f], new(f), "Normalized to lowercase") for f in rules.ENUMS]
    warnings = [
        outside(r["heel_height"], "height", "heel_height", "mm"),
        outside(r["forefoot_height"], "height", "forefoot_height", "mm"),
        outside(r["drop"], "drop", "drop", "mm"), outside(g, "weight", "weight", "g"),
        outside(u, "price", "price", " USD"),
    ] + [F.when(r[f].isNotNull() & new(f).isNull(), F.concat(
        F.lit(f"Invalid {f}: "), r[f], F.lit(f" (allowed: {', '.join(a)})")))
        for f, a in rules.ENUMS.items()]
    return F.struct(_present(changes, _CHANGE).alias("changes"),
                    _present(warnings, "string").alias("warnings"))


def post_process(df: DataFrame) -> DataFrame:
    """Derive a missing drop; an unstated trail product is not waterproof."""
    return df.withColumns({
        "drop": F.coalesce(F.col("drop"), text.round2(
            F.col("heel_height") - F.col("forefoot_height"))),
        "waterproof": F.coalesce(F.col("waterproof"), F.when(
            F.col("surface_type") == "trail", F.lit(False)))})


def response_specs(df: DataFrame) -> DataFrame:
    """Numeric sanity of response items (all columns are strings, see S11)."""
    num = lambda f: text.to_num(F.col(f))
    heel = text.js_round(units.keep_in_bounds(num("heel_height"), "height"))
    fore = text.js_round(units.keep_in_bounds(num("forefoot_height"), "height"))
    code = F.coalesce(units.currency_code(F.col("price_currency")),
                      units.detect_currency(F.col("price_text")))
    direct = text.round2(units.keep_in_bounds(num("price_usd"), "price"))
    converted = text.round2(units.keep_in_bounds(units.to_usd(num("price"), code), "price"))
    return df.withColumns({
        "brand_name": units.brand_alias(F.nullif(F.col("brand_name"), F.lit(""))),
        "model": F.nullif(rx.sub(text.trim(F.col("model")), rules.MODEL_NOISE_SUFFIX),
                          F.lit("")),
        "heel_height": heel, "forefoot_height": fore,
        "drop": F.coalesce(text.round2(units.keep_in_bounds(num("drop"), "drop")),
                           text.round2(heel - fore)),
        "weight": units.keep_in_bounds(
            text.to_int(F.col("weight")).cast("double"), "weight"),
        "price": F.coalesce(direct, converted),
        "upper_breathability": text.vocab(F.col("upper_breathability"),
                                          rules.VOCAB["breathability"]),
        "carbon_plate": text.vocab(F.col("carbon_plate"), rules.VOCAB["boolean_text"]),
        "waterproof": text.vocab(F.col("waterproof"), rules.VOCAB["boolean_text"]),
        "primary_use": F.coalesce(text.vocab(F.col("primary_use"), rules.VOCAB["use"]),
                                  F.nullif(F.col("primary_use"), F.lit(""))),
        "cushioning_type": text.vocab(F.col("cushioning_type"), rules.VOCAB["cushioning"]),
        "surface_type": text.vocab(F.col("surface_type"), rules.VOCAB["surface"]),
        "foot_width": text.vocab(F.col("foot_width"), rules.VOCAB["width"]),
        "additional_features": F.nullif(F.col("additional_features"), F.lit("")),
    }).drop("price_usd", "price_currency", "price_text")


def sanitize_response(df: DataFrame) -> DataFrame:
    """Typed coercion without vocabulary: exact enums, loose booleans, clean text."""
    out = {f: text.sanitize(F.col(f)) for f in
           ("brand_name", "model", "primary_use", "additional_features")}
    out |= {f: text.to_num(F.col(f)) for f in
            ("heel_height", "forefoot_height", "drop", "weight")}
    out["price"] = text.to_num(F.coalesce(
        F.nullif(F.col("price_usd"), F.lit("")), F.col("price")))
    out |= {f: text.to_bool(F.col(f)) for f in rules.BOOLEAN_FIELDS}
    out |= {f: text.enum(F.col(f), a) for f, a in rules.ENUMS.items()}
    return df.withColumns(out).drop("price_usd", "price_currency", "price_text")


def build_rows(df: DataFrame, doc_id: str, source_id: str, date: str, link: str) -> DataFrame:
    """Output rows: key, 'Unknown' for a missing name, document metadata, warnings."""
    brand, model = F.col("brand_name"), F.col("model")
    named = lambda c: F.coalesce(F.nullif(c, F.lit("")), F.lit("Unknown"))
    return df.withColumns({
        "build_warnings": _present([
            F.when(text.is_blank(brand), "Missing brand_name"),
            F.when(text.is_blank(model), "Missing model")], "string"),
        "article_id": F.col(doc_id).cast("string"),
        "source_id": F.nullif(F.col(source_id).cast("string"), F.lit("")),
        "model_key": keys.model_key(brand, model),
        "brand_name": named(brand), "model": named(model),
        "date": F.nullif(F.col(date).cast("string"), F.lit("")),
        "source_link": F.nullif(F.col(link), F.lit(""))})


def coerce_rows(df: DataFrame) -> DataFrame:
    """Column types for saving; rows without names, link or document are dropped."""
    blank_null = lambda c: F.when(c.cast("string") != "", c)
    df = df.withColumns({
        **{f: text.trim(F.coalesce(F.col(f).cast("string"), F.lit("")))
           for f in ("brand_name", "model", "source_link", "article_id")},
        **{f: blank_null(F.col(f)).try_cast("double") for f in rules.NUMERIC_FIELDS},
        **{f: blank_null(F.col(f)).try_cast("boolean") for f in rules.BOOLEAN_FIELDS},
        **{f: text.trim(F.col(f)) for f in rules.TEXT_FIELDS},
        "date": F.substring(F.col("date").cast("string"), 1, 10)})
    return df.filter((F.col("brand_name") != "") & (F.col("model") != "")
                     & (F.col("source_link") != "") & (F.col("article_id") != ""))


def tighten(df: DataFrame) -> DataFrame:
    """Strict rows: document, brand, refined model, key and source required.

    The names are bound and the tests run on them inside one generator; a filter
    on the columns would compute them again for each test.
    """
    brand = text.trim(F.coalesce(F.col("brand_name"), F.lit("")))

    def row(b, m):
        return F.struct(b.alias("brand_name"), m.alias("model"),
                        keys.model_key(b, m, "::").alias("model_key"),
                        text.to_num(F.col("article_id")).alias("article_id"),
                        text.norm_str(F.col("source_id")).alias("source_id"))

    def strict(r):
        return ((r["article_id"] != 0) & (r["brand_name"] != "") & (r["model"] != "")
                & (r["model_key"] != "") & r["source_id"].isNotNull())
    rows = F.filter(F.array(text.let(brand, lambda b: text.let(
        keys.refine_model(b, F.col("model")), lambda m: row(b, m)))), strict)
    df = df.select("*", F.explode(rows).alias("_r"))
    fields = ("brand_name", "article_id", "model", "model_key", "source_id")
    return df.withColumns({
        **{f: F.col(f"_r.{f}") for f in fields},
        **{f: text.to_num(F.col(f)) for f in rules.NUMERIC_FIELDS}}).drop("_r")


def rank_candidates(candidates: Column) -> Column:
    """Order a document's candidate array by title score, richness, then origin.

    Items need score, richness and from_title; ties keep their order.  The array
    sits in the document's row, so a document with many candidates is no group.
    """
    keyed = F.transform(candidates, lambda c, i: F.struct(
        (-c["score"]).alias("k1"), (-c["richness"]).alias("k2"),
        c["from_title"].cast("int").alias("k3"), i.alias("k4"), c.alias("c")))
    return F.transform(F.array_sort(keyed), lambda x: x["c"])


def compose_values(df: DataFrame) -> DataFrame:
    """Fill a candidate's gaps from whole-text figures, prices by precedence.

    Own value first; a missing drop from the text, then from the heights; price
    from own USD, own figure, text figure, odd figure, each only if plausible.
    """
    heel = F.coalesce(F.col("heel_height"), F.col("fb_heel"))
    fore = F.coalesce(F.col("forefoot_height"), F.col("fb_forefoot"))
    ok = lambda c: text.round2(units.keep_in_bounds(c, "price"))
    return df.withColumns({
        "drop": F.coalesce(F.col("drop"), F.col("fb_drop"), text.round2(heel - fore)),
        "heel_height": heel, "forefoot_height": fore,
        "weight": F.coalesce(F.col("weight"), F.col("fb_weight")),
        "price": F.coalesce(ok(F.col("price")), ok(F.col("fb_price")),
                            ok(F.col("odd_price")))})
