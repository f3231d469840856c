"""Articles to ranked product candidates: title, blocks and whole-text figures together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from specforge import rules
from specforge.functions import keys, text
from specforge.operators import blocks, fallback, normalize, titles

FALLBACKS = ["fb_heel", "fb_forefoot", "fb_drop", "fb_weight", "fb_price", "odd_price"]
TITLE_CONFIDENCE = 0.8


def article_candidates(articles: DataFrame, doc: str = "doc_id", title: str = "title", content: str = "content",
                       single: Column | None = None) -> DataFrame:
    """doc, rank (from 1), origin, names, model_key, spec fields, score, richness.

    An article's candidates are one array in its row: those of its blocks, in text order
    (`text`), then the title's product if it is known well enough (`title`).  An article
    about one product (`single`; by default its title scenario) gives the richest block of
    that product under the title's names (`title-single`), or the title alone (`title-only`).
    Candidates rank by title score, then richness, then blocks before the title, ties in
    their order; of one key the first stays.  Their gaps are filled from the whole text and
    prices taken in order of precedence.  Texts are not shuffled; a row without id is an
    article like any other, and articles with equal rows count once.
    """
    df = articles.select(doc, F.col(title).alias("_title"), F.col(content).alias("_content"),
                         (titles.analyze_title(F.col(title))["scenario"] == "specific" if single is None else single).alias("_single"))
    df = titles.brand_model_from_title(fallback.with_fallback_heights(df, "_content"), "_title", "_bm")
    price = fallback.fallback_price(F.col("_content"))
    brand = F.nullif(text.trim(F.col("_bm.brand")), F.lit(""))
    df = df.select(doc, "_single", "_content", brand.alias("_tb"),
                   F.nullif(keys.refine_model(brand, F.col("_bm.model")), F.lit("")).alias("_tm"), F.col("_bm.confidence").alias("_tc"),
                   "fb_heel", "fb_forefoot", "fb_drop", fallback.fallback_weight(F.col("_content")).alias("fb_weight"),
                   price["price_usd"].alias("fb_price"), fallback.weird_price(F.col("_content")).alias("odd_price"))
    meta = [doc, "_single", "_tb", "_tm", "_tc", *FALLBACKS]
    specs = blocks.extract_specs(blocks.explode_blocks(df, "_content", meta, outer=True))
    kinds = {f: specs.schema[f].dataType.simpleString() for f in rules.SPEC_FIELDS}
    values = F.struct(*[F.col(f).cast(k).alias(f) for f, k in kinds.items()])
    item = F.struct("block_no", "brand_name", "model", values.alias("v"))
    rows = specs.groupBy(*meta).agg(F.sort_array(F.collect_list(F.when(F.col("block_no").isNotNull(), item))).alias("_found"))

    tb, tm = F.col("_tb"), F.col("_tm")
    nothing = F.struct(*[F.lit(None).cast(k).alias(f) for f, k in kinds.items()])

    def candidate(name: Column, model: Column, v: Column, origin: str) -> Column:
        rich = text.sum_of([F.when(v[f].isNotNull(), 1).otherwise(0) for f in rules.SPEC_FIELDS])
        return F.struct(name.alias("brand_name"), model.alias("model"), keys.model_key(name, model).alias("model_key"), v.alias("v"),
                        F.lit(origin).alias("origin"), titles.score_by_title(name, model, tb, tm).alias("score"), rich.alias("richness"),
                        F.lit(origin == "title").alias("from_title"))

    def of_block(x: Column) -> Column:
        named = F.coalesce(F.nullif(x["brand_name"], F.lit("")), text.lookup(F.lower(x["model"]), rules.MODEL_TO_BRAND), tb)
        refined = F.coalesce(F.nullif(keys.refine_model(named, x["model"]), F.lit("")), x["model"])
        return candidate(named, refined, x["v"], "text")

    def one(found: Column) -> Column:
        same = F.filter(found, lambda c: c["model_key"] == keys.model_key(tb, tm))
        richest = F.array_max(F.transform(same, lambda c, i: F.struct(c["richness"].alias("r"), (-i).alias("i"), c["v"].alias("v"))))
        return F.when(F.size(same) > 0, F.array(candidate(tb, tm, richest["v"], "title-single"))).otherwise(
            F.array(candidate(tb, tm, nothing, "title-only")))

    titled = tb.isNotNull() & tm.isNotNull()
    many = lambda found: F.when(titled & (F.col("_tc") >= TITLE_CONFIDENCE), F.concat(
        found, F.array(candidate(tb, tm, nothing, "title")))).otherwise(found)
    ranked = lambda found: normalize.rank_candidates(F.filter(
        F.when(F.col("_single") & titled, one(found)).otherwise(many(found)),
        lambda c: c["brand_name"].isNotNull() & c["model"].isNotNull() & (c["model_key"] != "")))

    def first_of_key(found: Column) -> Column:
        return text.let(F.transform(found, lambda c: c["model_key"]), lambda ks: F.filter(
            found, lambda c, i: F.array_position(ks, c["model_key"]) == i + 1))

    best = text.let(F.transform("_found", of_block), lambda found: text.let(ranked(found), first_of_key))
    out = rows.select(doc, *FALLBACKS, F.posexplode(best).alias("_i", "_c"))
    out = out.select(doc, *FALLBACKS, (F.col("_i") + 1).alias("rank"), *[F.col(f"_c.{c}") for c in (
        "origin", "brand_name", "model", "model_key", "score", "richness")], *[F.col(f"_c.v.{f}") for f in rules.SPEC_FIELDS])
    return normalize.compose_values(out).drop(*FALLBACKS)
