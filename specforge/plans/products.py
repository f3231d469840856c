"""Articles to product rows: the main flow, one lazy plan per table write."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from specforge import rules
from specforge.functions import text
from specforge.operators import blocks, classify, dedup, merge, normalize, titles


NAMES = ["brand_name", "model", *rules.SPEC_FIELDS]


def article_products(articles: DataFrame, doc: str = "doc_id", unheaded: bool = True, fold: bool = True,
                     responses: DataFrame | None = None) -> DataFrame:
    """Relevant articles -> blocks -> specs -> scope -> normal form -> output rows.

    Articles without headings are read by their mentions (`unheaded`), and rows of
    one article whose names extend each other become one (`fold`).  `responses`
    (document, position, names and spec fields; one answer per article) complete text
    rows and replace those of articles that gave too few.

    The articles are read once and no shuffle carries a text: up to the specs all is
    row-local, then a document is one row with the array of its specs, in which fold,
    scope, completion and choice are expressions.  Normalization comes before the
    deduplication.
    """
    df = articles.withColumn("_rel", classify.relevance(F.col("title"), F.col("content")))
    df = df.filter(F.col("_rel.keep")).withColumn(
        "_an", titles.analyze_title(F.col("title")))
    meta = [doc, "source_id", "date", "link", "scenario", "t_brand", "t_model"]
    df = df.select(doc, "source_id", "date", "link", "content",
                   F.col("_an.scenario").alias("scenario"), F.col("_an.brand").alias("t_brand"),
                   F.col("_an.model").alias("t_model"))
    cut = blocks.blocks_or_mentions if unheaded else blocks.explode_blocks
    whole = fold or responses is not None
    found = blocks.extract_specs(cut(df, "content", meta, outer=whole))
    found = found.select(*meta, "block_no", *NAMES)
    usable = (F.col("brand_name").isNotNull() & F.col("model").isNotNull() & classify.complete_spec()
              & blocks.quality_name(F.col("brand_name"), F.col("model")))
    if whole:
        found = _from_documents(found, usable, meta, doc, fold, responses)
    else:
        found = found.filter(usable).filter(titles.in_scope(
            F.col("brand_name"), F.col("model"), F.col("scenario"), F.col("t_brand"), F.col("t_model")))
    found = normalize.normalize_specs(normalize.post_process(found))
    rows = normalize.build_rows(found, doc, "source_id", "date", "link")
    return dedup.keep_first(rows, doc, "block_no")


def _from_documents(found: DataFrame, usable: Column, meta: list[str], doc: str, fold: bool,
                    responses: DataFrame | None) -> DataFrame:
    """Spec rows again, after the steps that look at all rows of an article.

    A relevant article without usable rows stays as a row with an empty array, since
    its response may replace them.
    """
    kinds = {f: found.schema[f].dataType.simpleString() for f in NAMES}
    texts = [f for f in rules.SPEC_FIELDS if kinds[f] == "string"]
    flags = [f for f in rules.SPEC_FIELDS if kinds[f] == "boolean"]
    numbers = [f for f in rules.SPEC_FIELDS if f not in texts + flags]
    values = F.struct(*[F.col(f).cast(kinds[f]).alias(f) for f in NAMES]).alias("m")
    ordered = lambda no, when: F.transform(
        F.sort_array(F.collect_list(F.when(when, F.struct(no, values)))), lambda x: x["m"])
    docs = found.groupBy(*meta).agg(ordered(F.col("block_no"), usable).alias("_items"))
    items = F.col("_items")
    if fold:
        # One struct type throughout, as the fold orders the fields by their kind.
        folded = dedup.fold_similar(F.transform(items, lambda m: F.struct(
            *[m[f].alias(f) for f in ("brand_name", "model", *numbers, *texts, *flags)])), numbers, flags, texts=texts)
        items = F.transform(folded, lambda m: F.struct(*[m[f].alias(f) for f in NAMES]))
    scenario = F.col("scenario")
    items = F.filter(items, lambda m: titles.in_scope(m["brand_name"], m["model"], scenario, F.col("t_brand"), F.col("t_model")))
    if responses is not None:
        answers = responses.groupBy(doc).agg(
            F.sort_array(F.collect_list(F.struct(F.col("position").cast("bigint").alias("no"), values))).alias("_given"))
        docs = docs.join(answers, doc, "left")
        given = F.coalesce(F.col("_given"), F.slice(F.array(F.struct(F.lit(0).cast("bigint").alias("no"), F.struct(
            *[F.lit(None).cast(kinds[f]).alias(f) for f in NAMES]).alias("m"))), 1, 0))
        items = text.let(given, lambda g: text.let(items, lambda own: merge.chosen_items(
            merge.filled_items(own, g, scenario), g, scenario)))
    else:
        items = merge.numbered_items(items)
    return (docs.select(*meta, F.explode(items).alias("_x"))
            .select(*meta, F.col("_x.no").alias("block_no"), *[F.col(f"_x.m.{f}") for f in NAMES]))
