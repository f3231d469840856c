"""The article result: source choice, prefilters, windows, outcome."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from specforge import rules
from specforge.functions import text
from specforge.operators import classify, tables, windows
from specforge.sources import pages

_MODELS = ("array<struct<model_name:string,weight_g:double,weight_oz:double,heel_mm:double,"
           "forefoot_mm:double,drop_mm:double,price_usd:double>>")
OUTPUT = ["mode", "reason", "stage", "single_reason", "price_usd", "drop_mm", "weight_g",
          "heel_mm", "forefoot_mm", "candidates", "models", "prefilter_score",
          "prefilter_has_anchor", "prefilter_pos_hits", "prefilter_neg_hits", "source_used",
          "content_len", "html_chars", "method"]


def article_specs(df: DataFrame, key: str, title: str, content: str, html: str,
                  min_content: int = rules.MIN_CONTENT_CHARS,
                  max_html: int | None = None) -> DataFrame:
    """One result row per article.

    Content of `min_content` characters is used as it is, otherwise the page;
    without a page, shorter content too.  Only pages that remain after the title
    check (and a size limit, if one is given) are parsed, in the same pass over the
    table.  A comparison table with two or more models wins over the text windows.
    """
    base = choose_source(df, key, title, content, html, min_content, max_html)
    meta = ["content_len", "html_chars", "source_used", "_route"]
    page = F.when(F.col("_route") == "page", F.col("_html"))
    parsed = pages.parse_pages(base.withColumn("_page", page).withColumn(
        "_given", F.when(F.col("_route") == "content", F.col("_body")).when(
            F.col("_route") == "large", pages.light_text(F.col("_html")))), [key, *meta, "_given"], "_page")
    compared = tables.comparison(F.col("tables"))["models"]
    rows = parsed.withColumn("_cmp", F.when(F.col("_route") == "page", compared)).select(
        key, *meta, F.when(F.col("_route") == "page", F.col("body_text")).otherwise(F.col("_given")).alias("_text"),
        F.when(F.size("_cmp") >= 2, F.col("_cmp")).cast(_MODELS).alias("models"))
    return _extract(classify.with_prefilter(rows, "_text"), key)


def choose_source(df: DataFrame, key: str, title: str, content: str, html: str,
                  min_content: int = rules.MIN_CONTENT_CHARS, max_html: int | None = None) -> DataFrame:
    """key, source_used, content_len, html_chars, and the texts and route for the next step."""
    body = text.trim(F.coalesce(F.col(content), F.lit("")))
    base = df.select(F.col(key), F.col(title).alias("_title"), body.alias("_body"),
                     F.col(html).alias("_html"))
    base = base.withColumns({
        "content_len": F.length("_body").cast("bigint"),
        "html_chars": F.coalesce(F.length("_html"), F.lit(0)).cast("bigint"),
        "_title_ok": classify.title_prefilter(F.col("_title"))["decision"] == "pass"})
    use_content = (F.col("content_len") >= min_content) | text.is_blank(F.col("_html"))
    base = base.withColumns({
        "source_used": F.when(use_content, "content").otherwise("fetched_html"),
        "html_chars": F.when(use_content | ~F.col("_title_ok"), 0).otherwise(F.col("html_chars"))})
    large = F.lit(False) if max_html is None else F.col("html_chars") > max_html
    return base.withColumn("_route", F.when(~F.col("_title_ok"), "title").when(
        use_content, "content").when(large, "large").otherwise("page"))


def _extract(df: DataFrame, key: str) -> DataFrame:
    """Windows and outcome of the readable rows, labels of the others."""
    run = F.col("_route").isin("content", "page") & F.col("prefilter_ok")
    df = df.withColumn("_run", run)
    df = df.withColumn("_win", F.when(F.col("_run") & F.col("models").isNull(),
                                      windows.keyword_windows(F.col("_text"))["windows"]))
    df = df.withColumn("_texts", F.coalesce(
        windows.window_texts(F.col("_text"), F.col("_win")), F.array().cast("array<string>")))
    df = windows.resolve_windows(df, "_texts")
    state = (F.when(F.col("_route") == "title", "title").when(F.col("_route") == "large", "large")
             .when(~F.col("_run"), "off").when(F.col("models").isNotNull(), "table")
             .otherwise(F.col("mode")))
    df = df.withColumn("_state", state)
    s = F.col("_state")
    label = lambda table: text.lookup(s, table)
    values = ["single_reason", "price_usd", "drop_mm", "weight_g", "heel_mm", "forefoot_mm",
              "candidates"]
    scored = s != "title"
    return df.withColumns({
        **{c: F.when(s.isin("single", "ambiguous_multi", "skipped"), F.col(c)) for c in values},
        **{f"prefilter_{c}": F.when(scored, F.col(f"prefilter_{c}"))
           for c in ("score", "has_anchor", "pos_hits", "neg_hits")},
        "models": F.when(s == "table", F.col("models")),
        "mode": label({"single": "single", "ambiguous_multi": "ambiguous_multi",
                       "table": "multi_table", "skipped": "skipped", "title": "skipped",
                       "large": "skipped", "off": "skipped"}),
        "reason": label({"title": "not_shoe_article", "off": "not_shoe_article",
                         "large": "large_html", "skipped": "no_specs_found"}),
        "stage": label({"title": "title_prefilter", "large": "size_guard", "off": "prefilter",
                        "single": "extract", "ambiguous_multi": "extract",
                        "skipped": "extract", "table": "extract"}),
        "method": label({"title": "title_prefilter_skip", "large": "dom_skipped_large_html",
                         "off": "dom_not_shoe", "table": "dom_multi_table",
                         "single": "dom_windowed_single",
                         "ambiguous_multi": "dom_windowed_ambiguous",
                         "skipped": "dom_windowed_skipped"})}).select(key, *OUTPUT)


def keep_results(old: DataFrame, new: DataFrame, key: str, force: Column | None = None
                 ) -> DataFrame:
    """Only articles without a result, or with a skipped one, take the new result."""
    cols = [c for c in old.columns if c != key]
    n = new.select(key, *[F.col(c).alias(f"_n_{c}") for c in cols], F.lit(True).alias("_has"))
    take = F.col("_has") & (F.col("mode").isNull() | (F.col("mode") == "skipped")
                            | (force if force is not None else F.lit(False)))
    take = F.coalesce(take, F.lit(False))
    j = old.join(n, key, "full").withColumn("_take", take)
    return j.select(key, *[F.when(F.col("_take"), F.col(f"_n_{c}")).otherwise(F.col(c)).alias(c)
                           for c in cols])
