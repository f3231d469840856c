"""Incremental loads, response items, spec sheets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from specforge import rules
from specforge.functions import text

# --- high-water mark ------------------------------------------------------------

def after_mark(df: DataFrame, created: str, mark: Column) -> DataFrame:
    """Rows behind the mark; a row without a stamp is always taken."""
    return df.filter((F.col(created) > mark) | F.col(created).isNull())


def load_outcomes(df: DataFrame, created: str, mark: Column, doc_id: Column, content: Column,
                  converted: Column, core: Column) -> DataFrame:
    """Rows with `outcome`: LATE, NO_ID, NO_CONTENT, CONVERTER_EMPTY, CORE_EMPTY, OK."""
    return df.withColumn("outcome", F.when(F.col(created) <= mark, "LATE")
                         .when(doc_id.isNull(), "NO_ID")
                         .when(text.is_blank(content), "NO_CONTENT")
                         .when(~converted, "CONVERTER_EMPTY")
                         .when(~core, "CORE_EMPTY").otherwise("OK"))


def next_state(outcomes: DataFrame, created: str, mark: Column) -> DataFrame:
    """One state row: the mark moves to max(created) only if a row was accepted."""
    seen = F.max(F.when(F.col("outcome") != "LATE", F.col(created)))
    n = lambda s: F.count_if(F.col("outcome") == s)
    names = ["OK", "NO_ID", "NO_CONTENT", "CONVERTER_EMPTY", "CORE_EMPTY", "LATE"]
    return outcomes.agg(
        F.when(n("OK") > 0, F.greatest(seen, mark)).otherwise(mark).alias("last_created_at"),
        *[n(s).alias(f"n_{s.lower()}") for s in names])


# --- response items ---------------------------------------------------------------

ITEM_KEYS = ["brand_name", "brand", "model", "model_name", "shoe_model", "heel_height",
             "forefoot_height", "drop", "weight", "price", "price_usd", "price_currency",
             "price_text", "upper_breathability", "carbon_plate", "waterproof", "primary_use",
             "cushioning_type", "cushioning", "surface_type", "surface", "foot_width", "width",
             "additional_features"]
_ITEM = "struct<" + ",".join(f"{k}:string" for k in ITEM_KEYS) + ">"
_ENVELOPE = f"items array<{_ITEM}>, sneakers array<{_ITEM}>, models array<{_ITEM}>, model {_ITEM}"


def response_items(df: DataFrame, raw: str, keep: Sequence[str]) -> DataFrame:
    """One row per item of a response text, all fields as strings.

    The array sits under items, sneakers, models or model; other or broken JSON
    yields no row (see `bad_responses`).
    """
    e = F.from_json(F.col(raw), _ENVELOPE)
    items = F.coalesce(e["items"], e["sneakers"], e["models"],
                       F.when(e["model"].isNotNull(), F.array(e["model"])))
    rows = df.select(*keep, F.posexplode(items).alias("item_no", "_i"))
    i = lambda *names: F.coalesce(*[F.nullif(F.col(f"_i.{n}"), F.lit("")) for n in names])
    return rows.select(
        *keep, "item_no", i("brand_name", "brand").alias("brand_name"),
        i("model", "model_name", "shoe_model").alias("model"),
        *[F.col(f"_i.{n}").alias(n) for n in (
            "heel_height", "forefoot_height", "drop", "weight", "price", "price_usd",
            "price_currency", "price_text", "upper_breathability", "carbon_plate",
            "waterproof", "primary_use")],
        i("cushioning_type", "cushioning").alias("cushioning_type"),
        i("surface_type", "surface").alias("surface_type"),
        i("foot_width", "width").alias("foot_width"),
        F.col("_i.additional_features").alias("additional_features"))


def bad_responses(df: DataFrame, raw: str) -> DataFrame:
    """Responses without a usable item array."""
    e = F.from_json(F.col(raw), _ENVELOPE)
    return df.filter(F.coalesce(F.size(e["items"]), F.size(e["sneakers"]), F.size(e["models"]),
                                F.when(e["model"].isNotNull(), 1)).isNull())


# --- spec sheets --------------------------------------------------------------------

SHEET_COLUMNS = ["brand", "model", "use", "surface", "heel", "forefoot", "drop", "weight",
                 "price", "plate", "waterproof", "cushioning", "width", "breathability",
                 "source_link"]


def read_sheet(spark: SparkSession, path: str) -> DataFrame:
    """CSV with header; a byte-order mark and blanks around cells are removed."""
    schema = ", ".join(f"`{c}` string" for c in SHEET_COLUMNS)
    return spark.read.csv(path, schema=schema, header=True, multiLine=True, escape='"',
                          encoding="UTF-8", ignoreLeadingWhiteSpace=True,
                          ignoreTrailingWhiteSpace=True, enforceSchema=True)


def map_sheet(df: DataFrame, now: Column) -> DataFrame:
    """Spec-sheet rows to product rows; rows without brand or model are skipped."""
    c = {n: text.norm_str(F.regexp_replace(F.col(n), "^﻿", "")) for n in SHEET_COLUMNS}
    given = {n: F.when(v != "N/A", v) for n, v in c.items()}
    num = lambda n: text.sheet_number(c[n])
    exact = lambda n: text.lookup(F.lower(given[n]), rules.SHEET_EXACT[n])
    slug = lambda v: F.regexp_replace(F.lower(v), r"\s+", "-")
    plate = F.when(given["plate"] != "no", F.lower(given["plate"]) != "no")
    return df.filter(c["brand"].isNotNull() & c["model"].isNotNull()).select(
        F.concat(slug(c["brand"]), F.lit("_"), slug(c["model"])).alias("article_id"),
        c["brand"].alias("brand_name"), c["model"].alias("model"),
        F.concat(F.lower(c["brand"]), F.lit("::"), F.lower(c["model"])).alias("model_key"),
        num("heel").alias("heel_height"), num("forefoot").alias("forefoot_height"),
        num("drop").alias("drop"), num("weight").alias("weight"), num("price").alias("price"),
        exact("breathability").alias("upper_breathability"), plate.alias("carbon_plate"),
        (F.lower(given["waterproof"]) == "yes").alias("waterproof"),
        c["use"].alias("primary_use"),
        text.vocab(given["cushioning"], rules.VOCAB["cushioning_sheet"]).alias("cushioning_type"),
        exact("surface").alias("surface_type"), exact("width").alias("foot_width"),
        F.when(given["plate"] != "no", F.concat(F.lit("plate: "), c["plate"])
               ).alias("additional_features"),
        now.alias("date"), c["source_link"].alias("source_link"))


def insert_absent(target: DataFrame, rows: DataFrame, key: str, position: Sequence[Column]
                  ) -> DataFrame:
    """Rows to append: key not in the target, first row of a repeated key."""
    from specforge.operators.dedup import first_per_key
    fresh = rows.join(target.select(key).distinct(), key, "left_anti")
    return first_per_key(fresh, [F.col(key)], position)
