"""Weights, currencies and range checks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from specforge import rules
from specforge.functions import regex as rx
from specforge.functions import text


def oz_to_grams(oz: Column, factor: float = rules.OZ_TO_GRAMS) -> Column:
    return text.js_round(oz * F.lit(factor))


def grams_to_oz(grams: Column, factor: float = rules.OZ_TO_GRAMS) -> Column:
    return text.round2(grams / F.lit(factor))


def to_usd(amount: Column, code: Column, rates: dict = rules.USD_RATES) -> Column:
    """Null for a currency without a rate."""
    return amount * text.lookup(code, {k: float(v) for k, v in rates.items()})


def detect_currency(c: Column) -> Column:
    upper = F.upper(c)
    out = None
    for pattern, code in rules.CURRENCY_PATTERNS:
        out = (F if out is None else out).when(rx.test(upper, pattern, ""), code)
    return out


def currency_code(c: Column) -> Column:
    """A symbol or a three-letter code, upper case."""
    s = F.upper(text.trim(c.cast("string")))
    return (F.when(s.isin("$", "USD", "US$"), "USD")
            .when(s.isin("€", "EUR"), "EUR").when(s.isin("£", "GBP"), "GBP")
            .when(s.isin("¥", "JPY"), "JPY").when(F.length(s) == 3, s))


def in_bounds(c: Column, kind: str, bounds: dict = rules.BOUNDS) -> Column:
    low, high = bounds[kind]
    return F.coalesce(c.between(low, high), F.lit(False))


def keep_in_bounds(c: Column, kind: str, bounds: dict = rules.BOUNDS) -> Column:
    low, high = bounds[kind]
    return F.when(c.between(low, high), c)


def brand_alias(c: Column) -> Column:
    s = text.trim(c)
    return text.lookup(s, rules.BRAND_ALIASES, s)


def brand_alias_ci(c: Column) -> Column:
    """The alias map tried on the upper-cased name first (title brands)."""
    return F.coalesce(text.lookup(F.upper(c), rules.BRAND_ALIASES), brand_alias(c))
