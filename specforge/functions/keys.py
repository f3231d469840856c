"""Keys: product key, source id, model name refinement."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from specforge import rules
from specforge.functions import regex as rx
from specforge.functions import text


@lru_cache(maxsize=1)
def _accent_table() -> tuple[str, str]:
    """Latin letters whose compatibility form is one ASCII letter plus marks."""
    src, dst = [], []
    for cp in list(range(0xC0, 0x180)) + list(range(0x1E00, 0x1F00)):
        base = "".join(ch for ch in unicodedata.normalize("NFKD", chr(cp))
                       if not unicodedata.combining(ch))
        if len(base) == 1 and base.isascii():
            src.append(chr(cp))
            dst.append(base)
    return "".join(src), "".join(dst)


def strip_accents(c: Column) -> Column:
    src, dst = _accent_table()
    return F.regexp_replace(F.translate(c, src, dst), r"[\x{300}-\x{36F}]", "")


def strip_accents_exact(c: Column) -> Column:
    """Full NFKD, for scripts outside the Latin table (opt-in, Arrow batches)."""
    def fold(batch: pd.Series) -> pd.Series:
        import unicodedata as u
        return batch.map(lambda x: "".join(
            ch for ch in u.normalize("NFKD", x) if not 0x300 <= ord(ch) <= 0x36F),
            na_action="ignore")
    return F.pandas_udf(fold, "string")(c)


def key_part(c: Column, exact: bool = False) -> Column:
    """Lower-case ASCII words separated by one blank."""
    folded = strip_accents_exact(c) if exact else strip_accents(c)
    return F.trim(F.regexp_replace(F.lower(folded), "[^a-z0-9]+", " "))


def model_key(brand: Column, model: Column, sep: str = " ",
              exact: bool = False) -> Column:
    """`brand model` in key form; empty when either side is."""
    parts = F.struct(key_part(brand, exact).alias("b"), key_part(model, exact).alias("m"))
    return text.let(parts, lambda k: F.when((k["b"] != "") & (k["m"] != ""), F.concat(
        k["b"], F.lit(sep), k["m"])).otherwise(F.lit("")))


def plain_key(brand: Column, model: Column, sep: str = "::") -> Column:
    """Lower-cased and trimmed, nothing else folded."""
    return F.concat(text.trim(F.lower(brand)), F.lit(sep), text.trim(F.lower(model)))


def normalize_link(link: Column) -> Column:
    """Without scheme, `www.`, trailing slash, query and fragment."""
    s = F.regexp_replace(link, "^https?://", "")
    s = F.regexp_replace(F.regexp_replace(s, r"^www\.", ""), "/$", "")
    return F.regexp_replace(s, r"[?#][\s\S]*$", "")


def source_id(doc_id: Column, link: Column, content: Column,
              prefixed: bool = True) -> Column:
    """Document id, else normalized link, else content hash; null if all empty."""
    if prefixed:
        doc = F.when(doc_id.isNotNull() & (doc_id != 0),
                     F.concat(F.lit("article_"), doc_id.cast("string")))
        url = F.when(link != "", F.concat(F.lit("link_"), normalize_link(link)))
        body = F.when(content != "", F.concat(F.lit("content_"),
                                              F.sha1(text.trim(content))))
    else:
        doc = text.norm_str(doc_id)
        bare = rx.sub(rx.sub(text.trim(link), "^https?://"), r"^www\.")
        url = F.when(~text.is_blank(link), F.regexp_replace(bare, "/+$", ""))
        body = F.when(~text.is_blank(content), F.sha1(text.trim(content)))
    return F.coalesce(doc, url, body)


def strip_model_noise(model: Column) -> Column:
    """Remove the words shoe, sneaker and running."""
    return text.squeeze(rx.sub(model, r"\b(?:shoe|sneaker|running)\b"))


def strip_brand_prefix(model: Column, brands=tuple(rules.BLOCK_BRANDS)) -> Column:
    """Remove a trailing noise word, then a leading known brand."""
    alt = "|".join(rx.literal(b) for b in brands)
    return rx.sub(rx.sub(text.trim(model), rules.MODEL_NOISE_SUFFIX),
                  rf"^(?:{alt})\s+")


def refine_model(brand: Column, model: Column) -> Column:
    """Drop parentheses, subtitle, repeated brand and article words.

    Each step uses the step before once; the brand, its key and the name before
    the repeated-brand test are bound, since that test reads them again.
    """
    b = text.trim(F.coalesce(brand, F.lit("")))
    m = text.trim(F.coalesce(model, F.lit("")))
    m = rx.sub(m, r"\([^()]*\)")
    m = text.trim(rx.sub(m, r"\s*[:\-–—]\s+.*$"))
    parts = text.let(b, lambda b: F.struct(b.alias("b"), key_part(b).alias("key"), m.alias("m")))
    return text.let(parts, lambda p: _refined(p["b"], p["key"], p["m"]))


def _refined(b: Column, bn: Column, m: Column) -> Column:
    space = F.lit(" ")
    repeated = (bn != "") & F.startswith(F.concat(key_part(m), space), F.concat(bn, space))
    m = text.trim(F.substring(m, F.when(repeated, F.length(b) + 1).otherwise(1),
                              F.lit(2 ** 31 - 1)))
    for noise in (r"\s+(?:multi\s+)?tester\s*$", r"\s+\d+\s+mile\s*$",
                  r"^running\s+", r"\s+running\s*$", r"\s+review\s*$",
                  r"\s+test\s*$"):
        m = text.trim(rx.sub(m, noise))
    house = F.when(bn == "decathlon", rx.java(r"^kiprun\s+")).otherwise("(?!)")
    return text.squeeze(F.regexp_replace(m, house, F.lit("")))
