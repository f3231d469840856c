"""Numbers, brands and comparisons from a whole text."""

from __future__ import annotations

from functools import partial, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from specforge import rules
from specforge.functions import regex as rx
from specforge.functions import text, units
from specforge.operators.blocks import match_contexts


# One of these stands in every match, so a text without them is not scanned.
PAIR_WORDS = (("stack", "height"), ("/",))
HEEL_WORDS, FOREFOOT_WORDS = ("heel", "stack"), ("forefoot", "toe")


def _off_platform(content: Column, low: Column, pattern: str, words: tuple[str, ...]) -> Column:
    """Matches whose surroundings (24 characters each way) name no platform."""
    near = 24
    held = reduce(lambda a, b: a | b, [F.contains(low, F.lit(w)) for w in words])
    hits = F.when(held, match_contexts(content, pattern, near, near))
    return F.filter(hits, lambda h: ~rx.test(
        F.concat(h["before"], F.substring(F.concat(h["match"], h["after"]), 1, near)),
        rules.FALLBACK_PLATFORM))


def with_fallback_heights(df: DataFrame, content: str) -> DataFrame:
    """Add fb_heel, fb_forefoot, fb_drop: stack pair, else single mentions."""
    # every height pattern needs the unit: other texts are not scanned
    flat = F.regexp_replace(F.col(content), f"[{rx.BLANK}]+", " ")
    df = df.withColumn("_flat", F.when(F.rlike(F.col(content), F.lit("[mM][mM]")), flat))
    df = df.withColumn("_low", F.lower("_flat"))
    c, low = F.col("_flat"), F.col("_low")

    def pair(pattern, words):
        values = F.transform(_off_platform(c, low, pattern, words), lambda h: F.struct(
            rx.pick_num(h["match"], pattern, 1).alias("heel"),
            rx.pick_num(h["match"], pattern, 2).alias("fore")))
        ok = F.filter(values, lambda v: (v["heel"] > 0) & (v["fore"] > 0)
                      & (v["heel"] <= 60) & (v["fore"] <= 60))
        return F.get(ok, F.lit(0))

    def single(pattern, words):
        values = F.transform(_off_platform(c, low, pattern, words),
                             lambda h: rx.pick_num(h["match"], pattern, 1))
        return F.get(F.filter(values, lambda v: (v > 0) & (v <= 60)), F.lit(0))
    df = df.withColumns({
        "_pair": F.coalesce(*[pair(p, w) for p, w in zip(rules.FALLBACK_PAIRS, PAIR_WORDS, strict=True)]),
        "_heel": single(rules.FALLBACK_HEEL, HEEL_WORDS), "_fore": single(rules.FALLBACK_FOREFOOT, FOREFOOT_WORDS),
        "_drop": F.get(F.filter(F.transform(
            rx.pick_all(c, rules.FALLBACK_DROP), lambda x: x.try_cast("double")),
            lambda v: v <= 30), F.lit(0))})
    p = F.col("_pair")
    difference = text.round2(F.col("_heel") - F.col("_fore"))
    return df.withColumns({
        "fb_heel": F.when(p.isNotNull(), p["heel"]).otherwise(F.col("_heel")),
        "fb_forefoot": F.when(p.isNotNull(), p["fore"]).otherwise(F.col("_fore")),
        "fb_drop": F.when(p.isNotNull(), text.round2(p["heel"] - p["fore"]))
        .otherwise(F.coalesce(F.col("_drop"), difference)),
    }).drop("_flat", "_low", "_pair", "_heel", "_fore", "_drop")


def fallback_weight(content: Column) -> Column:
    """First gram figure in bounds, else the first ounce figure converted."""
    def in_range(g, value):
        return F.when(g.between(80, 600), value)
    converted = lambda oz: units.oz_to_grams(F.when((oz > 2) & (oz < 25), oz), rules.OZ_TO_GRAMS_TEXT)
    return F.coalesce(  # each figure is bound, so its pattern scans the text once
        text.let(rx.pick_num(content, rules.FALLBACK_GRAMS), lambda g: in_range(g, text.js_round(g))),
        text.let(rx.pick_num(content, rules.FALLBACK_OZ), lambda oz: in_range(converted(oz), converted(oz))))


def fallback_price(content: Column) -> Column:
    """struct(price_usd, currency, raw): first currency whose first amount is plausible."""
    def hit(code, raw):
        usd = raw * F.lit(rules.USD_RATES[code])
        return F.when(units.in_bounds(usd, "price"), F.struct(
            text.round2(usd).alias("price_usd"), F.lit(code).alias("currency"), raw.alias("raw")))
    return text.let(F.lower(content), lambda low: F.coalesce(*[
        text.let(rx.pick_num_low(low, content, pattern), partial(hit, code)) for pattern, code in rules.FALLBACK_MONEY]))


def weird_price(content: Column) -> Column:
    """'180,$199': the second figure."""
    return text.let(F.when(F.contains(content, F.lit("$")), rx.pick_num(content, rules.WEIRD_PRICE, 2)), lambda n: units.keep_in_bounds(n, "price"))


def frequent_phrase(df: DataFrame, content: str, key: str) -> DataFrame:
    """(key, phrase, n): the most frequent capitalised phrase seen twice or more.

    Counts are combined before the shuffle; ties go to the first occurrence.
    """
    phrases = rx.pick_all(F.col(content), r"\b([A-Z][a-z]+(?:\s[A-Z][a-z]+)?)\b", 1, "")
    counted = (df.select(key, F.posexplode(phrases).alias("pos", "phrase"))
               .filter(~F.col("phrase").isin(rules.PHRASE_STOP))
               .groupBy(key, "phrase")
               .agg(F.count("*").alias("n"), F.min("pos").alias("first_pos")))
    best = counted.groupBy(key).agg(F.max_by(
        F.struct("phrase", "n"), F.struct(F.col("n"), -F.col("first_pos"))).alias("b"))
    return best.select(key, "b.phrase", "b.n").filter(F.col("n") > 1)


_VS, _DOTTED = "\x01", "\x02"


def comparisons(content: Column) -> Column:
    """array<struct(left, right)> of 'A vs B' phrases.

    A word run reaches as far as blanks join words; within a run the last
    separator divides.  'vs.' joins two runs.  No run passes a full stop, so only
    sentences with the letters of a separator are scanned, and of them only the
    runs that hold a mark are taken.
    """
    return text.let(F.lower(content), lambda low: F.when(_separates(low), _pairs(content, low)).when(
        low.isNotNull(), F.array().cast("array<struct<left: string, right: string>>")))


def _separates(low: Column) -> Column:
    return F.contains(low, F.lit("vs")) | F.contains(low, F.lit("versus")) | F.contains(low, F.lit("compare"))


def _pairs(content: Column, low: Column) -> Column:
    c = F.replace(F.replace(content, F.lit(_VS), F.lit(" ")), F.lit(_DOTTED), F.lit(" "))
    c = F.when(F.contains(low, F.lit("vs.")), F.regexp_replace(c, rx.java(r"\bvs\.(?=\s+\w)"), _DOTTED)).otherwise(c)
    sentences = F.filter(F.split(c, r"\."), lambda s: F.contains(s, F.lit(_DOTTED)) | text.let(F.lower(s), _separates))
    joined = rf"\w{rx.BLANK}"
    marked = f"(?<![{joined}{_VS}{_DOTTED}])[{joined}]*+[{_VS}{_DOTTED}][{joined}{_VS}{_DOTTED}]*+"
    separator = rx.java(r"(?<=[A-Za-z0-9_])\s+(?:vs|versus|compared?\s+to)\s+(?=[A-Za-z0-9_])")
    runs = F.flatten(F.transform(sentences, lambda s: F.regexp_extract_all(
        F.regexp_replace(s, separator, _VS), F.lit(marked), F.lit(0))))

    def cut(left, right):
        flat = lambda x: text.squeeze(F.replace(x, F.lit(_VS), F.lit(" vs ")))
        return F.struct(flat(left).alias("left"), flat(right).alias("right"))

    def of_run(subs):
        pairs = F.transform(
            F.filter(F.sequence(F.lit(0), F.size(subs) - 1), lambda i: i % 2 == 0),
            lambda i: F.when(i + 1 < F.size(subs), cut(F.get(subs, i), F.get(subs, i + 1)))
            .otherwise(F.when(F.contains(F.get(subs, i), F.lit(_VS)), cut(
                F.regexp_extract(F.get(subs, i), f"^([\\s\\S]*){_VS}[\\s\\S]*$", 1),
                F.substring_index(F.get(subs, i), _VS, -1)))))
        return F.filter(pairs, lambda p: p.isNotNull() & (p["left"] != "")
                        & (p["right"] != ""))
    return F.flatten(F.transform(F.transform(runs, lambda r: F.split(r, _DOTTED)), of_run))
