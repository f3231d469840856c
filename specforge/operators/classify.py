"""Relevance and validity predicates over text and product columns (F*)."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from specforge import rules
from specforge.functions import regex as rx
from specforge.functions import text


def _or(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def relevance(title: Column, content: Column, strict_substrings: bool = False) -> Column:
    """Two stages, title then content: struct(keep, stage, reason).

    Short negative terms are word-bounded; `strict_substrings` matches them
    anywhere, so that "what" counts as a hat.
    """
    terms = rules.NON_SHOE_TERMS_SUBSTRING if strict_substrings else rules.NON_SHOE_TERMS
    negative = lambda low: rx.any_low(low, terms)
    positive = lambda low: rx.any_low(low, rules.SHOE_TERMS)
    t = F.lower(text.trim(title))
    traits = lambda low: text.sum_of([
        rx.test_low(low, p).cast("int") for p in rules.CHARACTERISTIC_PATTERNS])

    def out(keep, stage, reason):
        return F.struct(F.lit(keep).alias("keep"), F.lit(stage).alias("stage"),
                        F.lit(reason).alias("reason"))
    by_content = text.let(F.lower(content), lambda low: (
        F.when(positive(low), out(True, "content", "positive_term"))
        .when(traits(low) >= 3, out(True, "content", "characteristics"))
        .when(negative(low), out(False, "content", "negative_term"))
        .otherwise(out(False, "content", "no_indicator"))))
    by_title = text.let(t, lambda low: (
        F.when(_or(negative(low)), out(False, "title", "negative_term"))
        .when(_or(positive(low)), out(True, "title", "positive_term"))))
    none = F.when(text.is_blank(content), out(False, "content", "no_content"))
    return F.coalesce(by_title, none, by_content)


def mentions_review(c: Column) -> Column:
    return text.let(F.lower(c), lambda low: rx.any_low(low, rules.REVIEW_TERMS))


def is_product_article(title: Column, content: Column) -> Column:
    """Product word and context word and no excluded footwear."""
    both = F.concat_ws(" ", title, content)
    return (rx.test(both, rules.SHOE_WORDS) & rx.test(both, rules.CONTEXT_WORDS)
            & ~rx.test(both, rules.EXCLUSION_WORDS))


def _term_pattern(term: str, group: str) -> str:
    if group == "high":  # hyphen or blank inside a term is optional
        return r"\b" + r"[-\s]?".join(term.replace("-", " ").split(" ")) + r"\b"
    return rx.literal(term) if term == "$" else rf"\b{rx.literal(term)}\b"


def term_patterns() -> list[tuple[str, str, str]]:
    """(group, term, pattern) of the weighted prefilter in scoring order."""
    groups = [("high", rules.SCORE_HIGH), ("medium", rules.SCORE_MEDIUM),
              ("low", rules.SCORE_LOW), ("negative", rules.SCORE_NEGATIVE)]
    return [(g, t, _term_pattern(t, g)) for g, terms in groups for t in terms]


def _term_counts(low: Column) -> Column:
    """map(term key -> hits) of a lower-cased text, in two scans.

    A word is a maximal run of word characters, so vocabulary words are counted
    by equality.  Phrases share no border word and count by one alternation;
    their key has no blanks or hyphens (see `_term_key`).
    """
    words = [t.lower() for _, t, _ in term_patterns() if t.isalnum()]
    phrases = [p.lower() for _, t, p in term_patterns() if " " in t]
    found = F.concat(
        F.filter(F.regexp_extract_all(low, F.lit("[a-z0-9_]+"), F.lit(0)),
                 lambda w: w.isin(words)),
        F.when(reduce(lambda a, b: a | b, [F.contains(low, F.lit(rx.required(p))) for p in phrases]),
               F.transform(F.regexp_extract_all(low, F.lit(rx.java("|".join(phrases), "")), F.lit(0)),
                           lambda m: F.regexp_replace(m, f"[{rx.BLANK}-]", "")))
        .otherwise(F.array().cast("array<string>")),
        F.array_repeat(F.lit("$"), F.regexp_count(low, F.lit(r"\$"))))
    return F.map_from_entries(text.let(found, lambda ws: F.transform(
        F.array_distinct(ws), lambda w: F.struct(
            w.alias("t"), F.size(F.filter(ws, lambda x: x == w)).alias("n")))))


def _term_key(term: str) -> str:
    return term.lower().replace("-", "").replace(" ", "")


def with_prefilter(df: DataFrame, content: str, prefix: str = "prefilter_",
                   most_hits: int | None = None) -> DataFrame:
    """Weighted keyword score with capped counts, anchor bonus and decision.

    Adds score, negative, has_anchor, ok, pos_hits, neg_hits (all, or the first `most_hits`).
    """
    p = prefix
    low = F.col("_low")
    # a foldable literal: the optimizer turns it into one constant
    table = F.from_json(F.lit(json.dumps([
        dict(term=t, key=_term_key(t), group=g, weight=rules.SCORE_WEIGHTS[g], n=0,
             specific=g in ("high", "medium") and not any(x in t for x in rules.SCORE_LOW))
        for g, t, _ in term_patterns()])), "array<struct<term:string,key:string,group:string,"
        "weight:double,n:int,specific:boolean>>")
    df = df.withColumn("_low", F.lower(F.coalesce(F.col(content), F.lit(""))))
    df = df.withColumn("_counts", _term_counts(low))
    df = df.withColumns({
        "_hits": text.let(F.col("_counts"), lambda counts: F.filter(
            F.transform(table, lambda r: r.withField("n", F.least(F.coalesce(
                F.try_element_at(counts, r["key"]), F.lit(0)), F.lit(rules.SCORE_CAP)))),
            lambda r: r["n"] > 0)),
        "_ev": F.array(*[rx.test_low(low, q) for q, _, _ in rules.EVIDENCE_PATTERNS]),
        "_anchor": reduce(lambda a, b: a | b, [rx.test_low(low, q) for q in rules.ANCHOR_PATTERNS])})
    negative = lambda r: r["group"] == "negative"
    df = df.withColumns({
        "_pos": F.filter("_hits", lambda r: ~negative(r)), "_neg": F.filter("_hits", negative)})
    points = lambda c: F.aggregate(c, F.lit(0.0), lambda acc, r: acc + r["n"] * r["weight"])
    names = lambda c: F.transform(c, lambda r: r["term"])
    unseen = lambda *parts: ~F.exists("_pos", lambda r: F.rlike(
        r["term"], F.lit("|".join(rx.literal(x) for x in parts))))
    labels = F.filter(F.array(*[
        F.when(F.col("_ev")[i] & unseen(*parts), F.lit(label)) for i, (parts, label) in
        enumerate([(("$",), "price indication"), (("mm",), "mm measurements"),
                   (("g", "oz"), "weight measurements")])]), lambda x: x.isNotNull())
    first = lambda c: c if most_hits is None else F.slice(c, 1, most_hits)
    evidence = F.aggregate("_ev", F.lit(0.0), lambda acc, e: acc + e.cast("double"))
    df = df.withColumns({
        f"{p}negative": points(F.col("_neg")),
        f"{p}score": F.greatest(F.lit(0.0), points(F.col("_pos")) + evidence
                                - points(F.col("_neg")))
        + F.when(F.col("_anchor"), F.lit(rules.ANCHOR_BONUS)).otherwise(F.lit(0.0)),
        f"{p}has_anchor": F.col("_anchor"),
        f"{p}pos_hits": first(F.concat(names(F.col("_pos")), labels)),
        f"{p}neg_hits": first(names(F.col("_neg"))),
        "_specific": F.exists("_pos", lambda r: r["specific"])})
    ok = ((F.col(f"{p}score") >= rules.SCORE_MIN)
          & (F.col(f"{p}negative") < rules.SCORE_NEGATIVE_MAX) & F.col("_specific"))
    return df.withColumn(f"{p}ok", ok).drop(
        "_low", "_counts", "_hits", "_ev", "_anchor", "_pos", "_neg", "_specific")


def title_prefilter(title: Column) -> Column:
    """struct(decision, positives, negatives) by substrings of the title."""
    low = F.lower(F.coalesce(title, F.lit("")))

    def found(terms):
        return text.let(low, lambda s: F.filter(F.array(*[F.lit(t) for t in terms]),
                                                lambda t: F.contains(s, t)))
    compounds = F.filter(F.array(*[
        F.when(reduce(lambda a, b: a & b, [F.contains(low, F.lit(t)) for t in ts]),
               F.lit(name)) for ts, name in rules.TITLE_COMPOUNDS]),
        lambda x: x.isNotNull())
    positives = found(rules.TITLE_POSITIVES)
    negatives = F.concat(found(rules.TITLE_NEGATIVES), compounds)
    none = F.array().cast("array<string>")
    passed = F.size(positives) > 0
    return F.struct(
        F.when(passed | (F.size(negatives) == 0), "pass").otherwise("skip").alias("decision"),
        positives.alias("positives"),
        F.when(passed, none).otherwise(negatives).alias("negatives"))


def irrelevance(title: Column, key: Column, model: Column, brand: Column) -> Column:
    """Reason why a row is no product, null when it is fine."""
    hay = F.concat(F.coalesce(title, F.lit("")), F.lit(" "),
                   F.coalesce(key, F.lit("")), F.lit(" "), F.coalesce(model, F.lit("")))
    b, m = text.trim(brand), text.trim(model)
    return (F.when(rx.test(hay, rules.LISTICLE), "listicle")
            .when(rx.test(hay, rules.APPAREL), "apparel")
            .when(rx.test(hay, rules.NON_SHOE), "nonshoe")
            .when(_or(rx.test(b, rules.BAD_BRAND)), "badbrand")
            .when(_or(rx.test(m, rules.BAD_MODEL)), "badmodel")
            .when(F.length(b) > 25, "badbrand")
            .when(F.length(m) > 50, "badmodel")
            .when(F.size(F.split(m, f"[{rx.BLANK}]+")) > 6, "badmodel"))


def apply_irrelevance(df: DataFrame, reason: Column, mode: str = "hard",
                      column: str = "irrelevant_reason") -> DataFrame:
    """'hard' filters the rows, 'soft' keeps them with their reason."""
    df = df.withColumn(column, reason)
    return df.filter(F.col(column).isNull()) if mode == "hard" else df


def is_footwear(brand: Column, model: Column) -> Column:
    """Negative keyword out, known brand in, others need positive evidence."""
    m, b = F.lower(text.trim(model)), F.lower(text.trim(brand))
    present = ~text.is_blank(brand) & ~text.is_blank(model)
    evidence = (text.contains_any(m, rules.SNEAKER_KEYWORDS)
                | rx.test(m, rx.any_of(rules.FOOTWEAR_PATTERNS)))
    return _or(present & ~text.contains_any(m, rules.NON_SNEAKER_KEYWORDS)
               & (b.isin(rules.FOOTWEAR_BRANDS) | evidence))


def cleanup_category(cols: dict[str, Column], table=rules.CLEANUP_RULES) -> Column:
    """First matching rule: struct(category, reason); null keeps the row.

    The fields are bound, and a pattern runs only where its literal stands.
    """
    fields = list(dict.fromkeys(field for field, _, _ in table))
    given = F.struct(*[c.alias(f"{f}{end}") for f in fields for c, end in (
        (cols[f], ""), (F.lower(cols[f]), "_low"))])

    def first(row):
        out = None
        for field, pattern, category in table:
            hit = F.struct(F.lit(category).alias("category"),
                           F.lit(f"{field} matches {category}").alias("reason"))
            found = F.contains(row[f"{field}_low"], F.lit(rx.required(pattern))) & rx.test(row[field], pattern)
            out = (F if out is None else out).when(_or(found), hit)
        return out
    return text.let(given, first)


def names_valid(brand: Column, model: Column) -> Column:
    b, m = text.trim(brand), text.trim(model)
    return _or(F.length(b).between(2, 30) & F.length(m).between(2, 50)
               & ~rx.test(m, rules.INVALID_MODELS))


def _truthy_num(c: str) -> Column:
    return F.coalesce(F.col(c) != 0, F.lit(False))


def has_characteristic() -> Column:
    """Any filled attribute; zero counts for drop only, false counts for flags."""
    nums = [_truthy_num(c) for c in ("heel_height", "forefoot_height", "weight", "price")]
    texts = [~text.is_blank(F.col(c)) for c in
             ("primary_use", "surface_type", "cushioning_type", "foot_width",
              "upper_breathability")]
    given = [F.col(c).isNotNull() for c in ("drop", "carbon_plate", "waterproof")]
    return reduce(lambda a, b: a | b, nums + texts + given)


def valid_spec() -> Column:
    return names_valid(F.col("brand_name"), F.col("model")) & has_characteristic()


def complete_spec(zero_drop_counts: bool = True) -> Column:
    """(heel or drop) and (use or surface)."""
    drop = F.col("drop").isNotNull() if zero_drop_counts else _truthy_num("drop")
    return ((_truthy_num("heel_height") | drop)
            & (~text.is_blank(F.col("primary_use")) | ~text.is_blank(F.col("surface_type"))))


def has_core() -> Column:
    """At least one of use, surface, heel, weight."""
    return F.coalesce(*[F.col(c).cast("string") for c in
                        ("primary_use", "surface_type", "heel_height", "weight")]).isNotNull()


def split_core(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejects with reason `core_empty`)."""
    return (df.filter(has_core()),
            df.filter(~has_core()).withColumn("reason", F.lit("core_empty")))


def not_excluded(brand: Column, excluded=tuple(rules.EXCLUDED_BRANDS)) -> Column:
    b = F.lower(text.trim(brand))
    return _or((b != "") & ~b.isin(list(excluded)))


def suspicious(c: Column) -> Column:
    """Script-like content in a response text."""
    return _or(rx.test(c, rx.any_of(rules.SUSPICIOUS)))
