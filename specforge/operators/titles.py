"""Title understanding: scenario, brand and model, scope filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from specforge import rules
from specforge.functions import text, units
from specforge.functions import regex as rx

_BRANDS = ("nike|adidas|hoka|asics|brooks|saucony|new balance|salomon|altra|on"
           "|mizuno|puma|under armour|reebok|inov-?8|topo athletic|scott|dynafit"
           "|la sportiva|scarpa|merrell")
_NUMBERED = (rf"\b({_BRANDS})\s+([a-z]+(?:\s+[a-z]+)?)\s+(\d+)(?:\s+(?:trail|road))?"
             rf"(?:\s+(?:{rules.TITLE_REVIEW}|vs|comparison)|\s*$)")
_NAMED = rf"\b({_BRANDS})\s+([a-z]+(?:\s+[a-z]+){{1,2}})(?:\s+(?:{rules.TITLE_REVIEW}))"
_MODEL_ONLY = (r"\b([a-z]+(?:\s+[a-z]+)?)\s+(\d+)(?:\s+(?:trail|road))?"
               rf"(?:\s+(?:{rules.TITLE_REVIEW}))")


def _scenario(name, brand=None, model=None, confidence=0.8) -> Column:
    as_str = lambda x: (F.lit(None) if x is None else x).cast("string")
    return F.struct(F.lit(name).alias("scenario"), as_str(brand).alias("brand"),
                    as_str(model).alias("model"),
                    (confidence if isinstance(confidence, Column) else F.lit(confidence)
                     ).cast("double").alias("confidence"))


def analyze_title(title: Column, strict_substrings: bool = False) -> Column:
    """struct(scenario, brand, model, confidence).

    Order: dictionary model, brand + name + number, brand + name + review word,
    known model + number, brand only, general.  Brands are word-bounded unless
    `strict_substrings` ("on" would match inside "marathon").
    """
    t = F.lower(text.trim(title))
    # choices are small codes 'brand|rest' first; one struct is built at the end
    known = None
    for model, brand in rules.MODEL_TO_BRAND.items():
        known = (F if known is None else known).when(
            F.contains(t, F.lit(model)), F.lit(f"{brand}|{model}"))
    head = lambda c: F.substring_index(c, "|", 1)
    rest = lambda c: F.substring_index(c, "|", -1)
    n_brand = rx.pick(t, _NUMBERED, 1)
    n_model = F.concat_ws(" ", rx.pick(t, _NUMBERED, 2), rx.pick(t, _NUMBERED, 3))
    w_brand, w_model = rx.pick(t, _NAMED, 1), rx.pick(t, _NAMED, 2)
    m_model = F.concat_ws(" ", rx.pick(t, _MODEL_ONLY, 1), rx.pick(t, _MODEL_ONLY, 2))
    m_brand = text.lookup(m_model, rules.MODEL_TO_BRAND)
    specific = (
        F.when(n_brand.isNotNull(),
               _scenario("specific", units.brand_alias_ci(n_brand), n_model, 0.8))
        .when(w_brand.isin(rules.TITLE_BRANDS),
              _scenario("specific", units.brand_alias_ci(w_brand), w_model, 0.8))
        .when(m_brand.isNotNull(), _scenario("specific", m_brand, m_model, 0.8)))
    has_known = text.contains_any(t, list(rules.MODEL_TO_BRAND))
    brand_only = []
    for b in rules.TITLE_BRANDS:
        lit = rx.literal(b)
        present = (F.contains(t, F.lit(b)) if strict_substrings
                   else rx.test(t, rf"\b{lit}\b"))
        focus = rx.test(t, rf"\b\d+\s+{lit}|best\s+{lit}|top\s+{lit}"
                           rf"|{lit}\s+(?:running\s+)?shoes?")
        numbered = rx.test(t, rf"{lit}\s+[a-z]+\s+\d+")
        name = rules.BRAND_ALIASES.get(b.upper(), b)
        brand_only.append(F.when(present, F.when(focus, F.lit(f"{name}|0.95")).when(
            ~numbered & ~has_known, F.lit(f"{name}|0.85"))))
    any_brand = text.contains_any(t, rules.TITLE_BRANDS)
    by_model = text.let(F.when(has_known, known), lambda c: F.when(
        c.isNotNull(), _scenario("specific", head(c), rest(c), 0.9)))
    by_brand = text.let(F.when(any_brand, F.coalesce(*brand_only)), lambda c: F.when(
        c.isNotNull(), _scenario("brand-only", head(c), None, rest(c).cast("double"))))
    return F.coalesce(by_model, specific, by_brand, _scenario("general"))


def analyze_title_loose(title: Column) -> Column:
    """Second analyser: confidence by version number, digits or known words."""
    t = text.trim(title)
    low = F.lower(t)
    nothing = _scenario("irrelevant", confidence=0.0)
    general = rx.test(t, rx.any_of(rules.LOOSE_GENERAL))
    brand = F.coalesce(*[
        F.when(rx.test(low, rf"\b{b.lower()}\b") if len(b) <= 2
               else F.contains(low, F.lit(b.lower())), F.lit(b))
        for b in rules.LOOSE_TITLE_BRANDS])
    after = text.trim(F.substring(
        t, F.instr(low, F.lower(brand)) + F.length(brand), F.length(t)))
    model = text.trim(rx.pick(after, rules.LOOSE_MODEL))
    confidence = (F.when(rx.test(model, rules.LOOSE_VERSION), 0.95)
                  .when(rx.test(model, r"\d"), 0.85)
                  .when(rx.test(model, rules.LOOSE_MODEL_WORDS), 0.75).otherwise(0.5))
    found = model.isNotNull() & (model != "")
    return (F.when(rx.test(t, rx.any_of(rules.LOOSE_NON_SHOE)), nothing)
            .when(brand.isNull() & general, _scenario("general", confidence=0.8))
            .when(brand.isNull(), _scenario("general", confidence=0.3))
            .when(general, _scenario("brand-only", brand, None, 0.8))
            .when(found & rx.test(model, rules.LOOSE_NOT_MODEL),
                  _scenario("brand-only", brand, None, 0.7))
            .when(found, F.struct(F.lit("specific").alias("scenario"),
                                  brand.alias("brand"), model.alias("model"),
                                  confidence.alias("confidence")))
            .when(rx.test(after, rules.LOOSE_COLLECTION),
                  _scenario("brand-only", brand, None, 0.8))
            .otherwise(_scenario("brand-only", brand, None, 0.6)))


def in_scope(brand: Column, model: Column, scenario: Column, want_brand: Column,
             want_model: Column) -> Column:
    """Keep rows the title talks about."""
    same = F.coalesce(F.lower(brand) == F.lower(want_brand), F.lit(False))
    named = F.coalesce(F.contains(F.lower(model), F.lower(want_model)), F.lit(False))
    return (F.when(scenario == "general", F.lit(True))
            .when((scenario == "brand-only") & want_brand.isNotNull(), same)
            .when((scenario == "specific") & want_brand.isNotNull()
                  & want_model.isNotNull(), same & named)
            .otherwise(F.lit(True)))


def word_mentions(model: Column, content: Column) -> Column:
    """Occurrences in the content of the model words longer than two letters."""
    words = model_words(model)
    # occurrences by length difference: no pattern built from data
    return text.let(F.lower(content), lambda low: F.aggregate(
        words, F.lit(0).cast("bigint"), lambda acc, w: acc + F.floor(
            (F.length(low) - F.length(F.replace(low, w, F.lit("")))) / F.length(w))))


def in_scope_strict(brand: Column, title: Column, scenario: Column, want_brand: Column, mentions: Column) -> Column:
    """Stricter: a general title must name the brand and the text the model twice.

    `mentions` is the number of places of the model words, from `word_mentions` on a
    row that holds the text or from `hit_count` where the text is elsewhere.
    """
    same = F.coalesce(F.lower(brand) == F.lower(want_brand), F.lit(False))
    discussed = F.contains(F.lower(title), F.lower(brand)) & (mentions >= 2)
    return (F.when(scenario.isin("specific", "brand-only") & want_brand.isNotNull(), same)
            .when(scenario == "general", F.coalesce(discussed, F.lit(False)))
            .otherwise(F.lit(True)))


def model_mentioned(model: Column, content: Column, ratio: float = 0.7) -> Column:
    """At least `ratio` of the significant model words occur in the content."""
    hit = lambda words: text.let(F.lower(content), lambda low: F.filter(words, lambda w: F.contains(low, w)))
    return _mentioned(model, hit, ratio)


def _mentioned(model: Column, hit, ratio: float) -> Column:
    words = F.filter(model_words(model), lambda w: ~w.isin(rules.MENTION_WORD_STOP))
    return F.when(F.size(words) > 0, F.size(hit(words)) / F.size(words) >= ratio).otherwise(F.lit(False))


# Texts stay where they are: an article gives its distinct words with their counts, the
# rows that ask about it their distinct model words, and one row of each meets per article.

def model_words(model: Column) -> Column:
    """Lower-case words longer than two letters."""
    return F.filter(F.split(F.lower(model), f"[{rx.BLANK}]+"), lambda w: F.length(w) > 2)


def content_words(content: Column, kept=lambda w: w != "") -> Column:
    """array<struct(word, n)>: the distinct lower-case words of a text that are kept, ascending."""
    words = F.sort_array(F.filter(F.split(F.lower(content), f"[{rx.BLANK}]+"), kept))

    def counted(s: Column, first: Column) -> Column:
        return F.transform(first, lambda i, k: F.struct(
            F.get(s, i).alias("word"), (F.coalesce(F.get(first, k + 1), F.size(s)) - i).alias("n")))
    return text.let(words, lambda s: F.when(F.size(s) == 0, F.array().cast("array<struct<word: string, n: int>>")).otherwise(
        text.let(F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1))),
                 lambda first: counted(s, first))))


SLOTS = 1 << 18     # of the filter ahead of the exchange; a crowded one lets more words through and changes no hit


def _slot(part: Column, kind: int) -> Column:
    return F.xxhash64(part, F.lit(kind)).bitwiseAND(F.lit(SLOTS - 1)).cast("int")


def asked_starts(words: DataFrame, word: str) -> Column:
    """array<boolean> by slot, one value for all rows: the starts of the words, at three
    letters (kind 0) and at five or, of a shorter word, its whole (kind 1)."""
    starts = F.array(_slot(F.substring(word, 1, 3), 0), _slot(F.substring(word, 1, 5), 1))
    slots = words.select(F.explode(starts).alias("_slot")).agg(F.sort_array(F.collect_set("_slot")).alias("_slots"))
    gap = lambda x, k: x - F.coalesce(F.get("_slots", k - 1), F.lit(-1)) - 1
    return slots.select(F.flatten(F.transform("_slots", lambda x, k: F.concat(
        F.array_repeat(F.lit(False), gap(x, k)), F.array(F.lit(True)))))).scalar()


def holds_start(word: Column, starts: Column) -> Column:
    """False or null only if the word holds none of the words of `asked_starts`."""
    at = lambda part, kind: F.get(starts, _slot(part, kind))
    return F.exists(F.regexp_extract_all(word, F.lit("(?s)(?=(.{3,5}))"), F.lit(1)), lambda x: at(F.substring(x, 1, 3), 0) & (
        at(x, 1) | F.coalesce(at(F.substring(x, 1, 3), 1), F.lit(False)) | F.coalesce(at(F.substring(x, 1, 4), 1), F.lit(False))))


def mention_hits(articles: DataFrame, rows: DataFrame, doc: str, content: str, model: str) -> DataFrame:
    """doc and `hits`, array<struct(word, n)>: how often the text of an article holds each
    model word that some row asks about, counted as `word_mentions` does.

    No join and no shuffle carries a text, and each article's words travel once, however
    many rows ask.  A model word has no blanks, so each of its places lies in one word;
    a word of the text travels only if it holds the start of some model word.
    The words asked about one article are as many as there are distinct model words.
    """
    pairs = rows.where(F.col(doc).isNotNull()).select(doc, F.explode(model_words(F.col(model))).alias("_w")).distinct()
    asked = pairs.groupBy(doc).agg(F.collect_list("_w").alias("_asked"))
    # The subquery is a column of its own, since Spark takes none inside a higher-order function.
    given = articles.select(doc, content, asked_starts(pairs, "_w").alias("_starts")).select(doc, text.let(
        F.col("_starts"), lambda starts: content_words(F.col(content), lambda w: holds_start(w, starts))).alias("_given"))
    places = lambda x, w: F.floor((F.length(x["word"]) - F.length(F.replace(x["word"], w, F.lit("")))) / F.length(w)) * x["n"]
    hits = F.transform("_asked", lambda w: F.struct(w.alias("word"), F.aggregate(
        F.filter("_given", lambda x: F.contains(x["word"], w)), F.lit(0).cast("bigint"), lambda acc, x: acc + places(x, w)).alias("n")))
    return given.join(asked, doc).select(doc, F.filter(hits, lambda h: h["n"] > 0).alias("hits"))


def hit_count(model: Column, hits: Column) -> Column:
    """`word_mentions` from the hits of the row's article; a word that stands twice counts twice."""
    return F.aggregate(model_words(model), F.lit(0).cast("bigint"), lambda acc, w: acc + F.coalesce(
        F.get(F.filter(hits, lambda h: h["word"] == w), F.lit(0))["n"], F.lit(0).cast("bigint")))


def model_hit(model: Column, hits: Column, ratio: float = 0.7) -> Column:
    """`model_mentioned` from the hits of the row's article."""
    return _mentioned(model, lambda words: F.filter(words, lambda w: F.exists(hits, lambda h: h["word"] == w)), ratio)


# --- brand and model from a free title --------------------------------------

def _title_case(c: Column) -> Column:
    return F.initcap(F.lower(c))


def _strip_prefix(c: Column) -> Column:
    words = "|".join(rules.TITLE_STOP_PREFIXES)
    preps = "|".join(rules.TITLE_PREPOSITIONS)
    return rx.sub(c, rf"^(?:{words})\b(?:\s+(?:{preps})\b)?\s*(?:[:\-–—])?\s*")


def _strip_trailing(c: Column) -> Column:
    return text.trim(rx.sub(c, rf"\s+(?:{'|'.join(rules.TITLE_STOP_PREFIXES)})\.?$"))


def _refine_title_model(c: Column) -> Column:
    m = text.trim(rx.sub(c, r"\([^()]*\)"))
    m = text.trim(rx.sub(m, r"\s+(?:review|обзор|test|beoordeling|recensie|recension"
                            r"|recensione|in depth)$"))
    return text.trim(rx.sub(m, r"\s*[:\-–—]\s+.*$"))


def _strip_noise(c: Column) -> Column:
    """At most five passes over possessives, numbering and leading articles."""
    def one(t):
        t = text.trim(rx.sub(t, r"^[A-Za-zÀ-ÿ]+['’ʼ]s\b\s+"))
        t = text.trim(rx.sub(t, r"^(?:top\s*)?\d+[.)]?\s+"))
        t = text.trim(rx.sub(t, r"^no\.\s*\d+\s+"))
        return F.when(rx.test(t, rx.any_of(rules.TITLE_HEAD_WHITELIST)), t).otherwise(
            text.trim(rx.sub(t, rf"^(?:{rules.TITLE_STOP_HEAD})\s+")))
    return F.aggregate(F.sequence(F.lit(1), F.lit(5)), text.trim(c),
                       lambda acc, _: one(acc))


def _brand_anywhere(c: Column) -> Column:
    """Earliest known brand: struct(brand, after); list order breaks ties."""
    found = F.array(*[
        F.struct(F.regexp_instr(c, F.lit(rx.java(rf"\b{rx.literal(b)}\b"))).alias("at"),
                 F.lit(i).alias("order"), F.lit(b).alias("brand"))
        for i, b in enumerate(rules.ANYWHERE_BRANDS)])
    return text.let(
        F.array_min(F.filter(found, lambda x: x["at"] > 0)),
        lambda best: F.when(best.isNotNull(), F.struct(
            _title_case(best["brand"]).alias("brand"),
            text.trim(F.substring(c, best["at"] + F.length(best["brand"]), F.length(c))
                      ).alias("after"))))


def _model_after(after: Column) -> Column:
    """First run of at most four model-like words behind a brand."""
    s = text.trim(rx.sub(after, r"^\s*(?:the|a|an|that|that's|is|are|was|were)\b\s*"))
    words = F.split(s, f"[{rx.BLANK}]+")

    def step(acc, w):
        stop = (acc["stop"] | rx.test(w, rules.TITLE_AFTER_NOISE)
                | ~rx.test(w, r"^[A-Za-z0-9][A-Za-z0-9\-/]*$", "") | (acc["n"] >= 4))
        return F.struct(
            stop.alias("stop"),
            F.when(stop, acc["n"]).otherwise(acc["n"] + 1).alias("n"),
            F.when(stop, acc["out"]).otherwise(F.concat_ws(
                " ", F.nullif(acc["out"], F.lit("")), w)).alias("out"))
    run = F.aggregate(words, F.struct(F.lit(False).alias("stop"), F.lit(0).alias("n"),
                                      F.lit("").alias("out")), step)
    return F.nullif(_refine_title_model(run["out"]), F.lit(""))


def _pair(brand: Column, model: Column) -> Column:
    return F.struct(brand.cast("string").alias("brand"), model.cast("string").alias("model"))


def _with_head(df: DataFrame, source: str, out: str) -> DataFrame:
    """Add struct(brand, model) read from the head of a title.

    Staged columns keep the plan small: each step is computed once per row.
    """
    s, words, low, found = (f"_{out}_{x}" for x in ("s", "words", "low", "found"))
    df = df.withColumn(s, _strip_noise(F.col(source)))
    df = df.withColumns({
        words: F.filter(F.split(F.col(s), " "), lambda w: w != ""),
        low: F.filter(F.split(F.lower(F.col(s)), " "), lambda w: w != ""),
        found: _brand_anywhere(F.col(s))})
    w, lw, hit = F.col(words), F.col(low), F.col(found)
    rest = lambda k: F.array_join(F.slice(w, k, F.greatest(F.size(w), F.lit(1))), " ")
    at = lambda k: F.get(lw, F.lit(k))
    none = _pair(F.lit(None), F.lit(None))

    def fixed(name, model):
        return F.when(model != "", _pair(F.lit(name), _refine_title_model(model))
                      ).otherwise(none)
    by_search = F.when(hit.isNotNull(), _pair(
        hit["brand"], F.coalesce(_model_after(hit["after"]),
                                 F.nullif(_refine_title_model(hit["after"]), F.lit("")))))
    second = F.coalesce(at(1).isin(rules.TITLE_SECOND_WORDS), F.lit(False))
    third = second & F.coalesce(at(2).isin(rules.TITLE_SECOND_WORDS), F.lit(False))
    n_brand = F.when(third, 3).when(second, 2).otherwise(1)
    brand = F.array_join(F.slice(w, F.lit(1), n_brand), " ")
    model = F.array_join(F.slice(w, n_brand + 1, F.greatest(F.size(w), F.lit(1))), " ")
    doubtful = (model == "") | rx.test(brand, rules.TITLE_STOP_HEAD)
    pair = (F.when(F.size(w) < 2, F.coalesce(by_search, none))
            .when((at(0) == "mount") & (at(1) == "to") & (at(2) == "coast"),
                  fixed("Mount to Coast", rest(4))))
    for w1, w2, name in rules.TITLE_TWO_WORD_BRANDS:
        pair = pair.when((at(0) == w1) & (at(1) == w2), fixed(name, rest(3)))
    pair = (pair.when(doubtful & hit.isNotNull(), by_search)
            .when(model == "", none)
            .otherwise(_pair(text.trim(brand), _refine_title_model(model))))
    return df.withColumn(out, pair).drop(s, words, low, found)


def _canonical_model(brand: Column, model: Column) -> Column:
    return F.when((F.lower(brand) == "asics") & rx.test(model, r"\bgt[-\s]?2000\b"),
                  F.lit("GT-2000")).otherwise(model)


def brand_model_from_title(df: DataFrame, title: str, out: str = "title_bm") -> DataFrame:
    """Add struct(brand, model, confidence): split at dash or colon, else the head."""
    t = text.squeeze(F.coalesce(F.col(title), F.lit("")))
    t = F.when((t != "") & (t == F.upper(t)), _title_case(t)).otherwise(t)
    df = df.withColumn("_t", _strip_prefix(t))
    df = df.withColumn("_parts", F.split(F.col("_t"), rx.java(r"\s+[-–—]\s+|:\s*", "")))
    parts = F.col("_parts")
    df = df.withColumns({
        "_left": _strip_trailing(text.trim(F.get(parts, F.lit(0)))),
        "_right": text.trim(F.array_join(
            F.slice(parts, 2, F.greatest(F.size(parts), F.lit(1))), " - "))})
    df = df.withColumn("_in", F.when(F.col("_left") != "", F.col("_left")
                                     ).otherwise(F.col("_right")))
    df = _with_head(_with_head(df, "_in", "_head"), "_t", "_whole")
    left, right, head, whole = (F.col(c) for c in ("_left", "_right", "_head", "_whole"))
    split = F.size(parts) >= 2

    def done(brand, model, confidence):
        return F.struct(brand.cast("string").alias("brand"),
                        model.cast("string").alias("model"),
                        F.lit(confidence).alias("confidence"))

    def full(p):
        return (F.coalesce(p["brand"], F.lit("")) != "") & (
            F.coalesce(p["model"], F.lit("")) != "")
    nothing = done(F.lit(None), F.lit(None), 0.0)
    result = (
        F.when(F.col("_t") == "", nothing)
        .when(split & full(head), done(head["brand"], _canonical_model(
            head["brand"], head["model"]), 0.95))
        .when(split & rx.test(right, r"\s"), done(
            F.nullif(left, F.lit("")),
            _canonical_model(left, _refine_title_model(right)), 0.7))
        .when(full(whole), done(whole["brand"], _canonical_model(
            whole["brand"], whole["model"]), 0.8))
        .otherwise(nothing))
    return df.withColumn(out, result).drop(
        "_t", "_parts", "_left", "_right", "_in", "_head", "_whole")


def score_by_title(brand: Column, model: Column, t_brand: Column, t_model: Column) -> Column:
    """2 for the same brand, up to 2 for shared model words."""
    flat = lambda c: F.trim(F.regexp_replace(F.lower(c), r"[^a-z0-9]+", " "))
    toks = lambda c: F.filter(F.array_distinct(F.split(flat(c), " ")),
                              lambda w: (w != "") & ~w.isin(rules.MODEL_TOKEN_STOP))
    overlap = F.size(F.array_intersect(toks(model), toks(t_model)))
    same = F.coalesce(flat(brand) == flat(t_brand), F.lit(False))
    return (F.when(same, 2).otherwise(0)
            + F.when(model.isNull() | t_model.isNull(), 0)
            .when(overlap >= 2, 2).when(overlap == 1, 1).otherwise(0))
