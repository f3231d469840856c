"""Keyword windows, value collection and ambiguity resolution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from specforge import rules
from specforge.functions import regex as rx
from specforge.functions import text, units
from specforge.operators.blocks import mark_heights, marked_contexts, marked_matches, match_contexts

_WINDOW = "array<struct<start:bigint,end:bigint>>"


def keyword_windows(content: Column, radius: int = rules.WINDOW_RADIUS,
                    terms=tuple(rules.WINDOW_TERMS)) -> Column:
    """struct(hit_count, windows array<struct(start, end)>), offsets from 0.

    The text is split in front of every hit; hits closer than two radii join
    one window, so only gaps are kept and the fold stays linear.  Without a hit
    the whole text is the window.
    """
    ahead = "(?=" + "|".join(rx.literal(t) for t in terms) + ")"
    lens = F.transform(F.split(F.concat(F.lit("\x01"), F.lower(content)), ahead),
                       lambda p: F.length(p).cast("bigint"))
    bound = F.struct(lens.alias("lens"), F.length(content).cast("bigint").alias("size"))
    return F.when(content.isNotNull(), text.let(
        bound, lambda b: _windows_of(b["lens"], b["size"], radius)))


def _windows_of(lens: Column, size: Column, radius: int) -> Column:
    hits = F.size(lens) - 1
    big = F.lit(radius).cast("bigint")

    def window(first, last):
        return F.struct(F.greatest(F.lit(0).cast("bigint"), first - big).alias("start"),
                        F.least(size, last + big).alias("end"))

    def step(acc, n):  # acc.pos is the offset of the hit that this part starts with
        gap = acc["pos"] - big > F.least(size, acc["last"] + big)
        return F.struct(
            F.when(gap, F.concat(acc["out"], F.array(window(acc["first"], acc["last"]))))
            .otherwise(acc["out"]).alias("out"),
            F.when(gap, acc["pos"]).otherwise(acc["first"]).alias("first"),
            acc["pos"].alias("last"), (acc["pos"] + n).alias("pos"))
    start = F.get(lens, F.lit(0)) - 1
    none = F.array().cast(_WINDOW)
    folded = F.aggregate(
        text.tail(lens),
        F.struct(none.alias("out"), start.alias("first"), start.alias("last"),
                 start.alias("pos")), step,
        lambda acc: F.concat(acc["out"], F.array(window(acc["first"], acc["last"]))))
    whole = F.array(F.struct(F.lit(0).cast("bigint").alias("start"), size.alias("end")))
    return F.struct(
        hits.alias("hit_count"),
        F.when(hits > 0, folded).otherwise(whole).cast(_WINDOW).alias("windows"))


def cap_windows(windows: Column, max_total_chars: int) -> Column:
    """Earliest windows up to a character budget; the last one is cut."""
    budget = F.lit(max_total_chars).cast("bigint")

    def step(acc, w):
        room = budget - acc["used"]
        take = F.least(w["end"] - w["start"], room)
        cut = F.struct(w["start"].alias("start"), (w["start"] + take).alias("end"))
        return F.struct(
            F.when(room > 0, F.concat(acc["out"], F.array(cut))).otherwise(acc["out"]).alias("out"),
            (acc["used"] + F.greatest(take, F.lit(0))).cast("bigint").alias("used"))
    return F.aggregate(windows, F.struct(F.array().cast(_WINDOW).alias("out"),
                                         F.lit(0).cast("bigint").alias("used")),
                       step, lambda acc: acc["out"])


def window_texts(content: Column, windows: Column) -> Column:
    return text.let(content, lambda c: F.transform(windows, lambda w: F.substring(
        c, (w["start"] + 1).cast("int"), (w["end"] - w["start"]).cast("int"))))


# --- values of all windows ----------------------------------------------------

def _numbers(texts: Column, field: str, sub: str | None = None) -> Column:
    pattern, low, high = rules.VALUE_PATTERNS[field]

    def one(t):
        if sub:
            hits = F.transform(marked_matches(mark_heights(t, field)), lambda h: F.regexp_extract(h, sub, 0))
        else:
            hits = rx.pick_all(t, pattern, 1)
        return F.transform(hits, lambda h: h.try_cast("double"))
    return F.filter(F.flatten(F.transform(texts, one)), lambda v: v.between(low, high))


def with_values(df: DataFrame, texts: str) -> DataFrame:
    """Add distinct value arrays: price, drop, weight, heel, forefoot (`v_*`).

    Order is the order of discovery, window by window; a stated stack height
    replaces the looser heel matches.
    """
    t = F.col(texts)
    # per window: grams before ounces, as they are found
    gp, glo, ghi = rules.VALUE_PATTERNS["grams"]
    op, olo, ohi = rules.VALUE_PATTERNS["oz"]
    weights = F.flatten(F.transform(t, lambda w: F.concat(
        F.filter(F.transform(rx.pick_all(w, gp), lambda h: h.try_cast("double")),
                 lambda v: v.between(glo, ghi)),
        F.transform(F.filter(F.transform(rx.pick_all(w, op), lambda h: h.try_cast("double")),
                             lambda v: v.between(olo, ohi)),
                    lambda v: units.oz_to_grams(v, rules.OZ_TO_GRAMS_TEXT)))))
    df = df.withColumns({
        "v_price": F.array_distinct(_numbers(t, "price")),
        "v_drop": F.array_distinct(_numbers(t, "drop")),
        "v_weight": F.array_distinct(weights),
        "_stack": F.array_distinct(_numbers(t, "stack")),
        "_heel": F.array_distinct(_numbers(t, "heel", r"\d{2}")),
        "v_forefoot": F.array_distinct(_numbers(t, "forefoot", r"\d{2}"))})
    return df.withColumn("v_heel", F.when(F.size("_stack") > 0, F.col("_stack"))
                         .otherwise(F.col("_heel"))).drop("_stack", "_heel")


VALUE_COLUMNS = ["v_price", "v_drop", "v_weight", "v_heel", "v_forefoot"]


def snippets(texts: Column) -> Column:
    """struct of snippet arrays per field: each match with 200 characters around."""
    r = rules.SNIPPET_RADIUS

    def found(t, field):
        pattern, low, high = rules.VALUE_PATTERNS[field]
        around = (marked_contexts(mark_heights(t, field), r, r) if field in ("heel", "forefoot")
                  else match_contexts(t, pattern, r, r))
        hits = F.transform(around, lambda h: F.struct(
            F.concat(h["before"], h["match"], h["after"]).alias("s"),
            F.regexp_extract(h["match"], r"\d+(?:\.\d+)?", 0).try_cast("double").alias("v")))
        return F.transform(F.filter(hits, lambda x: x["v"].between(low, high)), lambda x: x["s"])

    def of(*fields):
        return F.flatten(F.transform(texts, lambda t: F.concat(*[found(t, f) for f in fields])))
    return F.struct(of("price").alias("price_snippets"), of("drop").alias("drop_snippets"),
                    of("grams", "oz").alias("weight_snippets"),
                    of("stack", "heel").alias("heel_snippets"),
                    of("forefoot").alias("forefoot_snippets"))


SNIPPET_FIELDS = ["price_snippets", "drop_snippets", "weight_snippets", "heel_snippets",
                  "forefoot_snippets"]


def snippet_score(s: Column) -> Column:
    points = [F.when(rx.test(s, p), n).otherwise(0) for p, n in rules.SNIPPET_SCORES]
    number, word, n = rules.SNIPPET_HEIGHT
    points.append(F.when(F.exists(F.split(s, r"[\n\r\x{2028}\x{2029}]"), lambda x: rx.test(x, word) & rx.test(x, number)),
                         n).otherwise(0))
    anchors = text.let(F.lower(s), lambda low: text.sum_of(
        [F.contains(low, F.lit(a)).cast("int") for a in rules.SNIPPET_ANCHORS]))
    return text.sum_of([*points, anchors])


def top_snippets(all_snippets: Column, n: int | None = None) -> Column:
    """Positive snippets, best first, ties in their order; the n best if given."""
    scored = F.transform(all_snippets, lambda s, i: F.struct(
        (-snippet_score(s)).alias("k"), i.alias("i"), s.alias("s")))
    ranked = F.array_sort(F.filter(scored, lambda x: x["k"] < 0))
    return F.transform(ranked if n is None else F.slice(ranked, 1, n), lambda x: x["s"])


def _cluster(s: Column, i: Column) -> Column:
    """Values and score of a snippet; each pattern runs once (a lambda shares nothing by itself)."""
    def height(field):
        hit = F.get(marked_matches(mark_heights(s, field)), F.lit(0))
        return F.regexp_extract(hit, r"\d{2}", 0).try_cast("double")
    read = {"grams": (rx.pick_num(s, r"(\d{2,4})\s*(?:g|grams)\b"), 50, 1000),
            "oz": (rx.pick_num(s, r"(\d{1,2}(?:\.\d)?)\s*(?:oz|ounces)\b"), 3, 30),
            "drop": (rx.pick_num(s, rules.CLUSTER_DROP), 0, 25),
            "heel": (height("heel"), 5, 60), "fore": (height("forefoot"), 5, 60),
            "price": (rx.pick_num(s, rules.VALUE_PATTERNS["price"][0]), 50, 500)}
    found = F.struct(*[v.alias(k) for k, (v, _, _) in read.items()])
    return text.let(found, lambda f: text.let(
        F.struct(*[F.when(f[k].between(low, high), f[k]).alias(k) for k, (_, low, high) in read.items()]),
        lambda v: _scored(v, i)))


def _scored(v: Column, i: Column) -> Column:
    oz = units.oz_to_grams(v["oz"], rules.OZ_TO_GRAMS_TEXT)
    points = lambda c, n: F.when(c.isNotNull(), n).otherwise(0)
    score = text.sum_of([points(v["grams"], 2), points(oz, 2), points(v["drop"], 2),
                         points(v["heel"], 2), points(v["fore"], 2), points(v["price"], 1)])
    weight = F.coalesce(oz, v["grams"])
    groups = text.sum_of([points(weight, 1), points(v["drop"], 1),
                          points(F.coalesce(v["heel"], v["fore"]), 1), points(v["price"], 1)])
    return F.struct(score.alias("score"), i.alias("source"), groups.alias("groups"),
                    weight.alias("weight_g"), v["drop"].alias("drop_mm"), v["heel"].alias("heel_mm"),
                    v["fore"].alias("forefoot_mm"), v["price"].alias("price_usd"))


def best_cluster(top: Column) -> Column:
    """Best snippet with two or more value groups; null unless it stands alone.

    First wins on equal scores; another within 90 % of the best leaves the case
    open (`competing`).
    """
    all_ = F.filter(F.transform(top, _cluster), lambda c: c["groups"] >= 2)
    return F.aggregate(
        all_, F.struct(F.lit(None).cast(
            "struct<score:int,source:int,groups:int,weight_g:double,drop_mm:double,"
            "heel_mm:double,forefoot_mm:double,price_usd:double>").alias("best"),
            F.lit(0).alias("second")),
        lambda acc, c: F.when(
            acc["best"].isNull() | (c["score"] > acc["best"]["score"]),
            F.struct(c.alias("best"), F.greatest(
                acc["second"], F.coalesce(acc["best"]["score"], F.lit(0))).alias("second"))
        ).otherwise(F.struct(acc["best"].alias("best"),
                             F.greatest(acc["second"], c["score"]).alias("second"))),
        lambda acc: F.when(acc["best"].isNotNull(), F.struct(
            acc["best"].alias("cluster"),
            (acc["second"] >= acc["best"]["score"] * 0.9).alias("competing"))))


RESULT = ["mode", "reason", "single_reason", "price_usd", "drop_mm", "weight_g",
          "heel_mm", "forefoot_mm", "candidates"]


def resolve_windows(df: DataFrame, texts: str, most: int | None = None,
                    chars: int | None = None) -> DataFrame:
    """Add the extraction outcome of a text's windows (columns of `RESULT`).

    One value per field is `single`; several with a unique drop and heel take
    the first weight; else the best snippet decides; else `ambiguous_multi`
    with its candidates per field (`most` of them, cut to `chars`, if given);
    nothing is `skipped`.
    Snippets are cut only for texts that need them.
    """
    df = with_values(df, texts)
    first = {n: F.get(F.col(f"v_{n}"), F.lit(0)) for n in
             ("price", "drop", "weight", "heel", "forefoot")}
    multiple = F.greatest(*[F.size(c) for c in VALUE_COLUMNS]) > 1
    found = F.greatest(*[F.size(c) for c in VALUE_COLUMNS]) > 0
    unique = multiple & (F.size("v_drop") == 1) & (F.size("v_heel") == 1)
    df = df.withColumns({"_multiple": multiple, "_unique": unique, "_found": found})
    df = df.withColumn("_snip", F.when(F.col("_multiple") & ~F.col("_unique"),
                                       snippets(F.col(texts))))
    df = df.withColumn("_best", best_cluster(top_snippets(
        F.concat(*[F.col(f"_snip.{f}") for f in SNIPPET_FIELDS]))))
    joined = F.coalesce(~F.col("_best.competing"), F.lit(False))
    state = (F.when(F.col("_unique"), "unique").when(~F.col("_multiple") & F.col("_found"), "plain")
             .when(~F.col("_found"), "none").when(joined, "cluster").otherwise("open"))
    df = df.withColumn("_state", state)
    s = F.col("_state")

    def value(name, cluster):
        return F.when(s.isin("unique", "plain"), first[name]).when(
            s == "cluster", F.col(f"_best.cluster.{cluster}"))
    def cut(c):
        c = c if most is None else F.slice(c, 1, most)
        return c if chars is None else F.transform(c, lambda x: F.substring(x, 1, chars))
    candidates = F.when(s == "open", F.struct(*[
        cut(F.col(f"_snip.{f}")).alias(f)
        for f in SNIPPET_FIELDS]))
    return df.withColumns({
        "mode": F.when(s == "open", "ambiguous_multi").when(s == "none", "skipped")
        .otherwise("single"),
        "reason": F.when(s == "none", "no_specs_found"),
        "single_reason": F.when(s == "unique", "unique_drop_and_heel_with_multiple_weights")
        .when(s == "cluster", "proximity_join"),
        "price_usd": value("price", "price_usd"), "drop_mm": value("drop", "drop_mm"),
        "weight_g": value("weight", "weight_g"), "heel_mm": value("heel", "heel_mm"),
        "forefoot_mm": value("forefoot", "forefoot_mm"), "candidates": candidates,
    }).drop("_multiple", "_unique", "_found", "_snip", "_best", "_state")
