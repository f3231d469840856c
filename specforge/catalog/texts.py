"""Queries of the text predicates and title operators (F*, E1, E2, E10, E19, E20)."""

from __future__ import annotations

from pyspark.sql import functions as F

from specforge import rules
from specforge.catalog import duck as d
from specforge.catalog import query
from specforge.functions import keys
from specforge.functions import regex as rx
from specforge.operators import classify, fallback, profile, resolve, titles

C = F.col


def _relevance_sql(negative) -> str:
    neg, pos = rx.any_of(negative), rx.any_of(rules.SHOE_TERMS)
    traits = " + ".join(f"cast({d.m('content', p)} as int)" for p in rules.CHARACTERISTIC_PATTERNS)
    return f"""SELECT doc_id, split_part(r, ' ', 1) = 'keep' AS keep, split_part(r, ' ', 2) AS stage,
 split_part(r, ' ', 3) AS reason FROM (SELECT doc_id, CASE WHEN {d.m('lower(title)', neg)} THEN 'drop title negative_term'
 WHEN {d.m('lower(title)', pos)} THEN 'keep title positive_term'
 WHEN coalesce(content, '') = '' THEN 'drop content no_content'
 WHEN {d.m('content', pos)} THEN 'keep content positive_term' WHEN {traits} >= 3 THEN 'keep content characteristics'
 WHEN {d.m('content', neg)} THEN 'drop content negative_term' ELSE 'drop content no_indicator' END AS r FROM articles)"""


@query("relevance", "F1", _relevance_sql(rules.NON_SHOE_TERMS))
def relevance(t):
    r = classify.relevance(C("title"), C("content"))
    return t.articles.select("doc_id", r.alias("r")).select("doc_id", "r.*")


@query("relevance_substrings", "F1", _relevance_sql(rules.NON_SHOE_TERMS_SUBSTRING))
def relevance_substrings(t):
    r = classify.relevance(C("title"), C("content"), strict_substrings=True)
    return t.articles.select("doc_id", r.alias("r")).select("doc_id", "r.*")


@query("review_terms", "F2", f"""SELECT doc_id, {d.m('title', rx.any_of(rules.REVIEW_TERMS))} AS title_hit,
 {d.m('content', rx.any_of(rules.REVIEW_TERMS))} AS content_hit FROM articles""")
def review_terms(t):
    return t.articles.select("doc_id", classify.mentions_review(C("title")).alias("title_hit"),
                             classify.mentions_review(C("content")).alias("content_hit"))


@query("product_articles", "F3", f"""SELECT doc_id FROM articles WHERE {d.m("title || ' ' || content", rules.SHOE_WORDS)}
 AND {d.m("title || ' ' || content", rules.CONTEXT_WORDS)} AND NOT {d.m("title || ' ' || content", rules.EXCLUSION_WORDS)}""")
def product_articles(t):
    return t.articles.filter(classify.is_product_article(C("title"), C("content"))).select("doc_id")


def _score_sql() -> tuple[str, dict]:
    terms = classify.term_patterns()
    cnt = [f"least(len({d.xa('c', p.lower(), 0, '')}), 3)" for _, _, p in terms]
    pos = " + ".join(f"{n} * {rules.SCORE_WEIGHTS[g]}::double" for (g, _, _), n in zip(terms, cnt) if g != "negative")
    neg = " + ".join(f"{n} * 3.0::double" for (g, _, _), n in zip(terms, cnt) if g == "negative")
    ev = " + ".join(f"cast({d.m('c', p, '')} as int)" for p, _, _ in rules.EVIDENCE_PATTERNS)
    anchor = " OR ".join(d.m("c", p) for p in rules.ANCHOR_PATTERNS)
    spec = " OR ".join(f"{n} > 0" for (g, w, _), n in zip(terms, cnt)
                       if g in ("high", "medium") and not any(x in w for x in rules.SCORE_LOW))
    negs = ", ".join(f"CASE WHEN {n} > 0 THEN {d.s(w)} END" for (g, w, _), n in zip(terms, cnt) if g == "negative")
    body = f"""SELECT doc_id, {pos} + {ev} AS pos, {neg} AS neg, ({anchor}) AS anchor, ({spec}) AS spec,
      array_to_string(list_filter([{negs}], lambda x: x IS NOT NULL)[1:5], '|') AS neg_hits FROM (SELECT doc_id, lower(content) AS c FROM articles)"""
    sql = """SELECT doc_id, greatest(0.0, pos - neg) + CASE WHEN anchor THEN 5.0 ELSE 0.0 END AS score, neg AS negative,
 anchor AS has_anchor, neg_hits, greatest(0.0, pos - neg) + CASE WHEN anchor THEN 5.0 ELSE 0.0 END >= 8 AND neg < 6 AND spec AS ok FROM scored"""
    return sql, {"scored": body}


@query("score_prefilter", "F4", *_score_sql())
def score_prefilter(t):
    df = classify.with_prefilter(t.articles.select("doc_id", "content"), "content", "p_")
    return df.select("doc_id", C("p_score").alias("score"), C("p_negative").alias("negative"),
                     C("p_has_anchor").alias("has_anchor"),
                     F.array_join("p_neg_hits", "|").alias("neg_hits"), C("p_ok").alias("ok"))


def _found(c: str, terms) -> str:
    return f"list_filter({'[' + ', '.join(d.s(w) for w in terms) + ']'}, lambda w: contains({c}, w))"


_COMP = ", ".join("CASE WHEN " + " AND ".join(f"contains(t, {d.s(w)})" for w in ws) + f" THEN {d.s(n)} END"
                  for ws, n in rules.TITLE_COMPOUNDS)


@query("title_prefilter", "F5", f"""SELECT doc_id, CASE WHEN len(p) > 0 OR len(n) = 0 THEN 'pass' ELSE 'skip' END AS decision,
 array_to_string(p, '|') AS positives, CASE WHEN len(p) > 0 THEN '' ELSE array_to_string(n, '|') END AS negatives
 FROM (SELECT doc_id, {_found('t', rules.TITLE_POSITIVES)} AS p,
   list_concat({_found('t', rules.TITLE_NEGATIVES)}, list_filter([{_COMP}], lambda x: x IS NOT NULL)) AS n
   FROM (SELECT doc_id, lower(title) AS t FROM articles))""")
def title_prefilter(t):
    df = t.articles.select("doc_id", classify.title_prefilter(C("title")).alias("r"))
    return df.select("doc_id", "r.decision", F.array_join("r.positives", "|").alias("positives"),
                     F.array_join("r.negatives", "|").alias("negatives"))


_HAY = "coalesce(title, '') || ' ' || coalesce(key, '') || ' ' || coalesce(model, '')"


def _irrelevance_sql(select: str) -> str:
    return f"""SELECT {select} FROM (SELECT doc_id, CASE WHEN {d.m(_HAY, rules.LISTICLE)} THEN 'listicle'
 WHEN {d.m(_HAY, rules.APPAREL)} THEN 'apparel' WHEN {d.m(_HAY, rules.NON_SHOE)} THEN 'nonshoe'
 WHEN {d.m('trim(brand)', rules.BAD_BRAND)} THEN 'badbrand' WHEN {d.m(d.trim('model'), rules.BAD_MODEL)} THEN 'badmodel'
 WHEN length({d.trim('brand')}) > 25 THEN 'badbrand' WHEN length({d.trim('model')}) > 50 THEN 'badmodel'
 WHEN len(regexp_split_to_array({d.trim('model')}, {d.s('[' + rx.BLANK + ']+')})) > 6 THEN 'badmodel' END AS reason
 FROM (SELECT doc_id, title, split_part(title, ' ', 1) AS brand, substring(title, length(split_part(title, ' ', 1)) + 2) AS model,
   {d.key_part('title')} AS key FROM articles))"""


def _irrelevant(t):
    brand = F.split_part("title", F.lit(" "), F.lit(1))
    model = F.substring(C("title"), F.length(brand) + 2, F.length("title"))
    return t.articles.select("doc_id", "title", brand.alias("brand"), model.alias("model"),
                             keys.key_part(C("title")).alias("key"))


@query("irrelevance", "F6", _irrelevance_sql("doc_id, reason"))
def irrelevance(t):
    r = classify.irrelevance(C("title"), C("key"), C("model"), C("brand"))
    return classify.apply_irrelevance(_irrelevant(t), r, "soft", "reason").select("doc_id", "reason")


@query("irrelevance_hard", "F6", _irrelevance_sql("doc_id") + " WHERE reason IS NULL")
def irrelevance_hard(t):
    r = classify.irrelevance(C("title"), C("key"), C("model"), C("brand"))
    return classify.apply_irrelevance(_irrelevant(t), r).select("doc_id")


@query("product_gate", "F7", f"""SELECT id FROM (SELECT id, lower(trim(brand_name)) AS b,
  lower(trim(model || CASE id % 7 WHEN 0 THEN ' jacket' WHEN 1 THEN ' trail' ELSE '' END)) AS m,
  CASE WHEN id % 5 = 0 THEN 'Acme' END AS other FROM products) WHERE coalesce(other, b) IS NOT NULL AND m <> ''
 AND NOT {d.m('m', '|'.join(rx.literal(k) for k in rules.NON_SNEAKER_KEYWORDS), '')}
 AND (lower(coalesce(other, b)) IN {d.in_list(rules.FOOTWEAR_BRANDS)} OR {d.m('m', '|'.join(rules.SNEAKER_KEYWORDS), '')}
   OR {d.m('m', rx.any_of(rules.FOOTWEAR_PATTERNS))})""")
def product_gate(t):
    tail = F.when(C("id") % 7 == 0, " jacket").when(C("id") % 7 == 1, " trail").otherwise("")
    brand = F.when(C("id") % 5 == 0, "Acme").otherwise(C("brand_name"))
    return t.products.filter(classify.is_footwear(brand, F.concat("model", tail))).select("id")


_MODEL7 = "model || CASE id % 9 WHEN 0 THEN ' hydration  pack' WHEN 1 THEN ' Cap' WHEN 2 THEN ' vest' ELSE '' END"
_CLEAN = f"""SELECT id, CASE {' '.join(f"WHEN {d.m(dict(brand_name='brand_name', model='m', primary_use='primary_use')[f], p)} THEN {d.s(f + '>' + c)}" for f, p, c in rules.CLEANUP_RULES)} END AS hit
 FROM (SELECT id, brand_name, {_MODEL7} AS m, primary_use FROM products)"""


def _cleanup(t):
    tail = (F.when(C("id") % 9 == 0, " hydration  pack").when(C("id") % 9 == 1, " Cap")
            .when(C("id") % 9 == 2, " vest").otherwise(""))
    cols = {"brand_name": C("brand_name"), "model": F.concat("model", tail), "primary_use": C("primary_use")}
    return t.products.select("id", classify.cleanup_category(cols).alias("c"))


@query("cleanup_rules", "F8", f"""SELECT id, split_part(hit, '>', 2) AS category,
 split_part(hit, '>', 1) || ' matches ' || split_part(hit, '>', 2) AS reason FROM ({_CLEAN}) WHERE hit IS NOT NULL""")
def cleanup_rules(t):
    return _cleanup(t).filter("c is not null").select("id", "c.*")


@query("cleanup_kept", "F8", f"SELECT id FROM ({_CLEAN}) WHERE hit IS NULL")
def cleanup_kept(t):
    return _cleanup(t).filter("c is null").select("id")


@query("category_report", "A13", f"""SELECT split_part(hit, '>', 2) AS outcome, count(*) AS n FROM ({_CLEAN})
 WHERE hit IS NOT NULL GROUP BY 1""")
def category_report(t):
    return profile.outcome_counts(_cleanup(t).filter("c is not null"), "c.category")


_CHAR = """(coalesce(heel_height, 0) <> 0 OR coalesce(forefoot_height, 0) <> 0 OR coalesce(weight, 0) <> 0
 OR coalesce(price, 0) <> 0 OR coalesce(trim(primary_use), '') <> '' OR coalesce(trim(surface_type), '') <> ''
 OR coalesce(trim(cushioning_type), '') <> '' OR coalesce(trim(foot_width), '') <> '' OR coalesce(trim(upper_breathability), '') <> ''
 OR "drop" IS NOT NULL OR carbon_plate IS NOT NULL OR waterproof IS NOT NULL)"""


@query("valid_specs", "F9", f"""SELECT id FROM products WHERE length(trim(brand_name)) BETWEEN 2 AND 30
 AND length(trim(model)) BETWEEN 2 AND 50 AND NOT {d.m('trim(model)', rules.INVALID_MODELS)} AND {_CHAR}""")
def valid_specs(t):
    return t.products.filter(classify.valid_spec()).select("id")


@query("complete_specs", "F10", """SELECT id, coalesce(heel_height, 0) <> 0 OR coalesce("drop", 0) <> 0 AS strict_ok FROM products
 WHERE (coalesce(heel_height, 0) <> 0 OR "drop" IS NOT NULL) AND (coalesce(primary_use, '') <> '' OR coalesce(surface_type, '') <> '')""")
def complete_specs(t):
    return t.products.filter(classify.complete_spec()).select("id", classify.complete_spec(False).alias("strict_ok"))


@query("core_rejects", "F11", """SELECT id, 'core_empty' AS reason FROM products
 WHERE primary_use IS NULL AND surface_type IS NULL AND heel_height IS NULL AND weight IS NULL
 UNION ALL SELECT id, 'ok' FROM products WHERE NOT (primary_use IS NULL AND surface_type IS NULL AND heel_height IS NULL AND weight IS NULL)""")
def core_rejects(t):
    ok, bad = classify.split_core(t.products)
    return bad.select("id", "reason").unionAll(ok.select("id", F.lit("ok").alias("reason")))


@query("excluded_brands", "F14", f"""SELECT id, s AS brand FROM (SELECT id, CASE id % 6 WHEN 0 THEN 'Garmin ' WHEN 1 THEN 'polar'
 ELSE brand_name END AS s FROM products) WHERE coalesce(lower(trim(s)), '') <> '' AND lower(trim(s)) NOT IN {d.in_list(rules.EXCLUDED_BRANDS)}""")
def excluded_brands(t):
    b = F.when(C("id") % 6 == 0, "Garmin ").when(C("id") % 6 == 1, "polar").otherwise(C("brand_name"))
    return t.products.select("id", b.alias("brand")).filter(classify.not_excluded(C("brand")))


@query("suspicious_pages", "F15", f"""SELECT page_id, {d.m('html', rx.any_of(rules.SUSPICIOUS))} AS suspicious FROM pages""")
def suspicious_pages(t):
    return t.pages.select("page_id", classify.suspicious(C("html")).alias("suspicious"))


# --- titles --------------------------------------------------------------------

_RV = rules.TITLE_REVIEW


def _analysis_ctes() -> dict:
    known = " ".join(f"WHEN contains(t, {d.s(m)}) THEN {d.s(b + '|' + m)}" for m, b in rules.MODEL_TO_BRAND.items())
    anyknown = "(" + " OR ".join(f"contains(t, {d.s(m)})" for m in rules.MODEL_TO_BRAND) + ")"
    alias = lambda c: f"coalesce({d.mapping(f'upper({c})', rules.BRAND_ALIASES)}, {c})"
    b_only = []
    for b in rules.TITLE_BRANDS:
        pres = d.m("t", rf"\b{b}\b")
        focus = d.m("t", rf"\b\d+\s+{b}|best\s+{b}|top\s+{b}|{b}\s+(?:running\s+)?shoes?")
        name = rules.BRAND_ALIASES.get(b.upper(), b)
        b_only.append(f"WHEN {pres} AND {focus} THEN {d.s(name + '|0.95')}")
        b_only.append(f"WHEN {pres} AND NOT {d.m('t', b + r'\s+[a-z]+\s+\d+')} AND NOT {anyknown} THEN {d.s(name + '|0.85')}")
    nb, nn, nm = titles._NUMBERED, titles._NAMED, titles._MODEL_ONLY
    return {"an0": f"SELECT doc_id, lower({d.trim('title')}) AS t FROM articles",
            "an1": f"""SELECT doc_id, t, CASE {known} END AS k, {d.x('t', nb, 1)} AS b1, {d.x('t', nb, 2)} || ' ' || {d.x('t', nb, 3)} AS m1,
 {d.x('t', nn, 1)} AS b2, {d.x('t', nn, 2)} AS m2, {d.x('t', nm, 1)} || ' ' || {d.x('t', nm, 2)} AS m3, CASE {' '.join(b_only)} END AS bo FROM an0""",
            "an": f"""SELECT doc_id, CASE WHEN k IS NOT NULL OR b1 IS NOT NULL OR b2 IN {d.in_list(rules.TITLE_BRANDS)}
   OR {d.mapping('m3', rules.MODEL_TO_BRAND)} IS NOT NULL THEN 'specific' WHEN bo IS NOT NULL THEN 'brand-only' ELSE 'general' END AS scenario,
 CASE WHEN k IS NOT NULL THEN split_part(k, '|', 1) WHEN b1 IS NOT NULL THEN {alias('b1')} WHEN b2 IN {d.in_list(rules.TITLE_BRANDS)} THEN {alias('b2')}
   WHEN {d.mapping('m3', rules.MODEL_TO_BRAND)} IS NOT NULL THEN {d.mapping('m3', rules.MODEL_TO_BRAND)} WHEN bo IS NOT NULL THEN split_part(bo, '|', 1) END AS brand,
 CASE WHEN k IS NOT NULL THEN split_part(k, '|', 2) WHEN b1 IS NOT NULL THEN m1 WHEN b2 IN {d.in_list(rules.TITLE_BRANDS)} THEN m2
   WHEN {d.mapping('m3', rules.MODEL_TO_BRAND)} IS NOT NULL THEN m3 END AS model,
 CASE WHEN k IS NOT NULL THEN 0.9::double WHEN b1 IS NOT NULL OR b2 IN {d.in_list(rules.TITLE_BRANDS)} OR {d.mapping('m3', rules.MODEL_TO_BRAND)} IS NOT NULL THEN 0.8::double
   WHEN bo IS NOT NULL THEN split_part(bo, '|', 2)::double ELSE 0.8::double END AS confidence FROM an1"""}


@query("title_analysis", "E1", "SELECT * FROM an", _analysis_ctes())
def title_analysis(t):
    return t.articles.select("doc_id", titles.analyze_title(C("title")).alias("a")).select("doc_id", "a.*")


def _loose_ctes() -> dict:
    brand = " ".join(f"WHEN {d.m('lower(t)', rf'\b{b.lower()}\b') if len(b) <= 2 else f'contains(lower(t), {d.s(b.lower())})'} THEN {d.s(b)}"
                     for b in rules.LOOSE_TITLE_BRANDS)
    return {"l0": f"SELECT doc_id, t, CASE {brand} END AS b FROM (SELECT doc_id, {d.trim('title')} AS t FROM articles)",
            "l1": f"""SELECT doc_id, t, b, {d.trim('substring(t, strpos(lower(t), lower(b)) + length(b))')} AS a FROM l0""",
            "l2": f"""SELECT *, {d.trim(d.x('a', rules.LOOSE_MODEL))} AS m, {d.m('t', rx.any_of(rules.LOOSE_GENERAL))} AS g,
 {d.m('t', rx.any_of(rules.LOOSE_NON_SHOE))} AS bad FROM l1""",
            "l3": f"""SELECT *, CASE WHEN bad THEN 'irrelevant' WHEN b IS NULL THEN 'general' WHEN g THEN 'brand-only'
 WHEN coalesce(m, '') <> '' AND {d.m('m', rules.LOOSE_NOT_MODEL)} THEN 'brand-only' WHEN coalesce(m, '') <> '' THEN 'specific' ELSE 'brand-only' END AS scenario FROM l2"""}


@query("title_analysis_loose", "E1b", f"""SELECT doc_id, scenario, CASE WHEN scenario IN ('specific', 'brand-only') THEN b END AS brand,
 CASE WHEN scenario = 'specific' THEN m END AS model, CASE WHEN bad THEN 0.0::double WHEN b IS NULL AND g THEN 0.8::double WHEN b IS NULL THEN 0.3::double WHEN g THEN 0.8::double
 WHEN scenario = 'specific' THEN CASE WHEN {d.m('m', rules.LOOSE_VERSION)} THEN 0.95::double WHEN {d.m('m', chr(92) + 'd')} THEN 0.85::double
   WHEN {d.m('m', rules.LOOSE_MODEL_WORDS)} THEN 0.75::double ELSE 0.5::double END
 WHEN coalesce(m, '') <> '' THEN 0.7::double WHEN {d.m('a', rules.LOOSE_COLLECTION)} THEN 0.8::double ELSE 0.6::double END AS confidence FROM l3""", _loose_ctes())
def title_analysis_loose(t):
    return t.articles.select("doc_id", titles.analyze_title_loose(C("title")).alias("a")).select("doc_id", "a.*")


@query("title_brand_model", "E2")
def title_brand_model(t):
    return titles.brand_model_from_title(t.articles.select("doc_id", "title"), "title").select(
        "doc_id", "title_bm.*")


@query("title_scope", "F12", """SELECT doc_id, p_id FROM scoped WHERE CASE WHEN scenario = 'general' THEN true
 WHEN scenario = 'brand-only' AND brand IS NOT NULL THEN coalesce(lower(p_brand) = lower(brand), false)
 WHEN scenario = 'specific' AND brand IS NOT NULL AND model IS NOT NULL THEN coalesce(lower(p_brand) = lower(brand) AND contains(lower(p_model), lower(model)), false)
 ELSE true END""", _analysis_ctes() | {"scoped": """SELECT an.*, p.id AS p_id, p.brand_name AS p_brand, p.model AS p_model FROM an JOIN products p ON p.source_id = an.doc_id"""})
def title_scope(t):
    an = t.articles.select("doc_id", titles.analyze_title(C("title")).alias("a"))
    p = t.products.select(C("id").alias("p_id"), C("source_id").alias("doc_id"), "brand_name", C("model").alias("p_model"))
    return an.join(p, "doc_id").filter(titles.in_scope(
        C("brand_name"), C("p_model"), C("a.scenario"), C("a.brand"), C("a.model"))).select("doc_id", "p_id")


_WORDS = f"list_filter(regexp_split_to_array(lower(p_model), {d.s('[' + rx.BLANK + ']+')}), lambda w: length(w) > 2)"
_DISC = """SELECT an.*, a.title, a.content, p.id AS p_id, p.brand_name AS p_brand, p.model AS p_model FROM an JOIN articles a USING (doc_id)
 JOIN products p ON p.source_id = an.doc_id"""


@query("title_scope_strict", "F13", f"""SELECT doc_id, p_id FROM (SELECT *, coalesce(list_sum(list_transform({_WORDS},
   lambda w: floor((length(content) - length(replace(lower(content), w, ''))) / length(w)))), 0) AS hits FROM scoped)
 WHERE CASE WHEN scenario IN ('specific', 'brand-only') AND brand IS NOT NULL THEN coalesce(lower(p_brand) = lower(brand), false)
 WHEN scenario = 'general' THEN coalesce(contains(lower(title), lower(p_brand)) AND hits >= 2, false) ELSE true END""",
       _analysis_ctes() | {"scoped": _DISC})
def title_scope_strict(t):
    an = t.articles.select("doc_id", "title", titles.analyze_title(C("title")).alias("a"))
    p = t.products.select(C("id").alias("p_id"), C("source_id").alias("doc_id"), "brand_name", C("model").alias("p_model"))
    hits = titles.mention_hits(t.articles, p, "doc_id", "content", "p_model")
    return an.join(p, "doc_id").join(hits, "doc_id", "left").filter(titles.in_scope_strict(
        C("brand_name"), C("title"), C("a.scenario"), C("a.brand"),
        F.coalesce(titles.hit_count(C("p_model"), C("hits")), F.lit(0)))).select("doc_id", "p_id")


_SIG = f"list_filter(regexp_split_to_array(lower(model), {d.s('[' + rx.BLANK + ']+')}), lambda w: length(w) > 2 AND w NOT IN {d.in_list(rules.MENTION_WORD_STOP)})"


@query("model_mentioned", "F13", f"""SELECT id, CASE WHEN len({_SIG}) > 0 THEN len(list_filter({_SIG}, lambda w: contains(lower(content), w))) / len({_SIG}) >= 0.7
 ELSE false END AS mentioned FROM products JOIN articles ON products.source_id = articles.doc_id""")
def model_mentioned(t):
    a = t.articles.select(C("doc_id").alias("source_id"), "content")
    rows = t.products.select("id", "source_id", "model")
    hits = titles.mention_hits(a, rows, "source_id", "content", "model")
    return rows.join(a.select("source_id"), "source_id").join(hits, "source_id", "left").select(
        "id", F.coalesce(titles.model_hit(C("model"), C("hits")), F.lit(False)).alias("mentioned"))


@query("frequent_phrase", "E10", f"""SELECT doc_id, arg_min(phrase, first_pos) AS phrase, max(n) AS n FROM (
 SELECT *, max(n) OVER (PARTITION BY doc_id) AS best FROM (SELECT doc_id, phrase, count(*) AS n, min(pos) AS first_pos FROM (
  SELECT doc_id, unnest(ps) AS phrase, generate_subscripts(ps, 1) AS pos FROM (
   SELECT doc_id, {d.xa('content', rf"{chr(92)}b([A-Z][a-z]+(?:{chr(92)}s[A-Z][a-z]+)?){chr(92)}b", 1, '')} AS ps FROM articles))
  WHERE phrase NOT IN {d.in_list(rules.PHRASE_STOP)} GROUP BY 1, 2)) WHERE n = best AND n > 1 GROUP BY doc_id""")
def frequent_phrase(t):
    return fallback.frequent_phrase(t.articles.select("doc_id", "content"), "content", "doc_id")


@query("comparisons", "E19")
def comparisons(t):
    full = F.concat_ws("\n\n", "title", "content")
    return t.articles.select("doc_id", F.posexplode(fallback.comparisons(full)).alias("no", "p")).select(
        "doc_id", "no", "p.left", "p.right")


@query("title_comparisons", "E19", f"""SELECT doc_id, {d.trim('l')} AS "left", {d.trim('r')} AS "right" FROM (
 SELECT doc_id, regexp_extract(title, {d.re2(r'(\w+(?:\s+\w+)*)\s+(?:vs\.?|versus|compared?\s+to)\s+(\w+(?:\s+\w+)*)')}, 1) AS l,
  regexp_extract(title, {d.re2(r'(\w+(?:\s+\w+)*)\s+(?:vs\.?|versus|compared?\s+to)\s+(\w+(?:\s+\w+)*)')}, 2) AS r FROM articles) WHERE l <> ''""")
def title_comparisons(t):
    return t.articles.select("doc_id", F.explode(fallback.comparisons(C("title"))).alias("p")).select("doc_id", "p.*")


@query("request_texts", "E20", """SELECT doc_id, md5('Title: ' || title || chr(10) || chr(10) || CASE WHEN scenario = 'specific' AND brand IS NOT NULL AND model IS NOT NULL
  THEN 'Focus on extracting specifications for: ' || brand || ' ' || model WHEN scenario = 'brand-only' AND brand IS NOT NULL
  THEN 'Focus on extracting ' || brand || ' models with their specifications' ELSE 'Extract all running shoe models with their specifications' END
  || chr(10) || chr(10) || 'Content: ' || content) AS digest FROM an JOIN articles USING (doc_id) WHERE title <> ''""",
       {k: v for k, v in _analysis_ctes().items()})
def request_texts(t):
    df = t.articles.select("doc_id", "title", "content", titles.analyze_title(C("title")).alias("a"))
    return df.filter("title <> ''").select("doc_id", F.md5(resolve.request_text(
        C("title"), C("content"), C("a.scenario"), C("a.brand"), C("a.model"))).alias("digest"))


@query("snippet_prompts", "E20", """SELECT doc_id, length(p) AS chars, md5(p) AS digest FROM (SELECT doc_id, '- price_snippets:' || chr(10) || coalesce(array_to_string(list_transform(list_filter(string_split(content, chr(10)), lambda w: contains(w, '$')), lambda w: '  * ' || CASE WHEN length(w) > 300 THEN substr(w, 1, 300) || '...' ELSE w END || chr(10)), ''), '')
 || '- drop_snippets:' || chr(10) || coalesce(array_to_string(list_transform(list_filter(string_split(content, chr(10)), lambda w: contains(w, ' mm')), lambda w: '  * ' || CASE WHEN length(w) > 300 THEN substr(w, 1, 300) || '...' ELSE w END || chr(10)), ''), '') AS p FROM articles)""")
def snippet_prompts(t):
    """The lines of an article that name a price or a length, as the snippet part of a request."""
    of = lambda word: F.filter(F.split("content", "\n"), lambda x: F.contains(x, F.lit(word)))
    found = F.struct(of("$").alias("price_snippets"), of(" mm").alias("drop_snippets"))
    prompt = resolve.candidate_lines(found, ["price_snippets", "drop_snippets"], chars=300)
    return t.articles.select("doc_id", prompt.alias("p")).select("doc_id", F.length("p").alias("chars"), F.md5("p").alias("digest"))


@query("comparison_context", "E20")
def comparison_context(t):
    c = resolve.comparison_context(C("title"), C("content"))
    return t.articles.select("doc_id", c.alias("context")).select(
        "doc_id", F.length("context").alias("chars"), F.md5("context").alias("digest"),
        F.startswith("context", F.lit("COMPARISONS FOUND")).alias("has_pairs"))


@query("score_by_title", "N7")
def score_by_title(t):
    df = titles.brand_model_from_title(t.articles.select("doc_id", "title"), "title")
    p = t.products.select("id", C("source_id").alias("doc_id"), "brand_name", "model")
    return df.join(p, "doc_id").select("id", titles.score_by_title(
        C("brand_name"), C("model"), C("title_bm.brand"), C("title_bm.model")).alias("score"))


