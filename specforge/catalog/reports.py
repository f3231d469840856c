"""Queries of profiles, diagnostics and reports (A*, W2, W4, J7, exports)."""

from __future__ import annotations

from pyspark.sql import functions as F

from specforge import rules
from specforge.catalog import duck as d
from specforge.catalog import query
from specforge.operators import profile, search
from specforge.sources import exports

C = F.col


@query("brand_facets", "A1", """SELECT arg_min(p_brand, p_partkey) AS name, count(*) AS count FROM (
 SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN upper(p_brand) WHEN 1 THEN lower(p_brand) ELSE p_brand END AS p_brand FROM part) GROUP BY lower(p_brand)""")
def brand_facets(t):
    b = F.when(C("p_partkey") % 3 == 0, F.upper("p_brand")).when(C("p_partkey") % 3 == 1, F.lower("p_brand")).otherwise(C("p_brand"))
    return profile.brand_facets(t.part.select("p_partkey", b.alias("p_brand")), "p_brand", "p_partkey")


@query("table_stats", "A3", """SELECT count(*) AS total_records, count(DISTINCT brand_name) AS unique_brands, count(DISTINCT model) AS unique_models, count(DISTINCT source_link) AS unique_keys FROM products""")
def table_stats(t):
    return profile.table_stats(t.products, "brand_name", "model", "source_link")


@query("table_stats_approx", "A3")
def table_stats_approx(t):
    return profile.table_stats_approx(t.products, "brand_name", "model", "source_link")


@query("surface_breakdown", "A4", "SELECT coalesce(nullif(surface_type, ''), 'unknown') AS value, count(*) AS n FROM products GROUP BY 1")
def surface_breakdown(t):
    return profile.breakdown(t.products, "surface_type", "unknown")


@query("stack_counts", "A4", """SELECT count(CASE WHEN heel_height IS NOT NULL OR "drop" IS NOT NULL THEN 1 END) AS with_stack,
 count(CASE WHEN heel_height IS NULL AND "drop" IS NULL THEN 1 END) AS without_stack FROM products""")
def stack_counts(t):
    return profile.stack_counts(t.products)


def _profile_sql(table: str, numeric, flags, others) -> str:
    out = []
    for c in [*numeric, *flags, *others]:
        q = f'"{c}"'
        n, f = c in numeric, c in flags
        out.append(f"""SELECT '{table}' AS table_name, '{c}' AS column_name, count(*) AS total_rows, count({q}) AS non_null_count, count(*) - count({q}) AS null_count,
 round(100.0::double * count({q}) / count(*), 2) AS fill_pct, {f'round(sum(cast({q} as double)) / count({q}), 2)' if n else 'NULL::double'} AS avg_value, {f'min({q})::double' if n else 'NULL::double'} AS min_value,
 {f'max({q})::double' if n else 'NULL::double'} AS max_value, {f'count(CASE WHEN {q} THEN 1 END)' if f else 'NULL::bigint'} AS true_count, {f'count(CASE WHEN NOT {q} THEN 1 END)' if f else 'NULL::bigint'} AS false_count FROM {table}""")
    return " UNION ALL ".join(out)


_LI = ["l_quantity", "l_discount", "l_linenumber"]


@query("column_profile", "A5", _profile_sql("lineitem", _LI, [], ["l_returnflag", "l_shipdate"]))
def column_profile(t):
    return profile.column_profile(t.lineitem, "lineitem", _LI, others=["l_returnflag", "l_shipdate"])


@query("product_profile", "A5", _profile_sql("products", rules.NUMERIC_FIELDS, rules.BOOLEAN_FIELDS, ["brand_name", "cushioning_type"]))
def product_profile(t):
    return profile.column_profile(t.products, "products", rules.NUMERIC_FIELDS, rules.BOOLEAN_FIELDS, ["brand_name", "cushioning_type"])


@query("duplicate_texts", "A6", """SELECT sha256(text) AS digest, length(text) AS chars, count(*) AS cnt, min(doc_id) AS first_id, max(doc_id) AS last_id
 FROM documents GROUP BY text HAVING count(*) > 1""")
def duplicate_texts(t):
    return profile.duplicate_long(t.documents, "text", "doc_id")


@query("duplicate_ids", "A6", """SELECT products.brand_name, products.model, cnt, id FROM products JOIN (SELECT brand_name, model, count(*) AS cnt FROM products GROUP BY 1, 2 HAVING count(*) > 1) g
 ON products.brand_name IS NOT DISTINCT FROM g.brand_name AND products.model IS NOT DISTINCT FROM g.model""")
def duplicate_ids(t):
    return profile.duplicate_ids(t.products, ["brand_name", "model"], "id", "created_at")


_REP = """SELECT source_id, count(*) AS products, list_sort(list(DISTINCT brand_name) FILTER (WHERE brand_name IS NOT NULL)) AS brands, count(DISTINCT source_link) AS k,
 count(weight) AS with_weight, count("drop") AS with_drop, count(price) AS with_price, count(heel_height) AS with_heel_height FROM products GROUP BY 1"""


def _report(t):
    return profile.run_report(t.products.withColumn("model_key", C("source_link")), "source_id", "created_at", "id")


@query("run_report", "A7", """SELECT source_id, products, coalesce(array_to_string(brands, '|'), '') AS brands, with_weight, with_drop, with_price, with_heel_height,
 CASE WHEN coalesce(len(brands), 0) > 2 THEN 1 ELSE 0 END + CASE WHEN with_weight = 0 AND with_drop = 0 AND with_price = 0 THEN 1 ELSE 0 END + CASE WHEN k < products THEN 1 ELSE 0 END AS issues FROM rep""",
       {"rep": _REP})
def run_report(t):
    return _report(t).select("source_id", "products", F.array_join("brands", "|").alias("brands"), "with_weight", "with_drop",
                             "with_price", "with_heel_height", F.size("issues").alias("issues"))


@query("run_totals", "A7,S15", """SELECT count(*) AS total_articles, sum(products)::bigint AS total_products, round(sum(products) / count(*), 1) AS avg_products, sum(with_weight)::bigint AS with_weight,
 sum(with_price)::bigint AS with_price FROM rep""", {"rep": _REP})
def run_totals(t):
    return profile.run_totals(_report(t)).select("total_articles", "total_products", "avg_products", "with_weight", "with_price")


# --- accuracy -------------------------------------------------------------------------

_F = ["weight", "drop", "waterproof", "cushioning_type"]
_PLAIN = lambda c: f"CASE WHEN coalesce({c}, '') IN ('', 'null', 'undefined', 'FALSE') THEN '' ELSE lower(trim({c})) END"
_TRUTH = """SELECT id, id AS line, CASE id % 4 WHEN 0 THEN cast(cast(weight as bigint) as varchar) || 'g' WHEN 1 THEN '250' ELSE NULL END AS weight_correct,
 CASE id % 3 WHEN 0 THEN 'FALSE' ELSE cast(cast("drop" as bigint) as varchar) END AS drop_correct, CASE id % 5 WHEN 0 THEN 'true' WHEN 1 THEN 'FALSE' ELSE 'false' END AS waterproof_correct,
 CASE id % 2 WHEN 0 THEN 'Max cushion' ELSE 'firm' END AS cushioning_type_correct FROM products WHERE id % 10 <> 0"""
_LONG = " UNION ALL ".join(
    f"""SELECT id, '{f}' AS field, {_PLAIN(f'cast(e."{f}" as varchar)')} AS a, {_PLAIN(f't.{f}_correct')} AS b FROM products e JOIN truth t USING (id)""" for f in _F)
_NUM = lambda c: f"try_cast(nullif(regexp_extract({c}, '^([-+]?(?:[0-9]+[.]?[0-9]*|[.][0-9]+))', 1), '') as double)"
_STATUS = f"""SELECT id, field, CASE WHEN a = '' AND b = '' THEN 'correct' WHEN b = '' THEN 'missing_gt' WHEN a = '' THEN 'missing_extracted'
 WHEN {_NUM('a')} IS NOT NULL AND {_NUM('b')} IS NOT NULL THEN CASE WHEN abs({_NUM('a')} - {_NUM('b')}) <= 0.5 THEN 'correct' ELSE 'incorrect' END
 WHEN a IN ('true', 'false') AND b IN ('true', 'false') THEN CASE WHEN a = b THEN 'correct' ELSE 'incorrect' END
 WHEN contains(a, b) OR contains(b, a) THEN 'correct' ELSE 'incorrect' END AS status FROM long"""
_ACC = {"truth": _TRUTH, "long": _LONG, "st": _STATUS}
_PCT = lambda a, b: f"round(CASE WHEN {b} = 0 THEN 0.0 ELSE 100.0::double * {a} / ({b}) END, 4)"


def _truth(t):
    i = lambda c: C(c).cast("bigint").cast("string")
    k = C("id")
    return t.products.filter("id % 10 <> 0").select(
        "id", k.alias("line"), F.when(k % 4 == 0, F.concat(i("weight"), F.lit("g"))).when(k % 4 == 1, "250").alias("weight_correct"),
        F.when(k % 3 == 0, "FALSE").otherwise(i("drop")).alias("drop_correct"),
        F.when(k % 5 == 0, "true").when(k % 5 == 1, "FALSE").otherwise("false").alias("waterproof_correct"),
        F.when(k % 2 == 0, "Max cushion").otherwise("firm").alias("cushioning_type_correct"))


def _status(t):
    matched, _ = profile.match_truth(t.products, _truth(t), ["id"], "line", _F)
    return profile.field_status(matched, ["id"], _F)


@query("field_status", "A9", "SELECT id, field, status FROM st", _ACC)
def field_status(t):
    return _status(t).select("id", "field", "status")


@query("field_accuracy", "A9", f"""SELECT field, total, correct, incorrect, missing_extracted, missing_gt, {_PCT('correct', 'total')} AS accuracy, {_PCT('correct', 'correct + missing_extracted')} AS recall,
 {_PCT('correct', 'correct + incorrect')} AS precision FROM (SELECT field, count(*) AS total, count(CASE WHEN status = 'correct' THEN 1 END) AS correct, count(CASE WHEN status = 'incorrect' THEN 1 END) AS incorrect,
 count(CASE WHEN status = 'missing_extracted' THEN 1 END) AS missing_extracted, count(CASE WHEN status = 'missing_gt' THEN 1 END) AS missing_gt FROM st GROUP BY field)""", _ACC)
def field_accuracy(t):
    return profile.accuracy(_status(t))


@query("overall_accuracy", "A9", "SELECT count(*) AS total, count(CASE WHEN status = 'correct' THEN 1 END) AS correct, round(100.0::double * count(CASE WHEN status = 'correct' THEN 1 END) / count(*), 4) AS accuracy FROM st", _ACC)
def overall_accuracy(t):
    return profile.overall_accuracy(profile.accuracy(_status(t)))


@query("errors_by_field", "A9", "SELECT field, count(*) AS errors FROM st WHERE status IN ('incorrect', 'missing_extracted') GROUP BY 1", _ACC)
def errors_by_field(t):
    return profile.errors_by_field(_status(t))


@query("top_errors", "A9", "SELECT id, field, status FROM st WHERE status IN ('incorrect', 'missing_extracted')", _ACC)
def top_errors(t):
    return profile.top_errors(_status(t), ["id"]).select("id", "field", "status")


@query("without_truth", "J7", "SELECT id FROM products WHERE id % 10 = 0")
def without_truth(t):
    return profile.match_truth(t.products, _truth(t), ["id"], "line", _F)[1].select("id")


@query("rule_accuracy", "A9", f"""SELECT count(*) AS total, count(CASE WHEN hit = quality THEN 1 END) AS correct, round(100.0::double * count(CASE WHEN hit = quality THEN 1 END) / count(*), 4) AS accuracy
 FROM (SELECT quality, cast({d.m('text', r'[.!?]\s+[A-Z]', '')} as int) AS hit FROM documents JOIN labels USING (doc_id))""")
def rule_accuracy(t):
    from specforge.functions import regex as rx
    hit = rx.test(C("text"), r"[.!?]\s+[A-Z]", "").cast("int").cast("string")
    hits = t.documents.select("doc_id", hit.alias("hit"))
    j = t.labels.join(hits, "doc_id").select("doc_id", C("hit").alias("quality"), C("quality").cast("string").alias("quality_correct"))
    st = profile.field_status(j, ["doc_id"], ["quality"])
    return profile.overall_accuracy(profile.accuracy(st))


# --- linkage, outcomes, quality ----------------------------------------------------------

@query("linkage_report", "A10", """SELECT total_rows, total_rows AS rows_with_id, m AS matching_rows, total_rows - m AS unmatched_rows, round(100.0::double * m / total_rows, 2) AS match_pct,
 CASE WHEN 100.0 * m / total_rows < 50 THEN 'WARNING' WHEN 100.0 * m / total_rows < 80 THEN 'CAUTION' ELSE 'SUCCESS' END AS verdict
 FROM (SELECT count(*) AS total_rows, count(CASE WHEN doc_id IN (SELECT doc_id FROM labels) THEN 1 END) AS m FROM documents)""")
def linkage_report(t):
    return profile.linkage_report(t.documents, t.labels, "doc_id")


@query("outcome_counts", "A11", "SELECT event_type AS outcome, count(*) AS n FROM events GROUP BY 1")
def outcome_counts(t):
    return profile.outcome_counts(t.events, "event_type")


@query("token_cost", "A11", """SELECT sum(n_chars)::bigint AS input_tokens, sum(doc_id)::bigint AS output_tokens, round(sum(n_chars)::double * 0.00015::double / 1000 + sum(doc_id)::double * 0.0006::double / 1000, 6) AS cost FROM documents""")
def token_cost(t):
    return profile.token_cost(t.documents, "n_chars", "doc_id")


@query("qc_status", "W2", """SELECT id, CASE WHEN coalesce(brand_name, '') = '' THEN 'Missing brand' WHEN coalesce(model, '') = '' THEN 'Missing model' WHEN price IS NULL THEN 'Missing price'
 WHEN weight IS NULL THEN 'Missing weight' ELSE 'OK' END AS quality_status FROM products""")
def qc_status(t):
    return t.products.select("id", profile.quality_status().alias("quality_status"))


@query("recent_rows", "W4", """SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'new' ELSE 'updated' END AS kind FROM events WHERE ts > (SELECT max(ts) FROM events) - INTERVAL 1440 MINUTE""")
def recent_rows(t):
    asof = t.events.agg(F.max("ts")).scalar()
    kind = profile.new_or_updated(C("event_id") % 2, F.lit(0))
    return profile.recent(t.events, "ts", asof, 1440).select("event_id", kind.alias("kind"))


# --- exports -------------------------------------------------------------------------------

@query("csv_page", "S12", """SELECT coalesce(brand_name, '') AS brand, coalesce(model, '') AS model, coalesce(cast("drop" as varchar), '') AS "drop", CASE WHEN carbon_plate THEN 'yes' ELSE 'no' END AS plate,
 CASE WHEN waterproof THEN 'yes' ELSE 'no' END AS waterproof, "date", source_link AS source FROM products ORDER BY weight DESC NULLS LAST, id LIMIT 100""")
def csv_page(t):
    page, _ = search.search(t.products, search.SearchParams(sort="weight_desc", page_size=100))
    return search.csv_page(page).select("brand", "model", "drop", "plate", "waterproof", "date", "source")


@query("csv_lines", "S12", """SELECT '"' || replace(coalesce(brand_name, ''), '"', '""') || '","' || coalesce(additional_features, '') || '","' || cast(id as varchar) || '"' AS line FROM products""")
def csv_lines(t):
    return t.products.select("brand_name", "additional_features", "id").select(
        search.quoted_csv(t.products.select("brand_name", "additional_features", "id")).alias("line"))


@query("latest_export", "S13", "SELECT " + ", ".join(
    f"""coalesce({'substring("date", 1, 10)' if c == 'date' else 'cast(source_id as varchar)' if c == 'article_id' else f'cast("{c}" as varchar)'}, '') AS "{c}" """ for c in rules.LATEST_COLUMNS) + " FROM products")
def latest_export(t):
    return exports.latest_export(t.products.withColumn("article_id", C("source_id")))


@query("validation_set", "S14", """SELECT source_id, coalesce(title, 'Unknown') AS article_title, brand_name, model, weight FROM products LEFT JOIN (SELECT doc_id, title FROM articles) ON doc_id = source_id WHERE source_id IN (SELECT user_id FROM events)""")
def validation_set(t):
    arts = t.articles.select(C("doc_id").alias("source_id"), "title")
    ids = t.events.select(C("user_id").alias("source_id"))
    return exports.validation_set(t.products, arts, ids, "source_id").select("source_id", "article_title", "brand_name", "model", "weight")


@query("truth_template", "S14", """SELECT source_id, brand_name, model, '' AS "weight_CORRECT", '' AS notes FROM products WHERE source_id IN (SELECT user_id FROM events)""")
def truth_template(t):
    arts = t.articles.select(C("doc_id").alias("source_id"), "title")
    v = exports.validation_set(t.products, arts, t.events.select(C("user_id").alias("source_id")), "source_id")
    return exports.truth_template(v, "source_id").select("source_id", "brand_name", "model", "weight_CORRECT", "notes")
