"""Queries of text-to-rows extraction (E3-E9, E11-E18, N*, main flow)."""

from __future__ import annotations

from pyspark.sql import functions as F

from specforge import rules
from specforge.catalog import duck as d
from specforge.catalog import query
from specforge.functions import text
from specforge.functions import regex as rx
from specforge.operators import blocks, dedup, fallback, normalize, profile, tables, windows
from specforge.plans import article_specs, candidates, products
from specforge.sources import grids, pages

C = F.col
J = lambda c: F.array_join(c, "|")

# Headings as marks in the text, cut by a split: the oracle form of E3 and E4.
_H = d.re2(rules.HEADING, "im")
HEAD_CTES = {
    "h0": f"""SELECT doc_id, string_split(regexp_replace(content, {_H}, chr(1) || '\\0' || chr(2) || '\\1' || chr(3) || '\\2' || chr(4), 'g'), chr(1)) AS parts FROM articles""",
    "h1": f"""SELECT doc_id, i, p, {d.trim(d.sub(d.trim('split_part(split_part(p, chr(3), 1), chr(2), 2)'), rules.HEADING_PREFIX))} AS bm
 FROM (SELECT doc_id, generate_subscripts(parts, 1) AS i, unnest(parts) AS p FROM h0)""",
    "h2": f"""SELECT *, i > 1 AND NOT {d.m('bm', rules.HEADING_GENERIC)} AND {d.m('bm', '[A-Z]', '')} AND length(bm) BETWEEN 3 AND 50 AS ok FROM h1""",
    "h3": """SELECT *, sum(cast(ok AS int)) OVER (PARTITION BY doc_id ORDER BY i) AS g,
 CASE WHEN i = 1 THEN p WHEN ok THEN split_part(p, chr(4), 2) ELSE split_part(p, chr(2), 1) || split_part(p, chr(4), 2) END AS body FROM h2""",
    "heads": f"""SELECT doc_id, cast(g AS bigint) AS block_no, {d.trim('max(CASE WHEN ok THEN split_part(p, chr(2), 1) END)')} AS heading,
 max(CASE WHEN ok THEN bm END) AS brand_model, try_cast(nullif(max(CASE WHEN ok THEN split_part(split_part(p, chr(4), 1), chr(3), 2) END), '') AS double) AS price,
 string_agg(body, '' ORDER BY i) AS body FROM h3 WHERE g > 0 GROUP BY doc_id, g""",
    "blocks": f"SELECT doc_id, block_no, heading, brand_model, price, heading || chr(10) || {d.trim('body')} AS b FROM heads",
}


@query("headings", "E3", "SELECT doc_id, block_no, heading, brand_model, price FROM blocks", HEAD_CTES)
def headings(t):
    return blocks.explode_blocks(t.articles, "content", ["doc_id"]).select(
        "doc_id", "block_no", "heading", "brand_model", C("heading_price").alias("price"))


@query("blocks", "E4", "SELECT doc_id, block_no, length(b) AS chars, md5(b) AS digest FROM blocks", HEAD_CTES)
def block_texts(t):
    return blocks.explode_blocks(t.articles, "content", ["doc_id"]).select(
        "doc_id", "block_no", F.length("block").cast("bigint").alias("chars"), F.md5("block").alias("digest"))


def _brand_split(c: str) -> tuple[str, str]:
    known = " ".join(f"WHEN starts_with(lower({c}), {d.s(b.lower())}) THEN {d.s(b)}" for b in rules.BLOCK_BRANDS)
    return (f"CASE {known} ELSE {d.x(c, chr(94) + '([^ ]+)', 1, '')} END",
            f"""CASE {' '.join(f"WHEN starts_with(lower({c}), {d.s(b.lower())}) THEN nullif({d.trim(f'substring({c}, {len(b) + 1})')}, '')" for b in rules.BLOCK_BRANDS)}
  ELSE '?' END""")


def _no_ahead(p: str) -> str:
    """Patterns of the general heights end in a negative look-ahead."""
    return p.replace(r"(?!\s*drop)", "")


def _spec_ctes(pairs, weights, drops) -> dict:
    brand, model = _brand_split("brand_model")
    grams = ", ".join(d.num(d.x("b", p, g)) if u == "g" else d.rnd(f"{d.num(d.x('b', p, g))} * 28.3495") for p, g, u in weights)
    pair = lambda side: " ".join(f"WHEN {d.m('b', p)} THEN {d.num(d.x('b', p, (h, f)[side]))}" for p, h, f in pairs)
    n = lambda p, g=1: d.num(d.x("b", p, g))
    heel = f"coalesce({n(rules.BOTH_HEIGHTS)}, nullif({n(rules.HEEL_AT_HEEL)}, 0), CASE WHEN gen > 15 THEN gen END)"
    fore = f"coalesce({n(rules.BOTH_HEIGHTS, 2)}, {n(rules.FOREFOOT_GENERAL)})"
    drop = ", ".join(d.num(d.x("b", p)) for p in drops)
    u = d.case("heading || ' ' || b", rules.USE_SPECIFIC)
    hb = "heading || ' ' || b"
    return HEAD_CTES | {
        "s0": f"""SELECT *, {brand} AS brand_name, {model} AS model, {n(_no_ahead(rules.HEEL_GENERAL))} AS gen, {n(_no_ahead(rules.STACK_GENERAL))} AS stack,
  nullif(regexp_extract(b, {d.re2(rules.WATERPROOF_MENTION)}, 0), '') AS wp,
  try_cast(nullif(regexp_extract(regexp_extract(b, {d.re2('|'.join(rules.PRICE_IN_BLOCK), '')}, 0), '([0-9]{{2,4}})', 1), '') AS double) AS bp FROM blocks""",
        "s1": f"""SELECT *, CASE {pair(0)} ELSE coalesce({heel}, CASE WHEN {fore} IS NULL AND stack > 15 THEN stack END) END AS heel_height,
  CASE {pair(1)} ELSE {fore} END AS forefoot_height, coalesce({drop}, CASE WHEN {d.m('b', rules.ZERO_DROP)} THEN 0.0 END) AS dr,
  coalesce({grams}) AS w FROM s0""",
        "specs": f"""SELECT doc_id, block_no, brand_name, model, nullif(heel_height, 0) AS heel_height, nullif(forefoot_height, 0) AS forefoot_height,
  coalesce(dr, CASE WHEN heel_height <> 0 AND forefoot_height <> 0 THEN floor((heel_height - forefoot_height) * 10 + 0.5) / 10 END) AS "drop",
  {d.rnd('nullif(w, 0)')} AS weight, {d.between('coalesce(nullif(price, 0), CASE WHEN bp BETWEEN 40 AND 500 THEN bp END)', 40, 500)} AS price,
  CASE WHEN {d.m('b', rules.CARBON_MENTION)} THEN true END AS carbon_plate,
  CASE WHEN wp IS NOT NULL AND NOT lower(substring(wp, 1, 4)) = 'not ' THEN true END AS waterproof,
  CASE WHEN {u} IS NOT NULL THEN {u} WHEN {d.m(hb, 'trail')} THEN 'trail running' WHEN {d.m(hb, 'road|pavement|asphalt|versatile')} THEN 'road' END AS primary_use,
  CASE WHEN {d.m(hb, 'trail')} THEN 'trail' WHEN {d.m(hb, 'road|pavement|asphalt|versatile')} THEN 'road' END AS surface_type FROM s1"""}


SPECS = _spec_ctes(rules.PAIR_PATTERNS, rules.WEIGHT_PATTERNS, rules.DROP_PATTERNS)
_SPEC_COLS = ["doc_id", "block_no", "brand_name", "model", "heel_height", "forefoot_height", "drop", "weight",
              "price", "carbon_plate", "waterproof", "primary_use", "surface_type"]


def _specs(t, profile_="full"):
    return blocks.extract_specs(blocks.explode_blocks(t.articles, "content", ["doc_id"]), profile_)


@query("block_specs", "E6", "SELECT * FROM specs", SPECS)
def block_specs(t):
    return _specs(t).select(*_SPEC_COLS)


@query("block_specs_classic", "E6b", "SELECT * FROM specs", _spec_ctes(
    rules.CLASSIC_PAIR_PATTERNS, rules.CLASSIC_WEIGHT_PATTERNS, rules.CLASSIC_DROP_PATTERNS))
def block_specs_classic(t):
    return _specs(t, "classic").select(*_SPEC_COLS)


@query("split_brand_model", "E7", f"""SELECT brand_model, {_brand_split('brand_model')[0]} AS brand_name, count(*) AS n FROM (SELECT {d.trim('bm')} AS brand_model FROM (
 SELECT CASE id % 3 WHEN 0 THEN coalesce(brand_name, '') || ' ' || model WHEN 1 THEN 'Norda ' || model ELSE 'Topo' END AS bm FROM products)) GROUP BY 1, 2""")
def split_brand_model(t):
    bm = (F.when(C("id") % 3 == 0, F.concat(F.coalesce("brand_name", F.lit("")), F.lit(" "), "model"))
          .when(C("id") % 3 == 1, F.concat(F.lit("Norda "), "model")).otherwise("Topo"))
    g = t.products.select(text.trim(bm).alias("brand_model")).groupBy("brand_model").agg(F.count(F.lit(1)).alias("n"))
    return g.select("brand_model", blocks.split_brand_model(C("brand_model"))["brand_name"].alias("brand_name"), "n")


@query("mentions", "E5")
def mentions(t):
    rows = blocks.mentions(C("content"))
    return t.articles.select("doc_id", F.posexplode(rows).alias("no", "m")).select(
        "doc_id", "no", "m.heading", "m.brand_model", "m.price", F.length("m.block").alias("chars"))


@query("blocks_or_mentions", "E5,E3")
def blocks_or_mentions(t):
    found = blocks.extract_specs(blocks.blocks_or_mentions(t.articles, "content", ["doc_id"]))
    return found.select(*_SPEC_COLS)


@query("fallback_heights", "E8")
def fallback_heights(t):
    return fallback.with_fallback_heights(t.articles.select("doc_id", "content"), "content").drop("content")


_MONEY = " ".join(f"WHEN {d.num(d.x('content', p))} * {rules.USD_RATES[c]}::double BETWEEN 40 AND 500 THEN {d.s(c)}" for p, c in rules.FALLBACK_MONEY)
_USD = " ".join(f"WHEN {d.num(d.x('content', p))} * {rules.USD_RATES[c]}::double BETWEEN 40 AND 500 THEN {d.r2(d.num(d.x('content', p)) + f' * {rules.USD_RATES[c]}::double')}" for p, c in rules.FALLBACK_MONEY)
_G, _OZ = d.num(d.x("content", rules.FALLBACK_GRAMS)), d.num(d.x("content", rules.FALLBACK_OZ))


@query("fallback_weight_price", "E8", f"""SELECT doc_id, coalesce(CASE WHEN g BETWEEN 80 AND 600 THEN {d.rnd('g')} END,
 CASE WHEN o > 2 AND o < 25 AND {d.rnd('o * 28.3495')} BETWEEN 80 AND 600 THEN {d.rnd('o * 28.3495')} END) AS weight, currency, price_usd
 FROM (SELECT doc_id, {_G} AS g, {_OZ} AS o, CASE {_MONEY} END AS currency, CASE {_USD} END AS price_usd FROM articles)""")
def fallback_weight_price(t):
    df = t.articles.select("doc_id", fallback.fallback_weight(C("content")).alias("weight"),
                           fallback.fallback_price(C("content")).alias("p"))
    return df.select("doc_id", "weight", "p.currency", "p.price_usd")


@query("odd_prices", "E9", f"""SELECT doc_id, v AS price FROM (SELECT doc_id, {d.num(d.x('content', rules.WEIRD_PRICE, 2))} AS v FROM articles) WHERE v BETWEEN 40 AND 500""")
def odd_prices(t):
    return t.articles.select("doc_id", fallback.weird_price(C("content")).alias("price")).filter("price is not null")


# --- windows ---------------------------------------------------------------------

def _window_ctes(radius: int) -> dict:
    hits = "|".join(rx.literal(w) for w in rules.WINDOW_TERMS)
    return {
        "w0": "SELECT doc_id, length(content) AS n, lower(content) AS c FROM articles",
        "w1": f"SELECT doc_id, n, unnest(list_filter(range(0, n), lambda i: regexp_matches(substring(c, i + 1, 8), '^(?:{hits})'))) AS h FROM w0",
        "w2": f"SELECT doc_id, n, h, greatest(0, h - {radius}) AS s, least(n, h + {radius}) AS e FROM w1",
        "w3": "SELECT *, max(e) OVER (PARTITION BY doc_id ORDER BY h ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM w2",
        "w4": "SELECT *, sum(CASE WHEN prev IS NULL OR s > prev THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY h) AS g FROM w3",
        "wins": """SELECT doc_id, cast(row_number() OVER (PARTITION BY doc_id ORDER BY min(s)) AS bigint) AS window_no, min(s) AS "start", max(e) AS "end" FROM w4 GROUP BY doc_id, g
 UNION ALL SELECT doc_id, 1, 0, n FROM w0 WHERE doc_id NOT IN (SELECT doc_id FROM w1)"""}


@query("keyword_windows", "E11", 'SELECT doc_id, window_no, "start", "end" FROM wins', _window_ctes(60))
def keyword_windows(t):
    w = windows.keyword_windows(C("content"), radius=60)["windows"]
    return t.articles.select("doc_id", F.posexplode(w).alias("i", "x")).select(
        "doc_id", (C("i") + 1).alias("window_no"), "x.start", "x.end")


@query("window_budget", "E11", """SELECT doc_id, window_no, "start", "start" + least("end" - "start", 2000 - before) AS "end" FROM (
 SELECT *, coalesce(sum("end" - "start") OVER (PARTITION BY doc_id ORDER BY window_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM wins)
 WHERE before < 2000""", _window_ctes(60))
def window_budget(t):
    w = windows.keyword_windows(C("content"), radius=60)["windows"]
    return t.articles.select("doc_id", F.posexplode(windows.cap_windows(w, 2000)).alias("i", "x")).select(
        "doc_id", (C("i") + 1).alias("window_no"), "x.start", "x.end")


def _vals(field: str) -> str:
    p, lo, hi = rules.VALUE_PATTERNS[field]
    p = p.replace(r"(?=[^a-z0-9_]|[a-z]|$)", "")
    if field in ("heel", "forefoot"):
        return (f"list_filter(list_transform({d.xa('content', p, 0)}, lambda v: cast(regexp_extract(v, '[0-9]{{2}}') as double)), "
                f"lambda v: v BETWEEN {lo} AND {hi})")
    return f"list_filter(list_transform({d.xa('content', p)}, lambda v: cast(v as double)), lambda v: v BETWEEN {lo} AND {hi})"


_VALUES = f"""SELECT doc_id, {_vals('price')} AS price, {_vals('drop')} AS dr, {_vals('stack')} AS stack, {_vals('heel')} AS heel, {_vals('forefoot')} AS fore,
 list_concat({_vals('grams')}, list_transform({_vals('oz')}, lambda v: floor(v * 28.3495 + 0.5))) AS w FROM articles"""
_SET = lambda c: f"array_to_string(list_transform(list_sort(list_distinct({c})), lambda v: cast(cast(v as bigint) as varchar)), ',')"


@query("window_values", "E12", f"""SELECT doc_id, {_SET('price')} AS price, {_SET('dr')} AS "drop", {_SET('w')} AS weight,
 {_SET('CASE WHEN len(stack) > 0 THEN stack ELSE heel END')} AS heel, {_SET('fore')} AS forefoot FROM vals""", {"vals": _VALUES})
def window_values(t):
    df = windows.with_values(t.articles.select("doc_id", F.array("content").alias("texts")), "texts")
    show = lambda c: F.array_join(F.transform(F.array_sort(c), lambda v: v.cast("bigint").cast("string")), ",")
    return df.select("doc_id", show("v_price").alias("price"), show("v_drop").alias("drop"),
                     show("v_weight").alias("weight"), show("v_heel").alias("heel"), show("v_forefoot").alias("forefoot"))


_N = lambda c: f"len(list_distinct({c}))"


@query("ambiguity_mode", "E13", f"""SELECT doc_id, CASE WHEN m > 1 AND nd = 1 AND nh = 1 THEN 'unique' WHEN m > 1 THEN 'multiple' WHEN m = 1 THEN 'plain' ELSE 'none' END AS state,
 CASE WHEN m > 0 AND (m = 1 OR (nd = 1 AND nh = 1)) THEN dr[1] END AS drop_mm FROM (SELECT *, greatest({_N('price')}, nd, {_N('w')}, nh, {_N('fore')}) AS m FROM (
  SELECT *, {_N('dr')} AS nd, {_N('CASE WHEN len(stack) > 0 THEN stack ELSE heel END')} AS nh FROM vals))""", {"vals": _VALUES})
def ambiguity_mode(t):
    df = windows.resolve_windows(t.articles.select("doc_id", F.array("content").alias("texts")), "texts")
    simple = F.coalesce("single_reason", F.lit("")) != "proximity_join"
    state = (F.when(C("single_reason") == "unique_drop_and_heel_with_multiple_weights", "unique")
             .when((C("mode") == "ambiguous_multi") | ~simple, "multiple").when(C("mode") == "single", "plain").otherwise("none"))
    return df.select("doc_id", state.alias("state"), F.when(state.isin("unique", "plain"), C("drop_mm")).alias("drop_mm"))


@query("top_snippets", "E14")
def top_snippets(t):
    df = t.articles.select("doc_id", windows.snippets(F.array("content")).alias("s"))
    all_ = F.concat(*[C(f"s.{f}") for f in windows.SNIPPET_FIELDS])
    return df.select("doc_id", F.posexplode(windows.top_snippets(all_)).alias("rank", "snippet")).select(
        "doc_id", "rank", windows.snippet_score(C("snippet")).alias("score"), F.md5("snippet").alias("digest"))


@query("best_cluster", "E15")
def best_cluster(t):
    df = t.articles.select("doc_id", windows.snippets(F.array("content")).alias("s"))
    best = windows.best_cluster(windows.top_snippets(F.concat(*[C(f"s.{f}") for f in windows.SNIPPET_FIELDS])))
    # A generator, since a filter on the column would compute it a second time.
    df = df.select("doc_id", F.explode(F.filter(F.array(best), lambda b: b.isNotNull())).alias("b"))
    return df.select("doc_id", "b.competing", "b.cluster.*")


# --- comparison tables --------------------------------------------------------------

_CELLS = {"weight": "Weight", "heel": "Heel stack", "fore": "Forefoot stack", "price": "Retail price"}


def _table_html():
    td = lambda *cs: F.concat(F.lit("<tr><td>"), F.concat_ws("</td><td>", *cs), F.lit("</td></tr>"))
    s = lambda c: c.cast("string")
    k = C("p_partkey")
    row = lambda label, unit, base, mod, pre="": td(
        F.lit(label), *[F.concat(F.lit(pre), s(base + (k * (i + 3)) % mod), F.lit(unit)) for i in range(2)])
    return F.concat(F.lit("<html><body><p>Nav</p><table><tr><td>a</td></tr></table><table>"),
                    td(F.lit("Spec"), C("p_name"), F.concat(C("p_name"), F.lit(" 2"))),
                    row("Weight", " g", F.lit(200), 90), row("Heel stack", " mm", F.lit(30), 15),
                    row("Forefoot stack", " mm", F.lit(22), 9), row("Retail price", "", F.lit(80), 200, "€"),
                    td(F.lit("Colour"), F.lit("red")), F.lit("</table></body></html>"))


@query("comparison_tables", "E16,S10", """SELECT p_partkey, i AS model_no, CASE i WHEN 0 THEN p_name ELSE p_name || ' 2' END AS model_name, cast(200 + (p_partkey * (i + 3)) % 90 as double) AS weight_g,
 cast(30 + (p_partkey * (i + 3)) % 15 as double) AS heel_mm, cast(22 + (p_partkey * (i + 3)) % 9 as double) AS forefoot_mm,
 cast(8 + (p_partkey * (i + 3)) % 15 - (p_partkey * (i + 3)) % 9 as double) AS drop_mm, floor(cast(80 + (p_partkey * (i + 3)) % 200 as double) * 1.08::double + 0.5) AS price_usd,
 0.6::double AS confidence, 'WEIGHT|STACK|DROP|PRICE|MULTI_TABLE' AS labels FROM part, (SELECT unnest([0, 1]) AS i)""")
def comparison_tables(t):
    src = pages.spread(t.part.select("p_partkey", "p_name"), "p_partkey").select("p_partkey", _table_html().alias("html"))
    df = pages.parse_pages(src, ["p_partkey"]).withColumn("c", tables.comparison(C("tables")))
    return df.select("p_partkey", "c.confidence", J("c.labels").alias("labels"), F.posexplode("c.models").alias("model_no", "m")).select(
        "p_partkey", "model_no", "m.model_name", "m.weight_g", "m.heel_mm", "m.forefoot_mm", "m.drop_mm", "m.price_usd", "confidence", "labels")


def _spanned(t):
    """Every page with a table of spanning cells and a nested one behind its own html."""
    k = C("page_id")
    n = lambda base, mod: (F.lit(base) + k % mod).cast("string")
    table = F.concat(
        F.lit('<table><thead><tr><th>Spec<th colspan="2">Pace '), k.cast("string"), F.lit("</thead><tr><td rowspan=2>Weight<td>"),
        n(200, 90), F.lit(" g</td><td>"), n(210, 70), F.lit(" g<tr><td colspan=2>see <table><tr><td>in "), n(0, 7),
        F.lit("</table> note</tr><tbody><tr><td>Drop<td colspan=2>"), n(4, 9), F.lit(" mm<tr><td>Retail price<td>$"), n(90, 50), F.lit("<td>"),
        F.lit("n/a</table>"))
    return grids.page_grids(t.pages.select("page_id", F.concat(F.coalesce(C("html"), F.lit("")), table).alias("html")), ["page_id"])


_ID = "cast(page_id AS varchar)"


@query("page_grids", "S10,E16", f"""SELECT page_id, 0 AS table_no, 0 AS depth, 3 AS columns, 'Spec|Pace ' || {_ID} || '|Pace ' || {_ID} || chr(10) ||
 'Weight|' || (200 + page_id % 90) || ' g|' || (210 + page_id % 70) || ' g' || chr(10) || 'Weight|see note|see note' || chr(10) ||
 'Drop|' || (4 + page_id % 9) || ' mm|' || (4 + page_id % 9) || ' mm' || chr(10) || 'Retail price|$' || (90 + page_id % 50) || '|n/a' AS cells FROM pages
 UNION ALL SELECT page_id, 1, 1, 1, 'in ' || (page_id % 7) FROM pages""")
def page_grids(t):
    df = _spanned(t).select("page_id", F.posexplode("grids").alias("table_no", "g"))
    return df.select("page_id", "table_no", "g.depth", F.size(F.get("g.cells", F.lit(0))).alias("columns"),
                     F.array_join(F.transform("g.cells", J), "\n").alias("cells"))


@query("grid_comparisons", "E16,S10", f"""SELECT page_id, i AS model_no, 'Pace ' || {_ID} AS model_name,
 cast(CASE i WHEN 0 THEN 200 + page_id % 90 ELSE 210 + page_id % 70 END AS double) AS weight_g, cast(4 + page_id % 9 AS double) AS drop_mm,
 CASE i WHEN 0 THEN cast(90 + page_id % 50 AS double) END AS price_usd, 0.6::double AS confidence FROM pages, (SELECT unnest([0, 1]) AS i)""")
def grid_comparisons(t):
    df = _spanned(t).withColumn("c", tables.comparison(F.transform("grids", lambda g: g["cells"])))
    return df.select("page_id", "c.confidence", F.posexplode("c.models").alias("model_no", "m")).select(
        "page_id", "model_no", "m.model_name", "m.weight_g", "m.drop_mm", "m.price_usd", "confidence")


# --- article results ----------------------------------------------------------------

def _article_inputs(t):
    page = F.concat(F.lit("<html><body><p>"), C("content"), F.lit("</p></body></html>"))
    html = F.when(C("doc_id") % 3 > 0, page)
    return t.articles.select("doc_id", "title", "content", html.alias("html"))


@query("article_results", "E17")
def article_results(t):
    df = article_specs.article_specs(_article_inputs(t), "doc_id", "title", "content", "html")
    return df.select("doc_id", "mode", "reason", "stage", "single_reason", "price_usd", "drop_mm", "weight_g", "heel_mm",
                     "forefoot_mm", "prefilter_score", "source_used", "content_len", "html_chars", "method")


@query("article_sources", "E17", f"""SELECT doc_id, CASE WHEN length({d.trim('content')}) >= 2000 OR doc_id % 3 = 0 THEN 'content' ELSE 'fetched_html' END AS source_used,
 length({d.trim('content')}) AS content_len FROM articles""")
def article_sources(t):
    df = article_specs.choose_source(_article_inputs(t), "doc_id", "title", "content", "html")
    return df.select("doc_id", "source_used", "content_len")


@query("keep_results", "E18", """SELECT id, CASE WHEN id % 3 = 0 OR id % 4 = 0 OR id % 7 = 0 THEN 'new' ELSE 'single' END AS mode FROM products""")
def keep_results(t):
    mode = F.when(C("id") % 3 == 0, "skipped").when(C("id") % 4 == 0, F.lit(None)).otherwise("single")
    old = t.products.select("id", mode.alias("mode"))
    new = t.products.select("id", F.lit("new").alias("mode"))
    return article_specs.keep_results(old, new, "id", force=C("id") % 7 == 0)


# --- normalization -------------------------------------------------------------------

_ALIAS = d.mapping(d.trim("brand_name"), rules.BRAND_ALIASES, d.trim("brand_name"))
_CODE = """CASE WHEN upper(trim(currency)) IN ('$','USD','US$') THEN 'USD' WHEN upper(trim(currency)) IN ('€','EUR') THEN 'EUR' WHEN upper(trim(currency)) IN ('£','GBP') THEN 'GBP' END"""
_NORM0 = f"""SELECT *, {_ALIAS} AS b2, CASE WHEN trim(model) <> '' THEN {d.squeeze(d.sub('model', r'\b(?:shoe|sneaker|running)\b'))} END AS m2,
 CASE WHEN weight < 20 THEN {d.rnd('weight * 28.35')} ELSE weight END AS g, {_CODE} AS code,
 CASE WHEN {_CODE} <> 'USD' THEN price * {d.mapping(_CODE, rules.USD_RATES)}::double ELSE price END AS usd,
 {d.r2(d.between('heel_height', 10, 60))} AS h2, {d.r2(d.between('forefoot_height', 10, 60))} AS f2 FROM products"""
_E = lambda c, a: f"CASE WHEN lower({d.trim(c)}) IN {d.in_list(a)} THEN lower({d.trim(c)}) END"
_NORM = f"""SELECT id, b2 AS brand_name, m2 AS model, h2 AS heel_height, f2 AS forefoot_height,
 CASE WHEN "drop" IS NOT NULL THEN {d.r2(d.between('"drop"', 0, 20))} ELSE {d.r2('h2 - f2')} END AS "drop", {d.r2(d.between('g', 100, 600))} AS weight, {d.r2(d.between('usd', 40, 500))} AS price,
 {_E('cushioning_type', rules.ENUMS['cushioning_type'])} AS cushioning_type, {_E('upper_breathability', rules.ENUMS['upper_breathability'])} AS upper_breathability,
 (cast(coalesce(b2 <> brand_name, false) as int) + cast(coalesce(m2 <> model, false) as int) + cast(coalesce(h2 <> heel_height, false) as int) + cast(coalesce(f2 <> forefoot_height, false) as int)
  + cast("drop" IS NULL AND h2 IS NOT NULL AND f2 IS NOT NULL as int) + cast(coalesce(weight < 20, false) as int) + cast(coalesce(code <> 'USD', false) AND price IS NOT NULL as int)
  + cast(coalesce({_E('cushioning_type', rules.ENUMS['cushioning_type'])} <> cushioning_type, false) as int) + cast(coalesce({_E('upper_breathability', rules.ENUMS['upper_breathability'])} <> upper_breathability, false) as int)) AS n_changes,
 (cast(coalesce(heel_height NOT BETWEEN 10 AND 60, false) as int) + cast(coalesce(forefoot_height NOT BETWEEN 10 AND 60, false) as int) + cast(coalesce("drop" NOT BETWEEN 0 AND 20, false) as int)
  + cast(coalesce(g NOT BETWEEN 100 AND 600, false) as int) + cast(coalesce(usd NOT BETWEEN 40 AND 500, false) as int)
  + cast(cushioning_type IS NOT NULL AND {_E('cushioning_type', rules.ENUMS['cushioning_type'])} IS NULL as int)) AS n_warnings FROM n0"""


@query("normalize_specs", "N1", "SELECT * FROM n1", {"n0": _NORM0, "n1": _NORM})
def normalize_specs(t):
    df = normalize.normalize_specs(t.products, "currency")
    return df.select("id", "brand_name", "model", "heel_height", "forefoot_height", "drop", "weight", "price", "cushioning_type",
                     "upper_breathability", F.size("changes").alias("n_changes"), F.size("warnings").alias("n_warnings"))


@query("change_counts", "A12", f"""SELECT 'weight' AS field, 'Converted from oz to grams' AS reason, count(*) AS n FROM products WHERE weight < 20
 UNION ALL SELECT 'drop', 'Calculated from heel - forefoot', count(*) FROM n0 WHERE "drop" IS NULL AND h2 IS NOT NULL AND f2 IS NOT NULL
 UNION ALL SELECT 'brand_name', 'Applied brand normalization', count(*) FROM n0 WHERE b2 <> brand_name
 UNION ALL SELECT 'model', 'Removed noise words', count(*) FROM n0 WHERE m2 <> model
 UNION ALL SELECT 'forefoot_height', 'Rounded to 2 decimals', count(*) FROM n0 WHERE f2 <> forefoot_height
 UNION ALL SELECT 'price', 'Converted from ' || code || ' to USD', count(*) FROM n0 WHERE code <> 'USD' AND price IS NOT NULL GROUP BY code
 UNION ALL SELECT 'cushioning_type', 'Normalized to lowercase', count(*) FROM n0 WHERE {_E('cushioning_type', rules.ENUMS['cushioning_type'])} <> cushioning_type
 UNION ALL SELECT 'upper_breathability', 'Normalized to lowercase', count(*) FROM n0 WHERE lower(upper_breathability) <> upper_breathability""", {"n0": _NORM0})
def change_counts(t):
    return profile.change_counts(normalize.normalize_specs(t.products, "currency"))


@query("warning_counts", "A12", """SELECT kind, count(*) AS n FROM (SELECT unnest(list_filter([CASE WHEN heel_height NOT BETWEEN 10 AND 60 THEN 'heel_height out of range (10-60mm)' END,
 CASE WHEN "drop" NOT BETWEEN 0 AND 20 THEN 'drop out of range (0-20mm)' END, CASE WHEN g NOT BETWEEN 100 AND 600 THEN 'weight out of range (100-600g)' END,
 CASE WHEN usd NOT BETWEEN 40 AND 500 THEN 'price out of range (40-500 USD)' END, CASE WHEN cushioning_type = 'squishy' THEN 'Invalid cushioning_type' END], lambda x: x IS NOT NULL)) AS kind FROM n0) GROUP BY 1""", {"n0": _NORM0})
def warning_counts(t):
    return profile.warning_counts(normalize.normalize_specs(t.products, "currency"))


@query("post_process", "N2", f"""SELECT id, coalesce("drop", {d.r2('heel_height - forefoot_height')}) AS "drop",
 coalesce(waterproof, CASE WHEN surface_type = 'trail' THEN false END) AS waterproof FROM products""")
def post_process(t):
    return normalize.post_process(t.products).select("id", "drop", "waterproof")


@query("build_rows", "N5", f"""SELECT id, cast(source_id as varchar) AS article_id, coalesce(nullif(brand_name, ''), 'Unknown') AS brand_name, coalesce(nullif(model, ''), 'Unknown') AS model,
 CASE WHEN coalesce({d.key_part('brand_name')}, '') <> '' AND coalesce({d.key_part('model')}, '') <> '' THEN {d.key_part('brand_name')} || ' ' || {d.key_part('model')} ELSE '' END AS model_key,
 array_to_string(list_filter([CASE WHEN coalesce(brand_name, '') = '' THEN 'Missing brand_name' END, CASE WHEN coalesce(model, '') = '' THEN 'Missing model' END], lambda x: x IS NOT NULL), '|') AS warnings FROM products""")
def build_rows(t):
    df = normalize.build_rows(t.products, "source_id", "id", "date", "source_link")
    return df.select("id", "article_id", "brand_name", "model", "model_key", J("build_warnings").alias("warnings"))


@query("coerce_rows", "N6", """SELECT id, trim(brand_name) AS brand_name, trim(model) AS model, weight, waterproof, trim(cushioning_type) AS cushioning_type, "date" FROM products
 WHERE coalesce(trim(brand_name), '') <> '' AND coalesce(trim(model), '') <> ''""")
def coerce_rows(t):
    src = t.products.withColumns({"article_id": C("source_id").cast("string"), "weight": C("weight").cast("string"),
                                  "date": F.concat("date", F.lit("T00:00:00Z"))})
    return normalize.coerce_rows(src).select("id", "brand_name", "model", "weight", "waterproof", "cushioning_type", "date")


@query("rank_candidates", "N7", """SELECT doc_id, block_no, row_number() OVER (PARTITION BY doc_id ORDER BY coalesce(price, 0) % 3 DESC,
 length(brand_model) % 4 DESC, block_no) - 1 AS rank FROM blocks""", HEAD_CTES)
def rank_candidates(t):
    # candidates stay in the array of their article row
    cands = F.transform(blocks.headings(C("content")), lambda h, i: F.struct(
        (i + 1).alias("block_no"), (F.coalesce(h["price"], F.lit(0.0)) % 3).alias("score"),
        (F.length(h["brand_model"]) % 4).alias("richness"), F.lit(False).alias("from_title")))
    return t.articles.select("doc_id", F.posexplode(normalize.rank_candidates(cands)).alias("rank", "r")).select(
        "doc_id", "r.block_no", "rank")


@query("compose_values", "N7")
def compose_values(t):
    found = _specs(t).select(*_SPEC_COLS)
    fb = fallback.with_fallback_heights(t.articles.select("doc_id", "content"), "content")
    fb = fb.select("doc_id", "fb_heel", "fb_forefoot", "fb_drop", fallback.fallback_weight(C("content")).alias("fb_weight"),
                   fallback.fallback_price(C("content"))["price_usd"].alias("fb_price"), fallback.weird_price(C("content")).alias("odd_price"))
    return normalize.compose_values(found.join(fb, "doc_id")).select("doc_id", "block_no", "heel_height", "forefoot_height", "drop", "weight", "price")


@query("article_candidates", "N7,E2,E8")
def article_candidates(t):
    """Candidates of all articles with their real scores, ranked and composed."""
    return candidates.article_candidates(t.articles)


@query("similar_fold", "D6")
def similar_fold(t):
    heads = F.transform(blocks.headings(C("content")), lambda h: F.struct(
        blocks.split_brand_model(h["brand_model"])["brand_name"].alias("brand_name"),
        F.regexp_replace(blocks.split_brand_model(h["brand_model"])["model"], " [0-9]+$", "").alias("model"), h["price"].alias("price")))
    named = F.filter(heads, lambda h: h["model"].isNotNull())
    return t.articles.select("doc_id", F.posexplode(dedup.fold_similar(named, ["price"])).alias("no", "m")).select("doc_id", "no", "m.*")



def _flow_ctes() -> dict:
    """The main flow over the oracle forms of its steps."""
    from specforge.catalog.texts import _analysis_ctes, _relevance_sql
    names = "|".join(rules.MENTION_BRANDS)
    return SPECS | _analysis_ctes() | {
        "rel": _relevance_sql(rules.NON_SHOE_TERMS),
        "f0": f"""SELECT s.*, a."date" AS art_date, a.link, coalesce(s."drop", {d.r2('s.heel_height - s.forefoot_height')}) AS d0 FROM specs s JOIN articles a ON a.doc_id = s.doc_id
  JOIN an ON an.doc_id = s.doc_id JOIN rel ON rel.doc_id = s.doc_id WHERE rel.keep AND s.brand_name IS NOT NULL AND s.model IS NOT NULL
  AND (coalesce(s.heel_height, 0) <> 0 OR s."drop" IS NOT NULL) AND (s.primary_use IS NOT NULL OR s.surface_type IS NOT NULL)
  AND {d.m('s.brand_name', f'^(?:{names})$', '')} AND ({d.m('s.model', '[0-9]')} OR {d.m('s.model', rules.QUALITY_SERIES)})
  AND CASE an.scenario WHEN 'general' THEN true WHEN 'brand-only' THEN lower(s.brand_name) = lower(an.brand)
   ELSE lower(s.brand_name) = lower(an.brand) AND contains(lower(s.model), lower(an.model)) END""",
        "f1": f"""SELECT *, {d.squeeze(d.sub('model', r'\b(?:shoe|sneaker|running)\b'))} AS m2, {d.r2(d.between('heel_height', 10, 60))} AS h2, {d.r2(d.between('forefoot_height', 10, 60))} AS v2,
  CASE WHEN weight < 20 THEN {d.rnd('weight * 28.35')} ELSE weight END AS g FROM f0""",
        "flow": f"""SELECT doc_id, block_no, cast(doc_id as varchar) AS article_id, {d.mapping('brand_name', rules.BRAND_ALIASES, 'brand_name')} AS brand_name, m2 AS model,
  {d.key_part('brand_name')} || ' ' || {d.key_part('m2')} AS model_key, h2 AS heel_height, v2 AS forefoot_height,
  CASE WHEN d0 IS NOT NULL THEN {d.r2(d.between('d0', 0, 20))} ELSE {d.r2('h2 - v2')} END AS "drop", {d.r2(d.between('g', 100, 600))} AS weight, {d.r2(d.between('price', 40, 500))} AS price,
  carbon_plate, coalesce(waterproof, CASE WHEN surface_type = 'trail' THEN false END) AS waterproof, primary_use, surface_type, art_date AS "date", nullif(link, '') AS source_link
  FROM f1 QUALIFY row_number() OVER (PARTITION BY doc_id, lower(brand_name), lower(m2) ORDER BY block_no) = 1"""}


@query("article_products", "E1,E3,E4,E6,E7,F1,F10,F12,N1,N2,N5,D1", "SELECT * FROM flow", _flow_ctes())
def article_products(t):
    df = products.article_products(t.articles, unheaded=False, fold=False)
    return df.select("doc_id", "block_no", "article_id", "brand_name", "model", "model_key", "heel_height", "forefoot_height", "drop",
                     "weight", "price", "carbon_plate", "waterproof", "primary_use", "surface_type", "date", "source_link")


_FLOW_FIELDS = ["heel_height", "forefoot_height", "drop", "weight", "price", "carbon_plate", "waterproof", "primary_use", "surface_type"]


@query("coverage", "A8", f"""SELECT count(*) AS total_products, {d.r2(f"sum(2 + {' + '.join(f'cast({chr(34)}{c}{chr(34)} IS NOT NULL as int)' for c in _FLOW_FIELDS)}) * 100.0::double / (count(*) * 15.0::double)")} AS average_coverage,
 {', '.join(f'count("{c}") AS "{c}"' if c in _FLOW_FIELDS else f'0 AS "{c}"' for c in rules.SPEC_FIELDS)} FROM flow""", _flow_ctes())
def coverage(t):
    return profile.coverage(products.article_products(t.articles, unheaded=False, fold=False))


@query("coverage_products", "A8", f"""SELECT count(*) AS total_products, {d.r2(f"sum(2 + {' + '.join(f'cast({chr(34)}{c}{chr(34)} IS NOT NULL as int)' for c in rules.SPEC_FIELDS)}) * 100.0::double / (count(*) * 15.0::double)")} AS average_coverage,
 {', '.join(f'count("{c}") AS "{c}"' for c in rules.SPEC_FIELDS)} FROM products""")
def coverage_products(t):
    return profile.coverage(t.products)




@query("article_products_full", "E5,D6,J5,J6")
def article_products_full(t):
    """The main flow with mentions, folded names and responses (from `products`, by source)."""
    given = t.products.select(C("source_id").alias("doc_id"), C("id").alias("position"), "brand_name", "model", *rules.SPEC_FIELDS)
    df = products.article_products(t.articles, responses=given)
    return df.select("doc_id", "block_no", "article_id", "source_id", "brand_name", "model", "model_key", *rules.SPEC_FIELDS, "date", "source_link")


@query("coverage_full", "A8,E5,D6,J5,J6")
def coverage_full(t):
    """Coverage of the whole flow, articles without headings included."""
    return profile.coverage(products.article_products(t.articles))
