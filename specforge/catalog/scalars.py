"""Queries of the scalar functions and keys (P*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from specforge import rules
from specforge.catalog import duck as d
from specforge.catalog import query
from specforge.functions import keys, text, units
from specforge.operators import profile

C = F.col


@query("norm_text", "P1", f"""
SELECT doc_id, nullif({d.trim('text')}, '') AS body,
  nullif({d.trim("CASE doc_id % 3 WHEN 0 THEN '  ' WHEN 1 THEN ' x ' || source END")}, '') AS additional
FROM documents""")
def norm_text(t):
    extra = F.when(C("doc_id") % 3 == 0, "  ").when(
        C("doc_id") % 3 == 1, F.concat(F.lit(" x "), C("source")))
    return t.documents.select(
        "doc_id", text.norm_str(C("text")).alias("body"), text.norm_str(extra).alias("additional"))


@query("norm_text_whole", "P1", f"""
SELECT doc_id, length(t) AS n, md5(t) AS digest FROM (SELECT doc_id, nullif({d.trim('text')}, '') AS t FROM documents)""")
def norm_text_whole(t):
    whole = text.norm_str(C("text"))
    return t.documents.select("doc_id", F.length(whole).alias("n"), F.md5(whole).alias("digest"))


_MESSY = "cast(l_quantity as int) || ' units, -' || cast(l_linenumber as string)"


@query("parse_numbers", "P2,P3,P4", f"""
SELECT l_returnflag AS flag, count(n) AS parsed, sum(cast({d.rnd('n')} AS bigint))::bigint AS total,
       sum(pos)::bigint AS digits, round(sum(r), 2) AS rounded
FROM (SELECT l_returnflag, {d.to_num("'$ ' || cast(l_extendedprice as string) || ' each'")} AS n,
             try_cast(nullif(regexp_replace('no ' || cast(l_orderkey as string), '[^0-9]', '', 'g'), '') AS bigint) AS pos,
             {d.r2('l_extendedprice * 0.333')} AS r FROM lineitem) GROUP BY 1""")
def parse_numbers(t):
    li = t.lineitem
    n = text.to_num(F.concat(F.lit("$ "), C("l_extendedprice").cast("string"), F.lit(" each")))
    return li.groupBy(C("l_returnflag").alias("flag")).agg(
        F.count(n).alias("parsed"), F.sum(F.floor(n + F.lit(0.5))).alias("total"),
        F.sum(text.to_positive_int(F.concat(F.lit("no "), C("l_orderkey").cast("string")))).alias("digits"),
        F.round(F.sum(text.round2(C("l_extendedprice") * 0.333)), 2).alias("rounded"))


@query("convert_units", "P5", f"""
SELECT id, {d.rnd('weight / 28.0::double * 28.35')} AS grams, {d.r2('weight / 28.35')} AS ounces,
       {d.rnd('weight / 28.0::double * 28.3495')} AS grams_text FROM products""")
def convert_units(t):
    oz = C("weight") / F.lit(28.0)
    return t.products.select("id", units.oz_to_grams(oz).alias("grams"),
                             units.grams_to_oz(C("weight")).alias("ounces"),
                             units.oz_to_grams(oz, rules.OZ_TO_GRAMS_TEXT).alias("grams_text"))


@query("currency_to_usd", "P6", f"""
SELECT id, code, {d.r2(f"price * {d.mapping('code', rules.USD_RATES)}")} AS usd
FROM (SELECT id, price, CASE id % 13 WHEN 0 THEN 'USD' WHEN 1 THEN 'EUR' WHEN 2 THEN 'GBP' WHEN 3 THEN 'JPY'
 WHEN 4 THEN 'PLN' WHEN 5 THEN 'XXX' WHEN 6 THEN 'CAD' WHEN 7 THEN 'CHF' ELSE 'DKK' END AS code FROM products)""")
def currency_to_usd(t):
    code = None
    for i, c in enumerate(["USD", "EUR", "GBP", "JPY", "PLN", "XXX", "CAD", "CHF"]):
        code = (F if code is None else code).when(C("id") % 13 == i, c)
    p = t.products.select("id", "price", code.otherwise("DKK").alias("code"))
    return p.select("id", "code", text.round2(units.to_usd(C("price"), C("code"))).alias("usd"))


@query("detect_currency", "P7", f"""
SELECT doc_id, {d.case('upper(content)', rules.CURRENCY_PATTERNS, '')} AS currency FROM articles""")
def detect_currency(t):
    return t.articles.select("doc_id", units.detect_currency(C("content")).alias("currency"))


@query("range_checks", "P8", """
SELECT count(CASE WHEN price BETWEEN 40 AND 500 THEN 1 END) AS price_ok,
 count(CASE WHEN heel_height BETWEEN 10 AND 60 THEN 1 END) AS height_ok,
 count(CASE WHEN weight BETWEEN 100 AND 600 THEN 1 END) AS weight_ok,
 count(CASE WHEN "drop" BETWEEN 0 AND 20 THEN 1 END) AS drop_ok,
 count(CASE WHEN price BETWEEN 30 AND 600 THEN 1 END) AS price_ok_legacy FROM products""")
def range_checks(t):
    ok = lambda c, kind, b=rules.BOUNDS: F.count_if(units.in_bounds(C(c), kind, b))
    return t.products.agg(ok("price", "price").alias("price_ok"),
                          ok("heel_height", "height").alias("height_ok"),
                          ok("weight", "weight").alias("weight_ok"),
                          ok("drop", "drop").alias("drop_ok"),
                          ok("price", "price", rules.LEGACY_BOUNDS).alias("price_ok_legacy"))


@query("brand_alias", "P9", f"""
SELECT brand_name, {d.mapping(d.trim('brand_name'), rules.BRAND_ALIASES, d.trim('brand_name'))} AS alias,
 coalesce({d.mapping('upper(brand_name)', rules.BRAND_ALIASES)},
   {d.mapping(d.trim('brand_name'), rules.BRAND_ALIASES, d.trim('brand_name'))}) AS title_alias, count(*) AS n
FROM products GROUP BY ALL""")
def brand_alias(t):
    return (t.products.groupBy("brand_name").agg(F.count(F.lit(1)).alias("n"))
            .select("brand_name", units.brand_alias(C("brand_name")).alias("alias"),
                    units.brand_alias_ci(C("brand_name")).alias("title_alias"), "n"))


@query("brand_canon", "P10", f"""
SELECT id, coalesce({d.mapping('k', rules.BRAND_CANON)}, f, brand_name) AS brand_name
FROM (SELECT id, brand_name, k, CASE WHEN brand_name <> '' THEN first_value(brand_name) OVER (PARTITION BY k ORDER BY id) END AS f
      FROM (SELECT id, brand_name, lower(trim(brand_name)) AS k FROM products))""")
def brand_canon(t):
    return profile.canonical_brands(t.products.select("id", "brand_name"), "brand_name", "id")


_NOISE = r"\b(?:shoe|sneaker|running)\b"


@query("model_noise", "P11", f"""
SELECT id, {d.squeeze(d.sub('model', _NOISE))} AS model FROM products""")
def model_noise(t):
    return t.products.select("id", keys.strip_model_noise(C("model")).alias("model"))


def _refined(brand: str, model: str) -> str:
    """The refinement chain over a subquery with columns k, b, m."""
    steps = [f"SELECT k, {d.trim(f'coalesce({brand}, {chr(39) * 2})')} AS b, "
             f"{d.trim(f'coalesce({model}, {chr(39) * 2})')} AS m FROM src"]
    head = d.trim(d.sub(d.sub("m", r"\([^()]*\)"), r"\s*[:\-–—]\s+.*$"))
    steps.append(f"SELECT k, b, {head} AS m FROM ({steps[-1]})")
    bn, mn = d.key_part("b"), d.key_part("m")
    steps.append(f"SELECT k, b, CASE WHEN {bn} <> '' AND ({mn} = {bn} OR starts_with({mn}, {bn} || ' ')) "
                 f"THEN {d.trim('substring(m, length(b) + 1)')} ELSE m END AS m FROM ({steps[-1]})")
    for p in (r"\s+(?:multi\s+)?tester\s*$", r"\s+\d+\s+mile\s*$", r"^running\s+",
              r"\s+running\s*$", r"\s+review\s*$", r"\s+test\s*$"):
        steps.append(f"SELECT k, b, {d.trim(d.sub('m', p))} AS m FROM ({steps[-1]})")
    kip = d.sub("m", r"^kiprun\s+")
    last = d.squeeze(f"CASE WHEN {bn} = 'decathlon' THEN {kip} ELSE m END")
    return f"SELECT k, {last} AS model FROM ({steps[-1]})"


@query("refine_model", "P12", "SELECT k AS id, model FROM (" + _refined("brand_name", "noisy") + ")",
       {"src": """SELECT id AS k, brand_name, CASE id % 6 WHEN 0 THEN brand_name || ' ' || model || ' Review'
 WHEN 1 THEN model || ' (2024) - all new' WHEN 2 THEN 'Running ' || model || ' Multi Tester'
 WHEN 3 THEN model || ' 120 Mile' WHEN 4 THEN model || ' Test' ELSE model END AS noisy FROM products"""})
def refine_model(t):
    b, m = C("brand_name"), C("model")
    sp = F.lit(" ")
    noisy = (F.when(C("id") % 6 == 0, F.concat(b, sp, m, F.lit(" Review")))
             .when(C("id") % 6 == 1, F.concat(m, F.lit(" (2024) - all new")))
             .when(C("id") % 6 == 2, F.concat(F.lit("Running "), m, F.lit(" Multi Tester")))
             .when(C("id") % 6 == 3, F.concat(m, F.lit(" 120 Mile")))
             .when(C("id") % 6 == 4, F.concat(m, F.lit(" Test"))).otherwise(m))
    return t.products.select("id", keys.refine_model(b, noisy).alias("model"))


_ALT = "|".join(rules.BLOCK_BRANDS)


@query("strip_brand_prefix", "P13", f"""
SELECT id, {d.sub(d.sub(d.trim("brand_name || ' ' || model || CASE id % 4 WHEN 0 THEN ' performance' WHEN 1 THEN ' Shoe' ELSE '' END"),
                        rules.MODEL_NOISE_SUFFIX), f'^(?:{_ALT})' + chr(92) + 's+')} AS model FROM products""")
def strip_brand_prefix(t):
    tail = F.when(C("id") % 4 == 0, " performance").when(C("id") % 4 == 1, " Shoe").otherwise("")
    full = F.concat(C("brand_name"), F.lit(" "), C("model"), tail)
    return t.products.select("id", keys.strip_brand_prefix(full).alias("model"))


@query("model_key", "P14", f"""
SELECT doc_id, CASE WHEN {d.key_part('lang')} <> '' AND {d.key_part('text')} <> ''
  THEN {d.key_part('lang')} || '::' || {d.key_part('text')} ELSE '' END AS model_key,
  sha1({d.key_part('text')}) AS text_key FROM documents""")
def model_key(t):
    return t.documents.select(
        "doc_id", keys.model_key(C("lang"), C("text"), "::").alias("model_key"),
        F.sha1(keys.key_part(C("text"))).alias("text_key"))


@query("product_key", "P14", f"""
SELECT id, CASE WHEN coalesce({d.key_part('brand_name')}, '') <> '' AND coalesce({d.key_part('model')}, '') <> ''
  THEN {d.key_part('brand_name')} || ' ' || {d.key_part('model')} ELSE '' END AS model_key FROM products""")
def product_key(t):
    return t.products.select("id", keys.model_key(C("brand_name"), C("model")).alias("model_key"))


@query("iso_dates", "P15", """
SELECT o_orderkey, CASE o_orderkey % 4 WHEN 3 THEN NULL ELSE strftime(o_orderdate, '%Y-%m-%d') END AS day FROM orders""")
def iso_dates(t):
    ts = C("o_orderdate")
    raw = (F.when(C("o_orderkey") % 4 == 0, F.date_format(ts, "yyyy-MM-dd"))
           .when(C("o_orderkey") % 4 == 1, F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z")))
           .when(C("o_orderkey") % 4 == 2, F.date_format(ts, "MMM d, yyyy")).otherwise("soon"))
    return t.orders.select("o_orderkey", text.to_iso_date(raw).alias("day"))


@query("guarded_bigint", "P16", """
SELECT id, CASE WHEN id % 3 = 0 THEN id WHEN id % 3 = 1 THEN NULL ELSE source_id END AS article_id_int FROM products""")
def guarded_bigint(t):
    raw = (F.when(C("id") % 3 == 0, C("id").cast("string"))
           .when(C("id") % 3 == 1, F.concat(F.lit("rec"), C("id").cast("string")))
           .otherwise(C("source_id").cast("string")))
    return t.products.select("id", text.guarded_bigint(raw).alias("article_id_int"))


def _link(c: str) -> str:
    for p in ("'^https?://'", r"'^www\.'", "'/$'", r"'[?#][\s\S]*$'"):
        c = f"regexp_replace({c}, {p}, '')"
    return c


_BARE = r"regexp_replace(regexp_replace(regexp_replace(trim(link), '(?i)^https?://', ''), '(?i)^www\.', ''), '/+$', '')"


@query("source_id", "P17", f"""
SELECT doc_id, CASE WHEN doc_id % 3 = 0 AND doc_id <> 0 THEN 'article_' || cast(doc_id as varchar)
  WHEN link <> '' THEN 'link_' || {_link('link')} ELSE 'content_' || sha1({d.trim('content')}) END AS prefixed,
  CASE WHEN doc_id % 3 = 0 THEN cast(doc_id as varchar)
  WHEN trim(link) <> '' THEN {_BARE} ELSE sha1({d.trim('content')}) END AS bare FROM articles""")
def source_id(t):
    some = F.when(C("doc_id") % 3 == 0, C("doc_id"))
    return t.articles.select(
        "doc_id", keys.source_id(some, C("link"), C("content")).alias("prefixed"),
        keys.source_id(some.cast("string"), C("link"), C("content"), False).alias("bare"))


@query("page_link_key", "P17", f"SELECT page_id, 'link_' || {_link('url')} AS source_id FROM pages")
def page_link_key(t):
    none = F.lit(None)
    return t.pages.select("page_id", keys.source_id(none.cast("bigint"), C("url"), none.cast("string")
                                                    ).alias("source_id"))


@query("enum_values", "P18", f"""
SELECT id, CASE WHEN lower(trim(cushioning_type)) IN ('firm','balanced','max') THEN lower(trim(cushioning_type)) END AS cushioning,
 CASE WHEN lower(trim(upper_breathability)) IN ('low','medium','high') THEN lower(trim(upper_breathability)) END AS breathability
FROM products""")
def enum_values(t):
    return t.products.select(
        "id", text.enum(C("cushioning_type"), rules.ENUMS["cushioning_type"]).alias("cushioning"),
        text.enum(C("upper_breathability"), rules.ENUMS["upper_breathability"]).alias("breathability"))


_PHRASES = ("plush and High,firm ride,Moderate feel,Trail grip,asphalt,2E fit,slim,regular,Daily Trainer,tempo day,"
            "race ready,carbon fibre,no plate,Gore-Tex,not waterproof,excellent airflow,poor,average")
_VOCABS = ["cushioning", "cushioning_loose", "cushioning_sheet", "surface", "surface_loose", "width",
           "width_loose", "breathability", "use", "plate", "waterproof"]


@query("vocab_maps", "P19", "SELECT phrase, " + ", ".join(
    f"{d.case('lower(phrase)', rules.VOCAB[v], '')} AS {v}" for v in _VOCABS)
    + f""", count(*) AS n FROM (SELECT split_part('{_PHRASES}', ',', cast(l_partkey % 18 as int) + 1) AS phrase FROM lineitem) GROUP BY phrase""")
def vocab_maps(t):
    phrase = F.split_part(F.lit(_PHRASES), F.lit(","), (C("l_partkey") % 18).cast("int") + 1)
    g = t.lineitem.groupBy(phrase.alias("phrase")).agg(F.count(F.lit(1)).alias("n"))
    return g.select("phrase", "n", *[text.vocab(C("phrase"), rules.VOCAB[v]).alias(v) for v in _VOCABS])


@query("loose_booleans", "P20", """
SELECT event_id, CASE WHEN event_type = 'click' THEN true WHEN event_type = 'view' THEN false
  WHEN event_type = 'error' THEN NULL ELSE user_id % 3 <> 0 END AS flag FROM events""")
def loose_booleans(t):
    raw = (F.when(C("event_type") == "click", " Yes ").when(C("event_type") == "view", "FALSE")
           .when(C("event_type") == "error", "maybe").otherwise((C("user_id") % 3).cast("string")))
    return t.events.select("event_id", text.to_bool(raw).alias("flag"))


@query("sanitize_text", "P21", f"""
SELECT conv_id, turn, role, nullif({d.squeeze("regexp_replace(text, '[' || chr(1) || '-' || chr(31) || chr(127) || '-' || chr(159) || ']', '', 'g')")}, '') AS text
FROM conversations""")
def sanitize_text(t):
    return t.conversations.select("conv_id", "turn", "role", text.sanitize(C("text")).alias("text"))


@query("sheet_numbers", "P22", f"""
SELECT id, CASE id % 5 WHEN 0 THEN {d.rnd('weight')} WHEN 1 THEN {d.rnd('price')} WHEN 2 THEN {d.rnd('heel_height')} ELSE NULL END AS value
FROM products""")
def sheet_numbers(t):
    s = lambda c: C(c).cast("string")
    raw = (F.when(C("id") % 5 == 0, F.concat(F.lit("9.9 oz ("), s("weight"), F.lit("g)")))
           .when(C("id") % 5 == 1, F.concat(F.lit("$"), s("price")))
           .when(C("id") % 5 == 2, F.concat(s("heel_height"), F.lit(" mm")))
           .when(C("id") % 5 == 3, "N/A").otherwise("unknown"))
    return t.products.select("id", text.sheet_number(raw).alias("value"))


@query("tighten_rows", "P23", f"""
SELECT id, {d.trim('brand_name')} AS brand_name, r.model, {d.key_part(d.trim('brand_name'))} || '::' || {d.key_part('r.model')} AS model_key,
 cast(source_id AS varchar) AS source_id, weight
FROM products JOIN ({_refined('brand_name', 'model')}) r ON r.k = id
WHERE coalesce({d.trim('brand_name')}, '') <> '' AND r.model <> '' AND {d.key_part('r.model')} <> '' AND id <> 0""",
       {"src": "SELECT id AS k, brand_name, model FROM products"})
def tighten_rows(t):
    from specforge.operators.normalize import tighten
    return tighten(t.products.withColumn("article_id", C("id"))).select(
        "id", "brand_name", "model", "model_key", "source_id", "weight")


_PH = d.in_list(rules.PLACEHOLDERS)


@query("drop_placeholders", "P24", f"""
SELECT id, CASE WHEN lower(additional_features) NOT IN {_PH} THEN additional_features END AS additional_features,
 CASE WHEN lower(primary_use) NOT IN {_PH} THEN primary_use END AS primary_use FROM products""")
def drop_placeholders(t):
    return t.products.select("id", *[text.drop_placeholders(C(c), rules.PLACEHOLDERS).alias(c)
                                     for c in ("additional_features", "primary_use")])
