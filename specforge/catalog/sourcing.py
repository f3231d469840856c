"""Queries of sources, loads and streams (S*, T*, N3, N4)."""

from __future__ import annotations

from pyspark.sql import functions as F

from specforge import rules
from specforge.catalog import duck as d
from specforge.catalog import query
from specforge.catalog.data import articles_of
from specforge.operators import dedup, normalize
from specforge.plans import products
from specforge.sources import exports, loads, pages, records, runs
from specforge.streaming import ingest, partitions

C = F.col
L = F.lit


def _records(t):
    """Source records: key bags with changing names."""
    k, s = C("doc_id"), C("doc_id").cast("string")
    m = lambda *kv: F.create_map(*[x if not isinstance(x, str) else L(x) for x in kv])
    fields = (F.when(k % 4 == 0, m("ID", F.concat(L("#"), s), "Title", C("title"), "Content", C("content"), "Created", C("date")))
              .when(k % 4 == 1, m("id", s, "Headline", F.concat(L("  "), C("title"), L(" ")), "Body", C("content"), "URL", C("link")))
              .when(k % 4 == 2, m("Article ID", s, "Name", C("title"), "Text", L("   "), "Link", C("link")))
              .otherwise(m("id", s, "title", C("title"), "text", C("content"), " Article Link ", C("link"))))
    return t.articles.select(F.concat(L("rec"), s).alias("id"), C("doc_id"), fields.alias("fields"))


@query("map_records", "S1", f"""SELECT doc_id, 'rec' || cast(doc_id as varchar) AS source_id, {d.trim('title')} AS title, md5({d.trim('content')}) AS digest, CASE WHEN doc_id % 4 = 0 THEN "date" END AS "date",
 CASE WHEN doc_id % 4 = 1 THEN nullif(link, '') END AS link FROM articles WHERE doc_id % 4 IN (0, 1) AND doc_id > 0 AND {d.trim('title')} <> '' AND {d.trim('content')} <> ''""")
def map_records(t):
    return records.map_records(_records(t).select("id", "fields")).select(
        "doc_id", "source_id", "title", F.md5("content").alias("digest"), "date", "link")


@query("record_outcomes", "S1", f"""SELECT doc_id, CASE WHEN doc_id = 0 THEN 'no_id' WHEN {d.trim('title')} = '' THEN 'no_title' WHEN doc_id % 4 IN (2, 3) OR {d.trim('content')} = '' THEN 'no_content' ELSE 'ok' END AS outcome FROM articles""")
def record_outcomes(t):
    return records.record_outcomes(_records(t)).select("doc_id", "outcome")


@query("scan_articles", "S2", f"""SELECT doc_id, cast(doc_id as varchar) AS source_id, {d.trim('title')} AS title, "date" FROM (SELECT * FROM articles ORDER BY "date" DESC, doc_id LIMIT 100)
 WHERE doc_id > 0 AND {d.trim('title')} <> '' AND {d.trim('content')} <> ''""")
def scan_articles(t):
    return records.scan_articles(t.articles, "doc_id", "title", "content", "date", 100).select("doc_id", "source_id", "title", "date")


@query("pick_ci", "S3", """SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN content WHEN 2 THEN '   ' WHEN 3 THEN content END IS NOT NULL AS has_text, CASE doc_id % 4 WHEN 3 THEN link END AS link FROM articles""")
def pick_ci(t):
    return _records(t).select("doc_id", records.pick_ci(C("fields"), ["Content", "Text"]).isNotNull().alias("has_text"),
                              records.pick_ci(C("fields"), ["article link"]).alias("link"))


@query("pick_normalized", "S4", """SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'a ' || event_type WHEN 1 THEN event_type ELSE 'none' END AS value FROM events""")
def pick_normalized(t):
    k = C("event_id")
    bag = (F.when(k % 3 == 0, F.create_map(L("Article_Link"), F.concat(L('["a", "'), C("event_type"), L('"]'))))
           .when(k % 3 == 1, F.create_map(L("article-link"), C("event_type"))).otherwise(F.create_map(L("ARTICLE LINK"), L("  "))))
    return t.events.select("event_id", records.pick_normalized(bag, ["Article Link"], L("none")).alias("value"))


@query("nested_urls", "S5", """SELECT page_id, CASE page_id % 6 WHEN 5 THEN NULL ELSE trim(url) END AS url FROM pages""")
def nested_urls(t):
    k, u = C("page_id"), C("url")
    j = lambda a, b: F.concat(L(a), u, L(b))
    raw = (F.when(k % 6 == 0, u).when(k % 6 == 1, j('["', '"]')).when(k % 6 == 2, j('[{"url": "', '"}]'))
           .when(k % 6 == 3, j('{"url": " ', ' ", "x": 1}')).when(k % 6 == 4, j('"', '"')).otherwise("{}"))
    return t.pages.select("page_id", records.nested_url(raw).alias("url"))


@query("date_chain", "S5", """SELECT o_orderkey, CASE o_orderkey % 3 WHEN 2 THEN '2024-01-01' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS day FROM orders""")
def date_chain(t):
    k, s = C("o_orderkey"), F.date_format("o_orderdate", "yyyy-MM-dd")
    c = records.date_chain(F.when(k % 3 == 0, s).otherwise("n/a"), F.when(k % 3 == 1, s), now=L("2024-01-01"))
    return t.orders.select("o_orderkey", F.date_format(c, "yyyy-MM-dd").alias("day"))


_SHEET = """SELECT id, lower(replace(brand_name, ' ', '-')) || '_' || lower(regexp_replace(model, '\\s+', '-', 'g')) AS article_id, floor(heel_height + 0.5) AS heel_height, floor(weight + 0.5) AS weight,
 CASE WHEN id % 3 = 0 THEN true END AS carbon_plate, id % 2 = 0 AS waterproof, CASE id % 4 WHEN 0 THEN 'max' WHEN 1 THEN 'balanced' WHEN 2 THEN 'firm' END AS cushioning_type,
 CASE id % 3 WHEN 0 THEN 'standard' WHEN 1 THEN 'wide' END AS foot_width FROM products WHERE coalesce(trim(brand_name), '') <> '' AND coalesce(trim(model), '') <> ''"""


def _sheet(t):
    k, s = C("id"), lambda c: C(c).cast("string")
    return t.products.select(
        "id", C("brand_name").alias("brand"), "model", C("primary_use").alias("use"), C("surface_type").alias("surface"),
        F.concat(s("heel_height"), L(" mm")).alias("heel"), F.concat(s("forefoot_height"), L(" mm")).alias("forefoot"), s("drop").alias("drop"),
        F.concat(L("9 oz ("), s("weight"), L("g)")).alias("weight"), F.concat(L("$"), s("price")).alias("price"),
        F.when(k % 3 == 0, "Carbon").when(k % 3 == 1, "no").otherwise("N/A").alias("plate"), F.when(k % 2 == 0, "Yes").otherwise("No").alias("waterproof"),
        F.when(k % 4 == 0, "Plush").when(k % 4 == 1, "Responsive ride").when(k % 4 == 2, "minimal").otherwise("N/A").alias("cushioning"),
        F.when(k % 3 == 0, "Normal").when(k % 3 == 1, "wide").otherwise("N/A").alias("width"), L("High").alias("breathability"), "source_link")


@query("sheet_rows", "S6", f"SELECT article_id, count(*) AS n, sum(heel_height) AS heel, sum(weight) AS weight, count(carbon_plate) AS plates, count(CASE WHEN waterproof THEN 1 END) AS wet, count(cushioning_type) AS cushioned, count(foot_width) AS wide FROM ({_SHEET}) GROUP BY 1")
def sheet_rows(t):
    return loads.map_sheet(_sheet(t), L("2024-01-01")).groupBy("article_id").agg(
        F.count(L(1)).alias("n"), F.sum("heel_height").alias("heel"), F.sum("weight").alias("weight"), F.count("carbon_plate").alias("plates"),
        F.count_if("waterproof").alias("wet"), F.count("cushioning_type").alias("cushioned"), F.count("foot_width").alias("wide"))


@query("sheet_inserts", "S6", f"SELECT article_id, weight FROM (SELECT article_id, arg_min(weight, coalesce(weight, 1e9)) AS weight FROM ({_SHEET}) GROUP BY 1) WHERE article_id NOT IN (SELECT lower(brand_name) || '_' || lower(model) FROM products WHERE id % 10 = 0 AND brand_name IS NOT NULL)")
def sheet_inserts(t):
    rows = loads.map_sheet(_sheet(t), L("2024-01-01"))
    have = t.products.filter("id % 10 = 0 and brand_name is not null").select(F.concat(F.lower("brand_name"), L("_"), F.lower("model")).alias("article_id"))
    return loads.insert_absent(have, rows, "article_id", [C("weight").asc_nulls_last()]).select("article_id", "weight")


@query("mark_synced", "S7", """SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN 'Synced' ELSE o_orderstatus END AS o_orderstatus FROM orders""")
def mark_synced(t):
    new = records.only_new(t.orders, "o_orderstatus", "O")
    return records.mark_synced(t.orders.select("o_orderkey", "o_orderstatus"), new, "o_orderkey", "o_orderstatus")


_MARK = "TIMESTAMP '2024-01-10 00:00:00'"


def _outcomes(t):
    mark = L("2024-01-10 00:00:00").cast("timestamp_ntz")
    return mark, loads.load_outcomes(
        t.events, "ts", mark, F.when(C("user_id") % 10 != 0, C("user_id")), F.when(C("event_type") == "error", "").otherwise(C("props")),
        C("event_type") != "signup", C("value") > 5)


_OUT = f"""SELECT ts, CASE WHEN ts <= {_MARK} THEN 'LATE' WHEN user_id % 10 = 0 THEN 'NO_ID' WHEN event_type = 'error' THEN 'NO_CONTENT' WHEN event_type = 'signup' THEN 'CONVERTER_EMPTY' WHEN NOT value > 5 THEN 'CORE_EMPTY' ELSE 'OK' END AS outcome FROM events"""


@query("incremental_load", "S8", f"SELECT outcome, count(*) AS n FROM ({_OUT}) GROUP BY 1")
def incremental_load(t):
    return _outcomes(t)[1].groupBy("outcome").agg(F.count(L(1)).alias("n"))


@query("load_state", "S8", f"""SELECT strftime(max(CASE WHEN outcome <> 'LATE' THEN ts END), '%Y-%m-%d %H:%M:%S') AS last_created_at, count(CASE WHEN outcome = 'OK' THEN 1 END) AS n_ok, count(CASE WHEN outcome = 'LATE' THEN 1 END) AS n_late FROM ({_OUT})""")
def load_state(t):
    mark, out = _outcomes(t)
    return loads.next_state(out, "ts", mark).select(F.date_format("last_created_at", "yyyy-MM-dd HH:mm:ss").alias("last_created_at"), "n_ok", "n_late")


@query("rows_after_mark", "S8", f"SELECT event_id FROM events WHERE ts > {_MARK}")
def rows_after_mark(t):
    return loads.after_mark(t.events, "ts", L("2024-01-10 00:00:00").cast("timestamp_ntz")).select("event_id")


@query("page_text", "S9", f"""SELECT page_id, md5({d.squeeze("regexp_replace(html, '<[^>]*>', ' ', 'g')")}) AS digest FROM pages""")
def page_text(t):
    return t.pages.select("page_id", F.md5(pages.light_text(C("html"))).alias("digest"))


@query("parsed_pages", "S10")
def parsed_pages(t):
    return pages.parse_pages(t.pages, ["page_id"]).select("page_id", F.length("body_text").alias("chars"), F.size("tables").alias("tables"))


def _responses(t):
    k, s = C("id"), C("id").cast("string")
    item = F.concat(L('{"brand_name":"'), F.coalesce(C("brand_name"), L("")), L('","model":"'), C("model"), L(' review","heel_height":"'), s,
                    L('.4 mm","forefoot_height":25,"weight":"250.6","price":'), (k % 300 + 50).cast("string"), L(',"price_currency":"€","carbon_plate":"Yes","cushioning":"Plush max","width":"2E"}'))
    body = (F.when(k % 5 == 0, F.concat(L('{"items":['), item, L(","), item, L("]}")))
            .when(k % 5 == 1, F.concat(L('{"sneakers":['), item, L("]}"))).when(k % 5 == 2, F.concat(L('{"model":'), item, L("}")))
            .when(k % 5 == 3, L("oops {")).otherwise(L('{"models":[]}')))
    return t.products.select("id", body.alias("raw"))


@query("response_items", "S11", """SELECT id, i AS item_no, nullif(brand_name, '') AS brand_name, model || ' review' AS model, cast(id as varchar) || '.4 mm' AS heel_height, 'Plush max' AS cushioning_type
 FROM (SELECT id, coalesce(brand_name, '') AS brand_name, model, unnest(CASE WHEN id % 5 = 0 THEN [0, 1] ELSE [0] END) AS i FROM products WHERE id % 5 IN (0, 1, 2))""")
def response_items(t):
    return loads.response_items(_responses(t), "raw", ["id"]).select("id", "item_no", "brand_name", "model", "heel_height", "cushioning_type")


@query("bad_responses", "S11", "SELECT id FROM products WHERE id % 5 = 3")
def bad_responses(t):
    return loads.bad_responses(_responses(t), "raw").select("id")


@query("json_props", "S11", "SELECT event_id, cast(json_extract_string(props, '$.k') as bigint) AS k FROM events")
def json_props(t):
    return t.events.select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


_H = "(id + 0.4)"
_ALIAS = d.mapping(d.trim("brand_name"), rules.BRAND_ALIASES, d.trim("brand_name"))


@query("response_specs", "N3", f"""SELECT id, nullif({_ALIAS}, '') AS brand_name, {d.sub(d.trim("model || ' review'"), rules.MODEL_NOISE_SUFFIX)} AS model, CASE WHEN {_H} BETWEEN 10 AND 60 THEN floor({_H} + 0.5) END AS heel_height,
 CASE WHEN {_H} BETWEEN 10 AND 60 THEN floor({_H} + 0.5) - 25.0 END AS "drop", 251.0 AS weight, CASE WHEN (id % 300 + 50) * 1.08::double BETWEEN 40 AND 500 THEN {d.r2('(id % 300 + 50)::double * 1.08::double')} END AS price, true AS carbon_plate, 'max' AS cushioning_type, 'wide' AS foot_width
 FROM (SELECT *, unnest(CASE WHEN id % 5 = 0 THEN [0, 1] ELSE [0] END) AS i FROM products WHERE id % 5 IN (0, 1, 2))""")
def response_specs(t):
    items = loads.response_items(_responses(t), "raw", ["id"])
    return normalize.response_specs(items).select("id", "brand_name", "model", "heel_height", "drop", "weight", "price", "carbon_plate", "cushioning_type", "foot_width")


@query("sanitized_responses", "N4", f"""SELECT id, nullif({d.squeeze('brand_name')}, '') AS brand_name, {d.squeeze("model || ' review'")} AS model, id + 0.4::double AS heel_height, 250.6::double AS weight, (id % 300 + 50)::double AS price, true AS carbon_plate, NULL AS cushioning_type
 FROM (SELECT *, unnest(CASE WHEN id % 5 = 0 THEN [0, 1] ELSE [0] END) AS i FROM products WHERE id % 5 IN (0, 1, 2))""")
def sanitized_responses(t):
    items = loads.response_items(_responses(t), "raw", ["id"])
    return normalize.sanitize_response(items).select("id", "brand_name", "model", "heel_height", "weight", "price", "carbon_plate", "cushioning_type")


@query("fetch_by_ids", "S16", "SELECT DISTINCT ON (brand_name, model) id FROM products WHERE source_id IN (SELECT n_nationkey FROM nation) ORDER BY brand_name, model, id")
def fetch_by_ids(t):
    hit = records.by_ids(t.products, t.nation.select(C("n_nationkey").cast("bigint").alias("source_id")), "source_id")
    return dedup.first_per_key(hit, [C("brand_name"), C("model")], [C("id")]).select("id")


# --- streams -------------------------------------------------------------------------------

@query("stream_ingest", "T1", """SELECT o_custkey AS source_id, o_orderkey AS id, o_totalprice AS price FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1""")
def stream_ingest(t):
    schema = "source_id bigint, id bigint, price double"
    base = exports.shared_dir(t.spark)
    stream = ingest.table_stream(t.spark, f"{t.folder}/orders.parquet", t.orders.schema)
    table = exports.VersionedTable(t.spark, f"{base}/table")
    shape = lambda b: b.select(C("o_custkey").alias("source_id"), C("o_orderkey").alias("id"), C("o_totalprice").alias("price"))
    ingest.ingest(stream, shape, table, schema, f"{base}/checkpoint", "id", ["source_id"])
    return table.read(schema)


@query("late_counts", "T2", f"SELECT count(CASE WHEN ts > {_MARK} THEN 1 END) AS accepted, count(CASE WHEN ts <= {_MARK} THEN 1 END) AS late, strftime(max(ts), '%Y-%m-%d') AS new_mark FROM events")
def late_counts(t):
    r = ingest.late_counts(t.events, "ts", L("2024-01-10 00:00:00").cast("timestamp_ntz"))
    return r.select("accepted", "late", F.date_format("new_mark", "yyyy-MM-dd").alias("new_mark"))


@query("stream_dedup", "T2", "SELECT event_id, user_id FROM events")
def stream_dedup(t):
    base = exports.shared_dir(t.spark)
    stream = ingest.table_stream(t.spark, f"{t.folder}/events.parquet", t.events.schema).withColumn("ts", C("ts").cast("timestamp"))
    stream = stream.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))  # every event comes twice
    kept = ingest.drop_late(stream, "ts", "event_id", "30 days").select("event_id", "user_id")
    q = (kept.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/cp")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return t.spark.read.parquet(f"{base}/out")


_DELAY = 10     # days


@query("stream_late_rows", "T2", f"""SELECT count(CASE WHEN ts > m THEN 1 END) AS kept, count(CASE WHEN ts <= m THEN 1 END) AS dropped FROM events,
 (SELECT max(ts) - INTERVAL {_DELAY} DAY AS m FROM events)""")
def stream_late_rows(t):
    """The newest day arrives first, then the other days within the delay, then all rows behind the watermark.

    A batch tells late rows by the watermark of the batch before, so one lies between.
    """
    base = exports.shared_dir(t.spark)
    events = t.events.withColumn("ts", C("ts").cast("timestamp"))
    newest = events.agg(F.max("ts").alias("newest"))
    age = C("newest") - C("ts")
    dealt = events.join(F.broadcast(newest), F.lit(True))     # one row
    day, delay = (F.expr(f"INTERVAL {n} DAYS") for n in (1, _DELAY))
    for part in (age < day, (age >= day) & (age < delay), age >= delay):
        dealt.where(part).drop("newest").write.mode("append").parquet(f"{base}/in")
    stream = ingest.file_stream(t.spark, f"{base}/in", events.schema, max_files=1)
    query = ingest.run_to_files(ingest.drop_late(stream, "ts", "event_id", f"{_DELAY} days").select("event_id"), f"{base}/out", f"{base}/cp")
    kept = t.spark.read.schema("event_id bigint").parquet(f"{base}/out")
    return kept.agg(F.count("*").alias("kept")).withColumn("dropped", L(ingest.rows_behind_mark(query)).cast("bigint"))


def _stream_ctes():
    from specforge.catalog.extraction import _flow_ctes
    return _flow_ctes()


@query("stream_articles", "T1,F1,E3,N2,L1", "SELECT * FROM flow", _stream_ctes())
def stream_articles(t):
    """Articles as a stream through relevance, specs and normal form into a partitioned table."""
    base = exports.shared_dir(t.spark)
    columns = "doc_id bigint, block_no int, article_id string, source_id string, brand_name string, model string, model_key string, " \
              "heel_height double, forefoot_height double, drop double, weight double, price double, carbon_plate boolean, " \
              "waterproof boolean, primary_use string, surface_type string, date string, source_link string"
    table = partitions.PartitionedTable(t.spark, f"{base}/products", columns, "block_no")
    stream = articles_of(ingest.table_stream(t.spark, f"{t.folder}/documents.parquet", t.documents.schema))
    flow = lambda batch: products.article_products(batch, unheaded=False, fold=False).select(*table.schema.names[:-1])
    partitions.ingest(stream, flow, table, f"{base}/checkpoint")
    return table.read().drop("source_id")


# --- a load as one version -------------------------------------------------------------------

_NEW = "id % 3 <> 0"
_FIRST = "DATE '1998-01-01'"
_RUN = f"""SELECT *, CASE WHEN coalesce(trim(model), '') = '' THEN 'NO_CONTENT' WHEN brand_name IS NULL THEN 'CONVERTER_EMPTY'
 WHEN coalesce(weight, heel_height) IS NULL THEN 'CORE_EMPTY' ELSE 'OK' END AS outcome FROM products WHERE {_NEW}"""


_N = lambda o: f"count(CASE WHEN seen AND NOT late AND outcome = '{o}' THEN 1 END) AS n_{o.lower()}"


@query("load_run", "S7,S8,S15,A11", f"""SELECT strftime(max(CASE WHEN seen AND NOT late THEN created_at END), '%Y-%m-%d') AS last_created_at,
 count(CASE WHEN seen AND late THEN 1 END) AS n_late, {', '.join(map(_N, ('OK', 'NO_CONTENT', 'CONVERTER_EMPTY', 'CORE_EMPTY')))},
 count(CASE WHEN outcome = 'OK' THEN 1 END) AS target_rows, round(sum(CASE WHEN outcome = 'OK' THEN coalesce(price, 0) END), 2) AS target_price,
 count(CASE WHEN outcome = 'OK' THEN 1 END) AS synced
 FROM (SELECT *, NOT (early AND outcome = 'OK') AS seen, coalesce(created_at <= m, false) AS late FROM (
  SELECT *, created_at < {_FIRST} AS early, max(CASE WHEN created_at < {_FIRST} THEN created_at END) OVER () AS m FROM ({_RUN})))""")
def load_run(t):
    """Two runs: rows up to a day first, then all; the second sees the first's rejected rows as late and its accepted ones as synced."""
    base = exports.shared_dir(t.spark)
    table = exports.VersionedTable(t.spark, f"{base}/products")
    source = t.products.withColumn("status", F.when(C("id") % 3 != 0, "New").otherwise("Held"))
    target = source.drop("status").limit(0)
    how = {"key": "id", "position": "id", "status": "status", "created": "created_at", "content": C("model"),
           "converted": C("brand_name").isNotNull(), "core": F.coalesce("weight", "heel_height").isNotNull()}
    runs.load_new(table, source.where(f"created_at < {_FIRST}"), target, **how)
    later = source.where(f"created_at >= {_FIRST}").unionByName(runs.part(table, "source"))
    runs.load_new(table, later, target, **how)
    exports.write_report(runs.part(table, "report"), f"{base}/report")
    report = t.spark.read.json(f"{base}/report").select(
        F.substring("last_created_at", 1, 10).alias("last_created_at"), "n_ok", "n_late", "n_no_content", "n_converter_empty", "n_core_empty")
    rows = runs.part(table, "rows").agg(F.count("*").alias("target_rows"), F.round(F.sum(F.coalesce("price", L(0))), 2).alias("target_price"))
    synced = runs.part(table, "source").agg(F.count_if(C("status") == "Synced").alias("synced"))
    return report.join(rows, L(True)).join(synced, L(True))      # one row each
