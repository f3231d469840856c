"""The main flow with mentions, fold and responses against a plain-Python flow."""

import os

import oracle
import pytest
import twins
from pyspark.sql import functions as F

from specforge import catalog, rules
from specforge.catalog.data import Tables
from specforge.operators import blocks, classify, dedup, normalize, titles
from specforge.plans import products

catalog.load()
FOLDER = f"{oracle.BASE}/{os.environ.get('SF', 'sf0.001')}"

EXTRA = [
    "I ran in the Nike Pegasus 40 and later the nike pegasus 41 Plus. Heel 32 mm, trail, drop: 8 mm, $140. "
    "The Hoka Speedgoat is a trail shoe; drop: 4 mm. On Cloud 5 costs 150 dollars on the road, drop: 9 mm.",
    "Asics Gel-Nimbus 25 for the road, drop: 8 mm. Asics Gel Nimbus 25 Lite! New Balance Fresh Foam 1080 v13, drop: 6 mm, road.",
    "Nike Pegasus 40\nroad, drop: 10 mm\n\nNike Pegasus 40 Trail 5 waterproof, drop: 9 mm",
    "Saucony Kinvara 14 Saucony Kinvara 14 Pro road drop: 4 mm, price: 130", "Brooks the best 3 shoes of 2024", "", " ",
]


@pytest.fixture(scope="module")
def articles(spark):
    base = Tables(spark, FOLDER).articles
    more = spark.createDataFrame(
        [(10_000 + k, f"s-{k}", ["Best Running Shoes 2024", "Nike Pegasus 40 Review", "Nike Running Shoes Overview"][k % 3], x,
          "2024-01-02", "https://www.example.org/x") for k, x in enumerate(EXTRA * 3)],
        "doc_id bigint, source_id string, title string, content string, date string, link string")
    return base.select(*more.columns).unionByName(more)


def test_mentions(spark, articles):
    texts = articles.select("doc_id", "content", F.transform(blocks.mentions(F.col("content")), lambda m: F.struct(
        m["heading"].alias("heading"), m["brand_model"].alias("brand_model"), m["price"].alias("price"), m["block"].alias("block"))).alias("m"))
    some = 0
    for r in texts.collect():
        assert [tuple(m) for m in r.m] == twins.mentions(r.content), r.doc_id
        some += len(r.m)
    assert some > 100


def brute(spark, articles, given):
    """The flow in plain Python around steps that have SQL of their own."""
    from collections import defaultdict
    kinds = {f: "string" for f in rules.TEXT_FIELDS} | {f: "boolean" for f in rules.BOOLEAN_FIELDS}
    kinds = {f: kinds.get(f, "double") for f in ("brand_name", "model", *rules.SPEC_FIELDS)} | {"brand_name": "string", "model": "string"}
    seen = articles.select("*", classify.relevance(F.col("title"), F.col("content"))["keep"].alias("keep"),
                           titles.analyze_title(F.col("title")).alias("an"), blocks.headings(F.col("content")).alias("heads")).collect()
    docs = {r.doc_id: r for r in seen if r.keep}
    cut = [(r.doc_id, no, *x) for r in docs.values() for no, x in enumerate(
        [tuple(h[f] for f in ("heading", "brand_model", "price", "block")) for h in r.heads] or twins.mentions(r.content), 1)]
    frame = spark.createDataFrame(cut, "doc_id bigint, block_no int, heading string, brand_model string, heading_price double, block string")
    found = defaultdict(list)
    for r in blocks.extract_specs(frame).orderBy("doc_id", "block_no").collect():
        row = {f: r[f] for f in kinds}
        if twins.usable(row):
            found[r.doc_id].append(row)
    answers = defaultdict(list)
    for r in given.orderBy("position").collect():
        answers[r.doc_id].append((r.position, {f: r[f] for f in kinds}))
    rows = []
    for i, d in docs.items():
        items = [r for r in twins.fold(found[i], kinds) if twins.in_scope(r, d.an.scenario, d.an.brand, d.an.model)]
        items = twins.completed(items, [g for _, g in answers[i]], d.an.scenario)
        rows += [(i, d.source_id, d.date, d.link, no, *r.values()) for no, r in twins.chosen(items, answers[i], d.an.scenario)]
    shape = "doc_id bigint, source_id string, date string, link string, block_no bigint, " + ", ".join(f"`{f}` {k}" for f, k in kinds.items())
    done = normalize.build_rows(normalize.normalize_specs(normalize.post_process(spark.createDataFrame(rows, shape))),
                                "doc_id", "source_id", "date", "link")
    first = {}
    for r in done.orderBy("doc_id", "block_no").collect():
        first.setdefault((r.doc_id, r.brand_name.lower(), r.model.lower()), r.asDict(recursive=True))
    return list(first.values())


def test_whole_flow(spark, articles):
    """All columns of all rows, with responses for some articles and without."""
    some = Tables(spark, FOLDER).products.select(F.col("source_id").alias("doc_id"), F.col("id").alias("position"), "brand_name", "model",
                                                 *rules.SPEC_FIELDS)
    named = spark.createDataFrame([(10_000 + k, 3, "nike", "PEGASUS 40") for k in range(0, 21, 2)],
                                  "doc_id bigint, position bigint, brand_name string, model string")
    filler = {"cushioning_type": F.lit("max"), "foot_width": F.lit("wide"), "waterproof": F.lit(True)}
    types = dict(some.dtypes)
    named = named.select("*", *[filler.get(f, F.lit(None)).cast(types[f]).alias(f) for f in rules.SPEC_FIELDS])
    given = some.unionByName(named)
    key = lambda r: repr(sorted(r.items(), key=lambda x: x[0]))
    for responses in (given, given.where("doc_id % 3 = 0"), given.limit(0)):
        got = products.article_products(articles, responses=responses)
        mine = sorted((r.asDict(recursive=True) for r in got.collect()), key=key)
        want = sorted(brute(spark, articles, responses), key=key)
        assert [key({k: r[k] for k in want[0]}) for r in mine] == [key(r) for r in want]
        assert len(want) > 50


def test_articles_are_read_once(spark):
    """One scan of the articles, one exchange of specs, one of responses, one for the first of each name."""
    t = Tables(spark, FOLDER)
    plan = catalog.QUERIES["article_products_full"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert t.articles.columns and plan.count("FileScan") == 2 and plan.count("documents.parquet") == 1
    exchanges = [x for x in plan.split("\n") if "Exchange hash" in x]
    assert len(exchanges) <= 4 and "content" not in "".join(exchanges)


def test_fold_on_random_names(spark):
    """D6 on random arrays: order, chains of extensions, zeros and blanks."""
    import random
    draw = random.Random(5)
    names = ["a", "ab", "abc", "abcdefghi", "abcde", "x", "xy 2", "xy", "Xy 22"]
    kinds = {"price": "double", "drop": "double", "primary_use": "string", "waterproof": "boolean"}
    rows = []
    for i in range(300):
        rows.append((i, [(draw.choice(["Nike", "nike", "On"]), draw.choice(names), draw.choice([None, 0.0, 5.0]), draw.choice([None, 0.0, 4.0]),
                          draw.choice([None, "", "road"]), draw.choice([None, False, True])) for _ in range(draw.randrange(7))]))
    df = spark.createDataFrame(rows, "i int, m array<struct<brand_name: string, model: string, price: double, drop: double, "
                                     "primary_use: string, waterproof: boolean>>")
    got = df.select("i", dedup.fold_similar(F.col("m"), ["price", "drop"], ["waterproof"], texts=["primary_use"]).alias("f")).collect()
    fields = ["brand_name", "model", *kinds]
    for r, (_, m) in zip(sorted(got), rows):
        want = twins.fold([dict(zip(fields, x)) for x in m], kinds)
        assert [{f: e[f] for f in fields} for e in r.f] == want


def test_candidates(spark, articles):
    """Rank, provenance and composed values against plain Python over all articles."""
    from specforge.functions import keys as keyfn
    from specforge.operators import fallback
    from specforge.plans import candidates
    base = fallback.with_fallback_heights(titles.brand_model_from_title(articles, "title"), "content")
    base = base.select("doc_id", "title_bm", titles.analyze_title(F.col("title"))["scenario"].alias("scenario"), "fb_heel", "fb_forefoot", "fb_drop",
                       fallback.fallback_weight(F.col("content")).alias("fb_weight"), fallback.weird_price(F.col("content")).alias("odd_price"),
                       fallback.fallback_price(F.col("content"))["price_usd"].alias("fb_price"),
                       keyfn.refine_model(F.trim("title_bm.brand"), F.col("title_bm.model")).alias("t_model"))
    specs = blocks.extract_specs(blocks.explode_blocks(articles, "content", ["doc_id"])).withColumn(
        "refined", keyfn.refine_model(F.col("brand_name"), F.col("model"))).orderBy("doc_id", "block_no").collect()
    flat = lambda c: " ".join(w for w in "".join(x if x.isalnum() and x.isascii() else " " for x in c.lower()).split())
    want = []
    for r in base.collect():
        found = [(s.brand_name, s.refined or s.model, {f: s[f] for f in rules.SPEC_FIELDS}) for s in specs if s.doc_id == r.doc_id]
        t_brand = (r.title_bm.brand or "").strip() or None
        got = twins.ranked_candidates(found, t_brand, r.t_model or None, r.title_bm.confidence, r.scenario == "specific",
                                      lambda b, m: f"{flat(b)} {flat(m)}")
        want += [(r.doc_id, k, origin, b, m, score, rich, *twins.composed(v, r.asDict()).values())
                 for k, (b, m, origin, score, rich, v) in enumerate(got, 1)]
    done = candidates.article_candidates(articles).select("doc_id", "rank", "origin", "brand_name", "model", "score", "richness", *rules.SPEC_FIELDS)
    assert sorted(map(tuple, done.collect()), key=repr) == sorted(want, key=repr)
    assert {w[2] for w in want} == {"text", "title", "title-single", "title-only"}
