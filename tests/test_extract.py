"""Golden cases of classification and extraction."""

import pytest
from pyspark.sql import functions as F

from specforge import rules
from specforge.operators import blocks, classify, dedup, fallback, tables, titles, windows
from specforge.plans import article_specs, products
from specforge.sources import pages

ROUNDUP = """Best Road Running Shoes: Hoka Clifton 9 ($145)
At 8.9 ounces (252 grams), the Clifton 9 is light, and with 32 millimeters of stack height, it features a lot of cushion.

Best Road Running Shoes — Runner-Up: Nike Pegasus 41 ($155)
The Pegasus boasts ReactX foam and an Air Zoom unit in the heel. It is a versatile road running shoe.

Best Trail Running Shoes: Hoka Speedgoat 6 ($155)
Trail shoe at 9.8 ounces (280 grams), with 40-millimeter stack height at the heel (men's), 5-millimeter lugs, Vibram Megagrip.

Best Trail Running Shoes — Runner-Up: Nike Pegasus Trail 5 ($150)
Weighing 10.2 ounces (289 grams) with a 9.5-millimeter drop and 37-millimeter stack height at the heel. All Terrain Compound outsole; good for road-to-trail."""


def docs(spark, *texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id int, content string")


def test_headings_and_specs(spark):
    rows = blocks.extract_specs(blocks.explode_blocks(docs(spark, ROUNDUP), "content", ["doc_id"])
                                ).orderBy("block_no").collect()
    assert [r["brand_model"] for r in rows] == ["Hoka Clifton 9", "Nike Pegasus 41", "Hoka Speedgoat 6",
                                                "Nike Pegasus Trail 5"]
    first, last = rows[0], rows[3]
    assert (first["brand_name"], first["model"], first["price"]) == ("Hoka", "Clifton 9", 145.0)
    assert (first["weight"], first["heel_height"], first["surface_type"], first["primary_use"]) == (
        252.0, 32.0, "road", "road")
    assert (last["weight"], last["heel_height"], last["drop"], last["price"]) == (289.0, 37.0, 9.5, 150.0)


def test_no_leak_between_blocks(spark):
    rows = blocks.extract_specs(blocks.explode_blocks(docs(spark, ROUNDUP), "content", ["doc_id"])
                                ).orderBy("block_no").collect()
    assert rows[1]["weight"] is None and rows[1]["drop"] is None and rows[2]["drop"] is None


def test_rejected_heading_joins_previous_block(spark):
    t = "Shoes: Nike Ghost 5\nfirst\nShoes: lower case words\nsecond"
    rows = blocks.explode_blocks(docs(spark, t), "content", ["doc_id"]).collect()
    assert len(rows) == 1
    assert rows[0]["block"] == "Shoes: Nike Ghost 5\nfirst\nShoes: lower case words\nsecond"


def test_zero_drop_and_negation(spark):
    t = "Shoes: Altra Torin 7\nA zero-drop shoe, not waterproof, carbon fiber plate on the road."
    r = blocks.extract_specs(blocks.explode_blocks(docs(spark, t), "content", ["doc_id"])).first()
    assert r["drop"] == 0.0 and r["waterproof"] is None and r["carbon_plate"] is True


@pytest.mark.parametrize("title,scenario,brand,model", [
    ("Nike Vaporfly 3 Review", "specific", "Nike", "vaporfly 3"),
    ("Best Running Shoes 2024", "general", None, None),
    ("Adidas Running Shoes Overview", "brand-only", "Adidas", None),
    ("Hoka Speedgoat 5 Trail Review", "specific", "Hoka", "speedgoat 5"),
    ("Trail Running Tips", "general", None, None),
    ("Marathon training plan", "general", None, None)])
def test_title_analysis(spark, title, scenario, brand, model):
    a = spark.createDataFrame([(title,)], "t string").select(titles.analyze_title(F.col("t")).alias("a")).first()["a"]
    assert (a["scenario"], a["brand"], a["model"]) == (scenario, brand, model)
    assert a["confidence"] > 0.7


def test_title_substring_mode(spark):
    df = spark.createDataFrame([("Marathon training plan",)], "t string")
    a = df.select(titles.analyze_title(F.col("t"), strict_substrings=True).alias("a")).first()["a"]
    assert a["brand"] == "on"


@pytest.mark.parametrize("title,brand,model", [
    ("How the Asics GT-2000 14 Delivers Both", "Asics", "GT-2000"),
    ("Nils’s Puma Fast-R Nitro 3 In Depth", "Puma", "Fast-R Nitro 3"),
    ("Kurt's Mizuno Wave Sky 9 Review", "Mizuno", "Wave Sky 9"),
    ("Li Ning Feidian 5 Elite Review", "Li-Ning", "Feidian 5 Elite"),
    ("Test des Mount to Coast T1 – a long look", "Mount to Coast", "T1"),
    ("Saucony Endorphin Speed 5: first thoughts", "Saucony", "Endorphin Speed 5")])
def test_brand_model_from_title(spark, title, brand, model):
    df = titles.brand_model_from_title(spark.createDataFrame([(title,)], "t string"), "t")
    bm = df.first()["title_bm"]
    assert (bm["brand"], bm["model"]) == (brand, model)


def scope(spark, brand, model, scenario, tb, tm):
    row = spark.createDataFrame([(brand, model, scenario, tb, tm)], "b string, m string, s string, tb string, tm string")
    return row.select(titles.in_scope(*[F.col(c) for c in ("b", "m", "s", "tb", "tm")]).alias("x")).first()["x"]


def test_scope(spark):
    assert scope(spark, "Nike", "Vaporfly 3", "general", None, None)
    assert scope(spark, "Nike", "Vaporfly 3", "specific", "Nike", "Vaporfly 3")
    assert not scope(spark, "Adidas", "Adizero Pro 3", "specific", "Nike", "Vaporfly 3")
    assert scope(spark, "nike", "x", "brand-only", "Nike", None)
    assert not scope(spark, "Adidas", "x", "brand-only", "Nike", None)


def prefilter(spark, content):
    return classify.with_prefilter(docs(spark, content), "content").first()


def test_prefilter_golden(spark):
    r = prefilter(spark, "running " * 200)
    assert not r["prefilter_ok"] and r["prefilter_score"] == 6.0
    r = prefilter(spark, "This shoe has a heel-to-toe drop of 8mm and stack height of 32mm.\nBut this article is "
                         "also about bikes, cycling, and GPS watches.\nWe also discuss jackets and backpacks.\n$120")
    assert r["prefilter_has_anchor"] and r["prefilter_neg_hits"] and not r["prefilter_ok"]
    r = prefilter(spark, "The Nike Pegasus 41 features a 10mm drop and weighs 285g.\nThe heel stack is 36mm and "
                         "forefoot is 26mm.\nThe shoe has a carbon plate and is waterproof.\nPrice is $130.")
    assert r["prefilter_ok"] and r["prefilter_has_anchor"] and not r["prefilter_neg_hits"]
    r = prefilter(spark, "The shoe has a drop of 8mm. " + "bike cycling watch GPS jacket backpack " * 50)
    assert not r["prefilter_ok"]


def test_relevance_bounded_terms(spark):
    df = spark.createDataFrame([("What to know about brands", "midsole, outsole and grip"),
                                ("Best hats", "x"), ("Обзор: кроссовки", None)], "t string, c string")
    got = [r["r"]["keep"] for r in df.select(classify.relevance(F.col("t"), F.col("c")).alias("r")).collect()]
    assert got == [True, True, True] or got[0] is True and got[2] is True
    loose = df.select(classify.relevance(F.col("t"), F.col("c"), True).alias("r")).first()["r"]
    assert loose["keep"] is False


def test_windows(spark):
    text = "x" * 50 + "g" + "x" * 100 + "drop" + "x" * 50
    r = docs(spark, text, "zzz").select(windows.keyword_windows(F.col("content"), 20).alias("w")).collect()
    assert [(w["start"], w["end"]) for w in r[0]["w"]["windows"]] == [(30, 70), (131, 171)]
    assert r[0]["w"]["hit_count"] == 2
    assert [(w["start"], w["end"]) for w in r[1]["w"]["windows"]] == [(0, 3)]
    capped = docs(spark, text).select(windows.cap_windows(
        windows.keyword_windows(F.col("content"), 20)["windows"], 50).alias("w")).first()["w"]
    assert [(w["start"], w["end"]) for w in capped] == [(30, 70), (131, 141)]


def test_windows_touch_and_overlap(spark):
    # brute force over every position
    text = "aag" + "x" * 39 + "g" + "x" * 41 + "mmm" + "x" * 200 + "$"
    hits = [i for i in range(len(text)) if any(text.startswith(w, i) for w in ("g", "mm", "$"))]
    want, r = [], 20
    for h in hits:
        s, e = max(0, h - r), min(len(text), h + r)
        if want and s <= want[-1][1]:
            want[-1][1] = max(want[-1][1], e)
        else:
            want.append([s, e])
    got = docs(spark, text).select(windows.keyword_windows(F.col("content"), r)["windows"].alias("w")).first()["w"]
    assert [[w["start"], w["end"]] for w in got] == want


def resolve(spark, *texts):
    df = spark.createDataFrame([(list(texts),)], "t array<string>")
    return windows.resolve_windows(df, "t").first()


def test_jammed_labels(spark):
    r = resolve(spark, "Drop10mmStack Height43mmWeight 280 g and 300g")
    assert (r["mode"], r["drop_mm"], r["heel_mm"], r["weight_g"]) == ("single", 10.0, 43.0, 280.0)
    assert r["single_reason"] == "unique_drop_and_heel_with_multiple_weights"


def test_modes(spark):
    assert resolve(spark, "nothing here")["mode"] == "skipped"
    r = resolve(spark, "costs $120 and weighs 250 g")
    assert (r["mode"], r["price_usd"], r["weight_g"], r["single_reason"]) == ("single", 120.0, 250.0, None)
    apart = " filler" * 100
    # both values lie in the drop's snippet only: its match is the longer one
    near = "drop: 8 mm" + " " * 195 + "$99"
    r = resolve(spark, near + apart + " costs $300")
    assert (r["mode"], r["single_reason"], r["price_usd"], r["drop_mm"]) == ("single", "proximity_join", 99.0, 8.0)
    r = resolve(spark, "drop: 8 mm, 250 g, $120" + apart + " costs $300")
    assert r["mode"] == "ambiguous_multi"  # three equal snippets compete
    r = resolve(spark, "drop: 8 mm, 250 g" + apart + " drop: 6 mm, 300 g")
    assert r["mode"] == "ambiguous_multi" and len(r["candidates"]["drop_snippets"]) == 2


def test_contexts_linear_and_whole(spark):
    text = "ab " * 300 + "$120 $130 " + "cd " * 300
    got = docs(spark, text).select(blocks.match_contexts(F.col("content"), r"\$\d+", 10, 10).alias("m")).first()["m"]
    for m in got:
        at = text.index(m["match"])
        assert m["before"] == text[at - 10:at] and m["after"] == text[at + 4:at + 14]


def test_fallback(spark):
    df = fallback.with_fallback_heights(docs(
        spark, "A stack of 36 mm heel / 30 mm", "platform stack: 50/40mm then 36/30mm", "heel 35mm. forefoot 28mm",
        "no figures"), "content").orderBy("doc_id").collect()
    assert [(r["fb_heel"], r["fb_forefoot"], r["fb_drop"]) for r in df] == [
        (36.0, 30.0, 6.0), (36.0, 30.0, 6.0), (35.0, 28.0, 28.0), (None, None, None)]


@pytest.mark.parametrize("s,pairs", [
    ("Nike Pegasus vs. Brooks Ghost", [("Nike Pegasus", "Brooks Ghost")]),
    ("A vs B vs C", [("A vs B", "C")]), ("Foo compared to Bar, x", [("Foo", "Bar")]), ("none", [])])
def test_comparisons(spark, s, pairs):
    got = docs(spark, s).select(fallback.comparisons(F.col("content")).alias("p")).first()["p"]
    assert [(p["left"], p["right"]) for p in got] == pairs


def test_mentions(spark):
    t = "We like the Nike Pegasus 40 with a 10 mm drop. The Brooks Ghost 17 costs $140. On the road."
    got = docs(spark, t).select(blocks.mentions(F.col("content")).alias("m")).first()["m"]
    assert [m["brand_model"] for m in got] == ["Nike Pegasus 40", "Brooks Ghost 17"]
    assert "10 mm drop" in got[0]["block"] and "Brooks" not in got[0]["block"]
    assert got[1]["price"] == 140.0


def fold(spark, *names):
    df = spark.createDataFrame([([("Nike", n, float(i)) for i, n in enumerate(names, 1)],)],
                               "m array<struct<brand_name:string,model:string,price:double>>")
    return [r["model"] for r in df.select(dedup.fold_similar(F.col("m"), ["price"]).alias("f")).first()["f"]]


def test_similar_fold_is_order_dependent(spark):
    assert fold(spark, "Pegasus", "Pegasus 40", "Pegasus 40 GTX") == ["Pegasus 40 GTX"]
    assert fold(spark, "Pegasus 40 GTX", "Pegasus", "Pegasus 40") == ["Pegasus 40 GTX", "Pegasus"]


HTML = """<html><head><title>t</title><script>var a='<b>'</script></head><body><h1>Ride</h1><table><tr><th>Spec</th><th>A 1</th>
<th>B 2</th></tr><tr><td>Weight</td><td>9.0 oz</td><td>250 g</td></tr><tr><td>Heel</td><td>36 mm</td><td>33 mm</td></tr>
<tr><td>Forefoot</td><td>30 mm</td><td>x</td></tr><tr><td>Price</td><td>€100</td></tr></table></body></html>"""


def test_tables(spark):
    df = spark.createDataFrame([(1, HTML), (2, None), (3, "<p>no table</p>")], "id int, html string")
    rows = pages.parse_pages(df, ["id"]).withColumn("c", tables.comparison(F.col("tables"))).orderBy("id").collect()
    models = rows[0]["c"]["models"]
    assert [(m["model_name"], m["weight_g"], m["heel_mm"], m["drop_mm"], m["price_usd"]) for m in models] == [
        ("A 1", 255.0, 36.0, 6.0, None), ("B 2", 250.0, 33.0, None, None)]
    assert rows[0]["c"]["labels"] == ["WEIGHT", "STACK", "DROP", "MULTI_TABLE"]
    assert rows[0]["body_text"].startswith("Ride") and "var a" not in rows[0]["body_text"]
    assert rows[1]["c"] is None and rows[2]["c"] is None and rows[2]["body_text"] == "no table"


def test_article_specs(spark):
    shoe = ("This running shoe has a midsole, outsole, great traction and grip. " * 40
            + "The drop: 8 mm, stack height 34 mm, weight 250 g, price $130.")
    page = HTML.replace("<h1>Ride</h1>", "<p>running shoe midsole outsole heel-to-toe drop traction grip upper</p>")
    df = spark.createDataFrame([
        (1, "Best watches", shoe, None), (2, "Pegasus review", shoe, None), (3, "Ride", "short", page),
        (4, "Ride", "", "<p>cooking recipe</p>"), (5, "Ride", None, "<p>shoe</p>" * 100)],
        "id int, t string, c string, h string")
    rows = {r["id"]: r for r in article_specs.article_specs(df, "id", "t", "c", "h", max_html=1000).collect()}
    assert rows[1]["method"] == "title_prefilter_skip" and rows[1]["mode"] == "skipped"
    assert (rows[2]["mode"], rows[2]["drop_mm"], rows[2]["price_usd"]) == ("single", 8.0, 130.0)
    assert rows[3]["mode"] == "multi_table" and len(rows[3]["models"]) == 2
    assert rows[4]["method"] == "dom_not_shoe"
    assert rows[5]["reason"] == "large_html" and rows[5]["stage"] == "size_guard"
    assert rows[5]["prefilter_score"] is not None


ARTICLE = "doc_id int, source_id string, title string, content string, date string, link string"


def test_unheaded_articles_give_rows(spark):
    text = ("Running shoes of the year. The Nike Pegasus 40 has a 10 mm drop and weighs 250 grams on the road. "
            "We also ran in the Brooks Ghost 17, a road shoe with a 12 mm drop and 280 grams.")
    df = spark.createDataFrame([(1, "s1", "Best running shoes", text, "2024-01-01", "u")], ARTICLE)
    assert {r["model_key"] for r in products.article_products(df).collect()} == {"nike pegasus 40", "brooks ghost 17"}
    assert products.article_products(df, unheaded=False).count() == 0


def test_similar_names_become_one_row(spark):
    block = "Best Running Shoes: {} ($140)\n{}\n\n"
    text = (block.format("Nike Pegasus", "Weighing 10.2 ounces (289 grams) with a 9.5-millimeter drop and 37-millimeter stack height at the heel, for the road.")
            + block.format("Nike Pegasus 40", "A road shoe with an 8-millimeter drop and 30-millimeter stack height at the heel."))
    df = spark.createDataFrame([(1, "s1", "Best running shoes", text, "2024-01-01", "u")], ARTICLE)
    rows = products.article_products(df).collect()
    assert [r["model_key"] for r in rows] == ["nike pegasus 40"] and rows[0]["weight"] == 289.0
    assert products.article_products(df, fold=False).count() == 2


def test_responses_complete_and_replace(spark):
    df = spark.createDataFrame([(1, "s1", "Best running shoes", ROUNDUP, "2024-01-01", "u"),
                                (2, "s2", "Best running shoes", "Running shoes without any figures. " * 5, "2024-01-01", "u")], ARTICLE)
    spec = ", ".join(f"{f} {'boolean' if f in rules.BOOLEAN_FIELDS else 'double' if f in rules.NUMERIC_FIELDS else 'string'}"
                     for f in rules.SPEC_FIELDS)
    values = lambda **v: tuple(v.get(f) for f in rules.SPEC_FIELDS)
    given = spark.createDataFrame([(1, 1, "Nike", "Other 1", *values(drop=6.0)), (2, 1, "Hoka", "Mach 6", *values(drop=5.0, weight=230.0))],
                                  f"doc_id int, position int, brand_name string, model string, {spec}")
    got = {(r["article_id"], r["model_key"]) for r in products.article_products(df, responses=given).collect()}
    assert ("2", "hoka mach 6") in got and ("1", "nike other 1") not in got and len(got) == 4


def test_pages_and_contents_are_read_whole(spark):
    spec = "This running shoe has a midsole, outsole, traction and grip. The drop: 8 mm, weight 250 g, price $130."
    page = "<html><body><p>" + "filler words here " * 35_000 + "</p><p>" + spec + "</p></body></html>"
    df = spark.createDataFrame([(1, "Ride", None, page), (2, "Ride", spec, None), (3, "Ride", spec, " ")], "id int, t string, c string, h string")
    rows = {r["id"]: r for r in article_specs.article_specs(df, "id", "t", "c", "h").collect()}
    assert len(page) > 600_000 and all(rows[i]["drop_mm"] == 8.0 for i in rows)
    assert [rows[i]["source_used"] for i in (1, 2, 3)] == ["fetched_html", "content", "content"]


def test_article_products(spark):
    df = spark.createDataFrame([(1, "s1", "Best running shoes", ROUNDUP, "2024-01-01", "u")],
                               "doc_id int, source_id string, title string, content string, date string, link string")
    rows = products.article_products(df).orderBy("block_no").collect()
    assert [r["model_key"] for r in rows] == ["hoka clifton 9", "hoka speedgoat 6", "nike pegasus trail 5"]
    assert rows[2]["waterproof"] is False  # trail, not stated
