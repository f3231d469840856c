"""Golden cases of the scalar functions and keys."""

import pytest
from pyspark.sql import functions as F

from specforge import rules
from specforge.functions import keys, text, units
from specforge.functions import regex as rx


def one(spark, expr, **cols):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in cols.items()] or [F.lit(1).alias("_")])
    return row.select(expr.alias("x")).first()["x"]


@pytest.mark.parametrize("raw,want", [("  hello  ", "hello"), ("", None), (" x　", "x")])
def test_norm_str(spark, raw, want):
    assert one(spark, text.norm_str(F.col("a")), a=raw) == want


@pytest.mark.parametrize("raw,want", [("123", 123.0), ("$12.34", 12.34), ("abc", None), ("-", None), ("1-2", None)])
def test_to_num(spark, raw, want):
    assert one(spark, text.to_num(F.col("a")), a=raw) == want


@pytest.mark.parametrize("x,want", [(-2.5, -2.0), (2.5, 3.0), (1.005, 1.0), (-0.4, 0.0)])
def test_js_round(spark, x, want):
    assert one(spark, text.js_round(F.col("a")), a=x) == want


def test_units(spark):
    assert one(spark, units.oz_to_grams(F.lit(10.0))) == 284.0
    got = [one(spark, text.round2(units.to_usd(F.lit(100.0), F.lit(c)))) for c in ("USD", "EUR", "GBP", "XXX")]
    assert got == [100.0, 108.0, 126.0, None]
    assert [one(spark, units.in_bounds(F.lit(p), "price")) for p in (100.0, 30.0, 600.0)] == [True, False, False]


@pytest.mark.parametrize("s,want", [("costs $ 5", "USD"), ("€20", "EUR"), ("10 gbp", "GBP"), ("¥9", "JPY"), ("20", None)])
def test_detect_currency(spark, s, want):
    assert one(spark, units.detect_currency(F.col("a")), a=s) == want


@pytest.mark.parametrize("brand,model,want", [
    ("Nike", "Vaporfly 3", "nike vaporfly 3"), ("Hoka", "Speedgoat 5", "hoka speedgoat 5"),
    ("Adidas", "Adizero Pro 3", "adidas adizero pro 3"), ("On", "Cloud-X 3!", "on cloud x 3"),
    ("", "X", ""), ("Nike", None, ""), ("Évö", "Ça  ñ", "evo ca n")])
def test_model_key(spark, brand, model, want):
    expr = keys.model_key(F.col("b").cast("string"), F.col("m").cast("string"))
    assert one(spark, expr, b=brand, m=model) == want


def test_model_key_exact_agrees(spark):
    df = spark.createDataFrame([("Ŝé ﬁ ½", "x")], "b string, m string")
    row = df.select(keys.model_key(F.col("b"), F.col("m"), exact=True).alias("k")).first()
    assert row["k"] == "se fi 1 2 x"


@pytest.mark.parametrize("brand,model,want", [
    ("Norda", "001A Multi Tester", "001A"), ("Inov8", "Trailtalon Max 120 Mile", "Trailtalon Max"),
    ("On", "Running Cloudsurfer Max Multi Tester", "Cloudsurfer Max"),
    ("Decathlon", "Kiprun KD900X LD+", "KD900X LD+"), ("ASICS", "Gel-Nimbus 25 Test", "Gel-Nimbus 25"),
    ("Nike", "Running Pegasus 40", "Pegasus 40"), ("Nike", "Nike Pegasus (2024) - all new", "Pegasus")])
def test_refine_model(spark, brand, model, want):
    assert one(spark, keys.refine_model(F.col("b"), F.col("m")), b=brand, m=model) == want


def test_source_id(spark):
    none = F.lit(None).cast("string")
    sid = lambda i, link, c: one(spark, keys.source_id(i, link, c))
    assert sid(F.lit(7), F.lit("x"), none) == "article_7"
    assert sid(F.lit(None).cast("int"), F.lit("https://www.a.com/b/"), none) == "link_a.com/b"
    assert sid(F.lit(None).cast("int"), F.lit("http://a.com/b?q=1#f"), none) == "link_a.com/b"
    assert sid(F.lit(None).cast("int"), none, F.lit(" hi ")).startswith("content_")
    assert sid(F.lit(None).cast("int"), none, none) is None


@pytest.mark.parametrize("v,want", [("9.9 oz (282g)", 282.0), ("37.3 mm", 37.0), ("$155", 155.0), ("N/A", None), ("", None)])
def test_sheet_number(spark, v, want):
    assert one(spark, text.sheet_number(F.col("a")), a=v) == want


def test_ascii_boundary(spark):
    assert one(spark, rx.test(F.col("a"), r"\bt"), a="été vest") is True
    assert one(spark, rx.test(F.col("a"), "обувь"), a="ОБУВЬ") is True
    assert one(spark, rx.test(F.col("a"), r"9\s*mm"), a="9 mm") is True


def test_required_literals():
    assert rx.required(r"\bstack\s+height\b") == "height"
    assert rx.required(r"\$\d{2,3}") == "$"
    assert rx.required("a|b") == ""
    assert rx.required(r"socks?") == "sock"


def test_vocab_order(spark):
    pick = lambda s, v: one(spark, text.vocab(F.col("a"), rules.VOCAB[v]), a=s)
    assert pick("High but firm", "cushioning") == "max"
    assert pick("High but firm", "cushioning_loose") == "firm"
    assert pick("2E", "width") == "wide"
    assert pick("no idea", "waterproof") is False


def test_bool_and_dates(spark):
    assert [one(spark, text.to_bool(F.col("a")), a=x) for x in ("Yes", "0", "7", "x")] == [True, False, True, None]
    assert one(spark, text.to_iso_date(F.col("a")), a="2024-05-06") == "2024-05-06"
    assert one(spark, text.to_iso_date(F.col("a")), a="2024-05-06T23:30:00Z") == "2024-05-06"
    assert one(spark, text.to_iso_date(F.col("a")), a="soon") is None
