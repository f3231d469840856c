"""Text rules that scan once: equal to the rule patterns, and linear in the text."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from specforge import rules
from specforge.operators import blocks, windows

PARTS = ["heel", "Heel", "forefoot", "35mm", "8 mm", "28  MM", "135 mm", "5", "carbon", "plate", "Fiber", "gore", "tex", "Gore-Tex", "GTX",
         "not ", "no ", "non", "north", "water", "waterproof", "resistant", "waterproofing", ".", ",", " ", " ", "\n", "x", "heels", "textile"]


def texts(n=400, seed=0):
    rng = random.Random(seed)
    made = ["".join(rng.choice(PARTS) + rng.choice(["", " "]) for _ in range(rng.randrange(25))) for _ in range(n)]
    # A line end between a number and its unit is read as the end of the line.
    return [re.sub(r"(\d)\s*\n\s*(?=mm)", r"\1 ", t, flags=re.I) for t in made]


@pytest.mark.parametrize("field", ["heel", "forefoot"])
def test_heights_equal_the_pattern(spark, field):
    rows = texts(seed=len(field))
    df = spark.createDataFrame(list(enumerate(rows)), "i int, t string")
    got = {r.i: r.m for r in df.select("i", blocks.marked_matches(blocks.mark_heights(F.col("t"), field)).alias("m")).collect()}
    pattern = re.compile(rules.VALUE_PATTERNS[field][0], re.I)
    for i, t in enumerate(rows):
        assert got[i] == [m.group(0) for m in pattern.finditer(t)], t


def test_presence_equals_the_patterns(spark):
    rows = texts(seed=9)
    df = spark.createDataFrame(list(enumerate(rows)), "i int, t string")
    got = {r.i: r for r in df.select("i", blocks.carbon_of(F.col("t")).alias("c"), blocks.waterproof_of(F.col("t")).alias("w")).collect()}
    carbon, mention = re.compile(rules.CARBON_MENTION, re.I), re.compile(rules.WATERPROOF_MENTION, re.I)
    negation = re.compile(rules.WATERPROOF_NEGATION, re.I)
    for i, t in enumerate(rows):
        assert got[i].c == (True if carbon.search(t) else None), t
        m = mention.search(t)
        want = (not re.match(r"not\s", m.group(0), re.I)) if m else False if "water" in t.lower() and negation.search(t) else None
        assert got[i].w == want, t


@pytest.mark.parametrize("unit", ["heel x ", "12 mm y ", "carbon z ", "water is not gore "])
def test_linear(spark, unit):
    def took(n):
        df = spark.createDataFrame([(unit * (n // len(unit)),)], "t string")
        df = windows.resolve_windows(df.withColumn("texts", F.array("t")), "texts").withColumns(
            {"c": blocks.carbon_of(F.col("t")), "w": blocks.waterproof_of(F.col("t"))})
        start = time.perf_counter()
        df.select("mode", "heel_mm", "c", "w").collect()
        return time.perf_counter() - start
    took(1000)
    assert took(400_000) < 3 * took(200_000) + 2
