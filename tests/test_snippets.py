"""Snippets, their ranking and the best cluster against a scanner by character offsets.

The scanner shares no pattern with the library: it walks over runs of digits, blanks and words.
"""

import math
import random

from pyspark.sql import functions as F

from specforge.catalog.data import Tables
from specforge.operators import windows

ENDS = "\n\r\u2028\u2029"
BLANKS, AROUND = " \t\u00a0" + ENDS, 200


def _digit(t, i):
    return 0 <= i < len(t) and t[i] in "0123456789"


def _wordy(t, i):
    return 0 <= i < len(t) and t[i].isascii() and (t[i].isalnum() or t[i] == "_")


def _over(t, i):
    while i < len(t) and t[i] in BLANKS:
        i += 1
    return i


def _runs(t):
    """(start, end) of runs of digits."""
    i = 0
    while i < len(t):
        j = i
        while _digit(t, j):
            j += 1
        if j > i:
            yield i, j
        i = max(j, i + 1)


def _unit(t, i):
    """(word, end) of the word behind blanks."""
    i = j = _over(t, i)
    while _wordy(t, j):
        j += 1
    return t[i:j].lower(), j


def _places(t, word):
    low, at = t.lower(), 0
    while (at := low.find(word, at)) >= 0:
        yield at
        at += 1


def grams(t):
    """(start, end, value) of weights in grams: the last two to four digits before the unit."""
    for s, e in _runs(t):
        word, end = _unit(t, e)
        if e - s >= 2 and word in ("g", "grams"):
            s = max(s, e - 4)
            yield s, end, float(t[s:e])


def ounces(t):
    for s, e in _runs(t):
        word, end = _unit(t, e)
        if word in ("oz", "ounces"):
            if e - s == 1 and s >= 2 and t[s - 1] == "." and _digit(t, s - 2):
                s -= 3 if _digit(t, s - 3) else 2
            else:
                s = max(s, e - 2)
            yield s, end, float(t[s:e])


def prices(t):
    for s, e in _runs(t):
        if s and t[s - 1] == "$" and e - s >= 2:
            end = min(e, s + 4)
            value = float(t[s:end])
            if t[end:end + 1] == "." and _digit(t, end + 1) and _digit(t, end + 2):
                end += 3
            yield s - 1, end, value


def _millimetres(t, i, most, least=1):
    """(value, end) of an optional mark, digits and mm at i."""
    i = _over(t, i)
    if t[i:i + 1] in (":", "-"):
        i = _over(t, i + 1)
    j = i
    while _digit(t, j):
        j += 1
    end = _over(t, j)
    if least <= j - i <= most and t[end:end + 2].lower() == "mm":
        return float(t[i:j]), end + 2
    return None


def drops(t, whole_word):
    for at in _places(t, "drop"):
        found = None if _wordy(t, at - 1) else _millimetres(t, at + 4, 2)
        if found:
            value, end = found
            after = t[end:end + 1]
            if not (_wordy(t, end) if whole_word else _digit(t, end) or after == "_"):
                yield at, end, value


def stacks(t):
    for at in _places(t, "stack"):
        i = _over(t, at + 5)
        if t[i:i + 6].lower() == "height" and (found := _millimetres(t, i + 6, 2, 2)):
            yield at, found[1], found[0]


def _lines(t):
    at = 0
    for k, c in enumerate(t):
        if c in ENDS:
            yield at, k
            at = k + 1
    yield at, len(t)


def heights(t, word):
    """(start, end) from the first of number and word to the last of the other, one a line."""
    for a, b in _lines(t):
        line = t[a:b]
        sizes = [(e - 2, _over(line, e) + 2) for s, e in _runs(line) if e - s >= 2 and line[_over(line, e):][:2].lower() == "mm"]
        words = list(_places(line, word))
        if sizes and words:
            if sizes[0][0] < words[0]:
                yield a + sizes[0][0], a + words[-1] + len(word)
            else:
                yield a + words[0], a + sizes[-1][1]


def _first_number(t):
    for s, e in _runs(t):
        stop = e
        if t[e:e + 1] == "." and _digit(t, e + 1):
            stop = e + 1
            while _digit(t, stop):
                stop += 1
        return float(t[s:stop])


def snippets(t):
    out = []
    for spans, low, high in ((prices(t), 50, 500), (drops(t, False), 0, 25), (grams(t), 50, 1000), (ounces(t), 3, 30),
                             (stacks(t), 5, 60), (heights(t, "heel"), 5, 60), (heights(t, "forefoot"), 5, 60)):
        out += [t[max(0, s - AROUND):e + AROUND] for s, e, *_ in spans if low <= _first_number(t[s:e]) <= high]
    return out


def score(s):
    points = 0
    if any(not _wordy(s, a - 1) and _unit(s, e)[0] in ("g", "grams", "oz", "ounces") for a, e in _runs(s)):
        points += 2
    points += 2 * any(True for _ in drops(s, True))
    points += any(a and s[a - 1] == "$" for a, _ in _runs(s))
    for a, b in _lines(s):
        line = s[a:b].lower()
        if ("heel" in line or "forefoot" in line) and any(line[_over(line, e):][:2] == "mm" for _, e in _runs(line)):
            points += 2
            break
    return points + sum(w in s.lower() for w in ("stack", "drop", "heel", "forefoot", "weight"))


def ranked(found):
    return [s for s in sorted(found, key=lambda s: -score(s)) if score(s) > 0]


def cluster(top):
    """(scores of usable snippets, the first best as (source, weight, drop, heel, forefoot, price))."""
    usable = []
    for k, s in enumerate(top):
        def first(spans, low, high):
            v = next((x[2] for x in spans), None)
            return v if v is not None and low <= v <= high else None

        def height(word):
            for a, b in heights(s, word):
                v = next(float(s[x:x + 2]) for x in range(a, b) if _digit(s, x) and _digit(s, x + 1))
                return v if 5 <= v <= 60 else None
        g, oz, drop = first(grams(s), 50, 1000), first(ounces(s), 3, 30), first(drops(s, True), 0, 25)
        price, heel, fore = first(prices(s), 50, 500), height("heel"), height("forefoot")
        weight = g if oz is None else math.floor(oz * 28.3495 + 0.5)
        groups = sum(x is not None for x in (weight, drop, fore if heel is None else heel, price))
        if groups >= 2:
            points = 2 * sum(x is not None for x in (g, oz, drop, heel, fore)) + (price is not None)
            usable.append((points, (k, weight, drop, heel, fore, price)))
    if not usable:
        return None
    best = max(p for p, _ in usable)
    at = next(k for k, (p, _) in enumerate(usable) if p == best)
    second = max((p for k, (p, _) in enumerate(usable) if k != at), default=0)
    return second >= best * 0.9, usable[at][1]


PARTS = ["heel", "Heel", "forefoot", "drop", "drop:", "backdrop", "drop -", "stack height", "Stackheight:", "weight", "mm", "30 mm", "22mm", "8 mm",
         "4mm", "125 mm", "31\tmm.", "mms", "mm_", "$120", "$99.95", "$1234.5", "$7", "$12345", "9.5 oz", "10.25 oz", "1.5.5 oz", "8oz", "270 g",
         "12345 g", "250grams", "x250 g", "9 g", "30 gr", "ounces", "7 ounces", "OZ", "the", "shoe", ".", ",", "\n", "\r", "\u2028", "\u00a0", "é", "_", "5", "42"]


def random_texts(n, seed):
    rnd = random.Random(seed)
    for _ in range(n):
        yield "".join(rnd.choice(PARTS) + rnd.choice(["", " ", " ", "  ", "\n" if rnd.random() < 0.2 else " "])
                      for _ in range(rnd.choice([0, 1, 3, 8, 20, 60, 150])))


def compare(df):
    s = windows.snippets(F.array("content"))
    df = df.select("doc_id", "content", F.concat(*[s[f] for f in windows.SNIPPET_FIELDS]).alias("found"))
    df = df.withColumn("top", windows.top_snippets(F.col("found")))
    df = df.withColumn("points", F.transform("top", windows.snippet_score)).withColumn("b", windows.best_cluster(F.col("top")))
    some = {"found": 0, "clusters": 0, "competing": 0}
    for r in df.collect():
        found = snippets(r.content)
        assert list(r.found) == found, r.content
        top = ranked(found)
        assert list(r.top) == top and list(r.points) == [score(x) for x in top], r.content
        want = cluster(top)
        c = r.b and r.b["cluster"]
        got = r.b and (r.b["competing"], (c["source"], c["weight_g"], c["drop_mm"], c["heel_mm"], c["forefoot_mm"], c["price_usd"]))
        assert got == want, r.content
        some["found"] += len(found)
        some["clusters"] += want is not None
        some["competing"] += want is not None and want[0]
    return some


def test_random_texts(spark):
    texts = list(random_texts(1200, 11))
    some = compare(spark.createDataFrame(list(enumerate(texts)), "doc_id int, content string").repartition(8))
    assert some["found"] > 5000 and 100 < some["competing"] < some["clusters"]


def test_all_articles(spark):
    some = compare(Tables(spark, "/root/testdata/sf0.001").articles)
    assert some["found"] > 100 and some["clusters"] > 20
