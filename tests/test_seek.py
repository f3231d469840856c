"""Seek paging: pages through the cursor equal pages by offset."""

import itertools
import random

import pytest

from specforge.operators import search
from specforge.operators.search import SearchParams


def _walk(df, order, size):
    at, pages = None, []
    while True:
        page = search.seek_page(df, order, size, at)
        rows = [tuple(r) for r in page.collect()]
        if not rows:
            return pages
        pages.append(rows)
        at = search.next_cursor(page, order)


@pytest.mark.parametrize("ways", list(itertools.product(("asc", "desc"), repeat=2)))
def test_walk_equals_sorted_rows(spark, ways):
    rnd = random.Random(3)
    rows = [(rnd.choice([None, 1.0, 2.5, float("nan"), float("-inf")]), rnd.choice([None, "a", "b"]), k) for k in range(60)]
    df = spark.createDataFrame(rows, "x double, s string, id int").repartition(5)
    order = [("x", ways[0]), ("s", ways[1]), ("id", "asc")]
    pages = _walk(df, order, 7)
    assert [len(p) for p in pages] == [7] * 8 + [4]
    got = [r[2] for p in pages for r in p]

    def key(value, way):
        # null, then numbers, then NaN; turned around for descending columns
        if value is None:
            rank = (0, 0)
        elif value != value:
            rank = (2, 0)
        else:
            rank = (1, value if isinstance(value, float) else ord(value))
        return rank if way == "asc" else (-rank[0], -rank[1])
    assert got == [r[2] for r in sorted(rows, key=lambda r: (key(r[0], ways[0]), key(r[1], ways[1]), r[2]))]


def test_search_by_cursor_equals_search_by_page(spark):
    from specforge.catalog.data import Tables
    products = Tables(spark, "/root/testdata/sf0.001").products
    for sort in ("weight_asc", "price_desc"):
        at = None
        for no in (1, 2, 3):
            p = SearchParams(sort=sort, page=no, page_size=20)
            page = search.search_seek(products, p, at)
            want = [r["id"] for r in search.search(products, p)[0].collect()]
            assert [r["id"] for r in page.collect()] == want
            at = search.next_cursor(page, search.seek_order(p, "id"))


def test_ends_and_plan(spark, tmp_path):
    empty = spark.createDataFrame([], "x int, id int")
    order = [("x", "desc"), ("id", "asc")]
    assert search.next_cursor(search.seek_page(empty, order, 5), order) is None
    one = spark.createDataFrame([(None, 1)], "x int, id int")
    assert search.seek_page(one, order, 5, {"x": None, "id": 1}).count() == 0
    with pytest.raises(ValueError):
        search.seek_page(one, [("x", "up")], 5, {"x": 1})
    spark.range(100).selectExpr("cast(id as int) as x", "id").write.parquet(str(tmp_path / "t"))
    df = search.seek_page(spark.read.parquet(str(tmp_path / "t")), [("x", "asc"), ("id", "asc")], 5, {"x": 40, "id": 40})
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject(limit=5" in plan and "GreaterThanOrEqual(x,40)" in plan and "offset" not in plan.lower()
    assert [r["id"] for r in df.collect()] == [41, 42, 43, 44, 45]
