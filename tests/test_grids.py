"""Table grids: spans, groups, nesting, broken markup, and time linear in the cells."""

import time

import pytest

from specforge.sources.grids import page_grids

T = "<table>{}</table>"
GRIDS = [
    ("", []), ("no table", []), (T.format(""), [[]]),
    (T.format("<tr><td>a<td>b<tr><td>c"), [[["a", "b"], ["c", ""]]]),
    (T.format("<tr><th colspan=2>h<th>i<tr><td>a<td>b<td>c"), [[["h", "h", "i"], ["a", "b", "c"]]]),
    (T.format("<tr><td rowspan=2>a<td>b<tr><td>c<tr><td>d<td>e"), [[["a", "b"], ["a", "c"], ["d", "e"]]]),
    (T.format("<tr><td>a<td rowspan=3>b<td>c<tr><td>d<td>e<tr><td>f"), [[["a", "b", "c"], ["d", "b", "e"], ["f", "b", ""]]]),
    (T.format("<tr><td rowspan=2 colspan=2>a<td>b<tr><td>c<tr><td>d"), [[["a", "a", "b"], ["a", "a", "c"], ["d", "", ""]]]),
    # a span makes no rows and ends with its group; zero reaches to the end of the group
    (T.format("<tr><td rowspan=9>a"), [[["a"]]]),
    (T.format("<tbody><tr><td rowspan=9>a<td>b<tr><td>c<tbody><tr><td>d"), [[["a", "b"], ["a", "c"], ["d", ""]]]),
    (T.format("<tr><td rowspan=0>a<td>b<tr><td>c<tr><td>d"), [[["a", "b"], ["a", "c"], ["a", "d"]]]),
    # overlap: the earlier cell keeps the place
    (T.format("<tr><td>a<td rowspan=2>b<tr><td colspan=2>c<td>d"), [[["a", "b", ""], ["c", "b", "d"]]]),
    # spans that are no numbers count as one
    (T.format("<tr><td colspan=x rowspan=-2>a<td colspan=0>b"), [[["a", "b"]]]),
    (T.format("<td>a<td>b</tr><td>c"), [[["a", "b"], ["c", ""]]]),
    (T.format("<caption>t</caption><tr><td>a<br>b<p>c</p>d<script>x</script>"), [[["a b c d"]]]),
    (T.format("<tr><td>a" + T.format("<tr><td>in<td>side") + "z<td>b"), [[["az", "b"]], [["in", "side"]]]),
    ("<td>x</td></table><table><tr><td>open &amp; on", [[["open & on"]]]),
]


def test_grids(spark):
    df = spark.createDataFrame([(k, html) for k, (html, _) in enumerate(GRIDS)] + [(None, None)], "id int, html string")
    got = {r["id"]: [g["cells"] for g in r["grids"]] for r in page_grids(df, ["id"]).collect()}
    assert got.pop(None) == []
    for k, (html, want) in enumerate(GRIDS):
        assert got[k] == want, html
    assert page_grids(df.limit(0), ["id"]).collect() == []


def test_depth_and_clashing_names(spark):
    html = "<table><tr><td><table><tr><td><table></table></table></table><table></table>"
    df = spark.createDataFrame([(1, "kept", html)], "id int, grids string, html string")
    row = page_grids(df, ["id"]).first()
    assert [g["depth"] for g in row["grids"]] == [0, 1, 2, 0]
    assert page_grids(df, ["id", "grids"], name="found").first()["grids"] == "kept"
    with pytest.raises(ValueError):
        page_grids(df, ["id", "grids"])


def test_linear(spark):
    def seconds(rows):
        html = T.format("<tr><th rowspan=0>s<th colspan=3>h" + "<tr><td>a<td rowspan=2>b<td>c" * rows)
        df = spark.createDataFrame([(html,)], "html string")
        best = 9e9
        for _ in range(3):
            start = time.perf_counter()
            assert len(page_grids(df, []).first()["grids"][0]["cells"]) == rows + 1
            best = min(best, time.perf_counter() - start)
        return best
    seconds(10)
    assert seconds(40_000) < 8 * seconds(10_000) + 1
