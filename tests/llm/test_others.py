"""Vector graph, chat formatting, URL rules and HTML text against brute force and known results."""

import random

import numpy as np
import oracle
import pytest
from pyspark.sql import functions as F

from specforge.llm import chat, html_text, queries, url_rules, vector_graph

VECTORS = "vec_id bigint, label int, embedding array<float>"


def naive_links(rows, threshold=vector_graph.THRESHOLD):
    """(n_links, component) per row position."""
    def good(v, label):
        return label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)

    x = [np.array(v, float) / np.linalg.norm(np.array(v, float)) if good(v, lab) else None for _, lab, v in rows]
    n, parent = [0] * len(rows), list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i + 1, len(rows)):
            if x[i] is not None and x[j] is not None and rows[i][1] == rows[j][1] and len(x[i]) == len(x[j]) \
                    and x[i] @ x[j] >= threshold:
                n[i] += 1
                n[j] += 1
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(least.get(find(i), r[0]), r[0])
    return sorted(((r[0], n[i], least.get(find(i)), r[0] is not None and r[0] == least.get(find(i)))
                   for i, r in enumerate(rows)), key=repr)


def made_vectors(n=400, dim=8, seed=0):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n // 8, dim))
    x = base[rng.integers(0, len(base), n)] + rng.normal(scale=0.25, size=(n, dim))
    x[: n // 5] = x[0]
    return [(i, int(rng.integers(0, 2)), x[i].astype(np.float32).tolist()) for i in range(n)]


def answer(df):
    return sorted((tuple(r) for r in vector_graph.cluster(df).collect()), key=repr)


def test_vectors_in_one_shard(spark):
    rows = made_vectors()
    assert answer(spark.createDataFrame(rows, VECTORS)) == naive_links(rows)


def test_vectors_in_cut_and_overlapping_shards(spark, monkeypatch):
    """Small shards and cuts; the audit raises the overlap until nothing is missed."""
    for name, value in (("SHARD", 40), ("CUT", 25), ("RECALL", 1.0), ("AUDITED", 10_000)):
        monkeypatch.setattr(vector_graph, name, value)
    rows = made_vectors(seed=1)
    assert answer(spark.createDataFrame(rows, VECTORS)) == naive_links(rows)


def test_vector_edges(spark):
    v, w = [1.0, 2.0, 3.0], [1.0, 2.0, 3.001]
    rows = [(1, 1, v), (2, 1, w), (2, 1, v), (3, 2, v), (4, None, v), (5, 1, None), (6, 1, []), (7, 1, [0.0, 0.0, 0.0]),
            (8, 1, [1.0, None, 3.0]), (9, 1, [float("nan"), 1.0, 1.0]), (10, 1, [float("inf"), 1.0, 1.0]), (None, 1, v),
            (None, 3, [3.0, 1.0]), (11, 1, [-1.0, -2.0, -3.0]), (12, 1, [1.0, 2.0]), (13, 1, [1e30, 2e30, 3e30])]
    df = spark.createDataFrame(rows, VECTORS)
    assert answer(df.withColumn("node", F.lit(1)).withColumn("weight", F.lit("x"))) == naive_links(rows)
    assert answer(df.limit(0)) == []


def test_graph_recall():
    """Greedy and range search alone, from the medoid only, on clustered vectors."""
    rng = np.random.default_rng(3)
    base = rng.normal(size=(60, 32))
    x = vector_graph.unit(base[rng.integers(0, 60, 900)] + rng.normal(scale=0.12, size=(900, 32)))
    walk = vector_graph.Search(x, vector_graph._table(vector_graph.build(x)))
    q, v = walk(x, np.full(len(x), -1), 0.93)
    found, true = set(zip(q.tolist(), v.tolist(), strict=True)), np.argwhere(x @ x.T >= 0.93)
    assert len(found) == len(q) and all(x[a] @ x[b] >= 0.93 - 1e-12 for a, b in found)
    assert sum((int(a), int(b)) in found for a, b in true) >= 0.9 * len(true)


def two_groups(size, others, cosine, seed=5, dim=64):
    """Two tight groups of distinct vectors at about a cosine to each other, and unrelated ones."""
    rng = np.random.default_rng(seed)
    a, b = np.linalg.qr(rng.normal(size=(dim, 2)))[0].T
    b = cosine * a + np.sqrt(1 - cosine ** 2) * b
    x = np.concatenate([np.repeat([a, b], size, axis=0) + rng.normal(scale=0.002, size=(2 * size, dim)),
                        rng.normal(size=(others, dim))])
    return vector_graph.unit(x)


@pytest.mark.parametrize("size,others,cosine", [(100, 0, 0.95), (100, 2000, 0.95), (300, 0, 0.94), (300, 2000, 0.94)])
def test_tight_groups_reach_each_other(size, others, cosine):
    x = two_groups(size, others, cosine)
    walk = vector_graph.Search(x, vector_graph._table(vector_graph.build(x)))
    true = {(int(a), int(b)) for a, b in np.argwhere(x @ x.T >= 0.93)}
    assert len(true) >= (2 * size) ** 2
    for own in (np.arange(len(x)), np.full(len(x), -1)):
        q, v = walk(x, own, 0.93)
        assert len(true & set(zip(q.tolist(), v.tolist(), strict=True))) >= 0.99 * len(true)
        q, v = walk.whole(x, own, 0.93)
        assert len(q) == len(true) and set(zip(q.tolist(), v.tolist(), strict=True)) == true


def test_tight_groups_link(spark, monkeypatch):
    """In one cut, and in several cuts that hold a part of each group."""
    rows = [(i, 1, v.astype(np.float32).tolist()) for i, v in enumerate(two_groups(200, 50, 0.94))]
    df = spark.createDataFrame(rows, VECTORS)
    assert answer(df) == naive_links(rows)
    monkeypatch.setattr(vector_graph, "CUT", 150)
    assert answer(df) == naive_links(rows)


def test_every_pass_is_audited(spark, monkeypatch):
    """Also that of a label with a single center, and the last one."""
    seen = []
    real = vector_graph.audit
    monkeypatch.setattr(vector_graph, "audit", lambda *a: seen.append(real(*a)) or seen[-1])
    answer(spark.createDataFrame(made_vectors(160), VECTORS))
    assert seen == [1.0]
    monkeypatch.setattr(vector_graph, "audit", lambda *a: 0.5)
    with pytest.raises(RuntimeError, match="recall"):
        vector_graph.cluster(spark.createDataFrame(made_vectors(160), VECTORS))


def test_hits_come_from_the_graph(spark, monkeypatch):
    """Without neighbours the walks miss links; the audit sees it and only then products repair the label."""
    rows = made_vectors(1200, seed=2)
    df = spark.createDataFrame(rows, VECTORS)
    want = naive_links(rows)
    asked = []
    real_search, real_audit = vector_graph.search, vector_graph.audit
    monkeypatch.setattr(vector_graph, "search", lambda *a: asked.append(a[3]) or real_search(*a))
    assert answer(df) == want and asked == [frozenset()]
    monkeypatch.setattr(vector_graph, "build", lambda x: [np.zeros(0, np.int64)] * len(x))
    asked.clear()
    assert answer(df) == want and asked == [frozenset(), frozenset({("0", 8), ("1", 8)})]
    monkeypatch.setattr(vector_graph, "audit", lambda *a: min(1.0, 1.0 + real_audit(*a)))
    assert answer(df) != want


def test_no_shard_repeats_a_whole_label(spark, monkeypatch):
    """A label with no more centers than a vector has shards is searched once, not once per center."""
    for name, value in (("SHARD", 100), ("RECALL", 1.0), ("AUDITED", 10_000)):
        monkeypatch.setattr(vector_graph, name, value)
    dealt = []
    real = vector_graph.deal
    monkeypatch.setattr(vector_graph, "deal", lambda *a: dealt.append(real(*a)) or dealt[-1])
    for n, copies in [(500, 1), (1000, vector_graph.OVERLAP)]:      # two labels: 3 and 5 centers each
        rows = made_vectors(n, seed=4)
        dealt.clear()
        assert answer(spark.createDataFrame(rows, VECTORS)) == naive_links(rows)
        assert dealt[0].count() == copies * dealt[0].select("node").distinct().count()


def test_audit_counts_queries(spark):
    """A hot group with all its links does not hide pairs that were missed."""
    hot = [(0, [1.0, 0.001 * i, 0.0]) for i in range(60)]
    pairs = [(k, [0.0, 1.0, 0.001 * i]) for k in range(1, 11) for i in range(2)]
    nodes = spark.createDataFrame([(i, lab, v, 1) for i, (lab, v) in enumerate(hot + pairs)],
                                  "node bigint, label int, vector array<double>, weight bigint")
    counts = spark.createDataFrame([(i, 59) for i in range(60)], "node bigint, n bigint")
    assert 3540 / 3560 > vector_graph.RECALL
    assert vector_graph.audit(nodes, counts, 0.93) == 60 / 80
    both = counts.unionAll(spark.createDataFrame([(i, 1) for i in range(60, 80)], counts.schema))
    assert vector_graph.audit(nodes, both, 0.93) == 1.0


@pytest.mark.parametrize("name", ["op2_vector_graph", "op5_chat_formatting", "op8_url_rules"])
def test_sql(spark, sf, name):
    ok, note = oracle.compare(spark, oracle.duck(sf), name, queries.QUERIES[name], queries.ORACLES[name], sf)
    assert ok, note


TURNS = "conv_id bigint, turn bigint, role string, text string"


def test_chats_collapse(spark):
    a, b, c = ("user", "Hi"), ("assistant", "Hello"), ("user", "Bye")
    talks = {1: [a], 2: [a, b], 3: [a, b, c], 4: [a, b, c], 5: [b, a], 6: [a, ("assistant", None)], 7: [a, ("assistant", "")],
             8: [(None, "Hi")], 9: [a, a], 10: [a, a, a]}
    rows = [(i, k, r, t) for i, turns in talks.items() for k, (r, t) in enumerate(turns)]
    rows += [(None, 0, "user", "alone"), (None, 0, "user", "alone"), (None, 1, "user", "other"), (None, 0, *b)]
    df = spark.createDataFrame(rows, TURNS).repartition(4).withColumn("own", F.lit(1)).withColumn("n", F.lit("x"))
    got = sorted(((r.conv_id, r.n_turns, r.n_copies, r.chat) for r in chat.format_chats(df).collect()), key=repr)

    def show(turns):
        return "".join(f"<|im_start|>{r or ''}\n{t or ''}<|im_end|>\n" for r, t in turns)

    # 5 begins with b, so the lone b is its prefix.
    want = [(i, len(talks[i]), 2 if i == 3 else 1, show(talks[i])) for i in (3, 5, 6, 7, 8, 10)]
    want += [(None, 1, 1, show([("user", "alone")])), (None, 1, 1, show([("user", "other")]))]
    folded = sorted(((i, n, 1 if i is None else k, t) for i, n, k, t in got), key=repr)
    assert folded == sorted(want, key=repr)
    assert chat.format_chats(df.limit(0)).collect() == []


def test_chats_against_all_pairs(spark):
    rng = random.Random(4)
    talks = {}
    for i in range(120):
        base = list(rng.choice(list(talks.values()))) if talks and rng.random() < 0.7 else []
        base = base[:rng.randrange(len(base) + 1)]
        talks[i] = base + [(rng.choice("ua"), rng.choice("xyz")) for _ in range(rng.randrange(1, 3))]
    df = spark.createDataFrame([(i, k, r, t) for i, x in talks.items() for k, (r, t) in enumerate(x)], TURNS)
    kept = {r.conv_id for r in chat.format_chats(df).collect()}
    want = {i for i, x in talks.items() if not any(
        (len(y) > len(x) and y[:len(x)] == x) or (y == x and j < i) for j, y in talks.items())}
    assert kept == want


def naive_rule(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
    tail = rest[cut:]
    path = tail[:min((tail.find(c) for c in "?#" if c in tail), default=len(tail))]
    fits = [(len(h + p), len(h), h + p, v) for h, p, v in rules
            if path.startswith(p) and (h == "" or host == h or host.endswith("." + h))]
    best = max(fits, default=(0, 0, None, "allow"))
    return host, path, best[2], best[3]


def test_urls(spark):
    rng = random.Random(6)
    labels = ["a", "b", "com", "x-y", "www", "é"]
    rules = {(".".join(rng.choice(labels) for _ in range(rng.randrange(0, 4))), rng.choice(["", "/", "/a", "/a/", "/a/b/"]))
             for _ in range(60)}
    rules = [(h, p, rng.choice(["allow", "block"])) for h, p in sorted(rules)]
    urls = [f"{rng.choice(['http', 'HTTPS', 'x'])}://{'.'.join(rng.choice(labels) for _ in range(rng.randrange(1, 5)))}"
            f"{rng.choice(['', '/', '/a/c', '/a/b/c', '?q=/a', '#/a'])}{rng.choice(['', '?x', '#y', '?u=http://a.com/'])}" for _ in range(500)]
    urls += [None, "", "no scheme", "://", "http://", "http:///a/b", "HTTP://WWW.COM/A", "http://a.b\n.com/a\nb", "http://a.com:80/a", "a/b://com/a"]
    urls += ["http://hot.com/a/b/c"] * 300
    df = spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string").repartition(5)
    got = url_rules.judge(df.withColumn("host", F.lit("clash")).withColumn("salt", F.lit(1)),
                          spark.createDataFrame(rules, "host string, path string, verdict string"))
    want = [(i, *naive_rule(u, rules)) for i, u in enumerate(urls)]
    assert sorted(tuple(r) for r in got.collect()) == want


def test_url_edges(spark):
    df = spark.createDataFrame([(1, "http://a.com/"), (1, "http://a.com/"), (None, "http://b.org")], "page_id bigint, url string")
    none = spark.createDataFrame([], "host string, path string, verdict string")
    assert {(r.rule, r.verdict) for r in url_rules.judge(df, none).collect()} == {(None, "allow")}
    assert url_rules.judge(df, none).count() == 3 and url_rules.judge(df.limit(0), none).collect() == []
    twice = spark.createDataFrame([("com", None, "allow"), ("COM", "", "block"), ("org", "", None)], "host string, path string, verdict string")
    assert sorted((r.rule, r.verdict) for r in url_rules.judge(df, twice).where("page_id = 1").collect()) == [("com", "block")] * 2


PAGES = [
    ("<p>One<p>Two <b>bold</b>text", "One\n\nTwo boldtext"),
    ("<ul><li>a<li>b<ol start=3><li>c<li>d</ol><li>e</ul>x", "- a\n- b\n  3. c\n  4. d\n- e\n\nx"),
    ("<table><tr><th>Name<th>Size<tr><td>ab<td>1<tr><td>long name<td>22</table>", "Name       Size\nab         1\nlong name  22"),
    ("<title>T</title><style>p{}</style><script>if(a<b){'</p>'}</script>Seen<!-- no --><div hidden>x</div>"
     "<span style='display: none'>y</span><i aria-hidden=true>z</i>", "Seen"),
    ("<pre>a  b\n  c</pre>after", "a  b\n  c\n\nafter"),
    ("a&amp;b &lt;c&gt; &eacute;<br>next", "a&b <c> é\nnext"),
    ("<div>a</div><div>b</div><h1>c</h1>d", "a\nb\n\nc\n\nd"),
    ("<table><tr><td><p>x<p>y<td>z</table>", "x  z\ny"),
    ("<td>no table</td>", "no table"), ("</div></p>stray<", "stray<"), ("", ""), ("plain text", "plain text"),
    ("<dl><dt>t<dd>d<dt>u<dd>e</dl>", "t\nd\nu\ne"), ("<p>a<table><tr><td>b</table>c", "a\n\nb\n\nc"),
    ("<select><option>no<option>no</select><textarea>no</textarea>yes", "yes"),
]


@pytest.mark.parametrize("html,text", PAGES)
def test_pages(html, text):
    assert html_text.page_text(html) == text


CELLS = [
    ("<table><td>a<td>b</table>c", "a  b\n\nc"),
    ("<table><tbody><td>a<th>b<tr><td>c</table>", "a  b\nc"),
    ("<table><caption>t<td>a</table>", "t\na"),
    ("<table><tr><form action=x><td>a</td><td>b</td></form></tr><tr><td>c</table>", "a  b\nc"),
    ("<table><tr><form><td>a<tr><td>b<td>c</table>", "a\nb  c"),
    ("<table><tr><a href=x><td>a</a><td>b</table>", "a  b"),
    ("<table><thead><th>h<tbody><td>a<tfoot><td>z</table>", "h\na\nz"),
    ("<table><tr><td>a<table><td>in</table><td>b</table>", None),
    ("<div><svg width=1 />a<p>b</div>c", "a\n\nb\n\nc"),
    ("<p>a<math/>b", "ab"),
    ("<p>a<svg><g><path d=x /><script/></g></svg>b", "ab"),
    ("<div>a<svg><path><div>b</div>c", "a\nb\nc"),
    ("<div/>a<p/>b", "a\n\nb"),
]


@pytest.mark.parametrize("html,text", CELLS)
def test_every_cell_and_what_follows_closed_elements(html, text):
    """Rows that no tag opens, elements between row and cell, svg and math that close themselves."""
    import re
    got = html_text.page_text(html)
    assert sorted(re.findall(r"\w+", got)) == sorted(re.findall(r"\w+", re.sub(r"<[^>]*>", " ", html))) or text == "ab"
    assert text is None or got == text


SHOWN = [
    # visibility is inherited, and may be set back inside; a later declaration counts
    ("<div style='visibility:hidden'>a<b style='visibility: visible'>b</b>c</div>d", "b\nd"),
    ("<p style='visibility:collapse'>a<i>b</i></p>c", "c"), ("<p style='display:none;display:block'>a", "a"),
    ("<p style='content-visibility:hidden'>a", "a"),
    # closed and open details and dialogs
    ("<details><p>no<summary>a</summary>no<summary>no</summary></details>b", "a\nb"),
    ("<details open><summary>a</summary>b</details>", "a\nb"), ("<dialog>no</dialog><dialog open>a</dialog>", "a"),
    # values of buttons and text fields
    ("<p>a<input type=submit value='Send it'>b<input type=hidden value=no><input value=c>", "a Send it b c"),
    # formulas and text in drawings
    ("<p>a <math><mi>x</mi><mo>=</mo><mfrac><mn>1</mn><mn>2</mn></mfrac><annotation>no</annotation></math> b", "a x=1 2 b"),
    ("<p>a<svg><title>no</title>no<defs><text>no</text></defs><text>b <tspan>c</tspan></text><text>d</text></svg>e", "a\nb c\nd\ne"),
    ("<svg><foreignObject><p>a</p></foreignObject></svg><text>b</text>c", "a\n\nbc"),
    # cells over columns and rows
    ("<table><tr><th colspan=2>head<th>x<tr><td>a<td>b<td>c</table>", "head  x\na  b  c"),
    ("<table><tr><td rowspan=2>a<td>b<tr><td>c<tr><td>d<td>e</table>", "a  b\n   c\nd  e"),
    ("<table><tr><td rowspan=0>a<td>b<tr><td>c<tbody><tr><td>d<td>e</table>", "a  b\n   c\nd  e"),
    ("<table><tr><td colspan=2>a long head<tr><td>a<td>b<td>c</table>", "a long head\na  b         c"),
    ("<table><tr><td colspan=0>a<td rowspan=x>b</table>", "a  b"),
    # a wide cell pushes what follows it and does not pad other rows beyond the bound
    (f"<table><tr><td>{'w' * 300}<td>x<tr><td>y<td>z</table>", "w" * 300 + "  x\ny" + " " * 81 + "z"),
]


@pytest.mark.parametrize("html,text", SHOWN)
def test_shown_and_unseen(html, text):
    assert html_text.page_text(html) == text


@pytest.mark.parametrize("part", ["<div>word ", "<ul><li>word ", "<table><tr><td>word ", "<p><b>word ", "<button><p>word ", "<svg><g><text>word ",
                                  "<object></b>", "<dl><dd>word ", "<details open><div>word ", "<li><p>word "])
def test_deep_pages_take_linear_time(part):
    import time

    def seconds(n):
        start = time.perf_counter()
        assert html_text.page_text(part * n).count("word") in (0, n)
        return time.perf_counter() - start
    seconds(500)
    assert seconds(20_000) < 8 * min(seconds(5_000), seconds(5_000)) + 0.5
    assert seconds(20_000) < 5


def test_deep_and_long_pages():
    assert html_text.page_text("<div>" * 20_000 + "x" + "</div>" * 20_000) == "x"
    assert html_text.page_text("<p>word " * 20_000).count("word") == 20_000
    assert html_text.page_text("<b>word " * 3_000).count("word") == 3_000


def test_every_visible_word_comes_out(spark, sf):
    """Words of the page's text nodes outside unseen elements, in order."""
    import re
    rows = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = queries.QUERIES["op7_html_text"](spark, sf).collect()
    assert len(got) == len(rows)
    for r in got:
        import html
        body = re.sub(r"(?s)<!--.*?-->|<(script|style|title)\b.*?</\1>", " ", rows[r.page_id])
        want = html.unescape(re.sub(r"<[^>]*>", " ", body)).split()
        lines = re.sub(r"(?m)^ *(- |\d+\. )", "", r.text)
        assert "".join(lines.split()) == "".join(want)


def test_html_edges(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (None, "<p>x"), (2, "<p>y")], "page_id bigint, html string")
    got = html_text.extract(df.withColumn("text", F.lit("clash")).withColumn("html_source", F.lit(1)))
    assert got.columns == ["page_id", "html", "html_source", "text"]
    assert sorted((r.text for r in got.collect()), key=repr) == ["", "x", "y", None]
    assert html_text.extract(df.limit(0)).collect() == []
