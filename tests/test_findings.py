"""Registered queries on tables that the given small ones do not hold."""

from types import SimpleNamespace

from pyspark.sql import functions as F

from specforge import catalog

catalog.load()

from specforge.catalog import relations  # noqa: E402


def test_approval_of_rows_that_look_like_results(spark):
    cols = "id bigint, source_id bigint, brand_name string, model string, price double, date string, created_at string"
    same = (1, "Nike", "Ghost 2", 99.0, "1998-06-02", "1998-06-02")
    t = SimpleNamespace(products=spark.createDataFrame([(i, *same) for i in (3, 4, 8, 16)], cols))
    assert [tuple(r) for r in relations.approve_log(t).collect()] == [("moved", 2, 3)]
    moved = relations.approve_moved(t)
    assert sorted(moved.columns) == ["brand_name", "date", "model", "model_key", "price", "source_id"]
    assert sorted(r["model_key"] for r in moved.collect()) == ["nike ghost 2", "nike ghost 2", "old"]
    assert [r["id"] for r in relations.approve_staging(t).collect()] == [4]


def test_table_stream_reads_a_file_and_a_folder(spark, tmp_path):
    from specforge.streaming import ingest
    df = spark.range(6).withColumn("x", F.col("id") * 2)
    folder = str(tmp_path / "documents.parquet")
    df.repartition(3).write.parquet(folder)
    one = next(p for p in (tmp_path / "documents.parquet").glob("part-*.parquet"))
    for n, (path, want) in enumerate([(folder, 6), (str(one), spark.read.parquet(str(one)).count())]):
        out = str(tmp_path / f"out{n}")
        ingest.run_to_files(ingest.table_stream(spark, path, df.schema), out, str(tmp_path / f"cp{n}"))
        assert spark.read.schema(df.schema).parquet(out).count() == want > 0


def runs(df, pattern):
    """How often a plan holds a pattern."""
    return df._jdf.queryExecution().optimizedPlan().toString().count(pattern)


def test_cluster_patterns_run_once_per_snippet(spark):
    from specforge import rules
    from specforge.functions import regex as rx
    from specforge.operators import windows
    df = spark.createDataFrame([(["weighs 250 g with an 8 mm drop and a 33 mm heel, 120 USD", "drop 4 mm"],)], "top array<string>")
    best = df.select(windows.best_cluster(F.col("top")).alias("b"))
    assert runs(best, rx.java(rules.CLUSTER_DROP)) == 1
    assert runs(best, rx.java(rules.VALUE_PATTERNS["price"][0])) == 1
    assert runs(best, "regexp_instr") == 4          # a number and a word, for heel and forefoot
    assert best.first()["b"]["cluster"]["weight_g"] == 250.0


def test_contexts_of_short_and_long_parts(spark):
    from specforge.operators import blocks
    body = "ab12" * 40 + "x" * 300 + " 34 " + "y" * 10 + "56" * 30 + "z" * 500
    df = spark.createDataFrame([(body,)], "t string")
    got = df.select(blocks.match_contexts(F.col("t"), r"\d\d", 50, 50).alias("m")).first()["m"]
    import re
    want = [(m.group(), body[max(0, m.start() - 50):m.start()], body[m.end():m.end() + 50]) for m in re.finditer(r"\d\d", body)]
    assert [tuple(x) for x in got] == want


def test_whole_text_figures_scan_once(spark):
    from specforge import rules
    from specforge.functions import regex as rx
    from specforge.operators import fallback
    df = spark.createDataFrame([("250 g, 180,$199 mm",), ("9 oz or €120",), (None,)], "t string")
    out = df.select(fallback.fallback_weight(F.col("t")).alias("w"), fallback.fallback_price(F.col("t"))["price_usd"].alias("p"),
                    fallback.weird_price(F.col("t")).alias("o"))
    for pattern in (rules.FALLBACK_GRAMS, rules.FALLBACK_OZ, rules.FALLBACK_MONEY[1][0], rules.WEIRD_PRICE):
        assert runs(out, rx.java(pattern)) == 1
    assert [tuple(r) for r in out.collect()] == [(250.0, 199.0, 199.0), (255.0, 129.6, None), (None, None, None)]


def test_tightened_names_are_refined_once(spark):
    from specforge.functions import regex as rx
    from specforge.operators.normalize import tighten
    cols = ("id bigint, article_id string, source_id bigint, brand_name string, model string, heel_height double, forefoot_height double, "
            "drop double, weight double, price double")
    rest = (None, None, None, 250.0, None)
    df = spark.createDataFrame([(1, "7", 5, " Nike ", "Nike Pegasus 40 Review", *rest), (2, "0", 5, "Nike", "Ghost", *rest), (3, "7", 5, None, "Ghost", *rest),
                                (4, "7", None, "On", "Cloud", *rest), (5, "7", 5, "Nike", " (x) ", *rest), (6, "7", 5, "¡", "Ghost", *rest)], cols)
    out = tighten(df)
    assert out.columns == [*df.columns, "model_key"]
    for pattern in (r"\s+review\s*$", r"\([^()]*\)"):
        assert runs(out, rx.java(pattern)) == 1
    assert [tuple(r)[:5] + (r["weight"], r["model_key"]) for r in out.collect()] == [(1, 7.0, "5", "Nike", "Pegasus 40", 250.0, "nike::pegasus 40")]


def test_comparisons_are_found_once_and_by_sentence(spark):
    from specforge.operators import resolve
    rows = [(0, "Ghost 17 vs Pegasus 40. Nothing here, A-vs-B.  On Cloud vs. Mach 6. x\x01y compared  to\nz vs w"), (1, "canvas. vs. x"), (2, "none"), (3, None),
            (4, "a VS b.c versus d"), (5, ", vs a vs b vs. c d vs e vs f")]
    df = spark.createDataFrame(rows, "i int, t string")
    out = df.select("i", resolve.comparison_context(F.lit("T"), F.col("t")).alias("x"))
    assert runs(out, "compared?") == 1
    got = {r.i: r.x and r.x.split("\n\n")[0] for r in out.collect()}
    found = "COMPARISONS FOUND: "
    assert got == {0: found + "T Ghost 17 vs Pegasus 40, On Cloud vs Mach 6, x y vs z vs w", 1: "T", 2: "T", 3: None,
                   4: found + "T a vs b, c vs d", 5: found + "vs a vs b vs c d vs e vs f"}


def test_pages_are_parsed_in_slices(spark, monkeypatch):
    import pyarrow as pa
    from specforge import rules
    from specforge.sources import pages
    html = ["<p>a <b>b</b></p><table><tr><td>x<td>1</tr></table>", None, "", "<table></table><div>c", "<p>d", "e" * 200, "f"]
    df = spark.createDataFrame(list(enumerate(html)), "i int, html string").coalesce(1)
    whole = [tuple(r) for r in pages.parse_pages(df, ["i"]).orderBy("i").collect()]
    assert whole[:4] == [(0, "a b\nx\n1", [[["x", "1"]]]), (1, "", []), (2, "", []), (3, "c", [[]])] and len(whole) == len(html)
    monkeypatch.setattr(rules, "PARSED_CHARS", 40, raising=False)
    assert [tuple(r) for r in pages.parse_pages(df, ["i"]).orderBy("i").collect()] == whole
    tasks = []
    monkeypatch.setattr(type(df), "mapInArrow", lambda self, run, schema: tasks.append(run))
    pages.parse_pages(df, ["i"])
    batch = pa.RecordBatch.from_pydict({"i": list(range(len(html))), "html": html})
    assert [b.column("i").to_pylist() for b in tasks[0](iter([batch]))] == [[0], [1, 2, 3, 4, 5], [6]]


def test_comparison_tables_use_all_tasks_and_read_a_cell_once(spark):
    from specforge.operators import tables
    df = catalog.QUERIES["comparison_tables"](spark, "/root/testdata/sf0.001")
    assert df.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    cell = spark.createDataFrame([("Weight: 9.9 oz",), ("250 g / 8 oz",), ("x",), (None,)], "c string").select(tables.cell_weight(F.col("c")).alias("w"))
    assert runs(cell, "ounces)") == runs(cell, "grams)") == 1
    assert [tuple(r["w"]) for r in cell.collect()] == [(281.0, 9.9), (250.0, None), (None, None), (None, None)]


def test_cleanup_patterns_run_where_their_literal_stands(spark):
    import re
    from specforge import rules
    from specforge.operators import classify
    fields = ("brand_name", "model", "primary_use")
    words = ["HeadPhone", "earbud", "Watch", "hydration \t Pack", "VEST", "shortS", "bacKpack", "Gloves", "nutrition", "cap", "x", None, ""]
    rows = [(i, words[i % 13], words[i * 5 % 13], words[i * 7 % 13]) for i in range(60)]
    df = spark.createDataFrame(rows, "i int, brand_name string, model string, primary_use string")
    out = df.select("i", classify.cleanup_category({f: F.col(f) for f in fields}).alias("c"))
    assert runs(out.filter("c is null").select("i"), "Contains(") == len(rules.CLEANUP_RULES)
    for r, row in zip(out.orderBy("i").collect(), rows, strict=True):
        want = next((c for f, p, c in rules.CLEANUP_RULES if re.search(p, row[1 + fields.index(f)] or "", re.I | re.A)), None)
        assert (r["c"] and r["c"]["category"]) == want, row


def test_a_filter_on_specs_reads_the_blocks_once(spark):
    from specforge.functions import regex as rx
    from specforge import rules
    from specforge.operators import blocks, classify
    df = spark.createDataFrame([(1, "Trail Shoes: Nike Pegasus 40", "Nike Pegasus 40", None, "Trail Shoes\nA 9.5 millimeter drop, 30 millimeters in the forefoot, 250 g."),
                                (2, "h", "x", None, "nothing")], "i int, heading string, brand_model string, heading_price double, block string")
    found = blocks.extract_specs(df).filter(classify.complete_spec())
    for pattern in (rules.FOREFOOT_GENERAL, rules.DROP_PATTERNS[4]):
        assert runs(found, rx.java(pattern)) == 1
    assert [(r.i, r.brand_name, r["drop"], r.forefoot_height, r.surface_type) for r in found.collect()] == [(1, "Nike", 9.5, 9.5, "trail")]
