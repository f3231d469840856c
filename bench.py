"""Headline queries, one JSON line: seconds per query and their sum.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8).  Each
query runs once to warm up and once measured, written to the `noop` sink so
that every column of every row is computed.

The given tables are single files of one row group, which no plan can split.  As a
large table has many splits, the larger ones are copied once, untimed, to a
temporary folder with as many files as cores; the queries themselves never
repartition a source.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "article_products", "article_products_full", "article_results", "block_specs", "relevance", "score_prefilter",
    "title_analysis", "keyword_windows", "page_text", "parsed_pages", "normalize_specs",
    "model_key", "keep_first", "merge_first_filled", "merge_richer", "latest_per_key",
    "upsert_replace", "upsert_if_richer", "stage_insert", "matching_lines", "column_profile",
    "duplicate_ids", "field_accuracy", "faceted_search", "search_latest", "incremental_load",
    "response_specs",
]


def split_tables(folder: str, parts: int) -> str:
    """The same tables in several files each."""
    import pyarrow.parquet as pq
    out = tempfile.mkdtemp(prefix="spark-")
    for name in os.listdir(folder):
        table = pq.read_table(os.path.join(folder, name))
        n = parts if table.num_rows > 1000 else 1
        os.mkdir(os.path.join(out, name))
        size = -(-table.num_rows // n) or 1
        for k in range(n):
            pq.write_table(table.slice(k * size, size), os.path.join(out, name, f"part-{k:03d}.parquet"))
    return out


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("specforge-bench")
             .config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false")
             .config("spark.driver.memory", "12g").config("spark.sql.session.timeZone", "UTC")
             .config("spark.sql.adaptive.enabled", "true").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    from specforge import catalog
    catalog.load()
    tables = split_tables(folder, int(cpus))
    times = {}
    for name in HEADLINE:
        for _ in range(2):
            start = time.perf_counter()
            catalog.QUERIES[name](spark, tables).write.mode("overwrite").format("noop").save()
            times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": os.path.basename(folder.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
