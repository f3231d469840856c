"""Exact duplicates, tokenizer alignment, phrase collocations."""

import hashlib
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from specforge.llm import alignment, exact, phrases, queries
from specforge.llm.queries import tokenizer

WHITE = re.compile("[\x20\x09-\x0D]")


# --- 11: exact duplicates ---------------------------------------------------------------

def naive_groups(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[WHITE.sub("", t or "")].append((-len(t or ""), i is None, i))
    return groups


def check_exact(rows, got):
    groups = naive_groups(rows)
    best = {k: min(v, key=lambda x: (x[0], x[1], x[2] or 0))[2] for k, v in groups.items()}
    want = sorted(((i, best[n], len(groups[n]), hashlib.sha256(n.encode()).hexdigest())
                   for i, t in rows for n in [WHITE.sub("", t or "")]), key=repr)
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=repr) == want
    kept = Counter(r.text_sha256 for r in got if r.kept)
    assert set(kept.values()) <= {1} and len(kept) == len(groups)
    assert all(r.doc_id == r.keep_id for r in got if r.kept)


def test_exact_edges(spark, docs, nothing):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    clash = docs.withColumn("row", F.lit(1)).withColumn("key", F.lit("x")).withColumn("bucket", F.lit(None))
    got = exact.deduplicate(clash)
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    check_exact(rows, got.collect())
    assert exact.deduplicate(nothing).collect() == []


@pytest.mark.parametrize("capacity,chain", [(exact.CAPACITY, exact.CHAIN), (2_000, 3)])
def test_exact_splits_and_salts(spark, capacity, chain):
    """Small buckets split over several rounds; a hot text in every task goes through salted parts."""
    rows = [(k, f"text number {k % 700} " + "x" * (k % 50)) for k in range(3_000)]
    rows += [(10_000 + k, "the same\n text" + " " * (k % 5)) for k in range(1_500)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(24)
    check_exact(rows, exact.deduplicate(df, capacity=capacity, chain=chain).collect())


def test_equal_keys_are_told_apart_by_bytes(spark):
    """Every text has the same key: the chain compares bytes, also across salted parts."""
    rows = [(k, 7, f"t{k % 5}".encode()) for k in range(200)]
    df = spark.createDataFrame(rows, "rep bigint, key bigint, text binary")
    for chain in (1_000, 10):
        got = {r["rep"]: r["head"] for r in exact.classes(df, chain=chain).collect()}
        assert len(got) == 200 and len(set(got.values())) == 5
        assert all(got[k] % 5 == k % 5 for k in got)


def test_directory_doubles_and_covers_all_keys(spark):
    import random
    draw = random.Random(1)
    keys = [draw.randrange(-1 << 63, 1 << 63) for _ in range(5_000)] + [123] * 3_000
    df = spark.createDataFrame([(k, 10) for k in keys], "key bigint, size int")
    made = exact.fill(df, capacity=400)
    assert made.depth > exact.STEP and len(made.slots) == 1 << made.depth
    placed = made.look_up(df).groupBy("bucket").agg(F.sum("size").alias("n"), F.max(F.col("key") == 123).alias("hot")).collect()
    assert sum(r.n for r in placed) == 10 * len(keys)
    assert all(r.n - (30_000 if r.hot else 10) <= 400 for r in placed)     # besides the heaviest key
    for bucket in made.local:
        a, b = made.range_of(bucket, made.depth)
        assert (made.slots[a:b] == bucket).all() and (made.slots == bucket).sum() == b - a


# --- 12: alignment ----------------------------------------------------------------------

@pytest.fixture(scope="module")
def sides():
    return alignment.Bpe(tokenizer("byte_bpe_50k.json")), alignment.Pieces(tokenizer("piece_bpe_32k.model"))


def naive_alignment(sides, rows):
    """Whole texts, token by token."""
    docs, seen = [], Counter()
    for i, text in rows:
        a, b = (s([text or ""])[0] for s in sides)
        bytes_a, bytes_b = ([s.bytes[x] for x in ids] for s, ids in zip(sides, (a, b)))
        whole = b" " + (text or "").encode()
        groups = []
        if text and b"".join(bytes_a) == whole and b"".join(bytes_b) == whole:
            x = y = at_a = at_b = first_a = first_b = 0
            while x < len(a) or y < len(b):
                if at_a <= at_b:
                    at_a += len(bytes_a[x])
                    x += 1
                else:
                    at_b += len(bytes_b[y])
                    y += 1
                if at_a == at_b:
                    groups.append((a[first_a:x], b[first_b:y]))
                    first_a, first_b = x, y
        links = Counter((p, q) for g, h in groups for p in g for q in h)
        seen.update(links.keys())
        docs.append((i, groups, links))
    top = defaultdict(int)
    for (p, _), n in seen.items():
        top[p] = max(top[p], n)
    out = []
    for i, groups, links in docs:
        line = ";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in groups)
        out.append((i, sum(len(g) for g, _ in groups), sum(len(h) for _, h in groups), len(groups), sum(links.values()),
                    sum(n for k, n in links.items() if seen[k] == top[k[0]]), sum(n * seen[k] for k, n in links.items()),
                    hashlib.sha256(line.encode()).hexdigest() if groups else ""))
    return sorted(out, key=repr)


TRICKY = ["a", " ", "  ", "\n", " a", "a ", "a  b", "a \n b\t c", "x  y 　z", "don't <|endoftext|> <s> </s> <0x41> it's",
          "▁ is a mark", "a▁b", "漢字かな交じり文 と 空白", "😀😀 é́ ñ", "a\x85 b\x1c c\x00 d", "​ zero ﻿ width", "1 22 333 4444 55555",
          "ÀÉ ﬁ ｆｕｌｌ", "." * 50 + " " * 40 + "end", "end \r\n", "\t tab first", "word\n word .\n"]


@pytest.mark.parametrize("head", [alignment.HEAD, 5, 0])
def test_alignment_of_odd_texts(spark, sides, docs, nothing, head):
    rows = [(r.doc_id, r.text) for r in docs.collect() if len(r.text or "") < 10_000] + [(100 + k, t) for k, t in enumerate(TRICKY)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3).withColumn("row", F.lit("clash")).withColumn("pairs", F.lit(1))
    paths = tokenizer("byte_bpe_50k.json"), tokenizer("piece_bpe_32k.model")
    got = alignment.align(df, *paths, head=head)
    assert sorted(map(tuple, got.collect()), key=repr) == naive_alignment(sides, rows)
    assert alignment.align(nothing, *paths).collect() == []


def test_op12_against_whole_texts(spark, sf, sides):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = queries.QUERIES["op12_alignment"](spark, sf)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(map(tuple, got.collect()), key=repr) == naive_alignment(sides, rows)


def test_overlaps_are_per_document():
    import pandas as pd
    a = pd.DataFrame({"doc": [0, 0, 1], "start": [0, 3, 10], "end": [3, 6, 12]})
    b = pd.DataFrame({"doc": [0, 0, 1], "start": [0, 2, 10], "end": [2, 6, 12]})
    i, j = alignment.overlaps(a, b)
    assert sorted(zip(i.tolist(), j.tolist())) == [(0, 0), (0, 1), (1, 1), (2, 2)]
    left, right, ends = alignment.groups(a, b)
    assert left.tolist() == [0, 0, 1] and right.tolist() == [0, 0, 1] and ends.tolist() == [6, 12]


# --- 13: phrases ------------------------------------------------------------------------

def naive_phrases(rows, threshold, top):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n-\r]", low):
            words = re.findall("[^ \t]+", piece)
            n[lang or "und"] += len(words)
            for k in range(1, 6):
                for i in range(len(words) - k + 1):
                    f[lang or "und"][tuple(words[i:i + k])] += 1
    out = []
    for lang, counts in f.items():
        wide = {p: a for p, a in counts.items() if len(p) > 1 and a >= threshold}
        inside = defaultdict(int)
        for p, a in wide.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    inside[p[i:i + k]] = max(inside[p[i:i + k]], a)
        found = []
        for p, a in wide.items():
            if 100 * inside[p] < 100 * a:
                score, k = min((1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
                found.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for rank, (s, a, p, l, r) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, p.decode(), -a, l, r, n[lang], -s))
    return sorted(out)


def test_phrases_edges(spark, docs, nothing):
    extra = docs.select(F.lit("w" * 3).alias("phrase"), F.lit(2).alias("size"), F.when(F.col("doc_id") != 2, F.col("lang")).alias("lang"), "text")
    rows = [(r.lang, r.text) for r in extra.collect()]
    for threshold, top in ((2, 50), (20, None), (1, 3_000)):
        if threshold == 1:
            rows = [r for r in rows if len(r[1] or "") < 1_000]
            extra = extra.where(F.length("text") < 1_000)
        got = phrases.collocations(extra, threshold=threshold, top=top)
        assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
        assert sorted(map(tuple, got.collect())) == naive_phrases(rows, threshold, top)
    assert phrases.collocations(nothing).collect() == []


@pytest.mark.parametrize("room", [1, 4])
def test_summaries_keep_every_frequent_phrase(spark, sf, room):
    """Tight capacities and tiny merges: counters are taken off, yet the counts are those of a plain sum."""
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("lang", "text").repartition(7)
    got = phrases.collocations(rows, threshold=15, top=None, room=room)
    assert sorted(map(tuple, got.collect())) == naive_phrases([tuple(r) for r in rows.collect()], 15, None)


def test_misra_gries_bound():
    """No more is taken off than mass over capacity, whatever order the summaries come in."""
    import numpy as np
    rng = np.random.default_rng(0)
    stream = np.concatenate([rng.integers(0, 10_000, 50_000), np.repeat(np.arange(20_000, 20_005), 700)])
    rng.shuffle(stream)
    capacity = len(stream) // 600 + 1
    keys, counts, off = np.zeros(0, np.uint64), np.zeros(0, np.int64), 0
    for part in np.array_split(stream, 40):
        one = np.unique(part.astype(np.uint64), return_counts=True)
        keys, counts, less = phrases.pruned(*phrases.merged([(keys, counts), one]), capacity)
        assert len(keys) <= capacity
        off += less
    assert off <= len(stream) // (capacity + 1) < 700
    assert set(range(20_000, 20_005)) <= set(keys[counts + off >= 600].tolist())


def test_planes_come_back():
    import numpy as np
    for width in (1, 2, 4, 8):
        values = np.random.default_rng(width).integers(0, 1 << min(62, 8 * width), 1_000).astype(f"<u{width}")
        assert (phrases._from_planes(phrases._planes(values), 1_000, width) == values).all()
