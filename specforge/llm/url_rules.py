"""URL filters as a sort-merge range join (operator 8).

A host's labels in reverse order, each closed by a dot, make a key under which a
domain and its subdomains are one interval.  URLs and rules are dealt to ranges
of keys, sorted together, and swept once: a rule's start pushes it on a stack, a
key outside its interval pops it, so the stack holds the rules of the current
host's domains, innermost last.  Among them the longest whose path begins the
URL's path wins.

Rules that span several ranges are given to each of them: only ancestors of a
range's first key do.  A host with very many URLs is cut by a hash of its rows,
so it takes several ranges; a task holds the stack and one batch of rows.

Null URLs and URLs without `://` have an empty host and path and get the method's
verdict, as does a URL that no rule fits.  Rules with an empty host fit every
host.  A rule that is there twice with different verdicts blocks.  Extra columns
are left to the caller (join by id).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from specforge.llm.common import batch_of, column, shuffle_parts

SAMPLE = 20_000         # keys that choose the ranges
DEFAULT = "allow"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    rest = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1), F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    rest = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1), F.lit(""))
    return F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def key_of(host: Column) -> Column:
    """com.example.www. for www.example.com; empty for an empty host."""
    return F.when(host == "", "").otherwise(
        F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit(".")))


ROWS = pa.schema([("part", pa.int32()), ("key", pa.string()), ("salt", pa.int64()), ("id", pa.int64()),
                  ("host", pa.string()), ("path", pa.string()), ("verdict", pa.string())])
RESULT = pa.schema([("page_id", pa.int64()), ("host", pa.string()), ("path", pa.string()),
                    ("rule", pa.string()), ("verdict", pa.string())])


class Stack:
    """Active rules: frames of (key, rules by path), each inside the one below."""

    def __init__(self):
        # Key, rules by path, lengths of the paths (longest first, made when needed).
        self.frames: list[list] = []

    def leave(self, key: str) -> None:
        while self.frames and not key.startswith(self.frames[-1][0]):
            self.frames.pop()

    def push(self, key: str, host: str, path: str, verdict: str) -> None:
        self.leave(key)
        if not self.frames or self.frames[-1][0] != key:
            self.frames.append([key, {}, None])
        rules = self.frames[-1][1]
        self.frames[-1][2] = None
        if path not in rules or verdict == "block":
            rules[path] = (host + path, verdict)

    def find(self, key: str, path: str) -> tuple[str, str] | None:
        """The longest rule; of equally long ones the one of the inner domain."""
        self.leave(key)
        best = None
        for frame in self.frames:
            rules = frame[1]
            if frame[2] is None:
                frame[2] = sorted({len(p) for p in rules}, reverse=True)
            for size in frame[2]:
                hit = rules.get(path[:size]) if size <= len(path) else None
                if hit is not None:
                    if best is None or len(hit[0]) >= len(best[0]):
                        best = hit
                    break
        return best


def sweep(default: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stack, part = Stack(), None
        for batch in batches:
            out: list[tuple] = []
            for of, key, _, page, host, path, verdict in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if of != part:
                    stack, part = Stack(), of
                if verdict is not None:
                    stack.push(key, host, path, verdict)
                else:
                    hit = stack.find(key, path)
                    out.append((page, host, path, *(hit or (None, default))))
            if out:
                yield batch_of(RESULT, list(map(list, zip(*out, strict=True))))
    return run


def _ranges(urls: DataFrame, parts: int) -> list[tuple[str, int]]:
    """The (key, salt) at which each range but the first begins, from a sample of fixed size."""
    picked = urls.select("key", "salt").orderBy(F.xxhash64("salt", "key")).limit(SAMPLE).toArrow()
    known = sorted(zip(picked.column("key").to_pylist(), picked.column("salt").to_pylist(), strict=True),
                   key=lambda k: (k[0].encode(), k[1]))
    return sorted({known[len(known) * k // parts] for k in range(1, parts)},
                  key=lambda k: (k[0].encode(), k[1])) if known else []


def _dealt(bounds: Sequence[tuple[str, int]]):
    """Rows with the range they belong to; a rule with all ranges its interval meets."""
    import bisect
    ends = [(k.encode(), s) for k, s in bounds]
    low, high = -(1 << 63), (1 << 63) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts, places = [], []
            for k, (key, salt, verdict) in enumerate(zip(*(column(batch, c).to_pylist() for c in ("key", "salt", "verdict")), strict=True)):
                first = (key.encode(), low if verdict is not None else salt)
                last = (key.encode() + b"\xff", high) if verdict is not None else first
                a, b = bisect.bisect_right(ends, first), bisect.bisect_right(ends, last)
                parts += range(a, b + 1)
                places += [k] * (b + 1 - a)
            taken = batch.take(pa.array(places, pa.int64()))
            yield batch_of(ROWS, [np.array(parts, np.int32), *(column(taken, f.name) for f in list(ROWS)[1:])])
    return run


def judge(pages: DataFrame, rules: DataFrame, doc: str = "page_id", url: str = "url",
          default: str = DEFAULT) -> DataFrame:
    """page_id, host, path, rule, verdict for every row of `pages`.

    `rules` has host, path and verdict ('allow' or 'block'); it may be large.
    """
    spark = pages.sparkSession
    columns = [f.name for f in list(ROWS)[1:]]
    urls = (pages.select(F.col(doc).cast("bigint").alias("id"), host_of(F.col(url)).alias("host"),
                         path_of(F.col(url)).alias("path"), F.lit(None).cast("string").alias("verdict"),
                         F.xxhash64(url, doc).alias("salt"))
            .withColumn("key", key_of(F.col("host"))).select(*columns))
    own = (rules.select(F.translate(F.coalesce("host", F.lit("")), UPPER, LOWER).alias("host"),
                        F.coalesce("path", F.lit("")).alias("path"), "verdict")
           .where("verdict is not null").groupBy("host", "path")
           .agg(F.when(F.max((F.col("verdict") == "block").cast("int")) == 1, "block").otherwise("allow").alias("verdict"))
           .select(key_of(F.col("host")).alias("key"), F.lit(-(1 << 63)).alias("salt"),
                   F.lit(None).cast("bigint").alias("id"), "host", "path", "verdict").select(*columns))
    parts = shuffle_parts(spark)
    dealt = _dealt(_ranges(urls, parts))
    every = (urls.mapInArrow(dealt, from_arrow_schema(ROWS))
             .unionAll(own.mapInArrow(dealt, from_arrow_schema(ROWS))))
    # Rules come before the URLs of their key in each range.
    return (every.repartition(parts, "part")
            .sortWithinPartitions("part", "key", F.col("verdict").isNull(), "path", "id", "salt")
            .mapInArrow(sweep(default), from_arrow_schema(RESULT)))
