"""SimHash near-duplicates with vantage-point trees (operator 3).

A fingerprint has the majority bits of its text's shingle hashes.  Distinct
fingerprints are dealt to shards by a vantage-point tree: each inner node keeps
a fingerprint and a distance, near ones go to one side, far ones to the other.
A pair within the radius can only be torn apart if its near member lies within
the radius of the border, so such members are copied to the far side as well, and
every pair meets in a shard.  There the same tree goes on down to blocks that are
compared by bit counts.  A shard returns links that span its components, not all
pairs of a group.

Null text: no words, fingerprint zero, like an empty text.  Null doc_id: the
document takes part, but only numbers name components (all null: null).  Repeated
rows share their component.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from specforge.llm.common import batch_of, column, shuffle_parts, stored, strings
from specforge.llm.components import components, forest

SHINGLE = 3
SEED = 42
RADIUS = 2
SAMPLE = 16_384        # fingerprints that choose the tree above the shards
SHARD = 50_000         # fingerprints a shard should have
BLOCK = 512            # fingerprints compared with each other directly
CANDIDATES = 8         # vantage points tried for a split
MANY_DROPPED = 1_000_000   # ids beyond which dropped ones are joined by a shuffle


# --- fingerprints ---------------------------------------------------------------------

def fingerprint(text: str, size: int = SHINGLE, seed: int = SEED) -> int:
    """Majority bits of the shingles' hashes as an unsigned number."""
    import xxhash
    words = text.encode().lower().split()   # bytes: ASCII letters and blanks only
    if not words:
        return 0
    if len(words) < size:
        runs = [words]
    else:
        runs = zip(*(words[k:] for k in range(size)), strict=False)
    total = max(1, len(words) - size + 1)
    digest, join = xxhash.xxh64_intdigest, b" ".join
    hashes = np.fromiter((digest(join(r), seed) for r in runs), np.uint64, total)
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, total, 1 << 16):
        part = hashes[at:at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > total, bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, doc: str = "doc_id", text: str = "text", size: int = SHINGLE,
                 seed: int = SEED) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed 64-bit integer) of every row."""
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = np.array([fingerprint(t.as_py(), size, seed) for t in strings(batch, "text")], dtype=np.uint64)
            yield batch_of(schema, [column(batch, "doc_id"), made.view(np.int64)])

    return df.select(F.col(doc).cast("bigint").alias("doc_id"), F.col(text).alias("text")) \
        .mapInArrow(run, "doc_id bigint, fp bigint")


# --- vantage-point trees --------------------------------------------------------------

@dataclass
class Node:
    point: np.uint64
    border: int                    # near: at most so far
    near: Node | int               # below, or a shard's number
    far: Node | int


def _distance(points: np.ndarray, point: np.uint64) -> np.ndarray:
    return np.bitwise_count(points ^ point)


def choose(points: np.ndarray, radius: int, rng: np.random.Generator) -> tuple[np.uint64, int] | None:
    """The vantage point and border whose larger side is smallest, copies included;
    none if no split makes both sides clearly smaller."""
    best, least = None, 0.9 * len(points)
    for point in points[rng.integers(0, len(points), CANDIDATES)]:
        upto = np.cumsum(np.bincount(_distance(points, point), minlength=65))
        beyond = np.concatenate([np.zeros(radius, np.int64), upto[:-radius]])   # at most border - radius
        larger = np.maximum(upto, len(points) - beyond)
        border = int(larger.argmin())
        if larger[border] < least:
            best, least = (point, border), larger[border]
    return best


def _sides(points: np.ndarray, point: np.uint64, border: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    far = _distance(points, point).astype(np.int64)
    return far <= border, far > border - radius


def grow(sample: np.ndarray, shards: int, radius: int = RADIUS, seed: int = 0) -> Node | int:
    """A tree with about so many shards, numbered from 0."""
    rng = np.random.default_rng(seed)
    number = iter(range(1 << 62))

    def below(points: np.ndarray, share: int) -> Node | int:
        split = choose(points, radius, rng) if share > 1 and len(points) > 1 else None
        if split is None:
            return next(number)
        near = _distance(points, split[0]) <= split[1]
        part = min(share - 1, max(1, round(share * near.mean())))
        return Node(*split, below(points[near], part), below(points[~near], share - part))

    return below(sample, shards)


def deal(tree: Node | int, points: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Shards and positions of points; one near a border is in several."""
    shards, places = [], []
    stack = [(tree, np.arange(len(points)))]
    while stack:
        node, at = stack.pop()
        if len(at) == 0:
            continue
        if isinstance(node, Node):
            near, far = _sides(points[at], node.point, node.border, radius)
            stack += [(node.near, at[near]), (node.far, at[far])]
        else:
            shards.append(np.full(len(at), node, dtype=np.int32))
            places.append(at)
    if not places:
        return np.zeros(0, np.int32), np.zeros(0, np.int64)
    return np.concatenate(shards), np.concatenate(places)


def links(points: np.ndarray, radius: int = RADIUS, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of distinct fingerprints that span the components of all close pairs."""
    rng = np.random.default_rng(seed)
    left, right = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]

    def compare(a: np.ndarray, b: np.ndarray) -> None:
        i, j = np.nonzero(np.bitwise_count(a[:, None] ^ b[None, :]) <= radius)
        different = a[i] != b[j]
        if different.any():
            x, y = forest(a[i][different], b[j][different])
            left.append(x)
            right.append(y)

    stack = [points]
    while stack:
        some = stack.pop()
        split = choose(some, radius, rng) if len(some) > BLOCK else None
        if split is not None:
            near, far = _sides(some, *split, radius)
            stack += [some[near], some[far]]
            continue
        # Small, or too dense to split: all blocks against each other.
        for a in range(0, len(some), BLOCK):
            for b in range(a, len(some), BLOCK):
                compare(some[a:a + BLOCK], some[b:b + BLOCK])
    return forest(np.concatenate(left), np.concatenate(right))


# --- on Spark -------------------------------------------------------------------------

def close_pairs(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links between the distinct values of `fp` that span their components."""
    spark: SparkSession = distinct.sparkSession
    count = distinct.count()
    # A fixed number of fingerprints comes to the driver, chosen by hash.
    sample = distinct.select("fp").orderBy(F.xxhash64("fp"), "fp").limit(SAMPLE).toArrow()
    known = sample.column("fp").to_numpy().astype(np.int64).view(np.uint64)
    shards = min(max(shuffle_parts(spark), count // SHARD), SAMPLE // 16, max(1, count // BLOCK))
    tree = grow(known, shards, radius) if len(known) else 0
    dealt = pa.schema([("shard", pa.int32()), ("fp", pa.int64())])
    found = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = column(batch, "fp").to_numpy(zero_copy_only=False).view(np.uint64)
            shard, at = deal(tree, points, radius)
            yield batch_of(dealt, [shard, points[at].view(np.int64)])

    def search(group: pa.Table) -> pa.Table:
        points = group.column("fp").to_numpy().astype(np.int64).view(np.uint64)
        u, v = links(points, radius)
        return pa.table([u.view(np.int64), v.view(np.int64)], schema=found)

    return (distinct.select("fp").mapInArrow(route, "shard int, fp bigint")
            .groupBy("shard").applyInArrow(search, "u bigint, v bigint"))


def grouped(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """fp, component_id (smallest doc_id of the component) for every distinct fingerprint."""
    own = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    label = components(close_pairs(own, radius)).withColumnRenamed("node", "fp")
    labelled = own.join(label, "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    names = labelled.groupBy("component").agg(F.min("least").alias("component_id"))
    return stored(labelled.join(names, "component").select("fp", "component_id", "component"))


def cluster(df: DataFrame, doc: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id for every row."""
    prints = stored(fingerprints(df, doc, text))
    return prints.join(grouped(prints, radius), "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_first(df: DataFrame, doc: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """One document of each component, the one with the smallest id, all columns.

    Only ids move: the dropped ones are taken from the table, by a broadcast while
    they are few.  Rows that share a kept id come down to one; documents without
    an id stay only, one each, where no numbered one is near.
    """
    prints = stored(fingerprints(df, doc, text))
    groups = grouped(prints, radius)
    rows = prints.join(groups, "fp")
    named = rows.where("doc_id is not null").groupBy("doc_id").agg(
        F.min("component_id").alias("component_id"), F.count("*").alias("n"))
    gone = stored(named.where("doc_id <> component_id or n > 1").select(
        F.col("doc_id").alias("id"), (F.col("doc_id") == F.col("component_id")).alias("again")))
    few = gone.limit(MANY_DROPPED + 1).count() <= MANY_DROPPED

    def join(right: DataFrame, how: str) -> DataFrame:
        right = F.broadcast(right) if few else right
        return df.join(right, df[doc] == right["id"], how)

    once = join(gone.select("id"), "left_anti").where(F.col(doc).isNotNull())
    again = join(gone.where("again").select("id"), "left_semi").dropDuplicates([doc])
    lone = stored(rows.where("doc_id is null and component_id is null").select("component", "fp")
                  .groupBy("component").agg(F.min("fp").alias("fp")))
    unnamed = df.where(F.col(doc).isNull())
    if lone.isEmpty():
        return once.unionByName(again)
    from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema
    schema = to_arrow_schema(df.schema).append(pa.field("_fp", pa.int64()))

    def marked(batches):
        for batch in batches:
            made = np.array([fingerprint(t.as_py()) for t in strings(batch, text)], dtype=np.uint64)
            yield batch_of(schema, [*batch.columns, made.view(np.int64)])

    some = unnamed.mapInArrow(marked, from_arrow_schema(schema))
    lone = lone.select(F.col("fp").alias("_fp"))
    return once.unionByName(again).unionByName(
        some.join(lone, "_fp", "left_semi").dropDuplicates(["_fp"]).drop("_fp"))
