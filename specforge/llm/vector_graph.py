"""Embedding near-duplicates with a robust-pruned flat graph (operator 2).

Vectors of a label are dealt to their nearest cluster centers, several each, so
shards overlap.  In each shard every vector gets a short adjacency list, pruned so
that no neighbour is much closer to another one, with a few long edges.  Lists of a
vector from all its shards are united.  Then every vector searches its shards:
greedily from the shard's medoid, the nearest of fixed entry nodes and its own list,
then outwards through everything within the range.  Hits are verified by
the cosine in double precision, a hit counts only in the shard that is its nearest,
so none counts twice.  Recall is audited against
brute force for a fixed number of queries in every pass, over all links and per
query; while it is too low the search is repeated with more shards per vector.  Once
a vector has all shards of its label, labels of queries that still miss links are
repaired by blocked products, and logged; should the audit then differ, it fails.

Equal vectors are folded first and weigh in the counts.  A shard with too many
vectors is cut by hash; each vector searches all its cuts, so no cut is missed.
A shard returns counts and links that span its components, never all pairs.

Vectors that are null, empty, zero, or hold null or non-finite numbers, and rows
without a label, link with nothing: no links, a component of their own.  Vectors
of other lengths are not compared.  A null vec_id takes part; it names no
component and is never kept.  Repeated rows count as vectors of their own.
"""

from __future__ import annotations

import logging
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from specforge.llm.common import batch_of, column, stored
from specforge.llm.components import components, forest

THRESHOLD = 0.93
SAMPLE = 20_000      # vectors that the centers are fitted on
SHARD = 2_048        # vectors a center should have
CUT = 8_192          # vectors a shard may have before it is cut by hash
OVERLAP = 3          # centers of a vector at first
CANDIDATES = 48      # nearest vectors that pruning chooses from
DEGREE = 24          # neighbours kept
LONG = 8             # candidates for long edges, anywhere in the shard
ENTRIES = 64         # nodes where a search may enter
ENTER = 4            # nearest of them where it does
ALPHA = 1.2          # a neighbour goes if another is so many times closer to it
BEAM = 8             # best vectors a greedy search keeps
SLACK = 0.1          # below the threshold by so much, the range search still goes on
AUDITED = 400        # queries of the audit
RECALL = 0.99
QUERIES = 512        # searches run side by side
ROUNDING = 1e-9      # products so near the threshold are verified pair by pair


# --- in a shard -----------------------------------------------------------------------

def unit(vectors: np.ndarray) -> np.ndarray:
    v = vectors.astype(np.float64)
    v /= np.abs(v).max(1, keepdims=True)      # no overflow or underflow in the norm
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.einsum("kd,kd->k", a, b)


def within(q: np.ndarray, x: np.ndarray, threshold: float) -> np.ndarray:
    """Which pairs are within the range, as a matrix; decided like the search does."""
    sims = q @ x.T
    hit = sims >= threshold
    a, b = np.nonzero(np.abs(sims - threshold) < ROUNDING)
    hit[a, b] = cosines(q[a], x[b]) >= threshold
    return hit


def build(x: np.ndarray) -> list[np.ndarray]:
    """Pruned neighbours (positions) of every unit vector of a shard."""
    n = len(x)
    c = min(CANDIDATES, n - 1)
    if c <= 0:
        return [np.zeros(0, np.int64)] * n
    out: list[np.ndarray] = []
    far = np.random.default_rng(0).integers(0, n, (n, LONG))
    for at in range(0, n, 256):
        sims = x[at:at + 256] @ x.T
        rows = np.arange(len(sims))
        sims[rows, at + rows] = -2
        near = np.argpartition(-sims, c - 1, axis=1)[:, :c] if c < n - 1 else np.argsort(-sims, axis=1)[:, :c]
        near = np.take_along_axis(near, np.argsort(-np.take_along_axis(sims, near, 1), axis=1, kind="stable"), 1)
        long = far[at:at + 256]
        alive = np.concatenate([np.ones_like(near, dtype=bool),
                                (long != (at + rows)[:, None]) & ~(long[:, :, None] == near[:, None, :]).any(2)], 1)
        near = np.concatenate([near, long], 1)
        own = np.sqrt(np.maximum(0, 2 - 2 * np.take_along_axis(sims, near, 1)))
        among = np.sqrt(np.maximum(0, 2 - 2 * np.einsum("bcd,bed->bce", x[near], x[near])))
        kept = np.zeros_like(alive)
        for k in range(near.shape[1]):
            # A tight group fills the degree, so long edges have room of their own.
            take = alive[:, k] & ((kept.sum(1) < DEGREE) | (k >= c))
            kept[take, k] = True
            gone = ALPHA * among[:, k, :] <= own
            alive &= ~(gone & take[:, None])
        out += [near[r][kept[r]] for r in rows]
    return out


def _table(lists: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Adjacency with reverse links: neighbours of all nodes in a row, and their bounds."""
    n = len(lists)
    a = np.repeat(np.arange(n), [len(x) for x in lists])
    b = np.concatenate(lists) if n else np.zeros(0, np.int64)
    a, b = np.divmod(np.unique(np.concatenate([a * n + b, b * n + a])), max(1, n))
    return b, np.concatenate([[0], np.cumsum(np.bincount(a, minlength=n))])


class Search:
    """Range searches over a shard's graph, many queries side by side."""

    def __init__(self, x: np.ndarray, table: tuple[np.ndarray, np.ndarray]):
        self.x, (self.near, self.bounds) = x, table
        center = x.mean(0)
        self.medoid = int((x @ center).argmax())
        self.entries = np.random.default_rng(1).permutation(len(x))[:ENTRIES]

    def _visit(self, q: np.ndarray, seen: np.ndarray, row: np.ndarray, node: np.ndarray) -> tuple:
        """New (row, node) pairs and their cosines."""
        new = (node >= 0) & ~seen[row, node]
        row, node = np.divmod(np.unique(row[new] * len(self.x) + node[new]), len(self.x))
        seen[row, node] = True
        sims = np.empty(len(row))
        for at in range(0, len(row), 1 << 15):
            sims[at:at + (1 << 15)] = cosines(q[row[at:at + (1 << 15)]], self.x[node[at:at + (1 << 15)]])
        return row, node, sims

    def _expand(self, q: np.ndarray, seen: np.ndarray, row: np.ndarray, node: np.ndarray) -> tuple:
        """Visit the neighbours of (row, node) pairs."""
        size = self.bounds[node + 1] - self.bounds[node]
        first = self.bounds[node] - (np.cumsum(size) - size)
        return self._visit(q, seen, np.repeat(row, size), self.near[np.repeat(first, size) + np.arange(size.sum())])

    def __call__(self, q: np.ndarray, own: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
        """(query, node) of all hits; `own` is a query's node in the shard, or -1."""
        rows = np.arange(len(q))
        seen = np.zeros((len(q), len(self.x)), dtype=bool)
        enter = self.entries[np.argsort(-(q @ self.x[self.entries].T), axis=1, kind="stable")[:, :ENTER]]
        found = [self._visit(q, seen, np.concatenate([rows, rows, np.repeat(rows, enter.shape[1])]),
                             np.concatenate([np.full(len(q), self.medoid), own, enter.ravel()]))]
        beam_id = np.full((len(q), BEAM), -1)
        beam_sim = np.full((len(q), BEAM), -9.0)
        beam_done = np.ones((len(q), BEAM), dtype=bool)
        while True:
            row, node, sims = found[-1]
            if len(row):
                # The new ones of each query compete with its beam.
                order = np.lexsort((-sims, row))
                r, v, s = row[order], node[order], sims[order]
                place = np.arange(len(r)) - np.searchsorted(r, r)
                r, v, s, place = (z[place < BEAM] for z in (r, v, s, place))
                wide = lambda base, fill: np.concatenate([base, np.full_like(base, fill)], 1)
                ids, vals, done = wide(beam_id, -1), wide(beam_sim, -9.0), wide(beam_done, True)
                ids[r, BEAM + place], vals[r, BEAM + place], done[r, BEAM + place] = v, s, False
                best = np.argsort(-vals, axis=1, kind="stable")[:, :BEAM]
                beam_id, beam_sim, beam_done = (np.take_along_axis(z, best, 1) for z in (ids, vals, done))
            # The best four that have not been expanded.
            todo = ~beam_done & (np.cumsum(~beam_done, axis=1) <= 4)
            if not todo.any():
                break
            r, k = np.nonzero(todo)
            beam_done[r, k] = True
            found.append(self._expand(q, seen, r, beam_id[r, k]))
        row, node, sims = (np.concatenate([f[k] for f in found]) for k in range(3))
        hits = [(row[sims >= threshold], node[sims >= threshold])]
        row, node = row[sims >= threshold - SLACK], node[sims >= threshold - SLACK]
        while len(row):
            # Everything within the range is expanded, a slice at a time.
            new_row, new_node = [], []
            for at in range(0, len(row), 1 << 13):
                r, v, s = self._expand(q, seen, row[at:at + (1 << 13)], node[at:at + (1 << 13)])
                hits.append((r[s >= threshold], v[s >= threshold]))
                new_row.append(r[s >= threshold - SLACK])
                new_node.append(v[s >= threshold - SLACK])
            row, node = np.concatenate(new_row), np.concatenate(new_node)
        return np.concatenate([h[0] for h in hits]), np.concatenate([h[1] for h in hits])

    def whole(self, q: np.ndarray, own: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
        """The hits of a walk and those it did not reach: the repair."""
        row, node = self(q, own, threshold)
        left = within(q, self.x, threshold)
        left[row, node] = False
        more = np.nonzero(left)
        return np.concatenate([row, more[0]]), np.concatenate([node, more[1]])


# --- on Spark -------------------------------------------------------------------------

def usable(vector: Column, label: Column) -> Column:
    finite = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.coalesce(label.isNotNull() & finite & F.exists(vector, lambda v: v != 0), F.lit(False))


def distinct_vectors(rows: DataFrame) -> DataFrame:
    """label, vector, weight (rows that have it), least (smallest id), node (a number)."""
    return stored(rows.groupBy("label", "vector").agg(F.count("*").alias("weight"), F.min("vec_id").alias("least"))
                  .withColumn("node", F.monotonically_increasing_id()))


def centers(nodes: DataFrame, seed: int = 0) -> dict:
    """Unit centers by (label, length), for those that have more of them than a vector has shards.

    With no more than that every shard would hold all vectors, with the same lists in each, and
    every query would search them all; such a label is one shard.  Fitted by spherical k-means on
    a sample of fixed size, chosen by hash.
    """
    large = (nodes.groupBy("label", F.size("vector").alias("dim")).agg(F.count("*").alias("n"))
             .where(F.col("n") > SHARD * OVERLAP).orderBy(F.desc("n"), "label", "dim").limit(SAMPLE // 16))
    sample = (nodes.withColumn("dim", F.size("vector")).join(F.broadcast(large), ["label", "dim"])
              .orderBy(F.xxhash64("node"), "node").limit(SAMPLE).select(F.col("label").cast("string").alias("label"), "dim", "n", "vector")).toArrow()
    groups: dict = {}
    for label, dim, n, vector in zip(*(sample.column(k).to_pylist() for k in range(4)), strict=True):
        groups.setdefault((label, dim), (n, []))[1].append(vector)
    fitted = {}
    rng = np.random.default_rng(seed)
    for key, (n, vectors) in sorted(groups.items(), key=repr):
        x = unit(np.array(vectors))
        k = min(-(-n // SHARD), max(1, len(x) // 8))
        if k <= OVERLAP:
            continue
        c = x[rng.permutation(len(x))[:k]]
        for _ in range(6):
            near = (x @ c.T).argmax(1)
            sums = np.zeros_like(c)
            np.add.at(sums, near, x)
            size = np.linalg.norm(sums, axis=1, keepdims=True)
            c = np.where(size > 1e-9, sums / np.maximum(size, 1e-9), c)
        fitted[key] = c
    return fitted


DEALT = "label string, dim int, center int, home boolean, node bigint, weight bigint, vector array<double>"


def deal(nodes: DataFrame, fitted: dict, overlap: int) -> DataFrame:
    """Every vector (as a unit vector) once for each of its nearest centers; home at the nearest."""
    schema = pa.schema([("label", pa.string()), ("dim", pa.int32()), ("center", pa.int32()), ("home", pa.bool_()),
                        ("node", pa.int64()), ("weight", pa.int64()), ("vector", pa.list_(pa.float64()))])
    shared = nodes.sparkSession.sparkContext.broadcast(fitted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels, sizes = column(batch, "label").to_pylist(), column(batch, "dim").to_pylist()
            rows: dict = {}
            for k, key in enumerate(zip(labels, sizes, strict=True)):
                rows.setdefault(key, []).append(k)
            for (label, dim), at in rows.items():
                part = batch.take(pa.array(at))
                x = unit(np.array(column(part, "vector").flatten()).reshape(-1, dim))
                c = shared.value.get((label, dim))
                near = (np.zeros((len(x), 1), np.int64) if c is None
                        else np.argsort(-(x @ c.T), axis=1, kind="stable")[:, :overlap])
                for k in range(near.shape[1]):
                    yield batch_of(schema, [
                        [label] * len(x), [dim] * len(x), near[:, k].astype(np.int32), [k == 0] * len(x),
                        column(part, "node"), column(part, "weight"),
                        pa.ListArray.from_arrays(np.arange(0, x.size + 1, dim, dtype=np.int32), x.ravel())])

    return nodes.select(F.col("label").cast("string").alias("label"), F.size("vector").alias("dim"), "node",
                        "weight", "vector").mapInArrow(run, DEALT)


def _matrix(table: pa.Table) -> np.ndarray:
    flat = table.column("vector").combine_chunks().flatten().to_numpy()
    return flat.reshape(table.num_rows, -1)


def shard_lists(members: DataFrame) -> DataFrame:
    """node, near: pruned neighbours of every vector in each of its shards' cuts."""
    schema = pa.schema([("node", pa.int64()), ("near", pa.list_(pa.int64()))])

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("node")
        ids = group.column("node").to_numpy()
        return pa.table([group.column("node"), [ids[a] for a in build(_matrix(group))]], schema=schema)

    return members.groupBy("label", "dim", "center", "cut").applyInArrow(run, "node bigint, near array<bigint>")


def search(members: DataFrame, queries: DataFrame, threshold: float, repaired: frozenset = frozenset()) -> DataFrame:
    """Counts per query and shard (node, n), and links (u, v) that span the hits' components.

    Hits are those of the walk; in the labels (and lengths) of `repaired` also those it
    does not reach.  Queries of a cut come in slices of a bounded number, each beside the cut's members.
    """
    schema = pa.schema([("node", pa.int64()), ("n", pa.int64()), ("u", pa.int64()), ("v", pa.int64())])

    def run(key, own: pa.Table, asked: pa.Table) -> pa.Table:
        if own.num_rows == 0 or asked.num_rows == 0:
            return schema.empty_table()
        own, asked = own.sort_by("node"), asked.sort_by("node")
        ids, x = own.column("node").to_numpy(), _matrix(own)
        home, weight = own.column("home").to_numpy(), own.column("weight").to_numpy()
        near = own.column("near").combine_chunks()
        flat = near.flatten().to_numpy()
        at = np.searchsorted(ids, flat).clip(max=len(ids) - 1)
        inside = ids[at] == flat
        bounds = np.concatenate([[0], np.cumsum(inside)])[near.offsets.to_numpy() - near.offsets[0].as_py()]
        walk = Search(x, _table(np.split(at[inside], bounds[1:-1])))
        wanted, q = asked.column("node").to_numpy(), _matrix(asked)
        place = np.searchsorted(ids, wanted).clip(max=len(ids) - 1)
        place = np.where(ids[place] == wanted, place, -1)
        find = walk.whole if (key[0].as_py(), key[1].as_py()) in repaired else walk
        counts, left, right = [], [], []
        for a in range(0, len(wanted), QUERIES):
            r, v = find(q[a:a + QUERIES], place[a:a + QUERIES], threshold)
            other = wanted[a + r] != ids[v]
            r, v = r[other], v[other]
            counts.append(np.bincount(r[home[v]], weight[v][home[v]], minlength=len(q[a:a + QUERIES])))
            some = forest(wanted[a + r], ids[v])
            left.append(some[0])
            right.append(some[1])
        n = np.concatenate(counts).astype(np.int64)
        u, v = forest(np.concatenate(left), np.concatenate(right))
        hit = np.flatnonzero(n)
        none = pa.nulls(len(u), pa.int64())
        return pa.concat_tables([
            pa.table([wanted[hit], n[hit], pa.nulls(len(hit), pa.int64()), pa.nulls(len(hit), pa.int64())], schema=schema),
            pa.table([none, none, u, v], schema=schema)])

    key = ["label", "dim", "center", "cut", "slice"]
    return (members.groupBy(*key).cogroup(queries.groupBy(*key))
            .applyInArrow(run, "node bigint, n bigint, u bigint, v bigint"))


def tally(nodes: DataFrame, counts: DataFrame, threshold: float) -> list[tuple]:
    """(label, length, true links, links found) of those of a fixed number of vectors,
    chosen by hash, that have links; the true ones by brute force over all vectors."""
    nodes = nodes.withColumn("label", F.col("label").cast("string"))
    asked = nodes.orderBy(F.xxhash64("node", F.lit(7)), "node").limit(AUDITED).select("node", "label", "vector").collect()
    groups: dict = {}
    for r in asked:
        groups.setdefault((r.label, len(r.vector)), []).append(r)
    shared = nodes.sparkSession.sparkContext.broadcast(
        {k: (np.array([r.node for r in v]), unit(np.array([r.vector for r in v]))) for k, v in groups.items()})
    schema = pa.schema([("node", pa.int64()), ("n", pa.int64())])

    def run(batches):
        total = {k: np.zeros(len(ids), np.int64) for k, (ids, _) in shared.value.items()}
        for batch in batches:
            rows: dict = {}
            for k, key in enumerate(zip(column(batch, "label").to_pylist(), column(batch, "dim").to_pylist(), strict=True)):
                rows.setdefault(key, []).append(k)
            for key, at in rows.items():
                if key in shared.value:
                    ids, q = shared.value[key]
                    part = batch.take(pa.array(at))
                    x = unit(np.array(column(part, "vector").flatten()).reshape(-1, key[1]))
                    hit = within(q, x, threshold) & (ids[:, None] != column(part, "node").to_numpy()[None, :])
                    total[key] += hit @ column(part, "weight").to_numpy()
        for key, n in total.items():
            yield batch_of(schema, [shared.value[key][0][n > 0], n[n > 0]])

    true = dict(nodes.withColumn("dim", F.size("vector")).mapInArrow(run, "node bigint, n bigint")
                .groupBy("node").agg(F.sum("n").alias("n")).collect())
    ids = nodes.sparkSession.createDataFrame([(r.node,) for r in asked] or [(-1,)], "node bigint")
    found = dict(counts.join(F.broadcast(ids), "node", "left_semi").select("node", "n").collect())
    return [(*key, true[k], found.get(k, 0)) for key, (ids, _) in shared.value.items() for k in ids.tolist() if k in true]


def audit(nodes: DataFrame, counts: DataFrame, threshold: float) -> float:
    """The least of three shares for the vectors of `tally`: true links that were
    found, the mean of that share per vector, vectors that miss none."""
    rows = tally(nodes, counts, threshold)
    if not rows:
        return 1.0
    shares = [found / n for *_, n, found in rows]
    links = sum(found for *_, found in rows) / sum(n for *_, n, _ in rows)
    return min(links, sum(shares) / len(shares), sum(x >= 1 for x in shares) / len(shares))


def cluster(df: DataFrame, threshold: float = THRESHOLD, vec: str = "vec_id", vector: str = "embedding",
            label: str = "label") -> DataFrame:
    """vec_id, n_links, component_id, kept for every row."""
    rows = df.select(F.col(vec).alias("vec_id"), F.col(label).alias("label"), F.col(vector).alias("vector"),
                     usable(F.col(vector), F.col(label)).alias("usable"))
    good = rows.where("usable").drop("usable")
    nodes = distinct_vectors(good)
    fitted = centers(nodes)
    most = max((len(c) for c in fitted.values()), default=1)
    overlap, repaired = min(OVERLAP, most), frozenset()
    while True:
        dealt = stored(deal(nodes, fitted, overlap))
        shard = ["label", "dim", "center"]
        # A shard's members by cuts, its queries by slices; both pairings meet once.
        sizes = dealt.groupBy(*shard).agg(F.count("*").alias("size"))
        cuts = F.ceil(F.col("size") / CUT).cast("int")
        sized = dealt.join(sizes, shard).withColumn("cuts", cuts).drop("size")
        part = F.pmod(F.xxhash64("node"), F.col("cuts")).cast("int")
        members = stored(sized.withColumn("cut", part))
        lists = (shard_lists(members).groupBy("node")
                 .agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near")))
        every = F.explode(F.sequence(F.lit(0), F.col("cuts") - 1))
        stores = members.join(lists, "node").withColumn("slice", every)
        asks = members.select(*shard, "node", "vector", "cuts", F.col("cut").alias("slice")).withColumn("cut", every)
        found = stored(search(stores, asks.toDF(*asks.columns), threshold, repaired))
        counts = found.where("node is not null").groupBy("node").agg(F.sum("n").alias("n"))
        recall = audit(nodes, counts, threshold)
        if recall >= RECALL:
            break
        if overlap < most:
            overlap = min(most, 2 * overlap)
            continue
        # Every vector has searched all shards of its label, so the walks missed something.
        short = {(label, dim) for label, dim, n, hits in tally(nodes, counts, threshold) if hits < n} - repaired
        if not short:
            raise RuntimeError(f"recall {recall:.4f} of {RECALL} with every shard searched")
        logging.getLogger(__name__).warning("recall %.4f: %d labels repaired by products", recall, len(short))
        repaired |= short
    label_of = components(found.where("u is not null").select("u", "v"))
    named = (nodes.join(label_of, "node", "left").join(counts, "node", "left")
             .select("label", "vector", "node", "least", (F.col("weight") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"),
                     F.coalesce("component", "node").alias("component")))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    named = stored(named.join(least, "component").select("label", "vector", "n_links", "component_id"))
    linked = good.join(named, ["label", "vector"]).select("vec_id", "n_links", "component_id")
    alone = rows.where(~F.col("usable")).select(
        "vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionAll(alone).withColumn(
        "kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
