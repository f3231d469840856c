"""Alignment of two tokenizers by byte ranges (operator 12).

Texts are cut before blanks that follow a visible character: no token of either
tokenizer spans such a border, so a segment that a batch holds often is encoded and
aligned at its first occurrence and its result is used for all.  Tokens carry their
document and byte offsets; `merge_asof`, keyed by document, finds for each token
start the token of the other side that covers it.  The union of both directions are
the overlapping pairs; pairs with equal ends close a group.

Linked id pairs are counted over all documents.  Frequent pairs, a bounded number, go
to the tasks as a table; the others are joined by a shuffle, so none is left out.

Null, empty texts and texts whose bytes a tokenizer does not give back (for example
those with U+2581) have no tokens: zeros and ''.  Repeated rows count as documents of
their own, also without an id.  An empty table gives no rows.  Only the id and the
text are read.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from specforge.llm.common import batch_of, chunks, column, stored, strings

CHUNK_BYTES = 8 << 20     # text handled at once
JOINED = 512              # segments given to a tokenizer as one text
HEAD = 1 << 19            # pairs that every task knows
B_BITS = 15               # ids of B are below 2**B_BITS

# A blank that follows a visible character and is followed by one that is no blank.
BLANK = r"\x00-\x20\x{7F}\x{85}\p{Z}"
ODD = rf"^ | $|[{BLANK}] "
CUT = regex.compile(r"(?<=[^\x00-\x20\x7F\x85\p{Z}])(?= [^ ])")


# --- the tokenizers -------------------------------------------------------------------

def byte_letters() -> dict[str, int]:
    """Byte-level vocabularies write a byte as a printable letter: itself where it is one, else a letter from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in plain]
    return {chr(c): b for b, c in zip(plain + other, plain + [256 + k for k in range(len(other))], strict=True)}


class Bpe:
    """Side A: space and text by a byte-level tokenizer file."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        letters = byte_letters()
        with open(path, encoding="utf-8") as f:
            vocabulary = json.load(f)["model"]["vocab"]
        self.bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.bytes[i] = bytes(letters[c] for c in token)

        self.names = pa.array([str(i) for i in range(len(self.bytes))], type=pa.large_string())

    def __call__(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)]


class Pieces:
    """Side B: the text by a sentencepiece model that puts a blank before it."""

    def __init__(self, path: str):
        import sentencepiece
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bytes = []
        for i in range(self.model.get_piece_size()):
            piece = self.model.id_to_piece(i)
            self.bytes.append(bytes([int(piece[3:5], 16)]) if self.model.is_byte(i)
                              else piece.replace("▁", " ").encode())
        for piece in (self.model.id_to_piece(i) for i in range(self.model.get_piece_size())):
            if "▁" in piece.lstrip("▁"):
                raise ValueError("a piece has a blank inside, so texts cannot be cut at blanks")
        self.names = pa.array([str(i) for i in range(len(self.bytes))], type=pa.large_string())

    def __call__(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


def encoded(side, segments: pa.Array, joins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids of all segments in a row, how many each has, and whether its bytes come back.

    `segments` come without their leading blank.  Those that may stand side by side
    (`joins`) go to the tokenizer many at once and are told apart by their bytes.
    """
    lengths = np.array([len(b) for b in side.bytes], dtype=np.int64)
    bytes_of = side.bytes.__getitem__
    texts = segments.to_pylist()
    size = pc.binary_length(segments).to_numpy(zero_copy_only=False).astype(np.int64) + 1
    n = np.zeros(len(texts), np.int64)
    same = np.ones(len(texts), dtype=bool)
    order, parts = [], []          # segments in the order of their ids
    alone = [np.flatnonzero(~joins)]
    rows = np.flatnonzero(joins)
    groups = [rows[k:k + JOINED] for k in range(0, len(rows), JOINED)]
    whole = [" ".join([texts[k] for k in g]) for g in groups]
    for group, text, got in zip(groups, whole, side(whole), strict=True):
        ids = np.array(got, dtype=np.int64)
        ends, want = np.cumsum(lengths[ids]), np.cumsum(size[group])
        cut = np.searchsorted(ends, want) + 1
        if len(ends) and ends[-1] == want[-1] and (ends[cut - 1] == want).all() and b"".join(map(bytes_of, got)) == b" " + text.encode():
            n[group] = np.diff(cut, prepend=0)
            order.append(group)
            parts.append(ids)
        else:
            alone.append(group)
    rest = np.concatenate(alone)
    for at in range(0, len(rest), JOINED):
        group = rest[at:at + JOINED]
        for k, got in zip(group.tolist(), side([texts[k] for k in group]), strict=True):
            n[k] = len(got)
            same[k] = b"".join(map(bytes_of, got)) == b" " + texts[k].encode()
            parts.append(np.array(got, dtype=np.int64))
    order = np.concatenate([*order, rest])
    start = np.zeros(len(texts), np.int64)
    start[order] = np.cumsum(n[order]) - n[order]
    ids = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    return ids[ranges(start, n)], n, same


# --- alignment ------------------------------------------------------------------------

def overlaps(a: pd.DataFrame, b: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Positions of overlapping tokens.  Frames of (doc, start), ascending in start."""
    a, b = a.assign(a=np.arange(len(a))), b.assign(b=np.arange(len(b)))
    down = pd.merge_asof(a, b, on="start", by="doc")
    up = pd.merge_asof(b, a, on="start", by="doc")
    pairs = pd.concat([down[["a", "b"]], up[["a", "b"]]]).dropna().drop_duplicates()
    return pairs["a"].to_numpy(np.int64), pairs["b"].to_numpy(np.int64)


def groups(a: pd.DataFrame, b: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The group of every token of both sides, and the common ends that close the groups.

    Frames of (doc, start, end) with offsets that ascend over documents.
    """
    i, j = overlaps(a[["doc", "start"]], b[["doc", "start"]])
    ends_a, ends_b = a["end"].to_numpy(), b["end"].to_numpy()
    ends = np.unique(ends_a[i][ends_a[i] == ends_b[j]])
    return np.searchsorted(ends, ends_a), np.searchsorted(ends, ends_b), ends


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Positions of ranges laid in a row."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)


class Segments:
    """The texts of a batch as segments: `codes` of all in a row, `first` of every text, the distinct ones."""

    def __init__(self, texts: pa.Array):
        odd = pc.match_substring_regex(texts, ODD).to_numpy(zero_copy_only=False).astype(bool)
        split = pc.split_pattern(texts, " ")
        if odd.any():
            rows = [[p[1:] for p in CUT.split(" " + t.as_py())] if o else s
                    for o, s, t in zip(odd, split, texts, strict=True)]
            split = pa.array([r if isinstance(r, list) else r.as_py() for r in rows], type=pa.list_(pa.string()))
        coded = pc.dictionary_encode(split.flatten())
        self.codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.first = split.offsets.to_numpy(zero_copy_only=False) - split.offsets[0].as_py()
        self.distinct = coded.dictionary
        # Such segments may stand side by side: neither border is other than in a text.
        plain = pc.match_substring_regex(self.distinct, rf"^[^{BLANK}](?:.|\n)*[^{BLANK}]$|^[^{BLANK}]$")
        self.joins = plain.to_numpy(zero_copy_only=False).astype(bool)


class Aligned:
    """What a batch's distinct segments give: tokens, groups, linked pairs."""

    def __init__(self, a, b, segments: Segments):
        ids_a, self.n_a, same_a = encoded(a, segments.distinct, segments.joins)
        ids_b, self.n_b, same_b = encoded(b, segments.distinct, segments.joins)
        self.same = same_a & same_b
        # Both sides are laid out at the first occurrence of each segment; the others have no tokens.
        size = pc.binary_length(segments.distinct).to_numpy(zero_copy_only=False).astype(np.int64) + 1
        ends = np.cumsum(size[segments.codes])
        _, place = np.unique(segments.codes, return_index=True)
        doc = np.searchsorted(segments.first, place, "right") - 1
        start = ends[place] - size[segments.codes[place]]
        usable = self.same

        def frame(side, ids, n):
            of = np.repeat(np.arange(len(n)), n)
            length = np.array([len(x) for x in side.bytes], dtype=np.int64)[ids]
            before = np.cumsum(length) - length
            of_segment = np.bincount(of, length, len(n)).astype(np.int64)
            begin = np.cumsum(of_segment) - of_segment
            at = start[of] + before - begin[of]
            kept = usable[of]
            return pd.DataFrame({"doc": doc[of], "start": at, "end": at + length, "of": of, "id": ids})[kept]

        left, right = frame(a, ids_a, self.n_a), frame(b, ids_b, self.n_b)
        group_a, group_b, closed = groups(left, right)
        count = len(closed)
        in_a, in_b = np.bincount(group_a, minlength=count), np.bincount(group_b, minlength=count)
        first_a, first_b = np.cumsum(in_a) - in_a, np.cumsum(in_b) - in_b
        id_a, id_b = left["id"].to_numpy(), right["id"].to_numpy()
        segment = left["of"].to_numpy()[first_a] if count else np.zeros(0, np.int64)
        self.n_groups = np.bincount(segment, minlength=len(self.same))
        self.n_links = np.bincount(segment, in_a * in_b, len(self.same)).astype(np.int64)
        # All pairs of a group: each of its A tokens beside each of its B tokens.
        each_a = np.repeat(in_b, in_a)
        self.pairs = (np.repeat(id_a, each_a) << B_BITS) | id_b[ranges(np.repeat(first_b, in_a), each_a)]
        lines = pc.binary_join_element_wise(joined(a.names.take(pa.array(id_a)), in_a, ","),
                                            joined(b.names.take(pa.array(id_b)), in_b, ","), pa.scalar("|", pa.large_string()))
        self.lines = joined(lines, self.n_groups, ";")


def joined(values: pa.Array, sizes: np.ndarray, separator: str) -> pa.Array:
    """Strings in a row, joined in groups of the given sizes."""
    offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64))
    return pc.binary_join(pa.LargeListArray.from_arrays(offsets, values), pa.scalar(separator, values.type))


DIGEST = pa.schema([("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()),
                    ("n_links", pa.int64()), ("groups_sha256", pa.string()), ("pairs", pa.binary()), ("times", pa.binary())])
DIGEST_DDL = ("doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, "
              "pairs binary, times binary")


def _rows(a, b, docs: pa.Array, texts: pa.Array) -> pa.RecordBatch:
    """A row per text: counts, the digest of its groups, its distinct pairs and how often it has each."""
    segments = Segments(texts)
    found = Aligned(a, b, segments)
    n = len(texts)
    doc = np.repeat(np.arange(n), np.diff(segments.first))
    good = np.ones(n, dtype=bool)
    good[doc[~found.same[segments.codes]]] = False
    good &= pc.binary_length(texts).to_numpy(zero_copy_only=False) > 0
    kept = good[doc]
    doc, codes = doc[kept], segments.codes[kept]
    sums = [np.bincount(doc, x[codes], n).astype(np.int64) for x in (found.n_a, found.n_b, found.n_groups, found.n_links)]
    lines = joined(found.lines.take(pa.array(codes)), np.bincount(doc, minlength=n), ";")
    digests = [hashlib.sha256(line.as_buffer()).hexdigest() if ok else "" for ok, line in zip(good.tolist(), lines, strict=True)]
    first = np.cumsum(found.n_links) - found.n_links
    size = found.n_links[codes]
    key = (np.repeat(doc, size) << 32) | found.pairs[ranges(first[codes], size)]
    key, times = np.unique(key, return_counts=True)
    bounds = np.searchsorted(key, np.arange(n + 1) << 32).tolist()
    pairs, times = (key & 0xFFFFFFFF).astype("<i4"), times.astype("<i4")
    return batch_of(DIGEST, [docs, *sums, digests, [pairs[x:y].tobytes() for x, y in zip(bounds[:-1], bounds[1:], strict=True)],
                             [times[x:y].tobytes() for x, y in zip(bounds[:-1], bounds[1:], strict=True)]])


def digests(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """The rows of `_rows` for a frame of doc_id and text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = Bpe(path_a), Pieces(path_b)
        if len(b.bytes) > 1 << B_BITS:
            raise ValueError(f"more than {1 << B_BITS} pieces")
        for batch in batches:
            texts, ids = strings(batch, "text"), column(batch, "doc_id")
            for x, y in chunks(texts, CHUNK_BYTES):
                yield _rows(a, b, ids.slice(x, y - x), texts.slice(x, y - x))

    return docs.mapInArrow(run, DIGEST_DDL)


# --- counts over all documents --------------------------------------------------------

def pair_counts(rows: DataFrame) -> DataFrame:
    """pair, docs (documents that hold it), best (no other pair of its A id is in more)."""
    schema = pa.schema([("pair", pa.int64()), ("docs", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            got, n = np.unique(np.frombuffer(b"".join(column(batch, "pairs").to_pylist()), "<i4"), return_counts=True)
            keys, at = np.unique(np.concatenate([keys, got.astype(np.int64)]), return_inverse=True)
            counts = np.bincount(at, np.concatenate([counts, n]), len(keys)).astype(np.int64)
        yield batch_of(schema, [keys, counts])

    counts = stored(rows.select("pairs").mapInArrow(run, "pair bigint, docs bigint")
                    .groupBy("pair").agg(F.sum("docs").alias("docs")).withColumn("a", F.shiftright("pair", B_BITS)))
    most = counts.groupBy("a").agg(F.max("docs").alias("most"))     # one row per entry of A's vocabulary
    return counts.join(most, "a").select("pair", "docs", (F.col("docs") == F.col("most")).alias("best"))


def head_of(counts: DataFrame, most: int) -> tuple[int, pa.Table]:
    """The least power of two that at most so many pairs reach, and these pairs by number."""
    level = F.floor(F.log2("docs")).cast("int")
    sizes = dict(counts.groupBy(level.alias("level")).agg(F.count("*").alias("n")).collect())
    power, total = max(sizes, default=0) + 1, 0
    while power > 0 and total + sizes.get(power - 1, 0) <= most:
        power -= 1
        total += sizes.get(power, 0)
    return 1 << power, counts.where(F.col("docs") >= 1 << power).orderBy("pair").toArrow()


def scores(rows: DataFrame, counts: DataFrame, head: int = HEAD) -> DataFrame:
    """row, n_best, count_sum: sums over a document's links, in parts that add up."""
    least, known = head_of(counts, head)
    shared = rows.sparkSession.sparkContext.broadcast(
        (known.column("pair").to_numpy(), known.column("docs").to_numpy(), known.column("best").to_numpy(zero_copy_only=False)))

    def found(batch: pa.RecordBatch) -> tuple:
        """Rows, pairs, times of a batch, and which pairs the head has at which place."""
        pairs = column(batch, "pairs").to_pylist()
        pair = np.frombuffer(b"".join(pairs), "<i4").astype(np.int64)
        times = np.frombuffer(b"".join(column(batch, "times").to_pylist()), "<i4").astype(np.int64)
        of = np.repeat(np.arange(len(pairs)), [len(p) // 4 for p in pairs])
        keys = shared.value[0]
        at = np.searchsorted(keys, pair).clip(max=max(0, len(keys) - 1))
        return of, pair, times, at, keys[at] == pair if len(keys) else np.zeros(len(pair), bool)

    def frequent(batches):
        _, docs, best = shared.value
        for batch in batches:
            of, _, times, at, hit = found(batch)
            of, times, at, n = of[hit], times[hit], at[hit], batch.num_rows
            total = np.zeros(n, np.int64)
            np.add.at(total, of, times * docs[at])
            yield pa.record_batch([column(batch, "row"), pa.array(np.bincount(of, times * best[at], n).astype(np.int64)), pa.array(total)],
                                  names=["row", "n_best", "count_sum"])

    def rare(batches):
        for batch in batches:
            of, pair, times, _, hit = found(batch)
            yield pa.record_batch([column(batch, "row").take(pa.array(of[~hit])), pa.array(pair[~hit]), pa.array(times[~hit])],
                                  names=["row", "pair", "times"])

    source = rows.select("row", "pairs", "times")
    rest = (source.mapInArrow(rare, "row bigint, pair bigint, times bigint").join(counts.where(F.col("docs") < least), "pair")
            .select("row", (F.col("times") * F.col("best").cast("bigint")).alias("n_best"), (F.col("times") * F.col("docs")).alias("count_sum")))
    return (source.mapInArrow(frequent, "row bigint, n_best bigint, count_sum bigint").unionAll(rest)
            .groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum")))


def align(df: DataFrame, path_a: str, path_b: str, doc: str = "doc_id", text: str = "text", head: int = HEAD) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 for every row."""
    docs = df.select(F.col(doc).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
    rows = stored(digests(docs, path_a, path_b).withColumn("row", F.monotonically_increasing_id()))
    counts = stored(pair_counts(rows))
    return rows.drop("pairs", "times").join(scores(rows, counts, head), "row").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
