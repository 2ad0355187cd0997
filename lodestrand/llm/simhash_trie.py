"""Near-duplicates by SimHash: a binary trie of fingerprints joined with itself."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bits import bit_sums, packed
from .common import HOT_SHARE, bytes_of, join_split, own_names, small_runs, stored, text_of
from .components import components

SHINGLE = 4
SEED = 42
RADIUS = 4
#: Fingerprints in one cell of the trie's top, at least and at most.
CELL = (1 << 15, 1 << 20)
#: A node of this many fingerprints or fewer is compared outright.
LEAF = 8
#: Node pairs that a task holds at a time.
FRONTIER = 1 << 17


def _shingle_hashes(text: bytes, width: int) -> list[int]:
    """XXH64 of each run of ``width`` words; of the whole sequence if it is shorter; none without words."""
    words = text.lower().split()  # of bytes: A-Z alone, and the six ASCII spaces
    if not words:
        return []
    data = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    width = min(width, len(words))
    starts = np.concatenate([[0], ends[:-1] + 1])[: len(words) - width + 1]
    digest = xxhash.xxh64_intdigest
    return [digest(data[a:b], SEED) for a, b in zip(starts.tolist(), ends[width - 1 :].tolist(), strict=True)]


def fingerprints_of(texts: list[bytes], width: int = SHINGLE) -> np.ndarray:
    """The 64-bit SimHash of each text: a bit is set if it is in over half the hashes."""
    out = np.zeros(len(texts), np.uint64)
    for a, b in small_runs(texts):
        hashes = [_shingle_hashes(t, width) for t in texts[a:b]]
        counts = np.fromiter(map(len, hashes), np.int64, b - a)
        flat = np.fromiter((h for hs in hashes for h in hs), np.uint64, int(counts.sum()))
        sums = bit_sums(flat, np.repeat(np.arange(b - a), counts), b - a)
        out[a:b] = packed(2 * sums > counts[:, None])
    return out


@F.arrow_udf(T.LongType())
def simhash(texts: pa.Array) -> pa.Array:
    return pa.array(fingerprints_of(bytes_of(texts)).view(np.int64))


# The trie


def _split(keys: np.ndarray, low: np.ndarray, high: np.ndarray, bit: int) -> np.ndarray:
    """Where the keys with the bit set begin, in each range of keys that agree above it."""
    one = np.uint64(1) << np.uint64(bit)
    prefix = keys[low] & ~(one | (one - np.uint64(1)))
    return np.clip(np.searchsorted(keys, prefix | one), low, high)


def _block(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The positions of small ranges as rows of equal width; the last position fills up."""
    width = int((high - low).max())
    return np.minimum(low[:, None] + np.arange(width), (high - 1)[:, None])


def near_pairs(a: np.ndarray, b: np.ndarray | None, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions (i in a, j in b) of keys that differ in ``radius`` bits or fewer, in portions.

    a, b: sorted distinct uint64; b None joins a with itself (i < j). Node pairs go down
    the trie together, one bit at a time, each with the bits it may still differ in; a
    pair without any left is pruned unless both sides take the same branch. The walk is
    depth first in portions, so memory does not grow with the number of pairs.
    """
    same, b = b is None, a if b is None else b
    if not len(a) or not len(b):
        return
    zero, all_a, all_b = np.zeros(1, np.int64), np.array([len(a)]), np.array([len(b)])
    stack = [(63, zero, all_a, zero, all_b, np.array([radius]))]
    while stack:
        bit, al, ah, bl, bh, left = stack.pop()
        small = ((ah - al <= LEAF) & (bh - bl <= LEAF)) if bit >= 0 else np.ones(len(al), bool)
        for k in range(0, int(small.sum()), 1 << 13):
            pick = np.flatnonzero(small)[k : k + (1 << 13)]
            i, j = _block(al[pick], ah[pick]), _block(bl[pick], bh[pick])
            near = np.bitwise_count(a[i][:, :, None] ^ b[j][:, None, :]) <= radius
            p, x, y = np.nonzero(near)
            i, j = i[p, x], j[p, y]
            yield (i[i < j], j[i < j]) if same else (i, j)
        deep = ~small
        if not deep.any():
            continue
        al, ah, bl, bh, left = al[deep], ah[deep], bl[deep], bh[deep], left[deep]
        am, bm = _split(a, al, ah, bit), _split(b, bl, bh, bit)
        own = same & (al == bl)
        branches = [(al, am, bl, bm, left), (am, ah, bm, bh, left), (al, am, bm, bh, left - 1), (am, ah, bl, bm, left - 1)]
        keep = [(x[1] > x[0]) & (x[3] > x[2]) & (x[4] >= 0) & (~own if k == 3 else True) for k, x in enumerate(branches)]
        down = [np.concatenate([x[c][m] for x, m in zip(branches, keep, strict=True)]) for c in range(5)]
        for k in range(0, len(down[0]), FRONTIER):
            stack.append((bit - 1, *(c[k : k + FRONTIER] for c in down)))


class Forest:
    """Union of pairs of positions; keeps one label each, not the pairs."""

    def __init__(self, size: int) -> None:
        self.label = np.arange(size)
        self.wait: list[tuple[np.ndarray, np.ndarray]] = []
        self.waiting = 0

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        differ = self.label[i] != self.label[j]
        self.wait.append((i[differ], j[differ]))
        self.waiting += int(differ.sum())
        if self.waiting > 1 << 20:
            self.merge()

    def merge(self) -> np.ndarray:
        i, j = (np.concatenate(x) for x in zip(*self.wait, strict=True)) if self.wait else (np.zeros(0, np.int64),) * 2
        self.wait, self.waiting = [], 0
        while len(i):
            x, y = self.label[i], self.label[j]
            differ = x != y
            i, j, x, y = i[differ], j[differ], x[differ], y[differ]
            self.label[np.maximum(x, y)] = np.minimum(x, y)
            while (up := self.label[self.label]).tobytes() != self.label.tobytes():
                self.label = up
        return self.label


def _linked(left: np.ndarray, right: np.ndarray | None, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """The links among the keys of two cells (or within one), thinned to a star for each group."""
    keys = left if right is None else np.concatenate([left, right])
    forest = Forest(len(keys))
    for i, j in near_pairs(left, right, radius):
        forest.add(i, j if right is None else j + len(left))
    label = forest.merge()
    tied = np.flatnonzero(label != np.arange(len(keys)))
    return keys[tied].view(np.int64), keys[label[tied]].view(np.int64)


def _cell(table: pa.Table) -> pa.Table:
    keys = np.sort(table["fp"].to_numpy().view(np.uint64))
    return pa.table({"node": table["node"][:1], "chunk": table["chunk"][:1], "keys": pa.array([keys.astype("<u8").tobytes()], pa.binary())})


def _join_cells(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                left = np.frombuffer(batch.column(0)[row].as_py(), "<u8")
                other = batch.column(1)[row].as_py()
                u, v = _linked(left, None if other is None else np.frombuffer(other, "<u8"), radius)
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    return run


def links(distinct: DataFrame, radius: int = RADIUS, cell_size: int | None = None) -> DataFrame:
    """(u, v): links that connect exactly the fingerprints (column fp) within ``radius`` bits of each other.

    The top of the trie is cut into cells: the prefixes of p bits, a crowded one in
    several chunks. Pairs of cells whose prefixes differ in ``radius`` bits or fewer
    are joined, each in a task of its own, and each reports a star for each group it
    finds rather than all its pairs.
    """
    count = distinct.count()
    size = cell_size or min(max(count // 64, CELL[0]), CELL[1])
    p = min(16, max(0, math.ceil(math.log2(max(1, count / size)))))
    node = F.shiftrightunsigned("fp", 64 - p).cast("int") if p else F.lit(0)
    placed = distinct.select("fp", node.alias("node"))
    chunks = placed.groupBy("node").agg(F.ceil(F.count("*") / (2 * size)).alias("chunks"))  # 2^p rows at most
    dealt = placed.join(F.broadcast(chunks), "node").select("fp", "node", F.pmod(F.xxhash64("fp"), "chunks").cast("int").alias("chunk"))
    cells = stored(dealt.groupBy("node", "chunk").applyInArrow(_cell, "node int, chunk int, keys binary"), "cells")
    masks = [m for m in range(1 << p) if m.bit_count() <= radius]
    ends = cells.select("node", "chunk")
    other = ends.select(F.col("node").alias("node2"), F.col("chunk").alias("chunk2"))
    near = ends.withColumn("mask", F.explode(F.lit(masks))).withColumn("node2", F.col("node").bitwiseXOR(F.col("mask"))).drop("mask")
    pairs = near.join(other, "node2").where("struct(node, chunk) <= struct(node2, chunk2)")
    left = pairs.join(cells.withColumnRenamed("keys", "left_keys"), ["node", "chunk"])
    both = left.join(cells.select(F.col("node").alias("node2"), F.col("chunk").alias("chunk2"), F.col("keys").alias("right_keys")), ["node2", "chunk2"])
    own = (F.col("node") == F.col("node2")) & (F.col("chunk") == F.col("chunk2"))
    work = both.select("left_keys", F.when(~own, F.col("right_keys")).alias("right_keys"))
    tasks = min(4096, max(1, len(masks) * max(1, count // size) // 2))
    return work.repartition(tasks).mapInArrow(_join_cells(radius), "u long, v long")


def near_duplicates(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", radius: int = RADIUS, cell_size: int | None = None) -> DataFrame:
    """Every row's fingerprint and the smallest doc_id it is linked to.

    Returns doc_id, text_hash (xxhash64 of the text, which tells apart the texts of a
    repeated doc_id), fp, root (the component's smallest fingerprint) and component_id.

    Fingerprints: SimHash over XXH64 of 4-word shingles of the whole text, A-Z in lower
    case. Texts whose fingerprints differ in ``radius`` bits or fewer are linked;
    component_id is the smallest doc_id reachable over links, the row's own included.
    Copies share a fingerprint, so a group of copies is one key in the join; groups of
    near copies are reported as stars.

    Nulls: a null text counts as empty. Texts without words have fingerprint zero and
    link like any other. A null doc_id stays null and never is a component's name,
    unless all its members are null. Repeated rows get equal results. An empty table
    gives no rows. Other columns are ignored.
    """
    text = text_of(text_column)
    rows = stored(documents.select(F.col(id_column).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), simhash(text).alias("fp")), "fingerprints")
    distinct = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies")), "distinct-fingerprints")
    root = components(links(distinct.select("fp"), radius, cell_size)).select(F.col("node").alias("fp"), "root")
    joined = distinct.join(root, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    joined = stored(joined, "roots")
    total = joined.agg(F.count("*"), F.sum("copies")).first()
    names = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    named = stored(join_split(joined, names, "root", total[0]).select("fp", "copies", "root", "component_id"), "components")
    limit = max(1, math.ceil((total[1] or 0) / HOT_SHARE))  # more copies have fewer than HOT_SHARE fingerprints
    hot = F.broadcast(named.where(F.col("copies") > limit).drop("copies"))
    cold = named.where(F.col("copies") <= limit).drop("copies")
    told = rows.join(hot, "fp").unionByName(rows.join(hot, "fp", "left_anti").join(cold, "fp"))
    return told.select("doc_id", "text_hash", "fp", "root", "component_id")


def first_of_each(documents: DataFrame, found: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """The rows of ``documents`` that are the first of a root of ``found`` (doc_id, text_hash, root); all columns."""
    absent, key = F.lit(-(2**63)), own_names(documents, "_row_id", "_row_hash")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")).alias("first")
    kept = found.groupBy("root").agg(first).select(F.coalesce("first.doc_id", absent).alias(key[0]), F.col("first.text_hash").alias(key[1]))
    keyed = documents.withColumns({key[0]: F.coalesce(F.col(id_column).cast("long"), absent), key[1]: F.xxhash64(text_of(text_column))})
    return keyed.join(kept, key, "left_semi").dropDuplicates(key).drop(*key)


def keep_one(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", radius: int = RADIUS) -> DataFrame:
    """The rows of ``documents`` that stay when each component keeps one; all columns.

    The smallest doc_id stays, a null only where its component has no other; of several
    texts under that id the one with the smallest hash. Repeated rows become one.
    """
    return first_of_each(documents, near_duplicates(documents, id_column, text_column, radius), id_column, text_column)


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract of op2: each document's fingerprint and component."""
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
