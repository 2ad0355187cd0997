"""Near copies by word shingles: the trie of SimHash fingerprints is joined with itself bucket by bucket, exact Jaccard decides.

The trie of all fingerprints is joined with itself as in operator 2, and its components
are buckets. At Jaccard 0.8 fingerprints differ in some ten of 64 bits, an error budget at
which a trie of all documents prunes nothing. For what lies beyond the trie's radius MinHash
bands deal the texts to more buckets; the walk of node pairs runs in each bucket with a
budget that loses nothing.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bits import bit_sums, packed
from .common import bytes_of, join_split, small_runs, stored, text_of, worker_table
from .components import components
from .simhash_trie import SEED, _shingle_hashes, first_of_each, links, near_pairs

#: Words of a shingle.
SHINGLE = 5
#: Texts are near copies from this share of common shingles on: a fraction.
LIKE = (4, 5)
#: Bands of so many minima: at Jaccard 0.8, 1 - (1 - 0.8^5)^16 = 99.8% of pairs share a band.
BANDS, ROWS = 16, 5
#: Bits that fingerprints of near copies may differ in: ten at Jaccard 0.8, with a standard deviation of three.
BUDGET = 24
#: Bytes of shingle sets that one group holds against their pivots.
STAR_BYTES = 4 << 20
#: Texts of one cell; a larger bucket is cut into cells, and pairs of cells are joined.
CELL = 1000

_FACTORS = np.random.default_rng(SEED).integers(0, 2**63, (2, BANDS * ROWS), dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def bands_of(sets: list[np.ndarray]) -> np.ndarray:
    """A row of BANDS keys for each set of hashes; equal sets have equal rows."""
    sets = [s if len(s) else np.zeros(1, np.uint64) for s in sets]
    starts = np.cumsum([0, *map(len, sets)])[:-1]
    flat = np.concatenate(sets)
    out = np.zeros((len(sets), BANDS), np.uint64)
    for k, (a, b) in enumerate(_FACTORS.T):
        least = np.minimum.reduceat(flat * a + b, starts)
        out[:, k // ROWS] = (out[:, k // ROWS] ^ least) * _FACTORS[0, 0]
        out[:, k // ROWS] ^= out[:, k // ROWS] >> np.uint64(29)
    return out


def _hashes(texts: list[bytes]) -> list[np.ndarray]:
    """The shingle hashes of each text, repeats included; none without words."""
    return [np.array(_shingle_hashes(t, SHINGLE), np.uint64) for t in texts]


@F.arrow_udf(T.StructType().add("node", "long").add("fp", "long").add("bands", "binary"))
def signature(texts: pa.Array) -> pa.Array:
    """A hash of the words in their order, the SimHash fingerprint and the bands."""
    worker_table("near-copies", bool)  # empties what other operators keep
    rows, nodes, prints, bands = bytes_of(texts), [], [], []
    for a, b in small_runs(rows):
        nodes += [xxhash.xxh64_intdigest(b" ".join(t.lower().split()), SEED) for t in rows[a:b]]
        hashes = _hashes(rows[a:b])
        counts = np.fromiter(map(len, hashes), np.int64, b - a)
        sums = bit_sums(np.concatenate(hashes), np.repeat(np.arange(b - a), counts), b - a)
        prints.append(packed(2 * sums > counts[:, None]).view(np.int64))
        bands += [r.astype("<u8").tobytes() for r in bands_of([np.unique(h) for h in hashes])]
    return pa.StructArray.from_arrays([pa.array(np.array(nodes, np.uint64).view(np.int64)), pa.array(np.concatenate([np.zeros(0, np.int64), *prints])), pa.array(bands, pa.binary())], ["node", "fp", "bands"])


@F.arrow_udf(T.BinaryType())
def shingle_set(texts: pa.Array) -> pa.Array:
    """The sorted distinct shingles of each text, by 48 bits of their hashes in six bytes each."""
    rows, out = bytes_of(texts), []
    for a, b in small_runs(rows):
        out += [np.unique(h & np.uint64((1 << 48) - 1)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes() for h in _hashes(rows[a:b])]
    return pa.array(out, pa.binary())


def _opened(data: bytes) -> np.ndarray:
    wide = np.zeros((len(data) // 6, 8), np.uint8)
    wide[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return wide.view("<u8").ravel()


def _like(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sets have a Jaccard similarity of LIKE or more; sizes alone rule out many."""
    if LIKE[1] * min(len(a), len(b)) < LIKE[0] * max(len(a), len(b)):
        return False
    common = len(np.intersect1d(a, b, assume_unique=True))
    return LIKE[1] * common >= LIKE[0] * (len(a) + len(b) - common)


@F.arrow_udf(T.ArrayType(T.LongType()))
def band_keys(bands: pa.Array) -> pa.Array:
    keys = np.frombuffer(b"".join(bands.to_pylist()), "<u8").astype(np.uint64).view(np.int64)
    return pa.ListArray.from_arrays(pa.array(np.arange(0, len(keys) + 1, BANDS, dtype=np.int32)), pa.array(keys))


def buckets_of(signatures: DataFrame) -> DataFrame:
    """(bucket, node, pivot) of the bands' keys that two texts or more share; of buckets with the same texts one stays.

    pivot is the bucket's smallest node.
    """
    placed = stored(signatures.select("node", F.posexplode(band_keys("bands")).alias("band", "key")).select(F.xxhash64("band", "key").alias("bucket"), "node"), "bands")
    sums = placed.groupBy("bucket").agg(F.count("*").alias("n"), F.min("node").alias("pivot"), F.sum(F.xxhash64("node").cast("decimal(20,0)")).alias("sum")).where("n > 1")
    once = sums.groupBy("n", "pivot", "sum").agg(F.min("bucket").alias("bucket")).select("bucket", "pivot")
    return stored(placed.join(once, "bucket").select("bucket", "node", "pivot"), "buckets")


def trie_buckets(distinct: DataFrame) -> DataFrame:
    """(bucket, node, pivot) of the components of two texts or more in the self-join of the trie of all fingerprints (node, fp)."""
    root = components(links(distinct.select("fp").distinct())).select(F.col("node").alias("fp"), "root")
    total = distinct.count()
    placed = stored(join_split(distinct.select("node", "fp"), root, "fp", total, "left").select("node", F.coalesce("root", "fp").alias("root")), "trie-components")
    sums = placed.groupBy("root").agg(F.count("*").alias("n"), F.min("node").alias("pivot")).where("n > 1").select("root", "pivot")
    return stored(join_split(placed, sums, "root", total).select(F.xxhash64(F.lit("trie"), "root").alias("bucket"), "node", "pivot"), "trie-buckets")


def _held_against_pivots(table: pa.Table) -> pa.Table:
    """(u, v): the texts of a group that are like their pivot. A pivot's own row has no node."""
    worker_table("near-copies", bool)
    nodes, pivots, sets = table["node"].to_pylist(), table["pivot"].to_pylist(), table["set"]
    held = {p: i for i, (n, p) in enumerate(zip(nodes, pivots, strict=True)) if n is None}
    like, order, at, pivot = [], sorted(range(len(nodes)), key=pivots.__getitem__), None, None
    for i in order:
        if nodes[i] is not None:
            if at != pivots[i]:
                at, pivot = pivots[i], _opened(sets[held[pivots[i]]].as_py())
            if _like(pivot, _opened(sets[i].as_py())):
                like.append(i)
    return pa.table({"u": pa.array([nodes[i] for i in like], pa.int64()), "v": pa.array([pivots[i] for i in like], pa.int64())})


def star_links(members: DataFrame, sets: DataFrame, star_bytes: int = STAR_BYTES) -> DataFrame:
    """(u, v): the texts of ``members`` (node, pivot) that are like the pivot of a bucket of theirs.

    A pivot's texts are dealt to as many groups as their sets have times ``star_bytes``,
    and its own set is sent once to each; small stars share groups of about that size.
    """
    stars = members.where("node <> pivot").select("node", "pivot").distinct()
    sized = stored(stars.join(sets.select("node", F.octet_length("set").alias("bytes")), "node"), "stars")
    total = sized.agg(F.sum("bytes"), F.count("*")).first()
    groups = max(1, (total[0] or 0) // star_bytes)
    parts = sized.groupBy("pivot").agg(F.ceil(F.sum("bytes") / star_bytes).alias("parts"))
    dealt = join_split(sized, parts.where("parts > 1"), "pivot", total[1], "left").withColumn("part", F.pmod(F.xxhash64("node"), F.coalesce("parts", F.lit(1))))
    dealt = stored(dealt.select("node", "pivot", F.pmod(F.xxhash64("pivot", "part"), F.lit(groups)).alias("group")), "dealt-stars")
    heads = dealt.select(F.lit(None).cast("long").alias("node"), "pivot", "group").distinct().join(sets.select(F.col("node").alias("pivot"), "set"), "pivot")
    own = dealt.join(sets.select("node", "set"), "node")
    work = own.select("group", "node", "pivot", "set").unionByName(heads.select("group", "node", "pivot", "set"))
    return work.groupBy("group").applyInArrow(_held_against_pivots, "u long, v long")


class _Links:
    """Union of a cell's texts; ``root`` tells which are linked already."""

    def __init__(self, roots: list[int]) -> None:
        first: dict[int, int] = {}
        self.up = [first.setdefault(r, i) for i, r in enumerate(roots)]

    def top(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = i = self.up[self.up[i]]
        return i


def _walk_cell(table: pa.Table) -> pa.Table:
    """The links that a pair of cells adds: the trie's near pairs, those linked already left out, by exact Jaccard."""
    nodes, side = table["node"].to_numpy(), table["side"].to_numpy()
    prints, sets = table["fp"].to_numpy().view(np.uint64), [_opened(x) for x in table["set"].to_pylist()]
    links, found = _Links(table["root"].to_pylist()), []
    keys, at = np.unique(prints, return_inverse=True)
    members = np.split(np.argsort(at, kind="stable"), np.cumsum(np.bincount(at, minlength=len(keys)))[:-1])

    def meet(i: int, j: int) -> None:
        for x in members[i].tolist():
            for y in members[j].tolist():
                if (i != j or x < y) and (side[x] != side[y] or side[x] == 2) and (a := links.top(x)) != (b := links.top(y)) and _like(sets[x], sets[y]):
                    links.up[max(a, b)] = min(a, b)
                    found.append((nodes[x], nodes[y]))

    for k in range(len(keys)):
        if len(members[k]) > 1:
            meet(k, k)
    for i, j in near_pairs(keys, None, BUDGET):
        for x, y in zip(i.tolist(), j.tolist(), strict=True):
            meet(x, y)
    ends = np.array(found, np.int64).reshape(-1, 2)
    return pa.table({"u": ends.max(axis=1), "v": ends.min(axis=1)})


def residual_links(members: DataFrame, sets: DataFrame, root: DataFrame, cell: int = CELL) -> DataFrame:
    """(u, v): the links within buckets between texts that are not in one component of ``root`` (node, root) yet.

    A bucket's texts are dealt to cells: those of a component that fills a cell or more
    to cells of their own, the others together. Every pair of cells of a bucket is walked
    in a group of its own, but for two cells of one component.
    """
    known = members.select("bucket", "node").join(root, "node", "left").withColumn("root", F.coalesce("root", "node"))
    open_ = known.groupBy("bucket").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a <> b").select("bucket")
    rows = stored(known.join(open_, "bucket", "left_semi"), "open-buckets")
    sizes = rows.groupBy("bucket", "root").agg(F.count("*").alias("n"))
    large = sizes.where(F.col("n") > cell)
    small = sizes.where(F.col("n") <= cell).groupBy("bucket").agg(F.sum("n").alias("n"))
    cuts = large.select("bucket", F.col("root").alias("own"), "n").unionByName(small.select("bucket", F.lit(None).cast("long").alias("own"), "n"))
    cuts = stored(cuts.withColumn("cells", F.ceil(F.col("n") / cell)), "cells")
    numbered = cuts.select("bucket", "own", F.explode(F.sequence(F.lit(1).cast("long"), "cells")).alias("i")).withColumn("cell", F.xxhash64("bucket", "own", "i"))
    a, b = (numbered.select("bucket", F.col("own").alias(f"own_{k}"), F.col("cell").alias(k)) for k in ("a", "b"))
    pairs = a.join(b, "bucket").where("a <= b AND (own_a IS NULL OR own_b IS NULL OR own_a <> own_b)")
    ends = pairs.select("a", "b", F.explode(F.when(F.col("a") == F.col("b"), F.array(F.struct(F.col("a").alias("cell"), F.lit(2).alias("side")))).otherwise(F.array(F.struct(F.col("a").alias("cell"), F.lit(0).alias("side")), F.struct(F.col("b").alias("cell"), F.lit(1).alias("side"))))).alias("e")).select("a", "b", "e.cell", "e.side")
    own = large.select("bucket", "root", F.col("root").alias("own"))
    placed = rows.join(own, ["bucket", "root"], "left").alias("r").join(cuts.alias("c"), (F.col("r.bucket") == F.col("c.bucket")) & F.col("r.own").eqNullSafe(F.col("c.own")))
    dealt = placed.select("r.node", "r.root", F.xxhash64("r.bucket", "r.own", F.pmod(F.xxhash64("r.node"), F.col("c.cells")) + 1).alias("cell"))
    work = dealt.join(ends, "cell").join(sets, "node").select("a", "b", "side", "node", "root", "fp", "set")
    return work.groupBy("a", "b").applyInArrow(_walk_cell, "u long, v long")


def near_copies(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", cell: int = CELL) -> DataFrame:
    """(doc_id, text_hash, root) of every row: rows of one component have one root.

    Texts are linked if 5-word shingles (A-Z in lower case; the whole sequence of a
    shorter text) have a Jaccard similarity of 0.8 or more. The self-join of the trie of
    fingerprints, and MinHash bands for pairs beyond its radius, put texts that may be
    linked in buckets. First every text is held against its bucket's pivot, which
    settles groups of copies however large; then the buckets that hold texts of several
    components are walked as tries of SimHash fingerprints, cell by cell, and every pair
    within the budget that is not connected yet is checked. No pair of a bucket is left
    out, and what is written is a tree of links, not all pairs.

    Nulls: a null text counts as empty; texts without words are copies of each other. A
    null doc_id stays null. Long texts are read whole. Repeated rows stay. An empty table
    gives no rows. Other columns are ignored.
    """
    text, absent = text_of(text_column), F.lit(-(2**63))
    key = F.coalesce(F.col(id_column).cast("long"), absent)
    hashed = documents.select(F.col(id_column).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), signature(text).alias("s"))
    rows = stored(hashed.select("doc_id", "text_hash", "s.node", "s.fp", "s.bands"), "signatures")
    one = F.min(F.struct(F.coalesce("doc_id", absent).alias("row_id"), "text_hash")).alias("one")
    distinct = stored(rows.groupBy("node").agg(one, F.first("fp").alias("fp"), F.first("bands").alias("bands")), "distinct-texts")
    members = trie_buckets(distinct.select("node", "fp")).unionByName(buckets_of(distinct.select("node", "bands")))
    # A text is fetched by one of its rows, so that copies don't meet in one task.
    asked = distinct.join(members.select("node").distinct(), "node", "left_semi").select("node", "fp", "one.row_id", "one.text_hash")
    texts = documents.select(key.alias("row_id"), text.alias("text"), F.xxhash64(text).alias("text_hash")).join(asked, ["row_id", "text_hash"])
    sets = stored(texts.dropDuplicates(["row_id", "text_hash"]).select("node", "fp", shingle_set("text").alias("set")), "shingle-sets")
    edges = stored(star_links(members, sets), "star-links")
    root = stored(components(edges), "components")
    more = stored(residual_links(members, sets, root, cell), "more-links")
    if not more.isEmpty():
        root = stored(components(edges.union(more)), "components")
    told = join_split(rows.select("doc_id", "text_hash", "node"), root, "node", rows.count(), "left")
    return told.select("doc_id", "text_hash", F.coalesce("root", "node").alias("root"))


def keep_one_near(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of ``documents`` that stay when each component of near copies keeps one; see ``first_of_each``."""
    return first_of_each(documents, near_copies(documents, id_column, text_column), id_column, text_column)
