"""Lines that many documents share: a sharded perfect hash tells each document which to drop."""

from __future__ import annotations

import itertools
import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bytes_of, own_names, stored, text_of, worker_table
from .perfect_hash import PerfectHash

MIN_CHARS = 40
MIN_DOCUMENTS = 5
#: Keys in one shard of the index: some 14 MB of arrays, which one task builds.
SHARD_KEYS = 500_000
#: The index is broadcast up to this size; beyond it, line hashes travel to its shards.
BROADCAST_BYTES = 64 << 20
#: Line hashes in one group of the travelling path.
GROUP_ROWS = 2_000_000
#: Stands for a null doc_id: smaller than every other.
NO_ID = -(2**63)

_INDEX = "shard int, perfect binary, fingerprints binary, keepers binary, counts binary"


def _digests(text: bytes, min_chars: int) -> tuple[int, list[int], list[bytes]]:
    """Number of lines; the numbers and 128-bit hashes of those with a long enough key."""
    lines = text.split(b"\n")
    at, found = [], []
    for i, line in enumerate(lines):
        if len(line) >= min_chars:
            key = line.strip().lower()  # of bytes: the six ASCII spaces, and A-Z alone
            if len(key) >= min_chars and (key.isascii() or len(key.decode("utf-8", "replace")) >= min_chars):
                at.append(i)
                found.append(xxhash.xxh3_128_digest(key))
    return len(lines), at, found


def _pairs(digests: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(b"".join(digests), "<u8").reshape(-1, 2)
    return both[:, 0].copy(), both[:, 1].copy()


def line_keys(documents: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, h1, h2): the hashes of each text's long lines, each once a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, found, owner = batch.column(0).to_numpy(zero_copy_only=False), [], []
            for i, text in enumerate(bytes_of(batch.column(1))):
                distinct = set(_digests(text, min_chars)[2])
                found += distinct
                owner.append((i, len(distinct)))
            h1, h2 = _pairs(found)
            rows = np.repeat([i for i, _ in owner], [n for _, n in owner]).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(ids[rows]), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64))], names=["doc_id", "h1", "h2"])

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id long, h1 long, h2 long")


def shared_keys(keys: DataFrame, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """(h1, h2, documents, keeper) of the keys in enough documents; keeper is the largest doc_id."""
    once = keys.select("h1", "h2", "doc_id").distinct()
    return once.groupBy("h1", "h2").agg(F.count("*").alias("documents"), F.max("doc_id").alias("keeper")).where(F.col("documents") >= min_documents)


def _build_shard(table: pa.Table) -> pa.Table:
    h1, h2 = (table[c].to_numpy().view(np.uint64) for c in ("h1", "h2"))
    # Two keys with the same h1 can't share a perfect hash: the second half joins in.
    perfect = PerfectHash.build(np.unique(_slot_key(h1, h2)))
    at = perfect.numbers(_slot_key(h1, h2))
    columns = []
    for values, dtype in ((h2, "<u8"), (table["keeper"].to_numpy(), "<i8"), (table["documents"].to_numpy(), "<u4")):
        array = np.zeros(len(h1), dtype)
        array[at] = values
        columns.append(array.tobytes())
    return pa.table({"shard": pa.array([table["shard"][0].as_py()], pa.int32()), "perfect": [perfect.to_bytes()], "fingerprints": [columns[0]], "keepers": [columns[1]], "counts": [columns[2]]})


def _slot_key(h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    return h1 ^ ((h2 << np.uint64(32)) | (h2 >> np.uint64(32)))


def shard_index(shared: DataFrame, shards: int) -> DataFrame:
    """One row per shard: the perfect hash and its arrays of fingerprints, keepers and counts."""
    dealt = shared.withColumn("shard", F.pmod("h1", F.lit(shards)).cast("int"))
    return dealt.groupBy("shard").applyInArrow(_build_shard, _INDEX)


class Shard:
    """The arrays of one shard, ready to be probed."""

    def __init__(self, perfect: bytes, fingerprints: bytes, keepers: bytes, counts: bytes) -> None:
        self.perfect = PerfectHash.from_bytes(perfect)
        self.fingerprints, self.keepers, self.counts = np.frombuffer(fingerprints, "<u8"), np.frombuffer(keepers, "<i8"), np.frombuffer(counts, "<u4")

    def drops(self, h1: np.ndarray, h2: np.ndarray, doc_ids: np.ndarray) -> np.ndarray:
        """Whether each line goes: its key is in the index, and another document keeps it."""
        at = self.perfect.numbers(_slot_key(h1, h2))
        known = at >= 0
        known[known] = self.fingerprints[at[known]] == h2[known]
        gone = known.copy()
        gone[known] = self.keepers[at[known]] != doc_ids[known]
        return gone


def _opened(key: str, index: Broadcast) -> dict[int, Shard]:
    """This worker's shards of a broadcast index."""
    return worker_table(key, lambda: {row[0]: Shard(*map(bytes, row[1:])) for row in index.value})


def _kept(text: bytes, dropped: set[int]) -> bytes:
    return b"\n".join(line for i, line in enumerate(text.split(b"\n")) if i not in dropped) if dropped else text


_TOLD = T.StructType().add("text", "string").add("n_lines", "long").add("n_dropped", "long")
_RESULT = pa.struct([("text", pa.string()), ("n_lines", pa.int64()), ("n_dropped", pa.int64())])


def _rewrite_by_broadcast(index: Broadcast, n_shards: int, min_chars: int):
    key = f"line-index-{uuid.uuid4().hex}"

    @F.arrow_udf(_TOLD)
    def rewrite(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for doc_ids, texts in batches:
            texts, ids = bytes_of(texts), doc_ids.to_numpy(zero_copy_only=False)
            n_lines, at, digests, counts = [], [], [], []
            for text in texts:
                n, where, found = _digests(text, min_chars)
                n_lines.append(n)
                at += where
                digests += found
                counts.append(len(where))
            h1, h2 = _pairs(digests)
            owner = np.repeat(np.arange(len(texts)), counts)
            gone = np.zeros(len(h1), bool)
            shard = (h1.view(np.int64) % n_shards).astype(np.int64)
            for number, arrays in _opened(key, index).items():
                mine = np.flatnonzero(shard == number)
                gone[mine] = arrays.drops(h1[mine], h2[mine], ids[owner[mine]])
            dropped: dict[int, set[int]] = {}
            for i in np.flatnonzero(gone):
                dropped.setdefault(int(owner[i]), set()).add(at[i])
            kept = [_kept(text, dropped.get(i, ())) for i, text in enumerate(texts)]
            yield pa.StructArray.from_arrays([pa.array(kept, pa.binary()).cast(pa.string()), pa.array(n_lines, pa.int64()), pa.array([len(dropped.get(i, ())) for i in range(len(texts))], pa.int64())], fields=list(_RESULT))

    return rewrite


def _drops_by_shard(documents: DataFrame, index: DataFrame, shards: int, min_chars: int, group_rows: int) -> DataFrame:
    """(doc_id, text_hash, dropped): the numbers of the lines to drop, of texts that lose any.

    Line hashes travel to the shards of the index. A hot line fills its shard, so
    each shard's lines are dealt to as many salted groups as the largest shard
    needs, and the index, compact as it is, is copied to each.
    """

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_digests(text, min_chars)[1:] for text in bytes_of(batch.column(2))]
            rows = np.repeat(np.arange(len(found)), [len(at) for at, _ in found])
            h1, h2 = _pairs(list(itertools.chain.from_iterable(d for _, d in found)))
            at = np.fromiter(itertools.chain.from_iterable(a for a, _ in found), np.int32, len(rows))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), batch.column(1).take(pa.array(rows)), pa.array(at), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64))], names=["doc_id", "text_hash", "line", "h1", "h2"])

    def probe(left: pa.Table, right: pa.Table) -> pa.Table:
        doc_ids, h1, h2 = left["doc_id"].to_numpy(), left["h1"].to_numpy().view(np.uint64), left["h2"].to_numpy().view(np.uint64)
        gone = np.zeros(len(h1), bool)
        if right.num_rows:
            gone = Shard(*(right[c][0].as_py() for c in ("perfect", "fingerprints", "keepers", "counts"))).drops(h1, h2, doc_ids)
        return left.select(["doc_id", "text_hash", "line"]).filter(pa.array(gone))

    plain = documents.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    hashed = stored(plain.mapInArrow(lines, "doc_id long, text_hash long, line int, h1 long, h2 long").withColumn("shard", F.pmod("h1", F.lit(shards)).cast("int")), "lines")
    largest = hashed.groupBy("shard").count().agg(F.max("count")).first()[0] or 0
    salts = max(1, math.ceil(largest / group_rows))
    left = hashed.withColumn("salt", F.pmod(F.xxhash64("doc_id", "line"), F.lit(salts)).cast("int"))
    right = index.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    gone = left.groupBy("shard", "salt").cogroup(right.groupBy("shard", "salt")).applyInArrow(probe, "doc_id long, text_hash long, line int")
    return gone.groupBy("doc_id", "text_hash").agg(F.collect_set("line").alias("dropped"))


@F.arrow_udf(_TOLD)
def _rewrite_by_numbers(texts: pa.Array, dropped: pa.Array) -> pa.Array:
    texts, gone = bytes_of(texts), [set(x or ()) for x in dropped.to_pylist()]
    kept = [_kept(*pair) for pair in zip(texts, gone, strict=True)]
    return pa.StructArray.from_arrays([pa.array(kept, pa.binary()).cast(pa.string()), pa.array([t.count(b"\n") + 1 for t in texts], pa.int64()), pa.array([len(x) for x in gone], pa.int64())], fields=list(_RESULT))


def drop_shared_lines(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", min_chars: int = MIN_CHARS, min_documents: int = MIN_DOCUMENTS, report: str = "line_dedup", broadcast_bytes: int = BROADCAST_BYTES, shard_keys: int = SHARD_KEYS, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Every row of ``documents``, the shared lines of its text gone.

    A line's key is the line without ASCII white space at either end, A-Z in lower
    case. A key of ``min_chars`` code points or more that is found in
    ``min_documents`` documents or more keeps its lines in the largest doc_id that
    holds it and loses them elsewhere. Other lines stay, joined by a line feed.

    Returns all columns, ``text_column`` rewritten, and a struct ``report`` of text
    (the kept text), n_lines (before dropping) and n_dropped.

    Method: distinct key hashes are counted with map-side sums (a line in a third of
    all documents is one row of each task). Keys in enough documents go into shards,
    each a minimal perfect hash with arrays of fingerprints, keepers and counts.
    Documents probe these arrays. Up to ``broadcast_bytes`` of arrays are broadcast;
    beyond that, line hashes are sent to the shards in salted groups, and the line
    numbers found there are joined to the texts. Both ways give the same rows.

    Nulls: a null text is one empty line and becomes the empty text; a null doc_id
    counts as one document, smaller than any other. Repeated rows of one doc_id are
    one document in the counts, and all of them keep or lose a line. Long texts are
    read whole. An empty table gives no rows. Other columns pass through;
    one named ``report`` is replaced.
    """
    spark = documents.sparkSession
    plain = documents.select(F.coalesce(F.col(id_column).cast("long"), F.lit(NO_ID)).alias("doc_id"), text_of(text_column).alias("text"))
    shared = stored(shared_keys(line_keys(plain, min_chars), min_documents), "shared-lines")
    shards = max(1, math.ceil(shared.count() / shard_keys))
    index = stored(shard_index(shared, shards), "line-index")
    total = index.agg(F.sum(sum(F.length(c) for c in ("perfect", "fingerprints", "keepers", "counts")))).first()[0] or 0
    key, text = F.coalesce(F.col(id_column).cast("long"), F.lit(NO_ID)), text_of(text_column)
    if total <= broadcast_bytes:
        held = spark.sparkContext.broadcast([tuple(row) for row in index.collect()])
        told = documents.withColumn(report, _rewrite_by_broadcast(held, shards, min_chars)(key, text))
    else:
        own = own_names(documents, "_drop_id", "_drop_hash", "_dropped")
        drops = _drops_by_shard(plain, index, shards, min_chars, group_rows).toDF(*own)
        joined = documents.join(drops, (key == F.col(own[0])) & (F.xxhash64(text) == F.col(own[1])), "left")
        told = joined.withColumn(report, _rewrite_by_numbers(text, F.col(own[2]))).drop(*own)
    return told.withColumn(text_column, F.col(report)["text"])


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract of op10: line counts of each document and the digest of its kept text."""
    kept = drop_shared_lines(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return kept.select("doc_id", F.col("line_dedup.n_lines"), F.col("line_dedup.n_dropped"), F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


ORACLE_SQL = r"""
WITH lines AS (
  SELECT doc_id, n, line, translate(trim(line, E' \t\n\r\x0b\x0c'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (
    SELECT doc_id, generate_subscripts(parts, 1) AS n, unnest(parts) AS line
    FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents)
  )
),
shared AS (
  SELECT k, max(doc_id) AS keeper FROM lines WHERE length(k) >= 40
  GROUP BY k HAVING count(DISTINCT doc_id) >= 5
),
marked AS (
  SELECT l.doc_id, l.n, l.line, s.k IS NOT NULL AND l.doc_id <> s.keeper AS gone
  FROM lines l LEFT JOIN shared s ON l.k = s.k
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
