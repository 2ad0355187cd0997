"""SimHash fingerprints of 128 bits, and permuted block tables to find the ones nearby."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bits import bit_sums, packed
from .common import WORD_LIMIT, GrowingRows, WordIndex, bytes_of, small_runs, stored, text_of, worker_table
from .tokens import BREAK

BITS = 128
#: Fingerprints of this many different bits or fewer are found; there is one block more than that.
RADIUS = 3
#: Bytes of text in one range of the order of ids, which one task reads.
RANGE_BYTES = 32 << 20
#: Bytes of texts that are compared at one time.
RUN_BYTES = 1 << 20
#: A word weighs as much as it has bytes, up to this: short words are in every text.
MAX_WEIGHT = 12


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Fingerprinter:
    """A worker's words with their hashes and weights."""

    def __init__(self) -> None:
        self._forget()

    def _forget(self) -> None:
        self.words, self.hashes, self.weights = WordIndex({BREAK.strip(): 0}), GrowingRows(np.uint64), GrowingRows(np.float64)
        self.hashes.extend(np.zeros(1, np.uint64))
        self.weights.extend(np.zeros(1))

    def __call__(self, texts: list[bytes]) -> np.ndarray:
        """Two columns of 64 bits for each text.

        Terms are pairs of neighbouring words, the text's ends counting as a word: each
        votes with the weight of its words on every bit, for or against; a bit is set
        if the votes for it have over half the weight. Without words no bit is set.
        """
        out = np.zeros((len(texts), 2), np.uint64)
        for a, b in small_runs(texts):
            if len(self.words) > WORD_LIMIT:
                self._forget()
            numbers = self.words.numbers((BREAK + BREAK.join(texts[a:b]) + BREAK).lower().split())
            if fresh := self.words.take_fresh():
                self.hashes.extend(np.fromiter((xxhash.xxh64_intdigest(w) for w in fresh), np.uint64, len(fresh)))
                self.weights.extend(np.minimum(np.fromiter(map(len, fresh), np.float64, len(fresh)), MAX_WEIGHT))
            h, w = self.hashes.data[numbers], self.weights.data[numbers]
            weight = w[:-1] + w[1:]  # none between two ends: a text without words
            owner = np.cumsum(numbers == 0)[:-1] - 1
            low = _mixed(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + ((h[1:] << np.uint64(31)) | (h[1:] >> np.uint64(33))))
            total = np.bincount(owner, weight, b - a)[:, None]
            for k, hashes in enumerate((low, _mixed(low + np.uint64(0x632BE59BD9B4E019)))):
                out[a:b, k] = packed(2 * bit_sums(hashes, owner, b - a, weight) > total)
        return out


def fingerprinter() -> Fingerprinter:
    """This worker's."""
    return worker_table("fingerprints", Fingerprinter)


_PAIR = T.StructType().add("high", "long").add("low", "long")


@F.arrow_udf(_PAIR)
def simhash128(texts: pa.Array) -> pa.Array:
    """The fingerprint of each text as two signed numbers."""
    both = fingerprinter()(bytes_of(texts)).view(np.int64)
    return pa.StructArray.from_arrays([pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy())], ["high", "low"])


def in_hex(high: str, low: str) -> F.Column:
    return F.lower(F.concat(F.lpad(F.hex(high), 16, "0"), F.lpad(F.hex(low), 16, "0")))


def block_tables(fingerprints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``fingerprints`` (high, low, ...) once for each table: (block, key), key the block put in front.

    Fingerprints within ``radius`` bits agree in at least one of radius + 1 blocks, and
    so meet in that block's table.
    """
    width = BITS // (radius + 1)
    if BITS % (radius + 1) or 64 % width:
        raise ValueError("radius + 1 must divide the bits of a fingerprint into blocks that lie in one half")
    per = 64 // width
    mask = (1 << width) - 1
    cut = lambda c, k: F.shiftrightunsigned(c, k * width).bitwiseAND(F.lit(mask if width < 64 else -1).cast("long"))
    keys = [F.struct(F.lit(i).alias("block"), cut("high" if i < per else "low", i % per).alias("key")) for i in range(radius + 1)]
    return fingerprints.withColumn("_table", F.explode(F.array(*keys))).select("*", "_table.block", "_table.key").drop("_table")


def near(queries: DataFrame, fingerprints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(high, low, near_high, near_low, distance): all of ``fingerprints`` within ``radius`` of each of ``queries``.

    Both are (high, low); equal rows are joined once. A pair is reported from the first
    block that it agrees in.
    """
    q = block_tables(queries.select("high", "low").distinct(), radius).alias("q")
    f = block_tables(fingerprints.select("high", "low").distinct(), radius).alias("f")
    high, low = (F.col(f"q.{c}").bitwiseXOR(F.col(f"f.{c}")) for c in ("high", "low"))
    distance = F.bit_count(high) + F.bit_count(low)
    width = BITS // (radius + 1)
    mask, per = (1 << width) - 1 if width < 64 else -1, 64 // width
    agree = [F.shiftrightunsigned(high if i < per else low, (i % per) * width).bitwiseAND(F.lit(mask).cast("long")) == 0 for i in range(radius + 1)]
    first = F.coalesce(*(F.when(a, F.lit(i)) for i, a in enumerate(agree)))
    joined = q.join(f, (F.col("q.block") == F.col("f.block")) & (F.col("q.key") == F.col("f.key")) & (distance <= radius) & (first == F.col("q.block")))
    return joined.select("q.high", "q.low", F.col("f.high").alias("near_high"), F.col("f.low").alias("near_low"), distance.alias("distance"))


def fingerprint(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, high, low) of every whole text.

    Nulls: a null text counts as empty, a null doc_id stays null. Texts without words
    have the fingerprint zero. Equal texts have equal fingerprints. Repeated rows stay.
    An empty table gives no rows. Other columns are ignored.
    """
    return documents.select(F.col(id_column).alias("doc_id"), simhash128(text_of(text_column)).alias("fp")).select("doc_id", "fp.high", "fp.low")


# Each text beside the next one, without sorting all rows into one task


def _bucket(bounds: list):
    cuts = np.array(sorted(bounds), np.int64)

    @F.arrow_udf(T.IntegerType())
    def bucket(ids: pa.Array) -> pa.Array:
        """0 for the largest ids; null ids come last."""
        found = len(cuts) - np.searchsorted(cuts, ids.fill_null(0).to_numpy(zero_copy_only=False), "right")
        return pa.array(np.where(ids.is_null().to_numpy(zero_copy_only=False), len(cuts), found).astype(np.int32))

    return bucket


def beside_next(documents: DataFrame, buckets: int | None = None) -> DataFrame:
    """(target, guest, doc_id, text): within a target, in order, each row comes before its next document.

    Order: descending doc_id (nulls last), equal ids by the hash of their text; after
    the last comes the first. Ranges of ids are the targets, as many as the bytes of the
    texts ask for, so that a task does not grow with the table. The first row of a range
    is also, as a guest, the last of the range before, so one shuffle of the texts is
    enough. Only the ranges' bounds and first rows' ids pass the driver.
    """
    spark = documents.sparkSession
    size = documents.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = buckets or max(1, math.ceil(size / RANGE_BYTES))
    bounds = documents.approxQuantile("doc_id", [i / n for i in range(1, n)], 0.1 / n) if n > 1 else []
    keyed = documents.select("doc_id", "text", F.xxhash64("text").alias("text_hash"), _bucket(sorted(set(map(int, bounds))))("doc_id").alias("bucket"))
    order = F.struct(F.col("doc_id").isNotNull(), "doc_id", "text_hash")
    firsts = sorted((b, d, h) for b, d, h in keyed.groupBy("bucket").agg(F.max(order).alias("o")).select("bucket", "o.doc_id", "o.text_hash").collect())
    guests = [(firsts[i - 1][0], d, h) for i, (_, d, h) in enumerate(firsts)]
    table = F.broadcast(spark.createDataFrame(guests, "_to int, _id long, _hash long"))  # one row a range
    sent = keyed.join(table, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash")), "left")
    own, guest = F.struct(F.col("bucket").alias("target"), F.lit(False).alias("guest")), F.struct(F.col("_to").alias("target"), F.lit(True).alias("guest"))
    dealt = sent.withColumn("_at", F.explode(F.when(F.col("_to").isNull(), F.array(own)).otherwise(F.array(own, guest)))).select("_at.target", "_at.guest", "doc_id", "text_hash", "text")
    return dealt.repartition(n, "target").sortWithinPartitions("target", "guest", F.col("doc_id").desc_nulls_last(), F.col("text_hash").desc()).select("target", "guest", "doc_id", "text")


def edited(text: str, following: str) -> str:
    """``text``, the last half of its code points replaced by the first as many of ``following``."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row beside the next of its target: their fingerprints, and the edited text's."""
    waiting: tuple | None = None
    for batch in batches:
        targets, guests, ids = (batch.column(i).to_pylist() for i in range(3))
        texts = bytes_of(batch.column(3))
        for a, b in small_runs(texts, RUN_BYTES):
            rows = list(zip(targets[a:b], guests[a:b], ids[a:b], texts[a:b], strict=True))
            rows = ([waiting] if waiting else []) + rows
            waiting = rows[-1]
            # A target's last row is a guest, and a guest has no next row of its own.
            now = [i for i in range(len(rows) - 1) if not rows[i][1]]
            plain = [r[3].decode("utf-8", "replace") for r in rows]
            changed = [edited(plain[i], plain[i + 1]).encode() for i in now]
            own, other = fingerprinter()([r[3] for r in rows]), fingerprinter()(changed)
            mine, following = own[now], own[[i + 1 for i in now]]
            columns = [mine[:, 0], mine[:, 1], other[:, 0], other[:, 1]]
            likeness = [1 - np.bitwise_count(mine ^ x).sum(axis=1) / BITS for x in (other, following)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([rows[i][2] for i in now], pa.int64()), pa.array([len(plain[i]) for i in now], pa.int64()), pa.array([hashlib.sha256(c).hexdigest() for c in changed], pa.string()), *(pa.array(c.view(np.int64).copy()) for c in columns), *map(pa.array, likeness)],
                names=["doc_id", "n_chars", "edited_sha256", "high", "low", "edited_high", "edited_low", "near_edited", "near_next"],
            )


def compare_with_next(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", buckets: int | None = None) -> DataFrame:
    """Fingerprints of each text, of its edited form and of the next text, and how alike they are.

    Likeness is the share of equal bits. For nulls and ties see ``fingerprint`` and
    ``beside_next``; a single document is its own next one. An empty table gives no rows.
    """
    plain = documents.select(F.col(id_column).cast("long").alias("doc_id"), text_of(text_column).alias("text"))
    kinds = "doc_id long, n_chars long, edited_sha256 string, high long, low long, edited_high long, edited_low long, near_edited double, near_next double"
    return beside_next(plain, buckets).mapInArrow(_compare, kinds)


def op5_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract of op5; n_near has, for doc_ids divisible by 100, the documents within the radius (itself included)."""
    told = stored(compare_with_next(spark.read.parquet(f"{sf_dir}/documents.parquet")), "fingerprints")
    copies = told.groupBy("high", "low").agg(F.count("*").alias("copies"))
    found = near(told.where("doc_id % 100 = 0"), copies)
    held = copies.select(F.col("high").alias("near_high"), F.col("low").alias("near_low"), "copies")
    counts = found.join(held, ["near_high", "near_low"]).groupBy("high", "low").agg(F.sum("copies").alias("n_near"))
    asked = told.where("doc_id % 100 = 0").join(counts, ["high", "low"], "left")
    rest = told.where("doc_id % 100 <> 0 OR doc_id IS NULL").withColumn("n_near", F.lit(None).cast("long"))
    every = asked.unionByName(rest)
    return every.select("doc_id", "n_chars", "edited_sha256", in_hex("high", "low").alias("fingerprint"), in_hex("edited_high", "edited_low").alias("edited_fingerprint"), "near_edited", "near_next", "n_near")
