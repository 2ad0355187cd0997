"""Concatenate and cut: documents into token sequences of a fixed size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bytes_of, small_runs, stored, text_of
from .tokens import encoder, tokenizer_path

SEQUENCE = 4096
END_ID = 2

_IDS = pa.schema([("part", pa.int32()), ("doc_id", pa.int64()), ("at", pa.int64()), ("doc_tokens", pa.int64()), ("ids", pa.binary())])


def _encode_partition(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            keys, texts = batch.column(0), bytes_of(batch.column(1))
            for a, b in small_runs(texts):
                ids, counts = encoder(path).encode(texts[a:b])
                ends = np.cumsum(counts)
                ids = np.insert(ids, ends, end_id).astype("<i4")
                counts = counts + 1
                ends = np.cumsum(counts)
                offsets = np.concatenate([[0], ends * 4])
                blob = pa.Array.from_buffers(pa.large_binary(), b - a, [None, pa.py_buffer(offsets.astype("<i8")), pa.py_buffer(ids)]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(b - a, part, np.int32)), keys.slice(a, b - a), pa.array(at + ends - counts), pa.array(counts), blob], schema=_IDS)
                at += int(ends[-1])

    return run


def token_table(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", tokenizer: str | None = None, end_id: int = END_ID) -> DataFrame:
    """First pass: each document's ids, and where they begin within its partition.

    Columns: part, doc_id, at, doc_tokens, ids (binary, unsigned 32-bit little-endian).
    The table is stored, so that texts are encoded once.
    """
    plain = documents.select(F.col(id_column).cast("long").alias("doc_id"), text_of(text_column).alias("text"))
    path = tokenizer or tokenizer_path()
    return stored(plain.mapInArrow(_encode_partition(path, end_id), "part int, doc_id long, at long, doc_tokens long, ids binary"), "tokens")


def pack(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", size: int = SEQUENCE, tokenizer: str | None = None, end_id: int = END_ID) -> DataFrame:
    """All documents as pieces of sequences of ``size`` tokens.

    Pass one encodes each partition and keeps running sums within it; the prefix
    sums of the partitions' totals (one row a partition) turn these into global
    offsets. Pass two cuts at the multiples of ``size``; a document over a boundary
    gets a piece on either side. Only the last sequence can be short.

    Returns one row per piece: doc_id, start, length, ids (binary, unsigned 32-bit
    little-endian), doc_tokens, sequence_id, offset. Every id lies in exactly one piece.

    Nulls: a null text counts as empty, and an empty text still has its end id; a
    null doc_id stays null. Long texts are encoded whole. Rows that repeat are
    documents of their own. An empty table gives no rows. Other columns are ignored.
    """
    tokens = token_table(documents, id_column, text_column, tokenizer, end_id)
    totals = tokens.groupBy("part").agg(F.sum("doc_tokens").alias("total"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    # One row for each partition of the first pass: a few bytes for every hundred MB of text.
    placed = tokens.join(F.broadcast(bases), "part").withColumn("first", F.col("base") + F.col("at"))
    last = F.col("first") + F.col("doc_tokens") - 1
    cut = placed.withColumn("sequence_id", F.explode(F.sequence(F.floor(F.col("first") / size), F.floor(last / size))))
    begin = F.greatest(F.col("first"), F.col("sequence_id") * size)
    start, end = begin - F.col("first"), F.least(last + 1, (F.col("sequence_id") + 1) * size)
    return cut.select(
        "doc_id",
        start.alias("start"),
        (end - begin).alias("length"),
        F.substring(F.col("ids"), (start * 4 + 1).cast("int"), ((end - begin) * 4).cast("int")).alias("ids"),
        "doc_tokens",
        "sequence_id",
        (begin - F.col("sequence_id") * size).alias("offset"),
    )


def sequences(pieces: DataFrame, size: int = SEQUENCE, pad_id: int = 0) -> DataFrame:
    """The sequences themselves: sequence_id, n_tokens, doc_ids, ids (array of int).

    A sequence is filled up with ``pad_id`` to ``size``, unless its length is a power
    of two; those stay as they are. A group holds ``size`` ids at most.
    """
    parts = F.array_sort(F.collect_list(F.struct("offset", "doc_id", F.hex("ids").alias("hex"))))
    whole = pieces.groupBy("sequence_id").agg(parts.alias("parts"), F.sum("length").cast("int").alias("n_tokens"))
    text = F.array_join(F.transform("parts", lambda p: p["hex"]), "")
    number = lambda i: F.conv(F.concat(*[F.substring(F.col("text"), i * 8 + k, F.lit(2)) for k in (7, 5, 3, 1)]), 16, 10).cast("int")
    ids = F.when(F.col("n_tokens") > 0, F.transform(F.sequence(F.lit(0), F.col("n_tokens") - 1), number))
    two = F.bit_count(F.col("n_tokens")) == 1
    pad = F.when(two, F.array().cast("array<int>")).otherwise(F.array_repeat(F.lit(pad_id), F.greatest(F.lit(size) - F.col("n_tokens"), F.lit(0))))
    return whole.withColumn("text", text).select("sequence_id", "n_tokens", F.transform("parts", lambda p: p["doc_id"]).alias("doc_ids"), F.concat(ids, pad).alias("ids"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract of op4: one row per piece of ``documents``, with the checksum of its ids."""
    return digest(pack(spark.read.parquet(f"{sf_dir}/documents.parquet")))


def digest(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
