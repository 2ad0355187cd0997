"""Digests over rows in order, however many rows a key has: a key's rows pass through one task as a stream."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Groups of keys for each shuffle partition: enough to even out, few enough to cost nothing.
SPREAD = 4


def in_order(rows: DataFrame, keys: list[str], order: list[str], run: Callable, schema: str) -> DataFrame:
    """``run`` over streams of rows that come in the order of ``keys``, then ``order``; it gets and yields record batches.

    A key's rows are all in one stream, a stream holds many keys. Grouping declares the
    distribution, so no plan can deal a key's rows to several tasks, and batches come one
    after the other, so a stream may be longer than memory. ``stream`` is the name of a
    column that is added in front.
    """
    n = SPREAD * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.withColumn("stream", F.pmod(F.xxhash64(*keys), F.lit(n)).cast("int"))
    ordered = dealt.repartition("stream").sortWithinPartitions("stream", *keys, *order)
    return ordered.select("stream", *(c for c in ordered.columns if c != "stream")).groupBy("stream").applyInArrow(run, schema)


def joined_digests(rows: DataFrame, keys: list[str], order: str, piece: Column, separator: bytes = b"", algorithm: str = "sha256") -> DataFrame:
    """``keys`` and a column named after ``algorithm``: of each key's pieces in order, with ``separator`` between them, as lower-case hex.

    Nulls: a null piece counts as the empty text, a null key as a key. Ties in the order
    raise an error: the order must tell a key's rows apart. No rows give no digests. A
    piece of any length is hashed whole; a key may have any number of pieces.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, last, state, done = None, None, None, []
        names = [f"k{i}" for i in range(len(keys))] + [algorithm]

        def told() -> pa.RecordBatch:
            columns = list(zip(*done, strict=True))
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [*types, pa.string()], strict=True)], names=names)
            done.clear()
            return batch

        types = None
        for batch in batches:
            types = [batch.column(1 + i).type for i in range(len(keys))]
            columns = [batch.column(1 + i).to_pylist() for i in range(len(keys) + 1)]
            pieces = batch.column(len(keys) + 2).cast(pa.binary()).to_pylist()
            for at, (own, text) in enumerate(zip(zip(*columns, strict=True), pieces, strict=True)):
                if own[:-1] != key or state is None:
                    if state is not None:
                        done.append((*key, state.hexdigest()))
                    key, state = own[:-1], hashlib.new(algorithm)
                elif not own[-1] > last:
                    raise ValueError(f"rows of {key} out of order at {own[-1]}")
                else:
                    state.update(separator)
                state.update(text or b"")
                last = own[-1]
            if len(done) > 10_000:
                yield told()
        if state is not None:
            done.append((*key, state.hexdigest()))
            yield told()

    kinds = dict(rows.dtypes)
    some = rows.select(*(F.col(c).alias(f"k{i}") for i, c in enumerate(keys)), F.col(order).alias("at"), piece.alias("piece"))
    schema = ", ".join([*(f"k{i} {kinds[c]}" for i, c in enumerate(keys)), f"{algorithm} string"])
    return in_order(some, [f"k{i}" for i in range(len(keys))], ["at"], run, schema).toDF(*keys, algorithm)
