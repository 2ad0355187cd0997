"""What the text operators share: shared storage, batches and word tables."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import shared_folder, stored

__all__ = ["GrowingRows", "WordIndex", "bytes_of", "gather_ranges", "join_split", "own_names", "shared_folder", "small_runs", "stored", "sums_of_runs", "text_of", "worker_table"]

#: Characters of text that a Python worker holds as words at one time.
CHUNK_CHARS = 1 << 20

#: Words that a worker's table holds before it is emptied (results do not depend on it).
WORD_LIMIT = 300_000


def text_of(column: str = "text"):
    """The text column, null taken as the empty text."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def own_names(df: DataFrame, *names: str) -> list[str]:
    """Names for columns that a function adds for itself: like ``names``, and in the way of no column of ``df``."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


#: Rows of a key that one task joins in any case; a key with more, and over 1 / HOT_SHARE of all rows, is split.
HOT_ROWS = 1_000_000
HOT_SHARE = 1000


def join_split(rows: DataFrame, table: DataFrame, key: str, total: int, how: str = "inner", hot_rows: int = HOT_ROWS) -> DataFrame:
    """``rows`` joined with ``table``, which has one row a key, so that no key's rows are one task.

    ``total`` is the number of ``rows``. Keys with more than ``hot_rows`` rows and more
    than a share of 1 / HOT_SHARE are fewer than HOT_SHARE, so their part of ``table`` is
    broadcast; the rest is joined by key. With no more rows than ``hot_rows`` there is no
    such key. ``how`` is inner or left; null keys match nothing.
    """
    if total <= hot_rows:
        return rows.join(table, key, how)
    limit = max(hot_rows, total // HOT_SHARE)
    hot = stored(rows.groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") > limit).select(key), "hot-keys")
    few = F.broadcast(hot)  # HOT_SHARE rows at most
    split = rows.join(few, key, "left_semi").join(F.broadcast(table.join(few, key, "left_semi")), key, how)
    return split.unionByName(rows.join(few, key, "left_anti").join(table, key, how))


_held: dict = {}


def _give_back() -> None:
    """Returns freed memory to the system, where the C library can."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def worker_table(key, make: Callable):
    """What a Python worker keeps between batches, made once. Another operator's table goes first.

    Spark reuses workers from stage to stage; without this, each stage of a pipeline
    would leave its words behind in all of them.
    """
    if key not in _held:
        _held.clear()
        _give_back()
        _held[key] = make()
    return _held[key]


def small_runs(texts: list, limit: int = CHUNK_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts of about ``limit`` characters; a longer text has a range of its own."""
    start, size = 0, 0
    for i, text in enumerate(texts):
        if i > start and size + len(text) > limit:
            yield start, i
            start, size = i, 0
        size += len(text)
    if start < len(texts):
        yield start, len(texts)


class WordIndex(dict):
    """Word to dense number. A new word gets the next number and waits in ``fresh``."""

    def __init__(self, known=()) -> None:
        super().__init__(known)
        self.fresh: list = []

    def __missing__(self, word):
        number = self[word] = len(self)
        self.fresh.append(word)
        return number

    def numbers(self, words: list) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))

    def take_fresh(self) -> list:
        fresh, self.fresh = self.fresh, []
        return fresh


class GrowingRows:
    """A numpy array that rows are added to; doubles when full."""

    def __init__(self, dtype, width: int | None = None) -> None:
        self.size = 0
        self.data = np.zeros((1024,) if width is None else (1024, width), dtype)

    def extend(self, rows: np.ndarray) -> None:
        need = self.size + len(rows)
        if need > len(self.data):
            grown = np.zeros((max(need, 2 * len(self.data)), *self.data.shape[1:]), self.data.dtype)
            grown[: self.size] = self.data[: self.size]
            self.data = grown
        self.data[self.size : need] = rows
        self.size = need


def gather_ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions start, start+1, ... of each range, one range after the other."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    shift = np.repeat(starts - (ends - lengths), lengths)
    return shift + np.arange(total)


def sums_of_runs(values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Sum of each run of ``values``; runs follow each other and may be empty."""
    ends = np.cumsum(lengths)
    total = np.concatenate([np.zeros(1, values.dtype if values.dtype.kind == "f" else np.int64), np.cumsum(values)])
    return total[ends] - total[ends - lengths]


def bytes_of(column: pa.Array) -> list[bytes]:
    """A string column as UTF-8."""
    return column.cast(pa.binary()).to_pylist()
