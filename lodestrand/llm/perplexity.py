"""Quality by perplexity: an interpolated modified Kneser-Ney model trained on trusted text.

The grams are runs of bytes, each a symbol of its own: a word model's counts would have to be joined to
every word of every document, which moves several times the corpus. All counts of all
trusted text are kept, however many grams there are; each order's probabilities come
from joins that are sharded by gram. Documents probe the levels in memory up to a
checked size, and are joined to them by gram beyond it.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bytes_of, gather_ranges, own_names, small_runs, stored, text_of

ORDER = 5
#: Bits of a symbol: the folded alphabet of five, or all bytes as they are.
BITS = 5
BYTE_BITS = 8
#: Levels are broadcast up to this size; beyond it, the grams of documents are joined to them.
BROADCAST_BYTES = 128 << 20
#: Distinct grams that a counting task holds before it hands them on (counts do not depend on it).
HELD_GRAMS = 4_000_000
#: Trusted ids that are broadcast at most; more are joined by a shuffle.
BROADCAST_IDS = 1_000_000
#: One trusted document in so many is kept from the counts and gives the thresholds.
HELD_OUT = 5
QUANTILE = 0.99
#: How far over its quantile a perplexity may be.
SLACK = 1.0
#: A threshold of n documents counts n times, the next wider one this often: all languages and lengths have their own, and few documents lean on more.
PRIOR = 50
LENGTH_CLASSES = (6, 12)

_SPACE = 28


def _alphabet() -> np.ndarray:
    """Symbol of each byte of UTF-8: a letter each, then capitals, digits, white space, marks, other signs; 0 beyond ASCII."""
    table = np.full(256, 31, np.int32)
    table[128:] = 0
    table[ord("a") : ord("z") + 1] = np.arange(1, 27)
    table[ord("A") : ord("Z") + 1] = 27
    table[[32, *range(9, 14)]] = _SPACE
    table[ord("0") : ord("9") + 1] = 29
    table[list(b".,;:!?'\"()-")] = 30
    return table


ALPHABET = _alphabet()


def grams(texts: list[bytes], order: int = ORDER, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """The codes of all grams of all texts, and how many each text has: one for each byte, white space going before."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    pad = bytes([32]) * (order - 1)
    data = np.frombuffer(b"".join(pad + t for t in texts), np.uint8)
    symbols = ALPHABET[data] if bits == BITS else data.astype(np.int64)
    codes = np.zeros(len(symbols), symbols.dtype)
    for k in range(order):
        codes[order - 1 :] |= symbols[order - 1 - k : len(symbols) - k] << (bits * k)
    starts = np.cumsum(sizes + order - 1) - sizes
    return codes[gather_ranges(starts, sizes)], sizes


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, at = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return keys, np.bincount(at, np.concatenate([n for _, n in parts]), len(keys)).astype(np.int64)


def gram_counts(trusted: DataFrame, order: int = ORDER, held: int = HELD_GRAMS, bits: int = BITS) -> DataFrame:
    """(gram, n): how often each gram occurs in the column text; summed in each task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size = [(np.zeros(0, np.int64), np.zeros(0, np.int64))], 0
        for batch in batches:
            texts = bytes_of(batch.column(0))
            for a, b in small_runs(texts):
                parts.append(np.unique(grams(texts[a:b], order, bits)[0], return_counts=True))
                size += len(parts[-1][0])
                if size > held:
                    parts = [_summed(parts)]
                    size = len(parts[0][0])
                    if size > held // 2:
                        yield _batch(*parts.pop())
                        parts, size = [(np.zeros(0, np.int64), np.zeros(0, np.int64))], 0
        yield _batch(*_summed(parts))

    def _batch(keys: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int64)), pa.array(n)], names=["gram", "n"])

    return trusted.select("text").mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def _discounts(counts: DataFrame) -> list[float]:
    """Modified Kneser-Ney discounts of counts of one, two, and three or more."""
    of = dict(counts.where("n <= 4").groupBy("n").count().collect())
    n1, n2, n3, n4 = (of.get(i, 0) + 1 for i in (1, 2, 3, 4))
    y = n1 / (n1 + 2 * n2)
    return [min(max(v, 0.1), k - 0.05) for k, v in ((1, 1 - 2 * y * n2 / n1), (2, 2 - 3 * y * n3 / n2), (3, 3 - 4 * y * n4 / n3))]


def _suffix(order: int, bits: int) -> F.Column:
    return F.col("gram") % (1 << (bits * (order - 1)))


def level(counts: DataFrame, lower: DataFrame | None, order: int, bits: int = BITS) -> DataFrame:
    """(gram, p, context_rest) of one order, from its counts and the next lower order's (gram, p).

    Two joins that are sharded by their keys: with the sums of the gram's context, and
    with the lower order's probability of the gram without its first symbol.
    context_rest is the probability that the context leaves to the lower order.
    """
    d = _discounts(counts)
    cut = F.when(F.col("n") == 1, d[0]).when(F.col("n") == 2, d[1]).otherwise(d[2])
    placed = counts.withColumns({"context": F.shiftright("gram", bits), "suffix": _suffix(order, bits), "cut": cut})
    contexts = placed.groupBy("context").agg(F.sum("n").alias("total"), F.sum("cut").alias("rest"))
    joined = placed.join(contexts, "context")
    if lower is None:
        below = F.lit(1.0 / (1 << bits))
    else:
        joined, below = joined.join(lower.select(F.col("gram").alias("suffix"), F.col("p").alias("below")), "suffix"), F.col("below")
    return joined.select("gram", ((F.col("n") - F.col("cut") + F.col("rest") * below) / F.col("total")).alias("p"), (F.col("rest") / F.col("total")).alias("context_rest"))


def train(trusted: DataFrame, order: int = ORDER, bits: int = BITS) -> list[DataFrame]:
    """The levels of a model, lowest order first: (gram, p, context_rest) of every gram that was seen.

    The highest order has the counts of all trusted texts, lower orders the number of
    symbols that were seen before a gram.
    """
    counts = [stored(gram_counts(trusted, order, bits=bits), "gram-counts")]
    for k in range(order - 1, 0, -1):
        counts.append(stored(counts[-1].groupBy((F.col("gram") % (1 << (bits * k))).alias("gram")).agg(F.count("*").alias("n")), "gram-counts"))
    levels: list[DataFrame] = []
    for k in range(1, order + 1):
        levels.append(stored(level(counts[order - k], levels[-1] if levels else None, k, bits), "gram-levels"))
    return levels


def _contexts(of: DataFrame, bits: int) -> DataFrame:
    return of.groupBy(F.shiftright("gram", bits).alias("context")).agg(F.max("context_rest").alias("rest"))


class Tables:
    """The levels as sorted arrays, to be probed in memory."""

    def __init__(self, levels: list[DataFrame], bits: int = BITS) -> None:
        self.bits = bits
        self.orders = [(*_sorted(of.select("gram", F.log("p"))), *_sorted(_contexts(of, bits).select("context", F.log("rest")))) for of in levels]

    def log_p(self, codes: np.ndarray) -> np.ndarray:
        """log P of the last symbol of each gram of the highest order, given those before it."""
        out, left, weight = np.full(len(codes), -self.bits * np.log(2.0)), np.arange(len(codes)), np.zeros(len(codes))
        for k in range(len(self.orders), 0, -1):
            seen, values, contexts, rests = self.orders[k - 1]
            at, hit = _found(seen, codes)
            out[left[hit]] = weight[hit] + values[at[hit]]
            left, codes, weight = left[~hit], codes[~hit], weight[~hit]
            at, hit = _found(contexts, codes >> self.bits)
            weight[hit] += rests[at[hit]]
            codes = codes & ((1 << (self.bits * (k - 1))) - 1)
        out[left] += weight
        return out


def _sorted(pairs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    table = pairs.toArrow()
    keys = table.column(0).to_numpy()
    keys = keys.astype(np.int32) if keys.max(initial=0) < 2**31 else keys
    order = np.argsort(keys)
    return keys[order], table.column(1).to_numpy()[order]


def _found(keys: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return np.zeros(len(asked), np.int64), np.zeros(len(asked), bool)
    at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
    return at, keys[at] == asked


def resolved(distinct: DataFrame, levels: list[DataFrame], bits: int = BITS) -> DataFrame:
    """(gram, p) of distinct grams of the highest order: joins by gram, by context and, for the lower order, by suffix."""
    if not levels:
        return distinct.select("gram", F.lit(1.0 / (1 << bits)).alias("p"))
    of, order = levels[-1], len(levels)
    suffixes = distinct.select(_suffix(order, bits).alias("gram")).distinct()
    below = resolved(suffixes, levels[:-1], bits).select(F.col("gram").alias("suffix"), F.col("p").alias("below"))
    placed = distinct.withColumns({"context": F.shiftright("gram", bits), "suffix": _suffix(order, bits)})
    joined = placed.join(of.select("gram", F.col("p").alias("own")), "gram", "left").join(_contexts(of, bits), "context", "left").join(below, "suffix")
    return joined.select("gram", F.coalesce("own", F.coalesce("rest", F.lit(1.0)) * F.col("below")).alias("p"))


def _mean_log(tables: Broadcast, order: int, bits: int):
    @F.arrow_udf(T.DoubleType())
    def mean_log(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            texts, out = bytes_of(column), np.zeros(len(column))
            for a, b in small_runs(texts):
                codes, sizes = grams(texts[a:b], order, bits)
                sums = np.bincount(np.repeat(np.arange(b - a), sizes), tables.value.log_p(codes), b - a)
                out[a:b] = sums / np.maximum(sizes, 1)
            yield pa.array(out)

    return mean_log


def _gram_rows(order: int, bits: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(h1, h2, gram, n) of each text's distinct grams."""
    for batch in batches:
        texts = bytes_of(batch.column(2))
        for a, b in small_runs(texts):
            codes, sizes = grams(texts[a:b], order, bits)
            both, n = np.unique(np.repeat(np.arange(b - a, dtype=np.int64), sizes) << (bits * order) | codes, return_counts=True)
            row, gram = pa.array(a + (both >> (bits * order))), both & ((1 << (bits * order)) - 1)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(row), batch.column(1).take(row), pa.array(gram), pa.array(n)], names=["h1", "h2", "gram", "n"])


def _joined_mean_log(documents: DataFrame, levels: list[DataFrame], text: F.Column, bits: int) -> DataFrame:
    """(h1, h2, mean_log) of each distinct text: its grams are joined to the levels, sharded by gram."""
    texts = documents.select(*_text_key(text), text.alias("text")).where("text <> ''").dropDuplicates(["h1", "h2"])
    rows = stored(texts.mapInArrow(functools.partial(_gram_rows, len(levels), bits), "h1 long, h2 long, gram long, n long"), "document-grams")
    known = stored(resolved(rows.select("gram").distinct(), levels, bits), "resolved-grams")
    told = rows.join(known, "gram").groupBy("h1", "h2")
    return told.agg((F.sum(F.col("n") * F.log("p")) / F.sum("n")).alias("mean_log"))


def _text_key(text: F.Column) -> list[F.Column]:
    """128 bits of hash that stand for a text."""
    return [F.xxhash64(text).alias("h1"), F.xxhash64(text, F.lit(1)).alias("h2")]


@dataclass
class QualityModel:
    levels: list[DataFrame]
    #: The levels in memory; None if they are over the size that is broadcast.
    tables: Broadcast | None
    #: (lang, length_class, threshold): of a language and length; of a length (lang null); of all (both null).
    thresholds: DataFrame | None = None
    #: Bits of its symbols.
    bits: int = BYTE_BITS


def _length_class(text: F.Column) -> F.Column:
    """Twice as long, one class more: short texts scatter more than long ones."""
    low, high = LENGTH_CLASSES
    return F.least(F.greatest(F.floor(F.log2(F.octet_length(text) + 1)), F.lit(low)), F.lit(high)).cast("int")


def language_model(trusted: DataFrame, order: int = ORDER, broadcast_bytes: int = BROADCAST_BYTES, bits: int = BITS) -> QualityModel:
    """A model of the column text, without thresholds."""
    levels = train(trusted, order, bits)
    size = 32 * sum(of.count() for of in levels)  # a gram and at most a context, two numbers of eight bytes each
    return QualityModel(levels, trusted.sparkSession.sparkContext.broadcast(Tables(levels, bits)) if size <= broadcast_bytes else None, bits=bits)


def with_perplexity(documents: DataFrame, model: QualityModel, text_column: str = "text", column: str = "perplexity") -> DataFrame:
    """``documents`` with the perplexity per byte of each whole text; null for an empty or null text.

    Both ways, in memory and by joins, give the same numbers but for the order of the
    sums. Long texts are scored whole; repeated rows get equal numbers; an empty table
    gives no rows; all columns pass through, and one named ``column`` is replaced.
    """
    text = text_of(text_column)
    if model.tables is not None:
        return documents.withColumn(column, F.when(text != "", F.exp(-_mean_log(model.tables, len(model.levels), model.bits)(text))))
    own1, own2, value = own_names(documents, "_h1", "_h2", "_perplexity")
    told = _joined_mean_log(documents, model.levels, text, model.bits).select(F.col("h1").alias(own1), F.col("h2").alias(own2), F.exp(-F.col("mean_log")).alias(value))
    h1, h2 = _text_key(text)
    joined = documents.join(told, (h1 == F.col(own1)) & (h2 == F.col(own2)), "left")
    return joined.withColumn(column, F.when(text != "", F.col(value))).drop(own1, own2, value)


def fit(documents: DataFrame, trusted_ids: DataFrame, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang", order: int = ORDER, quantile: float = QUANTILE, broadcast_ids: int = BROADCAST_IDS, broadcast_bytes: int = BROADCAST_BYTES) -> QualityModel:
    """A model of the documents named in ``trusted_ids`` (id_column), and the thresholds by language.

    All trusted text is used, however much it is: of every ``HELD_OUT`` documents (by a
    hash of the id) one gives the thresholds, for a model is never surprised by text
    that it has counted, and the others give the counts. The ids are broadcast up to a
    checked number; more of them are joined by a shuffle, with the same result.
    """
    ids = trusted_ids.select(F.col(id_column).alias("_id")).where("_id IS NOT NULL").distinct()
    side = F.broadcast(ids) if ids.count() <= broadcast_ids else ids
    text = documents.select(F.col(id_column).alias("_id"), text_of(text_column).alias("text"), F.col(lang_column).cast("string").alias("lang"))
    trusted = text.join(side, "_id", "left_semi").where("text <> ''")
    held = F.pmod(F.xxhash64("_id"), F.lit(HELD_OUT)) == 0
    model = language_model(trusted.where(~held), order, broadcast_bytes, BYTE_BITS)
    scored = with_perplexity(trusted.where(held), model)
    told = stored(scored.select("lang", _length_class(F.col("text")).alias("length_class"), "perplexity"), "trusted-perplexities")
    model.thresholds = stored(thresholds(told, quantile), "thresholds")
    return model


def thresholds(told: DataFrame, quantile: float = QUANTILE, prior: int = PRIOR) -> DataFrame:
    """(lang, length_class, threshold) from trusted perplexities (lang, length_class, perplexity).

    A row for each language and length class, for each length class (lang null) and for
    all (both null). Each quantile is drawn towards the next wider one in the logarithm:
    (n log q + prior log wider) / (n + prior), so there is no size at which one takes over.
    """
    value, n = F.log(F.percentile_approx("perplexity", quantile, 10_000)).alias("q"), F.count("*").alias("n")
    drawn = lambda wider: (F.col("n") * F.col("q") + prior * F.col(wider)) / (F.col("n") + prior)
    every = told.agg(value, n).where("n > 0").select(F.col("q").alias("every"), F.lit(True).alias("_all"))  # one row
    length = told.groupBy("length_class").agg(value, n).withColumn("_all", F.lit(True)).join(F.broadcast(every), "_all").select("length_class", drawn("every").alias("same_length"))  # a row for each class
    own = told.where("lang IS NOT NULL").groupBy("lang", "length_class").agg(value, n).join(F.broadcast(length), "length_class")
    rows = own.select("lang", "length_class", F.exp(drawn("same_length")).alias("threshold"))
    rows = rows.unionByName(length.select(F.lit(None).cast("string").alias("lang"), "length_class", F.exp("same_length").alias("threshold")))
    return rows.unionByName(every.select(F.lit(None).cast("string").alias("lang"), F.lit(None).cast("int").alias("length_class"), F.exp("every").alias("threshold")))


def classify(documents: DataFrame, model: QualityModel, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang", slack: float = SLACK) -> DataFrame:
    """doc_id, lang, perplexity, threshold and kept of every document.

    A document goes if its perplexity is over ``slack`` times its threshold: that of its
    language and length class, see ``thresholds``; of its length class where no trusted
    document has that language, or of all. Without trusted text nothing goes but the
    empty.

    Nulls: a null or empty text has no perplexity and is not kept; a null language is
    held against all languages. Long texts are scored whole. Repeated rows get equal
    results. An empty table gives no rows. Other columns are ignored.
    """
    text = text_of(text_column)
    rows = documents.select(F.col(id_column).alias("doc_id"), F.col(lang_column).cast("string").alias("lang"), text.alias("text")).withColumn("length_class", _length_class(F.col("text")))
    scored = with_perplexity(rows, model).drop("text")
    own = model.thresholds.where("lang IS NOT NULL").withColumnRenamed("threshold", "own")
    same_length = model.thresholds.where("lang IS NULL AND length_class IS NOT NULL").select("length_class", F.col("threshold").alias("same_length"))  # a row for each class of length
    every = model.thresholds.where("length_class IS NULL").select(F.col("threshold").alias("every"), F.lit(True).alias("_all"))  # one row
    joined = scored.withColumn("_all", F.lit(True)).join(F.broadcast(same_length), "length_class", "left").join(F.broadcast(every), "_all", "left").join(own, ["lang", "length_class"], "left")
    limit = F.coalesce("own", "same_length", "every") * slack
    return joined.select("doc_id", "lang", "perplexity", limit.alias("threshold"), F.when(F.col("perplexity").isNull(), False).otherwise(F.coalesce(F.col("perplexity") <= limit, F.lit(True))).alias("kept"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's perplexity under a model of those labelled good, and whether it is kept."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    trusted = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1").select("doc_id")
    return classify(documents, fit(documents, trusted))
