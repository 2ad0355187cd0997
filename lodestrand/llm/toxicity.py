"""Toxicity by two Kneser-Ney models, one of toxic and one of ordinary text, that share their backoff.

An expression is a word after the word before it. A model spells it in steps: growing
prefixes of the word, the whole word, then its left neighbour, each given the step
before. A step's probability in a class is its discounted count plus the discounted mass
times the lower order that both classes share: continuation counts, that is in how many
different words a prefix is met, and beside how many different words a neighbour. The
score compares the two log-likelihoods of a text, each divided by its number of words;
steps whose evidence is too thin have the shared probability in both and cancel.
"""

from __future__ import annotations

import math
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WORD_LIMIT, GrowingRows, WordIndex, bytes_of, gather_ranges, small_runs, stored, text_of, worker_table
from .tokens import BREAK

#: Labelled documents that the models are fitted on, at most (a share by hash of the doc_id beyond that).
MAX_LABELLED = 50_000
#: Expressions whose documents give less evidence than this get their probability from the shared counts alone.
EVIDENCE = 20.0
#: The part of each model that is the shared distribution, so that no single word decides.
SHARED = 0.2
#: A word is spelled as its first 4, 5 and 6 letters, then the whole, then with the word before it: each is a step of the model.
STEPS = (4, 5, 6)
#: Stands before a text's first word; no word is spelled so.
START = "^"

_TRIM = re.compile(r"^[\W_]+|[\W_]+$")


def plain(word: bytes) -> str:
    """A word without marks at its ends; empty without letters or digits."""
    return _TRIM.sub("", word.decode("utf-8", "replace").lower())


def spelled(word: str) -> list[str]:
    """The steps of a plain word: growing prefixes, then the whole with an end mark."""
    return [*dict.fromkeys(word[:n] for n in STEPS), word + "$"] if word else []


def paired(before: str, word: str) -> str:
    """The last step: the word with the one before it."""
    return f"{before or START} {word}$"


def _parent() -> F.Column:
    """The step before: of a pair its word; else the prefix that a key extends, empty for the first."""
    key, last = F.col("key"), max(STEPS)
    whole = F.expr(f"substring(key, 1, least(length(key) - 1, {last}))")
    return F.when(_is_pair(), F.expr("substring_index(key, ' ', -1)")).when(key.endswith("$"), whole).otherwise(F.when(F.length(key) > min(STEPS), F.expr("substring(key, 1, length(key) - 1)")).otherwise(F.lit("")))


def _is_pair() -> F.Column:
    return F.col("key").contains(" ")


_SUMS = ("toxic", "ordinary", "toxic_docs", "ordinary_docs")


def _count_steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, toxic, ordinary, toxic_docs, ordinary_docs) sums of each run of texts; the empty key has all."""
    worker_table("toxic-counts", bool)  # empties what other operators keep
    for batch in batches:
        texts, labels = bytes_of(batch.column(0)), np.array(batch.column(1).to_pylist(), np.int64)
        for a, b in small_runs(texts, 2 << 20):
            raw, words, keys = WordIndex({BREAK.strip(): 0}), WordIndex({"": 0}), WordIndex()
            numbers = raw.numbers((BREAK + BREAK.join(texts[a:b])).lower().split())
            word = np.concatenate([[0], words.numbers([plain(w) for w in raw.take_fresh()])])[numbers]
            names = list(words)
            steps = [spelled(w) for w in names]
            count = np.fromiter(map(len, steps), np.int64, len(steps))
            step = keys.numbers([k for s in steps for k in s])
            owner = np.cumsum(numbers == 0) - 1
            real = (word > 0) | (numbers == 0)
            word, owner = word[real], owner[real]
            pair, place = np.unique((word[:-1] * len(names) + word[1:])[word[1:] > 0], return_inverse=True)
            keys_of_pairs = [paired(names[p // len(names)], names[p % len(names)]) for p in pair.tolist()]
            used = np.concatenate([step[gather_ranges((np.cumsum(count) - count)[word], count[word])], len(keys) + place])
            owner = np.concatenate([np.repeat(owner, count[word]), owner[1:][word[1:] > 0]])
            size, kind = len(keys) + len(pair), labels[a:b] != 0
            docs = np.unique(owner * size + used)
            columns = []
            for of, at in ((kind[owner], used), (kind[docs // size] if size else kind[:0], docs % max(size, 1))):
                columns += [np.bincount(at[of], minlength=size), np.bincount(at[~of], minlength=size)]
            whole = (int(columns[0].sum()), int(columns[1].sum()), int(kind.sum()), int((~kind).sum()))
            columns = [pa.array(np.append(c, w)) for c, w in zip(columns, whole, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([*keys, *keys_of_pairs, ""], pa.string()), *columns], names=["key", *_SUMS])


def _discounts(counts: DataFrame, column: str) -> F.Column:
    """Modified Kneser-Ney: a discount for counts of one, two, and three or more, from the counts of counts."""
    n = dict(counts.where(F.col(column).between(1, 4)).groupBy(column).count().collect())
    n1, n2, n3, n4 = (n.get(i, 0) + 1 for i in (1, 2, 3, 4))
    y = n1 / (n1 + 2 * n2)
    d = [min(max(v, 0.1), k - 0.05) for k, v in ((1, 1 - 2 * y * n2 / n1), (2, 2 - 3 * y * n3 / n2), (3, 3 - 4 * y * n4 / n3))]
    c = F.col(column)
    return F.when(c == 0, 0.0).when(c == 1, d[0]).when(c == 2, d[1]).otherwise(d[2])


def _xlogx(share: F.Column, expected: F.Column) -> F.Column:
    return F.when(share > 0, share * F.log(share / expected)).otherwise(0.0)


def _continuations(counts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(key, n) of prefixes and words: in how many different words; and of the words before others: in how many different pairs."""
    words = counts.where(F.col("key").endswith("$") & ~_is_pair()).select("key", F.expr("substring(key, 1, length(key) - 1)").alias("word"))
    steps = F.array_distinct(F.array(F.lit(""), *(F.substring("word", 1, n) for n in STEPS), F.col("key")))
    return words.select(F.explode(steps).alias("key")).groupBy("key").agg(F.count("*").alias("n")), counts.where(_is_pair()).groupBy(F.substring_index("key", " ", 1).alias("before")).agg(F.count("*").alias("n"))


def model_table(labelled: DataFrame, evidence: float = EVIDENCE, shared: float = SHARED) -> DataFrame:
    """(key, llr): the log of P(key | the step before, toxic) / P(key | the step before, ordinary).

    labelled: text, toxic. Rare expressions, whose documents of either class differ by
    less than ``evidence`` (a log-likelihood ratio) from what the documents of the step
    before suggest, are left to the shared counts alone: there the ratio is one, and they
    have no row.
    """
    found = labelled.select("text", "toxic").mapInArrow(_count_steps, "key string, " + ", ".join(f"{c} long" for c in _SUMS))
    counts = stored(found.groupBy("key").agg(*(F.sum(c).alias(c) for c in _SUMS)).withColumn("parent", _parent()), "toxic-counts")
    kinds = ("toxic", "ordinary")
    cut = counts.where("key <> ''").select("*", *(_discounts(counts, k).alias(f"d_{k}") for k in kinds))
    holder = counts.where(~_is_pair()).select(F.col("key").alias("parent"), *(F.col(f"{k}_docs").alias(f"held_{k}") for k in kinds))
    joined = cut.join(holder, "parent")
    expected = {k: F.col(f"held_{k}") for k in kinds}
    docs = F.col("toxic_docs") + F.col("ordinary_docs")
    differs = 2 * sum(_xlogx(F.col(f"{k}_docs"), docs * expected[k] / (expected["toxic"] + expected["ordinary"])) for k in kinds)
    told = stored(joined.where(differs >= evidence), "toxic-steps")
    above = cut.groupBy("parent").agg(*(F.sum(k).alias(f"all_{k}") for k in kinds), *(F.sum(f"d_{k}").alias(f"free_{k}") for k in kinds))
    under, beside = _continuations(counts)
    own = told.join(above, "parent").join(under.withColumnRenamed("n", "n_own"), "key", "left").join(under.select(F.col("key").alias("parent"), F.col("n").alias("n_parent")), "parent", "left")
    own = own.withColumn("before", F.substring_index("key", " ", 1)).join(beside.withColumnRenamed("n", "n_before"), "before", "left")
    pooled = F.when(_is_pair(), F.col("n_before") / F.lit(max(counts.where(_is_pair()).count(), 1))).otherwise(F.col("n_own") / F.col("n_parent"))

    def probability(k: str) -> F.Column:
        mine = (F.col(k) - F.col(f"d_{k}") + F.col(f"free_{k}") * pooled) / F.col(f"all_{k}")
        return F.when(F.col(f"all_{k}") > 0, (1 - shared) * mine + shared * pooled).otherwise(pooled)

    return own.select("key", F.log(probability("toxic") / probability("ordinary")).alias("llr"))


@dataclass
class ToxicityModel:
    """Step ratios as sorted arrays (bounded by the labelled sample), and the calibration."""

    keys: np.ndarray
    ratios: np.ndarray
    #: Words that are the first, and the second, of a pair, numbered; the pairs as first * len(after) + second, in order, and their ratios.
    before: dict[str, int] = field(default_factory=dict)
    after: dict[str, int] = field(default_factory=dict)
    pairs: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    pair_ratios: np.ndarray = field(default_factory=lambda: np.zeros(0))
    slope: float = 1.0
    offset: float = 0.0

    @classmethod
    def of(cls, rows: list[tuple[str, float]]) -> ToxicityModel:
        """From the rows of ``model_table``."""
        single = sorted((xxhash.xxh64_intdigest(k), v) for k, v in rows if " " not in k)
        ends = [(*k[:-1].split(" "), v) for k, v in rows if " " in k]
        before = {w: i for i, w in enumerate(sorted({a for a, *_ in ends}))}
        after = {w: i for i, w in enumerate(sorted({b for _, b, _ in ends}))}
        pairs = sorted((before[a] * len(after) + after[b], v) for a, b, v in ends)
        if START in before:
            before[""] = before.pop(START)
        return cls(np.array([k for k, _ in single], np.uint64), np.array([v for _, v in single], np.float64), before, after, np.array([k for k, _ in pairs], np.int64), np.array([v for _, v in pairs], np.float64))

    def word_ratios(self, words: list[str]) -> np.ndarray:
        """The sum over the steps of each plain word."""
        steps = [spelled(w) for w in words]
        flat = np.fromiter((xxhash.xxh64_intdigest(k) for s in steps for k in s), np.uint64)
        at = np.minimum(np.searchsorted(self.keys, flat), max(len(self.keys) - 1, 0))
        known = self.keys[at] == flat if len(self.keys) else np.zeros(len(flat), bool)
        values = np.where(known, self.ratios[at] if len(self.keys) else 0, 0.0)
        return np.bincount(np.repeat(np.arange(len(steps)), list(map(len, steps))), values, len(steps))

    def score(self, evidence: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * evidence + self.offset, -500, 500)))


class _Scorer:
    """A worker's words and their ratios."""

    def __init__(self, model: ToxicityModel) -> None:
        self.model = model
        self._forget()

    def _forget(self) -> None:
        self.words, self.ratios = WordIndex({BREAK.strip(): 0}), GrowingRows(np.float64)
        self.real, self.before, self.after = GrowingRows(bool), GrowingRows(np.int32), GrowingRows(np.int32)
        self._add([""], [True])

    def _add(self, names: list[str], real: list[bool]) -> None:
        self.ratios.extend(self.model.word_ratios(names))
        self.real.extend(np.array(real, bool))
        for of, part in ((self.before, self.model.before), (self.after, self.model.after)):
            of.extend(np.fromiter((part.get(n, -1) for n in names), np.int32, len(names)))

    def evidence(self, texts: list[bytes]) -> np.ndarray:
        """The difference of the two log-likelihoods of each text, by its number of words; zero without words."""
        if len(self.words) > WORD_LIMIT:
            self._forget()
        numbers = self.words.numbers((BREAK + BREAK.join(texts)).lower().split())
        if fresh := self.words.take_fresh():
            names = [plain(w) for w in fresh]
            self._add(names, [n != "" for n in names])
        owner = np.cumsum(numbers == 0) - 1
        size = np.bincount(owner, numbers > 0, len(texts))
        real = self.real.data[numbers]
        numbers, owner = numbers[real], owner[real]
        value = self.ratios.data[numbers]
        if len(self.model.pairs):
            first, second = self.before.data[numbers[:-1]].astype(np.int64), self.after.data[numbers[1:]]
            both = np.flatnonzero((first >= 0) & (second >= 0) & (numbers[1:] > 0))
            pair = first[both] * len(self.model.after) + second[both]
            at = np.minimum(np.searchsorted(self.model.pairs, pair), len(self.model.pairs) - 1)
            hit = self.model.pairs[at] == pair
            value[1 + both[hit]] += self.model.pair_ratios[at[hit]]
        return np.bincount(owner, value, len(texts)) / np.maximum(size, 1)


def _evidence_udf(model: Broadcast):
    key = f"toxicity-{uuid.uuid4().hex}"

    @F.arrow_udf(T.DoubleType())
    def evidence(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        held = model.value
        scorer = worker_table(key, lambda: _Scorer(held))
        for column in batches:
            texts = bytes_of(column)
            parts = [scorer.evidence(texts[a:b]) for a, b in small_runs(texts)]
            yield pa.array(np.concatenate(parts) if parts else np.zeros(0))

    return evidence


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset by Newton's method, with a weak pull towards zero."""
    if not len(x) or y.min() == y.max():
        return 50.0, math.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)) if len(y) else -2.0
    design = np.stack([x / (scale := x.std() or 1.0), np.ones(len(x))], 1)
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-design @ w))
        step = np.linalg.solve((design.T * (p * (1 - p))) @ design + 1e-3 * np.eye(2), design.T @ (y - p) - 1e-3 * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0] / scale), float(w[1])


def fit(documents: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "toxic", max_labelled: int = MAX_LABELLED, evidence: float = EVIDENCE) -> ToxicityModel:
    """A model from the labelled rows given.

    Four fifths of them (by hash) give the counts, the rest the calibration. At most
    about ``max_labelled`` rows are used, so that the model is of bounded size; which
    ones is decided by a hash of the doc_id. Rows with a null id or label are left out.

    A null text counts as empty. Rows of one id that repeat are all counted; of several
    labels of an id the largest holds. Long texts are read whole. Without labels, or
    without documents, the model has no expressions and calls nothing toxic.
    """
    spark = documents.sparkSession
    known = labels.select(F.col(id_column).alias("_id"), F.col(label_column).cast("int").alias("toxic")).where("_id IS NOT NULL AND toxic IS NOT NULL").groupBy("_id").agg(F.max("toxic").alias("toxic"))
    share = min(1.0, max_labelled / max(known.count(), 1))
    chosen = known.where(F.pmod(F.xxhash64("_id"), F.lit(1_000_000)) < share * 1_000_000)
    text = documents.select(F.col(id_column).alias("_id"), text_of(text_column).alias("text"))
    # max_labelled rows of an id and a label at most.
    sample = text.join(F.broadcast(chosen), "_id").withColumn("held", F.pmod(F.xxhash64("_id", F.lit(1)), F.lit(5)) == 0)
    rows = model_table(sample.where("NOT held"), evidence).collect()
    model = ToxicityModel.of([(r[0], r[1]) for r in rows])
    told = sample.where("held").select("toxic", _evidence_udf(spark.sparkContext.broadcast(model))("text").alias("x")).collect()
    model.slope, model.offset = _logistic(np.array([r[1] for r in told]), np.array([r[0] for r in told], np.float64))
    return model


def with_score(documents: DataFrame, model: ToxicityModel, text_column: str = "text", score_column: str = "score") -> DataFrame:
    """``documents`` with a score from 0 to 1 of every whole text; null texts count as empty.

    An empty text has no evidence either way and gets what the calibration gives
    there. Repeated rows get equal scores; long texts are scored whole; an empty table
    gives no rows. All columns pass through; a column named ``score_column`` is replaced.
    A score of 0.5 counts as toxic.
    """
    held = documents.sparkSession.sparkContext.broadcast(model)
    x = _evidence_udf(held)(text_of(text_column)) * F.lit(model.slope) + F.lit(model.offset)
    return documents.withColumn(score_column, 1 / (1 + F.exp(-x)))


def held_out(id_column: str = "doc_id") -> F.Column:
    """Rows whose label must not be learned from: a fifth, by the crc32 of the id's digits; null for a null id."""
    return F.crc32(F.col(id_column).cast("string").cast("binary")) % 5 == 0


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract of op6: a score of every document from a model that has not seen a fifth of the labels."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    model = fit(documents, labels.where(~held_out()))
    scored = with_score(documents, model)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(documents: DataFrame, model: ToxicityModel, text_column: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of ``documents`` that score less than ``threshold``; nulls, ties and other cases as in ``with_score``."""
    held = documents.sparkSession.sparkContext.broadcast(model)
    x = _evidence_udf(held)(text_of(text_column)) * F.lit(model.slope) + F.lit(model.offset)
    return documents.where(1 / (1 + F.exp(-x)) < threshold)
