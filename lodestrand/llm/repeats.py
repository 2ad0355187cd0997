"""Passages that occur more than once, as bytes: found by suffix arrays of the places where texts can repeat, and removed."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bytes_of, own_names, stored, text_of
from .suffixes import SuffixArray, maximal_repeats

MIN_LENGTH = 200
#: Bytes of the anchor that every window of MIN_LENGTH has; windows that are equal have equal anchors.
GRAM = 64
#: Bytes of text that a worker looks for anchors in at one time.
CHUNK = 1 << 19
#: Bytes of passages in one suffix array.
ARRAY_BYTES = 1 << 20
#: Different passages around one anchor that go into one suffix array; see ``_window_covers``.
MOST_PASSAGES = 4096

_RNG = np.random.default_rng(20240229)
_LETTER = _RNG.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15  # odd: it has an inverse modulo 2 ** 64


def _powers(base: int, n: int) -> np.ndarray:
    return np.concatenate([np.ones(1, np.uint64), np.multiply.accumulate(np.full(n - 1, base, np.uint64))])


def _gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A hash of the ``gram`` bytes from each place on."""
    n = len(data)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_LETTER[data] * _powers(_BASE, n))])
    h = (total[gram:] - total[:-gram]) * _powers(pow(_BASE, -1, 2**64), n - gram + 1)
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` values in a row."""
    span, low = 1, values
    while 2 * span <= width:
        low = np.minimum(low[: len(low) - span], low[span:])
        span *= 2
    return low if span == width else np.minimum(low[: len(values) - width + 1], low[width - span :])


def anchors(data: np.ndarray, piece: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first window, last window, hash) for each run of windows of ``length`` bytes with one anchor.

    The anchor is the gram with the least hash, the leftmost of these, so it depends on
    the window's bytes alone. piece: the number of the text each byte belongs to; windows
    over two texts do not count.
    """
    n = len(data) - length + 1
    if n < 1:
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64),)
    hashes = _gram_hashes(data, gram)
    low = np.uint64(len(hashes).bit_length())
    ranked = ((hashes >> low) << low) | np.arange(len(hashes), dtype=np.uint64)
    anchor = (_sliding_min(ranked, length - gram + 1) & ((np.uint64(1) << low) - np.uint64(1))).astype(np.int64)
    within = piece[:n] == piece[length - 1 :]
    anchor[~within] = -1
    first = np.flatnonzero(np.diff(anchor, prepend=-2))
    last = np.append(first[1:], n) - 1
    some = anchor[first] >= 0
    return first[some], last[some], hashes[anchor[first[some]]]


def _pieces(texts: list[bytes], length: int, chunk: int) -> Iterator[list[tuple[int, int, bytes]]]:
    """Lists of (text's number, offset, bytes) of some ``chunk`` bytes; long texts in pieces that share length - 1 bytes."""
    held, size = [], 0
    for i, text in enumerate(texts):
        if len(text) < length:
            continue
        for at in range(0, len(text) - length + 1, chunk):
            part = text[at : at + chunk + length - 1]
            held.append((i, at, part))
            size += len(part)
            if size >= chunk:
                yield held
                held, size = [], 0
    if held:
        yield held


def _keyed(text: Column) -> dict[str, Column]:
    """128 bits that stand for a text."""
    return {"k1": F.xxhash64(text), "k2": F.xxhash64(F.lit(1), text)}


def _runs(length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for pieces in _pieces(bytes_of(batch.column(2)), length, CHUNK):
                sizes = [len(p) for *_, p in pieces]
                data = np.frombuffer(b"".join(p for *_, p in pieces), np.uint8)
                number = np.repeat(np.arange(len(pieces)), sizes)
                first, last, hashes = anchors(data, number, length, gram)
                own = number[first]
                shift = np.array([at for _, at, _ in pieces]) - (np.cumsum(sizes) - sizes)
                rows = pa.array(np.array([i for i, *_ in pieces])[own])
                yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), pa.array(hashes.view(np.int64)), pa.array(first + shift[own]), pa.array((last - first + 1).astype(np.int32))], names=["k1", "k2", "h", "at", "windows"])

    return run


def _flat(batch: pa.RecordBatch, column: int, fields: int) -> tuple[list[bytes], list[list], list[int]]:
    """Texts of a batch, and its lists of places as columns with the text of each."""
    places = batch.column(column)
    rows = np.repeat(np.arange(batch.num_rows), places.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)).tolist()
    return bytes_of(batch.column(2)), [places.flatten().field(i).to_pylist() for i in range(fields)], rows


def _digests(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, (h, at, windows), rows = _flat(batch, 3, 3)
            both = b"".join(xxhash.xxh3_128_digest(texts[i][a : a + n + length - 1]) for i, a, n in zip(rows, at, windows, strict=True))
            c = np.frombuffer(both, "<i8").reshape(-1, 2)
            own = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(own), batch.column(1).take(own), pa.array(h, pa.int64()), pa.array(at, pa.int64()), pa.array(windows, pa.int32()), pa.array(c[:, 0].copy()), pa.array(c[:, 1].copy())], names=["k1", "k2", "h", "at", "windows", "c1", "c2"])

    return run


def _extracts(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, (array, h, c1, c2, again, at, windows), rows = _flat(batch, 3, 7)
            step = 8192  # passages in one batch
            for x in range(0, len(rows), step):
                part = slice(x, x + step)
                found = [texts[i][a : a + n + length - 1] for i, a, n in zip(rows[part], at[part], windows[part], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(c[part], t) for c, t in ((array, pa.int32()), (h, pa.int64()), (c1, pa.int64()), (c2, pa.int64()), (again, pa.bool_()))] + [pa.array(found, pa.binary())], names=["array", "h", "c1", "c2", "again", "passage"])

    return run


def _with_text(keyed: DataFrame, places: DataFrame) -> DataFrame:
    """(k1, k2, text, places) of the texts that ``places`` (k1, k2, places) has; copies of a text give it once."""
    one = keyed.groupBy("k1", "k2").agg(F.min("id").alias("_one"))
    return keyed.join(places.join(one, ["k1", "k2"]), ["k1", "k2"]).where(F.col("id").eqNullSafe(F.col("_one"))).select("k1", "k2", "text", "places")


def occurrences(keyed: DataFrame, length: int = MIN_LENGTH, gram: int = GRAM) -> DataFrame:
    """(k1, k2, h, at, windows, c1, c2): the places of distinct texts that can repeat.

    keyed: k1, k2, id and text. A window that occurs at two places has the same anchor at
    both, so only runs of windows are kept whose anchor's hash h is met at two places.
    k1 and k2 stand for the text, at is the first window's place in it, c1 and c2 stand for
    the passage, which reaches from the first window to the end of the last.
    """
    runs = stored(keyed.select("k1", "k2", "text").mapInArrow(_runs(length, gram), "k1 long, k2 long, h long, at long, windows int"), "anchor-runs")
    place = F.xxhash64("k1", "k2", "at")
    met = stored(runs.groupBy("h").agg(F.min(place).alias("a"), F.max(place).alias("b")).where("a < b").select("h"), "anchors-met-again")
    places = runs.join(met, "h").groupBy("k1", "k2").agg(F.collect_set(F.struct("h", "at", "windows")).alias("places"))
    return stored(_with_text(keyed, places).mapInArrow(_digests(length), "k1 long, k2 long, h long, at long, windows int, c1 long, c2 long"), "occurrences")


def passages(keyed: DataFrame, found: DataFrame, length: int = MIN_LENGTH, array_bytes: int = ARRAY_BYTES, most: int = MOST_PASSAGES) -> DataFrame:
    """(array, h, c1, c2, again, passage): the bytes of each different passage once, for anchors that are met with two occurrences.

    array: which suffix array it goes to; null for anchors with more than ``most`` different
    passages. again: it occurs at two places.
    """
    place = F.struct("k1", "k2", "at", "windows")
    once = stored(found.groupBy("h", "c1", "c2").agg(F.min(place).alias("one"), (F.min(place) < F.max(place)).alias("again")), "distinct-passages")
    sums = once.groupBy("h").agg(F.count("*").alias("n"), F.max("again").alias("any"), F.sum(F.col("one.windows") + length - 1).alias("bytes")).where("n > 1 OR any")
    sums = stored(sums.select("h", "n", "bytes"), "passages-of-anchors")
    size = sums.where(F.col("n") <= most).agg(F.sum("bytes")).first()[0] or 0
    arrays = max(1, math.ceil(size / array_bytes))
    array = F.when(F.col("n") <= most, F.pmod(F.xxhash64("h"), F.lit(arrays)).cast("int"))
    wanted = once.join(sums, "h").select("one.k1", "one.k2", F.struct(array.alias("array"), "h", "c1", "c2", "again", "one.at", "one.windows").alias("place"))
    places = wanted.groupBy("k1", "k2").agg(F.collect_list("place").alias("places"))
    return stored(_with_text(keyed, places).mapInArrow(_extracts(length), "array int, h long, c1 long, c2 long, again boolean, passage binary"), "passages")


def _array_of(table: pa.Table, length: int) -> tuple[SuffixArray, np.ndarray, np.ndarray]:
    """The suffix array of a group's passages, its maximal repeats and what they cover; a passage met twice is one too."""
    texts = table["passage"].to_pylist()
    suffixes = SuffixArray(texts, length)
    groups, covered = maximal_repeats(suffixes)
    again = np.flatnonzero(table["again"].to_numpy(zero_copy_only=False))
    rank = np.empty(len(suffixes.data), np.int64)
    rank[suffixes.order] = np.arange(len(suffixes.order))
    whole = rank[suffixes.starts[again]]
    sizes = suffixes.left[suffixes.starts[again]]
    covered[whole] = sizes
    known = {(a, b, n) for a, b, n in groups.tolist()}
    own = np.array([(r, r, n) for r, n in zip(whole.tolist(), sizes.tolist(), strict=True) if (r, r, n) not in known], np.int64).reshape(-1, 3)
    return suffixes, np.concatenate([groups, own]), covered


def _merged(owner: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranges of each owner, those that touch or overlap put together."""
    order = np.lexsort((start, owner))
    owner, start, end = owner[order], start[order], end[order]
    reach = int(end.max(initial=0)) + 1
    furthest = np.maximum.accumulate(end + owner * (reach + 1))
    new = np.concatenate([[True], start[1:] + owner[1:] * (reach + 1) > furthest[:-1]]) if len(start) else np.zeros(0, bool)
    at = np.flatnonzero(new)
    last = np.append(at[1:], len(start)) - 1 if len(at) else at
    return owner[at], start[at], furthest[last] - owner[at] * (reach + 1)


def _covers(length: int):
    def run(table: pa.Table) -> pa.Table:
        suffixes, _, covered = _array_of(table, length)
        some = np.flatnonzero(covered)
        places = suffixes.order[some]
        owner = suffixes.owner[places]
        start = places - suffixes.starts[owner]
        owner, start, end = _merged(owner, start, start + covered[some])
        rows = pa.array(owner)
        return pa.table({"h": table["h"].take(rows), "c1": table["c1"].take(rows), "c2": table["c2"].take(rows), "from": pa.array(start), "to": pa.array(end)})

    return run


def _window_hashes(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, passage in enumerate(batch.column(3).to_pylist()):
                n = len(passage) - length + 1
                found = np.frombuffer(b"".join(xxhash.xxh3_128_digest(passage[j : j + length]) for j in range(n)), "<i8").reshape(-1, 2)
                same = pa.array(np.full(n, i))
                yield pa.RecordBatch.from_arrays([*(batch.column(k).take(same) for k in range(3)), pa.array(np.arange(n)), pa.array(found[:, 0].copy()), pa.array(found[:, 1].copy())], names=["h", "c1", "c2", "from", "w1", "w2"])

    return run


def _window_covers(hot: DataFrame, length: int) -> DataFrame:
    """The same covers for anchors with more passages than one array takes: each window by itself, counted before the shuffle."""
    windows = stored(hot.select("h", "c1", "c2", "passage").mapInArrow(_window_hashes(length), "h long, c1 long, c2 long, from long, w1 long, w2 long"), "windows")
    place = F.xxhash64("c1", "c2", "from")
    met = stored(windows.groupBy("w1", "w2").agg(F.min(place).alias("a"), F.max(place).alias("b")).where("a < b").select("w1", "w2"), "windows-met-again")
    shared = windows.join(met, ["w1", "w2"]).select("h", "c1", "c2", "from", (F.col("from") + length).alias("to"))
    whole = hot.where("again").select("h", "c1", "c2", F.lit(0).cast("long").alias("from"), F.length("passage").cast("long").alias("to"))
    return shared.unionByName(whole)


def repeated_ranges(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", length: int = MIN_LENGTH, gram: int = GRAM, array_bytes: int = ARRAY_BYTES, most: int = MOST_PASSAGES) -> DataFrame:
    """(k1, k2, copies, ranges): for each different text its rows, and the byte ranges that repeats of ``length`` bytes cover.

    k1 and k2 are ``xxhash64`` of the text and of (1, text). ranges: (from, to) as they
    come from the repeats around each anchor; they may overlap. A text of two rows or more
    is its own repeat and has all of itself as a range, if it is long enough. Texts
    without ranges are left out.

    Nulls: a null text is the empty one, a null id is an id. Repeated rows are copies. Texts
    shorter than ``length`` have no repeats. A long text is read in pieces that overlap.
    """
    text = text_of(text_column)
    keyed = documents.select(F.col(id_column).alias("id"), text.alias("text")).withColumns(_keyed(F.col("text")))
    found = occurrences(keyed, length, gram)
    once = passages(keyed, found, length, array_bytes, most)
    by_array = once.where("array IS NOT NULL").select("array", "h", "c1", "c2", "passage", "again").groupBy("array").applyInArrow(_covers(length), "h long, c1 long, c2 long, from long, to long")
    covers = stored(by_array.unionByName(_window_covers(once.where("array IS NULL"), length)), "covers")
    near = found.select("k1", "k2", "h", "c1", "c2", "at").join(covers, ["h", "c1", "c2"]).select("k1", "k2", (F.col("at") + F.col("from")).alias("from"), (F.col("at") + F.col("to")).alias("to"))
    ranges = near.groupBy("k1", "k2").agg(F.collect_set(F.struct("from", "to")).alias("ranges"))
    copies = keyed.groupBy("k1", "k2").agg(F.count("*").alias("copies"), F.max(F.octet_length("text")).cast("long").alias("n")).where(F.col("copies") > 1).where(F.col("n") >= length)
    both = ranges.join(copies, ["k1", "k2"], "full")
    whole = F.array(F.struct(F.lit(0).cast("long").alias("from"), F.col("n").alias("to")))
    return both.select("k1", "k2", F.coalesce("copies", F.lit(1)).alias("copies"), F.when(F.col("copies") > 1, whole).otherwise(F.col("ranges")).alias("ranges"))


def repeat_groups(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", length: int = MIN_LENGTH, gram: int = GRAM, array_bytes: int = ARRAY_BYTES) -> DataFrame:
    """(array, group, n_bytes, k1, k2, at): every occurrence of every maximal repeat in the passages, at: its first byte in the text k1, k2.

    A repeat is looked at as far as the windows around one anchor reach, up to
    2 * length - gram bytes; a longer one is told as several groups that overlap, one for
    each anchor in it. Copies of a whole text are one occurrence; see ``repeated_ranges``
    for their number, and for nulls and edge cases. All anchors go to arrays here, so this
    is for looking at repeats, not for anchors with very many passages.
    """
    keyed = documents.select(F.col(id_column).alias("id"), text_of(text_column).alias("text")).withColumns(_keyed(F.col("text")))
    found = occurrences(keyed, length, gram)
    once = passages(keyed, found, length, array_bytes, 2**31 - 1)

    def run(table: pa.Table) -> pa.Table:
        suffixes, groups, _ = _array_of(table, length)
        sizes = groups[:, 1] - groups[:, 0] + 1
        number = np.repeat(np.arange(len(groups)), sizes)
        ranks = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(groups[:, 0], sizes)
        places = suffixes.order[ranks]
        owner = suffixes.owner[places]
        rows = pa.array(owner)
        return pa.table({"array": table["array"].take(rows), "group": pa.array(number), "n_bytes": pa.array(groups[number, 2]), "h": table["h"].take(rows), "c1": table["c1"].take(rows), "c2": table["c2"].take(rows), "from": pa.array(places - suffixes.starts[owner])})

    members = once.select("array", "h", "c1", "c2", "passage", "again").groupBy("array").applyInArrow(run, "array int, group long, n_bytes long, h long, c1 long, c2 long, from long")
    return members.join(found.select("k1", "k2", "h", "c1", "c2", "at"), ["h", "c1", "c2"]).select("array", "group", "n_bytes", "k1", "k2", (F.col("at") + F.col("from")).alias("at")).distinct()


_TOLD = T.StructType().add("kept", "binary").add("n_bytes", "long").add("n_removed", "long").add("n_spans", "long")
_RESULT = pa.struct([("kept", pa.binary()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64())])


def _without(text: bytes, ranges: list[dict] | None) -> tuple[bytes, int, int, int]:
    kept, at, spans = [], 0, 0
    end = -1
    for r in sorted(ranges or (), key=lambda r: r["from"]):
        if r["from"] > end:
            kept.append(text[at : r["from"]])
            spans += 1
            end = at = r["to"]
        elif r["to"] > end:
            end = at = r["to"]
    kept.append(text[at:])
    left = b"".join(kept)
    return left, len(text), len(text) - len(left), spans


@F.arrow_udf(_TOLD)
def _cut(columns: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for texts, ranges in columns:
        rows = [_without(t, r) for t, r in zip(bytes_of(texts), ranges.to_pylist(), strict=True)]
        yield pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _RESULT, strict=True)] if rows else [pa.array([], f.type) for f in _RESULT], fields=list(_RESULT))


def without_repeats(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", report: str = "repeats", **ways) -> DataFrame:
    """Every row of ``documents`` with a struct ``report``: kept (the bytes that no repeat covers), n_bytes, n_removed, n_spans.

    A byte goes if a string of ``length`` bytes that covers it starts at another place
    too, in the same text or another; overlaps count, and all is judged on the texts as
    they are. Kept bytes may cut a character, so they are binary.

    Method: equal windows share an anchor, the least hash of their grams. Passages around
    anchors that are met twice are gathered by anchor, each different one once, and put in
    suffix arrays of some ``array_bytes``. A stack scan of the common prefixes gives the
    tree of intervals, those whose left bytes differ are the maximal repeats, and all
    suffixes of such an interval are its occurrences. Anchors with more than ``most``
    different passages are counted window by window instead, with the same result.

    See ``repeated_ranges`` for nulls, copies, short and long texts. No rows give no rows.
    Other columns pass through; one named ``report`` is replaced.
    """
    k1, k2, own = own_names(documents, "_repeat_k1", "_repeat_k2", "_repeat_ranges")
    ranges = repeated_ranges(documents, id_column, text_column, **ways).select(F.col("k1").alias(k1), F.col("k2").alias(k2), F.col("ranges").alias(own))
    text = text_of(text_column)
    joined = documents.withColumns(dict(zip((k1, k2), _keyed(text).values(), strict=True))).join(ranges, [k1, k2], "left")
    return joined.withColumn(report, _cut(text, F.col(own))).drop(k1, k2, own)


def op11_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract of op11: what repeats of 200 bytes leave of each document.

    Runs jobs while it is built: it stores the anchors, the passages and what repeats cover.
    """
    told = without_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return told.select("doc_id", F.col("repeats.n_bytes"), F.col("repeats.n_removed"), F.col("repeats.n_spans"), F.sha2("repeats.kept", 256).alias("kept_sha256"))


ORACLE_SQL = r"""
WITH texts AS (SELECT row_number() OVER () AS r, doc_id, encode(coalesce(text, '')) AS b FROM documents),
starts AS (SELECT r, doc_id, unnest(range(1, octet_length(b) - 198)) AS p, b FROM texts WHERE octet_length(b) >= 200),
windows AS (SELECT r, p, md5(array_slice(b, p, p + 199)) AS w FROM starts),
again AS (SELECT w FROM windows GROUP BY w HAVING count(*) > 1),
hits AS (SELECT r, p, p - coalesce(lag(p) OVER (PARTITION BY r ORDER BY p), -1000) > 200 AS fresh FROM windows WHERE w IN (SELECT w FROM again)),
runs AS (SELECT *, sum(fresh::INT) OVER (PARTITION BY r ORDER BY p) AS k FROM hits),
spans AS (SELECT r, k, min(p) AS a, max(p) + 200 AS z FROM runs GROUP BY r, k),
edges AS (SELECT r, a, z, lag(z, 1, 1) OVER (PARTITION BY r ORDER BY a) AS open FROM spans),
cuts AS (SELECT r, sum(z - a)::BIGINT AS n_removed, count(*) AS n_spans, max(z) AS last, list({'a': open, 'z': a - 1} ORDER BY a) AS kept FROM edges GROUP BY r),
parts AS (SELECT doc_id, b, n_removed, n_spans, list_concat(coalesce(kept, []), [{'a': coalesce(last, 1), 'z': octet_length(b)}]) AS kept FROM texts LEFT JOIN cuts USING (r))
SELECT doc_id, octet_length(b) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(array_to_string(list_transform(kept, lambda x: CASE WHEN x.z < x.a THEN '' ELSE hex(array_slice(b, x.a, x.z)) END), ''))) AS kept_sha256
FROM parts
"""
