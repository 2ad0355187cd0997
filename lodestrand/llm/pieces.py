"""Sampled segmentations over the piece lattice of a SentencePiece model, and lossless decoding."""

from __future__ import annotations

import itertools
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import GrowingRows, WordIndex, bytes_of, gather_ranges, small_runs, sums_of_runs, text_of, worker_table

MODEL = "piece_bpe_32k.model"
#: Sharpness: 0 makes all segmentations equally likely; large values leave only the best one.
ALPHA = 1.0
SEED = 0
#: Edges of word lattices that a worker keeps, of nine bytes each (results do not depend on it).
EDGE_LIMIT = 3_000_000
#: Characters whose lattices are worked on at one time (results do not depend on it).
RUN_CHARS = 1 << 17
#: Units of more characters are filtered one by one, and the last so many units of a run are walked back one by one (the way does not matter to the draws).
LONG_UNIT = 200
FEW = 4
#: Bytes of texts (or ids) whose results go back to Spark at one time.
SLICE_BYTES = 1 << 21

#: No piece has anything but these signs before a space sign or across a line feed, so
#: the lattice of a text falls apart into these units.
UNITS = re.compile(r" +[^ \n]*|[^ \n]+|\n")
_SPACE_SIGN = 0x2581
_NONE = 0x110000  # stands for a character without a piece


def model_path(name: str = MODEL) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Vocabulary:
    """The pieces' bytes and log weights.

    A model of merges has ranks, not probabilities: a piece of rank r weighs 1 / (r + 3),
    as words by frequency do, and a character without a piece weighs as its byte pieces.
    """

    def __init__(self, path: str) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        self.byte_id = np.zeros(256, np.int32)
        self.bytes: list[bytes] = []
        ranked = sorted((i for i in range(size) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))), key=lambda i: -model.get_score(i))
        self.ranked, self.names = ranked, {i: model.id_to_piece(i) for i in ranked}
        self.weight = np.full(size, -np.log(size + 3.0))
        self.weight[ranked] = -np.log(np.arange(len(ranked)) + 3.0)
        for i in range(size):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte_id[int(piece[3:5], 16)] = i
                self.bytes.append(bytes([int(piece[3:5], 16)]))
            else:
                self.bytes.append(b"" if model.is_control(i) or model.is_unknown(i) else piece.replace(chr(_SPACE_SIGN), " ").encode())
        self.length = np.array(list(map(len, self.bytes)), np.int64)
        self.blob = np.frombuffer(b"".join(self.bytes), np.uint8)
        self.offset = np.cumsum(self.length) - self.length

    def decode(self, ids: np.ndarray) -> bytes:
        """The text of a row's ids, without the space that went before it."""
        return self.blob[gather_ranges(self.offset[ids], self.length[ids])].tobytes()[1:]


class Trie:
    """The pieces by their characters, in arrays."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        steps: dict[int, int] = {}
        piece_at = [-1]
        for i in vocabulary.ranked:
            node = 0
            for c in map(ord, vocabulary.names[i]):
                node = steps.setdefault(node << 21 | c, len(piece_at))
                if node == len(piece_at):
                    piece_at.append(-1)
            piece_at[node] = i
        keys = np.fromiter(steps.keys(), np.int64, len(steps))
        order = np.argsort(keys)
        self.keys, self.next = keys[order], np.fromiter(steps.values(), np.int64, len(steps))[order]
        self.piece_at = np.array(piece_at, np.int64)
        self.longest = max(map(len, vocabulary.names.values()), default=1)

    def step(self, node: np.ndarray, char: np.ndarray) -> np.ndarray:
        """The next node of each, -1 if there is none."""
        key = node << 21 | char
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.next[at], -1)

    def edges(self, chars: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, length, piece) of all pieces found in ``chars``, none going beyond its start's ``stop``."""
        start, node, found = np.arange(len(chars)), np.zeros(len(chars), np.int64), []
        for length in range(1, self.longest + 1):
            inside = start + length <= stop[start]
            start, node = start[inside], node[inside]
            node = self.step(node, chars[start + length - 1])
            start, node = start[node >= 0], node[node >= 0]
            if not len(start):
                break
            piece = self.piece_at[node]
            found.append((start[piece >= 0], np.full(int((piece >= 0).sum()), length), piece[piece >= 0]))
        return tuple(np.concatenate([f[i] for f in found] or [np.zeros(0, np.int64)]) for i in range(3))


def _octets(points: np.ndarray) -> np.ndarray:
    """Bytes of UTF-8 that each code point takes."""
    return 1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000)


class Sampler:
    """Forward filtering of each distinct unit once, backward sampling of each of its occurrences.

    What is kept of a unit: for each of its positions the edges that end there, shortest
    first, with the summed probability up to each.
    """

    def __init__(self, vocabulary: Vocabulary, alpha: float) -> None:
        self.vocabulary, self.trie, self.alpha = vocabulary, Trie(vocabulary), alpha
        self._forget()

    def _forget(self) -> None:
        self.units = WordIndex()
        self.end, self.first = GrowingRows(np.int32), GrowingRows(np.int32)  # of units: last position; of positions: first edge
        self.reach, self.back = GrowingRows(np.float32), GrowingRows(np.uint8 if self.trie.longest < 256 else np.int32)
        self.emits = GrowingRows(np.int32)  # a piece, or the complement of a character that has none

    def _learn(self, units: list[str], sizes: np.ndarray) -> None:
        v = self.vocabulary
        raw = np.frombuffer("".join(units).encode("utf-32-le", "replace"), np.uint32).astype(np.int64)
        chars = np.where(raw == 32, _SPACE_SIGN, np.where(raw == _SPACE_SIGN, _NONE, raw))
        unit = np.repeat(np.arange(len(units)), sizes)
        offset = np.cumsum(sizes) - sizes
        begin, length, piece = self.trie.edges(chars, (offset + sizes)[unit])
        lone = np.ones(len(chars), bool)
        lone[begin[length == 1]] = False
        lone = np.flatnonzero(lone)
        weight = np.concatenate([v.weight[piece], -np.log(len(v.weight) + 3.0) * _octets(raw[lone])]) * self.alpha
        emits = np.concatenate([piece, ~raw[lone]]).astype(np.int32)
        begin, length = np.concatenate([begin, lone]), np.concatenate([length, np.ones(len(lone), np.int64)])
        # Edges by their last character, shortest first; a unit of n characters has n + 1 positions.
        order = np.lexsort((length, begin + length))
        begin, length, weight, emits = begin[order], length[order], weight[order], emits[order]
        last = begin + length - 1
        heads = np.searchsorted(last, np.arange(len(chars) + 1))
        forward, reach = np.zeros(len(chars) + len(units)), np.empty(len(last), np.float32)
        depth = np.arange(len(chars)) - offset[unit]
        long = sizes > LONG_UNIT
        for u in np.flatnonzero(long).tolist():
            self._filter(int(offset[u]), int(offset[u] + sizes[u]), heads, length, weight, reach)
        by_depth = np.flatnonzero(~long[unit])
        by_depth = by_depth[np.argsort(depth[by_depth], kind="stable")]
        cuts = np.searchsorted(depth[by_depth], np.arange(int(sizes[~long].max(initial=0)) + 1))
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            at = by_depth[a:b]
            spread = heads[at + 1] - heads[at]
            mine = gather_ranges(heads[at], spread)
            row, column = np.repeat(np.arange(b - a), spread), gather_ranges(np.zeros(b - a, np.int64), spread)
            value = np.full((b - a, int(spread.max())), -np.inf)
            value[row, column] = forward[(begin + unit[begin])[mine]] + weight[mine]
            top = value.max(axis=1)
            summed = np.cumsum(np.exp(value - top[:, None]), axis=1)
            forward[at + unit[at] + 1] = top + np.log(summed[:, -1])
            reach[mine] = (summed / summed[:, -1:])[row, column]
        reach[heads[1:] - 1] = 2.0  # the last edge takes what rounding leaves
        first = np.zeros(len(forward), np.int64)
        first[np.arange(len(chars)) + unit + 1] = heads[:-1] + self.reach.size
        self.end.extend(self.first.size + np.cumsum(sizes + 1) - 1)
        self.first.extend(first)
        self.reach.extend(reach)
        self.back.extend(length)
        self.emits.extend(emits)

    @staticmethod
    def _filter(a: int, b: int, heads: np.ndarray, length: np.ndarray, weight: np.ndarray, reach: np.ndarray) -> None:
        """Forward filtering of one long unit, the characters a to b, position by position."""
        forward, at, back, w, out = [0.0], heads[a : b + 1].tolist(), length[heads[a] : heads[b]].tolist(), weight[heads[a] : heads[b]].tolist(), []
        low = at[0]
        for j in range(1, b - a + 1):
            value = [forward[j - back[e]] + w[e] for e in range(at[j - 1] - low, at[j] - low)]
            top = max(value)
            summed = list(itertools.accumulate(math.exp(v - top) for v in value))
            forward.append(top + math.log(summed[-1]))
            out += [x / summed[-1] for x in summed]
        reach[heads[a] : heads[b]] = out

    def _draw(self, units: list[str], sizes: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all units, one after the other, and how many each has."""
        if self.reach.size > EDGE_LIMIT:
            self._forget()
        numbers = self.units.numbers(units)
        if fresh := self.units.take_fresh():
            self._learn(fresh, np.fromiter(map(len, fresh), np.int64, len(fresh)))
        position = self.end.data[numbers].astype(np.int64)
        start = position - sizes
        taken, who, active, turn, step = [], [], np.arange(len(units)), np.zeros(len(units), np.int64), 0
        while len(active) > FEW:
            draw = (_mixed(state[active] + np.uint64((step * 0xD1B54A32D192ED03) % 2**64)) >> np.uint64(40)).astype(np.float32) * np.float32(2**-24)
            edge = self.first.data[position].astype(np.int64)
            more = np.flatnonzero(draw >= self.reach.data[edge])
            while len(more):
                edge[more] += 1
                more = more[draw[more] >= self.reach.data[edge[more]]]
            taken.append(edge)
            who.append(active)
            turn[active] += 1
            position = position - self.back.data[edge]
            left = position > start
            active, position, start = active[left], position[left], start[left]
            step += 1
        # What is left when most units are done: a few long ones, each walked back by itself.
        alone = [self._walk(int(s), step, int(p), int(q)) for s, p, q in zip(state[active], position, start, strict=True)]
        turn[active] += np.array(list(map(len, alone)), np.int64)
        edges = np.empty(int(turn.sum()), np.int64)
        last = np.cumsum(turn) - 1
        for k, (edge, mine) in enumerate(zip(taken, who, strict=True)):
            edges[last[mine] - k] = edge
        for u, walked in zip(active.tolist(), alone, strict=True):
            edges[last[u] - step - np.arange(len(walked))] = walked
        emits = self.emits.data[edges]
        lone = np.flatnonzero(emits < 0)
        points = ~emits[lone]
        count = np.ones(len(emits), np.int64)
        count[lone] = _octets(points)
        ids = np.repeat(emits, count)
        octets = "".join(map(chr, points.tolist())).encode("utf-8", "replace")
        ids[gather_ranges((np.cumsum(count) - count)[lone], count[lone])] = self.vocabulary.byte_id[np.frombuffer(octets, np.uint8)]
        return ids, sums_of_runs(count, turn)

    def _walk(self, state: int, step: int, position: int, start: int) -> list[int]:
        """The edges from a position back to its unit's start."""
        first, reach, back, walked, mask = self.first.data, self.reach.data, self.back.data, [], 2**64 - 1
        while position > start:
            x = (state + step * 0xD1B54A32D192ED03) & mask
            x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & mask
            x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & mask
            draw, edge = ((x ^ (x >> 31)) >> 40) * 2.0**-24, int(first[position])
            while draw >= reach[edge]:
                edge += 1
            walked.append(edge)
            position, step = position - int(back[edge]), step + 1
        return walked

    def sample(self, texts: list[str], seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and how many each has. A text's draws depend on its seed alone."""
        parts = list(self.samples(texts, seeds))
        return np.concatenate([np.zeros(0, np.int32), *(ids for ids, _ in parts)]), sum((n for _, n in parts), np.zeros(len(texts), np.int64))

    def samples(self, texts: list[str], seeds: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The ids of all texts, and how many each has, for runs of texts; a long text's ids may come in several parts.

        What is held at one time is bounded by ``RUN_CHARS``, unless a single unit is longer.
        """
        for a, b in small_runs(texts, RUN_CHARS):
            split = [UNITS.findall(" " + t) for t in texts[a:b]]
            per_text = np.fromiter(map(len, split), np.int64, b - a)
            units = split[0] if b - a == 1 else list(itertools.chain.from_iterable(split))
            sizes = np.fromiter(map(len, units), np.int64, len(units))
            owner = np.repeat(np.arange(b - a), per_text)
            place = gather_ranges(np.zeros(b - a, np.int64), per_text).astype(np.uint64)
            state = _mixed(seeds[a:b][owner] + place * np.uint64(0x9E3779B97F4A7C15))
            run = (np.cumsum(sizes) - sizes) // RUN_CHARS
            cuts = [0, *(np.flatnonzero(np.diff(run)) + 1).tolist(), len(units)]
            for i, j in itertools.pairwise(cuts):
                ids, count = self._draw(units[i:j], sizes[i:j], state[i:j])
                yield ids, np.concatenate([np.zeros(a, np.int64), np.bincount(owner[i:j], count, len(texts) - a).astype(np.int64)])


class _Kept:
    """What a worker keeps of a model: the pieces, and a sampler where one was asked for."""

    def __init__(self, path: str) -> None:
        self.vocabulary = Vocabulary(path)
        self.samplers: dict[float, Sampler] = {}

    def sampler(self, alpha: float) -> Sampler:
        if alpha not in self.samplers:
            self.samplers = {alpha: Sampler(self.vocabulary, alpha)}
        return self.samplers[alpha]


def _kept(path: str) -> _Kept:
    return worker_table(("pieces", path), lambda: _Kept(path))


def sampler(path: str, alpha: float) -> Sampler:
    return _kept(path).sampler(alpha)


def vocabulary(path: str) -> Vocabulary:
    return _kept(path).vocabulary


def _encoded(path: str, alpha: float, seed: int, keys: list, texts: list[bytes]) -> pa.Array:
    """The ids of each text as bytes."""
    plain = [t.decode("utf-8", "replace") for t in texts]
    seeds = np.fromiter((xxhash.xxh64_intdigest(str(k), seed) for k in keys), np.uint64, len(plain))
    data, sizes = [], np.zeros(len(plain), np.int64)
    for ids, count in sampler(path, alpha).samples(plain, seeds):
        data.append(ids.astype("<i4").tobytes())
        sizes += count
    offsets = np.concatenate([[0], np.cumsum(sizes * 4)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(plain), [None, pa.py_buffer(offsets), pa.py_buffer(b"".join(data))])


def _decoded(path: str, rows: pa.Array) -> pa.Array:
    return pa.array([None if x is None else vocabulary(path).decode(np.frombuffer(x, "<i4")) for x in rows.to_pylist()], pa.binary()).cast(pa.string())


def _slices(texts: pa.Array) -> Iterator[tuple[int, pa.Array]]:
    """Parts of a batch of about ``SLICE_BYTES``, with their places: results go back a part at a time."""
    ends = np.cumsum(np.nan_to_num(pa.compute.binary_length(texts).to_numpy(zero_copy_only=False)))
    cuts = [0, *(np.flatnonzero(np.diff(ends // SLICE_BYTES)) + 1).tolist(), len(texts)]
    for a, b in itertools.pairwise(cuts):
        yield a, texts.slice(a, b - a)


def _encode(path: str, alpha: float, seed: int):
    @F.arrow_udf(T.BinaryType())
    def encode(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for keys, texts in batches:
            for a, part in _slices(texts):
                yield _encoded(path, alpha, seed, keys.slice(a, len(part)).to_pylist(), bytes_of(part))

    return encode


def _both(path: str, alpha: float, seed: int):
    @F.arrow_udf(T.StructType().add("ids", "binary").add("decoded", "string"))
    def both(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for keys, texts in batches:
            for a, part in _slices(texts):
                ids = _encoded(path, alpha, seed, keys.slice(a, len(part)).to_pylist(), bytes_of(part))
                yield pa.StructArray.from_arrays([ids, _decoded(path, ids)], ["ids", "decoded"])

    return both


def encode(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", alpha: float = ALPHA, seed: int = SEED, model: str | None = None, column: str = "ids") -> DataFrame:
    """``documents`` with the ids of a sampled segmentation (binary, 32-bit little-endian).

    Segmentations are drawn from all that the pieces allow, by their weights to the
    power ``alpha``: forward filtering sums up the lattice of each unit, backward
    sampling draws the pieces from its end. The draws depend on the seed and the row's
    id alone, not on partitions or neighbours, so a retried task gives the same ids.

    Nulls: a null text counts as empty and has no ids; rows with a null id share one
    key. Long texts are encoded whole, some ``RUN_CHARS`` at a time. Rows that repeat have
    equal ids. An empty table gives no rows. All columns pass through; one named ``column``
    is replaced. Bytes that are no UTF-8 count as U+FFFD.
    """
    key = F.coalesce(F.col(id_column).cast("string"), F.lit(""))
    return documents.withColumn(column, _encode(model or model_path(), alpha, seed)(key, text_of(text_column)))


def _decode(path: str):
    @F.arrow_udf(T.StringType())
    def decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            for _, part in _slices(column):
                yield _decoded(path, part)

    return decode


def decode(encoded: DataFrame, ids_column: str = "ids", model: str | None = None, column: str = "decoded") -> DataFrame:
    """``encoded`` with the text of its ids: exactly the text that was encoded, whatever the segmentation.

    Nulls: null ids have a null text. No ids are the empty text. Repeated rows get equal
    texts. An empty table gives no rows. All columns pass through; one named ``column``
    is replaced.
    """
    return encoded.withColumn(column, _decode(model or model_path())(F.col(ids_column)))


def round_trip(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", alpha: float = ALPHA, seed: int = SEED, model: str | None = None, column: str = "pieces") -> DataFrame:
    """``documents`` with a struct of ids and decoded: ``encode`` and ``decode`` in one pass of one worker.

    Nulls, repeated rows, long texts, empty tables and other columns as in ``encode``.
    """
    key = F.coalesce(F.col(id_column).cast("string"), F.lit(""))
    return documents.withColumn(column, _both(model or model_path(), alpha, seed)(key, text_of(text_column)))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's sampled ids by number and checksum, and whether decoding gives its text again."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", text_of("text").alias("text"))
    both = round_trip(documents).select("doc_id", "text", "pieces.ids", "pieces.decoded")
    size = (F.octet_length("ids") / 4).cast("long")
    return both.select("doc_id", size.alias("n_pieces"), F.crc32("ids").alias("ids_crc32"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"), (F.col("decoded") == F.col("text")).alias("lossless"))
