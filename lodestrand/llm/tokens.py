"""Token ids of whole texts by a public tokenizer file, with word-wise reuse."""

from __future__ import annotations

import gc
import re

import numpy as np

from .common import GrowingRows, WordIndex, gather_ranges, worker_table

WORD_BPE = "word_bpe_49k.json"

#: Stands between texts: no UTF-8 text holds this byte.
BREAK = b" \xff "

#: Words, and word stems, whose ids a worker keeps (results do not depend on it).
WORD_LIMIT = 600_000
STEM_LIMIT = 500_000

#: A word of Latin letters, maybe with ASCII marks after it: these need no normaliser,
#: and the marks are a token run of their own. The apostrophe can begin a short form.
PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)")


def tokenizer_path(name: str = WORD_BPE) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class TokenEncoder:
    """``encode`` of the ``tokenizers`` library for many texts.

    The tokenizer drops white space and never joins what white space separates, so
    the ids of a text are the ids of its words in order. Each worker keeps the ids
    of words it has met; words of plain Latin letters share the entry of their
    lower-case form. All ids come from the library.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.full = Tokenizer.from_file(path)
        self.full.encode_special_tokens = True
        self.bare = Tokenizer.from_file(path)
        self.bare.encode_special_tokens = True
        self.bare.normalizer = normalizers.Sequence([])
        self.bare.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = self.full.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        gc.set_threshold(200_000)  # the tables hold millions of plain objects and no cycles
        self._forget()
        self._forget_stems()

    def _forget(self) -> None:
        self.words, self.ids = WordIndex({BREAK.strip(): 0}), GrowingRows(np.int32)
        self.start, self.count = GrowingRows(np.int64), GrowingRows(np.int64)
        self.start.extend(np.zeros(1, np.int64))
        self.count.extend(np.zeros(1, np.int64))

    def _forget_stems(self) -> None:
        self.stems, self.stem_ids = WordIndex(), GrowingRows(np.int32)
        self.stem_start, self.stem_count = GrowingRows(np.int64), GrowingRows(np.int64)
        self.marks: dict[str, list[int]] = {"": []}

    def _learn_stems(self, stems: list[str]) -> None:
        joined = [" ".join(stems[i : i + 500]) for i in range(0, len(stems), 500)]
        ids = np.concatenate([np.array(e.ids, np.int32) for e in self.bare.encode_batch_fast(joined, add_special_tokens=False)])
        stops = np.flatnonzero(self.ends[ids]) + 1
        starts = np.concatenate([[0], stops[:-1]])
        self.stem_start.extend(self.stem_ids.size + starts)
        self.stem_count.extend(stops - starts)
        self.stem_ids.extend(ids)

    def _mark(self, mark: str) -> list[int]:
        if mark not in self.marks:
            self.marks[mark] = self.full.encode(mark, add_special_tokens=False).ids
        return self.marks[mark]

    def _learn(self, fresh: list[bytes]) -> None:
        """Ids of new words: a stem and maybe a mark, or whatever the whole tokenizer says."""
        if len(self.stems) > STEM_LIMIT:
            self._forget_stems()
        matches = list(map(PLAIN.fullmatch, [w.decode("utf-8", "replace") for w in fresh]))
        plain = np.fromiter((m is not None for m in matches), bool, len(fresh))
        stem = self.stems.numbers([m[1].lower() for m in matches if m])
        if stems := self.stems.take_fresh():
            self._learn_stems(stems)
        marks = [self._mark(m[2]) for m in matches if m]
        marked = np.fromiter(map(len, marks), np.int64, len(marks))
        counts = np.empty(len(fresh), np.int64)
        counts[plain] = self.stem_count.data[stem] + marked
        others = [w.decode("utf-8", "replace") for w, p in zip(fresh, plain, strict=True) if not p]
        encoded = [e.ids for e in self.full.encode_batch_fast(others, add_special_tokens=False)] if others else []
        counts[~plain] = list(map(len, encoded))
        starts = np.cumsum(counts) - counts
        ids = np.empty(int(counts.sum()), np.int32)
        ids[gather_ranges(starts[plain], self.stem_count.data[stem])] = self.stem_ids.data[gather_ranges(self.stem_start.data[stem], self.stem_count.data[stem])]
        ids[gather_ranges((starts + counts)[plain] - marked, marked)] = [i for m in marks for i in m]
        ids[gather_ranges(starts[~plain], counts[~plain])] = [i for e in encoded for i in e]
        self.start.extend(self.ids.size + starts)
        self.count.extend(counts)
        self.ids.extend(ids)

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts (UTF-8), one after the other, and the number of each text's ids."""
        if len(self.words) > WORD_LIMIT:
            self._forget()
        numbers = self.words.numbers(BREAK.join(texts).split())
        if fresh := self.words.take_fresh():
            self._learn(fresh)
        counts = self.count.data[numbers]
        ids = self.ids.data[gather_ranges(self.start.data[numbers], counts)]
        breaks = np.concatenate([[-1], np.flatnonzero(numbers == 0), [len(numbers)]])
        before = np.concatenate([[0], np.cumsum(counts)])
        return ids, before[breaks[1:]] - before[breaks[:-1] + 1]


def encoder(path: str) -> TokenEncoder:
    """This worker's encoder."""
    return worker_table(("tokens", path), lambda: TokenEncoder(path))
