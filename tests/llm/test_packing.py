import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from lodestrand.llm.packing import op4_packing, pack, sequences
from lodestrand.llm.tokens import encoder, tokenizer_path

TEXTS = ["Hello, World! It's 12 o'clock.", "", None, "ÄÖÜ straße déjà-vu", "日本語 and mixed текст", "a" * 3000, "don't  stop\n\n\tnow...!!", "x" * 100_000 + " end", "ﬁ ligature é", "token " * 500, "#tag @name $5 100% C++ e.g. U.S.A.", "  ", "\x00\x01 b", "'s 're ''s", "İstanbul ǅ ß"]


def whole():
    t = Tokenizer.from_file(tokenizer_path())
    t.encode_special_tokens = True
    return t


def test_ids_are_those_of_the_library():
    texts = [t or "" for t in TEXTS]
    ids, counts = encoder(tokenizer_path()).encode([t.encode() for t in texts])
    for got, text in zip(np.split(ids, np.cumsum(counts)[:-1]), texts, strict=True):
        assert got.tolist() == whole().encode(text, add_special_tokens=False).ids


def held(pieces, want, size):
    """Every id once, in order, in gapless sequences of which one at most is short."""
    total = {}
    by_doc, by_sequence = {}, {}
    for p in pieces:
        by_doc.setdefault((p.doc_id, p.doc_tokens), []).append(p)
        by_sequence.setdefault(p.sequence_id, []).append(p)
    for s in by_sequence.values():
        at = 0
        for p in sorted(s, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= size
        total[s[0].sequence_id] = at
    assert sorted(total) == list(range(len(total))) and sum(n < size for n in total.values()) <= 1
    assert sum(total.values()) == sum(map(len, want))


@pytest.mark.parametrize("size", [16, 100, 4096])
def test_pieces(spark, size):
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(TEXTS)], "doc_id long, text string, ids string, part int").repartition(4)
    pieces = pack(docs, size=size).collect()
    want = [[*whole().encode(t or "", add_special_tokens=False).ids, 2] for t in TEXTS]
    held(pieces, want, size)
    for i, ids in enumerate(want):
        mine = sorted((p for p in pieces if p.doc_id == i), key=lambda p: p.start)
        assert b"".join(p.ids for p in mine) == np.array(ids, "<i4").tobytes()
        assert [p.start for p in mine] == np.cumsum([0, *(p.length for p in mine)])[:-1].tolist() and {p.doc_tokens for p in mine} == {len(ids)}


def test_sequences_are_padded_unless_a_power_of_two(spark):
    docs = spark.createDataFrame([(1, "one two three"), (2, "four")], "doc_id long, text string").coalesce(1)
    rows = sequences(pack(docs, size=5), 5).orderBy("sequence_id").collect()
    n = sum(len(whole().encode(t, add_special_tokens=False).ids) + 1 for t in ("one two three", "four"))
    assert [r.n_tokens for r in rows] == [5, n - 5]
    assert [len(r.ids) for r in rows] == [5, n - 5 if (n - 5).bit_count() == 1 else 5]
    assert rows[0].ids[3] == 2 and rows[0].doc_ids == [1, 2]


def test_nulls_repeats_and_empty_tables(spark):
    docs = spark.createDataFrame([(None, "a b"), (5, None), (6, "c"), (6, "c")], "doc_id long, text string")
    assert sorted((str(r.doc_id), r.doc_tokens) for r in pack(docs).collect()) == [("5", 1), ("6", 2), ("6", 2), ("None", 3)]
    none = pack(docs.where("false"))
    assert none.count() == 0 and sequences(none).count() == 0


def test_query(spark, sf_dir, duck):
    rows = dict(duck.sql("SELECT doc_id, coalesce(text, '') FROM documents").fetchall())
    ids = {d: [*e.ids, 2] for d, e in zip(rows, whole().encode_batch(list(rows.values()), add_special_tokens=False), strict=True)}
    pieces = op4_packing(spark, sf_dir).collect()
    held(pieces, list(ids.values()), 4096)
    for p in pieces:
        assert p.ids_crc32 == zlib.crc32(np.array(ids[p.doc_id][p.start : p.start + p.length], "<u4").tobytes()) and p.doc_tokens == len(ids[p.doc_id])
