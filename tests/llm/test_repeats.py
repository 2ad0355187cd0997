import hashlib
import random

import pytest

from lodestrand.llm import repeats as R


def brute(rows, length=200):
    texts = [(i, (t or "").encode()) for i, t in rows]
    met = {}
    for _, t in texts:
        for p in range(len(t) - length + 1):
            met[t[p : p + length]] = met.get(t[p : p + length], 0) + 1
    out = []
    for i, t in texts:
        gone = bytearray(len(t))
        for p in range(len(t) - length + 1):
            if met[t[p : p + length]] > 1:
                gone[p : p + length] = b"\1" * length
        kept = bytes(c for c, g in zip(t, gone, strict=True) if not g)
        spans = sum(g and not before for before, g in zip(b"\0" + bytes(gone), gone, strict=False))
        out.append((i, len(t), len(t) - len(kept), spans, kept))
    return sorted(out, key=str)


def rows_of():
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcdefghiü", k=rng.randrange(1, 8)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passages = [prose(60) for _ in range(5)]
    rows = []
    for i in range(60):
        parts = [prose(rng.randrange(5, 60)) for _ in range(3)]
        if i % 2:
            parts.insert(rng.randrange(4), rng.choice(passages)[rng.randrange(30) : -1 - rng.randrange(30)])
        rows.append((i, " ".join(parts)))
    common = prose(45)
    rows += [(100 + i, f"{prose(20)}{common}{prose(20)}") for i in range(30)]  # one passage in a third of all
    whole = prose(80)
    rows += [(200, whole), (201, whole), (202, whole), (202, whole), (None, whole)]
    cut = prose(80)
    rows += [(300, cut), (301, cut[:250]), (302, cut[-250:]), (303, cut[30:229]), (304, cut[30:230])]
    rows += [(400, "x" * 700), (401, "ab" * 300), (402, "z" * 201), (403, "y" * 200), (404, prose(3) * 60)]
    long = prose(4000)
    rows += [(500, long), (501, long[:9000] + "!" + long[9001:])]
    return [*rows, (600, None), (601, ""), (602, "short"), (602, "short"), (None, None)]


@pytest.mark.parametrize("ways", [{}, {"most": 3}, {"most": 0}, {"array_bytes": 2000}])
def test_what_is_left_equals_brute_force(spark, monkeypatch, ways):
    rows = rows_of()
    docs = spark.createDataFrame([(i, t, 1, "k", 2) for i, t in rows], "doc_id long, text string, k1 int, ranges string, h int").repartition(5)
    found = R.without_repeats(docs, **ways)
    assert found.columns == [*docs.columns, "repeats"]
    assert sorted(((r.doc_id, r.repeats.n_bytes, r.repeats.n_removed, r.repeats.n_spans, bytes(r.repeats.kept)) for r in found.collect()), key=str) == brute(rows)


def test_pieces_of_long_texts_find_the_same_windows():
    import numpy as np

    rng = random.Random(1)
    texts = [bytes(rng.choices(b"abc", k=n)) for n in (0, 199, 200, 5000, 777)]

    def windows(chunk):
        found = set()
        for pieces in R._pieces(texts, 200, chunk):
            sizes = [len(p) for *_, p in pieces]
            data, number = np.frombuffer(b"".join(p for *_, p in pieces), np.uint8), np.repeat(np.arange(len(pieces)), sizes)
            starts = np.cumsum(sizes) - sizes
            for a, b, h in zip(*R.anchors(data, number, 200, 64), strict=True):
                i, at, _ = pieces[number[a]]
                found |= {(i, at + p - starts[number[a]], h) for p in range(a, b + 1)}
        return found

    want = {(i, p) for i, t in enumerate(texts) for p in range(len(t) - 199)}
    assert windows(1 << 20) == windows(300) and {(i, p) for i, p, _ in windows(300)} == want


def test_groups_hold_every_occurrence(spark):
    rows = [(i, t) for i, t in rows_of() if i is not None and (i < 60 or i // 100 in (1, 3))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    keys = {(r.k1, r.k2): r.text.encode() for r in docs.withColumns(R._keyed(docs.text)).collect()}
    groups = {}
    for r in R.repeat_groups(docs).collect():
        groups.setdefault((r.array, r.group, r.n_bytes), []).append((r.k1, r.k2, r.at))
    assert len(groups) > 20
    for (_, _, n), members in groups.items():
        (passage,) = {keys[k1, k2][at : at + n] for k1, k2, at in members}
        want = {(*k, at) for k, t in keys.items() for at in range(len(t) - n + 1) if t[at : at + n] == passage}
        assert len(passage) == n >= 200 and len(members) == len(set(members)) and set(members) == want and len(want) > 1


def test_no_rows_and_no_repeats(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert R.without_repeats(empty).count() == 0
    one = spark.createDataFrame([(1, "a b c"), (2, None)], "doc_id long, text string")
    assert {(r.doc_id, r.repeats.n_removed, bytes(r.repeats.kept)) for r in R.without_repeats(one).collect()} == {(1, 0, b"a b c"), (2, 0, b"")}


def test_query_digests_what_is_left(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    want = [(i, n, gone, spans, hashlib.sha256(kept).hexdigest()) for i, n, gone, spans, kept in brute(rows)]
    assert sorted((tuple(r) for r in R.op11_suffix_dedup(spark, sf_dir).collect()), key=str) == sorted(want, key=str)
