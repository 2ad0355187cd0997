import re

import numpy as np
import pytest
import xxhash

from lodestrand.llm.simhash_trie import fingerprints_of, keep_one, near_duplicates, near_pairs, op2_simhash_near_dedup

WORDS = [f"w{i}" for i in range(500)]


def fingerprint(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    n = min(4, len(words))
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + n]).encode(), 42) for i in range(len(words) - n + 1)] if words else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(rows, radius=4):
    """{row number: smallest doc_id of its component} and the components themselves."""
    prints = [fingerprint(t) for _, t in rows]
    root = list(range(len(rows)))

    def up(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                root[up(i)] = up(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[up(i)] = min(least.get(up(i), d), d)
    return [(d, prints[i], least.get(up(i))) for i, (d, _) in enumerate(rows)], [up(i) for i in range(len(rows))]


def rows_of():
    rng = np.random.default_rng(5)
    rows = []
    for g in range(25):
        words = [str(w) for w in rng.choice(WORDS, int(rng.integers(2, 250)))]
        for _ in range(int(rng.integers(1, 5))):
            near = list(words)
            near[int(rng.integers(len(near)))] = "changed"
            rows.append((len(rows), " ".join(near if rng.random() < 0.7 else words)))
    return [*rows, (900, None), (901, ""), (902, " \t\n"), (None, "only this"), (None, "only this"), (None, rows[0][1]), rows[1], (903, rows[2][1].upper()), (904, "é ü É"), (905, "x" * 200_000)]


def test_fingerprints_equal_brute_force():
    texts = [t or "" for _, t in rows_of()]
    assert fingerprints_of([t.encode() for t in texts]).tolist() == [fingerprint(t) for t in texts]


@pytest.mark.parametrize("radius", [0, 1, 4])
def test_trie_finds_exactly_the_near_pairs(radius):
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**63, 40, dtype=np.int64).astype(np.uint64)
    flips = [np.uint64(sum(1 << int(b) for b in rng.integers(0, 64, 3))) for _ in range(30)]
    keys = np.unique(np.concatenate([base, *(base ^ f for f in flips)]))
    other = np.unique(keys[::3] ^ np.uint64(5))
    pairs = lambda a, b: {(i, j) for x, y in near_pairs(a, b, radius) for i, j in zip(x.tolist(), y.tolist(), strict=True)}
    assert pairs(keys, None) == {(i, j) for i in range(len(keys)) for j in range(i + 1, len(keys)) if int(keys[i] ^ keys[j]).bit_count() <= radius}
    assert pairs(keys, other) == {(i, j) for i in range(len(keys)) for j in range(len(other)) if int(keys[i] ^ other[j]).bit_count() <= radius}


@pytest.mark.parametrize("cell_size", [None, 8])
def test_components_equal_brute_force(spark, cell_size):
    rows = rows_of()
    docs = spark.createDataFrame([(i, t, "a", 1) for i, t in rows], "doc_id long, text string, fp string, root int").repartition(5)
    found = sorted(((r.doc_id, r.fp % 2**64, r.component_id) for r in near_duplicates(docs, cell_size=cell_size).collect()), key=str)
    assert found == sorted(components(rows)[0], key=str)


def test_one_of_each_component_stays(spark):
    rows = rows_of()
    docs = spark.createDataFrame([(i, t, "a", 1) for i, t in rows], "doc_id long, text string, fp string, root int").repartition(5)
    kept = keep_one(docs)
    assert kept.columns == docs.columns
    told, groups = components(rows)
    assert kept.count() == len(set(groups))
    assert {r.doc_id for r in kept.collect()} == {c for *_, c in told}


def test_empty_and_single(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert near_duplicates(none).count() == 0 and keep_one(none).count() == 0
    assert [r.component_id for r in near_duplicates(spark.createDataFrame([(3, "a b")], "doc_id long, text string")).collect()] == [3]


def test_query(spark, sf_dir, duck):
    rows = duck.sql("SELECT doc_id, text FROM documents").fetchall()
    want = sorted((d, f"{f:016x}", c) for d, f, c in components(rows)[0])
    assert sorted((r.doc_id, r.fingerprint, r.component_id) for r in op2_simhash_near_dedup(spark, sf_dir).collect()) == want
