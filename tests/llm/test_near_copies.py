import re

import numpy as np
import pytest

from lodestrand.llm import near_copies as module
from lodestrand.llm.near_copies import keep_one_near, near_copies

WORDS = [f"w{i}" for i in range(3000)]


def shingles(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    n = min(5, len(words))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if words else set()


def groups(rows):
    """The component of each row by exact Jaccard of all pairs."""
    sets, root = [shingles(t) for _, t in rows], list(range(len(rows)))

    def up(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                root[up(i)] = up(j)
    return [up(i) for i in range(len(rows))]


def rows_of():
    """Bases of 200 to 400 words with copies of which 1 to 8 words, one in 50 or so, are changed."""
    rng, rows = np.random.default_rng(8), []
    for _ in range(40):
        base = [str(w) for w in rng.choice(WORDS, int(rng.integers(200, 400)))]
        rows.append((len(rows), " ".join(base)))
        for _ in range(3):
            copy = list(base)
            for at in rng.integers(0, len(base), int(rng.integers(1, 9))):
                copy[at] = "changed"
            rows.append((len(rows), " ".join(copy)))
    return [*rows, (900, None), (901, ""), (902, " \t\n"), (None, "only this"), (903, rows[0][1].upper()), (None, rows[1][1]), rows[2], rows[2], (904, "a b"), (905, "x " * 20_000)]


def test_near_copies_at_jaccard_eight_tenths_leave_one(spark):
    rows = rows_of()
    docs = spark.createDataFrame([(i, t, "k") for i, t in rows], "doc_id long, text string, node string").repartition(5)
    kept = keep_one_near(docs)
    assert kept.columns == docs.columns
    members = {}
    for (i, _), g in zip(rows, groups(rows), strict=True):
        members.setdefault(g, []).append(i)
    want = sorted((min((i for i in m if i is not None), default=None) for m in members.values()), key=str)
    assert sorted((r.doc_id for r in kept.collect()), key=str) == want


def test_a_crowd_of_near_copies_leaves_one(spark):
    rng = np.random.default_rng(3)
    base = [str(w) for w in rng.choice(WORDS, 200)]
    crowd = [(i, " ".join([*base[:k], f"new{i}", *base[k + 1 :]])) for i, k in enumerate(rng.integers(0, 200, 500).tolist())]
    other = [(1000 + i, " ".join(str(w) for w in rng.choice(WORDS, 50))) for i in range(20)]
    kept = keep_one_near(spark.createDataFrame(crowd + other, "doc_id long, text string"))
    assert sorted(r.doc_id for r in kept.collect()) == [0, *(i for i, _ in other)]


@pytest.mark.parametrize("cell", [4, 1000])
def test_buckets_that_hold_several_groups_lose_no_link(spark, cell):
    """Families of chained copies: each step is near, the ends are not, and all share most of a long passage."""
    rng, rows = np.random.default_rng(12), []
    for _ in range(6):
        base = [str(w) for w in rng.choice(WORDS, 150)]
        for _ in range(3):
            chain = list(base)
            for at in rng.choice(150, 5, replace=False):
                chain[at] = f"fork{rng.integers(10**6)}"
            for _ in range(10):
                chain[int(rng.integers(150))] = f"step{rng.integers(10**6)}"
                chain[int(rng.integers(150))] = f"step{rng.integers(10**6)}"
                rows.append((len(rows), " ".join(chain)))
    found = near_copies(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), cell=cell).collect()
    roots = {r.doc_id: r.root for r in found}
    mine, want = {}, {}
    for (i, _), g in zip(rows, groups(rows), strict=True):
        mine.setdefault(roots[i], []).append(i)
        want.setdefault(g, []).append(i)
    assert len(want) > 6
    assert sorted(map(sorted, mine.values())) == sorted(map(sorted, want.values()))


def test_no_documents(spark):
    assert keep_one_near(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_the_trie_of_all_fingerprints_finds_near_copies_by_itself(spark, monkeypatch):
    """No band is shared here, so links come from the trie's self-join, and only exact ones stay."""
    held = module.buckets_of
    monkeypatch.setattr(module, "buckets_of", lambda signatures: held(signatures.where("false")))
    base = [f"w{i}" for i in range(2000)]
    rows = [(1, " ".join(base)), (2, " ".join([*base[:-1], "other"])), (3, "a b c d e f"), (4, "a b c d e f".upper())]
    found = {r.doc_id: r.root for r in near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found[1] == found[2] and found[3] == found[4] and found[1] != found[3]
