"""Keys that hold a third of the rows or more: the same results, in tasks of bounded size."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestrand.llm.common import join_split
from lodestrand.llm.components import components
from lodestrand.llm.near_copies import shingle_set, star_links


@pytest.mark.parametrize("how", ["inner", "left"])
def test_join_split(spark, how):
    rows = [(i, 7 if i % 3 else 8 if i % 6 else i) for i in range(600)] + [(1000, None)]
    left = spark.createDataFrame(rows, "i long, k long").repartition(4)
    table = spark.createDataFrame([(7, "a"), *((k, "b") for k in range(9, 300))], "k long, v string")
    plain, split = (sorted(map(str, join_split(left, table, "k", n, how, hot_rows=50).collect())) for n in (1, len(rows)))
    assert plain == split and len(split) == (601 if how == "left" else len(split))


def brute(edges):
    up = {}

    def top(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for u, v in edges:
        a, b = top(u), top(v)
        up[max(a, b)] = min(a, b)
    return {x: top(x) for x in up}


@pytest.mark.parametrize("hot_rows", [20, 1_000_000])
def test_a_hub_and_a_path(spark, hot_rows):
    rng = np.random.default_rng(2)
    hub = [(5000, int(i)) for i in rng.integers(0, 900, 400)]
    path = [(10_000 + i, 10_001 + i) for i in range(60)]
    loose = [(int(a), int(b)) for a, b in rng.integers(20_000, 20_300, (150, 2))]
    edges = [*hub, *path, *loose, (3, 3), (30_000, 30_000), (None, 4)]
    found = components(spark.createDataFrame(edges, "u long, v long").repartition(3), hot_rows=hot_rows).collect()
    assert {r.node: r.root for r in found} == brute([e for e in edges if None not in e]) and len(found) == len({r.node for r in found})


@pytest.mark.parametrize("star_bytes", [500, 1 << 22])
def test_stars_in_groups_of_any_size(spark, star_bytes):
    rng = np.random.default_rng(4)
    words = [[f"w{b}_{i}" for i in range(60)] for b in range(4)]
    texts, pivots = [], {}
    for k in range(200):
        b = 0 if k % 3 else k % 4
        mine = list(words[b])
        for at in rng.integers(0, 60, int(rng.integers(0, 3))):
            mine[at] = f"new{k}"
        texts.append((k, " ".join(mine)))
        pivots.setdefault(b, k)
    base = {k: pivots[0 if k % 3 else k % 4] for k, _ in texts}
    sets = spark.createDataFrame(texts, "node long, text string").select("node", F.lit(0).alias("fp"), shingle_set("text").alias("set"))
    members = spark.createDataFrame([*base.items(), (1, 0), (5, 0)], "node long, pivot long")
    shingles = {k: {tuple(t.split()[i : i + 5]) for i in range(56)} for k, t in texts}
    like = lambda a, b: 5 * len(shingles[a] & shingles[b]) >= 4 * len(shingles[a] | shingles[b])
    want = sorted({(k, p) for k, p in [*base.items(), (1, 0), (5, 0)] if k != p and like(k, p)})
    assert sorted((r.u, r.v) for r in star_links(members, sets, star_bytes).collect()) == want and want
