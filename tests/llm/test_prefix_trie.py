import hashlib
import random
import zlib

import pytest

from lodestrand.llm import prefix_trie as P


def sequences(rows, rebuild):
    held = {}
    for c, turn, role, text in rows:
        if c is not None:
            held.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    held = {c: [r[2:] for r in sorted(v)] for c, v in held.items()}
    if not rebuild:
        return held
    out = {}
    for c, own in held.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = held.get(c - c % 100, [])[:h] + own[h:]
    return out


def brute(rows, rebuild=True):
    members = {}
    seqs = sequences(rows, rebuild)
    for c, turns in seqs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    out = []
    for node, convs in members.items():
        below = [n for n in members if n[: len(node)] == node]
        children = [n for n in below if len(n) == len(node) + 1]
        leaf = lambda n: not any(m[: len(n)] == n and len(m) == len(n) + 1 for m in below)
        ends = ",".join(str(c) for c in sorted(convs) if len(seqs[c]) == len(node))
        saved = sum((len(members[n]) - 1) * len(n[-1][1]) for n in below if n)
        out.append((min(convs), len(node), min(members[node[:-1]]) if node else None, len(convs), len(children), sum(map(leaf, below)), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def rows_of():
    rng = random.Random(8)
    rows = [(c, t, rng.choice(["user", "assistant"]), rng.choice(["a", "bb", "", "ccc"])) for c in [*range(30), *range(100, 130), 205, 207] for t in range(rng.randrange(1, 6))]
    rows += [(400 + k, t, ("user", "assistant")[t % 2], f"same {t}") for k in range(40) for t in range(4)]  # copies
    rows += [(500, t, "user", f"deep {t}") for t in range(60)] + [(501, t, "user", f"deep {t}") for t in range(60)]
    rows += [(31, None, None, None), (31, None, "user", "x"), (31, 0, "user", "x"), (32, 1, "ü" * 3, "é" * 50_000), (None, 1, "user", "no id"), (33, 1, "ab", "c"), (34, 1, "a", "bc")]
    return [*rows, rows[0], rows[0]]


@pytest.mark.parametrize("rebuild", [True, False])
def test_nodes_equal_brute_force(spark, rebuild):
    rows = rows_of()
    table = spark.createDataFrame([(*r, 1, b"k", 2) for r in rows], "conv_id long, turn long, role string, text string, depth int, digest binary, place int").repartition(5)
    found = P.trie(table, rebuild).drop("digest")
    assert found.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert sorted((tuple(r) for r in found.collect()), key=str) == brute(rows, rebuild)


def test_no_rows(spark):
    assert P.trie(spark.createDataFrame([], "conv_id long, turn long, role string, text string"), True).count() == 0


def test_explosion_is_bounded_by_the_beginnings(spark):
    """Two conversations that share all of 400 turns: one line of nodes, none of which is exploded."""
    rows = [(c, t, "user", f"turn {t}") for c in (1, 2) for t in range(400)]
    found = {r.depth: r for r in P.trie(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert len(found) == 401 and found[0].saved_tokens == sum(len(f"turn {t}") for t in range(400)) and found[400].n_leaves == 1 and found[0].n_children == 1


def test_streams_refuse_rows_out_of_order(spark):
    from pyspark.sql import functions as F

    from lodestrand.operators.streams import joined_digests

    rows = spark.createDataFrame([(1, 1, "a"), (1, 1, "b")], "k int, at int, piece string")
    with pytest.raises(Exception, match="out of order"):
        joined_digests(rows, ["k"], "at", F.col("piece"), b",").collect()
