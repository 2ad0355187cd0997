import hashlib
import re

import numpy as np
import pytest

from lodestrand.llm.line_dedup import drop_shared_lines
from lodestrand.llm.perfect_hash import PerfectHash

LINE = "this line is shared by very many of the documents here"


def brute(rows, min_chars=40, min_documents=5):
    key = lambda line: re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(" \t\n\r\x0b\x0c"))
    held = {}
    for i, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= min_chars:
                held.setdefault(key(line), set()).add(-(2**63) if i is None else i)
    shared = {k: max(ids) for k, ids in held.items() if len(ids) >= min_documents}
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if key(x) not in shared or shared[key(x)] == i]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=str)


def rows_of():
    rng = np.random.default_rng(3)
    pool = [f"passage {k} " + "word " * int(rng.integers(5, 12)) for k in range(30)] + ["short", "", "  ", "é" * 39, "ü" * 40]
    rows = [(i, "\n".join(str(x) for x in rng.choice(pool, int(rng.integers(0, 8))))) for i in range(60)]
    rows += [(100 + i, f"  {LINE.upper()}\t\nown {i}\n{LINE}") for i in range(40)]
    return [*rows, (None, LINE), (None, LINE), (7, None), (8, ""), (9, "x" * 300_000 + "\n" + LINE), rows[0], (50, rows[0][1])]


@pytest.mark.parametrize("way", [{}, {"broadcast_bytes": 0}, {"broadcast_bytes": 0, "shard_keys": 3, "group_rows": 7}, {"shard_keys": 4}])
def test_both_ways_equal_brute_force(spark, way):
    rows = rows_of()
    docs = spark.createDataFrame([(i, t, 1, 2, "k") for i, t in rows], "doc_id long, text string, shard int, h1 int, dropped string").repartition(5)
    found = drop_shared_lines(docs, **way)
    assert found.columns == [*docs.columns, "line_dedup"]
    assert sorted(((r.doc_id, r.text, r.line_dedup.n_lines, r.line_dedup.n_dropped) for r in found.collect()), key=str) == brute(rows)


def test_the_kept_line_is_in_the_largest_document(spark):
    docs = spark.createDataFrame([(i, LINE) for i in range(6)], "doc_id long, text string")
    assert sorted((r.doc_id, r.text) for r in drop_shared_lines(docs).collect()) == [(i, "") for i in range(5)] + [(5, LINE)]


def test_empty_table(spark):
    assert drop_shared_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_perfect_hash_is_minimal_and_survives_bytes():
    keys = np.random.default_rng(1).integers(0, 2**63, 20_000, dtype=np.int64).astype(np.uint64)
    keys = np.unique(keys)
    perfect = PerfectHash.from_bytes(PerfectHash.build(keys).to_bytes())
    assert sorted(perfect.numbers(keys).tolist()) == list(range(len(keys)))
    assert PerfectHash.build(keys[:0]).numbers(keys[:3]).tolist() == [-1] * 3


def test_query(spark, sf_dir, duck):
    from lodestrand.llm.line_dedup import op10_line_dedup

    rows = duck.sql("SELECT doc_id, text FROM documents").fetchall()
    want = sorted((i, n, d, hashlib.sha256(t.encode()).hexdigest()) for i, t, n, d in brute(rows))
    assert sorted((r.doc_id, r.n_lines, r.n_dropped, r.kept_sha256) for r in op10_line_dedup(spark, sf_dir).collect()) == want
