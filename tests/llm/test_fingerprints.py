import hashlib

import numpy as np
import pytest

from lodestrand.llm.fingerprints import block_tables, compare_with_next, edited, fingerprint, near, op5_document_fingerprints


@pytest.mark.parametrize("radius", [1, 3])
def test_block_tables_find_all_within_the_radius(spark, radius):
    rng = np.random.default_rng(1)
    keys = [(int(a), int(b)) for a, b in rng.integers(-(2**63), 2**63 - 1, (60, 2))]
    for a, b in list(keys):
        for _ in range(4):
            for bit in rng.integers(0, 128, int(rng.integers(0, 5))).tolist():
                if bit < 64:
                    a = (a ^ (1 << bit)) if bit < 63 else a
                else:
                    b = (b ^ (1 << (bit - 64))) if bit < 127 else b
            keys.append((a, b))
    keys += keys[:3]
    frame = spark.createDataFrame(keys, "high long, low long")
    asked = frame.limit(0).unionByName(spark.createDataFrame(keys[::5], "high long, low long"))
    bits = lambda x, y: sum(((p ^ q) & (2**64 - 1)).bit_count() for p, q in zip(x, y, strict=True))
    found = [tuple(r) for r in near(asked, frame, radius).collect()]
    want = {(*q, *k, bits(q, k)) for q in keys[::5] for k in keys if bits(q, k) <= radius}
    assert set(found) == want and len(found) == len(want)
    assert block_tables(frame, radius).count() == (radius + 1) * len(keys)


def test_texts_beside_the_next_whatever_the_buckets(spark):
    rows = [(i * 3 % 101, f"text {i} " + "ü word " * (i % 9)) for i in range(100)] + [(500, None), (501, ""), (502, "x" * 100_000)]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, target int, guest string")
    order = sorted(rows, key=lambda r: -r[0])
    want = {d: (len(t or ""), hashlib.sha256(edited(t or "", n or "").encode()).hexdigest()) for (d, t), (_, n) in zip(order, order[1:] + order[:1], strict=True)}
    for buckets in (1, 4, 30):
        found = compare_with_next(docs, buckets=buckets).collect()
        assert {r.doc_id: (r.n_chars, r.edited_sha256) for r in found} == want and len(found) == len(rows)


def test_likeness(spark):
    text = "some words that tell of an old house upon a hill by the sea " * 3
    rows = [(5, text), (4, text), (3, text + "more"), (2, "nothing at all like the others in this table of texts"), (1, "")]
    found = {r.doc_id: r for r in compare_with_next(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found[5].near_next == 1 and found[5].near_edited > 0.6 and (found[5].high, found[5].low) == (found[4].high, found[4].low)
    assert found[4].near_next > 0.9 > found[3].near_next
    assert (found[1].high, found[1].low) == (0, 0) and found[1].near_edited == 1


def test_nulls_repeats_and_empty_tables(spark):
    docs = spark.createDataFrame([(None, "a b"), (None, None), (1, "a b"), (1, "a b")], "doc_id long, text string")
    assert fingerprint(docs).count() == 4 and compare_with_next(docs).count() == 4
    assert len({(r.high, r.low) for r in fingerprint(docs).collect()}) == 2
    assert compare_with_next(docs.where("false")).count() == 0
    assert compare_with_next(docs.where("doc_id = 1").limit(1)).first().near_next == 1


def test_query(spark, sf_dir, duck):
    rows = duck.sql("SELECT doc_id, coalesce(text, '') FROM documents ORDER BY doc_id DESC").fetchall()
    found = {r.doc_id: r for r in op5_document_fingerprints(spark, sf_dir).collect()}
    assert len(found) == len(rows)
    for (d, t), (n, u) in zip(rows, rows[1:] + rows[:1], strict=True):
        r = found[d]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited(t, u).encode()).hexdigest())
        assert r.near_next == pytest.approx(1 - (int(r.fingerprint, 16) ^ int(found[n].fingerprint, 16)).bit_count() / 128)
        assert r.near_edited == pytest.approx(1 - (int(r.fingerprint, 16) ^ int(r.edited_fingerprint, 16)).bit_count() / 128)
        if d % 100 == 0:
            assert r.n_near == sum((int(r.fingerprint, 16) ^ int(o.fingerprint, 16)).bit_count() <= 3 for o in found.values())
