import hashlib
import itertools
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestrand.llm.pieces import UNITS, decode, encode, model_path, op3_sentencepiece, sampler, vocabulary

TEXTS = ["the cat sat", "", None, "  two  spaces \n\n line", "日本語 🙂 é́", "x" * 50_000, "▁ sign", "tab\tand\x00null", " \n \n"]


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet=st.characters(exclude_categories=["Cs"]), max_size=60), st.integers(0, 2**64 - 1))
def test_decoding_is_lossless(text, seed):
    ids, counts = sampler(model_path(), 1.0).sample([text], np.array([seed], np.uint64))
    assert counts.tolist() == [len(ids)] and vocabulary(model_path()).decode(ids).decode() == text


def test_draws_depend_on_the_key_alone(spark):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(None, "the cat sat", "x"), (None, "the cat sat", "x"), (0, "the cat sat", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, decoded string")
    one = sorted((str(r.doc_id), str(r.text), bytes(r.ids)) for r in encode(docs.coalesce(1)).collect())
    assert one == sorted((str(r.doc_id), str(r.text), bytes(r.ids)) for r in encode(docs.repartition(7)).collect())
    assert one != sorted((str(r.doc_id), str(r.text), bytes(r.ids)) for r in encode(docs, seed=1).collect())
    back = decode(encode(docs))
    assert all(r.decoded == (r.text or "") for r in back.collect()) and back.count() == len(rows)
    assert decode(encode(docs.where("false"))).count() == 0


def test_segmentations_are_drawn_by_their_weights():
    v = vocabulary(model_path())
    pieces = {b.decode(): i for i, b in enumerate(v.bytes) if len(b) and i not in set(v.byte_id.tolist())}
    unit, weights = " then", {}
    for n in range(len(unit)):
        for cuts in itertools.combinations(range(1, len(unit)), n):
            parts = [unit[a:b] for a, b in zip((0, *cuts), (*cuts, len(unit)), strict=True)]
            if all(p in pieces for p in parts):
                weights[tuple(pieces[p] for p in parts)] = np.exp(sum(v.weight[pieces[p]] for p in parts))
    total, n = sum(weights.values()), 20_000
    ids, counts = sampler(model_path(), 1.0).sample(["then"] * n, np.random.default_rng(0).integers(0, 2**63, n).astype(np.uint64))
    drawn = Counter(tuple(x.tolist()) for x in np.split(ids, np.cumsum(counts)[:-1]))
    assert set(drawn) <= set(weights) and len(weights) > 3
    for s, w in weights.items():
        assert drawn[s] / n == pytest.approx(w / total, abs=0.012)


def test_query(spark, sf_dir, duck):
    found = op3_sentencepiece(spark, sf_dir).collect()
    assert len(found) == duck.sql("SELECT count(*) FROM documents").fetchall()[0][0]
    assert all(r.lossless for r in found)


def drawn(text, key, alpha=1.0, seed=0):
    """One text's ids by plain loops over each unit's lattice: forward sums, then steps back from the end."""
    v, mask = vocabulary(model_path()), 2**64 - 1
    pieces = {b.decode(): i for i, b in enumerate(v.bytes) if i in v.names}
    longest = max(map(len, pieces))

    def mixed(x):
        x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & mask
        x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & mask
        return x ^ (x >> 31)

    out = []
    for place, unit in enumerate(UNITS.findall(" " + text)):
        ends, forward = [[]], [0.0]
        for j in range(1, len(unit) + 1):
            edges = []
            for n in range(1, min(longest, j) + 1):
                part = unit[j - n : j]
                if part in pieces and "▁" not in part:
                    edges.append((n, alpha * v.weight[pieces[part]], [pieces[part]]))
                elif n == 1:
                    octets = part.encode()
                    edges.append((1, alpha * -np.log(len(v.bytes) + 3.0) * len(octets), [int(v.byte_id[o]) for o in octets]))
            value = [forward[j - n] + w for n, w, _ in edges]
            top = max(value)
            share = np.cumsum([np.exp(x - top) for x in value])
            forward.append(top + np.log(share[-1]))
            ends.append([(n, ids, np.float32(r)) for (n, _, ids), r in zip(edges, share / share[-1], strict=True)])
        state = mixed((xxhash.xxh64_intdigest(key, seed) + place * 0x9E3779B97F4A7C15) & mask)
        j, step, back = len(unit), 0, []
        while j:
            draw = np.float32(mixed((state + step * 0xD1B54A32D192ED03) & mask) >> 40) * np.float32(2**-24)
            n, ids, _ = next((e for e in ends[j] if draw < e[2]), ends[j][-1])
            back.append(ids)
            j, step = j - n, step + 1
        out += [i for ids in reversed(back) for i in ids]
    return out


def test_query_equals_brute_force(spark, sf_dir, duck):
    """Every document's ids, drawn anew by plain loops."""
    texts = duck.sql("SELECT doc_id, coalesce(text, '') FROM documents").fetchall()
    found = {r.doc_id: r for r in op3_sentencepiece(spark, sf_dir).collect()}
    for i, text in texts:
        ids = drawn(text, str(i))
        assert found[i].n_pieces == len(ids) and found[i].ids_crc32 == zlib.crc32(np.array(ids, "<i4").tobytes())
        assert found[i].decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_ids_do_not_depend_on_what_a_worker_holds(monkeypatch):
    texts = [t or "" for t in TEXTS] * 3
    seeds = np.arange(len(texts)).astype(np.uint64)
    one = sampler(model_path(), 1.0).sample(texts, seeds)
    monkeypatch.setattr("lodestrand.llm.pieces.RUN_CHARS", 7)
    monkeypatch.setattr("lodestrand.llm.pieces.EDGE_LIMIT", 10)
    many = sampler(model_path(), 1.0).sample(texts, seeds)
    assert all(np.array_equal(a, b) for a, b in zip(one, many, strict=True))
