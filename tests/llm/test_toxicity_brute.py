"""The two models' ratios, and a text's evidence, against plain loops."""

import math
import re
from collections import Counter

import numpy as np
import pytest

from lodestrand.llm.toxicity import SHARED, STEPS, ToxicityModel, _Scorer, model_table

PLAIN = "house garden river morning bread table window go home summer letter forest music winter".split()
BAD = "vilescum hatefilth vilescums".split()


def labelled():
    rng, rows = np.random.default_rng(4), [(None, 1), ("", 0), (" ... !!", 1), ("Österreich ÄRGER 12", 0)]
    for i in range(160):
        words = [str(w) for w in rng.choice(PLAIN, int(rng.integers(5, 30)))]
        if i % 4 == 0:
            words[int(rng.integers(len(words)))] = str(rng.choice(BAD)) + "!"
        if i % 4 == 1:
            words += ["go", "home,"] if i % 8 == 1 else ["home", "go"]
        rows.append((" ".join(words), int(i % 4 == 0 or i % 8 == 1)))
    return rows


def words_of(text):
    return [w for w in (re.sub(r"^[\W_]+|[\W_]+$", "", x) for x in (text or "").lower().split()) if w]


def chain(text):
    """(step before, step) of every word of a text, its pair last."""
    out, before = [], "^"
    for w in words_of(text):
        parent = ""
        for step in [*dict.fromkeys(w[:n] for n in STEPS), w + "$"]:
            out.append((parent, step))
            parent = step
        out.append((parent, f"{before} {parent}"))
        before = w
    return out


def discount(counts):
    of = Counter(counts)
    n1, n2, n3, n4 = (of[i] + 1 for i in (1, 2, 3, 4))
    y = n1 / (n1 + 2 * n2)
    d = [0.0] + [min(max(v, 0.1), k - 0.05) for k, v in ((1, 1 - 2 * y * n2 / n1), (2, 2 - 3 * y * n3 / n2), (3, 3 - 4 * y * n4 / n3))]
    return lambda n: d[min(n, 3)]


def brute(rows, evidence):
    n, docs, held = [Counter(), Counter()], [Counter(), Counter()], [Counter(), Counter()]
    for text, y in rows:
        n[y].update(chain(text))
        docs[y].update(set(chain(text)))
        held[y][""] += 1
    for k in (0, 1):
        for (_, step), v in docs[k].items():
            held[k][step] = v
    keys = set(n[0]) | set(n[1])
    cut = [discount(c.values()) for c in n]
    total, free = [Counter(), Counter()], [Counter(), Counter()]
    for k in (0, 1):
        for (h, s), v in n[k].items():
            total[k][h] += v
            free[k][h] += cut[k](v)
    under = Counter(p for w in {s[:-1] for _, s in keys if s.endswith("$") and " " not in s} for p in {"", *(w[:i] for i in STEPS), w + "$"})
    beside = Counter(s.split(" ")[0] for _, s in keys if " " in s)
    out = {}
    for h, s in keys:
        both, parent = docs[0][h, s] + docs[1][h, s], held[0][h] + held[1][h]
        if 2 * sum(docs[k][h, s] * math.log(docs[k][h, s] / (both * held[k][h] / parent)) for k in (0, 1) if docs[k][h, s]) < evidence:
            continue
        shared = beside[s.split(" ")[0]] / sum(beside.values()) if " " in s else under[s] / under[h]
        p = [(1 - SHARED) * (n[k][h, s] - cut[k](n[k][h, s]) + free[k][h] * shared) / total[k][h] + SHARED * shared if total[k][h] else shared for k in (0, 1)]
        out[s] = math.log(p[1] / p[0])
    return out


@pytest.mark.parametrize("evidence", [0.0, 6.0, 20.0])
def test_ratios_and_evidence(spark, evidence):
    rows = labelled()
    frame = spark.createDataFrame([(t or "", y) for t, y in rows], "text string, toxic int").repartition(3)
    found = [(r.key, r.llr) for r in model_table(frame, evidence).collect()]
    want = brute(rows, evidence)
    assert {k for k, _ in found} == set(want) and (evidence > 10 or any(" " in k for k in want))
    for key, value in found:
        assert value == pytest.approx(want[key], abs=1e-9)
    texts = [t or "" for t, _ in rows] + ["vilescum", "go home go", "x " * 5000 + "vilescum"]
    scores = _Scorer(ToxicityModel.of(found)).evidence([t.encode() for t in texts])
    for text, score in zip(texts, scores, strict=True):
        assert score == pytest.approx(sum(want.get(s, 0.0) for _, s in chain(text)) / max(len(words_of(text)), 1), abs=1e-9)
