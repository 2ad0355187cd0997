"""Perplexities, thresholds and verdicts against plain loops."""

import math
from collections import Counter

import numpy as np
import pytest

from lodestrand.llm import perplexity as P

WORDS = {"en": "the cat sat on a mat and saw one dog".split(), "el": "και το σπίτι είναι στο βουνό με νερό".split()}


def corpus():
    rng, rows = np.random.default_rng(9), []
    for i in range(150):
        lang = "el" if i % 3 == 0 else "en"
        rows.append((i, " ".join(str(w) for w in rng.choice(WORDS[lang], int(rng.integers(3, 40)))), lang))
    rows += [(200 + i, "".join(chr(int(c)) for c in rng.integers(33, 127, 60)), "en") for i in range(10)]
    return [*rows, (300, None, "en"), (301, "", None), (302, "the dog sat", None), (303, "zz", "fr"), (304, "the cat " * 3000, "en")]


def grams_of(text, k):
    data = b" " * (P.ORDER - 1) + text.encode()
    return [data[i - k : i] for i in range(P.ORDER, len(data) + 1)]


class Model:
    """Interpolated modified Kneser-Ney over bytes, by dictionaries."""

    def __init__(self, texts):
        top = Counter(g for t in texts for g in grams_of(t, P.ORDER))
        self.counts = {P.ORDER: top}
        for k in range(P.ORDER - 1, 0, -1):
            self.counts[k] = Counter(g[1:] for g in self.counts[k + 1])
        self.cut, self.sums = {}, {}
        for k, counts in self.counts.items():
            of = Counter(counts.values())
            n1, n2, n3, n4 = (of[i] + 1 for i in (1, 2, 3, 4))
            y = n1 / (n1 + 2 * n2)
            d = [min(max(v, 0.1), i - 0.05) for i, v in ((1, 1 - 2 * y * n2 / n1), (2, 2 - 3 * y * n3 / n2), (3, 3 - 4 * y * n4 / n3))]
            self.cut[k] = lambda n, d=d: d[min(n, 3) - 1]
            self.sums[k] = {}
            for g, n in counts.items():
                total, rest = self.sums[k].get(g[:-1], (0, 0.0))
                self.sums[k][g[:-1]] = (total + n, rest + self.cut[k](n))

    def p(self, gram):
        below = self.p(gram[1:]) if len(gram) > 1 else 1 / 256
        k = len(gram)
        if gram[:-1] not in self.sums[k]:
            return below
        total, rest = self.sums[k][gram[:-1]]
        n = self.counts[k][gram]
        return ((n - self.cut[k](n) if n else 0) + rest * below) / total

    def perplexity(self, text):
        grams = grams_of(text, P.ORDER)
        return math.exp(-sum(math.log(self.p(g)) for g in grams) / len(grams)) if grams else None


def quantile(values):
    return sorted(values)[max(math.ceil(P.QUANTILE * len(values)), 1) - 1]


@pytest.mark.parametrize("broadcast_bytes", [P.BROADCAST_BYTES, 0])
def test_perplexities_thresholds_and_verdicts(spark, broadcast_bytes):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    ids = spark.createDataFrame([(i,) for i in range(150)], "doc_id long")
    model = P.fit(docs, ids, broadcast_bytes=broadcast_bytes)
    held = {r.doc_id for r in docs.where(f"pmod(xxhash64(doc_id), {P.HELD_OUT}) = 0").collect()}
    brute = Model([t for i, t, _ in rows if i < 150 and i not in held])
    found = {r.doc_id: r for r in P.classify(docs, model).collect()}
    size = lambda t: min(max(math.floor(math.log2(len((t or "").encode()) + 1)), 6), 12)
    told = [(lang, size(t), brute.perplexity(t)) for i, t, lang in rows if i < 150 and i in held]
    every = math.log(quantile([x for *_, x in told]))
    drawn = lambda values, wider: (len(values) * math.log(quantile(values)) + P.PRIOR * wider) / (len(values) + P.PRIOR)
    length = {c: drawn([x for _, k, x in told if k == c], every) for c in {k for _, k, _ in told}}
    own = {(lang, c): drawn([x for a, k, x in told if (a, k) == (lang, c)], length[c]) for lang, c in {(a, k) for a, k, _ in told}}
    assert len({lang for lang, _ in own}) == 2 and len(set(own.values())) > 2  # language by language
    for i, text, lang in rows:
        x, limit = brute.perplexity(text or ""), math.exp(own.get((lang, size(text)), length.get(size(text), every)))
        assert (x is None) == (found[i].perplexity is None) and (x is None or found[i].perplexity == pytest.approx(x, rel=1e-9))
        assert found[i].threshold == pytest.approx(limit, rel=1e-9)
        assert found[i].kept == (x is not None and x <= limit)


def test_languages_have_thresholds_of_their_own(spark, sf_dir):
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = P.fit(documents, spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1"))
    rows = model.thresholds.where("lang IS NOT NULL").collect()
    wider = {r.length_class: r.threshold for r in model.thresholds.where("lang IS NULL AND length_class IS NOT NULL").collect()}
    assert rows and any(abs(r.threshold - wider[r.length_class]) > 1e-6 for r in rows)
