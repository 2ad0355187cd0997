"""Bad documents in a trusted script beyond ASCII."""

import numpy as np
import pytest

from lodestrand.llm import perplexity as P

WORDS = ["дом", "река", "старый", "город", "вода", "и", "на", "горе", "стоит", "мост"]


@pytest.fixture(scope="module")
def mixed(spark):
    rng = np.random.default_rng(6)
    good = [(i, " ".join(str(w) for w in rng.choice(WORDS, 20)), "ru") for i in range(300)]
    junk = [(1000 + i, "".join(chr(int(c)) for c in rng.integers(0x410, 0x450, 100)), "ru") for i in range(20)]
    caps = [(2000 + i, "".join(chr(int(c)) for c in rng.integers(0x4E00, 0x9000, 60)), "ru") for i in range(20)]
    return spark.createDataFrame(good + junk + caps, "doc_id long, text string, lang string").repartition(3)


def test_junk_in_a_trusted_script_goes(mixed):
    model = P.fit(mixed, mixed.where("doc_id < 300").select("doc_id"))
    kept = {r.doc_id: r.kept for r in P.classify(mixed, model).collect()}
    assert np.mean([kept[i] for i in range(300)]) >= 0.97
    assert not any(k for i, k in kept.items() if i >= 1000)
