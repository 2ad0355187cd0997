import numpy as np
import pytest

from lodestrand.llm import perplexity as P

GOOD = ["the cat sat on the mat and looked at the dog", "a dog ran over the hill to the old house", "the house on the hill has a red door and a cat"]


def documents(spark):
    rows = [(i, f"{GOOD[i % 3]} {i} {GOOD[(i * 7 + 1) % 3]}", "en") for i in range(300)]
    rows += [(1000, "zqxj kvw qqq xzx jjk wvq " * 4, "en"), (1001, "", "en"), (1002, None, "en"), (1003, GOOD[0], None), (None, GOOD[1], "en"), (None, GOOD[1], "en"), (1004, GOOD[2] * 5000, "xx"), (1005, "日本語" * 30, "ja")]
    return spark.createDataFrame([(*r, 1, 2, "x") for r in rows], "doc_id long, text string, lang string, gram int, h1 int, perplexity string").repartition(3)


@pytest.fixture(scope="module")
def fitted(spark):
    docs = documents(spark)
    return docs, P.fit(docs, docs.where("doc_id < 300").select("doc_id"))


@pytest.mark.parametrize("order", [1, 2, 4])
def test_probabilities_sum_to_one(spark, order):
    trusted = spark.createDataFrame([(t,) for t in GOOD], "text string")
    model = P.language_model(trusted, order)
    contexts = np.random.default_rng(0).integers(0, 32 ** (order - 1), 200) if order > 1 else np.zeros(1, np.int64)
    seen = P.grams([GOOD[0].encode()], order)[0] >> 5
    for context in [*contexts, *seen]:
        assert np.exp(model.tables.value.log_p((int(context) << 5) | np.arange(32))).sum() == pytest.approx(1, abs=1e-5)


def test_gram_counts_equal_brute_force_however_little_a_task_holds(spark):
    texts = [*GOOD, "", "ÄÖ 12!"]
    codes, sizes = P.grams([t.encode() for t in texts], 3)
    assert sizes.tolist() == [len(t.encode()) for t in texts]
    want = dict(zip(*map(np.ndarray.tolist, np.unique(codes, return_counts=True)), strict=True))
    frame = spark.createDataFrame([(t,) for t in texts], "text string")
    for held in (1, 10_000):
        assert {r.gram: r.n for r in P.gram_counts(frame, 3, held).collect()} == want


def test_joins_and_memory_give_the_same_numbers(spark, fitted):
    docs, model = fitted
    rows = lambda m: sorted(((str(r.doc_id), r.perplexity) for r in P.with_perplexity(docs, m).collect()), key=str)
    for (a, x), (b, y) in zip(rows(model), rows(P.QualityModel(model.levels, None)), strict=True):
        assert a == b and (x is None) == (y is None) and (x is None or x == pytest.approx(y, rel=1e-5))


def test_verdicts(spark, fitted):
    docs, model = fitted
    rows = P.classify(docs, model).collect()
    assert len(rows) == docs.count()
    kept = {r.doc_id: r.kept for r in rows if r.doc_id is not None}
    assert all(kept[i] for i in range(300)) and kept[1003]
    assert not any(kept[i] for i in (1000, 1001, 1002, 1005))
    assert [r.kept for r in rows if r.doc_id is None] == [True, True]


def test_without_documents_or_trusted_text(spark):
    docs = documents(spark)
    none = docs.where("false")
    assert P.classify(none, P.fit(none, none.select("doc_id"))).count() == 0
    free = P.classify(docs, P.fit(docs, none.select("doc_id"))).collect()
    assert sum(r.kept for r in free) == len(free) - 2


def test_query_keeps_good_documents(spark, duck, sf_dir):
    found = {r.doc_id: r.kept for r in P.op9_quality_classifier(spark, sf_dir).collect()}
    assert len(found) == duck.sql("SELECT count(*) FROM documents").fetchall()[0][0]
    good = [found[i] for (i,) in duck.sql("SELECT doc_id FROM labels JOIN documents USING (doc_id) WHERE quality = 1").fetchall()]
    assert np.mean(good) >= 0.95
