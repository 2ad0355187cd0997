import zlib

import numpy as np
import pytest

from lodestrand.llm.toxicity import drop_toxic, fit, held_out, op6_toxicity, with_score

PLAIN = "house garden river morning bread table window summer letter forest music winter".split()
BAD = "vilescum hatefilth rotgut".split()


def documents(spark, n=500):
    rng, rows = np.random.default_rng(6), []
    for i in range(n):
        words = [str(w) for w in rng.choice(PLAIN, int(rng.integers(20, 60)))]
        if i % 4 == 0:
            for k in rng.integers(0, len(words), 4):
                words[int(k)] = str(rng.choice(BAD))
        rows.append((i, " ".join(words), int(i % 4 == 0)))
    return spark.createDataFrame([(i, t, "x", 1.0) for i, t, _ in rows], "doc_id long, text string, key string, score double").repartition(3), spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")


@pytest.fixture(scope="module")
def fitted(spark):
    docs, labels = documents(spark)
    return docs, labels, fit(docs, labels.where(~held_out()))


def test_held_out_labels_are_met(fitted):
    docs, labels, model = fitted
    rows = with_score(docs, model).join(labels, "doc_id").where(held_out()).collect()
    assert len(rows) > 50 and np.mean([(r.score >= 0.5) == r.toxic for r in rows]) >= 0.97
    kept = {r.doc_id for r in drop_toxic(docs, model).collect()}
    assert kept == {r.doc_id for r in with_score(docs, model).collect() if r.score < 0.5}


def test_odd_rows(spark, fitted):
    _, _, model = fitted
    rows = [(None, "house garden"), (None, "house garden"), (1, None), (1, ""), (2, "!!! ?"), (3, "house " * 100_000), (4, "日本語"), (5, " ".join(BAD * 3))]
    found = with_score(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()
    assert len(found) == len(rows) and all(0 <= r.score <= 1 for r in found)
    assert [r.score >= 0.5 for r in found] == [False] * 7 + [True]
    assert with_score(spark.createDataFrame([], "doc_id long, text string"), model).count() == 0


def test_without_labels_or_documents(spark):
    docs, labels = documents(spark, 20)
    assert drop_toxic(docs, fit(docs, labels.where("false"))).count() == 20
    assert drop_toxic(docs.where("false"), fit(docs.where("false"), labels)).count() == 0
    odd = spark.createDataFrame([(None, 1), (1, None), (999, 1)], "doc_id long, toxic int")
    assert drop_toxic(docs, fit(docs, odd)).count() == 20


def test_query(spark, sf_dir, duck):
    found = {r.doc_id: r for r in op6_toxicity(spark, sf_dir).collect()}
    assert len(found) == duck.sql("SELECT count(*) FROM documents").fetchall()[0][0]
    for d, r in found.items():
        assert r.held_out == (zlib.crc32(str(d).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.5)
