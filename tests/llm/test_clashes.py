"""Tables that have columns named as the operators name their own."""

import pytest

from lodestrand.llm import perplexity as P
from lodestrand.llm.line_dedup import drop_shared_lines
from lodestrand.llm.near_copies import keep_one_near
from lodestrand.llm.secrets import redact
from lodestrand.llm.simhash_trie import keep_one

NAMES = ["_cuts", "_cut_id", "_cut_hash", "_row_id", "_ROW_HASH", "_drop_id", "_drop_hash", "_dropped", "_h1", "_h2", "_perplexity", "node", "root", "bucket"]
LINE = "this line is long enough to count as one that many share"


@pytest.fixture(scope="module")
def docs(spark):
    texts = [f"{LINE}\nown {i} password=hunter{i}22" for i in range(6)] + [None, ""]
    return spark.createDataFrame([(i, t, *(f"{n}{i}" for n in NAMES)) for i, t in enumerate(texts)], "doc_id long, text string, " + ", ".join(f"{n} string" for n in NAMES)).repartition(3)


def model(docs, size):
    return P.language_model(docs.where("text <> ''").select("text"), broadcast_bytes=size)


@pytest.mark.parametrize("operator", [redact, keep_one, keep_one_near, drop_shared_lines, lambda d: drop_shared_lines(d, broadcast_bytes=0), lambda d: P.with_perplexity(d, model(d, 0)), lambda d: P.with_perplexity(d, model(d, 1 << 20))])
def test_columns_pass_through(docs, operator):
    found = operator(docs)
    assert found.columns[: len(docs.columns)] == docs.columns
    for r in found.collect():
        assert [r[n] for n in NAMES] == [f"{n}{r.doc_id}" for n in NAMES]
