"""Every query of this list against its SQL, and the pipeline against the operators' brute-force versions."""

import pytest
from conftest import shown

from lodestrand.llm.queries import ORACLE_SQL, QUERIES


def test_names():
    assert sorted(int(q[2:].split("_")[0]) for q in QUERIES) == list(range(1, 14))
    assert set(ORACLE_SQL) <= set(QUERIES) and all(isinstance(s, str) for s in ORACLE_SQL.values())


@pytest.mark.parametrize("name", ORACLE_SQL)
def test_query_equals_sql(spark, sf_dir, duck, name):
    assert shown(QUERIES[name](spark, sf_dir).toPandas()) == shown(duck.sql(ORACLE_SQL[name]).df())


def test_pipeline(spark, sf_dir, tmp_path):
    import corpus_pipeline as C
    from test_line_dedup import brute as lines_brute
    from test_near_copies import groups as near_groups
    from test_packing import held, whole
    from test_secrets import ROLE
    from test_secrets import brute as secrets_brute

    from lodestrand.llm.toxicity import fit, held_out, with_score

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    odd = spark.createDataFrame([(None, None, None, None, None), (10**6, "", "en", "s", 0), (10**6, "", "en", "s", 0), (10**6 + 1, "x " * 100_000, None, "s", 1)], docs.schema)
    docs = docs.unionByName(odd)
    at = docs
    for name, stage in C.STAGES[:-1]:
        before = {(r.doc_id, r.text) for r in at.collect()}
        n = at.count()
        out = stage(spark, at, sf_dir)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        path = f"file://{tmp_path}/{name}"
        out.write.parquet(path)
        rows = [(r.doc_id, r.text) for r in at.collect()]
        at = spark.read.parquet(path)
        after = sorted(((r.doc_id, r.text or "") for r in at.collect()), key=str)
        if name == "toxicity":
            labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
            scored = with_score(docs, fit(docs, labels.where(~held_out()))).where("score < 0.5").collect()
            assert {(r.doc_id, r.text) for r in at.collect()} <= before and after == sorted(((r.doc_id, r.text or "") for r in scored), key=str)
        if name == "line_dedup":
            assert after == sorted(((i, t) for i, t, *_ in lines_brute(rows)), key=str)
        if name == "near_dedup":
            members = {}
            for (i, _), g in zip(rows, near_groups(rows), strict=True):
                members.setdefault(g, []).append(i)
            assert sorted((i for i, _ in after), key=str) == sorted((min((i for i in m if i is not None), default=None) for m in members.values()), key=str)
        if name == "secret_scan":
            assert len(after) == n
            plain = {i: t for i, t in rows}
            assert all((t != (plain[i] or "")) == any(ROLE[s[3]] != "endpoint" for s in secrets_brute(plain[i])) for i, t in after)
    rows = [(r.doc_id, r.text or "") for r in at.collect()]
    held(C.STAGES[-1][1](spark, at, sf_dir).collect(), [[*e.ids, 2] for e in whole().encode_batch([t for _, t in rows], add_special_tokens=False)], 4096)


def test_pipeline_runs_on_no_documents(spark, sf_dir):
    import corpus_pipeline as C

    at = spark.read.parquet(f"{sf_dir}/documents.parquet").where("false")
    for _, stage in C.STAGES:
        at = stage(spark, at, sf_dir)
    assert at.count() == 0
