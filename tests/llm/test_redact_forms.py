"""Keys written against other signs, and passwords inside endpoints."""

import pytest

from lodestrand.llm.secrets import redact

KEY = "wJalrXUtnFEMI7K7MDENGbPxRfiCYzEXAMPLEKE9"
ID = "AKIA" + "Q7" * 8

FORMS = [
    (f"{ID} aws_secret_access_key={KEY}", "[SECRET] aws_secret_access_key=[SECRET]"),
    (f"{ID} the key is {KEY}.", "[SECRET] the key is [SECRET]."),
    (f"{ID} k-{KEY}_x", "[SECRET] k-[SECRET]_x"),
    (f"{ID} {KEY}=", "[SECRET] [SECRET]="),
    (f"aws_secret_access_key={KEY} alone", f"aws_secret_access_key={KEY} alone"),
    (f"{ID} {KEY}A", f"[SECRET] {KEY}A"),
    ("at postgres://bob:geh%21m@db.host:5432/x", "at postgres://[SECRET]@db.host:5432/x"),
    ("é redis://:pa$$@w@host user=anna1", "é redis://[SECRET]@host user=anna1"),
    ("https://plain.example:80/a@b and http://a.b:80 c@d", "https://plain.example:80/a@b and http://a.b:80 c@d"),
]


@pytest.mark.parametrize("i", range(2))
def test_masked_forms(spark, i):
    docs = spark.createDataFrame([(k, ("é " * 400 if i else "") + t) for k, (t, _) in enumerate(FORMS)], "doc_id long, text string").repartition(2)
    found = {r.doc_id: r.text for r in redact(docs).collect()}
    assert found == {k: ("é " * 400 if i else "") + t for k, (_, t) in enumerate(FORMS)}
