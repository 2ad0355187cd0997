import re

import numpy as np

from lodestrand.llm.secrets import ASSIGN, BASE, KINDS, ROLE, SCOPE, WEAK, redact, scan, secret_spans

KEY = "wJalrXUtnFEMI7K7MDENGbPxRfiCYzEXAMPLEKE9"
TEXTS = [
    "password=hunter22 and api-key no", "API_KEY: 'abcdef123'", "token = abc", "AKIA" + "A" * 15, "AKIA" + "Z9" * 8 + "x", "f" * 23, "0f" * 12, "secret=" + "ab" * 20,
    f"user: bob99 {KEY}", f"{KEY}", f"{KEY} " + "x" * 400 + " login=bob99", "postgres://db.host:5432 password: geheim99", "https://plain.example only", None, "", "é" * 50 + " passwd:=secret", 'é "token": "ünï" token:"AbC.d+/=9"',
    "user=anna1 " * 300 + KEY, "x" * 200_000 + " secret=abcdefgh", "password=password=abcdef token=secret:abcdef",
]


def brute(text):
    text, found = text or "", []
    for kind, pattern in (BASE | WEAK).items():
        for m in re.finditer(pattern, text):
            if kind == "assign" and len(m[2]) < 6:
                continue
            if kind == "weak_key" and not (len(m[0]) == 40 and not re.search("[_=.-]", m[0]) and all(re.search(c, m[0]) for c in ("[0-9]", "[a-z]", "[A-Z]"))):
                continue
            found.append((m.start(), KINDS.index(kind), m.end(), kind))
    near = lambda w: any(ROLE[p[3]] != ROLE[w[3]] and "secret" in (ROLE[p[3]], ROLE[w[3]]) and p[0] < w[2] + SCOPE and p[2] > w[0] - SCOPE for p in found)
    return sorted(s for s in found if s[3] in BASE or near(s))


def random_texts():
    rng = np.random.default_rng(4)
    parts = ["password=abc123", "user=bob99", KEY, "https://a.b", "AKIA" + "Q" * 16, "deadbeef" * 3, "word " * 20, "lorem " * 60, "\n", "token:", '"']
    return [" ".join(str(x) for x in rng.choice(parts, int(rng.integers(0, 9)))) for _ in range(60)]


def told(spans):
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in spans)


def test_spans_equal_brute_force(spark):
    texts = TEXTS + random_texts()
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, TEXTS[0]), (0, TEXTS[0]), (0, TEXTS[5])]
    docs = spark.createDataFrame([(*r, "a", 1, "b") for r in rows], "doc_id long, text string, kind string, start int, spans string").repartition(4)
    found = sorted(((str(r.doc_id), r.text, r.spans, r.base, r.n_assign, r.n_access, r.n_hex, r.n_linked) for r in scan(docs).collect()), key=str)
    want = []
    for i, t in rows:
        s = brute(t)
        n = [sum(x[3] == k for x in s) for k in BASE]
        want.append((str(i), t or "", told(s), told([x for x in s if x[3] in BASE]), *n, sum(x[3] in WEAK for x in s)))
    assert found == sorted(want, key=str)
    assert any("weak_key" in w[2] for w in want) and any("weak_user" in w[2] for w in want) and any("weak_endpoint" in w[2] for w in want)


def test_redacted_texts_hold_no_secret_and_nothing_else_changes(spark):
    texts = TEXTS + random_texts()
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, _cuts string").withColumnRenamed("_cuts", "kind").repartition(3)
    found = redact(docs)
    assert found.columns == docs.columns
    for r in found.collect():
        text, out, at = texts[r.doc_id], "", 0
        merged = []
        for a, _, b, k in brute(text):
            if ROLE[k] == "endpoint":
                continue
            if merged and a <= merged[-1][1]:
                merged[-1][1] = max(b, merged[-1][1])
            else:
                merged.append([a, b])
        for a, b in merged:
            out, at = out + text[at:a] + "[SECRET]", b
        assert r.text == (text if not merged else out + text[at:])


def test_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert scan(none).count() == 0 and redact(none).count() == 0 and secret_spans(none).count() == 0
    assert ASSIGN.startswith("(")
