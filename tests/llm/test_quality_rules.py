import math
import re
from collections import Counter

import pytest

from lodestrand.llm import quality_rules as Q

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TEXTS = [
    ("the cat and the dog are in the house of the king " * 3, "en"), ("a b c a b c a b", "en"), ("", "en"), (None, "en"), ("x y", None), ("# $ % & | < > *", "zz"), ("line one\nline one\n\n \nline two\nline one", "en"), ("aaa bbb ÄÖ ä\x0bq\x1cr", "de"),
    (" ".join(f"w{i}" for i in range(120)), "en"), ("der die und in den " * 60, "de"), ("z " * 30_000, "fr"), ("日本語 テキスト です " * 20, "es"), ("the of and to in is that for it was on are as with " * 20, "en"),
]


def base(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    many = Counter(windows)
    repeated = {i + k for i, w in enumerate(windows) if many[w] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeated)


def test_counts_and_verdicts_equal_brute_force(spark):
    rows = [(i, t, lang) for i, (t, lang) in enumerate(TEXTS)] + [(None, *TEXTS[0]), (0, *TEXTS[0])]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, lang string, n_words int, characters string").repartition(3)
    found = Q.judge(docs).collect()
    assert len(found) == len(rows)
    by_id = {i: base(t) for i, t, _ in rows}
    for r in found:
        want = by_id[r.doc_id]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert r.kept == (not r.base_failed and (r.character_distance or 0) <= Q.MAX_CHARACTER_DISTANCE and (r.word_distance or 0) <= Q.MAX_WORD_DISTANCE)
        assert (r.word_distance is None) == (want[0] < Q.MIN_WORDS_COMPARED or r.lang not in Q.COMMON_WORDS)


@pytest.mark.parametrize(("a", "b", "want"), [([1, 1], [5, 5], 0.0), ([3, 0], [0, 9], 1.0), ([1, 0], [1, 1], None), ([0, 0], [1, 1], "none")])
def test_divergence(spark, a, b, want):
    found = spark.createDataFrame([(a, b)], "a array<long>, b array<long>").select(Q.divergence("a", "b").alias("d")).first().d
    if want is None:
        p, q = [x / sum(a) for x in a], [x / sum(b) for x in b]
        want = math.sqrt(sum(x * math.log2(x / ((x + y) / 2)) / 2 for u, v in ((p, q), (q, p)) for x, y in zip(u, v, strict=True) if x))
    assert found is None if want == "none" else found == pytest.approx(want)


def test_histograms_are_those_of_the_text(spark):
    row = Q.text_statistics(spark.createDataFrame([(1, "The cat, of 12 <dogs>!\n", "en")], "doc_id long, text string, lang string")).first()
    assert row.characters == [11, 1, 2, 5, 2, 2, 0]
    assert row.common[0] == 1 and row.common[1] == 1 and sum(row.common) == row.n_words


def test_empty_table(spark):
    assert Q.judge(spark.createDataFrame([], "doc_id long, text string, lang string")).count() == 0


def test_trusted_references_make_a_verdict_its_own(spark):
    kind = "doc_id long, text string, lang string"
    trusted = spark.createDataFrame([(i, TEXTS[12][0], "en") for i in range(3)], kind)
    one = spark.createDataFrame([(1, TEXTS[12][0] + " and a bird", "en")], kind)
    crowd = one.unionByName(spark.createDataFrame([(10 + i, "zq xj kv " * 100, "en") for i in range(50)], kind))
    alone, among = (next(r for r in Q.judge(d, trusted=trusted).collect() if r.doc_id == 1) for d in (one, crowd))
    assert alone == among and alone.word_distance is not None


def test_trusted_ids_stand_for_the_documents_they_name(spark):
    rows = [(i, *TEXTS[i % len(TEXTS)]) for i in range(40)] + [(None, *TEXTS[0])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    ids = spark.createDataFrame([(9,), (12,), (12,), (8,), (None,), (999,)], "doc_id long")
    texts = spark.createDataFrame([r for r in rows if r[0] in (8, 9, 12)], docs.schema)
    by_ids, by_texts = (sorted(map(str, Q.judge(docs, trusted=t).collect())) for t in (ids, texts))
    assert by_ids == by_texts and len(by_ids) == len(rows)
    assert all(r.kept == (not r.base_failed) for r in Q.judge(docs, trusted=ids.limit(0)).collect())
