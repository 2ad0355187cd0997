"""Suffix arrays and maximal repeats of small texts against all substrings."""

import random

from lodestrand.llm.suffixes import SuffixArray, maximal_repeats


def brute(texts, least):
    """Every maximal repeat with all its occurrences (text, place)."""
    met = {}
    for k, t in enumerate(texts):
        for i in range(len(t)):
            for n in range(least, len(t) - i + 1):
                met.setdefault(t[i : i + n], []).append((k, i))
    found = {}
    for w, places in met.items():
        right = [texts[k][i + len(w) : i + len(w) + 1] for k, i in places]
        left = [texts[k][i - 1 : i] if i else b"" for k, i in places]
        if len(places) > 1 and all(len(set(x)) > 1 or b"" in x for x in (left, right)):
            found[w] = sorted(places)
    return found


def test_maximal_repeats_equal_brute_force():
    rng = random.Random(1)
    for trial in range(400):
        texts = [bytes(rng.choice(b"ab\0" if trial % 5 == 0 else b"ab") for _ in range(rng.randrange(14))) for _ in range(rng.randrange(1, 6))]
        texts += texts[:2] if trial % 3 == 0 else []
        least = rng.choice([1, 2, 3, 4, 8])
        suffixes = SuffixArray(texts, least)
        groups, covered = maximal_repeats(suffixes)
        places = [(int(suffixes.owner[p]), int(p - suffixes.starts[suffixes.owner[p]])) for p in suffixes.order]
        assert [texts[k][i:] for k, i in places] == sorted(t[i:] for t in texts for i in range(len(t)) if len(t) - i >= least)
        found = {texts[places[a][0]][places[a][1] :][:n]: sorted(places[a : b + 1]) for a, b, n in groups.tolist()}
        want = brute(texts, least)
        assert found == want and len(groups) == len(want)
        assert covered.tolist() == [max((len(w) for w, at in want.items() if p in at), default=0) for p in places]


def test_one_letter_over_and_over():
    suffixes = SuffixArray([b"a" * 3000], 200)
    groups, covered = maximal_repeats(suffixes)
    assert {tuple(g) for g in groups.tolist()} == {(r, 2800, 200 + r) for r in range(2800)}
    assert max(covered.tolist()) == 2999


def test_no_texts():
    groups, covered = maximal_repeats(SuffixArray([], 200))
    assert len(groups) == len(covered) == 0
    assert len(SuffixArray([b"", b"abc"], 200).order) == 0
