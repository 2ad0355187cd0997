import hashlib
import itertools
import random
import re
import zlib

import pytest

from lodestrand.llm import turn_repair as R

GRAMMAR = re.compile("(s?(ua)+)?")
SPACE = " \t\n\x0b\x0c\r"


def damage(rows):
    """Rows of a conversation in the order of their turns, after damage."""
    out = []
    for c, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind:
            row = (turn, "user" if kind == 4 else role, "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text)
            out += [row] * (2 if kind == 3 else 1)
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        solid = text.rstrip(SPACE)
        out.append("b" if not solid else "d" if (role, text) in seen else "t" if solid[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows, marks):
    """The best of all edits by trying every one, insertions of up to two turns anywhere."""
    best = None
    gaps = [((), ("user",), ("assistant",), ("user", "assistant"), ("assistant", "user"))] * (len(rows) + 1)
    ways = [[("D", None)] + ([] if m in ("b", "d") else [("K", r[1]), ("R", "user"), ("R", "assistant")]) for r, m in zip(rows, marks, strict=True)]
    for inserts in itertools.product(*gaps):
        for edits in itertools.product(*ways):
            cost, audit, turns = 0, "", []
            for i, added in enumerate(inserts):
                cost, audit, turns = cost + 5 * len(added), audit + "I" * len(added), turns + [(r, "") for r in added]
                if i < len(rows):
                    edit, role = edits[i]
                    cost += {"D": 2, "K": 0, "R": 1}[edit] + 5 * (edit != "D" and marks[i] == "t")
                    audit += edit
                    turns += [] if edit == "D" else [(role, rows[i][2])]
            if all(r[0][:1] in "sua" and r[0] for r in turns) and GRAMMAR.fullmatch("".join(r[0][:1] for r in turns)):
                best = min(best or (cost, audit, turns), (cost, audit, turns))
    return best


def test_edits_equal_every_way_tried(spark):
    rng = random.Random(5)
    texts = ["Yes.", "No", " ", "Why?"]
    cases = [[(i, rng.choice(["system", "user", "assistant", "tool", ""]), rng.choice(texts)) for i in range(n)] for n in (0, 1, 1, 2, 2, 3, 3, 3, 3, 3, 3) for _ in range(6)]
    for rows in cases:
        marks = faults(rows)
        letter = {"": R.SOUND, "t": R.CUT, "b": R.GONE, "d": R.GONE}
        codes = "".join(letter[m][R.SOUND.index(r[1][:1] if r[1][:1] in ("s", "u", "a") else "-")] for r, m in zip(rows, marks, strict=True))
        cost, edits = R.cheapest_edits(codes)
        want = cheapest(rows, marks)
        assert (cost, edits.translate(str.maketrans("rtij", "RRII"))) == want[:2], rows


def rows_of():
    rng = random.Random(2)
    rows = [(c, t, rng.choice(["system", "user", "assistant", "user", "assistant", "tool"]), f"text {rng.randrange(4)}{rng.choice('.!? ')}") for c in range(60) for t in range(rng.randrange(1, 9))]
    rows += [(100, None, "user", "null turn."), (100, None, None, None), (100, 3, "user", ""), (100, 3, "user", ""), (101, 7, None, "x."), (None, None, None, None), (None, 1, "user", "a."), (None, 2, "assistant", "b.")]
    rows += [(200, t, ("user", "assistant")[t % 2], "y" * 200_000 + f" {t}.") for t in range(5)] + [(300, t, ("user", "assistant")[t % 2], f"long {t}.") for t in range(9000)]
    return [*rows, rows[3], rows[3], (102, 2**62, "", "empty role.")]


def lines_of(rows, edits):
    out, at = [], 0
    for e in edits:
        if e in "ij":
            out.append({"i": "user:", "j": "assistant:"}[e])
        else:
            role = {"K": rows[at][1], "r": "user", "t": "assistant"}.get(e)
            out += [] if e == "D" else [f"{role}:{rows[at][2]}"]
            at += 1
    return out


def want_of(rows):
    out = []
    for c in sorted({r[0] for r in rows}, key=str):
        own = damage([r for r in rows if r[0] == c])
        marks, turns = faults(own), [t for t, *_ in own if t is not None]
        initials = [r[1][:1] if r[1][:1] in ("s", "u", "a") else "-" for r in own]
        letter = {"": R.SOUND, "t": R.CUT, "b": R.GONE, "d": R.GONE}
        cost, edits = R.cheapest_edits("".join(letter[m][R.SOUND.index(i)] for m, i in zip(marks, initials, strict=True)))
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out.append((c, gaps, marks.count("b"), marks.count("d"), marks.count("t"), illegal, cost, edits.translate(str.maketrans("rtij", "RRII")), hashlib.sha256("\n".join(lines_of(own, edits)).encode()).hexdigest()))
    return sorted(out, key=str)


def test_query_over_odd_rows(spark, tmp_path):
    rows = rows_of()
    table = spark.createDataFrame([(*r, 1, "k", "x") for r in rows], "conv_id long, turn long, role string, text string, place int, stream string, c string").repartition(5)
    table.write.parquet(f"{tmp_path}/conversations.parquet")
    found = R.op12_conversation_repair(spark, f"file://{tmp_path}")
    assert found.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert sorted((tuple(r) for r in found.collect()), key=str) == want_of(rows)


def test_no_rows(spark, tmp_path):
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    assert R.op12_conversation_repair(spark, f"file://{tmp_path}").count() == 0


@pytest.mark.parametrize("codes, want", [("", (0, "")), ("ua", (0, "KK")), ("s", (2, "D")), ("a", (2, "D")), ("aa", (1, "rK"))])
def test_small_cases(codes, want):
    assert R.cheapest_edits(codes) == want
