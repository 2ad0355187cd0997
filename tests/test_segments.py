"""Entries in segments against the same entries in one cell."""

import hashlib
import random

import pytest

from lodestrand.operators import records, segments
from lodestrand.options import Options
from lodestrand.plans.validation import Validation


def text_of():
    rng = random.Random(6)
    line = lambda n: "".join(rng.choices("ACGTMKVLI", k=n))
    out = []
    for i in range(12):
        out += [f">PROT{i:03d} about"] + [line(rng.choice([0, 7, 60, 60, 133])) + rng.choice(["", "", " ", "*"]) for _ in range(rng.choice([1, 3, 40, 90]))]
    out += [">STARS ends", line(60), line(60) + "**", "****", "", "*" * 60]
    out += [">ALLSTARS", "*" * 60, "*" * 60, "***"]
    out += [">DNA all", *[rng.choice(["ACGT", "GGCA"]) * 15 for _ in range(30)], ">LAST", "MKV"]
    return "\n".join(out)


@pytest.mark.parametrize("more", [{}, {"fix": True, "consolidate": True, "ignore_il": True, "remove_invalid_residues": True}])
def test_a_run_in_segments_equals_one_in_cells(spark, more):
    lines = spark.createDataFrame([("f", i + 1, x) for i, x in enumerate(text_of().split("\n"))], "file string, line_no long, line string").repartition(3)
    runs = [Validation(lines, Options(max_residues_per_line=70, **more), cell=c) for c in (segments.CELL, 150)]
    assert runs[0].assembled[1] is None and runs[1].assembled[1] is not None
    for told in ("hashes", "nucleic", "unique", "all_findings", "fixed_lines", "summary"):
        plain, cut = (sorted(map(str, getattr(r, told).collect())) for r in runs)
        assert plain == cut and plain, told


def test_segments_are_bounded_and_whole(spark):
    rows = [("f", 1, i + 1, 100, f"{i % 10}" * 100, False) for i in range(500)] + [("g", 1, 1, 7, "ABCDEFG" * 10_000, False), ("g", 2, 1, 3, "***", False)]
    lines = spark.createDataFrame(rows, "file string, ordinal long, line_no long, raw long, clean string, changed boolean").repartition(5)
    parts = segments.segments(lines, Options(), size=1000)
    found = {}
    for r in parts.orderBy("file", "ordinal", "segment").collect():
        assert len(r.residues) <= 1000 and r.width * r.per_segment <= 1000
        found.setdefault((r.file, r.ordinal), []).append(r.residues)
    want = {("f", 1): "".join(x[4] for x in rows[:500]), ("g", 1): "ABCDEFG" * 10_000}
    assert {k: "".join(v) for k, v in found.items()} == want
    assert all(len(x) == len(v[0]) for v in found.values() for x in v[:-1])
    sums = {(r.file, r.ordinal): r for r in segments.segment_sums(parts).collect()}
    for k, whole in want.items():
        assert sums[k].Sequence_Hash == hashlib.sha1(whole.encode()).hexdigest().upper() and sums[k].n_residues == len(whole) and sums[k].start == whole[:20]
    wide = {}
    for r in segments.wrapped_segments(parts).orderBy("file", "part").collect():
        wide.setdefault((r.file, r.ordinal), []).append((r.part, r.line))
    for k, whole in want.items():
        width = 100 if k[0] == "f" else 120
        assert wide[k] == [(i + 1, whole[i * width : (i + 1) * width]) for i in range(-(-len(whole) // width))]


def test_no_long_entry(spark):
    lines = spark.createDataFrame([], "file string, line_no long, line string")
    whole, parts = segments.assembled(records.classify(lines), Options(), 10)
    assert parts is None and whole.count() == 0
