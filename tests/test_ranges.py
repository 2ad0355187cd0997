"""Files read by ranges of bytes: every line once, whatever the cut; blocks of gzip; files that cannot be read."""

import gzip
import random
import struct
import zlib

import pytest

from lodestrand.options import Options
from lodestrand.plans.validation import validate
from lodestrand.sources import ranges
from lodestrand.sources.files import file_sizes


def cut(data, start, stop, rng):
    at = start
    while at < len(data):
        inside = at < stop
        part = data[at : min(at + rng.randrange(1, 6), stop) if inside else at + rng.randrange(1, 6)]
        yield part, inside
        at += len(part)


def test_every_line_is_in_one_range():
    rng = random.Random(1)
    for _ in range(3000):
        data = bytes(rng.choice(b"ab\r\n") for _ in range(rng.randrange(30)))
        size = rng.choice([1, 2, 3, 5, 7, 40])
        found = []
        for start in range(0, max(len(data), 1), size):
            for lines in ranges.lines_of(cut(data, start, min(start + size, len(data)), rng), start == 0):
                found += lines
        assert found == data.splitlines(True)


def blocked(data, size):
    """Gzip in blocks that tell their size in the header's extra field, and the empty block at the end."""
    out = b""
    for part in [data[i : i + size] for i in range(0, len(data), size)] + [b""]:
        pack = zlib.compressobj(6, zlib.DEFLATED, -15)
        body = pack.compress(part) + pack.flush()
        out += struct.pack("<4BI2BHBBHH", 31, 139, 8, 4, 0, 0, 255, 6, 66, 67, 2, len(body) + 25) + body + struct.pack("<II", zlib.crc32(part), len(part))
    return out


def read(spark, files, size):
    parts = ranges.splits(files, size)
    sums = ranges.range_sums(parts).cache()
    rows = ranges.range_lines(parts, sums).collect()
    told = {r.file.rsplit("/", 1)[1]: r for r in ranges.file_sums(sums).collect()}
    lines = {}
    for r in sorted(rows, key=lambda r: r.line_no):
        name = r.file.rsplit("/", 1)[1]
        lines.setdefault(name, []).append(r.line)
        assert r.line_no == len(lines[name])
    return lines, told


@pytest.fixture
def folder(tmp_path):
    rng = random.Random(4)
    text = b"".join(b">P%d d\n%s\n" % (i, bytes(rng.choices(b"ACDEFGHIKL", k=rng.randrange(90)))) for i in range(2000))
    (tmp_path / "lf.fasta").write_bytes(text)
    (tmp_path / "crlf.fasta").write_bytes(text.replace(b"\n", b"\r\n"))
    (tmp_path / "cr.fasta").write_bytes(text.replace(b"\n", b"\r"))
    (tmp_path / "_hidden c+d%.fasta").write_bytes(text.rstrip(b"\n"))
    (tmp_path / ".dot.faa").write_bytes(b"\xef\xbb\xbf>A b\n\rMKV\xff")
    (tmp_path / "none.fasta").write_bytes(b"")
    (tmp_path / "plain.fasta.gz").write_bytes(gzip.compress(text))
    (tmp_path / "two.fasta.gz").write_bytes(gzip.compress(text[:5000]) + gzip.compress(text[5000:]))
    (tmp_path / "blocks.fasta.gz").write_bytes(blocked(text, 3000))
    return tmp_path, text.decode().splitlines()


@pytest.mark.parametrize("size", [3001, 1 << 20])
def test_lines_ends_and_names(spark, folder, size):
    path, text = folder
    lines, told = read(spark, file_sizes(spark, str(path)), size)
    for name in ("lf.fasta", "crlf.fasta", "cr.fasta", "_hidden c+d%.fasta", "plain.fasta.gz", "two.fasta.gz", "blocks.fasta.gz"):
        assert lines[name] == text and told[name].lines == len(text) and told[name].fault is None, name
    assert lines[".dot.faa"] == [">A b", "", "MKV�"]
    kinds = {n: (t.terminator, t.ends_with_newline) for n, t in told.items()}
    assert (kinds["lf.fasta"], kinds["crlf.fasta"], kinds["cr.fasta"]) == (("LF", True), ("CRLF", True), ("CR", True))
    assert kinds[".dot.faa"] == ("LFCR", False) and kinds["_hidden c+d%.fasta"] == ("LF", False) and told["none.fasta"].lines == 0
    if size == 3001:
        many = ranges.range_sums(ranges.splits(file_sizes(spark, str(path)), size)).where("lines > 0").groupBy("file").count().collect()
        wide = {r.file.rsplit("/", 1)[1] for r in many if r["count"] > 3}
        assert wide >= {"lf.fasta", "cr.fasta", "blocks.fasta.gz"} and "plain.fasta.gz" not in wide


def test_a_cut_file_is_a_finding(spark, tmp_path):
    (tmp_path / "bad.fasta.gz").write_bytes(gzip.compress(b">PROT1 d\n" + bytes(random.Random(2).choices(b"ACGT", k=9000)))[:1500])
    (tmp_path / "odd.fasta.gz").write_bytes(b"no gzip at all")
    (tmp_path / "_good.fasta").write_text(">PROT1 d\nMKV\n")
    run = validate(spark, str(tmp_path), Options(strict_eof=True))
    found = sorted((r.file.rsplit("/", 1)[1], r.code, r.level, r.line_no, r.col) for r in run.findings.collect())
    assert found == [("bad.fasta.gz", 0, "Error", 0, 0), ("odd.fasta.gz", 0, "Error", 0, 0)]
    assert all(r.message.startswith("Unspecified error (") for r in run.findings.collect())
    counts = {r.file.rsplit("/", 1)[1]: (r.proteins, r.residues, r.errors) for r in run.summary.collect()}
    assert counts == {"bad.fasta.gz": (0, 0, 1), "odd.fasta.gz": (0, 0, 1), "_good.fasta": (1, 3, 0)}


def test_folders_are_listed_level_by_level(spark, tmp_path):
    for at in ("a.fasta", "x/b.FAA", "x/_y/c.fasta.gz", "x/_y/z/d.fasta", "x/e.txt"):
        (tmp_path / at).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / at).write_bytes(b"12345")
    names = lambda paths=str(tmp_path), **k: sorted(r.file.rsplit("/", 1)[1] for r in file_sizes(spark, paths, **k).collect())
    assert names() == ["a.fasta"]
    assert names(recursive=True, depth=1) == ["a.fasta", "b.FAA"]
    assert names(recursive=True) == ["a.fasta", "b.FAA", "c.fasta.gz", "d.fasta"]
    assert names(recursive=True, extensions=None) == ["a.fasta", "b.FAA", "c.fasta.gz", "d.fasta", "e.txt"]
    assert names([f"{tmp_path}/a.fasta", f"{tmp_path}/*", f"{tmp_path}/x/e.txt"]) == ["a.fasta", "b.FAA", "e.txt"]
    assert {r.size for r in file_sizes(spark, str(tmp_path), True).collect()} == {5}


@pytest.mark.parametrize("asked", [["file"], ["file", "line_no", "line"]])
def test_lines_are_on_no_side_of_a_join(spark, folder, asked):
    """The planner takes lines for as few as the ranges they are read from, and would broadcast them."""
    parts = ranges.splits(file_sizes(spark, str(folder[0])), 3001)
    plan = ranges.range_lines(parts, ranges.range_sums(parts).cache()).select(*asked)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "Join" not in plan.split("MapInArrow")[0]
