"""Progress, counts and warnings while a run goes on."""

import gzip

from lodestrand.options import Options
from lodestrand.plans import sinks
from lodestrand.plans.events import Events
from lodestrand.plans.validation import validate


def test_a_run_tells_what_it_does(spark, tmp_path):
    (tmp_path / "a.fasta").write_text(">PROT1 d\nMKV\n>PROT2 d\nMK\n")
    (tmp_path / "b.fasta").write_text(">PROT3 d\r\nMKV\r\n", newline="")
    (tmp_path / "c.fasta.gz").write_bytes(gzip.compress(b">PROT4 d\nM"))
    (tmp_path / "d.fasta.gz").write_bytes(b"\x1f\x8b cut")
    told, seen = [], []
    events = Events(status=lambda x: told.append(("status", x)), warning=lambda x: told.append(("warning", x)), error=lambda x: told.append(("error", x)), progress=lambda *x: seen.append(x), every=0.01)
    run = validate(spark, str(tmp_path), Options(), events=events)
    assert run.totals == {"lines": 8, "proteins": 4, "residues": 9, "skipped_lines": 0}
    assert [x for k, x in told if k == "status"] == ["file-ranges", "classified-lines", "4 proteins, 9 residues, 8 lines"]
    assert [x.rsplit("/", 1)[1].split(":")[0] for k, x in told if k == "error"] == ["d.fasta.gz"]
    assert {s for s, *_ in seen} == {"file-ranges", "classified-lines"} and all(0 <= done <= n for _, done, n in seen)
    written = sinks.write_normalised_files(run, str(tmp_path / "out"))
    assert written.count() == 1 and (tmp_path / "out" / "CRLF_a.fasta").read_bytes() == b">PROT1 d\r\nMKV\r\n>PROT2 d\r\nMK\r\n"
    assert ("warning", "1 gzipped files keep their line ends") in told


def test_a_silent_run(spark, tmp_path):
    (tmp_path / "a.fasta").write_text(">PROT1 d\nMKV\n")
    assert validate(spark, str(tmp_path)).totals["proteins"] == 1
