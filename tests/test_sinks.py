"""Outputs as single files: their names, their bytes, their order."""

from datetime import datetime

from lodestrand.operators.hashing import sequence_duplicates
from lodestrand.options import Options
from lodestrand.plans import sinks
from lodestrand.plans.validation import validate

TEXT = ">PROT1 one\nMKVLAGMKVLAG\nMK\n>PROT2 two \nMKV*\n>PROT3\nMKV\n>PROT1 again\nACGT\n"


def folder(tmp_path):
    for at, text in (("in/a.fasta", TEXT), ("in/b c%+.faa", ">X1YZ d\nMKV\n"), ("in/x/d.fasta", ">ABCD d\nMKL"), ("in/y/d.faa", ">EFGH d\nMKI"), ("in/none.fasta", "")):
        (tmp_path / at).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / at).write_text(text)
    return str(tmp_path / "in")


def test_names_and_bytes(spark, tmp_path):
    run = validate(spark, folder(tmp_path), Options(fix=True), recursive=True)
    out = tmp_path / "out"
    told = {r.target.rsplit("/", 1)[1]: r.bytes for r in sinks.write_fixed_files(run, str(out), "\r\n").collect()}
    found = {p.name: p.read_bytes() for p in out.iterdir()}
    assert found.pop("a_new.fasta") == b">PROT1 one\r\nMKVLAGMKVLAG\r\nMK\r\n>PROT2 two\r\nMKV\r\n>PROT3\r\nMKV\r\n"
    assert found.pop("b c%+_new.fasta") == b">X1YZ d\r\nMKV\r\n" and found.pop("none_new.fasta") == b""
    assert sorted(found.values()) == [b">ABCD d\r\nMKL\r\n", b">EFGH d\r\nMKI\r\n"] and all(n.startswith("d-") and n.endswith("_new.fasta") for n in found)
    assert told == {p.name: p.stat().st_size for p in out.iterdir()}
    for kind, table in (("hashes", run.hashes), ("unique", run.unique), ("duplicates", sequence_duplicates(run.unique))):
        sinks.write_table_files(table, kind, run.summary, str(tmp_path / kind))
    read = lambda kind, name: (tmp_path / kind / name).read_text().split("\n")
    hashes = read("hashes", "a_ProteinHashes.txt")
    assert hashes[0] == "Protein_ID\tProtein_Name\tSequence_Length\tSequence_Hash" and [x.split("\t")[:3] for x in hashes[1:]] == [["1", "PROT1", "14"], ["2", "PROT2", "3"], ["3", "PROT3", "3"], [""]]
    unique = read("unique", "a_UniqueProteinSeqs.txt")
    assert [x.split("\t")[:3] + x.split("\t")[4:] for x in unique[1:3]] == [["1", "PROT1", "14", "1", ""], ["2", "PROT2", "3", "2", "PROT3"]]
    assert read("duplicates", "a_UniqueProteinSeqDuplicates.txt")[1:] == ["2\tPROT2\t3\tPROT3", ""]
    assert read("duplicates", "none_UniqueProteinSeqDuplicates.txt") == ["Sequence_Index\tProtein_Name_First\tSequence_Length\tDuplicate_Protein", ""]


def test_statistics_stay_in_the_order_of_the_runs(spark, tmp_path):
    source = folder(tmp_path)
    days = [datetime(2024, 3, 5, 10 - i, 0, 0) for i in range(3)]  # later runs with earlier times
    for day in days:
        path = sinks.append_stats_file(validate(spark, f"{source}/a.fasta"), str(tmp_path), date=day)
    lines = [r.value for r in sinks.read_stats_file(spark, path).collect()]
    assert lines[0].startswith("Date\tSourceFile") and sum(x.startswith("Date") for x in lines) == 1
    assert [x[:19] for x in lines[1:]] == sorted((x[:19] for x in lines[1:]), reverse=True) and len({x[:19] for x in lines[1:]}) == 3
    runs = [[x[20:] for x in lines[1:] if x.startswith(str(d))] for d in days]
    assert runs[0] == runs[1] == runs[2] and "Full path to file" in runs[0][0]
