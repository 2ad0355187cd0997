import gzip
from datetime import datetime

import pandas as pd
import pytest
from pyspark.sql import functions as F

from lodestrand.__main__ import main
from lodestrand.operators import dedup
from lodestrand.operators.dedup import endings
from lodestrand.options import Options, load_options, parse_xml, save_options
from lodestrand.functions.text import wrapped
from lodestrand.plans.reports import append_stats, report, report_lines, write_fixed, write_with_last_line_end
from lodestrand.plans.validation import Validation, dedupe_by_hash_file, validate, validate_table
from lodestrand.rules import Rule, default_rules, numbered
from lodestrand.sources.files import file_ends, find_files
from lodestrand.streaming.arrivals import watch


def run(spark, text, options=None):
    return validate_table(spark.createDataFrame([("f", text)], "name string, text string"), "name", "text", options)


def codes(spark, text, options=None):
    return sorted((r.code, r.level, r.line_no, r.col) for r in run(spark, text, options).all_findings.collect())


CLEAN = ">PROT1 a protein\nMKVLAG\n"


@pytest.mark.parametrize(
    ("header", "expected"),
    [
        (">", 1000), ("> abc d", 1001), (">ABCD", 1002), (">ABCD\tdef", 1003), (">ABCD\xa0def", 1004), (">AB~D def", 1006), (">A|B|C|D def", 1007), (">AB(D def", 1008),
        ('>ABCD d"e', 1009), (">ABCD d\te", 1010), (">ABCD d\\/e", 1011), (">ABCD d\x01e", 1012), (">ABCD " + "x" * 901, 1013),
    ],
)
def test_header_rules(spark, header, expected):
    assert expected in [c for c, *_ in codes(spark, f"{header}\nMKVLAG")]


@pytest.mark.parametrize(("line", "expected"), [("MK V", 1014), ("MK*V", 1015), ("MK-V", 1016), ("MKaV", 1017), ("MB", 1018), ("MJ", 1019), ("MO", 1020), ("MU", 1021), ("MX", 1022), ("MZ", 1023)])
def test_sequence_rules(spark, line, expected):
    assert [c for c, *_ in codes(spark, f">PROT1 d\n{line}") if c >= 1000] == [expected]


def test_clean_file_has_no_findings(spark):
    assert codes(spark, CLEAN) == []


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        (">PROT1 d\n\nMKV", (6, "Error", 3, 1)), (">PROT1 d\nMKV\n\nMKV", (7, "Error", 4, 1)), ("MKV\n>PROT1 d\nMKV", (8, "Error", 1, 1)), ("MKV", (9, "Error", 1, 1)),
        (">PROT1 d\nMKV\n>PROT2 d", (10, "Error", 3, 1)), (">" + "A" * 61 + " d\nMKV", (1, "Error", 1, 2)), (">AB d\nMKV", (13, "Warning", 1, 2)), (" >PROT1 d\nMKV", (2, "Error", 1, 1)),
        (">PROT1 d\n" + "A" * 121 + "M", (17, "Warning", 2, 1)), (">PROT1 d\n" + "M" * 100_001, (17, "Warning", 2, 1)), (">PROT1 d\nMKV\n>prot1 e\nMKL", (12, "Error", 3, 2)),
        (">PROT1 d\nMKV\n>PROT2 e\nMKV", (18, "Warning", 4, 1)), (">PROT1 d\nACGT\n>PROT2 e\nMKV", (22, "Warning", 3, 1)), (">PROT1 d\nACGT\nACGG", (22, "Error", 0, 1)),
        (">PROT1 d\nMKV\n\n>PROT2 d\nMKL", (6, "Error", 5, 1)),  # a header does not forget the blank line
    ],
)
def test_structural_checks(spark, text, expected):
    assert expected in codes(spark, text)


def test_optional_checks(spark):
    text = ">PROT1 d\nMKV\n\n>PROT2 d\nMKL"
    assert (15, "Warning", 4, 1) in codes(spark, text, Options(warn_blank_lines_between=True))
    assert 6 not in [c for c, *_ in codes(spark, text, Options(reset_blank_on_header=True))]
    assert codes(spark, ">P~1* d\nMK*-", Options(allow_asterisk=True, allow_dash=True)) == [(1006, "Error", 1, 3)]
    no_hash = Options(check_duplicate_names=False, check_duplicate_sequences=False)
    assert codes(spark, ">PROT1 d\nACGT\n>PROT1 d\nACGT", no_hash) == []  # nothing asks for residues


def test_replacement_character_is_told_beside_the_rules(spark):
    found = run(spark, ">PROT1�d\nMKV").all_findings.where("code = 1005").collect()
    assert [(r.level, r.col, r.context) for r in found] == [("Warning", 7, ">PROT1�d")]


def test_details_are_capped_and_counted(spark):
    r = run(spark, "\n".join(f">PROT{i} d\nMKB" + "V" * i for i in range(8)), Options(max_findings=3))
    assert r.findings.where("code = 1018").orderBy("line_no").select("line_no").collect() == [(2,), (4,), (6,)]
    assert r.finding_counts.where("code = 1018").select("n_specified", "n_unspecified").collect() == [(3, 5)]


def test_report(spark):
    found = report(run(spark, ">PROT1 d\nMKB\n>PROT1 e\nMKL")).collect()
    assert [(r.MessageType, r.Description_or_Protein) for r in found] == [("Status", "Full path to file"), ("Status", "Protein count"), ("Status", "Residue count"), ("Error", "Error count"), ("Error", "PROT1"), ("Warning", "Warning count"), ("Warning", "PROT1"), ("Status", "Summary line")]
    assert found[4].Info == "Duplicate protein name found" and found[6].Context == "MKB"
    assert report_lines(run(spark, CLEAN), "|").count() == 4


def model_names(names):
    seen, out = set(), []
    for name in names:
        new = name
        if name.lower() in seen:
            new = next(name + e for e in endings() if (name + e).lower() not in seen)
        seen.add(new.lower())
        out.append(new)
    return out


def test_rename_equals_a_sequential_model(spark):
    names = ["TOM5", "TOM5", "tom5-b", "TOM5", "TOM5-b", "X", "X-b", "X"] + ["Y"] * 60 + ["Y-a1", "Y-z"]
    entries = spark.createDataFrame([("f", i, n) for i, n in enumerate(names)], "file string, ordinal long, name string")
    found = [r.new_name for r in dedup.rename_duplicates(entries).orderBy("ordinal").collect()]
    assert found == model_names(names)
    assert len({n.lower() for n in found}) == len(names)


def test_rename_within_a_run(spark):
    r = run(spark, ">TOM5 a\nMKV\n>TOM5 b\nMKL\n>TOM5 c\nMKI", Options(fix=True, rename_duplicates=True))
    assert [x.name for x in r.fixed.orderBy("ordinal").collect()] == ["TOM5", "TOM5-b", "TOM5-c"]
    assert [(x.code, x.extra) for x in r.all_findings.where("code IN (12, 19)").orderBy("line_no").collect()] == [(19, "--> TOM5-b"), (19, "--> TOM5-c")]


def test_duplicates_are_skipped_kept_or_merged(spark):
    text = ">P1PROT a\nMKV\n>P1PROT b\nMKL\n>P2PROT c\nMKV\n>P1PROT d\nMKV\n>P3PROT e\nMKV\n"
    names = lambda o: [(x.name, x.description) for x in run(spark, text, o).fixed.orderBy("ordinal").collect()]
    assert [n for n, _ in names(Options(fix=True))] == ["P1PROT", "P2PROT", "P3PROT"]
    assert [d for _, d in names(Options(fix=True, keep_same_name=True))] == ["a", "b", "c", "e"]
    assert names(Options(fix=True, consolidate=True)) == [("P1PROT", "a; Duplicate proteins: P2PROT,P3PROT")]
    gone = run(spark, text, Options(fix=True, consolidate=True)).repair_findings.orderBy("ordinal").collect()
    assert [(x.name, x.code, x.extra) for x in gone] == [("P2PROT", 20, "same as P1PROT"), ("P3PROT", 20, "same as P1PROT")]


def test_consolidation_is_idempotent_and_cuts_long_descriptions(spark):
    text = "".join(f">PROTEIN{i:04d}{'x' * 20} d\nMKV\n" for i in range(400))
    fixed = run(spark, text, Options(fix=True, consolidate=True)).fixed.collect()
    assert len(fixed) == 1 and len(fixed[0].description) == 7995 and fixed[0].description.endswith("...")
    again = run(spark, f">{fixed[0].name} {fixed[0].description}\nMKV", Options(fix=True, consolidate=True)).fixed.collect()
    assert again[0].description == fixed[0].description


def test_isoleucine_and_leucine_alike(spark):
    text = ">P1PROT a\nMKL\n>P2PROT b\nMKI\n"
    assert run(spark, text, Options(fix=True, consolidate=True, ignore_il=True)).fixed.count() == 1
    assert run(spark, text, Options(ignore_il=True)).unique.count() == 2  # only a repair that merges looks away


@pytest.mark.parametrize(
    ("name", "options", "fixed", "description"),
    [
        ("gi|48425853|pdb|1V0O|B", {}, "gi|48425853", "pdb|1V0O|B d"),
        ("IPI:IPI00177321.1|REFSEQ_XP:XP_1", {}, "IPI:IPI00177321.1", "REFSEQ_XP:XP_1 d"),
        ("jgi|Abc|123|model", {}, "jgi|Abc|123", "model d"),
        ("abcdefgh|ijkl|mnop", {"max_name_length": 14}, "abcdefgh|ijkl", "mnop d"),
        ("abcdefgh|ijklmnopqrst", {"max_name_length": 10}, "abcdefgh", "ijklmnopqrst d"),
        ("abc_no_split_at_all_here", {"max_name_length": 10}, "abc_no_split_at_all_here", "d"),
        ("#ab#cd#", {"invalid_name_chars": "#"}, "ab_cd", "d"),
        ("sp|Q1|NAME", {"split_multiple_refs": True}, "sp|Q1", "NAME d"),
    ],
)
def test_names_are_repaired(spark, name, options, fixed, description):
    row = run(spark, f">{name} d\nMKV", Options(fix=True, **options)).fixed.first()
    assert (row.name, row.description) == (fixed, description)


def test_fixed_file_is_written_in_order(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.fasta").write_text(">PROT1 one\nMKVLAGMKVLAG\nMK\n>PROT2 two \nMK V*\n")
    r = validate(spark, str(tmp_path / "in"), Options(fix=True, remove_invalid_residues=True))
    write_fixed(r, str(tmp_path / "out"))
    parts = sorted((tmp_path / "out" / "source=a.fasta").glob("part-*"))
    assert "".join(p.read_text() for p in parts) == ">PROT1 one\nMKVLAGMKVLAG\nMK\n>PROT2 two\nMKV\n"
    counts = r.fix_counts.first()
    assert counts.updated_residue_lines == 1 and counts.duplicates_skipped == 0
    unwrapped = Validation(r.lines, Options(fix=True, wrap_residues=False)).fixed_lines.orderBy("ordinal", "part")
    assert [x.line for x in unwrapped.collect()] == [">PROT1 one", "MKVLAGMKVLAG", "MK", ">PROT2 two", "MK V*"]


def test_hash_file_run(spark, tmp_path):
    (tmp_path / "a.fasta").write_text(">B x\nMKV\n>A |y\nMKV\n>C z\nMKL\n>A w\nMKV\n")
    table = validate(spark, str(tmp_path / "a.fasta"), Options(check_duplicate_names=False)).hashes
    fixed, unique, names, coverage = dedupe_by_hash_file(spark, str(tmp_path / "a.fasta"), table)
    assert [(x.name, x.description) for x in fixed.fixed.orderBy("ordinal").collect()] == [("A", "y"), ("C", "z")]
    assert {(x.Protein_Name_First, x.Duplicate_Proteins) for x in unique.collect()} == {("A", "B"), ("C", "")}
    assert sorted((x.Protein_Name, x.First_Protein_For_Hash, x.Duplicate_Name) for x in names.collect()) == [("A", "1", "0"), ("A", "1", "1"), ("B", "0", "0"), ("C", "1", "0")]
    assert coverage.collect() == [(2, 2, 0, 1)]


def test_unique_sequences_by_first_appearance(spark):
    r = run(spark, ">P2PROT a\nMKV\n>P9PROT b\nMKL\n>P1PROT c\nMKV*\n")
    assert [(x.Sequence_Index, x.Protein_Name_First, x.Protein_Count, x.Duplicate_Proteins) for x in r.unique.orderBy("Sequence_Index").collect()] == [(1, "P2PROT", 2, "P1PROT"), (2, "P9PROT", 1, "")]
    assert [x.Protein_ID for x in r.hashes.orderBy("Protein_ID").collect()] == [1, 2, 3]


def test_options_and_rules_survive_xml(tmp_path):
    options = Options(max_name_length=34, allow_asterisk=True, consolidate=True, rules=numbered(header=[Rule("^>.<$", "odd", 7, False, True)], sequence=[Rule("&", "and", 2)]))
    save_options(options, tmp_path / "o.xml")
    back = load_options(tmp_path / "o.xml")
    assert back == options and back.rules.all() == options.rules.all()
    assert parse_xml('<sections><section name="a"><item key="k" value="^>[^<]&" /></section></sections>') == {"a": {"k": "^>[^<]&"}}
    (tmp_path / "bad.xml").write_text("<sections></sections>")
    with pytest.raises(ValueError, match="section"):
        load_options(tmp_path / "bad.xml")
    with pytest.raises(ValueError, match="rule 1000"):
        numbered(header=[Rule("(", "broken", 3)])


def test_limits_are_clamped():
    o = Options(max_findings=0, max_name_length=2, max_residues_per_line=10, long_name_split_chars=" ")
    assert (o.max_findings, o.max_name_length, o.max_residues_per_line, o.long_name_split_chars) == (1, 8, 40, "|")
    assert [r.id for r in default_rules().all()] == list(range(1000, 1024))
    assert len(default_rules(True, True, True).all()) == 21


def test_missing_newline_is_told_on_request(spark, tmp_path):
    (tmp_path / "a.fasta").write_text(">PROT1 d\nMKV")
    assert validate(spark, str(tmp_path / "a.fasta"), Options(strict_eof=True)).all_findings.where("code = 11").count() == 1
    assert validate(spark, str(tmp_path / "a.fasta")).all_findings.count() == 0


def test_files_that_arrive_are_validated_once(spark, tmp_path):
    folder, seen = tmp_path / "in", []
    folder.mkdir()
    (folder / "a.fasta").write_text(">PROT1 d\nMKB\n")
    sink = lambda findings, n: seen.append(sorted((r.file.rsplit("/", 1)[1], r.code) for r in findings.collect()))
    watch(spark, str(folder), str(tmp_path / "state"), sink).awaitTermination()
    (folder / "b.fasta").write_text("MKV\n")
    watch(spark, str(folder), str(tmp_path / "state"), sink).awaitTermination()
    assert seen == [[("a.fasta", 1018)], [("b.fasta", 8), ("b.fasta", 9)]]


def test_command_line(spark, tmp_path):
    (tmp_path / "a.fasta").write_text(">PROT1 d\nMKB\n>PROT1 e\nMKB\n")
    main([str(tmp_path / "a.fasta"), "-o", str(tmp_path / "out"), "--fix", "-x", str(tmp_path / "o.xml")])
    assert (tmp_path / "o.xml").exists()
    assert spark.read.text(str(tmp_path / "out" / "report")).where(F.col("value").contains("Duplicate protein name")).count() == 1


def test_findings_have_one_schema(spark):
    assert run(spark, "").all_findings.columns == ["file", "level", "line_no", "col", "protein", "code", "extra", "context", "emit_seq"]
    assert isinstance(run(spark, CLEAN).summary.toPandas(), pd.DataFrame)


def test_files_are_found_by_ending_and_depth(spark, tmp_path):
    deep = tmp_path / "one" / "two"
    deep.mkdir(parents=True)
    for place in ("a b.fasta", "b,{1}.faa", "c.txt", "one/d.FASTA", "one/two/e.fasta.gz"):
        (tmp_path / place).write_text(">PROT1 d\nMKV\n") if not place.endswith("gz") else (tmp_path / place).write_bytes(gzip.compress(b">PROT1 d\nMKV"))
    names = lambda **k: sorted(p.rsplit("/", 1)[1].replace("\\", "") for p in find_files(spark, str(tmp_path), **k))
    assert names() == ["a b.fasta", "b,{1}.faa"]
    assert names(recursive=True, depth=1) == ["a b.fasta", "b,{1}.faa", "d.FASTA"]
    assert names(recursive=True) == ["a b.fasta", "b,{1}.faa", "d.FASTA", "e.fasta.gz"]
    run = validate(spark, str(tmp_path), Options(strict_eof=True), recursive=True)
    assert sorted((r.proteins, r.residues, r.errors) for r in run.summary.collect()) == [(1, 3, 0)] * 4
    assert {r.file for r in file_ends(spark, find_files(spark, str(tmp_path), True)).collect()} == {r.file for r in run.lines.select("file").distinct().collect()}
    with pytest.raises(FileNotFoundError):
        validate(spark, str(tmp_path / "nowhere"))


def test_a_file_without_a_line_has_no_entries(spark, tmp_path):
    (tmp_path / "a.fasta").write_text("")
    run = validate(spark, str(tmp_path))
    assert [(r.code, r.level) for r in run.all_findings.collect()] == [(9, "Error")]
    assert [(r.valid, r.has_warnings) for r in run.verdicts.collect()] == [(False, False)]


def test_what_a_repair_leaves_out_is_told(spark):
    text = ">P1PROT a\nMKV\n>P1PROT b\nMKL\n>P2PROT c\nMKV\n"
    found = run(spark, text, Options(fix=True, consolidate=True)).all_findings.where("code IN (20, 21)").collect()
    assert [(r.code, r.level, r.line_no, r.col, r.protein, r.extra) for r in found] == [(20, "Warning", 7, 0, "P2PROT", "same as P1PROT")]
    found = run(spark, text, Options(fix=True, keep_same_name=True)).all_findings.where("code IN (20, 21)").collect()
    assert [(r.code, r.level, r.line_no, r.col, r.protein) for r in found] == [(21, "Warning", 5, 1, "P1PROT")]


def test_verdicts_messages_and_rules(spark):
    r = run(spark, ">PROT1 d\nMK*\nM-B", Options(allow_asterisk=True, allow_dash=True))
    assert [(x.valid, x.has_warnings, x.warnings) for x in r.verdicts.collect()] == [(True, True, 1)]
    assert r.message(0, "Warning") == "Warning, 3, 3, PROT1, Residues line contains B (non-standard amino acid for N or D), M-B"
    assert r.message(1, "Warning") is None and r.message(0) is None
    rules = default_rules().with_rule("sequence", Rule("W", "a W", 6))
    assert [x.id for x in rules.sequence][-1] == 1024
    assert (1024, "Error", 2, 2) in codes(spark, ">PROT1 d\nMW", Options(rules=rules))
    with pytest.raises(ValueError, match="rule 1024"):
        default_rules().with_rule("name", Rule("(?<", "broken", 3))
    assert default_rules().with_rule("name", Rule(r"\p{IsAlphabetic}&&[^a]", "only Java has this", 3)).name[-1].id == 1024


def test_statistics_file_grows_by_the_day(spark, tmp_path):
    day = datetime(2024, 3, 5, 10, 20, 30)
    path = append_stats(run(spark, CLEAN), str(tmp_path), date=day)
    assert path.endswith("FastaFileStats_2024-03-05.txt")
    append_stats(run(spark, CLEAN), str(tmp_path), date=day)
    lines = [r.value for r in spark.read.text(path).collect()]
    assert lines.count("\t".join(["Date", "SourceFile", "MessageType", "LineNumber", "ColumnNumber", "Description_or_Protein", "Info", "Context"])) == 1
    assert len(lines) == 9 and sum(x.startswith("2024-03-05 10:20:30\tf\tStatus") for x in lines) == 8


def test_same_names_in_two_folders_stay_apart(spark, tmp_path):
    for folder, residues in (("x", "MKV"), ("y", "MKL")):
        (tmp_path / "in" / folder).mkdir(parents=True)
        (tmp_path / "in" / folder / "a.fasta").write_text(f">PROT1 d\n{residues}")
    r = validate(spark, str(tmp_path / "in"), Options(fix=True, strict_eof=True), recursive=True)
    write_fixed(r, str(tmp_path / "out"))
    assert len(list((tmp_path / "out").glob("source=*"))) == 2
    write_with_last_line_end(r, str(tmp_path / "ended"))
    assert sorted(p.read_bytes() for p in (tmp_path / "ended" / "LF").glob("source=*/part-*")) == [b">PROT1 d\nMKL\n", b">PROT1 d\nMKV\n"]


def test_a_chromosome_is_wrapped_in_one_pass(spark):
    row = spark.range(1).select(F.expr("repeat('ACGTN', 10000000)").alias("r")).select(wrapped(F.col("r"), F.lit(60)).alias("w")).select(F.size("w").alias("n"), F.length(F.element_at("w", -1)).alias("last"), F.length(F.element_at("w", 1)).alias("first")).first()
    assert (row.n, row.first, row.last) == (833_334, 60, 20)


def test_entries_are_joined_without_residues_and_files_named_without_findings(spark):
    """Residues are met again in the repaired records alone; a text is what is left of its stored line."""
    lines = spark.createDataFrame([("f", i, line) for i, line in enumerate([">A|x d", "M1" * 5000, ">A|x d", " MK" * 100, ">B d", "MKV"], 1)], "file string, line_no long, line string")
    r = Validation(lines, Options(fix=True, rename_duplicates=True))
    assert "residues" not in r.entries.columns
    assert {x.line_no: x.text for x in r.classified.collect()} == {1: ">A|x d", 2: "M1" * 5000, 3: ">A|x d", 4: "MK MK" + " MK" * 98, 5: ">B d", 6: "MKV"}
    assert r.all_findings.where("protein = 'A|x-b'").count() > 0
    assert [x.residues for x in r.fixed.orderBy("ordinal").collect()] == ["M1" * 5000, "MK MK" + " MK" * 98, "MKV"]
    other = Validation(lines, Options())
    assert [x.file for x in other.names.collect()] == ["f"] and "all_findings" not in other.__dict__
