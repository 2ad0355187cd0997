import gzip

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestrand.functions import text as t
from lodestrand.operators import checks, records
from lodestrand.options import Options
from lodestrand.rules import FLAGS, Rule, numbered
from lodestrand.sources.files import file_ends, read_hash_file, read_lines
from lodestrand.storage import stored


def lines_of(spark, *texts):
    rows = [(f"f{i}", n, line) for i, text in enumerate(texts) for n, line in enumerate(text.split("\n"), 1)]
    return spark.createDataFrame(rows, "file string, line_no long, line string")


def model(lines):
    """The state of each line, one after the other."""
    ordinal, prev, blank, out = 0, None, False, []
    for line in lines:
        kind = "blank" if not line.strip() else "header" if line.lstrip().startswith(">") else "residue"
        before = (prev, blank)
        if kind == "header":
            ordinal, prev = ordinal + 1, kind
        elif kind == "residue":
            prev = kind
        blank = False if kind == "residue" else blank or kind == "blank"
        out.append((kind, ordinal, *before))
    return out


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.sampled_from([">a b", "MKV", "", "  ", " >c", "AC GT"]), min_size=1, max_size=25), st.integers(1, 7))
def test_states_equal_a_sequential_model_whatever_the_blocks(spark, lines, block):
    found = records.classify(lines_of(spark, "\n".join(lines)), block_lines=block).orderBy("line_no").collect()
    assert [(r.kind, r.ordinal, r.prev_kind, r.blank_before) for r in found] == model(lines)


def test_reset_blank_on_header(spark):
    lines = lines_of(spark, ">a\nMK\n\n>b\nMK")
    flags = lambda **k: [r.blank_before for r in records.classify(lines, **k).orderBy("line_no").collect()]
    assert flags() == [False, False, False, True, True]
    assert flags(reset_blank_on_header=True) == [False, False, False, True, False]


@pytest.mark.parametrize(
    ("header", "name", "description"),
    [
        (">P1 first one", "P1", "first one"),
        (">P1\tfirst", "P1", "first"),
        (">P1\xa0first", "P1", "first"),
        (">P1�first", "P1", "first"),
        (">P1", "P1", ""),
        ("> P1 x", "", ""),
        (">", "", ""),
        (">P1  two", "P1", " two"),
        (">P1 a\tb", "P1", "a\tb"),
    ],
)
def test_header_split(spark, header, name, description):
    row = spark.createDataFrame([(header,)], "h string").select(t.header_name(F.col("h")).alias("n"), t.header_description(F.col("h")).alias("d")).first()
    assert (row.n, row.d) == (name, description)


def test_records_keep_entries_without_residues_and_residues_without_header(spark):
    found = {r.ordinal: r for r in records.records(records.classify(lines_of(spark, "AAA\n>p one\n MKV* \nGG**\n>q"))).collect()}
    assert found[0].residues == "AAA" and found[0].name == ""
    assert found[1].residues == "MKV*GG" and found[1].raw_residues == 9 and found[1].max_line_len == 4 and found[1].next_header_line_no == 5
    assert found[2].name == "q" and found[2].residues == "" and found[2].next_header_line_no == 5


def test_lines_of_files_are_numbered_across_splits(spark, tmp_path):
    whole = {}
    for name, end, n in (("a.fasta", "\n", 4000), ("b.fasta", "\r\n", 3000), ("c.fasta", "\r", 10)):
        whole[name] = [f">p{i} x" if i % 7 == 0 else "MKV" * (i % 5) for i in range(n)]
        (tmp_path / name).write_bytes(end.join(whole[name]).encode() + end.encode())
    with gzip.open(tmp_path / "d.fasta.gz", "wb") as f:
        f.write(("﻿" + "\n".join(whole["a.fasta"])).encode())
    whole["d.fasta.gz"] = whole["a.fasta"]
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        found = read_lines(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    for name, lines in whole.items():
        assert [r.line for r in sorted((r for r in found if r.file.endswith(name)), key=lambda r: r.line_no)] == lines
        assert sorted(r.line_no for r in found if r.file.endswith(name)) == list(range(1, len(lines) + 1))


def test_file_ends(spark, tmp_path):
    for name, content in {"lf": b"a\nb\n", "crlf": b"a\r\nb", "cr": b"a\rb\r", "lfcr": b"a\n\rb", "none": b"abc"}.items():
        (tmp_path / name).write_bytes(content)
    found = {r.file.rsplit("/", 1)[1]: (r.terminator, r.ends_with_newline) for r in file_ends(spark, str(tmp_path)).collect()}
    assert found == {"lf": ("LF", True), "crlf": ("CRLF", False), "cr": ("CR", True), "lfcr": ("LFCR", False), "none": ("CRLF", False)}


def test_hash_file_columns_are_found_by_name(spark, tmp_path):
    (tmp_path / "h.txt").write_text('x\tprotein_name\tSEQUENCE_LENGTH\tSequence_Hash\n1\tP"1\t5\tAB\n')
    assert read_hash_file(spark, str(tmp_path / "h.txt")).collect() == [('P"1', "5", "AB")]
    (tmp_path / "bad.txt").write_text("Protein_Name\tSequence_Length\nP\t3\n")
    with pytest.raises(ValueError, match="Sequence_Hash"):
        read_hash_file(spark, str(tmp_path / "bad.txt"))


def test_summary_of_no_lines(spark):
    none = spark.createDataFrame([], "file string, line_no long, line string")
    assert records.file_summary(records.classify(none)).count() == 0
    assert records.records(records.classify(none), Options()).count() == 0


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.text("ACGTMK", max_size=60), st.integers(-5, 200))
def test_wrapped_lines_join_to_the_residues(spark, residues, longest):
    row = spark.createDataFrame([(residues, longest)], "r string, n int").select(t.wrapped(F.col("r"), t.wrap_width(F.col("n"), 120)).alias("w")).first()
    assert "".join(row.w) == residues
    width = max(10, longest if 0 < longest <= 120 else 120)
    assert all(len(x) == width for x in row.w[:-1])


def test_stored_blocks_equal_plain_ones_and_lines_are_read_once(spark):
    """Blocks of two lines, files of one block and of several; what is carried over has no row for a file's first block."""
    texts = {"a": [">A", "MK", "", " MV", ">B", ">C", "", "", "", "MKV", "M"], "b": [">A"], "c": ["", "", "MK", "", ">D", "M"], "d": ["M", " "]}
    rows = [(f, i, x) for f, lines in texts.items() for i, x in enumerate(lines, 1)] + [(None, 1, "M")]
    plain, seen, tables = spark.createDataFrame(rows, "file string, line_no long, line string"), spark.sparkContext.accumulator(0), {}

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    def keep(df, name):
        tables[name] = stored(df, name)
        return tables[name]

    found = records.classify(plain.mapInArrow(counted, plain.schema), block_lines=2, keep=keep)
    assert sorted(found.collect()) == sorted(records.classify(plain, block_lines=2).collect()) == sorted(records.classify(plain).collect())
    assert found.count() == len(rows) - 1 and seen.value == len(rows)
    assert {(r.file, r.block) for r in tables["blocks"].collect()} == {("a", i) for i in range(1, 6)} | {("c", 1), ("c", 2)}


ODD = ["", " ", "A", " A", "A ", "\u2003A\u2003B\x85", "A\r\n", "\U0001f600B\tA-", "\n\n", "a\u2028", "x*y", None, "\U00010400 \U00010400", "1ATCG2ÄÄ3"]


def test_texts_are_searched_only_where_something_is_and_give_the_same(spark):
    rows = spark.createDataFrame([(x,) for x in ODD], "x string").withColumn("n", F.col("x"))
    x = F.col("x")
    cut, counts = lambda pattern: F.regexp_replace(x, pattern, ""), t.residue_counts(x)
    pairs = [(t.is_blank(x), x.rlike(r"(?U)^\s*$")), (t.left_trimmed(x), cut(r"(?U)^\s+")), (t.trimmed(x), cut(r"(?U)^\s+|\s+$")), (t.clean_residues(x, True), cut(r"[^A-Z(*)(-)]"))]
    pairs += [(counts["letters"], F.length(cut(r"\P{L}"))), (counts["nucleic"], F.length(cut("[^ATCG]")))]
    for i, (a, b) in enumerate(pairs):
        assert rows.where(~a.eqNullSafe(b)).collect() == [], i


def test_rules_of_signs_find_the_place_that_the_search_finds(spark):
    patterns = ["B", r"\-", r"[ \t]", r"\*", "y", r"[\-\*]"]
    assert [checks.signs(p) for p in patterns] == [["B"], ["-"], [" ", "\t"], ["*"], ["y"], ["-", "*"]]
    assert [checks.signs(p) for p in ("[^B]", ".", r"\d", "[a-z]", "B+", r"\/{2}", "^B", "[]")] == [[]] * 8
    rows = spark.createDataFrame([("f", i, x) for i, x in enumerate(ODD) if x is not None], "file string, line_no long, text string")
    for matches in (True, False):
        rules = numbered(sequence=[Rule(p, "m", 5, matches, True) for p in patterns]).sequence
        found = checks.told(rows, checks.rule_findings(rules, F.col("text"), F.col("text"), 0, 5, "sequence"), "")
        for rule in rules:
            place = F.regexp_instr("text", F.lit(FLAGS + rule.pattern))
            broken = rows.where(place > 0 if matches else place == 0).select("line_no", F.greatest(place, F.lit(1)).alias("col"))
            assert sorted(map(tuple, found.where(F.col("code") == rule.id).select("line_no", "col").collect())) == sorted(map(tuple, broken.collect()))


def test_a_rule_searches_once_for_its_place(spark):
    """The place has many uses: column and surroundings. Each would be a search of the text if it stood there itself."""
    (found,) = checks.rule_findings(numbered(sequence=[Rule("[^A-Z]", "m", 5)]).sequence, F.col("x"), F.col("x"), 0, 5, "sequence")
    plan = spark.createDataFrame([("AB1",)], "x string").select(found.alias("f"))
    assert str(plan._jdf.queryExecution().analyzed().toString()).lower().count("regexp_instr(") == 1
    assert plan.select("f.col", "f.context").first() == (3, "AB1")
