"""Findings: what the rules and the structural checks report, in the order it is met."""

from __future__ import annotations

import functools
import operator
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import HEADER_CONTEXT, SEQUENCE_CONTEXT, context
from ..options import Options
from ..rules import FIRST_RULE_ID, FLAGS, Rule
from .hashing import measured

COLUMNS = ["file", "level", "line_no", "col", "protein", "code", "extra", "context", "emit_seq"]
#: Places in a line's order, one after the other; a rule's number is added.
PHASES = {n: i * 100 for i, n in enumerate(("entry", "size", "start", "header", "replacement", "description", "length", "name", "duplicate", "blank", "structure", "line_length", "sequence", "end"))}
DNA_PERCENT = 95


def finding(level: str, code: int, phase: str, index: Column | int = 0, extra: Column | str = "", around: Column | str = "", step: int = 0) -> Column:
    col = (F.lit(index) if isinstance(index, int) else index) + 1
    text = [F.lit(x) if isinstance(x, str) else x for x in (extra, around)]
    return F.struct(F.lit(level).alias("level"), col.cast("int").alias("col"), F.lit(code).alias("code"), F.coalesce(text[0].cast("string"), F.lit("")).alias("extra"), F.coalesce(text[1], F.lit("")).alias("context"), F.lit(PHASES[phase] + step).cast("long").alias("seq"))


#: A character of a pattern that stands for itself.
_SIGN = r"[^\\^$.|?*+()\[\]{}&\-]|\\t|\\[^A-Za-z0-9]"


def signs(pattern: str) -> list[str]:
    """The characters of which a pattern finds one, if it is such a character or a plain class of them; else none."""
    found = re.fullmatch(rf"({_SIGN})|\[((?:{_SIGN})+)\]", pattern, re.DOTALL)
    return ["\t" if x == r"\t" else x[-1] for x in re.findall(_SIGN, found[1] or found[2], re.DOTALL)] if found else []


def rule_findings(rules: tuple[Rule, ...], text: Column, line: Column, offset: Column | int, width: int, phase: str, when: Column | None = None) -> list[Column]:
    """One column for each rule: a finding where it is broken, else null. Only the first match counts."""

    def told_at(place: Column, rule: Rule, step: int) -> Column:
        broken = place > 0 if rule.match_is_problem else place == 0
        index = (F.lit(offset) if isinstance(offset, int) else offset) + F.greatest(place - 1, F.lit(0))
        extra = F.regexp_substr(text, F.lit(FLAGS + rule.pattern)) if rule.show_match else F.lit("")
        return F.when(broken if when is None else when & broken, finding(rule.level, rule.id, phase, index, extra, context(line, index, width), step))

    found = []
    for step, rule in enumerate(rules):
        place = F.regexp_instr(text, F.lit(FLAGS + rule.pattern))  # one search tells whether and where
        if held := signs(rule.pattern):  # a text without them is not searched
            place = F.when(functools.reduce(operator.or_, (text.contains(x) for x in held)), place).otherwise(F.lit(0))
        # As an element of an array the place is searched for once, not again for each use of it.
        found.append(F.get(F.transform(F.array(place), lambda at: told_at(at, rule, step)), F.lit(0)))  # noqa: B023
    return found


def told(rows: DataFrame, found: list[Column], protein: Column | str | list[Column | str]) -> DataFrame:
    """The non-null findings of each row as rows of the findings table. protein: of all of them, or of each."""
    as_column = lambda p: F.lit(p) if isinstance(p, str) else p
    if isinstance(protein, list):
        pairs = [F.when(f.isNotNull(), F.struct(f.alias("f"), as_column(p).alias("protein"))) for f, p in zip(found, protein, strict=True)]
        each = rows.select("file", "line_no", F.explode(F.array_compact(F.array(*pairs))).alias("p")).select("file", "line_no", "p.protein", "p.f")
    else:
        each = rows.select("file", "line_no", as_column(protein).alias("protein"), F.explode(F.array_compact(F.array(*found))).alias("f"))
    return each.select("file", "f.level", "line_no", "f.col", "protein", "f.code", "f.extra", "f.context", (F.col("line_no") * 10_000 + F.col("f.seq")).alias("emit_seq"))


def header_findings(heads: DataFrame, options: Options) -> DataFrame:
    """Findings of header lines (see ``records.split_headers``): header, description, length and name rules."""
    rules, header, name, description = options.rule_set, F.col("header"), F.col("name"), F.col("description")
    place = F.instr(header, name) - 1 + F.length(name)
    mark = F.substring(header, (place + 1).cast("int"), F.lit(1)) == "�"
    replacement = next((r.id for r in rules.header if r.pattern.endswith(r"\xFFFD")), FIRST_RULE_ID * 10)
    named = name != ""
    start = F.length(name) + 1  # the separator's place: one before the description's
    short, long = named & (F.length(name) < options.min_name_length), named & (F.length(name) > options.max_name_length)
    found = [
        *rule_findings(rules.header, header, header, 0, HEADER_CONTEXT, "header"),
        F.when(named & mark, finding("Warning", replacement, "replacement", place, "", context(header, place, HEADER_CONTEXT))),
        *rule_findings(rules.description, description, header, start, HEADER_CONTEXT, "description", description != ""),
        F.when(short, finding("Warning", 13, "length", 1, F.length(name))),
        F.when(long, finding("Error", 1, "length", 1, F.length(name))),
        *rule_findings(rules.name, name, header, 1, HEADER_CONTEXT, "name", named),
    ]
    return told(heads, found, name)


def sequence_findings(lines: DataFrame, options: Options) -> DataFrame:
    """Findings of residue lines (file, line_no, text, protein): too long, or against the sequence rules."""
    text = F.col("text")
    found = [F.when(F.length(text) > options.max_residues_per_line, finding("Warning", 17, "line_length", 0, F.length(text))), *rule_findings(options.rule_set.sequence, text, text, 0, SEQUENCE_CONTEXT, "sequence")]
    return told(lines, found, F.col("protein"))


def line_findings(lines: DataFrame, options: Options) -> DataFrame:
    """Findings of a classified line's form and place, with the column protein: the entry that it stands in.

    A line's size and first character, blank lines where none should be, residues
    without a header.
    """
    size, kind, raw = F.length("line"), F.col("kind"), F.col("line")
    first = F.substring(raw, 1, 1)
    starts = F.lit(options.warn_line_starts_with_space) & kind.isin("header", "residue") & first.isin(" ", "\xa0", "\t")
    residue, after_header, after_residue = kind == "residue", F.col("prev_kind") == "header", F.col("prev_kind") == "residue"
    blank = F.col("blank_before")
    unnamed = [
        F.when(starts, finding("Error", 2, "start", 0, "", context(raw, F.lit(0), HEADER_CONTEXT))),
        F.when(residue & F.col("prev_kind").isNull(), finding("Error", 8, "structure")),
    ]
    named = [
        F.when((kind == "header") & blank & F.lit(options.warn_blank_lines_between), finding("Warning", 15, "blank")),
        F.when(residue & after_header & blank, finding("Error", 6, "structure")),
        F.when(residue & after_residue & blank, finding("Error", 7, "structure")),
    ]
    sizes = [
        F.when(size > 10_000_000, finding("Error", 17, "size", 0, "Line is over 10 million residues long; skipping")),
        F.when((size > 1_000_000) & (size <= 10_000_000), finding("Warning", 17, "size", 0, "Line is over 1 million residues long; this is very suspicious")),
        F.when((size > 100_000) & (size <= 1_000_000), finding("Warning", 17, "size", 0, "Line is over 100,000 residues long; this could indicate a problem")),
    ]
    before = F.when(kind == "header", F.col("previous_protein")).otherwise(F.col("protein"))
    proteins = [*[""] * len(unnamed), *[F.col("protein")] * len(named), *[before] * len(sizes)]
    return told(lines, [*unnamed, *named, *sizes], proteins)


def with_names(findings: DataFrame, names: DataFrame) -> DataFrame:
    """``findings`` whose protein is an entry's ordinal as text, with the name that the entry has in ``names`` (file, ordinal, name).

    So findings are joined with names, not the lines they are found in.
    """
    known = names.select("file", F.col("ordinal").cast("string").alias("protein"), F.col("name").alias("_name"))
    return findings.join(known, ["file", "protein"], "left").withColumn("protein", F.coalesce("_name", F.lit(""))).select(*COLUMNS)


def end_findings(classified: DataFrame) -> DataFrame:
    """Findings about whole files: no entries at all, or a last entry without residues."""
    place = F.when(F.col("kind") == "header", F.struct("line_no", "kind")).when(F.col("kind") == "residue", F.struct("line_no", "kind"))
    files = classified.groupBy("file").agg(F.max("line_no").alias("line_no"), F.count_if(F.col("kind") == "header").alias("heads"), F.max(place).alias("last"))
    found = [F.when(F.col("heads") == 0, finding("Error", 9, "end", step=90)), F.when((F.col("heads") > 0) & (F.col("last.kind") == "header"), finding("Error", 10, "end", step=91))]
    return told(files, found, "")


def dna_findings(entries: DataFrame, nucleic: DataFrame) -> DataFrame:
    """A warning for each entry of nucleic acids, told where the entry ends, and an error for a file of mostly such."""
    start = measured(entries).select("file", "ordinal", F.col("next_header_line_no").alias("line_no"), "start")
    each = told(nucleic.where("likely_dna").join(start, ["file", "ordinal"]), [finding("Warning", 22, "entry", 0, "", F.col("start"))], F.col("name"))
    votes = nucleic.groupBy("file").agg(F.count("*").alias("total"), F.count_if(F.col("percent") > DNA_PERCENT).alias("dna")).withColumn("line_no", F.lit(0).cast("long"))
    all_dna = F.col("total") == F.col("dna")
    count = F.when(F.col("dna") == 1, "The sequence is DNA").otherwise(F.format_string("The %d sequences are DNA", "dna"))
    extra = F.when(all_dna, "The FASTA file has nucleic acids (DNA)").otherwise("The majority of the FASTA file entries are nucleic acids (DNA)")
    note = F.concat(F.when(all_dna, count).otherwise(F.format_string("%d / %d sequences are DNA", "dna", "total")), F.lit(" (residues are A, T, C, or G)"))
    vote = F.when((F.col("dna") > 0) & (F.col("total") - F.col("dna") < F.col("dna")), finding("Error", 22, "end", 0, extra, note, 80))
    return each.unionByName(told(votes, [vote], ""))


def capped(findings: DataFrame, limit: int) -> DataFrame:
    """The first ``limit`` findings of each file, level and code, as they were met."""
    order = Window.partitionBy("file", "level", "code").orderBy("emit_seq", "col", "extra")
    return findings.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= limit).drop("_rank")


def finding_counts(findings: DataFrame, limit: int) -> DataFrame:
    """(file, level, code, n_specified, n_unspecified): how many have their details kept, and how many are only counted."""
    sums = findings.groupBy("file", "level", "code").agg(F.count("*").alias("n"))
    return sums.select("file", "level", "code", F.least("n", F.lit(limit)).cast("long").alias("n_specified"), F.greatest(F.col("n") - limit, F.lit(0)).cast("long").alias("n_unspecified"))


def ordered(findings: DataFrame) -> DataFrame:
    return findings.orderBy("file", "code", "line_no", "col", "emit_seq")
