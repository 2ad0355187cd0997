"""A whole run: lines in; findings, counts, hashes, repaired records and reports out, each when it is asked for."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.text import build_header, left_trimmed, trimmed, with_repair, wrap_width, wrapped
from ..operators import checks, dedup, hashing, records, segments
from ..options import Options
from ..rules import messages
from ..storage import stored
from .events import Events
from ..sources import ranges
from ..sources.files import EXTENSIONS, file_ends, file_sizes, find_files, read_lines, split_lines


class Validation:
    """What can be asked about a set of files, each property a DataFrame.

    The classified lines, the entries and the findings, which all other properties are
    made of, are stored when first asked for; the rest is computed only when read.
    """

    def __init__(self, lines: DataFrame, options: Options | None = None, ends: DataFrame | None = None, keep: DataFrame | None = None, files: DataFrame | None = None, cell: int = segments.CELL, faults: DataFrame | None = None, events: Events | None = None) -> None:
        """lines: (file, line_no, line); ends: see ``sources.file_ends``; keep: names to keep (Protein_Name); files: (file, size) of all files, those without a line too; cell: characters of an entry that is kept in one cell; faults: (file, fault) of files that could not be read; events: what is told meanwhile."""
        self.cell, self.faults, self.events = cell, faults, events or Events()
        self._seen = Observation("lines")
        self.lines, self.options, self.ends, self.keep, self.files = lines, options or Options(), ends, keep, files

    @functools.cached_property
    def classified(self) -> DataFrame:
        if self.faults is not None:
            for file, fault in self.faults.limit(self.options.max_findings).collect():
                self.events.error(f"{file}: {fault}")
        kind, n = F.col("kind"), F.length(left_trimmed(F.col("line")))
        counts = [F.count("*").alias("lines"), F.count_if(kind == "header").alias("proteins"), F.coalesce(F.sum(F.when(kind == "residue", n)), F.lit(0)).cast("long").alias("residues"), F.count_if(kind == "oversize").alias("skipped_lines")]
        # Lines are counted while they are stored; their texts are cut from them when they are read.
        keep = lambda rows, name: self._stored(rows.observe(self._seen, *counts) if "line" in rows.columns else rows, name)
        return records.classify(self.lines, self.options.header_start, reset_blank_on_header=self.options.reset_blank_on_header, keep=keep)

    def _stored(self, df: DataFrame, name: str) -> DataFrame:
        with self.events.step(df.sparkSession, name):
            return stored(df, name)

    @functools.cached_property
    def totals(self) -> dict[str, int]:
        """lines, proteins, residues and skipped_lines of all files: counted while the classified lines were written."""
        _ = self.classified
        seen = dict.fromkeys(("lines", "proteins", "residues", "skipped_lines"), 0) | dict(self._seen.get)
        self.events.status(f"{seen['proteins']:,} proteins, {seen['residues']:,} residues, {seen['lines']:,} lines")
        if seen["skipped_lines"]:
            self.events.warning(f"{seen['skipped_lines']:,} lines of over {records.MAX_LINE:,} characters were skipped")
        return seen

    @functools.cached_property
    def headers(self) -> DataFrame:
        return records.split_headers(self.classified)

    @functools.cached_property
    def assembled(self) -> tuple[DataFrame, DataFrame | None]:
        """The entries' residues, and the segments of those that are too long for a cell; see ``segments.assembled``."""
        return segments.assembled(self.classified, self.options, self.cell)

    @functools.cached_property
    def entries(self) -> DataFrame:
        return self._stored(self._entries(), "entries")

    def _entries(self) -> DataFrame:
        """Every entry with its final name and what becomes of it.

        Adds to ``records.records``: raw_name, the repair flags, name_again, renamed,
        valid (its residues count for hashes and DNA). Residues are measured and left
        out, so that no join by name moves them; see ``fixed``.
        """
        o = self.options
        whole, _ = self.assembled
        measures = whole.withColumn("residues", F.lit(None).cast("string"))
        found = records.records(self.classified, o, measures).drop("residues").withColumn("raw_name", F.col("name"))
        if o.fix and self.keep is None:
            found = with_repair(found, o, column="_fixed")
            found = found.withColumns({c: F.when(F.col("raw_name") == "", F.col(c)).otherwise(F.col("_fixed")[c]) for c in ("name", "description")} | {c: F.coalesce(F.col("_fixed")[c], F.lit(False)) for c in ("truncated", "refs_removed", "chars_replaced")}).drop("_fixed")
        else:
            found = found.withColumns({c: F.lit(False) for c in ("truncated", "refs_removed", "chars_replaced")})
        # Stored: a condition on the name would be pushed below the repair and spell it out for each use of its steps.
        found = self._stored(found, "repaired-entries")
        if self.keep is not None:
            kept = dedup.kept_by_list(found, self.keep).select("file", "ordinal", F.lit(True).alias("listed"))
            found = found.join(kept, ["file", "ordinal"], "left").withColumn("valid", F.coalesce("listed", F.lit(False))).drop("listed")
            return found.withColumns({"description": F.regexp_replace("description", r"^[| ]+", ""), "name_again": F.lit(False), "renamed": F.lit(False)})
        found = dedup.duplicate_names(found) if o.check_duplicate_names else found.withColumn("name_again", F.lit(False))
        if o.fix and o.rename_duplicates and o.check_duplicate_names:
            found = dedup.rename_duplicates(found).withColumn("renamed", F.col("new_name") != F.col("name")).withColumn("old_name", F.col("name")).withColumn("name", F.col("new_name")).drop("new_name")
        else:
            found = found.withColumns({"renamed": F.lit(False), "old_name": F.col("name")})
        again = F.col("name_again") & ~F.col("renamed")
        if o.fix:
            skipped = again & F.lit(not o.keep_same_name)
        else:
            skipped = again & F.lit(not o.save_basic_hashes)
        nameless = (F.col("raw_name") == "") & (F.col("ordinal") > 0)
        return found.withColumn("valid", ~nameless & ~skipped)

    @functools.cached_property
    def sequences(self) -> DataFrame:
        """The entries whose residues count."""
        some = self.entries.where("valid AND n_residues > 0")
        return some if self.options.needs_residues else some.where("false")

    @functools.cached_property
    def hashes(self) -> DataFrame:
        """(file, Protein_ID, Protein_Name, Sequence_Length, Sequence_Hash), and each entry's ordinal and first residues."""
        return hashing.protein_hashes(self.sequences, self.options.hash_ignores_il)

    @functools.cached_property
    def unique(self) -> DataFrame:
        return hashing.unique_sequences(self.hashes)

    @functools.cached_property
    def nucleic(self) -> DataFrame:
        return records.nucleic(self.sequences)

    @functools.cached_property
    def all_findings(self) -> DataFrame:
        return self._stored(self._all_findings(), "findings")

    def _all_findings(self) -> DataFrame:
        """Every finding, in the findings table's columns; none left out."""
        o, entries = self.options, self.entries
        placed = self.classified.withColumns({"protein": F.col("ordinal").cast("string"), "previous_protein": (F.col("ordinal") - 1).cast("string")})
        in_lines = checks.line_findings(placed, o).unionByName(checks.sequence_findings(placed.where("kind = 'residue'"), o))
        found = [checks.header_findings(self.headers, o), checks.with_names(in_lines, entries), checks.end_findings(self.classified), self._name_findings(), checks.dna_findings(entries, self.nucleic)]
        if o.check_duplicate_sequences:
            found.append(self._sequence_findings())
        if o.fix:
            found.append(self._repair_findings())
        if self.files is not None:
            bare = self.files.join(self.classified.select("file").distinct(), "file", "left_anti").withColumn("line_no", F.lit(0).cast("long"))
            if self.faults is not None:
                bare = bare.join(self.faults, "file", "left_anti")
                found.append(checks.told(self.faults.withColumn("line_no", F.lit(0).cast("long")), [checks.finding("Error", 0, "entry", -1, F.col("fault"))], ""))
            found.append(checks.told(bare, [checks.finding("Error", 9, "end", step=90)], ""))
        if o.strict_eof and self.ends is not None:
            last = self.classified.groupBy("file").agg(F.max("line_no").alias("line_no"))
            bad = self.ends.where("NOT ends_with_newline").join(last, "file")
            found.append(checks.told(bad, [checks.finding("Error", 11, "end", step=92)], ""))
        return functools.reduce(DataFrame.unionByName, found)

    def _name_findings(self) -> DataFrame:
        o = self.options
        if self.keep is not None or not o.check_duplicate_names:
            return checks.told(self.headers.where("false"), [checks.finding("Error", 12, "duplicate")], "")
        named = self.entries.where("name_again").withColumn("line_no", F.col("header_line_no"))
        kept = o.fix and o.keep_same_name and not o.rename_duplicates
        again = F.when(~F.col("renamed"), checks.finding("Warning" if kept else "Error", 12, "duplicate", 1))
        renamed = F.when(F.col("renamed"), checks.finding("Warning", 19, "duplicate", 1, F.concat(F.lit("--> "), F.col("name"))))
        return checks.told(named, [again, renamed], F.col("old_name"))

    def _repair_findings(self) -> DataFrame:
        """What the repair left out or kept: told at the line where the entry ends, after all that the entry itself has."""
        gone = F.when(F.col("code") == 20, checks.finding("Warning", 20, "end", -1, F.col("extra"), step=70))
        kept = F.when(F.col("code") == 21, checks.finding("Warning", 21, "end", 0, step=71))
        return checks.told(self.repair_findings, [gone, kept], F.col("name"))

    def _sequence_findings(self) -> DataFrame:
        last = self.classified.groupBy("file").agg(F.max("line_no").alias("line_no"))
        many = self.unique.where("Protein_Count > 1").join(last, "file")
        names = F.concat(F.col("Protein_Name_First"), F.lit(", "), F.array_join("additional", ", "))
        found = checks.told(many, [checks.finding("Warning", 18, "end", 0, names, F.col("start"))], F.col("Protein_Name_First"))
        order = many.select("file", F.col("Protein_Name_First").alias("protein"), F.col("Sequence_Index").alias("_i")).groupBy("file", "protein").agg(F.min("_i").alias("_i"))
        # In the order of the sequences, before the file's other last findings.
        return found.join(order, ["file", "protein"]).withColumn("emit_seq", F.col("emit_seq") - 100 + F.col("_i") / (F.col("_i") + 1.0) * 90).withColumn("emit_seq", F.col("emit_seq").cast("long")).select(*checks.COLUMNS)

    @functools.cached_property
    def findings(self) -> DataFrame:
        """The findings whose details are kept, with their message."""
        few = checks.capped(self.all_findings, self.options.max_findings)
        texts = F.create_map(*[F.lit(x) for pair in messages(self.options).items() for x in pair])
        message = F.coalesce(F.try_element_at(texts, F.col("code")), F.lit(""))
        return few.withColumn("message", F.when(F.trim("extra") == "", message).otherwise(F.concat(message, F.lit(" ("), F.col("extra"), F.lit(")"))))

    @functools.cached_property
    def finding_counts(self) -> DataFrame:
        return checks.finding_counts(self.all_findings, self.options.max_findings)

    @functools.cached_property
    def names(self) -> DataFrame:
        """(file) of each file of ``summary``, which needs no finding."""
        return (self.classified if self.files is None else self.files).select("file").distinct()

    @functools.cached_property
    def summary(self) -> DataFrame:
        """(file, proteins, residues, lines, errors, warnings) of each file."""
        sums = self.finding_counts.withColumn("n", F.col("n_specified") + F.col("n_unspecified")).groupBy("file").agg(F.sum(F.when(F.col("level") == "Error", F.col("n"))).alias("errors"), F.sum(F.when(F.col("level") == "Warning", F.col("n"))).alias("warnings"))
        counts = records.file_summary(self.classified)
        if self.files is not None:
            counts = self.files.select("file").join(counts, "file", "left").fillna(0, ["proteins", "residues", "lines"])
        return counts.join(sums, "file", "left").fillna(0, ["errors", "warnings"])

    @functools.cached_property
    def verdicts(self) -> DataFrame:
        """(file, valid, has_warnings, errors, warnings) of each file.

        Errors about asterisks and dashes in residues, and the invalid residues that these
        are where no rule of their own names them, do not count where the options allow
        these signs.
        """
        o = self.options
        allowed = [sign for sign, on in (("*", o.allow_asterisk), ("-", o.allow_dash)) if on]
        spared = {r.id for r in o.rule_set.sequence for sign in allowed if r.pattern == "\\" + sign}
        shown = {r.id for r in o.rule_set.sequence if r.show_match}
        harmless = F.col("code").isin(*spared or [-1]) | (F.col("code").isin(*shown or [-1]) & F.col("extra").isin(*allowed or ["\0"]))
        counts = self.all_findings.where(~harmless).groupBy("file").agg(F.count_if(F.col("level") == "Error").alias("errors"), F.count_if(F.col("level") == "Warning").alias("warnings"))
        told = self.summary.select("file").join(counts, "file", "left").fillna(0, ["errors", "warnings"])
        return told.select("file", (F.col("errors") == 0).alias("valid"), (F.col("warnings") > 0).alias("has_warnings"), "errors", "warnings")

    def message(self, index: int, level: str = "Error", separator: str = ", ") -> str | None:
        """The index-th kept finding of a level as text, in the order of the report; None beyond the last."""
        rows = self.findings.where(F.col("level") == level).orderBy("file", "code", "line_no", "col", "emit_seq").offset(index).limit(1).collect()
        if not rows:
            return None
        r = rows[0]
        return separator.join([r.level, str(r.line_no), str(r.col), r.protein or "N/A", r.message, *([r.context] if r.context else [])])

    # Repair

    @functools.cached_property
    def _kept(self) -> DataFrame:
        """The entries that the repaired file has, without their residues."""
        o = self.options
        some = self.entries.where("valid AND ordinal > 0").withColumns({c: trimmed(F.col(c)) for c in ("name", "description")})
        if self.keep is None and o.keep_same_name and not o.rename_duplicates:
            some = dedup.same_name_kept(some)
        if self.keep is None and o.consolidate:
            some = dedup.consolidate(some, self.hashes)
        return some

    @functools.cached_property
    def fixed(self) -> DataFrame:
        """(file, ordinal, name, description, residues, max_line_len) of the entries that the repaired file has; residues is null where they are in segments."""
        some, (whole, _) = self._kept, self.assembled
        # As ``records.records`` has them.
        residues = F.when(F.col("n_residues") == 0, "").otherwise(F.col("residues")).alias("residues")
        return some.join(whole.select("file", "ordinal", "residues"), ["file", "ordinal"], "left").select("file", "ordinal", "name", "description", residues, "max_line_len")

    @functools.cached_property
    def repair_findings(self) -> DataFrame:
        """The entries that the repair leaves out, or keeps although their name is taken: (file, ordinal, line_no, name, code, extra)."""
        o, some = self.options, self.entries.where("valid AND ordinal > 0")
        none = some.where("false").select("file", "ordinal", "name", F.lit(20).alias("code"), F.lit("").alias("extra"))
        found = none
        if self.keep is None and o.fix and o.consolidate:
            found = found.unionByName(dedup.removed_by_consolidation(some, self.hashes).select("file", "ordinal", "name", F.lit(20).alias("code"), F.concat(F.lit("same as "), F.col("same_as")).alias("extra")))
        if self.keep is None and o.fix and o.keep_same_name and not o.rename_duplicates:
            found = found.unionByName(dedup.same_name_kept(some).where("retained").select("file", "ordinal", "name", F.lit(21).alias("code"), F.lit("").alias("extra")))
        ends = self.entries.select("file", "ordinal", F.col("next_header_line_no").alias("line_no"))
        return found.join(ends, ["file", "ordinal"]).select("file", "ordinal", "line_no", "name", "code", "extra")

    @functools.cached_property
    def fixed_lines(self) -> DataFrame:
        """(file, ordinal, part, line): the lines of the repaired file; order by all of these."""
        o = self.options
        width = wrap_width(F.col("max_line_len"), o.max_residues_per_line)
        body = wrapped(F.col("residues"), width)
        if not o.wrap_residues:
            kept = self._kept.select("file", "ordinal")
            clean = records.clean_residues(F.col("text"), o.remove_invalid_residues)
            body_lines = self.classified.where("kind = 'residue'").join(kept, ["file", "ordinal"], "left_semi").select("file", "ordinal", F.col("line_no").alias("part"), clean.alias("line"))
            heads = self._kept.select("file", "ordinal", F.lit(0).cast("long").alias("part"), build_header(F.col("name"), F.col("description"), o.header_start).alias("line"))
            return heads.unionByName(body_lines)
        all_lines = F.concat(F.array(build_header(F.col("name"), F.col("description"), o.header_start)), F.coalesce(body, F.array().cast("array<string>")))
        lines = self.fixed.select("file", "ordinal", F.posexplode(all_lines).alias("part", "line")).withColumn("part", F.col("part").cast("long"))
        _, parts = self.assembled
        if parts is None:
            return lines
        kept = self.fixed.where("residues IS NULL").select("file", "ordinal")
        return lines.unionByName(segments.wrapped_segments(parts.join(kept, ["file", "ordinal"], "left_semi")))

    @functools.cached_property
    def fix_counts(self) -> DataFrame:
        """The seven counters of a repair, for each file."""
        e = self.entries.where("ordinal > 0")
        counts = {
            "truncated_names": F.count_if("truncated"),
            "refs_removed": F.count_if("refs_removed"),
            "chars_replaced": F.count_if("chars_replaced"),
            "duplicates_renamed": F.count_if("renamed"),
            "duplicates_skipped": F.count_if(F.col("name_again") & ~F.col("renamed") & ~F.col("valid")),
            "updated_residue_lines": F.coalesce(F.sum(F.when(F.col("valid"), F.col("changed_lines"))), F.lit(0)),
        }
        base = e.groupBy("file").agg(*(c.alias(k) for k, c in counts.items()))
        gone = self.repair_findings.where("code = 20").groupBy("file").agg(F.count("*").alias("duplicate_sequences_skipped"))
        return base.join(gone, "file", "left").fillna(0, ["duplicate_sequences_skipped"])


def open_files(spark: SparkSession, paths: str | list[str], recursive: bool = False, depth: int | None = None, extensions: tuple[str, ...] | None = EXTENSIONS) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(lines, ends, files, faults) of the files that ``paths`` name.

    Files are read by ranges of bytes where tasks can open them, and else by Spark's
    readers, which pass over names that begin with a dot or an underscore: these are
    refused then. faults: (file, fault) of files that could not be read to their end;
    they have no lines.
    """
    files = file_sizes(spark, paths, recursive, depth, extensions)
    if files.isEmpty():
        raise FileNotFoundError(f"no sequence file in {paths}")
    scheme = F.regexp_extract("file", r"^([a-z0-9+.-]+):", 1)
    if not files.where(~scheme.isin(*ranges.SCHEMES)).isEmpty():
        hidden = files.where(F.col("file").rlike(r"[/\\][._][^/\\]*$")).first()
        if hidden:
            raise ValueError(f"{hidden.file} would be passed over by Spark's readers")
        found = find_files(spark, paths, recursive, depth, extensions)
        return read_lines(spark, found), file_ends(spark, found), files, files.where("false").select("file", F.lit("").alias("fault"))
    cut = stored(ranges.splits(files), "file-ranges")
    sums = stored(ranges.range_sums(cut), "range-sums")
    by_file = stored(ranges.file_sums(sums), "file-sums")
    faults = by_file.where("fault IS NOT NULL").select("file", "fault")
    whole = by_file.where("fault IS NULL").join(files, "file")
    good = whole.select("file")
    lines = ranges.range_lines(cut.join(good, "file", "left_semi"), sums.join(good, "file", "left_semi"))
    gzip = F.lower("file").endswith(".gz")
    ends = whole.where("lines > 0").select("file", "size", "terminator", F.when(~gzip, F.col("ends_with_newline")).alias("ends_with_newline"))
    return lines, ends, files, faults


def validate(spark: SparkSession, paths: str | list[str], options: Options | None = None, recursive: bool = False, depth: int | None = None, extensions: tuple[str, ...] | None = EXTENSIONS, events: Events | None = None) -> Validation:
    """A run over files, plain or gzipped; of folders those with one of ``extensions``, down to ``depth`` levels."""
    with (events or Events()).step(spark, "file-ranges"):
        lines, ends, files, faults = open_files(spark, paths, recursive, depth, extensions)
    return Validation(lines, options, ends, files=files, faults=faults, events=events)


def validate_table(table: DataFrame, id_column: str, text_column: str, options: Options | None = None) -> Validation:
    """A run over a table whose rows hold one file's text each."""
    return Validation(split_lines(table, id_column, text_column), options)


def dedupe_by_hash_file(spark: SparkSession, paths: str | list[str], hash_table: DataFrame, options: Options | None = None, recursive: bool = False, depth: int | None = None) -> tuple[Validation, DataFrame, DataFrame, DataFrame]:
    """A repair that keeps the first name of each sequence in a table of hashes.

    Returns the run, the unique sequences, the name summary and the coverage of the list.
    """
    unique = hashing.unique_from_hash_file(hash_table)
    keep = hashing.keep_list(unique)
    lines, _, files, faults = open_files(spark, paths, recursive, depth)
    run = Validation(lines, (options or Options()).for_hash_file(), None, keep, files=files, faults=faults)
    return run, unique, hashing.name_summary(hash_table, keep), dedup.coverage(keep, run.fixed, run.entries.where("ordinal > 0"))
