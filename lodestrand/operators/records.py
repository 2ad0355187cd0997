"""From lines to records: what each line is, which entry it belongs to, and the entries put together."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import clean_residues, header_description, header_name, is_blank, left_trimmed
from ..options import Options
from ..sources.files import BLOCK_LINES
from .hashing import measured

MAX_LINE = 10_000_000


def classify(lines: DataFrame, header_start: str = ">", block_lines: int = BLOCK_LINES, reset_blank_on_header: bool = False, keep: Callable[[DataFrame, str], DataFrame] | None = None) -> DataFrame:
    """Every line with its kind, its entry's ordinal and what came before it.

    Adds: text (left-trimmed), kind ('header', 'residue', 'blank', 'oversize'), ordinal
    (headers so far; 0 before the first), prev_kind (of the last line that was neither
    blank nor oversize, null before the first) and blank_before (a blank line since the
    last residue line).

    A file is cut into blocks of ``block_lines``: windows run within blocks, and one row
    for each block carries the counts and last places over, so a huge file is no task.
    Lines go to their block once, without the text, which is cut from them there.
    keep(rows, name) stores rows: with it the blocks' lines are stored before blocks are
    counted, so ``lines`` are read once, not for the counts again. Only blocks with
    another before them carry anything over, so what each read of the stored lines is
    joined with has a row for these alone, however many files there are.
    """
    text = left_trimmed(F.col("line"))
    kind = F.when(F.length("line") > MAX_LINE, "oversize").when(is_blank(F.col("line")), "blank").when(F.substring(text, 1, 1) == header_start, "header").otherwise("residue")
    rows = lines.select("file", "line_no", "line").withColumn("kind", kind).withColumn("block", F.floor((F.col("line_no") - 1) / block_lines)).where("file IS NOT NULL AND block IS NOT NULL")
    of = lambda k: F.when(F.col("kind") == k, F.col("line_no"))
    marks = {"h": of("header"), "r": of("residue"), "b": of("blank")}
    here = Window.partitionBy("file", "block").orderBy("line_no")
    before = here.rowsBetween(Window.unboundedPreceding, -1)
    own = rows.withColumns({"n": F.sum((F.col("kind") == "header").cast("long")).over(here.rowsBetween(Window.unboundedPreceding, 0))} | {k: F.max(c).over(before) for k, c in marks.items()})
    if keep:
        own = rows = keep(own, "classified-lines")
    sums = rows.groupBy("file", "block").agg(F.count_if(F.col("kind") == "header").alias("n"), *(F.max(c).alias(k) for k, c in marks.items()))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carry = sums.select("file", "block", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("n0"), *(F.max(k).over(earlier).alias(f"{k}0") for k in marks)).where("h0 IS NOT NULL OR r0 IS NOT NULL OR b0 IS NOT NULL")
    none = F.lit(0)
    joined = own.join(keep(carry, "blocks") if keep else carry, ["file", "block"], "left").withColumns({k: F.coalesce(k, f"{k}0", none) for k in marks} | {"n": F.col("n") + F.coalesce("n0", none)})
    since = F.greatest("r", "h") if reset_blank_on_header else F.col("r")
    prev = F.when(F.col("h") > F.col("r"), "header").when(F.col("r") > F.col("h"), "residue")
    return joined.select("file", "line_no", "line", text.alias("text"), "kind", F.col("n").alias("ordinal"), prev.alias("prev_kind"), (F.col("b") > since).alias("blank_before"))


def split_headers(classified: DataFrame) -> DataFrame:
    """(file, ordinal, line_no, header, name, description) of every header line."""
    header = F.col("text")
    return classified.where("kind = 'header'").select("file", "ordinal", "line_no", header.alias("header"), header_name(header).alias("name"), header_description(header).alias("description"))


def residue_lines(classified: DataFrame, options: Options | None = None) -> DataFrame:
    """(file, ordinal, line_no, raw, clean, changed) of each line of residues: its length, what is left of it, whether that differs."""
    clean = clean_residues(F.col("text"), (options or Options()).remove_invalid_residues)
    return classified.where("kind = 'residue'").select("file", "ordinal", "line_no", F.length("text").cast("long").alias("raw"), clean.alias("clean"), (clean != F.col("text")).alias("changed"))


def line_sums() -> list[Column]:
    return [F.sum("raw").alias("raw_residues"), F.max(F.length("clean")).alias("max_line_len"), F.count("*").alias("n_residue_lines"), F.count_if("changed").alias("changed_lines")]


def assemble(classified: DataFrame, options: Options | None = None) -> DataFrame:
    """(file, ordinal, residues, raw_residues, max_line_len, n_residue_lines, changed_lines) of each entry with residue lines.

    residues are the cleaned lines joined in order, without asterisks at the end;
    raw_residues counts the characters of the left-trimmed lines, as they were. An entry
    is one cell here: see ``segments`` for entries of any length.
    """
    grouped = residue_lines(classified, options).groupBy("file", "ordinal").agg(F.array_sort(F.collect_list(F.struct("line_no", "clean"))).alias("parts"), *line_sums())
    joined = F.array_join(F.transform("parts", lambda p: p["clean"]), "")
    return grouped.select("file", "ordinal", F.rtrim(joined, F.lit("*")).alias("residues"), "raw_residues", "max_line_len", "n_residue_lines", "changed_lines")


def records(classified: DataFrame, options: Options | None = None, assembled: DataFrame | None = None) -> DataFrame:
    """Headers beside their residues, also entries with only one of the two, and where the next header lies.

    next_header_line_no is the line at which the entry ends: the next header's, or the
    file's last. n_residues, start, Sequence_Hash, letters and nucleic: see
    ``hashing.measured``. assembled: see ``segments.assembled``; without it every entry is
    one cell. Residues of an entry that is in segments are null.
    """
    heads, options = split_headers(classified), options or Options()
    whole = assembled if assembled is not None else measured(assemble(classified, options), options.hash_ignores_il)
    # Entry ends by the entry after: a join on the ordinal, not a window over a whole file.
    following = heads.select("file", (F.col("ordinal") - 1).alias("ordinal"), F.col("line_no").alias("next_line"))
    last = classified.groupBy("file").agg(F.max("line_no").alias("line_count"))
    both = heads.join(whole, ["file", "ordinal"], "full").join(following, ["file", "ordinal"], "left").join(last, "file")
    text = lambda c: F.coalesce(c, F.lit("")).alias(c)
    number = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    residues = F.when(F.coalesce("n_residues", F.lit(0)) == 0, "").otherwise(F.col("residues")).alias("residues")
    return both.select("file", "ordinal", F.col("line_no").alias("header_line_no"), F.coalesce("next_line", "line_count").alias("next_header_line_no"), *map(text, ("header", "name", "description")), residues, *map(number, ("raw_residues", "max_line_len", "n_residue_lines", "changed_lines", "n_residues", "letters", "nucleic")), *map(text, ("start", "Sequence_Hash")))


def file_summary(classified: DataFrame) -> DataFrame:
    """(file, proteins, residues, lines) of each file."""
    return classified.groupBy("file").agg(F.count_if(F.col("kind") == "header").alias("proteins"), F.coalesce(F.sum(F.when(F.col("kind") == "residue", F.length("text"))), F.lit(0)).cast("long").alias("residues"), F.max("line_no").alias("lines"))


def nucleic(entries: DataFrame) -> DataFrame:
    """(file, ordinal, name, percent, likely_dna) of each entry with residues; likely if every letter is A, T, C or G."""
    share = F.when(F.col("letters") > 0, F.col("nucleic") * 100.0 / F.col("letters")).otherwise(0.0)
    return measured(entries).where("n_residues > 0").select("file", "ordinal", "name", share.alias("percent"), ((F.col("letters") > 0) & (share >= 100)).alias("likely_dna"))
