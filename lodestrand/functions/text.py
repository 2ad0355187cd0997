"""Column functions on header lines, names and residues: built-in expressions only."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..options import Options

HEADER_CONTEXT = 13
SEQUENCE_CONTEXT = 5
MIN_SPLIT_INDEX = 6
MIN_WRAP = 10
MAX_DESCRIPTION = 7995


# A long text is searched only where its first or last character says that there may be something to find.


def _signs_at(text: Column, *places: int) -> Column:
    return F.concat(*(F.substring(text, place, 1) for place in places))


def is_blank(line: Column) -> Column:
    return _signs_at(line, 1).rlike(r"(?U)^\s*$") & line.rlike(r"(?U)^\s*$")


def left_trimmed(line: Column) -> Column:
    return F.when(_signs_at(line, 1).rlike(r"(?U)\s"), F.regexp_replace(line, r"(?U)^\s+", "")).otherwise(line)


def trimmed(text: Column) -> Column:
    return F.when(_signs_at(text, 1, -1).rlike(r"(?U)\s"), F.regexp_replace(text, r"(?U)^\s+|\s+$", "")).otherwise(text)


_HEADER = r"(?s)^.([^ \t\xA0�]*)(?:[ \t\xA0�](.*))?$"


def header_name(header: Column) -> Column:
    """Up to the first space, tab, non-breaking space or replacement character."""
    return F.regexp_extract(header, _HEADER, 1)


def header_description(header: Column) -> Column:
    """What follows the separator; nothing where the name is empty."""
    return F.when(header_name(header) == "", "").otherwise(F.regexp_extract(header, _HEADER, 2))


def context(text: Column, index: Column, length: int) -> Column:
    """The characters around a 0-based index; a text of one character or none as it is."""
    length += 1 - length % 2
    half = (length - 1) // 2
    start = F.greatest(index - half, F.lit(0))
    end = F.least(F.greatest(index + half, start + length - 1), F.length(text) - 1)
    return F.when(F.length(text) <= 1, text).otherwise(F.substring(text, (start + 1).cast("int"), (end - start + 1).cast("int")))


def sequence_hash(residues: Column, ignore_il: bool = False) -> Column:
    """SHA-1 in upper-case hex, leucine and isoleucine alike if asked; empty for an empty sequence."""
    plain = F.translate(residues, "L", "I") if ignore_il else residues
    return F.when(residues == "", "").otherwise(F.upper(F.sha1(plain.cast("binary"))))


def residue_counts(residues: Column) -> dict[str, Column]:
    """How many letters there are, and how many of them are upper-case A, T, C or G."""
    return {"letters": F.length(F.regexp_replace(residues, r"\P{L}+", "")).cast("long"), "nucleic": F.length(F.regexp_replace(residues, "[^ATCG]+", "")).cast("long")}


def clean_residues(line: Column, remove_invalid: bool) -> Column:
    return F.regexp_replace(line, r"[^A-Z(*)(-)]+", "") if remove_invalid else trimmed(line)


def wrap_width(longest: Column, most: int) -> Column:
    width = F.when((longest <= 0) | (longest > most), most).otherwise(longest)
    return F.greatest(width, F.lit(MIN_WRAP))


def wrapped(residues: Column, width: Column) -> Column:
    """The residues as an array of lines of ``width``, cut in one pass."""
    lines = F.regexp_extract_all(residues, F.concat(F.lit("(?s).{1,"), width.cast("int").cast("string"), F.lit("}")), F.lit(0))
    return F.when(residues == "", F.array().cast("array<string>")).otherwise(lines)


def build_header(name: Column, description: Column, start: str = ">") -> Column:
    shown = F.when(is_blank(name), "????").otherwise(name)
    return F.concat(F.lit(start), shown, F.when(is_blank(description), "").otherwise(F.concat(F.lit(" "), description)))


def with_duplicates(description: Column, names: Column) -> Column:
    """The description with the names of duplicates, cut to what readers of the format take."""
    full = F.concat(description, F.lit("; Duplicate proteins: "), F.array_join(names, ","))
    return F.when(F.length(full) > MAX_DESCRIPTION, F.concat(F.substring(full, 1, MAX_DESCRIPTION - 3), F.lit("..."))).otherwise(full)


def prepended(extra: Column, description: Column) -> Column:
    cut = F.regexp_replace(extra, r"[| ]+$", "")
    glued = F.when(description == "", cut).when(F.substring(description, 1, 1).isin(" ", "|"), F.concat(cut, description)).otherwise(F.concat(cut, F.lit(" "), description))
    return F.when(extra == "", description).otherwise(glued)


# Accession patterns. Fixed values; {first} and {next} are the separator characters.
IPI = r"^(IPI:IPI[\w.]{2,})\|(.+)"
GI = r"^(gi\|\d+)\|(.+)"
JGI = r"^(jgi\|[^|]+\|[^|]+)\|(.+)"
GENERIC = r"^(\w{{2,}}[{first}][\w\d._]{{2,}})[{next}](.+)"
JGI_BASE = r"^jgi\|[^|]+\|\d+"
SEVERAL = r"[{first}][^{next}]*([{next}])"


def _class(characters: str) -> str:
    return re.sub(r"([\\\]\[^&-])", r"\\\1", characters)


def with_repair(entries: DataFrame, options: Options, name: str = "name", description: str = "description", column: str = "fixed") -> DataFrame:
    """``entries`` with a struct of name, description and the flags truncated, refs_removed, chars_replaced.

    In order: known accessions and too long names lose what follows them to the
    description; unwanted characters go; further references go to the description.
    Each step is a column of its own, so no step repeats the expressions of the one
    before.
    """
    o, c = options, F.col
    first, following = _class(o.first_ref_separators), _class(o.subsequent_ref_separators)
    no = F.lit(False)
    out = entries.withColumns({"_name": c(name), "_about": c(description), "_long": F.length(name) > o.max_name_length, "_known": no, "_cut": no, "_refs": no, "_tidied": no})
    if o.split_known_accessions or o.truncate_long_names:
        applies = F.lit(True) if o.split_known_accessions else c("_long")
        patterns = [IPI, GI, JGI] + ([GENERIC.format(first=first, next=following)] if o.truncate_long_names else [])
        # The number of the pattern that holds, the accessions before the general one.
        out = out.withColumn("_which", F.coalesce(*(F.when(c("_name").rlike("(?sU)" + x) & (c("_long") if i == 3 else F.lit(True)), F.lit(i)) for i, x in enumerate(patterns)), F.lit(-1)))
        part = lambda k: F.coalesce(*(F.when(c("_which") == i, F.regexp_extract("_name", "(?sU)" + x, k)) for i, x in enumerate(patterns)))
        out = out.withColumns({"_known": applies & c("_which").between(0, 2), "_new": part(1), "_extra": part(2)})
        if o.truncate_long_names:
            # Cut at a split character: the last one that leaves a short enough name, else the first one allowed.
            chars, most = o.long_name_split_chars, o.max_name_length
            out = out.withColumn("_signs", F.when((c("_which") < 0) & c("_long"), F.split("_name", "")))
            out = out.withColumn("_places", F.filter(F.transform("_signs", lambda x, i: F.when((i >= MIN_SPLIT_INDEX) & F.lit(chars).contains(x) & (x != ""), i)), lambda i: i.isNotNull()))
            out = out.withColumn("_at", F.coalesce(F.array_max(F.filter("_places", lambda i: i <= most)), F.array_min("_places")))
            out = out.withColumn("_rest", F.rtrim(F.translate(F.substring("_name", (c("_at") + 2).cast("int"), F.length("_name")), chars, "|" * len(chars)), F.lit("|")))
            out = out.withColumns({"_new": F.coalesce("_new", F.substring("_name", F.lit(1), c("_at").cast("int"))), "_extra": F.coalesce("_extra", "_rest")})
        out = out.withColumn("_moved", applies & (F.coalesce("_extra", F.lit("")) != ""))
        out = out.withColumns({"_name": F.when(c("_moved"), c("_new")).otherwise(c("_name")), "_about": F.when(c("_moved"), prepended(c("_extra"), c("_about"))).otherwise(c("_about")), "_cut": c("_moved") & c("_long"), "_refs": c("_moved") & ~c("_long")})
    if o.invalid_name_chars:
        chars = o.invalid_name_chars
        out = out.withColumn("_tidy", F.translate(F.btrim("_name", F.lit(chars)), chars, "_" * len(chars)))
        out = out.withColumn("_tidied", (c("_tidy") != c("_name")) & (F.length("_tidy") >= 3))
        out = out.withColumn("_name", F.when(c("_tidied"), c("_tidy")).otherwise(c("_name")))
    if o.split_multiple_refs:
        several = ~c("_known") & c("_name").rlike("(?s)" + SEVERAL.format(first=first, next=following))
        second = F.regexp_extract("_name", rf"(?s)^([^{first}]*[{first}][^{following}]*)[{following}](.*)$", 1)
        out = out.withColumn("_kept", F.when(several, F.coalesce(F.regexp_substr("_name", F.lit(JGI_BASE)), second)).otherwise(""))
        out = out.withColumn("_extra", F.when(c("_kept") != "", F.substring("_name", F.length("_kept") + 2, F.length("_name"))).otherwise(""))
        out = out.withColumn("_split", (c("_kept") != "") & (c("_extra") != ""))
        out = out.withColumns({"_name": F.when(c("_split"), c("_kept")).otherwise(c("_name")), "_about": F.when(c("_split"), prepended(c("_extra"), c("_about"))).otherwise(c("_about")), "_refs": c("_refs") | c("_split")})
    told = F.struct(c("_name").alias("name"), F.regexp_replace("_about", r"^[| ]+", "").alias("description"), c("_cut").alias("truncated"), c("_refs").alias("refs_removed"), c("_tidied").alias("chars_replaced"))
    return out.select(*entries.columns, told.alias(column))
