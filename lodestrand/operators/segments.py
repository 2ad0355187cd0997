"""Entries of any length: residues in segments instead of one cell, hashed as a stream and wrapped segment by segment."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import residue_counts, wrap_width, wrapped
from ..options import Options
from ..storage import stored
from .hashing import measured, running_sums
from .records import assemble, line_sums, residue_lines
from .streams import joined_digests

#: Characters of a segment, at most.
SEGMENT = 1 << 20
#: Entries with more characters than this, as they stand in the file, are put in segments.
CELL = 1 << 26


def long_entries(classified: DataFrame, most: int = CELL) -> DataFrame:
    """(file, ordinal) of the entries whose residue lines have more than ``most`` characters."""
    sums = classified.where("kind = 'residue'").groupBy("file", "ordinal").agg(F.sum(F.length("text")).alias("n"))
    return sums.where(F.col("n") > most).select("file", "ordinal")


def segments(lines: DataFrame, options: Options, size: int = SEGMENT) -> DataFrame:
    """(file, ordinal, segment, per_segment, width, residues) of entries given as ``records.residue_lines``.

    Segments are numbered from 0 and hold whole lines of the entry's wrapping width,
    per_segment of them, but for the last one. A line's place in its entry is the sum of
    the lines before it, which comes from ranges, so an entry may have any number of
    lines. Asterisks at the end of an entry are left out. An entry of nothing else has no
    segment.
    """
    sized = lines.withColumn("n", F.length("clean").cast("long"))
    placed = stored(running_sums(sized, {"at": "n"}, ["line_no"], ["file", "ordinal"]), "placed-lines")
    solid = F.length(F.rtrim("clean", F.lit("*"))).cast("long")
    ends = placed.groupBy("file", "ordinal").agg(F.max(F.when(solid > 0, F.col("at") + solid)).alias("end"), F.max("n").alias("longest"))
    width = wrap_width(F.col("longest"), options.max_residues_per_line).cast("long")
    shaped = ends.where("end IS NOT NULL").select("file", "ordinal", "end", width.alias("width")).withColumn("per_segment", F.greatest(F.floor(F.lit(size) / F.col("width")), F.lit(1)))
    cut = placed.join(shaped, ["file", "ordinal"]).where("at < end AND n > 0").withColumn("n", F.least("n", F.col("end") - F.col("at"))).withColumn("_size", F.col("width") * F.col("per_segment"))
    met = F.sequence(F.floor(F.col("at") / F.col("_size")), F.floor((F.col("at") + F.col("n") - 1) / F.col("_size")))
    pieces = cut.withColumn("segment", F.explode(met))
    first = F.greatest(F.col("segment") * F.col("_size") - F.col("at"), F.lit(0))
    last = F.least((F.col("segment") + 1) * F.col("_size") - F.col("at"), F.col("n"))
    text = F.substring("clean", (first + 1).cast("int"), (last - first).cast("int"))
    grouped = pieces.select("file", "ordinal", "segment", "width", "per_segment", "line_no", text.alias("text")).groupBy("file", "ordinal", "segment").agg(F.first("per_segment").alias("per_segment"), F.first("width").alias("width"), F.array_sort(F.collect_list(F.struct("line_no", "text"))).alias("parts"))
    return grouped.select("file", "ordinal", "segment", "per_segment", "width", F.array_join(F.transform("parts", lambda p: p["text"]), "").alias("residues"))


def segment_sums(parts: DataFrame, ignore_il: bool = False) -> DataFrame:
    """(file, ordinal, n_residues, start, Sequence_Hash, letters, nucleic) of entries in segments, as ``hashing.measured`` has them.

    The SHA-1 is taken of an entry's segments one after the other, its state carried
    over from each to the next.
    """
    residues = F.col("residues")
    counted = parts.select("file", "ordinal", F.length(residues).cast("long").alias("n"), F.when(F.col("segment") == 0, F.substring(residues, 1, 20)).alias("start"), *(c.alias(k) for k, c in residue_counts(residues).items()))
    sums = counted.groupBy("file", "ordinal").agg(F.sum("n").alias("n_residues"), F.max("start").alias("start"), F.sum("letters").alias("letters"), F.sum("nucleic").alias("nucleic"))
    plain = F.translate(residues, "L", "I") if ignore_il else residues
    hashes = joined_digests(parts, ["file", "ordinal"], "segment", plain, algorithm="sha1").select("file", "ordinal", F.upper("sha1").alias("Sequence_Hash"))
    return sums.join(hashes, ["file", "ordinal"])


def wrapped_segments(parts: DataFrame) -> DataFrame:
    """(file, ordinal, part, line): the wrapped lines of entries in segments, part from 1 on. Segments end where lines do."""
    lines = parts.select("file", "ordinal", "segment", "per_segment", F.posexplode(wrapped(F.col("residues"), F.col("width"))).alias("i", "line"))
    return lines.select("file", "ordinal", (F.col("segment") * F.col("per_segment") + F.col("i") + 1).alias("part"), "line")


def assembled(classified: DataFrame, options: Options, most: int = CELL, size: int = SEGMENT) -> tuple[DataFrame, DataFrame | None]:
    """Entries with residue lines as ``records.records`` takes them, and the segments of the long ones, null if there are none.

    Entries of up to ``most`` characters are put together in one cell; the residues of
    longer ones are null. All have the same measures. Runs a job: it looks for long
    entries.
    """
    long = long_entries(classified, most)
    if long.isEmpty():
        return measured(assemble(classified, options), options.hash_ignores_il), None
    long = stored(long, "long-entries")
    short = classified.join(long, ["file", "ordinal"], "left_anti")
    lines = residue_lines(classified.join(long, ["file", "ordinal"], "left_semi"), options)
    parts = stored(segments(lines, options, size), "segments")
    sums = segment_sums(parts, options.hash_ignores_il)
    told = lines.groupBy("file", "ordinal").agg(*line_sums()).join(sums, ["file", "ordinal"], "left").withColumn("residues", F.lit(None).cast("string"))
    return measured(assemble(short, options), options.hash_ignores_il).unionByName(told), parts
