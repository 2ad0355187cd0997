"""Reports and files: statistics rows, tables of hashes, repaired text."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .validation import Validation

#: File name endings of the outputs. Fixed values.
ENDINGS = {"fixed": "_new.fasta", "hashes": "_ProteinHashes.txt", "unique": "_UniqueProteinSeqs.txt", "duplicates": "_UniqueProteinSeqDuplicates.txt", "names": "_ProteinNameSummary.txt"}
COLUMNS = {
    "hashes": ["Protein_ID", "Protein_Name", "Sequence_Length", "Sequence_Hash"],
    "unique": ["Sequence_Index", "Protein_Name_First", "Sequence_Length", "Sequence_Hash", "Protein_Count", "Duplicate_Proteins"],
    "duplicates": ["Sequence_Index", "Protein_Name_First", "Sequence_Length", "Duplicate_Protein"],
    "names": ["Protein_Name", "Sequence_Hash", "First_Protein_For_Hash", "Duplicate_Name"],
}
#: Columns of the statistics file. Fixed values.
REPORT = ["SourceFile", "MessageType", "LineNumber", "ColumnNumber", "Description_or_Protein", "Info", "Context"]


def report_rows(run: Validation, sizes: DataFrame | None = None) -> DataFrame:
    """The rows of the statistics report, with file and rank to order them by.

    For each file: its path, its counts, its errors, its warnings, a line that sums it
    up. sizes: (file, size) in bytes for the last; without it the size is left out.
    """
    summary = run.summary
    summary = summary.join(sizes.select("file", "size"), "file", "left") if sizes is not None else summary.withColumn("size", F.lit(None).cast("long"))
    name = F.regexp_extract("file", r"([^/\\]*)$", 1)
    number = lambda c: F.format_number(c, 0)
    total = F.concat(number("proteins"), F.lit(" proteins, "), number("residues"), F.lit(" residues"), F.coalesce(F.concat(F.lit(", "), F.format_string("%.0f", F.col("size") / 1024), F.lit(" KB")), F.lit("")))
    lines = [(0, "Status", "Full path to file", F.col("file"), F.lit(True)), (1, "Status", "Protein count", number("proteins"), F.lit(True)), (2, "Status", "Residue count", number("residues"), F.lit(True)), (3, "Error", "Error count", F.col("errors").cast("string"), F.col("errors") > 0), (5, "Warning", "Warning count", F.col("warnings").cast("string"), F.col("warnings") > 0), (7, "Status", "Summary line", total, F.lit(True))]
    each = F.array_compact(F.array(*[F.when(c, F.struct(F.lit(r).alias("rank"), F.lit(k).alias("type"), F.lit(t).alias("text"), i.alias("info"))) for r, k, t, i, c in lines]))
    zero = F.lit(0).cast("long")
    status = summary.select("file", name.alias("SourceFile"), F.explode(each).alias("s")).select("file", "s.rank", zero.alias("code"), zero.alias("emit_seq"), "SourceFile", F.col("s.type").alias("MessageType"), zero.alias("LineNumber"), F.lit(0).alias("ColumnNumber"), F.col("s.text").alias("Description_or_Protein"), F.col("s.info").alias("Info"), F.lit("").alias("Context"))
    protein = F.when(F.col("protein") == "", "N/A").otherwise(F.col("protein"))
    details = run.findings.select("file", F.when(F.col("level") == "Error", 4).otherwise(6).alias("rank"), F.col("code").cast("long").alias("code"), "emit_seq", name.alias("SourceFile"), F.col("level").alias("MessageType"), F.col("line_no").alias("LineNumber"), F.col("col").alias("ColumnNumber"), protein.alias("Description_or_Protein"), F.col("message").alias("Info"), F.col("context").alias("Context"))
    return status.unionByName(details)


def report(run: Validation, sizes: DataFrame | None = None) -> DataFrame:
    """The report in order."""
    return report_rows(run, sizes).orderBy("file", "rank", "code", "LineNumber", "ColumnNumber", "emit_seq").select(*REPORT)


def report_lines(run: Validation, separator: str = "\t", sizes: DataFrame | None = None, date: datetime | None = None) -> DataFrame:
    """The report as text, the context left out where it is empty; ``date`` stands before each line."""
    first = [F.lit(date.strftime("%Y-%m-%d %H:%M:%S"))] if date else []
    base = F.concat_ws(separator, *first, *REPORT[:-1])
    return report(run, sizes).select(F.when(F.col("Context") == "", base).otherwise(F.concat_ws(separator, base, "Context")).alias("value"))


def stats_name(date: datetime) -> str:
    return f"FastaFileStats_{date:%Y-%m-%d}.txt"


def append_stats(run: Validation, folder: str, sizes: DataFrame | None = None, date: datetime | None = None) -> str:
    """The report added to the day's statistics file of ``folder``, a folder of parts; returns its path.

    The first run of a day also writes the line of column names, in the part that comes
    before all others; a later run adds parts and changes none.
    """
    date = date or datetime.now()
    path, spark = f"{folder.rstrip('/')}/{stats_name(date)}", run.lines.sparkSession
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    fresh = not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)
    lines = report_lines(run, "\t", sizes, date)
    if fresh:
        spark.createDataFrame([("\t".join(["Date", *REPORT]),)], "value string").coalesce(1).write.mode("append").text(path)
    lines.write.mode("append").text(path)
    return path


def write_table(table: DataFrame, kind: str, path: str, mode: str = "errorifexists") -> None:
    """One of the tab-separated outputs, a folder with a part for each task."""
    table.select(*COLUMNS[kind]).write.mode(mode).csv(path, sep="\t", header=True, quote="", escape="", emptyValue="")


def _sources(lines: DataFrame) -> DataFrame:
    """``lines`` with source: the file's name, and a hash of its path where files of several folders have that name."""
    name = F.regexp_replace(F.regexp_extract("file", r"([^/\\]*)$", 1), r"(?i)\.gz$", "")
    files = lines.select("file").distinct().withColumn("name", name)
    shared = files.groupBy("name").agg((F.count("*") > 1).alias("several"))
    named = files.join(shared, "name").select("file", F.when(F.col("several"), F.concat("name", F.lit("-"), F.lower(F.hex(F.xxhash64("file"))))).otherwise(F.col("name")).alias("source"))
    return lines.join(named, "file")


def write_fixed(run: Validation, path: str, line_separator: str = "\n", mode: str = "errorifexists") -> None:
    """The repaired records, in order, one folder for each input file."""
    ordered = _sources(run.fixed_lines).repartitionByRange("source", "ordinal").sortWithinPartitions("source", "ordinal", "part")
    ordered.select("source", "line").write.mode(mode).partitionBy("source").option("lineSep", line_separator).text(path)


def write_normalised(lines: DataFrame, path: str, line_separator: str = "\r\n", mode: str = "errorifexists") -> None:
    """The lines of files with one kind of line end; the last line has one too. Inputs are never changed."""
    ordered = _sources(lines).repartitionByRange("source", "line_no").sortWithinPartitions("source", "line_no")
    ordered.select("source", "line").write.mode(mode).partitionBy("source").option("lineSep", line_separator).text(path)


def write_with_last_line_end(run: Validation, path: str, mode: str = "errorifexists") -> None:
    """The lines of those files that lack the last line end, with it, each file's other line ends as they are."""
    for kind, separator in (("CRLF", "\r\n"), ("LF", "\n"), ("CR", "\r"), ("LFCR", "\n\r")):
        lacking = run.ends.where((F.col("terminator") == kind) & ~F.col("ends_with_newline")).select("file")
        write_normalised(run.lines.join(lacking, "file", "left_semi"), f"{path}/{kind}", separator, mode)
