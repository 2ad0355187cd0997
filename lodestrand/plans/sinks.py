"""Outputs as single files with the names that the format gives them: parts written in order, then put together by tasks."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from datetime import datetime

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.ranges import CHUNK, SCHEMES, place_of
from ..storage import shared_folder
from .reports import COLUMNS, ENDINGS, REPORT, report_lines, stats_name
from .validation import Validation

#: What the rows of each table are ordered by in its file.
ORDER = {"hashes": ["Protein_ID"], "unique": ["Sequence_Index"], "duplicates": ["Sequence_Index", "Duplicate_Protein"]}


def full_name(spark: SparkSession, folder: str) -> str:
    """``folder`` with its scheme, as tasks open it; an error if they cannot."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    name = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    if name.split(":")[0] not in SCHEMES:
        raise ValueError(f"tasks cannot write single files to {name}")
    return name


def base_name(file: Column) -> Column:
    """A file's name without folders, without ``.gz`` and without its ending."""
    return F.regexp_replace(F.regexp_replace(F.regexp_extract(file, r"([^/\\]*)$", 1), r"(?i)\.gz$", ""), r"(.)\.[^.]*$", "$1")


def target_names(files: DataFrame, ending: str) -> DataFrame:
    """(file, target): each file's output; where files would share a name, a hash of the path is added."""
    named = files.select("file").distinct().withColumn("_base", base_name(F.col("file")))
    shared = named.groupBy("_base").agg((F.count("*") > 1).alias("_several"))
    base = F.when(F.col("_several"), F.concat("_base", F.lit("-"), F.lower(F.hex(F.xxhash64("file"))))).otherwise(F.col("_base"))
    return named.join(shared, "_base").select("file", F.concat(base, F.lit(ending)).alias("target"))


def _join_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Puts the parts of each staged folder together, in the order of their names, under the target's name."""
    for batch in batches:
        sizes = []
        for staged, target, header in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            (source, folder), (sink, path) = place_of(staged), place_of(target)
            found = source.get_file_info(pyarrow.fs.FileSelector(folder, allow_not_found=True))
            sink.create_dir(path.rsplit("/", 1)[0], recursive=True)
            unready = f"{path.rsplit('/', 1)[0]}/.{uuid.uuid4().hex}"  # a second attempt of the task does not meet the first
            with sink.open_output_stream(unready, compression=None) as out:
                out.write(header or b"")
                for part in sorted((x for x in found if x.base_name.startswith("part-")), key=lambda x: x.base_name):
                    with source.open_input_stream(part.path, compression=None) as f:
                        while data := f.read(CHUNK):
                            out.write(data)
                sizes.append(out.tell())
            sink.move(unready, path)
        yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(sizes, pa.int64())], names=["target", "bytes"])


def write_single(rows: DataFrame, targets: DataFrame, folder: str, order: list[str], header: str = "", line_separator: str = "\n", compression: str | None = None) -> DataFrame:
    """The lines of each file in ``targets`` (file, target) as one file of ``folder``; returns (target, bytes), already written.

    rows: (file, *order, line). Lines are written in ranges of their order to the folder
    that driver and executors share; then each output is put together by one task, as a
    stream, and renamed. A file without lines has the header alone. compression: None or
    gzip, whose parts are members of one file; there is no header then.
    """
    spark = rows.sparkSession
    place, staging = full_name(spark, folder), f"{shared_folder(spark)}/lodestrand/output-{uuid.uuid4().hex}"
    staged = full_name(spark, staging)
    key = F.lower(F.hex(F.xxhash64("file")))
    ordered = rows.select(key.alias("id"), *order, "line").repartitionByRange("id", *order).sortWithinPartitions("id", *order)
    ordered.select("id", "line").write.partitionBy("id").text(staging, compression=compression, lineSep=line_separator)
    first = f"{header}{line_separator}".encode() if header else b""
    jobs = targets.select(F.concat(F.lit(f"{staged}/id="), key).alias("staged"), F.concat(F.lit(f"{place}/"), "target").alias("target"), F.lit(first).alias("header"))
    n = targets.count()
    done = jobs.repartition(max(1, min(n, 10_000)), "staged").mapInArrow(_join_parts, "target string, bytes long")
    told = spark.createDataFrame(done.toPandas(), "target string, bytes long") if n <= 1_000_000 else done
    if n <= 1_000_000:
        path = spark._jvm.org.apache.hadoop.fs.Path(staging)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return told


def write_fixed_files(run: Validation, folder: str, line_separator: str = "\n") -> DataFrame:
    """The repaired records of each file as ``<name>_new.fasta``."""
    lines = run.fixed_lines.select("file", "ordinal", "part", "line")
    return write_single(lines, target_names(run.names, ENDINGS["fixed"]), folder, ["ordinal", "part"], line_separator=line_separator)


def write_table_files(table: DataFrame, kind: str, files: DataFrame, folder: str, line_separator: str = "\n") -> DataFrame:
    """One of the tables (hashes, unique, duplicates) of each file as ``<name>_ProteinHashes.txt`` and so on, tabs between."""
    line = F.concat_ws("\t", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in COLUMNS[kind]))
    return write_single(table.select("file", *ORDER[kind], line.alias("line")), target_names(files, ENDINGS[kind]), folder, ORDER[kind], "\t".join(COLUMNS[kind]), line_separator)


def write_normalised_files(run: Validation, folder: str) -> DataFrame:
    """A copy with CR and LF at the end of every line, as ``CRLF_<name>``, of each file that has other line ends.

    Gzipped files are passed over, with a warning; files whose first line end is CRLF
    already have no copy. Inputs are never changed.
    """
    gzip = F.lower("file").endswith(".gz")
    if skipped := run.ends.where(gzip).count():
        run.events.warning(f"{skipped} gzipped files keep their line ends")
    wanted = run.ends.where(~gzip & (F.col("terminator") != "CRLF")).select("file")
    named = wanted.withColumn("name", F.regexp_extract("file", r"([^/\\]*)$", 1))
    several = named.groupBy("name").agg((F.count("*") > 1).alias("several"))
    own = F.when(F.col("several"), F.concat(F.lower(F.hex(F.xxhash64("file"))), F.lit("_"))).otherwise("")
    targets = named.join(several, "name").select("file", F.concat(F.lit("CRLF_"), own, "name").alias("target"))
    return write_single(run.lines.join(wanted, "file", "left_semi").select("file", "line_no", "line"), targets, folder, ["line_no"], line_separator="\r\n")


def append_stats_file(run: Validation, folder: str, sizes: DataFrame | None = None, date: datetime | None = None) -> str:
    """The report as the next numbered part of the day's statistics file, a folder; returns its path.

    The first part begins with the column names. A run claims its number by creating a
    file that no other run can, so two runs at a time have two parts; a part is renamed
    into place when it is whole.
    """
    date = date or datetime.now()
    spark = run.lines.sparkSession
    path = f"{full_name(spark, folder.rstrip('/'))}/{stats_name(date)}"
    jvm, number = spark._jvm, 0
    fs = jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    while not fs.createNewFile(jvm.org.apache.hadoop.fs.Path(f"{path}/_claim-{number:06d}")):
        number += 1
    lines = report_lines(run, "\t", sizes, date)
    numbered = lines.select(F.lit("").alias("file"), F.monotonically_increasing_id().alias("at"), F.col("value").alias("line"))
    targets = spark.createDataFrame([("", f"part-{number:06d}.txt")], "file string, target string")
    write_single(numbered, targets, path, ["at"], "\t".join(["Date", *REPORT]) if number == 0 else "")
    return path


def read_stats_file(spark: SparkSession, path: str) -> DataFrame:
    """(value): the lines of a statistics file in the order of its runs."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_name").alias("name"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    return lines.orderBy("name", "block", "at").select("value")
