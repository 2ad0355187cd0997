"""Lines of text files, plain or gzipped, with their numbers; tables of hashes; what ends a file."""

from __future__ import annotations

import functools
import operator
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..storage import stored
from .ranges import SCHEMES, place_of

#: Lines of one block: what one task of the state operators holds at a time.
BLOCK_LINES = 50_000
#: Bytes that are looked at for the kind of line end.
SNIFF_BYTES = 100_000
#: Endings of the files that are looked for in a folder. Fixed values.
EXTENSIONS = (".fasta", ".faa")


def _literal(path: str) -> str:
    """A name as a pattern that matches nothing else."""
    return re.sub(r"([\\{}\[\]*?,])", r"\\\1", path)


def _named(uri: Column) -> Column:
    """A file's name as it is, from the form in which the readers' metadata has it."""
    return F.url_decode(F.replace(uri, F.lit("+"), F.lit("%2B")))


def _listed(spark: SparkSession, paths: str | list[str], recursive: bool, depth: int | None, extensions: tuple[str, ...] | None) -> list[tuple[str, str, int]]:
    """(pattern, file, size) of each file found, those too whose names begin with a dot or an underscore."""
    jvm, found = spark._jvm, {}
    conf = spark._jsc.hadoopConfiguration()
    fits = lambda name: extensions is None or name.lower().removesuffix(".gz").endswith(tuple(extensions))

    def add(at) -> None:
        name = at.getPath().toString()
        found[_literal(name)] = (name, at.getLen())

    def walk(fs, folder, left: float) -> None:
        for at in sorted(fs.listStatus(folder), key=lambda x: x.getPath().toString()):
            if at.isDirectory():
                if left > 0:
                    walk(fs, at.getPath(), left - 1)
            elif fits(at.getPath().getName()):
                add(at)

    for path in [paths] if isinstance(paths, str) else paths:
        place = jvm.org.apache.hadoop.fs.Path(path)
        fs = place.getFileSystem(conf)
        for at in fs.globStatus(place) or []:
            if at.isDirectory():
                walk(fs, at.getPath(), (float("inf") if depth is None else depth) if recursive else 0)
            else:
                add(at)
    return [(k, *v) for k, v in found.items()]


def find_files(spark: SparkSession, paths: str | list[str], recursive: bool = False, depth: int | None = None, extensions: tuple[str, ...] | None = EXTENSIONS) -> list[str]:
    """The files that ``paths`` name: files and patterns as they are, of folders those with one of ``extensions``.

    What comes back is for Spark's readers, which take names as patterns: signs of
    patterns in a name are escaped. Endings count in either case, with or without
    ``.gz`` after them; None takes all. depth: levels of folders below a given one that
    ``recursive`` goes down, all if None.
    """
    return [pattern for pattern, *_ in _listed(spark, paths, recursive, depth, extensions)]


def _one_level(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What lies in each folder, not deeper."""
    for batch in batches:
        for folder, left in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            fs, path = place_of(folder)
            found = fs.get_file_info(pyarrow.fs.FileSelector(path))
            names = [f"{folder.rstrip('/')}/{x.base_name}" for x in found]
            folders = [x.type == pyarrow.fs.FileType.Directory for x in found]
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([x.size for x in found], pa.int64()), pa.array(folders, pa.bool_()), pa.array([left - 1] * len(found), pa.int64())], names=["file", "size", "folder", "left"])


def file_sizes(spark: SparkSession, paths: str | list[str], recursive: bool = False, depth: int | None = None, extensions: tuple[str, ...] | None = EXTENSIONS) -> DataFrame:
    """(file, size) of each file that ``paths`` name, empty and hidden ones too; see ``find_files``.

    The driver looks at the given names alone. Folders are listed by tasks, a level at a
    time, so neither the number of folders nor of files is held in one place; where tasks
    cannot open them, the driver lists them.
    """
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    files, folders = [], []
    for path in [paths] if isinstance(paths, str) else paths:
        place = jvm.org.apache.hadoop.fs.Path(path)
        for at in place.getFileSystem(conf).globStatus(place) or []:
            (folders if at.isDirectory() else files).append((at.getPath().toString(), at.getLen()))
    if any(name.split(":")[0] not in SCHEMES for name, _ in files + folders):
        return spark.createDataFrame([row[1:] for row in _listed(spark, paths, recursive, depth, extensions)], "file string, size long")
    found = spark.createDataFrame(files, "file string, size long")
    level = spark.createDataFrame([(name, (1 << 40 if depth is None else depth) if recursive else 0) for name, _ in folders], "folder string, left long")
    wanted = [F.regexp_replace(F.lower("file"), r"\.gz$", "").endswith(x) for x in extensions or ()]
    while not level.isEmpty():
        n = max(1, min(level.count(), 10_000))
        listed = stored(level.repartition(n, "folder").mapInArrow(_one_level, "file string, size long, folder boolean, left long"), "listed-folders")
        here = listed.where("NOT folder").select("file", "size")
        found = found.unionByName(here.where(functools.reduce(operator.or_, wanted)) if wanted else here)
        level = listed.where("folder AND left >= 0").select(F.col("file").alias("folder"), "left")
    return found.distinct()


def read_lines(spark: SparkSession, paths: str | list[str], recursive: bool = False, pattern: str | None = None) -> DataFrame:
    """(file, line_no, line) of every physical line; numbers start at 1 in each file.

    Spark's reader splits files at line feeds, carriage returns and both together, and
    unpacks gzip. Numbers come without sorting: rows of one split are contiguous in
    ``monotonically_increasing_id``, so a line's number is its place in its split plus
    the lines of the splits before, of which there is one row each. These readers pass
    over names that begin with a dot or an underscore: see ``ranges`` for all files.
    """
    reader = spark.read.option("recursiveFileLookup", str(recursive).lower())
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    raw = reader.text(paths).select(_named(F.col("_metadata.file_path")).alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("at"), F.make_valid_utf8("value").alias("line"))
    splits = raw.groupBy("file", "split").agg(F.min("at").alias("first"), F.count("*").alias("lines"))
    before = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    placed = splits.withColumn("before", F.coalesce(F.sum("lines").over(before), F.lit(0))).drop("lines")
    numbered = raw.join(placed, ["file", "split"])
    line_no = F.col("at") - F.col("first") + F.col("before") + 1
    text = F.when(line_no == 1, F.regexp_replace("line", "^﻿", "")).otherwise(F.col("line"))
    return numbered.select("file", line_no.alias("line_no"), text.alias("line"))


def file_ends(spark: SparkSession, paths: str | list[str], recursive: bool = False) -> DataFrame:
    """(file, size, terminator, ends_with_newline) of each file.

    terminator: CRLF, LF, CR or LFCR, by the first line end in the leading bytes; CRLF
    if there is none. ends_with_newline is null for gzip files, whose size says nothing
    of their text.

    The file is read in splits, cut at line feeds alone: its lines' bytes and one line
    feed for each are its size, or one more than that if the last line has none.
    """
    listed = spark.read.option("recursiveFileLookup", str(recursive).lower()).option("lineSep", "\n").text(paths)
    raw = listed.select(_named(F.col("_metadata.file_path")).alias("file"), F.col("_metadata.file_size").alias("size"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("at"), F.col("value").cast("binary").alias("line"))
    place = F.struct("split", "at")
    head = F.struct("split", "at", F.substring("line", 1, SNIFF_BYTES).alias("head"), F.octet_length("line").alias("n"))
    tail = F.struct("split", "at", F.expr("substring(line, -1, 1)").alias("tail"))
    # The first two lines decide: a carriage return may stand before or after the line feed.
    sums = raw.groupBy("file", "size").agg(F.sum(F.octet_length("line")).alias("bytes"), F.count("*").alias("lines"), F.min(head).alias("a"), F.max(tail).alias("z"))
    second = raw.select("file", place.alias("place"), F.substring("line", 1, 1).alias("start")).join(sums.select("file", F.struct("a.split", "a.at").alias("first")), "file").where(F.col("place") > F.col("first")).groupBy("file").agg(F.min(F.struct("place", "start")).alias("b"))
    first = F.hex("a.head")
    cr = F.regexp_extract(first, "^((?:(?!0D)..)*)0D", 1)
    has_cr, at_end = first.rlike("^(?:(?!0D)..)*0D"), (F.length(cr) / 2 + 1 == F.col("a.n"))
    feeds = (F.col("lines") > 1) | (F.col("bytes") + F.col("lines") == F.col("size"))
    near = F.col("a.n") < SNIFF_BYTES
    kind = F.when(has_cr & at_end & feeds, "CRLF").when(has_cr, "CR").when(~(near & feeds), "CRLF").when(F.hex("b.start") == "0D", "LFCR").otherwise("LF")
    ended = (F.col("bytes") + F.col("lines") == F.col("size")) | (F.hex("z.tail") == "0D")
    gzip = F.lower("file").endswith(".gz")
    return sums.join(second, "file", "left").select("file", "size", kind.alias("terminator"), F.when(~gzip, ended).alias("ends_with_newline"))


def line_terminator(text: Column) -> Column:
    """The kind of the first line end of a text in memory."""
    end = F.regexp_extract(F.substring(text, 1, SNIFF_BYTES), "(\r\n|\n\r|\n|\r)", 1)
    return F.when(end == "\n\r", "LFCR").when(end == "\n", "LF").when(end == "\r", "CR").otherwise("CRLF")


def split_lines(table: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """(file, line_no, line) of the texts of a table, one file for each row; a null text is one empty line."""
    return table.select(F.col(id_column).cast("string").alias("file"), F.posexplode(F.split(F.coalesce(text_column, F.lit("")), "\r\n|\n|\r")).alias("pos", "line")).select("file", (F.col("pos") + 1).cast("long").alias("line_no"), "line")


HASH_COLUMNS = ("Protein_Name", "Sequence_Length", "Sequence_Hash")


def read_hash_file(spark: SparkSession, path: str) -> DataFrame:
    """A tab-separated table of hashes; columns are found by name in either case, all as text."""
    table = spark.read.csv(path, sep="\t", header=True, quote="", escape="")
    names = {c.strip().lower(): c for c in table.columns}
    if missing := [c for c in HASH_COLUMNS if c.lower() not in names]:
        raise ValueError(f"the hash file lacks the column {missing[0]}")
    return table.select(*(F.col(f"`{names[c.lower()]}`").alias(c) for c in HASH_COLUMNS), *([F.col(f"`{names['protein_id']}`").alias("Protein_ID")] if "protein_id" in names else []))
