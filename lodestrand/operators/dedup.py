"""Duplicate names and duplicate sequences: found, renamed, skipped, kept or merged."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import MAX_DESCRIPTION, with_duplicates
from .hashing import first_names, other_names, running_sums
from .renaming import ending, endings, rename_duplicates

__all__ = ["consolidate", "coverage", "duplicate_names", "ending", "endings", "kept_by_list", "removed_by_consolidation", "rename_duplicates", "same_name_kept"]


def _first_places(entries: DataFrame, name: Column) -> DataFrame:
    """(_file, _key, _first): where each name of a file is met first; sums within each task come first."""
    return entries.groupBy(F.col("file").alias("_file"), name.alias("_key")).agg(F.min("ordinal").alias("_first"))


def _with_first(entries: DataFrame, name: Column) -> DataFrame:
    """``entries`` with _first, joined by the name: a name that most rows have is one row of the smaller side."""
    firsts = _first_places(entries, name)
    return entries.join(firsts, F.col("file").eqNullSafe(F.col("_file")) & name.eqNullSafe(F.col("_key"))).drop("_file", "_key")


def duplicate_names(entries: DataFrame) -> DataFrame:
    """``entries`` with name_again: an earlier entry of the file has the name, in either case."""
    marked = _with_first(entries, F.lower("name"))
    return marked.withColumn("name_again", (F.col("name") != "") & (F.col("ordinal") > F.col("_first"))).drop("_first")


def same_name_kept(entries: DataFrame, hash_column: str = "Sequence_Hash") -> DataFrame:
    """Entries whose name is new, or whose sequence differs from the first entry of that name."""
    key = F.lower("name")
    firsts = entries.groupBy(F.col("file").alias("_file"), key.alias("_key")).agg(F.min(F.struct("ordinal", hash_column)).alias("_first"))
    marked = entries.join(firsts, F.col("file").eqNullSafe(F.col("_file")) & key.eqNullSafe(F.col("_key")))
    later = F.col("ordinal") > F.col("_first.ordinal")
    retained = later & (F.col(hash_column) != F.col(f"_first.{hash_column}"))
    return marked.withColumn("retained", retained).where(~later | F.col("retained")).drop("_first", "_file", "_key")


def consolidate(entries: DataFrame, hashes: DataFrame) -> DataFrame:
    """The first entry of each sequence, the other names at the end of its description.

    entries: file, ordinal, name, description, ...; hashes: see ``hashing.protein_hashes``.
    Other names come by the order of their sequences, then by name, without the entry's
    own and its own with an ending. Only as many are gathered as a description can hold,
    which a running length over ranges tells, however many names a sequence has.
    """
    key = F.lower("Protein_Name_First").alias("_key")
    base = F.regexp_extract("name", r"(.+)-[a-z]\d*", 1)
    others = other_names(hashes).select("file", key, "first_ordinal", "name").where((F.lower("name") != F.col("_key")) & (F.lower(base) != F.col("_key")))
    placed = running_sums(others.withColumn("_n", (F.length("name") + 1).cast("long")), {"_before": "_n"}, ["first_ordinal", "name"], ["file", "_key"]).where(F.col("_before") <= MAX_DESCRIPTION)
    lists = placed.groupBy("file", "_key").agg(F.transform(F.array_sort(F.collect_list(F.struct("first_ordinal", "name"))), lambda x: x["name"]).alias("_others"))
    once = _with_first(entries, F.lower("name")).where("ordinal = _first").drop("_first").withColumn("_key", F.lower("name"))
    joined = once.join(first_names(hashes).select("file", key), ["file", "_key"], "left_semi").join(lists, ["file", "_key"], "left")
    return joined.withColumn("description", F.when(F.col("_others").isNotNull(), with_duplicates(F.col("description"), F.col("_others"))).otherwise(F.col("description"))).drop("_key", "_others")


def removed_by_consolidation(entries: DataFrame, hashes: DataFrame) -> DataFrame:
    """(file, ordinal, name, same_as): the entries that go, and the one that stands for each."""
    firsts = first_names(hashes).select("file", F.lower("Protein_Name_First").alias("_key")).distinct()
    others = other_names(hashes).select("file", F.lower("name").alias("_key"), F.col("Protein_Name_First").alias("same_as")).groupBy("file", "_key").agg(F.min("same_as").alias("same_as"))
    gone = entries.withColumn("_key", F.lower("name")).join(firsts, ["file", "_key"], "left_anti").join(others, ["file", "_key"], "left")
    return gone.select("file", "ordinal", "name", F.coalesce("same_as", F.lit("??")).alias("same_as"))


def kept_by_list(entries: DataFrame, keep: DataFrame) -> DataFrame:
    """The first entry of each name in ``keep`` (Protein_Name); the case of letters counts."""
    wanted = keep.select(F.col("Protein_Name").alias("name")).distinct()
    return _with_first(entries.join(wanted, "name", "left_semi"), F.col("name")).where("ordinal = _first").drop("_first")


def coverage(keep: DataFrame, kept: DataFrame, entries: DataFrame) -> DataFrame:
    """(wanted, written, not_found, duplicated): what became of the names in the list."""
    have = entries.groupBy(F.col("name").alias("Protein_Name")).agg(F.count("*").alias("n"))
    joined = keep.join(have, "Protein_Name", "left")
    return joined.agg(F.count("*").alias("wanted"), F.count("n").alias("written"), F.count_if(F.col("n").isNull()).alias("not_found"), F.count_if(F.col("n") > 1).alias("duplicated"))
