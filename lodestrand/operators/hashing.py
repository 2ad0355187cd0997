"""Fingerprints of sequences, the unique ones, and the tables that list them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import residue_counts, sequence_hash
from ..storage import stored


def indexed(df: DataFrame, column: str, *order: str, by: str | list[str] | None = "file") -> DataFrame:
    """``df`` with its 1-based place in the order of a file, without a window over the whole of it.

    Rows are put in ranges of the order; a row's place is the rows of the ranges before
    plus its place in its own range, and there is one row for each range. The ranges are
    stored: drawn again for the counts, they would have other bounds. by: the columns
    whose values are counted apart; a value that most rows share fills several ranges,
    as long as ``order`` tells its rows apart.
    """
    group = [by] if isinstance(by, str) else list(by or [])
    ranged = stored(df.repartitionByRange(*group, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    own = Window.partitionBy(*group, "_range").orderBy(*order)
    sizes = ranged.groupBy(*group, "_range").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    same = [F.col(f"r.{c}").eqNullSafe(F.col(f"b.{c}")) for c in [*group, "_range"]]
    placed = ranged.withColumn("_own", F.row_number().over(own)).alias("r").join(bases.alias("b"), same)
    return placed.select(*(F.col(f"r.{c}") for c in df.columns), (F.col("_own") + F.col("_base")).alias(column))


def running_sums(df: DataFrame, sums: dict[str, str], order: list[str], by: list[str]) -> DataFrame:
    """``df`` with, for each new column in ``sums``, what the column named there adds up to in the rows before, in the order of a group.

    Like ``indexed``: rows are put in ranges of the group and the order, and one row for
    each range carries the sums over, so a group may fill any number of ranges.
    """
    ranged = stored(df.repartitionByRange(*by, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    own = Window.partitionBy(*by, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    bases = ranged.groupBy(*by, "_range").agg(*(F.sum(c).alias(f"_{k}") for k, c in sums.items())).select(*by, "_range", *(F.coalesce(F.sum(f"_{k}").over(before), zero).alias(f"_{k}") for k in sums))
    same = [F.col(f"r.{c}").eqNullSafe(F.col(f"b.{c}")) for c in [*by, "_range"]]
    placed = ranged.withColumns({f"_own_{k}": F.coalesce(F.sum(c).over(own), zero) for k, c in sums.items()}).alias("r").join(bases.alias("b"), same)
    return placed.select(*(F.col(f"r.{c}") for c in df.columns), *((F.col(f"_own_{k}") + F.col(f"_{k}")).alias(k) for k in sums))


def measured(entries: DataFrame, ignore_il: bool = False) -> DataFrame:
    """``entries`` with what is asked of their residues: n_residues, start (the first 20), Sequence_Hash, letters and nucleic (how many A, T, C and G)."""
    if "n_residues" in entries.columns:
        return entries
    r = F.col("residues")
    return entries.withColumns({"n_residues": F.length(r).cast("long"), "start": F.substring(r, 1, 20), "Sequence_Hash": sequence_hash(r, ignore_il), **residue_counts(r)})


def protein_hashes(entries: DataFrame, ignore_il: bool = False) -> DataFrame:
    """(file, Protein_ID, Protein_Name, Sequence_Length, Sequence_Hash) of each entry with residues, in their order."""
    some = measured(entries, ignore_il).where("n_residues > 0").select("file", "ordinal", F.col("name").alias("Protein_Name"), F.col("n_residues").alias("Sequence_Length"), "Sequence_Hash", "start")
    return indexed(some, "Protein_ID", "ordinal")


def unique_sequences(hashes: DataFrame) -> DataFrame:
    """One row for each sequence of a file, by first appearance.

    Columns: file, Sequence_Index, Protein_Name_First (the first seen), Sequence_Length,
    Sequence_Hash, Protein_Count, Duplicate_Proteins (other names, in order, commas
    between), additional (the same as an array), repeats (how often a name came again),
    start (first residues).
    """
    first = F.min(F.struct("ordinal", "Protein_Name", "Sequence_Length", "start"))
    sums = hashes.groupBy("file", "Sequence_Hash").agg(first.alias("first"), F.collect_set("Protein_Name").alias("names"), F.count("*").alias("n"))
    others = F.array_sort(F.filter("names", lambda x: x != F.col("first.Protein_Name")))
    shaped = sums.select("file", F.col("first.ordinal").alias("first_ordinal"), F.col("first.Protein_Name").alias("Protein_Name_First"), F.col("first.Sequence_Length").alias("Sequence_Length"), "Sequence_Hash", others.alias("additional"), (F.col("n") - F.size("names")).alias("repeats"), F.col("first.start").alias("start"))
    ranked = indexed(shaped, "Sequence_Index", "first_ordinal")
    return ranked.select("file", "Sequence_Index", "Protein_Name_First", "Sequence_Length", "Sequence_Hash", (F.size("additional") + 1).alias("Protein_Count"), F.array_join("additional", ",").alias("Duplicate_Proteins"), "additional", "repeats", "start")


def first_names(hashes: DataFrame) -> DataFrame:
    """(file, Sequence_Hash, first_ordinal, Protein_Name_First, Sequence_Length) of each sequence: where and under which name it is met first."""
    first = F.min(F.struct("ordinal", "Protein_Name", "Sequence_Length")).alias("first")
    return hashes.groupBy("file", "Sequence_Hash").agg(first).select("file", "Sequence_Hash", F.col("first.ordinal").alias("first_ordinal"), F.col("first.Protein_Name").alias("Protein_Name_First"), F.col("first.Sequence_Length").alias("Sequence_Length"))


def other_names(hashes: DataFrame) -> DataFrame:
    """A row for each other name of each sequence: the columns of ``first_names`` and name. No sequence's names are gathered."""
    names = hashes.select("file", "Sequence_Hash", F.col("Protein_Name").alias("name")).distinct()
    return names.join(first_names(hashes), ["file", "Sequence_Hash"]).where("name <> Protein_Name_First")


def duplicate_rows(hashes: DataFrame) -> DataFrame:
    """The rows of ``sequence_duplicates`` straight from the hashes, for sequences with any number of names."""
    ranked = indexed(first_names(hashes), "Sequence_Index", "first_ordinal").select("file", "Sequence_Hash", "Sequence_Index")
    named = other_names(hashes).join(ranked, ["file", "Sequence_Hash"])
    return named.select("file", "Sequence_Index", "Protein_Name_First", "Sequence_Length", F.col("name").alias("Duplicate_Protein"))


def sequence_duplicates(unique: DataFrame) -> DataFrame:
    """(file, Sequence_Index, Protein_Name_First, Sequence_Length, Duplicate_Protein): one row for each other name."""
    return unique.select("file", "Sequence_Index", "Protein_Name_First", "Sequence_Length", F.explode("additional").alias("Duplicate_Protein"))


def unique_from_hash_file(table: DataFrame) -> DataFrame:
    """The same of a table of hashes, by hash; the first name is the first by alphabet."""
    sums = table.groupBy("Sequence_Hash").agg(F.array_sort(F.collect_set("Protein_Name")).alias("names"), F.min(F.col("Sequence_Length").cast("int")).alias("Sequence_Length"))
    shaped = sums.select(F.get("names", F.lit(0)).alias("Protein_Name_First"), "Sequence_Length", "Sequence_Hash", F.slice("names", 2, F.greatest(F.size("names") - 1, F.lit(0))).alias("additional"))
    ranked = indexed(shaped, "Sequence_Index", "Sequence_Hash", by=None)
    return ranked.select(F.lit("").alias("file"), "Sequence_Index", "Protein_Name_First", "Sequence_Length", "Sequence_Hash", (F.size("additional") + 1).alias("Protein_Count"), F.array_join("additional", ",").alias("Duplicate_Proteins"), "additional")


def keep_list(unique: DataFrame) -> DataFrame:
    """(Protein_Name): the first name of each sequence, each once."""
    return unique.select(F.col("Protein_Name_First").alias("Protein_Name")).distinct()


def name_summary(table: DataFrame, keep: DataFrame) -> DataFrame:
    """(Protein_Name, Sequence_Hash, First_Protein_For_Hash, Duplicate_Name) of each row, flags as '0' and '1'.

    The first of equal names is not a duplicate; which comes first is decided by the hash.
    """
    flag = lambda c: c.cast("int").cast("string")
    rows = table.select("Protein_Name", "Sequence_Hash", F.monotonically_increasing_id().alias("at"))
    placed = indexed(rows, "k", "Sequence_Hash", "at", by="Protein_Name")  # a name that most rows have is in many ranges
    known = keep.select("Protein_Name", F.lit(True).alias("kept"))
    return placed.select("Protein_Name", "Sequence_Hash", (F.col("k") > 1).alias("again")).join(known, "Protein_Name", "left").select("Protein_Name", "Sequence_Hash", flag(F.coalesce("kept", F.lit(False))).alias("First_Protein_For_Hash"), flag(F.col("again")).alias("Duplicate_Name"))
