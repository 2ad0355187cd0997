"""Registered queries beside those of ``queries``: names that meet each other's endings, and what goes through files."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import dedup, segments
from .options import Options
from .plans import sinks
from .plans.validation import Validation, open_files
from .queries import ENTRIES, RECORDS, _read, doc_records, entry_lines
from .storage import shared_folder

#: Endings that some names are given, so that endings made later meet them; capital letters too.
GIVEN = ("", "", "", "-b", "-C", "-b-b", "", "-a1", "-b2", "-d", "-c-b", "-b01")


def q_rename_mixed(spark, d):
    """Renamed names where given names already end like the endings that are made."""
    mixed = F.concat("source", F.lit("|"), (F.col("doc_id") % 5).cast("string"), F.element_at(F.array(*map(F.lit, GIVEN)), (F.col("doc_id") / 5 % len(GIVEN) + 1).cast("int")))
    entries = _read(spark, d, "documents").select(F.col("lang").alias("file"), F.col("doc_id").alias("ordinal"), mixed.alias("name"))
    return dedup.rename_duplicates(entries).select("file", "ordinal", "new_name")


MIXED_SQL = rf"""
WITH RECURSIVE e AS (SELECT lang AS file, doc_id AS ordinal, source || '|' || (doc_id % 5) || {list(GIVEN)}[(doc_id // 5) % {len(GIVEN)} + 1] AS name FROM documents),
placed AS (SELECT *, regexp_replace(lower(name), '(-[a-z]\d*)+$', '') AS root, row_number() OVER (PARTITION BY file, regexp_replace(lower(name), '(-[a-z]\d*)+$', '') ORDER BY ordinal) AS i FROM e),
endings AS (SELECT list('-' || CASE WHEN k < 25 THEN chr((98 + k)::INT) ELSE chr((97 + (k - 25) % 26)::INT) || ((k - 25) // 26 + 1) END ORDER BY k) AS all_of FROM range((SELECT max(i) + 1 FROM placed)) AS r(k)),
walk(file, root, i, taken, ordinal, new_name) AS (
  SELECT DISTINCT file, root, 0::BIGINT, []::VARCHAR[], NULL::BIGINT, NULL::VARCHAR FROM placed
  UNION ALL
  SELECT file, root, i, list_append(taken, lower(new_name)), ordinal, new_name FROM (
    SELECT p.file, p.root, p.i, w.taken, p.ordinal, CASE WHEN list_contains(w.taken, lower(p.name)) THEN p.name || list_filter(all_of[:p.i + 1], lambda x: NOT list_contains(w.taken, lower(p.name) || x))[1] ELSE p.name END AS new_name
    FROM walk w JOIN placed p ON p.file = w.file AND p.root = w.root AND p.i = w.i + 1, endings
  )
)
SELECT file, ordinal, new_name FROM walk WHERE i > 0
"""


#: What ends the texts in a language's file, by the second letter of its name; how the file is called.
FILES = {0: ("\n", "{}.fasta", None), 1: ("\r\n", "{}.fasta.gz", "gzip"), 2: ("\r", "_{}.faa", None)}


def _folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/lodestrand/files-{uuid.uuid4().hex}"


def written_texts(spark: SparkSession, d: str) -> str:
    """A folder with a file for each language: its texts by doc_id, with line feeds, carriage returns or both after each, one kind of file gzipped, one with hidden names."""
    folder = _folder(spark)
    docs = _read(spark, d, "documents").select(F.col("lang").alias("file"), F.col("doc_id").alias("at"), F.coalesce("text", F.lit("")).alias("line"))
    kind = F.ascii(F.substring("file", 2, 1)) % 3
    for number, (end, name, compression) in FILES.items():
        some = docs.where(kind == number)
        targets = some.select("file").distinct().withColumn("target", F.replace(F.lit(name), F.lit("{}"), F.col("file")))
        sinks.write_single(some, targets, folder, ["at"], line_separator=end, compression=compression)
    return folder


def _language(file: str = "file"):
    return F.regexp_extract(file, r"/_?([a-z]+)[^/]*$", 1)


def q_file_lines(spark, d):
    """Lines of files with each kind of line end, of gzipped ones and of hidden names."""
    lines, *_ = open_files(spark, written_texts(spark, d))
    return lines.select(_language().alias("file"), "line_no", F.length("line").alias("n"), F.md5(F.col("line").cast("binary")).alias("md5"))


def q_file_ends(spark, d):
    """Kind of the first line end, the last line end, and the number of lines of each file."""
    lines, ends, files, faults = open_files(spark, written_texts(spark, d))
    counts = lines.groupBy("file").agg(F.count("*").alias("lines"))
    whole = files.join(ends.drop("size"), "file", "left").join(counts, "file", "left").join(faults, "file", "left")
    return whole.select(_language().alias("file"), "terminator", "ends_with_newline", "lines", F.col("fault").isNull().alias("readable"))


def q_fixed_files(spark, d):
    """Repaired records, written as one file for each input and read again."""
    folder = _folder(spark)
    sinks.write_fixed_files(Validation(entry_lines(spark, d), Options(fix=True)), folder, "\r\n")
    lines, *_ = open_files(spark, folder)
    return lines.select(F.regexp_extract("file", r"/([a-z]+)_new\.fasta$", 1).alias("file"), "line_no", F.md5(F.col("line").cast("binary")).alias("md5"))


def q_table_files(spark, d):
    """The table of unique sequences, written as one file for each input and read again."""
    folder = _folder(spark)
    run = Validation(entry_lines(spark, d), Options())
    sinks.write_table_files(run.unique, "unique", run.names, folder)
    lines, *_ = open_files(spark, folder, extensions=(".txt",))
    return lines.select(F.regexp_extract("file", r"/([a-z]+)_UniqueProteinSeqs\.txt$", 1).alias("file"), "line_no", "line")


def _one_entry_a_source(spark: SparkSession, d: str) -> DataFrame:
    rows = doc_records(spark, d).where("residues <> ''")
    return rows.select("file", F.xxhash64(F.split_part("name", F.lit("|"), F.lit(1))).alias("ordinal"), F.split_part("name", F.lit("|"), F.lit(1)).alias("source"), F.col("ordinal").alias("line_no"), F.length("residues").cast("long").alias("raw"), F.when(F.col("ordinal") % 9 == 0, F.concat("residues", F.lit("*"))).otherwise(F.col("residues")).alias("clean"), F.lit(False).alias("changed"))


def q_segmented_sequences(spark, d):
    """Sequences in segments: all letters of a source in a language as one entry, its lines the documents."""
    lines = _one_entry_a_source(spark, d)
    parts = segments.segments(lines.drop("source"), Options(), size=100_000)
    sums = segments.segment_sums(parts, True)
    wide = segments.wrapped_segments(parts).groupBy("file", "ordinal").agg(F.max("part").alias("n_lines"), F.max("line").alias("largest_line"))
    names = lines.select("file", "ordinal", "source").distinct()
    return sums.join(wide, ["file", "ordinal"]).join(names, ["file", "ordinal"]).drop("ordinal")


def _faulty_entries(spark: SparkSession, d: str) -> DataFrame:
    """Lines of entries made of parts: known accessions, long names, unwanted characters, names and sequences that come again, small letters."""
    k = F.col("p_partkey")
    kind = k % 6
    name = F.when(kind == 0, F.concat(F.lit("gi|"), k, F.lit("|rest"))).when(kind == 1, F.concat(F.lit("longname"), k, F.lit("|second|third|fourth_part"))).when(kind == 2, F.concat(F.lit("na#me"), k)).when(kind == 5, F.concat(F.lit("plain"), k)).otherwise(F.concat(F.lit("dup"), k % 40))
    residues = F.concat(F.expr("substring(repeat('ACDEFGHIKL', 8), cast(p_partkey % 50 + 1 AS int), 20)"), F.when(k % 4 == 0, "x").otherwise(""))
    lines = F.array(F.concat(F.lit(">"), name, F.lit(" about")), residues)
    parts = _read(spark, d, "part").select(F.concat(F.lit("f"), k % 3).alias("file"), "p_partkey", F.posexplode(lines).alias("i", "line"))
    return parts.select("file", (F.col("p_partkey") * 2 + F.col("i")).alias("line_no"), "line")


def q_fix_counters(spark, d):
    """The seven counters of a repair, of one run that renames duplicates and of one that leaves out duplicate names and sequences."""
    same = {"fix": True, "max_name_length": 24, "invalid_name_chars": "#%", "remove_invalid_residues": True}
    runs = {"rename": Options(rename_duplicates=True, **same), "leave out": Options(consolidate=True, **same)}
    counts = [Validation(_faulty_entries(spark, d), o).fix_counts.withColumn("run", F.lit(k)) for k, o in runs.items()]
    return counts[0].unionByName(counts[1])


COUNTERS_SQL = """
WITH e AS (
  SELECT 'f' || (p_partkey % 3) AS file, p_partkey AS k, p_partkey % 6 AS kind, substring(repeat('ACDEFGHIKL', 8), (p_partkey % 50 + 1)::INT, 20) AS residues,
    p_partkey % 6 IN (3, 4) AND row_number() OVER (PARTITION BY p_partkey % 3, p_partkey % 6 IN (3, 4), p_partkey % 40 ORDER BY p_partkey) > 1 AS again
  FROM part
)
SELECT run, file, count(*) FILTER (WHERE kind = 1) AS truncated_names, count(*) FILTER (WHERE kind = 0) AS refs_removed, count(*) FILTER (WHERE kind = 2) AS chars_replaced, count(*) FILTER (WHERE again AND run = 'rename') AS duplicates_renamed,
  count(*) FILTER (WHERE again AND run <> 'rename') AS duplicates_skipped, count(*) FILTER (WHERE k % 4 = 0 AND (run = 'rename' OR NOT again)) AS updated_residue_lines,
  CASE WHEN run = 'rename' THEN 0 ELSE count(*) FILTER (WHERE NOT again) - count(DISTINCT residues) FILTER (WHERE NOT again) END AS duplicate_sequences_skipped
FROM e, (VALUES ('rename'), ('leave out')) AS r(run) GROUP BY run, file
"""
CONTENT = r"""content AS (
  SELECT lang AS file, string_agg(coalesce(text, '') || CASE ascii(lang[2]) % 3 WHEN 0 THEN chr(10) WHEN 1 THEN chr(13) || chr(10) ELSE chr(13) END, '' ORDER BY doc_id) AS t
  FROM documents WHERE lang IS NOT NULL GROUP BY lang
),
parts AS (SELECT file, string_split_regex(t, '\r\n|\n|\r')[:-2] AS p FROM content)"""
FIXED_SQL = f"""
WITH {ENTRIES}, w AS (SELECT *, greatest(least(length(residues), 120), 10) AS w FROM e WHERE k = 1),
l AS (SELECT file, ordinal, 0 AS part, '>' || name || ' d' AS line FROM w UNION ALL SELECT file, ordinal, unnest(range(1, ((length(residues) + w - 1) // w) + 1)), unnest([substring(residues, i, w) for i in range(1, length(residues) + 1, w)]) FROM w WHERE residues <> '')
SELECT file, row_number() OVER (PARTITION BY file ORDER BY ordinal, part) AS line_no, md5(line) AS md5 FROM l
"""
TABLE_SQL = f"""
WITH {ENTRIES}, u AS (SELECT file, hash, min(ordinal) AS o, arg_min(name, ordinal) AS first, max(length(residues)) AS n, list_sort(list(DISTINCT name)) AS names FROM e WHERE k = 1 AND residues <> '' GROUP BY file, hash),
r AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY o) AS i, [x for x in names if x <> first] AS others FROM u)
SELECT file, 1 AS line_no, concat_ws(chr(9), 'Sequence_Index', 'Protein_Name_First', 'Sequence_Length', 'Sequence_Hash', 'Protein_Count', 'Duplicate_Proteins') AS line FROM (SELECT DISTINCT file FROM e)
UNION ALL SELECT file, i + 1, concat_ws(chr(9), i, first, n, hash, len(others) + 1, coalesce(array_to_string(others, ','), '')) FROM r
"""
SEGMENTED_SQL = f"""
WITH {RECORDS}, s AS (SELECT file, split_part(name, '|', 1) AS source, rtrim(string_agg(residues || CASE WHEN ordinal % 9 = 0 THEN '*' ELSE '' END, '' ORDER BY ordinal), '*') AS r, max(length(residues) + CASE WHEN ordinal % 9 = 0 THEN 1 ELSE 0 END) AS longest FROM records WHERE residues <> '' GROUP BY ALL),
w AS (SELECT *, CASE WHEN longest > 120 THEN 120 ELSE greatest(longest, 10) END AS w FROM s),
l AS (SELECT file, source, max(line) AS largest_line, count(*) AS n_lines FROM (SELECT file, source, unnest([substring(r, i, w) for i in range(1, length(r) + 1, w)]) AS line FROM w) GROUP BY ALL)
SELECT file, source, length(r) AS n_residues, substring(r, 1, 20) AS start, upper(sha1(replace(r, 'L', 'I'))) AS Sequence_Hash, length(regexp_replace(r, '[^A-Z]', '', 'g')) AS letters, length(regexp_replace(r, '[^ATCG]', '', 'g')) AS nucleic, n_lines, largest_line
FROM w JOIN l USING (file, source)
"""

QUERIES = {name: f for name, f in list(globals().items()) if name.startswith("q_")}
ORACLE_SQL = {
    "q_rename_mixed": MIXED_SQL,
    "q_file_lines": f"WITH {CONTENT} SELECT file, line_no, length(line) AS n, md5(line) AS md5 FROM (SELECT file, generate_subscripts(p, 1) AS line_no, unnest(p) AS line FROM parts)",
    "q_file_ends": rf"WITH {CONTENT} SELECT file, CASE regexp_extract(t[:100000], '(\r\n|\n\r|\n|\r)') WHEN chr(10) || chr(13) THEN 'LFCR' WHEN chr(10) THEN 'LF' WHEN chr(13) THEN 'CR' ELSE 'CRLF' END AS terminator, CASE WHEN ascii(file[2]) % 3 <> 1 THEN true END AS ends_with_newline, len(p) AS lines, true AS readable FROM content JOIN parts USING (file)",
    "q_fixed_files": FIXED_SQL,
    "q_table_files": TABLE_SQL,
    "q_segmented_sequences": SEGMENTED_SQL,
    "q_fix_counters": COUNTERS_SQL,
}
