"""The registered queries of the sequence-file operators, each with the SQL that says the same.

The driver's tables hold no sequence files; three views of them take their place. Lines:
each document is a file and its text the lines. Records: each document is an entry named
after its source and id, its letters the residues, in a file for each language. Stream:
the lines of all documents of a source as one file, each document after a header line.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as t
from .operators import checks, dedup, hashing, records
from .options import Options
from .plans.validation import Validation
from .rules import default_rules
from .sources.files import line_terminator, split_lines

OPTIONS = Options()
RULES = default_rules()
MIX_OPTIONS = Options(fix=True, max_name_length=24, split_multiple_refs=True, invalid_name_chars="#%")


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def doc_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_lines(_read(spark, sf_dir, "documents"), "doc_id", "text")


def doc_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file, ordinal, name, description, residues, next_header_line_no)."""
    letters = F.upper(F.regexp_replace("text", "[^A-Za-z]+", ""))
    name = F.concat("source", F.lit("|"), F.col("doc_id") % 50)
    return _read(spark, sf_dir, "documents").select(F.col("lang").alias("file"), F.col("doc_id").alias("ordinal"), name.alias("name"), F.concat(F.lit("from "), F.col("source")).alias("description"), letters.alias("residues"), (F.col("doc_id") + 1).alias("next_header_line_no"))


RECORDS = "records AS (SELECT lang AS file, doc_id AS ordinal, source || '|' || (doc_id % 50) AS name, 'from ' || source AS description, upper(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS residues FROM documents)"
LINES = r"lines AS (SELECT doc_id::VARCHAR AS file, generate_subscripts(p, 1) AS line_no, unnest(p) AS line FROM (SELECT doc_id, string_split_regex(text, '\r\n|\n|\r') AS p FROM documents))"
KINDS = LINES + r", kinds AS (SELECT *, regexp_replace(line, '^\s+', '') AS text, CASE WHEN regexp_full_match(line, '\s*') THEN 'blank' WHEN regexp_matches(line, '^\s*>') THEN 'header' ELSE 'residue' END AS kind FROM lines)"


def stream_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of one file for each source: a header line for each document, then its lines, a blank one before every third."""
    docs = _read(spark, sf_dir, "documents")
    header = F.concat(F.lit(">"), "source", F.lit("|"), F.col("doc_id"), F.lit(" "), "lang")
    spaced = F.flatten(F.transform(F.split("text", "\n"), lambda x, i: F.when(i % 3 == 2, F.array(F.lit(""), x)).otherwise(F.array(x))))
    parts = docs.select(F.col("source").alias("file"), "doc_id", F.posexplode(F.concat(F.array(header), spaced)).alias("i", "line"))
    # Numbers in the order of the documents; gaps do not matter.
    return parts.select("file", (F.col("doc_id") * 1_000_000 + F.col("i") + 1).alias("line_no"), "line")


STREAM = r"""stream AS (
  SELECT source AS file, doc_id * 1000000 + i AS line_no, line
  FROM (
    SELECT source, doc_id, generate_subscripts(p, 1) AS i, unnest(p) AS line
    FROM (SELECT source, doc_id, list_concat(['>' || source || '|' || doc_id || ' ' || lang], flatten(list_transform(string_split(text, chr(10)), lambda x, i: CASE WHEN i % 3 = 0 THEN ['', x] ELSE [x] END))) AS p FROM documents)
  )
),
kinds AS (SELECT *, regexp_replace(line, '^\s+', '') AS text, CASE WHEN regexp_full_match(line, '\s*') THEN 'blank' WHEN regexp_matches(line, '^\s*>') THEN 'header' ELSE 'residue' END AS kind FROM stream),
state AS (
  SELECT *, count(*) FILTER (WHERE kind = 'header') OVER (PARTITION BY file ORDER BY line_no) AS ordinal,
    coalesce(max(CASE WHEN kind = 'header' THEN line_no END) OVER before, 0) AS h, coalesce(max(CASE WHEN kind = 'residue' THEN line_no END) OVER before, 0) AS r, coalesce(max(CASE WHEN kind = 'blank' THEN line_no END) OVER before, 0) AS b
  FROM kinds WINDOW before AS (PARTITION BY file ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
)"""


def q_line_kinds(spark, d):
    return records.classify(doc_lines(spark, d)).groupBy("file", "kind").agg(F.count("*").alias("n"), F.sum(F.length("text")).cast("long").alias("chars"), F.max("line_no").cast("long").alias("last_line"))


def q_residue_counts(spark, d):
    return records.file_summary(records.classify(doc_lines(spark, d)))


def q_record_assembly(spark, d):
    found = records.assemble(records.classify(stream_lines(spark, d), block_lines=50_000_000))
    return found.select("file", "ordinal", F.length("residues").alias("n"), F.md5(F.col("residues").cast("binary")).alias("md5"), "raw_residues", "max_line_len", "n_residue_lines")


def q_line_states(spark, d):
    found = records.classify(stream_lines(spark, d), block_lines=50_000_000)
    return found.select("file", "line_no", "kind", "ordinal", "prev_kind", "blank_before")


def q_structural_checks(spark, d):
    found = records.classify(stream_lines(spark, d), block_lines=50_000_000).withColumns({"protein": F.lit(""), "previous_protein": F.lit("")})
    return checks.line_findings(found, Options(warn_blank_lines_between=True)).groupBy("file", "code", "level").agg(F.count("*").alias("n"), F.min("line_no").alias("first_line"))


def q_header_split(spark, d):
    header = F.concat(F.lit(">"), F.translate("p_name", " ", "\t"), F.lit(" "), F.col("p_brand"))
    return _read(spark, d, "part").select("p_partkey", header.alias("header")).select("p_partkey", t.header_name(F.col("header")).alias("name"), t.header_description(F.col("header")).alias("description"))


def _headers(spark, d):
    docs = _read(spark, d, "documents")
    sep = F.when(F.col("doc_id") % 5 == 0, "\t").when(F.col("doc_id") % 5 == 1, "\xa0").when(F.col("doc_id") % 5 == 2, "�").otherwise(" ")
    name = F.concat("source", F.when(F.col("doc_id") % 3 == 0, "|a|b|c").when(F.col("doc_id") % 3 == 1, "(1),*").otherwise(""))
    text = F.concat(F.lit(">"), name, sep, "text", F.when(F.col("doc_id") % 7 == 0, ' "q" \\/').otherwise(""))
    return docs.select(F.lit("f").alias("file"), F.col("doc_id").alias("line_no"), text.alias("header")).withColumn("name", t.header_name(F.col("header"))).withColumn("description", t.header_description(F.col("header")))


HEADERS = r"""headers AS (
  SELECT doc_id AS line_no, '>' || source || CASE doc_id % 3 WHEN 0 THEN '|a|b|c' WHEN 1 THEN '(1),*' ELSE '' END || CASE doc_id % 5 WHEN 0 THEN chr(9) WHEN 1 THEN chr(160) WHEN 2 THEN chr(65533) ELSE ' ' END || text || CASE WHEN doc_id % 7 = 0 THEN ' "q" \/' ELSE '' END AS header
  FROM documents
),
cut AS (SELECT *, regexp_extract(header, '(?s)^.([^ \t\x{A0}\x{FFFD}]*)', 1) AS name FROM headers),
parts AS (SELECT *, substring(header, length(name) + 3) AS description FROM cut)"""


def _sql_rules(rules, text: str, offset: str, line_from: str) -> str:
    """A row for each broken rule, by the first match."""
    found = []
    for r in rules:
        p = r.pattern.replace("'", "''").replace(r"\xA0", r"\x{A0}").replace(r"\xFFFD", r"\x{FF}FD")
        place = f"length(regexp_extract({text}, '(?s)^(.*?)(?:{p.lstrip('^')})', 1))" if not p.startswith("^") else "0"
        holds = f"regexp_matches({text}, '(?s){p}')"
        if least := re.fullmatch(r"\.\{(\d+),\}", r.pattern):  # so many characters or more: what the pattern says, in a form that is quick on whole texts
            place, holds = "0", f"length({text}) >= {least[1]}"
        extra = f"regexp_extract({text}, '(?s){p}')" if r.show_match else "''"
        found.append(f"SELECT line_no, '{r.level}' AS level, {r.id} AS code, {offset} + {place} + 1 AS col, {extra} AS extra FROM {line_from} WHERE {holds}")
    return " UNION ALL ".join(found)


def q_rule_header(spark, d):
    heads = _headers(spark, d)
    return checks.told(heads, checks.rule_findings(RULES.header, F.col("header"), F.col("header"), 0, t.HEADER_CONTEXT, "header"), F.col("name")).select("line_no", "level", "code", "col", "extra")


def q_rule_name(spark, d):
    return checks.told(_headers(spark, d), checks.rule_findings(RULES.name, F.col("name"), F.col("header"), 1, t.HEADER_CONTEXT, "name"), F.col("name")).select("line_no", "level", "code", "col", "extra")


def q_rule_description(spark, d):
    return checks.told(_headers(spark, d), checks.rule_findings(RULES.description, F.col("description"), F.col("header"), F.length("name") + 1, t.HEADER_CONTEXT, "description", F.col("description") != ""), F.col("name")).select("line_no", "level", "code", "col", "extra")


def _sequence_lines(spark, d):
    return doc_lines(spark, d).where(~t.is_blank(F.col("line"))).select((F.col("file").cast("long") * 1_000_000 + F.col("line_no")).alias("line_no"), F.lit("f").alias("file"), t.left_trimmed(F.col("line")).alias("text"))


def q_rule_sequence(spark, d):
    found = checks.told(_sequence_lines(spark, d), checks.rule_findings(RULES.sequence, F.col("text"), F.col("text"), 0, t.SEQUENCE_CONTEXT, "sequence"), "")
    return found.groupBy("level", "code", "extra").agg(F.count("*").alias("n"), F.sum("col").alias("cols"), F.max("line_no").alias("last_line"))


def q_context_snippet(spark, d):
    place = F.instr("text", " ") + 6
    docs = _read(spark, d, "documents")
    return docs.select("doc_id", t.context(F.col("text"), place, t.HEADER_CONTEXT).alias("wide"), t.context(F.col("text"), F.lit(1), t.SEQUENCE_CONTEXT).alias("narrow"), t.context(F.col("text"), F.length("text") - 1, t.HEADER_CONTEXT).alias("last"))


def q_name_length(spark, d):
    heads = _read(spark, d, "part").select(F.lit("f").alias("file"), F.col("p_partkey").alias("line_no"), F.concat(F.lit(">"), F.translate("p_name", " ", "_"), F.lit(" d")).alias("header"))
    heads = heads.withColumn("name", t.header_name(F.col("header"))).withColumn("description", F.lit("d"))
    return checks.header_findings(heads, Options(min_name_length=20, max_name_length=30)).where("code IN (1, 13)").select("line_no", "level", "code", "col", F.col("extra").cast("long").alias("length"))


def q_findings_capped(spark, d):
    return checks.capped(_findings(spark, d), 5).select("file", "level", "code", "line_no", "col", "extra")


def q_finding_counts(spark, d):
    return checks.finding_counts(_findings(spark, d), 5)


def _findings(spark, d):
    lines = _read(spark, d, "documents").select("doc_id", "lang", F.posexplode(F.split("text", "\r\n|\n|\r")).alias("i", "line"))
    placed = lines.where(~t.is_blank(F.col("line"))).select(F.col("lang").alias("file"), (F.col("doc_id") * 1_000_000 + F.col("i") + 1).alias("line_no"), t.left_trimmed(F.col("line")).alias("text"), F.lit("").alias("protein"))
    return checks.sequence_findings(placed, OPTIONS)


def q_protein_hash(spark, d):
    return doc_records(spark, d).select("ordinal", t.sequence_hash(F.col("residues")).alias("hash"), t.sequence_hash(F.col("residues"), True).alias("hash_il"))


def _hashes(spark, d):
    return hashing.protein_hashes(doc_records(spark, d))


def q_protein_ids(spark, d):
    return _hashes(spark, d).select("file", "Protein_ID", "Protein_Name", "Sequence_Length", "Sequence_Hash")


def q_unique_seqs(spark, d):
    return hashing.unique_sequences(_hashes(spark, d)).select("file", "Sequence_Index", "Protein_Name_First", "Sequence_Length", "Sequence_Hash", "Protein_Count", "Duplicate_Proteins")


def q_seq_dups(spark, d):
    return hashing.duplicate_rows(_hashes(spark, d))


def q_hashfile_unique(spark, d):
    return hashing.unique_from_hash_file(_hashes(spark, d)).select("Sequence_Index", "Protein_Name_First", "Sequence_Length", "Sequence_Hash", "Protein_Count", "Duplicate_Proteins")


def q_name_summary(spark, d):
    table = _hashes(spark, d)
    return hashing.name_summary(table, hashing.keep_list(hashing.unique_from_hash_file(table)))


def q_keep_list(spark, d):
    keep = _read(spark, d, "documents").where("doc_id % 4 = 0").select(F.concat("source", F.lit("|"), F.col("doc_id") % 50).alias("Protein_Name"))
    return dedup.kept_by_list(doc_records(spark, d), keep).select("file", "ordinal", "name")


def q_hash_coverage(spark, d):
    entries = doc_records(spark, d)
    keep = _read(spark, d, "documents").select(F.concat("source", F.lit("|"), F.col("doc_id") % 75).alias("Protein_Name")).distinct()
    return dedup.coverage(keep, entries, entries)


def q_dup_names(spark, d):
    return dedup.duplicate_names(doc_records(spark, d)).select("file", "ordinal", "name", "name_again")


def q_rename_dups(spark, d):
    return dedup.rename_duplicates(doc_records(spark, d)).select("file", "ordinal", "new_name")


def q_keep_same_name(spark, d):
    hashed = doc_records(spark, d).withColumn("Sequence_Hash", t.sequence_hash(F.col("residues")))
    return dedup.same_name_kept(hashed).select("file", "ordinal", "name", "retained")


def q_consolidate(spark, d):
    entries = doc_records(spark, d)
    once = entries.withColumn("name", F.concat("name", F.lit("."), F.col("ordinal")))
    return dedup.consolidate(once.where("residues <> ''"), hashing.protein_hashes(once)).select("file", "ordinal", "name", "description")


def _dna(spark, d):
    return doc_records(spark, d).withColumn("residues", F.when(F.col("ordinal") % 3 == 0, F.regexp_replace("residues", "[^ATCG]", "")).otherwise(F.col("residues")))


def q_dna_class(spark, d):
    return records.nucleic(_dna(spark, d)).select("file", "ordinal", F.round("percent", 6).alias("percent"), "likely_dna")


def q_dna_vote(spark, d):
    entries = _dna(spark, d).withColumn("file", F.when(F.col("ordinal") % 3 == 0, "dna").otherwise(F.col("file")))
    return checks.dna_findings(entries, records.nucleic(entries)).where("line_no = 0").select("file", "level", "code", "extra", "context")


def q_autofix_name(spark, d):
    k = F.col("p_partkey")
    name = F.when(k % 5 == 0, F.concat(F.lit("gi|"), k, F.lit("|pdb|1V0O|B"))).when(k % 5 == 1, F.concat(F.lit("IPI:IPI00"), k, F.lit(".1|REFSEQ_XP:XP_"), k)).when(k % 5 == 2, F.concat(F.lit("#contig"), k, F.lit("%scaffold|chain|A#"))).when(k % 5 == 3, F.concat(F.lit("sp|Q"), k, F.lit(":x;HUMAN"))).otherwise(F.concat(F.lit("longname"), k, F.lit("|second|third|fourth_part")))
    named = _read(spark, d, "part").select("p_partkey", name.alias("name"), F.when(k % 2 == 0, "| about").otherwise("").alias("description"))
    return t.with_repair(named, MIX_OPTIONS, column="f").select("p_partkey", "f.*")


AUTOFIX_SQL = r"""
WITH n AS (
  SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'gi|' || p_partkey || '|pdb|1V0O|B' WHEN 1 THEN 'IPI:IPI00' || p_partkey || '.1|REFSEQ_XP:XP_' || p_partkey WHEN 2 THEN '#contig' || p_partkey || '%scaffold|chain|A#' WHEN 3 THEN 'sp|Q' || p_partkey || ':x;HUMAN' ELSE 'longname' || p_partkey || '|second|third|fourth_part' END AS name0,
    CASE WHEN p_partkey % 2 = 0 THEN '| about' ELSE '' END AS d0 FROM part
),
k AS (
  SELECT *, length(name0) > 24 AS long, CASE WHEN regexp_matches(name0, '^(IPI:IPI[\w.]{2,})\|.+') THEN regexp_extract(name0, '^(IPI:IPI[\w.]{2,})\|', 1) WHEN regexp_matches(name0, '^gi\|\d+\|.+') THEN regexp_extract(name0, '^(gi\|\d+)\|', 1) END AS known FROM n
),
g AS (SELECT *, CASE WHEN known IS NULL AND long AND regexp_matches(name0, '^(\w{2,}[:|][\w\d._]{2,})[:|;](.+)') THEN regexp_extract(name0, '^(\w{2,}[:|][\w\d._]{2,})[:|;](.+)', 1) END AS generic, [i - 1 for i in range(1, length(name0) + 1) if i > 6 and name0[i] = '|'] AS bars FROM k),
c AS (SELECT *, CASE WHEN known IS NULL AND generic IS NULL AND long AND len(bars) > 0 THEN coalesce(list_max([b for b in bars if b <= 24]), list_min(bars)) END AS bar FROM g),
m AS (SELECT *, coalesce(known, generic, substring(name0, 1, bar), name0) AS name1 FROM c),
e AS (SELECT *, name1 <> name0 AS moved, rtrim(substring(name0, length(name1) + 2), '| ') AS extra1 FROM m),
t AS (SELECT *, CASE WHEN NOT moved THEN d0 WHEN d0 = '' THEN extra1 ELSE extra1 || d0 END AS d1, replace(replace(trim(name1, '#%'), '#', '_'), '%', '_') AS tidy FROM e),
s AS (SELECT *, CASE WHEN tidy <> name1 THEN tidy ELSE name1 END AS name2 FROM t),
r AS (SELECT *, CASE WHEN known IS NULL AND regexp_matches(name2, '[:|][^:|;]*[:|;]') THEN regexp_extract(name2, '^([^:|]*[:|][^:|;]*)[:|;].', 1) ELSE '' END AS kept FROM s)
SELECT p_partkey, CASE WHEN kept <> '' THEN kept ELSE name2 END AS name,
  regexp_replace(CASE WHEN kept <> '' THEN CASE WHEN d1 = '' THEN substring(name2, length(kept) + 2) WHEN d1[1] IN ('|', ' ') THEN substring(name2, length(kept) + 2) || d1 ELSE substring(name2, length(kept) + 2) || ' ' || d1 END ELSE d1 END, '^[| ]+', '') AS description,
  moved AND long AS truncated, (moved AND NOT long) OR kept <> '' AS refs_removed, tidy <> name1 AS chars_replaced
FROM r
"""


def q_clean_residues(spark, d):
    return _read(spark, d, "documents").select("doc_id", F.md5(t.clean_residues(F.col("text"), True).cast("binary")).alias("kept"), F.length(t.clean_residues(F.col("text"), False)).alias("trimmed"))


def q_wrap_residues(spark, d):
    width = t.wrap_width(F.length("residues") % 200, 120)
    return doc_records(spark, d).select("ordinal", F.posexplode(t.wrapped(F.col("residues"), width)).alias("i", "line")).groupBy("ordinal").agg(F.count("*").alias("n_lines"), F.max(F.length("line")).alias("longest"), F.max("line").alias("largest"))


def q_build_header(spark, d):
    return _read(spark, d, "supplier").select("s_suppkey", t.build_header(F.when(F.col("s_suppkey") % 3 == 0, "").otherwise(F.col("s_name")), F.when(F.col("s_suppkey") % 2 == 0, " ").otherwise(F.lit("supplier"))).alias("header"))


def q_file_stats(spark, d):
    rows = records.file_summary(records.classify(stream_lines(spark, d), block_lines=50_000_000))
    return rows.select("file", "proteins", "residues")


def q_line_endings(spark, d):
    mixed = F.when(F.col("doc_id") % 4 == 0, F.regexp_replace("text", "\n", "\r\n")).when(F.col("doc_id") % 4 == 1, F.regexp_replace("text", "\n", "\r")).when(F.col("doc_id") % 4 == 2, F.regexp_replace("text", "\n", "\n\r")).otherwise(F.col("text"))
    return _read(spark, d, "documents").select("doc_id", line_terminator(mixed).alias("terminator"))


# Runs over files of entries: a header line and a line of residues for each document, a file for each language.


def entry_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line numbers leave gaps where a document is of another file; these do not matter."""
    rows = doc_records(spark, sf_dir)
    lines = F.array(F.concat(F.lit(">"), "name", F.lit(" d")), F.col("residues"))
    return rows.select("file", F.col("ordinal").alias("doc_id"), F.posexplode(lines).alias("i", "line")).select("file", (F.col("doc_id") * 2 + F.col("i") + 1).alias("line_no"), "line")


def _run(spark, d, **options) -> Validation:
    return Validation(entry_lines(spark, d), Options(**options))


ENTRIES = RECORDS + """, e AS (
  SELECT *, ordinal * 2 + 1 AS line_no, row_number() OVER (PARTITION BY file ORDER BY ordinal) AS place, row_number() OVER (PARTITION BY file, lower(name) ORDER BY ordinal) AS k, upper(sha1(residues)) AS hash,
    coalesce(lead(ordinal * 2 + 1) OVER (PARTITION BY file ORDER BY ordinal), ordinal * 2 + 2) AS next_line, max(ordinal * 2 + 2) OVER (PARTITION BY file) AS last_line FROM records
)"""


def q_end_checks(spark, d):
    return checks.end_findings(records.classify(doc_lines(spark, d))).select("file", "level", "code", "line_no", "col")


def q_duplicate_name_findings(spark, d):
    return _run(spark, d).all_findings.where("code = 12").select("file", "level", "line_no", "col", "protein")


def q_duplicate_sequence_findings(spark, d):
    return _run(spark, d).all_findings.where("code = 18").select("file", "level", "line_no", "col", "protein", "extra", "context")


def q_rename_findings(spark, d):
    return _run(spark, d, fix=True, rename_duplicates=True).all_findings.where("code = 19").select("file", "level", "line_no", "col", "protein", "extra")


def q_consolidation_findings(spark, d):
    return _run(spark, d, fix=True, consolidate=True).all_findings.where("code = 20").select("file", "level", "line_no", "col", "protein", "extra")


def q_retained_findings(spark, d):
    return _run(spark, d, fix=True, keep_same_name=True).all_findings.where("code = 21").select("file", "level", "line_no", "col", "protein")


def q_skipped_names(spark, d):
    return _run(spark, d, fix=True).fixed.select("file", "ordinal", "name", F.length("residues").alias("n"))


def q_fix_counts(spark, d):
    return _run(spark, d, fix=True, invalid_name_chars="|").fix_counts


def q_messages(spark, d):
    return _run(spark, d, max_findings=3).findings.where("code IN (12, 17)").select("file", "line_no", "code", "message")


def q_replacement_mark(spark, d):
    return checks.header_findings(_headers(spark, d), OPTIONS).where("code = 1005").select("line_no", "level", "col", "context")


UNIQUE_SQL = f"""
WITH {RECORDS}, h AS (SELECT *, upper(sha1(residues)) AS hash FROM records WHERE residues <> ''),
u AS (SELECT file, hash, min(ordinal) AS o, arg_min(name, ordinal) AS first, max(length(residues)) AS n, list_sort(list(DISTINCT name)) AS names FROM h GROUP BY file, hash),
r AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY o) AS i, [x for x in names if x <> first] AS others FROM u)
"""
HASHED = f"WITH {RECORDS}, h AS (SELECT *, upper(sha1(residues)) AS hash FROM records WHERE residues <> '')"
FINDINGS_SQL = LINES + r", placed AS (SELECT lang AS file, l.file::BIGINT * 1000000 + line_no AS line_no, regexp_replace(line, '^\s+', '') AS text FROM lines l JOIN documents ON l.file = doc_id::VARCHAR WHERE NOT regexp_full_match(line, '\s*')), broken AS (" + _sql_rules(RULES.sequence, "text", "0", "placed").replace("SELECT line_no", "SELECT file, line_no") + f" UNION ALL SELECT file, line_no, 'Warning', 17, 1, length(text)::VARCHAR FROM placed WHERE length(text) > {OPTIONS.max_residues_per_line})"

QUERIES = {name: f for name, f in list(globals().items()) if name.startswith("q_")}
QUERIES = {"q_residue_counts": QUERIES.pop("q_residue_counts"), **QUERIES}

ORACLE_SQL = {
    "q_residue_counts": f"WITH {KINDS} SELECT file, count(*) FILTER (WHERE kind = 'header') AS proteins, coalesce(sum(length(text)) FILTER (WHERE kind = 'residue'), 0)::BIGINT AS residues, max(line_no) AS lines FROM kinds GROUP BY file",
    "q_line_kinds": f"WITH {KINDS} SELECT file, kind, count(*) AS n, sum(length(text))::BIGINT AS chars, max(line_no) AS last_line FROM kinds GROUP BY file, kind",
    "q_record_assembly": f"WITH {STREAM}, e AS (SELECT file, ordinal, rtrim(string_agg(trim(text), '' ORDER BY line_no), '*') AS residues, sum(length(text))::BIGINT AS raw_residues, max(length(trim(text))) AS max_line_len, count(*) AS n_residue_lines FROM state WHERE kind = 'residue' GROUP BY file, ordinal) SELECT file, ordinal, length(residues) AS n, md5(residues) AS md5, raw_residues, max_line_len, n_residue_lines FROM e",
    "q_line_states": f"WITH {STREAM} SELECT file, line_no, kind, ordinal, CASE WHEN h > r THEN 'header' WHEN r > h THEN 'residue' END AS prev_kind, b > r AS blank_before FROM state",
    "q_structural_checks": f"""WITH {STREAM}, f AS (
SELECT file, line_no, 15 AS code, 'Warning' AS level FROM state WHERE kind = 'header' AND b > r
UNION ALL SELECT file, line_no, 6, 'Error' FROM state WHERE kind = 'residue' AND h > r AND b > r
UNION ALL SELECT file, line_no, 7, 'Error' FROM state WHERE kind = 'residue' AND r > h AND b > r
UNION ALL SELECT file, line_no, 8, 'Error' FROM state WHERE kind = 'residue' AND h = 0 AND r = 0
UNION ALL SELECT file, line_no, 2, 'Error' FROM state WHERE kind IN ('header', 'residue') AND line[1] IN (' ', chr(9), chr(160))
UNION ALL SELECT file, line_no, 17, 'Warning' FROM state WHERE length(line) > 100000 AND length(line) <= 10000000)
SELECT file, code, level, count(*) AS n, min(line_no) AS first_line FROM f GROUP BY file, code, level""",
    "q_header_split": r"WITH h AS (SELECT p_partkey, replace(p_name, ' ', chr(9)) || ' ' || p_brand AS x FROM part), n AS (SELECT *, regexp_extract(x, '^[^ \t]*') AS name FROM h) SELECT p_partkey, name, CASE WHEN name = '' THEN '' ELSE substring(x, length(name) + 2) END AS description FROM n",
    "q_rule_header": f"WITH {HEADERS} " + _sql_rules(RULES.header, "header", "0", "parts"),
    "q_rule_name": f"WITH {HEADERS} " + _sql_rules(RULES.name, "name", "1", "parts"),
    "q_rule_description": f"WITH {HEADERS} " + _sql_rules(RULES.description, "description", "length(name) + 1", "parts"),
    "q_rule_sequence": rf"WITH {LINES}, placed AS (SELECT file::BIGINT * 1000000 + line_no AS line_no, regexp_replace(line, '^\s+', '') AS text FROM lines WHERE NOT regexp_full_match(line, '\s*')), broken AS (" + _sql_rules(RULES.sequence, "text", "0", "placed") + ") SELECT level, code, extra, count(*) AS n, sum(col)::BIGINT AS cols, max(line_no) AS last_line FROM broken GROUP BY level, code, extra",
    "q_context_snippet": "SELECT doc_id, " + ", ".join(f"CASE WHEN length(text) <= 1 THEN text ELSE substring(text, greatest({i} - {h}, 0) + 1, least(greatest({i} + {h}, greatest({i} - {h}, 0) + {2 * h}), length(text) - 1) - greatest({i} - {h}, 0) + 1) END AS {n}" for n, i, h in (("wide", "(instr(text, ' ') + 6)", 6), ("narrow", "1", 2), ("last", "(length(text) - 1)", 6))) + " FROM documents",
    "q_name_length": "WITH n AS (SELECT p_partkey AS line_no, length(p_name) AS n FROM part) SELECT line_no, 'Warning' AS level, 13 AS code, 2 AS col, n AS length FROM n WHERE n < 20 UNION ALL SELECT line_no, 'Error', 1, 2, n FROM n WHERE n > 30",
    "q_findings_capped": f"WITH {FINDINGS_SQL}, ranked AS (SELECT *, row_number() OVER (PARTITION BY file, level, code ORDER BY line_no, col, extra) AS k FROM broken) SELECT file, level, code, line_no, col, extra FROM ranked WHERE k <= 5",
    "q_finding_counts": f"WITH {FINDINGS_SQL} SELECT file, level, code, least(count(*), 5) AS n_specified, greatest(count(*) - 5, 0) AS n_unspecified FROM broken GROUP BY file, level, code",
    "q_protein_hash": f"WITH {RECORDS} SELECT ordinal, CASE WHEN residues = '' THEN '' ELSE upper(sha1(residues)) END AS hash, CASE WHEN residues = '' THEN '' ELSE upper(sha1(replace(residues, 'L', 'I'))) END AS hash_il FROM records",
    "q_protein_ids": f"{HASHED} SELECT file, row_number() OVER (PARTITION BY file ORDER BY ordinal) AS Protein_ID, name AS Protein_Name, length(residues) AS Sequence_Length, hash AS Sequence_Hash FROM h",
    "q_unique_seqs": f"{UNIQUE_SQL} SELECT file, i AS Sequence_Index, first AS Protein_Name_First, n AS Sequence_Length, hash AS Sequence_Hash, len(others) + 1 AS Protein_Count, coalesce(array_to_string(others, ','), '') AS Duplicate_Proteins FROM r",
    "q_seq_dups": f"{UNIQUE_SQL} SELECT file, i AS Sequence_Index, first AS Protein_Name_First, n AS Sequence_Length, unnest(others) AS Duplicate_Protein FROM r",
    "q_hashfile_unique": f"{HASHED}, u AS (SELECT hash, list_sort(list(DISTINCT name)) AS names, min(length(residues)) AS n FROM h GROUP BY hash) SELECT row_number() OVER (ORDER BY hash) AS Sequence_Index, names[1] AS Protein_Name_First, n AS Sequence_Length, hash AS Sequence_Hash, len(names) AS Protein_Count, coalesce(array_to_string(names[2:], ','), '') AS Duplicate_Proteins FROM u",
    "q_name_summary": f"{HASHED}, keep AS (SELECT DISTINCT k FROM (SELECT min(name) AS k FROM h GROUP BY hash)) SELECT name AS Protein_Name, hash AS Sequence_Hash, CASE WHEN name IN (SELECT k FROM keep) THEN '1' ELSE '0' END AS First_Protein_For_Hash, CASE WHEN row_number() OVER (PARTITION BY name ORDER BY hash) > 1 THEN '1' ELSE '0' END AS Duplicate_Name FROM h",
    "q_keep_list": f"WITH {RECORDS} SELECT file, ordinal, name FROM records WHERE name IN (SELECT source || '|' || (doc_id % 50) FROM documents WHERE doc_id % 4 = 0) QUALIFY row_number() OVER (PARTITION BY file, name ORDER BY ordinal) = 1",
    "q_hash_coverage": f"WITH {RECORDS}, k AS (SELECT DISTINCT source || '|' || (doc_id % 75) AS name FROM documents), n AS (SELECT name, count(*) AS n FROM records GROUP BY name) SELECT count(*) AS wanted, count(n) AS written, count(*) FILTER (WHERE n IS NULL) AS not_found, count(*) FILTER (WHERE n > 1) AS duplicated FROM k LEFT JOIN n ON k.name = n.name",
    "q_dup_names": f"WITH {RECORDS} SELECT file, ordinal, name, row_number() OVER (PARTITION BY file, lower(name) ORDER BY ordinal) > 1 AS name_again FROM records",
    "q_rename_dups": f"WITH {RECORDS}, k AS (SELECT *, row_number() OVER (PARTITION BY file, lower(name) ORDER BY ordinal) AS k FROM records) SELECT file, ordinal, CASE WHEN k = 1 THEN name WHEN k <= 26 THEN name || '-' || chr((96 + k)::INT) ELSE name || '-' || chr((97 + (k - 27) % 26)::INT) || ((k - 27) // 26 + 1) END AS new_name FROM k",
    "q_keep_same_name": f"WITH {RECORDS}, k AS (SELECT *, CASE WHEN residues = '' THEN '' ELSE upper(sha1(residues)) END AS hash FROM records), f AS (SELECT *, first_value(hash) OVER w AS f, row_number() OVER w AS k FROM k WINDOW w AS (PARTITION BY file, lower(name) ORDER BY ordinal)) SELECT file, ordinal, name, k > 1 AND hash <> f AS retained FROM f WHERE k = 1 OR hash <> f",
    "q_consolidate": f"WITH {RECORDS}, h AS (SELECT file, ordinal, name || '.' || ordinal AS name, description, upper(sha1(residues)) AS hash FROM records WHERE residues <> ''), g AS (SELECT file, hash, min(ordinal) AS o, arg_min(name, ordinal) AS first, list_sort(list(name)) AS names FROM h GROUP BY file, hash), x AS (SELECT h.file, o AS ordinal, first AS name, description, array_to_string([n for n in names if n <> first], ',') AS others, len(names) AS k FROM g JOIN h ON g.file = h.file AND g.o = h.ordinal), y AS (SELECT *, description || '; Duplicate proteins: ' || others AS d FROM x) SELECT file, ordinal, name, CASE WHEN k = 1 THEN description WHEN length(d) > 7995 THEN substring(d, 1, 7992) || '...' ELSE d END AS description FROM y",
    "q_dna_class": f"WITH {RECORDS}, s AS (SELECT file, ordinal, CASE WHEN ordinal % 3 = 0 THEN regexp_replace(residues, '[^ATCG]', '', 'g') ELSE residues END AS r FROM records), p AS (SELECT *, length(regexp_replace(r, '[^ATCG]', '', 'g')) AS d FROM s WHERE r <> '') SELECT file, ordinal, round(d * 100.0::DOUBLE / length(r), 6) AS percent, d = length(r) AS likely_dna FROM p",
    "q_dna_vote": f"WITH {RECORDS}, s AS (SELECT CASE WHEN ordinal % 3 = 0 THEN 'dna' ELSE file END AS file, CASE WHEN ordinal % 3 = 0 THEN regexp_replace(residues, '[^ATCG]', '', 'g') ELSE residues END AS r FROM records), v AS (SELECT file, count(*) AS total, count(*) FILTER (WHERE length(regexp_replace(r, '[^ATCG]', '', 'g')) * 100.0 / length(r) > 95) AS dna FROM s WHERE r <> '' GROUP BY file) SELECT file, 'Error' AS level, 22 AS code, CASE WHEN total = dna THEN 'The FASTA file has nucleic acids (DNA)' ELSE 'The majority of the FASTA file entries are nucleic acids (DNA)' END AS extra, CASE WHEN total = dna AND dna = 1 THEN 'The sequence is DNA' WHEN total = dna THEN 'The ' || dna || ' sequences are DNA' ELSE dna || ' / ' || total || ' sequences are DNA' END || ' (residues are A, T, C, or G)' AS context FROM v WHERE dna > 0 AND total - dna < dna",
    "q_autofix_name": AUTOFIX_SQL,
    "q_clean_residues": r"SELECT doc_id, md5(regexp_replace(text, '[^A-Z(*)(-)]', '', 'g')) AS kept, length(regexp_replace(regexp_replace(text, '^\s+', ''), '\s+$', '')) AS trimmed FROM documents",
    "q_wrap_residues": f"WITH {RECORDS}, w AS (SELECT ordinal, residues, greatest(CASE WHEN length(residues) % 200 <= 0 OR length(residues) % 200 > 120 THEN 120 ELSE length(residues) % 200 END, 10) AS w FROM records WHERE residues <> ''), l AS (SELECT ordinal, unnest([substring(residues, i, w) for i in range(1, length(residues) + 1, w)]) AS line FROM w) SELECT ordinal, count(*) AS n_lines, max(length(line)) AS longest, max(line) AS largest FROM l GROUP BY ordinal",
    "q_build_header": "SELECT s_suppkey, '>' || CASE WHEN s_suppkey % 3 = 0 THEN '????' ELSE s_name END || CASE WHEN s_suppkey % 2 = 0 THEN '' ELSE ' supplier' END AS header FROM supplier",
    "q_file_stats": f"WITH {STREAM} SELECT file, count(*) FILTER (WHERE kind = 'header') AS proteins, coalesce(sum(length(text)) FILTER (WHERE kind = 'residue'), 0)::BIGINT AS residues FROM state GROUP BY file",
    "q_end_checks": f"WITH {KINDS}, f AS (SELECT file, max(line_no) AS line_no, count(*) FILTER (WHERE kind = 'header') AS heads, arg_max(kind, line_no) FILTER (WHERE kind <> 'blank') AS last FROM kinds GROUP BY file) SELECT file, 'Error' AS level, CASE WHEN heads = 0 THEN 9 ELSE 10 END AS code, line_no, 1 AS col FROM f WHERE heads = 0 OR last = 'header'",
    "q_duplicate_name_findings": f"WITH {ENTRIES} SELECT file, 'Error' AS level, line_no, 2 AS col, name AS protein FROM e WHERE k > 1",
    "q_duplicate_sequence_findings": f"WITH {ENTRIES}, g AS (SELECT file, hash, arg_min(name, ordinal) AS protein, list_sort(list(name)) AS names, any_value(last_line) AS line_no, any_value(substring(residues, 1, 20)) AS context FROM e WHERE k = 1 AND residues <> '' GROUP BY file, hash HAVING count(*) > 1) SELECT file, 'Warning' AS level, line_no, 1 AS col, protein, array_to_string(list_concat([protein], [n for n in names if n <> protein]), ', ') AS extra, context FROM g",
    "q_rename_findings": f"WITH {ENTRIES} SELECT file, 'Warning' AS level, line_no, 2 AS col, name AS protein, '--> ' || name || CASE WHEN k <= 26 THEN '-' || chr((96 + k)::INT) ELSE '-' || chr((97 + (k - 27) % 26)::INT) || ((k - 27) // 26 + 1) END AS extra FROM e WHERE k > 1",
    "q_consolidation_findings": f"WITH {ENTRIES}, v AS (SELECT *, min(ordinal) OVER (PARTITION BY file, hash) AS first, first_value(name) OVER (PARTITION BY file, hash ORDER BY ordinal) AS same FROM e WHERE k = 1) SELECT file, 'Warning' AS level, next_line AS line_no, 0 AS col, name AS protein, CASE WHEN residues = '' THEN 'same as ??' ELSE 'same as ' || same END AS extra FROM v WHERE residues = '' OR ordinal <> first",
    "q_retained_findings": f"WITH {ENTRIES}, f AS (SELECT *, first_value(CASE WHEN residues = '' THEN '' ELSE hash END) OVER (PARTITION BY file, lower(name) ORDER BY ordinal) AS f FROM e) SELECT file, 'Warning' AS level, next_line AS line_no, 1 AS col, name AS protein FROM f WHERE k > 1 AND CASE WHEN residues = '' THEN '' ELSE hash END <> f",
    "q_skipped_names": f"WITH {ENTRIES} SELECT file, place AS ordinal, name, length(residues) AS n FROM e WHERE k = 1",
    "q_fix_counts": f"WITH {ENTRIES} SELECT file, 0 AS truncated_names, 0 AS refs_removed, count(*) AS chars_replaced, 0 AS duplicates_renamed, count(*) FILTER (WHERE k > 1) AS duplicates_skipped, 0 AS updated_residue_lines, 0 AS duplicate_sequences_skipped FROM e GROUP BY file",
    "q_messages": f"WITH {ENTRIES}, f AS (SELECT file, line_no, 12 AS code, 'Duplicate protein name found' AS message FROM e WHERE k > 1 UNION ALL SELECT file, line_no + 1, 17, 'Residues line is longer than the suggested maximum length of 120 characters (' || length(residues) || ')' FROM e WHERE length(residues) > 120) SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY file, code ORDER BY line_no) <= 3",
    "q_replacement_mark": f"WITH {HEADERS} SELECT line_no, 'Warning' AS level, length(name) + 2 AS col, substring(header, greatest(length(name) + 1 - 6, 0) + 1, 13) AS context FROM parts WHERE line_no % 5 = 2",
    "q_line_endings": "SELECT doc_id, CASE WHEN instr(text, chr(10)) = 0 OR instr(text, chr(10)) > 100000 THEN 'CRLF' ELSE CASE doc_id % 4 WHEN 0 THEN 'CRLF' WHEN 1 THEN 'CR' WHEN 2 THEN 'LFCR' ELSE 'LF' END END AS terminator FROM documents",
}
