"""Conversations as a trie of their turns: which beginnings they share, and what sharing them saves."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.hashing import indexed
from .common import stored
from ..operators.streams import in_order, joined_digests
from .turn_repair import CRC32_SQL

#: Digest of the node without turns.
ROOT = hashlib.sha256(b"").digest()
#: A rebuilt conversation takes fewer than so many turns from the first of its hundred.
MOST_GIVEN = 6


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, place, role, text): places 1, 2, ... by turn, null turns first, then by role and text; null role and text are empty.

    Rows without conv_id belong to no conversation and are left out.
    """
    some = conversations.where("conv_id IS NOT NULL").select("conv_id", "turn", *(F.coalesce(c, F.lit("")).alias(c) for c in ("role", "text")))
    return stored(indexed(some, "place", "turn", "role", "text", by="conv_id").drop("turn"), "ordered-turns")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations (conv_id, n_turns) and turns (conv_id, place, role, text) with shared beginnings.

    The first h turns of conversation c become those of c - c % 100 (all if it has fewer,
    none if it is absent); h is the CRC-32 of c in decimal, modulo 6.
    """
    sizes = turns.groupBy("conv_id").agg(F.count("*").alias("n"))
    h = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(MOST_GIVEN))
    known = sizes.select("conv_id", "n", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % 100).alias("base"))
    firsts = sizes.select(F.col("conv_id").alias("base"), F.col("n").alias("n_base"))
    convs = stored(known.join(firsts, "base", "left").withColumn("given", F.least("h", F.coalesce("n_base", F.lit(0)))), "rebuilt-conversations")
    own = turns.join(convs.select("conv_id", "h", "given"), "conv_id").where("place > h").select("conv_id", (F.col("place") - F.col("h") + F.col("given")).alias("place"), "role", "text")
    begin = turns.where(F.col("place") < MOST_GIVEN).select(F.col("conv_id").alias("base"), "place", "role", "text")
    given = begin.join(convs.select("conv_id", "base", "h"), "base").where("place <= h").select("conv_id", "place", "role", "text")
    return convs.select("conv_id", (F.col("given") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("n_turns")), own.unionByName(given)


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of beginnings: each of the one before and the turn's own digest."""
    conv, digest, depth = None, ROOT, 0
    for batch in batches:
        ids, places, own = (batch.column(i).to_pylist() for i in (1, 2, 3))
        digests, parents = [], []
        for c, place, turn in zip(ids, places, own, strict=True):
            if c != conv:
                conv, digest, depth = c, ROOT, 0
            depth += 1
            if place != depth:
                raise ValueError(f"turn {place} of conversation {c} out of order")
            parents.append(digest)
            digest = hashlib.sha256(digest + turn).digest()
            digests.append(digest)
        yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(digests, pa.binary()), pa.array(parents, pa.binary()), batch.column(4), batch.column(5)], names=["conv_id", "depth", "digest", "parent", "chars", "is_end"])


def prefixes(convs: DataFrame, turns: DataFrame) -> DataFrame:
    """(conv_id, depth, digest, parent, chars, is_end): every beginning of every conversation, the empty one too.

    digest: SHA-256 of the digest of the beginning before it and that of the turn, so it
    stands for the whole sequence of roles and texts. chars: code points of the last text.
    """
    own = F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"), 256))
    told = turns.select("conv_id", "place", own.alias("turn"), F.length("text").cast("long").alias("chars")).join(convs, "conv_id")
    rows = told.select("conv_id", "place", "turn", "chars", (F.col("place") == F.col("n_turns")).alias("is_end"))
    chained = in_order(rows, ["conv_id"], ["place"], _chained, "conv_id long, depth long, digest binary, parent binary, chars long, is_end boolean")
    root = convs.select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit(ROOT).alias("digest"), F.lit(None).cast("binary").alias("parent"), F.lit(0).cast("long").alias("chars"), (F.col("n_turns") == 0).alias("is_end"))
    return chained.unionByName(root)


def _below(nodes: DataFrame, sums: list[str]) -> DataFrame:
    """``nodes`` (conv_id, depth, ...) with ``sums`` added up from each node to the end of its conversation's own nodes.

    Nodes are put in ranges of (conv_id, depth), so a conversation of any length is added
    up in several tasks; what the later ranges hold is one row for each.
    """
    ranged = stored(nodes.repartitionByRange("conv_id", "depth").withColumn("_range", F.spark_partition_id()), "trie-ranges")
    own = Window.partitionBy("conv_id", "_range").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    after = Window.partitionBy("conv_id").orderBy(F.desc("_range")).rowsBetween(Window.unboundedPreceding, -1)
    rest = ranged.groupBy("conv_id", "_range").agg(*(F.sum(c).alias(c) for c in sums)).select("conv_id", "_range", *(F.coalesce(F.sum(c).over(after), F.lit(0)).alias(f"_{c}") for c in sums))
    summed = ranged.withColumns({c: F.sum(c).over(own) for c in sums})
    return summed.join(rest, ["conv_id", "_range"]).withColumns({c: F.col(c) + F.col(f"_{c}") for c in sums}).drop("_range", *(f"_{c}" for c in sums))


def trie(conversations: DataFrame, rebuild: bool = False) -> DataFrame:
    """(conv_id, depth, digest, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of each node.

    A node is a sequence of turns (role and text) that one conversation or more begin
    with; conv_id is the smallest of these. Sums over the nodes below a node: each node
    belongs to its conv_id, whose nodes hang together in one line. Sums along a line
    come from ranges; then each line's total is exploded to all ancestors of its first
    node, which are beginnings of that conversation, so no more rows come of it than
    there are beginnings.

    rebuild: give conversations shared beginnings first, see ``rebuilt``. Nulls: see
    ``ordered_turns``. Empty texts are turns like others; repeated rows are turns of their
    own. Texts of any length count by their digest. A conversation or a node may have any
    number of turns or members: both pass as streams or as sums made before the shuffle.
    No conversations give no nodes. Other columns are left out, whatever their names.
    """
    turns = ordered_turns(conversations)
    convs, turns = rebuilt(turns) if rebuild else (turns.groupBy("conv_id").agg(F.count("*").alias("n_turns")), turns)
    begun = stored(prefixes(convs, turns), "prefixes")
    own = begun.groupBy("depth", "digest").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.max("chars").alias("chars"), F.max("parent").alias("parent"))
    found = stored(own, "trie-nodes")
    below = found.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("parent").alias("digest")).agg(F.count("*").alias("n_children"))
    above = found.select((F.col("depth") + 1).alias("depth"), F.col("digest").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    nodes = found.join(below, ["depth", "digest"], "left").fillna(0, ["n_children"]).join(above, ["depth", "parent"], "left")
    weighed = nodes.withColumns({"n_leaves": (F.col("n_children") == 0).cast("long"), "saved_tokens": (F.col("n_convs") - 1) * F.col("chars")}).drop("chars", "parent")
    lines = stored(_below(weighed, ["n_leaves", "saved_tokens"]), "trie-lines")
    first = lines.groupBy("conv_id").agg(F.max(F.struct(-F.col("depth"), "n_leaves", "saved_tokens")).alias("top"))  # the first node has the line's total
    totals = first.select("conv_id", (-F.col("top.col1")).alias("top"), F.col("top.n_leaves").alias("_leaves"), F.col("top.saved_tokens").alias("_saved"))
    hung = begun.join(totals, "conv_id").where("depth < top").groupBy("depth", "digest").agg(F.sum("_leaves").alias("_leaves"), F.sum("_saved").alias("_saved"))
    ends = joined_digests(begun.where("is_end"), ["depth", "digest"], "conv_id", F.col("conv_id").cast("string"), b",")
    whole = lines.join(hung, ["depth", "digest"], "left").fillna(0, ["_leaves", "_saved"]).join(ends, ["depth", "digest"], "left")
    none = F.sha2(F.lit("").cast("binary"), 256)
    return whole.select("conv_id", "depth", "digest", "parent_conv_id", "n_convs", "n_children", (F.col("n_leaves") + F.col("_leaves")).alias("n_leaves"), (F.col("saved_tokens") + F.col("_saved")).alias("saved_tokens"), F.coalesce("sha256", none).alias("ends_sha256"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract of op13: the nodes of the trie of all rebuilt conversations.

    Runs jobs while it is built: it stores the ordered turns, the beginnings and the nodes.
    """
    return trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"), rebuild=True).drop("digest")


ORACLE_SQL = (
    """
WITH placed AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS place
  FROM conversations WHERE conv_id IS NOT NULL
),
sizes AS (SELECT conv_id, conv_id::VARCHAR AS s, count(*) AS n FROM placed GROUP BY conv_id),
hashed AS (SELECT conv_id, n, conv_id - conv_id % 100 AS base, """
    + CRC32_SQL
    + """ % 6 AS h FROM sizes),
convs AS (SELECT c.*, least(c.h, coalesce(b.n, 0)) AS given FROM hashed c LEFT JOIN sizes b ON b.conv_id = c.base),
turns AS (
  SELECT conv_id, place - h + given AS place, role, text FROM placed JOIN convs USING (conv_id) WHERE place > h
  UNION ALL
  SELECT c.conv_id, p.place, p.role, p.text FROM convs c JOIN placed p ON p.conv_id = c.base WHERE p.place <= c.h
),
sequences AS (SELECT conv_id, coalesce(list({'role': role, 'text': text} ORDER BY place) FILTER (WHERE place IS NOT NULL), []) AS l FROM convs LEFT JOIN turns USING (conv_id) GROUP BY conv_id),
each AS (SELECT conv_id, l, unnest(range(0, len(l) + 1)) AS depth FROM sequences),
begun AS (
  SELECT conv_id, depth, md5(to_json(l[1:depth])::VARCHAR) AS key, CASE WHEN depth > 0 THEN md5(to_json(l[1:depth - 1])::VARCHAR) END AS parent, CASE WHEN depth > 0 THEN length(l[depth].text) ELSE 0 END AS chars, depth = len(l) AS is_end
  FROM each
),
nodes AS (
  SELECT depth, key, any_value(parent) AS parent, min(conv_id) AS conv_id, count(*) AS n_convs, max(chars) * (count(*) - 1) AS saved, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE is_end), '')) AS ends_sha256
  FROM begun GROUP BY depth, key
),
children AS (SELECT depth - 1 AS depth, parent AS key, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY ALL),
sums AS (
  SELECT b.depth, b.key, count(*) FILTER (WHERE c.n IS NULL) AS n_leaves, sum(n.saved) AS saved
  FROM nodes n LEFT JOIN children c ON c.depth = n.depth AND c.key = n.key JOIN begun b ON b.conv_id = n.conv_id AND b.depth <= n.depth GROUP BY b.depth, b.key
)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(c.n, 0) AS n_children, s.n_leaves, s.saved::BIGINT AS saved_tokens, n.ends_sha256
FROM nodes n LEFT JOIN nodes p ON p.depth = n.depth - 1 AND p.key = n.parent LEFT JOIN children c ON c.depth = n.depth AND c.key = n.key JOIN sums s ON s.depth = n.depth AND s.key = n.key
"""
)
