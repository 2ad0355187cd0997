"""Conversations with faulty turns: what is wrong with each, and the cheapest edits that mend it."""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.hashing import indexed
from .common import stored
from ..operators.streams import joined_digests

#: What each edit costs; a truncated turn that is not deleted costs TRUNCATED more.
DELETE, INSERT, KEEP, REROLE, TRUNCATED = 2, 5, 0, 1, 5
#: Turns whose codes are put together at first.
BLOCK = 4096
SPACES = " \t\n\x0b\x0c\r"

#: The grammar of role initials, (s?(ua)+)?: the state after each initial, where it may stand.
#: 0: nothing yet, 1: after s, 2: after u, 3: after a. A conversation may end in 0 and 3.
NEXT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
#: The state that the role which may be inserted, or given to a turn, leads to: user, or assistant in 2.
GIVEN = (2, 2, 3, 2)
LEGAL = ("su", "ua", "au")
#: Codes of turns, by initial (s, u, a, any other): sound, truncated, to be deleted.
SOUND, CUT, GONE = "sua-", "SUA_", "1230"


def damaged(conversations: DataFrame) -> DataFrame:
    """(c, turn, role, text): the rows with one in four damaged, by the CRC-32 of ``conv_id:turn`` modulo 20.

    0 drops the row, 1 empties its text, 2 takes out its ``.``, ``!`` and ``?``, 3 repeats it
    in the same turn, 4 makes its role user. c is the conversation's id as text. Nulls are
    one space in c, role and text, and in the damage's key; a null turn stays null.
    """
    c = F.coalesce(F.col("conv_id").cast("string"), F.lit(" "))
    key = F.concat(c, F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    kind = F.pmod(F.crc32(key.cast("binary")), F.lit(20))
    rows = conversations.select(c.alias("c"), "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), kind.alias("kind")).where("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    times = F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("c", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(times).alias("_time")).drop("_time")


def with_faults(rows: DataFrame) -> DataFrame:
    """``rows`` (c, turn, role, text) with place, fault and initial.

    place: 1, 2, ... in a conversation, by turn, null turns first, then by role and text.
    fault: blank, duplicate (the role and text were there before), truncated (the last
    character that is no white space is not ``.``, ``!`` or ``?``), or null; the first that
    holds. initial: s, u or a, - for any other role, an empty one too.
    """
    placed = stored(indexed(rows, "place", "turn", "role", "text", by="c"), "placed-turns")
    keyed = placed.withColumns({"k1": F.xxhash64("role", "text"), "k2": F.xxhash64(F.lit(1), "text", "role")})
    firsts = keyed.groupBy("c", "k1", "k2").agg(F.min("place").alias("first"))
    solid = F.rtrim("text", F.lit(SPACES))
    fault = F.when(solid == "", "blank").when(F.col("place") > F.col("first"), "duplicate").when(~F.right(solid, F.lit(1)).isin(".", "!", "?"), "truncated")
    first = F.left("role", F.lit(1))
    return keyed.join(firsts, ["c", "k1", "k2"]).select("c", "turn", "role", "text", "place", fault.alias("fault"), F.when(first.isin("s", "u", "a"), first).otherwise("-").alias("initial"))


def _code() -> Column:
    """One letter for what the edits of a turn depend on."""
    fault = F.col("fault")
    spelled = lambda letters: F.translate("initial", SOUND, letters)
    return F.when(fault.isin("blank", "duplicate"), spelled(GONE)).when(fault == "truncated", spelled(CUT)).otherwise(F.col("initial"))


def _moves() -> dict[str, list[list[tuple[str, int, int]]]]:
    """For each code and state: (edit as the audit has it, cost, next state), the ASCII-least edit first."""
    found = {}
    for codes, more in ((SOUND, 0), (CUT, TRUNCATED), (GONE, None)):
        for initial, code in zip(SOUND, codes, strict=True):
            found[code] = [[("D", DELETE, state)] for state in range(4)]
            for state, moves in enumerate(found[code]):
                if more is not None and initial in NEXT[state]:
                    moves.append(("K", KEEP + more, NEXT[state][initial]))
                if more is not None:
                    moves.append(("R", REROLE + more, GIVEN[state]))
    return found


MOVES = _moves()
#: Cost to the end from each state when no turn is left.
AT_END = (0, 2 * INSERT, INSERT, 0)
#: How edits are told to those who rebuild the turns: a role given, a turn inserted, of user or assistant.
TOLD = {("R", 2): "r", ("R", 3): "t", ("I", 2): "i", ("I", 3): "j"}


def cheapest_edits(codes: str) -> tuple[int, str]:
    """(cost, edits) of a conversation whose turns have these codes.

    Backwards over the turns, the cost to go from each state of the grammar; then
    forwards, always the ASCII-least edit that keeps to the cost. Edits are spelled D, K,
    r or t (role user or assistant given), i or j (user or assistant inserted before).
    """
    to_go = array("q", AT_END)  # four a turn, from the last turn on
    later = AT_END
    for code in reversed(codes):
        b0, b1, b2, b3 = (min(cost + later[state] for _, cost, state in moves) for moves in MOVES[code])
        t2, t3 = min(b2, INSERT + b3), min(b3, INSERT + b2)
        later = (min(b0, INSERT + t2), min(b1, INSERT + t2), t2, t3)
        to_go.extend(later)
    cost, state, i, n, edits = later[0], 0, 0, len(codes), []
    while i < n or state not in (0, 3):
        base = 4 * (n - i)
        left = to_go[base + state]
        best = None
        if i < n:
            for edit, price, after in MOVES[codes[i]][state]:
                if price + to_go[base - 4 + after] == left:
                    best = (edit, after)
                    break
        if (best is None or best[0] > "I") and INSERT + to_go[base + GIVEN[state]] == left:
            best = ("I", GIVEN[state])
        edit, state = best
        i += edit != "I"
        edits.append(TOLD.get((edit, state), edit))
    return cost, "".join(edits)


_EDITED = T.StructType().add("cost", "long").add("illegal", "long").add("edits", "string")
_EDITED_ARROW = pa.struct([("cost", pa.int64()), ("illegal", pa.int64()), ("edits", pa.string())])


@F.arrow_udf(_EDITED)
def _edited(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
    initial = str.maketrans(CUT + GONE, SOUND + SOUND)
    for blocks in columns:
        rows = []
        for parts in blocks.to_pylist():
            codes = "".join(p["codes"] for p in parts)
            plain = codes.translate(initial)
            cost, edits = cheapest_edits(codes)
            rows.append({"cost": cost, "illegal": sum(plain[i : i + 2] not in LEGAL for i in range(len(plain) - 1)), "edits": edits})
        yield pa.array(rows, _EDITED_ARROW)


def edits_of(faulty: DataFrame) -> DataFrame:
    """(c, cost, illegal, edits) of each conversation of ``with_faults``.

    A conversation is a text of one letter a turn here, as the audit is in the result;
    its texts are not gathered.
    """
    block = F.floor((F.col("place") - 1) / BLOCK)
    letters = lambda listed: F.array_join(F.transform(F.array_sort(listed), lambda x: x["code"]), "")
    blocks = faulty.groupBy("c", block.alias("block")).agg(letters(F.collect_list(F.struct("place", _code().alias("code")))).alias("codes"))
    whole = blocks.groupBy("c").agg(F.array_sort(F.collect_list(F.struct("block", "codes"))).alias("blocks"))
    return whole.select("c", _edited("blocks").alias("e")).select("c", "e.cost", "e.illegal", "e.edits")


def repaired(faulty: DataFrame, edits: DataFrame) -> DataFrame:
    """(c, place, lines): the turns after the edits as ``role:text`` lines, those inserted before a turn in front of it."""
    steps = edits.select("c", F.posexplode(F.regexp_extract_all("edits", F.lit("[ij]*[DKrt]|[ij]+$"), F.lit(0))).alias("i", "step"))
    joined = steps.select("c", (F.col("i") + 1).cast("long").alias("place"), "step").join(faulty.select("c", "place", "role", "text"), ["c", "place"], "left")
    added = F.regexp_extract_all("step", F.lit("[ij]"), F.lit(0))
    told = F.transform(added, lambda x: F.when(x == "i", "user:").otherwise("assistant:"))
    last = F.right("step", F.lit(1))
    role = F.when(last == "K", F.col("role")).when(last == "r", "user").when(last == "t", "assistant")
    own = F.array_compact(F.array(F.when(role.isNotNull(), F.concat(role, F.lit(":"), "text"))))
    lines = F.concat(told, own)
    return joined.select("c", "place", lines.alias("lines")).where(F.size("lines") > 0)


def repair(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Faults, edits and repaired turns of conversations (c, turn, role, text): see ``with_faults``, ``edits_of``, ``repaired``.

    Nulls: c, role and text must not be null (``damaged`` makes them one space); null
    turns come first and leave no gap. Empty texts are blank. Texts of any length are
    handled one by one. Turns that are alike in all columns are repeated rows: each but
    the first is a duplicate. No rows give no conversations. Other columns of ``rows``
    are left out, whatever their names.
    """
    faulty = stored(with_faults(rows.select("c", "turn", "role", "text")), "faulty-turns")
    edits = stored(edits_of(faulty), "turn-edits")
    return faulty, edits, repaired(faulty, edits)


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract of op12: faults of each damaged conversation, the cheapest edits, the digest of the repaired turns.

    Runs jobs while it is built: it stores the numbered turns, their faults and the edits.
    """
    conversations = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    faulty, edits, turns = repair(damaged(conversations))
    digests = joined_digests(turns, ["c"], "place", F.array_join("lines", "\n"), b"\n")
    span = F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")
    counts = faulty.groupBy("c").agg(F.coalesce(span, F.lit(0)).alias("gaps"), *(F.count_if(F.col("fault") == k).alias(k) for k in ("blank", "duplicate", "truncated")))
    every = conversations.select("conv_id").distinct().withColumn("c", F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")))
    joined = every.join(counts, "c", "left").join(edits, "c", "left").join(digests, "c", "left")
    number = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    audit = F.translate(F.coalesce("edits", F.lit("")), "rtij", "RRII")
    return joined.select("conv_id", *map(number, ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), audit.alias("audit"), F.coalesce("sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))


#: CRC-32 of the text s, from its letters' codes: eight steps of division for each.
CRC32_SQL = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(s) + 1), lambda i: ascii(s[i])::BIGINT)),
    lambda h, b: list_reduce([xor(h, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x // 2, 3988292384 * (x % 2)))), 4294967295)"""

ORACLE_SQL = (
    r"""
WITH RECURSIVE keyed AS (
  SELECT coalesce(conv_id::VARCHAR, ' ') AS c, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS s
  FROM conversations
),
kinds AS (SELECT c, turn, role, text, """
    + CRC32_SQL
    + r""" % 20 AS kind FROM keyed),
damage AS (
  SELECT c, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM kinds WHERE kind <> 0
),
placed AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, role, text) AS i FROM damage),
seen AS (SELECT *, row_number() OVER (PARTITION BY c, role, text ORDER BY i) AS k, rtrim(text, E' \t\n\x0b\x0c\r') AS solid FROM placed),
faults AS (
  SELECT *, CASE WHEN solid = '' THEN 'b' WHEN k > 1 THEN 'd' WHEN right(solid, 1) NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault, CASE WHEN left(role, 1) IN ('s', 'u', 'a') THEN left(role, 1) ELSE '-' END AS initial
  FROM seen
),
pairs AS (SELECT *, lag(initial) OVER (PARTITION BY c ORDER BY i) || initial AS pair FROM faults),
counts AS (
  SELECT c, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'b') AS blank, count(*) FILTER (WHERE fault = 'd') AS duplicate, count(*) FILTER (WHERE fault = 't') AS truncated,
    count(*) FILTER (WHERE pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM pairs GROUP BY c
),
inserts(state, after, price, edits, added) AS (
  VALUES (0, 0, 0, '', []::VARCHAR[]), (1, 1, 0, '', []), (2, 2, 0, '', []), (3, 3, 0, '', []), (0, 2, 5, 'I', ['user:']), (1, 2, 5, 'I', ['user:']), (2, 3, 5, 'I', ['assistant:']), (3, 2, 5, 'I', ['user:']),
    (0, 3, 10, 'II', ['user:', 'assistant:']), (1, 3, 10, 'II', ['user:', 'assistant:'])
),
moves(state, edit, initial, after, price, given) AS (
  VALUES (0, 'K', 's', 1, 0, ''), (0, 'K', 'u', 2, 0, ''), (1, 'K', 'u', 2, 0, ''), (2, 'K', 'a', 3, 0, ''), (3, 'K', 'u', 2, 0, ''), (0, 'R', '', 2, 1, 'user'), (1, 'R', '', 2, 1, 'user'), (2, 'R', '', 3, 1, 'assistant'), (3, 'R', '', 2, 1, 'user'),
    (0, 'D', '', 0, 2, ''), (1, 'D', '', 1, 2, ''), (2, 'D', '', 2, 2, ''), (3, 'D', '', 3, 2, '')
),
walk(c, i, state, cost, audit, turns) AS (
  SELECT c, 0, 0, 0, '', []::VARCHAR[] FROM counts
  UNION ALL
  SELECT c, i, state, cost, audit, turns FROM (
    SELECT w.c, w.i + 1 AS i, m.after AS state, w.cost + n.price + m.price + CASE WHEN m.edit <> 'D' AND f.fault = 't' THEN 5 ELSE 0 END AS cost, w.audit || n.edits || m.edit AS audit,
      list_concat(list_concat(w.turns, n.added), CASE m.edit WHEN 'D' THEN [] WHEN 'K' THEN [f.role || ':' || f.text] ELSE [m.given || ':' || f.text] END) AS turns
    FROM walk w JOIN faults f ON f.c = w.c AND f.i = w.i + 1 JOIN inserts n ON n.state = w.state JOIN moves m ON m.state = n.after
    WHERE m.edit = 'D' OR f.fault IN ('', 't') AND (m.edit = 'R' OR m.initial = f.initial)
  ) QUALIFY row_number() OVER (PARTITION BY c, state ORDER BY cost, audit) = 1
),
ends AS (
  SELECT w.c, w.cost + n.price AS cost, w.audit || n.edits AS audit, list_concat(w.turns, n.added) AS turns
  FROM walk w JOIN counts t ON t.c = w.c AND t.n = w.i JOIN inserts n ON n.state = w.state
  WHERE n.after IN (0, 3) QUALIFY row_number() OVER (PARTITION BY w.c ORDER BY w.cost + n.price, w.audit || n.edits) = 1
),
every AS (SELECT DISTINCT conv_id, coalesce(conv_id::VARCHAR, ' ') AS c FROM conversations)
SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit,
  sha256(coalesce(array_to_string(turns, chr(10)), '')) AS repaired_sha256
FROM every LEFT JOIN counts USING (c) LEFT JOIN ends USING (c)
"""
)
