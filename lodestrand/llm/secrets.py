"""Secrets in texts, and the parts of split credentials that lie close together.

Native: DataFrame functions alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import own_names, stored, text_of


def either_case(words: str) -> str:
    """The pattern with a class of both cases for each letter: the same in every regex engine."""
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in words)


_QUOTED = r"""["']?\x20*[:=]\x20*["']?"""
# The base kinds: pattern, least length of what is measured. Fixed values.
ASSIGN = f"({either_case('password|passwd|secret|token|api_?key')}){_QUOTED}([A-Za-z0-9+/_.=-]+)"
BASE = {
    "assign": ASSIGN,  # six characters or more in group 2
    "access": r"AKIA[A-Z0-9]{16,}",  # a run of fewer is no match in any case
    "hex": r"[0-9a-f]{24,}",
}
ASSIGN_LEAST = 6
# Parts of credentials that say little alone.
WEAK = {
    "weak_user": f"(?:{either_case('username|user|login|account|client_?id')}){_QUOTED}[A-Za-z0-9@._-]{{3,}}",
    "weak_key": r"[A-Za-z0-9+/_=.-]{40,}",  # exactly 40, see strong_mix()
    "weak_endpoint": r"(?:https?|jdbc|postgresql|postgres|mysql|mongodb|redis|amqp)://[A-Za-z0-9._@:-]+",
}
KINDS = [*BASE, *WEAK]
#: What is masked beyond what op7 reports: keys written against other signs, and the user and password of any endpoint.
USERINFO = "userinfo"
MASKED = BASE | WEAK | {"weak_key": r"[A-Za-z0-9+/]{40,}", USERINFO: r"""://[^\s:/@?#"'<>]*:[^\s/?#"'<>]+@"""}
#: What each kind is a part of: an identifier, a secret or an endpoint.
ROLE = {"assign": "secret", "access": "id", "hex": "secret", "weak_user": "id", "weak_key": "secret", "weak_endpoint": "endpoint", USERINFO: USERINFO}
#: A scope reaches this many code points to either side of a candidate.
SCOPE = 300

#: What every match has in it somewhere.
_LIKELY = "|".join(["AKIA", "://", "[0-9a-f]{24}", "[A-Za-z0-9+/]{40}", *map(either_case, ("passw", "secret", "token", "key", "user", "login", "account", "client"))])


def _pieces(text: Column, pattern: str) -> Column:
    """(before, found) of each match: the code points since the last match, and the match itself."""
    found, between = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    return F.zip_with(found, F.slice(between, 1, F.size(found)), lambda m, b: F.struct(F.length(b).alias("before"), m.alias("match")))


def strong_mix(key: Column) -> Column:
    """40 characters of base 64 with digits and letters of both cases."""
    return (F.length(key) == 40) & ~key.rlike("[_=.-]") & key.rlike("[0-9]") & key.rlike("[a-z]") & key.rlike("[A-Z]")


def spans(texts: DataFrame, patterns: dict[str, str] = BASE | WEAK) -> DataFrame:
    """(doc_id, text_hash, kind, start, end, role) of every match of every kind of ``patterns``; code points, end exclusive.

    texts: doc_id, text_hash, text. The positions are running sums over the pieces of a
    text; texts without anything that begins a match are left out before.
    """
    likely = texts.where(F.col("text").rlike(_LIKELY))
    kinds = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), _pieces(F.col("text"), p).alias("pieces")) for k, p in patterns.items()]))
    each = likely.select("doc_id", "text_hash", kinds.alias("k")).select("doc_id", "text_hash", "k.kind", F.posexplode("k.pieces").alias("at", "piece"))
    flat = each.select("doc_id", "text_hash", "kind", "at", F.col("piece.before").alias("before"), F.length("piece.match").alias("size"), F.col("piece.match").alias("match")).dropDuplicates(["doc_id", "text_hash", "kind", "at"])
    so_far = Window.partitionBy("doc_id", "text_hash", "kind").orderBy("at")
    placed = flat.withColumn("end", F.sum(F.col("before") + F.col("size")).over(so_far))
    value = F.regexp_extract("match", f"^{ASSIGN}$", 2)
    enough = F.when(F.col("kind") == "assign", F.length(value) >= ASSIGN_LEAST).when(F.col("kind") == "weak_key", strong_mix(F.col("match"))).otherwise(True)
    role = F.create_map(*[F.lit(x) for pair in ROLE.items() for x in pair])[F.col("kind")]
    start, end = F.col("end") - F.col("size"), F.col("end")
    inner = F.col("kind") == USERINFO  # between :// and @
    return placed.where(enough).select("doc_id", "text_hash", "kind", F.when(inner, start + 3).otherwise(start).alias("start"), F.when(inner, end - 1).otherwise(end).alias("end"), role.alias("role"))


def linked(found: DataFrame, scope: int = SCOPE) -> DataFrame:
    """The weak candidates of ``found`` with a part of another role in their scope.

    An interval join: a candidate's scope is its span and ``scope`` code points to
    either side; a part lies in it if the two overlap. One of the two must be a secret.
    Parts are summed up as the first start and last end of each role in each bin of a
    text that they touch, so the join compares a few rows for a candidate, however many
    parts lie around it; a bin is no wider than a scope's side, so these sums decide
    exactly.
    """
    weak = found.where(F.col("kind").isin(*WEAK))
    bins = lambda low, high: F.explode(F.sequence(F.floor(F.greatest(low, F.lit(0)) / scope), F.floor(high / scope)))
    parts = found.withColumn("bin", bins(F.col("start"), F.col("end"))).groupBy("doc_id", "text_hash", "bin", F.col("role").alias("other")).agg(F.min("start").alias("first"), F.max("end").alias("last"))
    reach = weak.withColumn("bin", bins(F.col("start") - scope, F.col("end") + scope))
    same = [F.col("w.doc_id").eqNullSafe(F.col("p.doc_id")), F.col("w.text_hash") == F.col("p.text_hash"), F.col("w.bin") == F.col("p.bin")]
    complement = (F.col("w.role") != F.col("p.other")) & ((F.col("w.role") == "secret") | (F.col("p.other") == "secret"))
    near = (F.col("p.first") < F.col("w.end") + scope) & (F.col("p.last") > F.col("w.start") - scope)
    return reach.alias("w").join(parts.alias("p"), [*same, complement, near], "left_semi").drop("bin").distinct()


def _told(kinds: list[str]) -> Column:
    """kind:start:end of the spans of these kinds, by start and then by kind as listed."""
    order = F.create_map(*[F.lit(x) for i, k in enumerate(KINDS) for x in (k, i)])
    items = F.array_sort(F.collect_list(F.when(F.col("kind").isin(*kinds), F.struct("start", order[F.col("kind")].alias("order"), "end", "kind"))))
    return F.array_join(F.transform(items, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def _keyed(documents: DataFrame, id_column: str, text_column: str) -> DataFrame:
    text = text_of(text_column)
    return documents.select(F.col(id_column).alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))


def secret_spans(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", scope: int = SCOPE) -> DataFrame:
    """(doc_id, text_hash, kind, start, end, role): the base spans, and the weak ones that are linked.

    Base kinds: assignments to a name such as ``password`` or ``api_key``, access
    identifiers, long lower-case hex runs. Weak kinds, reported only where parts of
    another role lie within ``scope`` code points: user names, bare 40-character keys,
    endpoints. text_hash is xxhash64 of the text, which tells apart the texts of a
    repeated doc_id.
    """
    found = stored(spans(_keyed(documents, id_column, text_column)), "secret-spans")
    return found.where(F.col("kind").isin(*BASE)).unionByName(linked(found, scope))


def scan(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", scope: int = SCOPE) -> DataFrame:
    """One row per document: its text and the secrets in it.

    Columns: doc_id, text, n_assign, n_access, n_hex (base spans of each kind), n_linked
    (weak candidates that a complementary part stands close to), base and spans (both
    as kind:start:end joined by commas, by start and then kind).

    Nulls: a null text counts as empty; a null doc_id is a document like another. An
    empty text has no spans. Long texts are scanned whole. Repeated rows get equal
    results. An empty table gives no rows. Other columns are ignored.
    """
    counts = [F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in BASE]
    every = secret_spans(documents, id_column, text_column, scope)
    rows = every.groupBy("doc_id", "text_hash").agg(*counts, F.count_if(F.col("kind").isin(*WEAK)).alias("n_linked"), _told([*BASE]).alias("base"), _told(KINDS).alias("spans"))
    there = rows.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), *rows.columns[2:])
    whole = _keyed(documents, id_column, text_column).join(there, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash")), "left")
    zero = [F.coalesce(F.col(f"n_{k}"), F.lit(0)).alias(f"n_{k}") for k in (*BASE, "linked")]
    return whole.select("doc_id", "text", *zero, *(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("base", "spans")))


def redact(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", mask: str = "[SECRET]", scope: int = SCOPE) -> DataFrame:
    """``documents`` with each secret replaced by ``mask``; all columns, texts without secrets as they were.

    Masked are the secrets of ``secret_spans`` but for endpoints, where only user and
    password go; also keys of 40 characters between = _ . or -, which op7's own kinds
    take for parts of longer runs. Spans that overlap or touch have one mask.

    Nulls: a null text stays null, a null doc_id is a document like another. Long texts
    are masked whole. Repeated rows get equal texts. An empty table gives no rows. All
    columns pass through, whatever their names.
    """
    key = ["doc_id", "text_hash"]
    every = stored(spans(_keyed(documents, id_column, text_column), MASKED), "masked-spans")
    told = F.col("kind").isin(*BASE, USERINFO)
    found = every.where(told).unionByName(linked(every.where(F.col("kind") != USERINFO), scope)).where("role <> 'endpoint'")
    order = Window.partitionBy(*key).orderBy("start", "end")
    fresh = F.coalesce(F.col("start") > F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True))
    islands = found.withColumn("fresh", fresh.cast("int")).withColumn("island", F.sum("fresh").over(order)).groupBy(*key, "island").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    at, own_id, own_hash = own_names(documents, "_cuts", "_cut_id", "_cut_hash")
    cuts = islands.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias(at)).select(F.col("doc_id").alias(own_id), F.col("text_hash").alias(own_hash), at)
    text, last = text_of(text_column), F.size(at)
    begin = lambda i: F.when(i == 0, 0).otherwise(F.get(at, i - 1)["end"])
    stop = lambda i: F.when(i == last, F.length(text)).otherwise(F.get(at, i)["start"])
    kept = F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(text, (begin(i) + 1).cast("int"), (stop(i) - begin(i)).cast("int")))
    joined = documents.join(cuts, F.col(id_column).eqNullSafe(F.col(own_id)) & (F.xxhash64(text) == F.col(own_hash)), "left")
    return joined.withColumn(text_column, F.when(F.col(at).isNull(), F.col(text_column)).otherwise(F.array_join(kept, mask))).drop(own_id, own_hash, at)


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract of op7: counts of the base kinds and digests of the spans."""
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"), "spans")


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _oracle() -> str:
    kinds = " UNION ALL ".join(f"SELECT doc_id, {i} AS k, {_quoted(k)} AS kind, {_quoted(ROLE[k])} AS role, string_split_regex(t, {_quoted(p)}) AS gaps, regexp_extract_all(t, {_quoted(p)}) AS hits FROM d" for i, (k, p) in enumerate((BASE | WEAK).items()))
    base, weak = ("(" + ", ".join(map(_quoted, kinds)) + ")" for kinds in (BASE, WEAK))
    told = "string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k)"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
m AS ({kinds}),
p AS (SELECT doc_id, k, kind, role, unnest(hits) AS hit, unnest(gaps[1:len(hits)]) AS gap, generate_subscripts(hits, 1) AS i FROM m),
ends AS (SELECT doc_id, k, kind, role, hit, sum(length(gap) + length(hit)) OVER (PARTITION BY doc_id, k ORDER BY i) AS e FROM p),
f AS (
  SELECT doc_id, k, kind, role, (e - length(hit))::BIGINT AS s, e::BIGINT AS e FROM ends
  WHERE CASE kind WHEN 'assign' THEN length(regexp_extract(hit, {_quoted(ASSIGN)}, 2)) >= {ASSIGN_LEAST}
    WHEN 'weak_key' THEN length(hit) = 40 AND NOT regexp_matches(hit, '[_=.-]') AND regexp_matches(hit, '[0-9]') AND regexp_matches(hit, '[a-z]') AND regexp_matches(hit, '[A-Z]')
    ELSE true END
),
w AS (
  SELECT * FROM f WHERE kind IN {weak} AND EXISTS (
    SELECT 1 FROM f x WHERE x.doc_id = f.doc_id AND x.role <> f.role AND (x.role = 'secret' OR f.role = 'secret') AND x.s < f.e + {SCOPE} AND x.e > f.s - {SCOPE})
),
every AS (SELECT * FROM f WHERE kind IN {base} UNION ALL SELECT * FROM w),
told AS (
  SELECT doc_id, {", ".join(f"count(*) FILTER (WHERE kind = '{k}') AS n_{k}" for k in BASE)},
    {told} FILTER (WHERE kind IN {base}) AS base, {told} AS spans
  FROM every GROUP BY doc_id
)
SELECT d.doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN told ON d.doc_id = told.doc_id
"""


ORACLE_SQL = _oracle()
