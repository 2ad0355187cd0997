"""Quality rules: repetition and length, and how far a text's histograms are from its language.

Native: DataFrame functions alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, text_of

# Frequent function words of each language. Fixed values.
COMMON_WORDS = {
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als".split(),
    "en": "the of and to in is that for it was on are as with be this at by from or".split(),
    "es": "de la que el en y a los se del las un por con no una su para es al".split(),
    "fr": "de la le et les des en un du une que est pour qui dans il par plus pas au".split(),
}
# Classes of characters; what is in none of them is a class of its own. Fixed values.
CHARACTER_CLASSES = {"lower": "a-z", "upper": "A-Z", "digit": "0-9", "space": r"\x20\x09-\x0D", "mark": ".,;:!?'\"()-", "symbol": "#*$%&|<>"}
SPACE = r"[\x20\x09-\x0D]+"
MIN_WORDS = 50
MAX_REPEATED_PERCENT = 50
WINDOW = 3
#: Jensen-Shannon distance (0 to 1) from the language's characters, and from its common words, at most.
MAX_CHARACTER_DISTANCE = 0.28
MAX_WORD_DISTANCE = 0.28
#: Words that a text needs before its common words are compared: of fewer, chance alone
#: takes a clean text as far from its language as the rule allows.
MIN_WORDS_COMPARED = 200


def words_of(text: Column) -> Column:
    trimmed = F.regexp_replace(text, r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "")
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE))


def _repeated_words(words: str) -> Column:
    """Words in a window of three that the text has twice or more.

    The hashes of the windows are sorted with their places; neighbours that are equal
    mark both places, and each marked place counts the words up to the next one.
    """
    n = F.size(words)
    hashes = F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(*(F.get(words, i + k) for k in range(WINDOW))))
    return F.when(n >= WINDOW, hashes)


def _neighbours(pairs: str) -> Column:
    """The places, in order, whose hash a neighbour in the sorted array shares."""
    like = lambda p, i: F.coalesce(F.get(pairs, i)["h"] == p["h"], F.lit(False))
    return F.sort_array(F.transform(F.filter(pairs, lambda p, i: like(p, i - 1) | like(p, i + 1)), lambda p: p["at"]))


def _covered(places: str) -> Column:
    step = F.transform(places, lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get(places, i + 1) - p, F.lit(WINDOW))))
    return F.aggregate(step, F.lit(0).cast("long"), lambda a, x: a + x)


def _removed(text: Column, pattern: str) -> Column:
    return (F.length(text) - F.length(F.regexp_replace(text, pattern, ""))).cast("long")


def text_statistics(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang") -> DataFrame:
    """Counts of each document, all from its own row: no shuffle.

    Columns: doc_id, lang, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    characters (counts of each class, the rest last), common (counts of each common
    word of the language, the rest last; null for a language without a list).
    """
    text = F.col("text")
    rows = documents.select(F.col(id_column).alias("doc_id"), F.col(lang_column).cast("string").alias("lang"), text_of(text_column).alias("text"))
    split = rows.withColumns({"words": words_of(text), "low": words_of(F.lower(text)), "lines": F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))})
    listed = F.create_map(*[x for k, v in COMMON_WORDS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    split = split.withColumns({"hashes": _repeated_words("words"), "listed": F.try_element_at(listed, F.col("lang"))})
    split = split.withColumn("seen", F.filter(F.transform("low", lambda w: F.array_position("listed", w)), lambda p: p > 0))
    doubled = F.size(F.array_distinct("hashes")) < F.size("hashes")
    split = split.withColumn("pairs", F.when(doubled, F.sort_array(F.transform("hashes", lambda h, i: F.struct(h.alias("h"), i.alias("at"))))))
    split = split.withColumn("places", F.when(F.col("pairs").isNotNull(), _neighbours("pairs")))
    classes = [_removed(text, f"[{c}]+").alias(k) for k, c in CHARACTER_CLASSES.items()]
    counted = split.select(
        "doc_id",
        "lang",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(_covered("places"), F.lit(0)).alias("n_repeat_words"),
        F.length(text).cast("long").alias("n_chars"),
        *classes,
        F.col("listed").isNotNull().alias("is_listed"),
        "seen",
    )
    rest = F.col("n_chars") - sum(F.col(k) for k in CHARACTER_CLASSES)
    size = max(map(len, COMMON_WORDS.values()))
    each = [F.size("seen") - F.size(F.array_remove("seen", F.lit(k + 1).cast("long"))) for k in range(size)]
    common = F.array(*(x.cast("long") for x in each), F.col("n_words") - F.size("seen"))
    return counted.select("doc_id", "lang", "n_words", "word_chars", F.col("symbol").alias("n_symbols"), "n_dup_lines", "n_repeat_words", F.array(*CHARACTER_CLASSES, rest).alias("characters"), F.when(F.col("is_listed"), common).alias("common"))


def references(statistics: DataFrame) -> DataFrame:
    """(language, characters, common): summed histograms of each listed language, and of all rows under ''.

    One row for each listed language and one more, whatever the input.
    """
    language = F.when(F.col("lang").isin(*COMMON_WORDS), F.col("lang")).otherwise(F.lit(""))
    widths = {"characters": len(CHARACTER_CLASSES) + 1, "common": max(map(len, COMMON_WORDS.values())) + 1}
    cells = {f"{c}_{i}": F.coalesce(F.get(c, F.lit(i)), F.lit(0)) for c, n in widths.items() for i in range(n)}
    sums = statistics.select(language.alias("language"), *(v.alias(k) for k, v in cells.items())).groupBy("language").agg(*(F.sum(k).alias(k) for k in cells))
    total = sums.agg(*(F.sum(k).alias(k) for k in cells)).select(F.lit("").alias("language"), *cells)
    every = sums.where("language <> ''").unionByName(total)
    return every.select("language", *(F.array(*(F.col(f"{c}_{i}") for i in range(n))).alias(f"{c}_reference") for c, n in widths.items()))


def divergence(counts: str, reference: str) -> Column:
    """Jensen-Shannon distance, base 2, of two arrays of counts: 0 if they agree, 1 if they have nothing in common."""
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x)
    n, m = total(counts), total(reference)
    part = lambda p, mid: F.when(p > 0, p * F.log2(p / mid)).otherwise(F.lit(0.0))

    def term(a: Column, b: Column) -> Column:
        p, q = a / n, b / m
        return part(p, (p + q) / 2) + part(q, (p + q) / 2)

    whole = F.aggregate(F.zip_with(counts, reference, term), F.lit(0.0), lambda s, x: s + x)
    return F.when((n > 0) & (m > 0), F.sqrt(F.greatest(whole / 2, F.lit(0.0))))


def base_failed() -> Column:
    """Too few words, or too many of them in windows that repeat."""
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words"))


def judge(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang", max_character_distance: float = MAX_CHARACTER_DISTANCE, max_word_distance: float = MAX_WORD_DISTANCE, min_words_compared: int = MIN_WORDS_COMPARED, trusted: DataFrame | None = None) -> DataFrame:
    """One row per document with its counts, its distances from its language and the verdict.

    The references are the summed histograms of ``trusted``, so a verdict does not depend
    on the documents that are judged with it. ``trusted`` is a table of texts (columns as
    ``documents``), or of ids alone, which name documents of this table. Without it all
    documents serve, and a verdict then depends on the table it comes with. A text is compared with its own language's; with all languages' where the language has no list of common words
    (or is null), and then by characters alone. Texts of fewer than
    ``min_words_compared`` words are compared by characters alone.

    Columns: doc_id, lang, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    character_distance, word_distance (null where not compared), base_failed, kept.

    Nulls: a null text has no words and fails the base rules; a null doc_id is a
    document like another. Long texts are read whole. Repeated rows get equal results.
    An empty table gives no rows. Other columns are ignored.
    """
    counts = stored(text_statistics(documents, id_column, text_column, lang_column), "text-statistics")
    if trusted is None:
        known_good = counts
    elif text_column in trusted.columns:
        known_good = text_statistics(trusted, id_column, text_column, lang_column)
    else:
        known_good = counts.join(trusted.select(F.col(id_column).alias("doc_id")), "doc_id", "left_semi")
    known = counts.withColumn("language", F.when(F.col("lang").isin(*COMMON_WORDS), F.col("lang")).otherwise(F.lit("")))
    joined = known.join(F.broadcast(references(known_good)), "language", "left")  # a row for each listed language and one more
    compared = joined.withColumns({"character_distance": divergence("characters", "characters_reference"), "word_distance": F.when((F.col("n_words") >= min_words_compared) & F.col("common").isNotNull(), divergence("common", "common_reference"))})
    close = (F.coalesce("character_distance", F.lit(0.0)) <= max_character_distance) & (F.coalesce("word_distance", F.lit(0.0)) <= max_word_distance)
    return compared.select("doc_id", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "character_distance", "word_distance", base_failed().alias("base_failed"), (~base_failed() & close).alias("kept"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract of op8: the base counts of each document and whether it is kept. References: the documents labelled good."""
    trusted = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1").select("doc_id")
    judged = judge(spark.read.parquet(f"{sf_dir}/documents.parquet"), trusted=trusted)
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _oracle() -> str:
    lists = ", ".join(f"('{k}', [{', '.join(repr(w) for w in v)}])" for k, v in COMMON_WORDS.items())
    size = max(map(len, COMMON_WORDS.values()))
    classes = ", ".join("length(t) - length(regexp_replace(t, '[" + c.replace("'", "''") + "]+', '', 'g'))" for c in CHARACTER_CLASSES.values())
    sums = lambda c, n: "[" + ", ".join(f"sum({c}[{i + 1}])::BIGINT" for i in range(n)) + "]"
    n_chars = len(CHARACTER_CLASSES) + 1

    def distance(a: str, b: str) -> str:
        mid = f"(({a}[i] / list_sum({a}) + {b}[i] / list_sum({b})) / 2)"
        part = lambda x: f"CASE WHEN {x}[i] > 0 THEN {x}[i] / list_sum({x}) * log2({x}[i] / list_sum({x}) / {mid}) ELSE 0 END"
        return f"CASE WHEN list_sum({a}) > 0 AND list_sum({b}) > 0 THEN sqrt(greatest(list_sum([{part(a)} + {part(b)} for i in range(1, len({a}) + 1)]) / 2, 0)) END"

    return rf"""
WITH d AS (SELECT doc_id, lang, coalesce(text, '') AS t FROM documents),
listed(language, common_words) AS (VALUES {lists}),
s AS (
  SELECT doc_id, coalesce(language, '') AS language, common_words, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words, regexp_extract_all(lower(t), '[^\x20\x09-\x0D]+') AS low,
    length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, [x for x in string_split(t, chr(10)) if regexp_matches(x, '[^\x20\x09-\x0D]')] AS lines, [{classes}] AS cs, length(t) AS n
  FROM d LEFT JOIN listed ON lang = language
),
c AS (
  SELECT doc_id, language, words, len(words) AS n_words, list_sum([length(w) for w in words]) AS word_chars, n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
    list_append(cs, n - list_sum(cs)) AS characters, [list_position(common_words, w) for w in low if list_contains(common_words, w)] AS seen, common_words IS NOT NULL AS is_listed
  FROM s
),
h AS (SELECT *, CASE WHEN is_listed THEN list_append([len([p for p in seen if p = k]) for k in range(1, {size + 1})], n_words - len(seen)) END AS common FROM c),
w AS (SELECT doc_id, generate_subscripts(words, 1) AS i, words FROM c WHERE n_words >= {WINDOW}),
g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, words[i], words[i + 1], words[i + 2]) AS times FROM w WHERE i <= len(words) - 2),
r AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM g, range(0, {WINDOW}) AS o(k) WHERE times > 1 GROUP BY doc_id),
good AS (SELECT * FROM h WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)),
one AS (SELECT language, {sums("characters", n_chars)} AS cr, {sums("common", size + 1)} AS wr FROM good WHERE language <> '' GROUP BY language),
refs AS (SELECT * FROM one UNION ALL SELECT '', (SELECT {sums("characters", n_chars)} FROM good), NULL),
x AS (
  SELECT h.doc_id, n_words, coalesce(word_chars, 0)::BIGINT AS word_chars, n_symbols, n_dup_lines, coalesce(r.n, 0) AS n_repeat_words, {distance("characters", "cr")} AS cd, CASE WHEN n_words >= {MIN_WORDS_COMPARED} AND common IS NOT NULL THEN {distance("common", "wr")} END AS wd
  FROM h LEFT JOIN r ON h.doc_id = r.doc_id LEFT JOIN refs ON h.language = refs.language
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED_PERCENT} * n_words AS base_failed,
  NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED_PERCENT} * n_words) AND coalesce(cd, 0) <= {MAX_CHARACTER_DISTANCE} AND coalesce(wd, 0) <= {MAX_WORD_DISTANCE} AS kept
FROM x
"""


ORACLE_SQL = _oracle()
