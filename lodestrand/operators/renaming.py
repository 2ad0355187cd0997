"""Every name of a file once: names that came before get an ending that no earlier name has."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import stored
from .hashing import indexed

#: A name that an ending may have made of another.
ENDED = r"^(.+)-([a-z])([1-9]\d{0,8})?$"


def endings() -> Iterator[str]:
    """-b to -z, then -a1 to -z1, -a2 and so on."""
    number = 0
    while True:
        for letter in range(ord("a") if number else ord("b"), ord("z") + 1):
            yield f"-{chr(letter)}{number or ''}"
        number += 1


def ending(number: Column) -> Column:
    """The ending of a number from 0 on, as ``endings`` gives them."""
    later = number - 25
    letter = F.when(number < 25, F.lit(ord("b")) + number).otherwise(F.lit(ord("a")) + F.pmod(later, F.lit(26)))
    return F.concat(F.lit("-"), F.char(letter), F.when(number < 25, "").otherwise(F.floor(later / 26 + 1).cast("string")))


def _ending_number(low: Column) -> Column:
    """Which ending a name has; null if none."""
    letter, digits = F.ascii(F.regexp_extract(low, ENDED, 2)) - ord("a"), F.regexp_extract(low, ENDED, 3)
    plain = F.when(letter > 0, letter - 1)
    return F.when(low.rlike(ENDED), F.when(digits == "", plain).otherwise(25 + (digits.try_cast("long") - 1) * 26 + letter)).cast("long")


def _decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each given name that another name's endings may come to: who has it first.

    Rows come by file and base: the base's repeats with their number from 0, and the
    given names with the number of their ending; at the same number, repeats first. The
    repeat that reaches an ending is as many places back as endings before were taken,
    so only that many repeats are held.
    """
    key, held, first, passed = None, deque(), 0, 0
    for batch in batches:
        files, bases, at, given, time = (batch.column(i).to_pylist() for i in (1, 2, 3, 4, 5))
        rows = []
        for file, base, number, name, when in zip(files, bases, at, given, time, strict=True):
            if (file, base) != key:
                key, held, first, passed = (file, base), deque(), 0, 0
            if name is None:
                held.append(when)
                continue
            reached = number - passed
            while held and first < reached:
                held.popleft()
                first += 1
            if first == reached and held:
                made = held[0] < when  # else the given name was there before
                passed += not made
                rows.append((file, name, made, base, None if made else reached + 1))
            else:
                rows.append((file, name, False, base, None))
        columns = zip(*rows, strict=True) if rows else [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.bool_(), pa.string(), pa.int64()), strict=True)], names=["file", "low", "made", "base", "from"])


def _contested(repeats: DataFrame, children: DataFrame) -> DataFrame:
    """(file, low, made, base, from) for each of ``children`` (file, low, base, number, first, base_made), whose bases are decided.

    made: the base's endings came to the name before it was given. from: the number of
    the base's repeat from which on endings are one further, as this one was taken.
    """
    reach = children.groupBy("file", "base", "base_made").agg(F.max("number").alias("most"))
    again = repeats.join(reach, (repeats["file"] == reach["file"]) & (repeats["low"] == reach["base"])).select(repeats["file"], "base", (F.col("place") - F.when(F.col("base_made"), 1).otherwise(2)).alias("at"), "most", "ordinal")
    rows = again.where("at BETWEEN 0 AND most").select("file", "base", "at", F.lit(None).cast("string").alias("given"), F.col("ordinal").alias("time"))
    rows = rows.unionByName(children.select("file", "base", F.col("number").alias("at"), F.col("low").alias("given"), F.col("first").alias("time")))
    n = 4 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.withColumn("stream", F.pmod(F.xxhash64("file", "base"), F.lit(n)).cast("int")).select("stream", "file", "base", "at", "given", "time")
    ordered = dealt.repartition("stream").sortWithinPartitions("stream", "file", "base", "at", F.col("given").asc_nulls_first())
    return ordered.groupBy("stream").applyInArrow(_decide, "file string, low string, made boolean, base string, from long")


def _passed(repeats: DataFrame, taken: DataFrame) -> DataFrame:
    """(file, ordinal, passed) of the repeats (file, low, number) of names in ``taken`` (file, low, from): how many of these are reached.

    A running count over ranges of (file, low, number): one row for each range carries
    the counts over, so the repeats of one name are counted in several tasks.
    """
    names = taken.select("file", "low").distinct()
    rows = repeats.join(names, ["file", "low"], "left_semi").select("file", "low", "number", F.lit(1).alias("kind"), "ordinal").unionByName(taken.select("file", "low", F.col("from").alias("number"), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("ordinal")))
    ranged = stored(rows.repartitionByRange("file", "low", "number", "kind").withColumn("_range", F.spark_partition_id()), "endings-taken")
    one = (F.col("kind") == 0).cast("long")
    own = Window.partitionBy("file", "low", "_range").orderBy("number", "kind").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("file", "low").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sums = ranged.groupBy("file", "low", "_range").agg(F.sum(one).alias("n")).select("file", "low", "_range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    counted = ranged.withColumn("own", F.sum(one).over(own)).join(sums, ["file", "low", "_range"])
    return counted.where("kind = 1").select("file", "ordinal", (F.col("own") + F.col("base")).alias("passed"))


def rename_duplicates(entries: DataFrame) -> DataFrame:
    """``entries`` with new_name: every name of a file once, in either case, by endings that no earlier name has.

    The k-th repeat of a name has the k-th ending that is free when its turn comes. An
    ending is taken if the name it makes was given before, so only given names that end
    like one are looked at, level by level: names whose base is no such name first, then
    those whose base is decided. Of the repeats, those that can reach such a name pass
    by it in a stream, whose distribution the grouping declares. All other repeats get
    their ending from their place among the entries of the name alone, which comes from
    ranges, so one name, or one root of names, may hold most entries.

    Nulls and empty names are left as they are. Runs jobs while it is built: it stores
    the repeats and each level's decisions.
    """
    low = F.lower("name")
    named = entries.where("name <> ''").select("file", "ordinal", "name", low.alias("low"))
    names = stored(named.groupBy("file", "low").agg(F.count("*").alias("n"), F.min("ordinal").alias("first")), "names")
    bases = names.select(F.col("file").alias("_file"), F.col("low").alias("base"), F.col("n").alias("base_n"))
    ended = names.withColumns({"base": F.regexp_extract("low", ENDED, 1), "number": _ending_number(F.col("low"))}).where("number IS NOT NULL").drop("n")
    joined = ended.join(bases, (ended["file"] == bases["_file"]) & (ended["base"] == bases["base"])).select("file", "low", "first", "number", ended["base"])
    children = stored(joined, "names-with-base")
    made = children.select("file", "low")
    wanted = names.where("n > 1").select("file", "low").unionByName(made).distinct()
    repeats = stored(indexed(named.join(wanted, ["file", "low"], "left_semi"), "place", "ordinal", by=["file", "low"]), "repeats")
    open_, decided = children, None
    while not open_.isEmpty():
        waiting = open_.select("file", F.col("low").alias("base"))
        ready = open_.join(waiting, ["file", "base"], "left_anti")
        if decided is None:
            ready = ready.withColumn("base_made", F.lit(False))
        else:
            known = decided.select("file", F.col("low").alias("base"), F.col("made").alias("base_made"))
            ready = ready.join(known, ["file", "base"], "left").withColumn("base_made", F.coalesce("base_made", F.lit(False)))
        found = stored(_contested(repeats, ready), "names-decided")
        decided = found if decided is None else stored(decided.unionByName(found), "names-decided")
        open_ = stored(open_.join(found.select("file", "low"), ["file", "low"], "left_anti"), "names-open")
    if decided is None:
        late = repeats.where("place > 1").select("file", "ordinal", F.concat("name", ending(F.col("place") - 2)).alias("new_name"))
    else:
        early = decided.where("made").select("file", "low", F.lit(True).alias("made"))
        numbered = repeats.join(early, ["file", "low"], "left").withColumn("number", F.col("place") - F.when(F.col("made"), 0).otherwise(1)).where("number > 0")
        taken = decided.where("from IS NOT NULL").select("file", F.col("base").alias("low"), "from")
        late = numbered.join(_passed(numbered, taken), ["file", "ordinal"], "left").select("file", "ordinal", F.concat("name", ending(F.col("number") - 1 + F.coalesce("passed", F.lit(0)))).alias("new_name"))
    return entries.join(late, ["file", "ordinal"], "left").withColumn("new_name", F.coalesce("new_name", "name"))
