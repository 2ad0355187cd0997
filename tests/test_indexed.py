"""Places in the order of a file when its rows are in many ranges."""

import pytest

from lodestrand.operators.hashing import indexed


@pytest.fixture
def many_ranges(spark):
    conf = {"spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20000", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1000", "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false"}
    old = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@pytest.mark.parametrize("by", ["file", None])
def test_places_are_right_however_wide_the_rows(spark, many_ranges, by):
    rows = [(("a", "b")[i % 3 == 0], i, f"{i * 7919 % 1009:04d}" * 100) for i in range(6000)]
    found = indexed(spark.createDataFrame(rows, "file string, ordinal long, payload string").repartition(6), "place", "ordinal", by=by).collect()
    order = sorted(rows, key=lambda r: (r[0] if by else "", r[1]))
    want, seen = {}, {}
    for f, i, payload in order:
        seen[f if by else ""] = want[f, i, payload] = seen.get(f if by else "", 0) + 1
    assert len(found) == len(rows)
    assert {(r.file, r.ordinal, r.payload): r.place for r in found} == want


def test_a_name_that_most_entries_have(spark, many_ranges):
    """Duplicates, repeats and renamed entries where one name holds most rows, against plain loops."""
    from test_validation import model_names

    from lodestrand.operators import dedup, hashing

    names = ["Hot" if i % 3 else ("hOT", f"N{i % 40}", f"N{i % 7}-b")[i % 9 // 3] for i in range(3000)]
    rows = [("f", i, n, f"h{i % 5}") for i, n in enumerate(names)]
    entries = spark.createDataFrame(rows, "file string, ordinal long, name string, Sequence_Hash string").repartition(6)
    assert [r.new_name for r in dedup.rename_duplicates(entries).orderBy("ordinal").collect()] == model_names(names)
    seen, again, first, kept = set(), [], {}, []
    for _, i, n, h in rows:
        again.append(n.lower() in seen)
        seen.add(n.lower())
        if first.setdefault(n.lower(), h) != h or not again[-1]:
            kept.append((i, again[-1]))
    assert [r.name_again for r in dedup.duplicate_names(entries).orderBy("ordinal").collect()] == again
    assert [(r.ordinal, r.retained) for r in dedup.same_name_kept(entries).orderBy("ordinal").collect()] == kept
    table = entries.withColumnRenamed("name", "Protein_Name")
    told = hashing.name_summary(table, table.where("false").select("Protein_Name")).collect()
    assert len(told) == len(rows) and sum(r.Duplicate_Name == "0" for r in told) == len(set(names))


POOL = ["A", "a-b", "A-b-b", "A-c", "A-a1", "A-z", "B", "b-a", "B-b2", "B-b01", "B-b", "A-d", "A-c-b-b", "-b", "A-b-b-b", "C-b", "A-b123456789012345678901"]


@pytest.mark.parametrize("seed", range(6))
def test_mixed_roots_equal_a_sequential_model(spark, many_ranges, seed):
    import random

    from test_validation import model_names

    from lodestrand.operators import dedup

    rng = random.Random(seed)
    pool = rng.sample(POOL, rng.randrange(4, len(POOL)))
    names = {f: [rng.choice(pool) for _ in range(rng.choice([20, 400]))] for f in ("f", "g")}
    entries = spark.createDataFrame([(f, i, n, f"{i}" * 50) for f in names for i, n in enumerate(names[f])], "file string, ordinal long, name string, payload string").repartition(5)
    found = dedup.rename_duplicates(entries)
    assert found.columns == [*entries.columns, "new_name"]
    for f in names:
        assert [r.new_name for r in found.where(found.file == f).orderBy("ordinal").collect()] == model_names(names[f])


def test_empty_and_missing_names_stay(spark):
    from lodestrand.operators import dedup

    entries = spark.createDataFrame([("f", 0, ""), ("f", 1, ""), ("f", 2, None), ("f", 3, "X"), ("f", 4, "x")], "file string, ordinal long, name string")
    assert [r.new_name for r in dedup.rename_duplicates(entries).orderBy("ordinal").collect()] == ["", "", None, "X", "x-b"]
    assert dedup.rename_duplicates(entries.where("false")).count() == 0
