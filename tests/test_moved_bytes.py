"""What queries over entries shuffle and store: a few times the texts, and no more of them as these grow."""

import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from lodestrand.queries import QUERIES
from lodestrand.storage import shared_folder


def moved(spark, run):
    """Bytes that are shuffled and that stored tables take while ``run`` is called."""

    def so_far():
        spark.range(1).count()
        time.sleep(0.3)
        spark.range(1).count()  # sums are brought up to date when tasks end, not each time
        context = spark.sparkContext._jsc.sc()
        context.listenerBus().waitUntilEmpty(60_000)
        seen = context.statusStore().executorList(False)
        stored = sum(p.stat().st_size for p in Path(shared_folder(spark).removeprefix("file://")).rglob("*.parquet") if p.is_file())
        return sum(seen.apply(i).totalShuffleWrite() for i in range(seen.size())) + stored

    before = so_far()
    run()
    return so_far() - before


@pytest.fixture
def small_broadcasts(spark):
    """Tables are as small against this limit as large ones against the usual one."""
    key = "spark.sql.autoBroadcastJoinThreshold"
    usual = spark.conf.get(key)
    spark.conf.set(key, "64k")
    yield
    spark.conf.set(key, usual)


@pytest.mark.parametrize("name", ["q_rename_findings", "q_messages"])
def test_moved_bytes_follow_the_texts(spark, sf_dir, tmp_path, small_broadcasts, name):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    span = docs.agg(F.max("doc_id")).first()[0] + 1
    sizes, bytes_moved = [], []
    for copies in (4, 16):
        d = str(tmp_path / str(copies))
        docs.crossJoin(spark.range(copies).select(F.col("id").alias("copy"))).withColumn("doc_id", F.col("doc_id") + F.col("copy") * span).drop("copy").write.parquet(f"{d}/documents.parquet")
        sizes.append(spark.read.parquet(f"{d}/documents.parquet").agg(F.sum(F.octet_length("text"))).first()[0])
        bytes_moved.append(moved(spark, lambda d=d: QUERIES[name](spark, d).write.format("noop").mode("overwrite").save()))
    assert bytes_moved[1] < 3 * sizes[1]
    assert bytes_moved[1] / bytes_moved[0] < 1.1 * sizes[1] / sizes[0]
