"""Files that arrive in a folder, each validated once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..options import Options
from ..plans.validation import validate_table


def watch(spark: SparkSession, folder: str, checkpoint: str, sink: Callable[[DataFrame, int], None], options: Options | None = None, max_files: int = 100, once: bool = True) -> StreamingQuery:
    """Findings of every new file of ``folder``, given to ``sink`` (findings, batch id) batch by batch.

    A file is a unit: no state goes from one to the next. Files come whole, so they
    should be of a size that a task can hold; ``plans.validate`` splits larger ones.
    """
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("maxFilesPerTrigger", max_files).load(folder)

    def batch(rows: DataFrame, number: int) -> None:
        texts = rows.select("path", F.make_valid_utf8(F.col("content")).alias("text"))
        sink(validate_table(texts, "path", "text", options).findings, number)

    writer = files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
