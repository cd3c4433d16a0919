"""Work in resumable batches: each new file of questions is processed once, its results appended."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery


def resumable(spark: SparkSession, source: str, schema: str, work: Callable[[DataFrame], DataFrame], target: str, state: str, files_a_batch: int = 1) -> StreamingQuery:
    """Runs ``work`` over the files of ``source`` that no earlier run has seen, then stops.

    A batch is written to a folder of its own, so one that is repeated after a failure replaces itself.
    """
    new = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(source)

    def write(batch: DataFrame, number: int) -> None:
        work(batch).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return new.writeStream.foreachBatch(write).option("checkpointLocation", state).trigger(availableNow=True).start()
