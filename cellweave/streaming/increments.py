"""New cells as a stream: each micro-batch runs the batch functions, and cells already done are skipped."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

KEYS = ["tab_id", "row_id"]


def process_new_rows(spark: SparkSession, folder: str, schema: str, state: str, output: str, checkpoint: str, work: Callable[[DataFrame], DataFrame], once: bool = True) -> StreamingQuery:
    """Read new parquet files of ``folder``, drop rows whose key is in ``state``, write ``work(rows)`` to ``output``.

    Each micro-batch overwrites its own partition, so a batch repeated after a
    failure gives the same files.
    """
    stream = spark.readStream.schema(schema).parquet(folder)

    def batch(rows: DataFrame, number: int) -> None:
        session = rows.sparkSession
        fresh = rows.dropDuplicates(KEYS)
        try:
            done = session.read.parquet(state)
            fresh = fresh.join(done.where(f"batch <> {number}").select(*KEYS), KEYS, "left_anti")
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
        fresh.persist()
        work(fresh).write.mode("overwrite").parquet(f"{output}/batch={number}")
        fresh.select(*KEYS).write.mode("overwrite").parquet(f"{state}/batch={number}")
        fresh.unpersist()

    writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
