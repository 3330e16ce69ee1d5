"""Incremental intake with Structured Streaming: new log rows are appended once, whatever is read again.

The batch engine has no streaming operators to match; this is what its resumable scanner becomes on Spark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def append_new(spark: SparkSession, source: str, schema: str, target: str, keys: list[str], checkpoint: str) -> StreamingQuery:
    """Reads all files of ``source`` that were not read before and appends rows whose keys the target lacks."""

    def add(batch: DataFrame, _: int) -> None:
        own = batch.dropDuplicates(keys)
        try:
            known = spark.read.schema(batch.schema).parquet(target).select(*keys)
        except Exception as missing:  # the first batch makes the target
            if "PATH_NOT_FOUND" not in str(missing):
                raise
            known = None
        (own if known is None else own.join(known, keys, "left_anti")).write.mode("append").parquet(target)

    return spark.readStream.schema(schema).parquet(source).writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
