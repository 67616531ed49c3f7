"""Keeping bucket sizes of a growing windows table, with Structured Streaming over new files.

Each micro-batch is made distinct, freed of the windows that earlier batches hold, and appended; readers count. The index
keeps every distinct window, so one that arrives again counts once however late it is, and none is lost for its time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.hashes import hex64

WINDOWS = "run_id int, file_id int, pos int, h string, emitted_at timestamp"


KEY = ["run_id", "hv", "file_id", "pos"]
INDEX = "run_id int, hv bigint, file_id int, pos int, batch int"


def maintain(spark: SparkSession, source: str, index: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Start the query; by default it takes what is there and ends. Null and zero hashes are no windows."""
    new = spark.readStream.schema(WINDOWS).parquet(source).select("run_id", hex64("h").alias("hv"), "file_id", "pos").where("hv <> 0").dropna()

    def append(batch: DataFrame, no: int) -> None:
        rows = batch.dropDuplicates(KEY)
        if no:
            rows = rows.join(batch.sparkSession.read.schema(INDEX).parquet(index).where(F.col("batch") < no), KEY, "left_anti")
        rows.write.mode("overwrite").parquet(f"{index}/batch={no}")  # a repeated batch replaces itself

    return new.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def bucket_sizes(spark: SparkSession, index: str) -> DataFrame:
    """(run_id, hv, bucket_size) over all batches so far."""
    return spark.read.schema(INDEX).parquet(index).groupBy("run_id", "hv").agg(F.count(F.lit(1)).alias("bucket_size"))
