"""Extension (the batch engine's model has no streams): incremental import, deduplication and contract checks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..operators.aggregates import contract


def incoming(spark: SparkSession, path: str, schema: StructType, fmt: str = "parquet", files_per_batch: int = 100) -> DataFrame:
    """New files of a folder as they come."""
    return spark.readStream.format(fmt).schema(schema).option("maxFilesPerTrigger", files_per_batch).load(path)


def deduplicated(df: DataFrame, keys: list[str], time: str, within: str = "1 hour") -> DataFrame:
    """First of each key within a watermark; state older than that is dropped."""
    return df.withWatermark(time, within).dropDuplicatesWithinWatermark(keys)


def windowed(df: DataFrame, time: str, by: list[str], value: str, length: str = "10 minutes", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """start, end, by..., n, total of windows; later data than the watermark are left out."""
    w = F.window(time, length, slide) if slide else F.window(time, length)
    g = df.withWatermark(time, late).groupBy(w.alias("w"), *by).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
    return g.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "n", "total")


def sink(df: DataFrame, path: str, checkpoint: str, rules: list[dict] | None = None, rejected: str | None = None, on_batch: Callable[[int], None] | None = None) -> StreamingQuery:
    """Appends to Parquet; with rules, rows that break a contract go to `rejected`. Batches are written by number, so a
    repeated batch replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        good = batch
        if rules:
            batch = batch.withColumn("__row", F.monotonically_increasing_id()).persist()
            _, bad = contract(batch, rules)
            bad = bad.persist()
            if rejected:
                bad.drop("__row", "broken_rules").write.mode("overwrite").parquet(f"{rejected}/batch={number}")
            good = batch.join(bad.select("__row"), "__row", "left_anti").drop("__row")
        good.write.mode("overwrite").parquet(f"{path}/batch={number}")
        if rules:
            bad.unpersist()
            batch.unpersist()
        if on_batch:
            on_batch(number)

    return df.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
