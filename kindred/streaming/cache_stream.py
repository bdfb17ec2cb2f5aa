"""A file stream of newly read tracks kept in the scan cache (an addition: scanning itself is a batch)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from ..sources.scan import load_cache, save_cache, upsert


def follow(spark: SparkSession, folder: str, schema: StructType, cache_path: str, checkpoint: str):
    """Starts a query that upserts every batch of track files dropped into ``folder`` into the cache; a repeated batch changes nothing."""
    rows = spark.readStream.schema(schema).parquet(folder)

    def merge(batch: DataFrame, number: int) -> None:
        kept = StructType([f for f in schema.fields if f.name != "problems"])
        save_cache(upsert(load_cache(spark, cache_path, kept), batch.dropDuplicates(["path"])), cache_path)

    return rows.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
