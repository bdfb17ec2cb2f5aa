"""File versions as state: a stream of file sightings becomes a stream of changes, numbered by path.

A path's state is its latest size, time and version number. Sightings count in the order of their time and size; one that lies behind the state is new, and if its size differs from
the one before it is a change and gets the next version. A repeated or older one is none. Each batch is joined with the state of its paths and numbered in one window; what it
leaves as state is written behind that of the batches before, under its own number, so a repeated batch gives the same and a restarted query goes on where it was. Nothing but the
paths of a batch is written per batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import new_table

CHANGES = "path string, version long, size long, modified timestamp"
LOG = f"{CHANGES}, changed boolean, last boolean"


def changes(sightings: DataFrame, latest: DataFrame | None = None) -> DataFrame:
    """``LOG``: the changes among a batch of ``path, size, modified`` and each path's last sighting; rows without a path or a time are left out. latest: ``path, version, size, modified`` so far."""
    seen = sightings.filter("path IS NOT NULL AND modified IS NOT NULL").select("path", F.col("size").cast("long").alias("size"), "modified")
    if latest is None:
        seen = seen.withColumns({"known": F.lit(0).cast("long"), "known_size": F.lit(None).cast("long")})
    else:
        before = latest.select("path", F.col("version").alias("known"), F.col("size").alias("known_size"), F.col("modified").alias("known_modified"))
        behind = "modified > known_modified OR (modified = known_modified AND known_size IS NOT NULL AND (size IS NULL OR size > known_size))"
        seen = seen.join(before, "path", "left").filter(f"known IS NULL OR {behind}").withColumn("known", F.coalesce("known", F.lit(0).cast("long")))
    ordered = Window.partitionBy("path").orderBy("modified", F.asc_nulls_last("size"))
    placed = seen.withColumns({"prior": F.when(F.row_number().over(ordered) == 1, F.col("known_size")).otherwise(F.lag("size").over(ordered)), "last": F.lead("path").over(ordered).isNull()})
    marked = placed.withColumn("changed", F.coalesce(F.col("prior").isNull() | (F.col("prior") != F.col("size")), F.lit(False)))
    number = F.col("known") + F.sum(F.col("changed").cast("long")).over(ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return marked.withColumn("version", number).filter("changed OR last").select("path", "version", "size", "modified", "changed", "last")


def follow_changes(sightings: DataFrame, folder: str, checkpoint: str) -> None:
    """Reads what has arrived since the checkpoint and adds the changes to ``folder``, in a folder ``batch=n`` for each batch."""
    log = f"{checkpoint}/log"

    def merge(batch: DataFrame, number: int) -> None:
        spark, latest = batch.sparkSession, None
        if number:
            last = spark.read.schema(f"{LOG}, batch long").parquet(log).filter(F.col("batch") < number).filter("last")
            row = F.max_by(F.struct("version", "size", "modified"), "batch").alias("row")
            latest = last.join(batch.select("path").distinct(), "path", "left_semi").groupBy("path").agg(row).select("path", "row.*")
        changes(batch, latest).write.mode("overwrite").parquet(f"{log}/batch={number}")
        found = spark.read.schema(LOG).parquet(f"{log}/batch={number}").filter("changed")
        found.select("path", "version", "size", "modified").write.mode("overwrite").parquet(f"{folder}/batch={number}")

    sightings.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def changes_now(sightings: DataFrame) -> DataFrame:
    """The changes of all that has arrived, as a table."""
    spark = sightings.sparkSession
    folder, checkpoint = new_table(spark), new_table(spark)
    follow_changes(sightings, folder, checkpoint)
    return spark.read.schema(f"{CHANGES}, batch long").parquet(folder).select("path", "version", "size", "modified")
