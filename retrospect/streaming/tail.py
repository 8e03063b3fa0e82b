"""The log's tail as a stream: summaries built as segments arrive, and late ones too."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..operators.summary import build_summary


def tail(spark, path: str, schema, late: str | None = None) -> DataFrame:
    """Records of new Parquet files under ``path``. With ``late``, a record logged twice within it
    counts once, and records later than it are left out; without, none is."""
    rows = spark.readStream.schema(schema).parquet(path)
    if late:
        rows = rows.withWatermark("commit_ts", late).dropDuplicatesWithinWatermark(["lsn", "kind"])
    return rows


def summarize_stream(records: DataFrame, out: str, checkpoint: str, **trigger):
    """Builds the summaries of the segments that each batch touches, under ``out``/<section>, one folder
    a segment. A batch's records are kept under ``out``/records by batch and segment, and a segment's
    summary is made of all of its records so far: one that is split over batches, or comes again
    late, is whole after each of them, and a batch that is repeated replaces its own records only.
    Sections have Parquet's Bloom filters on the relation. Triggers as in writeStream.trigger
    (availableNow by default)."""
    schema = StructType([*records.schema.fields, StructField("batch", LongType())])

    def one(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        batch.write.mode("overwrite").partitionBy("segno").parquet(f"{out}/records/batch={epoch}")
        stored = spark.read.schema(schema).parquet(f"{out}/records")
        touched = [r[0] for r in stored.where(F.col("batch") == epoch).select("segno").distinct().collect()]  # of one batch
        if not touched:
            return
        own = stored.where(F.col("segno").isin(touched)).drop("batch").distinct()  # a segment that comes again brings the same records
        for name, section in build_summary(own).items():
            section.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("parquet.bloom.filter.enabled#rel", "true").partitionBy("segno").parquet(f"{out}/{name}")

    return records.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def ops_per_window(records: DataFrame, width: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Records by kind and event-time window, closed once the watermark has passed."""
    return records.withWatermark("commit_ts", late).groupBy(F.window("commit_ts", width), "kind").agg(F.count("*").alias("n"))
