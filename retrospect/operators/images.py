"""Row images: before-images out of after-image logs, and large values out of chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..model import DELETES, INSERTS, UPDATES

#: Kinds that give a row's version without being a change of it.
VERSIONS = ("heap_inplace", "xlog_fpi", "xlog_fpi_for_hint")


def explode_tuples(records: DataFrame) -> DataFrame:
    """A row a tuple of records that carry several (row_ids and images, of equal length): row_id and
    image beside the record's other columns."""
    return records.withColumn("__t", F.explode(F.arrays_zip("row_ids", "images"))).select(*[c for c in records.columns if c not in ("row_ids", "images")], F.col("__t.row_ids").alias("row_id"), F.col("__t.images").alias("image"))


def before_images(base: DataFrame, after: DataFrame, older: DataFrame | None = None) -> DataFrame:
    """Adds old_row to a log of after-images: ``after`` has row_id, lsn, kind, image (null for a
    delete); ``base`` has row_id and image at the anchor, ``older`` (row_id, image) what an older base
    held of rows that it lacks. The row's version before is the latest one by lsn.

    Changes in place and images of whole pages are versions but no changes, and have no row in the
    result; locks, confirmations, visibility and pruning are neither. An update or delete
    without a version before it raises when run. Aborted changes must be out."""
    seed = lambda rows, lsn: rows.select("row_id", F.lit(lsn).cast("long").alias("lsn"), F.lit(None).cast("string").alias("kind"), "image")
    rows = seed(base, -1) if older is None else seed(base, -1).unionByName(seed(older, -2))
    rows = rows.unionByName(after.where(F.col("kind").isin(*INSERTS, *UPDATES, *DELETES, *VERSIONS)).select("row_id", "lsn", "kind", "image"))
    order = Window.partitionBy("row_id").orderBy("lsn")
    old = F.lag("image").over(order)
    rows = rows.withColumn("old_row", old).where(F.col("kind").isin(*INSERTS, *UPDATES, *DELETES))
    lost = ~F.col("kind").isin(*INSERTS) & F.col("old_row").isNull()
    message = F.concat(F.lit("missing base image for row "), F.col("row_id").cast("string"))
    checked = F.when(lost, F.raise_error(message).cast(rows.schema["old_row"].dataType)).otherwise(F.col("old_row"))
    return rows.select("row_id", "lsn", "kind", checked.alias("old_row"), F.col("image").alias("new_row"))


def reassemble(chunks: DataFrame, live: DataFrame | None = None, sizes: DataFrame | None = None) -> DataFrame:
    """(value_id, value) from (value_id, chunk_seq, data). A chunk that history lacks comes from
    ``live``. Sequence numbers must run from 0 without a hole, and the length must be that of
    ``sizes`` (value_id, size) where given, which must name the same values; else this raises when run. A group is one value."""
    parts = chunks.select("value_id", "chunk_seq", "data")
    if live is not None:
        more = live.select("value_id", "chunk_seq", "data").join(parts, ["value_id", "chunk_seq"], "left_anti")
        parts = parts.unionByName(more.join(chunks.select("value_id").distinct(), "value_id", "left_semi"))
    whole = parts.groupBy("value_id").agg(F.array_sort(F.collect_list(F.struct("chunk_seq", "data"))).alias("c"))
    joined = F.aggregate("c", F.lit(b"").cast("binary"), lambda acc, x: F.concat(acc, x["data"]))
    hole = (F.element_at("c", -1)["chunk_seq"] != F.size("c") - 1) | (F.element_at("c", 1)["chunk_seq"] != 0)
    message = F.concat(F.lit("missing chunk for value "), F.col("value_id").cast("string"))
    out = whole.select("value_id", F.when(hole, F.raise_error(message).cast("binary")).otherwise(joined).alias("value"))
    if sizes is not None:
        out = out.join(sizes, "value_id", "full")
        said = lambda text: F.raise_error(F.concat(F.lit(text), F.col("value_id").cast("string"))).cast("binary")
        value = F.when(F.col("value").isNull(), said("missing chunk for value ")).when(F.col("size").isNull(), said("no length known of value "))
        out = out.select("value_id", value.when(F.octet_length("value") != F.col("size"), said("wrong length for value ")).otherwise(F.col("value")).alias("value"))
    return out
