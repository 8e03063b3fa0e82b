"""Reads a log of row changes: what columns it must have, and what they must hold."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType, TimestampType

from ..model import KINDS, HistoryError

#: Columns of a log beside old_row and new_row, which are structs of the table's columns.
REQUIRED = {"kind": StringType(), "lsn": LongType(), "xid": LongType()}
OPTIONAL = {"rel": "string", "top_xid": "bigint", "speculative": "boolean", "super_delete": "boolean", "outcome": "string", "commit_ts": "timestamp", "commit_lsn": "bigint", "segno": "bigint", "record_no": "bigint"}


def log_schema(table: StructType) -> StructType:
    """The least that a log of changes of a table of this schema holds."""
    return StructType([*(StructField(n, t) for n, t in REQUIRED.items()), StructField("old_row", table), StructField("new_row", table)])


def as_op_log(rows: DataFrame, table: StructType, check_rows: bool = True) -> DataFrame:
    """``rows`` as a log for ``history``: columns that are missing, or that cannot be cast to their type
    without a loss, are refused at once; records of unknown kinds, and changes without the image
    that their kind asks for, raise when the log is read. Columns of other names are left out."""
    have = {f.name.lower(): f for f in rows.schema.fields}
    if missing := [n for n in (*REQUIRED, "old_row", "new_row") if n not in have]:
        raise HistoryError(f"the log lacks columns: {', '.join(missing)}")
    for side in ("old_row", "new_row"):
        kind = have[side].dataType
        if not isinstance(kind, StructType) or [f.name for f in kind.fields] != table.fieldNames():
            raise HistoryError(f"{side} has other columns than the table: its definition changed")
    casts = {n: t.simpleString() for n, t in REQUIRED.items()} | {n: t for n, t in OPTIONAL.items() if n in have}
    for n, to in casts.items():
        kind = have[n].dataType
        if to != kind.simpleString() and not (to == "bigint" and kind.simpleString() in ("int", "smallint", "tinyint")) and not (to == "timestamp" and not isinstance(kind, TimestampType) and kind.simpleString() == "timestamp_ntz"):
            raise HistoryError(f"the log's column {n} is {kind.simpleString()}, not {to}")
    out = rows.select(*[F.col(n).cast(t).alias(n) for n, t in casts.items()], *[F.col(s).cast(table).alias(s) for s in ("old_row", "new_row")])
    if not check_rows:
        return out
    kind, old, new = F.col("kind"), F.col("old_row").isNull(), F.col("new_row").isNull()
    wrong = F.when(F.coalesce(~kind.isin(*KINDS), F.lit(True)), F.concat(F.lit("unknown kind of record: "), F.coalesce(kind, F.lit("null"))))
    wrong = wrong.when(kind.isin("heap_insert", "heap2_multi_insert") & new, "an insert without a new row").when(kind.isin("heap_update", "heap_hot_update") & (old | new), "an update without both rows").when((kind == "heap_delete") & old, "a delete without an old row")
    return out.withColumn("kind", F.when(wrong.isNotNull(), F.raise_error(wrong).cast("string")).otherwise(kind))


def read_op_log(spark: SparkSession, path: str, table: StructType, kind: str = "parquet", check_rows: bool = True) -> DataFrame:
    """The log under ``path`` (Parquet, ORC, Avro where installed, or JSON, which is read by the schema that a log must have)."""
    reader = spark.read.format(kind)
    if kind == "json":
        reader = reader.schema(StructType([*log_schema(table).fields, *StructType.fromDDL(", ".join(f"{n} {t}" for n, t in OPTIONAL.items())).fields]))
    return as_op_log(reader.load(path), table, check_rows)
