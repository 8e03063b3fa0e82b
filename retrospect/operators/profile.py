"""What happened in a window: counts of records by kind."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rounding import percent
from ..model import DELETES, GROUPS, INSERTS, KINDS, NOT_COUNTED

GROUP_NAMES = ("insert", "update", "delete", "vacuum", "other")


def kind_counts(op_log: DataFrame, anchor_lsn: int = 0, rels: tuple | None = None) -> DataFrame:
    """(op_kind, op_count), of records from the anchor on that carry no transaction or one to be
    undone (column undo); ``rels`` limits them to a relation and its side relation. A record counts once, however many rows it has (column record_no, if the
    log has it); speculative inserts, deletes that take them back, locks and visibility do not."""
    flag = lambda c: F.coalesce(F.col(c), F.lit(False)) if c in op_log.columns else F.lit(False)
    kind = F.col("kind")
    counted = ~kind.isin(*NOT_COUNTED) & ~(kind.isin(*INSERTS[:1]) & flag("speculative")) & ~(kind.isin(*DELETES) & flag("super_delete"))
    seen = op_log.where((F.col("lsn") >= anchor_lsn) & counted & (F.col("xid").isNull() | (F.col("xid") == 0) | F.col("undo")))
    if rels is not None:
        seen = seen.where(F.col("rel").isin(*rels))
    if "record_no" in op_log.columns:
        seen = seen.select("record_no", "kind").distinct()
    return seen.groupBy(kind.alias("op_kind")).agg(F.count("*").alias("op_count"))


def _group(kind):
    return F.coalesce(F.create_map(*[F.lit(x) for pair in GROUPS.items() for x in pair])[kind], F.lit("other"))


def profile_detail(op_log: DataFrame, target_ts, now_ts, anchor_lsn: int = 0, rels: tuple | None = None) -> DataFrame:
    """A row a kind that occurs: op_kind, op_group, op_count, op_pct, in the kinds' order."""
    counts = kind_counts(op_log, anchor_lsn, rels)
    rows = counts.withColumn("total", F.sum("op_count").over(Window.partitionBy()))  # at most 13 rows
    place = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("op_kind"))
    return rows.orderBy(place).select(F.lit(target_ts).cast("timestamp").alias("target_ts"), F.lit(now_ts).cast("timestamp").alias("query_now_ts"), "op_kind", _group(F.col("op_kind")).alias("op_group"), "op_count", percent(F.col("op_count") * 100.0 / F.col("total")).alias("op_pct"))


def profile_summary(op_log: DataFrame, target_ts, now_ts, anchor_lsn: int = 0, unsafe: DataFrame | None = None, rels: tuple | None = None) -> DataFrame:
    """One row: counts and percentages by group. A window with unsafe facts is not refused here:
    window_supported is false, unsafe_reason names the first fact, and the counts are zero."""
    reason = None
    if unsafe is not None:
        first = unsafe.orderBy("lsn").limit(1).collect()
        reason = first[0]["reason"] if first else None
    counts = kind_counts(op_log if reason is None else op_log.where("false"), anchor_lsn, rels)
    group = _group(F.col("op_kind"))
    sums = counts.agg(F.coalesce(F.sum("op_count"), F.lit(0)).alias("total_ops"), *[F.coalesce(F.sum(F.when(group == g, F.col("op_count"))), F.lit(0)).alias(f"{g}_ops") for g in GROUP_NAMES])
    share = lambda g: percent(F.when(F.col("total_ops") == 0, F.lit(0.0)).otherwise(F.col(f"{g}_ops") * 100.0 / F.col("total_ops"))).alias(f"{g}_pct")
    pairs = [c for g in GROUP_NAMES for c in (F.col(f"{g}_ops"), share(g))]
    return sums.select(F.lit(target_ts).cast("timestamp").alias("target_ts"), F.lit(now_ts).cast("timestamp").alias("query_now_ts"), F.lit(reason is None).alias("window_supported"), F.lit(reason).cast("string").alias("unsafe_reason"), "total_ops", *pairs)
