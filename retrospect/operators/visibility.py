"""Which record changes the target misses: outcomes, subtransactions, snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import DELETES, INSERTS, UPDATES, HistoryError


def parse_snapshot(text: str) -> tuple[int, int, list[int]]:
    """(xmin, xmax, running) of ``xmin:xmax:xip,xip,...``."""
    parts = (text or "").split(":")
    try:
        xmin, xmax = int(parts[0]), int(parts[1])
        running = [int(x) for x in parts[2].split(",") if x] if len(parts) == 3 else None
    except (ValueError, IndexError):
        running = None
    if running is None or not 0 < xmin <= xmax or any(not xmin <= x < xmax for x in running):
        raise HistoryError("invalid target snapshot")
    return xmin, xmax, running


def invisible_to(snapshot: str | None, xid="xid"):
    """Whether the snapshot did not see the transaction: it was running, or came later."""
    if not snapshot:
        return F.lit(False)
    _, xmax, running = parse_snapshot(snapshot)
    return F.coalesce(F.col(xid).isin(running) | (F.col(xid) >= xmax), F.lit(False))


def with_outcomes(op_log: DataFrame, xact_log: DataFrame | None, target_ts, now_ts, *, xid_assign: DataFrame | None = None, snapshot: str | None = None, clog: DataFrame | None = None, anchor_lsn: int | None = None) -> DataFrame:
    """Adds outcome, commit_ts, commit_lsn, ``undo`` (committed after the target, by time or
    unseen by the snapshot, and not after now) and ``before`` (committed by the target, and seen) to each record from the anchor on.

    A record's transaction is its top transaction: as logged, else as assigned, else its own. A log
    that carries outcome, commit_ts and commit_lsn itself needs no ``xact_log`` and no join. An
    outcome that is not logged is taken, where there is a snapshot, from ``clog``, at now if the
    snapshot missed it and at the target otherwise; without one it stays unknown and undoes nothing."""
    ops = op_log if anchor_lsn is None else op_log.where(F.col("lsn") >= anchor_lsn)
    if xid_assign is not None:
        sub = xid_assign.select(F.col("subxid").alias("__sub"), F.col("top_xid").alias("__top"))
        ops = ops.join(sub, ops["xid"] == F.col("__sub"), "left").drop("__sub")
    else:
        ops = ops.withColumn("__top", F.lit(None).cast("long"))
    own = F.col("top_xid") if "top_xid" in op_log.columns else F.lit(None).cast("long")
    ops = ops.withColumn("__xid", F.coalesce(own, F.col("__top"), F.col("xid"))).drop("__top")
    if xact_log is not None:
        # the last word on a transaction, however often it is logged
        known = xact_log.groupBy(F.col("xid").alias("__x")).agg(F.max(F.struct("commit_lsn", "commit_ts", "outcome")).alias("__o")).select("__x", "__o.outcome", "__o.commit_ts", "__o.commit_lsn")
        ops = ops.drop("outcome", "commit_ts", "commit_lsn").join(known, F.col("__xid") == F.col("__x"), "left").drop("__x")
    unseen = invisible_to(snapshot, "__xid")
    if snapshot and clog is not None:
        past = clog.select(F.col("xid").alias("__x"), F.col("outcome").alias("__outcome"))
        ops = ops.join(past, F.col("__xid") == F.col("__x"), "left").drop("__x")
        lost = F.col("outcome").isNull() & F.col("__outcome").isNotNull()
        stamp = F.when(unseen, F.lit(now_ts)).otherwise(F.lit(target_ts)).cast(ops.schema["commit_ts"].dataType)
        ops = ops.withColumns({"commit_ts": F.when(lost, stamp).otherwise(F.col("commit_ts")), "outcome": F.coalesce("outcome", "__outcome")}).drop("__outcome")
    # a transaction without a logged commit has no place of its own in the log: the record's counts
    place = F.coalesce(F.when(F.col("commit_lsn") != 0, F.col("commit_lsn")), F.col("lsn"))
    undo = (F.col("outcome") == "committed") & (F.col("commit_ts") <= F.lit(now_ts)) & (unseen | (F.col("commit_ts") > F.lit(target_ts)))
    before = (F.col("outcome") == "committed") & ~unseen & (F.col("commit_ts") <= F.lit(target_ts))
    return ops.withColumns({"commit_lsn": place, "undo": F.coalesce(undo, F.lit(False)), "before": F.coalesce(before, F.lit(False))}).withColumnRenamed("__xid", "resolved_xid")


def row_changes(op_log: DataFrame, rel: str | None = None) -> DataFrame:
    """Records that change rows of the relation: speculative inserts and the deletes that take them
    back are none, nor are locks, pruning and page images."""
    flag = lambda c: F.coalesce(F.col(c), F.lit(False)) if c in op_log.columns else F.lit(False)
    kind = F.col("kind")
    keep = kind.isin(*INSERTS) & ~flag("speculative") | kind.isin(*DELETES) & ~flag("super_delete") | kind.isin(*UPDATES)
    return op_log.where(keep if rel is None else keep & (F.col("rel") == rel))


def reverse_ops(changes: DataFrame) -> DataFrame:
    """The inverse of each change: an insert is removed, a delete added back, an update replaced. Rows
    come in no order; ``newest_first`` gives that of applying them one by one."""
    kind = F.col("kind")
    op = F.when(kind.isin(*INSERTS), "remove").when(kind.isin(*DELETES), "add").otherwise("replace")
    return changes.select(op.alias("reverse_op"), "commit_lsn", "lsn", F.when(kind.isin(*INSERTS), None).otherwise(F.col("old_row")).alias("old_row"), F.when(kind.isin(*DELETES), None).otherwise(F.col("new_row")).alias("new_row"))


def newest_first(reverse: DataFrame) -> DataFrame:
    """Reverse changes in the order in which they would be applied one after the other."""
    return reverse.orderBy(F.desc("commit_lsn"), F.desc("lsn"))
