"""The past of a table: gates, the reverse changes, and how they are applied."""

from __future__ import annotations

import datetime as dt
import logging
import time

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import DELETES, INSERTS, UPDATES, HistoryError, RelationInfo, check_relation, preflight, settings
from ..operators.apply import apply_bag, apply_bag_many, apply_keyed, apply_keyed_many
from ..operators.summary import prune_segments
from ..operators.unsafe import refuse_unsafe, unsafe_facts
from ..operators.visibility import reverse_ops, row_changes, with_outcomes
from ..sources.segments import choose_segments, find_anchor, retained_suffix

log = logging.getLogger("retrospect")
STAGES = ("validating", "filtering the log", "building the change set", "applying")


class Progress:
    """Log lines ``[n/4 percent%] stage detail (+ms)`` and ``[done] total elapsed ms``."""

    def __init__(self, on: bool = True):
        self.on, self.began = on, time.perf_counter()
        self.last = self.began

    def stage(self, n: int, detail: str = "") -> None:
        if self.on:
            now = time.perf_counter()
            log.info("[%d/%d %d%%] %s%s (+%.3f ms)", n, len(STAGES), 100 * (n - 1) // len(STAGES), STAGES[n - 1], f" {detail}" if detail else "", 1e3 * (now - self.last))
            self.last = now

    def done(self) -> None:
        if self.on:
            log.info("[done] total elapsed %.3f ms", 1e3 * (time.perf_counter() - self.began))


def _moment(value, spark) -> dt.datetime:
    if value is None:
        raise HistoryError("target timestamp must not be NULL")
    if isinstance(value, str):
        value = spark.range(1).select(F.lit(value).cast("timestamp")).first()[0]
        if value is None:
            raise HistoryError("target timestamp is not a timestamp")
    return value


def _now(value, spark) -> tuple[dt.datetime, Column]:
    """Now, to compare targets with and to compare commits with. It may lie past the years that Python's
    datetimes hold (Spark's reach 294247), and is their last moment to targets then."""
    if isinstance(value, str) and spark.range(1).select(F.lit(value).cast("timestamp") >= F.lit("9999-12-31").cast("timestamp")).first()[0]:
        return dt.datetime.max, F.lit(value).cast("timestamp")
    value = _moment(value, spark) if value is not None else spark.range(1).select(F.current_timestamp()).first()[0]
    return value, F.lit(value)


def _condition(key_filter):
    return key_filter if isinstance(key_filter, Column) else F.expr(key_filter)


def check_key_filter(current: DataFrame, keys: list[str], key_filter) -> None:
    """Refuses conditions on anything but keys: an update may bring a row in or out of them."""
    empty = current.sparkSession.createDataFrame([], current.select(*keys).schema)
    try:
        empty.where(_condition(key_filter)).schema
    except AnalysisException as e:
        raise HistoryError(f"a key filter may use the key columns ({', '.join(keys)}) only: {key_filter}") from e


def reverse_changes(current: DataFrame, op_log: DataFrame, xact_log: DataFrame | None, target_ts, now_ts, *, rel: str | None = None, key_filter=None, **visible) -> DataFrame:
    """The reverse changes of a relation after the target. ``key_filter`` (SQL or a column, over key
    columns) also restricts them, before any shuffle: a change matters if its old or its new key passes."""
    changes = row_changes(op_log, rel)
    for side in ("old_row", "new_row"):
        kinds = [(f.name, f.dataType) for f in changes.schema[side].dataType.fields]
        if [n for n, _ in kinds] != current.columns:
            raise HistoryError(f"{side} has other columns than the table: its definition changed")
        if any(t != current.schema[n].dataType for n, t in kinds):
            raise HistoryError(f"{side} has other types than the table: its definition changed")
    if key_filter is not None:
        for side in ("old_row", "new_row"):  # the condition finds the side's columns under their own names
            apart = changes.select(F.struct(*changes.columns).alias("__change"), f"{side}.*")
            changes = apart.select("__change.*", F.coalesce(_condition(key_filter), F.lit(False)).alias(f"__{side}"))
        changes = changes.where("__old_row or __new_row").drop("__old_row", "__new_row")
    return reverse_ops(with_outcomes(changes, xact_log, target_ts, now_ts, **visible).where("undo"))


def history(
    current: DataFrame, op_log: DataFrame, target_ts, *, xact_log: DataFrame | None = None, keys: list[str] | tuple | None = None, relation: RelationInfo | None = None,
    now_ts=None, key_filter=None, verify: bool = True, snapshot: str | None = None, clog: DataFrame | None = None, xid_assign: DataFrame | None = None,
    checkpoints: DataFrame | None = None, retained_lsn: int | None = None, unsafe_log: DataFrame | None = None, segments: DataFrame | None = None,
    relations: DataFrame | None = None, created_ts=None, conf: dict | None = None,
) -> DataFrame:
    """The rows that ``current`` held at ``target_ts``, with its schema.

    ``op_log`` has kind, lsn, xid, old_row and new_row (structs with the table's columns), and where
    it applies rel, top_xid, speculative, super_delete, and outcome, commit_ts and commit_lsn if
    there is no ``xact_log``. Changes committed after the target and not after ``now_ts`` are undone.

    With ``keys`` (or a ``relation`` that has some) rows are found by key, nulls equal; without, the
    table is a multiset. ``key_filter`` (SQL or a column) is for conditions on key columns only: it reaches the scans
    of the table and of the log. Conditions on other columns belong on the result, as an update may
    bring a row in or out of them.

    ``segments`` are the log's files (``sources.segments.discover``): one a number is chosen, what lies
    before the newest gap cannot be started from, and a log with the column segno is read from chosen
    segments only, of which ``relations``, the index's section of that name, leaves those that may
    hold the relation's records. ``created_ts`` is when the table was made. ``conf`` holds settings
    (``model.settings``); with memory_limit among them the size of what has to be held is estimated first.

    Eager checks raise before any plan is returned: a target in the future, null or before the table
    was made, relations without row history, no checkpoint to start from, windows with truncation or
    rewriting, an estimate over the limit."""
    spark, conf = current.sparkSession, conf or {}
    own = settings(**conf)
    progress, snapshot = Progress(own["show_progress"]), snapshot or own["target_snapshot"]
    progress.stage(1)
    target = _moment(target_ts, spark)
    latest, now = _now(now_ts, spark)
    if target > latest:
        raise HistoryError("target timestamp is in the future")
    if created_ts is not None and _moment(created_ts, spark) > target:
        raise HistoryError("the table was made after the target")
    if relation is not None:
        check_relation(relation)
        keys = relation.keys if keys is None else keys
    if keys and key_filter is not None:
        check_key_filter(current, list(keys), key_filter)
    name = relation.name if relation is not None and "rel" in op_log.columns else None
    gap = None
    if segments is not None:
        chosen = choose_segments(segments)
        first, _, gap = retained_suffix(chosen)
        if "segno" in op_log.columns:
            kept = chosen.where(F.col("segno") >= first).select("segno")
            if relations is not None and relation is not None:
                kept = prune_segments(kept, relations, relation.name)
            op_log = op_log.join(kept, "segno", "left_semi")
    anchor = find_anchor(checkpoints, target, retained_lsn, gap)["redo_lsn"] if checkpoints is not None else None
    if unsafe_log is not None:
        refuse_unsafe(unsafe_facts(unsafe_log, xact_log if xact_log is not None else op_log, target, now, relation.name if relation else None), target)
    if "memory_limit" in conf:
        ops = row_changes(op_log, name).agg(F.count("*").alias("n"), F.count_if(F.col("kind").isin(*UPDATES)).alias("updates")).first()
        told = preflight(0, ops["n"], ops["updates"], 24 + 32 * len(current.columns), bool(keys), own["memory_limit"], own["spill_mode"])
        if told["spills"]:
            log.warning("estimated history working set of %d bytes exceeds the limit of %d: it is held on disk", told["estimate_bytes"], told["limit_bytes"])
    progress.stage(2)
    reverse = reverse_changes(current, op_log, xact_log, target, now, rel=name, key_filter=key_filter if keys else None, snapshot=snapshot, clog=clog, xid_assign=xid_assign, anchor_lsn=anchor)
    progress.stage(3)
    progress.stage(4, "by key" if keys else "as a multiset")
    if not keys:
        out = apply_bag(current, reverse)
    else:
        out = apply_keyed(current if key_filter is None else current.where(_condition(key_filter)), reverse, list(keys), verify)
    progress.done()
    return out if key_filter is None else out.where(_condition(key_filter))


def history_many(current: DataFrame, op_log: DataFrame, marks: dict, *, xact_log: DataFrame | None = None, keys: list[str] | tuple | None = None, now_ts=None) -> DataFrame:
    """The table at several targets at once, with a column label in front: ``marks`` maps labels to
    targets. Each change goes to the marks before it; a current row meets the changes once and goes to
    the marks for which none touched it. The log is read once for all. A table with a column label of its
    own, and no marks at all, are refused."""
    spark = current.sparkSession
    if not marks or "label" in current.columns:
        raise HistoryError("no targets" if not marks else "the table has a column label, which the result needs for its own")
    times = {k: _moment(v, spark) for k, v in marks.items()}
    latest, now = _now(now_ts, spark)
    if any(t > latest for t in times.values()):
        raise HistoryError("target timestamp is in the future")
    changes = with_outcomes(row_changes(op_log), xact_log, min(times.values()), now).where("undo")
    kind = changes.schema["commit_ts"].dataType
    array = F.array(*[F.struct(F.lit(k).alias("label"), F.lit(t).cast(kind).alias("ts")) for k, t in times.items()])
    later = changes.withColumn("__mark", F.explode(F.filter(array, lambda m: m["ts"] < F.col("commit_ts"))))
    reverse = _reverse_with_label(later)
    if keys:
        return apply_keyed_many(current, reverse, list(keys), list(times))
    return apply_bag_many(current, reverse, list(times))


def _reverse_with_label(changes: DataFrame) -> DataFrame:
    kind = F.col("kind")
    return changes.select(F.col("__mark.label").alias("label"), "commit_lsn", "lsn", F.when(~kind.isin(*INSERTS), F.col("old_row")).alias("old_row"), F.when(~kind.isin(*DELETES), F.col("new_row")).alias("new_row"))


def top_n(rows: DataFrame, key: str, n: int, descending: bool = False, offset: int = 0) -> DataFrame:
    """The first rows by key, nulls last when ascending and first when descending."""
    order = F.col(key).desc_nulls_first() if descending else F.col(key).asc_nulls_last()
    out = rows.orderBy(order).limit(n + offset)
    return out.orderBy(order).offset(offset).limit(n) if offset else out
