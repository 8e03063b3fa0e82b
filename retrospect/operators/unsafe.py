"""Windows in which a table was truncated, rewritten or moved: no row history leads through them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import HistoryError


def facts_of_records(records: DataFrame, rel: str, side: str | None = None) -> DataFrame:
    """The facts (rel, scope, reason, storage_op, xid, lsn) that records of the log are for a relation or
    its ``side`` relation of large values. ``records`` has record, xid, lsn, rels (all relations it
    names), fork and truncates_heap. Truncation and rewriting of any of the two; storage made for the
    main fork; storage cut with the heap's flag; an exclusive lock taken on a standby."""
    kind, own = F.col("record"), [rel] if side is None else [rel, side]
    hit = F.array_intersect("rels", F.array(*map(F.lit, own)))
    known = records.where(F.size(hit) > 0).where(
        kind.isin("truncate", "rewrite", "standby_lock") | (kind == "smgr_create") & (F.col("fork") == "main") | (kind == "smgr_truncate") & F.coalesce("truncates_heap", F.lit(False))
    )
    reason = F.when(kind.isin("truncate", "rewrite"), kind).otherwise("storage_change")
    scope = F.when(F.array_contains(hit, rel), "main").otherwise("side")
    return known.select(F.lit(rel).alias("rel"), scope.alias("scope"), reason.alias("reason"), F.when(~kind.isin("truncate", "rewrite"), kind).alias("storage_op"), "xid", "lsn")


def unsafe_facts(unsafe_log: DataFrame, xact_log: DataFrame, target_ts, now_ts, rel: str | None = None) -> DataFrame:
    """Facts that forbid the window: their transaction committed in it, and they are not a lock
    taken on a standby nor the storage shrinking at its end."""
    facts = unsafe_log if rel is None else unsafe_log.where(F.col("rel") == rel)
    harmless = (F.col("reason") == "storage_change") & F.coalesce(F.col("storage_op").isin("standby_lock", "smgr_truncate"), F.lit(False))
    done = xact_log.where((F.col("outcome") == "committed") & (F.col("commit_ts") > F.lit(target_ts)) & (F.col("commit_ts") <= F.lit(now_ts)))
    return facts.where(~harmless).join(done.groupBy("xid").agg(F.max("commit_ts").alias("commit_ts")), "xid").select("rel", "scope", "reason", "storage_op", "xid", "commit_ts", "lsn")


def refuse_unsafe(facts: DataFrame, target_ts) -> None:
    """Raises for the first such fact in the log, if there is one."""
    first = facts.orderBy("lsn").limit(1).collect()
    if first:
        f = first[0]
        raise HistoryError(
            f"history does not support log windows containing {f['reason']} operations: scope={f['scope']} operation={f['storage_op'] or f['reason']} "
            f"target={target_ts} table={f['rel']} xid={f['xid']} commit_ts={f['commit_ts']} lsn={f['lsn']}"
        )
