"""The log's index: what a segment's summary holds, spans, coverage, retention."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..model import DELETES, INSERTS, UPDATES

#: Version of summaries, and bytes between spans that still join (fixed values).
VERSION = 12
GAP = 8192


def build_summary(records: DataFrame) -> dict[str, DataFrame]:
    """Sections of the summaries of all segments in ``records`` (segno, rel, kind, lsn, end_lsn, xid,
    and optionally outcome, commit_ts, top_xid, reason, block): relations, their spans, outcomes,
    assignments, touched transactions, unsafe facts, block anchors and the places of records that carry
    rows, each keyed by segno."""
    have = set(records.columns)
    out = {
        "spans": merge_spans(records.where("rel is not null").select("segno", "rel", F.col("lsn").alias("start_lsn"), F.col("end_lsn"))),
        "touched": records.where("xid is not null and rel is not null").select("segno", "rel", "xid").distinct(),
        "relations": records.where("rel is not null").groupBy("segno", "rel").agg(F.min("lsn").alias("first_lsn"), F.max("lsn").alias("last_lsn"), F.count("*").alias("records")),
        "payloads": records.where(F.col("rel").isNotNull() & F.col("kind").isin(*INSERTS, *UPDATES, *DELETES)).select("segno", "rel", "lsn", "end_lsn"),
    }
    if {"outcome", "commit_ts"} <= have:
        out["outcomes"] = records.where("outcome is not null").groupBy("segno", "xid").agg(F.max_by("outcome", "lsn").alias("outcome"), F.max("commit_ts").alias("commit_ts"))
    if "top_xid" in have:
        out["assignments"] = records.where("top_xid is not null and top_xid <> xid").select("segno", F.col("xid").alias("subxid"), "top_xid").distinct()
    if "reason" in have:
        out["unsafe"] = records.where("reason is not null").select("segno", "rel", "reason", "xid", "lsn").distinct()
    if "block" in have:
        image = F.col("kind").isin("xlog_fpi", "xlog_fpi_for_hint")
        out["anchors"] = records.where(image).groupBy("segno", "rel", "block").agg(F.max("lsn").alias("image_lsn"))
    return {k: v.withColumn("version", F.lit(VERSION)) for k, v in out.items()}


def merge_spans(spans: DataFrame, gap: int = GAP) -> DataFrame:
    """Spans (segno, rel, start_lsn, end_lsn): one that starts at most ``gap`` bytes behind the end of
    those before it joins them: a session per segment and relation. Empty spans and spans without an end are left out."""
    spans = spans.where("start_lsn < end_lsn")
    own = Window.partitionBy("segno", "rel").orderBy("start_lsn", "end_lsn")
    reach = F.max("end_lsn").over(own.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(reach.isNull() | (F.col("start_lsn") > reach + gap), 1).otherwise(0)
    run = spans.withColumn("__new", new).withColumn("__run", F.sum("__new").over(own.rowsBetween(Window.unboundedPreceding, 0)))
    return run.groupBy("segno", "rel", "__run").agg(F.min("start_lsn").alias("start_lsn"), F.max("end_lsn").alias("end_lsn"), F.count("*").alias("hits")).drop("__run")


def prune_segments(segments: DataFrame, relations: DataFrame, rel: str, from_lsn: int | None = None) -> DataFrame:
    """Segments that may hold records of the relation: those whose summary (of this version) says
    so, and those without one."""
    fresh = relations.where(F.col("version") == VERSION)
    hit = fresh.where((F.col("rel") == rel) & (F.col("last_lsn") >= (from_lsn or 0))).select("segno").distinct()
    built = fresh.select("segno").distinct()
    return segments.join(built, "segno", "left_anti").unionByName(segments.join(hit, "segno", "left_semi"))


def queue(segments: DataFrame, built: DataFrame, workers: int = 2) -> DataFrame:
    """Segments without a summary, newest first; hot are the newest max(32, 16 workers)."""
    place = F.row_number().over(Window.orderBy(F.desc("segno")))
    ranked = segments.select("segno").distinct().withColumn("place", place)
    return ranked.join(built.select("segno").distinct(), "segno", "left_anti").select("segno", (F.col("place") <= max(32, 16 * workers)).alias("hot")).orderBy(F.desc("segno"))


def retention(files: DataFrame, limit_bytes: int, low_percent: int = 80) -> DataFrame:
    """Summaries (segno, bytes, protected) to delete: none within the limit, else the oldest that are
    not protected until what is left is at most ``low_percent`` of it."""
    order = Window.orderBy("segno").rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum("bytes").over(Window.partitionBy())
    freed = F.coalesce(F.sum(F.when(~F.col("protected"), F.col("bytes")).otherwise(0)).over(order), F.lit(0))
    return files.withColumns({"__total": total, "__freed": freed}).where(~F.col("protected") & (F.col("__total") > limit_bytes) & (F.col("__total") - F.col("__freed") > limit_bytes * low_percent / 100)).select("segno", "bytes")


def progress(segments: DataFrame, built: DataFrame, *, timeline: int | None = None, bounds: tuple[int, int] | None = None, service_enabled: bool = True, state: dict | None = None, hint: dict | None = None, now: dt.datetime | None = None) -> DataFrame:
    """One row on how far the index covers the log. ``segments`` has segno, oldest_ts and newest_ts
    of each visible segment, ``built`` the segno of those with a summary; times of a segment without one are not known.

    Percent: built over the newest less the oldest number plus one (100 without segments); bounds
    are those a service published, else the visible ones. Missing: visible without a summary, holes
    between visible numbers, and published ends that are not visible. From each end the covered run
    stops at the first hole or segment without a summary; the time of that gap is the nearer one of the
    covered segment beside it. A published end that is not visible is the gap itself, without times.
    ``state`` (published_at, builds, elapsed seconds, oldest and newest, and kept: external or memory) and ``hint``
    (the last query's counts) are what a service keeps; a state older than ten seconds is stale; five seconds of it
    give an estimate of the end."""
    state, hint = state or {}, hint or {}
    if bounds is None and state.get("oldest") is not None:
        bounds = (state["oldest"], state["newest"])
    have = built.select("segno").distinct().withColumn("built", F.lit(True))
    rows = segments.groupBy("segno").agg(F.min("oldest_ts").alias("oldest_ts"), F.max("newest_ts").alias("newest_ts")).join(have, "segno", "left").withColumn("built", F.coalesce("built", F.lit(False)))
    rows = rows.withColumns({c: F.when(F.col("built"), F.col(c)) for c in ("oldest_ts", "newest_ts")})
    if bounds is not None:
        rows = rows.where(F.col("segno").between(*bounds))
    low, high = Window.orderBy("segno"), Window.orderBy(F.desc("segno"))  # a row a segment
    rows = rows.withColumns({"prev": F.lag("segno").over(low), "next": F.lead("segno").over(low), "below_ts": F.lag("newest_ts").over(low), "above_ts": F.lead("oldest_ts").over(low)})
    rows = rows.withColumns({
        "up_break": F.when(F.col("segno") - F.col("prev") > 1, F.col("prev") + 1).when(~F.col("built"), F.col("segno")),
        "down_break": F.when(F.col("next") - F.col("segno") > 1, F.col("next") - 1).when(~F.col("built"), F.col("segno")),
    })
    rows = rows.withColumns({
        "up_ok": F.count("up_break").over(low.rowsBetween(Window.unboundedPreceding, 0)) == 0,
        "down_ok": F.count("down_break").over(high.rowsBetween(Window.unboundedPreceding, 0)) == 0,
    })
    known = lambda c: F.when(F.col(c).isNotNull(), F.col("segno"))
    agg = rows.agg(
        F.min("segno").alias("lo"), F.max("segno").alias("hi"), F.count("*").alias("visible"), F.sum(F.col("built").cast("long")).alias("completed"),
        F.min_by("oldest_ts", known("oldest_ts")).alias("stable_oldest_ts"), F.max_by("newest_ts", known("newest_ts")).alias("stable_newest_ts"),
        F.min(F.when(F.col("down_ok"), F.col("oldest_ts"))).alias("near"), F.max(F.when(F.col("up_ok"), F.col("newest_ts"))).alias("far"),
        F.max("down_break").alias("gap_new"), F.min("up_break").alias("gap_old"),
        F.max_by("above_ts", known("down_break")).alias("gap_new_ts"), F.min_by("below_ts", known("up_break")).alias("gap_old_ts"),
    )
    if bounds is not None:  # a published end that is not visible
        cut_new, cut_old = F.coalesce(F.col("hi") < bounds[1], F.lit(True)), F.coalesce(F.col("lo") > bounds[0], F.lit(True))
        agg = agg.withColumns({
            "gap_new": F.when(cut_new, F.lit(bounds[1]).cast("long")).otherwise(F.col("gap_new")), "gap_old": F.when(cut_old, F.lit(bounds[0]).cast("long")).otherwise(F.col("gap_old")),
            **{c: F.when(~cut_new, F.col(c)) for c in ("near", "gap_new_ts")}, **{c: F.when(~cut_old, F.col(c)) for c in ("far", "gap_old_ts")},
        })
    lo = F.lit(bounds[0]).cast("long") if bounds else F.col("lo")
    hi = F.lit(bounds[1]).cast("long") if bounds else F.col("hi")
    size = hi - lo + 1
    done = F.coalesce("completed", F.lit(0))
    missing = F.coalesce(size - done, F.lit(0))
    published = state.get("published_at")
    now = now or dt.datetime.now()
    stale = published is not None and (now - published).total_seconds() > 10
    rate = state["builds"] / state["elapsed"] if state.get("elapsed", 0) >= 5 and state.get("builds") else None
    eta = F.lit(None).cast("timestamp") if rate is None else (F.lit(now).cast("timestamp") + F.make_dt_interval(secs=missing / F.lit(rate)))
    none = lambda kind: F.lit(None).cast(kind)
    return agg.select(
        F.lit(service_enabled).alias("service_enabled"), F.lit(timeline).cast("int").alias("timeline_id"), lo.alias("stable_oldest_segno"), hi.alias("stable_newest_segno"),
        "stable_oldest_ts", "stable_newest_ts", F.col("near").alias("near_contiguous_through_ts"), F.col("far").alias("far_contiguous_until_ts"),
        F.col("gap_new").alias("first_gap_from_newest_segno"), F.col("gap_new_ts").alias("first_gap_from_newest_ts"), F.col("gap_old").alias("first_gap_from_oldest_segno"), F.col("gap_old_ts").alias("first_gap_from_oldest_ts"),
        done.alias("completed_segments"), missing.alias("missing_segments"), F.when((F.col("visible") == 0) & F.lit(bounds is None), F.lit(100.0)).otherwise(done * F.lit(100.0) / size).alias("progress_pct"),
        (F.lit(hint["observed_at"]).cast("timestamp") if hint else none("timestamp")).alias("last_query_observed_at"), (F.lit(hint["span_fallback"] == 0) if hint else none("boolean")).alias("last_query_summary_ready"),
        F.lit(hint.get("span_fallback")).cast("long").alias("last_query_summary_span_fallback_segments"), F.lit(hint.get("metadata_fallback")).cast("long").alias("last_query_metadata_fallback_segments"),
        F.when(missing > 0, eta).alias("estimated_completion_at"), F.lit(state.get("kept", "external") if published else "none").alias("state_source"), F.lit(published is not None).alias("daemon_state_present"), F.lit(stale).alias("daemon_state_stale"),
        (F.lit(published).cast("timestamp") if published else none("timestamp")).alias("daemon_state_published_at"),
    )
