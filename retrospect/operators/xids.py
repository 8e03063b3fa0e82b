"""Transactions whose outcome the summaries do not tell, and how they were resolved."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def unresolved_xids(touched: DataFrame, unsafe: DataFrame, outcomes: DataFrame, assignments: DataFrame, xact_log: DataFrame, missing_segments: int = 0, fallback_windows: int = 0, probed: bool = True) -> DataFrame:
    """A row for each touched or unsafe transaction that summaries leave open.

    ``touched`` and ``unsafe`` have xid. ``outcomes`` (xid, outcome, commit_ts, in_span) and
    ``assignments`` (subxid, top_xid, in_span) are what summaries hold, inside or outside the spans
    that were read; ``xact_log`` (xid, outcome, commit_ts, in_window) is the exact log, in the
    windows read first or elsewhere. A transaction is resolved by a summary if its own outcome, or
    that of the top transaction it is assigned to, lies in a span. diag tells all that was found as
    name=value, in a fixed order."""
    sides = touched.select("xid", F.lit(0).alias("u"), F.lit(1).alias("t")).unionByName(unsafe.select("xid", F.lit(1).alias("u"), F.lit(0).alias("t")))
    both = sides.where("xid is not null").groupBy("xid").agg(F.max("u").alias("u"), F.max("t").alias("t"))
    own = outcomes.groupBy("xid").agg(F.max("in_span").alias("o_in"), F.max("commit_ts").alias("o_ts"))
    up = assignments.groupBy(F.col("subxid").alias("xid")).agg(F.max("top_xid").alias("top_xid"), F.max("in_span").alias("a_in"))
    top = own.select(F.col("xid").alias("top_xid"), F.col("o_in").alias("t_in"), F.col("o_ts").alias("t_ts"))
    exact = xact_log.groupBy("xid").agg(F.max("in_window").alias("in_window"), F.max("commit_ts").alias("x_ts"))
    rows = both.join(own, "xid", "left").join(up, "xid", "left").join(top, "top_xid", "left").join(exact, "xid", "left")
    rows = rows.join(exact.select(F.col("xid").alias("top_xid"), F.col("in_window").alias("tw"), F.col("x_ts").alias("tx_ts")), "top_xid", "left")
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    rows = rows.where(~(yes("o_in") | (yes("a_in") & yes("t_in"))))
    found = F.coalesce("in_window", "tw")
    resolved = F.when(found.isNull(), "unresolved").when(yes("in_window") | yes("tw"), "exact_window").otherwise("exact_all")
    own_any, up_any, top_any = F.col("o_in").isNotNull(), F.col("top_xid").isNotNull(), F.col("t_in").isNotNull()
    why = (
        F.when(F.col("u") == 1, "unsafe_xid").when(F.lit(not probed), "raw_xact_fallback").when(F.lit(missing_segments > 0), "summary_missing_segment")
        .when(~yes("o_in") & own_any, "summary_outcome_outside_span").when(~yes("a_in") & up_any, "summary_assignment_outside_span")
        .when(up_any & ~top_any, "summary_missing_top_outcome").when(~up_any, "summary_missing_assignment").when(~own_any, "summary_missing_outcome").otherwise("raw_xact_fallback")
    )
    role = F.when(F.col("u") == 1, "unsafe").when(F.col("t") == 1, "touched").otherwise("unknown")
    ts = F.coalesce("x_ts", "o_ts", "tx_ts", "t_ts")
    said = lambda c: F.when(c, "true").otherwise("false")
    pairs = {
        "xid": F.col("xid").cast("string"), "xid_role": role, "unresolved_after_summary": F.lit("true"), "unresolved_after_exact_windows": said(resolved != "exact_window"),
        "unresolved_after_exact_all": said(resolved == "unresolved"), "fallback_reason": why, "fallback_windows": F.lit(str(fallback_windows)), "summary_missing_segments": F.lit(str(missing_segments)),
        "touched_in_metadata": said(F.col("t") == 1), "span_outcome_found": said(yes("o_in")), "all_outcome_found": said(own_any), "span_assignment_found": said(yes("a_in")),
        "all_assignment_found": said(up_any), "top_outcome_found": said(top_any), "top_xid": F.coalesce(F.col("top_xid").cast("string"), F.lit("0")),
        "commit_ts_known": said(ts.isNotNull()), "commit_ts": F.coalesce(ts.cast("string"), F.lit("null")),
    }
    diag = F.concat_ws(" ", *[F.concat(F.lit(f"{k}="), v) for k, v in pairs.items()])
    return rows.select("xid", role.alias("xid_role"), resolved.alias("resolved_by"), why.alias("fallback_reason"), "top_xid", ts.alias("commit_ts"), F.lit(missing_segments).alias("summary_missing_segments"), F.lit(fallback_windows).alias("fallback_windows"), diag.alias("diag"))
