"""The engine's registered queries, and DuckDB SQL that gives the same rows without using the log
where the past can be told from how the log was made."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixtures as X
from ..functions.rounding import percent
from ..model import KINDS, Index, RelationInfo
from ..operators.apply import undo_delete_keys, undo_upserts
from ..operators.diff import diff
from ..operators.images import before_images, reassemble
from ..operators.profile import profile_detail, profile_summary
from ..operators.summary import VERSION, merge_spans, progress, prune_segments, queue, retention
from ..operators.unsafe import facts_of_records, unsafe_facts
from ..operators.visibility import with_outcomes
from ..operators.xids import unresolved_xids
from ..sources.segments import choose_segments, find_anchor, islands
from .history import history, history_many, reverse_changes, top_n

T, NOW = X.TARGET, X.NOW
AT = 5000

TRUTH = """
SELECT o_orderkey AS k, o_totalprice AS price FROM orders WHERE o_orderkey % 7 = 0 AND o_orderkey <= {t}
UNION ALL SELECT o_orderkey, CASE WHEN o_orderkey <= {t} THEN o_totalprice ELSE o_totalprice - 1 END FROM orders WHERE o_orderkey % 7 = 1
UNION ALL SELECT o_orderkey, CASE WHEN o_orderkey + 2000 <= {t} THEN o_totalprice WHEN o_orderkey <= {t} THEN o_totalprice - 1 ELSE o_totalprice - 2 END FROM orders WHERE o_orderkey % 7 = 2
UNION ALL SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey % 7 = 3 AND o_orderkey > {t}
UNION ALL SELECT CASE WHEN o_orderkey <= {t} THEN o_orderkey ELSE o_orderkey + 1000000 END, CASE WHEN o_orderkey <= {t} THEN o_totalprice ELSE o_totalprice - 1 END FROM orders WHERE o_orderkey % 7 = 4
UNION ALL SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey % 7 IN (5, 6)
UNION ALL SELECT o_orderkey + 2000000, o_totalprice FROM orders WHERE o_orderkey % 7 = 6 AND o_orderkey <= {t} AND o_orderkey + 3000 > {t}
"""
BAG_TRUTH = """
SELECT l_returnflag AS flag, l_linestatus AS status, CASE WHEN (l_orderkey + l_linenumber) % 5 = 1 AND l_orderkey > {t} THEN CAST(l_quantity AS INT) + 1 ELSE CAST(l_quantity AS INT) END AS qty
FROM lineitem WHERE NOT ((l_orderkey + l_linenumber) % 5 = 0 AND l_orderkey > {t}) AND NOT ((l_orderkey + l_linenumber) % 5 = 2 AND l_orderkey <= {t})
"""
#: The orders' log as rows (kind, minute, old key, old price, new key, new price, class).
LOG = """
SELECT 'heap_insert' AS kind, o_orderkey AS minute, NULL AS old_k, NULL AS old_price, o_orderkey AS new_k, o_totalprice AS new_price, 0 AS c FROM orders WHERE o_orderkey % 7 = 0
UNION ALL SELECT 'heap_update', o_orderkey, o_orderkey, o_totalprice - 1, o_orderkey, o_totalprice, 1 FROM orders WHERE o_orderkey % 7 = 1
UNION ALL SELECT 'heap_update', o_orderkey, o_orderkey, o_totalprice - 2, o_orderkey, o_totalprice - 1, 2 FROM orders WHERE o_orderkey % 7 = 2
UNION ALL SELECT 'heap_hot_update', o_orderkey + 2000, o_orderkey, o_totalprice - 1, o_orderkey, o_totalprice, 7 FROM orders WHERE o_orderkey % 7 = 2
UNION ALL SELECT 'heap_delete', o_orderkey, o_orderkey, o_totalprice, NULL, NULL, 3 FROM orders WHERE o_orderkey % 7 = 3
UNION ALL SELECT 'heap_update', o_orderkey, o_orderkey + 1000000, o_totalprice - 1, o_orderkey, o_totalprice, 4 FROM orders WHERE o_orderkey % 7 = 4
UNION ALL SELECT 'heap_insert', o_orderkey, NULL, NULL, o_orderkey + 2000000, o_totalprice, 6 FROM orders WHERE o_orderkey % 7 = 6
UNION ALL SELECT 'heap_delete', o_orderkey + 3000, o_orderkey + 2000000, o_totalprice, NULL, NULL, 11 FROM orders WHERE o_orderkey % 7 = 6
"""


def truth(t: int = AT) -> str:
    return TRUTH.format(t=t)


def moment(minutes: int) -> str:
    import datetime as dt

    return str(dt.datetime(2024, 1, 1) + dt.timedelta(minutes=minutes))


def past_orders(spark: SparkSession, sf_dir: str, t: str = T, **more) -> DataFrame:
    return _orders(history(X.orders_current(spark, sf_dir), X.orders_log(spark, sf_dir), t, keys=X.ORDERS_KEYS, now_ts=NOW, **more))


def _orders(past: DataFrame) -> DataFrame:
    """Orders without what tells rows of one number apart."""
    return past.drop("part")


def past_lines(spark: SparkSession, sf_dir: str, t: str = T) -> DataFrame:
    return history(X.lineitem_current(spark, sf_dir), X.lineitem_log(spark, sf_dir), t, now_ts=NOW)


def _reverse(spark, sf_dir):
    return reverse_changes(X.orders_current(spark, sf_dir), X.orders_log(spark, sf_dir), None, T, NOW)


Q: dict = {}
SQL: dict = {}


def query(name: str, sql: str | None = None):
    def register(f):
        Q[name] = f
        if sql:
            SQL[name] = sql
        return f

    return register


@query("keyed_history", truth())
def keyed_history(spark, d):
    return past_orders(spark, d)


@query("keyed_history_xacts", truth(2500))
def keyed_history_xacts(spark, d):
    """Outcomes in a table of their own, joined by transaction."""
    ops, xacts = X.split_log(X.orders_log(spark, d))
    return _orders(history(X.orders_current(spark, d), ops, moment(2500), xact_log=xacts, keys=X.ORDERS_KEYS, now_ts=NOW))


@query("bag_history", f"SELECT flag, status, qty, CAST(count(*) AS BIGINT) AS n FROM ({BAG_TRUTH.format(t=AT)}) GROUP BY flag, status, qty")
def bag_history(spark, d):
    return past_lines(spark, d).groupBy("flag", "status", "qty").agg(F.count("*").alias("n"))


@query("bag_rows", BAG_TRUTH.format(t=3000))
def bag_rows(spark, d):
    return past_lines(spark, d, moment(3000))


@query("key_eq", f"SELECT * FROM ({truth()}) WHERE k = 5489")
def key_eq(spark, d):
    return past_orders(spark, d, key_filter="k = 5489")


@query("key_in", f"SELECT * FROM ({truth()}) WHERE k IN (1, 5489, 1005001, 5001, 2004990)")
def key_in(spark, d):
    return past_orders(spark, d, key_filter="k IN (1, 5489, 5489, 1005001, 5001, 2004990)")


@query("key_range", f"SELECT * FROM ({truth()}) WHERE k > 4900 AND k <= 5300")
def key_range(spark, d):
    return past_orders(spark, d, key_filter="k > 4900 and k <= 5300")


@query("key_topn", f"SELECT * FROM ({truth()}) ORDER BY k DESC LIMIT 25")
def key_topn(spark, d):
    return top_n(past_orders(spark, d), "k", 25, descending=True)


@query("key_range_topn", f"SELECT * FROM ({truth()}) WHERE k > 2 AND k <= 6000 ORDER BY k DESC LIMIT 20 OFFSET 5")
def key_range_topn(spark, d):
    return top_n(past_orders(spark, d, key_filter="k > 2 and k <= 6000"), "k", 20, descending=True, offset=5)


@query("count_star", f"SELECT CAST(count(*) AS BIGINT) AS n FROM ({truth()})")
def count_star(spark, d):
    return past_orders(spark, d).agg(F.count("*").alias("n"))


@query("projection", f"SELECT k % 100 AS bucket, CAST(round(price) AS BIGINT) AS rounded FROM ({truth()}) WHERE price > 100000")
def projection(spark, d):
    return past_orders(spark, d).where("price > 100000").select((F.col("k") % 100).alias("bucket"), F.round("price").cast("long").alias("rounded"))


@query("full_output", f"SELECT * FROM ({truth(1)})")
def full_output(spark, d):
    return past_orders(spark, d, moment(1))


@query("join_customers", f"SELECT c_mktsegment AS segment, CAST(count(*) AS BIGINT) AS n FROM ({truth()}) p JOIN orders o ON o.o_orderkey = p.k JOIN customer c ON c.c_custkey = o.o_custkey GROUP BY c_mktsegment")
def join_customers(spark, d):
    past = past_orders(spark, d).select("k")
    orders, customers = X.table(spark, d, "orders").select("o_orderkey", "o_custkey"), X.table(spark, d, "customer").select("c_custkey", "c_mktsegment")
    return past.join(orders, F.col("k") == F.col("o_orderkey")).join(customers, F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("c_mktsegment").alias("segment")).agg(F.count("*").alias("n"))


@query("rollup_aggregates", f"SELECT flag, status, CAST(count(*) AS BIGINT) AS n, CAST(sum(qty) AS BIGINT) AS qty, min(qty) AS low, max(qty) AS high, CAST(count(*) FILTER (WHERE qty > 25) AS BIGINT) AS large FROM ({BAG_TRUTH.format(t=AT)}) GROUP BY ROLLUP (flag, status)")
def rollup_aggregates(spark, d):
    return past_lines(spark, d).rollup("flag", "status").agg(F.count("*").alias("n"), F.sum("qty").alias("qty"), F.min("qty").alias("low"), F.max("qty").alias("high"), F.count_if(F.col("qty") > 25).alias("large"))


@query("set_operations", f"SELECT k FROM ({truth(6000)}) EXCEPT ALL SELECT k FROM ({truth(4000)})")
def set_operations(spark, d):
    return past_orders(spark, d, moment(6000)).select("k").exceptAll(past_orders(spark, d, moment(4000)).select("k"))


@query("truth_diff", f"WITH a AS ({truth(6000)}), b AS ({truth(4000)}) SELECT 'left' AS side, *, CAST(1 AS BIGINT) AS times FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL SELECT 'right', *, CAST(1 AS BIGINT) FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)")
def truth_diff(spark, d):
    return diff(past_orders(spark, d, moment(6000)), past_orders(spark, d, moment(4000)))


@query("multi_target", " UNION ALL ".join(f"SELECT '{n}' AS label, * FROM ({truth(t)})" for n, t in (("early", 1000), ("middle", 5000), ("late", 9000))))
def multi_target(spark, d):
    marks = {"early": moment(1000), "middle": moment(5000), "late": moment(9000)}
    return _orders(history_many(X.orders_current(spark, d), X.orders_log(spark, d), marks, keys=X.ORDERS_KEYS, now_ts=NOW))


@query("multi_target_bag", " UNION ALL ".join(f"SELECT '{n}' AS label, flag, CAST(count(*) AS BIGINT) AS n, CAST(sum(qty) AS BIGINT) AS qty FROM ({BAG_TRUTH.format(t=t)}) GROUP BY flag" for n, t in (("early", 1000), ("late", 9000))))
def multi_target_bag(spark, d):
    past = history_many(X.lineitem_current(spark, d), X.lineitem_log(spark, d), {"early": moment(1000), "late": moment(9000)}, now_ts=NOW)
    return past.groupBy("label", "flag").agg(F.count("*").alias("n"), F.sum("qty").alias("qty"))


@query("reverse_ops", f"SELECT CASE WHEN old_k IS NULL THEN 'remove' WHEN new_k IS NULL THEN 'add' ELSE 'replace' END AS reverse_op, minute * 10 + 1 AS lsn, old_k, old_price, new_k, new_price FROM ({LOG}) WHERE minute > {AT}")
def reverse_operations(spark, d):
    return _reverse(spark, d).select("reverse_op", "lsn", F.col("old_row.k").alias("old_k"), F.col("old_row.price").alias("old_price"), F.col("new_row.k").alias("new_k"), F.col("new_row.price").alias("new_price"))


_FIRST = f"SELECT k, price, gone FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY minute, gone) AS n FROM (SELECT minute, new_k AS k, NULL AS price, 1 AS gone FROM ({LOG}) WHERE new_k IS NOT NULL AND minute > {AT} UNION ALL SELECT minute, old_k, old_price, 0 FROM ({LOG}) WHERE old_k IS NOT NULL AND minute > {AT})) WHERE n = 1"


@query("undo_upserts", f"SELECT k, price FROM ({_FIRST}) WHERE gone = 0")
def upserts(spark, d):
    """By number alone, as the SQL has it: the first change of either row decides where two bear one."""
    return _orders(undo_upserts(_reverse(spark, d), ["k"]))


@query("undo_delete_keys", f"SELECT k FROM ({_FIRST}) WHERE gone = 1")
def delete_keys(spark, d):
    return undo_delete_keys(_reverse(spark, d), ["k"])


@query("subtransactions", truth())
def subtransactions(spark, d):
    """Every change ran in a subtransaction; outcomes are logged for the top transactions only."""
    ops, xacts = X.split_log(X.orders_log(spark, d))
    sub = F.col("xid") + 10**12
    assign = xacts.select(sub.alias("subxid"), F.col("xid").alias("top_xid"))
    return _orders(history(X.orders_current(spark, d), ops.withColumn("xid", sub), T, xact_log=xacts, xid_assign=assign, keys=X.ORDERS_KEYS, now_ts=NOW))


@query("snapshot_override", truth())
def snapshot_override(spark, d):
    """By time only changes after minute 9000 would go; the snapshot missed those after 5000."""
    top = (AT * 10 + 1) * 100 + 99
    return past_orders(spark, d, moment(9000), snapshot=f"1:{top}:")


@query("snapshot_clog", truth())
def snapshot_clog(spark, d):
    """No outcome of even transactions is in the log; a table of outcomes has them."""
    ops, xacts = X.split_log(X.orders_log(spark, d))
    top = (AT * 10 + 1) * 100 + 99
    return _orders(history(X.orders_current(spark, d), ops, T, xact_log=xacts.where("xid % 2 = 1"), clog=xacts.select("xid", "outcome"), snapshot=f"1:{top}:", keys=X.ORDERS_KEYS, now_ts=NOW))


_ORDER = "CASE kind " + " ".join(f"WHEN '{k}' THEN {i}" for i, k in enumerate(KINDS)) + " END"
_EVENTS = """
SELECT event_id AS lsn, ts, event_id % 13 AS m, user_id % 10 = 0 AS aborted,
  ['""" + "', '".join(KINDS) + """'][event_id % 13 + 1] AS kind FROM events
"""
_COUNTED = f"""
SELECT kind AS op_kind, CASE WHEN kind IN ('heap_insert', 'heap2_multi_insert') THEN 'insert' WHEN kind IN ('heap_update', 'heap_hot_update', 'heap_inplace') THEN 'update'
  WHEN kind = 'heap_delete' THEN 'delete' WHEN kind = 'heap2_prune' THEN 'vacuum' ELSE 'other' END AS op_group, CAST(count(*) AS BIGINT) AS op_count
FROM ({_EVENTS}) WHERE lsn >= 100 AND m NOT IN (4, 5, 8, 10) AND (m IN (7, 11, 12) OR (NOT aborted AND ts > TIMESTAMP '2024-01-15 00:00:00')) GROUP BY ALL
"""
MIDDLE = "2024-01-15 00:00:00"


def _events(spark, d):
    return with_outcomes(X.events_log(spark, d), None, MIDDLE, NOW)


@query("profile_detail", f"SELECT op_kind, op_group, op_count, CAST(printf('%.2f', op_count * 100.0::DOUBLE / sum(op_count) OVER ()) AS DECIMAL(5,2)) AS op_pct FROM ({_COUNTED})")
def detail(spark, d):
    return profile_detail(_events(spark, d), MIDDLE, NOW, anchor_lsn=100).select("op_kind", "op_group", "op_count", "op_pct")


@query("profile_summary", "SELECT true AS window_supported, CAST(NULL AS VARCHAR) AS unsafe_reason, total_ops, " + ", ".join(f"{g}_ops, CAST(printf('%.2f', {g}_ops * 100.0::DOUBLE / total_ops) AS DECIMAL(5,2)) AS {g}_pct" for g in ("insert", "update", "delete", "vacuum", "other")) + " FROM (SELECT CAST(sum(op_count) AS BIGINT) AS total_ops, " + ", ".join(f"CAST(coalesce(sum(op_count) FILTER (WHERE op_group = '{g}'), 0) AS BIGINT) AS {g}_ops" for g in ("insert", "update", "delete", "vacuum", "other")) + f" FROM ({_COUNTED}))")
def summary(spark, d):
    return profile_summary(_events(spark, d), MIDDLE, NOW, anchor_lsn=100).drop("target_ts", "query_now_ts")


@query("percent_rounding", "SELECT l_quantity AS quantity, l_discount AS discount, CAST(printf('%.2f', l_discount * 12.5) AS DECIMAL(5,2)) AS pct FROM (SELECT DISTINCT l_quantity, l_discount FROM lineitem)")
def percent_rounding(spark, d):
    return X.table(spark, d, "lineitem").select(F.col("l_quantity").alias("quantity"), F.col("l_discount").alias("discount")).distinct().withColumn("pct", percent(F.col("discount") * 12.5))


_IMAGES = f"SELECT minute * 10 + 1 AS lsn, coalesce(old_k, new_k) % 1000000 AS k, CASE WHEN c IN (0, 3, 6, 11) THEN kind ELSE 'change' END AS what, old_price, new_price, c FROM ({LOG})"


@query("before_images", f"SELECT k AS row_id, lsn, old_price, new_price FROM ({_IMAGES})")
def row_images(spark, d):
    """The old rows of a log that has new ones only, from the versions before them, for every record of
    the orders' log: inserts, updates, deletes, updates that change a key, rows inserted and
    deleted again. A row is found by its order's own number, which stays when its key changes; the number
    shown leaves whole millions out. Page images and locks lie between."""
    orders = X.table(spark, d, "orders").select(F.col("o_orderkey").alias("row_id"), "o_totalprice")
    c = F.col("row_id") % 7
    first = F.when(c.isin(1, 4), F.col("o_totalprice") - 1).when(c == 2, F.col("o_totalprice") - 2).otherwise(F.col("o_totalprice"))
    base = orders.where(c.isin(1, 2, 3, 4)).select("row_id", F.struct(first.alias("price")).alias("image"))
    log = X.orders_log(spark, d).where("outcome = 'committed'")
    either = F.coalesce("new_row", "old_row")
    number = either["k"] - either["part"] * X.APART
    after = log.select(number.alias("row_id"), "lsn", "kind", F.when(F.col("new_row").isNotNull(), F.struct(F.col("new_row.price").alias("price"))).alias("image"))
    pages = base.where(c == 1).select("row_id", F.lit(0).cast("long").alias("lsn"), F.lit("xlog_fpi").alias("kind"), "image")
    locks = base.select("row_id", F.lit(1).cast("long").alias("lsn"), F.lit("heap_lock").alias("kind"), F.lit(None).cast(base.schema["image"].dataType).alias("image"))
    return before_images(base, after.unionByName(pages).unionByName(locks)).select((F.col("row_id") % 1000000).alias("row_id"), "lsn", F.col("old_row.price").alias("old_price"), F.col("new_row.price").alias("new_price"))


@query("chunk_reassembly", "SELECT doc_id AS value_id, CAST(strlen(text) AS BIGINT) AS bytes, md5(text) AS digest FROM documents WHERE text <> ''")
def chunks(spark, d):
    """Large values cut into chunks, half of them only in the live store, put together again."""
    docs = X.table(spark, d, "documents").where("text <> ''").select(F.col("doc_id").alias("value_id"), F.col("text").cast("binary").alias("raw"))
    n = F.ceil(F.octet_length("raw") / 1996).cast("int")
    cut = docs.select("value_id", F.explode(F.sequence(F.lit(0), n - 1)).alias("chunk_seq"), "raw").select("value_id", "chunk_seq", F.expr("substring(raw, chunk_seq * 1996 + 1, 1996)").alias("data"))
    whole = reassemble(cut.where("chunk_seq % 2 = 0"), cut.where("chunk_seq % 2 = 1"), docs.select("value_id", F.octet_length("raw").alias("size")))
    return whole.select("value_id", F.octet_length("value").cast("long").alias("bytes"), F.md5("value").alias("digest"))


@query("anchor", "SELECT o_orderkey AS checkpoint_lsn, o_orderkey * 10 AS redo_lsn FROM orders WHERE o_orderkey % 100 = 0 AND o_orderkey <= 5050 ORDER BY o_orderkey DESC LIMIT 1")
def anchor(spark, d):
    marks = X.table(spark, d, "orders").where("o_orderkey % 100 = 0").select(F.col("o_orderkey").alias("checkpoint_lsn"), (F.col("o_orderkey") * 10).alias("redo_lsn"), F.expr(f"{X.EPOCH} + make_dt_interval(0, 0, CAST(o_orderkey AS INT), 0)").alias("checkpoint_ts"))
    found = find_anchor(marks, spark.range(1).select(F.lit(moment(5050)).cast("timestamp")).first()[0])
    return spark.createDataFrame([(found["checkpoint_lsn"], found["redo_lsn"])], "checkpoint_lsn long, redo_lsn long")


@query("unsafe_windows", "SELECT reason, CAST(count(*) AS BIGINT) AS n FROM (SELECT o_orderkey AS x, ['truncate', 'rewrite', 'storage_change', 'storage_change', 'storage_change'][o_orderkey % 5 + 1] AS reason FROM orders WHERE o_orderkey % 3 = 0 AND o_orderkey % 7 <> 5 AND o_orderkey > 5000) WHERE x % 5 NOT IN (3, 4) GROUP BY reason")
def unsafe_windows(spark, d):
    x = F.col("o_orderkey")
    reason = F.element_at(F.array(*map(F.lit, ("truncate", "rewrite", "storage_change", "storage_change", "storage_change"))), (x % 5 + 1).cast("int"))
    how = F.element_at(F.array(F.lit(None).cast("string"), F.lit(None).cast("string"), *map(F.lit, ("smgr_create", "smgr_truncate", "standby_lock"))), (x % 5 + 1).cast("int"))
    orders = X.table(spark, d, "orders").select("o_orderkey")
    facts = orders.where("o_orderkey % 3 = 0").select(F.lit("orders").alias("rel"), F.lit("main").alias("scope"), reason.alias("reason"), how.alias("storage_op"), x.alias("xid"), x.alias("lsn"))
    xacts = orders.select(x.alias("xid"), F.when(x % 7 == 5, "aborted").otherwise("committed").alias("outcome"), F.expr(f"{X.EPOCH} + make_dt_interval(0, 0, CAST(o_orderkey AS INT), 0)").alias("commit_ts"))
    return unsafe_facts(facts, xacts, T, NOW).groupBy("reason").agg(F.count("*").alias("n"))


@query("span_merge", """
WITH e AS (SELECT CAST(floor(event_id / 500) AS BIGINT) AS segno, event_type AS rel, event_id AS i FROM events WHERE event_id % 97 <> 5),
n AS (SELECT *, CASE WHEN i - lag(i) OVER (PARTITION BY segno, rel ORDER BY i) <= 2 THEN 0 ELSE 1 END AS new FROM e),
r AS (SELECT *, sum(new) OVER (PARTITION BY segno, rel ORDER BY i) AS run FROM n)
SELECT segno, rel, min(i) * 3000 AS start_lsn, max(i) * 3000 + 100 AS end_lsn, CAST(count(*) AS BIGINT) AS hits FROM r GROUP BY segno, rel, run""")
def span_merge(spark, d):
    """Spans of 100 bytes every 3,000: 5,900 bytes lie between every other one, which join, and 8,900 between
    every third, which do not. Some are empty and count for nothing."""
    i = F.col("event_id")
    rows = X.table(spark, d, "events").select(F.floor(i / 500).alias("segno"), F.col("event_type").alias("rel"), (i * 3000).alias("start_lsn"), (i * 3000 + F.when(i % 97 == 5, 0).otherwise(100)).alias("end_lsn"))
    return merge_spans(rows)


@query("segment_pruning", "SELECT DISTINCT floor(event_id / 20)::BIGINT AS segno FROM events WHERE (event_type = 'purchase' AND event_id >= 0) OR floor(event_id / 20) % 10 = 3")
def segment_pruning(spark, d):
    """Segments that may hold a relation's records: those whose summary names it, or without one."""
    rows = X.table(spark, d, "events").select(F.floor(F.col("event_id") / 20).alias("segno"), F.col("event_type").alias("rel"), F.col("event_id").alias("lsn"))
    own = rows.where("segno % 10 <> 3").groupBy("segno", "rel").agg(F.max("lsn").alias("last_lsn")).withColumn("version", F.lit(12))
    return prune_segments(rows.select("segno").distinct(), own, "purchase")


@query("relation_gate", "SELECT * FROM (VALUES ('pk', 'keyed'), ('none', 'bag'), ('unique', 'keyed'), ('partial', 'bag'), ('deferred', 'bag'), ('expression', 'bag')) t(name, mode)")
def relation_gate(spark, d):
    kinds = {"pk": (Index(("id",), primary=True),), "none": (), "unique": (Index(("code",)),), "partial": (Index(("code",), predicate=True),), "deferred": (Index(("code",), immediate=False),), "expression": (Index(("lower(code)",), expressions=True),)}
    return spark.createDataFrame([(n, RelationInfo(n, indexes=i).mode) for n, i in kinds.items()], "name string, mode string")


@query("sink_round_trip", f"SELECT * FROM ({truth()})")
def sink_round_trip(spark, d):
    """The past written as CSV, and read again."""
    from ..sources.sinks import read_csv, scratch, write_csv

    out = scratch(spark, "csv")
    write_csv(past_orders(spark, d), out)
    return read_csv(spark, out, "k long, price double")


@query("table_as_select", f"SELECT CAST(count(*) AS BIGINT) AS n, min(k) AS low, max(k) AS high FROM ({truth()})")
def table_as_select(spark, d):
    """The past as a Parquet table laid out by key, and a query over it."""
    from ..sources.sinks import scratch, write_table

    out = scratch(spark, "table")
    write_table(past_orders(spark, d), out, by=["k"])
    return spark.read.parquet(out).agg(F.count("*").alias("n"), F.min("k").alias("low"), F.max("k").alias("high"))


# Segments, transactions and summaries made of the whole orders table. Made-up numbers lie beyond all of its own.
BEYOND = 10**12
_FILES = f"SELECT *, CASE WHEN segno < 20 THEN 1 ELSE 2 END AS timeline, CASE WHEN segno % 50 = 11 THEN segno + {BEYOND} ELSE segno END AS hdr FROM (SELECT o_orderkey AS o, CAST(floor(o_orderkey / 2) AS BIGINT) AS segno FROM orders) WHERE segno % 37 <> 5 AND NOT (segno % 4 = 0 AND o % 2 = 1) AND segno <> 199"
_CHOSEN = f"SELECT hdr AS segno, timeline, 'f' || arg_min(o, CASE WHEN o % 2 = 0 THEN 0 ELSE 1 END) AS name FROM ({_FILES}) WHERE timeline = 2 GROUP BY hdr, timeline"


@query("segment_choice", _CHOSEN)
def segment_choice(spark, d):
    return choose_segments(X.log_segments(spark, d, None, BEYOND)).select("segno", "timeline", "name")


@query("segment_gaps", f"SELECT min(segno) AS first_segno, max(segno) AS last_segno, CAST(count(*) AS BIGINT) AS n FROM (SELECT segno, segno - row_number() OVER (ORDER BY segno) AS run FROM ({_CHOSEN})) GROUP BY run")
def segment_gaps(spark, d):
    return islands(choose_segments(X.log_segments(spark, d, None, BEYOND)))


@query("unresolved_xids", f"""
WITH want(m, resolved_by, reason, up, known, so, ao, sa, aa, tf) AS (VALUES
  (1, 'exact_all', 'summary_outcome_outside_span', false, true, 'false', 'true', 'false', 'false', 'false'),
  (2, 'exact_window', 'summary_missing_assignment', false, true, 'false', 'false', 'false', 'false', 'false'),
  (3, 'exact_window', 'summary_assignment_outside_span', true, true, 'false', 'false', 'false', 'true', 'false'),
  (4, 'unresolved', 'summary_missing_top_outcome', true, false, 'false', 'false', 'true', 'true', 'false'),
  (5, 'unresolved', 'summary_missing_assignment', false, false, 'false', 'false', 'false', 'false', 'false'),
  (6, 'exact_all', 'summary_missing_assignment', false, true, 'false', 'false', 'false', 'false', 'false'),
  (7, 'unresolved', 'summary_missing_outcome', true, true, 'false', 'false', 'true', 'true', 'true')),
r AS (SELECT o_orderkey AS xid, CASE WHEN o_orderkey % 11 = 0 THEN 'unsafe' ELSE 'touched' END AS xid_role, w.*, CASE WHEN o_orderkey % 11 = 0 THEN 'unsafe_xid' ELSE reason END AS fallback_reason,
      CASE WHEN up THEN o_orderkey + {BEYOND} END AS top_xid FROM orders JOIN want w ON o_orderkey % 8 = m)
SELECT xid, xid_role, resolved_by, fallback_reason, top_xid, CASE WHEN known THEN epoch(TIMESTAMP '{T}')::BIGINT END AS commit_ts, 0 AS summary_missing_segments, 3 AS fallback_windows,
  'xid=' || xid || ' xid_role=' || xid_role || ' unresolved_after_summary=true unresolved_after_exact_windows=' || CASE WHEN resolved_by = 'exact_window' THEN 'false' ELSE 'true' END ||
  ' unresolved_after_exact_all=' || CASE WHEN resolved_by = 'unresolved' THEN 'true' ELSE 'false' END || ' fallback_reason=' || fallback_reason || ' fallback_windows=3 summary_missing_segments=0 touched_in_metadata=true' ||
  ' span_outcome_found=' || so || ' all_outcome_found=' || ao || ' span_assignment_found=' || sa || ' all_assignment_found=' || aa || ' top_outcome_found=' || tf || ' top_xid=' || coalesce(top_xid, 0) ||
  ' commit_ts_known=' || CASE WHEN known THEN 'true' ELSE 'false' END || ' commit_ts=' || CASE WHEN known THEN '{T}' ELSE 'null' END AS diag
FROM r""")
def xids(spark, d):
    """By number modulo 8: 0 in a summary's span; 1 outside it, and in the exact log; 2 in its windows only;
    3 assigned outside a span, the top transaction in the windows; 4 assigned, no outcome anywhere;
    5 nowhere; 6 elsewhere in the log only; 7 assigned in a span, the top transaction's outcome outside."""
    rows = X.table(spark, d, "orders").select(F.col("o_orderkey").alias("xid"), (F.col("o_orderkey") % 8).alias("m"))
    ts, m, top = F.lit(T).cast("timestamp"), F.col("m"), F.col("xid") + BEYOND
    outcomes = rows.where("m in (0, 1, 7)").select(F.when(m == 7, top).otherwise(F.col("xid")).alias("xid"), F.lit("committed").alias("outcome"), ts.alias("commit_ts"), (m == 0).alias("in_span"))
    assigned = rows.where("m in (3, 4, 7)").select(F.col("xid").alias("subxid"), top.alias("top_xid"), m.isin(4, 7).alias("in_span"))
    exact = rows.where("m in (1, 2, 3, 6)").select(F.when(m == 3, top).otherwise(F.col("xid")).alias("xid"), F.lit("committed").alias("outcome"), ts.alias("commit_ts"), m.isin(2, 3).alias("in_window"))
    return unresolved_xids(rows.select("xid"), rows.where("xid % 11 = 0").select("xid"), outcomes, assigned, exact, fallback_windows=3).withColumn("commit_ts", F.col("commit_ts").cast("long"))


def _index(spark, d):
    seen = X.table(spark, d, "orders").where("o_orderkey % 301 <> 300").select(F.col("o_orderkey").alias("segno"))
    stamp = lambda n: F.expr(f"{X.EPOCH} + make_dt_interval(0, 0, CAST(segno AS INT) + {n}, 0)")
    return seen.select("segno", stamp(0).alias("oldest_ts"), stamp(1).alias("newest_ts")), seen.where("segno % 450 <> 449").select("segno")


def _progress_sql(first: str, last: str, visible_ends: bool) -> str:
    """What the view says, told from the set of numbers that are missing or without a summary between
    the ends: the gaps are its largest and smallest; what lies beyond them is covered."""
    far, near = ("g_old", "g_new") if visible_ends else ("NULL::BIGINT", "NULL::BIGINT")
    stamp = lambda n: f"epoch(TIMESTAMP '2024-01-01 00:00:00' + to_minutes(CAST({n} AS INTEGER)))::BIGINT"
    return f"""
WITH s AS (SELECT o_orderkey AS segno, o_orderkey % 450 <> 449 AS built FROM orders WHERE o_orderkey % 301 <> 300),
e AS (SELECT {first} AS lo, {last} AS hi FROM s),
b AS (SELECT n FROM (SELECT unnest(generate_series(lo, hi)) AS n FROM e) LEFT JOIN s ON s.segno = n WHERE s.segno IS NULL OR NOT built),
g AS (SELECT max(n) AS g_new, min(n) AS g_old, count(*) AS missing FROM b),
c AS (SELECT min(segno) AS c_lo, max(segno) AS c_hi, count(*) AS done FROM s WHERE built)
SELECT true AS service_enabled, NULL::INTEGER AS timeline_id, lo AS stable_oldest_segno, hi AS stable_newest_segno, {stamp("c_lo")} AS stable_oldest_ts, {stamp("c_hi + 1")} AS stable_newest_ts,
  (SELECT min({stamp("segno")}) FROM s WHERE segno > {near} AND built) AS near_contiguous_through_ts, (SELECT max({stamp("segno + 1")}) FROM s WHERE segno < {far} AND built) AS far_contiguous_until_ts,
  g_new AS first_gap_from_newest_segno, (SELECT {stamp("segno")} FROM s WHERE segno = {near} + 1 AND built) AS first_gap_from_newest_ts,
  g_old AS first_gap_from_oldest_segno, (SELECT {stamp("segno + 1")} FROM s WHERE segno = {far} - 1 AND built) AS first_gap_from_oldest_ts,
  done AS completed_segments, CAST(missing AS BIGINT) AS missing_segments, done * 100.0::DOUBLE / (hi - lo + 1) AS progress_pct,
  {"NULL::BIGINT" if visible_ends else "epoch(TIMESTAMP '2024-02-01 00:00:00')::BIGINT"} AS last_query_observed_at, {"NULL::BOOLEAN" if visible_ends else "false"} AS last_query_summary_ready,
  {"NULL::BIGINT" if visible_ends else "4::BIGINT"} AS last_query_summary_span_fallback_segments, {"NULL::BIGINT" if visible_ends else "2::BIGINT"} AS last_query_metadata_fallback_segments,
  {"NULL::BIGINT" if visible_ends else "CAST(floor(epoch(TIMESTAMP '2024-02-01 00:00:00') + missing * 6 / 4.0) AS BIGINT)"} AS estimated_completion_at, '{"none" if visible_ends else "external"}' AS state_source, {str(not visible_ends).lower()} AS daemon_state_present,
  {str(not visible_ends).lower()} AS daemon_state_stale, {"NULL::BIGINT" if visible_ends else "epoch(TIMESTAMP '2024-01-31 23:59:40')::BIGINT"} AS daemon_state_published_at
FROM e, g, c"""


def _seconds(row: DataFrame) -> DataFrame:
    return row.select(*[F.floor(F.unix_micros(c) / 1000000).alias(c) if row.schema[c].dataType.typeName() == "timestamp" else c for c in row.columns])


@query("index_progress", _progress_sql("min(segno)", "max(segno)", True))
def index_progress(spark, d):
    return _seconds(progress(*_index(spark, d)))


@query("index_progress_published", _progress_sql("-3::BIGINT", "max(segno) + 7", False))
def index_progress_published(spark, d):
    """Ends that a service published and that are not visible, its state stale, and a query's hint."""
    import datetime as dt

    segments, built = _index(spark, d)
    now, newest = dt.datetime(2024, 2, 1), segments.agg(F.max("segno")).first()[0] or 0
    now = spark.range(1).select(F.lit("2024-02-01 00:00:00").cast("timestamp")).first()[0]
    state = {"published_at": now - dt.timedelta(seconds=20), "builds": 4, "elapsed": 6, "oldest": -3, "newest": newest + 7}
    return _seconds(progress(segments, built, state=state, hint={"observed_at": now, "span_fallback": 4, "metadata_fallback": 2}, now=now))


@query("index_queue", "SELECT segno, newer <= 64 AS hot FROM (SELECT o_orderkey AS segno, row_number() OVER (ORDER BY o_orderkey DESC) AS newer FROM orders WHERE o_orderkey % 301 <> 300) WHERE segno % 450 = 449")
def index_queue(spark, d):
    segments, built = _index(spark, d)
    return queue(segments, built, workers=4)


@query("index_retention", "SELECT segno, bytes FROM (SELECT *, coalesce(sum(CASE WHEN keep THEN 0 ELSE bytes END) OVER (ORDER BY segno ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS freed, sum(bytes) OVER () AS total FROM (SELECT o_orderkey AS segno, CAST(o_orderkey % 17 + 1 AS BIGINT) AS bytes, o_orderkey % 5 = 0 AS keep FROM orders)) WHERE NOT keep AND total > 5000 AND total - freed > 4000")
def index_retention(spark, d):
    files = X.table(spark, d, "orders").select(F.col("o_orderkey").alias("segno"), (F.col("o_orderkey") % 17 + 1).alias("bytes"), (F.col("o_orderkey") % 5 == 0).alias("protected"))
    return retention(files, 5000, 80)


@query("key_or_not", f"SELECT * FROM ({truth()}) WHERE (k = 5489 OR (k > 4990 AND NOT k >= 5010)) AND NOT (k = 5000 OR k IN (5001, 5002))")
def key_or_not(spark, d):
    """Nested conditions, as a column, names in any case."""
    k = F.col("K")
    return past_orders(spark, d, key_filter=((k == 5489) | ((k > 4990) & ~(k >= 5010))) & ~((k == 5000) | k.isin(5001, 5002)))


@query("join_full", f"SELECT coalesce(a.k, b.k) AS k, a.price AS earlier, b.price AS later FROM ({truth(4000)}) a FULL JOIN ({truth(6000)}) b USING (k) WHERE a.price IS DISTINCT FROM b.price")
def join_full(spark, d):
    """What two moments hold of each key, where that differs."""
    a, b = (past_orders(spark, d, moment(t)).withColumnRenamed("price", n) for t, n in ((4000, "earlier"), (6000, "later")))
    return a.join(b, "k", "full").where(~F.col("earlier").eqNullSafe(F.col("later"))).select("k", "earlier", "later")


@query("join_semi_anti", f"SELECT CASE WHEN k IN (SELECT k FROM ({truth(1000)})) THEN 'old' ELSE 'new' END AS kind, CAST(count(*) AS BIGINT) AS n FROM ({truth()}) GROUP BY 1")
def join_semi_anti(spark, d):
    now, then = past_orders(spark, d), past_orders(spark, d, moment(1000)).select("k")
    both = now.join(then, "k", "left_semi").select(F.lit("old").alias("kind")).unionByName(now.join(then, "k", "left_anti").select(F.lit("new").alias("kind")))
    return both.groupBy("kind").agg(F.count("*").alias("n"))


@query("join_as_of", f"SELECT p.k, max(c.o_orderkey) AS before FROM ({truth()}) p JOIN orders c ON c.o_orderkey % 500 = 0 AND c.o_orderkey <= p.k GROUP BY p.k")
def join_as_of(spark, d):
    """The last checkpoint at or before each key: one pass over both sides in order of bands of keys."""
    from ..operators.ranges import as_of

    marks = X.table(spark, d, "orders").where("o_orderkey % 500 = 0").select(F.col("o_orderkey").alias("before"))
    return as_of(past_orders(spark, d).select("k").distinct(), marks, "k", "before", band=10_000)


@query("unsafe_from_records", "SELECT reason, storage_op, scope, CAST(count(*) AS BIGINT) AS n FROM (SELECT x, ['truncate', 'rewrite', 'smgr_create', 'smgr_truncate', 'standby_lock', 'heap_insert'][x % 6 + 1] AS op, x % 4 AS which, x % 5 = 0 AS odd FROM (SELECT o_orderkey AS x FROM orders)) r, LATERAL (SELECT CASE WHEN op IN ('truncate', 'rewrite') THEN op ELSE 'storage_change' END AS reason, CASE WHEN op NOT IN ('truncate', 'rewrite') THEN op END AS storage_op, CASE WHEN which = 1 THEN 'side' ELSE 'main' END AS scope) WHERE which IN (0, 1, 2) AND op <> 'heap_insert' AND NOT (op IN ('smgr_create', 'smgr_truncate') AND odd) GROUP BY ALL")
def unsafe_from_records(spark, d):
    """Facts out of records that name the relation (modulo 4: 0), its side relation (1), both (2) or another."""
    x = F.col("o_orderkey")
    kind = F.element_at(F.array(*map(F.lit, ("truncate", "rewrite", "smgr_create", "smgr_truncate", "standby_lock", "heap_insert"))), (x % 6 + 1).cast("int"))
    rels = F.when(x % 4 == 0, F.array(F.lit("orders"))).when(x % 4 == 1, F.array(F.lit("side"))).when(x % 4 == 2, F.array(F.lit("side"), F.lit("orders"))).otherwise(F.array(F.lit("other")))
    records = X.table(spark, d, "orders").select(kind.alias("record"), x.alias("xid"), x.alias("lsn"), rels.alias("rels"), F.when(x % 5 == 0, "visibility").otherwise("main").alias("fork"), (x % 5 != 0).alias("truncates_heap"))
    return facts_of_records(records, "orders", "side").groupBy("reason", "storage_op", "scope").agg(F.count("*").alias("n"))


@query("pruned_history", f"SELECT * FROM ({truth()})")
def pruned_history(spark, d):
    """The past from a log by segments, of which those are read that were chosen and that the index names;
    each segment without a record of the relation would be passed over."""
    log = X.orders_log(spark, d).withColumn("segno", F.floor(F.col("lsn") / 1000))
    other = log.withColumns({"rel": F.lit("other"), "segno": F.col("segno") + 10**6})
    segno = F.col("segno")
    files = log.unionByName(other).select("segno").distinct()
    most = files.agg(F.max("segno")).first()[0] or 0
    files = spark.range(0, most + 1).select(F.lit(1).alias("timeline"), F.col("id").alias("segno"))
    files = files.select("timeline", "segno", F.concat(F.lit("f"), segno.cast("string")).alias("name"), F.lit("archive").alias("source"), F.lit(16 << 20).cast("long").alias("bytes"), F.lit(False).alias("partial"), F.lit(True).alias("valid"), F.lit(1).alias("hdr_timeline"), segno.alias("hdr_segno"))
    relations = log.unionByName(other).groupBy("segno", "rel").agg(F.max("lsn").alias("last_lsn")).withColumn("version", F.lit(VERSION))
    return _orders(history(X.orders_current(spark, d), log.unionByName(other), T, now_ts=NOW, relation=RelationInfo("orders", indexes=(Index(tuple(X.ORDERS_KEYS), primary=True),)), segments=files, relations=relations, conf={"spill_mode": "DISK", "memory_limit": "1MB", "show_progress": True}))


@query("log_reader", f"SELECT * FROM ({truth()})")
def log_reader(spark, d):
    """The past from a log that was written and read by the reader, which checks its columns and kinds."""
    from ..sources.log import read_op_log
    from ..sources.sinks import scratch

    out, current = scratch(spark, "log"), X.orders_current(spark, d)
    X.orders_log(spark, d).write.json(out)
    return _orders(history(current, read_op_log(spark, out, current.schema, "json"), T, keys=X.ORDERS_KEYS, now_ts=NOW))


@query("table_saved", f"SELECT CAST(count(*) AS BIGINT) AS n, min(k) AS low, max(k) AS high FROM ({truth()})")
def table_saved(spark, d):
    """The past as a table of the catalog, and a query over it."""
    import uuid

    from ..sources.sinks import save_as_table, scratch

    name = f"past_{uuid.uuid4().hex}"
    save_as_table(past_orders(spark, d), name, scratch(spark, "saved"))
    return spark.table(name).agg(F.count("*").alias("n"), F.min("k").alias("low"), F.max("k").alias("high"))
