"""Logs derived from the star-schema tables, for queries and tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EPOCH = "TIMESTAMP '2024-01-01 00:00:00'"
TARGET = "2024-01-04 11:20:00"  # epoch and 5000 minutes
NOW = "+294000-01-01 00:00:00"  # after every commit
#: The last minute a commit has, in the year 292926: Spark's times end in 294247, and later changes commit then.
#: Which of a row's changes came first is told by their lsn, which goes on.
LAST_MINUTE = 153 * 10**9

#: What tells an orders row. Some rows bear made-up numbers, which are numbers of other orders too in a table
#: of over a million: ``part`` is 0 of an order under its own number, 1 of one under the number that it had
#: before it changed, 2 of a row that came beside it and went again.
ORDERS_KEYS = ["k", "part"]
#: How far the made-up numbers of each part lie from the order's own.
APART = 1000000

_ROW = "struct<k:bigint,part:int,price:double>"
_ORDERS_LOG = """
SELECT stack(2,
  CASE c WHEN 0 THEN 'heap_insert' WHEN 3 THEN 'heap_delete' WHEN 6 THEN 'heap_insert' ELSE 'heap_update' END, c, o_orderkey,
    CASE WHEN c IN (0, 6) THEN NULL WHEN c = 4 THEN o_orderkey + 1000000 ELSE o_orderkey END,
    CASE c WHEN 0 THEN NULL WHEN 6 THEN NULL WHEN 2 THEN o_totalprice - 2 WHEN 3 THEN o_totalprice WHEN 5 THEN o_totalprice - 9 ELSE o_totalprice - 1 END,
    CASE c WHEN 3 THEN NULL WHEN 6 THEN o_orderkey + 2000000 ELSE o_orderkey END,
    CASE c WHEN 3 THEN NULL WHEN 2 THEN o_totalprice - 1 ELSE o_totalprice END,
  CASE c WHEN 2 THEN 'heap_hot_update' WHEN 6 THEN 'heap_delete' END, c + 5, CASE c WHEN 2 THEN o_orderkey + 2000 ELSE o_orderkey + 3000 END,
    CASE c WHEN 6 THEN o_orderkey + 2000000 ELSE o_orderkey END,
    CASE c WHEN 6 THEN o_totalprice ELSE o_totalprice - 1 END,
    CASE c WHEN 6 THEN NULL ELSE o_orderkey END, CASE c WHEN 6 THEN NULL ELSE o_totalprice END
) AS (kind, class, minute, old_k, old_price, new_k, new_price)
FROM (SELECT o_orderkey, o_totalprice, CAST(o_orderkey % 7 AS INT) AS c FROM {orders})
"""


def at_minute(minute: str):
    """The time so many minutes after the epoch, be their number an int or a long; LAST_MINUTE's from there on."""
    return F.expr(f"timestampadd(MINUTE, IF({minute} > {LAST_MINUTE}, {LAST_MINUTE}, {minute}), {EPOCH})")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def orders_current(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as they are now; by key modulo 7: 0 inserted, 1 updated, 2 updated twice, 3 deleted,
    4 key changed, 5 an update that aborted, 6 untouched beside a key inserted and deleted."""
    return table(spark, sf_dir, "orders").where("o_orderkey % 7 <> 3").select(F.col("o_orderkey").alias("k"), F.when(F.col("o_orderkey").isNotNull(), 0).alias("part"), F.col("o_totalprice").alias("price"))


def orders_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The changes that led there; each is a transaction of its own, committed in its minute."""
    rows = spark.sql(_ORDERS_LOG, orders=table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")).where("kind is not null")
    made = F.when(F.col("class").isin(6, 11), 2)
    row = lambda a, b, part: F.when(F.col(a).isNotNull(), F.struct(F.col(a).cast("long").alias("k"), part.alias("part"), F.col(b).cast("double").alias("price"))).cast(_ROW)
    lsn = (F.col("minute") * 10 + 1).cast("long")
    return rows.select(
        F.lit("orders").alias("rel"), "kind", lsn.alias("lsn"), (lsn * 100 + F.col("class")).alias("xid"), F.when(F.col("class") == 5, "aborted").otherwise("committed").alias("outcome"),
        at_minute("minute").alias("commit_ts"), lsn.alias("commit_lsn"), row("old_k", "old_price", made.when(F.col("class") == 4, 1).otherwise(0)).alias("old_row"), row("new_k", "new_price", made.otherwise(0)).alias("new_row"),
    )


def split_log(log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The log without outcomes, and the transactions apart."""
    return log.drop("outcome", "commit_ts", "commit_lsn"), log.select("xid", "outcome", "commit_ts", "commit_lsn").distinct()


def lineitem_current(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").where("(l_orderkey + l_linenumber) % 5 <> 2")
    return rows.select(F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"), F.col("l_quantity").cast("int").alias("qty"))


def lineitem_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By order and line number modulo 5: 0 inserted, 1 quantity lowered by one, 2 deleted."""
    rows = table(spark, sf_dir, "lineitem").withColumn("c", (F.col("l_orderkey") + F.col("l_linenumber")) % 5).where("c < 3")
    qty = F.col("l_quantity").cast("int")
    row = lambda q: F.struct(F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"), q.alias("qty"))
    lsn = (F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("long")
    return rows.select(
        F.lit("lineitem").alias("rel"), F.when(F.col("c") == 0, "heap_insert").when(F.col("c") == 1, "heap_update").otherwise("heap_delete").alias("kind"), lsn.alias("lsn"), lsn.alias("xid"), F.lit("committed").alias("outcome"),
        at_minute("l_orderkey").alias("commit_ts"), lsn.alias("commit_lsn"),
        F.when(F.col("c") == 1, row(qty + 1)).when(F.col("c") == 2, row(qty)).alias("old_row"), F.when(F.col("c") < 2, row(qty)).alias("new_row"),
    )


def events_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One record an event, of the kind that its number modulo 13 names; three kinds have no
    transaction, and a tenth of the users' transactions abort."""
    from .model import KINDS

    kind = F.element_at(F.array(*[F.lit(k) for k in KINDS]), (F.col("event_id") % 13 + 1).cast("int"))
    return table(spark, sf_dir, "events").select(
        F.lit("events").alias("rel"), kind.alias("kind"), F.col("event_id").alias("lsn"), F.col("event_id").alias("commit_lsn"), F.when(~(F.col("event_id") % 13).isin(7, 11, 12), F.col("event_id")).alias("xid"),
        F.when(F.col("user_id") % 10 == 0, "aborted").otherwise("committed").alias("outcome"), F.col("ts").alias("commit_ts"),
    )


def log_segments(spark: SparkSession, sf_dir: str, below: int | None = 400, moved: int = 1000) -> DataFrame:
    """Log files named after the orders ``below`` (None: all): two a number (archive and running log, one only for
    multiples of 4), no number 5 modulo 37, headers that name another number (11 modulo 50), an
    older timeline, and partial files."""
    rows = table(spark, sf_dir, "orders").where("true" if below is None else f"o_orderkey < {below}").select(F.col("o_orderkey").alias("o"))
    segno = F.floor(F.col("o") / 2)
    rows = rows.withColumn("segno", segno.cast("long")).where("segno % 37 <> 5 and not (segno % 4 = 0 and o % 2 = 1)")
    return rows.select(
        F.when(F.col("segno") < 20, 1).otherwise(2).alias("timeline"), "segno", F.concat(F.lit("f"), F.col("o").cast("string")).alias("name"), F.when(F.col("o") % 2 == 0, "archive").otherwise("log").alias("source"),
        F.lit(16 << 20).cast("long").alias("bytes"), (F.col("segno") == 199).alias("partial"), F.lit(True).alias("valid"), F.when(F.col("segno") < 20, 1).otherwise(2).alias("hdr_timeline"),
        F.when(F.col("segno") % 50 == 11, F.col("segno") + moved).otherwise(F.col("segno")).alias("hdr_segno"),
    )
