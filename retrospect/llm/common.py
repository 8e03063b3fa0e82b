"""What the corpus operators share: reading tables, cutting lineage, graph components."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: The white space of the contracts: blank, and tab to carriage return.
SPACE = " \t\n\x0b\x0c\r"
#: Rows of an Arrow batch, at most, where a table is written in between.
ARROW_BATCH, ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 2000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def schema_plus(df: DataFrame, more: str) -> StructType:
    """The schema of ``df`` and further columns, in DDL."""
    return StructType([*df.schema.fields, *StructType.fromDDL(more).fields])


def unused(df: DataFrame, *names: str) -> list[str]:
    """Column names for helpers, made longer until ``df`` has none of them."""
    have = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in have:
            name += "_"
        out.append(name)
    return out


@cache
def _own_folder(app: str) -> str:
    return "file://" + tempfile.mkdtemp(prefix="retrospect-")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a local
    session, as in tests, gets a folder of its own; on a cluster, whose machines would not see it, this
    raises."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = _own_folder(spark.sparkContext.applicationId)
    return folder.rstrip("/")


def _remove(spark: SparkSession, path: str) -> None:
    try:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session has ended: the folder's owner clears it
        pass


def new_path(spark: SparkSession, what: str) -> str:
    """A path of its own in the shared folder, removed when the driver ends."""
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def written(df: DataFrame, what: str = "cut", instead: DataFrame | None = None) -> DataFrame:
    """``df`` written to the shared folder and read again: later stages, and tasks repeated after
    a lost executor, start from the files instead of repeating what led to them. ``instead`` is a
    written table that nothing needs any more once ``df`` is there: its files are deleted."""
    spark = df.sparkSession
    path = new_path(spark, what)
    rows = spark.conf.get(ARROW_BATCH)
    try:  # whole texts go through Arrow: what is under way at a time should be small
        spark.conf.set(ARROW_BATCH, str(min(ARROW_ROWS, int(rows))) if int(rows) > 0 else str(ARROW_ROWS))
        df.write.parquet(path)
    finally:
        spark.conf.set(ARROW_BATCH, rows)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_at = path
    if instead is not None:
        _remove(spark, instead.written_at)
    return out


def counted_join(rows: DataFrame, groups: DataFrame, on: list[str], how: str, size: str = "n", large: int = 200, most: int = 10_000) -> DataFrame:
    """``rows`` joined (inner or left) with ``groups``, a written table of one row a key, whose column
    ``size`` tells how many rows the key has. Groups of more rows than ``large`` and than a ``most``-th
    of all rows, of which there can be ``most`` at most, are broadcast, and only the rows of smaller
    groups shuffle: no key is a task's burden."""
    told = groups.agg(F.coalesce(F.sum(size), F.lit(0)).alias("all"), F.coalesce(F.max(size), F.lit(0)).alias("most")).first()
    bar = max(large, -(-told["all"] // most))
    if told["most"] <= bar:
        return rows.join(groups, on, how)
    found = rows.join(F.broadcast(groups.where(F.col(size) > bar)), on, "left")
    rest = found.where(F.col(size).isNull()).select(*rows.columns).join(groups.where(F.col(size) <= bar), on, how)
    return found.where(F.col(size).isNotNull()).unionByName(rest)


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Components of an undirected graph: alternate large-star and small-star rounds until the
    edges stay as they are. Returns (node, root) for each node of an edge between different
    nodes, root being the component's smallest node.

    Nothing is collected: each round is written to the shared folder, and only a row count and a
    checksum of it come to the driver, and a round's files go when the next one's are there. A node with very many neighbours is pre-aggregated where
    its minimum is taken; the join that hands the minimum out is a plain sort-merge join, which
    the adaptive planner may split. Null ends make no edge."""
    now = written(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("u") != F.col("v")))
        .distinct(),
        "edges",
    )

    def state(df):
        return tuple(df.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long")), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    was, is_ = None, state(now)
    while is_ != was and is_[0]:
        both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.unionByName(least.where("m < u").select("u", F.col("m").alias("v"))).distinct()
        below = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(below, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = written(small.unionByName(below.select("u", F.col("m").alias("v"))).distinct(), "edges", now)
        was, is_ = is_, state(now)
    roots = now.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
