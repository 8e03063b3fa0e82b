"""Where a past table can go."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def scratch(spark: SparkSession, what: str) -> str:
    """A path in the folder that driver and executors share (spark.checkpoint.dir), removed when the
    driver ends. Where that is unset a local session gets a local folder; on a cluster this raises."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="retrospect-")
    path = f"{folder.rstrip('/')}/{what}-{uuid.uuid4().hex}"

    def remove() -> None:
        try:
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # the session has ended
            pass

    atexit.register(remove)
    return path


#: An empty text is told from a null by a mark while it is read.
_EMPTY = "\u0001empty\u0001"
#: A null is nothing between commas, an empty text two quotes, and a quote in a text is doubled.
CSV = {"header": "true", "quote": '"', "escape": '"', "nullValue": "", "emptyValue": '""', "lineSep": "\n", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.options(**CSV).csv(path)


def read_csv(spark: SparkSession, path: str, schema) -> DataFrame:
    """What ``write_csv`` wrote, line ends within texts included."""
    rows = spark.read.schema(schema).options(**CSV | {"multiLine": "true", "emptyValue": _EMPTY}).csv(path)
    texts = [f.name for f in rows.schema.fields if isinstance(f.dataType, StringType)]
    return rows.withColumns({c: F.when(F.col(c) == _EMPTY, "").otherwise(F.col(c)) for c in texts})


def write_table(rows: DataFrame, path: str, by: list[str] | None = None) -> None:
    """Parquet; ``by`` deals rows out by ranges, so that later readers skip files by key."""
    (rows.repartitionByRange(*by).sortWithinPartitions(*by) if by else rows).write.parquet(path)


def save_as_table(rows: DataFrame, name: str, path: str | None = None) -> None:
    """A table of the catalog, with ``path`` one whose files lie there."""
    (rows.write if path is None else rows.write.option("path", path)).saveAsTable(name)
