"""The index as a service: what it publishes, what queries leave for it, and its command line."""

from __future__ import annotations

import argparse
import datetime as dt
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import __version__
from ..model import HistoryError, settings
from ..operators.summary import progress, retention
from .tail import summarize_stream, tail

RECORDS = "segno bigint, rel string, kind string, lsn bigint, end_lsn bigint, xid bigint, top_xid bigint, outcome string, commit_ts timestamp"
_STATE = "published_at timestamp, builds bigint, elapsed double, oldest bigint, newest bigint"
_HINT = "observed_at timestamp, span_fallback bigint, metadata_fallback bigint"


def _publish(spark: SparkSession, path: str, row: dict, schema: str) -> None:
    spark.createDataFrame([row], schema).coalesce(1).write.mode("overwrite").json(path)


def _found(spark: SparkSession, path: str, schema: str) -> dict | None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return None
    row = spark.read.schema(schema).json(path).first()
    return row.asDict() if row else None


def publish_state(spark: SparkSession, index: str, **state) -> None:
    """What the service knows of itself: published_at, builds, elapsed, oldest and newest."""
    _publish(spark, f"{index}/state", {"published_at": dt.datetime.now(), "builds": 0, "elapsed": 0.0, "oldest": None, "newest": None} | state, _STATE)


def publish_hint(spark: SparkSession, index: str, span_fallback: int, metadata_fallback: int) -> None:
    """What a query found: how many segments it had to read without spans, and without outcomes."""
    _publish(spark, f"{index}/hint", {"observed_at": dt.datetime.now(), "span_fallback": span_fallback, "metadata_fallback": metadata_fallback}, _HINT)


def prune_and_tell(spark: SparkSession, index: str, segments: DataFrame, relations: DataFrame, outcomes: DataFrame) -> tuple[int, int]:
    """Counts the segments that have no spans and no outcomes in the index, and leaves them as a hint."""
    lacking = [segments.select("segno").distinct().join(x.select("segno").distinct(), "segno", "left_anti").count() for x in (relations, outcomes)]
    publish_hint(spark, index, *lacking)
    return lacking[0], lacking[1]


def index_progress(spark: SparkSession, index: str, segments: DataFrame, memory: dict | None = None, now: dt.datetime | None = None) -> DataFrame:
    """The progress view over an index folder: the state comes from the service's file if it is fresh, or
    if the session holds none itself (``memory``); else from the session; the hint from the last query."""
    now = now or dt.datetime.now()
    state = _found(spark, f"{index}/state", _STATE)
    fresh = state is not None and (now - state["published_at"]).total_seconds() <= 10
    if memory is not None and not fresh:
        state = memory | {"kept": "memory"}
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{index}/relations")
    exists = where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)
    built = spark.read.parquet(f"{index}/relations").select(F.col("segno").cast("long")) if exists else segments.select("segno").where("false")
    return progress(segments, built, state=state, hint=_found(spark, f"{index}/hint", _HINT), now=now)


def clean(spark: SparkSession, index: str, limit_mb: int, low_percent: int, keep_newest: int = 32) -> list[int]:
    """Deletes the summaries of the oldest segments while the index is over its limit, the newest
    ``keep_newest`` never. Returns the numbers of those deleted."""
    where = spark._jvm.org.apache.hadoop.fs.Path(index)
    files = where.getFileSystem(spark._jsc.hadoopConfiguration())
    sizes: dict[int, int] = {}
    folders: dict[int, list] = {}
    for section in files.listStatus(where) if files.exists(where) else []:
        if section.isDirectory() and section.getPath().getName() not in ("records", "state", "hint"):
            for part in files.listStatus(section.getPath()):
                name, eq, number = part.getPath().getName().partition("=")
                if eq and name == "segno":
                    sizes[int(number)] = sizes.get(int(number), 0) + files.getContentSummary(part.getPath()).getLength()
                    folders.setdefault(int(number), []).append(part.getPath())
    recent = set(sorted(sizes)[-keep_newest:]) if keep_newest else set()
    rows = spark.createDataFrame([(n, b, n in recent) for n, b in sizes.items()], "segno bigint, bytes bigint, protected boolean")
    gone = sorted(r["segno"] for r in retention(rows, limit_mb << 20, low_percent).collect())
    for n in gone:
        for path in folders[n]:
            files.delete(path, True)
    return gone


def parse_arguments(words: list[str]) -> argparse.Namespace:
    """Options, and those of the file given by --config (lines ``name = value``, # begins a comment)."""
    options = argparse.ArgumentParser("retrospect-index", description="Builds the index of a log as its segments arrive.")
    options.add_argument("--records", help="folder of Parquet files with the log's records")
    options.add_argument("--archive-dest", help="folder of archived segments")
    options.add_argument("--index", help="folder of the index")
    options.add_argument("--config", help="file with options")
    options.add_argument("--interval-ms", type=int, help="pause between looks at the log")
    options.add_argument("--once", action="store_true", help="build what is there and end")
    options.add_argument("--foreground", action="store_true", help="do not return before the job ends")
    options.add_argument("--version", action="version", version=__version__)
    own = options.parse_args(words)
    if own.config:
        with open(own.config, encoding="utf-8") as lines:
            for line in lines:
                name, eq, value = line.partition("#")[0].partition("=")
                name, value = name.strip().replace("-", "_"), value.strip().strip("'\"")
                if not eq and not name:
                    continue
                if not eq or name not in vars(own) or name in ("config", "version"):
                    raise HistoryError(f"unrecognized option: {name}")
                if getattr(own, name) in (None, False):
                    setattr(own, name, int(value) if name == "interval_ms" else value.lower() in ("1", "on", "true", "yes") if name in ("once", "foreground") else value)
    own.interval_ms = settings(summary_scan_interval_ms=own.interval_ms if own.interval_ms is not None else settings()["summary_scan_interval_ms"])["summary_scan_interval_ms"]
    if not own.records or not own.index:
        raise HistoryError("--records and --index are needed")
    return own


def main(words: list[str] | None = None, spark: SparkSession | None = None):
    """Runs the index job; returns its stream."""
    own = parse_arguments(sys.argv[1:] if words is None else words)
    spark = spark or SparkSession.builder.getOrCreate()
    trigger = {"availableNow": True} if own.once else {"processingTime": f"{own.interval_ms} milliseconds"}
    run = summarize_stream(tail(spark, own.records, RECORDS), own.index, f"{own.index}/../checkpoint", **trigger)
    if own.once or own.foreground:
        run.awaitTermination()
    return run


if __name__ == "__main__":
    main()
