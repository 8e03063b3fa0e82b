"""Where log segments come from: archive settings, the choice of one file a segment, gaps, anchors."""

from __future__ import annotations

import os
import re
import shlex

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..model import HistoryError


def _cp_target(words: list[str]) -> str | None:
    if len(words) == 3 and os.path.basename(words[0]) == "cp" and words[1] == "%p" and words[2].endswith("/%f"):
        return words[2][: -len("/%f")]
    return None


def parse_copy_command(command: str) -> str | None:
    """The folder of ``cp %p DIR/%f``, also behind ``test ! -f DIR/%f &&``; else None."""
    try:
        words = shlex.split(command)
    except ValueError:
        return None
    if "&&" in words:
        at = words.index("&&")
        test, words = words[:at], words[at + 1 :]
        found = _cp_target(words)
        return found if found and test == ["test", "!", "-f", f"{found}/%f"] else None
    return _cp_target(words)


def parse_archive_push(command: str) -> str | None:
    """The folder of ``pg_probackup archive-push -B DIR --instance X --wal-file-name %f``: DIR/wal/X.
    DIR must be absolute and the file name there. Remote and archive options are not understood: None."""
    try:
        words = shlex.split(command)
    except ValueError:
        return None
    if len(words) < 2 or os.path.basename(words[0]) != "pg_probackup" or words[1] != "archive-push":
        return None
    given: dict[str, str] = {}
    rest = iter(words[2:])
    for word in rest:
        name, eq, value = word.partition("=")
        if word == "-B" or word in ("--instance", "--wal-file-name"):
            if (value := next(rest, None)) is None:
                return None
            given[word] = value
        elif eq and name in ("--instance", "--wal-file-name"):
            given[name] = value
        elif word.startswith(("--remote-", "--archive-")):
            return None
    folder, instance = given.get("-B", ""), given.get("--instance")
    if instance is None or given.get("--wal-file-name") != "%f" or not folder.startswith("/"):
        return None
    return f"{folder.rstrip('/') or '/'}/wal/{instance}"


def resolve_source(archive_dest: str | None = None, archive_dir: str | None = None, archive_command: str | None = None) -> tuple[str, str]:
    """(folder, where it was set), by the order destination, older name, parsed command."""
    for value, name in ((archive_dest, "archive_dest"), (archive_dir, "archive_dir")):
        if value:
            return value, name
    if archive_command and (found := parse_copy_command(archive_command) or parse_archive_push(archive_command)):
        return found, "archive_command"
    raise HistoryError("no archive is configured, and the archive command is not understood")


_NAME = re.compile(r"[0-9A-F]{24}")


def segment_name(name: str, per_log: int = 256) -> tuple[int, int] | None:
    """(timeline, segment number) of a segment's 24-digit file name."""
    if not _NAME.fullmatch(name):
        return None
    return int(name[:8], 16), int(name[8:16], 16) * per_log + int(name[16:], 16)


SEGMENTS = "timeline int, segno long, name string, source string, bytes long, partial boolean, valid boolean, hdr_timeline int, hdr_segno long, path string"


def discover(spark: SparkSession, archive: str, running: str | None = None, recovered: str | None = None, segment_bytes: int = 16 << 20, per_log: int = 256) -> DataFrame:
    """The log's files in the archive, among recovered ones and in the running log, as rows for
    ``choose_segments``. Folders are listed by the file system that their path names. Files of other
    names are passed over; those of another size than a segment's, or that end in .partial, are partial.
    Headers are taken to say what names do (columns hdr_timeline and hdr_segno can be replaced by
    what a reader finds). Raises if the archive does not exist or holds no segment."""
    rows = []
    for source, folder in (("archive", archive), ("recovered", recovered), ("log", running)):
        if folder is None:
            continue
        where = spark._jvm.org.apache.hadoop.fs.Path(folder)
        files = where.getFileSystem(spark._jsc.hadoopConfiguration())
        if not files.exists(where):
            if source == "archive":
                raise HistoryError(f"archive folder does not exist: {folder}")
            continue
        for status in files.listStatus(where):
            name = status.getPath().getName()
            if status.isFile() and (found := segment_name(name.removesuffix(".partial"), per_log)):
                rows.append((*found, name, source, status.getLen(), name.endswith(".partial") or status.getLen() != segment_bytes, True, *found, status.getPath().toString()))
        if source == "archive" and not rows:
            raise HistoryError(f"archive holds no segments: {folder}")
    return spark.createDataFrame(rows, SEGMENTS)


def choose_segments(segments: DataFrame) -> DataFrame:
    """One row a segment number of the highest timeline. A file whose header names another segment
    than its name counts under its header's number, behind all others; complete archived files come
    before recovered ones, those before the running log's. Partial and invalid files are left out."""
    known = segments.where("valid and not partial").withColumn("mismatch", ~(F.col("hdr_segno").eqNullSafe(F.col("segno")) & F.col("hdr_timeline").eqNullSafe(F.col("timeline"))))
    known = known.withColumns({"timeline": F.when(F.col("mismatch"), F.col("hdr_timeline")).otherwise(F.col("timeline")), "segno": F.when(F.col("mismatch"), F.col("hdr_segno")).otherwise(F.col("segno"))}).where("segno is not null")
    newest = known.agg(F.max("timeline").alias("newest"))
    known = known.join(F.broadcast(newest), F.col("timeline") == F.col("newest"), "left_semi")  # one row
    rank = F.when(F.col("mismatch"), 3).when(F.col("source") == "archive", 0).when(F.col("source") == "recovered", 1).otherwise(2)
    first = F.row_number().over(Window.partitionBy("segno").orderBy(rank, "name"))
    return known.withColumns({"priority": rank, "__n": first}).where("__n = 1").drop("__n")


def islands(segments: DataFrame) -> DataFrame:
    """Runs of consecutive segment numbers: first_segno, last_segno, n, newest first."""
    numbers = segments.select("segno").distinct()
    run = F.col("segno") - F.row_number().over(Window.orderBy("segno"))
    runs = numbers.withColumn("run", run).groupBy("run").agg(F.min("segno").alias("first_segno"), F.max("segno").alias("last_segno"), F.count("*").alias("n"))
    return runs.drop("run").orderBy(F.desc("last_segno"))


def retained_suffix(segments: DataFrame) -> tuple[int, int, tuple | None]:
    """(oldest, newest, gap) of the newest unbroken run; gap is (first, last) missing before it."""
    runs = islands(segments).limit(2).collect()
    if not runs:
        raise HistoryError("log not complete: no segments")
    gap = (runs[1]["last_segno"] + 1, runs[0]["first_segno"] - 1) if len(runs) > 1 else None
    return runs[0]["first_segno"], runs[0]["last_segno"], gap


def find_anchor(checkpoints: DataFrame, target_ts, retained_lsn: int | None = None, gap: tuple | None = None) -> dict:
    """The newest checkpoint at or before the target; replay starts at its redo position. ``gap`` is
    what is missing before the retained suffix (see ``retained_suffix``): where it cuts the log, that
    is the reason told when no checkpoint will do."""
    at = F.col("checkpoint_ts") <= F.lit(target_ts)
    row = checkpoints.agg(
        F.max(F.when(at, F.struct("checkpoint_ts", "redo_lsn", "checkpoint_lsn"))).alias("best"), F.min("checkpoint_ts").alias("earliest"),
    ).first()
    if row["best"] is None:
        if gap is not None:
            raise HistoryError(f"log not complete: the target predates the retained suffix (segments {gap[0]} to {gap[1]} are missing)")
        if row["earliest"] is None:
            raise HistoryError("log not complete: no checkpoint in the retained log")
        raise HistoryError(f"log not complete: the target predates the earliest checkpoint ({row['earliest']})")
    if retained_lsn is not None and row["best"]["redo_lsn"] < retained_lsn:
        raise HistoryError("log not complete: the target predates the retained suffix")
    return row["best"].asDict()
