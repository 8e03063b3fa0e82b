"""Every query of the engine against its SQL, on the smallest tables; the index stream."""

import datetime as dt
import decimal
import os
from collections import Counter

import duckdb
import pytest

from retrospect.operators.summary import progress
from retrospect.plans.queries import SQL, Q
from retrospect.streaming.tail import ops_per_window, summarize_stream, tail

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


def plain(v):
    if isinstance(v, decimal.Decimal):
        return str(v.normalize())
    if isinstance(v, float):
        return round(v, 6)
    return v.replace(tzinfo=None) if isinstance(v, dt.datetime) else v


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(Q))
def test_query(spark, duck, name):
    df = Q[name](spark, DATA)
    columns = sorted(df.columns)
    got = Counter(tuple(plain(r[c]) for c in columns) for r in df.collect())
    if name not in SQL:
        assert got
        return
    rel = duck.execute(SQL[name])
    names = [d[0] for d in rel.description]
    assert sorted(names) == columns
    assert got == Counter(tuple(plain(r[names.index(c)]) for c in columns) for r in rel.fetchall())


def test_stream_builds_late_segments(spark, tmp_path):
    schema = "segno bigint, rel string, kind string, lsn bigint, end_lsn bigint, xid bigint, commit_ts timestamp, outcome string"
    stamp = dt.datetime(2024, 1, 1)
    rows = lambda s: spark.createDataFrame([(s, "t", "heap_insert", s * 100 + i, s * 100 + i + 5, s * 10 + i, stamp, "committed") for i in range(3)], schema)
    source, out = f"{tmp_path}/in", f"{tmp_path}/out"
    for batch in ([2], [1], [2]):  # 1 comes after its successor, 2 comes twice
        for s in batch:
            rows(s).write.mode("append").parquet(source)
        run = summarize_stream(tail(spark, source, rows(1).schema), out, f"{tmp_path}/state")
        assert run.awaitTermination(120) and run.exception() is None
    found = spark.read.parquet(f"{out}/relations")
    assert sorted((r["segno"], r["records"]) for r in found.collect()) == [(1, 3), (2, 3)]
    assert {r["segno"] for r in spark.read.parquet(f"{out}/spans").collect()} == {1, 2}


def test_windows_close_behind_the_watermark(spark, tmp_path):
    stamp = dt.datetime(2024, 1, 1)
    spark.createDataFrame([("heap_insert", stamp + dt.timedelta(minutes=m)) for m in (0, 1, 7, 60)], "kind string, commit_ts timestamp").write.parquet(f"{tmp_path}/in")
    rows = spark.readStream.schema("kind string, commit_ts timestamp").parquet(f"{tmp_path}/in")
    run = ops_per_window(rows).writeStream.outputMode("append").format("memory").queryName("closed").trigger(availableNow=True).start()
    assert run.awaitTermination(120)
    assert sorted(r["n"] for r in spark.sql("SELECT n FROM closed").collect()) == [1, 2]


def test_progress_states(spark):
    segments = spark.createDataFrame([(n, dt.datetime(2024, 1, n), dt.datetime(2024, 1, n + 1)) for n in (3, 4, 6)], "segno bigint, oldest_ts timestamp, newest_ts timestamp")
    built = spark.createDataFrame([(3,), (6,)], "segno bigint")
    now = dt.datetime(2024, 2, 1)
    row = progress(segments, built, state={"published_at": now - dt.timedelta(seconds=20), "builds": 10, "elapsed": 5, "oldest": 2, "newest": 6}, hint={"observed_at": now, "span_fallback": 0, "metadata_fallback": 2}, now=now).first()
    assert (row["completed_segments"], row["missing_segments"], row["progress_pct"], row["daemon_state_stale"], row["last_query_summary_ready"]) == (2, 3, 40.0, True, True)
    # the published oldest segment, 2, is not visible: it is the gap, and nothing is covered from there
    assert row["first_gap_from_newest_segno"] == 5 and row["first_gap_from_oldest_segno"] == 2
    assert (row["first_gap_from_newest_ts"], row["near_contiguous_through_ts"]) == (dt.datetime(2024, 1, 6), dt.datetime(2024, 1, 6))
    assert row["first_gap_from_oldest_ts"] is None and row["far_contiguous_until_ts"] is None
    seen = progress(segments, built, now=now).first()
    assert (seen["first_gap_from_oldest_segno"], seen["first_gap_from_oldest_ts"], seen["far_contiguous_until_ts"]) == (4, dt.datetime(2024, 1, 4), dt.datetime(2024, 1, 4))
    none = progress(segments.where("false"), built.where("false"), bounds=(4, 9)).first()
    assert (none["first_gap_from_newest_segno"], none["first_gap_from_oldest_segno"], none["missing_segments"], none["progress_pct"]) == (9, 4, 6, 0.0)
    assert row["estimated_completion_at"] == now + dt.timedelta(seconds=1.5)
    empty = progress(segments.where("false"), built).first()
    assert empty["progress_pct"] == 100.0 and len(empty) == 24
