"""Rules of the engine case by case, expected values worked out by hand."""

import datetime as dt
import logging

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from retrospect.model import HistoryError, Index, RelationInfo, parse_size, settings
from retrospect.operators.images import before_images, explode_tuples, reassemble
from retrospect.operators.profile import kind_counts
from retrospect.operators.ranges import as_of
from retrospect.operators.summary import build_summary, merge_spans
from retrospect.operators.unsafe import facts_of_records
from retrospect.operators.visibility import newest_first, with_outcomes
from retrospect.operators.xids import unresolved_xids
from retrospect.plans.history import history
from retrospect.sources import sinks
from retrospect.sources.log import as_op_log, read_op_log
from retrospect.sources.segments import discover, find_anchor, parse_archive_push
from retrospect.streaming import service
from retrospect.streaming.tail import summarize_stream, tail

ROW = "struct<k:bigint,v:string>"
LOG = f"kind string, lsn bigint, xid bigint, old_row {ROW}, new_row {ROW}, outcome string, commit_ts timestamp, commit_lsn bigint"


def at(n):
    return dt.datetime(2024, 1, 1) + dt.timedelta(hours=n)


@pytest.fixture(scope="module")
def current(spark):
    return spark.createDataFrame([(1, "one"), (2, "two"), (3, "three")], "k bigint, v string")


@pytest.fixture(scope="module")
def log(spark):
    rows = [("heap_update", 10, 1, (1, "old one"), (1, "one"), "committed", at(2), 11), ("heap_insert", 20, 2, None, (2, "two"), "committed", at(3), 21), ("heap_delete", 30, 3, (9, "nine"), None, "committed", at(4), 31)]
    return spark.createDataFrame(rows, LOG)


def test_spans_join_within_a_page_of_bytes(spark):
    rows = [(1, "a", 8000, 8190), (1, "a", 8193, 8300), (1, "a", 8300 + 8192, 17000), (1, "a", 17000 + 8193, 26000), (1, "a", 50, 50), (1, "b", 60, 40), (1, "b", 5, None), (1, "b", 100, 9000), (1, "b", 200, 300), (1, "b", 9000, 9001)]
    got = merge_spans(spark.createDataFrame(rows, "segno int, rel string, start_lsn bigint, end_lsn bigint")).collect()
    assert sorted(map(tuple, got)) == [(1, "a", 8000, 17000, 3), (1, "a", 25193, 26000, 1), (1, "b", 100, 9001, 3)]


def test_reasons_in_their_order(spark):
    ids = spark.createDataFrame([(n,) for n in range(1, 8)], "xid bigint")
    outcomes = spark.createDataFrame([(1, "committed", at(1), False), (40, "committed", at(2), False), (5, "committed", at(1), True), (60, "committed", at(1), True)], "xid bigint, outcome string, commit_ts timestamp, in_span boolean")
    assigned = spark.createDataFrame([(2, 20, False), (3, 30, True), (4, 40, True), (6, 60, True)], "subxid bigint, top_xid bigint, in_span boolean")
    nothing = spark.createDataFrame([], "xid bigint, outcome string, commit_ts timestamp, in_window boolean")
    tell = lambda **more: {r["xid"]: r["fallback_reason"] for r in unresolved_xids(ids, ids.where("xid = 7"), outcomes, assigned, nothing, **more).collect()}
    assert tell() == {1: "summary_outcome_outside_span", 2: "summary_assignment_outside_span", 3: "summary_missing_top_outcome", 4: "summary_missing_outcome", 7: "unsafe_xid"}
    assert set(tell(missing_segments=1).values()) == {"summary_missing_segment", "unsafe_xid"} and set(tell(probed=False).values()) == {"raw_xact_fallback", "unsafe_xid"}


def test_archive_push_commands():
    push = "pg_probackup archive-push"
    assert parse_archive_push(f"/usr/bin/{push} -B /bk/ --instance main --wal-file-name %f --wal-file-path=%p") == "/bk/wal/main"
    for bad in (f"{push} -B bk --instance=main --wal-file-name=%f", f"{push} -B /bk --instance=main", f"{push} -B /bk --instance=main --wal-file-name=x", f"{push} --instance=main --wal-file-name=%f", f"{push} -B /bk --wal-file-name=%f --instance", f"{push} -B /bk --instance=main --wal-file-name=%f --archive-timeout=1"):
        assert parse_archive_push(bad) is None


def test_memory_limits_and_modes():
    assert parse_size("1048576") == (1 << 30, "1GB") and parse_size("1024kB") == (1 << 20, "1MB") and parse_size(" 2 mb ") == (2 << 20, "2MB")
    assert parse_size("1536kb") == (1536 << 10, "1536kB") and parse_size("2048B") == (2048, "2kB") and parse_size("32gb")[1] == "32GB"
    for bad in ("", "x", "1.5MB", "-1", "1000B", "0", "33GB", "1TB", "5 pages", "1kib"):
        with pytest.raises(HistoryError):
            parse_size(bad)
    assert settings(spill_mode="DISK", memory_limit="1024MB")["spill_mode"] == "disk" and settings(memory_limit="1024MB")["memory_limit"] == "1GB"


def test_why_there_is_no_anchor(spark):
    marks = spark.createDataFrame([(at(5), 50, 55)], "checkpoint_ts timestamp, redo_lsn bigint, checkpoint_lsn bigint")
    for frame, gap, said in ((marks, (3, 4), "retained suffix"), (marks.where("false"), (3, 4), "retained suffix"), (marks, None, "earliest checkpoint"), (marks.where("false"), None, "no checkpoint")):
        with pytest.raises(HistoryError, match=said):
            find_anchor(frame, at(1), gap=gap)
    assert find_anchor(marks, at(6), gap=(3, 4))["redo_lsn"] == 50


@pytest.mark.parametrize("key_filter", ["K = 1 or `k` = 9", lambda: F.col("K").isin(1, 9), "k = 1 or (k > 8 and not K > 9)"])
def test_key_filters_in_any_case_and_form(current, log, key_filter):
    key_filter = key_filter() if callable(key_filter) else key_filter
    assert sorted(map(tuple, history(current, log, at(1), keys=["k"], now_ts=at(9), key_filter=key_filter).collect())) == [(1, "old one"), (9, "nine")]


def test_key_filters_on_other_columns_are_refused(current, log):
    for bad in ("v = 'one'", F.col("v") == "one", "k = 1 and nothing = 2"):
        with pytest.raises(HistoryError, match="key"):
            history(current, log, at(1), keys=["k"], now_ts=at(9), key_filter=bad)


def test_definition_changes_are_refused(spark, current, log):
    with pytest.raises(HistoryError, match="types"):
        history(spark.createDataFrame([(1, "x")], "k int, v string"), log, at(1), keys=["k"], now_ts=at(9))


def test_repeated_outcomes_change_nothing(spark, current, log):
    ops, xacts = log.drop("outcome", "commit_ts", "commit_lsn"), log.select("xid", "outcome", "commit_ts", "commit_lsn")
    xacts = xacts.unionByName(xacts)
    for keys in (["k"], None):
        got = history(current, ops, at(1), xact_log=xacts, keys=keys, now_ts=at(9)).collect()
        assert sorted(map(tuple, got)) == [(1, "old one"), (3, "three"), (9, "nine")]
    seen = with_outcomes(ops, xacts, at(2), at(9)).collect()
    assert sorted((r["lsn"], r["undo"], r["before"]) for r in seen) == [(10, False, True), (20, True, False), (30, True, False)]
    assert [r["lsn"] for r in newest_first(with_outcomes(ops, xacts, at(2), at(9))).collect()] == [30, 20, 10]


def test_images_in_place_of_pages_and_of_several_rows(spark):
    base = spark.createDataFrame([(1, "a"), (2, "b")], "row_id bigint, image string")
    many = explode_tuples(spark.createDataFrame([(5, "heap2_multi_insert", [7, 8], ["x", "y"])], "lsn bigint, kind string, row_ids array<bigint>, images array<string>"))
    rows = [(1, 10, "heap_inplace", "a2"), (1, 20, "heap_update", "a3"), (2, 11, "xlog_fpi", "b2"), (2, 12, "heap_lock", None), (2, 13, "heap2_prune", None), (2, 15, "heap_delete", None), (3, 30, "heap_update", "c2")]
    after = spark.createDataFrame(rows, "row_id bigint, lsn bigint, kind string, image string").unionByName(many.select("row_id", "lsn", "kind", "image"))
    older = spark.createDataFrame([(3, "c"), (1, "too old")], "row_id bigint, image string")
    got = sorted((r["row_id"], r["kind"], r["old_row"], r["new_row"]) for r in before_images(base, after, older).collect())
    assert got == [(1, "heap_update", "a2", "a3"), (2, "heap_delete", "b2", None), (3, "heap_update", "c", "c2"), (7, "heap2_multi_insert", None, "x"), (8, "heap2_multi_insert", None, "y")]
    with pytest.raises(PySparkException, match="missing base image for row 3"):
        before_images(base, after).collect()


def test_values_that_lost_all_chunks_raise(spark):
    chunks = spark.createDataFrame([(1, 0, bytearray(b"ab"))], "value_id bigint, chunk_seq int, data binary")
    sizes = lambda *rows: spark.createDataFrame(list(rows), "value_id bigint, size int")
    assert [bytes(r["value"]) for r in reassemble(chunks, sizes=sizes((1, 2))).collect()] == [b"ab"]
    for own, said in ((sizes((1, 2), (2, 5)), "missing chunk for value 2"), (sizes((3, 1)), "missing chunk for value 3|no length known of value 1"), (sizes((1, 3)), "wrong length for value 1")):
        with pytest.raises(PySparkException, match=said):
            reassemble(chunks, sizes=own).collect()


def test_scope_of_the_profile_and_facts(spark):
    log = spark.createDataFrame([(1, "heap_insert", None, "t"), (2, "heap_insert", None, "t_side"), (3, "heap_insert", None, "u")], "lsn bigint, kind string, xid bigint, rel string").withColumn("undo", F.lit(False))
    assert kind_counts(log, rels=("t", "t_side")).first()["op_count"] == 2 and kind_counts(log).first()["op_count"] == 3
    records = spark.createDataFrame([("truncate", 1, 1, ["t_side"], None, None), ("smgr_create", 2, 2, ["t"], "fsm", None), ("smgr_truncate", 3, 3, ["t"], None, None), ("standby_lock", 4, 4, ["x", "t"], None, None)], "record string, xid bigint, lsn bigint, rels array<string>, fork string, truncates_heap boolean")
    assert sorted(tuple(r)[1:4] for r in facts_of_records(records, "t", "t_side").collect()) == [("main", "storage_change", "standby_lock"), ("side", "truncate", None)]
    assert facts_of_records(records, "t").count() == 1


def test_reader_of_the_log(spark, current, log, tmp_path):
    log.write.json(f"{tmp_path}/log")
    own = read_op_log(spark, f"{tmp_path}/log", current.schema, "json")
    assert sorted(map(tuple, history(current, own, at(1), keys=["k"], now_ts=at(9)).collect())) == [(1, "old one"), (3, "three"), (9, "nine")]
    for bad, said in ((log.drop("xid"), "lacks columns: xid"), (log.withColumn("lsn", F.lit("a")), "lsn is string"), (log.withColumn("old_row", F.lit(1)), "old_row has other columns")):
        with pytest.raises(HistoryError, match=said):
            as_op_log(bad, current.schema)
    for bad, said in ((log.withColumn("kind", F.lit("heap_nothing")), "unknown kind"), (log.withColumn("new_row", F.lit(None).cast(ROW)), "without"), (log.withColumn("kind", F.lit(None).cast("string")), "unknown kind")):
        with pytest.raises(PySparkException, match=said):
            as_op_log(bad, current.schema).collect()


def test_folders_of_segments(spark, tmp_path):
    with pytest.raises(HistoryError, match="does not exist"):
        discover(spark, f"{tmp_path}/none")
    (tmp_path / "archive").mkdir()
    (tmp_path / "archive" / "notes.txt").write_text("x")
    with pytest.raises(HistoryError, match="holds no segments"):
        discover(spark, f"{tmp_path}/archive")
    for name, size in (("000000020000000000000003", 8), ("000000020000000100000004", 8), ("000000020000000000000005.partial", 8), ("000000020000000000000006", 3)):
        (tmp_path / "archive" / name).write_bytes(b"x" * size)
    (tmp_path / "log").mkdir()
    (tmp_path / "log" / "000000020000000000000007").write_bytes(b"x" * 8)
    got = {(r["segno"], r["source"], r["partial"]) for r in discover(spark, f"{tmp_path}/archive", f"{tmp_path}/log", segment_bytes=8).collect()}
    assert got == {(3, "archive", False), (260, "archive", False), (5, "archive", True), (6, "archive", True), (7, "log", False)}


def test_history_reads_settings_segments_and_creation(spark, current, log, caplog):
    info = RelationInfo("t", indexes=(Index(("k",), primary=True),))
    ops = log.withColumns({"rel": F.lit("t"), "segno": F.floor(F.col("lsn") / 10)})
    files = spark.createDataFrame([(1, n, f"f{n}", "archive", 16, False, True, 1, n) for n in (1, 2, 3)], "timeline int, segno bigint, name string, source string, bytes bigint, partial boolean, valid boolean, hdr_timeline int, hdr_segno bigint")
    relations = ops.groupBy("segno", "rel").agg(F.max("lsn").alias("last_lsn")).withColumn("version", F.lit(12))
    with caplog.at_level(logging.INFO, "retrospect"):
        got = history(current, ops, at(1), relation=info, now_ts=at(9), segments=files, relations=relations, conf={"memory_limit": "1kB", "spill_mode": "disk"}).collect()
    assert sorted(map(tuple, got)) == [(1, "old one"), (3, "three"), (9, "nine")]
    said = [r.getMessage() for r in caplog.records]
    assert any(s.startswith("[4/4 75%] applying by key (+") for s in said) and said[-1].startswith("[done] total elapsed") and any("exceeds the limit" in s for s in said)
    with pytest.raises(HistoryError, match="exceeds"):
        history(current, ops, at(1), relation=info, now_ts=at(9), conf={"memory_limit": "1kB"})
    with pytest.raises(HistoryError, match="made after"):
        history(current, ops, at(1), relation=info, now_ts=at(9), created_ts=at(2))
    with pytest.raises(HistoryError, match="unrecognized setting"):
        history(current, ops, at(1), relation=info, now_ts=at(9), conf={"nothing": 1})
    marks = spark.createDataFrame([(at(5), 50, 55)], "checkpoint_ts timestamp, redo_lsn bigint, checkpoint_lsn bigint")
    with pytest.raises(HistoryError, match="retained suffix"):
        history(current, ops, at(1), relation=info, now_ts=at(9), segments=files.where("segno <> 2"), checkpoints=marks)


def test_a_segment_split_over_batches_is_whole(spark, tmp_path):
    rows = lambda a, b: spark.createDataFrame([(n // 100, "t", "heap_insert", n, n + 1, n) for n in range(a, b)], "segno bigint, rel string, kind string, lsn bigint, end_lsn bigint, xid bigint")
    for a, b in ((100, 103), (103, 106), (250, 252)):
        rows(a, b).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        run = summarize_stream(tail(spark, f"{tmp_path}/in", rows(0, 1).schema), f"{tmp_path}/out", f"{tmp_path}/state")
        assert run.awaitTermination(120)
    assert sorted((r["segno"], r["records"]) for r in spark.read.parquet(f"{tmp_path}/out/relations").collect()) == [(1, 6), (2, 2)]
    assert spark.read.parquet(f"{tmp_path}/out/payloads").count() == 8


def test_late_and_repeated_records(spark, tmp_path):
    make = lambda *m: spark.createDataFrame([("heap_insert", n, at(0) + dt.timedelta(minutes=n)) for n in m], "kind string, lsn bigint, commit_ts timestamp").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    got = []
    for m in ((1, 1, 2), (2, 60), (61,), (3, 59)):
        make(*m)
        rows = tail(spark, f"{tmp_path}/in", "kind string, lsn bigint, commit_ts timestamp", late="10 minutes")
        run = rows.writeStream.foreachBatch(lambda b, _: got.extend(r["lsn"] for r in b.collect())).option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
        assert run.awaitTermination(120)
    assert sorted(got) == [1, 2, 59, 60, 61]


def test_service_state_hint_and_command_line(spark, tmp_path):
    index = f"{tmp_path}/index"
    rows = spark.createDataFrame([(n // 100, "t", "heap_insert", n, n + 1, n, None, "committed", at(1)) for n in (100, 101, 250)], service.RECORDS)
    rows.write.parquet(f"{tmp_path}/records")
    (tmp_path / "conf").write_text(f"# options\nindex = '{index}'\ninterval_ms = 500\nonce = on\n")
    service.main(["--records", f"{tmp_path}/records", "--config", f"{tmp_path}/conf"], spark)
    segments = spark.createDataFrame([(n, at(n), at(n + 1)) for n in (1, 2, 3)], "segno bigint, oldest_ts timestamp, newest_ts timestamp")
    built, spans = spark.read.parquet(f"{index}/relations"), spark.read.parquet(f"{index}/outcomes")
    assert service.prune_and_tell(spark, index, segments, built, spans) == (1, 1)
    row = service.index_progress(spark, index, segments).first()
    assert (row["completed_segments"], row["missing_segments"], row["state_source"], row["last_query_summary_span_fallback_segments"], row["last_query_summary_ready"]) == (2, 1, "none", 1, False)
    memory = {"published_at": dt.datetime.now(), "oldest": 1, "newest": 3}
    assert service.index_progress(spark, index, segments, memory).first()["state_source"] == "memory"
    service.publish_state(spark, index, oldest=1, newest=4, builds=2, elapsed=6.0)
    fresh = service.index_progress(spark, index, segments, memory).first()
    assert (fresh["state_source"], fresh["stable_newest_segno"], fresh["daemon_state_stale"]) == ("external", 4, False)
    assert service.clean(spark, index, 1, 25) == [] and service.clean(spark, index, 0, 25, keep_newest=1) == [1]
    assert {r["segno"] for r in spark.read.parquet(f"{index}/relations").collect()} == {2}
    for bad in ([], ["--records", "a", "--index", "b", "--interval-ms", "5"]):
        with pytest.raises(HistoryError):
            service.parse_arguments(bad)
    (tmp_path / "conf").write_text("nonsense = 1\n")
    with pytest.raises(HistoryError, match="unrecognized option"):
        service.parse_arguments(["--config", f"{tmp_path}/conf"])
    with pytest.raises(SystemExit):
        service.parse_arguments(["--version"])


def test_sections_of_a_summary(spark):
    records = spark.createDataFrame([(1, "t", "heap_insert", 5, 6, 7, 9, "committed", at(1), "truncate", 3), (1, "t", "xlog_fpi", 8, 9, None, None, None, None, None, 3)], "segno bigint, rel string, kind string, lsn bigint, end_lsn bigint, xid bigint, top_xid bigint, outcome string, commit_ts timestamp, reason string, block int")
    sections = build_summary(records)
    assert set(sections) == {"relations", "spans", "outcomes", "assignments", "touched", "unsafe", "anchors", "payloads"}
    assert sections["payloads"].count() == 1 and all("version" in s.columns for s in sections.values())


def test_as_of_across_bands(spark):
    rows, marks = [0, 5, 9, 10, 11, 25, 99, 100, 350], [5, 10, 98]
    got = as_of(spark.createDataFrame([(k, "x") for k in rows], "k bigint, x string"), spark.createDataFrame([(m,) for m in marks], "m bigint"), "k", "m", band=10).collect()
    assert sorted((r["k"], r["m"]) for r in got) == [(k, max(m for m in marks if m <= k)) for k in rows if k >= 5]


def test_csv_keeps_nulls_empty_texts_quotes_and_line_ends(spark, tmp_path):
    rows = [(1, None), (2, ""), (3, 'say "a", b'), (4, "two\nlines"), (5, " x "), (6, "\\")]
    sinks.write_csv(spark.createDataFrame(rows, "k bigint, v string"), f"{tmp_path}/csv")
    assert sorted(map(tuple, sinks.read_csv(spark, f"{tmp_path}/csv", "k bigint, v string").collect())) == rows


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    class Cluster:
        class sparkContext:  # noqa: N801
            master = "spark://there:7077"

            @staticmethod
            def getConf():
                return {}

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        sinks.scratch(Cluster, "x")
