"""History against snapshots taken while changes are applied forward, and the error contract."""

import datetime as dt
import random
import re
from collections import Counter

import pytest

from retrospect.model import HistoryError, Index, RelationInfo, check_relation, parse_size, preflight, settings
from retrospect.operators.apply import apply_bag, apply_keyed
from retrospect.operators.diff import diff
from retrospect.operators.images import before_images, reassemble
from retrospect.operators.profile import kind_counts, profile_summary
from retrospect.operators.unsafe import refuse_unsafe, unsafe_facts
from retrospect.operators.visibility import invisible_to, parse_snapshot, with_outcomes
from retrospect.plans.history import history, history_many, top_n
from retrospect.sources.segments import choose_segments, find_anchor, parse_archive_push, parse_copy_command, resolve_source, retained_suffix, segment_name

START = dt.datetime(2024, 1, 1)
NOW = "2030-01-01 00:00:00"
ROW = "struct<k:bigint,v:string>"
LOG = f"kind string, lsn bigint, xid bigint, outcome string, commit_ts timestamp, commit_lsn bigint, old_row {ROW}, new_row {ROW}, speculative boolean, super_delete boolean"


def at(minutes):
    return START + dt.timedelta(minutes=minutes)


def op(kind, n, old=None, new=None, outcome="committed", minute=None, spec=False, sup=False, commit_lsn=None):
    return (kind, n, n, outcome, at(n if minute is None else minute), n if commit_lsn is None else commit_lsn, old, new, spec, sup)


def play(seed, keyed, steps=120):
    """A log and the table's rows after each minute."""
    rng, rows, log, states = random.Random(seed), [(k, f"v{k}") for k in (None, 1, 2, 3)], [], {}
    if not keyed:
        rows += [(1, "v1"), (1, "v1")]
    states[0] = list(rows)
    for n in range(1, steps):
        what, gone = rng.choice("iiduuk"), rng.random() < 0.2
        outcome, before = ("aborted" if gone else "committed"), list(rows)
        used = {k for k, _ in rows}
        key = rng.choice([k for k in [None, *range(30)] if not keyed or k not in used])
        if what == "i":
            new = (key, rng.choice("abc"))
            log.append(op("heap_insert", n, None, new, outcome))
            rows.append(new)
        elif rows:
            old = rng.choice(rows)
            rows.remove(old)
            if what == "d":
                log.append(op("heap_delete", n, old, None, outcome))
            else:
                new = (key if what == "k" else old[0], rng.choice("abc"))
                log.append(op(rng.choice(["heap_update", "heap_hot_update"]), n, old, new, outcome))
                rows.append(new)
        if gone:
            rows = before
        states[n] = list(rows)
    return log, states, rows


@pytest.mark.parametrize("keyed", [True, False])
@pytest.mark.parametrize("seed", [1, 2])
def test_history_equals_snapshots(spark, seed, keyed):
    log, states, rows = play(seed, keyed)
    current = spark.createDataFrame(rows, "k bigint, v string")
    ops = spark.createDataFrame(log, LOG)
    marks = {str(m): at(m) for m in (0, 17, 60, 119)}
    many = Counter(map(tuple, history_many(current, ops, marks, keys=["k"] if keyed else None, now_ts=NOW).collect()))
    assert many == Counter((str(m), *r) for m in (0, 17, 60, 119) for r in states[m])
    one = history(current, ops, at(40), keys=["k"] if keyed else None, now_ts=NOW)
    assert one.schema == current.schema
    assert Counter(map(tuple, one.collect())) == Counter(states[40])


def test_update_chain_and_key_swap(spark):
    log = [op("heap_update", n, (1, f"v{n - 1}"), (1, f"v{n}")) for n in range(1, 501)]
    out = history(spark.createDataFrame([(1, "v500")], "k bigint, v string"), spark.createDataFrame(log, LOG), at(0), keys=["k"], now_ts=NOW)
    assert out.collect() == [(1, "v0")]
    swap = [op("heap_update", 1, (1, "a"), (9, "a")), op("heap_update", 2, (2, "b"), (1, "b")), op("heap_update", 3, (9, "a"), (2, "a"))]
    out = history(spark.createDataFrame([(1, "b"), (2, "a")], "k bigint, v string"), spark.createDataFrame(swap, LOG), at(0), keys=["k"], now_ts=NOW)
    assert sorted(map(tuple, out.collect())) == [(1, "a"), (2, "b")]


def test_commit_order_decides_and_target_is_exclusive(spark):
    # lsn 1 committed after lsn 2
    log = [op("heap_update", 1, (1, "b"), (1, "c"), minute=5, commit_lsn=9), op("heap_update", 2, (1, "a"), (1, "b"), minute=4, commit_lsn=5)]
    current = spark.createDataFrame([(1, "c")], "k bigint, v string")
    ops = spark.createDataFrame(log, LOG)
    assert history(current, ops, at(0), keys=["k"], now_ts=NOW).collect() == [(1, "a")]
    assert history(current, ops, at(4), keys=["k"], now_ts=NOW).collect() == [(1, "b")]


def test_speculative_and_super_delete_are_no_changes(spark):
    log = [op("heap_insert", 1, None, (5, "x"), spec=True), op("heap_delete", 2, (6, "y"), None, sup=True)]
    current = spark.createDataFrame([(1, "a")], "k bigint, v string")
    assert history(current, spark.createDataFrame(log, LOG), at(0), keys=["k"], now_ts=NOW).collect() == [(1, "a")]
    assert history(current, spark.createDataFrame([], LOG), at(0), now_ts=NOW).collect() == [(1, "a")]


def test_duplicate_current_key_and_bag_underflow_raise(spark):
    current = spark.createDataFrame([(None, "a"), (None, "b"), (2, "c")], "k bigint, v string")
    changed = spark.createDataFrame([op("heap_update", 1, (None, "z"), (None, "a"))], LOG)
    with pytest.raises(Exception, match="duplicate current row"):
        history(current, changed, at(0), keys=["k"], now_ts=NOW).collect()
    other = spark.createDataFrame([op("heap_update", 1, (2, "z"), (2, "c"))], LOG)
    assert Counter(map(tuple, history(current, other, at(0), keys=["k"], now_ts=NOW).collect())) == Counter([(None, "a"), (None, "b"), (2, "z")])
    with pytest.raises(Exception, match="fewer current rows"):
        history(current, spark.createDataFrame([op("heap_insert", 1, None, (7, "q"))], LOG), at(0), now_ts=NOW).collect()


def test_composite_keys_and_filters(spark):
    row = "struct<a:int,b:int,v:string>"
    schema = LOG.replace(ROW, row)
    log = [op("heap_update", 1, (1, 1, "x"), (1, 2, "x")), op("heap_delete", 2, (2, 1, "d"), None), op("heap_insert", 3, None, (3, 3, "n"))]
    current = spark.createDataFrame([(1, 2, "x"), (3, 3, "n"), (4, 4, "o")], "a int, b int, v string")
    ops = spark.createDataFrame(log, schema)
    assert sorted(map(tuple, history(current, ops, at(0), keys=["a", "b"], now_ts=NOW).collect())) == [(1, 1, "x"), (2, 1, "d"), (4, 4, "o")]
    assert history(current, ops, at(0), keys=["a", "b"], now_ts=NOW, key_filter="a = 1 and b in (1, 2)").collect() == [(1, 1, "x")]


def test_key_filter_reaches_both_scans(spark, tmp_path):
    spark.createDataFrame([(k, "v") for k in range(100)], "k bigint, v string").write.parquet(f"{tmp_path}/t")
    spark.createDataFrame([op("heap_update", k, (k, "o"), (k, "v")) for k in range(1, 50)], LOG).write.parquet(f"{tmp_path}/l")
    out = history(spark.read.parquet(f"{tmp_path}/t"), spark.read.parquet(f"{tmp_path}/l"), at(0), keys=["k"], now_ts=NOW, key_filter="k = 7")
    assert out.collect() == [(7, "o")]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"Filter .*\bk#\d+L = 7", plan) and re.search(r"old_row#\d+\.k = 7", plan)


def test_gates(spark):
    current, ops = spark.createDataFrame([(1, "a")], "k bigint, v string"), spark.createDataFrame([], LOG)
    with pytest.raises(HistoryError, match="target timestamp is in the future"):
        history(current, ops, "2031-01-01", now_ts=NOW)
    with pytest.raises(HistoryError, match="must not be NULL"):
        history(current, ops, None)
    with pytest.raises(HistoryError, match="definition changed"):
        history(current.withColumnRenamed("v", "w"), ops, at(0), now_ts=NOW)
    for kind, text in (("temporary", "temporary relations"), ("unlogged", "unlogged relations"), ("matview", "materialized views"), ("partitioned", "partitioned table parents"), ("catalog", "system catalogs"), ("view", "this relation kind")):
        with pytest.raises(HistoryError, match=f"does not support {text}"):
            check_relation(RelationInfo("t", kind=kind))
    assert check_relation(RelationInfo("t", indexes=(Index(("id",), primary=True),), has_external=True)) == "mode=keyed has_external=true"


def test_unsafe_windows(spark):
    facts = [("t", "main", "storage_change", "smgr_truncate", 1, 10), ("t", "main", "storage_change", "standby_lock", 2, 20), ("t", "toast", "truncate", None, 3, 30), ("t", "main", "rewrite", None, 4, 40), ("t", "main", "storage_change", "smgr_create", 5, 50)]
    xacts = [(1, "committed", at(9)), (2, "committed", at(9)), (3, "aborted", at(9)), (4, "committed", at(2)), (5, "committed", at(9))]
    log, known = spark.createDataFrame(facts, "rel string, scope string, reason string, storage_op string, xid bigint, lsn bigint"), spark.createDataFrame(xacts, "xid bigint, outcome string, commit_ts timestamp")
    assert [r["xid"] for r in unsafe_facts(log, known, at(5), at(100)).collect()] == [5]
    assert sorted(r["xid"] for r in unsafe_facts(log, known, at(1), at(100)).collect()) == [4, 5]
    with pytest.raises(HistoryError, match="containing rewrite operations: scope=main"):
        refuse_unsafe(unsafe_facts(log, known, at(1), at(100)), at(1))
    ops = spark.createDataFrame([op("heap_insert", 1)], LOG)
    row = profile_summary(with_outcomes(ops, None, at(0), at(100)), at(0), at(100), unsafe=unsafe_facts(log, known, at(5), at(100))).first()
    assert (row["window_supported"], row["unsafe_reason"], row["total_ops"], str(row["insert_pct"])) == (False, "storage_change", 0, "0.00")


def test_snapshots(spark):
    assert parse_snapshot("10:20:12,15") == (10, 20, [12, 15])
    rows = spark.createDataFrame([(x,) for x in (9, 12, 15, 19, 20, 21)], "xid bigint")
    assert [r[0] for r in rows.select(invisible_to("10:20:12,15")).collect()] == [False, True, True, False, True, True]
    for bad in ("", "10", "20:10:", "10:20:30", "a:b:c"):
        with pytest.raises(HistoryError, match="invalid target snapshot"):
            parse_snapshot(bad)


def test_profile_counts_records(spark):
    rows = [(1, "heap2_multi_insert", 5, 1, True), (1, "heap2_multi_insert", 5, 1, True), (2, "heap2_prune", 6, None, False), (3, "heap_lock", 7, 2, True), (4, "heap_update", 8, 3, False)]
    log = spark.createDataFrame(rows, "record_no int, kind string, lsn bigint, xid bigint, undo boolean")
    assert {r["op_kind"]: r["op_count"] for r in kind_counts(log).collect()} == {"heap2_multi_insert": 1, "heap2_prune": 1}


def test_before_images_and_chunks(spark):
    base = spark.createDataFrame([(1, ("a",))], "row_id bigint, image struct<v:string>")
    after = spark.createDataFrame([(1, 5, "heap_update", ("b",)), (1, 9, "heap_delete", None), (2, 6, "heap_insert", ("n",)), (2, 7, "heap_update", ("m",))], "row_id bigint, lsn bigint, kind string, image struct<v:string>")
    got = {(r["row_id"], r["lsn"]): r["old_row"] and r["old_row"]["v"] for r in before_images(base, after).collect()}
    assert got == {(1, 5): "a", (1, 9): "b", (2, 6): None, (2, 7): "n"}
    with pytest.raises(Exception, match="missing base image"):
        before_images(base.where("false"), after).collect()
    schema = "value_id bigint, chunk_seq int, data binary"
    chunks = spark.createDataFrame([(1, 1, b"cd"), (1, 0, b"ab")], schema)
    assert bytes(reassemble(chunks).first()["value"]) == b"abcd"
    with pytest.raises(Exception, match="missing chunk"):
        reassemble(spark.createDataFrame([(1, 1, b"cd")], schema)).collect()
    with pytest.raises(Exception, match="wrong length"):
        reassemble(chunks, sizes=spark.createDataFrame([(1, 5)], "value_id bigint, size int")).collect()


def test_sources(spark):
    assert parse_copy_command("cp %p /arch/%f") == "/arch"
    assert parse_copy_command("test ! -f '/a b/%f' && cp %p '/a b/%f'") == "/a b"
    assert parse_copy_command("rsync %p host:/x") is None
    assert parse_archive_push("/usr/bin/pg_probackup archive-push -B /bk --instance=main --wal-file-name=%f") == "/bk/wal/main"
    assert parse_archive_push("pg_probackup archive-push -B /bk --instance=main --remote-host=h") is None
    assert resolve_source(None, "/old", "cp %p /c/%f") == ("/old", "archive_dir")
    with pytest.raises(HistoryError):
        resolve_source(None, None, "true")
    assert segment_name("0000000200000001000000FF") == (2, 511) and segment_name("x") is None
    schema = "timeline int, segno bigint, name string, source string, partial boolean, valid boolean, hdr_timeline int, hdr_segno bigint"
    rows = [(2, 1, "a", "log", False, True, 2, 1), (2, 1, "b", "archive", False, True, 2, 1), (1, 9, "c", "archive", False, True, 1, 9), (2, 3, "d", "log", False, True, 2, 3), (2, 4, "e", "log", False, True, 2, 3), (2, 5, "f", "log", True, True, 2, 5)]
    chosen = choose_segments(spark.createDataFrame(rows, schema))
    assert sorted((r["segno"], r["name"]) for r in chosen.collect()) == [(1, "b"), (3, "d")]
    assert retained_suffix(chosen) == (3, 3, (2, 2))
    marks = spark.createDataFrame([(10, 5, at(1)), (20, 15, at(2))], "checkpoint_lsn bigint, redo_lsn bigint, checkpoint_ts timestamp")
    assert find_anchor(marks, at(2))["redo_lsn"] == 15
    for frame, t, kept, text in ((marks, at(0), None, "earliest checkpoint"), (marks.where("false"), at(0), None, "no checkpoint"), (marks, at(1), 9, "retained suffix")):
        with pytest.raises(HistoryError, match=text):
            find_anchor(frame, t, kept)


def test_settings():
    assert parse_size("2mb") == (2 << 20, "2MB") and parse_size("1024B")[0] == 1024
    for bad in ("100B", "64GB", "x", "1.5GB"):
        with pytest.raises(HistoryError):
            parse_size(bad)
    assert settings()["spill_mode"] == "auto"
    for bad in ({"nothing": 1}, {"spill_mode": "x"}, {"parallel_workers": 17}, {"summary_workers": 0}):
        with pytest.raises(HistoryError):
            settings(**bad)
    assert preflight(1000, 10, 5, 100, True)["spills"] is False
    assert preflight(5 << 30, 0, 0, 0, True, spill_mode="disk")["spills"] is True
    for mode, text in (("auto", "memory limit"), ("memory", "memory-only")):
        with pytest.raises(HistoryError, match=text):
            preflight(5 << 30, 0, 0, 0, True, spill_mode=mode)


def test_diff_and_top_n(spark):
    a, b = spark.createDataFrame([(1,), (1,), (2,), (None,)], "k int"), spark.createDataFrame([(1,), (3,), (None,)], "k int")
    assert sorted(map(tuple, diff(a, b).collect())) == [("left", 1, 1), ("left", 2, 1), ("right", 3, 1)]
    assert [r[0] for r in top_n(a, "k", 2).collect()] == [1, 1]
    assert [r[0] for r in top_n(a, "k", 2, descending=True).collect()] == [None, 2]
    assert [r[0] for r in top_n(a, "k", 1, offset=2).collect()] == [2]


def test_empty_inputs(spark):
    empty = spark.createDataFrame([], "k bigint, v string")
    assert apply_keyed(empty, spark.createDataFrame([], f"reverse_op string, commit_lsn bigint, lsn bigint, old_row {ROW}, new_row {ROW}"), ["k"]).collect() == []
    assert apply_bag(empty, spark.createDataFrame([], f"reverse_op string, commit_lsn bigint, lsn bigint, old_row {ROW}, new_row {ROW}")).collect() == []


def test_targets_that_cannot_be_told(spark):
    current, ops, xacts = spark.createDataFrame([], "label string, v int"), spark.createDataFrame([], "kind string, lsn long, xid long"), None
    with pytest.raises(HistoryError, match="column label"):
        history_many(current, ops, {"a": NOW}, xact_log=xacts, now_ts=NOW)
    with pytest.raises(HistoryError, match="no targets"):
        history_many(current.drop("label"), ops, {}, xact_log=xacts, now_ts=NOW)


@pytest.mark.parametrize("keyed", [True, False])
def test_several_targets_read_the_table_once_to_deal_it_out(spark, keyed):
    row = "struct<k:int,v:int>"
    current = spark.createDataFrame([(1, 10), (2, 20), (None, 30), (4, 41)] + ([] if keyed else [(2, 20)]), "k int, v int")
    at = lambda m: dt.datetime(2024, 1, 1, 0, m)
    ops = spark.createDataFrame(
        [("heap_update", 5, 5, (4, 40), (4, 41), "committed", at(5), 5), ("heap_insert", 7, 7, None, (None, 30), "committed", at(7), 7), ("heap_delete", 8, 8, (9, 90), None, "committed", at(8), 8)],
        f"kind string, lsn long, xid long, old_row {row}, new_row {row}, outcome string, commit_ts timestamp, commit_lsn long",
    )
    out = history_many(current, ops, {"old": at(1), "mid": at(6), "new": at(9)}, keys=["k"] if keyed else None, now_ts=at(30))
    same = [(1, 10), (2, 20)] + ([] if keyed else [(2, 20)])
    want = [("old", *r) for r in [*same, (4, 40), (9, 90)]] + [("mid", *r) for r in [*same, (4, 41), (9, 90)]] + [("new", *r) for r in [*same, (None, 30), (4, 41)]]
    assert Counter(map(tuple, out.collect())) == Counter(want)
    twice = current.unionByName(current)
    if keyed:
        with pytest.raises(Exception, match="duplicate current row"):
            history_many(twice, ops, {"old": at(1), "new": at(9)}, keys=["k"], now_ts=at(30)).collect()
    else:
        with pytest.raises(Exception, match="consumed fewer"):
            history_many(current.where("v <> 41"), ops, {"old": at(1)}, now_ts=at(30)).collect()
