"""Queries on orders whose numbers reach past those that the log makes up (over 1,000,000) and past the minutes
of a few years (over 3,200,000), against their SQL."""

import os
from collections import Counter

import duckdb
import pytest

from retrospect.plans.queries import SQL, Q

from .test_queries import DATA, TABLES, plain

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
#: What is added to the numbers 0 to 1499: around the targets, and the same numbers one, two and more millions on.
SHIFTS = [m + s for m in (0, 1_000_000, 2_000_000, 8_000_000) for s in (0, 1500, 3000, 4500, 6000, 7500)]
NUMBERS = {"orders": "o_orderkey", "lineitem": "l_orderkey", "events": "event_id"}


@pytest.fixture(scope="module")
def shifted(tmp_path_factory):
    path = tmp_path_factory.mktemp("shifted")
    duck = duckdb.connect()
    for t in TABLES:
        rows = f"SELECT * FROM '{DATA}/{t}.parquet'"
        if n := NUMBERS.get(t):
            rows = f"SELECT * REPLACE ({n} + s AS {n}) FROM '{DATA}/{t}.parquet', (SELECT unnest({SHIFTS})::BIGINT AS s)"
        duck.execute(f"COPY ({rows}) TO '{path}/{t}.parquet' (FORMAT parquet)")
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}/{t}.parquet'")
    return str(path), duck


NAMES = (
    "before_images bag_history bag_rows count_star full_output join_customers join_full key_in key_topn keyed_history keyed_history_xacts join_semi_anti multi_target join_as_of log_reader"
    " multi_target_bag projection pruned_history rollup_aggregates truth_diff reverse_ops undo_upserts undo_delete_keys unsafe_windows table_as_select sink_round_trip"
).split()


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, shifted, name):
    path, duck = shifted
    df = Q[name](spark, path)
    columns = sorted(df.columns)
    rel = duck.execute(SQL[name])
    names = [d[0] for d in rel.description]
    assert sorted(names) == columns
    want = Counter(tuple(plain(r[names.index(c)]) for c in columns) for r in rel.fetchall())
    assert want and Counter(tuple(plain(r[c]) for c in columns) for r in df.collect()) == want
