"""Queries on orders whose numbers, which are minutes in the logs, reach past ints and past the year 9999, against their SQL:
in sessions that raise on a cast that overflows and in sessions that wrap around."""

import os
from collections import Counter

import duckdb
import pytest

from retrospect.plans.queries import SQL, Q

from .test_queries import DATA, TABLES, plain

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
#: What is added to the numbers 0 to 1499: around the targets, past 2 ** 31 - 1 and where ints that wrap around come to negative minutes.
SHIFTS = [m + s for m in (0, 3_000_000_000, 5_000_000_000, 59_000_000_000) for s in (0, 1500, 3000, 4500, 6000)]
NUMBERS = {"orders": "o_orderkey", "lineitem": "l_orderkey"}


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


NAMES = "bag_rows count_star full_output join_customers join_full key_topn keyed_history keyed_history_xacts join_semi_anti multi_target log_reader".split()


#: Those that gave SQL's rows all the same where the cast wrapped around.
RAISED = {"count_star", "join_full", "join_semi_anti"}


@pytest.mark.parametrize("name,ansi", [(n, "true" if n in RAISED else "false") for n in NAMES] + [("bag_rows", "true")])
def test_query(spark, shifted, name, ansi):
    path, duck = shifted
    rel = duck.execute(SQL[name])
    names = [d[0] for d in rel.description]
    columns = sorted(names)
    want = Counter(tuple(plain(r[names.index(c)]) for c in columns) for r in rel.fetchall())
    before = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", ansi)
    try:
        df = Q[name](spark, path)
        assert sorted(df.columns) == columns
        assert want and Counter(tuple(plain(r[c]) for c in columns) for r in df.collect()) == want
    finally:
        spark.conf.set("spark.sql.ansi.enabled", before)
