"""Queries on orders whose numbers, which are minutes in the logs, reach past now (153,564,543,360) and past the end of
Spark's times (about 153,690,000,000), against their SQL."""

import os
from collections import Counter

import duckdb
import pytest

from retrospect.plans.queries import SQL, Q

from .test_queries import DATA, TABLES, plain

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
#: What is added to the numbers 0 to 1499: around the targets, around the last minute that a commit has, and one more.
SHIFTS = [m + s for m in (0, 152_999_997_000) for s in (0, 1500, 3000, 4500, 6000)]
MORE = (153_600_000_000, 9_000_000_000_000_000)
NUMBERS = {"orders": "o_orderkey", "lineitem": "l_orderkey"}


@pytest.fixture(scope="module", params=MORE)
def shifted(tmp_path_factory, request):
    path = tmp_path_factory.mktemp("shifted")
    duck = duckdb.connect()
    for t in TABLES:
        rows = f"SELECT * FROM '{DATA}/{t}.parquet'"
        if n := NUMBERS.get(t):
            rows = f"SELECT * REPLACE ({n} + s AS {n}) FROM '{DATA}/{t}.parquet', (SELECT unnest({[*SHIFTS, request.param]})::BIGINT AS s)"
        duck.execute(f"COPY ({rows}) TO '{path}/{t}.parquet' (FORMAT parquet)")
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}/{t}.parquet'")
    return str(path), duck


NAMES = "bag_rows full_output join_customers join_full join_semi_anti key_topn keyed_history keyed_history_xacts log_reader multi_target".split()


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
