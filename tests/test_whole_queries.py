"""The queries over the whole orders table reach past the first ids."""

import os

import pytest

from retrospect import fixtures as X
from retrospect.plans.queries import Q

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


def test_whole_table(spark):
    ids = [r[0] for r in X.table(spark, DATA, "orders").select("o_orderkey").collect()]
    assert max(ids) > 1000
    got = {r["xid"] for r in Q["unresolved_xids"](spark, DATA).collect()}
    assert got == {i for i in ids if i % 8}
    assert {r["segno"] for r in Q["index_queue"](spark, DATA).collect()} == {i for i in ids if i % 301 != 300 and i % 450 == 449}
    assert Q["index_progress"](spark, DATA).first()["stable_newest_segno"] == max(i for i in ids if i % 301 != 300)
