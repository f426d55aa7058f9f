"""Every query on training text against its SQL, and those without SQL for a result."""

import pytest

from tests.oracle import connect, rows_of, rows_of_sql
from tidewrack.llm.queries import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, sf, name):
    cols, got = rows_of(QUERIES[name](spark, sf))
    want_cols, want = rows_of_sql(connect(sf), SQL[name])
    assert cols == want_cols and got == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_columns(spark, sf):
    want = {
        "p1_found": "fetch_id bigint, line_no int", "p3_found": "fetch_id bigint, field string", "p4_found": "fetch_id bigint, line_no int", "p5_found": "fetch_id bigint", "p7_found": "fetch_id bigint",
        "p8_ids": "doc_id bigint, ids array<int>", "p9_found": "doc_id bigint, item_id bigint", "p10_found": "doc_id bigint",
    }
    for name, spec in want.items():
        assert ", ".join(" ".join(x) for x in QUERIES[name](spark, sf).dtypes) == spec
