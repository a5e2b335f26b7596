"""Every registered query against its DuckDB oracle (sf0.001; the driver
runs the same comparison at sf0.01).  Rows-only queries must run."""

import pytest

import __spark_entry__ as E
from conftest import SF001
from oracle import compare

Q = E.queries()
S = E.oracle_sql()


@pytest.mark.parametrize("name", sorted(Q))
def test_query(spark, name):
    if name not in S:
        assert Q[name](spark, SF001).count() >= 0
        return
    ok, msg = compare(spark, name, SF001, Q, S)
    assert ok, msg


def test_render_reports_all_symbols(spark):
    from tsfolds.plans.queries import v

    keys = ["run_id", "ticker"]
    want = {tuple(r) for r in v(spark, SF001, "orders_q").join(v(spark, SF001, "prices").select("ticker"), "ticker", "left_semi").select(*keys).distinct().collect()}
    got = {tuple(r) for r in Q["d12_render"](spark, SF001).select(*keys).distinct().collect()}
    assert got == want and len({t for _, t in got}) > 4
