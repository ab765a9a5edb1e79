from __future__ import annotations

import __spark_entry__ as e


def test_entry(spark):
    df = e.entry(spark)
    assert df.columns == ["pair_id", "type", "severity", "summary", "t_node", "b_node"] and df.limit(1).count() == 1


def test_names():
    q = e.queries()
    assert set(e.oracle_sql()) <= set(q)
    assert all(callable(f) for f in q.values())
