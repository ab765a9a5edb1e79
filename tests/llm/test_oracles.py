from __future__ import annotations

import pytest

from paperloom.llm.queries import oracle_sql, queries

from ..compare import connect, differences


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_twin(spark, sf, name):
    assert differences(spark, connect(sf), sf, queries()[name], oracle_sql()[name]) is None
