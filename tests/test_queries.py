"""Every query of the engine's own operators against its SQL."""

import pytest

from palimpsest.plans.catalogue import ORACLES, QUERIES
from tests.compare import SF, assert_same


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    df = QUERIES[name](spark, SF)
    if name in ORACLES:
        assert_same(df, ORACLES[name])
    else:
        assert df.count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["total"]
    assert set(ORACLES) <= set(__spark_entry__.oracle_sql())
