"""Every query of the subpackage runs on the smallest tables; those with SQL agree with it."""

import pytest

from landweave.llm.queries import ORACLES, QUERIES
from tests.compare import database, same_rows


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    if name in ORACLES:
        same_rows(df, database(sf_dir), ORACLES[name])
    else:
        assert df.count() >= 0
