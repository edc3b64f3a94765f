"""Every core query against its SQL, on the smallest tables."""

import pytest

from landweave.queries import ORACLES, QUERIES
from tests.compare import database, same_rows


@pytest.fixture(scope="module")
def db(sf_dir):
    return database(sf_dir)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, db, name):
    df = QUERIES[name](spark, sf_dir)
    if name in ORACLES:
        same_rows(df, db, ORACLES[name])
    else:
        df.collect()


def test_entry(spark, sf_dir):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0
