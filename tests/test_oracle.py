"""Every registered query with oracle SQL holds the same rows in both engines."""

import pytest

from checks import catalog, compare

ROWS_ONLY = {"score_models", "top_feature_importance", "ridge_fit"}


@pytest.fixture(scope="module")
def con(folder):
    return compare.oracle_connection(folder)


@pytest.mark.parametrize("name", list(catalog.REG.sql))
def test_same_rows(spark, folder, con, name):
    df = catalog.REG.queries[name](spark, folder)
    assert con.sql(catalog.REG.sql[name]).limit(1).fetchall()
    assert compare.type_difference(df, con, catalog.REG.sql[name]) == []
    assert compare.difference(df, con, catalog.REG.sql[name]) is None


@pytest.mark.parametrize("name", sorted(ROWS_ONLY))
def test_has_rows(spark, folder, name):
    assert catalog.REG.queries[name](spark, folder).count() > 0


def test_every_oracle_has_a_query():
    assert set(catalog.REG.sql) <= set(catalog.REG.queries)
