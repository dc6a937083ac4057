"""Every registered query against its reference SQL."""

import oracle
import pytest

from assayer.catalogue import ORACLES, QUERIES


@pytest.fixture(scope="module")
def db(sf_dir):
    with oracle.connect(sf_dir) as connection:
        yield connection


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, db, name):
    df = QUERIES[name](spark, sf_dir)
    if name in ORACLES:
        assert oracle.differences(df, db, ORACLES[name]) == []
    else:
        assert df.count() > 0


def test_star_pairs_are_the_ones_in_the_reference_sql(spark, sf_dir):
    from assayer.catalogue import links

    found = {frozenset([p[:2], p[2:]]) for p in links.expected_star_pairs(spark, sf_dir)}
    assert found == {frozenset([p[:2], p[2:]]) for p in links._STAR_PAIRS}
