"""Every registered query against its SQL on the smallest tables."""

from __future__ import annotations

from pathlib import Path

import pytest

import __spark_entry__ as entry
from postwatch.plans import fixture
from postwatch.plans.oracles import ORACLES
from postwatch.plans.registry import QUERIES
from tests.check_oracles import compare, connect

ROWS_ONLY: set[str] = set()


@pytest.fixture(scope="module")
def duck(sf_dir):
    return connect(sf_dir)


def test_every_query_has_sql_or_is_known_to_have_none():
    assert set(QUERIES) - set(ORACLES) == ROWS_ONLY
    assert set(ORACLES) <= set(QUERIES) <= set(entry.queries())
    assert set(ORACLES) <= set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, sf_dir, name):
    frame = QUERIES[name](spark, sf_dir).toPandas()
    if name in ROWS_ONLY:
        assert len(frame) > 0
        return
    assert compare(frame, duck.execute(ORACLES[name]).df()) is None


def test_stream_deletes_stores_its_posts_once(spark, duck, sf_dir, tmp_path):
    """Posts that no query has stored yet are stored by this one alone, with the same result as from stored ones."""
    here = f"{tmp_path}/tables"
    Path(here).symlink_to(sf_dir)
    wanted = duck.execute(ORACLES["stream_deletes"]).df()
    assert compare(QUERIES["stream_deletes"](spark, here).toPandas(), wanted) is None
    assert not any(place[1] == here for place in fixture._STORED)
    fixture.stored_path(spark, here)
    assert compare(QUERIES["stream_deletes"](spark, here).toPandas(), wanted) is None


def test_entry(spark):
    assert len(entry.entry(spark).collect()) > 0
