"""Every query with SQL gives what DuckDB gives, on the smallest tables."""

from pathlib import Path

import pytest

from compare import compare, database
from loomtime.plans import registry

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="no test data here")


@pytest.fixture(scope="module")
def db():
    return database(FOLDER)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, db, name):
    said = compare(spark, db, name, FOLDER)
    assert "equal" in said or "no SQL" in said, said
