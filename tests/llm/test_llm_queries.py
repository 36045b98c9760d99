from pathlib import Path

import pytest

from compare import compare, database
from loomtime.llm import queries

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="no test data here")


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query(spark, name):
    said = compare(spark, database(FOLDER), name, FOLDER)
    assert "equal" in said or "no SQL" in said, said
