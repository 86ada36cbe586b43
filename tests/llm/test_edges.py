"""Every text query on empty tables, and on tables with null rows, repeated rows and clashing columns."""

import pytest

from quillspark.llm.registry import queries
from tests.fixtures import SMALL, dirty, empty

pytestmark = pytest.mark.skipif(not SMALL.exists(), reason="no test tables")


@pytest.fixture(scope="module")
def folders(spark, tmp_path_factory):
    return empty(spark, tmp_path_factory.mktemp("empty")), dirty(spark, tmp_path_factory.mktemp("dirty"))


@pytest.mark.parametrize("name", sorted(queries()))
def test_query_survives(spark, folders, name):
    assert queries()[name](spark, folders[0]).count() == 0
    assert queries()[name](spark, folders[1]).count() > 0


@pytest.mark.parametrize("name", ["p3_percentiles", "p7_found", "p8_found"])
def test_null_and_repeated_rows_change_nothing(spark, folders, name):
    clean = {tuple(r) for r in queries()[name](spark, str(SMALL)).collect()}
    assert {tuple(r) for r in queries()[name](spark, folders[1]).collect()} == clean
