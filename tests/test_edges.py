"""Every core query on empty tables, and on tables with null rows, repeated rows and clashing columns."""

import pytest

from quillspark.plans import library, library_checks, library_extract, library_knowledge, library_more, library_planning, library_service, library_text, problems  # noqa: F401
from tests.fixtures import SMALL, dirty, empty

pytestmark = pytest.mark.skipif(not SMALL.exists(), reason="no test tables")
#: These have a row whatever they read, or none without an answer stream's files.
ALWAYS = {"agg_17_completeness", "agg_25_26_calibration", "agg_rollup_by_class"}
#: These also hold the registry's own names and formulas.
ALWAYS |= {"jn_21_set_09_formula_matches", "qc_02_str_23_variants", "qc_03_equivalents", "str_16_17_18_formula_meanings", "str_22_symbol_differences"}
QUERIES = problems.QUERIES | library.QUERIES


@pytest.fixture(scope="module")
def folders(spark, tmp_path_factory):
    return empty(spark, tmp_path_factory.mktemp("empty")), dirty(spark, tmp_path_factory.mktemp("dirty"))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_survives(spark, folders, name):
    if name not in ALWAYS:
        assert QUERIES[name](spark, folders[0]).count() == 0
    assert QUERIES[name](spark, folders[1]).count() > 0


@pytest.mark.parametrize("name", ["p4_found", "p5_by_type", "p6_found", "p6_sittings"])
def test_null_and_repeated_rows_change_nothing(spark, folders, name):
    clean = {tuple(r) for r in QUERIES[name](spark, str(SMALL)).collect()}
    assert {tuple(r) for r in QUERIES[name](spark, folders[1]).collect()} == clean
