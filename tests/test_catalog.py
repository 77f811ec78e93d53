import pytest

from quirebook.plans import catalog, upkeep  # noqa: F401  upkeep adds to the catalogue
from tests.differential import differences, duck

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_against_sql(spark, con, name):
    found = differences(catalog.QUERIES[name](spark, SF), con, catalog.ORACLE_SQL[name])
    assert found in ("", "no rows") and (found == "" or name in ("grep_context", "grep_regex", "prefix_scan")), found
