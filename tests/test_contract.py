import pytest

import __spark_entry__ as entry_module
from contract.check import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(entry_module.oracle_sql()))
def test_query_and_sql_agree(spark, con, name):
    result, _ = compare(spark, con, SF, name)
    assert result.startswith("ok"), result


def test_entry(spark):
    df = entry_module.entry(spark)
    assert df.columns == ["run_id", "part_no", "n_parts", "offset", "html"]
    assert df.count() == 531


def test_every_sql_has_a_query():
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())
