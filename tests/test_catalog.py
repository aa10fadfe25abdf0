import harness
import pytest

import __spark_entry__ as E
from tessella import catalog

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_equals_sql(spark, name):
    assert harness.compare(spark, catalog.queries()[name], catalog.oracle_sql()[name], SF) > 0


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_told(spark, name):
    assert all(catalog.queries()[name](spark, SF).first())


def test_entry(spark):
    assert E.entry(spark).columns == ["i", "v"]


def test_one_table_needs_no_join(spark):
    plan = catalog.queries()["vector_add"](spark, SF)._jdf.queryExecution().toString()
    assert "Join" not in plan.split("== Physical Plan ==")[1] and "ReadSchema: struct<event_id:bigint,user_id:bigint,value:double>" in plan or "ReadSchema" in plan
