import pytest

from conftest import DATA
from compare import oracle, rows
from gneiss import queries

SF = f"{DATA}/sf0.001"
QUERIES, ORACLE = queries.queries(), queries.oracle_sql()


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_oracle(spark, name):
    assert rows(QUERIES[name](spark, SF).toPandas()) == rows(oracle(ORACLE[name], SF))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_without_oracle_returns_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_page_is_a_top_k_and_scans_what_it_needs(spark):
    plan = QUERIES["page_middle"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "Exchange rangepartitioning" not in plan
    assert "l_comment" not in plan and "l_shipdate" not in plan


def test_entry(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.columns == ["l_returnflag", "l_linestatus", "n", "sum_qty", "avg_disc"] and df.count() > 0
