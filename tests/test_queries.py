import pytest

from linkspark.plans import catalogue
from tests.oracle import connected, rows_by_sql, rows_of


@pytest.fixture(scope="module")
def duck(data):
    return connected(f"{data}/sf0.001")


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_agrees_with_sql(spark, data, duck, name):
    columns, got = rows_of(catalogue.QUERIES[name](spark, f"{data}/sf0.001"))
    assert got == rows_by_sql(duck, catalogue.SQL[name], columns)


#: Columns that may be null in all rows of the smallest tables.
MAY_BE_NULL: dict[str, tuple[str, ...]] = {}


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.SQL)))
def test_runs(spark, data, name):
    df = catalogue.QUERIES[name](spark, f"{data}/sf0.001")
    rows = df.limit(2000).collect()
    assert rows and len(set(df.columns)) == len(df.columns)
    # every column says something somewhere, and what identifies a row is there in all of them (a recording is an attribute)
    assert all(any(r[c] is not None for r in rows) for c in df.columns if c not in MAY_BE_NULL.get(name, ()))
    assert all(r[c] is not None for r in rows for c in df.columns if c.endswith("_id") and c != "recording_id")


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_blocked_queries_have_no_cross_join(spark, data):
    for name in ("q_topk_parts", "q_blocking_candidates", "q_release_total_distance"):
        plan = catalogue.QUERIES[name](spark, f"{data}/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_scan_reads_only_needed_columns(spark, data):
    plan = catalogue.QUERIES["q_weighted_mean_set"](spark, f"{data}/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<l_quantity:double,l_discount:double,l_returnflag:string>" in plan
