import pytest

from linkspark.llm import queries
from tests.oracle import connected, rows_by_sql, rows_of

FOUND = {
    "p1_found": ["catalogue_id", "release_id"], "p2_found": ["release_id_a", "release_id_b"], "p3_found": ["field_name", "name_a", "name_b"], "p5_found": ["field_name", "record_id"],
    "p6_found": ["field_name", "record_id"], "p8_found": ["doc_id", "item_id"], "p9_found": ["doc_id", "lang"],
}


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_agrees_with_sql(spark, data, name):
    columns, got = rows_of(queries.QUERIES[name](spark, f"{data}/sf0.001"))
    assert got == rows_by_sql(connected(f"{data}/sf0.001"), queries.SQL[name], columns)


@pytest.mark.parametrize("name", sorted(FOUND))
def test_columns_and_distinct_rows(spark, data, name):
    df = queries.QUERIES[name](spark, f"{data}/sf0.001")
    rows = df.collect()
    assert sorted(df.columns) == FOUND[name] and rows and len(set(rows)) == len(rows)


def test_nothing_else_imports_the_subpackage():
    import pathlib

    root = pathlib.Path(queries.__file__).parents[1]
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert "linkspark.llm" not in p.read_text(), p
