"""Operators that SQL can express against their statements, on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from memberlens.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_matches_statement(spark, name):
    duck = duckdb.connect()
    for path in Path(SF).glob("*.parquet"):
        duck.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    result = duck.execute(queries.oracle_sql()[name])
    columns = [d[0] for d in result.description]
    mine = queries.queries()[name](spark, SF)
    assert sorted(mine.columns) == sorted(columns)
    assert sorted(map(str, map(tuple, mine.select(*columns).collect()))) == sorted(map(str, result.fetchall()))


def test_every_operator_has_a_query():
    assert sorted(int(name[2:].split("_")[0]) for name in queries.queries()) == list(range(1, 14))
