"""Every registered query against its statement, on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entries

# those of the training-data subpackage have tests of their own
_OWN = entries._entries()
QUERIES = {name: entries.queries()[name] for name in _OWN}
STATEMENTS = {name: text for name, text in entries.oracle_sql().items() if name in _OWN}
FAMILY = {
    "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "date": "DATE",
    "timestamp_ntz": "TIMESTAMP", "int": "INTEGER",
}


@pytest.fixture(scope="module")
def duck(small):
    connection = duckdb.connect()
    for path in Path(small).glob("*.parquet"):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return connection


def shown(value):
    if isinstance(value, float):
        return repr(round(value, 6))
    return str(value)


def test_every_query_has_a_statement():
    assert sorted(QUERIES) == sorted(STATEMENTS)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_statement(spark, small, duck, name, capsys):
    frame = QUERIES[name](spark, small)
    capsys.readouterr()
    frame.explain()
    plan = capsys.readouterr().out
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    result = duck.execute(STATEMENTS[name])
    types = {d[0]: str(d[1]) for d in result.description}
    assert {f.name: FAMILY[f.dataType.simpleString()] for f in frame.schema.fields} == types
    columns = sorted(frame.columns)
    places = [list(types).index(c) for c in columns]
    mine = sorted(tuple(shown(v) for v in row) for row in frame.select(*columns).collect())
    theirs = sorted(tuple(shown(row[i]) for i in places) for row in result.fetchall())
    assert mine == theirs
    assert mine


@pytest.mark.parametrize(
    "name, facts",
    [("r09_revenue_trend", 1), ("r11_location_pnl", 3), ("r14_labor_cost_by_role", 1),
     ("r10_booking_forecast", 1), ("r18_staffing_summary", 1)],
)
def test_look_back_reaches_the_scan(spark, small, name, facts, capsys):
    QUERIES[name](spark, small).explain("formatted")
    pushed = [
        line for line in capsys.readouterr().out.splitlines()
        if "PushedFilters" in line and "date,ScalarSubquery" in line
    ]
    assert len(pushed) == facts


def test_entry(spark, small):
    assert entries.entry(spark).count() > 0
