"""The read-only guard, reply parsing, the catalog and the sinks."""

import inspect
import json
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.errors import AnalysisException

from memberlens.params import InvalidParameter
from memberlens.plans import adhoc, catalog
from memberlens.plans.catalog import Request
from memberlens.sources.retail import RetailWarehouse
from memberlens.sources.sinks import json_rows, write_json
from memberlens.sources.warehouse import ParquetWarehouse


@pytest.fixture(autouse=True)
def view(spark):
    spark.range(5).createOrReplaceTempView("numbers")


@pytest.mark.parametrize(
    "sql, expected",
    [
        ("select id from numbers order by id desc limit 2", [4, 3]),
        ("  WITH a AS (SELECT 7 AS x) SELECT x FROM a -- done", [7]),
        ("select max(id) from numbers;", [4]),
        ("select 'using; delete' is not null", [True]),
    ],
)
def test_queries_run(spark, sql, expected):
    assert [r[0] for r in adhoc.run_readonly_sql(spark, sql).collect()] == expected


@pytest.mark.parametrize(
    "sql",
    [
        "DELETE FROM numbers", "drop view numbers", "insert into t select 1", "(select 1)",
        "-- note\nselect 1", "explain select 1", "WITH a AS (SELECT 1 x) INSERT INTO t SELECT x FROM a",
        "with x as (select 1 y) from x insert into t select y", "select 1; drop view numbers",
        "select reflect('java.lang.Math', 'abs', -1)", "select transform(id) using 'cat' from numbers",
    ],
)
def test_everything_else_is_refused(spark, sql):
    with pytest.raises(adhoc.NotReadOnly):
        adhoc.run_readonly_sql(spark, sql)
    assert spark.table("numbers").count() == 5


def test_unknown_tables_are_reported_and_no_statement_gives_no_rows(spark):
    with pytest.raises(AnalysisException):
        adhoc.run_readonly_sql(spark, "select * from nowhere")
    assert adhoc.run_readonly_sql(spark, None) is None
    assert adhoc.answer(spark, "text only", None).rows is None
    assert adhoc.answer(spark, "t", "select 1 as one").rows.columns == ["one"]
    bound = adhoc.run_readonly_sql(spark, "select id from numbers where id > ? limit ?", [1, 2])
    assert bound.count() == 2


def test_replies(spark):
    texts = [
        '[{"text":"hi"},{"statement":"select 1"}]', "plain", "[1, 2]", '[{"statement":"s"}]', "[bad",
        '[3, {"text": 5}, {"text": "z"}, {"text": "y"}]', "[]",
    ]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, r string")
    got = adhoc.read_replies(frame, "r").orderBy("i").collect()
    assert [(r.interpretation, r.generated_sql) for r in got] == [
        ("hi", "select 1"), ("plain", None), ("", None), ("", "s"), ("[bad", None), ("z", None), ("", None),
    ]


def test_catalog_isolates_failures(spark, small, tmp_path):
    wh = RetailWarehouse(spark, small)
    requests = [
        Request("revenue_trend", {"months": 3}), Request("no_such_report"),
        Request("location_pnl", {"months": 99}), Request("churn_cohorts"),
        Request("campaign_performance"),
    ]

    def write(request, frame):
        write_json(frame, str(tmp_path / request.report))
        return request.report

    outcomes = catalog.run_many(wh, requests, write)
    assert [bool(o.error) for o in outcomes] == [False, True, True, True, False]
    assert "unknown report" in outcomes[1].error and "group_by" in outcomes[3].error
    written = spark.read.json(str(tmp_path / "campaign_performance"))
    assert written.count() == 6 and "cost_per_acquisition" in written.columns
    with pytest.raises(InvalidParameter):
        catalog.run_report(wh, "nothing")


def test_reports_on_written_tables_equal_those_on_derived_ones(spark, small, tmp_path):
    derived = RetailWarehouse(spark, small)
    derived.materialise(str(tmp_path))
    written = ParquetWarehouse(spark, str(tmp_path))
    ids = derived.source("part").selectExpr("p_partkey AS customer_id")
    arguments = {
        "churn_cohorts": {"group_by": "tier"},
        "room_payback": {"room_cost": 1000},
        "overtime_saving": {"cut_pct": 10},
        "cost_gap": {"city": "NATION_15", "other_city": "NATION_3"},
        "readonly_sql": {"sql": "SELECT location_id, count(*) AS n FROM bookings GROUP BY 1"},
    }
    for name in catalog.REPORTS:
        if name == "search_customers":
            continue
        given = dict(arguments.get(name, {}))
        if "ids" in inspect.signature(catalog.REPORTS[name]).parameters:
            given["ids"] = ids
        mine = catalog.run_report(written, name, **given)
        theirs = catalog.run_report(derived, name, **given)
        assert mine.dtypes == theirs.dtypes, name
        assert sorted(map(str, mine.collect())) == sorted(map(str, theirs.collect())), name


def test_catalog_names_every_report():
    assert len(catalog.REPORTS) == 37
    assert all(function.__doc__ for function in catalog.REPORTS.values())


def test_json_rows_keep_nulls(spark):
    frame = spark.createDataFrame([("a", None)], "x string, y int")
    assert json.loads(json_rows(frame).first()[0]) == {"x": "a", "y": None}


@pytest.mark.parametrize(
    "statement",
    [
        "SELECT `reflect`('java.lang.System', 'getProperty', 'user.home')",
        "SELECT reflect/* c */('java.lang.System', 'getProperty', 'user.home')",
        "SELECT reflect -- c\n ('java.lang.System', 'getProperty', 'user.home')",
        "SELECT * FROM parquet.`/any/path`",
        "SELECT 1) AS a, (SELECT 2",
        "/* c */ INSERT INTO t VALUES (1)",
        "SELECT IDENTIFIER('reflect')('java.lang.System', 'getProperty', 'java.version')",
        "SELECT IDENTIFIER('ref' || 'lect')('java.lang.System', 'getProperty', 'java.version')",
        "SELECT * FROM IDENTIFIER('parquet.`/any/path`')",
        "WITH a AS (SELECT java_method('java.lang.Math', 'abs', -1) AS x) SELECT x FROM a",
        "SELECT (SELECT try_reflect('java.lang.Math', 'abs', -1))",
        "SELECT id FROM numbers WHERE EXISTS (SELECT 1 FROM csv.`/etc`)",
        "SELECT id FROM numbers WHERE id IN (SELECT reflect('java.lang.Math', 'abs', -1))",
        "SELECT twice(id) FROM numbers",
        "SELECT * FROM numbers, LATERAL (SELECT twice(id) AS y)",
        "SELECT 1 /* open",
        "SELECT sum(id) OVER (ORDER BY twice(id)) FROM numbers",
        "WITH a AS (WITH b AS (SELECT * FROM json.`/any`) SELECT * FROM b) SELECT * FROM a",
    ],
)
def test_ways_around_the_guard_are_refused(spark, statement):
    spark.udf.register("twice", lambda x: x * 2, "long")
    with pytest.raises(adhoc.NotReadOnly):
        adhoc.run_readonly_sql(spark, statement)


def test_harmless_literals_and_bound_values_run(spark):
    rows = adhoc.run_readonly_sql(spark, "SELECT 'reflect (x)' AS a, :v AS b -- reflect(", {"v": 3}).collect()
    assert [tuple(r) for r in rows] == [("reflect (x)", 3)]


@pytest.mark.parametrize(
    "statement, expected",
    [
        ("WITH a AS (SELECT id FROM numbers), b AS (SELECT max(id) AS m FROM a) SELECT id FROM a, b WHERE id = m", [4]),
        ("SELECT n.id FROM numbers n JOIN range(3) r ON n.id = r.id WHERE n.id IN (SELECT 2 UNION ALL SELECT 9)", [2]),
        ("SELECT x FROM numbers LATERAL VIEW explode(array(id, 10)) t AS x WHERE id = 1 ORDER BY x", [1, 10]),
        ("SELECT count(DISTINCT id) FROM numbers GROUP BY ROLLUP (id % 2) ORDER BY 1 LIMIT 1", [2]),
        ("SELECT CAST(sum(id) OVER (ORDER BY id) AS LONG) AS s FROM numbers ORDER BY s DESC LIMIT 1 OFFSET 1", [6]),
        ("SELECT a FROM VALUES (1, 2) AS t(a, b) INTERSECT SELECT id FROM numbers", [1]),
        ("SELECT try_variant_get(parse_json('{\"a\": 3}'), '$.a', 'int') AS v", [3]),
        ("SELECT sum(v) FROM numbers PIVOT (count(*) AS v FOR id IN (1 AS v, 2))", [1]),
        ("SELECT id FROM numbers EXCEPT SELECT id FROM numbers WHERE id > 0", [0]),
        ("SELECT (SELECT max(id) FROM numbers m WHERE m.id < n.id) FROM numbers n WHERE id = 3", [2]),
    ],
)
def test_the_shapes_of_queries_run(spark, statement, expected):
    assert [r[0] for r in adhoc.run_readonly_sql(spark, statement).collect()] == expected


def test_statements_are_checked_side_by_side(spark):
    before = spark.conf.get("spark.sql.runSQLOnFiles")

    def one(k):
        if k % 2:
            with pytest.raises(adhoc.NotReadOnly):
                adhoc.run_readonly_sql(spark, "SELECT * FROM parquet.`/any/path`")
            return -1
        return adhoc.run_readonly_sql(spark, f"SELECT max(id) + {k} FROM numbers").first()[0]

    with ThreadPoolExecutor(8) as pool:
        assert list(pool.map(one, range(16))) == [-1 if k % 2 else 4 + k for k in range(16)]
    assert spark.conf.get("spark.sql.runSQLOnFiles") == before


def test_a_table_of_the_catalog_is_no_registered_view(spark):
    spark.range(3).write.mode("overwrite").saveAsTable("stored_numbers")
    with pytest.raises(adhoc.NotReadOnly):
        adhoc.run_readonly_sql(spark, "SELECT * FROM stored_numbers")
    spark.table("stored_numbers").createOrReplaceTempView("stored_view")
    assert adhoc.run_readonly_sql(spark, "SELECT count(*) FROM stored_view").first()[0] == 3
    spark.sql("DROP TABLE stored_numbers")
