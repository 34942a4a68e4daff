"""Ad-hoc SQL over the registered tables, queries only, and the replies that propose it."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

from py4j.java_gateway import JavaObject, is_instance_of
from pyspark.errors import ParseException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed value: how an accepted statement begins.
_QUERY_START = re.compile(r"\s*(select|with)\b", re.IGNORECASE)
_CATALYST = "org.apache.spark.sql.catalyst"

#: what an analysed query may consist of; a view stands for the table registered under its name
_OPERATORS = frozenset(
    """
    Aggregate AsOfJoin CTERelationDef CTERelationRef Deduplicate Distinct Except Expand Filter Generate GlobalLimit
    Intersect Join LateralJoin LocalLimit LocalRelation Offset OneRowRelation Project Range RebalancePartitions
    Repartition RepartitionByExpression ResolvedHint Sample Sort SubqueryAlias Tail Union Window WithCTE
    """.split()
)
_TABLES = frozenset(["View"])
#: what stands for a relation before the analysis, and the names that only the analysis would work out
_NAMED = "UnresolvedRelation"
_WORKED_OUT = re.compile(r"(Plan|Expression|Relation)WithUnresolvedIdentifier")
#: calls that leave SQL; functions of the session itself (Python, Scala, Hive) are no built-in expressions or among these
_OUTSIDE = frozenset(
    """
    CallMethodViaReflection TryReflect ScalaUDF PythonUDF PythonUDAF PythonUDTF PythonFuncExpression
    UnresolvedPolymorphicPythonUDTF ScalaAggregator ScalaUDAF ScriptInputOutputSchema
    """.split()
)


class NotReadOnly(ValueError):
    """The statement is something else than a query over registered tables."""


def _items(sequence: JavaObject) -> Iterator[JavaObject]:
    for i in range(sequence.size()):
        yield sequence.apply(i)


def _nodes(spark: SparkSession, plan: JavaObject) -> Iterator[tuple[str, JavaObject]]:
    """Class name and node of every operator and expression of ``plan``, subqueries included.

    A view is given, but not what it stands for.
    """
    gateway = spark.sparkContext._gateway
    open_nodes = [plan]
    while open_nodes:
        node = open_nodes.pop()
        name = node.getClass().getName()
        yield name, node
        if name.rsplit(".", 1)[-1] in _TABLES:
            continue
        open_nodes += _items(node.children())
        if is_instance_of(gateway, node, f"{_CATALYST}.plans.logical.LogicalPlan"):
            open_nodes += _items(node.expressions())
            if name.endswith(".UnresolvedWith"):
                open_nodes += _items(node.innerChildren())
        elif is_instance_of(gateway, node, f"{_CATALYST}.expressions.PlanExpression"):
            open_nodes.append(node.plan())


def _check_names(spark: SparkSession, statement: str) -> None:
    """Refuse what is no single query, and tables that are named by a path or a worked-out name.

    Only parsed, so nothing is looked up yet: the analysis would already open a file named as a table.
    """
    try:
        parsed = spark._jsparkSession.sessionState().sqlParser().parsePlan(statement)
    except ParseException as error:
        raise NotReadOnly("the statement is not a single query") from error
    for name, node in _nodes(spark, parsed):
        short = name.rsplit(".", 1)[-1]
        if _WORKED_OUT.fullmatch(short):
            raise NotReadOnly("names that are worked out are not accepted")
        if short == _NAMED:
            parts = list(_items(node.multipartIdentifier()))
            # a plain name is a view, a common table expression or unknown; unknown ones are reported later
            if len(parts) > 1 and not spark.catalog.tableExists(".".join(f"`{p.replace('`', '``')}`" for p in parts)):
                raise NotReadOnly("only registered tables are accepted")


def _check_plan(spark: SparkSession, analysed: JavaObject) -> None:
    """Refuse operators, relations and functions that are not known to stay inside SQL."""
    for name, node in _nodes(spark, analysed):
        package, short = name.rsplit(".", 1)
        if is_instance_of(spark.sparkContext._gateway, node, f"{_CATALYST}.plans.logical.LogicalPlan"):
            if short not in _OPERATORS | _TABLES:
                raise NotReadOnly(f"{short} is not accepted in a query")
        elif short in _OUTSIDE or not package.startswith(f"{_CATALYST}.expressions"):
            raise NotReadOnly(f"the function {short} is not accepted")


def _single(sql: str) -> str:
    """The statement without a closing semicolon."""
    return re.sub(r"[\s;]+$", "", sql)


def run_readonly_sql(spark: SparkSession, sql: str | None, args=None) -> DataFrame | None:
    """Rows of a query; None when there is no statement to run.

    Everything but a single query over registered views is refused before anything runs: the statement is
    parsed, then analysed as the source of a FROM clause, where only queries are allowed, and every operator,
    relation and function of that plan has to be a known one. No setting of the session is touched, so
    statements may be checked side by side.
    """
    if not sql:
        return None
    if not _QUERY_START.match(sql):
        raise NotReadOnly("only SELECT or WITH queries are accepted")
    statement = _single(sql)
    _check_names(spark, statement)
    try:
        rows = spark.sql(f"SELECT * FROM (\n{statement}\n) AS candidate", args=args)
    except ParseException as error:
        raise NotReadOnly("the statement is not a single query") from error
    _check_plan(spark, rows._jdf.queryExecution().analyzed())
    return rows


@dataclass(frozen=True)
class Answer:
    interpretation: str
    statement: str | None
    rows: DataFrame | None


def answer(spark: SparkSession, interpretation: str, statement: str | None) -> Answer:
    """A reply's text with the rows of the statement it proposed, if any."""
    return Answer(interpretation, statement or None, run_readonly_sql(spark, statement))


def _string_fields(parts: Column, path: str) -> Column:
    """Values at ``path`` of the parts that hold a string there, in order."""
    values = F.transform(parts, lambda part: F.try_variant_get(part, path, "variant"))
    strings = F.filter(values, lambda value: F.schema_of_variant(value) == "STRING")
    return F.transform(strings, lambda value: F.try_variant_get(value, "$", "string"))


def read_replies(replies: DataFrame, column: str) -> DataFrame:
    """First text and first statement of every reply.

    A reply is a JSON array of parts with ``text`` or ``statement``; any other text is taken as the
    interpretation itself. The interpretation is empty when no part has a text.
    """
    reply = F.col(column)
    parts = F.try_variant_get(F.try_parse_json(reply), "$", "array<variant>")
    first_text = F.coalesce(F.get(_string_fields(F.col("_parts"), "$.text"), 0), F.lit(""))
    statements = _string_fields(F.col("_parts"), "$.statement")
    return (
        replies.withColumn("_parts", parts)
        .withColumn(
            "interpretation", F.when(F.col("_parts").isNull(), reply).otherwise(first_text)
        )
        .withColumn("generated_sql", F.get(statements, 0))
        .drop("_parts")
    )
