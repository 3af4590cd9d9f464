"""Publishing marts for ad-hoc SQL, read only."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.errors import ParseException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PUBLISHED = "datamart_"
# Functions that run code or read beyond the views.
UNSAFE = frozenset({"reflect", "java_method", "try_reflect"})
# Table functions that make rows from their arguments only (no path, no catalog).
ROW_MAKERS = frozenset({"range", "explode", "explode_outer", "inline", "inline_outer", "posexplode", "posexplode_outer", "stack"})
# Plan nodes a read-only query is made of; any other node (commands, inserts, file sources, ...) is refused.
QUERY_NODES = frozenset({
    "Project", "Filter", "Aggregate", "Sort", "Distinct", "Deduplicate", "Union", "Except", "Intersect", "GlobalLimit",
    "LocalLimit", "Offset", "Tail", "SubqueryAlias", "Join", "LateralJoin", "UnresolvedRelation", "UnresolvedWith",
    "OneRowRelation", "LocalRelation", "UnresolvedInlineTable", "Generate", "UnresolvedHaving", "WithWindowDefinition",
    "Pivot", "Unpivot", "Sample", "RepartitionByExpression", "Repartition", "UnresolvedSubqueryColumnAliases",
    "UnresolvedHint", "UnresolvedTableValuedFunction", "UnresolvedTVFAliases"})
_SUBQUERY = "org.apache.spark.sql.catalyst.expressions.SubqueryExpression"


def register_marts(marts: Mapping[str, DataFrame]) -> None:
    """Publish frames as ``datamart_<name>`` temp views; a temp view cannot be written to."""
    for name, df in marts.items():
        df.createOrReplaceTempView(f"datamart_{name}")


def _items(seq) -> list:
    return [seq.apply(i) for i in range(seq.size())]


class _Guard:
    """Visits every node of a parsed plan, every expression of each node and the plan of every subquery, with the
    WITH members visible at that place (a member is seen by later members, itself and the query below its WITH)."""

    def __init__(self, spark: SparkSession, allow_with: bool):
        self.allow_with = allow_with
        self.subquery = spark.sparkContext._jvm.java.lang.Class.forName(_SUBQUERY)

    def plan(self, node, members: frozenset[str]) -> None:
        kind = node.getClass().getSimpleName()
        if kind not in QUERY_NODES:
            raise ValueError(f"only queries are allowed: {kind}")
        if kind == "UnresolvedWith":
            if not self.allow_with:
                raise ValueError("WITH is not allowed here")
            seen = set(members)
            for member in _items(node.cteRelations()):
                name = member._1().lower()
                self.plan(member._2(), frozenset(seen | {name}))
                seen.add(name)
            members = frozenset(seen)
        elif kind == "UnresolvedRelation":
            parts = [p.lower() for p in _items(node.multipartIdentifier())]
            if not (len(parts) == 1 and (parts[0] in members or parts[0].startswith(PUBLISHED))):
                raise ValueError(f"not a published view: {'.'.join(parts)}")
        elif kind == "UnresolvedTableValuedFunction":
            name = _items(node.name())
            if len(name) != 1 or name[0].lower() not in ROW_MAKERS:
                raise ValueError(f"the query calls what it may not: {'.'.join(name)}")
        for expression in _items(node.expressions()):
            self.expression(expression, members)
        for child in _items(node.children()):
            self.plan(child, members)

    def expression(self, expression, members: frozenset[str]) -> None:
        kind = expression.getClass().getSimpleName()
        if kind == "UnresolvedFunction":
            name = [p.lower() for p in _items(expression.nameParts())]
            if name[-1] in UNSAFE:
                raise ValueError(f"the query calls what it may not: {'.'.join(name)}")
        elif kind == "UnresolvedGenerator" and expression.name().funcName().lower() in UNSAFE:
            raise ValueError("the query calls what it may not")
        if self.subquery.isInstance(expression):
            self.plan(expression.plan(), members)
        for child in _items(expression.children()):
            self.expression(child, members)


def check_readonly(spark: SparkSession, sql: str, allow_with: bool = False) -> str:
    """The statement without its final semicolon, or ValueError unless it is one query over the published views.

    The statement is parsed, not run, and every node and expression of its plan is visited, subqueries and WITH
    members included: only query nodes, no relation but published views (``datamart_``, any case) and the WITH
    members in scope, no file read by path, no table function but those that make rows from their arguments, no
    function that calls Java. Text inside literals is never looked at.
    """
    statement = sql.strip().rstrip(";")
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(statement)
    except ParseException as problem:
        raise ValueError("not a single query") from problem
    _Guard(spark, allow_with).plan(plan, frozenset())
    return statement


def run_readonly_sql(spark: SparkSession, sql: str, allow_with: bool = False) -> DataFrame:
    """Run one query over the published views; all its rows come back."""
    return spark.sql(check_readonly(spark, sql, allow_with))


def describe_result(df: DataFrame, rows: int) -> dict:
    """The first ``rows`` rows, the column names, how many rows are shown, and whether there are more."""
    shown = [r.asDict() for r in df.take(rows + 1)]
    return {"data": shown[:rows], "schema": df.columns, "row_count": min(len(shown), rows), "more": len(shown) > rows}


def render_rows(df: DataFrame) -> DataFrame:
    """One text line per row, columns joined by ' | '."""
    return df.select(F.concat_ws(" | ", *[F.coalesce(F.col(c).cast("string"), F.lit("None")) for c in df.columns]).alias("line"))
