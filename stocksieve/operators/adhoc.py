"""Ad-hoc SQL answered as JSON, behind a gate.

Questions are answered by SQL text (written by a person or a model) over
read-only views of the snapshot tables, each already restricted to the
``as_of`` snapshot.  The gate judges twice: the parsed plan must be one query
without commands and without a star, and the *analysed* plan, where every name
is resolved, may only hold

* query operators of ``_OPERATORS``;
* as leaves, the registered views (each taken whole, by the session's own
  resolution), rows written in the text, and references to the text's own
  common table expressions;
* expressions of the built-in functions in ``_FUNCTION_GROUPS`` and the plain
  building blocks in ``_BLOCKS``: no function that reads files, the session or
  the JVM, none defined by a user, none drawn at random.

So a name can't be smuggled in by a nested scope, and a function is refused
unless it is known to be harmless.

The answer is ``{"result": [...rows in the query's order...], "total": n,
"truncated": ...}`` with at most ``limit`` rows, or ``{"error": ...}``; an error
while the query runs is an error answer, too.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_path
from .screens import snapshot

MAX_ROWS = 100
ERROR_JSON = '{"error":"Invalid expression"}'

# Operators of an analysed query that only read and reshape rows.
_OPERATORS = {
    "Project", "Filter", "Aggregate", "Sort", "GlobalLimit", "LocalLimit", "Offset", "Distinct", "Deduplicate", "Join", "LateralJoin",
    "Union", "Intersect", "Except", "SubqueryAlias", "WithCTE", "CTERelationDef", "CTERelationRef", "Window", "Generate", "Expand",
    "OneRowRelation", "LocalRelation", "ResolvedInlineTable", "Pivot", "Unpivot", "UnresolvedHint", "ResolvedHint", "WithWindowDefinition",
}
# Groups of built-in functions whose result follows from their arguments alone.
_FUNCTION_GROUPS = {
    "agg_funcs", "array_funcs", "bitwise_funcs", "collection_funcs", "conditional_funcs", "conversion_funcs", "date_funcs", "datetime_funcs", "generator_funcs",
    "hash_funcs", "json_funcs", "lambda_funcs", "map_funcs", "math_funcs", "predicate_funcs", "string_funcs", "struct_funcs", "window_funcs",
}
_REFUSED_FUNCTIONS = {"rand", "random", "randn", "uniform", "randstr", "shuffle", "stack", "current_database", "current_catalog", "raise_error", "assert_true"}
# What expressions are put together from, besides functions.
_BLOCKS = {
    "Alias", "AttributeReference", "Literal", "Cast", "SortOrder", "AggregateExpression", "WindowExpression", "WindowSpecDefinition",
    "SpecifiedWindowFrame", "UnspecifiedFrame$", "UnboundedPreceding$", "UnboundedFollowing$", "CurrentRow$", "RowFrame$", "RangeFrame$",
    "ScalarSubquery", "Exists", "ListQuery", "InSubquery", "LateralSubquery", "OuterReference", "LambdaFunction", "NamedLambdaVariable", "GetStructField",
    "GetArrayItem", "GetMapValue", "GetArrayStructFields", "CaseWhen", "If", "Coalesce", "In", "InSet", "Like", "Not", "And", "Or", "EqualTo", "EqualNullSafe",
    "LessThan", "LessThanOrEqual", "GreaterThan", "GreaterThanOrEqual", "IsNull", "IsNotNull", "IsNaN", "Add", "Subtract", "Multiply", "Divide",
    "IntegralDivide", "Remainder", "Pmod", "UnaryMinus", "UnaryPositive", "Concat", "CreateNamedStruct", "CreateArray", "CreateMap", "Between", "Count", "Sum",
    "Average", "Min", "Max", "Lower", "Upper", "Substring", "StringLPad", "StringRPad", "Length", "OctetLength", "StringTrim", "StringTrimLeft",
    "StringTrimRight", "Round", "Ceil", "Floor", "DateAdd", "DateSub", "DateDiff", "ParseToDate", "CurrentDate", "Extract", "Year", "Month", "DayOfMonth",
    "With", "CommonExpressionRef", "CommonExpressionDef", "ExtractANSIIntervalDays", "DateFormatClass", "Explode", "PosExplode", "Inline", "GroupingID", "Grouping", "TimeAdd", "DatetimeSub", "SubtractDates", "SubtractTimestamps", "TryCast", "TryEval", "Collate",
}


def _each(seq) -> Iterator:
    for i in range(seq.size()):
        yield seq.apply(i)


def _name(node) -> str:
    return node.getClass().getSimpleName()


def _expressions(node) -> Iterator:
    todo = list(_each(node.expressions()))
    while todo:
        e = todo.pop()
        yield e
        todo += list(_each(e.children()))


_SUBQUERIES = ("ScalarSubquery", "Exists", "ListQuery", "LateralSubquery", "FunctionTableSubqueryArgumentExpression")


def _subplans(node) -> list:
    return [e.plan() for e in _expressions(node) if _name(e) in _SUBQUERIES]


# ---------------------------------------------------------------- the parsed plan

_CHANGES = ("Command", "Insert", "Create", "Drop", "Replace", "Merge", "Delete", "Update", "Truncate", "Alter", "Set", "Cache", "Uncache",
            "Refresh", "Describe", "Show", "Explain", "Transform", "TableValuedFunction")
_PLAIN_SET = ("SetOperation", "SetOperationStrategy")


def _parsed_nodes(plan) -> Iterator:
    """Every node of a parsed plan, those of subqueries and CTEs included."""
    todo = [plan]
    while todo:
        node = todo.pop()
        yield node
        todo += [*_each(node.children()), *_subplans(node)]
        if _name(node) == "UnresolvedWith":
            todo += [pair._2() for pair in _each(node.cteRelations())]


def _parsed_refusal(plan) -> str | None:
    for node in _parsed_nodes(plan):
        name = _name(node)
        if any(word in name for word in _CHANGES) and name not in _PLAIN_SET:
            return f"not a read-only query: {name}"
        if any("Star" in _name(e) for e in _expressions(node)):
            return "star projection"
    return None


# ---------------------------------------------------------------- the analysed plan

_allowed: dict = {}


def _function_classes(spark: SparkSession) -> set[str]:
    """Class names of the functions of the harmless groups, by the session's
    own list of built-in functions."""
    key = spark.version
    if key not in _allowed:
        classes = set()
        registry = getattr(spark._jvm.org.apache.spark.sql.catalyst.analysis, "FunctionRegistry$")
        listed = getattr(registry, "MODULE$").expressions()
        it = listed.iterator()
        while it.hasNext():
            pair = it.next()
            info = pair._2()._1()
            if info.getGroup() in _FUNCTION_GROUPS and pair._1() not in _REFUSED_FUNCTIONS:
                classes.add(info.getClassName().removesuffix("$").removesuffix("ExpressionBuilder"))
        _allowed[key] = classes
    return _allowed[key]


def _is_view(node, views: set[str]) -> bool:
    if _name(node) != "View" or not node.isTempView():
        return False
    ident = node.desc().identifier()
    return ident.database().isEmpty() and ident.table().lower() in views


def _analysed_refusal(spark: SparkSession, plan, views: set[str]) -> str | None:
    functions = _function_classes(spark)
    todo = [plan]
    while todo:
        node = todo.pop()
        if _is_view(node, views):
            continue  # a registered view, as it was registered
        name = _name(node)
        if name not in _OPERATORS:
            return f"not a registered view: {name}" if not node.children().size() or name == "View" else f"not a plain query: {name}"
        for e in _expressions(node):
            if _name(e) not in _BLOCKS and e.getClass().getName() not in functions:
                return f"not a plain function: {_name(e)}"
        todo += [*_each(node.children()), *_subplans(node)]
        if name == "WithCTE":
            todo += list(_each(node.cteDefs()))
    return None


def check_sql(spark: SparkSession, sql: str, views: set[str]) -> str | None:
    """Reason the text is refused, or ``None``.  Nothing is run."""
    state = spark._jsparkSession.sessionState()
    try:
        parsed = state.sqlParser().parsePlan(sql)
    except Exception:  # noqa: BLE001 - the parser's refusal
        return "not a query"
    refused = _parsed_refusal(parsed)
    if refused:
        return refused
    try:
        analysed = state.executePlan(parsed, getattr(getattr(spark._jvm.org.apache.spark.sql.execution, "CommandExecutionMode$"), "MODULE$").SKIP()).analyzed()
    except Exception:  # noqa: BLE001 - a name or type that doesn't resolve
        return "does not resolve"
    return _analysed_refusal(spark, analysed, {v.lower() for v in views})


def register_snapshot_views(spark: SparkSession, tables: dict[str, DataFrame], as_of) -> None:
    """Expose each table as a temp view holding only the ``as_of`` rows."""
    for name, df in tables.items():
        snapshot(df, as_of).createOrReplaceTempView(name)


def session_views(spark: SparkSession) -> set[str]:
    return {t.name for t in spark.catalog.listTables() if t.isTemporary}


# ---------------------------------------------------------------- answers

def _result(spark: SparkSession, sql: str, limit: int) -> DataFrame:
    """The query runs once, into the shared folder; count and rows are read
    from there."""
    rows = spark.sql(sql)
    if len({c.lower() for c in rows.columns}) < len(rows.columns):
        raise ValueError("two columns of one name")
    path = shared_path(spark, "adhoc", unique=True)
    record = F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("row")
    rows.select(record).withColumn("nth", F.monotonically_increasing_id()).write.parquet(path)
    kept = spark.read.parquet(path)
    first = kept.orderBy("nth").limit(limit).agg(F.transform(F.array_sort(F.collect_list(F.struct("nth", "row"))), lambda r: r["row"]).alias("result"))
    total = kept.agg(F.count("nth").alias("total"))
    body = F.struct("result", "total", (F.col("total") > limit).alias("truncated"))
    return first.crossJoin(total).select(F.to_json(body, {"ignoreNullFields": "false"}).alias("answer"))  # one row each


def answer(spark: SparkSession, sql: str, limit: int = MAX_ROWS, views: set[str] | None = None) -> DataFrame:
    """One row ``answer`` holding the JSON result of ``sql`` over ``views``
    (default: the session's temporary views).  The query runs here, for its
    errors are part of the answer."""
    sql = sql.strip().rstrip(";")
    if check_sql(spark, sql, session_views(spark) if views is None else views) is None:
        try:
            return _result(spark, sql, limit)
        except Exception:  # noqa: BLE001 - any failure is the error answer
            pass
    return spark.createDataFrame([(ERROR_JSON,)], "answer string")


def run_sql(spark: SparkSession, query, views: set[str] | None = None) -> DataFrame | None:
    """SQL text, or ``{"query": text}``, through the same gate -> DataFrame;
    ``None`` when it is refused."""
    if isinstance(query, dict):
        query = query["query"]
    text = query.strip().rstrip(";")
    if check_sql(spark, text, session_views(spark) if views is None else views) is not None:
        return None
    return spark.sql(text)
