"""Which SQL statements of users may run: one query, on given tables, with functions that only compute.

The session's own parser makes the plan; what stands in it decides, not how the text is written. Node
types, relations and functions are each held against a list of what is allowed, so what isn't known is refused.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Set

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession

#: Plan nodes of queries; commands are none of them.
NODES = frozenset(
    "Project Filter UnresolvedRelation UnresolvedWith SubqueryAlias UnresolvedSubqueryColumnAliases Join LateralJoin Aggregate Sort GlobalLimit LocalLimit Limit Offset Distinct Union Except Intersect "
    "UnresolvedInlineTable ResolvedInlineTable OneRowRelation LocalRelation UnresolvedHaving WithWindowDefinition Window Generate Pivot Unpivot Sample UnresolvedTableValuedFunction UnresolvedTVFAliases AsOfJoin Deduplicate UnionLoop UnresolvedOrdinal".split()
)
#: Groups of built-in functions that compute values from their arguments alone.
GROUPS = frozenset("agg_funcs array_funcs bitwise_funcs collection_funcs conditional_funcs conversion_funcs csv_funcs date_funcs datetime_funcs generator_funcs hash_funcs json_funcs lambda_funcs map_funcs math_funcs predicate_funcs string_funcs struct_funcs url_funcs window_funcs xml_funcs variant_funcs table_funcs sketch_funcs st_funcs vector_funcs".split())
#: Functions of other groups that do so too, and table functions without a group.
HARMLESS = frozenset("typeof monotonically_increasing_id equal_null range explode explode_outer posexplode posexplode_outer inline inline_outer stack json_tuple".split())


class Refused(ValueError):
    """Why a statement may not run."""


def _each(sequence) -> Iterator:
    items = sequence.iterator()
    while items.hasNext():
        yield items.next()


class _Walk:
    def __init__(self, spark: SparkSession, tables: Set[str] | None) -> None:
        self.spark, self.tables = spark, tables
        self.catalog = spark._jsparkSession.sessionState().catalog()
        self.identifier = spark._jvm.org.apache.spark.sql.catalyst.FunctionIdentifier
        self.known: dict[str, bool] = {}

    def relation(self, parts: list[str], named: Set[str]) -> None:
        name = ".".join(parts)
        if len(parts) == 1 and name.lower() in named:
            return
        if self.tables is None:
            # what is no table of the catalog may be a path of files
            if not self.spark.catalog.tableExists(".".join(f"`{p.replace('`', '``')}`" for p in parts)):
                raise Refused(f"{name} is no table")
        elif len(parts) > 1 or name.lower() not in self.tables:
            raise Refused(f"only {', '.join(sorted(self.tables))} may be read, not {name}")

    def function(self, parts: list[str]) -> None:
        name = parts[-1].lower()
        if len(parts) > 1 or not self._computes(name):
            raise Refused(f"the function {'.'.join(parts)} may not be used")

    def _computes(self, name: str) -> bool:
        if name in HARMLESS:
            return True
        if name not in self.known:
            try:
                info = self.catalog.lookupFunctionInfo(self.identifier(name))
                self.known[name] = info.getSource() == "built-in" and info.getGroup() in GROUPS
            except (Py4JJavaError, PySparkException):
                self.known[name] = False
        return self.known[name]

    def expression(self, e, named: Set[str]) -> None:
        kind = e.getClass().getSimpleName()
        if kind in ("UnresolvedFunction", "UnresolvedTableValuedFunction"):
            self.function([str(p) for p in _each(e.nameParts())])
        elif kind == "UnresolvedGenerator":
            self.function([e.name().funcName()])
        elif kind in ("ScalarSubquery", "Exists", "ListQuery", "LateralSubquery", "FunctionTableSubqueryArgumentExpression"):
            self.plan(e.plan(), named)
        elif ("Subquery" in kind and kind != "InSubquery") or "UDF" in kind or kind in ("CallMethodViaReflection", "TryReflect"):
            raise Refused(f"{kind} may not be used")
        if kind == "UnresolvedFunction":
            for part in _each(e.arguments()):
                self.expression(part, named)
        for part in _each(e.children()):
            self.expression(part, named)

    def plan(self, node, named: Set[str]) -> None:
        """``named``: common table expressions that are in scope, in lower case."""
        kind = node.getClass().getSimpleName()
        if kind not in NODES:
            raise Refused(f"{kind} is no part of a query")
        if kind == "UnresolvedRelation":
            self.relation([str(p) for p in _each(node.multipartIdentifier())], named)
        elif kind == "UnresolvedTableValuedFunction":
            self.function([str(p) for p in _each(node.name())])
        elif kind == "UnresolvedWith":
            for entry in _each(node.cteRelations()):
                name = str(entry._1()).lower()
                self.plan(entry._2(), named | {name} if node.allowRecursion() else named)
                named = named | {name}
        elif kind == "WithWindowDefinition":
            for entry in _each(node.windowDefinitions()):
                self.expression(entry._2(), named)
        for e in _each(node.expressions()):
            self.expression(e, named)
        for child in _each(node.children()):
            self.plan(child, named)


def check(spark: SparkSession, query: str, tables: Set[str] | None = None) -> None:
    """Raises ``Refused`` unless ``query`` is one query that reads only ``tables`` (lower case; None: tables and views of the catalog), and calls only functions that compute."""
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(query)
    except (Py4JJavaError, PySparkException) as why:
        raise Refused(f"one query is allowed: {str(why).splitlines()[0][:200]}") from None
    _Walk(spark, tables).plan(plan, frozenset())


def guarded(spark: SparkSession, query: str, most_rows: int, views: Mapping[str, DataFrame] | None = None) -> DataFrame:
    """Runs one query; at most ``most_rows`` rows come back.

    With ``views`` only these may be read, by their names; without, the tables and views of the
    session's catalog. Neither files nor functions that reach beyond their arguments may be used.
    """
    body = query.strip().rstrip(";")
    check(spark, body, None if views is None else {v.lower() for v in views})
    if views is None:
        return spark.sql(body).limit(most_rows)
    # the views become common table expressions, so nothing is registered in the session
    named = ", ".join(f"{name} AS (SELECT * FROM {{{name}}})" for name in views)
    body = body.replace("{", "{{").replace("}", "}}")
    return spark.sql(f"WITH {named} SELECT * FROM (\n{body}\n)", **views).limit(most_rows)
