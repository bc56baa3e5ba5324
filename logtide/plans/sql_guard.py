"""Read-only SQL over the store: one query, of known relations and functions, with a cap on rows, texts and time.

What is allowed is named: kinds of nodes of the analysed plan, and groups of Spark's own functions,
by which each function that the parsed query calls is looked up in the registry.
"""

from __future__ import annotations

import re
import threading
import uuid
from collections.abc import Sequence

from py4j.java_gateway import is_instance_of
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logtide.functions.times import ArgumentError

MOST_ROWS = 200
SECONDS = 30.0
#: Nodes of a parsed statement that read nothing but rows.
_REFUSED_NODE = re.compile(r"Command|Insert|ScriptTransformation|CompoundBody|SetCatalog|SetNamespace|Create|Drop|Alter|Show|Describe|Cache|Refresh|Load|Merge|Delete|Update|Use|Call|Analyze|Truncate")
#: Nodes that an analysed query may have.
NODES = frozenset(
    """
    Aggregate CTERelationDef CTERelationRef Distinct Except Expand Filter Generate GlobalLimit Intersect Join LateralJoin LocalLimit LocalRelation
    LogicalRDD LogicalRelation Offset OneRowRelation Pivot Project Range ResolvedHint Sample Sort SubqueryAlias Union Unpivot View Window WithCTE
    """.split()
)
#: Groups of functions, as Spark names them, that compute from their arguments alone; of other groups, single functions.
GROUPS = frozenset(f"{g}_funcs" for g in "agg array bitwise collection conditional conversion csv datetime generator hash json lambda map math predicate string struct url variant window xml".split())
FUNCTIONS = frozenset("typeof monotonically_increasing_id try_element_at uuid rand randn random range".split())
#: Characters of a text that come to the driver.
MOST_CHARS = 100_000
_TABLE_FUNCTIONS = frozenset("range explode posexplode inline stack sequence".split())


def _nodes(gateway, plan) -> list:
    """The plan's nodes, those of subqueries and common table expressions included."""
    out = [plan]
    for children in (plan.children(), plan.innerChildren(), plan.subqueries()):
        it = children.iterator()
        while it.hasNext():
            child = it.next()
            if is_instance_of(gateway, child, "org.apache.spark.sql.catalyst.plans.logical.LogicalPlan"):
                out += _nodes(gateway, child)
    return out


def checked(spark: SparkSession, sql: str, relations: Sequence[str]) -> None:
    """Raise ArgumentError unless ``sql`` is one query over ``relations``."""
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    except PySparkException as e:
        raise ArgumentError(f"not a query: {str(e)[:300]}") from e
    allowed = {r.lower() for r in relations}
    name = plan.getClass().getSimpleName()
    if name == "ExplainCommand":
        plan = plan.logicalPlan()
        name = plan.getClass().getSimpleName()
    names: set[str] = set()
    for node in _nodes(spark.sparkContext._gateway, plan):
        kind = node.getClass().getSimpleName()
        if _REFUSED_NODE.search(kind):
            raise ArgumentError(f"only queries are run, not {kind}")
        if kind == "UnresolvedWith":
            it = node.cteRelations().iterator()
            while it.hasNext():
                names.add(it.next()._1().lower())
    refused = sorted({f for node in _nodes(spark.sparkContext._gateway, plan) for f in _called(node) if not is_allowed(spark, f)})
    if refused:
        raise ArgumentError(f"not allowed: {', '.join(refused)}")
    text = plan.toString()
    for found in re.findall(r"'?UnresolvedRelation \[([^\]]*)\]", text):
        if found.lower() not in allowed | names:
            raise ArgumentError(f"no such table: {found}")
    for found in re.findall(r"'?UnresolvedTableValuedFunction \[([^\]]*)\]", text):
        if found.lower() not in _TABLE_FUNCTIONS:
            raise ArgumentError(f"not allowed: {found}")


def _called(node) -> set[str]:
    """Names of the functions that a parsed node's expressions call; those of subqueries belong to their own nodes."""
    out, open_ = set(), [node.expressions()]
    while open_:
        it = open_.pop().iterator()
        while it.hasNext():
            e = it.next()
            if e.getClass().getSimpleName() == "UnresolvedFunction":
                out.add(".".join(e.nameParts().mkString("\0").split("\0")))
            open_.append(e.children())
    return out


def is_allowed(spark: SparkSession, function: str) -> bool:
    """Whether it is one of Spark's own functions, of a group that is allowed or named itself."""
    name = function.lower()
    if name in FUNCTIONS:
        return True
    registry = spark._jsparkSession.sessionState().functionRegistry()
    found = registry.lookupFunction(spark._jvm.org.apache.spark.sql.catalyst.FunctionIdentifier(name))
    if found.isEmpty():
        return False
    info = found.get()
    return info.getClassName().startswith("org.apache.spark.sql.catalyst.expressions.") and info.getGroup() in GROUPS


def analysed(spark: SparkSession, sql: str) -> DataFrame:
    """The query, whose analysed plan has only nodes that are allowed; nothing has run."""
    found = spark.sql(sql)
    plan = found._jdf.queryExecution().analyzed()
    # Explaining runs nothing; what is explained was checked as it was parsed.
    if plan.getClass().getSimpleName() == "ExplainCommand":
        return found
    kinds = {node.getClass().getSimpleName() for node in _nodes(spark.sparkContext._gateway, plan)}
    if odd := sorted(kinds - NODES):
        raise ArgumentError(f"not allowed in a query: {', '.join(odd)}")
    return found


def run(spark: SparkSession, tables: dict[str, DataFrame], sql: str, most: int = MOST_ROWS, seconds: float = SECONDS) -> tuple[list[str], list[tuple], bool]:
    """(columns, rows, whether there are more) of one query.

    The query's own session has the tables as views and reads no files by path; a timer
    cancels its jobs.
    """
    own = spark.newSession()
    own.conf.set("spark.sql.runSQLOnFiles", "false")
    for name, df in tables.items():
        path = df.inputFiles()
        (own.read.schema(df.schema).parquet(*path) if path else own.createDataFrame([], df.schema)).createOrReplaceTempView(name)
    checked(own, sql, list(tables))
    group, late = uuid.uuid4().hex, threading.Event()

    def stop():
        late.set()
        spark.sparkContext.cancelJobGroup(group)

    timer = threading.Timer(max(0.1, min(seconds, SECONDS)), stop)
    spark.sparkContext.setJobGroup(group, "run_sql", interruptOnCancel=True)
    timer.start()
    try:
        found = analysed(own, sql)
        # No longer texts than anyone reads.
        cut = found.toDF(*[f"c{i}" for i in range(len(found.columns))])
        cut = cut.select(*[F.substring(c, 1, MOST_CHARS).alias(c) if kind == "string" else F.col(c) for c, kind in cut.dtypes])
        rows = cut.limit(most + 1).collect()
    except ArgumentError:
        raise
    except Exception as e:
        if late.is_set():
            raise ArgumentError(f"stopped after {seconds:g} seconds; narrow the query") from e
        raise ArgumentError(f"the query failed: {str(e)[:500]}") from e
    finally:
        timer.cancel()
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return found.columns, [tuple(r) for r in rows[:most]], len(rows) > most
