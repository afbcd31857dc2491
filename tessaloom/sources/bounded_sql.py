"""Read-only SQL with bounded rows and cells."""

from __future__ import annotations

import re

from py4j.java_gateway import is_instance_of
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROWS, MOST_ROWS, CELL = 20, 100, 2000

#: Plans of the parser that only read; anything that holds another command is refused.
_COMMANDS = ("Insert", "Delete", "Update", "Merge", "Create", "Drop", "Alter", "Replace", "Truncate", "SetCommand", "AddJar", "Cache", "Load", "Refresh", "Repair", "Analyze", "Command", "Overwrite", "Append", "Use", "Call", "Declare", "SetVariable")
#: Functions that run code or reach out of the tables.
_FUNCTIONS = ("reflect", "java_method", "try_reflect")
_EXPLAIN = re.compile(r"\s*EXPLAIN\b(?:\s+(?:EXTENDED|CODEGEN|COST|FORMATTED)\b)?", re.I)


class NotReadOnly(ValueError):
    pass


def guard(spark: SparkSession, query: str) -> None:
    """Spark's own parser says what a text is, so words in literals and comments don't matter.
    EXPLAIN is allowed where what it explains is; scans of files by path aren't tables."""
    query = _EXPLAIN.sub("", query, count=1)
    plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(query)
    nodes = [plan]
    while nodes:
        node = nodes.pop()
        name = node.nodeName()
        if any(name.startswith(c) or name.endswith("Command") for c in _COMMANDS):
            raise NotReadOnly(f"{name} is not read-only")
        if name == "UnresolvedRelation" and "/" in str(node.tableName()):
            raise NotReadOnly("files are not tables")
        if name == "UnresolvedFunction" and node.nameParts().mkString(".").lower().rsplit(".", 1)[-1] in _FUNCTIONS:
            raise NotReadOnly("functions that run code are not read-only")
        is_plan = is_instance_of(spark.sparkContext._gateway, node, "org.apache.spark.sql.catalyst.plans.QueryPlan")
        for inner in [node.children(), node.innerChildren()] + ([node.expressions()] if is_plan else []):
            nodes += [inner.apply(i) for i in range(inner.size())]


def bounded_sql(spark: SparkSession, query: str, limit: int | None = None) -> tuple[DataFrame, bool]:
    """The first rows, cells as clipped text, and whether there were more: one row beyond the
    limit is asked for, once."""
    guard(spark, query)
    limit = ROWS if limit is None else max(1, min(int(limit), MOST_ROWS))
    df = spark.sql(query)
    rows = df.limit(limit + 1).collect()
    return clip_cells(spark.createDataFrame(rows[:limit], df.schema)), len(rows) > limit


def clip_cells(df: DataFrame, limit: int = CELL) -> DataFrame:
    return df.select(*[F.when(F.length(F.col(c)) > limit, F.substring(F.col(c), 1, limit)).otherwise(F.col(c)).alias(c) if t == "string" else F.col(c) for c, t in df.dtypes])


def schema_catalog(tables: dict[str, DataFrame]) -> DataFrame:
    """(table, position, column, type) from the frames' schemas; no data is read."""
    spark = next(iter(tables.values())).sparkSession
    rows = [(t, i, c, kind) for t, df in sorted(tables.items()) for i, (c, kind) in enumerate(df.dtypes)]
    return spark.createDataFrame(rows, "table string, position long, column string, type string")
