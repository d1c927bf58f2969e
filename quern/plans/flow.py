"""Program analysis over functions made of the star schema: an order's line items are its statements."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.operators import flow as op
from quern.plans.catalog import query
from quern.plans.fixture import Fixture


def edges(x: Fixture) -> DataFrame:
    """Line k of an order goes to k + 1, a returned line branches past the next one, a line of odd part loops back."""
    li = x.lineitem.select(F.concat(F.lit("order"), "l_orderkey").alias("function"), F.col("l_linenumber").alias("k"), "l_returnflag", "l_partkey")
    li = li.groupBy("function", "k").agg(F.max("l_returnflag").alias("flag"), F.max("l_partkey").alias("part"))
    last = li.groupBy("function").agg(F.max("k").alias("last"))
    rows = li.join(last, "function")
    to = lambda k: F.when(k > F.col("last"), F.lit(1)).otherwise(k + 1)
    node = F.col("k") + 1
    both = F.array(to(F.col("k") + 1), F.when(F.col("flag") == "R", to(F.col("k") + 2)), F.when(F.col("part") % 2 == 1, node))
    found = rows.select("function", node.cast("int").alias("a"), F.explode(F.array_compact(both).cast("array<int>")).alias("b"))
    start = rows.groupBy("function").agg((F.min("k") + 1).cast("int").alias("b")).select("function", F.lit(0).alias("a"), "b")
    return found.unionByName(start).distinct()


@query()
def flow_dominators(x: Fixture) -> DataFrame:
    return op.dominators(edges(x))


@query()
def flow_control_dependence(x: Fixture) -> DataFrame:
    return op.control_dependence(edges(x))


@query()
def flow_def_use(x: Fixture) -> DataFrame:
    """A line defines its supplier's variable and uses its tax class's."""
    li = x.lineitem.select(F.concat(F.lit("order"), "l_orderkey").alias("function"), (F.col("l_linenumber") + 1).cast("int").alias("node"), "l_suppkey", "l_partkey")
    d = li.select("function", "node", F.concat(F.lit("v"), F.col("l_suppkey") % 3).alias("variable"), F.lit(True).alias("is_def"))
    u = li.select("function", "node", F.concat(F.lit("v"), F.col("l_partkey") % 3).alias("variable"), F.lit(False).alias("is_def"))
    return op.def_use(edges(x), d.unionByName(u))
