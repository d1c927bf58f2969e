"""Connected components of links by alternating large-star and small-star rounds, all as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.shared import remove, store


def components(links: DataFrame) -> DataFrame:
    """(id, component) for every end of links (a, b): component is the smallest id reachable.

    Each round hangs every neighbour on a node's smallest one, so the number of rounds grows with the logarithm of the
    longest chain. Links are reduced to distinct pairs before each shuffle by node, and each round is written to the
    scratch folder, so neither lineage nor links pile up. Links with a null end or equal ends are left out; an empty
    table gives an empty result.
    """
    spark = links.sparkSession
    edges, at = store(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    mark = None
    while True:
        both = edges.select("u", "v").union(edges.select(F.col("v"), F.col("u")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))  # of a node and its neighbours
        # large star: neighbours above a node hang on the least of its neighbourhood
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: a node and its neighbours below it hang on the least of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        new, new_at = store(small)
        remove(spark, at)
        edges, at = new, new_at
        last, mark = mark, tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum("v"), F.sum("u")).first())
        if mark == last:  # a round that changes nothing
            break
    tops = edges.select(F.col("v").alias("id")).distinct()
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).union(tops.select("id", F.col("id").alias("component")))
