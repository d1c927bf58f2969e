"""Graph exports as CSV pairs: nodes_<LABEL>_{header,data}.csv and edges_<TYPE>_{header,data}.csv."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_TYPES = {"int": "bigint", "long": "bigint", "float": "double", "double": "double", "boolean": "boolean"}


def _columns(header: str) -> list[tuple[str, str]]:
    """(name, type) of a header line; :ID, :LABEL, :START_ID, :END_ID and :TYPE lose their colon."""
    out = []
    for i, field in enumerate(header.strip().split(",")):
        name, _, kind = field.partition(":")
        out.append((name, _TYPES.get(kind.rstrip("[]").lower(), "string")) if name else (kind or f"c{i}", "string"))
    return out


def _read(spark: SparkSession, folder: str, prefix: str) -> dict[str, DataFrame]:
    """By label, one typed table of its data file. Only header lines, one for each label, come to the driver."""
    headers = spark.read.format("binaryFile").option("pathGlobFilter", f"{prefix}_*_header.csv").load(folder).select("path", F.col("content").cast("string").alias("text")).collect()
    out = {}
    for h in headers:
        label = re.search(rf"{prefix}_(.+)_header\.csv$", h["path"])[1]
        schema = ", ".join(f"`{n}` {t}" for n, t in _columns(h["text"]))
        out[label] = spark.read.schema(schema).option("escape", '"').option("multiLine", True).csv(h["path"].replace("_header.csv", "_data.csv"))
    return out


def _union(tables: dict[str, DataFrame], columns: dict[str, str]) -> DataFrame | None:
    out = None
    for label, t in sorted(tables.items()):
        part = t.select(*((F.col(f"`{c}`") if c in t.columns else F.lit(None)).cast(k).alias(c) for c, k in columns.items()), F.lit(label).alias("label"))
        out = part if out is None else out.unionByName(part)
    return out


NODE = {"ID": "bigint", "NAME": "string", "FULL_NAME": "string", "FILENAME": "string", "LINE_NUMBER": "bigint", "LINE_NUMBER_END": "bigint", "IS_EXTERNAL": "boolean"}
EDGE = {"START_ID": "bigint", "END_ID": "bigint", "TYPE": "string"}


def load(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """All nodes and all edges of an export, whatever its labels."""
    nodes, edges = _union(_read(spark, folder, "nodes"), NODE), _union(_read(spark, folder, "edges"), EDGE)
    if nodes is None or edges is None:
        raise ValueError(f"{folder} has no graph export")
    return nodes, edges


def calls(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(caller, callee, kind): call edges between methods; a call site with several targets may refer to any of them."""
    m = nodes.where("label = 'METHOD'").select("ID", "FULL_NAME")
    sites = edges.where("label = 'CALL'").groupBy("START_ID").agg(F.countDistinct("END_ID").alias("targets"))
    owner = edges.where("label = 'CONTAINS'").join(m.withColumnRenamed("ID", "START_ID"), "START_ID").select(F.col("FULL_NAME").alias("caller"), F.col("END_ID").alias("site"))
    to = edges.where("label = 'CALL'").join(m.select(F.col("ID").alias("END_ID"), F.col("FULL_NAME").alias("callee")), "END_ID").join(sites, "START_ID").withColumnRenamed("START_ID", "site")
    return owner.join(to, "site").select("caller", "callee", F.when(F.col("targets") > 1, "may_refer_to").otherwise("calls").alias("kind")).distinct()
