"""Vocabularies and constants of the code-graph model."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Relation kinds and what a step along each costs. A kind that isn't listed costs UNKNOWN_COST.
EDGE_COST = {
    "calls": 1,
    "implements": 1,
    "extends": 1,
    "overrides": 1,
    "imports": 2,
    "exports": 2,
    "depends_on": 2,
    "references": 2,
    "data_flows_to": 2,
    "control_depends_on": 3,
    "reads": 3,
    "writes": 3,
    "tests": 4,
    "builds": 4,
    "generates": 4,
    "documents": 5,
    "configures": 5,
    "contains": 6,
    "defines": 6,
    "owns": 6,
    "renamed_from": 7,
    "moved_from": 7,
    "may_refer_to": 7,
}
UNKNOWN_COST = 7
DEFAULT_KINDS = tuple(k for k in EDGE_COST if k not in ("renamed_from", "moved_from", "may_refer_to"))
IMPACT_KINDS = ("implements", "overrides", "calls", "reads", "writes", "tests", "configures", "documents", "depends_on", "imports")

# What a relation kind contributes to a context route, and how far each precision is trusted, in millionths.
ROUTE_WEIGHT = {
    "implements": 940_000,
    "overrides": 940_000,
    "extends": 940_000,
    "tests": 920_000,
    "calls": 900_000,
    "reads": 880_000,
    "writes": 880_000,
    "data_flows_to": 880_000,
    "control_depends_on": 880_000,
    "references": 780_000,
    "exports": 780_000,
    "depends_on": 720_000,
    "configures": 720_000,
    "imports": 600_000,
    "documents": 550_000,
    "contains": 350_000,
    "owns": 350_000,
    "defines": 350_000,
}
PRECISION_WEIGHT = {"compiler": 1_000_000, "static_analysis": 950_000, "semantic": 900_000, "syntax": 720_000, "heuristic": 450_000}
SEED_SCORE, EXACT_SCORE, HOP_DECAY = 1_000_000, 980_000, 650_000
TASK_BOOST, CHANGE_BOOST, TEST_BOOST, CENTRALITY_BOOST, CENTRALITY_STEP = 200_000, 120_000, 100_000, 50_000, 5_000

# What a node's kind asks of a reader.
REQUIREMENT = {
    "full": ("interface", "class", "struct", "enum", "test", "configuration", "file"),
    "symbol": ("function", "method", "field", "variable", "constant", "endpoint", "database_entity"),
    "recommended": ("document", "section", "package", "module", "namespace", "dependency", "build_target"),
}
REQUIREMENT_RANK = {"full": 0, "symbol": 1, "recommended": 2, "optional": 3}

# Ranking of lexical search.
BM25_K1, BM25_B = 1.2, 0.75
FIELD_WEIGHT = {"body": 1.0, "name": 5.0, "path": 2.0, "qualified_name": 5.0, "signature": 2.0}

MICROS = 1_000_000
PAGE_CEILING = 200
CONTAINER_KINDS = ("package", "module")


def case_map(column: Column, values: dict, otherwise: object = None) -> Column:
    """values[column], inside generated code."""
    out = None
    for key, value in values.items():
        out = F.when(column == key, F.lit(value)) if out is None else out.when(column == key, F.lit(value))
    return out.otherwise(F.lit(otherwise))


def edge_cost(kind: Column) -> Column:
    return case_map(kind, EDGE_COST, UNKNOWN_COST)


def requirement(kind: Column) -> Column:
    return case_map(kind, {k: r for r, kinds in REQUIREMENT.items() for k in kinds}, "optional")
