"""Context plans: seeds, scope, scores, boosts and packing into slices."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from quern.functions.text import mul_scaled
from quern.model import CENTRALITY_BOOST, CENTRALITY_STEP, CHANGE_BOOST, EXACT_SCORE, HOP_DECAY, REQUIREMENT_RANK, ROUTE_WEIGHT, SEED_SCORE, TASK_BOOST, TEST_BOOST, case_map, requirement


def seeds_of(task: str, explicit: list[str] = ()) -> list[tuple[str, str]]:
    """(basis, value) in order of trust: given ones, backticked names, paths, dotted names, then plain words."""
    out = [("explicit", s) for s in explicit]
    out += [("quoted", s) for s in re.findall(r"`([^`]+)`", task)]
    rest = re.sub(r"`[^`]*`", " ", task)
    for word in re.findall(r"[\w./\\:#-]+", rest):
        word = word.strip(".,:;-")
        if "/" in word or "\\" in word:
            out.append(("path", word.replace("\\", "/")))
        elif re.search(r"\w(\.|::|#)\w", word):
            out.append(("qualified", word))
        elif len(word) > 2:
            out.append(("term", word.lower()))
    return list(dict.fromkeys(out))


def route_score(hops: Column) -> Column:
    """The score of a route of hops (kind, precision_micros), in order: every hop's weight by its precision, and less by
    each hop after the first. A hop of a kind without weight makes it null."""
    step = lambda h: mul_scaled(case_map(h["kind"], ROUTE_WEIGHT), h["trust"])
    first = F.struct(F.lit(SEED_SCORE).cast("long").alias("score"), F.lit(0).alias("n"))
    folded = F.aggregate(
        hops, first, lambda a, h: F.struct(mul_scaled(mul_scaled(a["score"], step(h)), F.when(a["n"] == 0, F.lit(1_000_000)).otherwise(F.lit(HOP_DECAY))).alias("score"), (a["n"] + 1).alias("n"))
    )
    return folded["score"]


def boosted(base: Column, task: Column, changed: Column, test: Column, edges: Column) -> Column:
    """A base score with what the task, a change, tests and centrality add, within what seed and boosts can reach."""
    on = lambda c, v: F.when(c, F.lit(v)).otherwise(F.lit(0))
    central = F.least(F.coalesce(edges, F.lit(0)) * CENTRALITY_STEP, F.lit(CENTRALITY_BOOST))
    top = SEED_SCORE + TASK_BOOST + CHANGE_BOOST + TEST_BOOST + CENTRALITY_BOOST
    return F.least(base + on(task, TASK_BOOST) + on(changed, CHANGE_BOOST) + on(test, TEST_BOOST) + central, F.lit(top)).cast("long")


def demoted(kind: Column, depth: Column) -> Column:
    """The rank of what a node asks of its reader, weaker by a step for each level beyond the first."""
    return F.least(case_map(requirement(kind), REQUIREMENT_RANK) + F.greatest(depth - 1, F.lit(0)), F.lit(3)).cast("int")


def plan(reached: DataFrame, nodes: DataFrame, edges: DataFrame, changed: Column, task: Column) -> DataFrame:
    """Entries of a plan over a walk's reached nodes: requirement rank, score and size, in serving order by columns.

    ``edges`` has (node, edges): how many relations a node takes part in.
    """
    n = nodes.select("node_id", "kind", "path", "file_id", "start_byte", "end_byte")
    found = reached.withColumnRenamed("node", "node_id").join(n, "node_id").join(edges.select(F.col("node").alias("node_id"), "edges"), "node_id", "left")
    base = F.when(F.col("depth") == 0, F.lit(SEED_SCORE)).when(F.col("depth") == 1, F.lit(EXACT_SCORE)).otherwise(F.lit(EXACT_SCORE) - F.col("cost") * 10_000)
    size = F.coalesce(F.col("end_byte") - F.col("start_byte"), F.lit(0))
    return found.select(
        "node_id", "kind", "path", "depth", demoted(F.col("kind"), F.col("depth")).alias("requirement_rank"),
        boosted(base, task, changed, F.col("kind") == "test", F.col("edges")).alias("score_micros"), size.alias("bytes"), (4 * F.ceil(size / 3)).cast("long").alias("encoded_bytes"),
    )


ORDER = ("requirement_rank", "score_micros", "path", "start_byte", "node_id")


class BudgetError(ValueError):
    """The smallest entry is larger than a slice may be."""


def next_fit(sizes: Iterator[tuple[int, int]], most_bytes: int, most_tokens: int, most_slices: int = 0) -> list[int]:
    """The slice of each entry (bytes, tokens) in order, -1 for those after the last slice is full; 0 slices: no limit."""
    out, at, b, t = [], 0, 0, 0
    for nb, nt in sizes:
        if nb > most_bytes or nt > most_tokens:
            raise BudgetError(f"an entry of {nb} bytes and {nt} tokens is over {most_bytes} and {most_tokens}")
        if b + nb > most_bytes or t + nt > most_tokens:
            at, b, t = at + 1, 0, 0
        b, t = b + nb, t + nt
        out.append(at if not most_slices or at < most_slices else -1)
    return out


def slices(entries: DataFrame, key: str, order: list[str], most_bytes: int, most_tokens: int) -> DataFrame:
    """Entries (key, bytes, tokens, order) with their slice, packed in order within each key (a plan).

    Next fit depends on all entries before, so a plan is packed by one task; a plan is bounded by its request, plans are
    packed side by side.
    """
    rows = entries.select(key, *order, "bytes", "tokens")

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable")
        pdf["slice"] = next_fit(zip(pdf["bytes"], pdf["tokens"]), most_bytes, most_tokens)
        return pdf

    return rows.groupBy(key).applyInPandas(pack, StructType([*rows.schema.fields, StructField("slice", LongType())]))
