"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

The ring is a circle of CELLS hash cells. Each shard has ``vnodes`` points on it; a key belongs to the shard of the next
point clockwise from its cell. Under the law ``rows`` a shard holds at most its share of the rows: what it can't hold
goes on clockwise to the next point of a shard with room. The shares add up to the number of rows, so counts are at most
one apart. Under the law ``key`` there is no bound: key and shard count decide, and one more shard takes rows only into
itself.

Only the counts of the cells (a constant number) reach the driver; rows are ranked within a cell, and a cell's ranks are
dealt to shards as whole ranges, so a row's shard and slot follow from its cell and rank. Null keys hash like any value
and repeated keys are spread by rank within their cell; rows that are equal in all columns are ranked in one group. An
empty table gives an empty result.
"""

from __future__ import annotations

from bisect import bisect_left

import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.llm.shared import table

CELLS = 4096
PARTS = 8
VNODES = 64
SHARDS = 8


def ring(shards: int, vnodes: int = VNODES, cells: int = CELLS) -> list[tuple[int, int]]:
    """(cell, shard) of each virtual node in ring order. A shard's points don't depend on how many shards there are."""
    return sorted((xxhash.xxh64_intdigest(f"shard {s} point {v}") % cells, s) for s in range(shards) for v in range(vnodes))


def homes(shards: int, vnodes: int = VNODES, cells: int = CELLS) -> list[list[int]]:
    """For each cell, the distinct shards met clockwise from it, its own first."""
    points = ring(shards, vnodes, cells)
    at = [c for c, _ in points]
    out = []
    for cell in range(cells):
        start = bisect_left(at, cell)
        out.append(list(dict.fromkeys(points[(start + k) % len(points)][1] for k in range(len(points)))))
    return out


def deal(counts: dict[int, int], shards: int, vnodes: int = VNODES, cells: int = CELLS) -> list[tuple[int, int, int, int, int]]:
    """(cell, first rank, end rank, shard, first slot): ranges of a cell's ranks and where they go, under equal shares."""
    total = sum(counts.values())
    room = [total // shards + (s < total % shards) for s in range(shards)]
    filled = [0] * shards
    order = homes(shards, vnodes, cells)
    taken = dict.fromkeys(counts, 0)
    out = []
    for turn in range(shards):  # first every key that its own shard can hold, then those that go one on, and so forth
        for cell in sorted(counts):
            shard = order[cell][turn] if turn < len(order[cell]) else turn
            n = min(counts[cell] - taken[cell], room[shard] - filled[shard])
            if n > 0:
                out.append((cell, taken[cell], taken[cell] + n, shard, filled[shard]))
                taken[cell] += n
                filled[shard] += n
    return out


def _lookup(values: list[int], index: Column) -> Column:
    return F.get(F.split(F.lit(",".join(map(str, values))), ",").cast("array<int>"), index)


def shard_of_key(key: Column, shards: int, vnodes: int = VNODES, cells: int = CELLS) -> Column:
    """The law ``key``: the shard of the next point clockwise."""
    return _lookup([h[0] for h in homes(shards, vnodes, cells)], F.pmod(F.xxhash64(key), F.lit(cells)).cast("int"))


def _pieces(plan: list[tuple[int, int, int, int, int]], counts: dict[tuple[int, int], int]) -> list[tuple[int, int, int, int, int, int]]:
    """The plan's ranges of a cell's ranks as ranges of ranks within its parts: (cell, part, first rank, end rank, shard, first slot)."""
    parts: dict[int, list[tuple[int, int, int]]] = {}
    for (cell, part), n in sorted(counts.items()):
        at = parts.setdefault(cell, [])
        start = at[-1][2] if at else 0
        at.append((part, start, start + n))
    out = []
    for cell, lo, hi, shard, slot in plan:
        for part, start, end in parts[cell]:
            a, b = max(lo, start), min(hi, end)
            if a < b:
                out.append((cell, part, a - start, b - start, shard, slot + a - lo))
    return out


def shard_rows(df: DataFrame, key: str, shards: int = SHARDS, vnodes: int = VNODES, cells: int = CELLS, parts: int = PARTS) -> DataFrame:
    """df with ``shard`` and ``slot`` under the law ``rows``. Columns of these names are replaced.

    A cell's rows are ranked in ``parts`` parts by a hash of their content, so a key that many rows share doesn't make
    one large group. Rows that differ in columns without an order (maps) alone rank as they come.
    """
    spark = df.sparkSession
    names = [c for c in df.columns if c not in ("shard", "slot")]
    kinds = dict(df.dtypes)
    told = [F.col(f"`{c}`") for c in names if not any(x in kinds[c] for x in ("map<", "variant", "geometry", "geography"))]
    h = F.xxhash64(F.col(f"`{key}`"))
    keyed = df.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("row"), F.struct(*told).alias("told"), h.alias("h"), F.pmod(h, F.lit(cells)).cast("int").alias("cell"), F.pmod(F.xxhash64(F.lit(3), *told), F.lit(parts)).cast("int").alias("part"))
    counts = {(r["cell"], r["part"]): r["n"] for r in keyed.groupBy("cell", "part").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most cells * parts rows
    of_cells: dict[int, int] = {}
    for (cell, _), n in counts.items():
        of_cells[cell] = of_cells.get(cell, 0) + n
    plan = spark.createDataFrame(_pieces(deal(of_cells, shards, vnodes, cells), counts), "cell int, part int, lo long, hi long, shard int, first long")
    ranked = keyed.withColumn("rank", F.row_number().over(Window.partitionBy("cell", "part").orderBy("h", "told")).cast("long") - 1)
    # at most cells * (parts + shards) rows
    return ranked.join(F.broadcast(plan), ["cell", "part"]).where("rank >= lo AND rank < hi").select("row.*", "shard", (F.col("first") + F.col("rank") - F.col("lo")).alias("slot"))


def op7_ring_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).cast("long").alias("text_crc32"))
    return shard_rows(rows, "doc_id").select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
