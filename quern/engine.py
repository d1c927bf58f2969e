"""The public surface: one object over a store of fact tables, with a query for each question."""

from __future__ import annotations

import json
import secrets
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.hashing import framed_id
from quern.model import DEFAULT_KINDS, IMPACT_KINDS
from quern.operators import context, facts, graph, intervals, pages, search, snapshots, workflow
from quern.plans.fixture import Fixture

CURSOR_SECONDS = 15 * 60
REFERENCE_KINDS = {"references": ("incoming", ["references", "calls"]), "implements": ("incoming", ["implements"]), "type-definition": ("outgoing", ["references"])}


class AmbiguousError(ValueError):
    """A name stands for several nodes."""


class Store:
    """Fact tables as Parquet below a folder: units append, a generation is a list of units, and a pointer row names the
    active one. Written once, never changed; publishing adds rows and then moves the pointer."""

    TABLES = ("nodes", "relations", "evidence", "docs", "generation_units")

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        if name in self.TABLES:
            return self.spark.read.parquet(f"{self.root}/{name}")
        raise AttributeError(name)

    def append(self, name: str, rows: DataFrame) -> None:
        rows.write.mode("append").parquet(f"{self.root}/{name}")

    def _folder(self) -> tuple[object, object]:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/active")
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def _pointer(self) -> tuple[int, int | None]:
        """How many times the pointer moved, and where it points."""
        files, folder = self._folder()
        names = [s.getPath().getName() for s in files.listStatus(folder)] if files.exists(folder) else []
        moves = sorted(tuple(map(int, n.split("-"))) for n in names if n.replace("-", "").isdigit())
        return moves[-1] if moves else (0, None)

    def recover(self) -> None:
        """Gives up a move of the pointer that a writer began and never ended. For when no writer is at work."""
        files, folder = self._folder()
        files.delete(self.spark._jvm.org.apache.hadoop.fs.Path(folder, f"{self._pointer()[0] + 1:012d}.lock"), False)

    def publish(self, members: DataFrame, generation: int, expected: int | None) -> None:
        """Adds a generation's units and makes it the active one, if ``expected`` still is.

        The units are written as a whole under the generation's name, so one that is already there, after a crash or for
        a way back, stays as it is. Then the pointer moves by making the file of the next move, which only one writer
        can; the file system must refuse to make a file that exists.
        """
        moves, now = self._pointer()
        if now != expected:
            raise workflow.Conflict(f"generation {now} is active, expected {expected}")
        try:
            members.withColumn("generation_id", F.lit(generation)).write.partitionBy("generation_id").mode("append" if self._absent(generation) else "ignore").parquet(f"{self.root}/generation_units")
        finally:
            self.spark.catalog.refreshByPath(f"{self.root}/generation_units")
        files, folder = self._folder()
        files.mkdirs(folder)
        mine = self.spark._jvm.org.apache.hadoop.fs.Path(folder, f"{moves + 1:012d}.lock")
        if not files.createNewFile(mine):
            raise workflow.Conflict(f"another writer moves the pointer from generation {now}, or broke off and left that to recover()")
        files.createNewFile(self.spark._jvm.org.apache.hadoop.fs.Path(folder, f"{moves + 1:012d}-{generation}"))

    def _absent(self, generation: int) -> bool:
        files, folder = self._folder()
        return not files.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/generation_units/generation_id={generation}"))

    def active(self) -> int | None:
        return self._pointer()[1]


class Engine:
    """Queries pinned to one generation of a store (or of the star-schema fixture)."""

    def __init__(self, store: Store | Fixture, generation: int, secret: bytes | None = None) -> None:
        """secret signs cursors; without one, cursors hold for this object only."""
        self.store, self.generation, self.secret = store, generation, secret or secrets.token_bytes(32)
        self.spark: SparkSession = store.spark

    def _pinned(self, name: str) -> DataFrame:
        return facts.visible(getattr(self.store, name), self.store.generation_units, self.generation)

    @property
    def nodes(self) -> DataFrame:
        """One row a node: where several units have it, that of the first unit."""
        found = self._pinned("nodes")
        return facts.prefer(found, ["node_id"], [F.col("unit_id"), F.col("kind"), F.coalesce("file_id", F.lit("")), F.coalesce("start_byte", F.lit(-1))])

    @property
    def relations(self) -> DataFrame:
        return self._pinned("relations")

    @property
    def evidence(self) -> DataFrame:
        return self._pinned("evidence")

    @property
    def docs(self) -> DataFrame:
        return self._pinned("docs")

    def _seeds(self, names: list[str]) -> DataFrame:
        """Node ids of names: an id as it is, else a name or qualified name that stands for one node only."""
        out = []
        for name in names:
            found = [r["node_id"] for r in search.resolve(self.nodes, name, 200).where("tier IN (-1, 1, 3)").limit(17).collect()]
            if len(found) > 1:
                raise AmbiguousError(f"{name}: {', '.join(found[:16])}")
            out += found or [name]
        return self.spark.createDataFrame([(n,) for n in out], "node string")

    def overview(self) -> DataFrame:
        return graph.overview(self.nodes, self.relations)

    def search(self, query: str, limit: int = 0, paths: list[str] = (), languages: list[str] = ()) -> DataFrame:
        docs = self.docs.where(facts.under_paths("path", list(paths)))
        docs = docs.where(facts.in_kinds("language", list(languages))) if languages else docs
        return search.search(docs, query, pages.clamp(limit)[0])

    def search_page(self, query: str, limit: int = 0, cursor: str | None = None, paths: list[str] = (), languages: list[str] = ()) -> tuple[DataFrame, str | None]:
        """A page of all results of a search, best first, and the cursor of the next, None after the last."""
        docs = self.docs.where(facts.under_paths("path", list(paths)))
        docs = docs.where(facts.in_kinds("language", list(languages))) if languages else docs
        found = search.search(docs, query, None).withColumn("rank", -F.col("score_micros"))
        rows, nxt = self.page(found, ["tier", "rank", "path", "node_id"], limit, cursor, query=query, paths=list(paths), languages=list(languages))
        return rows.drop("rank"), nxt

    def symbol(self, query: str, definitions: bool = False) -> DataFrame:
        return search.resolve(facts.declarations(self.nodes) if definitions else self.nodes, query)

    def document_symbols(self, file_id: str) -> DataFrame:
        return self.nodes.where(F.col("file_id") == file_id).orderBy("start_byte", "node_id")

    def references(self, name: str, operation: str = "references") -> DataFrame:
        direction, kinds = REFERENCE_KINDS[operation]
        return graph.occurrences(self.relations, self.evidence, self._seeds([name]), kinds, direction).orderBy("relation_id", "evidence_id")

    def callers(self, name: str, depth: int = 1) -> DataFrame:
        return graph.walk(self.relations, self._seeds([name]), ["calls"], "incoming", depth).edges.orderBy("depth", "neighbour", "owner", "relation_id")

    def callees(self, name: str, depth: int = 1) -> DataFrame:
        return graph.walk(self.relations, self._seeds([name]), ["calls"], "outgoing", depth).edges.orderBy("depth", "neighbour", "owner", "relation_id")

    def neighbours(self, names: list[str], depth: int = 1, direction: str = "both", kinds: list[str] = DEFAULT_KINDS) -> graph.Walk:
        return graph.walk(self.relations, self._seeds(names), list(kinds), direction, depth)

    def path(self, source: str, target: str, most: int = 8) -> DataFrame:
        goal = self._seeds([target]).first()["node"]
        return graph.routes(self.relations, self._seeds([source]), goal, list(DEFAULT_KINDS), most)

    def impact(self, names: list[str], depth: int = 3, kinds: list[str] = IMPACT_KINDS) -> DataFrame:
        return graph.impact(self.relations, self._seeds(names), list(kinds), depth).orderBy(F.desc("score_micros"), "depth", "node_id")

    def package_dependencies(self) -> DataFrame:
        edges = self.relations.join(facts.evidence_counts(self.evidence), "relation_id")
        return facts.rollup(edges, facts.inherited_containers(self.nodes, self.relations))

    def plan(self, task: str, explicit: list[str] = (), depth: int = 2) -> DataFrame:
        """Entries of a context plan for a task, in serving order."""
        wanted = context.seeds_of(task, list(explicit))
        names = [v for basis, v in wanted if basis in ("explicit", "quoted", "qualified")]
        found = self._seeds(names) if names else self.nodes.where(F.lower("name").isin([v for _, v in wanted])).select(F.col("node_id").alias("node"))
        reached = graph.walk(self.relations, found, list(IMPACT_KINDS), "both", depth).reached.select("node", "depth", "cost")
        degrees = facts.adjacency(self.relations).groupBy("node").agg(F.count(F.lit(1)).alias("edges"))
        terms = [v for _, v in wanted]
        flagged = reached.join(self.nodes.select(F.col("node_id").alias("node"), F.lower("name").isin(terms).alias("_t")), "node")
        return context.plan(flagged, self.nodes, degrees, F.lit(False), F.col("_t")).orderBy("requirement_rank", F.desc("score_micros"), "path", "node_id")

    def plan_id(self, task: str, explicit: list[str] = ()) -> str:
        return framed_id("plan-v1", str(self.generation), json.dumps([task, list(explicit)]))

    def coverage(self, required: DataFrame, receipts: DataFrame, keys: list[str]) -> DataFrame:
        return intervals.coverage(required, intervals.coalesce(receipts, keys), keys)

    def refresh(self, planned: DataFrame, sealed: DataFrame) -> DataFrame:
        """What each planned unit needs: reuse, delta or build."""
        return snapshots.reusable(planned, sealed)

    def page(self, df: DataFrame, keys: list[str], limit: int = 0, cursor: str | None = None, **request: object) -> tuple[DataFrame, str | None]:
        """A page in order of keys and the cursor of the next, None after the last."""
        size, _ = pages.clamp(limit)
        about = {"generation": self.generation, "query": pages.query_hash(keys=keys, **request)}
        after = pages.opened(self.secret, cursor, **about)["after"] if cursor else None
        rows = pages.keyset(df, keys, after, size + 1).collect()
        more = rows[size - 1] if len(rows) > size else None
        nxt = None if more is None else pages.sign(self.secret, about | {"after": [more[k] for k in keys], "expires": int(time.time()) + CURSOR_SECONDS})
        return self.spark.createDataFrame(rows[:size], df.schema), nxt

    def export(self, lists: dict[str, DataFrame], folder: str) -> None:
        """Each list as ordered JSON rows under its name."""
        for name, rows in lists.items():
            keys = rows.columns
            rows.select(F.lit(name).alias("list"), F.to_json(F.struct(*keys)).alias("row_json")).write.json(f"{folder}/{name}")

    def doctor(self) -> DataFrame:
        """(check, state, n, remediation): problems that must not be there."""
        ids = self.nodes.select("node_id")
        checks: dict[str, tuple[DataFrame, str]] = {
            "orphans": (self.relations.join(ids, F.col("from_node_id") == ids.node_id, "left_anti"), "rebuild the unit"),
            "dangling": (self.relations.join(ids, F.col("to_node_id") == ids.node_id, "left_anti"), "rebuild the unit"),
            "duplicates": (self._pinned("nodes").groupBy("node_id").count().where("count > 1"), "keep the preferred unit's fact"),
        }
        out = None
        for name, (rows, remedy) in checks.items():
            row = rows.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("check"), F.when(F.col("n") == 0, "ok").otherwise("failed").alias("state"), "n", F.lit(remedy).alias("remediation"))
            out = row if out is None else out.unionByName(row)
        return out


def registry() -> dict[str, Callable]:
    """Providers that produce fact tables from files (path, text), by name."""
    from quern.sources import manifests, python_code

    return {"manifests": manifests.manifest_facts, "python": python_code.python_facts}
