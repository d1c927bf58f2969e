"""The public surface over the fixture, and a store that publishes generations."""

import pytest
from pyspark.sql import functions as F

from quern.engine import AmbiguousError, Engine, Store
from quern.operators.workflow import Conflict
from quern.plans.fixture import Fixture


@pytest.fixture(scope="module")
def engine(spark, sf_dir):
    return Engine(Fixture(spark, sf_dir), 2)


def test_questions(engine):
    assert engine.overview().where("kind = 'repository'").count() == 5
    callers = engine.callers("function:7").collect()
    assert callers and all(r.depth == 1 and r.incoming for r in callers)
    assert engine.callees(callers[0].neighbour).where("neighbour = 'function:7'").count() == 1
    assert engine.references("module:1").count() > 0
    assert engine.impact(["function:7"], 2).first().score_micros == 500_000
    assert engine.package_dependencies().columns == ["from_container", "to_container", "pair_count", "evidence_count"]
    assert engine.search("the", 5).count() == 5 and engine.search("the", 5, paths=["fr"]).where("path NOT LIKE 'fr/%'").count() == 0
    assert engine.symbol("function:7").count() == 1
    assert engine.path("package:3", engine.callees(callers[0].neighbour).first().neighbour) is not None
    assert {r.state for r in engine.doctor().collect()} <= {"ok", "failed"}
    assert engine.plan("look at `function:7`").first().node_id is not None
    assert len(engine.plan_id("x")) == 64


def test_ambiguous_name(engine):
    name = engine.nodes.where("kind = 'function'").groupBy("name").count().where("count > 1").first().name
    with pytest.raises(AmbiguousError):
        engine.callers(name)


def test_pages(engine):
    df = engine.nodes.where("kind = 'function'").select("node_id", "name")
    seen, cursor = [], None
    while True:
        rows, cursor = engine.page(df, ["node_id"], 70, cursor, kind="function")
        seen += [r.node_id for r in rows.collect()]
        if cursor is None:
            break
    assert seen == sorted(r.node_id for r in df.collect())


def test_store_publishes(spark, sf_dir, tmp_path):
    fx = Fixture(spark, sf_dir)
    store = Store(spark, str(tmp_path))
    for name in ("nodes", "relations", "evidence", "docs"):
        store.append(name, getattr(fx, name))
    units = store.nodes.select("unit_id").distinct().select("unit_id", F.lit(False).alias("carried"), F.lit(0).alias("distance_generations"))
    assert store.active() is None
    store.publish(units, 1, None)
    with pytest.raises(Conflict):
        store.publish(units, 2, None)
    store.publish(units.where("unit_id <> 'suppliers'"), 2, 1)
    assert store.active() == 2
    one, two = Engine(store, 1), Engine(store, 2)
    assert one.nodes.count() - two.nodes.count() == store.nodes.where("unit_id = 'suppliers'").count() > 0


def test_a_broken_off_publish_and_a_way_back(spark, sf_dir, tmp_path):
    store, units = Store(spark, str(tmp_path)), Fixture(spark, sf_dir).generation_units.where("generation_id = 2").drop("generation_id")
    store.publish(units, 1, None)
    store.publish(units.limit(2), 2, 1)
    (tmp_path / "active" / "000000000003.lock").touch()  # a writer that died, or is still at it
    with pytest.raises(Conflict):
        store.publish(units, 1, 2)
    store.recover()
    store.publish(units, 1, 2)
    assert store.active() == 1
    assert store.generation_units.where("generation_id = 1").count() == units.count() and store.generation_units.where("generation_id = 2").count() == 2


def test_search_is_pinned_and_goes_on(engine, spark, sf_dir):
    """Generation 1 has no French documents; pages of a search give all its results once, best first."""
    one = Engine(Fixture(spark, sf_dir), 1)
    assert one.docs.where("unit_id = 'fr'").count() == 0 < engine.docs.where("unit_id = 'fr'").count()
    assert one.search_page("src3", 200, paths=["fr"])[0].count() == 0
    seen, cursor = [], None
    while True:
        rows, cursor = engine.search_page("src3", 7, cursor)
        seen += [(r.tier, -r.score_micros, r.path, r.node_id) for r in rows.collect()]
        if cursor is None:
            break
    assert seen == sorted(seen) and len({s[3] for s in seen}) == len(seen) > 7
    assert len(seen) == engine.search("src3").count() or len(seen) > 200
    with pytest.raises(ValueError):
        engine.search_page("src3", 7, Engine(engine.store, 2).search_page("src3", 7)[1])


def test_export(engine, spark, tmp_path):
    engine.export({"roots": engine.overview().where("depth = 0")}, str(tmp_path))
    assert spark.read.json(f"{tmp_path}/roots").count() == 5
