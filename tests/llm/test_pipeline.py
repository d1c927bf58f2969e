"""The pipeline's stages on planted cases and on odd rows, and its whole run."""

import random
import re

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

import __spark_entry__


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    """Documents with a copy, a near copy, a shared passage, a benchmark passage and toxic texts among clean ones."""
    rng = random.Random(8)
    vocabulary = ["".join(rng.choice("aeioubcdfglmnrst") for _ in range(rng.randrange(3, 9))) for _ in range(600)]
    word = lambda: rng.choice(vocabulary)
    text = lambda n: " ".join(word() for _ in range(n))
    texts = {i: text(100) for i in range(700)}
    labels = []
    for i in range(500):
        bad = i % 2 == 0
        if bad:
            w = texts[i].split()
            w[40:40] = ["idiot", "moron"]
            texts[i] = " ".join(w)
        labels.append((i, 1, int(bad)))
    texts[601] = texts[600]
    texts[603] = texts[602] + " " + word()
    passage = text(60)
    texts[604] += " " + passage + " " + text(5)
    texts[605] = text(20) + " " + passage + " " + texts[605]
    item = text(25)
    texts[606] += " " + item
    folder = tmp_path_factory.mktemp("planted")
    spark.createDataFrame([(i, t, "en", f"s{i % 3}", len(t)) for i, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder), texts, passage


def test_stages_on_planted_cases(spark, planted):
    folder, texts, passage = planted
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, kept = docs.columns, []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.store(stage(spark, docs, folder))[0]
        assert docs.columns == columns
        kept.append({r.doc_id: r for r in docs.collect()})
    toxic = {i for i in range(0, 500, 2)}
    assert len(toxic - set(kept[0])) >= 0.9 * len(toxic) and len(set(texts) - toxic - set(kept[0])) <= 0.03 * len(texts)
    assert set(kept[0]) - set(kept[1]) == {601, 603}
    for i in (604, 605):
        assert passage not in kept[2][i].text and kept[2][i].n_chars == len(kept[2][i].text) < len(texts[i])
    assert kept[2][607].text == texts[607]
    assert set(kept[2]) - set(kept[3]) == {606}
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, folder)
    assert {r.doc_id for r in pieces.collect()} == set(kept[3])


def test_stages_on_odd_rows(spark, planted):
    """Nulls, empty texts, repeated rows, extra columns, and no rows at all."""
    folder = planted[0]
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(30)
    odd = spark.createDataFrame([(None, None, None, None, None), (9001, None, "en", "s", 0), (9002, "", "en", None, 0), (9003, "one", "en", "s", 3), (9003, "one", "en", "s", 3), (9004, "word " * 30000, None, "s", 150000)], docs.schema)
    extra = {c: F.lit("x") for c in ("row", "of", "fp", "score", "n_words", "meta", "text_", "block", "items")}
    for rows, ids in ((docs.union(odd).withColumns(extra), {9003, 9004}), (docs.withColumns(extra).limit(0), set())):
        columns = rows.columns
        for _, stage in corpus_pipeline.STAGES[:-1]:
            rows = corpus_pipeline.store(stage(spark, rows, folder))[0]
            assert rows.columns == columns
        kept = [r.doc_id for r in rows.collect()]
        assert ids <= set(kept) and len(kept) == len(set(kept))
        assert len({9001, 9002, None} & set(kept)) == (1 if ids else 0)
        assert {r.doc_id for r in corpus_pipeline.STAGES[-1][1](spark, rows, folder).collect()} == set(kept)


def test_run(spark, sf_dir):
    out = corpus_pipeline.run(spark, sf_dir)
    assert out.count() > 0 and len(corpus_pipeline.STAGES) == 5


def test_registered():
    names = list(__spark_entry__.queries())
    for n in range(1, 11):
        assert sum(bool(re.match(rf"op{n}_", x)) for x in names) == 1
    assert "pipeline" in names
