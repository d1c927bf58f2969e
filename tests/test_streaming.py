"""Streams run to their end over files, against the same grouping of a table."""

from pyspark.sql import functions as F

from quern.streaming import receipts, watch


def run(df, mode, name):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.sql(f"SELECT * FROM {name}")


def changes(spark, tmp_path):
    rows = [(0.0, "b"), (0.1, "a"), (0.2, "b"), (5.0, "c"), (100.0, "z")]
    df = spark.createDataFrame([(1_700_000_000 + t, p) for t, p in rows], "t double, path string").select(F.timestamp_millis((F.col("t") * 1000).cast("long")).alias("ts"), "path")
    df.write.parquet(f"{tmp_path}/c")
    return df, spark.readStream.schema(df.schema).parquet(f"{tmp_path}/c")


def test_debounced_batches(spark, tmp_path):
    table, stream = changes(spark, tmp_path)
    want = {(tuple(r.paths), r.n_events, r.reason) for r in watch.batches(table).collect()}
    assert want == {(("a", "b"), 3, "changes"), (("c",), 1, "changes"), (("z",), 1, "changes")}
    got = {(tuple(r.paths), r.n_events, r.reason) for r in run(watch.batches(stream), "append", "debounced").collect()}
    assert got <= want and (("a", "b"), 3, "changes") in got  # the last batch waits for its watermark


def test_overflow(spark, tmp_path):
    table, _ = changes(spark, tmp_path)
    r = watch.batches(table, most_paths=1).orderBy("started").first()
    assert r.full and r.reason == "overflow" and r.paths == []


def test_receipts_as_state(spark, tmp_path):
    schema = "session_id long, start_byte long, end_byte long"
    for k, rows in enumerate([[(1, 0, 10), (1, 5, 20), (2, 0, 1)], [(1, 30, 40), (1, 5, 20)]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/r")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/r")
    rows = run(receipts.covered(stream), "update", "receipt_state").collect()
    last = max((r for r in rows if r.session_id == 1), key=lambda r: r.n_receipts)
    assert (last.n_ranges, last.covered_bytes, last.n_receipts) == (2, 30, 4)


def test_apply_once(spark, tmp_path):
    _, stream = changes(spark, tmp_path)
    seen = []
    watch.apply_once(stream, lambda batch, epoch: seen.append((epoch, batch.count())), f"{tmp_path}/k").awaitTermination(120)
    assert seen == [(0, 5)]
    watch.apply_once(stream, lambda batch, epoch: seen.append(epoch), f"{tmp_path}/k2", epoch_of=lambda: 0).awaitTermination(120)
    assert len(seen) == 1


def test_heartbeats(spark):
    beats = spark.createDataFrame([("s", "2024-01-01 00:00:00"), ("s", "2024-01-01 00:01:00"), ("t", "2024-01-01 00:00:00")], "session_id string, ts string").withColumn("ts", F.to_timestamp("ts"))
    got = {r.session_id: r.alive for r in watch.live(watch.heartbeats(beats), "2024-01-01 00:01:30").collect()}
    assert got == {"s": True, "t": False}


def test_tumbling_windows(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    assert watch.tumbling(events, "1 hour", ["event_type"]).agg(F.sum("n")).first()[0] == events.count()
