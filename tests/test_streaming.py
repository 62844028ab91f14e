"""The streaming fold against the batch fold, inserts and writes."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from jobtide.operators import batch, control, transitions
from jobtide.sources import fixtures as X
from jobtide.sources import inserts as I
from jobtide.streaming import lifecycle as L


@pytest.fixture
def event_files(spark, sf_dir, tmp_path):
    e = X.events(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))
    path = str(tmp_path / "events")
    e.repartitionByRange(4, "ts").write.parquet(path)
    return e, path


def test_stream_equals_batch(spark, event_files, tmp_path):
    e, path = event_files
    got = L.run_fold(spark, path, str(tmp_path / "ck"), "folded")
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in L.fold(e).collect()}


def test_custom_state(spark, event_files, tmp_path):
    e, path = event_files
    q = L.lease_state(L.source(spark, path, 4), 10**12).writeStream.outputMode("update").format("memory").queryName("leases").option("checkpointLocation", str(tmp_path / "ck2")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {r["job_id"]: r["m"] for r in spark.table("leases").groupBy("job_id").agg(F.max("run_lease").alias("m")).collect()}
    assert got == {r["job_id"]: r["m"] for r in e.groupBy("job_id").agg(F.max("run_lease").alias("m")).collect()}


def test_csv_keeps_nulls_and_quotes(spark, tmp_path):
    rows = [(1, "a", None), (2, "", 'say "hi", you'), (3, "line\nbreak", "x,y"), (4, None, "")]
    df = spark.createDataFrame(rows, "id int, a string, b string")
    I.write_csv(df.coalesce(1), str(tmp_path / "csv"))
    assert sorted(map(tuple, I.read_csv(spark, str(tmp_path / "csv"), "id int, a string, b string").collect())) == rows


def test_write_by_state(spark, sf_dir, tmp_path):
    j = X.jobs(spark, sf_dir).select("id", "state", "queue")
    I.write_by_state(j, str(tmp_path / "jobs"))
    back = I.read_jobs(spark, str(tmp_path / "jobs"))
    assert back.count() == j.count() and "PartitionFilters: [isnotnull(state" in back.filter("state = 'failed'")._jdf.queryExecution().toString()


def test_prepare_refuses(spark):
    bad = spark.createDataFrame([("k", 9)], "kind string, priority int")
    with pytest.raises(Exception, match="out of range"):
        I.prepare(bad, X.as_of()).collect()


def test_token_bucket(spark):
    rows = [("q", f"2024-01-01 00:00:{s:02}", w) for s, w in ((0, 3), (0, 3), (1, 3), (10, 9))]
    a = spark.createDataFrame(rows, "queue string, ts string, wanted long").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    assert sorted(r["granted"] for r in control.token_bucket(a, 2.0, 4).collect()) == [1, 2, 3, 4]
    assert control.default_burst(0.3) == 1 and control.default_burst(2.5) == 3


def test_scopes_are_guarded(spark, sf_dir):
    with pytest.raises(ValueError):
        transitions.move_to_dlq(X.jobs(spark, sf_dir), X.as_of())
    with pytest.raises(ValueError):
        transitions.purge_dlq(X.jobs(spark, sf_dir))


def test_states_partition_the_jobs(spark, sf_dir):
    j = X.jobs(spark, sf_dir)
    after = transitions.promote(transitions.rescue_stale(j, X.as_of()).drop("changed"), X.as_of())
    assert after.count() == j.count() == after.select("id").distinct().count()
    assert after.filter("priority NOT BETWEEN 1 AND 4").count() == 0
    once = transitions.claim(j, X.queue_meta(spark), X.as_of(), 10)
    assert once.filter("changed").join(j.filter("state = 'available'"), "id", "left_anti").count() == 0


def test_chunk_skips_equal_priority(spark, sf_dir):
    j = X.jobs(spark, sf_dir).filter("state = 'available'")
    empty = spark.createDataFrame([], "operation_id long, job_id long, status string")
    chunk = batch.take_chunk(batch.materialise(j, empty, 1), 1, 50)
    _, done = batch.apply_chunk(j, chunk, "set_priority", X.as_of(), priority=2)
    want = {r["id"]: "skipped" if r["priority"] == 2 else "succeeded" for r in j.orderBy("id").limit(50).collect()}
    assert {r["job_id"]: r["status"] for r in done.collect()} == want
