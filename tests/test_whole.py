"""Queries that are to take all their rows, against second implementations over all rows of the smallest tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from jobtide import catalog
from jobtide.functions import blake
from jobtide.operators import reads as R
from jobtide.sources import fixtures as X


def test_every_job_has_its_unique_key(spark, sf_dir):
    want = {r["id"]: blake.unique_key(r["kind"], r["queue"], f'{{"n": {r["id"]}}}', r["id"] // 1000) for r in X.jobs(spark, sf_dir).select("id", "kind", "queue").collect()}
    got = catalog.QUERIES["d04_unique_keys"](spark, sf_dir).collect()
    assert len(got) == len(want) and {r["id"]: r["unique_key"] for r in got} == want


def test_every_customer_has_its_ordering_hash(spark, sf_dir):
    want = {r[0]: blake.ordering_hash(f"customer-{r[0]}".encode()) for r in X.table(spark, sf_dir, "customer").select("c_custkey").collect()}
    got = catalog.QUERIES["d07_ordering_hash"](spark, sf_dir).collect()
    assert len(got) == len(want) and {r["id"]: int(r["hash"]) for r in got} == want and all(r["shard"] == want[r["id"]] % 8 for r in got)


def test_every_job_is_dumped_with_its_events(spark, sf_dir):
    want = {}
    for j in X.jobs(spark, sf_dir).collect():
        events = [("created", j["created_at"], None), ("due", j["run_at"], None), ("attempted", j["attempted_at"], None)]
        events += [("error", e["at"], e["error"]) for e in j["errors"]] + [("finalized", j["finalized_at"], j["state"])]
        want[j["id"]] = sorted((e for e in events if e[1] is not None), key=lambda e: e[1]), len(j["errors"]), j["errors"][-1]["error"] if j["errors"] else None
    got = R.dump_job(X.jobs(spark, sf_dir)).collect()
    assert len(got) == len(want)
    assert {r["id"]: ([(e["event"], e["ts"], e["detail"]) for e in r["timeline"]], r["error_count"], r["latest_error"]) for r in got} == want
    assert {r["id"] for r in catalog.QUERIES["b24_dump_job"](spark, sf_dir).collect()} == set(want)


def _moved(spark, sf_dir, to):
    """The smallest tables with all order keys raised, so that every id is over the ceilings of the older queries."""
    for name in ("orders", "customer"):
        df = X.table(spark, sf_dir, name)
        (df.withColumn("o_orderkey", F.col("o_orderkey") + 32_000) if name == "orders" else df).write.parquet(f"{to}/{name}.parquet")
    return str(to)


def test_batches_reach_the_largest_ids(spark, sf_dir, tmp_path):
    far = _moved(spark, sf_dir, tmp_path)
    jobs = X.jobs(spark, far).collect()
    match = [j for j in jobs if j["kind"] == "send_email" and j["queue"] == "building"]
    done = sum(j["state"] in ("completed", "failed", "cancelled") for j in match)
    got = [r.asDict() for r in catalog.QUERIES["t41_batch_cancel"](spark, far).collect()]
    assert match and got == [{"operation_id": 7, "total": len(match), "pending": 0, "succeeded": len(match) - done, "skipped": done, "missing": 0}]
    want = {j["id"] for j in jobs if j["state"] in ("available", "retryable") and "seg-1" in j["tags"]}
    assert want and {r["id"] for r in catalog.QUERIES["b32_batch_page_rebuilt"](spark, far).collect()} == want
