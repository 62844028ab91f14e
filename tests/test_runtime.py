"""Runtime steps, handlers, cached reads, numbering and hashes against plain Python."""

from __future__ import annotations

import collections
import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from jobtide import catalog
from jobtide.functions import blake, cron
from jobtide.functions import scalars as S
from jobtide.operators import batch as O
from jobtide.operators import emission as E
from jobtide.operators import reads as R
from jobtide.operators import runtime as U
from jobtide.operators.numbering import numbered, percentile_ranks
from jobtide.sources import fixtures as X
from jobtide.sources.cached import CachedReads
from jobtide.streaming import workers as W


def test_hashes_of_many_rows():
    rng = random.Random(1)
    rows = [bytes(rng.randrange(256) for _ in range(n)) for n in (0, 1, 63, 64, 65, 127, 128, 129, 500, 1023, 1024, 1025, 3073)]
    assert blake.blake3_many(rows) == [blake.blake3(r) for r in rows] and blake.blake3_many([]) == []


def test_descriptor_and_partition_queries(spark, sf_dir):
    want = {r["id"]: blake.descriptor_hash(r["queue"].title(), None, "ops", None, r["tags"], {"z": 1, "a": [2]}) for r in X.jobs(spark, sf_dir).select("id", "queue", "tags").collect()}
    assert {r["id"]: r["hash"] for r in catalog.QUERIES["d06_descriptor_hash"](spark, sf_dir).collect()} == want
    assert blake.descriptor_hash(extra={"b": 1, "a": 2}) == blake.descriptor_hash(extra={"a": 2, "b": 1}) != blake.descriptor_hash()
    for r in catalog.QUERIES["d08_partition_of_key"](spark, sf_dir).collect():
        p = blake.partition_hash(f"customer-{r['id']}".encode()) % 8
        assert (r["partition"], r["queue"]) == (p, blake.partition_name("mail", p))


@pytest.mark.parametrize(("expression", "zone"), [("*/7 * * * *", "UTC"), ("30 2 * * *", "Europe/Berlin"), ("0 */3 * * SUN", "America/New_York"), ("*/20 15 1,3 * * *", "Pacific/Auckland"), ("0 0 31 * *", "UTC")])
def test_fires_backwards(expression, zone):
    """The last fire before a moment is the last of those that follow the anchor one by one, over changes of the clock, too."""
    c, rng = cron.Cron.parse(expression, zone), random.Random(3)
    for start in (datetime(2024, 3, 29), datetime(2024, 10, 25), datetime(2024, 4, 5), datetime(2024, 11, 1)):
        for _ in range(6):
            anchor = start + timedelta(seconds=rng.randrange(86_400 * 2))
            now = anchor + timedelta(seconds=rng.randrange(86_400 * 3))
            fires = cron.between(c, anchor, now)
            assert cron.latest(c, now, anchor) == (max(fires) if fires else None)


def test_places_without_one_task(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice("ab"), rng.randrange(50)) for i in range(300)]
    got = numbered(spark.createDataFrame(rows, "id long, k string, v long"), ["k"], F.floor(F.col("v") / 7), ["v", "id"]).collect()
    want = {r[0]: n for k in "ab" for n, r in enumerate(sorted((r for r in rows if r[1] == k), key=lambda r: (r[2], r[0])), 1)}
    assert {r["id"]: r["place"] for r in got} == want
    empty = spark.createDataFrame([], "id long, k string, v long")
    assert numbered(empty, [], F.floor(F.col("v") / 7), ["v"]).count() == 0


@pytest.mark.parametrize("p", [0.0, 0.5, 0.95, 0.99, 1.0])
def test_percentiles_by_cells(spark, p):
    rng = random.Random(5)
    rows = [(k, float(v)) for k in "abc" for v in (rng.choices([1, 2, 3], k=41) if k == "a" else [rng.lognormvariate(0, 3) for _ in range(500)] if k == "b" else [7.5])] + [("d", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    got = {r["k"]: r for r in R.percentiles(df, "v", p, "k").collect()}
    assert set(got) == set("abc")
    for k in "abc":
        v = sorted(x for n, x in rows if n == k)
        n = len(v)
        assert got[k]["by_floor"] == v[min(int(np.floor(n * p)), n - 1)] and got[k]["by_round"] == v[int(np.floor((n - 1) * p + 0.5))]
        assert got[k]["interpolated"] == pytest.approx(float(np.quantile(v, p)))
    assert percentile_ranks(df.filter("k = 'b'"), "v", 0.5, []).count() < 500 and R.percentiles(df.filter("k = 'b'"), "v", p).count() == 1


def test_branches_that_overrun_rest(spark, sf_dir):
    got = catalog.QUERIES["r12_branch_health"](spark, sf_dir).collect()
    by = collections.defaultdict(list)
    for r in got:
        by[r["branch"]].append(r)
    rested = 0
    for rows in by.values():
        rest = over = fine = 0
        sample, late = None, False
        for r in sorted(rows, key=lambda r: r["tick"]):
            ran = rest == 0
            if rest:
                rest -= 1
            elif sample is not None:
                took, sample = sample, None
                if took > 1500:
                    over, fine = over + 1, 0
                    if over >= 3:
                        late, rest, ran = True, min(max(-(-2 * took // 1000), 1), 120), False
                elif took < 700:
                    fine, over = fine + 1, 0
                    late = late and fine < 3
            if ran:
                sample = r["took_ms"]
            rested += not ran
            assert (r["ran"], r["delayed"], r["resting"]) == (ran, late, rest)
    assert rested


def test_prunes_back_off(spark, sf_dir):
    by = collections.defaultdict(list)
    for r in catalog.QUERIES["r13_prune_backoff"](spark, sf_dir).collect():
        by[r["ring"]].append(r)
    for rows in by.values():
        skip = level = 0
        for r in sorted(rows, key=lambda r: r["tick"]):
            ran = skip == 0
            if not ran:
                skip -= 1
            elif r["outcome"] == "pruned":
                skip = level = 0
            elif r["outcome"] != "noop":
                level = min(level + 1, 5)
                skip = 2**level
            assert (r["ran"], r["level"], r["skip"]) == (ran, level, skip)


def test_cursors_pass_spent_entries_only(spark):
    rng = random.Random(6)
    rows, heads = [], []
    for shard in range(30):
        seqs = [s for s in range(1, 40) if rng.random() < 0.9]
        rows += [("q", 1, shard, s, rng.random() < 0.8) for s in seqs]
        heads.append(("q", 1, shard, rng.randrange(1, 12)))
    lane = "queue string, priority int, enqueue_shard int"
    got = E.skip_spent(spark.createDataFrame(rows, f"{lane}, lane_seq long, spent boolean"), spark.createDataFrame(heads, f"{lane}, next_claim_seq long")).collect()
    for _, _, shard, at in heads:
        there = {r[3]: r[4] for r in rows if r[2] == shard}
        end = at
        while there.get(end):
            end += 1
        assert next(r["next"] for r in got if r["enqueue_shard"] == shard) == end


def test_operations_that_are_refused(spark):
    for action, filters, more in (("retry", {"states": "completed"}, {}), ("cancel", {"states": ["failed"]}, {}), ("set_priority", {"queue": "a"}, {"priority": 9}), ("move_queue", {"queue": "a"}, {}), ("cancel", {}, {}), ("fly", {"queue": "a"}, {})):
        with pytest.raises(ValueError):
            O.check(action, filters, **more)
    O.check("cancel", {}, allow_all=True)
    O.check("retry", {"states": ["failed", "cancelled"]})


def test_chunks_of_an_operation(spark, sf_dir):
    j = X.jobs(spark, sf_dir)
    after, items = O.run(j, 1, "cancel", X.as_of(), chunk=10, max_chunks=3, kind="sync_inventory", states="available")
    rows = sorted(items.collect(), key=lambda r: r["job_id"])
    assert [r["chunk"] for r in rows] == [i // 10 for i in range(len(rows))] and len(rows) > 40
    assert [r["status"] for r in rows] == ["succeeded"] * 30 + ["pending"] * (len(rows) - 30)
    gone = {r["id"] for r in after.filter("state = 'cancelled'").join(j.filter("state = 'available'").select("id"), "id").collect()}
    assert gone == {r["job_id"] for r in rows[:30]}


def test_handlers(spark):
    registry = W.Registry()
    registry.state["dict"] = {"greeting": "hi"}

    @registry.task("greet")
    def greet(args, context):
        context.note(said=context.extract(dict)["greeting"])
        context.set_progress(140)
        if context.cancelled:
            return W.cancel("asked to")
        return W.retry_after(5) if args.get("later") else None

    with pytest.raises(ValueError):
        registry.task("greet")(greet)
    with pytest.raises(ValueError):
        registry.periodic("bad", "* * *", "greet")
    registry.periodic("good", "* * * * *", "greet")
    rows = [(1, "greet", "{}", 1, 4, False), (2, "greet", '{"later": true}', 1, 4, False), (3, "none", "{}", 1, 4, False), (4, "greet", "not json", 1, 4, False), (5, "greet", None, 2, 9, True)]
    got = {r["id"]: r for r in W.perform(spark.createDataFrame(rows, "id long, kind string, args string, attempt int, run_lease long, cancelled boolean"), registry).collect()}
    assert {i: r["result"] for i, r in got.items()} == {1: "completed", 2: "retry_after", 3: "terminal", 4: "retryable", 5: "cancel"}
    assert got[1]["progress"] == 100 and got[1]["metadata"] == '{"said": "hi"}' and got[2]["delay_s"] == 5 and got[5]["run_lease"] == 9


def test_cached_reads(spark):
    now, asked = [0.0], []
    cache = CachedReads(10, lambda: now[0])

    def query():
        asked.append(1)
        return spark.range(len(asked))

    assert cache.read("a", query).count() == 1 and cache.read("a", query).count() == 1
    now[0] = 10.0
    assert cache.read("a", query).count() == 2 and cache.read("b", query).count() == 3
    cache.forget("b")
    assert cache.read("b", query).count() == 4


def test_json_keeps_kinds(spark):
    row = spark.createDataFrame([('{"a":1,"b":[1,{"c":null}],"d":"x"}',)], "j string")
    out = row.select(S.json_put(S.json_without(F.col("j"), "d"), "e", F.lit('{"f":true}')).alias("o"), S.json_has(F.col("j"), "d").alias("h"), S.json_has(F.lit('["x"]'), "x").alias("i"), S.json_typeof(F.lit("[")).alias("bad")).first()
    import json

    assert json.loads(out["o"]) == {"a": 1, "b": [1, {"c": None}], "e": {"f": True}} and out["h"] and out["i"] and out["bad"] is None


def test_limits_of_a_page(spark, sf_dir):
    j = X.jobs(spark, sf_dir)
    assert R.list_jobs(j, 5000).count() == j.count() > 1000 and R.list_jobs(j, 5000, clamp=True).count() == 1000


def test_one_claim_a_queue_at_most(spark, sf_dir):
    j = X.jobs(spark, sf_dir)
    asked = spark.createDataFrame([("building", 3, 2.9), ("machinery", 5, 5.0)], "queue string, permits long, tokens double")
    after, ledger = U.dispatch(j, X.queue_meta(spark), asked, X.as_of())
    assert {r["queue"]: (r["asked"], r["claimed"], r["refunded"]) for r in ledger.collect()} == {"building": (2, 2, 0), "machinery": (5, 0, 5)}  # machinery is paused
    assert after.filter("changed").count() == 2


class _NoFolder:
    """A session of a cluster in which no shared folder is set."""

    class conf:  # noqa: N801
        @staticmethod
        def get(key, default=None):
            return default

    class sparkContext:  # noqa: N801
        master = "spark://host:7077"

        @staticmethod
        def getCheckpointDir():
            return None


def test_a_cluster_needs_a_shared_folder():
    from jobtide.sources.storage import shared_dir

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_dir(_NoFolder)
