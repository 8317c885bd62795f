import random

import pytest
from pyspark.sql import functions as F

from gleaner.operators import replay as RP

REQUEST = "seq long, url string, t_us long, realtime boolean, ttl long, target string"
SECOND = 1_000_000


def fold(requests, seeds):
    """The service's own way: one request after another against a store."""
    store = {u: (t, None) for u, t in seeds.items()}
    out = {}
    for seq, url, t, realtime, ttl, target in sorted(requests, key=lambda r: (r[2], r[0])):
        row = store.get(url)
        if not realtime and row and t - row[0] <= ttl * SECOND:
            out[seq] = (True, row[1] is None, row[0], row[1])
        else:
            store[target] = (t, url)
            out[seq] = (False, False, t, url)
    return out


def replayed(spark, requests, seeds):
    found = RP.store_replay(spark.createDataFrame(requests, REQUEST).repartition(5),
                            spark.createDataFrame(list(seeds.items()), "url string, t_us long"))
    return {r.seq: (r.hit, r.from_seed, r.ref_us, r.ref_writer) for r in found.collect()}


@pytest.fixture
def many_partitions(spark):
    """Partitions stay as they are dealt, and Arrow batches are short."""
    kept = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.execution.arrow.maxRecordsPerBatch": "7",
            "spark.sql.shuffle.partitions": "6"}
    before = {k: spark.conf.get(k) for k in kept}
    for k, v in kept.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def log(rng, n, urls, span, target=lambda u: u, realtime=0.1, ttl=lambda u: 40):
    out = []
    for seq in range(n):
        u = rng.choice(urls)
        out.append((seq, u, rng.randrange(span) * SECOND, rng.random() < realtime, ttl(u), target(u)))
    return out


@pytest.mark.parametrize("realtime", [0.0, 0.2])
def test_replay_matches_the_fold_across_partitions(spark, many_partitions, realtime):
    rng = random.Random(int(realtime * 10))
    requests = log(rng, 400, ["hot"] * 6 + ["a", "b", "c", "d"], 900, realtime=realtime)
    seeds = {"hot": 20 * SECOND, "a": 10**15, "b": 0}  # one stored in the future
    assert replayed(spark, requests, seeds) == fold(requests, seeds)


def test_hot_url_without_certain_refreshes_spreads(spark, many_partitions):
    """Gaps below the ttl and nothing realtime: no place where the history could be cut."""
    requests = [(i, "hot", i * 3 * SECOND, False, 40, "hot") for i in range(300)]
    rows = [r for r in requests if r[0] % 3 or r[0] == 0]
    assert replayed(spark, rows, {}) == fold(rows, {})
    events = spark.createDataFrame(rows, REQUEST)
    plan = RP.store_replay(events, spark.createDataFrame([], "url string, t_us long"))
    assert plan.count() == len(rows)
    refreshed = [k for k, v in fold(rows, {}).items() if not v[0]]
    assert len(refreshed) > 15  # a chain through all partitions


def test_ttl_may_differ_between_requests_of_a_url(spark, many_partitions):
    rng = random.Random(7)
    requests = [(*r[:4], rng.choice([0, 5, 40, 200]), r[5]) for r in log(rng, 300, ["hot", "hot", "a"], 600, realtime=0.02)]
    assert replayed(spark, requests, {"hot": 0}) == fold(requests, {"hot": 0})


def test_redirects_chains_and_circles(spark, many_partitions):
    rng = random.Random(11)
    moved = {"a": "b", "b": "c", "x": "y", "y": "x", "s": "s", "z": "gone"}  # a chain, a circle, itself, nowhere asked
    requests = log(rng, 250, ["a", "b", "c", "x", "y", "s", "z"], 700, lambda u: moved.get(u, u), 0.1)
    seeds = {"b": 100 * SECOND, "gone": 0, "z": 50 * SECOND}
    want = fold(requests, seeds)
    assert replayed(spark, requests, seeds) == want
    assert any(w[0] and w[3] not in (None, dict((r[0], r[1]) for r in requests)[s]) for s, w in want.items())


def test_redirect_of_three_requests(spark):
    """Redirected twice, then asked under the final url: the second misses, the third hits."""
    rows = [(1, "a", 0, False, 60, "b"), (2, "a", SECOND, False, 60, "b"), (3, "b", 2 * SECOND, False, 60, "b")]
    assert {k: v[0] for k, v in replayed(spark, rows, {}).items()} == {1: False, 2: False, 3: True}


def test_nulls_ties_and_no_rows(spark):
    assert replayed(spark, [], {}) == {}
    rows = [(1, None, None, None, None, None), (2, None, 0, False, 10, None), (3, "u", 5, None, 10, "u"), (4, "u", 5, False, 10, "u")]
    got = {k: v[0] for k, v in replayed(spark, rows, {}).items()}
    assert got == {1: False, 2: True, 3: False, 4: True}
    out = RP.ttl_replay(spark.createDataFrame(rows, REQUEST).withColumn("ts", F.timestamp_micros("t_us")), ttl_col="ttl")
    assert {r.seq: (r.url, r.hit) for r in out.collect()} == {1: (None, False), 2: (None, True), 3: ("u", False), 4: ("u", True)}


def test_nothing_grows_with_a_key_in_one_task(spark, many_partitions):
    """The rows of one url lie in several partitions, of about equal size."""
    rows = spark.range(20_000).selectExpr("id as seq", "'hot' as url", "id * 1000000 as t_us", "false as realtime",
                                          "cast(100 as long) as ttl", "'hot' as target")
    events = RP._lookups(rows, "target", F.lit(None).cast("long"))
    dealt = events.repartitionByRange("key", "t_us", "seq").groupBy(F.spark_partition_id()).count().collect()
    assert len(dealt) == 6 and max(r["count"] for r in dealt) < 8000
    got = RP.replay(events)
    assert got.where("not hit").count() == len(range(0, 20_000, 101))
