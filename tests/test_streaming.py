import random

import pytest
from pyspark.sql import functions as F

from quarry.streaming.admission import MICRO, Admission, Clients, TtlCache, admit, admit_all, admit_clients, admit_stream, bursts, cache_hits, check_limit, window_counts


def test_admission_vectors():
    a, b = Admission(6, 60), Admission(6, 60)
    assert [a.accept(0) for _ in range(3)] + [a.accept(30) for _ in range(4)] == [True] * 6 + [False]
    assert b.accept(30)
    assert [a.accept(60) for _ in range(4)] == [True] * 3 + [False]
    assert not Admission(0, 60).accept(5)
    g = Admission(60, 3600)
    assert sum(g.accept(0) for _ in range(61)) == 60 and not g.accept(3599) and g.accept(3600)


def test_cache_vectors():
    c = TtlCache(2, 10)
    assert [c.get("a", 0), c.get("b", 0), c.get("a", 5), c.get("c", 5)] == [False, False, True, False]
    assert not c.get("b", 6)  # was the least recently used
    c = TtlCache(2, 10)
    c.get("a", 0), c.get("c", 5)
    assert not c.get("a", 10) and c.get("c", 10)  # reads don't extend
    assert not TtlCache(0, 10).get("a", 0) and not TtlCache(1, 0).get("a", 0)


@pytest.mark.parametrize("limit, window", [(-1, 1), (True, 1), (1.5, 1), (1, 0), (1, float("nan")), (1, float("inf")), (1, True)])
def test_settings(limit, window):
    with pytest.raises(ValueError):
        check_limit(limit, window)


def events(seed=1, n=600):
    rng = random.Random(seed)
    at, out = 1_000_000, []  # a stream takes what is not after the epoch for late
    for i in range(n):
        at += rng.choice([0, 1, 5, 20, 59, 60, 61, 3600])
        out.append((i, rng.choice(["hot", "hot", "a", None]), at, rng.choice("xyz")))
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "id long, k string, s long, name string").withColumn("ts", F.timestamp_seconds("s")).withColumn("burst", F.lit("clash"))


def test_bursts(spark):
    rows = [(i, k, s, n) for i, k, s, n in events() if k]
    got = {r["id"]: r["burst"] for r in bursts(frame(spark, rows).drop("burst").withColumn("at", F.col("s") * MICRO), "k", "at", 60 * MICRO).collect()}
    last, head = {}, {}
    for i, k, s, _ in rows:
        if k not in last or s - last[k] >= 60:
            head[k] = s * MICRO
        last[k] = s
        assert got[i] == head[k]


def test_batch_against_one_by_one(spark):
    rows = events()
    want, states, caches, hits = {}, {}, {}, {}
    for i, k, s, n in rows:
        want[i] = states.setdefault(k, Admission(2, 60)).accept(s)
        hits[i] = caches.setdefault(k, TtlCache(2, 600)).get(n, s)
    df = frame(spark, rows)
    assert {r["id"]: r["accepted"] for r in admit(df, "k", "ts", "id", 2, 60).collect()} == want
    assert {r["id"]: r["hit"] for r in cache_hits(df, "k", "name", "ts", "id", 2, 600).collect()} == hits
    assert admit(df.limit(0), "k", "ts", "id").count() == 0
    counts = {r["id"]: r["n"] for r in window_counts(df, "k", "ts", "id", 60).collect()}
    assert all(counts[i] == sum(k2 == k and s - 60 < s2 <= s for _, k2, s2, _ in rows) for i, k, s, _ in rows)


def test_stream_equals_batch(spark, tmp_path):
    rows = [(i, k, s, n) for i, k, s, n in events(2, 300) if k]
    for part in range(3):  # three micro-batches, in order of time
        frame(spark, rows[part * 80 : (part + 1) * 80 + (1000 if part == 2 else 0)]).coalesce(1).write.parquet(str(tmp_path / "in" / str(part)))
    schema = frame(spark, rows).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    q = admit_stream(stream, "k", "ts", "id", 2, 60, late="30 days").writeStream.format("memory").queryName("admitted").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {r["id"]: r["accepted"] for r in spark.table("admitted").collect()}
    assert got == {r["id"]: r["accepted"] for r in admit(frame(spark, rows), "k", "ts", "id", 2, 60).collect()}


def test_clients_share_places():
    """Full places refuse new clients and put none out; refusals neither extend a time nor take a place."""
    c = Clients(1, 60, 2, 60)
    assert c.accept("a", 0) and c.accept("b", 0) and not any(c.accept(f"n{i}", 0) for i in range(50)) and len(c.of) == 2
    assert not c.accept("a", 59) and c.accept("n1", 60) and c.accept("a", 60) and not c.accept("b", 60)
    assert not Clients(0, 60, 2, 60).accept("a", 0) and not Clients(1, 60, 0, 60).accept("a", 0)


def test_clients_and_budget_against_one_by_one(spark):
    rows = events(5)
    clients, budget = Clients(2, 60, 2, 120), Admission(5, 600)
    want, all_ = {}, {}
    for i, k, s, _ in rows:
        if k:
            want[i] = clients.accept(k, s)
        all_[i] = budget.accept(s)
    mixed = frame(spark, [(i, k and (k.upper() if i % 2 else k), s, n) for i, k, s, n in rows])
    assert {r["id"]: r["accepted"] for r in admit_clients(mixed, "k", "ts", "id", 2, 60, 2, 120).collect()} == want
    assert {r["id"]: r["accepted"] for r in admit_all(mixed, "ts", "id", 5, 600).collect()} == all_
    assert 0 < sum(want.values()) < len(want)
    with pytest.raises(ValueError):
        admit_clients(mixed, "k", "ts", "id", 2, 60, 2, 30)


def test_late_rows_get_no_decision(spark, tmp_path):
    """What comes in behind the watermark is left out; what is late but before it is decided."""
    base = 1_000_000
    parts = [[(1, "a", base, "x"), (2, "a", base + 7200, "x")], [(3, "a", base + 7100, "x")], [(4, "a", base + 10, "x"), (5, "a", base + 7300, "x")]]
    for n, rows in enumerate(parts):
        frame(spark, rows).coalesce(1).write.parquet(str(tmp_path / "late" / str(n)))
    stream = spark.readStream.schema(frame(spark, parts[0]).schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "late"))
    q = admit_stream(stream, "k", "ts", "id", 5, 600, late="10 minutes").writeStream.format("memory").queryName("late_rows").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {r["id"]: r["accepted"] for r in spark.table("late_rows").collect()} == {1: True, 2: True, 3: True, 5: True}
