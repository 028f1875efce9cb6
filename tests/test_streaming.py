import random
from collections import deque

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowmill.streaming import windows
from flowmill.streaming.throttle import accept, throttle, throttle_stream


def naive(times, limit, window):
    recent, out = deque(), []
    for t in times:
        while recent and recent[0] < t - window:
            recent.popleft()
        out.append(len(recent) < limit)
        if out[-1]:
            recent.append(t)
    return out


@pytest.mark.parametrize("seed", range(25))
def test_accept_matches_naive(seed):
    rng = random.Random(seed)
    times = sorted(rng.randint(0, 400) for _ in range(rng.randint(1, 300)))
    limit, window = rng.randint(1, 12), rng.randint(1, 80)
    assert list(accept(np.array(times), deque(), limit, window)) == naive(times, limit, window)


def _events(spark, seed, n=3000):
    """One key holds a third of the events; bursts and quiet stretches alternate."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        key = 0 if rng.random() < 0.34 else rng.randint(1, 30)
        burst = rng.randint(0, 40) * 500
        rows.append((i, key, burst + (rng.randint(0, 60) if rng.random() < 0.7 else rng.randint(0, 500))))
    df = spark.createDataFrame(rows, "id long, key long, s long")
    return rows, df.select("id", "key", F.timestamp_seconds("s").alias("ts"))


@pytest.mark.parametrize("limit,window", [(3, 30), (10, 60), (1, 7)])
def test_throttle_matches_naive(spark, limit, window):
    rows, df = _events(spark, limit)
    got = {r.id: r.accepted for r in throttle(df, "key", "ts", "id", limit, window).collect()}
    want = {}
    for key in {r[1] for r in rows}:
        own = sorted((s, i) for i, k, s in rows if k == key)
        want.update(zip([i for _, i in own], naive([s for s, _ in own], limit, window)))
    assert got == want and not all(want.values())


def test_throttle_stream_in_micro_batches(spark, tmp_path):
    rows, df = _events(spark, 4, 900)
    ordered = sorted(rows, key=lambda r: (r[2], r[0]))
    for part in range(3):
        ids = [r[0] for r in ordered[part * 300 : (part + 1) * 300]]
        df.filter(F.col("id").isin(ids)).coalesce(1).write.parquet(f"{tmp_path}/in/part{part}")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option(
        "recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    q = (throttle_stream(stream, "key", "ts", "id", 5, 60, "1 day").writeStream.format("parquet").outputMode("append")
         .option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start(f"{tmp_path}/out"))
    q.awaitTermination()
    got = {r.id: r.accepted for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    want = {r.id: r.accepted for r in throttle(df, "key", "ts", "id", 5, 60).collect()}
    assert len(got) == 900 and got == want


def _files(df, path, groups):
    """One file per group of ids, older first."""
    import os
    for number, ids in enumerate(groups):
        part = f"{path}/part{number}"
        df.filter(F.col("id").isin(ids)).coalesce(1).write.parquet(part)
        for name in os.listdir(part):
            os.utime(f"{part}/{name}", (1_700_000_000 + number, 1_700_000_000 + number))
    return df.sparkSession.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option(
        "recursiveFileLookup", True).parquet(path)


def test_every_event_of_a_stream_comes_out(spark, tmp_path):
    rows = [(1, 7, 100), (2, 7, 110), (3, 7, 50_000), (4, 7, 105), (5, 7, 50_001), (6, None, 5), (7, 7, None)]
    df = spark.createDataFrame(rows, "id long, key long, s long").select("id", "key", F.timestamp_seconds("s").alias("ts"))
    stream = _files(df, f"{tmp_path}/in", [[1, 2], [3], [4, 5, 6, 7]])
    q = (throttle_stream(stream, "key", "ts", "id", 5, 60, "1 minute").writeStream.format("parquet").outputMode("append")
         .option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start(f"{tmp_path}/out"))
    q.awaitTermination()
    got = {r.id: (r.accepted, r.late) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {i: (True, False) for i in (1, 2, 3, 5, 6, 7)} | {4: (None, True)}


def test_recent_times_stay_in_order():
    recent = deque([100, 130])
    assert list(accept(np.array([90, 95]), recent, 4, 60)) == [True, True] and list(recent) == [90, 95, 100, 130]
    assert list(accept(np.array([140, 151, 156]), recent, 4, 60)) == [False, True, True] and list(recent) == [100, 130, 151, 156]


def test_windows_of_a_stream_are_those_of_the_table(spark, tmp_path):
    rng = random.Random(8)
    rows = [(i, rng.randint(0, 40_000), rng.choice(["/api/a", "/api/b"]), rng.choice([200, 500]), rng.choice([None, 3, 9])) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, s long, path string, status int, ms long").withColumn("ts", F.timestamp_seconds("s"))
    late = [r[0] for r in rows if r[1] < 10_000]  # the oldest events come last
    others = [r[0] for r in rows if r[1] >= 10_000]
    stream = _files(df, f"{tmp_path}/in", [others[:100], others[100:], late])
    windows.audit_stream(stream, f"{tmp_path}/parts", f"{tmp_path}/state").awaitTermination()
    show = lambda out: sorted(map(str, out.collect()))
    assert show(windows.merge_audit(spark.read.parquet(f"{tmp_path}/parts"))) == show(windows.audit_windows(df))

    base = df.filter("s < 20000")
    windows.drift_stream(stream, "ts", base, ["s", "ms"], "1 hour", f"{tmp_path}/drift", f"{tmp_path}/drift-state").awaitTermination()
    edges, known = windows.baseline_bins(base, ["s", "ms"])
    want = windows.score_windows(windows.window_bins(df, "ts", edges, ["s", "ms"], "1 hour"), known)
    pick = lambda out: sorted((str(r.window), r.feature, round(r.psi, 9), r.severity) for r in out.collect())
    assert pick(windows.drift_windows(spark, f"{tmp_path}/drift")) == pick(want)


def test_windows_without_events(spark, tmp_path):
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema("ts timestamp, path string, status int, ms long").parquet(f"{tmp_path}/in")
    windows.audit_stream(stream, f"{tmp_path}/parts", f"{tmp_path}/state").awaitTermination()
    assert windows.merge_audit(spark.read.parquet(f"{tmp_path}/parts")).count() == 0
