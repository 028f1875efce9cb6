"""No row is lost for a missing key or an infinite cell."""

import pytest
from pyspark.sql import functions as F

from flowmill.operators import compare, drift, generate, quality, split
from flowmill.sources import audit
from flowmill.streaming.throttle import throttle


def test_split_keeps_rows_without_label(spark):
    rows = [(i, None if i % 10 == 0 else i % 2, "a" if i % 3 else None) for i in range(1000)]
    df = spark.createDataFrame(rows, "flow long, label int, attack_category string")
    counts = {r.split: r["count"] for r in split.stratified_split(df).groupBy("split").count().collect()}
    assert counts == {"train": 700, "val": 150, "test": 150}


def test_infinite_cells_are_missing_to_correlation(spark):
    rows = [(float(i), float(-i)) for i in range(50)] + [(float("inf"), 1.0)]
    got = compare.correlation_matrix(spark.createDataFrame(rows, "x double, y double"), ["x", "y"]).collect()
    assert abs(next(r.correlation for r in got if r.x == "x" and r.y == "y") + 1) < 1e-9


def test_audit_tail_gives_as_many_as_asked(spark):
    log = spark.range(2000).selectExpr("id AS ts", "'/api/x' AS path")
    assert audit.audit_tail(log, 1200).count() == 1200


def test_throttle_keeps_events_without_key_or_time(spark):
    rows = [(1, "a", 1.0), (2, None, 1.0), (3, "a", None), (4, "a", 1.5), (5, None, None)]
    df = spark.createDataFrame(rows, "id long, who string, ts double").withColumn("ts", F.timestamp_seconds("ts"))
    got = {r.id: r.accepted for r in throttle(df, "who", "ts", "id", limit=1, window_seconds=10).collect()}
    assert got == {1: True, 2: True, 3: True, 4: False, 5: True}


@pytest.mark.parametrize("key", [None, "id", "nothing"])
def test_copies_are_split_like_other_rows(spark, key):
    key = {"id": F.col("id"), "nothing": F.lit(None)}.get(key)
    copies = [(None if key is None else 5, "a", 1, "same")] * 1000
    others = [(i, "b", 0, f"row {i % 150}") for i in range(100, 300)]
    df = spark.createDataFrame(copies + others, "id long, attack_category string, label int, text string").repartition(4)
    got = {(r.split, r.attack_category): r["count"]
           for r in split.stratified_split(df, key=key).groupBy("split", "attack_category").count().collect()}
    assert [got[s, "a"] for s in ("train", "val", "test")] == [700, 150, 150]
    assert [got[s, "b"] for s in ("train", "val", "test")] == [140, 30, 30]


def test_profile_of_a_null_category_and_infinite_cells(spark):
    rows = [(None, 1.0), (None, 3.0), ("a", 2.0), ("a", float("inf")), ("a", float("nan")), ("a", 4.0), ("b", None)]
    df = spark.createDataFrame(rows, "attack_category string, x double")
    for q in (0.0, 0.05):
        got = {r.attack_category: r for r in quality.numeric_profile(df, ["x"], quantile=q).collect()}
        assert set(got) == {None, "a"}
        assert got[None].low == pytest.approx(1 + 2 * q) and got["a"].high == pytest.approx(4 - 2 * q)
        assert got["a"].std == pytest.approx(2 ** 0.5)


def test_one_infinite_cell_does_not_hide_drift(spark):
    a = spark.createDataFrame([(float(i % 100),) for i in range(1000)], "x double")
    b = spark.createDataFrame([(float(i % 100) + 80,) for i in range(1000)], "x double")
    odd = b.union(spark.createDataFrame([(float("inf"),), (float("-inf"),), (float("nan"),)], "x double"))
    plain, got = (drift.drift_report(a, t, ["x"]).first() for t in (b, odd))
    assert got.psi == plain.psi > 1 and got.severity == "high"
    js = [compare.js_divergence(a, t, ["x"]).first().js_divergence for t in (b, odd)]
    assert js[0] == js[1] > 0.1


def test_generation_refuses_what_is_below_zero(spark):
    df = spark.createDataFrame([("a", 1)], "attack_category string, label int")
    for bad in ({"noise_scale": -0.1}, {"rows": 0}, {"minimum_per_category": -1}, {"clip_quantile": -0.01}, {"mode": "odd"}):
        with pytest.raises(ValueError):
            generate.generate(df, generate.GenerationRequest(**bad))


def test_matches_are_exact_when_fingerprints_collide(spark):
    kinds = "a double, b string, c long"
    real = spark.createDataFrame([(0.0, "x", 1), (0.0, "x", 1), (None, "y", 2), (float("nan"), None, 3), (5.0, "z", 4)], kinds)
    rows = [(-0.0, "x", 1), (-0.0, "x", 1), (None, "y", 2), (float("nan"), None, 3), (5.0, "z", 5), (None, None, None)]
    made = spark.createDataFrame(rows, kinds)
    shown = lambda df: sorted(map(str, df.collect()))
    plain = {how: shown(quality._membership(made, real, ["a", "b", "c"], how)) for how in ("left_semi", "left_anti")}
    assert len(plain["left_semi"]) == 4 and len(plain["left_anti"]) == 2
    one = lambda types, columns: F.lit(7).cast("long")
    assert all(shown(quality._membership(made, real, ["a", "b", "c"], how, one)) == rows for how, rows in plain.items())
    assert quality.exact_match_count(made, real).first().exact_real_row_matches == 4
    assert quality.exact_match_count(made, real.limit(0)).first().exact_real_row_matches == 0
