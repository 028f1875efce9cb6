import numpy as np
import pytest
from pyspark.sql import functions as F

import flowmill.plans.ordered as ordered
from flowmill.functions.hashing import digest
from flowmill.operators.quality import dedup, missing_profile
from flowmill.operators.split import quotas, sample_rows, split_counts, stratified_split
from flowmill.plans import small
from flowmill.plans.small import settle


def test_running_totals(spark):
    rng = np.random.default_rng(1)
    rows = [(k, float(v), int(n)) for k in "ab" for v, n in zip(rng.permutation(500), rng.integers(0, 9, 500))]
    df = spark.createDataFrame(rows, "k string, v double, n long")
    got = {(r.k, r.v): r for r in ordered.running_totals(df, ["k"], "v", ["n"], with_next=True).collect()}
    for k in "ab":
        before, own = 0, sorted((v, n) for kk, v, n in rows if kk == k)
        for i, (v, n) in enumerate(own):
            r = got[(k, v)]
            assert r.n_before == before and r.n_total == sum(m for _, m in own)
            assert r.next_v == (own[i + 1][0] if i + 1 < len(own) else None)
            before += n


def test_running_totals_descending_without_keys(spark):
    df = spark.range(100).select(F.col("id").alias("v"), F.lit(1).alias("n"))
    got = ordered.running_totals(df, [], "v", ["n"], descending=True).filter("v = 97").first()
    assert got.n_before == 2 and got.n_total == 100


@pytest.mark.parametrize("ranked", [100_000, 50])
def test_quantiles_match_numpy(spark, monkeypatch, ranked):
    monkeypatch.setattr(ordered, "MAX_RANKED_ROWS", ranked)
    rng = np.random.default_rng(2)
    groups = {"normal": rng.normal(size=3000), "heavy": np.exp(rng.normal(size=2000) * 6),
              "ties": rng.integers(0, 4, 1500).astype(float), "one": np.array([3.5]), "same": np.full(900, 2.0)}
    df = spark.createDataFrame([(k, float(v)) for k, vs in groups.items() for v in vs] + [("normal", None)], "k string, v double")
    probs = [0.0, 0.005, 0.25, 0.5, 0.9, 1.0]
    got = {(r.k, r.prob): r.quantile for r in ordered.exact_quantiles(df, ["k"], "v", probs).collect()}
    for k, vs in groups.items():
        for p in probs:
            assert got[(k, p)] == pytest.approx(np.quantile(vs, p), rel=1e-12, abs=1e-12)


def test_quantiles_of_nothing(spark):
    df = spark.createDataFrame([], "k string, v double")
    assert ordered.exact_quantiles(df, ["k"], "v", [0.5]).count() == 0


@pytest.mark.parametrize("ranked", [100_000, 20])
def test_hash_cuts(spark, monkeypatch, ranked):
    monkeypatch.setattr(ordered, "MAX_RANKED_ROWS", ranked)
    df = spark.range(3000).select((F.col("id") % 3).alias("g"), digest(F.col("id")).alias("h"))
    wanted = spark.createDataFrame([(0, 0), (1, 333), (2, 5000)], "g long, k long")
    cuts = {r.g: r.cut for r in ordered.hash_cuts(df, "g", "h", wanted).collect()}
    below = {g: df.filter((F.col("g") == g) & (F.col("h") < cuts[g])).count() for g in cuts}
    assert below == {0: 0, 1: 333, 2: 1000}


@pytest.mark.parametrize("per_slice,bound", [(4_096, 100_000), (37, 100_000), (5, 3)])
def test_rows_at(spark, monkeypatch, per_slice, bound):
    # The last case shuffles where the others broadcast.
    monkeypatch.setattr(small.broadcast_checked, "__defaults__", (bound,))
    monkeypatch.setattr(small.settle, "__defaults__", (bound,))
    once = spark.range(1000).select(F.when(F.col("id") < 700, "a").otherwise("b").alias("g"),
                                    (F.col("id") - F.col("id") % 10).alias("v"))
    df = once.withColumn("h", digest(F.col("v")))  # ten copies of each row
    sizes = df.groupBy("g").agg(F.count("*").alias("n"))
    draws = [("a", i % 700, i) for i in range(0, 2000, 7)] + [("b", 299, -1), ("b", 300, -2), ("c", 0, -3), ("a", 5, -4)]
    wanted = spark.createDataFrame(draws, "g string, idx long, id long")
    ranked = {g: sorted((r.h, r.v) for r in df.filter(F.col("g") == g).collect()) for g in ("a", "b")}
    want = sorted((g, i, at, ranked[g][i][1]) for g, i, at in draws if g in ranked and i < len(ranked[g]))
    out = ordered.rows_at(df, "g", "h", sizes, wanted, per_slice)
    assert sorted((r.g, r.idx, r.id, r.v) for r in out.collect()) == want


def test_sample_is_exact_and_repeatable(spark):
    df = spark.range(2000)
    a = sample_rows(df, 137, 7)
    assert a.count() == 137 and a.distinct().count() == 137
    assert sorted(a.collect()) == sorted(sample_rows(df.repartition(13), 137, 7).collect())
    assert sample_rows(df, 5000, 7).count() == 2000


def test_sample_of_copies_is_exact(spark):
    df = spark.range(900).select((F.col("id") % 3).alias("v"))
    assert sample_rows(df, 400, 1).count() == 400


def _flows(spark, n=4000):
    rare = F.when(F.col("id") % 1000 == 1, "rare").when(F.col("id") % 1000 == 2, "scarce")
    return spark.range(n).select(
        "id", rare.when(F.col("id") % 2 == 0, "Normal").when(F.col("id") % 7 == 0, "DoS").otherwise("Probe").alias("attack_category")
    ).withColumn("label", F.when(F.col("attack_category") == "Normal", 0).otherwise(1))


def test_split_invariants(spark):
    df = _flows(spark)
    out = stratified_split(df, seed=3)
    counts = {r["split"]: r["count"] for r in out.groupBy("split").count().collect()}
    assert counts == {"train": 2800, "val": 600, "test": 600}
    assert out.select("id").distinct().count() == 4000 and sorted(out.drop("split").columns) == sorted(df.columns)
    shares = out.filter("attack_category = 'Normal'").groupBy("split").count().collect()
    whole = df.filter("attack_category = 'Normal'").count()
    for r in shares:
        assert abs(r["count"] - whole * {"train": 0.7, "val": 0.15, "test": 0.15}[r["split"]]) <= 2
    assert sorted(out.collect()) == sorted(stratified_split(df.repartition(11), seed=3).collect())
    assert sum(r["rows"] for r in split_counts(out).collect()) == 4000
    with pytest.raises(ValueError):
        stratified_split(df, 0.5, 0.1, 0.1)


def test_published_split_sizes(spark):
    def total(sizes, fraction):
        df = spark.createDataFrame([(f"s{i}", n) for i, n in enumerate(sizes)], "stratum string, n long")
        return quotas(df, fraction).agg(F.sum("k")).first()[0]

    assert total([171298, 100000, 40000, 3529], 0.7) == 220378
    assert total([51389, 30000, 12000, 1060], 0.5) == 47224


def test_settle_beyond_the_bound(spark):
    df = spark.range(100)
    assert settle(df, max_rows=10).count() == 100 and settle(df, max_rows=1000).count() == 100


def test_dedup_treats_nulls_and_zeros_alike(spark):
    df = spark.createDataFrame([(0.0, None), (-0.0, None), (None, "a"), (None, "a")], "x double, y string")
    assert dedup(df).count() == 2
    assert [tuple(r) for r in missing_profile(df).collect()] == [("x", 2), ("y", 2)]
