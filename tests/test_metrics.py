import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from flowmill.operators import compare as C
from flowmill.operators import drift as D
from flowmill.operators import metrics as M
from flowmill.operators import privacy as P


def test_published_confusion(spark):
    cells = spark.createDataFrame([(25521, 174, 172, 21358)], "tn long, fp long, fn long, tp long")
    r = M.with_scores(cells).first()
    assert round(r.f1, 6) == 0.991965 and round(r.accuracy, 6) == 0.992673
    assert round(r.precision, 6) == 0.991919 and round(r.recall, 6) == 0.992011


def test_zero_division(spark):
    df = spark.createDataFrame([(0, 0)], "label int, prediction int")
    r = M.confusion_metrics(df).first()
    assert (r.precision, r.recall, r.f1, r.accuracy) == (0.0, 0.0, 0.0, 1.0)


def _scores(seed, n=400, levels=40):
    rng = np.random.default_rng(seed)
    y = rng.integers(0, 2, n)
    return y, np.round((rng.random(n) + 0.4 * y) * levels) / levels


def test_areas_match_brute_force(spark):
    y, s = _scores(3)
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, s)], "label int, score double")
    r = M.ranking_areas(df).first()
    pos, neg = s[y == 1], s[y == 0]
    auc = np.mean((pos[:, None] > neg[None]) + 0.5 * (pos[:, None] == neg[None]))
    ap, last = 0.0, 0.0
    for t in sorted(set(s), reverse=True):
        tp, fp = (pos >= t).sum(), (neg >= t).sum()
        ap += (tp / len(pos) - last) * tp / (tp + fp)
        last = tp / len(pos)
    assert r.roc_auc == pytest.approx(auc) and r.average_precision == pytest.approx(ap)
    flipped = M.ranking_areas(df.withColumn("score", -F.col("score"))).first()
    assert r.roc_auc + flipped.roc_auc == pytest.approx(1)
    best = M.best_threshold(df).first()
    f1 = {t: 2 * (pos >= t).sum() / ((pos >= t).sum() + (neg >= t).sum() + len(pos)) for t in set(s)}
    assert best.f1 == pytest.approx(max(f1.values()))
    assert best.threshold == min(t for t in f1 if f1[t] == pytest.approx(best.f1, abs=1e-15))


def test_one_class(spark):
    df = spark.createDataFrame([(1, 0.2), (1, 0.4)], "label int, score double")
    r = M.ranking_areas(df).first()
    assert r.roc_auc is None and r.average_precision is None
    empty = M.best_threshold(df.limit(0)).first()
    assert empty.threshold == 0.5 and empty.f1 == 0.0


def test_bootstrap_interval_covers_the_estimate(spark):
    y, s = _scores(5, 3000)
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, s)], "label int, score double")
    df = df.withColumn("prediction", (F.col("score") >= 0.7).cast("int"))
    ci = {r.metric: r for r in M.bootstrap_ci(df, rounds=100).collect()}
    point = M.confusion_metrics(df).first()
    for m in ("f1", "precision", "recall"):
        assert ci[m].low < point[m] < ci[m].high and ci[m].high - ci[m].low < 0.08
    assert ci["roc_auc"].low < M.ranking_areas(df).first().roc_auc < ci["roc_auc"].high


def _table(spark, x, name="x"):
    return spark.createDataFrame([(None if np.isnan(v) else float(v),) for v in x], f"{name} double")


def test_ks_wasserstein_js(spark):
    rng = np.random.default_rng(7)
    a, b = np.round(rng.normal(size=700), 2), np.round(rng.normal(0.4, 1.3, 500), 2)
    grid = np.unique(np.concatenate([a, b]))
    fa = np.searchsorted(np.sort(a), grid, "right") / len(a)
    fb = np.searchsorted(np.sort(b), grid, "right") / len(b)
    r = C.ks_wasserstein(_table(spark, a), _table(spark, b), ["x"]).first()
    assert r.ks_statistic == pytest.approx(np.abs(fa - fb).max())
    assert r.wasserstein_distance == pytest.approx((np.abs(fa - fb)[:-1] * np.diff(grid)).sum())
    lo, hi = min(a.min(), b.min()), max(a.max(), b.max())
    p, edges = np.histogram(a, 30, (lo, hi))
    q, _ = np.histogram(b, edges)
    p, q = (p + 1e-12) / (p + 1e-12).sum(), (q + 1e-12) / (q + 1e-12).sum()
    m = (p + q) / 2
    js = (p * np.log2(p / m) + q * np.log2(q / m)).sum() / 2
    assert C.js_divergence(_table(spark, a), _table(spark, b), ["x"]).first().js_divergence == pytest.approx(js, abs=1e-9)
    same = C.js_divergence(_table(spark, a), _table(spark, a), ["x"]).first()
    assert same.js_divergence == pytest.approx(0, abs=1e-9)


def test_ks_pvalue(spark):
    df = spark.createDataFrame([(0.0, 50, 50), (0.2, 50, 50), (0.05, 5000, 5000), (1.0, 100, 100)], "d double, a long, b long")
    got = [r[0] for r in df.select(C.ks_pvalue(F.col("d"), F.col("a"), F.col("b"))).collect()]
    # Kolmogorov's limit at 1.0 is 0.26999967; at 2.5 it is 7.45e-6.
    assert got[0] == 1.0 and got[1] == pytest.approx(0.26999967, abs=1e-7)
    assert got[2] == pytest.approx(7.4533e-6, rel=1e-3) and got[3] < 1e-20


def test_correlation_with_missing_cells(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(300, 3)) + 1e6
    x[:, 1] = x[:, 0] * 0.5 + rng.normal(size=300)
    x[rng.random((300, 3)) < 0.1] = np.nan
    frame = pd.DataFrame(x, columns=list("abc")).assign(k=4.0)
    rows = [[None if np.isnan(v) else float(v) for v in r] for r in frame.to_numpy()]
    df = spark.createDataFrame(rows, "a double, b double, c double, k double")
    got = {(r.x, r.y): r.correlation for r in C.correlation_matrix(df, list("abck")).collect()}
    want = frame.corr().fillna(0.0)
    for i in "abck":
        for j in "abck":
            assert got[(i, j)] == pytest.approx(want.loc[i, j], abs=1e-7)
    r = C.correlation_preservation(df, df, list("abck")).first()
    assert r.correlation_frobenius_delta == 0 and r.correlation_preservation == 1


def _pandas_drift(expected, actual):
    both = pd.concat([expected, actual], ignore_index=True).dropna()
    if both.std() == 0:
        return 0.0
    bins = pd.cut(both, 10, duplicates="drop").cat.categories
    share = lambda s: pd.cut(s, bins).value_counts(normalize=True).reindex(bins, fill_value=0.0) + 1e-6
    e, a = share(expected), share(actual)
    return round(max(0.0, float(((a / e - 1) - np.log(a / e)).mul(e).sum())), 6)


def test_drift_matches_binning_by_rounded_edges(spark):
    rng = np.random.default_rng(9)
    cases = {"wide": (rng.normal(size=900), rng.normal(0.5, 1, 700)), "tiny": (rng.random(500) * 1e-5, rng.random(400) * 1.2e-5),
             "large": (rng.normal(1e7, 5, 500), rng.normal(1e7 + 2, 5, 500)), "same": (np.full(50, 3.0), np.full(40, 3.0)),
             "mixed": (np.exp(rng.normal(size=800) * 2), np.exp(rng.normal(size=800) * 2 + 0.3))}
    for name, (a, b) in cases.items():
        got = D.drift_report(_table(spark, a), _table(spark, b), ["x"]).first()
        assert got.psi == pytest.approx(_pandas_drift(pd.Series(a), pd.Series(b)), abs=2e-6), name


def test_drift_of_itself_and_states(spark):
    t = spark.createDataFrame([(float(i), None) for i in range(100)], "x double, e double")
    rows = {r.feature: r for r in D.drift_report(t, t, ["x", "e", "gone"]).collect()}
    assert rows["x"].psi == 0 and rows["x"].severity == "stable"
    assert rows["e"].severity == "empty" and rows["gone"].severity == "missing"
    s = D.drift_summary(D.drift_report(t, t, ["x", "e", "gone"])).first()
    assert (s.features_analysed, s.drifted_features, s.overall_severity) == (1, 0, "stable")


def test_nearest_two_matches_brute_force(spark):
    rng = np.random.default_rng(10)
    base, query = rng.normal(size=(80, 5)), rng.normal(size=(60, 5))
    query[0] = base[3]
    b = spark.createDataFrame([(x.tolist(),) for x in base], "v array<double>")
    q = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(query)], "id long, v array<double>").repartition(4)
    d = np.sort(np.sqrt(((query[:, None] - base[None]) ** 2).sum(-1)), axis=1)
    for r in P.nearest_two(q, b).collect():
        assert (r.d1, r.d2) == (pytest.approx(d[r.id, 0]), pytest.approx(d[r.id, 1]))
    one = P.nearest_two(q, b.limit(1)).first()
    assert one.d2 is None
    s = P.distance_summary(P.nearest_two(q, b)).first()
    assert s.dcr_p05 == pytest.approx(np.percentile(d[:, 0], 5)) and s.nndr_mean == pytest.approx((d[:, 0] / d[:, 1]).mean())


def test_bootstrap_area_does_not_depend_on_the_scale_of_scores(spark):
    rng = np.random.default_rng(4)
    y = rng.integers(0, 2, 2000)
    raw = rng.normal(size=2000) + 0.6 * y
    rank = raw.argsort().argsort() / 2000

    def area(labels, scores):
        order = scores.argsort()
        ranks = np.empty(len(scores))
        ranks[order] = np.arange(1, len(scores) + 1)
        for v in np.unique(scores):
            ranks[scores == v] = ranks[scores == v].mean()
        n1 = labels.sum()
        return (ranks[labels == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * (len(labels) - n1))

    draws = [area(y[i], rank[i]) for i in (rng.integers(0, 2000, 2000) for _ in range(200))]
    low, high = np.quantile(draws, [0.025, 0.975])
    for scores in (rank, rank * 1e-8, 1 - (1 - rank) * 1e-12, rank * 1e-200):
        df = spark.createDataFrame([(int(a), 1, float(s)) for a, s in zip(y, scores)], "label int, prediction int, score double")
        got = {r.metric: r for r in M.bootstrap_ci(df, rounds=200).collect()}["roc_auc"]
        assert abs((got.high - got.low) / (high - low) - 1) < 0.25 and abs(got.low - low) < 0.02
