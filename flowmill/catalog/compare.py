"""Distribution comparison and drift between parts of the flow view."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowmill.catalog import query
from flowmill.operators import compare as C
from flowmill.operators import drift as D
from flowmill.plans.small import settle
from flowmill.session import stored
from flowmill.views import flow_sql, flow_view

FEATURES = ["duration", "src_bytes", "dst_bytes", "total_packets_fwd", "packet_length_mean", "idle_mean"]

# Two tables: normal rows, and attack rows with two features moved.
PAIR = "WITH " + flow_sql() + """
, a AS (SELECT * FROM flow WHERE label = 0),
b AS (SELECT * REPLACE (duration * 1.25 AS duration, src_bytes + 5000 AS src_bytes) FROM flow WHERE label = 1),
la AS (""" + " UNION ALL ".join(f"SELECT '{c}' AS feature, {c} AS value FROM a WHERE {c} IS NOT NULL" for c in FEATURES) + """),
lb AS (""" + " UNION ALL ".join(f"SELECT '{c}' AS feature, {c} AS value FROM b WHERE {c} IS NOT NULL" for c in FEATURES) + """),
sides AS (SELECT feature, value, 0 AS side FROM la UNION ALL SELECT feature, value, 1 FROM lb),
ranges AS (SELECT feature, min(value) AS low, max(value) AS high FROM sides GROUP BY 1)"""

HIST = PAIR + """
, g AS (SELECT s.feature, side, value, low, high, (high - low) / 30 AS step,
  least(floor((value - low) / (high - low) * 30), 29) AS guess FROM sides s JOIN ranges r ON s.feature = r.feature),
bins AS (SELECT feature, side, CAST(CASE WHEN value < low + guess * step AND guess > 0 THEN guess - 1
  WHEN value >= low + (guess + 1) * step AND guess < 29 THEN guess + 1 ELSE guess END AS INTEGER) AS bin FROM g),
hist AS (SELECT feature, bin, count(*) FILTER (side = 0) AS n_a, count(*) FILTER (side = 1) AS n_b FROM bins GROUP BY 1, 2)"""

JS = HIST + """
, grid AS (SELECT r.feature, b.bin, coalesce(n_a, 0) + 1e-12 AS x, coalesce(n_b, 0) + 1e-12 AS y
  FROM ranges r JOIN (SELECT unnest(range(0, 30)) AS bin) b ON true LEFT JOIN hist h ON h.feature = r.feature AND h.bin = b.bin),
shares AS (SELECT feature, x / sum(x) OVER (PARTITION BY feature) AS p, y / sum(y) OVER (PARTITION BY feature) AS q FROM grid),
js AS (SELECT feature, sum(p * log2(p / ((p + q) / 2)) + q * log2(q / ((p + q) / 2))) / 2 AS js FROM shares GROUP BY 1)"""

KS = """
, counts AS (SELECT feature, value, count(*) FILTER (side = 0) AS x, count(*) FILTER (side = 1) AS y FROM sides GROUP BY 1, 2),
run AS (SELECT feature, value, sum(x) OVER w / sum(x) OVER f - sum(y) OVER w / sum(y) OVER f AS gap,
  lead(value) OVER w - value AS width, sum(x) OVER f AS n_a, sum(y) OVER f AS n_b
  FROM counts WINDOW w AS (PARTITION BY feature ORDER BY value), f AS (PARTITION BY feature)),
ks AS (SELECT feature, CAST(max(n_a) AS BIGINT) AS n_a, CAST(max(n_b) AS BIGINT) AS n_b, max(abs(gap)) AS d,
  sum(abs(gap) * coalesce(width, 0)) AS w FROM run GROUP BY 1)"""


def _pair(spark, sf_dir):
    flow = stored(flow_view(spark, sf_dir).select("label", *FEATURES, "active_mean"))
    return flow.filter("label = 0"), flow.filter("label = 1").withColumns(
        {"duration": F.col("duration") * 1.25, "src_bytes": F.col("src_bytes") + 5000})


@query("histogram", HIST + " SELECT * FROM hist")
def histogram(spark, sf_dir):
    return C.histogram(*_pair(spark, sf_dir), FEATURES)


@query("js_divergence", JS + " SELECT feature, round(js, 6) AS js_divergence FROM js")
def js_divergence(spark, sf_dir):
    out = C.js_divergence(*_pair(spark, sf_dir), FEATURES)
    return out.withColumn("js_divergence", F.round("js_divergence", 6))


@query("ks_wasserstein", PAIR + KS + """
SELECT feature, n_a, n_b, round(d, 6) AS ks_statistic, round(w, 4) AS wasserstein_distance FROM ks""")
def ks_wasserstein(spark, sf_dir):
    out = C.ks_wasserstein(*_pair(spark, sf_dir), FEATURES)
    return out.withColumns({"ks_statistic": F.round("ks_statistic", 6),
                            "wasserstein_distance": F.round("wasserstein_distance", 4)})


def _corr_sql(side):
    return " UNION ALL ".join(
        f"SELECT '{x}' AS x, '{y}' AS y, coalesce(corr({x}, {y}), 0.0) AS c FROM {side}"
        for x in FEATURES for y in FEATURES)


CORR = PAIR + ", ca AS (" + _corr_sql("a") + "), cb AS (" + _corr_sql("b") + ")"


@query("correlation_matrix", CORR + " SELECT x, y, round(c, 6) AS correlation FROM ca")
def correlation_matrix(spark, sf_dir):
    a, _ = _pair(spark, sf_dir)
    return C.correlation_matrix(a, FEATURES).withColumn("correlation", F.round("correlation", 6))


@query("correlation_preservation", CORR + """
, n AS (SELECT sqrt(sum(ca.c * ca.c)) AS norm, sqrt(sum((ca.c - cb.c) * (ca.c - cb.c))) AS delta
  FROM ca JOIN cb ON ca.x = cb.x AND ca.y = cb.y)
SELECT round(delta, 6) AS correlation_frobenius_delta, round(greatest(0.0, 1 - delta / norm), 6) AS correlation_preservation FROM n""")
def correlation_preservation(spark, sf_dir):
    out = C.correlation_preservation(*_pair(spark, sf_dir), FEATURES)
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


# The p-value is a series; only whether it is below 0.05 is used downstream.
@query("fidelity_report", JS + KS + CORR[len(PAIR):] + """
, n AS (SELECT sqrt(sum(ca.c * ca.c)) AS norm, sqrt(sum((ca.c - cb.c) * (ca.c - cb.c))) AS delta
  FROM ca JOIN cb ON ca.x = cb.x AND ca.y = cb.y),
x AS (SELECT feature, d * sqrt(CAST(n_a AS DOUBLE) * n_b / (n_a + n_b)) AS x FROM ks),
terms AS (SELECT feature, x, k FROM x JOIN (SELECT unnest(range(1, 101)) AS k) t ON true),
p AS (SELECT feature, CASE WHEN x <= 1e-9 THEN 1.0 WHEN x < 1 THEN
    1 - sqrt(2 * pi()) / x * sum(exp(-(2 * k - 1) * (2 * k - 1) * pi() * pi() / 8 / (x * x)))
    ELSE 2 * sum((CASE WHEN k % 2 = 1 THEN 1.0 ELSE -1.0 END) * exp(-2.0 * k * k * x * x)) END AS p FROM terms GROUP BY feature, x)
SELECT 'ks_statistic' AS metric, feature, round(d, 4) AS value FROM ks
UNION ALL SELECT 'ks_pvalue', feature, round(greatest(0.0, least(1.0, p)), 4) FROM p
UNION ALL SELECT 'js_divergence', feature, round(js, 4) FROM js
UNION ALL SELECT 'wasserstein_distance', feature, round(w, 4) FROM ks
UNION ALL SELECT 'numeric_features_compared', NULL, CAST(count(*) AS DOUBLE) FROM ks
UNION ALL SELECT 'average_js_divergence', NULL, round(avg(js), 4) FROM js
UNION ALL SELECT 'ks_failure_rate_p_lt_0_05', NULL, round(avg(CASE WHEN p < 0.05 THEN 1.0 ELSE 0.0 END), 4) FROM p
UNION ALL SELECT 'correlation_frobenius_delta', NULL, round(delta, 4) FROM n
UNION ALL SELECT 'correlation_preservation', NULL, round(greatest(0.0, 1 - delta / norm), 4) FROM n""")
def fidelity_report(spark, sf_dir):
    out = C.fidelity_report(*_pair(spark, sf_dir), FEATURES)
    return out.withColumn("value", F.round("value", 4))


# Edges are rounded to three places; the features' edges need no more.
DRIFT = PAIR + """
, e0 AS (SELECT r.feature, i, CASE WHEN i = 10 THEN high ELSE low + i * ((high - low) / 10) END
    - CASE WHEN i = 0 THEN (high - low) * 0.001 ELSE 0 END AS edge
  FROM ranges r JOIN (SELECT unnest(range(0, 11)) AS i) t ON true),
e AS (SELECT feature, i, round_even(edge * 1000, 0) / 1000 AS edge FROM e0),
b10 AS (SELECT lo.feature, lo.i AS bin, lo.edge AS lo, hi.edge AS hi FROM e lo JOIN e hi ON lo.feature = hi.feature AND hi.i = lo.i + 1),
cnt AS (SELECT b10.feature, b10.bin, count(*) FILTER (side = 0) AS n_a, count(*) FILTER (side = 1) AS n_b
  FROM b10 LEFT JOIN sides s ON s.feature = b10.feature AND s.value > lo AND s.value <= hi GROUP BY 1, 2),
sh AS (SELECT feature, n_a / sum(n_a) OVER (PARTITION BY feature) + 1e-6 AS e, n_b / sum(n_b) OVER (PARTITION BY feature) + 1e-6 AS a FROM cnt),
score AS (SELECT feature, round(greatest(0.0, sum((a - e) - e * ln(a / e))), 6) AS psi,
  round(greatest(0.0, sum((a - e) * ln(a / e))), 6) AS textbook FROM sh GROUP BY 1),
report AS (SELECT feature, psi, CASE WHEN psi < 0.1 THEN 'stable' WHEN psi < 0.25 THEN 'moderate' ELSE 'high' END AS severity FROM score
  UNION ALL SELECT 'active_mean', NULL, 'empty' UNION ALL SELECT 'not_a_column', NULL, 'missing')"""

LISTED = FEATURES + ["active_mean", "not_a_column"]


@query("drift_report", DRIFT + " SELECT feature, psi, severity FROM report")
def drift_report(spark, sf_dir):
    return D.drift_report(*_pair(spark, sf_dir), LISTED)


@query("drift_psi", DRIFT + " SELECT feature, textbook AS psi FROM score")
def drift_psi(spark, sf_dir):
    return D.drift_report(*_pair(spark, sf_dir), FEATURES, method="psi").select("feature", "psi")


@query("drift_summary", DRIFT + """
, f AS (SELECT count(psi) AS features_analysed, count(*) FILTER (severity IN ('moderate', 'high')) AS drifted_features,
  count(*) FILTER (severity IN ('moderate', 'high')) / count(*) AS fraction FROM report)
SELECT features_analysed, drifted_features, round(fraction, 4) AS drift_fraction,
  CASE WHEN fraction > 0.3 THEN 'high' WHEN fraction > 0.1 THEN 'moderate' ELSE 'stable' END AS overall_severity,
  fraction > 0.2 AS retraining_recommended FROM f""")
def drift_summary(spark, sf_dir):
    return D.drift_summary(D.drift_report(*_pair(spark, sf_dir), LISTED))


@query("top_drifted", DRIFT + """
, graded AS (SELECT feature, textbook AS psi, CASE WHEN textbook < 0.1 THEN 'stable' WHEN textbook < 0.25 THEN 'moderate' ELSE 'high' END
  AS severity FROM score),
ranked AS (SELECT *, row_number() OVER (PARTITION BY severity ORDER BY psi DESC, feature) AS place FROM graded)
SELECT severity, feature, psi FROM ranked WHERE severity = 'high' AND place <= 10 OR severity = 'stable' AND place <= 3""")
def top_drifted(spark, sf_dir):
    """The worst features of two severities, the second cut by the limit."""
    report = settle(D.drift_report(*_pair(spark, sf_dir), FEATURES, method="psi"))
    return D.top_drifted(report, "high").unionByName(D.top_drifted(report, "stable", 3)).select("severity", "feature", "psi")
