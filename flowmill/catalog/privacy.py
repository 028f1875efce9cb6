"""k-anonymity and distances to the closest record."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowmill.catalog import query
from flowmill.catalog.generate import GENERATED, _generated, _real
from flowmill.catalog.quality import FILLED
from flowmill.operators import privacy as P
from flowmill.session import cut_lineage, stored
from flowmill.views import flow_sql, flow_view, table

FLOW = "WITH " + flow_sql()


@query("k_anonymity", FLOW + """
SELECT min(n) AS k_anonymity_min FROM (
  SELECT count(*) AS n FROM flow GROUP BY protocol, service, dst_port, attack_category)""")
def k_anonymity(spark, sf_dir):
    return P.k_anonymity(flow_view(spark, sf_dir))


STATS = ["duration", "src_bytes", "packet_length_mean", "idle_mean", "active_std"]


@query("standardisation", FLOW + ", m AS (SELECT " + ", ".join(
    f"coalesce(median({c}), 0.0) AS {c}" for c in STATS) + " FROM flow) " + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, round(any_value(m.{c}), 6) AS median, round(avg(coalesce(f.{c}, m.{c})), 6) AS mean, "
    f"round(CASE WHEN stddev_pop(coalesce(f.{c}, m.{c})) > 0 THEN stddev_pop(coalesce(f.{c}, m.{c})) ELSE 1.0 END, 6) AS scale "
    f"FROM flow f JOIN m ON true" for c in STATS))
def standardisation(spark, sf_dir):
    out = P.standardisation(stored(flow_view(spark, sf_dir).select(*STATS)), STATS)
    return out.select("feature", *[F.round(c, 6).alias(c) for c in ("median", "mean", "scale")])


# Vectors of label 0-4 play the real side, the others the synthetic one.
KNN = """
WITH base AS (SELECT embedding AS v FROM embeddings WHERE label < 5),
q AS (SELECT vec_id, embedding AS v FROM embeddings WHERE label >= 5),
d AS (SELECT vec_id, list_distance(CAST(q.v AS DOUBLE[]), CAST(base.v AS DOUBLE[])) AS d
  FROM q JOIN base ON true),
r AS (SELECT vec_id, d, row_number() OVER (PARTITION BY vec_id ORDER BY d) AS rk FROM d),
two AS (SELECT vec_id, max(d) FILTER (rk = 1) AS d1, max(d) FILTER (rk = 2) AS d2 FROM r WHERE rk <= 2 GROUP BY 1)"""


def _nearest(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").alias("v"))
    return P.nearest_two(vectors.filter("label >= 5"), vectors.filter("label < 5"), "v", "vec_id")


@query("nearest_two", KNN + " SELECT vec_id, round(d1, 6) AS d1, round(d2, 6) AS d2 FROM two")
def nearest_two(spark, sf_dir):
    return _nearest(spark, sf_dir).select("vec_id", F.round("d1", 6).alias("d1"), F.round("d2", 6).alias("d2"))


@query("distance_summary", KNN + """
, n AS (SELECT d1, d1 / greatest(d2, 1e-12) AS r FROM two)
SELECT round(avg(d1), 6) AS dcr_mean, round(median(d1), 6) AS dcr_median, round(quantile_cont(d1, 0.05), 6) AS dcr_p05,
  round(quantile_cont(d1, 0.95), 6) AS dcr_p95, round(avg(r), 6) AS nndr_mean, round(median(r), 6) AS nndr_median FROM n""")
def distance_summary(spark, sf_dir):
    out = P.distance_summary(_nearest(spark, sf_dir))
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


@query("privacy_report")
def privacy_report(spark, sf_dir):
    real = _real(spark, sf_dir)
    synthetic = cut_lineage(_generated(real))
    return P.privacy_report(real.select(*GENERATED), synthetic, FILLED)
