"""Classifier metrics on the flow view with a hashed score, and on the labels table."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowmill.catalog import query
from flowmill.functions.text import attribution_name, safe_stem, slug
from flowmill.operators import metrics as M
from flowmill.views import flow_sql, flow_view, normal_sql, table, uniform_sql

SCORED = "WITH " + flow_sql(extra=True) + """
, judged AS (SELECT *, CASE WHEN score >= 0.5 THEN 1 ELSE 0 END AS prediction FROM flow)"""
CELLS = """
, cells AS (SELECT count(*) FILTER (label = 0 AND prediction = 0) AS tn, count(*) FILTER (label = 0 AND prediction = 1) AS fp,
  count(*) FILTER (label = 1 AND prediction = 0) AS fn, count(*) FILTER (label = 1 AND prediction = 1) AS tp FROM judged)"""
CURVE = """
, counts AS (SELECT score, count(*) FILTER (label = 1) AS pos, count(*) FILTER (label = 0) AS neg FROM flow GROUP BY score),
sums AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER () AS p, sum(neg) OVER () AS n
  FROM counts WINDOW w AS (ORDER BY score DESC)),
curve AS (SELECT score AS threshold, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, pos, neg, p, n,
  tp / (tp + fp) AS precision, tp / p AS recall, 2 * tp / (tp + fp + p) AS f1 FROM sums)"""


def _scored(spark, sf_dir):
    return flow_view(spark, sf_dir, extra=True)


def _judged(spark, sf_dir):
    return M.band_scores(_scored(spark, sf_dir), 0.5)


def _round(df, *columns, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in columns})


@query("confusion_metrics", SCORED + CELLS + """
SELECT *, round((tp + tn) / (tp + tn + fp + fn), 6) AS accuracy, round(tp / (tp + fp), 6) AS precision,
  round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1 FROM cells""")
def confusion_metrics(spark, sf_dir):
    return _round(M.confusion_metrics(_judged(spark, sf_dir)), "accuracy", "precision", "recall", "f1")


@query("label_agreement", """
WITH judged AS (SELECT quality AS label, 1 - toxic AS prediction FROM labels)""" + CELLS + """
SELECT *, round((tp + tn) / (tp + tn + fp + fn), 6) AS accuracy, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision,
  round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall,
  round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1 FROM cells""")
def label_agreement(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").select("quality", (1 - F.col("toxic")).alias("clean"))
    return _round(M.confusion_metrics(labels, "quality", "clean"), "accuracy", "precision", "recall", "f1")


@query("classification_report", SCORED + CELLS + """
, s AS (SELECT *, tn / (tn + fn) AS p0, tn / (tn + fp) AS r0, 2 * tn / (2 * tn + fn + fp) AS f0,
  tp / (tp + fp) AS p1, tp / (tp + fn) AS r1, 2 * tp / (2 * tp + fp + fn) AS f1,
  tn + fp AS n0, tp + fn AS n1, tn + fp + tp + fn AS n, (tp + tn) / (tn + fp + tp + fn) AS acc FROM cells),
l AS (SELECT 'Normal' AS class, p0 AS precision, r0 AS recall, f0 AS f1, n0 AS support FROM s
UNION ALL SELECT 'Attack', p1, r1, f1, n1 FROM s
UNION ALL SELECT 'accuracy', acc, acc, acc, n FROM s
UNION ALL SELECT 'macro avg', (p0 + p1) / 2, (r0 + r1) / 2, (f0 + f1) / 2, n FROM s
UNION ALL SELECT 'weighted avg', (p0 * n0 + p1 * n1) / n, (r0 * n0 + r1 * n1) / n, (f0 * n0 + f1 * n1) / n, n FROM s)
SELECT class, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM l""")
def classification_report(spark, sf_dir):
    return _round(M.classification_report(_judged(spark, sf_dir)), "precision", "recall", "f1")


CATEGORY = SCORED + """
, modes AS (SELECT attack_category, label FROM (SELECT attack_category, label,
    row_number() OVER (PARTITION BY attack_category ORDER BY count(*) DESC, label) AS rk FROM judged GROUP BY 1, 2) WHERE rk = 1),
c AS (SELECT j.attack_category, count(*) AS rows, CAST(max(m.label) AS INTEGER) AS label, avg(score) AS mp, avg(prediction) AS rate
  FROM judged j JOIN modes m ON j.attack_category = m.attack_category GROUP BY 1),
lines AS (SELECT attack_category, rows, label, round(mp, 6) AS mean_attack_probability,
  CASE WHEN label = 1 THEN round(rate, 6) END AS detection_rate,
  CASE WHEN label = 0 THEN round(rate, 6) END AS false_positive_rate,
  CASE WHEN label = 0 THEN round(1 - rate, 6) END AS specificity,
  CASE WHEN label = 1 THEN CASE WHEN rate >= 0.95 THEN 'ok' WHEN rate >= 0.8 THEN 'warn' ELSE 'danger' END
    ELSE CASE WHEN rate <= 0.02 THEN 'ok' WHEN rate <= 0.06 THEN 'warn' ELSE 'danger' END END AS rate_band,
  CASE WHEN label = 1 THEN CASE WHEN mp >= 0.9 THEN 'ok' WHEN mp >= 0.7 THEN 'warn' ELSE 'danger' END
    ELSE CASE WHEN mp <= 0.03 THEN 'ok' WHEN mp <= 0.08 THEN 'warn' ELSE 'danger' END END AS probability_band,
  label = 1 AND rate < 0.75 AS concern FROM c)"""


@query("category_metrics", CATEGORY + " SELECT * FROM lines")
def category_metrics(spark, sf_dir):
    return _round(M.category_metrics(_judged(spark, sf_dir)), "mean_attack_probability",
                  "detection_rate", "false_positive_rate", "specificity")


@query("category_metrics_sorted", CATEGORY + """
, r AS (SELECT attack_category, rows, label, row_number() OVER (ORDER BY
  CASE WHEN label = 1 THEN coalesce(detection_rate, 0) ELSE 1 - coalesce(false_positive_rate, 0) END, attack_category) AS rk FROM lines)
SELECT attack_category, rows, label FROM r WHERE rk <= 40""")
def category_metrics_sorted(spark, sf_dir):
    lines = M.category_metrics(_judged(spark, sf_dir))
    return M.sorted_category_metrics(lines, "rate", descending=False).select("attack_category", "rows", "label")


@query("ranking_areas", SCORED + CURVE + """
SELECT round(sum(neg * (tp - pos + pos / 2)) / max(p * n), 6) AS roc_auc,
  round(sum(pos * precision) / max(p), 6) AS average_precision FROM curve""")
def ranking_areas(spark, sf_dir):
    return _round(M.ranking_areas(_scored(spark, sf_dir)), "roc_auc", "average_precision")


@query("pr_curve", SCORED + CURVE + """
SELECT threshold, tp, fp, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM curve""")
def pr_curve(spark, sf_dir):
    return _round(M.pr_curve(_scored(spark, sf_dir)).select("threshold", "tp", "fp", "precision", "recall", "f1"),
                  "precision", "recall", "f1")


@query("best_threshold", SCORED + CURVE + """
SELECT threshold, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1
FROM curve ORDER BY curve.f1 DESC, threshold LIMIT 1""")
def best_threshold(spark, sf_dir):
    return _round(M.best_threshold(_scored(spark, sf_dir)), "precision", "recall", "f1")


@query("evaluation", SCORED + CELLS + CURVE + """
, areas AS (SELECT sum(neg * (tp - pos + pos / 2)) / max(p * n) AS roc_auc,
  sum(pos * precision) / max(p) AS average_precision FROM curve)
SELECT 'test' AS split, tn + fp + fn + tp AS rows, CAST(0.5 AS DOUBLE) AS decision_threshold,
  round((tp + tn) / (tp + tn + fp + fn), 6) AS accuracy, round(tp / (tp + fp), 6) AS precision,
  round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1,
  round(roc_auc, 6) AS roc_auc, round(average_precision, 6) AS average_precision, tn, fp, fn, tp FROM cells, areas""")
def evaluation(spark, sf_dir):
    return _round(M.evaluation(_scored(spark, sf_dir), "test", 0.5), "accuracy", "precision", "recall",
                  "f1", "roc_auc", "average_precision")


def _poisson_sql(u):
    import math
    total, term, whens = 0.0, math.exp(-1), []
    for k in range(17):
        total += term
        whens.append(f"WHEN {u} < CAST({total!r} AS DOUBLE) THEN {k}")
        term /= k + 1
    return "CASE " + " ".join(whens) + " ELSE 17 END"


# The four cells hold more than 16 rows at any scale, score groups may hold fewer.
@query("bootstrap_ci", SCORED + """
, g1 AS (SELECT label AS y, prediction AS p, label || '|' || prediction AS key, count(*) AS n FROM judged GROUP BY 1, 2),
g2 AS (SELECT label AS y, score, label || '|' || CAST(CASE WHEN score = 0 THEN 0 ELSE round(score * 2.0 ** (52 - floor(log2(score)))) END AS BIGINT)
  || 'e' || CAST(CASE WHEN score = 0 THEN 0 ELSE floor(log2(score)) END AS BIGINT) AS key, count(*) AS n FROM judged GROUP BY 1, 2),
w1 AS (SELECT y, p, round, CAST(greatest(0.0, floor(n + sqrt(n) * """
       + normal_sql("'boot|42|' || round || '|' || key") + """ + 0.5)) AS BIGINT) AS weight
  FROM g1 CROSS JOIN (SELECT unnest(range(0, 100)) AS round) r),
w2 AS (SELECT y, score, round, CAST(sum(w) AS BIGINT) AS weight FROM (SELECT y, score, round, """ + _poisson_sql("u") + """ AS w FROM
    (SELECT y, score, round, """ + uniform_sql("'boot|42|' || round || '|' || key || '|' || j") + """ AS u
     FROM (SELECT *, unnest(range(1, n + 1)) AS j FROM g2 CROSS JOIN (SELECT unnest(range(0, 100)) AS round) r WHERE n <= 16))) GROUP BY 1, 2, 3
  UNION ALL SELECT y, score, round, CAST(greatest(0.0, floor(n + sqrt(n) * """
       + normal_sql("'boot|42|' || round || '|' || key") + """ + 0.5)) AS BIGINT)
    FROM g2 CROSS JOIN (SELECT unnest(range(0, 100)) AS round) r WHERE n > 16),
cells AS (SELECT round, coalesce(sum(weight) FILTER (y = 0 AND p = 1), 0) AS fp,
  coalesce(sum(weight) FILTER (y = 1 AND p = 0), 0) AS fn, coalesce(sum(weight) FILTER (y = 1 AND p = 1), 0) AS tp
  FROM w1 GROUP BY 1),
counts AS (SELECT round, score, coalesce(sum(weight) FILTER (y = 1), 0) AS pos, coalesce(sum(weight) FILTER (y = 0), 0) AS neg
  FROM w2 WHERE weight > 0 GROUP BY 1, 2),
sums AS (SELECT *, sum(pos) OVER (PARTITION BY round ORDER BY score DESC) AS tp FROM counts),
values_ AS (SELECT 'f1' AS metric, 2 * tp / (2 * tp + fp + fn) AS value FROM cells
  UNION ALL SELECT 'precision', tp / (tp + fp) FROM cells UNION ALL SELECT 'recall', tp / (tp + fn) FROM cells
  UNION ALL SELECT 'roc_auc', sum(neg * (tp - pos + pos / 2)) / (sum(pos) * sum(neg)) FROM sums GROUP BY round)
SELECT metric, round(quantile_cont(CAST(value AS DOUBLE), 0.025), 6) AS low,
  round(quantile_cont(CAST(value AS DOUBLE), 0.975), 6) AS high FROM values_ GROUP BY 1""")
def bootstrap_ci(spark, sf_dir):
    return _round(M.bootstrap_ci(_judged(spark, sf_dir)), "low", "high")


@query("score_bands", SCORED + """
SELECT CASE WHEN score >= 0.85 THEN 'Critical' WHEN score >= 0.65 THEN 'High' WHEN score >= 0.35 THEN 'Review' ELSE 'Low' END AS risk,
  CASE WHEN prediction = 1 THEN 'Attack' ELSE 'Normal' END AS verdict, count(*) AS rows, round(avg(score), 6) AS mean_score
FROM judged GROUP BY 1, 2""")
def score_bands(spark, sf_dir):
    return _judged(spark, sf_dir).groupBy("risk", "verdict").agg(
        F.count("*").alias("rows"), F.round(F.avg("score"), 6).alias("mean_score"))


@query("scoring_summary", SCORED + """
SELECT count(*) AS rows_received, count(*) AS rows_scored, false AS truncated,
  count(*) FILTER (prediction = 1) AS attack_count, count(*) FILTER (prediction = 0) AS normal_count,
  round(avg(score), 6) AS mean_attack_probability FROM judged""")
def scoring_summary(spark, sf_dir):
    return _round(M.scoring_summary(_judged(spark, sf_dir)), "mean_attack_probability")


@query("extreme_examples", SCORED + """
, a AS (SELECT 'attack' AS kind, row_key, score, attack_category FROM flow WHERE label = 1 ORDER BY score DESC, row_key LIMIT 1),
n AS (SELECT 'normal' AS kind, row_key, score, attack_category FROM flow WHERE label = 0 ORDER BY score, row_key LIMIT 1)
SELECT * FROM a UNION ALL SELECT * FROM n""")
def extreme_examples(spark, sf_dir):
    scored = _scored(spark, sf_dir)
    pick = lambda kind: M.extreme_example(scored, kind, tie="row_key").select(
        F.lit(kind).alias("kind"), "row_key", "score", "attack_category")
    return pick("attack").unionByName(pick("normal"))


@query("name_cleaning", """
SELECT url_stem, slug, feature, count(*) AS rows FROM (
  SELECT coalesce(nullif(regexp_replace(substr(regexp_replace(trim(p_name || ' / ' || p_brand), '[^a-zA-Z0-9_.-]+', '_', 'g'), 1, 80),
      '^[._-]+|[._-]+$', '', 'g'), ''), 'synthetic_dataset') AS url_stem,
    substr(regexp_replace(regexp_replace(lower(p_name || ' ' || p_type || ' ' || p_brand), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'), 1, 28) AS slug,
    CASE WHEN p_size % 2 = 0 THEN 'protocol = ' || p_type ELSE p_brand END AS feature
  FROM part) GROUP BY 1, 2, 3""")
def name_cleaning(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    raw = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("categorical__protocol_"), "p_type")).otherwise(
        F.concat(F.lit("numeric__"), "p_brand"))
    return part.select(
        safe_stem(F.concat_ws(" / ", "p_name", "p_brand")).alias("url_stem"),
        slug(F.concat_ws(" ", "p_name", "p_type", "p_brand")).alias("slug"),
        attribution_name(raw).alias("feature"),
    ).groupBy("url_stem", "slug", "feature").agg(F.count("*").alias("rows"))
