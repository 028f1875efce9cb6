"""Counts, facets, dedup, missing values, constraints, membership."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowmill.catalog import query
from flowmill.functions.numeric import derived_measures
from flowmill.operators import quality as Q
from flowmill.schema import FLOW_COLUMNS, NON_NEGATIVE, NUMERIC_FEATURES, STRING_FEATURES
from flowmill.session import stored
from flowmill.views import flow_sql, flow_view, table

FLOW = "WITH " + flow_sql()

# Columns of the view that carry values; the others are empty throughout.
FILLED = [
    "duration", "src_port", "dst_port", "src_bytes", "dst_bytes", "total_packets_fwd",
    "total_packets_bwd", "packet_length_mean", "flow_bytes_per_sec", "syn_flag_count",
    "idle_mean", "bytes_per_packet_ratio",
]


def _r(name: str, digits: int = 6):
    return F.round(F.col(name), digits).alias(name)


@query("flow_profile", FLOW + """
, by_label AS (SELECT attack_category, label, count(*) AS n FROM flow GROUP BY 1, 2),
mode AS (SELECT attack_category, label FROM
  (SELECT *, row_number() OVER (PARTITION BY attack_category ORDER BY n DESC, label) AS rn FROM by_label) WHERE rn = 1)
SELECT f.attack_category, count(*) AS rows, CAST(max(m.label) AS INTEGER) AS label,
  round(avg(src_bytes), 6) AS mean_src_bytes, round(avg(duration), 6) AS mean_duration,
  count(idle_mean) AS idle_rows
FROM flow f JOIN mode m ON f.attack_category = m.attack_category GROUP BY f.attack_category""")
def flow_profile(spark, sf_dir):
    flow = flow_view(spark, sf_dir)
    # One pass: label counts and sums per (category, label), then a merge of a few rows.
    parts = flow.groupBy("attack_category", "label").agg(
        F.count("*").alias("n"), F.sum("src_bytes").alias("b"), F.count("src_bytes").alias("nb"),
        F.sum("duration").alias("d"), F.count("duration").alias("nd"), F.count("idle_mean").alias("i"))
    return parts.groupBy("attack_category").agg(
        F.sum("n").alias("rows"),
        F.max_by("label", F.struct(F.col("n"), -F.col("label").cast("int"))).cast("int").alias("label"),
        F.round(F.try_divide(F.sum("b"), F.sum("nb")), 6).alias("mean_src_bytes"),
        F.round(F.try_divide(F.sum("d"), F.sum("nd")), 6).alias("mean_duration"),
        F.sum("i").alias("idle_rows"))


@query("value_counts", FLOW + """
SELECT coalesce(attack_subcategory, 'Unknown') AS name, count(*) AS rows FROM flow GROUP BY 1""")
def value_counts(spark, sf_dir):
    return Q.value_counts(flow_view(spark, sf_dir), "attack_subcategory")


@query("facet_counts", FLOW + " " + " UNION ALL ".join(
    f"SELECT '{c}' AS facet, CAST({c} AS VARCHAR) AS name, count(*) AS rows FROM flow GROUP BY 2"
    for c in ("dataset_source", "environment_type", "attack_subcategory", "label")))
def facet_counts(spark, sf_dir):
    return Q.facet_counts(flow_view(spark, sf_dir),
                          ["dataset_source", "environment_type", "attack_subcategory", "label"])


@query("label_counts", FLOW + """
SELECT environment_type, count(*) FILTER (label = 0) AS normal_rows,
  count(*) FILTER (label = 1) AS attack_rows FROM flow GROUP BY 1""")
def label_counts(spark, sf_dir):
    return Q.label_counts(flow_view(spark, sf_dir), ["environment_type"])


@query("category_facets", FLOW + """
, subs AS (SELECT attack_category, attack_subcategory, count(*) AS n,
    row_number() OVER (PARTITION BY attack_category ORDER BY count(*) DESC, attack_subcategory) AS rk
  FROM flow GROUP BY 1, 2),
tops AS (SELECT attack_category, string_agg(attack_subcategory, ',' ORDER BY rk) AS top_subcategories
  FROM subs WHERE rk <= 5 GROUP BY 1),
labs AS (SELECT attack_category, label, sum(count(*)) OVER (PARTITION BY attack_category) AS rows,
    row_number() OVER (PARTITION BY attack_category ORDER BY count(*) DESC, label) AS rk
  FROM flow GROUP BY 1, 2)
SELECT l.attack_category, CAST(l.rows AS BIGINT) AS rows, CAST(l.label AS INTEGER) AS label, t.top_subcategories
FROM labs l JOIN tops t ON l.attack_category = t.attack_category WHERE l.rk = 1""")
def category_facets(spark, sf_dir):
    return Q.category_facets(flow_view(spark, sf_dir)).withColumn(
        "top_subcategories", F.concat_ws(",", "top_subcategories"))


@query("group_mode", FLOW + """
SELECT attack_category, environment_type FROM (
  SELECT attack_category, environment_type,
    row_number() OVER (PARTITION BY attack_category ORDER BY count(*) DESC, environment_type) AS rk
  FROM flow GROUP BY 1, 2) WHERE rk = 1""")
def group_mode(spark, sf_dir):
    return Q.group_mode(flow_view(spark, sf_dir), "attack_category", "environment_type")


@query("ingest_summary", FLOW + """
, totals AS (SELECT dataset_source, count(*) AS rows, count(DISTINCT source_file) AS files,
    count(*) FILTER (label = 0) AS normal_rows, count(*) FILTER (label = 1) AS attack_rows
  FROM flow GROUP BY 1),
cats AS (SELECT dataset_source, attack_category, count(*) AS category_rows,
    row_number() OVER (PARTITION BY dataset_source ORDER BY count(*) DESC, attack_category) AS rank
  FROM flow GROUP BY 1, 2)
SELECT t.*, c.attack_category, c.category_rows, CAST(c.rank AS INTEGER) AS rank
FROM totals t JOIN cats c ON t.dataset_source = c.dataset_source WHERE c.rank <= 20""")
def ingest_summary(spark, sf_dir):
    return Q.ingest_summary(flow_view(spark, sf_dir))


@query("faceted_filter", FLOW + """
SELECT attack_category, dataset_source, count(*) AS rows, round(sum(src_bytes), 2) AS src_bytes FROM flow
WHERE attack_category IN ('ECONOMY', 'SMALL', 'Normal') AND dataset_source IN ('MACHINERY', 'HOUSEHOLD')
  AND label IN (1) GROUP BY 1, 2""")
def faceted_filter(spark, sf_dir):
    kept, _ = Q.faceted_filter(
        flow_view(spark, sf_dir), attack_categories=["ECONOMY", "SMALL", "Normal"],
        dataset_sources=["MACHINERY", "HOUSEHOLD"], labels=[1])
    return kept.groupBy("attack_category", "dataset_source").agg(
        F.count("*").alias("rows"), F.round(F.sum("src_bytes"), 2).alias("src_bytes"))


@query("facet_validation", FLOW + """
, asked(facet, name) AS (VALUES ('attack_categories', 'ECONOMY'), ('attack_categories', 'Worm'),
  ('dataset_sources', 'MACHINERY'), ('dataset_sources', 'Lab'), ('environment_types', '5-LOW'),
  ('labels', '1'), ('labels', '7'))
SELECT facet, name FROM asked a WHERE NOT EXISTS (
  SELECT 1 FROM (SELECT 'attack_categories' AS facet, attack_category AS name FROM flow
    UNION SELECT 'dataset_sources', dataset_source FROM flow
    UNION SELECT 'environment_types', environment_type FROM flow
    UNION VALUES ('labels', '0'), ('labels', '1')) h WHERE h.facet = a.facet AND h.name = a.name)""")
def facet_validation(spark, sf_dir):
    return Q.unknown_facet_values(
        flow_view(spark, sf_dir), attack_categories=["ECONOMY", "Worm"],
        dataset_sources=["MACHINERY", "Lab"], environment_types=["5-LOW"], labels=[1, 7])


@query("missing_profile", FLOW + ", m AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS missing FROM flow" for c in FLOW_COLUMNS
) + ") SELECT * FROM m WHERE missing > 0 ORDER BY missing DESC, \"column\" LIMIT 30")
def missing_profile(spark, sf_dir):
    return Q.missing_profile(flow_view(spark, sf_dir))


@query("missing_cells", FLOW + " SELECT CAST(" + " + ".join(
    f"(count(*) - count({c}))" for c in FLOW_COLUMNS) + " AS BIGINT) AS missing_cells FROM flow")
def missing_cells(spark, sf_dir):
    return Q.missing_cells(flow_view(spark, sf_dir))


def _twice(spark, sf_dir, hold=lambda df: df):
    """The flow view with the rows of one environment repeated."""
    flow = hold(flow_view(spark, sf_dir))
    return flow.unionByName(flow.filter(F.col("environment_type") == "1-URGENT"))


TWICE = FLOW + """
, twice AS (SELECT * FROM flow UNION ALL SELECT * FROM flow WHERE environment_type = '1-URGENT')"""


@query("dedup", TWICE + """
, d AS (SELECT DISTINCT * FROM twice)
SELECT attack_category, count(*) AS rows, CAST(sum(label) AS BIGINT) AS attacks FROM d GROUP BY 1""")
def dedup(spark, sf_dir):
    return Q.dedup(_twice(spark, sf_dir)).groupBy("attack_category").agg(
        F.count("*").alias("rows"), F.sum("label").alias("attacks"))


@query("dedup_documents", """
SELECT lang, source, count(*) AS texts, CAST(sum(length(text)) AS BIGINT) AS chars
FROM (SELECT DISTINCT lang, source, text FROM documents) GROUP BY 1, 2""")
def dedup_documents(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("lang", "source", "text")
    return Q.dedup(docs).groupBy("lang", "source").agg(
        F.count("*").alias("texts"), F.sum(F.length("text")).alias("chars"))


@query("duplicate_rows", TWICE + """
, d AS (SELECT DISTINCT * FROM twice)
SELECT (SELECT count(*) FROM twice) AS rows, (SELECT count(*) FROM d) AS distinct_rows,
  (SELECT count(*) FROM twice) - (SELECT count(*) FROM d) AS duplicate_rows""")
def duplicate_rows(spark, sf_dir):
    return Q.duplicate_rows(_twice(spark, sf_dir))


@query("quality_report", TWICE + """
, d AS (SELECT DISTINCT * FROM twice),
m AS (""" + " UNION ALL ".join(
    f"SELECT '{c}' AS key, count(*) - count({c}) AS value FROM d" for c in FLOW_COLUMNS) + f""")
SELECT 'rows' AS section, 'before_dedup' AS key, count(*) AS value FROM twice
UNION ALL SELECT 'rows', 'after_dedup', count(*) FROM d
UNION ALL SELECT 'rows', 'duplicates_removed', (SELECT count(*) FROM twice) - (SELECT count(*) FROM d)
UNION ALL SELECT 'columns', 'all', {len(FLOW_COLUMNS)}
UNION ALL SELECT 'columns', 'numeric_features', {len(NUMERIC_FEATURES)}
UNION ALL SELECT 'columns', 'categorical_features', {len(STRING_FEATURES)}
UNION ALL SELECT 'dataset_source', dataset_source, count(*) FROM d GROUP BY 2
UNION ALL SELECT 'label', CAST(label AS VARCHAR), count(*) FROM d GROUP BY 2
UNION ALL SELECT 'attack_category', attack_category, count(*) FROM d GROUP BY 2
UNION ALL SELECT 'missing', key, value FROM (SELECT * FROM m WHERE value > 0 ORDER BY value DESC, key LIMIT 30)""")
def quality_report(spark, sf_dir):
    before = _twice(spark, sf_dir, stored)
    return Q.quality_report(before, Q.dedup_portions(before))


@query("constraint_violations", FLOW + """
, bad AS (SELECT * REPLACE (src_port + 65000 AS src_port, duration - 100 AS duration) FROM flow),
v AS (""" + " UNION ALL ".join(
    f"SELECT 'non_negative' AS \"constraint\", '{c}' AS \"column\", count(*) FILTER ({c} < 0) AS rows FROM bad"
    for c in NON_NEGATIVE) + " UNION ALL " + " UNION ALL ".join(
    f"SELECT 'port_range', '{c}', count(*) FILTER ({c} < 0 OR {c} > 65535) FROM bad"
    for c in ("src_port", "dst_port")) + ") SELECT * FROM v WHERE rows > 0")
def constraint_violations(spark, sf_dir):
    bad = flow_view(spark, sf_dir).withColumns(
        {"src_port": F.col("src_port") + 65000, "duration": F.col("duration") - 100})
    return Q.constraint_violations(bad)


@query("category_numeric_profile", FLOW + """
, long AS (""" + " UNION ALL ".join(
    f"SELECT attack_category, '{c}' AS feature, {c} AS value FROM flow WHERE {c} IS NOT NULL"
    for c in FILLED) + """)
SELECT attack_category, feature, round(stddev_samp(value), 6) AS std,
  round(quantile_cont(value, 0.005), 6) AS low, round(quantile_cont(value, 0.995), 6) AS high
FROM long GROUP BY 1, 2""")
def category_numeric_profile(spark, sf_dir):
    profile = Q.numeric_profile(stored(flow_view(spark, sf_dir).select("attack_category", *FILLED)), FILLED)
    return profile.select("attack_category", "feature", _r("std"), _r("low"), _r("high"))


@query("median_fill", FLOW + ", med AS (SELECT " + ", ".join(
    f"coalesce(median({c}), 0.0) AS m_{c}" for c in ("packet_length_mean", "idle_mean", "active_std")
) + """ FROM flow)
SELECT attack_category, round(avg(coalesce(packet_length_mean, m_packet_length_mean)), 6) AS packet_length_mean,
  round(avg(coalesce(idle_mean, m_idle_mean)), 6) AS idle_mean,
  round(avg(coalesce(active_std, m_active_std)), 6) AS active_std, count(service) AS service
FROM flow, med GROUP BY 1""")
def median_fill(spark, sf_dir):
    columns = ["packet_length_mean", "idle_mean", "active_std"]
    flow = stored(flow_view(spark, sf_dir).select("attack_category", "service", *columns))
    filled = Q.fill_missing(flow, columns, ["service"])
    return filled.groupBy("attack_category").agg(
        *[F.round(F.avg(c), 6).alias(c) for c in ("packet_length_mean", "idle_mean", "active_std")],
        F.count("service").alias("service"))


@query("recompute_derived", FLOW + """
SELECT attack_category, label,
  round(avg(CASE WHEN total_packets_fwd + total_packets_bwd > 0
    THEN (src_bytes + dst_bytes) / (total_packets_fwd + total_packets_bwd) ELSE bytes_per_packet_ratio END), 6)
    AS bytes_per_packet_ratio,
  round(avg(CASE WHEN duration > 0 THEN (src_bytes + dst_bytes) / duration ELSE flow_bytes_per_sec END), 6)
    AS flow_bytes_per_sec,
  round(avg(CASE WHEN duration > 0 THEN (total_packets_fwd + total_packets_bwd) / duration END), 6)
    AS flow_packets_per_sec,
  round(avg(CASE WHEN total_packets_fwd > 0 THEN total_packets_bwd / total_packets_fwd END), 6) AS down_up_ratio
FROM flow GROUP BY 1, 2""")
def recompute_derived(spark, sf_dir):
    flow = flow_view(spark, sf_dir)
    measures = derived_measures(flow.columns)
    return flow.withColumns(measures).groupBy("attack_category", F.col("label").cast("int").alias("label")).agg(
        *[F.round(F.avg(c), 6).alias(c) for c in measures])


@query("drop_empty_features", FLOW + ", c AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, count({c}) AS n FROM flow" for c in STRING_FEATURES + NUMERIC_FEATURES
) + ") SELECT feature, n AS rows FROM c WHERE n > 0")
def drop_empty_features(spark, sf_dir):
    flow = flow_view(spark, sf_dir)
    numeric, categorical = Q.feature_classes(flow)
    empty = Q.empty_features(flow, numeric + categorical)
    kept = [c for c in numeric + categorical if c not in empty]
    counts = flow.agg(*[F.count(c).alias(c) for c in kept])
    return counts.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(c).alias("rows")) for c in kept])))


def _perturbed(spark, sf_dir):
    """The flow view beside one where half of the rows are moved by one byte, so they equal no real row."""
    flow = stored(flow_view(spark, sf_dir))
    odd = F.col("syn_flag_count") % 2 == 1
    moved = flow.withColumns({
        "dst_bytes": F.when(odd, F.col("dst_bytes") + 0.005).otherwise(F.col("dst_bytes")),
        "source_file": F.lit("generated"),
    })
    return moved, flow


PERTURBED = FLOW + """
, moved AS (SELECT * REPLACE (CASE WHEN syn_flag_count % 2 = 1 THEN dst_bytes + 0.005 ELSE dst_bytes END AS dst_bytes,
    'generated' AS source_file) FROM flow),
marked AS (SELECT m.*, EXISTS (SELECT 1 FROM flow f WHERE f.src_bytes = m.src_bytes AND f.dst_bytes = m.dst_bytes
    AND f.src_port = m.src_port AND f.dst_port = m.dst_port AND f.syn_flag_count = m.syn_flag_count
    AND f.duration = m.duration AND f.protocol = m.protocol AND f.label = m.label) AS known FROM moved m)"""


@query("exact_matches", PERTURBED + """
SELECT attack_category, count(*) AS rows FROM marked WHERE known GROUP BY 1""")
def exact_matches(spark, sf_dir):
    return Q.exact_matches(*_perturbed(spark, sf_dir)).groupBy(
        "attack_category").agg(F.count("*").alias("rows"))


@query("novel_rows", PERTURBED + """
SELECT attack_category, count(*) AS rows FROM marked WHERE NOT known GROUP BY 1""")
def novel_rows(spark, sf_dir):
    return Q.novel_rows(*_perturbed(spark, sf_dir)).groupBy(
        "attack_category").agg(F.count("*").alias("rows"))


@query("exact_match_count", PERTURBED + """
SELECT count(*) AS exact_real_row_matches FROM marked WHERE known""")
def exact_match_count(spark, sf_dir):
    return Q.exact_match_count(*_perturbed(spark, sf_dir))


@query("generation_quality", PERTURBED + """
SELECT true AS schema_match, CAST(""" + " + ".join(
    f"(count(*) - count({c}))" for c in FLOW_COLUMNS) + """ AS BIGINT) AS missing_cells, count(*) AS rows,
  count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM moved)) AS duplicate_rows,
  count(*) FILTER (known) AS exact_real_row_matches,
  CAST(""" + " + ".join(f"count(*) FILTER ({c} < 0)" for c in NON_NEGATIVE) + """ AS BIGINT) AS non_negative_violations,
  CAST(count(*) FILTER (src_port < 0 OR src_port > 65535) + count(*) FILTER (dst_port < 0 OR dst_port > 65535) AS BIGINT)
    AS port_range_violations
FROM marked""")
def generation_quality(spark, sf_dir):
    return Q.generation_quality(*_perturbed(spark, sf_dir))
