"""Allocation, bootstrap draws, jitter and full generation on the flow view."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowmill.catalog import query
from flowmill.catalog.quality import FILLED
from flowmill.operators import generate as G
from flowmill.operators import quality as Q
from flowmill.plans.small import broadcast_checked, settle
from flowmill.session import cut_lineage, stored
from flowmill.views import flow_sql, flow_view, normal_sql, uniform_sql

FLOW = "WITH " + flow_sql(extra=True)
ROWS = 20_000
COUNTS = FLOW + ", c AS (SELECT attack_category, count(*) AS n, max(label) AS label FROM flow GROUP BY 1)"


def _spread(source, total, weight):
    """Shares of total by weight, remainders to the largest fractions, names break ties."""
    return f"""SELECT attack_category, {weight} * {total} // s + CASE WHEN row_number() OVER (
    ORDER BY {weight} * {total} % s DESC, attack_category) <= {total} - CAST(sum({weight} * {total} // s) OVER () AS BIGINT)
    THEN 1 ELSE 0 END AS rows FROM (SELECT *, CAST(sum({weight}) OVER () AS BIGINT) AS s FROM {source})"""


@query("allocate_proportional", COUNTS + ", a AS (" + _spread("c", ROWS, "n") + """)
SELECT attack_category, CAST(rows AS BIGINT) AS rows FROM a""")
def allocate_proportional(spark, sf_dir):
    return G.allocation_table(spark, flow_view(spark, sf_dir), ROWS, "proportional", 25)


@query("allocate_balanced", COUNTS + ", o AS (SELECT *, 1 AS one FROM c), a AS (" + _spread("o", ROWS, "one") + """)
SELECT attack_category, CAST(rows AS BIGINT) AS rows FROM a""")
def allocate_balanced(spark, sf_dir):
    return G.allocation_table(spark, flow_view(spark, sf_dir), ROWS, "balanced", 25)


@query("allocate_label_balanced", COUNTS + """
, calm AS (SELECT * FROM c WHERE label = 0), hostile AS (SELECT *, 1 AS one FROM c WHERE label = 1),
a AS (""" + _spread("calm", ROWS // 2, "n") + "), b AS (" + _spread("hostile", ROWS - ROWS // 2, "one") + """)
SELECT attack_category, CAST(rows AS BIGINT) AS rows FROM a UNION ALL SELECT attack_category, CAST(rows AS BIGINT) FROM b""")
def allocate_label_balanced(spark, sf_dir):
    return G.allocation_table(spark, flow_view(spark, sf_dir), ROWS, "label_balanced", 25)


def _bootstrap(spark, sf_dir):
    """Draws of two text columns and jittered numbers, before derived columns."""
    flow = flow_view(spark, sf_dir, extra=True)
    real = stored(flow.select("attack_category", "label", "environment_type", "attack_subcategory", "service",
                       "src_bytes", "src_port", "total_packets_fwd",
                       F.md5(F.concat(F.lit("42|"), "row_key")).alias("_h")))
    facts = settle(G.category_facts(real))
    allocation = G._allocate_facts(facts, ROWS, "balanced", 25)
    numeric = ["src_bytes", "src_port", "total_packets_fwd"]
    rows = G.bootstrap_rows(G.synthetic_ids(spark, allocation), real, facts, 42, "_h", numeric)
    return real, facts, rows, numeric


# Ids run through the categories in name order.
DRAWS = COUNTS + ", o AS (SELECT *, 1 AS one FROM c), a AS (" + _spread("o", ROWS, "one") + """),
spans AS (SELECT attack_category, rows, CAST(sum(rows) OVER (ORDER BY attack_category) - rows AS BIGINT) AS start FROM a),
ids AS (SELECT attack_category, unnest(range(start, CAST(start + rows AS BIGINT))) AS id FROM spans),
real AS (SELECT *, row_number() OVER (PARTITION BY attack_category ORDER BY md5('42|' || row_key)) - 1 AS idx FROM flow),
drawn AS (SELECT i.id, i.attack_category, CAST(least(floor(""" + uniform_sql("'42|' || i.id || '|row'") + """ * c.n), c.n - 1) AS BIGINT) AS idx
  FROM ids i JOIN c ON i.attack_category = c.attack_category)"""


@query("bootstrap_rows", DRAWS + """
SELECT d.id, d.attack_category, d.idx, r.src_bytes, r.src_port, r.total_packets_fwd
FROM drawn d JOIN real r ON r.attack_category = d.attack_category AND r.idx = d.idx""")
def bootstrap_rows(spark, sf_dir):
    return _bootstrap(spark, sf_dir)[2]


def _value_sql(column):
    return f"""SELECT attack_category, {column} AS value, sum(count(*)) OVER w - count(*) AS lo, sum(count(*)) OVER w AS hi
  FROM flow GROUP BY 1, 2 WINDOW w AS (PARTITION BY attack_category ORDER BY {column})"""


@query("draw_values", DRAWS + ", vs AS (" + _value_sql("service") + "), vb AS (" + _value_sql("attack_subcategory") + """)
SELECT i.attack_category, vs.value AS service, vb.value AS attack_subcategory, count(*) AS rows
FROM ids i JOIN c ON i.attack_category = c.attack_category
JOIN vs ON vs.attack_category = i.attack_category AND floor(""" + uniform_sql("'42|' || i.id || '|service'") + """ * n) >= vs.lo
  AND floor(""" + uniform_sql("'42|' || i.id || '|service'") + """ * n) < vs.hi
JOIN vb ON vb.attack_category = i.attack_category AND floor(""" + uniform_sql("'42|' || i.id || '|attack_subcategory'") + """ * n) >= vb.lo
  AND floor(""" + uniform_sql("'42|' || i.id || '|attack_subcategory'") + """ * n) < vb.hi
GROUP BY 1, 2, 3""")
def draw_values(spark, sf_dir):
    real, facts, _, _ = _bootstrap(spark, sf_dir)
    rows = G.synthetic_ids(spark, G._allocate_facts(facts, ROWS, "balanced", 25))
    for column in ("service", "attack_subcategory"):
        rows = G.draw_value(rows, real, column, 42, F.lit(""))
    return rows.groupBy("attack_category", "service", "attack_subcategory").agg(F.count("*").alias("rows"))


def _jitter_sql(c, whole, port=False):
    noisy = (f"CASE WHEN std_{c} > 0 THEN r.{c} + " + normal_sql(f"'42|' || d.id || '|noise|{c}'")
             + f" * std_{c} * 0.08 ELSE r.{c} END")
    out = f"greatest(0.0, {noisy})"
    out = f"CASE WHEN hi_{c} > lo_{c} THEN least(greatest({out}, lo_{c}), hi_{c}) ELSE {out} END"
    if port:
        out = f"least(greatest({out}, 0.0), 65535.0)"
    return f"round_even({out}, 0)" if whole else out


@query("jitter", DRAWS + ", prof AS (SELECT attack_category, " + ", ".join(
    f"stddev_samp({c}) AS std_{c}, quantile_cont({c}, 0.005) AS lo_{c}, quantile_cont({c}, 0.995) AS hi_{c}"
    for c in ("src_bytes", "src_port", "total_packets_fwd")) + """ FROM flow GROUP BY 1)
SELECT d.id, round(""" + _jitter_sql("src_bytes", False) + ", 4) AS src_bytes, "
       + _jitter_sql("src_port", True, True) + " AS src_port, "
       + _jitter_sql("total_packets_fwd", True) + """ AS total_packets_fwd
FROM drawn d JOIN real r ON r.attack_category = d.attack_category AND r.idx = d.idx
JOIN prof p ON p.attack_category = d.attack_category""")
def jitter(spark, sf_dir):
    real, _, rows, numeric = _bootstrap(spark, sf_dir)
    profile = settle(G.wide_profile(real, numeric, 0.005))
    out = rows.join(broadcast_checked(profile), "attack_category").select(
        "id", *[G.jitter(c, 42, "noise", 0.08).alias(c) for c in numeric])
    return out.withColumn("src_bytes", F.round("src_bytes", 4))


GENERATED = ["attack_category", "label", "attack_subcategory", "environment_type", "dataset_source", "source_file",
             "protocol", "service", *FILLED, "flow_packets_per_sec", "down_up_ratio"]


def _text_sql(column, alias):
    """Join lines that draw a text column for id i of category c."""
    pick = f"floor({uniform_sql(f"'42|' || i.id || '|{column}'")} * c.n)"
    return (f"JOIN ({_value_sql(column)}) {alias} ON {alias}.attack_category = i.attack_category"
            f" AND {pick} >= {alias}.lo AND {pick} < {alias}.hi")


# The whole job, up to the second jitter of exact copies, of which there are none.
_NUMBERS = ("src_bytes", "duration", "packet_length_mean", "src_port", "total_packets_fwd")
GENERATE = FLOW + """
, med AS (SELECT median(packet_length_mean) AS m FROM flow),
full_ AS (SELECT flow.* REPLACE (coalesce(packet_length_mean, m) AS packet_length_mean) FROM flow, med),
c AS (SELECT attack_category, count(*) AS n, max(label) AS label FROM full_ GROUP BY 1),
calm AS (SELECT * FROM c WHERE label = 0), hostile AS (SELECT *, 1 AS one FROM c WHERE label = 1),
a AS (""" + _spread("calm", ROWS // 2, "n") + " UNION ALL " + _spread("hostile", ROWS - ROWS // 2, "one") + """),
spans AS (SELECT attack_category, rows, CAST(sum(rows) OVER (ORDER BY attack_category) - rows AS BIGINT) AS start FROM a),
ids AS (SELECT attack_category, unnest(range(start, CAST(start + rows AS BIGINT))) AS id FROM spans),
real AS (SELECT *, row_number() OVER (PARTITION BY attack_category ORDER BY md5('42|' || row_key)) - 1 AS idx FROM full_),
env AS (SELECT attack_category, environment_type FROM (SELECT attack_category, environment_type,
  row_number() OVER (PARTITION BY attack_category ORDER BY count(*) DESC, environment_type) AS rk FROM full_ GROUP BY 1, 2) WHERE rk = 1),
prof AS (SELECT attack_category, """ + ", ".join(
    f"stddev_samp({c}) AS std_{c}, quantile_cont({c}, 0.005) AS lo_{c}, quantile_cont({c}, 0.995) AS hi_{c}"
    for c in _NUMBERS) + """ FROM full_ GROUP BY 1),
d AS (SELECT i.id, i.attack_category, c.label, CAST(least(floor(""" + uniform_sql("'42|' || i.id || '|row'") + """ * c.n), c.n - 1) AS BIGINT) AS idx,
  vp.value AS protocol, vs.value AS service, CASE WHEN c.label = 0 THEN 'Normal' ELSE vb.value END AS attack_subcategory
  FROM ids i JOIN c ON i.attack_category = c.attack_category """ + " ".join(
    _text_sql(c, a) for c, a in (("protocol", "vp"), ("service", "vs"), ("attack_subcategory", "vb"))) + """)
SELECT d.attack_category, CAST(d.label AS INTEGER) AS label, d.attack_subcategory, d.protocol, d.service, e.environment_type, 'Synthetic' AS dataset_source,
  'generated:' || d.attack_category AS source_file, """ + ", ".join(
    [f"round({_jitter_sql(c, False)}, 3) AS {c}" for c in ("src_bytes", "duration", "packet_length_mean")]
    + [f"{_jitter_sql('src_port', True, True)} AS src_port", f"{_jitter_sql('total_packets_fwd', True)} AS total_packets_fwd"]) + """,
  true AS ratio_holds
FROM d JOIN real r ON r.attack_category = d.attack_category AND r.idx = d.idx
JOIN prof p ON p.attack_category = d.attack_category JOIN env e ON e.attack_category = d.attack_category"""


def _real(spark, sf_dir):
    return stored(flow_view(spark, sf_dir, extra=True).select(*GENERATED, "row_key"))


def _generated(real):
    return G.generate(real, G.GenerationRequest(rows=ROWS, mode="label_balanced"), key="row_key")


@query("generate_synthetic", GENERATE)
def generate_synthetic(spark, sf_dir):
    """The whole job; derived columns are compared with a recomputation from their row."""
    ratio = (F.col("src_bytes") + F.col("dst_bytes")) / (F.col("total_packets_fwd") + F.col("total_packets_bwd"))
    # Read once: generation stores the rows it draws from itself.
    out = _generated(flow_view(spark, sf_dir, extra=True).select(*GENERATED, "row_key"))
    return out.select(
        "attack_category", F.col("label").cast("int").alias("label"), "attack_subcategory", "protocol", "service",
        "environment_type", "dataset_source", "source_file",
        *[F.round(c, 3).alias(c) for c in ("src_bytes", "duration", "packet_length_mean")], "src_port",
        "total_packets_fwd", (F.abs(F.col("bytes_per_packet_ratio") - ratio) < 1e-6).alias("ratio_holds"))


@query("generation_summary")
def generation_summary(spark, sf_dir):
    real = _real(spark, sf_dir)
    synthetic = cut_lineage(_generated(real))
    return G.generation_summary(synthetic, real.select(*GENERATED), G.GenerationRequest(rows=ROWS, mode="label_balanced"))
