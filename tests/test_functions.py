import math

import pytest
from pyspark.sql import functions as F

from flowmill.functions import hashing, labels, numeric, text
from flowmill.operators.normalize import SourceConfig, normalize, recast_canonical, resolve
from flowmill.schema import FLOW_COLUMNS, FLOW_SCHEMA, NUMERIC_FEATURES


def column(spark, values, expr, schema="c string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, {schema}")
    return [r[0] for r in df.orderBy("i").select(expr(F.col("c"))).collect()]


def test_shape():
    assert len(FLOW_COLUMNS) == 47 and len(NUMERIC_FEATURES) == 39


def test_clean_label(spark):
    got = column(spark, [" normal. ", "Web  Attack", None, "...", "a.b.", " x "], text.clean_label)
    assert got == ["normal", "Web_Attack", "", "", "a.b", "x"]


def test_names(spark):
    assert text.clean_name(" Flow Bytes/s ") == "flowbytess"
    assert column(spark, [" my file!! ", "___", "a" * 90], text.safe_stem) == ["my_file", "synthetic_dataset", "a" * 80]
    assert column(spark, ["Hello World!", None], text.slug) == ["hello_world", ""]
    got = column(spark, ["categorical__protocol_TCP", "numeric__duration", "numeric__src_bytes",
                         "categorical__service_a b"], text.attribution_name)
    # A numeric name with an underscore reads the same way; the tail decides.
    assert got == ["protocol = TCP", "duration", "src = bytes", "service_a b"]


def test_numbers(spark):
    cells = ["1", " 2.5 ", "1e3", ".5", "-7", "1.0d", "1f", "abc", "", "inf", "nan", None, "0x10", "5."]
    got = column(spark, cells, numeric.text_to_number)
    assert got == [1.0, 2.5, 1000.0, 0.5, -7.0, None, None, None, None, math.inf, None, None, None, 5.0]
    assert column(spark, [1.0, math.inf, -math.inf, math.nan, None], numeric.finite, "c double") == [1.0, None, None, None, None]
    assert column(spark, ["NA", "None", "none", "x", ""], numeric.null_token) == [None, None, "none", "x", None]


@pytest.mark.parametrize("raw,label,family", [
    ("neptune.", 1, "DoS"), ("ipsweep", 1, "Probe"), ("spy", 1, "R2L"), ("rootkit", 1, "U2R"), ("LDAP", 1, "DDoS"),
    ("DrDoS_NTP", 1, "DDoS"), ("DoS Hulk", 1, "DoS"), ("FTP-BruteForce", 1, "BruteForce"), ("BFA", 1, "BruteForce"),
    ("bfax", 1, "bfax"), ("Mirai-x", 1, "Botnet"), ("portscan", 1, "Reconnaissance"), ("Infilteration", 1, "Infiltration"),
    ("XSS", 1, "WebAttack"), ("ransomware", 1, "Ransomware"), ("Backdoor", 1, "Backdoor"), ("mitm", 1, "MITM"),
    ("suspicious", 1, "Anomaly"), ("Fuzzers", 1, "Fuzzers"), ("", 1, "Attack"), ("benign", 1, "Normal"), ("neptune", 0, "Normal"),
])
def test_family(spark, raw, label, family):
    assert column(spark, [raw], lambda c: labels.attack_family(c, F.lit(label))) == [family]


def test_binary_label(spark):
    got = column(spark, ["0", "1", "0.0", "2.5", "benign", "Normal.", "x", "", None, "False"],
                 lambda c: labels.is_attack(c, numeric.text_to_number(c)))
    assert got == [0, 1, 0, 1, 0, 0, 1, 0, 0, 0]


def test_risk_edges(spark):
    got = column(spark, [0.85, 0.8499, 0.65, 0.6499, 0.35, 0.3499], labels.risk_level, "c double")
    assert got == ["Critical", "High", "High", "Review", "Review", "Low"]
    assert column(spark, [0.5, 0.4999], lambda c: labels.verdict(labels.decide(c, 0.5)), "c double") == ["Attack", "Normal"]
    assert column(spark, [0.95, 0.80, 0.79, None], lambda c: labels.rate_band(c, F.lit(1)), "c double") == ["ok", "warn", "danger", None]
    assert column(spark, [0.02, 0.06, 0.07], lambda c: labels.rate_band(c, F.lit(0)), "c double") == ["ok", "warn", "danger"]


def test_resolve_prefers_exact_then_last_collision():
    assert resolve(["Flow Duration", "duration"], ["duration"]) == "duration"
    assert resolve(["src port", "Src-Port"], ["SRC PORT"]) == "Src-Port"
    assert resolve(["a"], None) is None and resolve(["a"], ["b"]) is None


def test_normalize_edges(spark):
    raw = spark.createDataFrame(
        [("1", "inf", "0", "4", "x"), ("0", "5", "NA", None, "y"), (None, "1.0d", "2", "0", "")],
        "label string, `Flow Duration` string, spkts string, sbytes string, type string")
    cfg = SourceConfig("k", label_column="label", attack_column="type")
    rows = normalize(raw, cfg, F.lit("f")).collect()
    assert normalize(raw, cfg, F.lit("f")).schema.fieldNames() == FLOW_SCHEMA.fieldNames()
    assert [(r.label, r.attack_subcategory, r.attack_category, r.duration) for r in rows] == [
        (1, "x", "x", None), (0, "Normal", "Normal", 5.0), (0, "Normal", "Normal", None)]
    assert [r.bytes_per_packet_ratio for r in rows] == [None, None, 0.0]
    assert rows[0].protocol == "" and rows[0].environment_type == "Unknown"


def test_normalize_is_idempotent_on_numbers(spark):
    raw = spark.createDataFrame([("1", 3.0, 2.0)], "label string, duration double, src_bytes double")
    once = normalize(raw, SourceConfig("k", label_column="label"), F.lit("f"))
    twice = normalize(once, SourceConfig("k", label_column="label"), F.lit("f"))
    assert once.select("duration", "src_bytes", "label").collect() == twice.select("duration", "src_bytes", "label").collect()


def test_without_label_columns(spark):
    raw = spark.createDataFrame([("a",)], "x string")
    row = normalize(raw, SourceConfig("k", label_column="missing"), F.lit("f")).first()
    assert (row.label, row.attack_category, row.attack_subcategory) == (0, "Normal", "Normal")


def test_recast(spark):
    df = spark.createDataFrame([(None, None, None, "x", None)],
                               "attack_category string, attack_subcategory string, protocol string, label string, service string")
    r = recast_canonical(df).first()
    assert (r.attack_category, r.attack_subcategory, r.protocol, r.service, r.label) == ("Unknown", "Unknown", "", "", 0)


def test_hash_draws(spark):
    df = spark.range(20000).select(hashing.uniform("s", F.col("id")).alias("u"), hashing.normal("s", F.col("id")).alias("z"))
    r = df.agg(F.avg("u"), F.min("u"), F.max("u"), F.avg("z"), F.stddev("z")).first()
    assert abs(r[0] - 0.5) < 0.01 and 0 <= r[1] and r[2] < 1 and abs(r[3]) < 0.03 and abs(r[4] - 1) < 0.03
