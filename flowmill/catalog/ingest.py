"""Raw sources onto the unified schema, files as rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowmill.catalog import query
from flowmill.functions.labels import attack_family, is_attack, subcategory
from flowmill.functions.numeric import null_token, text_to_number
from flowmill.operators import quality as Q
from flowmill.operators.normalize import SourceConfig, normalize, recast_canonical
from flowmill.schema import (
    BRUTE_FORCE_NAMES, FAMILY_BY_NAME, FAMILY_RULES, FLOOD_PROTOCOLS, NORMAL_WORDS, NULL_TOKENS,
)
from flowmill.plans.small import settle
from flowmill.session import scratch_path
from flowmill.sources import files as files_
from flowmill.sources import readers
from flowmill.views import RAW_LABELS, RAW_NUMBERS, _pick, flow_sql, flow_view, raw_source, table

# ------------------------------------------------------------ SQL pieces


def _words(values):
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def _pick_sql(values, index):
    return f"([{_words(values)}])[({index}) % {len(values)} + 1]"


def _null_sql(c):
    return f"CASE WHEN {c} NOT IN ({_words(NULL_TOKENS)}) THEN {c} END"


def _number_sql(c):
    return (f"CASE WHEN regexp_matches({c}, '(?i)^\\s*[+-]?(\\d+\\.?\\d*(e[+-]?\\d+)?|\\.\\d+(e[+-]?\\d+)?|inf|infinity)\\s*$')"
            f" THEN TRY_CAST(trim({c}) AS DOUBLE) END")


def _clean_sql(c):
    return (f"regexp_replace(regexp_replace(regexp_replace(coalesce({c}, ''), '^\\s+|\\s+$', '', 'g'),"
            f" '^\\.+|\\.+$', '', 'g'), '\\s+', '_', 'g')")


def _label_sql(c, number):
    return (f"CASE WHEN {number} IS NOT NULL THEN CASE WHEN {number} <> 0 THEN 1 ELSE 0 END"
            f" WHEN lower({_clean_sql(c)}) <> '' AND lower({_clean_sql(c)}) NOT IN ({_words(NORMAL_WORDS)}) THEN 1 ELSE 0 END")


def _family_sql(name, label):
    word = f"lower({name})"
    whens = [f"WHEN {label} = 0 OR {word} IN ({_words(NORMAL_WORDS)}) THEN 'Normal'"]
    whens += [f"WHEN {word} = '{a}' THEN '{f}'" for a, f in FAMILY_BY_NAME.items()]
    whens.append(f"WHEN {word} IN ({_words(FLOOD_PROTOCOLS)}) THEN 'DDoS'")
    for parts, family in FAMILY_RULES:
        test = " OR ".join(f"contains({word}, '{p}')" for p in parts)
        if family == "BruteForce":
            test += f" OR {word} IN ({_words(BRUTE_FORCE_NAMES)})"
        whens.append(f"WHEN {test} THEN '{family}'")
    return "CASE " + " ".join(whens) + f" WHEN {name} <> '' THEN {name} ELSE 'Attack' END"


RAW = f"""raw AS (SELECT
  CASE WHEN l_linenumber > 2 THEN CAST(l_suppkey AS VARCHAR) ELSE {_pick_sql(RAW_NUMBERS, 'l_suppkey + l_linenumber')} END AS duration_t,
  CAST(l_orderkey AS VARCHAR) AS src_port_t, CAST(l_suppkey AS VARCHAR) AS dst_port_t,
  CASE WHEN l_linenumber = 1 THEN '0' WHEN l_linenumber = 2 THEN 'NA' ELSE l_returnflag END AS proto_t,
  CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) AS src_bytes_t, CAST(l_partkey % 97 AS VARCHAR) AS dst_bytes_t,
  CAST(l_linenumber - 1 AS VARCHAR) AS fwd_t, {_pick_sql(RAW_NUMBERS, 'l_linenumber')} AS bwd_t,
  {_pick_sql(RAW_LABELS, 'l_partkey')} AS label_t, {_pick_sql(RAW_LABELS, 'l_partkey + l_linenumber')} AS attack_t,
  CAST(l_linenumber % 2 AS VARCHAR) AS sus_t FROM lineitem)"""

_N = lambda c: _number_sql("(" + _null_sql(c) + ")")
_FIN = lambda c: f"CASE WHEN isfinite({c}) THEN {c} END"


def _normalized_sql(label, category, attack):
    """`norm` over raw: typed numbers, label, category."""
    return f"""typed AS (SELECT *, {_null_sql('label_t')} AS label_n, {_null_sql('attack_t')} AS attack_n,
  {_N('duration_t')} AS d0, {_N('src_port_t')} AS sp0, {_N('dst_port_t')} AS dp0, {_N('src_bytes_t')} AS sb0,
  {_N('dst_bytes_t')} AS db0, {_N('fwd_t')} AS f0, {_N('bwd_t')} AS b0, coalesce({_null_sql('proto_t')}, '') AS protocol0 FROM raw),
lab AS (SELECT *, {label} AS label FROM typed),
sub AS (SELECT *, CASE WHEN label = 0 THEN 'Normal' ELSE {attack} END AS attack_subcategory FROM lab),
norm AS (SELECT label, attack_subcategory, {category} AS attack_category,
  CASE WHEN protocol0 = '0' THEN 'MQTT' ELSE protocol0 END AS protocol,
  {_FIN('d0')} AS duration, {_FIN('sp0')} AS src_port, {_FIN('dp0')} AS dst_port, {_FIN('sb0')} AS src_bytes,
  {_FIN('db0')} AS dst_bytes, {_FIN('f0')} AS total_packets_fwd, {_FIN('b0')} AS total_packets_bwd,
  CASE WHEN coalesce(f0, 0) + coalesce(b0, 0) > 0 AND isfinite((coalesce(sb0, 0) + coalesce(db0, 0)) / (coalesce(f0, 0) + coalesce(b0, 0)))
    THEN (coalesce(sb0, 0) + coalesce(db0, 0)) / (coalesce(f0, 0) + coalesce(b0, 0)) END AS bytes_per_packet_ratio FROM sub)"""


NORM = "WITH " + RAW + ", " + _normalized_sql(
    _label_sql("label_n", _number_sql("label_n")), _family_sql(_clean_sql("attack_subcategory"), "label"),
    _clean_sql("attack_n"))
SUMMARY = """
SELECT attack_category, attack_subcategory, label, protocol, count(*) AS rows, count(duration) AS durations,
  round(sum(duration), 4) AS duration, round(sum(src_port), 4) AS src_port, round(sum(dst_port), 4) AS dst_port,
  round(sum(src_bytes), 4) AS src_bytes, round(sum(dst_bytes), 4) AS dst_bytes,
  round(sum(total_packets_fwd), 4) AS total_packets_fwd, round(sum(total_packets_bwd), 4) AS total_packets_bwd,
  round(sum(bytes_per_packet_ratio), 4) AS bytes_per_packet_ratio FROM norm GROUP BY 1, 2, 3, 4"""

CONFIG = SourceConfig("raw", "Raw", "Lab", label_column="label", attack_column="attack",
                      protocol_names={"0": "MQTT"})
NUMBERS = ["duration", "src_port", "dst_port", "src_bytes", "dst_bytes", "total_packets_fwd",
           "total_packets_bwd", "bytes_per_packet_ratio"]


def _summary(norm):
    return norm.groupBy("attack_category", "attack_subcategory", F.col("label").cast("int").alias("label"),
                        "protocol").agg(
        F.count("*").alias("rows"), F.count("duration").alias("durations"),
        *[F.round(F.sum(c), 4).alias(c) for c in NUMBERS])


# ------------------------------------------------------------ queries

@query("normalize_labels", "WITH " + RAW + f""", typed AS (SELECT *, {_null_sql('label_t')} AS label_n FROM raw),
lab AS (SELECT label_t, label_n, {_label_sql('label_n', _number_sql('label_n'))} AS label FROM typed)
SELECT label_t AS raw, label, CASE WHEN label = 0 THEN 'Normal' ELSE {_clean_sql('label_n')} END AS attack_subcategory,
  count(*) AS rows FROM lab GROUP BY 1, 2, 3""")
def normalize_labels(spark, sf_dir):
    raw = raw_source(spark, sf_dir).select(F.col("Label").alias("raw"))
    cell = null_token(F.col("raw"))
    label = is_attack(cell, text_to_number(cell))
    return raw.select("raw", label.alias("label"), subcategory(cell, label).alias("attack_subcategory")).groupBy(
        "raw", "label", "attack_subcategory").agg(F.count("*").alias("rows"))


@query("attack_family", "WITH " + RAW + f""", names AS (SELECT attack_t, CAST(sus_t AS INTEGER) AS label FROM raw)
SELECT attack_t AS raw, label, {_family_sql(_clean_sql('attack_t'), 'label')} AS family, count(*) AS rows
FROM names GROUP BY 1, 2, 3""")
def family(spark, sf_dir):
    raw = raw_source(spark, sf_dir).select(
        F.col("Attack").alias("raw"), F.col("sus").cast("int").alias("label"))
    return raw.withColumn("family", attack_family(F.col("raw"), F.col("label"))).groupBy(
        "raw", "label", "family").agg(F.count("*").alias("rows"))


@query("normalize_source", NORM + SUMMARY)
def normalize_source(spark, sf_dir):
    return _summary(normalize(raw_source(spark, sf_dir), CONFIG, F.lit("raw")))


@query("normalize_any_label", "WITH " + RAW + ", " + _normalized_sql(
    f"CASE WHEN coalesce({_number_sql('label_n')}, 0) <> 0 OR sus_t = '1' THEN 1 ELSE 0 END",
    "CASE WHEN label = 0 THEN 'Normal' ELSE 'Anomaly' END", _clean_sql("attack_n")) + SUMMARY)
def normalize_any_label(spark, sf_dir):
    cfg = SourceConfig("host", label_column="label", attack_column="attack", auxiliary_label_columns=["sus"],
                       protocol_names={"0": "MQTT"})
    return _summary(normalize(raw_source(spark, sf_dir), cfg, F.lit("raw")))


@query("normalize_csv", NORM + SUMMARY)
def normalize_csv(spark, sf_dir):
    """The raw table written as CSV, read back as text and normalised."""
    path = scratch_path(spark, "raw-csv")
    raw_source(spark, sf_dir).write.option("header", True).option("nullValue", "NA").csv(path)
    return _summary(normalize(readers.read_headered_csv(spark, path), CONFIG))


@query("normalize_lineage", """
SELECT 'Raw' AS dataset_source, 'Lab' AS environment_type, 'flag=' || l_returnflag AS folder, count(*) AS rows,
  CAST(sum(l_linenumber - 1) AS DOUBLE) AS packets
FROM lineitem GROUP BY l_returnflag""")
def normalize_lineage(spark, sf_dir):
    """Which source, environment and file every row of a folder of CSV files comes from."""
    path = scratch_path(spark, "lineage-csv")
    raw = raw_source(spark, sf_dir)
    raw.withColumn("flag", F.col("unrelated")).write.partitionBy("flag").option("header", True).option("nullValue", "NA").csv(path)
    rows = normalize(readers.read_headered_csv(spark, path), CONFIG, readers.relative_file(path))
    return rows.groupBy("dataset_source", "environment_type", F.substring_index("source_file", "/", 1).alias("folder")).agg(
        F.count("*").alias("rows"), F.sum("total_packets_fwd").alias("packets"))


@query("ingest_layouts", """
SELECT CASE WHEN l_linenumber = 1 THEN 'Normal' ELSE 'Botnet' END AS attack_category, l_returnflag AS folder,
  count(*) AS rows, sum(CAST(l_quantity AS DOUBLE)) AS seconds
FROM lineitem GROUP BY 1, 2""")
def ingest_layouts(spark, sf_dir):
    """A dataset of many files in three layouts under common patterns: two CSV headers and Parquet."""
    root = scratch_path(spark, "layouts")
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    word = F.when(F.col("l_linenumber") == 1, "benign").otherwise("Bot")
    number = F.col("l_quantity").cast("double")
    for flag, kind, names in (("A", "csv", {"Dur": number, "Label": word}), ("N", "csv", {"Label": word, "Flow Duration": number}),
                              ("R", "parquet", {"duration": number, "label": word})):
        part = lines.filter(F.col("l_returnflag") == flag).select(*[c.alias(n) for n, c in names.items()])
        part.write.format(kind).option("header", True).save(f"{root}/raw/{flag}")
    cfg = SourceConfig("raw", local_dir="raw", file_patterns=["*/*.csv", "*/*.parquet"], label_column="label",
                       attack_column="label")
    rows = readers.read_dataset(spark, cfg, root)
    return rows.groupBy("attack_category", F.split("source_file", "/")[1].alias("folder")).agg(
        F.count("*").alias("rows"), F.sum("duration").alias("seconds"))


@query("normalize_kdd", f"""
WITH raw AS (SELECT CAST(l_quantity AS INTEGER) AS d, l_returnflag AS p, l_partkey % 97 AS sb, l_suppkey AS db,
  {_pick_sql(RAW_LABELS, 'l_partkey')} AS a0 FROM lineitem),
n AS (SELECT *, {_null_sql('a0')} AS a FROM raw),
l AS (SELECT *, {_label_sql('a', _number_sql('a'))} AS label FROM n),
s AS (SELECT *, CASE WHEN label = 0 THEN 'Normal' ELSE {_clean_sql('a')} END AS sub FROM l)
SELECT {_family_sql(_clean_sql('sub'), 'label')} AS attack_category, label, p AS protocol, count(*) AS rows,
  CAST(sum(d) AS DOUBLE) AS duration, CAST(sum(sb) AS DOUBLE) AS src_bytes, CAST(sum(db) AS DOUBLE) AS dst_bytes
FROM s GROUP BY 1, 2, 3""")
def normalize_kdd(spark, sf_dir):
    """Connection records without a header, written and read back under the fixed names."""
    line = table(spark, sf_dir, "lineitem")
    own = {"duration": F.col("l_quantity").cast("int").cast("string"), "protocol_type": F.col("l_returnflag"),
           "src_bytes": (F.col("l_partkey") % 97).cast("string"), "dst_bytes": F.col("l_suppkey").cast("string"),
           "attack": _pick(RAW_LABELS, F.col("l_partkey"))}
    path = scratch_path(spark, "kdd")
    line.select(*[own.get(c, F.lit("0")).alias(c) for c in readers.HEADERLESS["kdd"]]).write.csv(path)
    cfg = SourceConfig("kdd", format="kdd", label_column="attack", attack_column="attack")
    norm = normalize(readers.read_kdd(spark, path), cfg)
    return norm.groupBy("attack_category", F.col("label").cast("int").alias("label"), "protocol").agg(
        F.count("*").alias("rows"), *[F.sum(c).alias(c) for c in ("duration", "src_bytes", "dst_bytes")])


@query("recast_canonical", "WITH " + flow_sql() + """
SELECT attack_category, CASE WHEN environment_type = '5-LOW' THEN 'Unknown' ELSE attack_subcategory END AS attack_subcategory,
  CASE WHEN service = 'P' THEN '' ELSE service END AS service, CASE WHEN protocol = 'A' THEN 0 ELSE label END AS label, count(*) AS rows
FROM flow GROUP BY 1, 2, 3, 4""")
def recast(spark, sf_dir):
    flow = flow_view(spark, sf_dir).withColumns({
        "attack_subcategory": F.when(F.col("environment_type") != "5-LOW", F.col("attack_subcategory")),
        "service": F.when(F.col("service") != "P", F.col("service")),
        "label": F.when(F.col("protocol") == "A", "n/a").otherwise(F.col("label").cast("string"))})
    return recast_canonical(flow).groupBy(
        "attack_category", "attack_subcategory", "service", F.col("label").cast("int").alias("label")
    ).agg(F.count("*").alias("rows"))


@query("numeric_parse_issues", "WITH " + RAW + f""", c AS (
SELECT 'duration' AS "column", {_null_sql('duration_t')} AS v FROM raw
UNION ALL SELECT 'src_bytes', {_null_sql('src_bytes_t')} FROM raw
UNION ALL SELECT 'total_packets_bwd', {_null_sql('bwd_t')} FROM raw
UNION ALL SELECT 'label', {_null_sql('label_t')} FROM raw)
SELECT "column", count(*) AS invalid_values FROM c WHERE trim(v) <> '' AND ({_number_sql('v')}) IS NULL GROUP BY 1""")
def numeric_parse_issues(spark, sf_dir):
    raw = raw_source(spark, sf_dir).select(
        F.col("Flow Duration").alias("duration"), F.col("TotLen Fwd Pkts").alias("src_bytes"),
        F.col("Tot Bwd Pkts").alias("total_packets_bwd"), F.col("Label").alias("label"))
    return Q.parse_issues(raw, raw.columns)


@query("validation_summary", "WITH " + RAW + f""", c AS (SELECT {_null_sql('duration_t')} AS v FROM raw
  UNION ALL SELECT {_null_sql('bwd_t')} FROM raw),
i AS (SELECT count(*) AS n FROM c WHERE trim(v) <> '' AND ({_number_sql('v')}) IS NULL)
SELECT (SELECT count(*) FROM raw) AS rows, 4 AS columns, CAST(0.75 AS DOUBLE) AS feature_coverage, 3 AS features_present, 2 AS numeric_present,
  1 AS categorical_present, 1 AS missing_feature_count, 1 AS ignored_column_count, n AS parse_issues,
  CASE WHEN n = 0 THEN 'ready' ELSE 'review' END AS readiness,
  '1 model features are missing; 1 extra columns are ignored; ' || n || ' numeric cells do not parse' AS recommendations FROM i""")
def validation_summary(spark, sf_dir):
    raw = raw_source(spark, sf_dir).select(
        F.col("Flow Duration").alias("duration"), F.col("Tot Bwd Pkts").alias("total_packets_bwd"),
        F.col(" Proto ").alias("protocol"), "unrelated")
    return Q.validation_summary(raw, ["duration", "total_packets_bwd", "src_bytes"], ["protocol"])


@query("feature_alignment", "WITH " + RAW + f"""
SELECT coalesce(proto_t, '') AS protocol, '' AS service, count(*) AS rows, count(CASE WHEN isfinite(d) THEN 1 END) AS durations,
  CAST(0 AS BIGINT) AS src_bytes FROM (SELECT *, {_number_sql('duration_t')} AS d FROM raw) GROUP BY 1""")
def feature_alignment(spark, sf_dir):
    raw = raw_source(spark, sf_dir).select(
        F.col("Flow Duration").alias("duration"), F.col(" Proto ").alias("protocol"), "unrelated")
    aligned = Q.align_features(raw, ["duration", "src_bytes"], ["protocol", "service"])
    finite = F.abs("duration") != float("inf")
    return aligned.groupBy("protocol", "service").agg(
        F.count("*").alias("rows"), F.count_if(finite).alias("durations"), F.count("src_bytes").alias("src_bytes"))


@query("column_alignment", """
SELECT n_name, n_regionkey, CAST(NULL AS DOUBLE) AS duration FROM nation""")
def column_alignment(spark, sf_dir):
    return Q.align_to_columns(table(spark, sf_dir, "nation"), ["n_name", "n_regionkey", "duration"])


@query("artifact_manifest")
def artifact_manifest(spark, sf_dir):
    """Names and sizes of the data files themselves, newest first, with row counts attached."""
    files = readers.file_table(spark, f"{sf_dir}/*")
    rows = table(spark, sf_dir, "lineitem").agg(F.count("*").alias("rows")).select(
        F.lit("lineitem").alias("stem"), "rows", F.lit("given").alias("mode"))
    return files_.manifest(files, [".parquet"], 20, rows).select("name", "size_bytes", "rows", "mode")


@query("file_digests")
def file_digests(spark, sf_dir):
    # One line per file, hashed once for both sides.
    actual = settle(files_.digests(spark, f"{sf_dir}/*.parquet"))
    expected = actual.select(files_.file_name(F.col("path")).alias("name"),
                             F.when(F.col("path").contains("line"), "0").otherwise(F.col("sha256")).alias("sha256"))
    return files_.verify_digests(actual, expected.filter("name <> 'region.parquet'"))


@query("text_gate")
def text_gate(spark, sf_dir):
    """Parquet files are turned away, the same rows as CSV are let in."""
    path = scratch_path(spark, "gate")
    table(spark, sf_dir, "supplier").write.option("header", True).csv(path)
    checked = files_.text_gate(spark, f"{path}/*.csv").unionByName(files_.text_gate(spark, f"{sf_dir}/*.parquet"))
    return checked.groupBy("accepted", "reason").agg(F.count("*").alias("files"))
