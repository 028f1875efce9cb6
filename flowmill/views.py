"""Flow-shaped views over the driver's tables, in Spark and as the same SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from flowmill.functions.hashing import uniform
from flowmill.schema import FLOW_COLUMNS

# Raw label spellings, picked per row by l_partkey: one for every branch of the label rules.
RAW_LABELS = [
    "BENIGN", "normal.", " Normal ", "0", "1", "0.0", "2.5", "", "NA", "none",
    "Legitimate", "Background", "no", "False", "neptune.", "satan", "guess_passwd.", "rootkit",
    "LDAP", "UDP-lag", "Syn", "DrDoS_DNS", "DDoS attacks-LOIC-HTTP", "DoS  Hulk", "FTP-BruteForce",
    "bfa", "Bot", "mirai-udpflood", "gafgyt_combo", "PortScan", "Reconnaissance", "Infilteration",
    "Web Attack XSS", "SQL Injection", "ransomware", "backdoor", "mitm", "Malware.", "evil",
    "suspicious", "Fuzzers", "Theft data", "...", "nan",
]

# Raw number spellings, picked the same way.
RAW_NUMBERS = ["NA", "1.0d", " 12 ", "inf", "1e3", "abc", "-7.25", "nan", "5f", "None", "3"]


_SCHEMAS: dict[str, T.StructType] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    path = f"{sf_dir}/{name}.parquet"
    if path not in _SCHEMAS:
        _SCHEMAS[path] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[path]).parquet(path)


def _pick(values: list[str], c: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (c % len(values) + 1).cast("int"))


def _joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem")
    orders = table(spark, sf_dir, "orders")
    part = table(spark, sf_dir, "part")
    customer = table(spark, sf_dir, "customer")
    at_part, at_customer = line.l_partkey == part.p_partkey, orders.o_custkey == customer.c_custkey
    if _is_moved(orders):
        # Lines are the widest and move for every join, so customers meet the orders first.
        orders = orders.join(customer, at_customer)
        return line.join(orders, line.l_orderkey == orders.o_orderkey).join(part, at_part)
    return line.join(orders, line.l_orderkey == orders.o_orderkey).join(part, at_part).join(customer, at_customer)


def _is_moved(df: DataFrame) -> bool:
    """Whether joins shuffle the table, being too large to broadcast."""
    state = df.sparkSession._jsparkSession.sessionState()
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return int(str(size)) > state.conf().autoBroadcastJoinThreshold()


def flow_view(spark: SparkSession, sf_dir: str, extra: bool = False) -> DataFrame:
    """The unified flow table; extra adds row_key (text) and score (0 to 1, in 1/1000)."""
    j = _joined(spark, sf_dir)
    null = F.lit(None).cast("double")
    label = F.when(F.col("l_linestatus") == "F", 1).otherwise(0)
    attack = F.col("l_linestatus") == "F"
    size = F.col("l_extendedprice") + F.col("o_totalprice")
    packets = F.col("l_quantity") + F.col("p_size")
    duration = F.abs(F.datediff(F.col("l_shipdate"), F.col("o_orderdate"))).cast("double")
    values = {
        "dataset_source": F.col("c_mktsegment"),
        "source_file": F.concat(F.lit("lineitem:"), F.col("l_returnflag")),
        "environment_type": F.col("o_orderpriority"),
        "attack_category": F.when(attack, F.col("p_type")).otherwise("Normal"),
        "attack_subcategory": F.when(attack, F.col("p_brand")).otherwise("Normal"),
        "label": label.cast("tinyint"),
        "protocol": F.col("l_returnflag"),
        "service": F.col("o_orderstatus"),
        "duration": duration,
        "src_port": (F.col("l_partkey") % 65536).cast("double"),
        "dst_port": (F.col("l_suppkey") % 1024).cast("double"),
        "src_bytes": F.col("l_extendedprice"),
        "dst_bytes": F.col("o_totalprice"),
        "total_packets_fwd": F.col("l_quantity"),
        "total_packets_bwd": F.col("p_size").cast("double"),
        "packet_length_mean": F.when(F.col("l_linenumber") != 5, F.col("p_retailprice")),
        "flow_bytes_per_sec": F.when(duration > 0, size / duration),
        "syn_flag_count": F.col("l_linenumber").cast("double"),
        "idle_mean": F.when(F.col("o_orderstatus") != "P", F.col("c_acctbal")),
        "bytes_per_packet_ratio": F.when(packets > 0, size / packets),
    }
    out = j.select(
        *[values.get(c, null).alias(c) for c in FLOW_COLUMNS],
        *([_row_key().alias("row_key"), label.alias("_l")] if extra else []),
    )
    if extra:
        out = out.withColumn("score", _score()).drop("_l")
    return out


def _row_key() -> Column:
    return F.concat_ws("-", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")


def _score() -> Column:
    # A noisy score: attacks lean high, normal rows low, in steps of 1/1000.
    u = uniform("score", F.col("row_key"))
    return F.floor(u * 700 + F.col("_l") * 300) / F.lit(1000.0)


# ---------------------------------------------------------------- oracle SQL

def _sql_select(extra: bool) -> str:
    values = {
        "dataset_source": "c_mktsegment",
        "source_file": "'lineitem:' || l_returnflag",
        "environment_type": "o_orderpriority",
        "attack_category": "CASE WHEN l_linestatus = 'F' THEN p_type ELSE 'Normal' END",
        "attack_subcategory": "CASE WHEN l_linestatus = 'F' THEN p_brand ELSE 'Normal' END",
        "label": "CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END",
        "protocol": "l_returnflag",
        "service": "o_orderstatus",
        "duration": "dur",
        "src_port": "CAST(l_partkey % 65536 AS DOUBLE)",
        "dst_port": "CAST(l_suppkey % 1024 AS DOUBLE)",
        "src_bytes": "l_extendedprice",
        "dst_bytes": "o_totalprice",
        "total_packets_fwd": "l_quantity",
        "total_packets_bwd": "CAST(p_size AS DOUBLE)",
        "packet_length_mean": "CASE WHEN l_linenumber <> 5 THEN p_retailprice END",
        "flow_bytes_per_sec": "CASE WHEN dur > 0 THEN (l_extendedprice + o_totalprice) / dur END",
        "syn_flag_count": "CAST(l_linenumber AS DOUBLE)",
        "idle_mean": "CASE WHEN o_orderstatus <> 'P' THEN c_acctbal END",
        "bytes_per_packet_ratio":
            "CASE WHEN l_quantity + p_size > 0 THEN (l_extendedprice + o_totalprice) / (l_quantity + p_size) END",
    }
    cols = [f"{values.get(c, 'CAST(NULL AS DOUBLE)')} AS {c}" for c in FLOW_COLUMNS]
    if extra:
        cols += ["row_key", "floor(" + uniform_sql("'score|' || row_key")
                 + " * 700 + (CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END) * 300) / 1000.0 AS score"]
    return ", ".join(cols)


def uniform_sql(text: str, start: int = 1) -> str:
    """The oracle's form of functions.hashing.uniform over a '|'-joined text."""
    return f"(CAST(CAST('0x' || substr(md5({text}), {start}, 13) AS BIGINT) AS DOUBLE) / 4503599627370496.0)"


def normal_sql(text: str) -> str:
    return (f"(sqrt(-2.0 * ln(1.0 - {uniform_sql(text)}))"
            f" * cos(6.283185307179586 * {uniform_sql(text, 14)}))")


def flow_sql(extra: bool = False) -> str:
    """`flow` as a common table expression."""
    return f"""flow_join AS (
  SELECT *, CAST(abs(date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE))) AS DOUBLE) AS dur,
    l_orderkey || '-' || l_partkey || '-' || l_suppkey || '-' || l_linenumber AS row_key
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  JOIN part ON l_partkey = p_partkey JOIN customer ON o_custkey = c_custkey),
flow AS (SELECT {_sql_select(extra)} FROM flow_join)"""


def raw_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A raw-looking table: source-style names, text cells, odd labels and numbers."""
    line = table(spark, sf_dir, "lineitem")
    key = F.col("l_partkey")
    number = F.when(F.col("l_linenumber") > 2, F.col("l_suppkey").cast("string")).otherwise(
        _pick(RAW_NUMBERS, F.col("l_suppkey") + F.col("l_linenumber"))
    )
    return line.select(
        number.alias("Flow Duration"),
        F.col("l_orderkey").cast("string").alias("Src Port"),
        F.col("l_suppkey").cast("string").alias("dstport"),
        F.when(F.col("l_linenumber") == 1, "0").when(F.col("l_linenumber") == 2, "NA")
        .otherwise(F.col("l_returnflag")).alias(" Proto "),
        (F.col("l_quantity").cast("int")).cast("string").alias("TotLen Fwd Pkts"),
        (key % 97).cast("string").alias("dbytes"),
        (F.col("l_linenumber") - 1).cast("string").alias("Tot Fwd Pkts"),
        _pick(RAW_NUMBERS, F.col("l_linenumber")).alias("Tot Bwd Pkts"),
        _pick(RAW_LABELS, key).alias("Label"),
        _pick(RAW_LABELS, key + F.col("l_linenumber")).alias("Attack"),
        (F.col("l_linenumber") % 2).cast("string").alias("sus"),
        F.col("l_returnflag").alias("unrelated"),
    )
