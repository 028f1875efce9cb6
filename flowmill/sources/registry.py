"""The dataset registry as a table."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import fields

from pyspark.sql import DataFrame, SparkSession, functions as F

from flowmill.operators.normalize import SourceConfig

DATA_SUFFIXES = ["csv", "parquet", "txt", "json", "gz", "pcap", "log"]

# Layout of the public datasets the pipeline knows.
ACTIVE_SOURCES = [
    SourceConfig("cic_ids2018", "CIC-IDS2018", "Enterprise", "data/raw/cic_ids2018", ["*.parquet"],
                 label_column="Label", attack_column="Label"),
    SourceConfig("ton_iot", "TON_IoT", "IoT", "data/raw/ton_iot", ["TON_IoT_Train_Test_Network.csv"],
                 label_column="label", attack_column="type"),
    SourceConfig("unsw_nb15", "UNSW-NB15", "Enterprise", "data/raw/unsw_nb15",
                 ["UNSW_NB15_training-set.csv", "UNSW_NB15_testing-set.csv"],
                 label_column="label", attack_column="attack_cat"),
    SourceConfig("kdd_cup_1999", "KDD Cup 1999", "Enterprise", "data/raw/kdd_cup_1999",
                 ["kddcup.data_10_percent_corrected"], "kdd", "attack", "attack"),
    SourceConfig("nsl_kdd", "NSL-KDD", "Enterprise", "data/raw/nsl_kdd", ["KDDTrain+.txt", "KDDTest+.txt"],
                 "nsl_kdd", "attack", "attack"),
    SourceConfig("bot_iot", "Bot-IoT", "IoT", "data/raw/bot_iot", ["CIC-BoT-IoT-V2.parquet"],
                 label_column="Label", attack_column="Attack"),
    SourceConfig("mqttset", "MQTTset", "IoT", "data/raw/mqttset",
                 ["mqttdataset_reduced.csv", "train70_reduced.csv", "test30_reduced.csv"],
                 label_column="target", attack_column="target", protocol_names={"0": "MQTT"}),
    SourceConfig("insdn", "InSDN", "SDN", "data/raw/insdn", ["InSDN_DatasetCSV/*.csv"],
                 label_column="Label", attack_column="Label"),
    SourceConfig("cic_ddos2019", "CIC-DDoS2019", "Enterprise", "data/raw/cic_ddos2019", ["*.parquet"],
                 label_column="Label", attack_column="Label"),
    SourceConfig("hikari_2021", "HIKARI-2021", "SDN", "data/raw/hikari_2021", ["ALLFLOWMETER_HIKARI2021.csv"],
                 label_column="Label", attack_column="traffic_category"),
    SourceConfig("beth", "BETH Dataset", "Host", "data/raw/beth",
                 ["labelled_training_data.csv", "labelled_validation_data.csv", "labelled_testing_data.csv"],
                 label_column="evil", attack_column="eventName", auxiliary_label_columns=["sus"]),
]


def load_registry(path: str) -> list[SourceConfig]:
    """Registry from a JSON or YAML file: {"datasets": {key: {...}}}."""
    with open(path, encoding="utf-8") as handle:
        if path.endswith(".json"):
            data = json.load(handle)
        else:
            try:
                import yaml
            except ImportError as e:
                raise ImportError("reading a YAML registry needs PyYAML; use JSON instead") from e
            data = yaml.safe_load(handle) or {}
    known = {f.name for f in fields(SourceConfig)}
    return [SourceConfig(key=key, **{k: v for k, v in entry.items() if k in known and k != "key"})
            for key, entry in data.get("datasets", {}).items()]


def registry_frame(spark: SparkSession, registry: Sequence[SourceConfig]) -> DataFrame:
    return spark.createDataFrame(
        [(c.key, c.name or c.key, c.environment, c.local_dir, int(c.tier), float(c.size_gb)) for c in registry],
        "key string, name string, environment string, local_dir string, tier int, size_gb double")


def select_datasets(registry: DataFrame, keys: Sequence[str] | None = None, tier: int | None = None,
                    skip_large: bool = False) -> DataFrame:
    """Registry lines by key list, else by tier, optionally without those over 2 GB."""
    if keys:
        registry = registry.filter(F.col("key").isin(list(keys)))
        if registry.isEmpty():
            raise ValueError(f"no dataset matches {', '.join(keys)}")
    elif tier is not None:
        registry = registry.filter(F.col("tier") == tier)
    return registry.filter("size_gb <= 2.0") if skip_large else registry


def registry_by_tier(registry: DataFrame) -> DataFrame:
    """(tier, datasets, size_gb)."""
    return registry.groupBy("tier").agg(F.count("*").alias("datasets"), F.sum("size_gb").alias("size_gb"))


def inventory(files: DataFrame, registry: DataFrame) -> DataFrame:
    """Per dataset the number and size of its data files; `files` is a recursive file_table."""
    data = files.filter(F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(DATA_SUFFIXES))
    # The registry is driver configuration: its folders become one expression over the path.
    owner = F.lit(None).cast("string")
    for line in registry.select("key", "local_dir").collect():
        owner = F.when(F.col("path").contains(f"/{line['local_dir'].strip('/')}/"), line["key"]).otherwise(owner)
    sizes = data.groupBy(owner.alias("key")).agg(
        F.count("*").alias("files"), (F.sum("length") / 1024**2).alias("megabytes"))
    return registry.select("key", "name", "tier").join(sizes, "key", "left").fillna(0, ["files", "megabytes"])
