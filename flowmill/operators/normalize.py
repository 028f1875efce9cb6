"""Raw source tables onto the unified flow schema: one lazy projection per source."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from flowmill.functions.labels import any_flag, family_of, label_of
from flowmill.functions.numeric import (
    bytes_total, finite, null_token, packets_total, ratio, to_number,
)
from flowmill.functions.text import clean_label, clean_name
from flowmill.schema import ALIASES, FLOW_COLUMNS, FLOW_SCHEMA, NUMERIC_FEATURES, STRING_FEATURES


@dataclass(frozen=True)
class SourceConfig:
    """How one dataset is laid out."""

    key: str
    name: str | None = None
    environment: str = "Unknown"
    local_dir: str = ""
    file_patterns: Sequence[str] = ()
    format: str | None = None
    label_column: str | Sequence[str] | None = None
    attack_column: str | Sequence[str] | None = None
    # Further label columns; when given, a row is an attack if any of them is non-zero
    # and every attack belongs to one family.
    auxiliary_label_columns: Sequence[str] = ()
    # Protocol texts to replace, e.g. {"0": "MQTT"}.
    protocol_names: dict = field(default_factory=dict)
    tier: int = 4
    size_gb: float = 0.0


def resolve(columns: Sequence[str], candidates: str | Sequence[str] | None) -> str | None:
    """The column carrying the first candidate that matches, exactly or after cleaning."""
    if not candidates:
        return None
    if isinstance(candidates, str):
        candidates = [candidates]
    cleaned = {clean_name(c): c for c in columns}
    for name in candidates:
        hit = name if name in columns else cleaned.get(clean_name(name))
        if hit is not None:
            return hit
    return None


class _Raw:
    """Typed access to a raw table's columns, by candidate names."""

    def __init__(self, df: DataFrame):
        self.types = dict(df.dtypes)

    def find(self, candidates) -> str | None:
        return resolve(list(self.types), candidates)

    def _cell(self, name: str) -> Column:
        quoted = F.col("`" + name.replace("`", "``") + "`")
        return null_token(quoted) if self.types[name] == "string" else quoted

    def text(self, name: str) -> Column:
        return self._cell(name).cast("string")

    def number(self, name: str) -> Column:
        # No spelling of a missing cell reads as a number.
        return to_number(F.col("`" + name.replace("`", "``") + "`"), self.types[name])


def normalize(df: DataFrame, cfg: SourceConfig, source_file: Column | None = None) -> DataFrame:
    """Project a raw table (batch or stream) onto FLOW_SCHEMA.

    source_file defaults to the path each row was read from.
    """
    raw = _Raw(df)
    label_col, attack_col = raw.find(cfg.label_column), raw.find(cfg.attack_column)

    # Texts are cleaned once, in a projection of their own: every rule below reads them.
    label_text = raw.text(label_col or attack_col) if (label_col or attack_col) else F.lit(None).cast("string")
    label_number = raw.number(label_col or attack_col) if (label_col or attack_col) else F.lit(None).cast("double")
    if cfg.auxiliary_label_columns:
        found = [raw.find(c) for c in (cfg.label_column, *cfg.auxiliary_label_columns)]
        label = any_flag([raw.number(c) for c in found if c])
    else:
        label = label_of(F.col("_word"), F.col("_number"))
    named = attack_col or label_col
    attack_text = raw.text(named) if named else F.lit("Attack")

    def string_feature(name: str) -> Column:
        col = raw.find(ALIASES[name])
        value = F.coalesce(raw.text(col), F.lit("")) if col else F.lit("")
        if name == "protocol":
            for old, new in cfg.protocol_names.items():
                value = F.when(value == old, F.lit(new)).otherwise(value)
        return value

    def numeric_feature(name: str) -> Column:
        col = raw.find(ALIASES[name])
        return raw.number(col) if col else F.lit(None).cast("double")

    if source_file is None:
        source_file = F.col("_metadata.file_path")
    first = df.select(
        F.lit(cfg.name or cfg.key).alias("dataset_source"),
        source_file.alias("source_file"),
        F.lit(cfg.environment).alias("environment_type"),
        F.lower(clean_label(label_text)).alias("_word"),
        label_number.alias("_number"),
        (label if cfg.auxiliary_label_columns else F.lit(None).cast("int")).alias("label"),
        clean_label(attack_text).alias("_attack"),
        *[string_feature(c).alias(c) for c in STRING_FEATURES],
        *[numeric_feature(c).alias(c) for c in NUMERIC_FEATURES],
    )
    if not cfg.auxiliary_label_columns:
        first = first.withColumn("label", label)
    second = first.withColumn(
        "attack_subcategory", F.when(F.col("label") == 0, "Normal").otherwise(F.col("_attack"))
    ).withColumn("_word", F.lower("attack_subcategory"))
    if cfg.auxiliary_label_columns:
        family = F.when(F.col("label") == 0, "Normal").otherwise("Anomaly")
    else:
        family = family_of(F.col("attack_subcategory"), F.col("_word"), F.col("label"))
    measured = F.coalesce(F.col("bytes_per_packet_ratio"), ratio(bytes_total(), packets_total()))
    # The ratio sees infinite operands as they were read; they are dropped afterwards.
    out = second.withColumns({"attack_category": family, "bytes_per_packet_ratio": measured}).withColumns(
        {c: finite(F.col(c)) for c in NUMERIC_FEATURES if raw.find(ALIASES[c]) or c == "bytes_per_packet_ratio"})
    return to_flow_schema(out)


def to_flow_schema(df: DataFrame) -> DataFrame:
    """Ordered projection and types of the unified table."""
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in FLOW_SCHEMA])


def recast_canonical(df: DataFrame) -> DataFrame:
    """Fill the text columns and the label of a unified table before splitting."""
    types = dict(df.dtypes)
    label = F.coalesce(to_number(F.col("label"), types["label"]), F.lit(0.0)).cast("tinyint")
    filled = {c: F.coalesce(F.col(c).cast("string"), F.lit("Unknown"))
              for c in ("attack_category", "attack_subcategory")}
    filled |= {c: F.coalesce(F.col(c).cast("string"), F.lit("")) for c in STRING_FEATURES}
    return df.withColumns({"label": label, **filled})


def union_sources(parts: Sequence[DataFrame]) -> DataFrame:
    """Bag union of normalised sources."""
    if not parts:
        raise ValueError("no source to unite")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.select(*FLOW_COLUMNS)

