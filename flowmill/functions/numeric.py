"""Numeric parsing and derived flow measures."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, functions as F

from flowmill.schema import NULL_TOKENS

# Spellings accepted as numbers.  A plain cast would also take the suffixes d and f.
NUMBER_PATTERN = r"(?i)^\s*[+-]?(\d+\.?\d*(e[+-]?\d+)?|\.\d+(e[+-]?\d+)?|inf|infinity)\s*$"


def null_token(c: Column) -> Column:
    """Cells that a CSV reader takes as missing become null."""
    return F.when(~c.isin(NULL_TOKENS), c)


def text_to_number(c: Column) -> Column:
    """Double, or null where the text is not a number.  Infinities are kept."""
    return F.when(c.rlike(NUMBER_PATTERN), c.try_cast("double"))


def to_number(c: Column, data_type: str) -> Column:
    """Double for any source column type, unparsable and NaN as null."""
    if data_type == "string":
        return text_to_number(c)
    return F.nanvl(c.cast("double"), F.lit(None).cast("double"))


def finite(c: Column) -> Column:
    """NaN and both infinities become null."""
    return F.when(~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))), c)


def ratio(top: Column, bottom: Column) -> Column:
    """top / bottom where bottom is positive, else null."""
    return F.when(bottom > 0, F.try_divide(top, bottom))


def _total(*columns: str) -> Column:
    return sum((F.coalesce(F.col(c), F.lit(0.0)) for c in columns[1:]),
               F.coalesce(F.col(columns[0]), F.lit(0.0)))


def bytes_total() -> Column:
    return _total("src_bytes", "dst_bytes")


def packets_total() -> Column:
    return _total("total_packets_fwd", "total_packets_bwd")


def derived_measures(available: Iterable[str]) -> dict[str, Column]:
    """New values of the derived columns; a measure whose divisor is not positive keeps
    its old value."""
    have = set(available)
    needs = {
        "bytes_per_packet_ratio": (
            {"total_packets_fwd", "total_packets_bwd", "src_bytes", "dst_bytes"},
            lambda: ratio(bytes_total(), packets_total()),
        ),
        "flow_bytes_per_sec": (
            {"src_bytes", "dst_bytes", "duration", "flow_bytes_per_sec"},
            lambda: ratio(bytes_total(), F.col("duration")),
        ),
        "flow_packets_per_sec": (
            {"total_packets_fwd", "total_packets_bwd", "duration", "flow_packets_per_sec"},
            lambda: ratio(packets_total(), F.col("duration")),
        ),
        "down_up_ratio": (
            {"total_packets_fwd", "total_packets_bwd", "down_up_ratio"},
            lambda: ratio(F.coalesce("total_packets_bwd", F.lit(0.0)), F.col("total_packets_fwd")),
        ),
    }
    out = {}
    for name, (inputs, value) in needs.items():
        if inputs <= have:
            old = F.col(name) if name in have else F.lit(None).cast("double")
            out[name] = finite(F.coalesce(value(), old))
    return out
