"""Reproducible randomness from hashes: the same draw whatever the partitioning."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

ColumnLike = Column | str | int


def _text(part: ColumnLike) -> Column:
    return part.cast("string") if isinstance(part, Column) else F.lit(str(part))


def digest(*parts: ColumnLike) -> Column:
    """md5 of the parts joined by '|'.  Plain strings and numbers are literals."""
    return F.md5(F.concat_ws("|", *[_text(p) for p in parts]))


def _unit(hex_digits: Column) -> Column:
    return F.conv(hex_digits, 16, 10).cast("double") / F.lit(2.0**52)


def uniform(*parts: ColumnLike) -> Column:
    """A number in [0, 1) fixed by the parts."""
    return _unit(F.substring(digest(*parts), 1, 13))


def normal(*parts: ColumnLike) -> Column:
    """A standard normal fixed by the parts: Box-Muller on two slices of one digest."""
    d = digest(*parts)
    radius = F.sqrt(F.lit(-2.0) * F.log(F.lit(1.0) - _unit(F.substring(d, 1, 13))))
    return radius * F.cos(F.lit(2 * math.pi) * _unit(F.substring(d, 14, 13)))


def row_digest(columns: list[str], seed: int | str = 0) -> Column:
    """md5 over whole rows; missing values differ from empty text."""
    cells = [F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-")) for c in columns]
    return F.md5(F.concat_ws("\u0001", F.lit(str(seed)), *cells))
