"""Size-checked local results and broadcasts."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from flowmill.session import cut_lineage

MAX_BROADCAST_ROWS = 100_000
MAX_BROADCAST_BYTES = 32 * 1024 * 1024

# Set on frames made by `settle` that hold their rows as a local relation.
_LOCAL = "_flowmill_local_rows"


def settle(df: DataFrame, max_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """Compute an aggregated table once: a local relation when it is small, else a
    reliable checkpoint.  Later plans start from the result, not from its inputs."""
    if hasattr(df, _LOCAL):
        return df
    rows = df.limit(max_rows + 1).toArrow()
    if rows.num_rows > max_rows or rows.nbytes > MAX_BROADCAST_BYTES:
        return cut_lineage(df)
    local = df.sparkSession.createDataFrame(rows, df.schema)
    setattr(local, _LOCAL, rows)
    return local


def column_max(settled: DataFrame, column: str):
    """Largest value of a column of a settled table, None when it is empty."""
    rows = getattr(settled, _LOCAL, None)
    if rows is None:
        return settled.agg(F.max(column)).first()[0]
    return max(rows.column(column).to_pylist(), default=None)


def broadcast_checked(df: DataFrame, max_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """Broadcast an aggregated table after proving it small.

    Within the bound the rows become a local relation, so the aggregation behind them is
    not run again by the query that joins it.  Beyond the bound the table is checkpointed
    and returned unhinted: the join shuffles, with adaptive skew handling.
    """
    settled = settle(df, max_rows)
    return F.broadcast(settled) if hasattr(settled, _LOCAL) else settled
