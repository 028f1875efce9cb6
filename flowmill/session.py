"""Session settings, shared scratch space and lineage cuts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


# Settings the operators are designed for.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # The JVM does not compile methods beyond 8,000 bytes of code, so a fused stage over the
    # 47-column table would run interpreted; such stages are generated per operator instead.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    # Call-site capture costs more than the column calls it annotates.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
    # Shuffle files go when the execution that wrote them ends, not when the driver happens to collect garbage: a query
    # of several jobs holds those of one at a time.
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
}


def tune(spark: SparkSession) -> SparkSession:
    """Apply SETTINGS to a running session where it has none of its own."""
    for key, value in SETTINGS.items():
        if spark.conf.isModifiable(key) and spark.sparkContext.getConf().get(key) is None:
            spark.conf.set(key, value)
    return spark


def build_session(app: str = "flowmill", master: str | None = None, **conf) -> SparkSession:
    """A session in UTC with SETTINGS; keyword settings win."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = SETTINGS | {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    } | conf
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see.  The cluster names it in spark.checkpoint.dir;
    only a session without one (local tests) gets a folder of its own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(named)
        return named
    current = spark.sparkContext.getCheckpointDir()
    if current is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="flowmill-"))
        current = spark.sparkContext.getCheckpointDir()
    return current


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/flowmill/{name}-{uuid.uuid4().hex}"


def delete_path(spark: SparkSession, path: str) -> None:
    """Remove a scratch table that is no longer read."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def move_path(spark: SparkSession, source: str, target: str) -> None:
    """Rename a written table; its target must not exist."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    files = path(source).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.rename(path(source), path(target)):
        raise OSError(f"could not move {source} to {target}")


# Set on frames made by `stored`: the path that holds their rows.
_STORED = "_flowmill_path"


def stored(df: DataFrame) -> DataFrame:
    """The rows computed once and written as Parquet to the shared folder: for tables read several times, since
    every later pass reads only the columns it uses, without the joins behind them."""
    if any("void" in kind or "interval" in kind for _, kind in df.dtypes):
        return cut_lineage(df)  # types that Parquet does not hold
    path = scratch_path(df.sparkSession, "rows")
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    setattr(out, _STORED, path)
    return out


def is_stored(df: DataFrame) -> bool:
    """Whether the frame is what `stored` returned, with no step after it."""
    return hasattr(df, _STORED)


def release(df: DataFrame) -> None:
    """Delete the rows of a stored frame that nothing reads any more; others are left alone."""
    if is_stored(df):
        delete_path(df.sparkSession, getattr(df, _STORED))


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: the rows survive lost executors and are computed once."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)
