"""Raw file scans: text tables without type guessing, Parquet, and dispatch by suffix."""

from __future__ import annotations

import io
from collections import Counter
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from flowmill.operators.normalize import SourceConfig, normalize, union_sources
from flowmill.plans.small import broadcast_checked
from flowmill.schema import KDD_COLUMNS
from flowmill.session import cut_lineage

_RECORD = "_record"
# Added to capped rows: file, piece of the file, place in it, rows left to take from it.
_FILE, _PIECE, _PLACE, _LEFT = "_row_file", "_row_piece", "_row_place", "_row_left"

HEADERLESS = {
    "kdd": [*KDD_COLUMNS, "attack"],
    "nsl_kdd": [*KDD_COLUMNS, "attack", "difficulty"],
}


def _read_csv(spark: SparkSession, paths: Sequence[str], names: Sequence[str], header: bool,
              multi_line: bool) -> DataFrame:
    """All-text CSV.  Short lines are padded with nulls; lines with too many fields are dropped."""
    schema = T.StructType([T.StructField(n, T.StringType()) for n in [*names, _RECORD]])
    df = (
        spark.read.schema(schema).option("header", header).option("enforceSchema", True)
        .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", _RECORD)
        # A pruned scan would not see how long a line is.
        .option("columnPruning", False).option("encoding", "UTF-8").option("multiLine", multi_line).option("escape", '"')
        .csv(list(paths)))
    # The record text is kept only for lines of another length; separators outside quotes
    # tell the short ones, which end in a null, from the long ones.
    record = F.regexp_replace(F.col(_RECORD), '"[^"]*"', "")
    separators = F.length(record) - F.length(F.replace(record, F.lit(","), F.lit("")))
    short = F.col(f"`{names[-1]}`").isNull() & (separators < len(names))
    return df.filter(F.col(_RECORD).isNull() | short).drop(_RECORD)


def csv_header(spark: SparkSession, path: str) -> list[str]:
    """Column names of one file; repeated names get a numbered suffix."""
    names = spark.read.option("header", True).option("escape", '"').csv(path).columns
    return list(names)


def read_headered_csv(spark: SparkSession, paths: str | Sequence[str], multi_line: bool = False) -> DataFrame:
    """CSV files that share the header of the first one, every column as text.

    multi_line admits line breaks inside quotes; such files cannot be split.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    return _read_csv(spark, paths, csv_header(spark, paths[0]), True, multi_line)


def read_headerless_csv(spark: SparkSession, paths: str | Sequence[str], names: Sequence[str]) -> DataFrame:
    paths = [paths] if isinstance(paths, str) else list(paths)
    return _read_csv(spark, paths, names, False, False)


def read_kdd(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    return read_headerless_csv(spark, paths, HEADERLESS["kdd"])


def read_nsl_kdd(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    return read_headerless_csv(spark, paths, HEADERLESS["nsl_kdd"])


def read_parquet(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    return spark.read.parquet(*([paths] if isinstance(paths, str) else paths))


LAYOUT_SCHEMA = "path string, layout string"


def _layout(path: str) -> str:
    """What a file's columns are known by: the schema in a Parquet footer, else the first line with text."""
    from pyarrow import fs, parquet

    # Listed paths read file:/folder/name; s3a names an S3 bucket.
    place = path[5:] if path.startswith("file:/") else path.replace("s3a://", "s3://", 1)
    files, at = fs.FileSystem.from_uri(place)
    if path.lower().endswith(".parquet"):
        with files.open_input_file(at) as handle:
            return "parquet:" + str(parquet.read_schema(handle).remove_metadata())
    with files.open_input_stream(at) as handle:
        lines = (line.strip() for line in io.BufferedReader(handle))
        return "csv:" + next((line for line in lines if line), b"").decode("utf-8", "replace")


def file_layouts(files: DataFrame, cfg: SourceConfig) -> DataFrame:
    """(path, layout) of the files in a table of paths; files of equal layout can be one scan.

    One job: tasks open the files and read a footer or a first line.  Formats without header are known
    beforehand.
    """
    known = F.lit(cfg.format) if cfg.format in HEADERLESS else F.lit(None).cast("string")
    parquet = F.lower("path").endswith(".parquet")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths, layouts = (batch.column(c).to_pylist() for c in ("path", "layout"))
            found = [layout or _layout(path) for path, layout in zip(paths, layouts)]
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(found, pa.string())],
                                             names=["path", "layout"])

    # Dealt by path, so that many small files are many tasks.
    return files.select("path", F.when(~parquet, known).alias("layout")).repartition("path").mapInArrow(
        run, LAYOUT_SCHEMA)


def _scan(spark: SparkSession, layout: str, paths: Sequence[str], example: str) -> DataFrame:
    if layout in HEADERLESS:
        return read_headerless_csv(spark, paths, HEADERLESS[layout])
    if layout.startswith("parquet:"):
        return spark.read.schema(spark.read.parquet(example).schema).parquet(*paths)
    return _read_csv(spark, paths, csv_header(spark, example), True, False)


def read_source(spark: SparkSession, files: DataFrame, cfg: SourceConfig) -> list[DataFrame]:
    """The files of one dataset, one frame per layout.

    `files` (pattern, path) comes from `matching_files`.  Where a layout is all that its patterns match, the
    patterns are scanned; only mixed patterns need the paths of each layout by name.
    """
    layouts = cut_lineage(file_layouts(files.select("path").distinct(), cfg))
    # (pattern, layout) lines; a path under two patterns is listed once, under the first.
    owned = files.groupBy("path").agg(F.min("pattern").alias("pattern"), F.count("*").alias("patterns"))
    groups = layouts.join(owned, "path").groupBy("layout", "pattern").agg(
        F.min("path").alias("example"), F.max("patterns").alias("patterns")).collect()
    scans: dict[str, tuple[str, list[str]]] = {}
    shared = {g["pattern"] for g in groups if g["patterns"] > 1}
    for group in sorted(groups, key=lambda g: g["example"]):
        layout, pattern = group["layout"], group["pattern"]
        example, paths = scans.setdefault(layout, (group["example"], []))
        if not shared and sum(g["pattern"] == pattern for g in groups) == 1:
            paths.append(pattern)
        else:
            mine = layouts.filter(F.col("layout") == layout).join(owned.filter(F.col("pattern") == pattern), "path")
            paths += sorted(r["path"] for r in mine.select("path").collect())
    return [_scan(spark, layout, paths, example) for layout, (example, paths) in scans.items()]


def file_table(spark: SparkSession, pattern: str, recursive: bool = False) -> DataFrame:
    """(path, length, modificationTime) of matching files; contents are not read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", recursive)
    try:
        return reader.load(pattern).select("path", "length", "modificationTime")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], "path string, length long, modificationTime timestamp")


def matching_files(spark: SparkSession, cfg: SourceConfig, root: str = "") -> DataFrame:
    """(pattern, path) of the files matching a dataset's patterns; nothing is read of them."""
    base = cfg.local_dir if not root else f"{root.rstrip('/')}/{cfg.local_dir}"
    out = spark.createDataFrame([], "pattern string, path string")
    for pattern in dict.fromkeys(f"{base}/{p}" for p in cfg.file_patterns):
        out = out.unionByName(file_table(spark, pattern).select(F.lit(pattern).alias("pattern"), "path"))
    return out


def relative_file(root: str, path: Column | None = None) -> Column:
    """Path of the row's file below root."""
    path = F.col("_metadata.file_path") if path is None else path
    marker = root.rstrip("/") + "/"
    at = F.instr(path, marker)
    return F.when(at > 0, F.substr(path, at + len(marker))).otherwise(path)


def _first_of_files(df: DataFrame, rows: int) -> DataFrame:
    """The first `rows` rows of each file of a scan, with their file and place in it.

    Tasks let go of what lies beyond the first rows of their own piece of a file, so that the ranking sees at
    most that many rows of a piece.
    """
    placed = df.select("*", F.col("_metadata.file_path").alias(_FILE), F.col("_metadata.file_block_start").alias(_PIECE),
                       F.monotonically_increasing_id().alias(_PLACE))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            keep = []
            for piece in zip(batch.column(_FILE).to_pylist(), batch.column(_PIECE).to_pylist()):
                seen[piece] += 1
                keep.append(seen[piece] <= rows)
            yield batch.filter(pa.array(keep, pa.bool_()))

    order = Window.partitionBy(_FILE).orderBy(_PIECE, _PLACE)
    return placed.mapInArrow(run, placed.schema).withColumn(_PLACE, F.row_number().over(order)).filter(
        F.col(_PLACE) <= rows).drop(_PIECE)


def read_dataset(spark: SparkSession, cfg: SourceConfig, root: str = "",
                 max_rows: int | None = None) -> DataFrame | None:
    """A dataset on the unified schema, or None when no file matches.

    max_rows caps the dataset: each file gives at most an even share, in name order, until the cap is
    reached.  None and 0 read everything.
    """
    files = cut_lineage(matching_files(spark, cfg, root))
    if files.isEmpty():
        return None
    scans = read_source(spark, files, cfg)
    if not max_rows:
        name = relative_file(root) if root else None
        return union_sources([normalize(raw, cfg, name) for raw in scans])
    share = -(-max_rows // files.select("path").distinct().count())
    heads = [cut_lineage(_first_of_files(raw, share)) for raw in scans]
    counts = heads[0].select(_FILE)
    for head in heads[1:]:
        counts = counts.unionByName(head.select(_FILE))
    # One line per file.
    earlier = F.sum("n").over(Window.orderBy(_FILE)) - F.col("n")
    left = counts.groupBy(_FILE).agg(F.count("*").alias("n")).select(_FILE, (F.lit(max_rows) - earlier).alias(_LEFT))
    name = relative_file(root, F.col(_FILE)) if root else F.col(_FILE)
    return union_sources([
        normalize(head.join(broadcast_checked(left), _FILE).filter(F.col(_PLACE) <= F.col(_LEFT)), cfg, name)
        for head in heads])


def ingest(spark: SparkSession, registry: Sequence[SourceConfig], root: str = "",
           selected: Sequence[str] | None = None, max_rows: int | None = None) -> tuple[DataFrame | None, list[str]]:
    """All selected datasets united, and the keys of those without files."""
    by_key = {cfg.key: cfg for cfg in registry}
    unknown = sorted(set(selected or []) - set(by_key))
    if unknown:
        raise ValueError(f"unknown dataset key(s): {', '.join(unknown)}")
    parts, skipped = [], []
    for key, cfg in by_key.items():
        if selected and key not in selected:
            continue
        df = read_dataset(spark, cfg, root, max_rows)
        if df is None:
            skipped.append(key)
        else:
            parts.append(df)
    return (union_sources(parts) if parts else None), skipped
