"""Files as rows: manifests, integrity, and the text-file gate."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

MAX_UPLOAD_BYTES = 25 * 1024 * 1024
# Files up to this size are held whole by the task that hashes them, larger ones go by in pieces.
WHOLE_BYTES = 32 * 1024 * 1024
PIECE_BYTES = 16 * 1024
# Names that line readers decompress, and the mark that they skip at the start of a file.
COMPRESSED = r"(?i)\.(gz|bz2|lz4|snappy|deflate|zst)$"
BYTE_ORDER_MARK = b"\xef\xbb\xbf"

# Leading bytes of archive, executable and image files, in hex.
BINARY_SIGNATURES = ["504B", "1F8B", "4D5A", "89504E47", "FFD8FF"]


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+)/?$", 1)


def manifest(files: DataFrame, suffixes: list[str], newest: int | None = None,
             summaries: DataFrame | None = None) -> DataFrame:
    """(name, size_bytes, modified_at, ...), newest first.

    `summaries` (stem, rows, mode) is attached to the Parquet files of the same stem.
    """
    name = file_name(F.col("path"))
    out = files.select(
        name.alias("name"), F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified_at"),
        F.regexp_replace(name, r"\.[^.]*$", "").alias("stem"),
        F.lower(F.regexp_extract(name, r"(\.[^.]*)$", 1)).alias("suffix"),
    ).filter(F.col("suffix").isin(suffixes))
    if summaries is not None:
        facts = summaries.select(F.col("stem").alias("_stem"), "rows", "mode")
        out = out.join(facts, (F.col("stem") == F.col("_stem")) & (F.col("suffix") == ".parquet"), "left").drop("_stem")
    out = out.orderBy(F.desc("modified_at"), "name").drop("stem", "suffix")
    return out.limit(newest) if newest else out


def required_files(spark: SparkSession, files: DataFrame, wanted: list[tuple[str, bool]]) -> DataFrame:
    """(name, required, ok, status, size_bytes) of a checklist of (name, required)."""
    asked = spark.createDataFrame(wanted, "name string, required boolean")
    held = files.select(file_name(F.col("path")).alias("name"), F.col("length").alias("size_bytes"))
    status = F.when(F.col("ok"), "pass").when(F.col("required"), "missing").otherwise("optional")
    return asked.join(held, "name", "left").withColumn("ok", F.col("size_bytes").isNotNull()).select(
        "name", "required", "ok", status.alias("status"), "size_bytes")


def digests(spark: SparkSession, pattern: str, whole_bytes: int = WHOLE_BYTES) -> DataFrame:
    """(path, sha256) of whole files.

    Files of up to `whole_bytes` are hashed by the task that reads them. The bytes of larger ones are read in
    parallel as lines, dealt by file and hashed in order, so that no task holds a file; a digest is made of one
    byte after the other, so one task sees all pieces of a file. Compressed files have no lines to read and are
    always hashed whole.
    """
    files = spark.read.format("binaryFile").load(pattern)
    whole = files.filter(F.col("length") <= whole_bytes)
    large = files.filter(F.col("length") > whole_bytes).select(
        "path", "length", F.col("path").rlike(COMPRESSED).alias("packed")).distinct().collect()
    packed = [row["path"] for row in large if row["packed"]]
    if packed:
        # Named one by one: the reader turns files away by length, not by name, and opens all others.
        whole = whole.unionByName(spark.read.format("binaryFile").load(packed))
    out = whole.select("path", F.sha2("content", 256).alias("sha256"))
    pieces = None
    for row in large:
        if row["packed"]:
            continue
        lines = spark.read.option("lineSep", "\n").text(row["path"]).select(
            F.lit(row["path"]).alias("path"), F.lit(row["length"]).alias("length"),
            F.col("_metadata.file_block_start").alias("block"),
            F.concat("value", F.lit("\n")).cast("binary").alias("data"))
        pieces = lines if pieces is None else pieces.unionByName(lines)
    if pieces is None:
        return out
    dealt = pieces.mapInArrow(_pieces, PIECE_SCHEMA).repartition("path").sortWithinPartitions(
        "path", F.col("data").isNotNull(), "block", "number")
    return out.unionByName(dealt.mapInArrow(_hash_pieces, "path string, sha256 string"))


# `number` counts the pieces of a block; the line without data holds the block's bytes in `size`.
PIECE_SCHEMA = "path string, length long, block long, number long, size long, data binary"


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines joined and cut into pieces, then the size of each block of a file."""
    schema = pa.schema([("path", pa.string()), ("length", pa.int64()), ("block", pa.int64()), ("number", pa.int64()),
                        ("size", pa.int64()), ("data", pa.binary())])
    counts: dict[tuple, list[int]] = {}
    for batch in batches:
        blocks = batch.column("block").to_numpy()
        paths = batch.column("path").dictionary_encode().indices.to_numpy()
        edges = np.flatnonzero((np.diff(blocks) != 0) | (np.diff(paths) != 0)) + 1
        for a, b in zip([0, *edges], [*edges, len(blocks)]):
            if a == b:
                continue
            # Values lie one after the other in the column's buffer.
            part = batch.column("data").slice(a, b - a)
            part = pa.concat_arrays([part])
            ends = np.frombuffer(part.buffers()[1], np.int32, len(part) + 1, part.offset * 4)
            data = memoryview(part.buffers()[2])[int(ends[0]):int(ends[-1])]
            cuts = [bytes(data[i:i + PIECE_BYTES]) for i in range(0, len(data), PIECE_BYTES)]
            key = (batch.column("path")[a].as_py(), batch.column("length")[a].as_py(), int(blocks[a]))
            count = counts.setdefault(key, [0, 0])
            n = len(cuts)
            yield pa.RecordBatch.from_arrays(
                [pa.array([key[0]] * n, pa.string()), pa.array([key[1]] * n, pa.int64()), pa.array([key[2]] * n, pa.int64()),
                 pa.array(range(count[0], count[0] + n), pa.int64()), pa.nulls(n, pa.int64()), pa.array(cuts, pa.binary())],
                schema=schema)
            count[0], count[1] = count[0] + n, count[1] + len(data)
    rows = [{"path": p, "length": w, "block": k, "number": -1, "size": size} for (p, w, k), (_, size) in counts.items()]
    yield pa.RecordBatch.from_pylist(rows, schema=schema)


def _hash_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of files whose pieces come in order, after the sizes of their blocks."""
    names = ["path", "sha256"]
    now, length, total, sha, last = None, 0, 0, None, b""

    def done():
        nonlocal sha
        sha = hashlib.sha256() if sha is None else sha
        # Every line got a line feed; the last of a file may have none.
        extra = total - length + (len(BYTE_ORDER_MARK) if total < length else 0)
        if extra not in (0, 1):
            raise ValueError(f"{now}: {total} bytes in lines, {length} in the file")
        sha.update(last if not extra else last[:-1])
        return pa.RecordBatch.from_arrays([pa.array([now]), pa.array([sha.hexdigest()])], names=names)

    for batch in batches:
        for path, size, whole, data in zip(batch.column("path").to_pylist(), batch.column("size").to_pylist(),
                                           batch.column("length").to_pylist(), batch.column("data")):
            if path != now:
                if now is not None:
                    yield done()
                now, length, total, sha, last = path, whole, 0, None, b""
            if size is not None:
                total += size
                continue
            if sha is None:
                sha = hashlib.sha256(BYTE_ORDER_MARK if total < length else b"")
            sha.update(last)
            last = data.as_py()
    if now is not None:
        yield done()


def verify_digests(actual: DataFrame, expected: DataFrame) -> DataFrame:
    """(name, status): pass, fail, or skipped where no digest is expected; `expected` is (name, sha256)."""
    want = expected.select("name", F.lower(F.trim("sha256")).alias("_want"))
    got = actual.select(file_name(F.col("path")).alias("name"), "sha256")
    none = F.col("_want").isNull() | (F.col("_want") == "")
    return got.join(want, "name", "left").select(
        "name", F.when(none, "skipped").when(F.col("_want") == F.col("sha256"), "pass").otherwise("fail").alias("status"))


def looks_binary(content: Column) -> Column:
    """A known binary signature, or more than 10 % control bytes in the first 512."""
    head = F.hex(F.substring(content, 1, 512))
    signed = F.lit(False)
    for signature in BINARY_SIGNATURES:
        signed = signed | head.startswith(signature)
    spaced = F.regexp_replace(head, "(..)", " $1")
    control = F.regexp_count(spaced, F.lit(" (0[0-8]|0[EF]|1[0-9A-F]|7F)"))
    return signed | (control / F.greatest(F.length(head) / 2, F.lit(1)) > 0.10)


def text_gate(spark: SparkSession, pattern: str) -> DataFrame:
    """(path, length, accepted, reason) for uploaded files: CSV name, size, text, rows.

    Only files with a CSV name and a size that may pass are opened.
    """
    refused = (F.when(~F.lower("path").endswith(".csv"), "not a csv file")
               .when(F.col("length") > MAX_UPLOAD_BYTES, "too large"))
    # Contents are not among the columns here.
    listed = spark.read.format("binaryFile").load(pattern).select("path", "length", refused.alias("reason")).filter(
        F.col("reason").isNotNull())
    # The reader itself turns names and lengths away.
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.[cC][sS][vV]").load(pattern).filter(
        F.col("length") <= MAX_UPLOAD_BYTES)
    lines = F.regexp_count(F.col("content").cast("string"), F.lit(r"(?m)^.*\S.*$"))
    reason = F.when(looks_binary(F.col("content")), "binary content").when(lines < 2, "no rows")
    opened = files.select("path", "length", reason.alias("reason"))
    return listed.unionByName(opened).select("path", "length", F.col("reason").isNull().alias("accepted"), "reason")
