"""Files as rows at sizes that no task may hold."""

import hashlib
import os
import random

from flowmill.sources import files


def _folder(tmp_path):
    noise = random.Random(3).randbytes(300_000)
    texts = {
        "plain.bin": noise, "ended.bin": noise + b"\n", "marked.bin": b"\xef\xbb\xbf" + noise,
        "marked_ended.bin": b"\xef\xbb\xbf" + noise + b"\n", "returns.txt": b"a\r\nb\rc\n\n\n" * 9_000 + b"\r",
        "breaks.txt": b"\n" * 70_000, "one_line.txt": b"x" * 100_000, "small.txt": b"a\nb"}
    for name, data in texts.items():
        (tmp_path / name).write_bytes(data)
    return {name: hashlib.sha256(data).hexdigest() for name, data in texts.items()}


def test_large_files_are_hashed_in_pieces(spark, tmp_path):
    want = _folder(tmp_path)
    held = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        for whole_bytes in (1_000, 50_000, files.WHOLE_BYTES):
            rows = files.digests(spark, f"{tmp_path}/*", whole_bytes).collect()
            assert {os.path.basename(r["path"]): r["sha256"] for r in rows} == want
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", held)


def test_refused_files_are_not_opened(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x\n1\n")
    (tmp_path / "B.CSV").write_text("x\n\n \n")
    for name in ("c.parquet", "d.csv"):
        with open(tmp_path / name, "wb") as f:
            f.truncate(3 << 30 if name == "c.parquet" else files.MAX_UPLOAD_BYTES + 1)  # more than a cell can hold
    (tmp_path / "e.csv").write_bytes(b"PK\x03\x04\n\n")
    got = {os.path.basename(r["path"]): (r["accepted"], r["reason"])
           for r in files.text_gate(spark, f"{tmp_path}/*").collect()}
    assert got == {"a.csv": (True, None), "B.CSV": (False, "no rows"), "c.parquet": (False, "not a csv file"),
                   "d.csv": (False, "too large"), "e.csv": (False, "binary content")}
