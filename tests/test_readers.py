"""Datasets of many files: layouts found in one job, scans by layout, caps by file."""

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from flowmill.operators.normalize import SourceConfig
from flowmill.sources import readers, sinks


@pytest.fixture
def many(tmp_path):
    """60 files: two CSV headers and a Parquet schema under one pattern, one header under another."""
    (tmp_path / "d" / "plain").mkdir(parents=True)
    want = []
    for i in range(60):
        rows = [(f"{i}.{k}", "Bot" if k % 2 else "benign") for k in range(1 + i % 4)]
        if i % 3 == 0:
            name, text = f"m{i:02}.csv", "\n\r\nDur,Label\r\n" + "".join(f"{d},{w}\n" for d, w in rows)
        elif i % 3 == 1:
            name, text = f"m{i:02}.csv", "Label,Flow Duration\n" + "".join(f"{w},{d}\n" for d, w in rows)
        else:
            name, text = f"m{i:02}.parquet", None
            pq.write_table(pa.table({"duration": [float(d) for d, _ in rows], "label": [w for _, w in rows]}),
                           tmp_path / "d" / name)
        if text:
            (tmp_path / "d" / name).write_text(text, newline="")
        want += [(f"d/{name}", float(d), int(w == "Bot")) for d, w in rows]
    for i in range(5):
        (tmp_path / "d" / "plain" / f"p{i}.csv").write_text("Dur,Label\n9.5,benign\n")
        want.append((f"d/plain/p{i}.csv", 9.5, 0))
    return tmp_path, want


def _config(*patterns):
    return SourceConfig("d", local_dir="d", file_patterns=list(patterns), label_column="label", attack_column="label")


def _rows(df):
    return sorted((r.source_file, r.duration, r.label) for r in df.collect())


def test_one_scan_per_layout(spark, many):
    root, want = many
    cfg = _config("m*", "plain/*.csv")
    files = readers.matching_files(spark, cfg, str(root))
    assert files.count() == 65
    scans = readers.read_source(spark, files, cfg)
    assert len(scans) == 3
    assert _rows(readers.read_dataset(spark, cfg, str(root))) == sorted(want)


def test_a_pattern_of_one_layout_is_scanned_as_it_is(spark, many, monkeypatch):
    root, want = many
    scanned, scan = [], readers._scan
    monkeypatch.setattr(readers, "_scan", lambda s, layout, paths, at: scanned.append(list(paths)) or scan(s, layout, paths, at))
    got = _rows(readers.read_dataset(spark, _config("plain/*.csv"), str(root)))
    assert got == sorted(w for w in want if "plain" in w[0]) and scanned == [[f"{root}/d/plain/*.csv"]]
    # A file under two patterns is read once.
    assert _rows(readers.read_dataset(spark, _config("plain/*.csv", "plain/p1*"), str(root))) == got


def test_missing_patterns(spark, many):
    root, _ = many
    assert readers.read_dataset(spark, _config("gone*"), str(root)) is None
    assert readers.read_dataset(spark, _config("gone*", "plain/*"), str(root)).count() == 5


@pytest.mark.parametrize("cap", [7, 65, 130, 10_000])
def test_cap_by_file_in_name_order(spark, many, cap):
    root, want = many
    files = {}
    for name, duration, label in want:
        files.setdefault(name, []).append((name, duration, label))
    share, expected = -(-cap // len(files)), []
    for name in sorted(files):
        expected += files[name][:min(share, cap - len(expected))]
    assert _rows(readers.read_dataset(spark, _config("m*", "plain/*.csv"), str(root), max_rows=cap)) == sorted(expected)


def test_no_cap_and_cap_zero_read_everything(spark, many):
    root, want = many
    assert readers.read_dataset(spark, _config("plain/*"), str(root), max_rows=0).count() == 5


def test_first_rows_of_a_split_file(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "long.csv").write_text("Dur,Label\n" + "".join(f"{i},benign\n" for i in range(20_000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        got = _rows(readers.read_dataset(spark, _config("*.csv"), str(tmp_path), max_rows=3000))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [d for _, d, _ in got] == [float(i) for i in range(3000)]


def test_write_table_runs_once_and_keeps_the_old_table(spark, tmp_path):
    runs = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            runs.add(batch.num_rows)
            yield batch

    path = str(tmp_path / "t")
    df = spark.range(100).mapInArrow(count, "id long")
    assert sinks.write_table(df, path) and runs.value == 100
    assert not sinks.write_table(spark.range(0), path) and not sinks.write_table(df.filter("id < 0"), path)
    assert spark.read.parquet(path).count() == 100
    assert sinks.write_table(spark.range(3), path) and spark.read.parquet(path).count() == 3
    assert [p.name for p in tmp_path.iterdir() if not p.name.startswith(".")] == ["t"]
