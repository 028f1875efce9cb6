"""What a query leaves on disk while it runs: shuffles go with their job, large tables are held as columns and dealt in portions."""

import hashlib
import math
import os
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowmill import views
from flowmill.catalog import generate, models
from flowmill.operators import generate as G
from flowmill.operators import model as L
from flowmill.operators import quality as Q
from flowmill.operators import split as S
from flowmill.plans import neighbours
from flowmill.session import is_stored, release, stored, tune
from flowmill.sources import files


def _rows(df):
    return sorted(map(str, df.collect()))


def test_shuffle_files_go_with_the_job(spark):
    held = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffles = lambda: [n for n in held.getAllBlocks().mkString("\n").split("\n") if n.startswith("shuffle_")]
    before = set(shuffles())
    tune(spark).range(10_000).repartition(4, "id").groupBy((F.col("id") % 100).alias("k")).count().collect()
    for _ in range(50):
        left = set(shuffles()) - before
        if not left:
            break
        time.sleep(0.1)
    assert not left


def test_lines_move_once_less_where_orders_are_shuffled(spark, sf):
    joins = lambda: [line for line in views.flow_view(spark, sf)._jdf.queryExecution().optimizedPlan().toString().split("\n")
                     if "Join Inner" in line]
    small, rows = joins(), _rows(views.flow_view(spark, sf, extra=True))
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        # From the top: customers are met last by small tables, by orders first of all in large ones.
        assert "c_custkey" in small[0] and "c_custkey" in joins()[-1]
        assert _rows(views.flow_view(spark, sf, extra=True)) == rows
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def _copied(spark):
    return spark.createDataFrame(
        [(("a", None, "b")[i % 3], i % 2 if i % 7 else None, "n" + str(i % 4), (0.0, -0.0, float("nan"), None)[i % 4])
         for i in range(100)] * 2, "dataset_source string, label int, attack_category string, x double")


def test_quality_report_of_portions(spark, monkeypatch):
    df = _copied(spark)
    whole = _rows(Q.quality_report(df, Q.dedup(df)))
    monkeypatch.setattr(Q, "PORTION_ROWS", 30)
    parts = Q.dedup_portions(df)
    assert len(parts) == 7 and sum(p.count() for p in parts) == Q.dedup(df).count()
    assert _rows(Q.quality_report(df, parts)) == whole
    assert len(Q.dedup_portions(df.withColumn("l", F.array("x")))) == 1
    want = {("dataset_source", "Unknown"), ("label", "Unknown"), ("missing", "x"), ("rows", "after_dedup")}
    assert want <= {(r["section"], r["key"]) for r in Q.quality_report(df, parts).collect()}


def test_membership_in_portions(spark, monkeypatch):
    real = _copied(spark)
    made = real.limit(60).unionByName(real.limit(40).withColumn("label", F.lit(5)))
    hit, new = _rows(Q.exact_matches(made, real)), _rows(Q.novel_rows(made, real))
    monkeypatch.setattr(Q, "MAX_SHARED_FINGERPRINTS", 0)
    monkeypatch.setattr(Q, "PORTION_ROWS", 50)
    found = Q.exact_matches(made, real)
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert _rows(found) == hit and len(hit) == 60
    assert _rows(Q.novel_rows(made, real)) == new and len(new) == 40


@pytest.mark.parametrize("name", ["lines.bin", "lines.bin.gz"])
def test_files_larger_than_a_cell_are_not_opened_whole(spark, tmp_path, name):
    import gzip

    data = np.random.default_rng(1).bytes(200_000)
    packed = gzip.compress(data) if name.endswith("gz") else data
    (tmp_path / name).write_bytes(packed)
    (tmp_path / "other.bin").write_bytes(data)
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", len(packed) - 1 if name == "lines.bin" else len(packed))
    try:
        got = {os.path.basename(r["path"]): r["sha256"] for r in files.digests(spark, f"{tmp_path}/*", 1_000).collect()}
    finally:
        spark.conf.unset("spark.sql.sources.binaryFile.maxLength")
    assert got == {name: hashlib.sha256(packed).hexdigest(), "other.bin": hashlib.sha256(data).hexdigest()}


def test_nearest_within_a_limit():
    noise = np.random.default_rng(5)
    rows, points = noise.normal(size=(40, 3)), noise.normal(size=(300, 3))
    counts = noise.integers(1, 3, 300)
    two = neighbours.two_nearest(rows, points, counts)
    for limit in (two[:, 1] * 1.5, two[:, 1], two[:, 0] * 0.5, np.where(np.arange(40) % 2, np.inf, two[:, 1])):
        got = neighbours.two_nearest(rows, points, counts, limit)
        below = two < limit[:, None]
        assert (got[below] == two[below]).all() and (got >= two).all()
    assert np.isinf(neighbours.two_nearest(rows, points, counts, np.zeros(40))).all()


def test_few_queries_in_many_cells_are_one_group(spark, monkeypatch):
    sides, real = [], neighbours.tile_side
    monkeypatch.setattr(neighbours, "tile_side", lambda *a: sides.append(a) or real(*a))
    noise = np.random.default_rng(6)
    table = lambda n: spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(noise.normal(size=(n, 4)))], "id int, v array<double>")
    query, base = table(200), table(2_000)
    got = {r["id"]: (r["d1"], r["d2"]) for r in neighbours.nearest_two(query, base).collect()}
    points = np.array([r["v"] for r in base.collect()])
    for r in query.collect():
        d = np.sort(np.sqrt(((points - r["v"]) ** 2).sum(1)))
        assert math.isclose(got[r["id"]][0], d[0]) and math.isclose(got[r["id"]][1], d[1])
    assert sides[0][:2] == (1, 1)


def test_stored_rows_are_not_stored_again(spark, sf, monkeypatch):
    written, real = [], generate._real(spark, sf)
    monkeypatch.setattr(G, "stored", lambda df: written.append(df) or stored(df))
    ready = G.prepare_real(real, "row_key")[0]
    assert not written and ready.count() == real.count()
    G.prepare_real(real.drop("row_key"))
    assert len(written) == 1


def test_digests_of_a_split_are_deleted(spark, sf, monkeypatch):
    gone = []
    monkeypatch.setattr(S, "release", lambda df: gone.append(is_stored(df)) or release(df))
    df = views.flow_view(spark, sf, extra=True).select("attack_category", "label", "row_key")
    assert S.stratified_split(df, key=F.col("row_key")).count() == df.count() and gone == [True]


def test_large_splits_and_vectors_are_columns(spark, sf, monkeypatch):
    monkeypatch.setattr(models, "_PARTS", {})
    monkeypatch.setattr(L, "LAID_OUT_ROWS", 1_000)
    train, val, test = models._parts(spark, sf)
    assert all("parquet" in df._jdf.queryExecution().optimizedPlan().toString() for df in (train, val, test))
    kept = []
    monkeypatch.setattr(L, "stored", lambda df: kept.append(stored(df)) or kept[-1])
    model = L.fit_best(train.drop("row_key"), val, [models.SMALL[0]])
    assert len(kept) == 2 and model.train_rows == train.count()
    with pytest.raises(Exception):  # noqa: B017
        kept[0].count()


def test_reports_on_parts_fit_no_model_they_do_not_read(spark, sf, monkeypatch):
    asked = []
    monkeypatch.setattr(models, "_fitted", lambda *a: asked.append(a))
    monkeypatch.setattr(L, "utility_protocols", lambda *a, **k: a[0])
    monkeypatch.setattr(L, "evaluation_report", lambda *a, **k: a[0])
    models.utility_protocols(spark, sf)
    models.evaluation_report(spark, sf)
    assert not asked
