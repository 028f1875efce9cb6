import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowmill import jobs
from flowmill.operators import explain as E
from flowmill.operators import generate as G
from flowmill.operators import model as L
from flowmill.operators import quality as Q
from flowmill.operators.normalize import SourceConfig
from flowmill.schema import FLOW_COLUMNS
from flowmill.sources import audit, files, readers, registry
from flowmill.session import cut_lineage
from flowmill.views import flow_view


# ------------------------------------------------------------ allocation

def test_published_allocation():
    counts = {"Normal": 1000} | {f"a{i:02}": i + 1 for i in range(35)}
    labels = {c: int(c != "Normal") for c in counts}
    got = G.allocate(counts, 500_000, "label_balanced", 25, labels)
    attacks = sorted((n for c, n in got.items() if c != "Normal"), reverse=True)
    assert got["Normal"] == 250_000 and attacks == [7143] * 30 + [7142] * 5


@pytest.mark.parametrize("seed", range(20))
def test_allocation_sums_and_minimum(seed):
    rng = random.Random(seed)
    counts = {f"c{i}": rng.randint(1, 10 ** rng.randint(1, 5)) for i in range(rng.randint(1, 12))}
    total, minimum = rng.randint(100, 5000), rng.randint(0, 300)
    for mode in G.MODES:
        got = G.allocate(counts, total, mode, minimum, {c: i % 2 for i, c in enumerate(counts)})
        assert sum(got.values()) == total
        if mode != "label_balanced":
            assert min(got.values()) >= min(minimum, total // len(counts))


def test_allocation_falls_back_when_a_side_is_absent():
    counts = {"a": 30, "b": 10}
    assert G.allocate(counts, 100, "label_balanced", 0, {"a": 1, "b": 1}) == G.allocate(counts, 100, "proportional", 0)
    assert G.allocate({}, 10) == {}
    with pytest.raises(ValueError):
        G.allocate(counts, 10, "odd")


def test_request_ranges():
    ok = dict(rows=100, mode="balanced", minimum_per_category=0, noise_scale=0.0, clip_quantile=0.0)
    Q.check_generation_request(**ok)
    for bad in ({"rows": 99}, {"rows": 1_000_001}, {"mode": "x"}, {"minimum_per_category": 101}, {"noise_scale": 0.6},
                {"clip_quantile": 0.2}, {"noise_scale": -0.1}):
        with pytest.raises(ValueError):
            Q.check_generation_request(**{**ok, **bad})


# ------------------------------------------------------------ generation

FEW = ["attack_category", "label", "attack_subcategory", "environment_type", "dataset_source", "source_file",
       "protocol", "service", "duration", "src_port", "src_bytes", "dst_bytes", "total_packets_fwd",
       "total_packets_bwd", "bytes_per_packet_ratio"]


def test_generation_invariants(spark, sf):
    real = flow_view(spark, sf).select(*FEW).distinct()
    request = G.GenerationRequest(rows=1000, mode="balanced", seed=5)
    out = G.generate(real, request)
    assert out.columns == FEW
    allocation = {r.attack_category: r.rows for r in G.allocation_table(spark, real, 1000, "balanced", 25).collect()}
    made = {r.attack_category: r["count"] for r in out.groupBy("attack_category").count().collect()}
    assert made == allocation and sum(made.values()) == 1000
    assert out.filter((F.col("label") == 0) != (F.col("attack_category") == "Normal")).isEmpty()
    assert out.filter((F.col("label") == 0) & (F.col("attack_subcategory") != "Normal")).isEmpty()
    assert Q.constraint_violations(out).isEmpty()
    assert Q.exact_match_count(out, real).first()[0] == 0
    profile = {(r.attack_category, r.feature): r for r in Q.numeric_profile(real, ["src_bytes", "src_port"]).collect()}
    for r in out.select("attack_category", "src_bytes", "src_port").collect():
        p = profile[(r.attack_category, "src_bytes")]
        assert p.low - 1e-6 <= r.src_bytes <= p.high + 1e-6 and r.src_port == int(r.src_port)


def test_generation_does_not_depend_on_partitions(spark, sf):
    real = flow_view(spark, sf).select(*FEW).distinct()
    request = G.GenerationRequest(rows=300, seed=9)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    results = []
    try:
        for n in ("2", "20"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            # Deviations are floating sums: their last digits follow the order of addition.
            results.append(sorted(tuple(f"{v:.6f}" if isinstance(v, float) else str(v) for v in r)
                                  for r in G.generate(real.repartition(int(n)), request).collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert results[0] == results[1]


def test_generation_without_noise_copies_then_moves(spark, sf):
    real = flow_view(spark, sf).select(*FEW).distinct()
    kept = G.generate(real, G.GenerationRequest(rows=200, noise_scale=0.0, drop_exact_matches=False), attack_categories=["Normal"])
    assert kept.select("attack_category").distinct().count() == 1
    sizes = {r[0] for r in real.filter("label = 0").select("src_bytes").collect()}
    assert all(r[0] in sizes for r in kept.select("src_bytes").collect())


def test_value_ranges_cover_every_draw(spark):
    real = spark.createDataFrame([("a", f"v{i % 50}") for i in range(500)] + [("b", "only")], "attack_category string, s string")
    ids = spark.range(3000).select("id", F.when(F.col("id") < 2900, "a").otherwise("b").alias("attack_category"))
    out = G.draw_value(ids, real, "s", 1, F.lit("missing"))
    counts = {r.s: r["count"] for r in out.groupBy("s").count().collect()}
    assert out.count() == 3000 and counts["only"] == 100 and len(counts) == 51 and "missing" not in counts


# ------------------------------------------------------------ models

@pytest.fixture(scope="module")
def fitted(spark, sf):
    flow = flow_view(spark, sf).withColumn("id", F.monotonically_increasing_id()).persist()
    train, val = flow.filter("id % 4 <> 0"), flow.filter("id % 4 = 0")
    candidate = L.Candidate("tiny", max_depth=3, rounds=3, min_rows=5, step=0.3)
    model = L.fit_best(train.drop("id"), val.drop("id"), [candidate])
    return model, val


def test_attributions_add_up(spark, fitted):
    model, val = fitted
    rows = E.explain(val, model, "id").groupBy("id").agg(
        F.abs(F.sum("value") + F.max("base_value") - E.margin_of(F.max("score"))).alias("gap"))
    assert rows.count() == val.count() and rows.agg(F.max("gap")).first()[0] < 1e-6


def test_top_drivers_need_no_shuffle_and_equal_a_plain_choice(spark, fitted):
    model, val = fitted
    twice = val.unionByName(val.limit(3))  # rows of equal id are explained by themselves
    chosen = E.top_drivers(twice, model, "id", overall=3, each=2)
    assert "Exchange" not in E.top_drivers(cut_lineage(val), model, "id")._jdf.queryExecution().executedPlan().toString()
    lines = E.explain(val, model, "id").toPandas()
    copies = twice.groupBy("id").count().toPandas().set_index("id")["count"]
    want = []
    for key, row in lines.groupby("id"):
        row = row.assign(size=-row["value"].abs()).sort_values(["size", "feature"], kind="stable")
        seen = {}
        for rank, (feature, value) in enumerate(zip(row["feature"], row["value"]), 1):
            side = "attack" if value > 0 else "normal" if value < 0 else "none"
            seen[side] = seen.get(side, 0) + 1
            driver = side != "none" and seen[side] <= 2
            if rank <= 3 or driver:
                want += [(key, feature, value, side, rank, seen[side], driver)] * copies[key]
    got = [tuple(r) for r in chosen.select("id", "feature", "value", "side", "rank", "side_rank", "driver").collect()]
    assert sorted(got) == sorted(want)


def test_ranked_drivers_of_ties():
    values = np.array([[0.0, 2.0, -2.0, 1.0], [0.0, 0.0, 0.0, 0.0]])
    rows, slots, more = E.rank_drivers(values, np.array([3, 2, 1, 0]), overall=2, each=1)
    got = list(zip(rows, slots, more["side"], more["rank"], more["side_rank"], more["driver"]))
    assert got == [(0, 2, "normal", 1, 1, True), (0, 1, "attack", 2, 1, True), (1, 3, "none", 1, 1, False),
                   (1, 2, "none", 2, 2, False)]


def test_attributions_are_shapley_values():
    from itertools import combinations
    from math import factorial

    leaves = [(2.0, [(0, [(True, 1.0)], 0.3), (1, [(False, 0.5)], 0.6)]), (-1.0, [(0, [(False, 1.0)], 0.7)]),
              (0.5, [(2, [(True, frozenset({1.0}))], 0.2), (0, [(True, 1.0)], 0.3), (1, [(True, 0.5)], 0.4)])]
    x = np.array([[0.0, 1.0, 1.0], [2.0, 0.0, 0.0], [1.0, 0.2, 1.0]])

    def game(row, known):
        total = 0.0
        for v, path in leaves:
            for f, tests, share in path:
                v *= float(E._passes(row[f : f + 1], tests)[0]) if f in known else share
            total += v
        return total

    for row, got in zip(x, E.attributions(x, leaves)):
        for i in range(3):
            others = [j for j in range(3) if j != i]
            want = sum(factorial(k) * factorial(2 - k) / 6 * (game(row, {*s, i}) - game(row, set(s)))
                       for k in range(3) for s in combinations(others, k))
            assert got[i] == pytest.approx(want)


def test_scoring_fills_absent_columns(spark, fitted):
    model, val = fitted
    partial = val.select("id", "duration", F.lit("new value").alias("protocol"))
    scored = L.predict(partial, model, ["id"])
    assert scored.count() == val.count()
    r = scored.agg(F.min("score"), F.max("score")).first()
    assert 0 <= r[0] <= r[1] <= 1
    assert {r[0] for r in scored.select("verdict").distinct().collect()} <= {"Attack", "Normal"}


def test_importance_sums(spark, fitted):
    model, val = fitted
    got = L.feature_importance(model, val)
    sums = {r.kind: r.s for r in got.groupBy("kind").agg(F.sum("gain").alias("s")).collect()}
    assert sums["original"] == pytest.approx(1.0) and sums["transformed"] == pytest.approx(1.0)
    assert "active_std" in model.dropped_empty


def test_model_round_trip(spark, fitted, tmp_path):
    model, val = fitted
    jobs.save_model(spark, model, str(tmp_path))
    again = jobs.load_model(spark, str(tmp_path))
    assert again.features == model.features and again.threshold == model.threshold
    a = L.predict(val, model, ["id"]).select("id", "score").collect()
    assert sorted(a) == sorted(L.predict(val, again, ["id"]).select("id", "score").collect())


def test_verdict_rule():
    assert L.validation_verdict(0.04, 85, 0.26).startswith("passes")
    assert not L.validation_verdict(0.05, 85, 0.26).startswith("passes")


# ------------------------------------------------------------ sources and jobs

def test_csv_short_and_long_lines(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text('a,b,c\n1,2,3\n4,5\n6,7,8,9\n,,\nx,"y, z",w\n1,2,,\n1,2,3,,\n', encoding="utf-8")
    rows = [tuple(r) for r in readers.read_headered_csv(spark, str(path)).collect()]
    assert rows == [("1", "2", "3"), ("4", "5", None), (None, None, None), ("x", "y, z", "w")]
    assert readers.read_headered_csv(spark, str(path)).count() == 4


def test_ingest_job_and_split_job(spark, tmp_path):
    raw = tmp_path / "raw"
    (raw / "one").mkdir(parents=True)
    (raw / "kdd").mkdir()
    (raw / "one" / "a.csv").write_text("Dur,Label\n1,benign\n2,DDoS x\nNA,Bot\n")
    (raw / "one" / "b.csv").write_text("Label,Flow Duration\nnormal,7\n")
    (raw / "kdd" / "k.data").write_text(",".join(["3", "tcp"] + ["0"] * 39 + ["neptune."]) + "\n")
    listed = [SourceConfig("one", "One", "Lab", "one", ["*.csv"], label_column="label", attack_column="label"),
              SourceConfig("kdd", "KDD", "Lab", "kdd", ["*.data"], "kdd", "attack", "attack"),
              SourceConfig("gone", "Gone", local_dir="gone", file_patterns=["*.csv"])]
    out = str(tmp_path / "out")
    assert jobs.ingest(spark, str(raw), out, listed) == ["gone"]
    unified = spark.read.parquet(f"{out}/unified")
    assert unified.columns == FLOW_COLUMNS
    got = sorted((r.source_file, r.attack_category, r.label, r.duration) for r in unified.collect())
    assert got == [("kdd/k.data", "DoS", 1, 3.0), ("one/a.csv", "Botnet", 1, None), ("one/a.csv", "DDoS", 1, 2.0),
                   ("one/a.csv", "Normal", 0, 1.0), ("one/b.csv", "Normal", 0, 7.0)]
    capped, _ = readers.ingest(spark, listed, str(raw), ["one"], max_rows=2)
    assert capped.count() == 2 and capped.select("source_file").distinct().count() == 2
    with pytest.raises(ValueError):
        readers.ingest(spark, listed, str(raw), ["nope"])
    jobs.split(spark, f"{out}/unified", out)
    assert spark.read.parquet(f"{out}/splits").groupBy("split").count().agg(F.sum("count")).first()[0] == 5
    jobs.drift(spark, unified, unified, out)
    assert spark.read.json(f"{out}/drift").filter("severity = 'stable'").count() >= 1


def test_registry(spark, tmp_path):
    listed = [SourceConfig("a", tier=1, size_gb=1.0), SourceConfig("b", tier=1, size_gb=3.0), SourceConfig("c", tier=2, size_gb=0.5)]
    frame = registry.registry_frame(spark, listed)
    keys = lambda df: sorted(r.key for r in df.collect())
    assert keys(registry.select_datasets(frame, ["a", "c"])) == ["a", "c"]
    assert keys(registry.select_datasets(frame, tier=1, skip_large=True)) == ["a"]
    assert [tuple(r) for r in registry.registry_by_tier(frame).orderBy("tier").collect()] == [(1, 2, 4.0), (2, 1, 0.5)]
    with pytest.raises(ValueError):
        registry.select_datasets(frame, ["zz"])
    (tmp_path / "r.json").write_text('{"datasets": {"x": {"name": "X", "environment": "IoT", "local_dir": "d", "extra": 1}}}')
    assert registry.load_registry(str(tmp_path / "r.json"))[0].environment == "IoT"
    assert len(registry.ACTIVE_SOURCES) == 11


def test_text_gate(spark, tmp_path):
    for name, data in {"ok.csv": b"a,b\n1,2\n", "empty.csv": b"a,b\n", "zip.csv": b"PK\x03\x04 rest\n1\n", "exe.csv": b"MZ\x00a\n1\n",
                       "gz.csv": b"\x1f\x8b123\n1\n", "noise.csv": b"a\n" + bytes(range(1, 9)) * 4, "ok.txt": b"a\n1\n"}.items():
        (tmp_path / name).write_bytes(data)
    got = {r.path.rsplit("/", 1)[1]: r.reason for r in files.text_gate(spark, f"{tmp_path}/*").collect()}
    assert got == {"ok.csv": None, "empty.csv": "no rows", "zip.csv": "binary content", "exe.csv": "binary content",
                   "gz.csv": "binary content", "noise.csv": "binary content", "ok.txt": "not a csv file"}


def test_digests_and_manifest(spark, tmp_path):
    (tmp_path / "a.json").write_text("hello")
    (tmp_path / "b.parquet").write_text("x")
    actual = files.digests(spark, f"{tmp_path}/*.json")
    good = "2cf24dba5fb0a30e26e83b2ac5b9e29e1b161e5c1fa7425e73043362938b9824"
    check = lambda want: files.verify_digests(actual, spark.createDataFrame([("a.json", want)], "name string, sha256 string")).first().status
    assert (check(good), check("00"), check("")) == ("pass", "fail", "skipped")
    table = readers.file_table(spark, f"{tmp_path}/*")
    facts = spark.createDataFrame([("b", 7, "m")], "stem string, rows long, mode string")
    lines = {r.name: r.rows for r in files.manifest(table, [".json", ".parquet"], 20, facts).collect()}
    assert lines == {"a.json": None, "b.parquet": 7}
    asked = {r.name: r.status for r in files.required_files(spark, table, [("a.json", True), ("z", True), ("y", False)]).collect()}
    assert asked == {"a.json": "pass", "z": "missing", "y": "optional"}


def test_audit_log(spark, tmp_path):
    path = str(tmp_path / "log")
    rows = [(f"2024-01-01 00:00:0{i}", "1.1.1.1", "GET", p, 200, i) for i, p in enumerate(["/api/a", "/", "/api/b"])]
    log = spark.createDataFrame(rows, "ts string, ip string, method string, path string, status int, ms long").withColumn(
        "ts", F.col("ts").cast("timestamp"))
    audit.append_audit(log, path)
    with open(tmp_path / "log" / "bad.json", "w") as handle:
        handle.write("not json\n")
    tail = [r.path for r in audit.audit_tail(audit.read_audit(spark, path), 5).collect()]
    assert tail == ["/api/b", "/api/a"]
    assert audit.audit_tail(audit.read_audit(spark, path), 0).count() == 1


def test_membership(spark):
    real = spark.createDataFrame([(0.0, None, "s"), (1.0, "a", "s")], "x double, y string, dataset_source string")
    made = spark.createDataFrame([(-0.0, None, "t"), (1.0, None, "t"), (1.0, "a", "t"), (1.0, "a", "t")], "x double, y string, dataset_source string")
    assert Q.exact_matches(made, real).count() == 3 and Q.novel_rows(made, real).count() == 1
    assert Q.exact_match_count(made, real).first()[0] == 3
    assert Q.exact_matches(made, real, []).count() == 0
    q = Q.generation_quality(made, real).first()
    assert (q.schema_match, q.missing_cells, q.duplicate_rows, q.exact_real_row_matches) == (True, 2, 1, 3)


def test_preview_and_fallback(spark):
    df = spark.createDataFrame([(float(i), "x", 1) for i in range(9)], "duration double, note string, label int")
    p = Q.preview(df, ["duration", "src_bytes"], ["protocol"])
    assert p.columns == ["duration", "note", "label"] and p.count() == 5
    assert Q.by_label_or_all(df, 1).count() == 9 and Q.by_label_or_all(df, 0).count() == 9
    r = Q.validation_summary(df.limit(0), ["duration"], []).first()
    assert r.readiness == "not_ready"
    assert Q.validation_summary(df, ["duration"], []).first().readiness == "ready"
    assert Q.validation_summary(df, ["duration", "src_bytes", "dst_bytes", "src_port"], []).first().readiness == "not_ready"
