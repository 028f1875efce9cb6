"""The pipeline as command-line jobs.

    python -m flowmill.jobs ingest   --root DIR --output DIR [--registry FILE] [--datasets K ...] [--max-rows N]
    python -m flowmill.jobs split    --input DIR --output DIR
    python -m flowmill.jobs generate --input DIR --output DIR [--rows N] [--mode M] ...
    python -m flowmill.jobs train    --splits DIR --output DIR
    python -m flowmill.jobs evaluate --splits DIR --synthetic DIR --output DIR
    python -m flowmill.jobs score    --model DIR --input DIR --output DIR
    python -m flowmill.jobs drift    --baseline DIR --current DIR --output DIR
"""

from __future__ import annotations

import argparse
from dataclasses import asdict

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession, functions as F

from flowmill.operators import drift as D
from flowmill.operators import generate as G
from flowmill.operators import metrics as M
from flowmill.operators import model as L
from flowmill.operators import quality as Q
from flowmill.operators.normalize import recast_canonical
from flowmill.operators.split import split_counts, stratified_split
from flowmill.schema import NUMERIC_FEATURES
from flowmill.session import build_session, scratch_path
from flowmill.sources import readers, sinks
from flowmill.sources.registry import ACTIVE_SOURCES, load_registry


def ingest(spark: SparkSession, root: str, output: str, registry=ACTIVE_SOURCES, datasets=None,
           max_rows: int | None = None) -> list[str]:
    """Raw files to one unified table and its summary; returns the datasets without files."""
    unified, skipped = readers.ingest(spark, registry, root, datasets, max_rows)
    if unified is not None and sinks.write_table(unified, f"{output}/unified"):
        sinks.write_document(Q.ingest_summary(spark.read.parquet(f"{output}/unified")), f"{output}/ingest_summary")
    return skipped


def split(spark: SparkSession, source: str, output: str, sizes=(0.70, 0.15, 0.15), seed: int = 42) -> None:
    """Recast, dedup, report and split; the deduplicated table is written once and read
    by the steps that follow."""
    before = recast_canonical(spark.read.parquet(source))
    distinct = scratch_path(spark, "distinct")
    Q.dedup(before).write.parquet(distinct)
    after = spark.read.parquet(distinct)
    sinks.write_document(Q.quality_report(before, after), f"{output}/quality_report")
    sinks.write_splits(stratified_split(after, *sizes, seed=seed), f"{output}/splits")
    counts = split_counts(spark.read.parquet(f"{output}/splits"))
    sinks.write_document(counts, f"{output}/split_counts")


def read_split(spark: SparkSession, splits: str, name: str) -> DataFrame:
    return spark.read.parquet(splits).filter(F.col("split") == name).drop("split")


def generate(spark: SparkSession, source: DataFrame, output: str, request: G.GenerationRequest, **facets) -> None:
    synthetic = G.generate(source, request, **facets)
    sinks.write_table(synthetic, f"{output}/synthetic")
    written = spark.read.parquet(f"{output}/synthetic")
    sinks.write_document(G.generation_summary(written, source, request), f"{output}/synthetic_summary")


def save_model(spark: SparkSession, model: L.FittedModel, path: str) -> None:
    """The pipeline and one line of facts needed to score with it."""
    model.pipeline.write().overwrite().save(f"{path}/pipeline")
    facts = {k: v for k, v in asdict_shallow(model).items() if k not in ("pipeline", "results")}
    spark.createDataFrame([facts], "threshold double, numeric array<string>, categorical array<string>, "
                          "dropped_empty array<string>, candidate string, train_rows long").write.mode(
        "overwrite").json(f"{path}/facts")


def asdict_shallow(model: L.FittedModel) -> dict:
    return {k: list(v) if isinstance(v, tuple) else v for k, v in vars(model).items()}


def load_model(spark: SparkSession, path: str) -> L.FittedModel:
    row = spark.read.schema("threshold double, numeric array<string>, categorical array<string>, "
                            "dropped_empty array<string>, candidate string, train_rows long").json(f"{path}/facts").first()
    return L.FittedModel(PipelineModel.load(f"{path}/pipeline"), row["threshold"], tuple(row["numeric"]),
                         tuple(row["categorical"]), tuple(row["dropped_empty"]), row["candidate"], row["train_rows"])


def train(spark: SparkSession, splits: str, output: str, candidates=L.CANDIDATES, seed: int = 42) -> L.FittedModel:
    parts = {name: read_split(spark, splits, name) for name in ("train", "val", "test")}
    model = L.fit_best(parts["train"], parts["val"], candidates, seed)
    save_model(spark, model, f"{output}/model")
    evaluation = L.evaluate(parts["val"], model, "val").unionByName(L.evaluate(parts["test"], model, "test"))
    sinks.write_document(evaluation, f"{output}/evaluation")
    sinks.write_document(L.candidate_results(model, parts["train"]), f"{output}/candidates")
    sinks.write_document(L.feature_importance(model, parts["train"]), f"{output}/feature_importance")
    scored = L.predict(parts["test"], model, ["label", "attack_category"])
    sinks.write_document(M.category_metrics(scored), f"{output}/category_metrics")
    return model


def evaluate(spark: SparkSession, splits: str, synthetic: str, output: str, **options) -> None:
    parts = [read_split(spark, splits, name) for name in ("train", "val", "test")]
    report = L.evaluation_report(*parts, spark.read.parquet(synthetic), NUMERIC_FEATURES, **options)
    sinks.write_document(report, f"{output}/evaluation_report")


def score(spark: SparkSession, model: L.FittedModel, flows: DataFrame, output: str) -> None:
    keep = [c for c in flows.columns if c not in model.features]
    L.predict(flows, model, keep).drop("features").write.mode("overwrite").parquet(f"{output}/scored")
    sinks.write_document(M.scoring_summary(spark.read.parquet(f"{output}/scored")), f"{output}/scoring_summary")


def drift(spark: SparkSession, baseline: DataFrame, current: DataFrame, output: str, method: str = "reference") -> None:
    numeric, _ = Q.feature_classes(baseline, categorical=())
    report = D.drift_report(baseline, current, [c for c in numeric if c in NUMERIC_FEATURES] or numeric, method)
    sinks.write_document(report, f"{output}/drift")
    sinks.write_document(D.drift_summary(report), f"{output}/drift_summary")


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="flowmill.jobs")
    jobs = parser.add_subparsers(dest="job", required=True)

    def job(name: str, *paths: str):
        sub = jobs.add_parser(name)
        for path in (*paths, "output"):
            sub.add_argument(f"--{path}", required=True)
        return sub

    sub = job("ingest", "root")
    sub.add_argument("--registry")
    sub.add_argument("--datasets", nargs="+")
    sub.add_argument("--max-rows", type=int)
    sub = job("split", "input")
    sub.add_argument("--train-size", type=float, default=0.70)
    sub.add_argument("--val-size", type=float, default=0.15)
    sub.add_argument("--test-size", type=float, default=0.15)
    sub.add_argument("--seed", type=int, default=42)
    sub = job("generate", "input")
    for field, value in asdict(G.GenerationRequest()).items():
        if field == "drop_exact_matches":
            sub.add_argument("--keep-exact-matches", action="store_true")
        else:
            sub.add_argument("--" + field.replace("_", "-"), type=type(value), default=value)
    for facet in Q.FACETS:
        sub.add_argument("--" + facet.replace("_", "-"), nargs="+", type=int if facet == "labels" else str)
    job("train", "splits")
    sub = job("evaluate", "splits", "synthetic")
    sub.add_argument("--max-rows", type=int)
    sub.add_argument("--privacy-rows", type=int)
    job("score", "model", "input")
    sub = job("drift", "baseline", "current")
    sub.add_argument("--method", choices=D.METHODS, default="reference")
    args = parser.parse_args(argv)

    spark = build_session(f"flowmill {args.job}")
    if args.job == "ingest":
        registry = load_registry(args.registry) if args.registry else ACTIVE_SOURCES
        skipped = ingest(spark, args.root, args.output, registry, args.datasets, args.max_rows)
        print("skipped:", ", ".join(skipped) or "none")
    elif args.job == "split":
        split(spark, args.input, args.output, (args.train_size, args.val_size, args.test_size), args.seed)
    elif args.job == "generate":
        request = G.GenerationRequest(
            **{k: getattr(args, k) for k in asdict(G.GenerationRequest()) if k != "drop_exact_matches"},
            drop_exact_matches=not args.keep_exact_matches)
        generate(spark, spark.read.parquet(args.input), args.output, request, **{f: getattr(args, f) for f in Q.FACETS})
    elif args.job == "train":
        train(spark, args.splits, args.output)
    elif args.job == "evaluate":
        evaluate(spark, args.splits, args.synthetic, args.output, max_rows=args.max_rows, privacy_rows=args.privacy_rows)
    elif args.job == "score":
        score(spark, load_model(spark, args.model), spark.read.parquet(args.input), args.output)
    else:
        drift(spark, spark.read.parquet(args.baseline), spark.read.parquet(args.current), args.output, args.method)


if __name__ == "__main__":
    main()
