"""Boosted-tree classifier: preparation, candidates, scoring, importance, protocols."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import Imputer, OneHotEncoder, SQLTransformer, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from flowmill.functions.labels import decide, risk_level, verdict
from flowmill.operators import metrics as M
from flowmill.operators import quality as Q
from flowmill.operators.compare import fidelity_report
from flowmill.operators.privacy import privacy_report
from flowmill.operators.split import sample_rows
from flowmill.plans.small import settle
from flowmill.schema import META_COLUMNS
from flowmill.session import release, shared_dir, stored

SCORE = "score"
# Rows up to which a fit keeps its vectors where they were made, in memory or beside it. The draws of a fit go by the
# place of a row, so this keeps small fits as they are; vectors of more rows are written as columns.
LAID_OUT_ROWS = 1_000_000
# A category the encoder can name: attribute names must not be empty.
BLANK = "(blank)"


@dataclass(frozen=True)
class Candidate:
    """One configuration of the booster."""

    name: str
    balanced: bool = True
    max_depth: int = 6
    min_rows: int = 80
    rounds: int = 60
    step: float = 0.1
    subsample: float = 0.9
    tolerance: float = 0.001


# Names and settings of the published candidates. Depths stand for the leaf limits 63, 63
# and 127 of a leaf-wise booster.
CANDIDATES = (
    Candidate("regularized_balanced"),
    Candidate("plain_probability", balanced=False),
    Candidate("deeper_recall", max_depth=7, min_rows=40),
)


@dataclass(frozen=True)
class FittedModel:
    pipeline: PipelineModel
    threshold: float
    numeric: tuple[str, ...]
    categorical: tuple[str, ...]
    dropped_empty: tuple[str, ...] = ()
    candidate: str = ""
    train_rows: int = 0
    results: tuple = field(default=())

    @property
    def features(self) -> list[str]:
        return [*self.numeric, *self.categorical]


def training_features(train: DataFrame) -> tuple[list[str], list[str], list[str]]:
    """(numeric, categorical, dropped): features with at least one training value."""
    numeric, categorical = Q.feature_classes(train, META_COLUMNS)
    empty = Q.empty_features(train, numeric + categorical)
    return ([c for c in numeric if c not in empty], [c for c in categorical if c not in empty], empty)


def preparation(numeric: Sequence[str], categorical: Sequence[str]) -> Pipeline:
    """Median for missing numbers, one-hot text with unknown values ignored, one vector."""
    text = ", ".join(
        f"CASE WHEN `{c}` IS NULL THEN 'missing' WHEN `{c}` = '' THEN '{BLANK}' ELSE CAST(`{c}` AS STRING) END AS `{c}__text`"
        for c in categorical)
    stages = [SQLTransformer(statement="SELECT *" + (", " + text if text else "") + " FROM __THIS__")]
    if numeric:
        stages.append(Imputer(strategy="median", inputCols=list(numeric), outputCols=[f"{c}__num" for c in numeric]))
    if categorical:
        stages.append(StringIndexer(inputCols=[f"{c}__text" for c in categorical],
                                    outputCols=[f"{c}__at" for c in categorical], handleInvalid="keep"))
        # The extra index of unknown values is the dropped last one: all zeros.
        stages.append(OneHotEncoder(inputCols=[f"{c}__at" for c in categorical],
                                    outputCols=[f"{c}__hot" for c in categorical], dropLast=True))
    stages.append(VectorAssembler(
        inputCols=[f"{c}__num" for c in numeric] + [f"{c}__hot" for c in categorical],
        outputCol="features", handleInvalid="keep"))
    return Pipeline(stages=stages)


def class_weight(balanced: bool, counts: dict[int, int]) -> Column:
    """Weight n / (2 n_class), or 1."""
    if not balanced:
        return F.lit(1.0)
    n = sum(counts.values())
    weight = lambda y: n / (2.0 * counts[y]) if counts.get(y) else 1.0
    return F.when(F.col("label") == 1, weight(1)).otherwise(weight(0))


def _boost(prepared: DataFrame, counts: dict[int, int], candidate: Candidate, seed: int):
    booster = GBTClassifier(
        featuresCol="features", labelCol="_y", weightCol="_w", validationIndicatorCol="_held_out",
        maxIter=candidate.rounds, maxDepth=candidate.max_depth, minInstancesPerNode=candidate.min_rows,
        stepSize=candidate.step, subsamplingRate=candidate.subsample, validationTol=candidate.tolerance,
        seed=seed, checkpointInterval=10)
    return booster.fit(prepared.withColumn("_w", class_weight(candidate.balanced, counts)))


def _with_score(df: DataFrame) -> DataFrame:
    return df.withColumn(SCORE, vector_to_array("probability")[1])


def fit_best(train: DataFrame, val: DataFrame, candidates: Sequence[Candidate] = CANDIDATES,
             seed: int = 42, features: tuple | None = None) -> FittedModel:
    """Fit each candidate with early stopping on `val`, tune its threshold there, keep the best F1."""
    shared_dir(train.sparkSession)  # the booster checkpoints its residuals there
    numeric, categorical, dropped = features or training_features(train)
    keep = [F.col("label").cast("int").alias("label")]
    narrow = lambda df: df.select(
        *[F.col(c).cast("double").alias(c) for c in numeric],
        *[F.col(c).cast("string").alias(c) for c in categorical], *keep)
    prepare = preparation(numeric, categorical).fit(narrow(train))
    ready = lambda df, held: prepare.transform(narrow(df)).select(
        "features", "label", F.col("label").cast("double").alias("_y"), F.lit(held).alias("_held_out"))
    counts = {r["label"]: r["count"] for r in train.groupBy(*keep).count().collect()}
    large = sum(counts.values()) > LAID_OUT_ROWS
    hold = stored if large else DataFrame.persist
    train_ready, val_ready = hold(ready(train, False)), hold(ready(val, True))
    try:
        best, results = None, []
        for candidate in candidates:
            booster = _boost(train_ready.unionByName(val_ready), counts, candidate, seed)
            scored = _with_score(booster.transform(val_ready))
            tuned = M.best_threshold(scored, score=SCORE).first()
            default = M.confusion_metrics(scored.withColumn("prediction", decide(F.col(SCORE), 0.5))).first()
            results.append((candidate.name, booster.getNumTrees, float(default["f1"]), tuned["threshold"],
                            tuned["precision"], tuned["recall"], tuned["f1"]))
            if best is None or tuned["f1"] > best[0]:
                best = (tuned["f1"], booster, tuned["threshold"], candidate.name)
    finally:
        for held in (train_ready, val_ready):
            release(held) if large else held.unpersist()
    return FittedModel(PipelineModel(prepare.stages + [best[1]]), best[2], tuple(numeric), tuple(categorical),
                       tuple(dropped), best[3], sum(counts.values()), tuple(results))


CANDIDATE_SCHEMA = ("name string, best_iteration int, validation_default_f1 double, threshold double, "
                    "precision double, recall double, f1 double")


def candidate_results(model: FittedModel, df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame(list(model.results), CANDIDATE_SCHEMA)


def predict(df: DataFrame, model: FittedModel, keep: Sequence[str] = ()) -> DataFrame:
    """Scores, predictions, verdicts and risks for any table or stream; a narrow map."""
    types = dict(df.dtypes)
    aligned = Q.align_features(
        df.select(*[F.col(c) for c in df.columns if c in model.features],
                  *[F.col(c).alias(f"_keep_{c}") for c in keep if c in types]),
        model.numeric, model.categorical, [f"_keep_{c}" for c in keep if c in types])
    scored = _with_score(model.pipeline.transform(aligned))
    p = F.col(SCORE)
    prediction = decide(p, model.threshold)
    return scored.select(
        *[F.col(f"_keep_{c}").alias(c) for c in keep if c in types], "features", SCORE,
        prediction.alias("prediction"), verdict(prediction).alias("verdict"), risk_level(p).alias("risk"))


def evaluate(df: DataFrame, model: FittedModel, split: str) -> DataFrame:
    return M.evaluation(predict(df, model, ["label"]), split, model.threshold, SCORE)


# ------------------------------------------------------------ importance

def vector_names(model: FittedModel, df: DataFrame) -> list[tuple[str, str]]:
    """(transformed name, source column) of every slot of the feature vector."""
    aligned = Q.align_features(df, model.numeric, model.categorical)
    names = [(f"numeric__{c}", c) for c in model.numeric]
    indexers = [s for s in model.pipeline.stages if s.__class__.__name__ == "StringIndexerModel"]
    if indexers:
        for column, labels in zip(model.categorical, indexers[0].labelsArray):
            names += [(f"categorical__{column}_{'' if v == BLANK else v}", column) for v in labels]
    size = model.pipeline.stages[-1].numFeatures
    if len(names) != size:
        raise ValueError(f"{len(names)} names for {size} features of {aligned.columns}")
    return names


def feature_importance(model: FittedModel, df: DataFrame, top: int = 30) -> DataFrame:
    """(kind, feature, gain): positive importances per vector slot and per source column."""
    names = vector_names(model, df)
    gains = model.pipeline.stages[-1].featureImportances.toArray()
    lines = df.sparkSession.createDataFrame(
        [(name, source, float(g)) for (name, source), g in zip(names, gains) if g > 0],
        "feature string, source string, gain double")
    slots = lines.orderBy(F.desc("gain"), "feature").limit(top).select(
        F.lit("transformed").alias("kind"), "feature", "gain")
    sources = lines.groupBy("source").agg(F.sum("gain").alias("gain")).orderBy(
        F.desc("gain"), "source").limit(top).select(F.lit("original").alias("kind"), F.col("source").alias("feature"), "gain")
    return slots.unionByName(sources)


# ------------------------------------------------------------ protocols and reports

def utility_protocols(train: DataFrame, val: DataFrame, test: DataFrame, synthetic: DataFrame,
                      max_train_rows: int | None = None, candidate: Candidate = Candidate("protocol", min_rows=60, step=0.05),
                      rounds: int = 100, seed: int = 42) -> DataFrame:
    """Train on real, synthetic and both, test on real: one line per protocol with F1 intervals."""
    features = training_features(train)
    types = dict(train.dtypes)
    synthetic = Q.align_to_columns(synthetic, train.columns, types).dropna(subset=["label"])
    real = train if max_train_rows is None else sample_rows(train, max_train_rows, seed)
    n = real.count()
    other = sample_rows(synthetic, n, seed + 1)
    out = None
    for name, frame in (("real_only", real), ("synthetic_only", other), ("augmented", real.unionByName(other))):
        model = fit_best(frame, val, [candidate], seed, features)
        scored = predict(test, model, ["label"])
        ci = M.bootstrap_ci(scored, rounds, seed, score=SCORE).filter("metric = 'f1'").select(
            F.col("low").alias("f1_low"), F.col("high").alias("f1_high"), F.lit(name).alias("protocol"))
        line = M.evaluation(scored, "test", model.threshold, SCORE).withColumn("protocol", F.lit(name)).join(ci, "protocol")
        out = line if out is None else out.unionByName(line)
    out = settle(out)
    return out.join(M.relative_performance(out.select("protocol", "f1")).drop("f1"), "protocol")


def validation_verdict(average_js: float, synthetic_percent: float, dcr_p05: float) -> str:
    """Whether generated data passes the configured checks."""
    passed = average_js < 0.05 and synthetic_percent >= 85 and dcr_p05 > 0.25
    return "passes the configured validation checks" if passed else "ready for controlled experiments"


def evaluation_report(train: DataFrame, val: DataFrame, test: DataFrame, synthetic: DataFrame, columns: Sequence[str],
                      max_rows: int | None = None, privacy_rows: int | None = None, **protocol) -> DataFrame:
    """Long form (section, metric, key, value) of fidelity, utility, privacy and the verdict."""
    line = lambda section, df, key: df.select(F.inline(F.array(*[
        F.struct(F.lit(section).alias("section"), F.lit(c).alias("metric"), key.alias("key"),
                 F.col(c).cast("string").alias("value")) for c in df.columns if c != "protocol"])))
    fidelity = fidelity_report(train, synthetic, columns, max_rows=max_rows)
    utility = utility_protocols(train, val, test, synthetic, **protocol)
    privacy = privacy_report(train, synthetic, columns, max_rows=privacy_rows)
    fidelity, utility, privacy = settle(fidelity), settle(utility), settle(privacy)
    js = fidelity.filter("metric = 'average_js_divergence'").first()["value"]
    percent = utility.filter("protocol = 'synthetic_only'").first()["percent_of_real"]
    verdict_text = validation_verdict(js, percent, privacy.first()["dcr_p05"])
    none = F.lit(None).cast("string")
    return (
        fidelity.select(F.lit("fidelity").alias("section"), "metric", F.col("feature").alias("key"),
                        F.col("value").cast("string").alias("value"))
        .unionByName(line("utility", utility, F.col("protocol")))
        .unionByName(line("privacy", privacy, none))
        .unionByName(Q.facet_counts(synthetic, ["attack_category", "label"]).select(
            F.lit("synthetic").alias("section"), F.col("facet").alias("metric"), F.col("name").alias("key"),
            F.col("rows").cast("string").alias("value")))
        .unionByName(train.sparkSession.range(1).select(
            F.lit("verdict").alias("section"), F.lit("recommendation").alias("metric"), none.alias("key"),
            F.lit(verdict_text).alias("value"))))


def experiment_card(model: FittedModel, evaluation: DataFrame, quality: DataFrame) -> DataFrame:
    """One row of model, performance and data facts; `quality` is a quality_report."""
    at = lambda section, key: F.max(F.when((F.col("section") == section) & (F.col("key") == key), F.col("value")))
    facts = quality.agg(
        at("rows", "after_dedup").alias("rows_after_dedup"), at("rows", "duplicates_removed").alias("duplicates_removed"),
        F.concat_ws(",", F.sort_array(F.collect_set(F.when(F.col("section") == "dataset_source", F.col("key"))))).alias("datasets_used"),
    ).withColumn("_one", F.lit(1))
    return evaluation.withColumn("_one", F.lit(1)).join(facts, "_one").select(
        F.lit("gradient boosted trees").alias("algorithm"), F.lit(model.candidate).alias("selected_candidate"),
        F.lit(model.threshold).alias("decision_threshold"), F.lit(len(model.features)).alias("feature_count"),
        F.lit(len(model.numeric)).alias("numeric_features"), F.lit(len(model.categorical)).alias("categorical_features"),
        F.lit(model.train_rows).alias("train_rows"),
        *[F.col(c).alias(f"test_{c}") for c in ("f1", "recall", "precision", "roc_auc", "average_precision", "accuracy")],
        "datasets_used", "rows_after_dedup", "duplicates_removed")
