"""Classifier metrics as aggregates: cells, curves, areas, thresholds, intervals."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from flowmill.functions.hashing import normal, uniform
from flowmill.functions.labels import decide, is_concern, probability_band, rate_band, risk_level, verdict
from flowmill.plans.ordered import exact_quantiles, running_totals


def share(top: Column, bottom: Column) -> Column:
    """top / bottom, 0 when the bottom is 0."""
    return F.coalesce(F.try_divide(top, bottom), F.lit(0.0))


# ------------------------------------------------------------ confusion cells

def confusion(df: DataFrame, label: str = "label", prediction: str = "prediction",
              by: list[str] | None = None) -> DataFrame:
    """tn, fp, fn, tp in one pass."""
    y, p = F.col(label), F.col(prediction)
    cell = lambda a, b: F.count_if((y == a) & (p == b))
    return df.groupBy(*(by or [])).agg(
        cell(0, 0).alias("tn"), cell(0, 1).alias("fp"), cell(1, 0).alias("fn"), cell(1, 1).alias("tp"))


def with_scores(cells: DataFrame) -> DataFrame:
    """Add accuracy, precision, recall and f1 to a table of cells."""
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    return cells.withColumns({
        "accuracy": share(tp + tn, tp + tn + fp + fn),
        "precision": share(tp, tp + fp),
        "recall": share(tp, tp + fn),
        "f1": share(2 * tp, 2 * tp + fp + fn),
    })


def confusion_metrics(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    return with_scores(confusion(df, label, prediction))


def classification_report(df: DataFrame, label: str = "label", prediction: str = "prediction",
                          names: tuple[str, str] = ("Normal", "Attack")) -> DataFrame:
    """Rows per class plus accuracy, macro and weighted averages."""
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))

    def scores(hit, extra, lost):
        return share(hit, hit + extra), share(hit, hit + lost), share(2 * hit, 2 * hit + extra + lost)

    p0, r0, f0 = scores(tn, fn, fp)
    p1, r1, f1 = scores(tp, fp, fn)
    n0, n1 = tn + fp, tp + fn
    n = n0 + n1
    line = lambda name, p, r, f, s: F.struct(
        F.lit(name).alias("class"), p.alias("precision"), r.alias("recall"), f.alias("f1"),
        s.cast("long").alias("support"))
    mean = lambda a, b: (a + b) / 2
    weighted = lambda a, b: share(a * n0 + b * n1, n)
    acc = share(tp + tn, n)
    return confusion(df, label, prediction).select(F.inline(F.array(
        line(names[0], p0, r0, f0, n0), line(names[1], p1, r1, f1, n1),
        line("accuracy", acc, acc, acc, n),
        line("macro avg", mean(p0, p1), mean(r0, r1), mean(f0, f1), n),
        line("weighted avg", weighted(p0, p1), weighted(r0, r1), weighted(f0, f1), n))))


def category_metrics(df: DataFrame, score: str = "score", prediction: str = "prediction") -> DataFrame:
    """Per attack category: rows, majority label, mean score, rates, bands; rows descending."""
    parts = df.groupBy("attack_category", "label").agg(
        F.count("*").alias("n"), F.sum(score).alias("s"), F.sum(prediction).alias("hits"))
    merged = parts.groupBy("attack_category").agg(
        F.sum("n").alias("rows"),
        F.max_by("label", F.struct(F.col("n"), -F.col("label").cast("int"))).cast("int").alias("label"),
        F.sum("s").alias("s"), F.sum("hits").alias("hits"))
    rate, attack = share(F.col("hits"), F.col("rows")), F.col("label") == 1
    mean = F.col("s") / F.col("rows")
    return merged.select(
        "attack_category", "rows", "label", mean.alias("mean_attack_probability"),
        F.when(attack, rate).alias("detection_rate"),
        F.when(~attack, rate).alias("false_positive_rate"),
        F.when(~attack, 1 - rate).alias("specificity"),
        rate_band(rate, F.col("label")).alias("rate_band"),
        probability_band(mean, F.col("label")).alias("probability_band"),
        is_concern(rate, F.col("label")).alias("concern"),
    ).orderBy(F.desc("rows"), "attack_category")


SORT_KEYS = ("attack_category", "rate", "mean_attack_probability", "rows")


def sorted_category_metrics(metrics: DataFrame, key: str = "rows", descending: bool = True,
                            limit: int = 40) -> DataFrame:
    """The category table by one of SORT_KEYS, first `limit` lines."""
    if key not in SORT_KEYS:
        raise ValueError(f"sort key must be one of {', '.join(SORT_KEYS)}")
    rate = F.when(F.col("label") == 1, F.coalesce("detection_rate", F.lit(0.0))).otherwise(
        1 - F.coalesce("false_positive_rate", F.lit(0.0)))
    order = {"attack_category": F.lower("attack_category"), "rate": rate}.get(
        key, F.coalesce(F.col(key).cast("double"), F.lit(0.0)) if key != "attack_category" else None)
    return metrics.orderBy(order.desc() if descending else order.asc(), "attack_category").limit(limit)


# ------------------------------------------------------------ score curves

def score_counts(df: DataFrame, label: str = "label", score: str = "score",
                 by: list[str] | None = None) -> DataFrame:
    """Rows collapsed to one line per distinct score with positives and negatives."""
    y = F.col(label)
    return df.filter(F.col(score).isNotNull()).groupBy(*(by or []), F.col(score).alias("score")).agg(
        F.count_if(y == 1).alias("pos"), F.count_if(y == 0).alias("neg"))


def pr_curve(df: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """One line per distinct threshold: cells at score >= threshold, precision, recall, f1."""
    return _curve(score_counts(df, label, score), [])


def _curve(counts: DataFrame, by: list[str]) -> DataFrame:
    ranked = running_totals(counts, by, "score", ["pos", "neg"])
    # Ascending totals: rows at or above the threshold are the total less those below.
    tp = F.col("pos_total") - F.col("pos_before")
    fp = F.col("neg_total") - F.col("neg_before")
    return ranked.select(
        *by, F.col("score").alias("threshold"), "pos", "neg", "pos_total", "neg_total",
        tp.alias("tp"), fp.alias("fp"),
        share(tp, tp + fp).alias("precision"), share(tp, F.col("pos_total")).alias("recall"),
        share(2 * tp, tp + fp + F.col("pos_total")).alias("f1"))


def ranking_areas(df: DataFrame, label: str = "label", score: str = "score",
                  by: list[str] | None = None) -> DataFrame:
    """roc_auc (ties count half) and average_precision (step sum), null with one class."""
    return _areas(score_counts(df, label, score, by), by or [])


def _areas(counts: DataFrame, by: list[str]) -> DataFrame:
    curve = _curve(counts, by)
    above = F.col("tp") - F.col("pos")
    return curve.groupBy(*by).agg(
        F.sum(F.col("neg") * (above + F.col("pos") / 2)).alias("_area"),
        F.sum(F.col("pos") * F.col("precision")).alias("_ap"),
        F.max("pos_total").alias("_p"), F.max("neg_total").alias("_n"),
    ).select(
        *by,
        F.when((F.col("_p") > 0) & (F.col("_n") > 0),
               F.try_divide(F.col("_area"), F.col("_p") * F.col("_n"))).alias("roc_auc"),
        F.when((F.col("_p") > 0) & (F.col("_n") > 0),
               F.try_divide(F.col("_ap"), F.col("_p"))).alias("average_precision"))


def best_threshold(df: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """One row: the threshold of highest F1, the lowest such on ties; 0.5 for an empty table."""
    best = pr_curve(df, label, score).agg(
        F.max_by(F.struct("threshold", "precision", "recall", "f1"),
                 F.struct(F.col("f1"), -F.col("threshold"))).alias("b"))
    value = lambda c, default: F.coalesce(F.col(f"b.{c}"), F.lit(default)).alias(c)
    return best.select(value("threshold", 0.5), value("precision", 0.0), value("recall", 0.0), value("f1", 0.0))


# ------------------------------------------------------------ bootstrap

_EXACT_COPIES = 16


def _poisson_one(u: Column) -> Column:
    """Inverse distribution of Poisson(1) at u."""
    rule, term, total = None, math.exp(-1), 0.0
    for k in range(17):
        total += term
        rule = F.when(u < total, k) if rule is None else rule.when(u < total, k)
        term /= k + 1
    return rule.otherwise(17)


def double_key(value: Column) -> Column:
    """A text that tells doubles apart: exponent and whole-number mantissa of 53 bits."""
    power = F.when(value != 0, F.floor(F.log2(F.abs(value)))).otherwise(0).cast("long")
    # In two steps, since 2 ** (52 - power) alone may exceed what a double holds.
    half = F.floor((F.lit(52) - power) / 2)
    whole = value * F.pow(F.lit(2.0), half) * F.pow(F.lit(2.0), F.lit(52) - power - half)
    return F.concat_ws("e", F.round(whole).cast("long").cast("string"), power.cast("string"))


def bootstrap_weights(counts: DataFrame, rounds: int, seed: int, keys: list[str]) -> DataFrame:
    """Resampled multiplicity (`weight`) of each counted group (`n` rows) per round.

    A resample with replacement gives a group of n equal rows a Poisson(n) weight.  Groups
    are collapsed first, so the work grows with distinct groups, not rows: up to 16 copies
    draw one Poisson(1) each, larger groups use the normal approximation.
    """
    each = counts.withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1))))
    parts = [F.lit("boot"), F.lit(str(seed)), F.col("round"), *[F.col(k) for k in keys]]
    copies = F.sequence(F.lit(1).cast("long"), F.col("n"))
    exact = F.aggregate(copies, F.lit(0).cast("long"),
                        lambda acc, j: acc + _poisson_one(uniform(*parts, j)))
    large = F.greatest(F.lit(0.0), F.floor(F.col("n") + F.sqrt("n") * normal(*parts) + 0.5))
    return each.withColumn(
        "weight", F.when(F.col("n") <= _EXACT_COPIES, exact).otherwise(large).cast("long"))


def bootstrap_ci(df: DataFrame, rounds: int = 100, seed: int = 42, label: str = "label",
                 prediction: str = "prediction", score: str = "score",
                 auc_step: float | None = None) -> DataFrame:
    """(metric, low, high): 95 % bootstrap intervals of f1, precision, recall and roc_auc.

    Precision, recall and f1 resample the four confusion cells.  The area resamples
    distinct (label, score) groups; auc_step rounds scores down to a multiple of it where
    a table holds too many distinct scores to carry every round.
    """
    scored = df.select(
        F.col(label).cast("int").alias("y"), F.col(prediction).cast("int").alias("p"),
        F.col(score).alias("score"))
    cells = bootstrap_weights(
        scored.groupBy("y", "p").agg(F.count("*").alias("n")), rounds, seed, ["y", "p"])
    by_cell = cells.groupBy("round").agg(*[
        F.coalesce(F.sum(F.when((F.col("y") == a) & (F.col("p") == b), F.col("weight"))), F.lit(0)).alias(c)
        for c, a, b in (("tn", 0, 0), ("fp", 0, 1), ("fn", 1, 0), ("tp", 1, 1))])
    rates = with_scores(by_cell).select(F.inline(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in ("f1", "precision", "recall")])))

    if auc_step:
        scored = scored.withColumn("score", F.floor(F.col("score") / auc_step) * auc_step)
    groups = scored.groupBy("y", "score").agg(F.count("*").alias("n")).withColumn("at", double_key(F.col("score")))
    drawn = bootstrap_weights(groups, rounds, seed, ["y", "at"]).filter("weight > 0")
    by_score = drawn.groupBy("round", "score").agg(
        F.coalesce(F.sum(F.when(F.col("y") == 1, F.col("weight"))), F.lit(0)).alias("pos"),
        F.coalesce(F.sum(F.when(F.col("y") == 0, F.col("weight"))), F.lit(0)).alias("neg"))
    auc = _areas(by_score, ["round"]).filter("roc_auc is not null").select(
        F.lit("roc_auc").alias("metric"), F.col("roc_auc").alias("value"))
    bounds = exact_quantiles(rates.unionByName(auc), ["metric"], "value", [0.025, 0.975])
    found = bounds.groupBy("metric").agg(
        F.min_by("quantile", "prob").alias("low"), F.max_by("quantile", "prob").alias("high"))
    names = df.sparkSession.createDataFrame([(m,) for m in ("f1", "precision", "recall", "roc_auc")], "metric string")
    return names.join(found, "metric", "left").fillna(0.0, ["low", "high"])


# ------------------------------------------------------------ scored rows

def band_scores(df: DataFrame, threshold: float, score: str = "score") -> DataFrame:
    """Add prediction, verdict and risk to scored rows."""
    p = F.col(score)
    out = df.withColumn("prediction", decide(p, threshold))
    return out.withColumns({"verdict": verdict(F.col("prediction")), "risk": risk_level(p)})


def scoring_summary(scored: DataFrame, score: str = "score", row_limit: int | None = None) -> DataFrame:
    """One row: rows received and scored, truncation, verdict counts, mean probability.

    row_limit is the reporting cap of an interactive scorer; None scores everything.
    """
    used = scored if row_limit is None else scored.limit(row_limit)
    one = used.agg(
        F.count("*").alias("rows_scored"), F.count_if(F.col("prediction") == 1).alias("attack_count"),
        F.count_if(F.col("prediction") == 0).alias("normal_count"),
        F.avg(score).alias("mean_attack_probability"))
    if row_limit is None:
        received = F.col("rows_scored")
        return one.select(received.alias("rows_received"), "rows_scored", F.lit(False).alias("truncated"),
                          "attack_count", "normal_count", "mean_attack_probability")
    total = scored.agg(F.count("*").alias("rows_received"))
    return total.withColumn("_one", F.lit(1)).join(one.withColumn("_one", F.lit(1)), "_one").select(
        "rows_received", "rows_scored", (F.col("rows_received") > F.col("rows_scored")).alias("truncated"),
        "attack_count", "normal_count", "mean_attack_probability")


def extreme_example(scored: DataFrame, kind: str = "attack", score: str = "score",
                    tie: str | None = None) -> DataFrame:
    """The surest row of a label: highest score for attacks, lowest for normal.

    `tie` orders rows of equal score, first wins.  A missing label falls back to all rows.
    """
    attack = kind.lower() == "attack"
    row = F.struct(*[F.col(c) for c in scored.columns])
    wanted = F.col("label") == (1 if attack else 0)
    best = F.col(score) if attack else -F.col(score)
    # One aggregate finds the row of the label and the fallback together.
    ordered = F.struct(wanted.cast("int").alias("w"), best.alias("s"))
    if tie is None:
        return scored.agg(F.max_by(row, ordered).alias("r")).select("r.*")
    top = scored.agg(F.max(ordered).alias("m"))
    return (
        scored.join(F.broadcast(top), (F.col("m.w") == wanted.cast("int")) & (F.col("m.s") == best))
        .agg(F.min_by(row, F.col(tie)).alias("r")).select("r.*"))


def relative_performance(f1: DataFrame) -> DataFrame:
    """(protocol, f1) lines with percent of the real_only line; a zero baseline counts as 1."""
    # A handful of lines, one per protocol.
    real = F.max(F.when(F.col("protocol") == "real_only", F.col("f1"))).over(Window.partitionBy(F.lit(1)))
    return f1.withColumn("base", real).select(
        "protocol", "f1",
        (F.col("f1") / F.when(F.col("base") != 0, F.col("base")).otherwise(1.0) * 100).alias("percent_of_real"))


def evaluation(scored: DataFrame, split: str, threshold: float, score: str = "score") -> DataFrame:
    """One row of headline metrics of a scored split."""
    judged = scored.withColumn("prediction", decide(F.col(score), threshold))
    cells = confusion_metrics(judged).withColumn("_one", F.lit(1))
    areas = ranking_areas(judged, score=score).withColumn("_one", F.lit(1))
    return cells.join(areas, "_one").drop("_one").select(
        F.lit(split).alias("split"), (F.col("tn") + F.col("fp") + F.col("fn") + F.col("tp")).alias("rows"),
        F.lit(float(threshold)).alias("decision_threshold"), "accuracy", "precision", "recall", "f1",
        "roc_auc", "average_precision", "tn", "fp", "fn", "tp")


