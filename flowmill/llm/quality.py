"""Quality classifier: histogram gradient-boosted trees over document statistics."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

FEATURES = ["log_words", "word_bytes", "distinct_words", "top_word", "upper", "digits", "symbols", "exclamations",
            "questions", "stops", "bars", "brackets", "other_marks", "non_ascii", "lines", "line_words",
            "repeated_lines", "entropy", "controls", "capital_words"]
# A model learns from at most this many labelled rows: those of the smallest hashed ids.
MAX_TRAINING_ROWS = 20_000


def _mask(chars: str | range) -> np.ndarray:
    mask = np.zeros(256)
    mask[[ord(c) if isinstance(c, str) else c for c in chars]] = 1
    return mask


CLASSES = np.stack([
    _mask(range(65, 91)), _mask(range(97, 123)), _mask(range(48, 58)), _mask("#*$%&<>|"), _mask("!"), _mask("?"),
    _mask(".,;:"), _mask("|"), _mask("()[]{}\"'"), _mask("+-/=@\\^_`~"), _mask(range(128, 256)),
    _mask([*range(0, 9), *range(14, 32), 127])])


def statistics(text: str) -> list[float]:
    """The features of a whole text; zeros for an empty one."""
    data = text.encode()
    found = data.split()
    n = len(found)
    if not n:
        return [0.0] * len(FEATURES)
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    upper, lower, digits, symbols, bang, ask, stops, bars, brackets, other, high, control = CLASSES @ counts
    size = len(data)
    shares = counts[counts > 0] / size
    by_word = Counter(found)
    lines = [x for x in data.split(b"\n") if x.strip()]
    return [np.log1p(n), sum(map(len, found)) / n, len(by_word) / n, max(by_word.values()) / n,
            upper / max(upper + lower, 1), digits / size, symbols / n, bang / n, ask / n, stops / n, bars / n,
            brackets / n, other / n, high / size, len(lines) / n, np.log1p(n / len(lines)),
            1 - len(set(lines)) / len(lines), float(-(shares * np.log2(shares)).sum()), control / size,
            sum(w[:1].isupper() for w in by_word) / len(by_word)]


@dataclass(frozen=True)
class Forest:
    """Trees as arrays: node k's children are 2k + 1 and 2k + 2; a row goes right above the threshold."""

    feature: np.ndarray  # trees x inner nodes
    threshold: np.ndarray
    leaf: np.ndarray  # trees x leaves
    start: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.start)
        rows = np.arange(len(x))
        depth = int(np.log2(self.leaf.shape[1])) if self.leaf.size else 0
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf):
            node = np.zeros(len(x), np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            total += leaf[node - (len(leaf) - 1)]
        return total

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -40, 40)))


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 80, depth: int = 4, rate: float = 0.2, bins: int = 64,
        ridge: float = 1.0, least_weight: float = 1.0) -> Forest:
    """Boosting on logistic loss. Features are cut into at most `bins` quantile bins once; each level
    sums gradients and curvatures per node, feature and bin and takes the best cut of every node.

    Labels of one class only, or none, give a forest without trees: 1 when no example is bad (there is
    nothing to reject), else the share of good ones with one of each added."""
    inner, leaves = 2 ** depth - 1, 2 ** depth
    if not len(y) or y.min() == y.max():
        share = (y.sum() + 1) / (len(y) + 2)
        none = np.zeros((0, inner))
        return Forest(none.astype(np.int64), none, np.zeros((0, leaves)),
                      40.0 if not len(y) or y.min() == 1 else float(np.log(share / (1 - share))))
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], 1)
    n, width = binned.shape
    offset = np.arange(width) * bins
    start = float(np.log(y.mean() / (1 - y.mean())))
    total = np.full(n, start)
    features, thresholds, values = [], [], []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-total))
        gradient, curve = p - y, p * (1 - p)
        node = np.zeros(n, np.int64)
        feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
        for level in range(depth):
            first, count = 2 ** level - 1, 2 ** level
            cell = ((node - first)[:, None] * (width * bins) + offset + binned).ravel()
            sums = [np.bincount(cell, np.repeat(w, width), count * width * bins).reshape(count, width, bins)
                    for w in (gradient, curve)]
            left = [np.cumsum(s, 2)[:, :, :-1] for s in sums]
            whole = [s.sum(2, keepdims=True) for s in sums]
            right = [w - s for w, s in zip(whole, left)]
            gain = sum(g * g / (h + ridge) for g, h in (left, right)) - whole[0] ** 2 / (whole[1] + ridge)
            gain[(left[1] < least_weight) | (right[1] < least_weight)] = -1
            flat = gain.reshape(count, -1)
            best = flat.argmax(1)
            for k in range(count):
                f, cut = divmod(int(best[k]), bins - 1)
                if flat[k, best[k]] > 1e-6 and cut < len(cuts[f]):
                    feature[first + k], threshold[first + k] = f, cuts[f][cut]
            node = 2 * node + 1 + (x[np.arange(n), feature[node]] > threshold[node])
        where = node - inner
        leaf = -rate * np.bincount(where, gradient, leaves) / (np.bincount(where, curve, leaves) + ridge)
        total += leaf[where]
        features.append(feature), thresholds.append(threshold), values.append(leaf)
    return Forest(np.array(features), np.array(thresholds), np.array(values), start)


def _margins(forest: Forest, x: np.ndarray) -> np.ndarray:
    """Margins after 0, 1, 2, ... trees, a row each."""
    steps = [Forest(forest.feature[k:k + 1], forest.threshold[k:k + 1], forest.leaf[k:k + 1], 0.0).margin(x)
             for k in range(len(forest.leaf))]
    return forest.start + np.cumsum(np.array([np.zeros(len(x)), *steps]), axis=0)


def fit_folds(x: np.ndarray, y: np.ndarray, folds: int = 5, **options) -> Forest:
    """The mean of `folds` boosted forests. Each learns without one fold of the rows and keeps the number of
    rounds after which its loss on that fold is least, so that few examples, on which boosting would run into
    its own noise, are treated by the same rule as many."""
    if not len(y) or y.min() == y.max():
        return fit(x, y, **options)
    parts = []
    for k in range(folds):
        out = np.arange(len(y)) % folds == k
        forest = fit(x[~out], y[~out], **options)
        if not len(forest.leaf):  # one class is in this fold only
            share = (y[~out].sum() + 1) / ((~out).sum() + 2)
            forest = Forest(forest.feature, forest.threshold, forest.leaf, float(np.log(share / (1 - share))))
        elif out.any():
            loss = np.logaddexp(0, -_margins(forest, x[out]) * (2 * y[out] - 1)).mean(1)
            n = max(1, int(loss.argmin()))
            forest = Forest(forest.feature[:n], forest.threshold[:n], forest.leaf[:n], forest.start)
        parts.append(forest)
    return Forest(np.concatenate([f.feature for f in parts]), np.concatenate([f.threshold for f in parts]),
                  np.concatenate([f.leaf for f in parts]) / folds, float(np.mean([f.start for f in parts])))


def held_out(doc_id):
    """Rows whose labels are never learnt: crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, limit: int = MAX_TRAINING_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of at most `limit` labelled documents outside the held-out fold, a set that
    depends on their ids only. Ids with null or contradictory labels are left out; an id with several texts
    gives the least of them."""
    known = (labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
             .groupBy("doc_id").agg(F.min("quality").alias("low"), F.max("quality").alias("quality"))
             .where(F.col("low") == F.col("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
             .select(F.col("doc_id").alias("label_id"), "quality"))
    schema = T.StructType([T.StructField("quality", T.IntegerType()),
                           *[T.StructField(f, T.DoubleType()) for f in FEATURES]])

    def run(batches):
        for batch in batches:
            x = np.array([statistics(t or "") for t in batch.column("text").to_pylist()]).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column("quality").cast(pa.int32()),
                                              *[pa.array(c, pa.float64()) for c in x.T]], names=schema.names)

    rows = (docs.select("doc_id", "text").join(known, F.col("doc_id") == F.col("label_id")).groupBy("label_id")
            .agg(F.max("quality").alias("quality"), F.min("text").alias("text"))
            .select("quality", "text").mapInArrow(run, schema).toPandas().to_numpy())
    rows = rows.reshape(-1, len(FEATURES) + 1)
    rows = rows[np.lexsort(rows.T)]  # the sums of training do not depend on the order of tasks
    return rows[:, 1:], rows[:, 0]


def score_documents(docs: DataFrame, forest: Forest) -> DataFrame:
    """The columns of `docs` and `score`, from 0 to 1; higher means likelier good.

    One pass without a shuffle; statistics are of whole texts. Null texts count as empty; an empty text
    has a score too. Nothing but `text` is read. A column named score is replaced."""
    columns = [c for c in docs.columns if c != "score"]
    schema = T.StructType([*[docs.schema[c] for c in columns], T.StructField("score", T.DoubleType())])

    def run(batches):
        for batch in batches:
            x = np.array([statistics(t or "") for t in batch.column("text").to_pylist()]).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in columns], pa.array(forest.score(x))],
                                             names=schema.names)

    return docs.select(*columns).mapInArrow(run, schema)


def classify(docs: DataFrame, labels: DataFrame, limit: int = MAX_TRAINING_ROWS) -> DataFrame:
    """`docs` with the score of a model learnt from the labels of its own documents.

    A row's score depends on its text and the model alone: rows with equal texts tie, repeated rows and ids keep a row
    each, null texts count as empty. Without documents the result is empty; without labels, or with good ones only,
    every score is near 1. Values equal to a threshold go left. A given column named score is replaced, all others stay."""
    return score_documents(docs, fit_folds(*training_rows(docs, labels, limit)))
