"""Toxicity by a classifier chain: linear models predict one category after another.

Each model's features are hashed words, their beginnings, and the probabilities of the categories before it. While fitting, these come from models that
haven't seen the document (out of fold), so a later model learns how far an earlier one can be trusted on new documents. The models of a
category, one for each fold and one for all rows, are fitted side by side, a task each, on a bounded number of labelled documents; scoring
runs over all documents.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize
from .rows import core, own_cache

DIMENSIONS = 1 << 17
#: Letters of a word's beginning that are a feature too: words of one stem count together.
PREFIX = 4


def features(text: Column, dimensions: int) -> Column:
    """Distinct hashed words of a text in lower case, and their beginnings, as array<int>; an empty array for null."""
    found = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    found = F.array_distinct(F.concat(found, F.transform(found, lambda w: F.concat(F.lit("<"), F.substring(w, 1, PREFIX)))))
    return F.array_distinct(F.transform(found, lambda w: F.pmod(F.xxhash64(w), F.lit(dimensions)).cast("int")))


def margins(values: np.ndarray, offsets: np.ndarray, before: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Linear scores of documents: their words' weights, those of the categories before, and a constant (the last weight)."""
    n = before.shape[1]
    sums = np.concatenate([[0.0], np.cumsum(weights[values])])
    return sums[offsets[1:]] - sums[offsets[:-1]] + before @ weights[len(weights) - 1 - n:-1] + weights[-1]


def logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit_weights(words: list[np.ndarray], before: np.ndarray, wanted: np.ndarray, dimensions: int, epochs: int = 10, rate: float = 0.3,
                decay: float = 1e-4, batch: int = 64, start: float = 1e-2, smooth: float = 3.0) -> np.ndarray:
    """Weights of a logistic regression, fitted by AdaGrad in small batches; the same rows give the same weights.

    A word's feature is its log ratio of occurrence in wanted and other documents, smoothed by ``smooth`` documents, so words that mark
    a category outweigh the many that say nothing. The ratio is folded into the weights that are returned.
    """
    n = before.shape[1]
    yes, total = np.zeros(dimensions, dtype=np.int64), np.zeros(dimensions, dtype=np.int64)
    for i in range(0, len(words), 256):
        values = np.concatenate(words[i:i + 256])
        marked = np.repeat(wanted[i:i + 256] > 0.5, np.fromiter(map(len, words[i:i + 256]), dtype=np.int64))
        total += np.bincount(values, minlength=dimensions)
        yes += np.bincount(values[marked], minlength=dimensions)
    base = (wanted.sum() + 1) / (len(wanted) + 2)
    scale = np.log((yes + smooth * base) / (total - yes + smooth * (1 - base))) - np.log(base / (1 - base))
    scale = np.concatenate([scale, np.ones(n + 1)])
    weights, seen = np.zeros(dimensions + n + 1), np.full(dimensions + n + 1, start)
    weights[-1] = np.log(base / (1 - base))
    order = np.random.default_rng(17)
    for _ in range(epochs):
        mixed = order.permutation(len(words))
        for i in range(0, len(words), batch):
            at = mixed[i:i + batch]
            rows = [words[k] for k in at]
            lengths = np.fromiter(map(len, rows), dtype=np.int64, count=len(rows))
            values, offsets = np.concatenate(rows).astype(np.int64), np.concatenate([[0], np.cumsum(lengths)])
            # only the words at hand are scaled
            sums = np.concatenate([[0.0], np.cumsum(weights[values] * scale[values])])
            score = sums[offsets[1:]] - sums[offsets[:-1]] + before[at] @ weights[dimensions:dimensions + n] + weights[-1]
            error = logistic(score) - wanted[at]
            index, place = np.unique(values, return_inverse=True)
            slope = np.bincount(place, weights=np.repeat(error, lengths), minlength=len(index)) * scale[index]
            index = np.concatenate([index, np.arange(dimensions, dimensions + n + 1)])
            slope = np.concatenate([slope, error @ before[at], [error.sum()]]) / len(at) + decay * weights[index]
            seen[index] += slope * slope
            weights[index] -= rate * slope / np.sqrt(seen[index])
    return weights * scale


@dataclass
class Chain:
    """A fitted chain: the categories in order, their weights (None where no label was given), and the last one's threshold."""
    categories: list[str]
    weights: list[np.ndarray | None]
    dimensions: int
    threshold: float

    def probabilities(self, text: Column) -> Column:
        """struct<p_<category>..> of a text; a null or empty one has no words."""
        chain = [w if w is None else w.astype(np.float32) for w in self.weights]
        names = [f"p_{c}" for c in self.categories]
        return _predicted(features(text, self.dimensions), F.lit(0), [], names, lambda k, _: chain[k])

    def rejects(self, text: Column) -> Column:
        """Whether the last category's probability is at the threshold or above."""
        return self.probabilities(text)[f"p_{self.categories[-1]}"] >= self.threshold

    def score(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """(doc_id, text, p_<category>.., rejected), one row per row; a null or empty text is one without words.

        ``rejected`` is the last category's probability against the threshold. Repeated rows stay, other columns are left out.
        """
        rows = core(docs, doc_id=id_col, text=text_col).withColumn("_p", self.probabilities(F.col("text")))
        return rows.select("doc_id", "text", "_p.*").withColumn("rejected", F.col(f"p_{self.categories[-1]}") >= self.threshold)


def _predicted(words: Column, fold: Column, known: list[Column], names: list[str], weights_of, rows: int = 1024) -> Column:
    """struct of the probabilities ``names``, one category after another; ``weights_of(k, fold)`` has the weights of the k-th of them.

    ``known`` has the probabilities of the categories before. Only features go to Python, ``rows`` documents at a time.
    """
    def part(words: pa.ListArray, folds: np.ndarray, known: list[np.ndarray]) -> list[np.ndarray]:
        values, offsets = words.flatten().to_numpy(), words.offsets.to_numpy()
        offsets, found = offsets - offsets[0], []
        for k in range(len(names)):
            before = np.column_stack([*known, *found, np.empty((len(words), 0))])
            p = np.zeros(len(words))
            for fold in np.unique(folds):
                if (w := weights_of(k, fold)) is not None:
                    at = folds == fold
                    p[at] = logistic(margins(values, offsets, before, w))[at]
            found.append(p)
        return found

    @F.arrow_udf(T.StructType([T.StructField(n, T.DoubleType()) for n in names]))
    def predict(words: pa.Array, fold: pa.Array, *known: pa.Array) -> pa.Array:
        own_cache("chain", {})
        folds, known = fold.to_numpy(zero_copy_only=False), [x.to_numpy(zero_copy_only=False) for x in known]
        parts = [part(words.slice(i, rows), folds[i:i + rows], [x[i:i + rows] for x in known]) for i in range(0, len(words), rows)]
        return pa.StructArray.from_arrays([pa.array(np.concatenate([p[k] for p in parts])) for k in range(len(names))], names=names)
    return predict(words, fold, *known)


def _fitter(before: list[str], wanted: str, dimensions: int):
    def fit(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        own_cache("chain", {})
        # the words stay in their Arrow buffer; rows are views of it
        words = rows["_words"].combine_chunks()
        values, offsets = words.values.to_numpy(), words.offsets.to_numpy()
        order = np.argsort(rows["_order"].to_numpy(), kind="stable")
        earlier = np.column_stack([*(rows[b].to_numpy()[order] for b in before), np.empty((len(order), 0))])
        fitted = fit_weights([values[offsets[i]:offsets[i + 1]] for i in order], earlier, rows[wanted].to_numpy()[order], dimensions)
        return pa.table({"model": pa.array([key[0].as_py()], pa.int32()), "weights": pa.array([fitted], pa.list_(pa.float64()))})
    return fit


def fit_chain(docs: DataFrame, labels: DataFrame, categories: list[str], max_labelled: int = 20_000, folds: int = 3, dimensions: int = DIMENSIONS,
              id_col: str = "doc_id", text_col: str = "text") -> Chain:
    """Fit on at most ``max_labelled`` labelled documents, those whose ids have the smallest hashes.

    ``labels`` has ``id_col`` and a 0/1 column for each category, in the order of the chain; the last is the one that rejects. Rows with a
    null id or label are left out, a repeated id counts once. The threshold is where the out-of-fold predictions have their best F1. With
    no labelled document all probabilities are 0.
    """
    marks = labels.select(labels[id_col].alias("doc_id"), *[labels[c].cast("double").alias(f"y_{c}") for c in categories]).dropna()
    marks = marks.dropDuplicates(["doc_id"]).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    known = core(docs, doc_id=id_col, text=text_col).join(F.broadcast(marks), "doc_id")  # at most max_labelled rows of a few numbers
    fold = F.pmod(F.xxhash64(F.lit(7), F.col("doc_id")), F.lit(folds)).cast("int")
    data = materialize(known.select(features(F.col("text"), dimensions).alias("_words"), fold.alias("_fold"), F.xxhash64("doc_id").alias("_order"),
                                    *[f"y_{c}" for c in categories]), "labelled")
    names = [f"p_{c}" for c in categories]
    chain = []
    for k, name in enumerate(categories):
        # model m leaves out fold m; the last one leaves out none
        uses = F.filter(F.sequence(F.lit(0), F.lit(folds)), lambda m: m != F.col("_fold"))
        fitted = data.withColumn("model", F.explode(uses)).groupBy("model").applyInArrow(
            _fitter(names[:k], f"y_{name}", dimensions), "model int, weights array<double>")
        models = {r["model"]: np.asarray(r["weights"]) for r in fitted.collect()}
        chain.append(models.get(folds))
        predicted = _predicted(F.col("_words"), F.col("_fold"), [F.col(n) for n in names[:k]], [names[k]], lambda _, fold, models=models: models.get(int(fold)))
        data = materialize(data.withColumn(names[k], predicted[names[k]]), "labelled")
    return Chain(list(categories), chain, dimensions, _best_threshold(data, categories[-1]))


def _best_threshold(data: DataFrame, name: str, steps: int = 100) -> float:
    """The probability, of ``steps`` even ones, from which rejecting has the best F1; the middle one of equals."""
    step = F.least(F.floor(F.col(f"p_{name}") * steps), F.lit(steps - 1)).cast("int")
    counts = {r["step"]: (r["yes"], r["n"]) for r in data.groupBy(step.alias("step")).agg(F.sum(f"y_{name}").alias("yes"), F.count("*").alias("n")).collect()}
    positives = sum(yes for yes, _ in counts.values())
    scores = []
    for t in range(1, steps):
        hit = sum(yes for s, (yes, _) in counts.items() if s >= t)
        flagged = sum(n for s, (_, n) in counts.items() if s >= t)
        scores.append(2 * hit / (flagged + positives) if flagged + positives else 0.0)
    best = [t for t, s in enumerate(scores, 1) if s >= max(scores) - 1e-12]
    return best[len(best) // 2] / steps
