"""Toxicity by a classifier chain over words.

Each category has a sparse linear model of its own. The first one sees the
words of a text, every later one also the probabilities that the models before
it gave. In training these come from models that were fitted without the text
(out of fold), so a later model learns how far its forerunners can be trusted.

The models are fitted on the driver on a bounded sample of labelled rows, chosen
by a hash of the id (`SAMPLE_ROWS`, a parameter): words that occur in few of
them are left out, and the fit sets the weights of words that say nothing to
zero. All documents are scored, whole, each in its own row.

Nulls and the like: a null or empty text has no words and gets the base rate;
rows with a null label are left out of the sample of that category; repeated
rows are scored alike. Without any labelled row nothing is toxic. Extra columns
are carried along; those named like a result column are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import column_or_null, fields
from corpusmill.session import spool

SAMPLE_ROWS = 4000
#: Documents of the sample that a word must occur in.
MIN_DOCUMENTS = 3
#: Letters of the beginnings that count as features beside the words.
BEGINNINGS = (4, 5, 6)
#: How many standard errors and times a feature must be more frequent in a category than in all texts.
STANDS_OUT = 3.0
TIMES = 2.0
FOLDS = 5
ROUNDS = 150
#: Weight of the absolute sum of the weights in the fit.
SPARSITY = 2e-4
#: The limit is the highest that finds `RECALL` of the sample's toxic texts out of fold, but none that takes more than
#: `FALSE_ALARMS` of its other texts; `LIMIT` stands without such texts.
RECALL, FALSE_ALARMS = 0.95, 0.0125
LIMIT = 0.4

_WORD = re.compile(r"[^\W\d_]+")


def features(words: set[str]) -> set[str]:
    """The words and their beginnings, by which inflected forms are known."""
    return words.union(*({w[:k] + "-" for w in words if len(w) > k} for k in BEGINNINGS))


def words_of(text: str | None) -> set[str]:
    return set(_WORD.findall((text or "").lower()))


@dataclass
class LinearModel:
    bias: float = -20.0
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))


@dataclass
class Chain:
    """Models of the categories, in order; `vocabulary` numbers the words, earlier probabilities come after them."""
    categories: Sequence[str]
    vocabulary: dict[str, int]
    models: list[LinearModel]
    limit: float = LIMIT

    def probabilities(self, words: set[str]) -> list[float]:
        at = [self.vocabulary[w] for w in words if w in self.vocabulary]
        earlier: list[float] = []
        n = len(self.vocabulary)
        for model in self.models:
            score = model.bias
            if len(model.weights):
                score += float(model.weights[at].sum() + model.weights[n:n + len(earlier)] @ np.array(earlier))
            earlier.append(1 / (1 + np.exp(-np.clip(score, -30, 30))))
        return earlier


class Rows:
    """Sparse rows of ones at word numbers, and dense columns after them."""

    def __init__(self, words: list[np.ndarray], n_words: int, dense: np.ndarray):
        self.row = np.repeat(np.arange(len(words)), [len(w) for w in words])
        self.column = np.concatenate(words) if words else np.zeros(0, dtype=np.int64)
        self.n_words, self.dense = n_words, dense

    def scores(self, weights: np.ndarray) -> np.ndarray:
        sparse = np.bincount(self.row, weights[self.column], minlength=len(self.dense))
        return sparse + self.dense @ weights[self.n_words:]

    def gradient(self, residual: np.ndarray) -> np.ndarray:
        sparse = np.bincount(self.column, residual[self.row], minlength=self.n_words)
        return np.concatenate([sparse, self.dense.T @ residual])


def fit(rows: Rows, target: np.ndarray, rounds: int = ROUNDS) -> LinearModel:
    """Logistic regression with sparse weights, by accelerated proximal steps."""
    n = len(target)
    width = rows.n_words + rows.dense.shape[1]
    if not n or target.min() == target.max():
        return LinearModel(bias=20.0 if n and target[0] else -20.0, weights=np.zeros(width))
    weights, bias = np.zeros(width), float(np.log(target.mean() / (1 - target.mean())))
    ahead, bias_ahead, t = weights, bias, 1.0
    # Each coordinate has a step of its own: a common word may move less than a rare one.
    seen = np.bincount(rows.column, minlength=rows.n_words)
    curvature = np.concatenate([seen, (rows.dense ** 2).sum(axis=0)]) / n
    per_row = max(1.0, float(np.bincount(rows.row, minlength=n).mean()) / 8)
    step = 1 / (0.25 * per_row * np.maximum(curvature, 4 / n))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(rows.scores(ahead) + bias_ahead, -30, 30)))
        residual = (p - target) / n
        moved = ahead - step * rows.gradient(residual)
        new = np.sign(moved) * np.maximum(np.abs(moved) - step * SPARSITY, 0)
        new_bias = bias_ahead - residual.sum() * 4 / per_row
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead = new + (t - 1) / t_new * (new - weights)
        bias_ahead = new_bias + (t - 1) / t_new * (new_bias - bias)
        weights, bias, t = new, new_bias, t_new
    return LinearModel(bias, weights)


def _stands_out(total: Column, within: Column, texts: int, hits: int) -> Column:
    """Whether a feature in `total` of the texts is in more of a category's `hits` than chance explains."""
    share = total / max(texts, 1)
    expected = share * hits
    return (within > expected * TIMES) & (within - expected > F.sqrt(expected * (1 - share) + 1e-9) * STANDS_OUT)


def train(texts: list[np.ndarray], labels: np.ndarray, vocabulary: Sequence[str], categories: Sequence[str], folds: int = FOLDS) -> Chain:
    """The chain from the numbers of each text's features and a table of labels (0, 1, or nan) with a column for each category."""
    fold = np.arange(len(texts)) % folds
    earlier = np.zeros((len(texts), 0))
    models = []
    for j in range(len(categories)):
        known = ~np.isnan(labels[:, j])

        def rows(mask: np.ndarray, dense: np.ndarray = earlier) -> Rows:
            return Rows([t for t, m in zip(texts, mask, strict=True) if m], len(vocabulary), dense[mask])

        models.append(fit(rows(known), labels[known, j]))
        out_of_fold = np.zeros(len(texts))
        for f in range(folds):
            rest = known & (fold != f)
            model = fit(rows(rest), labels[rest, j])
            held = fold == f
            out_of_fold[held] = 1 / (1 + np.exp(-np.clip(rows(held).scores(model.weights) + model.bias, -30, 30)))
        earlier = np.column_stack([earlier, out_of_fold])
    # Words without any weight are dropped: what is sent out is small.
    used = sorted(i for i in range(len(vocabulary)) if any(len(m.weights) and m.weights[i] for m in models))
    n = len(vocabulary)
    small = [LinearModel(m.bias, np.concatenate([m.weights[used], m.weights[n:]])) for m in models]
    return Chain(list(categories), {vocabulary[i]: k for k, i in enumerate(used)}, small, chosen_limit(earlier, labels))


def chosen_limit(out_of_fold: np.ndarray, labels: np.ndarray) -> float:
    """The limit for the highest probability of a text, from probabilities by models that were fitted without it."""
    toxic, other = (labels == 1).any(axis=1), (labels == 0).all(axis=1)
    if not toxic.any() or not other.any():
        return LIMIT
    best = out_of_fold.max(axis=1)
    found = float(np.quantile(best[toxic], 1 - RECALL, method="lower"))
    spared = float(np.quantile(best[other], 1 - FALSE_ALARMS, method="higher"))
    return max(found, np.nextafter(spared, 1))


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [sorted(features(words_of(t))) for t in batch.column("text").to_pylist()]
        names = [n for n in batch.schema.names if n != "text"]
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(found, pa.list_(pa.string()))], names=[*names, "features"])


def _numbers(place: dict[str, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sorted(place[w] for w in text if w in place) for text in batch.column("features").to_pylist()]
            names = [n for n in batch.schema.names if n != "features"]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(found, pa.list_(pa.int64()))], names=[*names, "numbers"])
    return run


def labelled_sample(docs: DataFrame, labels: DataFrame, categories: Sequence[str], rows: int = SAMPLE_ROWS, id_col: str = "doc_id",
                    text_col: str = "text") -> tuple[list[np.ndarray], np.ndarray, list[str]]:
    """(feature numbers, labels, features) of at most `rows` labelled documents; `labels` has the id and a 0/1 column per category.

    The features of the sample are counted and chosen on the executors; what comes here is the features that stand
    out and, for each text, their numbers. Of several documents with one id the text with the smallest hash counts.
    """
    names = [f"label_{i}" for i in range(len(categories))]
    chosen = labels.where(F.col(id_col).isNotNull()).dropDuplicates([id_col]).orderBy(F.xxhash64(id_col), id_col).limit(rows)
    chosen = chosen.select(F.col(id_col).alias("label_id"), *[F.col(c).cast("double").alias(n) for c, n in zip(categories, names, strict=True)])
    text = F.coalesce(column_or_null(docs, text_col, "string"), F.lit(""))
    found = docs.select(F.col(f"`{id_col}`").alias("label_id"), text.alias("text")).join(F.broadcast(chosen), "label_id").groupBy(
        "label_id", *names).agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
    kinds = docs.schema[id_col].dataType.simpleString()
    sample = spool(found.mapInArrow(_features, f"label_id {kinds}, {', '.join(f'{n} double' for n in names)}, features array<string>"), "sample")
    totals = sample.agg(F.count(F.lit(1)), *[F.sum((F.col(n) == 1).cast("int")) for n in names]).first()
    n, hits = totals[0], [t or 0 for t in totals[1:]]
    counts = sample.select(*names, F.explode("features").alias("feature")).groupBy("feature").agg(
        F.count(F.lit(1)).alias("total"), *[F.sum((F.col(c) == 1).cast("int")).alias(c) for c in names])
    out = F.lit(False)
    for c, h in zip(names, hits, strict=True):
        out = out | F.coalesce(_stands_out(F.col("total"), F.col(c), n, h), F.lit(False))
    vocabulary = sorted(r["feature"] for r in counts.where((F.col("total") >= MIN_DOCUMENTS) & out).select("feature").collect())
    numbered = sample.mapInArrow(_numbers({w: i for i, w in enumerate(vocabulary)}),
                                 f"label_id {kinds}, {', '.join(f'{n} double' for n in names)}, numbers array<long>")
    kept = numbered.orderBy(F.xxhash64("label_id"), "label_id").select(*names, "numbers").collect()
    values = np.array([[np.nan if v is None else v for v in r[:-1]] for r in kept], dtype=np.float64)
    return [np.array(r["numbers"], dtype=np.int64) for r in kept], values.reshape(len(kept), len(categories)), vocabulary


def _scored(chain: Chain):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = chain.vocabulary.keys()
        for batch in batches:
            scores = [chain.probabilities(features(words_of(t)) & known) for t in batch.column("_text").to_pylist()]
            added = [pa.array([s[j] for s in scores], pa.float64()) for j in range(len(chain.categories))]
            toxic = pa.array([max(s) >= chain.limit for s in scores], pa.bool_())
            names = [n for n in batch.schema.names if n != "_text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), *added, toxic],
                                             names=[*names, *(f"p_{c}" for c in chain.categories), "is_toxic"])
    return run


def toxicity(docs: DataFrame, chain: Chain, text_col: str = "text") -> DataFrame:
    """The documents with `p_<category>` for each category and `is_toxic`: whether one reaches the limit."""
    results = [f"p_{c}" for c in chain.categories] + ["is_toxic"]
    kept = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in (*results, "_text")])
    rows = kept.withColumn("_text", column_or_null(docs, text_col, "string"))
    schema = fields(kept, ", ".join([f"p_{c} double" for c in chain.categories] + ["is_toxic boolean"]))
    return rows.mapInArrow(_scored(chain), schema)


#: The languages whose toxic texts are categories of their own; the last category is toxic in any language.
LANGUAGES = ("en", "de", "fr", "es")
CATEGORIES = (*(f"toxic_{x}" for x in LANGUAGES), "toxic")


def toxicity_labels(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The id and a 0/1 column per category for each labelled document."""
    spoken = docs.select("doc_id", column_or_null(docs, "lang", "string").alias("lang"))
    toxic = F.col("toxic").cast("int")
    return labels.select("doc_id", "toxic").join(spoken, "doc_id").select(
        "doc_id", *[(toxic * (F.coalesce("lang", F.lit("")) == x).cast("int")).alias(f"toxic_{x}") for x in LANGUAGES],
        toxic.alias("toxic"))


def fitted(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Chain:
    """The chain for the given tables."""
    return train(*labelled_sample(docs, toxicity_labels(docs, labels), CATEGORIES, rows), CATEGORIES)
