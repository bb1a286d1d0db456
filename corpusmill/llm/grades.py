"""Quality grades by ordinal regression on hashed words.

A cumulative-link model has one set of weights for all grades and one threshold
between each two neighbouring grades: the probability of a grade above the k-th
is the logistic function of the text's score less the k-th threshold. The
thresholds are kept in order by fitting the gaps between them. The score of a
text is the mean weight of its words; a word has a hashed weight for itself and
one for its shape (letters and digits by kind, marks as they are), and a text
has some for its length and its variety.

The model is fitted on the driver on a bounded sample of graded rows, chosen by
a hash of the id (`SAMPLE_ROWS`, a parameter). All documents are graded, whole,
each in its own row: the expected grade, the probability of a grade of at least
`AT_LEAST`, and whether that reaches `LIMIT`.

Nulls and the like: a null or empty text has no words and is graded by its
length alone; rows without a rating are left out of the sample; without any
rating every text gets the highest grade. Repeated rows are graded alike. Extra
columns are carried along; those named like a result column are replaced.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import column_or_null, fields
from corpusmill.llm.hashing import binary

SAMPLE_ROWS = 4000
WEIGHTS = 1 << 18
REMEMBERED = 400_000
ROUNDS = 200
RATE = 0.3
DECAY = 1e-4
#: How much the mean over a text's words counts against its other features.
WORD_SCALE = 8.0
#: Grades there are, and the one from which a text is kept.
GRADES, AT_LEAST = 3, 2
LIMIT = 0.5
RESULTS = ("expected_grade", "tail_probability", "kept")

_SHAPES = ((re.compile(rb"[a-z\x80-\xff]+"), b"a"), (re.compile(rb"[A-Z]{2,}"), b"AA"), (re.compile(rb"[A-Z]"), b"A"),
           (re.compile(rb"[0-9]+"), b"0"))


def _place(name: bytes) -> int:
    return xxhash.xxh64_intdigest(name) % WEIGHTS


def word_places(word: bytes) -> tuple[int, int]:
    shape = word
    for pattern, sign in _SHAPES:
        shape = pattern.sub(sign, shape)
    return _place(b"w" + word), _place(b"s" + shape)


def text_places(words: list[bytes]) -> list[int]:
    """Features of the text as a whole: its length, and how many of its words are different."""
    variety = round(10 * len(set(words)) / len(words)) if words else 0
    return [_place(b"n%d" % len(words).bit_length()), _place(b"v%d" % variety)]


@dataclass
class Grades:
    weights: np.ndarray
    thresholds: np.ndarray

    def above(self, scores: np.ndarray) -> np.ndarray:
        """Probability of a grade above each threshold, one column for each."""
        return 1 / (1 + np.exp(-np.clip(scores[:, None] - self.thresholds[None, :], -30, 30)))


def _design(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, place, value) of all features; a few bytes for each, no object."""
    rows, places, values = [], [], []
    for i, text in enumerate(texts):
        words = text.split()
        found = np.fromiter((p for w in words for p in word_places(w)), dtype=np.int32)
        at, times = np.unique(found, return_counts=True)
        whole = np.array(text_places(words), dtype=np.int32)
        rows.append(np.full(len(at) + len(whole), i, dtype=np.int32))
        places.append(np.concatenate([at, whole]))
        values.append(np.concatenate([WORD_SCALE * times / max(len(words), 1), np.ones(len(whole))]))
    return np.concatenate(rows), np.concatenate(places), np.concatenate(values)


def rating(text: bytes, quality: int) -> int:
    """2 for a good text; of the others 1 where it has the outer form of one, 0 where it is too short or repeats itself."""
    if quality:
        return 2
    words = text.split()
    windows = [tuple(words[k:k + 3]) for k in range(len(words) - 2)]
    times = Counter(windows)
    repeated = {k + j for k, w in enumerate(windows) if times[w] > 1 for j in range(3)}
    return 0 if len(words) < 50 or 2 * len(repeated) > len(words) else 1


def fit(texts: list[bytes], ratings: np.ndarray, n_grades: int, rounds: int = ROUNDS) -> Grades:
    """Weights and ordered thresholds by adaptive gradient steps on the likelihood of the ratings."""
    weights, base, gaps = np.zeros(WEIGHTS), 0.0, np.zeros(max(n_grades - 2, 0))
    if not len(texts):
        return Grades(weights, np.full(n_grades - 1, -30.0))
    row, place, value = _design(texts)
    n = len(texts)
    state = [np.full(WEIGHTS, 1e-8), 1e-8, np.full(len(gaps), 1e-8)]
    grades = np.arange(n_grades - 1)
    for _ in range(rounds):
        thresholds = base + np.concatenate([[0.0], np.cumsum(np.exp(gaps))])
        score = np.bincount(row, weights[place] * value, minlength=n)
        up = 1 / (1 + np.exp(-np.clip(score[:, None] - thresholds[None, :], -30, 30)))
        full = np.column_stack([np.ones(n), up, np.zeros(n)])
        at = ratings
        chance = np.maximum(full[np.arange(n), at] - full[np.arange(n), at + 1], 1e-9)
        slope = up * (1 - up)
        d_up = np.zeros_like(up)  # of the negative log likelihood by each probability of being above
        lower, upper = at > 0, at < n_grades - 1
        d_up[np.flatnonzero(lower), at[lower] - 1] -= 1 / chance[lower]
        d_up[np.flatnonzero(upper), at[upper]] += 1 / chance[upper]
        pull = d_up * slope / n
        by_score, by_threshold = pull.sum(axis=1), -pull.sum(axis=0)
        grad = np.bincount(place, by_score[row] * value, minlength=WEIGHTS) + DECAY * weights
        grad_base = float(by_threshold.sum())
        grad_gaps = np.array([by_threshold[grades > k].sum() * np.exp(gaps[k]) for k in range(len(gaps))])
        state = [s + g * g for s, g in zip(state, (grad, grad_base, grad_gaps), strict=True)]
        weights = weights - RATE * grad / np.sqrt(state[0])
        base -= RATE * grad_base / np.sqrt(state[1])
        gaps = gaps - RATE * grad_gaps / np.sqrt(state[2])
    return Grades(weights, base + np.concatenate([[0.0], np.cumsum(np.exp(gaps))]))


def _scores(model: Grades, texts: list[bytes], known: dict[bytes, float]) -> np.ndarray:
    weights, out = model.weights, np.zeros(len(texts))
    for i, text in enumerate(texts):
        words = text.split()
        for w in set(words).difference(known):
            if len(known) >= REMEMBERED:
                known.clear()
                known.update((v, float(weights[list(word_places(v))].sum())) for v in set(words))
                break
            a, b = word_places(w)
            known[w] = float(weights[a] + weights[b])
        mean = sum(map(known.__getitem__, words)) / max(len(words), 1)
        out[i] = WORD_SCALE * mean + sum(float(weights[p]) for p in text_places(words))
    return out


def _graded(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, known = shared.value, {}
        for batch in batches:
            up = model.above(_scores(model, [t or b"" for t in binary(batch.column("_text"))], known))
            tail = up[:, AT_LEAST - 1]
            names = [n for n in batch.schema.names if n != "_text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(up.sum(axis=1)), pa.array(tail),
                                              pa.array(tail >= LIMIT)], names=[*names, *RESULTS])
    return run


def grade(docs: DataFrame, model: Grades, text_col: str = "text") -> DataFrame:
    """The documents with `expected_grade`, `tail_probability` and `kept`."""
    kept = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in (*RESULTS, "_text")])
    rows = kept.withColumn("_text", column_or_null(docs, text_col, "string"))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2 MB
    return rows.mapInArrow(_graded(shared), fields(kept, "expected_grade double, tail_probability double, kept boolean"))


def fitted_grades(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Grades:
    """Grades 0 (poor at sight), 1 (poor in its words) and 2 (good) from the given labels."""
    rated = labels.where("doc_id is not null and quality is not null").dropDuplicates(["doc_id"])
    chosen = rated.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows).select("doc_id", F.col("quality").cast("int").alias("quality"))
    text = F.coalesce(column_or_null(docs, "text", "string"), F.lit(""))
    sample = docs.select("doc_id", text.alias("text")).join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "quality").agg(
        F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
    got = [(r["text"].encode(), r["quality"]) for r in sample.orderBy(F.xxhash64("doc_id"), "doc_id").collect()]
    return fit([t for t, _ in got], np.array([rating(t, q) for t, q in got], dtype=np.int64), GRADES)
