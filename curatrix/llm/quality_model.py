"""Operator 6: quality by supervised subword embeddings.

Every word has the embeddings of its hashed self and of its hashed character n-grams; a word that repeats the one before it also has
that of a mark for repeats. A document is the average of all its embeddings, a linear layer and softmax give the classes, and
embeddings and layer are trained together by stochastic gradient descent in numpy. As the average is linear, a trained word contributes
one number (embedding sum times the difference of the output rows) and a count, which workers keep by word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curatrix.llm.common import held_out, labelled_sample, release_memory, table, unused
from curatrix.llm.features import Lexicon, Scores

#: Labelled documents of each class that the model is fitted on at most.
PER_CLASS = 1200
BUCKETS, GRAMS, DIM = 1 << 17, (3, 4), 8
EPOCHS, BATCH, RATE = 6, 32, 4.0
THRESHOLD = 0.5


def train(texts: list[str], y: np.ndarray, seed: int = 11) -> tuple[np.ndarray, float, float]:
    """(a number for each bucket, the repeat mark's number, bias): a document's log-odds of class 1 are the average of its numbers
    plus the bias."""
    rng = np.random.default_rng(seed)
    if not len(y) or y.min() == y.max():
        return np.zeros(BUCKETS), 0.0, float(np.clip(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)), -4, 4)) if len(y) else 0.0
    lex, docs = Lexicon(GRAMS, BUCKETS), []
    for t in texts:
        w = lex.add(t.split())
        ids, counts = np.unique(w, return_counts=True)
        docs.append((ids, counts, int((w[1:] == w[:-1]).sum())))
    feature, start = lex.arrays()
    size = np.diff(start)
    emb, layer, bias = rng.normal(0, 0.1, (BUCKETS + 1, DIM)), np.zeros((2, DIM)), np.zeros(2)
    layer[1] = rng.normal(0, 0.1, DIM)
    share = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))  # both classes weigh the same
    flat = []  # every document's features and counts
    for ids, counts, again in docs:
        at = np.repeat(start[ids] - np.concatenate([[0], np.cumsum(size[ids])[:-1]]), size[ids]) + np.arange(size[ids].sum()) if len(ids) else np.zeros(0, np.int64)
        flat.append((np.append(feature[at], BUCKETS).astype(np.int32), np.append(np.repeat(counts, size[ids]), again).astype(np.float32)))
    total = EPOCHS * -(-len(docs) // BATCH)
    step = 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(docs))
        for a in range(0, len(order), BATCH):
            rows, rate = order[a : a + BATCH], RATE * (1 - step / total)
            step += 1
            f, c = np.concatenate([flat[r][0] for r in rows]), np.concatenate([flat[r][1] for r in rows])
            of = np.repeat(np.arange(len(rows)), [len(flat[r][0]) for r in rows])
            c = c / np.maximum(1, np.bincount(of, weights=c))[of]
            used, f = np.unique(f, return_inverse=True)
            e = emb[used]
            mean = np.stack([np.bincount(of, weights=c * e[f, k], minlength=len(rows)) for k in range(DIM)], 1)
            z = mean @ layer.T + bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(rows)), y[rows]] -= 1
            p *= share[rows][:, None]
            back = p @ layer
            emb[used] -= rate * np.stack([np.bincount(f, weights=c * back[of, k], minlength=len(used)) for k in range(DIM)], 1)
            layer -= rate / len(rows) * (p.T @ mean)
            bias -= 0.1 * rate / len(rows) * p.sum(0)
    number = emb @ (layer[1] - layer[0])
    return number[:-1], float(number[-1]), float(bias[1] - bias[0])


class Judge:
    def __init__(self, numbers: np.ndarray, again: float, bias: float):
        self.again, self.bias = again, bias
        self.words = Scores(lambda f: complex(numbers[f].sum(), len(f)), GRAMS, BUCKETS)  # sum and count in one

    def score(self, text: str) -> float:
        """Probability of class 1; a text without words has that of the bias alone."""
        words = text.split()
        both = sum(map(self.words.__getitem__, words))
        same = sum(a == b for a, b in zip(words, words[1:], strict=False))
        n = both.imag + same if words else 0
        z = (both.real + same * self.again) / n + self.bias if n else self.bias
        return 1 / (1 + np.exp(-min(30.0, max(-30.0, z))))


def classify(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, threshold: float = THRESHOLD, learn_from: DataFrame | None = None) -> DataFrame:
    """docs plus score and predicted.

    Fitted on at most per_class documents (of learn_from, else docs) of each class of labels (doc_id, quality), none of them held out; labels, lang, source and
    doc_id are no inputs of a score. Null texts count as empty; they and texts without words get the score of the bias, and without
    labels of both classes so does every text. Columns of the same names are kept: new ones get trailing underscores.
    """
    sample = labelled_sample(docs if learn_from is None else learn_from, labels, "quality", per_class).toPandas().sort_values("doc_id")
    numbers, again, bias = train(list(sample["text"]), sample["y"].to_numpy(np.int64))
    del sample
    release_memory()
    model = docs.sparkSession.sparkContext.broadcast((numbers.astype(np.float32), again, bias))

    @F.pandas_udf("double")
    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        j = Judge(*model.value)
        for b in batches:
            yield pd.Series([j.score(t) for t in b], dtype=float)

    score, predicted = unused(docs, "score", "predicted")
    out = docs.withColumn(score, judge(F.coalesce(F.col("text"), F.lit(""))))
    return out.withColumn(predicted, (F.col(score) >= threshold).cast("int"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = classify(docs, table(spark, sf_dir, "labels"))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
