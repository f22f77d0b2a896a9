"""Operator 4: toxicity by multiple-instance learning.

A sentence's score is a logistic function of the hashed words and their character n-grams; a document is toxic if any sentence is, so
its score is the noisy-or 1 - prod(1 - p). Only documents carry labels: the gradient of their log-loss flows through the noisy-or to
the sentences, which afterwards show where the toxicity stands.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from math import exp, expm1, log1p

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curatrix.llm.common import held_out, labelled_sample, release_memory, table, unused
from curatrix.llm.features import SENTENCE, Lexicon, Scores

#: Labelled documents of each class that the model is fitted on at most.
PER_CLASS = 1500
#: Character n-grams of words (negative: beginnings). Taken by cross-validation over learnable rows, see README.
BUCKETS, GRAMS = 1 << 18, (3, 4, 5)
#: Adam's rounds and rate, quadratic and absolute shrinkage of weights, and the least documents of a feature.
ROUNDS, RATE, DECAY, LASSO, LEAST_DOCS = 200, 0.08, 1e-5, 0.02, 5
THRESHOLD = 0.7
#: A word or the end of a sentence.
TOKEN, PART, WORD = re.compile(r"[.!?\n]+|\w+"), re.compile(r"[.!?\n]+"), re.compile(r"\w+")


def instances(text: str) -> tuple[list[str], np.ndarray]:
    """The lower-cased words and each one's sentence number; sentences without words don't count."""
    words, at, n = [], [], 0
    for t in TOKEN.findall(text.lower()):
        if t[0] in ".!?\n":
            n += 1
        else:
            words.append(t)
            at.append(n)
    return words, np.unique(np.asarray(at, np.int64), return_inverse=True)[1] if at else np.zeros(0, np.int64)


def train(texts: list[str], y: np.ndarray) -> tuple[np.ndarray, float]:
    """(weights, bias) that minimise the documents' log-loss, by Adam over the whole sample."""
    lex, word, sent, doc = Lexicon(GRAMS, BUCKETS), [], [], []
    n = 0
    for d, t in enumerate(texts):
        w, s = instances(t)
        if not w:
            continue
        # within a sentence a word counts once
        pair = np.unique(np.stack([s, lex.add(w)]), axis=1)
        word.append(pair[1])
        sent.append(pair[0] + n)
        doc.append(np.full(s.max() + 1, d))
        n += int(s.max()) + 1
    if not n or y.min() == y.max():
        return np.zeros(BUCKETS), float(np.clip(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)), -4, 4)) if len(y) else 0.0
    word, sent, doc = map(np.concatenate, (word, sent, doc))
    feature, start = lex.arrays()
    used, feature = np.unique(feature, return_inverse=True)
    of = np.repeat(np.arange(len(start) - 1), np.diff(start))
    # features of few documents say nothing that carries over
    one = np.unique(np.stack([doc[sent], word]), axis=1)[1]
    docs_with = np.bincount(feature, weights=np.bincount(one, minlength=len(start) - 1)[of], minlength=len(used))
    common = docs_with >= LEAST_DOCS
    share = np.where(y == 1, 0.5 / y.sum(), 0.5 / (len(y) - y.sum()))  # both classes weigh the same
    w, b = np.zeros(len(used)), -4.0
    m, v, mb, vb = np.zeros(len(used)), np.zeros(len(used)), 0.0, 0.0
    for t in range(1, ROUNDS + 1):
        c = np.add.reduceat(w[feature], start[:-1])
        z = np.clip(np.bincount(sent, weights=c[word], minlength=n) + b, -30, 30)
        p = 1 / (1 + np.exp(-z))
        clean = np.exp(np.bincount(doc, weights=np.log1p(-p), minlength=len(y)))  # probability that no sentence is toxic
        pull = np.where(y == 1, -clean / np.maximum(1 - clean, 1e-9), 1.0) * share
        g = pull[doc] * p  # the loss's slope in each sentence's z
        gc = np.bincount(word, weights=g[sent], minlength=len(start) - 1)
        gw = np.where(common, np.bincount(feature, weights=gc[of], minlength=len(used)) + DECAY * w, 0)
        gb = g.sum()
        m, v = 0.9 * m + 0.1 * gw, 0.99 * v + 0.01 * gw * gw
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        c1, c2 = 1 - 0.9**t, 1 - 0.99**t
        w -= RATE * (m / c1) / (np.sqrt(v / c2) + 1e-7)
        w = np.maximum(0, w - RATE * LASSO)  # evidence only ever speaks for toxicity
        b = min(-1.0, b - RATE * (mb / c1) / (np.sqrt(vb / c2) + 1e-7))
    out = np.zeros(BUCKETS)
    out[used] = w
    return out, b


class Judge:
    """Scores of whole texts and the sentences that make them toxic."""

    def __init__(self, weights: np.ndarray, bias: float):
        self.bias = bias
        self.words = Scores(lambda f: float(weights[f].sum()), GRAMS, BUCKETS)

    def sentence(self, text: str) -> float:
        words = set(WORD.findall(text.lower()))
        return 1 / (1 + np.exp(-np.clip(sum(map(self.words.__getitem__, words)) + self.bias, -30, 30))) if words else 0.0

    def score(self, text: str) -> float:
        """1 - prod(1 - p) over the sentences; without words, the score of one empty sentence."""
        clean, found = 0.0, False
        for s in PART.split(text.lower()):
            if words := WORD.findall(s):
                z = min(30.0, max(-30.0, sum(map(self.words.__getitem__, set(words))) + self.bias))
                clean, found = clean - log1p(exp(z)), True
        return -expm1(clean if found else -log1p(exp(self.bias)))

    def offending(self, text: str, least: float = 0.5) -> list[dict]:
        """Start, end and score of the sentences that reach `least`."""
        spans = [(m.start(), m.end()) for m in SENTENCE.finditer(text) if m.end() > m.start()]
        return [{"start": a, "end": b, "score": float(p)} for a, b in spans if (p := self.sentence(text[a:b])) >= least]


def classify(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, threshold: float = THRESHOLD) -> DataFrame:
    """docs plus score, predicted and offending: array<struct<start int, end int, score double>> of sentences, in characters.

    Fitted on at most per_class documents of each class of labels (doc_id, toxic), none of them held out; labels, lang, source and
    doc_id are no inputs of a score. Null texts count as empty; they and texts without words get the score of an empty sentence. Without
    labels of both classes every sentence gets that score. Columns of the same names are kept: new ones get trailing underscores.
    """
    sample = labelled_sample(docs, labels, "toxic", per_class).toPandas().sort_values("doc_id")
    weights, bias = train(list(sample["text"]), sample["y"].to_numpy(np.int64))
    del sample
    release_memory()
    model = docs.sparkSession.sparkContext.broadcast((weights.astype(np.float32), bias))

    @F.pandas_udf("score double, offending array<struct<start:int,end:int,score:double>>")
    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        j = Judge(*model.value)
        for b in batches:
            scores = [j.score(t) for t in b]
            yield pd.DataFrame({"score": scores, "offending": [j.offending(t) if s >= 0.5 else [] for t, s in zip(b, scores, strict=True)]})

    made, score, predicted, where = unused(docs, "_judged", "score", "predicted", "offending")
    out = docs.withColumn(made, judge(F.coalesce(F.col("text"), F.lit(""))))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns], F.col(f"{made}.score").alias(score), (F.col(f"{made}.score") >= threshold).cast("int").alias(predicted), F.col(f"{made}.offending").alias(where))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = classify(docs, table(spark, sf_dir, "labels"))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", "offending")
