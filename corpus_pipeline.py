"""A corpus pipeline of five training-data operators: rules, classifier, near-duplicates, mixture, tokens.

Each stage takes (spark, docs, sf_dir) and works on every row its predecessor kept; run() writes each result to the shared folder and
reads it again. Null and empty texts fail the rules, so later stages meet them only where they are called alone: then they score as the classifier's
bias says, have no shingles (and are near-duplicates of each other), are taken as often as their place in the mix says, and have no tokens. Repeated rows
are rows like any other but for near-duplicates, of which one stays, one with a null id
only if its group has no other. Very long texts are handled whole,
in parts for the tokens. Empty tables stay empty. Columns of docs are kept whatever they are named, but for the last stage, which returns its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curatrix.llm import bpe, mixing, quality_model, rules, simhash
from curatrix.llm.common import materialize, table, unused

#: Near-duplicates share 0.8 of their different five-word shingles or more. For sets of alike size that is a cosine of 8/9, an angle of 27.3 degrees
#: and, of 256 bits, 39 that differ on average (deviation 5.7), or 48 (6.2) for the smallest sets, 4 of 5 shingles. The vantage-point
#: tree's links, fingerprints within the radius and counts that agree to 0.8, only name candidates (by those binomial laws 1e-5 of pairs are missed at
#: worst); the sets decide.
NEAR_WORDS, NEAR_RULE = 5, simhash.Rule(bits=256, radius=76, ratio=0.8, exact=True)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose posterior probability of being good passes, and that pass the base rules."""
    return rules.keep_good(docs)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier takes for good. It learns from a bounded sample of all labelled documents: those that the rules
    rejected show it what is bad."""
    scored = quality_model.classify(docs, table(spark, sf_dir, "labels"), learn_from=table(spark, sf_dir, "documents"))
    return scored.filter(F.col(scored.columns[-1]) == 1).select(*[F.col(f"`{c}`") for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the lowest id, of each group of near-duplicates."""
    return simhash.deduplicate(docs, NEAR_WORDS, NEAR_RULE)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    mixed = mixing.mix(docs)
    own, copies = [F.col(f"`{c}`") for c in docs.columns], F.col(f"`{mixed.columns[-1]}`")
    (turn,) = unused(mixed, "turn")
    return mixed.filter(copies > 0).select(*own, F.explode(F.sequence(F.lit(1), copies)).alias(turn)).select(*own)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number and digests of each document's tokens, and of what they decode to."""
    import public_tokenizers

    coded = bpe.encode_decode(docs.select("doc_id", "source", "text"), public_tokenizers.path("word_bpe_49k.json"), texts=False)
    return coded.drop("text")


STAGES = [
    ("quality_rules", quality_rules),
    ("quality_classifier", quality_classifier),
    ("near_duplicates", near_duplicates),
    ("mixture", mixture),
    ("tokens", tokens),
]

#: Expectation-maximisation and trained models can't be written in SQL; tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
