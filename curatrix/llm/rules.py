"""Operator 8: quality rules by weak supervision, in DataFrame functions only.

Each rule votes for quality, against it, or abstains. Expectation-maximisation over the counts of vote patterns (3 to the number of
rules at most, whatever the input) estimates how often each rule is right about good and about bad documents, without labels, and the
share of good ones. A document's posterior probability of being good replaces the usual demand that it pass every rule.
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass
from math import log

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from curatrix.llm.common import SPACES, materialize, table, unused

#: Rule -> (votes for, votes against), SQL over the features of `measured`. Neither: it abstains. Against wins where both hold.
RULES = {
    "word_length": ("word_chars between 3 * n_words and 10 * n_words", "word_chars < 2 * n_words or word_chars > 14 * n_words"),
    "symbols": ("100 * n_symbols <= n_words", "10 * n_symbols > n_words"),
    "letters": ("100 * n_letters >= 94 * word_chars", "100 * n_letters < 90 * word_chars"),
    "marks": ("50 * n_marks <= n_words", "10 * n_marks > n_words"),
    "lines": ("n_dup_lines = 0 and n_lines > 1", "10 * n_dup_lines > 3 * n_lines"),
    "repeats": ("20 * n_repeat_words <= n_words", "10 * n_repeat_words > 3 * n_words"),
    "capitals": ("20 * n_shouted <= n_words", "10 * n_shouted > 3 * n_words"),
    "sentences": ("n_ends > 0 and 4 * n_ends <= n_words", "n_ends = 0 or 2 * n_ends > n_words"),
}
ROUNDS, SETTLED = 200, 1e-6
#: Bounds of what is estimated: share of good documents; how often a rule is right about good ones, and about bad ones. The second of them tells good
#: from bad (else the two could change places): a rule's votes about good documents are right more often than not. The share itself is free.
PRIOR, RIGHT_GOOD, RIGHT_BAD = (0.001, 0.999), (0.5, 0.999), (0.2, 0.999)
LEAST_POSTERIOR = 0.5


def measured(df: DataFrame, text: str) -> DataFrame:
    """df plus the FEATURES of column `text` (null: no words) as long. Windows are hashed, and only documents in which a hash repeats
    sort theirs. The features come out of a generator of one row, so that filters on them aren't moved into, and don't repeat, their
    expressions. A column of a feature's name is an error: pack such rows into a struct first, as keep_good does."""
    taken = {c.lower() for c in df.columns} & {*FEATURES, *MADE}
    if taken:
        raise ValueError(f"columns are named like what is added: {sorted(taken)}")
    own = [F.col(f"`{c}`") for c in df.columns]
    words, lines, windows, ordered, again = unused(df, "_words", "_lines", "_windows", "_sorted", "_again")
    t, spaces = F.coalesce(F.col(text), F.lit("")), F.lit(SPACES)
    bare = F.btrim(t, spaces)
    long = lambda c: c.cast("long")
    df = df.withColumn(words, F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, r"[\x20\x09-\x0D]+")))
    df = df.withColumn(lines, F.filter(F.split(t, "\n"), lambda x: F.btrim(x, spaces) != ""))
    at = F.sequence(F.lit(1), F.size(words) - 2)
    window = lambda i: F.xxhash64(F.element_at(words, i), F.element_at(words, i + 1), F.element_at(words, i + 2))
    df = df.withColumn(windows, F.when(F.size(words) >= 3, F.transform(at, window)).otherwise(F.array().cast("array<long>")))
    df = df.withColumn(ordered, F.when(F.size(F.array_distinct(windows)) < F.size(windows), F.sort_array(F.transform(windows, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))))
    df = df.withColumn(again, F.expr(f"filter({ordered}, (x, k) -> x.h = get({ordered}, k - 1).h or x.h = get({ordered}, k + 1).h).i"))
    covered = F.expr(f"size(array_distinct(concat({again}, transform({again}, x -> x + 1), transform({again}, x -> x + 2))))")
    features = {
        "n_words": long(F.size(words)),
        "word_chars": long(F.length(F.translate(t, SPACES, ""))),
        "n_symbols": long(F.length(t) - F.length(F.translate(t, "#*$%&|<>", ""))),
        "n_lines": long(F.size(lines)),
        "n_dup_lines": long(F.size(lines) - F.size(F.array_distinct(lines))),
        "n_repeat_words": long(F.when(F.col(again).isNull(), F.lit(0)).otherwise(covered)),
        "n_shouted": long(F.regexp_count(t, F.lit(r"\p{Lu}{2,}"))),
        "n_ends": long(F.length(t) - F.length(F.translate(t, ".!?", ""))),
        "n_letters": long(F.length(F.regexp_replace(t, r"[^\p{L}]+", ""))),
        "n_marks": long(F.regexp_count(t, F.lit(r"[^\p{L}\p{N}\s]{2,}|(?<=\s)[^\p{L}\p{N}\s](?=\s)"))),
    }
    return df.select(*own, F.inline(F.array(F.struct(*[features[k].alias(k) for k in FEATURES]))))


FEATURES = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_shouted", "n_ends", "n_letters", "n_marks"]
#: What judge adds.
MADE = ["base_failed", "posterior", "kept"]
BASE_FAILED = "n_words < 50 or 100 * n_repeat_words > 50 * n_words"


def votes(rules: dict[str, tuple[str, str]]) -> list[Column]:
    """A column a rule: 1 for, -1 against, 0 abstains."""
    return [F.when(F.expr(against), -1).when(F.expr(good), 1).otherwise(0).cast("int").alias(f"v_{name}") for name, (good, against) in rules.items()]


@dataclass
class Trust:
    """Share of good documents; for each rule how often it is right about good and about bad ones, where it votes."""

    prior: float
    good: dict[str, float]
    bad: dict[str, float]

    def log_odds(self) -> Column:
        """Of a document being good, from its votes."""
        out = F.lit(log(self.prior / (1 - self.prior)))
        for r in self.good:
            g, b = self.good[r], self.bad[r]
            out = out + F.when(F.col(f"v_{r}") == 1, log(g / (1 - b))).when(F.col(f"v_{r}") == -1, log((1 - g) / b)).otherwise(0.0)
        return out

    def posterior(self) -> Column:
        return 1 / (1 + F.exp(-self.log_odds()))


def estimate(patterns: DataFrame, names: list[str], rounds: int = ROUNDS) -> Trust:
    """patterns (v_<rule>.., n): EM from a start that trusts every rule and takes half of the documents for good, within the bounds PRIOR, RIGHT_GOOD and
    RIGHT_BAD. Each round is one aggregate over the pattern table; its sums are rounded, so that the order of addition can't show. A warning tells if
    the estimates still move after `rounds` rounds."""
    held = lambda x, bounds: round(min(bounds[1], max(bounds[0], x)), 6)
    trust = Trust(0.5, dict.fromkeys(names, 0.9), dict.fromkeys(names, 0.6))
    for _ in range(rounds):
        p = patterns.withColumn("p", trust.posterior())
        sums = [F.sum(F.col("n") * F.col("p")), F.sum(F.col("n"))]
        for r in names:
            v = F.col(f"v_{r}")
            sums += [F.sum(F.when(c, F.col("n") * w)) for c, w in ((v == 1, F.col("p")), (v != 0, F.col("p")), (v == -1, 1 - F.col("p")), (v != 0, 1 - F.col("p")))]
        got = [x or 0.0 for x in p.agg(*[s.alias(f"s{i}") for i, s in enumerate(sums)]).first()]
        if not got[1]:
            break
        share = lambda a, b: (a + 1) / (b + 2)
        rows = {r: got[2 + 4 * i : 6 + 4 * i] for i, r in enumerate(names)}
        new = Trust(held(share(got[0], got[1]), PRIOR), {r: held(share(x[0], x[1]), RIGHT_GOOD) for r, x in rows.items()}, {r: held(share(x[2], x[3]), RIGHT_BAD) for r, x in rows.items()})
        moved = max(abs(new.prior - trust.prior), *(abs(a[r] - b[r]) for a, b in ((new.good, trust.good), (new.bad, trust.bad)) for r in names))
        trust = new
        if moved < SETTLED:
            break
    else:
        warnings.warn(f"the rules' estimates still moved by {moved:g} after {rounds} rounds", stacklevel=2)
    return trust


def judge(features: DataFrame, rules: dict[str, tuple[str, str]] | None = None, least: float = LEAST_POSTERIOR) -> DataFrame:
    """features (those of `measured`, with whatever else) plus base_failed, posterior and kept. An empty table keeps nothing."""
    rules = rules or RULES
    voted = features.select("*", *votes(rules))
    names = [f"v_{r}" for r in rules]
    patterns = materialize(voted.filter(f"not ({BASE_FAILED})").groupBy(*names).agg(F.count("*").cast("double").alias("n")), "patterns")
    trust = estimate(patterns, list(rules))
    out = voted.withColumn("base_failed", F.expr(BASE_FAILED)).withColumn("posterior", trust.posterior())
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= least)).drop(*names)


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of docs (text and any columns) that the rules keep. Null and empty texts have no words and fail; repeated rows fare
    alike; an empty table stays empty. Rows are written once with their features, so that these are worked out only once."""
    (row,) = unused(docs, "_row")
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(row), F.col("text").alias("text"))
    measured_rows = materialize(measured(packed, "text").select(row, *FEATURES), "measured")
    return judge(measured_rows).filter("kept").select(f"{row}.*")


def op8_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = judge(materialize(measured(docs, "text").select("doc_id", *FEATURES), "features"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("posterior", 4).alias("posterior"))
