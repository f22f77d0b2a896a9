"""Operator 13: periodic runs of words, by tiles whose size follows the period.

A run of period q and of at least 4 * q words holds, for the octave 2^k <= q < 2^(k+1), a boundary c (a multiple of D = 2^(k+1)) whose next words
return q words later. So a document is exploded into overlapping tiles an octave, of which only those with such a boundary leave it; tiles are solved
independently: Z-functions from each boundary to the right and to the left give how far every period of the octave reaches. A tile sees D words before
and 3 * D after its boundaries, so what it finds is a whole run or a fragment that overlaps its neighbour's by q words or more. Fragments are shuffled by
document and period and stitched where they overlap.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from curatrix.llm.common import SPACES, hot_join, materialize, partitions, table, unused

#: A run repeats its period so often at least, and has so many words at least.
REPEATS, LEAST = 4, 6
#: Words of boundaries that a tile has at least, and words that must return for a boundary to count, at most.
TILE, GRAM = 16_384, 16


def word_ids(text: str) -> np.ndarray:
    """The text's words (runs of other than the six ASCII white-space characters) as numbers, those of their last places."""
    words = text.encode("utf-8", "surrogatepass").split()  # bytes part at those six characters only
    number = dict(zip(words, range(len(words)), strict=True))
    return np.fromiter(map(number.__getitem__, words), np.int32, len(words))


def _octaves(n: int) -> range:
    """Octaves k whose least period can make a run in n words."""
    return range((n // REPEATS).bit_length() if n >= LEAST else 0)


def _gram(k: int) -> int:
    """Words that surely return after a boundary of octave k: max(LEAST, 4 * q) words leave room for a multiple of D with as many behind it."""
    return max(2, min(1 << k, GRAM))


def boundaries(ids: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """For each octave k that has any, the multiples c of 2^(k+1) whose next words come again q words later, for some q of the octave. Hashes of those
    words decide, doubled in length from octave to octave, so there may be a few more, but never fewer."""
    n, size = len(ids), 1
    h = np.zeros(n + n // 2 + 2, np.uint64)  # the last rows of an octave end behind the text
    h[:n] = ids
    h[:n] += np.uint64(1)
    for k in _octaves(n):
        while size < _gram(k):
            later = h[size:n] * np.uint64(0xC2B2AE3D27D4EB4F)
            h[:n] *= np.uint64(0x9E3779B97F4A7C15)
            h[: n - size] ^= later + np.uint64(size)
            size *= 2
        d = 2 << k
        rows = h[: -(-n // d) * d].reshape(-1, d)
        found = np.flatnonzero((rows[:, d // 2 :] == rows[:, :1]).any(1))
        if len(found):
            yield k, found * d


def suspect(text: str) -> bool:
    """Whether any boundary of any octave may lie in a run; cheap, in numpy."""
    return next(boundaries(word_ids(text)), None) is not None


def tiles(ids: np.ndarray, tile: int = TILE) -> Iterator[tuple[int, int, np.ndarray]]:
    """(octave, boundary that the tile begins with, its boundaries that count). A tile's boundaries span `tile` words, or 4 * D if that is more."""
    for k, found in boundaries(ids):
        span = max(tile // (2 << k), 4) * (2 << k)
        for start in np.unique(found // span):
            yield k, int(start * span), found[found // span == start]


def z_function(s: list[int], upto: int) -> list[int]:
    """For each place below upto how many items from there on equal the first ones."""
    n = len(s)
    z = [n] + [0] * (min(upto, n) - 1)
    left = right = 0
    for i in range(1, len(z)):
        m = min(right - i, z[i - left]) if i < right else 0
        while i + m < n and s[m] == s[i + m]:
            m += 1
        z[i] = m
        if i + m > right:
            left, right = i, i + m
    return z


def _prime_parts(q: int) -> list[int]:
    """q divided by each of its prime divisors: a word sequence of length q is a power if one of them is a period of it."""
    out, rest, p = [], q, 2
    while p * p <= rest:
        if rest % p == 0:
            out.append(q // p)
            while rest % p == 0:
                rest //= p
        p += 1
    return out + ([q // rest] if rest > 1 else [])


def solve(ids: list[int], k: int, at: list[int], low: int, n: int) -> list[tuple[int, int, int]]:
    """ids: the words from `low` on of a tile of a document of n words; at: its boundaries that count -> (period, start, end) of stretches of a
    primitive period of octave k: whole runs, and what reaches the tile's ends over two periods or more."""
    d, least, found = 2 << k, _gram(k), defaultdict(list)
    high = low + len(ids)
    for c in at:
        a, b = max(c - d, low), min(c + 3 * d, high)
        right = ids[c - low : b - low]
        z = z_function(right, d)
        behind = ids[a - low : c - low][::-1]
        # -1 parts the words before the boundary from those up to q after it, both read backwards
        back = z_function([*behind, -1, *ids[a - low : min(c + d, high) - low][::-1]], len(behind) + 1 + d) if behind else []
        top = min(c + d, high) - c
        for q in range(d // 2, min(d, len(right))):
            if z[q] < least:
                continue
            left = min(back[len(behind) + 1 + top - q], len(behind)) if behind else 0
            start, end = c - left, c + q + z[q]
            if end - start < 2 * q or any(z[p] >= q - p for p in _prime_parts(q)):
                continue
            last = found[q]
            if last and start <= last[-1][1] - q:
                last[-1] = (min(start, last[-1][0]), max(end, last[-1][1]))
            else:
                last.append((start, end))
    whole = lambda q, s, e: e - s >= max(LEAST, REPEATS * q)
    return [(q, s, e) for q, spans in found.items() for s, e in spans if whole(q, s, e) or (s == low and low > 0) or (e == high and high < n)]


def _frames(rows: Iterator[tuple], columns: list[str], most: int = 2000) -> Iterator[pd.DataFrame]:
    """Frames of at most `most` rows."""
    while part := list(islice(rows, most)):
        yield pd.DataFrame(part, columns=columns)


def _explode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    def rows() -> Iterator[tuple]:
        for b in batches:
            for key, text in zip(b["key"], b["text"], strict=True):
                ids = word_ids(text)
                for k, start, at in tiles(ids):
                    low, high = max(0, int(at[0]) - (2 << k)), min(len(ids), int(at[-1]) + 3 * (2 << k))
                    yield key, k, start, low, len(ids), ids[low:high].tobytes(), at.astype(np.int32).tobytes()

    yield from _frames(rows(), ["key", "octave", "tile", "low", "n", "ids", "at"], 200)


def _solved(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    def rows() -> Iterator[tuple]:
        for b in batches:
            for r in b.itertuples(index=False):
                found = solve(np.frombuffer(r.ids, np.int32).tolist(), int(r.octave), np.frombuffer(r.at, np.int32).tolist(), int(r.low), int(r.n))
                yield from ((r.key, *f) for f in found)

    yield from _frames(rows(), ["key", "period", "start", "end"])


def stitched(fragments: DataFrame) -> DataFrame:
    """fragments (key, period, start, end) -> runs (key, start, length, period): fragments of a key and period that overlap by a period or more
    are one. A window walks each key and period's fragments in order, which are shuffled by both."""
    w = Window.partitionBy("key", "period").orderBy("start", F.desc("end"))
    reach = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    parts = fragments.withColumn("new", F.when(F.col("start") <= reach - F.col("period"), 0).otherwise(1)).withColumn("island", F.sum("new").over(w))
    runs = parts.groupBy("key", "period", "island").agg(F.min("start").alias("start"), (F.max("end") - F.min("start")).alias("length"))
    return runs.filter(F.col("length") >= F.greatest(F.lit(LEAST), REPEATS * F.col("period"))).select("key", "start", "length", "period")


def _suspects(text: pd.Series) -> pd.Series:
    return text.map(suspect).astype(bool)


def _collapsed(text: pd.Series, runs: pd.Series) -> pd.Series:
    out = []
    for t, found in zip(text, runs, strict=True):
        words = t.encode("utf-8", "surrogatepass").split()
        drop = np.zeros(len(words) + 1, np.int64)
        for r in found:
            drop[r["start"] + r["period"]] += 1
            drop[r["start"] + r["length"]] -= 1
        gone = np.cumsum(drop) > 0
        out.append(b" ".join(w for w, g in zip(words, gone, strict=False) if not g).decode("utf-8", "surrogatepass"))
    return pd.Series(out)


def words_of(text: Column) -> Column:
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, r"[\x20\x09-\x0D]+"))


def find_runs(docs: DataFrame) -> DataFrame:
    """docs plus runs array<struct<start, length, period>> (by start, then period) and collapsed, the words that no run repeats, joined by one space.

    A run is a stretch of words with smallest period q, of max(6, 4 * q) words or more, that no neighbouring word extends; words count from 0. A word is
    dropped if any run contains it after that run's first q words. Only column text is read; a null text has no words; equal texts are solved once; an
    empty table gives no rows. Texts without a boundary that counts (nearly all) never leave their task. Columns of the same names are kept: the new
    ones then get trailing underscores. A tile of the highest octave is as long as its document.
    """
    n_runs, n_collapsed = unused(docs, "runs", "collapsed")
    text = F.coalesce(F.col("text"), F.lit(""))
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), text.alias("text")).withColumn("maybe", F.pandas_udf(_suspects, "boolean")("text"))
    kind = "array<struct<start:bigint,length:bigint,period:bigint>>"
    clean = packed.filter("not maybe").select("row.*", F.array().cast(kind).alias(n_runs), F.array_join(words_of(F.col("text")), " ").alias(n_collapsed))
    rows = materialize(packed.filter("maybe").select("row", F.sha2(F.col("text").cast("binary"), 256).alias("key"), "text"), "suspects")
    texts = rows.groupBy("key").agg(F.min("text").alias("text"), F.count("*").alias("copies"))
    n = partitions(docs.sparkSession)
    cut = texts.select("key", "text").mapInPandas(_explode, "key string, octave int, tile long, low long, n long, ids binary, at binary").repartition(n, "key", "octave", "tile")
    fragments = cut.mapInPandas(_solved, "key string, period long, start long, end long")
    runs = stitched(fragments).groupBy("key").agg(F.sort_array(F.collect_list(F.struct("start", "length", "period"))).alias("found"))
    copies = rows.groupBy("key").agg(F.count("*").alias("copies"))
    side = materialize(copies.join(runs, "key", "left").select("key", "copies", F.coalesce("found", F.array().cast(kind)).alias("found")), "runs")
    joined = hot_join(rows, side, "key", rows.count())
    return joined.select("row.*", F.col("found").alias(n_runs), F.pandas_udf(_collapsed, "string")("text", "found").alias(n_collapsed)).unionByName(clean)


def planted(docs: DataFrame) -> DataFrame:
    """(doc_id, text): documents as the contract changes them. With h the crc32 of the id, documents with h % 10 = 0 repeat p words from word a on."""
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    df = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), h.alias("h"), F.floor(h / 10).cast("long").alias("g"))
    # generators of one row keep expressions from being written into the lambda that walks the words
    df = df.select("doc_id", "text", "g", F.inline(F.array(F.struct(F.when(F.col("h") % 10 == 0, words_of(F.col("text"))).alias("words")))))
    n, g, a, p = F.size("words").cast("long"), F.col("g"), F.col("a"), F.col("p")
    start = F.when(n > 0, g % n)
    df = df.select("doc_id", "text", "words", F.inline(F.array(F.struct(start.alias("a"), (1 + F.floor((n - start) / (3 + g % 8))).alias("p")))))
    again = F.transform("words", lambda w, i: F.when(i < a, w).otherwise(F.get("words", (a + (i - a) % p).cast("int"))))
    return df.select("doc_id", F.inline(F.array(F.struct(F.when(n > 0, F.array_join(again, " ")).otherwise(F.col("text")).alias("text")))))


def op13_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_runs(planted(table(spark, sf_dir, "documents").select("doc_id", "text")))
    longest = F.transform("runs", lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("s"), r["period"].alias("p")))
    found = found.withColumn("best", F.array_min(longest))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    best = F.col("best")
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        best["s"].alias("start"),
        (-best["l"]).alias("length"),
        best["p"].alias("period"),
        F.floor(-1000 * best["l"] / best["p"]).cast("long").alias("exponent_milli"),
        digest(lines).alias("runs_sha256"),
        digest(F.col("collapsed")).alias("collapsed_sha256"),
    )
