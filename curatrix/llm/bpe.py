"""Operator 7: BPE encoding and decoding; long text by tree concatenation.

A text is halved, wherever the middle falls, until the parts are leaves of at most LEAF characters. Leaves are encoded independently and
joined two by two up the tree. A join is right only where both sides agree with a re-encoding of what lies around it: a window around the
join is encoded, and grows, until it has a token in common with the left half's encoding before the join and one with the right half's
after it, at the same place. What lies outside those tokens is kept, the rest comes from the window. If a window reaches both ends it
is the encoding itself.

The parts of a text above SPREAD characters are rows of their own, so that many tasks encode them in parallel; the joins of one text
are made in one task, which re-encodes their windows only. Below a leaf, runs between white space that texts repeat are remembered.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate, chain
from operator import add

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curatrix.llm.common import partitions, table, unused
from curatrix.llm.encoding import Units

#: Characters of a leaf; of the first window on each side of a join; tokens at a window's ends that are never trusted.
LEAF, WINDOW, MARGIN = 1024, 32, 2
#: Characters of a run that is remembered and joined as a whole.
RUN = 64
#: Characters above which a text's parts are spread over tasks.
SPREAD = 1 << 16
#: Units of each generation of a worker's memo (about 100 MB in all).
MEMO = 250_000
Tokens = list[tuple[int, int, int]]  # id, start, end in the text


@dataclass
class Part:
    """Encoding of text[lo:hi] in segments: runs between white space, encoded alone, or single tokens around joins."""

    lo: int
    hi: int
    starts: list[int]
    ends: list[int]
    ids: list[tuple[int, ...]]

    def spliced(self, i: int, starts: list[int], ends: list[int], ids: list[tuple[int, ...]], right: Part, j: int) -> Part:
        """The segments before i, those given, and right's from j on."""
        return Part(self.lo, right.hi, self.starts[:i] + starts + right.starts[j:], self.ends[:i] + ends + right.ends[j:], self.ids[:i] + ids + right.ids[j:])


def _distinct(ts: Tokens, lo: int, hi: int) -> dict[tuple[int, int, int], int]:
    """Places of the tokens that lie in lo .. hi and cover characters of their own (several tokens may share one character)."""
    starts = [t[1] for t in ts]
    out = {}
    for k in range(bisect_left(starts, lo), len(ts)):
        t = ts[k]
        if t[1] >= hi:
            break
        alone = (k == 0 or ts[k - 1][2] <= t[1]) and (k + 1 == len(ts) or ts[k + 1][1] >= t[2])
        if alone and t[2] <= hi and t[2] > t[1]:
            out[t] = k
    return out


class Coder(Units):
    """unit -> ids, and whole texts by tree concatenation. joins counts the joins made."""

    def __init__(self, path: str, leaf: int = LEAF):
        super().__init__(path, tuple, lambda a, b: a + b, lower=True, memo=MEMO)
        self.leaf, self.joins = leaf, 0
        if self.tokenizer.decoder is not None or not _parts_at_spaces(self.tokenizer):
            raise ValueError("a vocabulary that lower-cases, drops white space and joins decoded tokens by spaces is asked for")
        size = self.tokenizer.get_vocab_size()
        self.decimal, self.token = list(map(str, range(size))), [self.tokenizer.id_to_token(i) for i in range(size)]

    def tokens(self, text: str, a: int, b: int) -> Tokens:
        e = self.tokenizer.encode(text[a:b], add_special_tokens=False)
        return [(i, x + a, y + a) for i, (x, y) in zip(e.ids, e.offsets, strict=True)]

    def __missing__(self, unit: str) -> tuple[int, ...]:
        return super().__missing__(unit) if len(unit) <= RUN else tuple(self.ids(unit))

    def leaf_part(self, text: str, lo: int, hi: int) -> Part:
        part = text[lo:hi]
        units = [part] if self.has_special(part) else part.replace("\n", " ").split(" ")
        sizes = list(map(len, units))
        starts = list(accumulate([n + 1 for n in sizes[:-1]], initial=lo))
        return Part(lo, hi, starts, list(map(add, starts, sizes)), list(map(self.__getitem__, units)))

    def encode(self, text: str, lo: int = 0, hi: int | None = None) -> Part:
        """text[lo:hi] as if it stood alone."""
        hi = len(text) if hi is None else hi
        if hi - lo <= self.leaf:
            return self.leaf_part(text, lo, hi)
        mid = (lo + hi) // 2
        return self.concatenate(text, self.encode(text, lo, mid), self.encode(text, mid, hi))

    def concatenate(self, text: str, left: Part, right: Part) -> Part:
        """The encoding of two parts in a row. Windows are of two runs on each side, if these are short and the outer ones come out as they
        were; else of characters, and growing."""
        self.joins += 1
        return self._over_runs(text, left, right) or self._over_tokens(text, left, right)

    def _over_runs(self, text: str, left: Part, right: Part) -> Part | None:
        if len(left.ids) < 2 or len(right.ids) < 2:
            return None
        a, b = left.starts[-2], right.ends[1]
        if b - a > 4 * RUN or (a > left.lo and text[a - 1] not in " \n") or (b < right.hi and text[b] not in " \n"):
            return None
        inside = self.leaf_part(text, a, b)
        if inside.ids[0] != left.ids[-2] or inside.ids[-1] != right.ids[1] or inside.ends[0] != left.ends[-2] or inside.starts[-1] != right.starts[1]:
            return None
        return left.spliced(len(left.ids) - 2, inside.starts, inside.ends, inside.ids, right, 2)

    def _tokens_of(self, text: str, part: Part, i: int, j: int) -> Tokens:
        out = []
        for a, b, ids in zip(part.starts[i:j], part.ends[i:j], part.ids[i:j], strict=True):
            out += [(ids[0], a, b)] if len(ids) == 1 else self.tokens(text, a, b) if ids else []
        return out

    def _over_tokens(self, text: str, left: Part, right: Part) -> Part:
        lo, mid, hi = left.lo, left.hi, right.hi
        w = WINDOW
        while True:
            # the segments that a window of w characters touches, as tokens
            i, j = max(0, bisect_right(left.starts, mid - w) - 1), bisect_left(right.ends, mid + w) + 1
            before, after = self._tokens_of(text, left, i, len(left.ids)), self._tokens_of(text, right, 0, j)
            # a window starts and ends where the halves have a token's edge
            a = max((t[1] for t in before if t[1] <= mid - w), default=lo)
            b = min((t[2] for t in after if t[2] >= mid + w), default=hi)
            inside = self.tokens(text, a, b)
            last = len(inside) - MARGIN
            at_l = (0, 0) if a == lo else self._agree(_distinct(before, a, mid), {t: k for t, k in _distinct(inside, a, mid).items() if k >= MARGIN}, min)
            at_r = (len(after), len(inside)) if b == hi else self._agree(_distinct(after, mid, b), {t: k for t, k in _distinct(inside, mid, b).items() if k < last}, max)
            if at_l and at_r:
                # a window that reaches an end replaces that whole side
                i, before = (0, []) if a == lo else (i, before[: at_l[0]])
                j, after = (len(right.ids), []) if b == hi else (j, after[at_r[0] :])
                made = [*before, *inside[at_l[1] : at_r[1]], *after]
                return left.spliced(i, [t[1] for t in made], [t[2] for t in made], [(t[0],) for t in made], right, j)
            w *= 2

    @staticmethod
    def _agree(theirs: dict, mine: dict, outermost) -> tuple[int, int] | None:
        """Places, in a half and in the window, of the outermost token that both have."""
        common = [t for t in mine if t in theirs]
        if not common:
            return None
        t = outermost(common, key=lambda t: t[1])
        return theirs[t], mine[t]

    def described(self, part: Part, texts: bool) -> tuple:
        ids = list(chain.from_iterable(part.ids))
        decimals, decoded = " ".join(map(self.decimal.__getitem__, ids)), " ".join(map(self.token.__getitem__, ids))
        sha = (len(ids), hashlib.sha256(decimals.encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())
        return (*sha, decimals, decoded) if texts else sha


def _parts_at_spaces(tokenizer) -> bool:
    ids = lambda s: tokenizer.encode(s, add_special_tokens=False).ids
    return ids("a b") == ids("A\nB") == ids("a") + ids("b")


_coders: dict[str, Coder] = {}


def coder(path: str) -> Coder:
    """One a Python worker, kept for its later tasks."""
    if path not in _coders:
        _coders[path] = Coder(path)
    return _coders[path]


FIELDS = {"n_tokens": "long", "ids_sha256": "string", "decoded_sha256": "string", "ids": "string", "decoded": "string"}


def encode_decode(docs: DataFrame, tokenizer: str, texts: bool = True, spread: int = SPREAD) -> DataFrame:
    """docs plus n_tokens, ids_sha256, decoded_sha256 and, if texts, ids (their decimal numbers) and decoded.

    Null texts count as empty: no tokens, the digests of empty strings. Null ids, repeats and empty tables need no rule: texts of at most
    `spread` characters are coded row by row, longer ones once for each different text, in parts of `spread` characters that are rows
    of their own. Columns of the same names are kept and the new ones get trailing underscores.
    """
    fields = list(FIELDS)[: 5 if texts else 3]
    kind = ", ".join(f"{f} {FIELDS[f]}" for f in fields)

    def frame(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame({f: np.asarray([r[k] for r in rows], np.int64) if k == 0 else [r[k] for r in rows] for k, f in enumerate(fields)})

    @F.pandas_udf(kind)
    def code(text: pd.Series) -> pd.DataFrame:
        c = coder(tokenizer)
        return frame([c.described(c.encode(t), texts) for t in text])

    @F.pandas_udf("starts array<int>, ends array<int>, counts array<int>, ids array<int>")
    def code_part(text: pd.Series) -> pd.DataFrame:
        c, out = coder(tokenizer), []
        for t in text:
            p = c.encode(t)
            out.append((p.starts, p.ends, list(map(len, p.ids)), list(chain.from_iterable(p.ids))))
        return pd.DataFrame(out, columns=["starts", "ends", "counts", "ids"])

    def join_parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = coder(tokenizer)
        for b in batches:
            rows = []
            for text, parts in zip(b["text"], b["parts"], strict=True):
                level = []
                for p in parts:
                    lo, cuts, ids = p["no"] * spread, np.cumsum([0, *p["counts"]]).tolist(), np.asarray(p["ids"]).tolist()
                    starts, ends = ((np.asarray(p[k]) + lo).tolist() for k in ("starts", "ends"))
                    level.append(Part(lo, min(len(text), lo + spread), starts, ends, [tuple(ids[x:y]) for x, y in zip(cuts, cuts[1:], strict=False)]))
                while len(level) > 1:
                    joined = [c.concatenate(text, x, y) for x, y in zip(level[::2], level[1::2], strict=False)]
                    level = joined + level[2 * len(joined) :]
                rows.append(c.described(level[0], texts))
            yield pd.concat([b[["key"]].reset_index(drop=True), frame(rows)], axis=1)

    own = [F.col(f"`{c}`") for c in docs.columns]
    made, key = unused(docs, "_coded", "_text")
    text = F.coalesce(F.col("text"), F.lit(""))
    short = docs.filter(F.length(text) <= spread).select(*own, code(text).alias(made))
    long = docs.filter(F.length(text) > spread).withColumn(key, F.sha2(F.col("text"), 256))
    whole = long.select(F.col(key).alias("key"), F.col("text").alias("text")).dropDuplicates(["key"])
    numbers = F.sequence(F.lit(0), F.floor((F.length("text") - 1) / spread).cast("int"))
    parts = whole.select("key", F.posexplode(F.transform(numbers, lambda k: F.substring(F.col("text"), k * spread + 1, F.lit(spread)))).alias("no", "part"))
    parts = parts.repartition(partitions(docs.sparkSession), "key", "no").select("key", "no", code_part("part").alias("p"))
    gathered = parts.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("no", "p.starts", "p.ends", "p.counts", "p.ids"))).alias("parts"))
    joined = whole.join(gathered, "key").select("key", "text", "parts").mapInPandas(join_parts, f"key string, {kind}")
    joined = joined.select(F.col("key").alias("_k"), F.struct(*fields).alias(made))
    rest = long.join(joined, F.col(key) == F.col("_k")).select(*own, made)
    return short.unionByName(rest).select(*own, *[F.col(f"{made}.{f}").alias(n) for f, n in zip(fields, unused(docs, *FIELDS), strict=False)])


def op7_bpe(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("word_bpe_49k.json")
    return encode_decode(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer, texts=False).drop("text")
