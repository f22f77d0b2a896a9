"""Operator 3: SimHash near-duplicates through a vantage-point tree.

Documents with one fingerprint collapse into a point. A tree fitted on a bounded sample of points sends each point to one home leaf by
its distances to vantage points; where a point lies so near a split that the triangle inequality can't keep a partner out of the other
side, it also visits that side. Leaves join independently, exactly, and the links' connected components are the groups. A leaf of more
points than the sample can part gets a tree of its own, fitted on a sample of the leaf.

A rule of similarity between sets of shingles (deduplicate) takes the same way: the tree's links, fingerprints within the radius, are
candidates, and the sets decide. It allows so many differing bits that on unrelated texts only splits by size, which are distances from
the smallest set, keep partners out. So a second bound prunes what is left of a point's visits: two sets can only share the ratio of
their union if they have a shingle in common among their first ones (prefix), in an order that takes common shingles last; points
of a leaf that have such a shingle in common are compared in blocks, and a point visits only chunks where it has a candidate.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from curatrix.llm.common import hot_join, materialize, partitions, row_hash, table, unused
from curatrix.llm.graph import components
from curatrix.llm.rangejoin import CHUNK, chunks, joined, link

WORDS, BITS, RADIUS = 3, 64, 2
#: Points that a level of the tree is fitted on (about, twice as many at most); it has at most SAMPLE / 16 leaves.
SAMPLE = 32_768
#: Pairs whose bits are counted at a time.
TILE = 1 << 16
#: Texts (about) in which shingles are counted for the order of an exact rule, and shingles found common at most.
COUNTED, COMMON = 8_192, 131_072


def fingerprint(text: str, words: int = WORDS, bits: int = BITS) -> tuple[bytes, int]:
    """Big-endian SimHash of the text's shingles and their number. A bit is 1 if it is 1 in over half of the shingles' hashes: 64 bits
    are XXH64 (seed 42), further words of 64 are that hash mixed with the word's number. No words: all zero, no shingles."""
    return _votes(_hashes(text.encode("utf-8", "surrogatepass"), words), bits)


#: Shingles hashed, and hashes voting, at a time.
SLICE = 255 * 64


def _hashes(text: bytes, words: int, distinct: bool = False) -> np.ndarray:
    """XXH64 (seed 42) of every shingle, repeats included, or sorted and each once."""
    w = text.lower().split()
    if 0 < len(w) < words:
        w, words = [b" ".join(w)], 1
    out = [np.zeros(0, np.uint64)]
    for at in range(0, len(w) - words + 1, SLICE):
        part = w[at : at + SLICE + words - 1]
        shingles = map(b" ".join, zip(*[part[i:] for i in range(words)], strict=False))
        out.append(np.array([xxhash.xxh64_intdigest(s, 42) for s in shingles], np.uint64))
    h = np.concatenate(out)
    return np.unique(h) if distinct else h


def _votes(h: np.ndarray, bits: int) -> tuple[bytes, int]:
    total = np.zeros(bits, np.int64)
    for at in range(0, len(h), SLICE):
        part = h[at : at + SLICE]
        n = len(part)
        words = np.stack([part, *[_mixed(part, k) for k in range(1, bits // 64)]], axis=1)
        ones = np.unpackbits(words.astype(">u8").view(np.uint8), axis=1)
        whole = n // 255 * 255
        total += ones[:whole].reshape(-1, 255, bits).sum(1, dtype=np.uint8).sum(0, dtype=np.int64) + ones[whole:].sum(0, dtype=np.uint8)
    return np.packbits(2 * total > len(h)).tobytes(), len(h)


def _mixed(h: np.ndarray, k: int) -> np.ndarray:
    """The finaliser of SplitMix64 over h plus k steps."""
    z = h + np.uint64(k * 0x9E3779B97F4A7C15 % 2**64)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def common(docs: DataFrame, text: str, words: int) -> np.ndarray:
    """Hashes of shingles that stand in two or more of about COUNTED different texts, the least common first. They only order the shingles of
    a set: the prefixes keep what they promise whatever the sample is."""
    share = COUNTED / max(1, docs.count())
    some = docs.select(F.coalesce(F.col(text), F.lit("")).alias("text"))
    if share < 1:
        some = some.filter(F.shiftrightunsigned(F.xxhash64("text"), 32) < int(share * 2**32))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for t in b["text"]:
                yield pd.DataFrame({"h": _hashes(t.encode("utf-8", "surrogatepass"), words, True).view(np.int64)})

    found = some.distinct().mapInPandas(run, "h long").groupBy("h").agg(F.count("*").alias("n")).filter("n > 1")
    return found.orderBy(F.desc("n"), "h").limit(COMMON).toPandas()["h"].to_numpy(np.int64).view(np.uint64)[::-1]


def prefix(h: np.ndarray, last: tuple[np.ndarray, np.ndarray], ratio: float) -> np.ndarray:
    """The first of a set's sorted hashes: by hash, but those of last (sorted hashes and the rank of each) after all others, by rank. Sets that
    share `ratio` of their union share that part of the larger one; a prefix is one more than the rest, so their prefixes have one in common."""
    known, rank = last
    n = len(h) - math.ceil(ratio * len(h) - 1e-9) + 1 if len(h) else 0
    at = np.minimum(np.searchsorted(known, h), max(0, len(known) - 1))
    late = known[at] == h if len(known) else np.zeros(len(h), bool)
    return np.concatenate([h[~late], h[late][np.argsort(rank[at[late]])]])[:n]


def fingerprints(docs: DataFrame, text: str, words: int = WORDS, bits: int = BITS, ratio: float | None = None) -> DataFrame:
    """docs plus fp binary and shingles long, without the text column. Null text counts as empty. ratio, of an exact rule: a shingle votes and
    counts once however often it stands, digest binary holds 16 bytes of their set and prefix array<long> its first hashes."""
    rest, exact = [c for c in docs.columns if c != text], ratio is not None
    order = common(docs, text, words) if exact else np.zeros(0, np.uint64)
    last = np.sort(order), np.argsort(order)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            hashes = [_hashes(t.encode("utf-8", "surrogatepass"), words, exact) for t in b.pop(text)]
            made = [_votes(h, bits) for h in hashes]
            b = b.assign(fp=[m[0] for m in made], shingles=[m[1] for m in made])
            if exact:
                b = b.assign(digest=[xxhash.xxh3_128_digest(h.tobytes()) for h in hashes], prefix=[prefix(h, last, ratio).view(np.int64) for h in hashes])
            yield b

    schema = ", ".join(f"`{c}` {t}" for c, t in docs.select(*rest).dtypes) + ", fp binary, shingles long" + ", digest binary, prefix array<long>" * exact
    return docs.withColumn(text, F.coalesce(F.col(text), F.lit(""))).mapInPandas(run, schema)


@dataclass
class Points:
    """Fingerprints as rows of 64-bit words, logarithms of shingle counts (all 0 where sizes don't matter), and, for the exact check,
    sorted hashes of each one's set of shingles."""

    words: np.ndarray
    size: np.ndarray
    sets: np.ndarray | None = None

    def __len__(self) -> int:
        return len(self.size)

    def __getitem__(self, at) -> Points:
        return Points(self.words[at], self.size[at], None if self.sets is None else self.sets[at])


@dataclass
class Rule:
    """Two points link if at most `radius` bits differ and, where ratio is given, the smaller shingle count is at least ratio times the
    larger. Both are metric balls: of Hamming distance and of the distance between logarithms of counts. leaf: points of a leaf. exact
    (deduplicate only): shingles are taken once each, such pairs are candidates, and they link if their sets of shingles share ratio of
    their union or more."""

    bits: int = BITS
    radius: int = RADIUS
    ratio: float | None = None
    leaf: int = CHUNK
    exact: bool = False

    @property
    def width(self) -> int:
        return self.bits // 8 + 8 + 16 * self.exact

    def parse(self, data: Sequence[bytes]) -> Points:
        end = self.bits // 8
        raw = np.frombuffer(b"".join(data), np.uint8).reshape(len(data), self.width)
        words = np.ascontiguousarray(raw[:, :end]).view(">u8").astype(np.uint64)
        n = np.ascontiguousarray(raw[:, end : end + 8]).view(">u8")[:, 0].astype(np.float64)
        return Points(words, np.log(np.maximum(n, 0.5)) if self.ratio else np.zeros(len(data)))

    @property
    def spread(self) -> float:
        return -np.log(self.ratio) + 1e-9 if self.ratio else 0.0

    def hamming(self, a: Points, b: Points) -> np.ndarray:
        d = np.bitwise_count(a.words[None, :, 0] ^ b.words[:, None, 0]).astype(np.uint16)
        for k in range(1, a.words.shape[1]):
            d += np.bitwise_count(a.words[None, :, k] ^ b.words[:, None, k])
        return d

    def near(self, homes: Points, points: Points) -> np.ndarray:
        """Points x homes. Three words' bits, which fit a byte, rule out most pairs; the rest and the sizes are looked at where they don't."""
        hit, step = np.zeros((len(points), len(homes)), bool), max(1, TILE // max(1, len(points)))
        first, rest = homes.words[:, :3].T.copy(), range(3, homes.words.shape[1])
        for at in range(0, len(homes), step):
            d = np.bitwise_count(first[0, at : at + step] ^ points.words[:, :1])
            for k in range(1, len(first)):
                d += np.bitwise_count(first[k, at : at + step] ^ points.words[:, k : k + 1])
            np.less_equal(d, self.radius, out=hit[:, at : at + step])
        if rest or self.ratio:
            p, h = np.nonzero(hit)
            ok = self.far(homes.words[h], points.words[p]) <= self.radius
            if self.ratio:
                ok &= np.abs(homes.size[h] - points.size[p]) <= self.spread
            hit[p, h] = ok
        return hit

    def far(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.bitwise_count(a ^ b).sum(1, dtype=np.uint16)

    def same(self, a: np.ndarray, b: np.ndarray) -> bool:
        both = len(np.intersect1d(a, b, assume_unique=True))
        return both >= self.ratio * (len(a) + len(b) - both) - 1e-9


class VantageTree:
    """Nodes as arrays: a vantage fingerprint (or, for a split by size, none), its threshold and children; leaves are numbered."""

    def __init__(self, sample: Points, rule: Rule, leaves: int):
        self.rule, self.leaves = rule, 0
        self.root = self._grow(sample, max(1, leaves), np.random.default_rng(7))

    def _grow(self, s: Points, leaves: int, rng) -> tuple:
        best = None
        if leaves > 1 and len(s) >= 16:
            tries = [(None, s.size, self.rule.spread)] if self.rule.ratio else []
            for k in rng.choice(len(s), 6, replace=False):
                tries.append((s[k : k + 1], self.rule.hamming(s[k : k + 1], s)[:, 0].astype(float), float(self.rule.radius)))
            for vantage, d, r in tries:
                for q in (0.35, 0.5, 0.65):
                    t = float(np.quantile(d, q, method="lower"))
                    low, band = np.mean(d <= t), np.mean((d > t - r) & (d <= t + r))
                    if 0.2 <= low <= 0.8 and band < 0.8 and (best is None or band < best[0]):
                        best = (band, vantage, t, r, d <= t)
        if best is None:
            self.leaves += 1
            return (self.leaves - 1,)
        _, vantage, t, r, low = best
        part = max(1, min(leaves - 1, round(leaves * float(np.mean(low)))))
        return (vantage, t, r, self._grow(s[low], part, rng), self._grow(s[~low], leaves - part, rng))

    def place(self, p: Points, visitor: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, leaf, visits): one home leaf for every row that isn't a visitor already, and the leaves rows visit. Of two linked points
        that a split parts, the one on the low side is the visitor, so no pair is looked for twice."""
        out: list[tuple] = []
        visitor = np.zeros(len(p), bool) if visitor is None else visitor
        todo = [(self.root, np.flatnonzero(~visitor), np.flatnonzero(visitor))]
        while todo:
            node, homes, visits = todo.pop()
            if len(node) == 1:
                out += [(homes, node[0], False), (visits, node[0], True)]
                continue
            vantage, t, r, low, high = node
            far = lambda at: p.size[at] if vantage is None else self.rule.hamming(vantage, p[at])[:, 0].astype(float)  # noqa: E731, B023
            d, e = far(homes), far(visits)
            left, right = (homes[d <= t], visits[e <= t + r]), (homes[d > t], np.concatenate([homes[(d <= t) & (d > t - r)], visits[e > t - r]]))
            todo += [(child, *x) for child, x in ((low, left), (high, right)) if len(x[0]) or len(x[1])]
        return np.concatenate([x[0] for x in out]), np.concatenate([np.full(len(x[0]), x[1]) for x in out]), np.concatenate([np.full(len(x[0]), x[2]) for x in out])


SEATS = "cell int, visitor boolean, id binary, data binary, weight long"


def _seated(rows: DataFrame, trees: dict[int, tuple[VantageTree, int]], rule: Rule) -> DataFrame:
    """Seats in the leaves of their cell's tree, numbered from the tree's first number."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for cell, part in b.groupby("cell"):
                tree, first = trees[cell]
                row, leaf, visitor = tree.place(rule.parse(part["data"]), part["visitor"].to_numpy(bool))
                yield pd.DataFrame({"cell": leaf + first, "visitor": visitor.astype(bool), **{c: part[c].to_numpy()[row] for c in ("id", "data", "weight")}})

    return rows.mapInPandas(run, SEATS)


def seats(points: DataFrame, rule: Rule, sample: int = SAMPLE) -> DataFrame:
    """points (id, data) in the leaves of the tree. A round fits the trees of as many cells as need sample / 16 leaves together, on about
    64 points a leaf and 2 * sample at most; leaves above 4 times the rule's size become cells of later rounds, until there are none or
    none that can be parted. So rounds grow with the points, by one for each 2,048 leaves, and each works on its own cells only."""
    placed = points.select(F.lit(0).alias("cell"), F.lit(False).alias("visitor"), "id", "data", F.lit(1).cast("long").alias("weight"))
    todo, tables, most, free = [(0, points.count(), 0)], [placed], max(2, sample // 16), 1  # todo: cell, its homes, its table
    done = []
    while todo:
        now, leaves = [], 0
        while todo and (not now or (leaves + -(-todo[-1][1] // rule.leaf) <= most and todo[-1][2] == now[0][2])):
            now.append(todo.pop())
            leaves += -(-now[-1][1] // rule.leaf)
        own = tables[now[0][2]].filter(F.col("cell").isin([c for c, _, _ in now]))
        homes = max(1, sum(n for _, n, _ in now))
        share = min(sample, 64 * min(leaves, most)) / homes
        chosen = own.filter(~F.col("visitor"))
        if share < 1:
            chosen = chosen.filter(F.shiftrightunsigned(F.xxhash64("data", F.lit(free)), 32) < int(share * 2**32))
        chosen = chosen.select("cell", "data").limit(2 * sample).toPandas().sort_values("data")
        trees, parted = {}, set()
        for cell, n, _ in now:
            tree = VantageTree(rule.parse(chosen["data"][chosen["cell"] == cell]), rule, min(most, -(-n // rule.leaf)))
            trees[cell] = tree, free
            parted |= set(range(free, free + tree.leaves)) if tree.leaves > 1 else set()
            free += tree.leaves
        new = materialize(_seated(own, trees, rule), "leaves")
        big = new.filter("not visitor").groupBy("cell").count().filter(F.col("count") > 4 * rule.leaf).collect()
        later = [(r["cell"], r["count"], len(tables)) for r in big if r["cell"] in parted]
        tables.append(new)
        todo += later
        done.append(new.filter(~F.col("cell").isin([c for c, _, _ in later])) if later else new)
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def linked(points: DataFrame, rule: Rule, sample: int = SAMPLE, meets: Callable | None = None) -> DataFrame:
    """points (id binary, data binary: fingerprint and 8 bytes of shingle count; all different) -> (id, component): the ids that have a link,
    with the smallest id reachable. meets (see rangejoin.chunks) may keep points out of chunks where they have no partner."""
    return components(link(seats(points, rule, sample), rule.parse, rule.near, "binary", chunk=rule.leaf, meets=meets).select("a", "b"))


def lists(prefixes: DataFrame) -> DataFrame:
    """prefixes (point long, prefix array<long>) -> (list, point): for every shingle in the prefixes of two or more points, the points that
    have it. Shingles of the same points make one list; a list's number comes from its points, and lists that share one are united."""

    def made(h: np.ndarray, points: np.ndarray) -> pd.DataFrame:
        new = np.append(True, (h[1:] != h[:-1]) | (points[1:] != points[:-1]))  # copies of one point stand next to each other
        h, points = h[new], points[new]
        start = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
        n = np.diff(np.append(start, len(h)))
        return pd.DataFrame({"list": np.repeat(np.bitwise_xor.reduceat(points, start), n), "point": points})[np.repeat(n > 1, n)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple[np.ndarray, np.ndarray]] = []  # what the last shingle, which may go on in the next batch, stands in
        for b in batches:
            h, points = b["h"].to_numpy(np.int64), b["point"].to_numpy(np.int64)
            if len(h) == 0:
                continue
            if held and h[-1] != held[0][0][0]:
                cut = int(np.searchsorted(h, h[-1]))
                held.append((h[:cut], points[:cut]))
                yield made(*map(np.concatenate, zip(*held, strict=True)))
                held, h, points = [], h[cut:], points[cut:]
            held.append((h, points))
        if held:
            yield made(*map(np.concatenate, zip(*held, strict=True)))

    rows = prefixes.select("point", F.explode("prefix").alias("h"))
    return rows.repartition(partitions(prefixes.sparkSession), "h").sortWithinPartitions("h", "point").mapInPandas(run, "list long, point long").distinct()


def sharing(met: DataFrame, rule: Rule) -> Callable[[DataFrame], DataFrame]:
    """met (list, point: hash of a point's data) -> where a point has partners that the rule's candidates need: the points of a leaf meet in blocks of
    lists (about a quarter of rule.leaf together, so that blocks grow in number, not in size), each block's links are folded into a spanning forest, and
    an edge sends one of its ends to the other's home. So visits are at most as many as points in blocks, however many links a group has."""

    def meets(seats: DataFrame) -> DataFrame:
        leaves = max(1, seats.select("cell").distinct().count())
        packs = max(1, -(-4 * met.count() // (rule.leaf * leaves)))
        listed = seats.withColumn("point", F.xxhash64("data")).join(met, "point")
        block = F.xxhash64("cell", F.pmod("list", F.lit(packs)))
        listed = listed.select("point", block.alias("cell"), (F.col("own") < 0).alias("visitor"), "id", "data").distinct().drop("point")
        blocks = chunks(materialize(listed.withColumn("weight", F.lit(1).cast("long")), "listed"), rule.leaf)
        edges = joined(blocks, rule.parse, rule.near, "binary").filter("a <> b").select("a", "b")
        both = materialize(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "met")
        home = seats.filter("own >= 0").select(F.col("id").alias("b"), "cell", F.col("own").alias("chunk"))
        seat = seats.select(F.col("id").alias("a"), "cell", "own")
        visits = both.join(home, "b").join(seat, ["a", "cell"]).filter(F.col("chunk") > F.col("own"))
        return visits.select(F.col("a").alias("id"), "cell", "chunk").distinct()

    return meets


def verified(found: DataFrame, points: DataFrame, texts: DataFrame, rule: Rule, words: int) -> DataFrame:
    """found (id, component) of candidates, points (id, data) and texts (id, text), a row an id -> (id, component) of those that link exactly.

    A component of candidates is a cell: all its pairs are candidates again and the sets decide, so no link is lost with the forest that
    is kept of them. A pair is compared only while its ends are in different components.
    """
    data = F.concat("data", F.coalesce("text", F.lit("")).cast("binary"))
    placed = found.join(points.select("id", "data"), "id").join(texts, "id")
    placed = placed.select(F.xxhash64("component").alias("cell"), F.lit(False).alias("visitor"), "id", data.alias("data"), F.lit(1).cast("long").alias("weight"))

    def parse(rows: pd.Series) -> Points:
        p = rule.parse([r[: rule.width] for r in rows])
        p.sets = np.empty(len(rows), object)
        p.sets[:] = [_hashes(r[rule.width :], words, distinct=True) for r in rows]
        return p

    sure = lambda homes, i, points, k: rule.same(homes.sets[i], points.sets[k])
    return components(link(materialize(placed, "candidates"), parse, rule.near, "binary", sure=sure).select("a", "b"))


def sort_key(doc_id: Column, row: Column) -> Column:
    """17 bytes that order as: rows with an id first, then by id (integers), then by the 64 bits of row."""
    flipped = F.coalesce(doc_id.cast("long"), F.lit(0)).bitwiseXOR(F.lit(-(2**63)))
    return F.concat(F.when(doc_id.isNull(), F.unhex(F.lit("01"))).otherwise(F.unhex(F.lit("00"))), *[F.unhex(F.lpad(F.hex(x), 16, "0")) for x in (flipped, row)])


def key_id(key: Column) -> Column:
    """The id of a sort key."""
    flipped = F.conv(F.hex(F.substring(key, 2, 8)), 16, -10).cast("long")
    return F.when(F.hex(F.substring(key, 1, 1)) == "00", flipped.bitwiseXOR(F.lit(-(2**63))))


def groups(keyed: DataFrame, rule: Rule, texts: DataFrame | None = None, words: int = WORDS) -> DataFrame:
    """keyed (fp, shingles, key: binary) -> (data, low, copies): every point with the smallest key of its component and the number of its
    rows. An exact rule needs keyed's digest and prefix, and texts (id: a key, text), a row a key."""
    points = materialize(keyed.groupBy(point(rule).alias("data")).agg(F.min("key").alias("id"), F.count("*").alias("copies")), "points")
    meets = sharing(materialize(lists(keyed.select(F.xxhash64(point(rule)).alias("point"), "prefix")), "lists"), rule) if rule.exact else None
    near = materialize(linked(points.select("id", "data"), rule, meets=meets), "links")
    if rule.exact:
        near = materialize(verified(near, points, texts, rule, words), "links")
    return points.join(near.withColumnRenamed("id", "_id"), F.col("id") == F.col("_id"), "left").select("data", F.coalesce("component", "id").alias("low"), "copies")


def point(rule: Rule) -> Column:
    """Fingerprint, the shingle count where the rule looks at it (else zero) and the digest where it is exact, as bytes."""
    n = F.col("shingles") if rule.ratio else F.lit(0)
    return F.concat(F.col("fp"), F.unhex(F.lpad(F.hex(n.cast("long")), 16, "0")), *[F.col("digest")] * rule.exact)


def near_duplicates(docs: DataFrame, words: int = WORDS, rule: Rule | None = None) -> DataFrame:
    """(doc_id, fingerprint, component_id), a row for each of docs (doc_id: an integer, text): 16 hex digits a 64-bit word, and the smallest
    doc_id reachable through links, its own included.

    Null text counts as empty: no words, fingerprint zero, linked like any other. Null ids never become a component_id unless the
    whole component has no other. Repeated rows come back as often as they stand. An empty table gives no rows.
    """
    rule = rule or Rule()
    if rule.exact:
        raise ValueError("one doc_id may have several texts here: exact rules are for deduplicate")
    prints = fingerprints(docs.select("doc_id", "text"), "text", words, rule.bits)
    prints = materialize(prints.withColumn("data", point(rule)), "prints")
    # ids of one point's rows order alike whatever the rest of the key is; the point keeps keys of different points apart
    low = materialize(groups(prints.withColumn("key", sort_key(F.col("doc_id"), F.xxhash64("data"))), rule), "lows")
    out = hot_join(prints, low, "data", prints.count())
    return out.select("doc_id", F.lower(F.hex("fp")).alias("fingerprint"), key_id(F.col("low")).cast(docs.schema["doc_id"].dataType).alias("component_id"))


def deduplicate(docs: DataFrame, words: int = WORDS, rule: Rule | None = None) -> DataFrame:
    """The rows of docs, one of each group of near-duplicates: the lowest doc_id (an integer; null last), then the lowest hash of the row.
    Null text counts as empty, empty texts are alike; rows that are wholly alike count as one; an empty table stays empty."""
    rule = rule or Rule()
    own, (k_key,) = docs.columns, unused(docs, "_key")
    with_key = docs.withColumn(k_key, sort_key(F.col("doc_id"), row_hash(docs)))
    keyed = with_key.select(F.col(k_key).alias("key"), F.col("text").alias("text"))
    prints = materialize(fingerprints(keyed, "text", words, rule.bits, rule.ratio if rule.exact else None), "prints")
    repeats = materialize(prints.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("key").alias("_k")), "repeats")
    several = not repeats.isEmpty()
    texts = (keyed.dropDuplicates(["key"]) if several else keyed).withColumnRenamed("key", "id")
    keep = materialize(groups(prints, rule, texts, words).select(F.col("low").alias("_low")).distinct(), "keep")
    kept = with_key.join(keep, F.col(k_key) == F.col("_low"), "left_semi")
    if several:  # rows that stand several times, wholly alike: one of each
        again = F.col(k_key) == F.col("_k")
        kept = kept.join(repeats, again, "left_anti").unionByName(kept.join(repeats, again, "left_semi").dropDuplicates([k_key]))
    return kept.select(*[F.col(f"`{c}`") for c in own])


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
