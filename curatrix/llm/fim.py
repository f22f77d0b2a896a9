"""Operator 11: fill-in-the-middle, with cuts found through a Fenwick tree over fixed blocks of the text.

A text is a run of units (code points, words, lines: any pattern matched from left to right). Its UTF-8 bytes are cut into fixed blocks, and a
Fenwick tree holds how many units and code points start in each. A cut "after k units" goes down the tree by powers of two to the block where
unit k starts, with the code points before it, and only that block is searched for the unit's end. The Arrow function gives numbers alone; Spark
puts the outputs together and takes them apart again, so no text comes back from Python.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from curatrix.llm.common import table, unused

#: Bytes of a block.
BLOCK = 4096
#: Unit of the registered query: every code point.
CODE_POINT = r"(?s:.)"
WORDS, LINES = r"[^\x20\x09-\x0D]+", r"[^\n]*\n|[^\n]+"


@dataclass(frozen=True)
class Marks:
    """Strings that name the three parts. None may begin as another or itself ends: then no mark can arise where a text meets one."""

    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"

    def __post_init__(self) -> None:
        for i, a in enumerate(self.all):
            for j, b in enumerate(self.all):
                if not a or (i != j and a in b) or any(a.endswith(b[:k]) for k in range(1, len(b))):
                    raise ValueError(f"marks {a!r} and {b!r} overlap")

    @property
    def all(self) -> tuple[str, str, str]:
        return self.prefix, self.suffix, self.middle


class Blocks:
    """Fenwick tree over a text's blocks: node i sums units and code points of the blocks i - (i & -i) to i - 1."""

    def __init__(self, text: str, unit: str = CODE_POINT, block: int = BLOCK):
        self.text, self.unit = text, None if unit == CODE_POINT else re.compile(unit)
        starts_here = (np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8) & 0xC0) != 0x80
        points = np.add.reduceat(starts_here, np.arange(0, len(starts_here), block), dtype=np.int64) if len(starts_here) else np.zeros(0, np.int64)
        units = points if self.unit is None else np.zeros(len(points), np.int64)
        self.first = np.full(len(points), -1)  # where the first unit of a block starts, in code points
        if self.unit:
            ends = np.cumsum(points)
            at, end = 0, int(ends[0]) if len(ends) else 0
            for m in self.unit.finditer(text):
                if m.end() == m.start():
                    continue
                while m.start() >= end:
                    at += 1
                    end = int(ends[at])
                if self.first[at] < 0:
                    self.first[at] = m.start()
                units[at] += 1
        self.n = int(units.sum())
        tree = np.zeros((len(points) + 1, 2), np.int64)
        tree[1:, 0], tree[1:, 1] = units, points
        for i in range(1, len(tree)):
            if (up := i + (i & -i)) < len(tree):
                tree[up] += tree[i]
        self.tree = tree.tolist()

    def after(self, k: int) -> int:
        """Code points up to the end of the k-th unit (0: none)."""
        if k <= 0:
            return 0
        at, points, step = 0, 0, 1 << (len(self.tree) - 1).bit_length()
        while step:
            if at + step < len(self.tree) and self.tree[at + step][0] < k:
                at += step
                k -= self.tree[at][0]
                points += self.tree[at][1]
            step >>= 1
        if self.unit is None:
            return points + k
        for m in self.unit.finditer(self.text, int(self.first[at])):
            k -= m.end() > m.start()
            if not k:
                return m.end()
        raise AssertionError("the tree counts more units than the text has")


def _cuts(unit: str, block: int):
    def cuts(text: pd.Series, one: pd.Series, two: pd.Series) -> pd.DataFrame:
        out = np.zeros((len(text), 3), np.int64)
        for i, (t, a, b) in enumerate(zip(text, one, two, strict=True)):
            blocks = Blocks(t, unit, block)
            a, b = a % (blocks.n + 1), b % (blocks.n + 1)
            out[i] = blocks.n, blocks.after(min(a, b)), blocks.after(max(a, b))
        return pd.DataFrame(out, columns=["n", "low", "high"])

    return F.pandas_udf(cuts, "n long, low long, high long")


def draws(doc_id: Column, seed: int) -> list[Column]:
    """Four numbers below 2^32 of a document: the first 8-digit groups of the hex sha256 of `seed:id` (null: no id)."""
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(h, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]


def fill_in_middle(docs: DataFrame, unit: str = CODE_POINT, seed: int = 1, plain: int = 10, spm: int = 20, marks: Marks = Marks(), block: int = BLOCK) -> DataFrame:
    """docs plus n (units), form, prefix_chars, middle_chars (code points; null if plain) and output.

    Needs doc_id and text. Texts without units or with a mark in them stay plain, as do `plain` percent of the others; `spm` percent of the rest
    take the suffix first. Null texts are empty; null ids draw like an empty id; rows that share an id and text fare alike; an empty table gives
    no rows. A text is held whole by its task, with 32 bytes a block of it besides. Columns of the same names are kept: the new ones then get
    trailing underscores.
    """
    names = unused(docs, "n", "form", "prefix_chars", "middle_chars", "output")
    text, cut, form, draw = unused(docs, "_text", "_cut", "_form", "_draw")
    own = [F.col(f"`{c}`") for c in docs.columns]
    df = docs.select(*own, F.coalesce("text", F.lit("")).alias(text), F.array(*draws(F.col("doc_id"), seed)).alias(draw))
    df = df.withColumn(cut, _cuts(unit, block)(F.col(text), F.col(draw)[0], F.col(draw)[1]))
    t, n, low, high = F.col(text), F.col(cut)["n"], F.col(cut)["low"].cast("int"), F.col(cut)["high"].cast("int")
    marked = t.contains(marks.prefix) | t.contains(marks.suffix) | t.contains(marks.middle)
    kind = F.when((n == 0) | marked | (F.col(draw)[2] % 100 >= 100 - plain), "plain").when(F.col(draw)[3] % 100 < spm, "spm").otherwise("psm")
    df = df.withColumn(form, kind)
    p, m, s = F.substring(t, F.lit(1), low), F.substring(t, low + 1, high - low), F.substring(t, high + 1, F.length(t))
    psm = F.concat(F.lit(marks.prefix), p, F.lit(marks.suffix), s, F.lit(marks.middle), m)
    spm_text = F.concat(F.lit(marks.suffix), s, F.lit(marks.prefix), p, F.lit(marks.middle), m)
    output = F.when(F.col(form) == "plain", t).when(F.col(form) == "psm", psm).otherwise(spm_text)
    cut_only = lambda c: F.when(F.col(form) != "plain", c.cast("long"))
    made = [n, F.col(form), cut_only(low), cut_only(high - low), output]
    return df.select(*own, *[c.alias(k) for c, k in zip(made, names, strict=True)])


def restored(output: Column, form: Column, marks: Marks = Marks()) -> Column:
    """The text, from an output and its form."""

    def between(a: str, b: str | None) -> Column:
        start = F.locate(a, output) + len(a)
        return F.substring(output, start, (F.locate(b, output) - start) if b else F.length(output))

    p, s, m = marks.all
    return F.when(form == "psm", F.concat(between(p, s), between(m, None), between(s, m))).when(form == "spm", F.concat(between(p, m), between(m, None), between(s, p))).otherwise(output)


def op11_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


OP11_SQL = """
with d as (select doc_id, coalesce(text, '') t, sha256('1:' || coalesce(cast(doc_id as varchar), '')) h from documents),
k as (select *, cast(length(t) as bigint) n, [cast('0x' || substr(h, 1 + 8 * i, 8) as bigint) for i in range(4)] r from d),
c as (select *, least(r[1] % (n + 1), r[2] % (n + 1)) a, greatest(r[1] % (n + 1), r[2] % (n + 1)) b,
  case when n = 0 or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or r[3] % 100 >= 90 then 'plain' when r[4] % 100 < 20 then 'spm' else 'psm' end form from k),
p as (select *, substr(t, 1, a) p, substr(t, a + 1, b - a) m, substr(t, b + 1) s from c),
o as (select *, case form when 'plain' then t when 'psm' then '<P>' || p || '<S>' || s || '<M>' || m else '<S>' || s || '<P>' || p || '<M>' || m end output from p)
select doc_id, n, form, case when form <> 'plain' then a end prefix_chars, case when form <> 'plain' then b - a end middle_chars, sha256(output) output_sha256, sha256(t) restored_sha256 from o
"""
