"""Exact encoding by the tokenizers library, with a memo of the short units that texts repeat.

Both public vocabularies used here split a text before a run of spaces or line feeds that follows something else, whatever stands on
either side, so a text is the concatenation of such units and each distinct unit needs the library once a worker. Texts for which
that isn't so (other white space, strings of special tokens) go to the library whole.
"""

from __future__ import annotations

import os
import re

#: Marks that both patterns always part from a letter before them when nothing follows.
MARKS = frozenset(".,!?;:")
#: Units remembered by a worker in each of two generations (about 300 MB in all): when the young one is full it becomes the old one,
#: from which units still in use come back.
MEMO = 700_000


def load(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


def byte_characters() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for 256 and up, in order."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) if b in shown else chr(256 + hidden.index(b)) for b in range(256)}


class Units(dict):
    """unit -> make(ids), through the library. lead: what stands before a unit where it is encoded; join: value of two units in a row;
    lower: whether the vocabulary lower-cases; memo: units of a generation."""

    def __init__(self, path: str, make, join, lead: str = "", lower: bool = False, memo: int = MEMO):
        super().__init__()
        self.tokenizer, self.make, self.join, self.lead, self.lower = load(path), make, join, lead, lower
        self.model, self.bytes, self.old, self.marks = self.tokenizer.model, byte_characters(), {}, {}
        self.memo, self.mapped_lead = memo, lead.translate(self.bytes)
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, added))) if added else None

    def whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def has_special(self, text: str) -> bool:
        return bool(self.special and self.special.search(text))

    def __missing__(self, unit: str):
        if len(self) >= self.memo:
            self.old = dict(self)
            self.clear()
        v = self.old.get(unit)
        if v is None:
            mark = unit[-1:]
            before = unit[-2:-1].lower() if self.lower else unit[-2:-1]
            if mark in MARKS and before[-1:].isalpha():  # some capitals end in a combining mark when lowered
                if mark not in self.marks:
                    self.marks[mark] = self.make(self.whole(mark))
                v = self.join(self[unit[:-1]], self.marks[mark])
            else:
                v = self.make(self.ids(unit))
        self[unit] = v
        return v

    def ids(self, unit: str) -> list[int]:
        """Latin letters are one pre-token whose bytes go to the library's model as they are; all else takes the whole way."""
        u = unit.lower() if self.lower else unit
        if u.isascii() and u.isalpha():
            return [t.id for t in self.model.tokenize(self.mapped_lead + u)]
        if u.isalpha() and max(u) < "\u0250":
            return [t.id for t in self.model.tokenize((self.lead + u).encode().decode("latin-1").translate(self.bytes))]
        return self.whole(self.lead + unit)
