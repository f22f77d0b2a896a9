"""Operator 2: token ids as fixed-width bit-packed files.

A file holds the ids of consecutive documents (ascending doc_id), each in the fewest bits the vocabulary needs. All numbers are
little-endian.

    blocks    ids in blocks of the stated number; in each, 64 ids fill `bits` 64-bit words, lowest bits first, the last ones padded
    tables    u64 block offsets (blocks + 1), i64 doc ids, u8 is-null flags, u64 number of ids before each document (documents + 1)
    trailer   8s magic, u32 version, u32 bits an id, u32 ids a block, u32 0, u64 documents, u64 ids, u64 place of the tables

Any id is found with one division and one read of its block, and a block is unpacked with 64 numpy operations.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from curatrix.llm.common import fresh_path, materialize, partitions, table
from curatrix.llm.encoding import Units

MAGIC, TRAILER = b"CRTXIDS1", struct.Struct("<8sIIIIQQQ")
BLOCK = 4096
END_ID = 0


def vocabulary_bits(size: int) -> int:
    """Fewest bits that hold the ids 0 .. size - 1."""
    return max(1, int(size - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """64 ids to `bits` words; the last group is padded with zeros."""
    groups = -(-len(ids) // 64)
    a = np.zeros(groups * 64, np.uint64)
    a[: len(ids)] = ids
    a, out = a.reshape(groups, 64), np.zeros((groups, bits), np.uint64)
    for j in range(64):
        word, shift = divmod(j * bits, 64)
        out[:, word] |= a[:, j] << np.uint64(shift)
        if shift + bits > 64:
            out[:, word + 1] |= a[:, j] >> np.uint64(64 - shift)
    return out.astype("<u8").tobytes()


def unpack(data: bytes, bits: int, n: int) -> np.ndarray:
    words = np.frombuffer(data, "<u8").reshape(-1, bits)
    out, mask = np.empty((len(words), 64), np.uint32), np.uint64(2**bits - 1)
    for j in range(64):
        word, shift = divmod(j * bits, 64)
        v = words[:, word] >> np.uint64(shift)
        if shift + bits > 64:
            v = v | words[:, word + 1] << np.uint64(64 - shift)
        out[:, j] = v & mask
    return out.reshape(-1)[:n]


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


class FileWriter:
    """Writes under a temporary name and renames when closed, so that a task that runs twice leaves one whole file."""

    def __init__(self, uri: str, bits: int, block: int = BLOCK):
        self.bits, self.block, self.n = bits, block, 0
        self.fs, self.path = _filesystem(uri)
        self.temporary = f"{self.path}.{uuid.uuid4().hex}"
        self.out = self.fs.open_output_stream(self.temporary)
        self.offsets, self.ids, self.nulls, self.starts = [0], [], [], [0]
        self.waiting, self.held = [], 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.ids.append(0 if doc_id is None else doc_id)
        self.nulls.append(doc_id is None)
        self.n += len(ids)
        self.starts.append(self.n)
        self.waiting.append(ids)
        self.held += len(ids)
        if self.held >= 64 * self.block:
            self._flush(self.held // self.block * self.block)

    def _flush(self, upto: int) -> None:
        a = np.concatenate(self.waiting) if self.waiting else np.zeros(0, np.uint32)
        for at in range(0, upto, self.block):
            data = pack(a[at : min(upto, at + self.block)], self.bits)
            self.out.write(data)
            self.offsets.append(self.offsets[-1] + len(data))
        self.waiting, self.held = [a[upto:]], len(a) - upto

    def close(self) -> None:
        self._flush(self.held)
        for a, kind in ((self.offsets, "<u8"), (self.ids, "<i8"), (self.nulls, "u1"), (self.starts, "<u8")):
            self.out.write(np.asarray(a, kind).tobytes())
        self.out.write(TRAILER.pack(MAGIC, 1, self.bits, self.block, 0, len(self.ids), self.n, self.offsets[-1]))
        self.out.close()
        self.fs.move(self.temporary, self.path)


class FileReader:
    """Random access to one file."""

    def __init__(self, uri: str):
        self.fs, path = _filesystem(uri)
        self.file = self.fs.open_input_file(path)
        end = self.file.size()
        magic, version, self.bits, self.block, _, docs, self.n, at = TRAILER.unpack(self.file.read_at(TRAILER.size, end - TRAILER.size))
        if (magic, version) != (MAGIC, 1):
            raise ValueError(f"not a token file: {uri}")
        raw, blocks = self.file.read_at(end - TRAILER.size - at, at), -(-self.n // self.block)
        take = lambda kind, n, p: np.frombuffer(raw, kind, n, p)
        self.offsets = take("<u8", blocks + 1, 0)
        p = 8 * (blocks + 1)
        self.ids, self.nulls, self.starts = take("<i8", docs, p), take("u1", docs, p + 8 * docs), take("<u8", docs + 1, p + 9 * docs)

    def read(self, start: int, stop: int) -> np.ndarray:
        """The file's ids start .. stop - 1, from the blocks that hold them."""
        if stop <= start:
            return np.zeros(0, np.uint32)
        a, b = start // self.block, -(-stop // self.block)
        data = self.file.read_at(int(self.offsets[b] - self.offsets[a]), int(self.offsets[a]))
        if self.block % 64 == 0:
            ids = unpack(data, self.bits, min(b * self.block, self.n) - a * self.block)
        else:
            cut = [(int(self.offsets[i] - self.offsets[a]), int(self.offsets[i + 1] - self.offsets[a]), min(self.block, self.n - i * self.block)) for i in range(a, b)]
            ids = np.concatenate([unpack(data[x:y], self.bits, n) for x, y, n in cut])
        return ids[start - a * self.block : stop - a * self.block]

    def close(self) -> None:
        self.file.close()


_encoders: dict[str, tuple[Units, Units]] = {}


def encoder(path: str) -> tuple[Units, Units]:
    """(of runs after a space, of runs at the start of a line): one pair a Python worker, kept for its later tasks; values are ids as
    little-endian bytes."""
    if path not in _encoders:
        make, join = (lambda ids: struct.pack(f"<{len(ids)}I", *ids)), (lambda a, b: a + b)
        _encoders[path] = Units(path, make, join, lead=" "), Units(path, make, join)
    return _encoders[path]


#: White space but space and line feed.
OTHERS = [c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n"]
ASCII_OTHERS = [c for c in OTHERS if c < "\x80"]


def encode(encoders: tuple[Units, Units], text: str) -> np.ndarray:
    """ids of the whole text. Single spaces and single line feeds that touch no other white space part units; any other white space sends
    the text to the library."""
    after, start = encoders
    others = ASCII_OTHERS if text.isascii() else OTHERS
    if "  " in text or "\n\n" in text or "\n " in text or " \n" in text or after.has_special(text) or any([c in text for c in others]):
        return np.asarray(after.whole(text), np.uint32)
    out = []
    for line in text.split("\n"):
        first, *rest = line.split(" ")
        out.append((start[first] if first else b"") + b"".join(map(after.__getitem__, rest)))
    return np.frombuffer(start["\n"].join(out), "<u4")


def write_tokens(docs: DataFrame, tokenizer: str, folder: str, end_id: int | None = END_ID, block: int = BLOCK) -> DataFrame:
    """Encode doc_id, text into token files under folder (a URI that pyarrow.fs opens and all executors share) and return their
    manifest, written there too: (part, file, n_docs, n_ids), parts in ascending order of doc_id.

    Rows are range-partitioned by doc_id and then by a hash of the text, so even one id on a third of all rows is spread; null ids come
    first; rows that share an id follow in order of that hash. Null texts count as empty and hold the end id alone. No rows: no files.
    """
    spark = docs.sparkSession
    size = max(encoder(tokenizer)[0].tokenizer.get_vocab_size(), 1 + (end_id or 0))
    bits = vocabulary_bits(size)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        units, out, part = encoder(tokenizer), None, TaskContext.get().partitionId()
        tail = np.asarray([] if end_id is None else [end_id], np.uint32)
        name = f"ids-{part:06d}.bin"
        for b in batches:
            for doc_id, null, text in zip(b["doc_id"], b["no_id"], b["text"], strict=True):
                out = out or FileWriter(f"{folder}/{name}", bits, block)
                out.add(None if null else doc_id, np.concatenate([encode(units, text), tail]))
        if out:
            out.close()
            yield pd.DataFrame({"part": [part], "file": [name], "n_docs": [len(out.ids)], "n_ids": [out.n]})

    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.coalesce(F.col("doc_id"), F.lit(0)).cast("long").alias("doc_id"), F.col("doc_id").isNull().alias("no_id"), text.alias("text"), F.xxhash64(text).alias("h"))
    rows = rows.repartitionByRange(partitions(spark), F.col("no_id").desc(), "doc_id", "h").sortWithinPartitions(F.col("no_id").desc(), "doc_id", "h", "text").drop("h")
    made = rows.mapInPandas(run, "part int, file string, n_docs long, n_ids long")
    made.write.parquet(f"{folder}/manifest")
    return spark.read.schema(made.schema).parquet(f"{folder}/manifest")


def read_tokens(manifest: DataFrame, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and the file with the place in it, of every document, from the files."""
    before = F.coalesce(F.sum("n_ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    files = manifest.withColumn("start", before).select("file", "start")
    step = 1 << 20

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for file, start in zip(b["file"], b["start"], strict=True):
                r = FileReader(f"{folder}/{file}")
                have, at = np.zeros(0, np.uint32), 0
                crcs, s = np.zeros(len(r.ids), np.int64), r.starts.astype(np.int64)
                for i in range(len(r.ids)):
                    crc, p = 0, s[i]
                    while p < s[i + 1]:
                        if p >= at + len(have):
                            at = int(p)
                            have = r.read(at, min(r.n, at + step))
                        q = min(s[i + 1], at + len(have))
                        crc, p = zlib.crc32(np.ascontiguousarray(have[p - at : q - at], "<u4"), crc), q
                    crcs[i] = crc
                r.close()
                ids = pd.array(np.where(r.nulls == 1, 0, r.ids), dtype="Int64")
                ids[r.nulls == 1] = pd.NA
                for k in range(0, len(ids), 10_000):
                    e = min(len(ids), k + 10_000)
                    yield pd.DataFrame({"doc_id": ids[k:e], "start": start + s[k:e], "n_tokens": np.diff(s)[k:e], "ids_crc32": crcs[k:e], "file": file, "file_start": s[k:e]})

    return files.repartition(partitions(manifest.sparkSession)).mapInPandas(run, "doc_id long, start long, n_tokens long, ids_crc32 long, file string, file_start long")


def op2_token_files(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    folder = fresh_path(spark, "tokens")
    folder = folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"
    spark._jvm.org.apache.hadoop.fs.Path(folder).getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(spark._jvm.org.apache.hadoop.fs.Path(folder))
    manifest = write_tokens(table(spark, sf_dir, "documents"), tokenizer, folder)
    return read_tokens(manifest, folder)
