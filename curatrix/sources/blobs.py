"""Files as values: copies with a task-safe commit, and the size of images from their headers. Tasks open files through pyarrow's file systems, so
contents are neither shuffled nor held whole."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes copied at a time.
CHUNK = 1 << 20


def plain_path(path: Column) -> Column:
    """Local paths without their scheme, as tasks open them; others as they are."""
    return F.regexp_replace(path, "^file:/+", "/")


def _open(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def _put(target: str, write) -> int:
    """write(stream) into a temporary name beside target, which is then moved to it: a task that is run twice leaves one whole file."""
    import uuid

    fs, name = _open(target)
    folder, _, last = name.rpartition("/")
    fs.create_dir(folder, recursive=True)
    part = f"{folder}/.{last}.{uuid.uuid4().hex}"
    with fs.open_output_stream(part) as out:
        write(out)
        size = out.tell()
    try:
        fs.move(part, name)
    except OSError:  # some file systems move onto nothing that is there
        fs.delete_file(name)
        fs.move(part, name)
    return size


def copy_files(rows: DataFrame) -> DataFrame:
    """rows (source, target, whatever else) plus bytes and error: each source is copied to its target. A source that can't be read gives an error and no
    target; null paths are errors. Lazy: write the result, and copy once."""

    def copy(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            sizes, errors = [], []
            for source, target in zip(b["source"], b["target"], strict=True):
                size, error = None, None
                try:
                    if source is None or target is None:
                        raise FileNotFoundError("no path")
                    fs, name = _open(source)
                    with fs.open_input_stream(name) as read:

                        def write(out, read=read):
                            while chunk := read.read(CHUNK):
                                out.write(chunk)

                        size = _put(target, write)
                except OSError as e:
                    error = f"{type(e).__name__}: {e}"
                sizes.append(size)
                errors.append(error)
            yield b.assign(bytes=pd.Series(sizes, dtype="Int64", index=b.index), error=pd.Series(errors, dtype=object, index=b.index))

    return rows.mapInPandas(copy, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", bytes long, error string")


def write_files(rows: DataFrame) -> DataFrame:
    """rows (target, content binary) -> (target, bytes): each content becomes a file."""

    def put(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"target": b["target"], "bytes": [_put(t, lambda out, c=c: out.write(c)) for t, c in zip(b["target"], b["content"], strict=True)]})

    return rows.select("target", "content").mapInPandas(put, "target string, bytes long")


def _big(b: bytes) -> int:
    return int.from_bytes(b, "big")


def _little(b: bytes) -> int:
    return int.from_bytes(b, "little")


def _jpeg(f) -> tuple[int, int]:
    """From the frame header: segments before it are skipped by their lengths, never read."""
    f.seek(2)
    while True:
        mark = f.read(2)
        if len(mark) < 2 or mark[0] != 0xFF:
            raise ValueError("broken JPEG")
        while mark[1] == 0xFF:  # fill bytes
            mark = mark[1:] + f.read(1)
        code = mark[1]
        if code == 0x01 or 0xD0 <= code <= 0xD8:  # marks without a segment
            continue
        size = f.read(2)
        if 0xC0 <= code <= 0xCF and code not in (0xC4, 0xC8, 0xCC):
            head = f.read(5)
            return _big(head[3:5]), _big(head[1:3])
        if len(size) < 2 or code in (0xD9, 0xDA):
            raise ValueError("JPEG without a frame header")
        f.seek(f.tell() + _big(size) - 2)


def _webp(h: bytes) -> tuple[int, int]:
    kind, b = h[12:16], h[20:30]
    if kind == b"VP8 ":
        return _little(b[6:8]) & 0x3FFF, _little(b[8:10]) & 0x3FFF
    if kind == b"VP8L":
        bits = _little(b[1:5])
        return (bits & 0x3FFF) + 1, (bits >> 14 & 0x3FFF) + 1
    if kind == b"VP8X":
        return _little(b[4:7]) + 1, _little(b[7:10]) + 1
    raise ValueError("unknown WebP chunk")


def header_size(f) -> tuple[int, int]:
    """(width, height) from an open file's header: at most 32 bytes of it, and the segment lengths of a JPEG. Else ValueError."""
    h = f.read(32)
    if h[:8] == b"\x89PNG\r\n\x1a\n" and len(h) >= 24:
        return _big(h[16:20]), _big(h[20:24])
    if h[:2] == b"BM" and len(h) >= 26:
        old = _little(h[14:18]) == 12
        return (_little(h[18:20]), _little(h[20:22])) if old else (_little(h[18:22]), abs(int.from_bytes(h[22:26], "little", signed=True)))
    if h[:4] == b"RIFF" and h[8:12] == b"WEBP" and len(h) >= 30:
        return _webp(h)
    if h[:2] == b"\xff\xd8":
        return _jpeg(f)
    raise ValueError("unknown image format")


def image_sizes(rows: DataFrame, path: str = "path") -> DataFrame:
    """rows plus width, height and error, from the headers of PNG, JPEG, BMP and WebP files; no pixel is decoded. Files that can't be read or aren't
    images have null sizes and an error."""

    def sizes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for p in b[path]:
                try:
                    if p is None:
                        raise FileNotFoundError("no path")
                    fs, name = _open(p.replace("file://", "", 1) if p.startswith("file:///") else p.replace("file:", "", 1) if p.startswith("file:/") else p)
                    with fs.open_input_file(name) as f:
                        out.append((*header_size(f), None))
                except (OSError, ValueError, IndexError) as e:
                    out.append((None, None, f"{type(e).__name__}: {e}"))
            made = pd.DataFrame(out, columns=["width", "height", "error"], index=b.index)
            yield b.assign(width=made["width"].astype("Int64"), height=made["height"].astype("Int64"), error=made["error"].astype(object).where(made["error"].notna(), None))

    return rows.mapInPandas(sizes, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", width int, height int, error string")
