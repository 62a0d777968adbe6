"""Compressed logs as streams: one file at a time, in pieces, decoded and cut into lines.

Compressed files cannot be split, so a task reads each of its files from start to end. It holds
one piece of the file and what that piece decodes to, whatever the size of the file. The last row
of a file says whether it ended as its codec demands.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from typing import BinaryIO
from urllib.parse import quote, unquote, urlsplit

import pyarrow as pa
import pyarrow.fs

#: Bytes of a file read at once, and decoded bytes handed on at once.
PIECE = 1 << 20
STEP = 4 << 20
#: Bytes that a zstd decoder takes at once: what it gives back for them is at most 2**15 as much.
FED = 4096

# States of log files.
READ, UNREADABLE, NOT_SUPPORTED = "read", "unreadable", "not supported"

# Head of a block as Spark's own lz4 stream writes it, with the place and meaning of
# its fields: magic, method, compressed and plain length, checksum (xxhash of 28 bits).
LZ4_MAGIC = b"LZ4Block"
LZ4_HEAD = 21
LZ4_PACKED, LZ4_PLAIN = 0x20, 0x10
LZ4_SEED, LZ4_BITS = 0x9747B28C, 0x0FFFFFFF
LZ4_LARGEST = 1 << 25


class BrokenLog(ValueError):
    """A compressed log that breaks off or is none."""


def open_file(path: str) -> BinaryIO:
    """A file by its path as Spark names it, through Arrow's file systems."""
    parts = urlsplit(path)
    if parts.scheme in ("", "file"):
        return open(unquote(parts.path), "rb")
    scheme = {"s3a": "s3", "s3n": "s3"}.get(parts.scheme, parts.scheme)
    uri = parts._replace(scheme=scheme, path=quote(unquote(parts.path))).geturl()
    system, place = pyarrow.fs.FileSystem.from_uri(uri)
    return system.open_input_stream(place, compression=None)


def _gzip(source: BinaryIO) -> Iterator[bytes]:
    member = None
    while piece := source.read(PIECE):
        while piece:
            if member is None:
                member = zlib.decompressobj(31)
            yield member.decompress(piece, STEP)
            piece = member.unconsumed_tail
            if member.eof:
                piece, member = member.unused_data, None
    if member is not None:
        raise BrokenLog


def _zstd(source: BinaryIO) -> Iterator[bytes]:
    import zstandard

    frame = None
    while piece := source.read(PIECE):
        for at in range(0, len(piece), FED):
            part = piece[at : at + FED]
            while part:
                if frame is None:
                    frame = zstandard.ZstdDecompressor().decompressobj()
                try:
                    yield frame.decompress(part)
                except zstandard.ZstdError as broken:
                    raise BrokenLog from broken
                part = b""
                if frame.eof:
                    part, frame = frame.unused_data, None
    if frame is not None:
        raise BrokenLog


def _lz4(source: BinaryIO) -> Iterator[bytes]:
    import xxhash

    codec = pa.Codec("lz4_raw")
    ended = True
    while head := _exactly(source, LZ4_HEAD, may_end=True):
        packed, plain, check = (int.from_bytes(head[i : i + 4], "little") for i in (9, 13, 17))
        method = head[8] & 0xF0
        known = method == LZ4_PACKED or method == LZ4_PLAIN and packed == plain
        if head[:8] != LZ4_MAGIC or not known or max(packed, plain) > LZ4_LARGEST:
            raise BrokenLog
        ended = not plain
        if ended:  # the mark at the end of a stream; another may follow
            continue
        body = _exactly(source, packed)
        if method == LZ4_PACKED:
            body = codec.decompress(body, plain, asbytes=True)
        if xxhash.xxh32_intdigest(body, LZ4_SEED) & LZ4_BITS != check:
            raise BrokenLog
        yield body
    if not ended:
        raise BrokenLog


def _exactly(source: BinaryIO, size: int, may_end: bool = False) -> bytes:
    out = b""
    while len(out) < size and (more := source.read(size - len(out))):
        out += more
    if len(out) < size and not (may_end and not out):
        raise BrokenLog
    return out


#: Decoders by the end of a file's name.
DECODERS: dict[str, Callable[[BinaryIO], Iterator[bytes]]] = {
    ".gz": _gzip,
    ".zstd": _zstd,
    ".zst": _zstd,
    ".lz4": _lz4,
}


def decoded(path: str, source: BinaryIO) -> Iterator[bytes]:
    """The content of a compressed file in pieces; BrokenLog where it breaks off."""
    decoder = DECODERS["." + path.rsplit(".", 1)[-1]]
    try:
        yield from decoder(source)
    except (zlib.error, pa.ArrowException, EOFError) as broken:
        raise BrokenLog(path) from broken


def line_batches(pieces: Iterator[bytes]) -> Iterator[list[str]]:
    """Lines as text, a list for each piece; the end of a line may be \\n or \\r\\n."""
    rest: list[bytes] = []
    for piece in pieces:
        *lines, last = piece.split(b"\n")
        if lines:
            lines[0] = b"".join([*rest, lines[0]])
            rest = []
            yield [_text(line) for line in lines]
        rest.append(last)
    if last := b"".join(rest):
        yield [_text(last)]


def _text(line: bytes) -> str:
    return line.removesuffix(b"\r").decode("utf-8", "replace")


def stream_files(opener: Callable[[str], BinaryIO], fail: bool):
    """A function for mapInArrow: from (file) to (file, value, state).

    A file gives a row for each line and one row with its state and no value. With `fail` a file
    that breaks off ends the job.
    """

    def run(batches):
        for batch in batches:
            for file in batch["file"].to_pylist():
                state = READ
                try:
                    with opener(file) as source:
                        for lines in line_batches(decoded(unquote(file), source)):
                            yield rows(file, lines)
                except BrokenLog as broken:
                    if fail:
                        raise ValueError(f"a log breaks off: {unquote(file)}") from broken
                    state = UNREADABLE
                yield rows(file, [None], state)

    def rows(file, values, state=None):
        columns = [file] * len(values), values, [state] * len(values)
        arrays = [pa.array(c, pa.string()) for c in columns]
        return pa.RecordBatch.from_arrays(arrays, ["file", "value", "state"])

    return run
