"""Helpers of the operators: shared folder, input columns, and texts as numpy arrays.

Texts are handled in Python as UTF-8 bytes. A batch of texts is one byte array; words, their
hashes and their shingles come from array operations, so no Python code runs per word.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that array operations take at once; a longer text is taken alone.
CHUNK_BYTES = 1 << 20

U64 = np.uint64
_MIX = (U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB))
_POWER = 0x9E3779B97F4A7C15 | 1


def shared_folder(spark: SparkSession) -> str:
    """A new folder that driver and executors see: below spark.checkpoint.dir.

    Only a local session, where all share one machine, may leave that unset.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="llm-")
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def saved(df: DataFrame) -> DataFrame:
    """df, written once as Parquet to the shared folder and read from there.

    Later steps read the table instead of computing df again, and a lost executor costs only
    the tasks that it ran. The folder is left to whoever owns spark.checkpoint.dir.
    """
    spark = df.sparkSession
    path = shared_folder(spark)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def id_and_text(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id (long), text (null as empty), and the further columns named."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        *more,
    )


def table(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [
            c if isinstance(c, pa.Array) else pa.array(c, f.type)
            for c, f in zip(columns, schema, strict=True)
        ],
        schema=schema,
    )


class Texts:
    """Texts as one byte array: text i is data[start[i]:end[i]]."""

    def __init__(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, first_row: int):
        self.data, self.start, self.end, self.first_row = data, start, end, first_row

    def __len__(self) -> int:
        return len(self.start)

    def of(self, i: int) -> bytes:
        return self.data[self.start[i] : self.end[i]].tobytes()


def chunks(column: pa.Array, size: int = CHUNK_BYTES) -> Iterator[Texts]:
    """The texts of an Arrow column without nulls, in chunks of about size bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, at, raw = column.buffers()
    rows = len(column)
    if not rows:
        return
    offset = np.frombuffer(at, np.int64 if wide else np.int32)[
        column.offset : column.offset + rows + 1
    ].astype(np.int64)
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    row = 0
    while row < rows:
        upto = int(np.searchsorted(offset, offset[row] + size, "right")) - 1
        upto = min(rows, max(row + 1, upto))
        low = offset[row]
        yield Texts(
            data[low : offset[upto]],
            offset[row:upto] - low,
            offset[row + 1 : upto + 1] - low,
            row,
        )
        row = upto


def byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    """A table over byte values: True within the ranges, ends included."""
    out = np.zeros(256, bool)
    for low, high in ranges:
        out[low : high + 1] = True
    return out


#: Bytes outside `[\x20\x09-\x0D]`.
NOT_SPACE = ~byte_class((0x20, 0x20), (0x09, 0x0D))
#: Bytes outside `[\x00-\x2F\x3A-\x60\x7B-\x7F]`.
LETTER_OR_DIGIT = ~byte_class((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))
#: A-Z to a-z, all else as it is.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: A fixed random odd number for each byte, for the rolling hash of short strings.
BYTE_VALUE = np.random.default_rng(20).integers(0, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
#: Words of more bytes are hashed by blake2b.
LONG = 64
#: Masks of the first 0 to 8 bytes of a little-endian block.
_FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def powers(n: int) -> np.ndarray:
    """The first n powers of an odd number, modulo 2**64."""
    out = np.full(n, _POWER, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def mixed(h: np.ndarray) -> np.ndarray:
    """h with each bit spread over all others."""
    h = (h ^ (h >> U64(30))) * _MIX[0]
    h = (h ^ (h >> U64(27))) * _MIX[1]
    return h ^ (h >> U64(31))


class Words:
    """Words of a chunk: hash, place of the first and after the last byte, text; by text the
    range of its words."""

    def __init__(self, texts: Texts, is_word: np.ndarray, lower: bool = True):
        data = LOWER[texts.data] if lower else texts.data
        self.data = data
        inside = np.zeros(len(data) + 2, bool)
        inside[1:-1] = is_word[data]
        begins = inside[1:-1] & ~inside[:-2]
        ends = inside[1:-1] & ~inside[2:]
        # A word never runs on into the next text.
        filled = texts.start < texts.end
        cut = texts.start[filled]
        begins[cut] |= inside[cut + 1]
        last = texts.end[filled] - 1
        ends[last] |= inside[last + 1]
        self.begin = np.flatnonzero(begins)
        self.end = np.flatnonzero(ends) + 1
        self.low = np.searchsorted(self.begin, texts.start)
        self.high = np.searchsorted(self.begin, texts.end)
        self.text = np.repeat(np.arange(len(texts)), self.high - self.low)
        self.hash = _hashed(data, self.begin, self.end)

    def __len__(self) -> int:
        return len(self.begin)

    def prefixes(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the first bytes of the words that are longer, and the text of each."""
        longer = self.end - self.begin > size
        begin = self.begin[longer]
        return _hashed(self.data, begin, begin + size) ^ U64(size), self.text[longer]


def _hashed(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of each data[begin:end]: blocks of eight bytes, each mixed into all before it.

    The few strings longer than LONG are hashed whole by blake2b, so no text costs a step a block.
    """
    size = end - begin
    h = mixed(size.astype(np.uint64) + U64(_POWER))
    if not len(h):
        return h
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray(len(data) + 1, "<u8", buffer=padded, strides=(1,))
    for at in range(0, min(int(size.max()), LONG), 8):
        more = np.flatnonzero(size > at)
        block = eight[begin[more] + at] & _FIRST[np.minimum(size[more] - at, 8)]
        h[more] = mixed((h[more] ^ block) + U64(_POWER))
    for i in np.flatnonzero(size > LONG):
        whole = data[begin[i] : end[i]].tobytes()
        h[i] = int.from_bytes(blake2b(whole, digest_size=8).digest(), "little")
    return h


def word_hash(word: str) -> int:
    """The hash that Words gives to this one word."""
    raw = np.frombuffer(word.encode(), np.uint8)
    return int(_hashed(raw, np.zeros(1, np.int64), np.array([len(raw)]))[0])


def shingles(words: Words, k: int, short: bool) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of k words, and the text of each.

    short: a text with fewer words, but at least one, gives its whole sequence as one.
    """
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    weight = powers(2 * k + 2)
    count = words.high - words.low
    out = np.zeros(n, np.uint64)
    for j in range(min(k, n)):
        out[: n - j] += words.hash[j:] * weight[j + 1]
    place = np.arange(n) - np.repeat(words.low, count)
    whole = place + k <= np.repeat(count, count)
    if short:
        for i in np.flatnonzero((count > 0) & (count < k)):
            low, c = words.low[i], count[i]
            own = words.hash[low : low + c] * weight[1 : c + 1]
            out[low] = np.append(own, weight[k + 1 + c]).sum()
            whole[low] = True
    return mixed(out[whole]), words.text[whole]


def per_text(values: np.ndarray, text: np.ndarray, texts: int) -> Iterator[np.ndarray]:
    """The values of each text in turn; text is ascending."""
    at = np.searchsorted(text, np.arange(texts + 1))
    for i in range(texts):
        yield values[at[i] : at[i + 1]]


def packed(docs: DataFrame) -> DataFrame:
    """doc_id and its text as `body`, compressed, so that a shuffle moves less than half."""
    schema = pa.schema([("doc_id", pa.int64()), ("body", pa.binary())])

    def run(batches):
        pack = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            for texts in chunks(batch["text"]):
                ids = batch["doc_id"].slice(texts.first_row, len(texts))
                yield table(schema, ids, [pack(texts.of(i)) for i in range(len(texts))])

    return id_and_text(docs).mapInArrow(run, "doc_id long, body binary")


def unpacked(bodies: pa.Array) -> Iterator[bytes]:
    undo = zstandard.ZstdDecompressor()
    for body in bodies:
        yield undo.decompress(body.as_py())


def one_text(raw: bytes) -> Texts:
    return Texts(np.frombuffer(raw, np.uint8), np.zeros(1, np.int64), np.array([len(raw)]), 0)


def signed(h: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(h).view(np.int64)
