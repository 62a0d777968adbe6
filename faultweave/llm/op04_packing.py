"""Cost-balanced packing of documents into training sequences.

Attention costs a piece of n tokens about n + n * n / length. Pieces are taken by descending
cost and each goes to the sequence of lowest cost that has room for it, so sequences end up full
and alike in cost. Where no sequence has room for a whole piece, it is cut.

Documents are tokenized and packed where they are read: a task packs blocks of about a million
tokens, so its memory is bounded and nothing is shuffled. What a block leaves over is cut into
sequences whose lengths are powers of two, which need no padding.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultweave.llm.shared import table
from faultweave.llm.tokens import Encoder

BLOCK_TOKENS = 1 << 20
#: The id that ends each document.
END = 0


def pack(docs: DataFrame, tokenizer: str, length: int = 1024) -> DataFrame:
    """One row per piece: doc_id, start (the document's ids before it), length, ids_crc32 (of
    the ids as little-endian unsigned 32 bits), doc_tokens (with the closing id), sequence_id,
    offset in the sequence.

    Strings of special tokens in a text are these tokens, as the file has them. Every id of a
    document lies in exactly one piece. A null text is empty and so has the closing
    id only. Each row is packed, null doc_ids and repeated rows too. No rows give no rows.
    Sequence ids are unique and rise within a task. Columns other than doc_id and text are not
    read. length must be a power of two.
    """
    schema = pa.schema(
        [(c, pa.int64()) for c in "doc_id start length ids_crc32 doc_tokens".split()]
        + [("sequence_id", pa.int64()), ("offset", pa.int64())]
    )

    def run(batches):
        encoder = Encoder(tokenizer, special=True)
        first = TaskContext.get().partitionId() << 40
        block, tokens = [], 0
        for batch in batches:
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"], strict=True):
                ids = np.append(encoder.ids(text.as_py() or ""), END).astype("<u4")
                block.append((doc_id, ids))
                tokens += len(ids)
                if tokens >= BLOCK_TOKENS:
                    rows, used = _packed(block, length, first)
                    yield table(schema, *map(list, zip(*rows, strict=True)))
                    first += used
                    block, tokens = [], 0
        if block:
            rows, _ = _packed(block, length, first)
            yield table(schema, *map(list, zip(*rows, strict=True)))

    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")
    ).mapInArrow(run, ", ".join(f"{f.name} long" for f in schema))


def _packed(block: list, length: int, first: int) -> tuple[list[tuple], int]:
    """Rows of the pieces of a block, and the number of sequences."""
    sequences = assign([len(ids) for _, ids in block], length)
    rows = []
    for number, pieces in enumerate(sequences):
        offset = 0
        for doc, start, n in pieces:
            doc_id, ids = block[doc]
            crc = crc32(ids[start : start + n].tobytes())
            rows.append((doc_id, start, n, crc, len(ids), first + number, offset))
            offset += n
    return rows, len(sequences)


def assign(sizes: list[int], length: int) -> list[list[tuple[int, int, int]]]:
    """Sequences as lists of pieces (document, start, size); all but powers of two are full."""
    full = []
    rests = []
    for doc, size in enumerate(sizes):
        whole = size - size % length
        full += [[(doc, start, length)] for start in range(0, whole, length)]
        if size > whole:
            rests.append((whole - size, doc, whole))
    open_, left = divmod(-sum(r[0] for r in rests), length)
    balanced, over = _balanced(rests, open_, length)
    return full + balanced + list(_tail(over, left))


def _balanced(rests: list, count: int, length: int) -> tuple[list, list]:
    """Fill count sequences by lowest cost; what is over when all are full."""
    sequences = [[] for _ in range(count)]
    cost = [0.0] * count
    # By room left: a heap of sequences, and the cost of its cheapest.
    room = [[] for _ in range(length + 1)]
    room[length] = [(0.0, s) for s in range(count)]
    cheapest = np.full(length + 1, np.inf)
    if count:
        cheapest[length] = 0.0
    heapq.heapify(rests)  # largest first, then by document
    over = []
    while rests:
        negative, doc, start = heapq.heappop(rests)
        size = -negative
        place = size + int(np.argmin(cheapest[size:]))
        if cheapest[place] == np.inf:
            wide = np.flatnonzero(cheapest[1:] < np.inf)
            if not len(wide):
                over.append((doc, start, size))
                continue
            place = int(wide[-1]) + 1
            heapq.heappush(rests, (place - size, doc, start + place))
            size = place
        _, s = heapq.heappop(room[place])
        cheapest[place] = room[place][0][0] if room[place] else np.inf
        sequences[s].append((doc, start, size))
        cost[s] += size + size * size / length
        left = place - size
        if left:
            heapq.heappush(room[left], (cost[s], s))
            cheapest[left] = room[left][0][0]
    return sequences, over


def _tail(pieces: list, left: int) -> Iterator[list]:
    """Sequences of falling powers of two that hold the pieces left over."""
    pieces = pieces[::-1]
    while left:
        room = 1 << (left.bit_length() - 1)
        left -= room
        own = []
        while room:
            doc, start, size = pieces.pop()
            taken = min(size, room)
            own.append((doc, start, taken))
            room -= taken
            if taken < size:
                pieces.append((doc, start + taken, size - taken))
        yield own
