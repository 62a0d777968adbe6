"""Best-fit packing of whole documents, improved by swaps between underfull sequences.

Documents are tokenized where they are read. A task packs blocks of BLOCK pieces: by best fit in
descending order first, then by local search. The search takes the emptiest sequence as donor
and looks, over all pieces of all underfull sequences, for the step that increases the sum of
squared fills most: a piece moves over, a piece changes places with a smaller one, or two pieces
change places with one smaller than both together. So the donor drains until it is empty or no
step is left. The search ends when no fewer sequences can hold the tokens.

What blocks leave open, sequences with room for REOPEN tokens or more, meets in a second round:
these sequences are dealt to groups of about BLOCK pieces and the search goes on among them. Only
numbers are moved there, no ids.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations_with_replacement
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultweave.llm.shared import saved, table
from faultweave.llm.tokens import WordEncoder

#: Pieces that are packed together.
BLOCK = 1 << 15
#: Part of a sequence that may stay empty in the first round.
REOPEN = 1 / 64
#: The id that ends each document.
END = 1

_PIECE = pa.schema(
    [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64())]
    + [("ids_crc32", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())]
)
_COLUMNS = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long"
_COLUMNS += ", offset long"


def best_fit(docs: DataFrame, tokenizer: str, length: int = 4096) -> DataFrame:
    """One row per piece: doc_id, piece (from 0 within the document), start (the document's ids
    before it), length, ids_crc32 (of the ids as little-endian unsigned 32 bits), sequence_id,
    offset in the sequence.

    Only documents of more than `length` ids, the closing one included, are cut: into pieces of
    `length`, the last of what is left. A null or empty text has the closing id only. Each row is
    packed, null doc_ids and repeated rows too, so pieces of rows that repeat a doc_id bear the
    same numbers. Among equal sizes the row read first goes first. No rows give no rows. Columns
    other than doc_id and text are not read.
    """
    first = saved(_first_round(docs, tokenizer, length))
    opened = first.where("open").drop("open")
    groups = -(-opened.count() // BLOCK) or 1
    return first.where("not open").drop("open").unionByName(_second_round(opened, groups, length))


def _first_round(docs: DataFrame, tokenizer: str, length: int) -> DataFrame:
    schema = _PIECE.append(pa.field("open", pa.bool_()))

    def run(batches):
        encoder = WordEncoder(tokenizer)
        next_id = TaskContext.get().partitionId() << 40

        def packed(block):
            nonlocal next_id
            columns = [np.array(c) if i else list(c) for i, c in enumerate(zip(*block, strict=True))]
            size = columns[3]
            bins = improved(size, descending_best_fit(size, length), length)
            fill = np.bincount(bins, size).astype(np.int64)
            is_open = length - fill >= max(1, int(length * REOPEN))
            rows = table(schema, *columns, next_id + bins, offsets(size, bins), is_open[bins])
            next_id += len(fill)
            return rows

        pieces = []
        for batch in batches:
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"], strict=True):
                ids = np.append(encoder.ids(text.as_py() or ""), END).astype("<u4")
                for number, start in enumerate(range(0, len(ids), length)):
                    own = ids[start : start + length]
                    pieces.append((doc_id, number, start, len(own), crc32(own.tobytes())))
                while len(pieces) >= BLOCK:
                    block, pieces = pieces[:BLOCK], pieces[BLOCK:]
                    yield packed(block)
        if pieces:
            yield packed(pieces)

    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")
    ).mapInArrow(run, f"{_COLUMNS}, open boolean")


def _second_round(opened: DataFrame, groups: int, length: int) -> DataFrame:
    """The sequences left open, improved together; a group uses only ids of its own sequences."""
    names = _PIECE.names

    def run(batches):
        for group in by_key(batches, "of"):
            size = group["length"].to_numpy()
            ids, given = np.unique(group["sequence_id"].to_numpy(), return_inverse=True)
            fresh = descending_best_fit(size, length)
            bins = improved(size, fresh if fresh.max() <= given.max() else given, length)
            kept = [group[c].combine_chunks() for c in names[:5]]
            yield table(_PIECE, *kept, ids[bins], offsets(size, bins))

    return (
        opened.withColumn("of", F.pmod(F.xxhash64("sequence_id"), F.lit(groups)).cast("int"))
        .repartition(groups, "of")
        .sortWithinPartitions("of", "sequence_id", "offset")
        .mapInArrow(run, _COLUMNS)
    )


def by_key(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """The rows of each value of key, which come one behind the other."""
    kept: list[pa.RecordBatch] = []
    for batch in batches:
        if not len(batch):
            continue
        value = batch[key].to_numpy()
        edges = [0, *(np.flatnonzero(np.diff(value)) + 1).tolist(), len(value)]
        for low, high in zip(edges, edges[1:], strict=False):
            if kept and kept[-1][key][0].as_py() != value[low]:
                yield pa.Table.from_batches(kept)
                kept = []
            kept.append(batch.slice(low, high - low))
    if kept:
        yield pa.Table.from_batches(kept)


def offsets(size: np.ndarray, bins: np.ndarray) -> np.ndarray:
    """Where each piece begins in its sequence; pieces stand in the order given."""
    order = np.argsort(bins, kind="stable")
    before = np.cumsum(size[order]) - size[order]
    opens = np.diff(bins[order], prepend=-1) != 0
    out = np.empty(len(size), np.int64)
    out[order] = before - before[np.flatnonzero(opens)][np.cumsum(opens) - 1]
    return out


def descending_best_fit(size: np.ndarray, length: int) -> np.ndarray:
    """The sequence of each piece: largest pieces first, each to the fullest that has room."""
    out = np.empty(len(size), np.int64)
    with_room = [[] for _ in range(length + 1)]
    any_with = np.zeros(length + 1, bool)
    count = 0
    for i in np.argsort(-size, kind="stable").tolist():
        own = int(size[i])
        room = own + int(np.argmax(any_with[own:]))
        if any_with[room]:
            to = with_room[room].pop()
            any_with[room] = bool(with_room[room])
        else:
            to, room = count, length
            count += 1
        out[i] = to
        left = room - own
        if left:
            with_room[left].append(to)
            any_with[left] = True
    return out


def improved(size: np.ndarray, bins: np.ndarray, length: int) -> np.ndarray:
    """bins after local search, numbered without gaps; never more sequences than before."""
    bins = bins.copy()
    fill = np.bincount(bins, size).astype(np.int64)
    needed = -(-int(size.sum()) // length)
    alive = int((fill > 0).sum())
    stuck = fill == length
    while alive > needed and not stuck.all():
        donor = int(np.argmin(np.where(stuck, length + 1, fill)))
        step = _best_step(size, bins, fill, donor, length)
        if step is None:
            stuck[donor] = True
            continue
        given, taken, to = step
        change = int(size[given].sum() - size[taken].sum())
        bins[given], bins[taken] = to, donor
        fill[donor] -= change
        fill[to] += change
        stuck[to] = fill[to] == length
        if not fill[donor]:
            stuck[donor] = True
            alive -= 1
            stuck[(fill > 0) & (fill < length)] = False
    return np.unique(bins, return_inverse=True)[1]


def _best_step(size, bins, fill, donor: int, length: int) -> tuple[list, list, int] | None:
    """Pieces given, pieces taken and the receiver of the step that increases the sum of squared
    fills most; None if none does."""
    own = np.flatnonzero(bins == donor)
    own = own[np.unique(size[own], return_index=True)[1]]  # one of each size, ascending
    room = length - fill
    takes = np.flatnonzero((room > 0) & (fill > 0) & (np.arange(len(fill)) != donor))
    if not len(takes):
        return None
    their = np.flatnonzero((room[bins] > 0) & (bins != donor))
    pairs = _pairs(size, bins, own, donor)
    best, found = 0, None
    nothing = np.full(len(takes), -1)
    for parts, item, to in (
        ([(i,) for i in own], nothing, takes),
        ([(i,) for i in own], their, bins[their]),
        (pairs, their, bins[their]),
    ):
        if not parts or not len(to):
            continue
        total = np.array([size[list(p)].sum() for p in parts])
        parts = [parts[i] for i in np.argsort(total, kind="stable")]
        total.sort()
        back = np.where(item >= 0, size[item], 0)
        # The largest part that the receiver has room for once its own piece is gone.
        which = np.searchsorted(total, back + room[to], "right") - 1
        change = np.where(which >= 0, total[which] - back, 0)
        gain = np.where(change > 0, change * (change + fill[to] - fill[donor]), 0)
        i = int(np.argmax(gain))
        if gain[i] > best:
            best = int(gain[i])
            taken = [int(item[i])] if item[i] >= 0 else []
            found = list(map(int, parts[which[i]])), taken, int(to[i])
    return found


def _pairs(size, bins, own, donor: int) -> list[tuple[int, int]]:
    """Two pieces of the donor for each two sizes that it holds."""
    everyone = np.flatnonzero(bins == donor)
    out = []
    for a, b in combinations_with_replacement(own.tolist(), 2):
        if a == b:
            same = everyone[size[everyone] == size[a]]
            if len(same) < 2:
                continue
            b = int(same[1])
        out.append((a, b))
    return out
