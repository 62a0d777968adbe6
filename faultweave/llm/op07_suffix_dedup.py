"""Removal of repeated byte strings by suffix sorting.

A byte goes if a string of `length` bytes that covers it also starts in a document with a smaller
doc_id. Strings are brought together by content, sorted by suffix in small groups, and what was
found is brought back to the documents:

1. **Anchors.** Of the 16-byte grams of each string the one of least hash is its anchor. Equal
   strings have equal anchors at equal places, so each string is met in its anchor's group alone.
   Strings that follow each other mostly share an anchor; those of one anchor make a segment,
   about 70 bytes long. A segment goes out as three numbers: the hashes of anchor and segment and
   the document.
2. **Equal segments.** Of equal segments only the one of the smallest document is kept; the others
   are marked as repeats. This is done within a batch first, so copies that a third of all rows
   hold don't meet in one task.
3. **Suffix order.** Where different segments share an anchor, as at the ends of a passage or
   around an edit, their texts are fetched. Strings that occur in one of them only are set aside
   by their hashes; the rest, each text once, are sorted by suffix_array and neighbours that agree
   on `length` bytes are one string, whose smallest document keeps it. An anchor with more than
   GROUP segments is dealt again, by string.
4. **Documents** get the marks of their segments, and their bytes are cut.

Texts move compressed, twice. Tasks hold a batch of rows and one group of bounded size.
"""

from __future__ import annotations

from collections import defaultdict
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultweave.llm.lyndon import suffix_array
from faultweave.llm.shared import (
    BYTE_VALUE,
    U64,
    chunks,
    id_and_text,
    mixed,
    packed,
    powers,
    saved,
    signed,
    table,
    unpacked,
)

GRAM = 16
#: Strings taken from one text at a time.
PIECE = 1 << 20
#: Segments that one anchor's group may have in a task, and bytes sorted at once.
GROUP = 8192
SORTED_BYTES = 1 << 16
#: Segments of a batch that are compared before they go out.
AT_ONCE = 1 << 19


def remove_repeats(docs: DataFrame, length: int = 50) -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, n_removed, n_spans (runs of removed bytes) and
    kept_sha256 (of the bytes that stay).

    Texts are taken as UTF-8 bytes, a null text as empty; one shorter than `length` loses
    nothing. Rows without doc_id lose nothing and cost others nothing. Rows that repeat a doc_id
    are one document: they don't remove from each other, and each loses what a smaller doc_id
    has. Columns other than doc_id and text are not read.
    """
    if length < GRAM:
        raise ValueError(f"length must be {GRAM} at least")
    named = id_and_text(docs).where("doc_id is not null")
    marks = saved(_marks(_segments(named, length)))
    unlike = marks.where("anchor is not null")
    texts = saved(_texts(named, unlike, length))
    groups = _sorted_groups(texts.where("bytes is not null").drop("string", "low"), length)
    part = groups.union(_single_strings(texts.where("bytes is null")))
    whole = marks.where("anchor is null").select(
        "doc_id", "segment", F.lit(0).alias("low"), F.lit(-1).alias("high")
    )
    removed = whole.union(part).groupBy("doc_id")
    removed = removed.agg(F.collect_list(F.struct("segment", "low", "high")).alias("removed"))
    return _cut(packed(docs).join(removed, "doc_id", "left"), length)


# ---- strings, anchors and segments of one text ----


def _sums(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Running sums for hashes of any part of raw, and what brings a part to its start."""
    n = len(raw)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(BYTE_VALUE[raw] * _table(n)[0], out=sums[1:])
    return sums, _table(n)[1]


_TABLES: list = []


def _table(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    if not _TABLES or len(_TABLES[0]) <= n:
        size = 1 << max(12, int(n).bit_length())
        power = powers(size)
        inverse = np.full(size, pow(int(power[1]), -1, 1 << 64), np.uint64)
        inverse[0] = 1
        _TABLES[:] = [power[:size], np.multiply.accumulate(inverse)]
    return _TABLES[0][:n], _TABLES[1][:n]


def strings(raw: np.ndarray, length: int) -> np.ndarray:
    """The hash of the string at each place."""
    sums, back = _sums(raw)
    n = len(raw) - length + 1
    return mixed((sums[length:] - sums[:n]) * back[:n])


def segmented(raw: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Of each segment: hash of the anchor, hash of the segment, its first and last string."""
    parts = [
        (*_piece(raw[at : at + PIECE + length - 1], length), at)
        for at in range(0, max(0, len(raw) - length + 1), PIECE)
    ]
    if not parts:
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none.astype(np.uint64), none, none
    anchor, segment = (np.concatenate([p[c] for p in parts]) for c in (0, 1))
    first, last = (np.concatenate([p[c] + p[4] for p in parts]) for c in (2, 3))
    return anchor, segment, first, last


def _piece(raw: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    eight = np.ndarray(len(raw) - 7, "<u8", np.ascontiguousarray(raw), strides=(1,))
    eight = np.ascontiguousarray(eight)
    gram = mixed(eight[:-8] * U64(0x9E3779B97F4A7C15) + mixed(eight[8:]))
    # The least hash, leftmost of equals, with its place.
    place = U64((1 << 24) - 1)
    least = (gram & ~place) | np.arange(len(gram), dtype=np.uint64)
    span, wide = 1, length - GRAM + 1
    while 2 * span <= wide:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < wide:
        least = np.minimum(least[: span - wide], least[wide - span :])
    at = (least & place).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    last = np.append(first[1:], len(at)) - 1
    sums, back = _sums(raw)
    segment = (sums[last + length] - sums[first]) * back[first]
    return gram[at[first]], mixed(segment + (last - first).astype(np.uint64)), first, last


# ---- equal segments ----


def _segments(docs: DataFrame, length: int) -> DataFrame:
    """(anchor, segment, doc_id, known) of all segments; known: a smaller document of the batch
    has the segment, and anchor only says where the row is dealt."""
    schema = pa.schema(
        [("anchor", pa.int64()), ("segment", pa.int64()), ("doc_id", pa.int64())]
        + [("known", pa.bool_())]
    )

    def run(batches):
        held, count = [], 0
        for batch in batches:
            for texts in chunks(batch["text"]):
                ids = batch["doc_id"].slice(texts.first_row, len(texts)).to_numpy()
                for i in range(len(texts)):
                    raw = texts.data[texts.start[i] : texts.end[i]]
                    anchor, segment, _, _ = segmented(raw, length)
                    held.append((anchor, segment, np.full(len(anchor), ids[i])))
                    count += len(anchor)
                if count >= AT_ONCE:
                    yield _compared(held, schema)
                    held, count = [], 0
        if held:
            yield _compared(held, schema)

    return docs.mapInArrow(run, "anchor long, segment long, doc_id long, known boolean")


def _compared(held: list, schema: pa.Schema) -> pa.RecordBatch:
    anchor, segment, doc = (np.concatenate([h[c] for h in held]) for c in range(3))
    order = np.lexsort((doc, segment))
    s, d = segment[order], doc[order]
    new = np.concatenate([[True], s[1:] != s[:-1]])[: len(s)]
    low = d[np.maximum.accumulate(np.where(new, np.arange(len(s)), 0))] if len(s) else d
    same = ~new & (d == low)  # again in the document itself
    known = np.zeros(len(s), bool)
    known[order] = d > low
    keep = np.ones(len(s), bool)
    keep[order] = ~same
    deal = np.where(known, mixed(doc.astype(np.uint64)), anchor)
    return table(schema, signed(deal[keep]), signed(segment[keep]), doc[keep], known[keep])


def _marks(segments: DataFrame) -> DataFrame:
    """(doc_id, segment, anchor): repeats of a smaller document's segment, without anchor; and
    the first of each of several different segments of an anchor, with it."""
    schema = pa.schema([(c, pa.int64()) for c in ("doc_id", "segment", "anchor")])

    def run(batches):
        state = None  # anchor and segment at hand, its smallest document, and its row if alone
        for batch in batches:
            column = {c: batch[c].to_numpy() for c in ("anchor", "segment", "doc_id")}
            known = batch["known"].to_numpy(zero_copy_only=False)
            done = [(column["doc_id"][known], column["segment"][known])]
            anchor, segment, doc = (column[c][~known] for c in ("anchor", "segment", "doc_id"))
            unlike = []
            if len(anchor):
                state, unlike = _scanned(anchor, segment, doc, state, done)
            d, s = (np.concatenate([x[c] for x in done]) for c in (0, 1))
            blank = pa.nulls(len(d), pa.int64())
            yield table(schema, d, s, blank)
            for a, s, d in unlike:
                yield table(schema, d, s, a)

    return (
        segments.repartition("anchor")
        .sortWithinPartitions("anchor", "segment", "doc_id")
        .mapInArrow(run, "doc_id long, segment long, anchor long")
    )


def _scanned(anchor, segment, doc, state, done: list) -> tuple[tuple, list]:
    """One batch of the sorted rows; state: (anchor, segment, low, alone) of the row before."""
    n = len(anchor)
    old_anchor, old_segment, old_low, alone = state or (None, None, None, None)
    new_group = np.ones(n, bool)
    new_group[1:] = anchor[1:] != anchor[:-1]
    new_group[0] = old_anchor is None or anchor[0] != old_anchor
    new = new_group.copy()
    new[1:] |= segment[1:] != segment[:-1]
    new[0] |= old_segment is None or segment[0] != old_segment
    begin = np.maximum.accumulate(np.where(new, np.arange(n), -1))
    low = np.where(begin >= 0, doc[np.maximum(begin, 0)], old_low if state else 0)
    repeat = doc > low
    done.append((doc[repeat], segment[repeat]))
    # Segments of each group that begin in this batch; group 0 goes on from before.
    number = np.cumsum(new_group)
    starts = np.flatnonzero(new)
    count = np.bincount(number[starts], minlength=number[-1] + 1)
    out = []
    going_on = count[0] > 0
    if alone is not None and going_on:
        out.append(alone)
    several = count >= 2
    several[0] = going_on
    last_alone = not several[number[-1]] and number[-1] > 0
    pick = starts[several[number[starts]]]
    out.append((anchor[pick], segment[pick], doc[pick]))
    if number[-1] == 0:
        alone = None if going_on else alone
    elif last_alone:
        i = starts[-1:]
        alone = (anchor[i], segment[i], doc[i])
    else:
        alone = None
    # A group known to have several passes each further segment on.
    return (anchor[-1], segment[-1], low[-1], alone), out


# ---- suffix order ----


def _texts(docs: DataFrame, unlike: DataFrame, length: int) -> DataFrame:
    """(anchor, doc_id, segment, bytes, string, low) of the segments that need their text; those
    of large groups as strings instead: the hash and the place of each, without bytes."""
    large = unlike.groupBy("anchor").agg(F.count("*").alias("n")).where(F.col("n") > GROUP)
    large = saved(large.select("anchor", F.lit(True).alias("large")))
    wanted = unlike.join(large, "anchor", "left").groupBy("doc_id")
    few, many = F.col("large").isNull(), F.col("large")
    wanted = wanted.agg(
        F.collect_set(F.when(few, F.col("segment"))).alias("few"),
        F.collect_set(F.when(many, F.col("segment"))).alias("many"),
    )
    schema = pa.schema(
        [(c, pa.int64()) for c in ("anchor", "doc_id", "segment")]
        + [("bytes", pa.binary()), ("string", pa.int64()), ("low", pa.int64())]
    )

    def run(batches):
        for batch in batches:
            for i, text in enumerate(unpacked(batch["body"])):
                raw = np.frombuffer(text, np.uint8)
                anchor, segment, first, last = segmented(raw, length)
                names, at = np.unique(signed(segment), return_index=True)
                doc = batch["doc_id"][i].as_py()
                own = at[np.isin(names, batch["few"][i].values.to_numpy())]
                if len(own):
                    cut = [text[first[j] : last[j] + length] for j in own.tolist()]
                    none = pa.nulls(len(own), pa.int64())
                    head = signed(anchor[own]), np.full(len(own), doc), signed(segment[own])
                    yield table(schema, *head, cut, none, none)
                own = at[np.isin(names, batch["many"][i].values.to_numpy())]
                if len(own):
                    count = last[own] - first[own] + 1
                    which = np.repeat(own, count)
                    low = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
                    name = signed(strings(raw, length)[first[which] + low])
                    head = signed(anchor[which]), np.full(len(which), doc), signed(segment[which])
                    yield table(schema, *head, pa.nulls(len(which), pa.binary()), name, low)

    return (
        packed(docs)
        .join(wanted, "doc_id")
        .mapInArrow(
            run, "anchor long, doc_id long, segment long, bytes binary, string long, low long"
        )
    )


def _sorted_groups(texts: DataFrame, length: int) -> DataFrame:
    """(doc_id, segment, low, high): runs of strings to remove, counted from the segment's
    start."""
    schema = pa.schema([(c, pa.int64()) for c in ("doc_id", "segment", "low", "high")])

    def run(batches):
        held = None
        for batch in batches:
            part = pa.Table.from_batches([batch])
            if held is not None:
                part = pa.concat_tables([held, part]).combine_chunks()
            anchor = part["anchor"].to_numpy()
            edge = int(np.searchsorted(anchor, anchor[-1]))
            if edge:
                yield from _resolved(part.slice(0, edge), length, schema)
            held = part.slice(edge)
        if held is not None:
            yield from _resolved(held, length, schema)

    return (
        texts.repartition("anchor")
        .sortWithinPartitions("anchor", "doc_id")
        .mapInArrow(run, ", ".join(f"{f.name} long" for f in schema))
    )


class _Group:
    """Segments of whole anchors as one array, and the places where a string begins."""

    def __init__(self, part: pa.Table, length: int):
        self.doc, self.segment, self.anchor = (
            part[c].to_numpy() for c in ("doc_id", "segment", "anchor")
        )
        texts = part["bytes"].to_pylist()
        self.data = b"".join(texts)
        size = np.array([len(t) for t in texts])
        self.start = np.cumsum(size) - size
        count = size - length + 1
        self.row = np.repeat(np.arange(len(texts)), count)
        within = np.arange(len(self.row)) - np.repeat(np.cumsum(count) - count, count)
        self.offset = within
        self.at = self.start[self.row] + within
        self.hash = strings(np.frombuffer(self.data, np.uint8), length)[self.at]


def _resolved(part: pa.Table, length: int, schema: pa.Schema):
    g = _Group(part, length)
    # Strings that one row alone has cannot be repeats.
    key = g.hash ^ mixed(g.anchor[g.row].astype(np.uint64))
    _, code, count = np.unique(key, return_inverse=True, return_counts=True)
    shared = count[code] > 1
    # Runs of the others, as texts; equal texts of an anchor are one.
    begin = shared.copy()
    begin[1:] &= ~(shared[:-1] & (g.row[1:] == g.row[:-1]))
    end = shared.copy()
    end[:-1] &= ~(shared[1:] & (g.row[1:] == g.row[:-1]))
    places = defaultdict(list)
    for i, j in zip(np.flatnonzero(begin).tolist(), np.flatnonzero(end).tolist(), strict=True):
        run = g.data[g.at[i] : g.at[j] + length]
        places[int(g.anchor[g.row[i]]), run].append((int(g.row[i]), int(g.offset[i])))
    by_anchor = defaultdict(list)
    for anchor, run in places:
        by_anchor[anchor].append(run)
    low = {}
    block, size = [], 0
    for anchor, runs in by_anchor.items():
        if len(runs) == 1:  # nothing to sort
            doc = min(int(g.doc[row]) for row, _ in places[anchor, runs[0]])
            low[anchor, runs[0]] = np.full(len(runs[0]) - length + 1, doc)
            continue
        block += [(anchor, run) for run in runs]
        size += sum(map(len, runs))
        if size >= SORTED_BYTES:
            _order(block, places, g.doc, low, length)
            block, size = [], 0
    if block:
        _order(block, places, g.doc, low, length)
    out = [[], [], [], []]
    for name, smallest in low.items():
        for row, offset in places[name]:
            gone = np.concatenate([[False], smallest < g.doc[row], [False]])
            turn = np.flatnonzero(gone[1:] != gone[:-1])
            for first, after in zip(turn[::2].tolist(), turn[1::2].tolist(), strict=True):
                out[0].append(int(g.doc[row]))
                out[1].append(int(g.segment[row]))
                out[2].append(offset + first)
                out[3].append(offset + after - 1)
    if out[0]:
        yield table(schema, *out)


def _order(block: list, places: dict, doc: np.ndarray, low: dict, length: int) -> None:
    """Sort the suffixes of the texts of a block and give each string its smallest document."""
    text = b"\x00".join(run for _, run in block) + b"\x00"
    size = np.array([len(run) + 1 for _, run in block])
    start = np.cumsum(size) - size
    count = size - length
    of = np.repeat(np.arange(len(block)), count)
    at = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count) + start[of]
    number = np.full(len(text), -1)
    number[at] = np.arange(len(at))
    ranked = number[np.array(suffix_array(text))]
    ranked = ranked[ranked >= 0]
    window = np.lib.stride_tricks.sliding_window_view(np.frombuffer(text, np.uint8), length)
    here = window[at[ranked]]
    new = np.concatenate([[True], (here[1:] != here[:-1]).any(axis=1)])
    first = np.array([min(int(doc[row]) for row, _ in places[name]) for name in block])
    own = first[of[ranked]]
    smallest = np.minimum.reduceat(own, np.flatnonzero(new))[np.cumsum(new) - 1]
    by_place = np.empty(len(at), np.int64)
    by_place[ranked] = smallest
    for name, values in zip(block, np.split(by_place, np.cumsum(count)[:-1]), strict=True):
        low[name] = values


def _single_strings(rows: DataFrame) -> DataFrame:
    """Strings of large groups: (doc_id, segment, low, high) of those a smaller document has."""
    schema = pa.schema([(c, pa.int64()) for c in ("doc_id", "segment", "low", "high")])

    def run(batches):
        string, smallest = None, None
        for batch in batches:
            here, doc = batch["string"].to_numpy(), batch["doc_id"].to_numpy()
            new = np.concatenate([[here[0] != string], here[1:] != here[:-1]])
            begin = np.maximum.accumulate(np.where(new, np.arange(len(here)), -1))
            low = np.where(begin >= 0, doc[np.maximum(begin, 0)], smallest or 0)
            gone = doc > low
            part = (batch[c].to_numpy()[gone] for c in ("doc_id", "segment", "low", "low"))
            yield table(schema, *part)
            string, smallest = here[-1], low[-1]

    return (
        rows.select("string", "doc_id", "segment", "low")
        .repartition("string")
        .sortWithinPartitions("string", "doc_id")
        .mapInArrow(run, "doc_id long, segment long, low long, high long")
    )


# ---- documents ----


def _cut(docs: DataFrame, length: int) -> DataFrame:
    schema = pa.schema(
        [(c, pa.int64()) for c in ("doc_id", "n_bytes", "n_removed", "n_spans")]
        + [("kept_sha256", pa.string())]
    )

    def run(batches):
        for batch in batches:
            rows = []
            ids, removed = batch["doc_id"], batch["removed"]
            for i, text in enumerate(unpacked(batch["body"])):
                gone = np.zeros(len(text) + 1, np.int64)
                if removed[i].is_valid:
                    _marked(np.frombuffer(text, np.uint8), removed[i].values, length, gone)
                gone = np.cumsum(gone)[:-1] > 0
                spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
                kept = np.frombuffer(text, np.uint8)[~gone].tobytes()
                rows.append(
                    (ids[i].as_py(), len(text), int(gone.sum()), spans, sha256(kept).hexdigest())
                )
            if rows:
                yield table(schema, *map(list, zip(*rows, strict=True)))

    return docs.mapInArrow(
        run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    )


def _marked(raw: np.ndarray, removed: pa.StructArray, length: int, gone: np.ndarray) -> None:
    """Add 1 where a removed string begins to cover, -1 after its end."""
    _, segment, first, last = segmented(raw, length)
    name, low, high = (removed.field(c).to_numpy() for c in ("segment", "low", "high"))
    order = np.argsort(signed(segment), kind="stable")
    ordered = signed(segment)[order]
    begin, end = np.searchsorted(ordered, name), np.searchsorted(ordered, name, "right")
    count = end - begin
    which = np.repeat(np.arange(len(name)), count)
    place = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
    own = order[begin[which] + place]
    np.add.at(gone, first[own] + low[which], 1)
    stop = np.where(high[which] < 0, last[own], first[own] + high[which])
    np.add.at(gone, stop + length, -1)
