"""Token counts of the sections of documents, by offsets.

Each document is encoded once and whole, as a model would read it. The ids of a byte-level
tokenizer stand for known numbers of bytes, so running sums give the character span of each
token, and an interval join with the spans of the sections gives the section of each. A section
is a line with its newline. Tokens that cross a border are allotted by a rule:

    start     to the section that holds the token's first character
    majority  to the section that holds most of its characters, the earliest of equals

Documents are read and counted in one task each; nothing is shuffled.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from faultweave.llm.shared import id_and_text, table
from faultweave.llm.tokens import Encoder

ROWS = 1 << 16


def token_counts(docs: DataFrame, tokenizer: str, rule: str = "majority") -> DataFrame:
    """One row per section: doc_id, section (from 0), start, end (characters, end exclusive),
    n_tokens, n_crossing (tokens counted here that reach beyond the section), doc_tokens.

    The n_tokens of a document add up to its doc_tokens. A null or empty text has one empty
    section without tokens. Null doc_ids and repeated rows come out as they are. Columns other
    than doc_id and text are not read.
    """
    if rule not in ("start", "majority"):
        raise ValueError(f"no such rule: {rule}")
    names = "doc_id section start end n_tokens n_crossing doc_tokens".split()
    schema = pa.schema([(c, pa.int64()) for c in names])

    def run(batches):
        encoder = Encoder(tokenizer)
        parts, rows = [], 0
        for batch in batches:
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                start, end, n, crossing, total = sections(encoder, text.as_py(), rule)
                ids = pa.repeat(doc_id, len(start))
                each = np.arange(len(start)), start, end, n, crossing, np.full(len(start), total)
                parts.append(table(schema, ids, *each))
                rows += len(start)
                if rows >= ROWS:
                    yield from pa.Table.from_batches(parts).combine_chunks().to_batches()
                    parts, rows = [], 0
        if parts:
            yield from pa.Table.from_batches(parts).combine_chunks().to_batches()

    return id_and_text(docs).mapInArrow(run, ", ".join(f"`{c}` long" for c in names))


def sections(encoder: Encoder, text: str, rule: str) -> tuple:
    """start, end, tokens and crossing tokens of each section, and all tokens."""
    raw = np.frombuffer(text.encode(), np.uint8)
    # Characters that begin before each byte; a byte inside a character belongs to it.
    begins = (raw & 0xC0) != 0x80
    char = np.concatenate([[0], np.cumsum(begins)])
    newline = char[np.flatnonzero(raw == 10) + 1]
    start = np.concatenate([[0], newline])
    if len(start) > 1 and start[-1] == char[-1]:
        start = start[:-1]  # a closing newline opens no section
    end = np.append(start[1:], char[-1])

    ids = encoder.ids(text)
    upto = np.cumsum(encoder.bytes[ids])
    low, high = upto - encoder.bytes[ids], upto
    # Spans in characters: from the one that holds the first byte to the one with the last.
    low, high = char[low + 1] - 1, char[high]
    first = np.searchsorted(start, low, "right") - 1
    last = np.searchsorted(start, high - 1, "right") - 1
    crosses = np.flatnonzero(first != last)
    home = first
    if rule == "majority":
        for t in crosses.tolist():
            span = slice(first[t], last[t] + 1)
            held = np.minimum(end[span], high[t]) - np.maximum(start[span], low[t])
            home[t] += int(np.argmax(held))
    n = np.bincount(home, minlength=len(start))
    return start, end, n, np.bincount(home[crosses], minlength=len(start)), len(ids)
