"""License scan: an exact set-similarity join of text blocks with license templates.

A template is a license statement, a set of words T. A block is a run of at most |T| + fill words
of a document, across the ends of lines, as statements are wrapped. It matches where it holds at
least c = ceil(containment * |T|) words of T, in any order.

The words of the templates are put in one global order, rarest in the documents first; the
counts cover all documents. A matching block holds one of the first |T| - c + 1 words of T
(prefix filter), has c words (length filter), and after each word of T in that order the words
found and those still to come are c (positional filter). Blocks begin at words of T, as others only
shorten them. Blocks that pass are verified whole, so every match is found and no other. Only the
templates are sent to tasks; their size is fixed and does not depend on the documents. Each
document is read in one task and nothing is shuffled but the word counts, one row for each template
word and task.

Beside this, `phrases` are sought as runs of words, wherever they stand.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultweave.llm.shared import (
    LETTER_OR_DIGIT,
    Words,
    chunks,
    id_and_text,
    table,
    word_hash,
)

# The phrases of the contract with their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

# Statements by which well-known licenses are given, with the labels of the method.
TEMPLATES = {
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0",
    "gpl-3.0-notice": "Licensed under the GNU General Public License, version 3",
    "cc-by-nc-4.0-notice": "Licensed under CC BY-NC 4.0",
    "mit-notice": "Released under the MIT License",
    "mit-permission": "Permission is hereby granted, free of charge, to any person obtaining a copy"
    " of this software and associated documentation files",
    "bsd-conditions": "Redistribution and use in source and binary forms, with or without"
    " modification, are permitted provided that the following conditions are met",
    "mpl-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public"
    " License, v. 2.0",
    "rights-reserved": "Copyright. All rights reserved",
}


def _word_list(text: str) -> list[str]:
    raw = text.encode()
    words = Words(next(chunks(pa.array([text]))), LETTER_OR_DIGIT)
    lowered = bytes(words.data) if len(words) else raw
    return [lowered[a:b].decode() for a, b in zip(words.begin, words.end, strict=True)]


class Templates:
    """Words of the templates, each once, in the global order once it is known."""

    def __init__(self, texts: dict[str, str], containment: float):
        self.texts = {label: list(dict.fromkeys(_word_list(text))) for label, text in texts.items()}
        self.least = {
            label: max(1, int(np.ceil(containment * len(own) - 1e-9)))
            for label, own in self.texts.items()
        }
        self.words = sorted(set().union(*self.texts.values()))
        hashes = np.array([word_hash(w) for w in self.words], np.uint64)
        self.by_hash = np.argsort(hashes)
        self.hashes = hashes[self.by_hash]

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """The number of each word among the template words, else -1."""
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, self.by_hash[at], -1)

    def order(self, frequency: dict[int, int]) -> None:
        """Rank words rarest first, ties by the word; give each template's words by rank, and the
        ranks of all of them and of its prefix as tables."""
        ranked = sorted(range(len(self.words)), key=lambda i: (frequency.get(i, 0), self.words[i]))
        self.rank = np.empty(len(ranked), np.int64)
        self.rank[ranked] = np.arange(len(ranked))
        number = {w: i for i, w in enumerate(self.words)}
        self.ranks, self.is_own, self.is_prefix = {}, {}, {}
        for label, own in self.texts.items():
            self.ranks[label] = sorted(int(self.rank[number[w]]) for w in own)
            for is_in, upto in (
                (self.is_own, len(own)),
                (self.is_prefix, len(own) - self.least[label] + 1),
            ):
                is_in[label] = np.zeros(len(ranked), bool)
                is_in[label][self.ranks[label][:upto]] = True


def license_scan(
    docs: DataFrame,
    phrases: dict[str, str] = PHRASES,
    templates: dict[str, str] = TEMPLATES,
    containment: float = 0.8,
    fill: int = 16,
) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_base (places of a phrase), first_word and
    last_word (their smallest and largest start, words from 0; null if none), base_labels,
    labels (base and method), score and blocks (matching blocks of the method that do not overlap,
    by template).

    A block holds at most `fill` words more than its template has: names, years, marks of comments.
    Words are runs outside `[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`, A-Z lower-cased. score is 1 where
    a phrase stands, else the greatest containment of a matching block, else 0. A null or empty
    text has no words, no labels and score 0; a null doc_id and repeated rows come out as they
    are. Columns other than doc_id and text are not read.
    """
    docs = id_and_text(docs)
    known = Templates(templates, containment)
    known.order(_frequency(docs, known))
    runs = {
        label_of: np.array([word_hash(w) for w in _word_list(phrase)], np.uint64)
        for phrase, label_of in phrases.items()
    }
    schema = pa.schema(
        [
            ("doc_id", pa.int64()),
            ("n_words", pa.int64()),
            ("n_base", pa.int64()),
            ("first_word", pa.int64()),
            ("last_word", pa.int64()),
            ("base_labels", pa.string()),
            ("labels", pa.string()),
            ("score", pa.float64()),
            ("blocks", pa.int64()),
        ]
    )

    def run(batches):
        for batch in batches:
            for texts in chunks(batch["text"]):
                words = Words(texts, LETTER_OR_DIGIT)
                places = _places(words, runs)
                matches = _matches(words, known, fill)
                rows = [
                    _row(int(words.high[i] - words.low[i]), places[i], matches[i])
                    for i in range(len(texts))
                ]
                ids = batch["doc_id"].slice(texts.first_row, len(texts))
                yield table(schema, ids, *map(list, zip(*rows, strict=True)))

    return docs.mapInArrow(
        run,
        "doc_id long, n_words long, n_base long, first_word long, last_word long,"
        " base_labels string, labels string, score double, blocks long",
    )


def _frequency(docs: DataFrame, known: Templates) -> dict[int, int]:
    """Documents that hold each template word."""
    schema = pa.schema([("word", pa.int32()), ("n", pa.int64())])

    def run(batches):
        total = np.zeros(len(known.words), np.int64)
        for batch in batches:
            for texts in chunks(batch["text"]):
                words = Words(texts, LETTER_OR_DIGIT)
                number = known.numbers(words.hash)
                hit = number >= 0
                pair = np.unique(words.text[hit] * len(total) + number[hit])
                total += np.bincount(pair % len(total), minlength=len(total))
        yield table(schema, np.arange(len(total), dtype=np.int32), total)

    counts = docs.select("text").mapInArrow(run, "word int, n long").groupBy("word")
    return {r["word"]: r["n"] for r in counts.agg(F.sum("n").alias("n")).collect()}


def _places(words: Words, runs: dict[str, np.ndarray]) -> dict:
    """By text, the (start, label) of each phrase."""
    out = defaultdict(list)
    for label, run in runs.items():
        n = len(words) - len(run) + 1
        if n <= 0:
            continue
        found = words.hash[:n] == run[0]
        for j in range(1, len(run)):
            found &= words.hash[j : n + j] == run[j]
        at = np.flatnonzero(found)
        at = at[words.text[at] == words.text[at + len(run) - 1]]
        for i in at.tolist():
            text = int(words.text[i])
            out[text].append((i - int(words.low[text]), label))
    return out


def _matches(words: Words, known: Templates, fill: int) -> dict:
    """By text, the (containment, label, counts) of each matching block: the first of blocks that
    overlap counts, but all are given."""
    out = defaultdict(list)
    if not len(words):
        return out
    number = known.numbers(words.hash)
    rank = np.where(number >= 0, known.rank[number], -1)
    hits = np.flatnonzero(rank >= 0)
    for label, ranks in known.ranks.items():
        triggers = hits[known.is_prefix[label][rank[hits]]]
        if not len(triggers):
            continue
        own = hits[known.is_own[label][rank[hits]]]
        trigger = np.append(triggers, len(words))[np.searchsorted(triggers, own)]
        end = np.minimum(own + len(ranks) + fill, words.high[words.text[own]])
        near = trigger < end
        begin, end = own[near], end[near]
        places = {r: own[rank[own] == r] for r in ranks}
        free = 0
        for at, upto, both in _holding(begin, end, places, known.least[label]):
            out[int(words.text[at])].append((both / len(ranks), label, at >= free))
            free = upto if at >= free else free
    return out


def _holding(begin: np.ndarray, end: np.ndarray, places: dict[int, np.ndarray], least: int):
    """(begin, end, words) of the blocks that hold at least so many of the words at these places;
    end is after the last word needed."""
    length = end - begin >= least
    begin, end = begin[length], end[length]
    both, upto = np.zeros(len(begin), np.int64), begin.copy()
    left = len(places)
    for at in places.values():  # rarest first
        left -= 1
        first = np.append(at, np.iinfo(np.int64).max)[np.searchsorted(at, begin)]
        inside = first < end
        both += inside
        upto = np.where(inside, np.maximum(upto, first + 1), upto)
        kept = both + left >= least
        begin, end, both, upto = begin[kept], end[kept], both[kept], upto[kept]
        if not len(begin):
            break
    return zip(begin.tolist(), upto.tolist(), both.tolist(), strict=True)


def _row(n_words: int, places: list, matches: list) -> tuple:
    starts = [p for p, _ in places]
    base = {label for _, label in places}
    score = 1.0 if places else max((c for c, _, _ in matches), default=0.0)
    return (
        n_words,
        len(places),
        min(starts, default=None),
        max(starts, default=None),
        ",".join(sorted(base)),
        ",".join(sorted(base | {label for _, label, _ in matches})),
        score,
        sum(counts for _, _, counts in matches),
    )
