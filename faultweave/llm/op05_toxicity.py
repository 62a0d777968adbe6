"""Toxicity by a classifier chain.

The categories are predicted one after the other, and each linear model takes the probabilities
of the categories before it as further inputs. In training these come from models of the other
folds, so that a later model sees them as unsure as they will be on new text.

Inputs are words and beginnings of words, each as found once, twice, or three times and more; those
that tell toxic from clean most surely are kept, in whatever language.

Labels tell toxic from clean. The categories before `toxic` are labelled through it: a toxic
document with a word of the category's seeds belongs to the category. The chain is fitted in
numpy on the driver, on a bounded sample of labelled documents; each document is then scored where
it is read, without a shuffle.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultweave.llm.shared import (
    LETTER_OR_DIGIT,
    Texts,
    U64,
    Words,
    chunks,
    id_and_text,
    mixed,
    per_text,
    table,
    word_hash,
)

# Seed words of the categories that come before `toxic` in the chain.
SEEDS = {
    "insult": ("idiot", "moron", "stupid", "loser", "clown", "dumb", "fool"),
    "contempt": ("trash", "scum", "worthless", "pathetic", "disgusting", "vermin", "filth"),
}
CATEGORIES = (*SEEDS, "toxic")
#: Labelled documents to learn from, about, at most.
SAMPLE = 3_000
#: Longer texts are scored but not learned from, which bounds what the driver reads.
LEARNED_BYTES = 1 << 17
#: Inputs that are kept at most, those that tell toxic from clean best.
INPUTS = 384
#: Lengths in bytes of the beginnings of words, and the counts that are told apart.
PREFIXES = (4, 6)
LEVELS = 3
FOLDS = 5
LEAST_DOCS = 5
#: Standard errors by which the shares of an input must differ at least.
LEAST_Z = 4.0


def toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """One row per row of docs: doc_id, p_insult, p_contempt, p_toxic and toxic (p_toxic of a
    half or more).

    labels: (doc_id, toxic); null labels are left out, and of several labels of a document the
    highest counts. About `sample` labelled documents, chosen by their id, are learned from.
    Without labelled documents of both kinds every probability is 0. A null or empty text has no
    words and is scored by the models' constants. Null doc_ids and repeated rows come out as they
    are. Columns other than doc_id and text are not read.
    """
    chain = _fit(docs, labels, sample)
    names = [f"p_{c}" for c in CATEGORIES]
    schema = pa.schema(
        [("doc_id", pa.int64())] + [(c, pa.float64()) for c in names] + [("toxic", pa.bool_())]
    )

    def run(batches):
        for batch in batches:
            for texts in chunks(batch["text"]):
                ids = batch["doc_id"].slice(texts.first_row, len(texts))
                if chain is None:
                    p = np.zeros((len(texts), len(CATEGORIES)))
                else:
                    p = chain.predict(*chain.inputs(*_found(texts)), len(texts))
                yield table(schema, ids, *p.T.copy(), p[:, -1] >= 0.5)

    return id_and_text(docs).mapInArrow(
        run, "doc_id long, " + ", ".join(f"{c} double" for c in names) + ", toxic boolean"
    )


def _fit(docs: DataFrame, labels: DataFrame, sample: int):
    known = labels.where("doc_id is not null and toxic is not null")
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max(F.col("toxic").cast("int")).alias("label")
    )
    share = sample / max(1, known.count())
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) / (1 << 20)
    chosen = known.where(place < share)  # about `sample` rows, so small enough to broadcast
    schema = pa.schema([("doc_id", pa.int64()), ("label", pa.int32()), ("words", pa.binary())])

    def run(batches):
        for batch in batches:
            for texts in chunks(batch["text"]):
                part = slice(texts.first_row, texts.first_row + len(texts))
                found, text = _found(texts)
                order = np.argsort(text, kind="stable")
                own = per_text(found[order], text[order], len(texts))
                yield table(
                    schema,
                    batch["doc_id"][part],
                    batch["label"][part],
                    [np.concatenate(_levels(*np.unique(h, return_counts=True))).tobytes() for h in own],
                )

    # One row a document, of those that repeat an id the smallest text, and no text of many pages.
    rows = (
        id_and_text(docs)
        .join(F.broadcast(chosen), "doc_id")
        .groupBy("doc_id", "label")
        .agg(F.min("text").alias("text"))
        .where(F.octet_length("text") <= LEARNED_BYTES)
        .mapInArrow(run, "doc_id long, label int, words binary")
        .collect()
    )
    rows.sort(key=lambda r: (r["doc_id"], r["words"]))
    label = np.array([r["label"] for r in rows], np.int64)
    if not len(rows) or label.min() == label.max():
        return None
    words = [np.frombuffer(r["words"], np.uint64) for r in rows]
    fold = np.array([r["doc_id"] for r in rows]) % FOLDS
    del rows
    return Chain(words, label, fold)


def _found(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words and beginnings of words, and the text of each."""
    words = Words(texts, LETTER_OR_DIGIT)
    parts = [(words.hash, words.text), *(words.prefixes(size) for size in PREFIXES)]
    return tuple(np.concatenate([p[c] for p in parts]) for c in (0, 1))


def _levels(found: np.ndarray, count: np.ndarray) -> list[np.ndarray]:
    """The inputs of what was found so often: itself, and one more for each further level."""
    return [_level(found[count >= level], level) for level in range(1, LEVELS + 1)]


def _level(found: np.ndarray, level: int) -> np.ndarray:
    return found if level == 1 else mixed(found + U64(level))


class Chain:
    """Linear models in order, over the presence of inputs and the earlier probabilities."""

    def __init__(self, words: list[np.ndarray], toxic: np.ndarray, fold: np.ndarray):
        targets = []
        for seeds in SEEDS.values():
            seed = np.array([word_hash(w) for w in seeds], np.uint64)
            has = np.array([np.isin(seed, own).any() for own in words])
            targets.append((toxic == 1) & has)
        targets.append(toxic == 1)
        every = np.concatenate(words)
        text = np.repeat(np.arange(len(words), dtype=np.int32), [len(w) for w in words])
        self.vocabulary, self.base = _telling(every, text, toxic == 1)
        doc, column = self._columns(every, text)
        x = np.zeros((len(words), len(self.vocabulary) + len(targets)), np.float32)
        x[doc, column] = 1
        n = len(self.vocabulary)
        self.weights = []
        for k, target in enumerate(targets):
            held = x[:, : n + k]
            out_of_fold = np.zeros(len(words))
            for f in range(FOLDS):
                test = fold == f
                if test.any() and not test.all():
                    out_of_fold[test] = _probability(held[test], fitted(held[~test], target[~test]))
            self.weights.append(fitted(held, target))
            x[:, n + k] = out_of_fold

    def inputs(self, found: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of text and input, each once, of all that was found in the texts."""
        hit, at = _place(self.base, found)
        pair, count = np.unique(text[hit] * len(self.base) + at[hit], return_counts=True)
        text, at = np.divmod(pair, max(1, len(self.base)))
        text = np.concatenate([text[count >= level] for level in range(1, LEVELS + 1)])
        return self._columns(np.concatenate(_levels(self.base[at], count)), text)

    def _columns(self, inputs: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        hit, at = _place(self.vocabulary, inputs)
        return text[hit], at[hit]

    def predict(self, doc: np.ndarray, column: np.ndarray, texts: int) -> np.ndarray:
        """Probabilities by text and category; the last is of `toxic`."""
        n, p = len(self.vocabulary), np.zeros((texts, len(self.weights)))
        for k, w in enumerate(self.weights):
            z = np.bincount(doc, w[column], minlength=texts) + w[-1]
            z += p[:, :k] @ w[n : n + k]
            p[:, k] = _sigmoid(z)
        return p


def _place(ordered: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which values are among the ordered ones, and where."""
    if not len(ordered):
        return np.zeros(len(values), bool), np.zeros(len(values), np.int64)
    at = np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)
    return ordered[at] == values, at


def _telling(
    every: np.ndarray, text: np.ndarray, toxic: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the inputs whose shares among toxic and clean documents differ most surely, and
    of what they are levels of."""
    hashes = np.unique(every)
    yes, no = (
        np.bincount(np.searchsorted(hashes, every[toxic[text] == side]), minlength=len(hashes))
        for side in (True, False)
    )
    n_yes, n_no = toxic.sum(), (~toxic).sum()
    p = (yes + no) / (n_yes + n_no)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12) * (1 / n_yes + 1 / n_no))
    z = np.abs(yes / n_yes - no / n_no) / spread
    z[yes + no < LEAST_DOCS] = 0
    sure = np.flatnonzero(z >= LEAST_Z)
    best = hashes[sure[np.lexsort((hashes[sure], -z[sure]))[:INPUTS]]]
    base = [hashes[np.isin(_level(hashes, k), best)] for k in range(1, LEVELS + 1)]
    return np.sort(best), np.unique(np.concatenate(base))


def fitted(x: np.ndarray, y: np.ndarray, rounds: int = 8, ridge: float = 1.0) -> np.ndarray:
    """Weights and constant of a logistic regression with a ridge, by Newton's method."""
    x = np.column_stack([x, np.ones(len(x), np.float32)])
    penalty = np.append(np.full(x.shape[1] - 1, ridge), 1e-3)
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = _sigmoid(x @ w)
        slope = x.T @ (p - y) + penalty * w
        curve = (x * (p * (1 - p) + 1e-6)[:, None].astype(np.float32)).T @ x
        w = w - np.linalg.solve(curve + np.diag(penalty), slope)
    return w


def _probability(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return _sigmoid(x @ w[:-1] + w[-1])


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))
