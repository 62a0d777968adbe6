"""Language identification by a byte convolutional network in numpy.

A text is cut into windows of fixed length. Bytes are embedded, filters of several widths pass
over them, the greatest value of each filter feeds a softmax over the languages, and the windows'
probabilities are averaged by their bytes. The network is trained on a bounded sample of labelled
windows on the driver; every window of every text is then scored in batches where the text is
read, without a shuffle. For scoring, embedding and filters are multiplied out once: a filter's
value at a place is a sum of table entries, one for each byte it covers.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultweave.llm.shared import Texts, byte_class, chunks, id_and_text, table

LENGTH = 256
WIDTHS = (2, 3, 4)
FILTERS = 16
EMBEDDED = 8
#: Documents of a language that training takes at most, on average, and windows of each.
DOCS_A_LANGUAGE = 500
WINDOWS_A_DOC = 4
#: A window cut short, so that short texts are known too.
SHORT = 24
EPOCHS = 12
UNKNOWN = "und"
_REACH = max(WIDTHS) - 1
_ASCII_LETTER = byte_class((65, 90), (97, 122))


def _has_letter(text: str) -> bool:
    """Whether a character is of Unicode category L; numbers such as ² and ½ are not."""
    return any(map(str.isalpha, text))


def language_id(docs: DataFrame, docs_a_language: int = DOCS_A_LANGUAGE) -> DataFrame:
    """One row per row of docs: doc_id, held_out, lang_pred and score.

    Documents whose crc32(doc_id as text) mod 4 is 2 are held out; the network learns from text
    and lang of a sample of the others, about docs_a_language of each non-null lang. score is the
    mean probability of lang_pred.

    A null text, or one without a letter, is `und` with score 0, and so is every text where no
    document can be learned from. A null doc_id is neither held out nor learned from; repeated
    rows come out each. Columns other than doc_id, text and lang are not read.
    """
    remainder = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4
    known = docs.where(remainder != 2).where("lang is not null and text is not null")
    model = _fit(known, docs_a_language)
    schema = pa.schema(
        [
            ("doc_id", pa.int64()),
            ("held_out", pa.bool_()),
            ("lang_pred", pa.string()),
            ("score", pa.float64()),
        ]
    )

    def run(batches):
        for batch in batches:
            for texts in chunks(batch["text"]):
                part = slice(texts.first_row, texts.first_row + len(texts))
                lang, score = _predicted(texts, model)
                ids, held = batch["doc_id"][part], batch["held_out"][part]
                yield table(schema, ids, held, lang, score)

    held_out = F.coalesce(remainder == 2, F.lit(False)).alias("held_out")
    return id_and_text(docs, held_out).mapInArrow(
        run, "doc_id long, held_out boolean, lang_pred string, score double"
    )


def _fit(known: DataFrame, docs_a_language: int):
    """The trained network, or None without labelled text."""
    count = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    if not count:
        return None
    share = F.create_map(
        *(F.lit(x) for lang, n in count.items() for x in (lang, min(1.0, docs_a_language / n)))
    )
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) / (1 << 20)
    # Of rows that repeat an id the smallest text, so documents bound the rows.
    sample = known.where(place < share[F.col("lang")]).groupBy("doc_id", "lang")
    sample = sample.agg(F.min("text").alias("text"))
    schema = pa.schema([("lang", pa.string()), ("bytes", pa.binary())])

    def run(batches):
        for batch in batches:
            for texts in chunks(batch["text"]):
                lang, cut = [], []
                for i in range(len(texts)):
                    raw = texts.of(i)
                    step = max(LENGTH, -(-len(raw) // WINDOWS_A_DOC))
                    own = [raw[at : at + LENGTH] for at in range(0, len(raw), step)]
                    own.append(raw[:SHORT])
                    own = [w for w in own if w]
                    cut += own
                    lang += [batch["lang"][texts.first_row + i].as_py()] * len(own)
                yield table(schema, lang, cut)

    rows = sorted(
        (r["lang"], bytes(r["bytes"]))
        for r in sample.mapInArrow(run, "lang string, bytes binary").collect()
    )
    if not rows:
        return None
    langs = sorted({lang for lang, _ in rows})
    number = {lang: i for i, lang in enumerate(langs)}
    windows = np.zeros((len(rows), LENGTH + _REACH), np.uint8)
    for i, (_, raw) in enumerate(rows):
        windows[i, : len(raw)] = np.frombuffer(raw, np.uint8)
    labels = np.array([number[lang] for lang, _ in rows])
    network = Network(len(langs))
    network.train(windows, labels)
    return langs, network.tables(), network.bias, network.out, network.out_bias


class Network:
    """Embedding, filters (narrow ones are zero beyond their width), max pooling, softmax."""

    def __init__(self, classes: int, seed: int = 1):
        rng = np.random.default_rng(seed)
        reach, filters = _REACH + 1, FILTERS * len(WIDTHS)
        self.rng = rng
        self.embed = rng.normal(0, 0.5, (256, EMBEDDED)).astype(np.float32)
        self.embed[0] = 0
        self.filters = rng.normal(0, 0.3, (reach, EMBEDDED, filters)).astype(np.float32)
        self.covers = np.zeros((reach, 1, filters), np.float32)
        for k, width in enumerate(WIDTHS):
            self.covers[:width, :, k * FILTERS : (k + 1) * FILTERS] = 1
        self.filters *= self.covers
        self.bias = np.zeros(filters, np.float32)
        self.out = rng.normal(0, 0.2, (filters, classes)).astype(np.float32)
        self.out_bias = np.zeros(classes, np.float32)

    def tables(self) -> np.ndarray:
        """By place in the filter and byte, what it adds to each filter."""
        return np.einsum("be,jef->jbf", self.embed, self.filters)

    def train(self, windows: np.ndarray, labels: np.ndarray, batch: int = 64) -> None:
        weights = [self.embed, self.filters, self.bias, self.out, self.out_bias]
        moments = [(np.zeros_like(w), np.zeros_like(w)) for w in weights]
        step = 0
        for epoch in range(EPOCHS):
            rate = 0.01 * (1 - epoch / EPOCHS)
            order = self.rng.permutation(len(labels))
            for at in range(0, len(order), batch):
                own = order[at : at + batch]
                step += 1
                slopes = self._slopes(windows[own], labels[own])
                for w, (m, v), g in zip(weights, moments, slopes, strict=True):
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    fix = np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
                    w -= (rate * fix) * m / (np.sqrt(v) + 1e-7)
                self.filters *= self.covers
                self.embed[0] = 0

    def _slopes(self, windows: np.ndarray, labels: np.ndarray) -> list[np.ndarray]:
        n = len(labels)
        value = convolved(windows, self.tables())
        best = value.argmax(axis=1)
        pooled = np.take_along_axis(value, best[:, None, :], 1)[:, 0] + self.bias
        hidden = np.maximum(pooled, 0)
        p = softmax(hidden @ self.out + self.out_bias)
        p[np.arange(n), labels] -= 1
        p /= n
        down = (p @ self.out.T) * (pooled > 0)
        d_embed, d_filters = np.zeros_like(self.embed), np.zeros_like(self.filters)
        for j in range(_REACH + 1):
            byte = np.take_along_axis(windows, best + j, 1)  # window, filter
            d_filters[j] = np.einsum("nfe,nf->ef", self.embed[byte], down)
            back = down[:, :, None] * self.filters[j].T[None]
            np.add.at(d_embed, byte.ravel(), back.reshape(-1, EMBEDDED))
        return [d_embed, d_filters, down.sum(0), hidden.T @ p, p.sum(0)]


def convolved(windows: np.ndarray, tables: np.ndarray) -> np.ndarray:
    """Values by window, place and filter."""
    places = windows.shape[1] - _REACH
    value = tables[0][windows[:, :places]]
    for j in range(1, _REACH + 1):
        value += tables[j][windows[:, j : places + j]]
    return value


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _predicted(texts: Texts, model) -> tuple[list[str], list[float]]:
    if model is None:
        return [UNKNOWN] * len(texts), [0.0] * len(texts)
    langs, tables, bias, out, out_bias = model
    size = texts.end - texts.start
    count = -(-size // LENGTH)
    text = np.repeat(np.arange(len(texts)), count)
    at = np.concatenate([[0], np.cumsum(count)])
    begin = texts.start[text] + (np.arange(len(text)) - at[text]) * LENGTH
    held = np.minimum(LENGTH, texts.end[text] - begin)
    data = np.concatenate([texts.data, np.zeros(LENGTH + _REACH, np.uint8)])
    weight = np.zeros((len(texts), len(langs)))
    span = np.arange(LENGTH + _REACH)
    for low in range(0, len(text), 64):
        part = slice(low, low + 64)
        windows = data[begin[part, None] + span]
        windows[span >= held[part, None]] = 0
        pooled = convolved(windows, tables).max(axis=1) + bias
        p = softmax(np.maximum(pooled, 0) @ out + out_bias)
        np.add.at(weight, text[part], p * held[part, None])
    weight /= np.maximum(size, 1)[:, None]
    best = weight.argmax(axis=1)
    lang, score = [], []
    for i in range(len(texts)):
        raw = texts.data[texts.start[i] : texts.end[i]]
        if _ASCII_LETTER[raw].any() or _has_letter(raw.tobytes().decode()):
            lang.append(langs[best[i]])
            score.append(min(1.0, float(weight[i, best[i]])))
        else:
            lang.append(UNKNOWN)
            score.append(0.0)
    return lang, score
