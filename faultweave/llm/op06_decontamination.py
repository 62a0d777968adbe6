"""Benchmark decontamination: BM25 with block-max WAND, then overlap of question and answer.

Test items are indexed and every passage of every document is a query. Impacts are BM25 weights
divided by the item's own sum, so a score is the share of an item's weight whose words stand in
the passage, and one threshold serves all items. Passages are spans of 2 * step words at every
step words, where step is at least the longest item, so any place of an item lies in one whole.

The items are cut into ranges with the greatest impact of each term in each. A passage whose
terms cannot reach the threshold in any range is passed over, which array operations decide for
all passages at once. The rest walk the lists by WAND: lists stand at item
numbers in order, the pivot is where the sum of upper bounds first reaches the threshold, and
the maxima of the blocks around the pivot decide whether it is scored or jumped over. Nothing
above the threshold is missed.

Items retrieved are verified on the passage: the answer is the last sentence of an item (its last
quarter if it has one sentence only), the question what stands before.

The index is sent to tasks in blocks of at most ITEMS_AT_ONCE items, whose statistics are those
of all items; documents are read once a block and never shuffled.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import defaultdict
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultweave.llm.shared import LETTER_OR_DIGIT, Words, chunks, id_and_text, table, word_hash

ITEMS_AT_ONCE = 5_000
POSTINGS_A_BLOCK = 32
#: Ranges of items, at most, for which passages are bounded before they are searched.
RANGES = 64
#: The usual parameters of BM25.
K1, B = 1.2, 0.75
SHINGLE = 5
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def word_list(text: str) -> list[str]:
    return _WORD.findall(text.translate(_LOWER))


def contaminated(
    docs: DataFrame,
    items: DataFrame,
    threshold: float = 0.6,
    overlap: float = 0.8,
) -> DataFrame:
    """(doc_id, item_id, score, item_overlap, question_overlap, answer_overlap) of each pair of
    a document and an item that it contains; score is the passage's of best item_overlap.

    A pair counts if at least `overlap` of the item's 5-word shingles stand in one passage, or of
    both the question's shingles and the answer's words. Items and questions of fewer than five
    words have themselves as their one shingle.

    Null or empty texts, of documents or items, give no pair. Rows that repeat an item or a
    document each give theirs; null ids come out as they are. Columns other than the ids and
    texts are not read. No items or no documents give no rows.
    """
    docs = id_and_text(docs)
    items = items.select(
        F.col("item_id").cast("long").alias("item_id"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    total = items.agg(
        F.count("*").alias("n"), F.sum(_n_words()).alias("words"), F.max(_n_words()).alias("most")
    ).first()
    step = max(64, total["most"] or 0)
    mean = (total["words"] or 0) / max(1, total["n"])
    blocks = max(1, -(-total["n"] // ITEMS_AT_ONCE))
    frequency = items.select(F.explode(F.array_distinct(_words())).alias("term"))
    frequency = frequency.groupBy("term").agg(F.count("*").alias("df"))
    found = []
    for block in range(blocks):
        own = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block)
        terms = own.select(F.explode(_words()).alias("term")).distinct()
        df = {r["term"]: r["df"] for r in terms.join(frequency, "term").collect()}
        rows = [(r["item_id"], r["text"]) for r in own.orderBy("item_id", "text").collect()]
        index = Index(rows, df, total["n"], mean, threshold)
        found.append(_hits(docs, index, step, overlap))
    return reduce(DataFrame.union, found)


def _words():
    text = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.regexp_extract_all(text, F.lit(f"({_WORD.pattern})"))


def _n_words():
    return F.size(_words())


class Index:
    """Inverted lists of normalized BM25 impacts, in blocks with their maxima."""

    def __init__(self, items: list, df: dict[str, int], n: int, mean: float, threshold: float):
        self.items = items
        self.threshold = threshold
        lists = defaultdict(list)
        for i, (_, text) in enumerate(items):
            words = word_list(text)
            tf = defaultdict(int)
            for word in words:
                tf[word] += 1
            norm = K1 * (1 - B + B * len(words) / mean) if words else 1.0
            impact = {
                t: math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * c * (K1 + 1) / (c + norm)
                for t, c in tf.items()
            }
            own = sum(impact.values())
            for term, value in impact.items():
                lists[term].append((i, value / own))
        terms = sorted(lists)
        hashes = np.array([word_hash(t) for t in terms], np.uint64)
        by_hash = np.argsort(hashes)
        self.hashes = hashes[by_hash]
        terms = [terms[i] for i in by_hash]
        self.item = [[i for i, _ in lists[t]] for t in terms]
        self.impact = [[v for _, v in lists[t]] for t in terms]
        self.blocks = [
            [
                (own[min(len(own), at + POSTINGS_A_BLOCK) - 1], max(v[at : at + POSTINGS_A_BLOCK]))
                for at in range(0, len(own), POSTINGS_A_BLOCK)
            ]
            for own, v in zip(self.item, self.impact, strict=True)
        ]
        # The greatest impact of each term in each range of items.
        self.wide = wide = max(1, -(-len(items) // RANGES))
        self.by_range = np.zeros((len(terms), -(-len(items) // wide)), np.float32)
        for t, (own, v) in enumerate(zip(self.item, self.impact, strict=True)):
            np.maximum.at(self.by_range[t], np.array(own) // wide, np.array(v, np.float32))
        self.parts = {}

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """The term number of each word, -1 for words of no item."""
        if not len(self.hashes):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, at, -1)

    def search(self, terms: np.ndarray, part: int) -> list[tuple[int, float]]:
        """(item, score) of all items of a range of the threshold or more, by block-max WAND."""
        need = self.threshold - 1e-9
        most = self.by_range[terms, part]
        first, after = part * self.wide, (part + 1) * self.wide
        upper, lists = {}, []  # item at hand, its place, term
        for t, bound in zip(terms[most > 0].tolist(), most[most > 0].tolist(), strict=True):
            place = bisect_left(self.item[t], first)
            upper[t] = bound * (1 + 1e-6)  # rounded to single precision
            lists.append([self.item[t][place], place, t])
        out = []
        while lists:
            lists.sort()
            bound, pivot = 0.0, None
            for k, (_, _, t) in enumerate(lists):
                bound += upper[t]
                if bound >= need:
                    pivot = k
                    break
            if pivot is None:
                return out
            item = lists[pivot][0]
            while pivot + 1 < len(lists) and lists[pivot + 1][0] == item:
                pivot += 1
            # The blocks in which the lists up to the pivot would hold its item.
            bound, border = 0.0, math.inf
            for _, place, t in lists[: pivot + 1]:
                b = place // POSTINGS_A_BLOCK
                while b < len(self.blocks[t]) and self.blocks[t][b][0] < item:
                    b += 1
                if b < len(self.blocks[t]):
                    end, most = self.blocks[t][b]
                    bound += most
                    border = min(border, end + 1)
            if bound >= need:
                if lists[0][0] == item:
                    score = sum(self.impact[t][place] for _, place, t in lists[: pivot + 1])
                    if score >= need:
                        out.append((item, score))
                    goal = item + 1
                else:
                    goal = item
            else:
                goal = border
                if pivot + 1 < len(lists):
                    goal = min(goal, lists[pivot + 1][0])
                goal = max(goal, item + 1)
            kept = []
            for k, (at, place, t) in enumerate(lists):
                if k <= pivot and at < goal:
                    place = bisect_left(self.item[t], goal, place) if goal < math.inf else len(
                        self.item[t]
                    )
                    if place == len(self.item[t]) or self.item[t][place] >= after:
                        continue
                    at = self.item[t][place]
                kept.append([at, place, t])
            lists = kept
        return out

    def part(self, i: int) -> tuple:
        """Shingles of the item and of its question, with their length, and words of its answer."""
        if i not in self.parts:
            text = self.items[i][1]
            words = word_list(text)
            sentences = [s for s in (word_list(s) for s in re.split(r"[.!?]+\s", text)) if s]
            n = len(sentences[-1]) if len(sentences) > 1 else -(-len(words) // 4)
            question = words[: len(words) - n] or words
            whole = min(SHINGLE, len(words)), min(SHINGLE, len(question))
            self.parts[i] = (
                (whole[0], shingle_set(words, whole[0])),
                (whole[1], shingle_set(question, whole[1])),
                set(words[len(words) - n :]),
            )
        return self.parts[i]


def shingle_set(words: list[str], k: int) -> set:
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)}


def _share(part: set, k: int, own: list[str], there: dict[int, set]) -> float:
    """The share of a part's shingles that stand in the passage; there: the passage's by length."""
    if k == 1:
        return sum(w[0] in there[1] for w in part) / len(part)
    if k not in there:
        there[k] = shingle_set(own, k)
    return len(part & there[k]) / len(part)


def _hits(docs: DataFrame, index: Index, step: int, overlap: float) -> DataFrame:
    names = ("score", "item_overlap", "question_overlap", "answer_overlap")
    schema = pa.schema(
        [("doc_id", pa.int64()), ("item_id", pa.int64())] + [(c, pa.float64()) for c in names]
    )

    def run(batches):
        for batch in batches:
            ids, rows = batch["doc_id"], []
            for texts in chunks(batch["text"]):
                words = Words(texts, LETTER_OR_DIGIT)
                for i, pairs in _passages(words, index, step, overlap):
                    doc_id = ids[texts.first_row + i].as_py()
                    rows += [(doc_id, index.items[item][0], *values) for item, values in pairs]
            if rows:
                yield table(schema, *map(list, zip(*rows, strict=True)))

    return docs.mapInArrow(
        run, "doc_id long, item_id long, " + ", ".join(f"{c} double" for c in names)
    )


def _passages(words: Words, index: Index, step: int, overlap: float):
    """(text, its pairs) of the texts that have a passage near an item."""
    if not len(words) or not len(index.hashes):
        return
    count = words.high - words.low
    spans = -(-count // step)  # spans of step words in each text; a passage is two of them
    first = np.concatenate([[0], np.cumsum(spans)])
    place = np.arange(len(words)) - np.repeat(words.low, count)
    span = np.repeat(first[:-1], count) + place // step
    number = index.numbers(words.hash)
    hit = number >= 0
    pair = np.unique(span[hit] * len(index.hashes) + number[hit])
    in_span, term = np.divmod(pair, len(index.hashes))
    if not len(term):
        return
    # The bound of each passage in each range of items: its own span's and the next one's.
    begin = np.flatnonzero(np.concatenate([[True], in_span[1:] != in_span[:-1]]))
    bound = np.zeros((first[-1] + 1, index.by_range.shape[1]), np.float32)
    bound[in_span[begin]] = np.add.reduceat(index.by_range[term], begin, axis=0)
    last = np.zeros(first[-1], bool)
    last[first[1:][spans > 0] - 1] = True
    bound[:-1][~last] += bound[1:][~last]
    found = defaultdict(dict)
    for s in np.flatnonzero(bound[:-1].max(axis=1) >= index.threshold - 1e-4).tolist():
        low, high = np.searchsorted(in_span, [s, s + 1 + (not last[s])])
        terms = np.unique(term[low:high])
        near = np.flatnonzero(bound[s] >= index.threshold - 1e-4).tolist()
        retrieved = [hit for part in near for hit in index.search(terms, part)]
        if not retrieved:
            continue
        text = int(np.searchsorted(first, s, "right")) - 1
        begin = int(words.low[text]) + (s - int(first[text])) * step
        end = min(begin + 2 * step, int(words.high[text]))
        own = [
            words.data[a:b].tobytes().decode()
            for a, b in zip(words.begin[begin:end], words.end[begin:end], strict=True)
        ]
        there = {SHINGLE: shingle_set(own, SHINGLE), 1: set(own)}
        for item, score in retrieved:
            whole, question, answer = index.part(item)
            share, asked = (_share(part, k, own, there) for k, part in (whole, question))
            answered = len(answer & there[1]) / len(answer)
            if share >= overlap or min(asked, answered) >= overlap:
                best = found[text].get(item)
                if best is None or share > best[1]:
                    found[text][item] = (score, share, asked, answered)
    for text, items in found.items():
        yield text, sorted(items.items())
