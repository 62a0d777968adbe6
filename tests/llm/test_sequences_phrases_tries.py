"""Best-fit packing, phrase collocations and the conversation trie against plain Python."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from faultweave.llm import op11_best_fit, op12_collocations, op13_prefix_trie
from faultweave.llm.op11_best_fit import best_fit, descending_best_fit, improved, offsets
from faultweave.llm.op12_collocations import collocations
from faultweave.llm.op13_prefix_trie import prefix_trie
from faultweave.llm.queries import WORD_TOKENIZER
from faultweave.llm.tokens import PART, WordEncoder

from .conftest import texts

# ---- 11: best-fit packing ----

ODD_TEXTS = [
    "Hello <|endoftext|> end <|startoftext|>don't we'll I'VE 12345 ²½ ªº µ ÀÉÎõ÷× Straße",
    "naïve café 日本語 ΣΑΣ İstanbul \x1c\x1d\x85\xa0 x ﬁ",
    "<|endoftext|",
    "''s 's's't \t\r\n\x0b\x0c !!!...###",
    "x" * 5000 + " " + "1" * 700 + " " + "#" * 3000,
]


@pytest.fixture(scope="module")
def word_tokenizer():
    return Tokenizer.from_file(WORD_TOKENIZER)


def test_word_ids_are_those_of_the_file(word_tokenizer):
    encoder = WordEncoder(WORD_TOKENIZER)
    for text in ODD_TEXTS + [t or "" for _, t in texts()]:
        want = word_tokenizer.encode(text, add_special_tokens=False).ids
        assert encoder.ids(text).tolist() == want
    long = "some words and 日本 more " * (PART // 12)
    assert encoder.ids(long).tolist() == word_tokenizer.encode(long, add_special_tokens=False).ids


def check_packing(rows, ids_of, length):
    """Every id in one piece, pieces gapless, sequences within length; their number."""
    left = Counter()
    for ids in ids_of:
        for number, start in enumerate(range(0, len(ids), length)):
            own = ids[start : start + length]
            left[number, start, len(own), zlib.crc32(own.tobytes())] += 1
    assert Counter((r.piece, r.start, r.length, r.ids_crc32) for r in rows) == left
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for own in sequences.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at
            at += n
        assert at <= length
    return len(sequences)


@pytest.mark.parametrize("block", [1 << 15, 8])
def test_best_fit_is_whole_and_tight(odd, word_tokenizer, monkeypatch, block):
    monkeypatch.setattr(op11_best_fit, "BLOCK", block)
    rows = best_fit(odd, WORD_TOKENIZER, length=512).collect()
    ids_of = [
        np.array([*word_tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        for _, t in texts()
    ]
    assert Counter(r.doc_id for r in rows if r.start == 0) == Counter(k for k, _ in texts())
    count = check_packing(rows, ids_of, 512)
    if block > 8:
        size = np.array([min(512, len(x) - s) for x in ids_of for s in range(0, len(x), 512)])
        assert count <= descending_best_fit(size, 512).max() + 1


def test_one_of_few_rows_and_none(spark, none):
    assert best_fit(none, WORD_TOKENIZER).collect() == []
    docs = spark.createDataFrame([(1, None), (None, ""), (3, "w " * 9000)], "doc_id long, text string")
    rows = best_fit(docs.repartition(3), WORD_TOKENIZER).collect()
    # Three tasks, yet the short pieces share the sequence with room.
    assert len({r.sequence_id for r in rows}) == 3
    assert sorted(r.length for r in rows) == [1, 1, 809, 4096, 4096]


@pytest.mark.parametrize("low, high", [(1, 300), (30, 70), (26, 51), (50, 101), (1, 2)])
def test_search_never_needs_more(low, high):
    rng = np.random.default_rng(low)
    size = rng.integers(low, high, 300)
    size = size[size <= 100]
    before = descending_best_fit(size, 100)
    worse = rng.permutation(len(size))  # a sequence of its own for each piece
    for start in (before, worse):
        after = improved(size, start, 100)
        fill = np.bincount(after, size)
        assert fill.max() <= 100 and fill.min() > 0
        assert len(fill) <= start.max() + 1
        place = offsets(size, after)
        for b in range(len(fill)):
            own = sorted(zip(place[after == b], size[after == b], strict=True))
            assert [p for p, _ in own] == [0, *np.cumsum([n for _, n in own])[:-1]]


def test_search_empties_what_best_fit_leaves():
    # One for one, two for one: a donor of 30 drains into sequences that trade up.
    size = np.array([50, 40, 45, 45, 20])
    bins = np.array([0, 0, 1, 1, 2])
    assert improved(size, bins, 110).max() + 1 == 2
    size = np.array([60, 30, 70, 25, 10, 5])
    assert improved(size, np.array([0, 0, 1, 1, 2, 2]), 100).max() + 1 == 2


# ---- 12: phrase collocations ----


def plain_collocations(rows, least, top):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, 6):
                f[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = Counter()
    for lang, count in f.items():
        cand = {p: a for p, a in count.items() if len(p) > 1 and a >= least}
        inside = set()
        for longer, often in cand.items():
            for k in range(2, len(longer)):
                for i in range(len(longer) - k + 1):
                    part = longer[i : i + k]
                    if often >= cand[part]:
                        inside.add(part)
        scored = []
        for p, a in cand.items():
            if p in inside:
                continue
            score, k = min(
                (1000 * a * n[lang] // (count[p[:k]] * count[p[k:]]), k) for k in range(1, len(p))
            )
            text = " ".join(p)
            scored.append((-score, -a, text.encode(), text, count[p[:k]], count[p[k:]]))
        for rank, (score, a, _, text, left, right) in enumerate(sorted(scored)[:top], 1):
            out[lang, rank, text, -a, left, right, n[lang], -score] += 1
    return out


def phrase_rows():
    rng = random.Random(5)
    words = ["The", "of", "new", "york", "Ünïon", "x y", "ALPHA", "beta", "日本", "\x0b", "\x1f"]
    rows = [(None, None), ("en", ""), ("de", " \t . ,"), ("xx", "only one")]
    for i in range(60):
        line = []
        for _ in range(rng.randrange(1, 60)):
            if rng.random() < 0.3:
                line.append("new york city hall is")
            line.append(rng.choice(words) + rng.choice(["", "", "", ",", ".", "\t", "\n", " "]))
        rows.append((rng.choice(["en", "en", "de", None, "und"]), " ".join(line)))
    rows += [rows[-1]] * 5 + [("en", "word " * 700)]
    return rows


@pytest.mark.parametrize("block, top", [(1 << 19, 2000), (50, 7)])
def test_collocations(spark, monkeypatch, block, top):
    monkeypatch.setattr(op12_collocations, "BLOCK", block)
    monkeypatch.setattr(op12_collocations, "HELD", 2 * block)
    monkeypatch.setattr(op12_collocations, "RANKED", 5)
    rows = phrase_rows()
    docs = spark.createDataFrame(
        [(i, *r, "k", 1, 2) for i, r in enumerate(rows)],
        "doc_id long, lang string, text string, phrase string, block long, h long",
    )
    out = collocations(docs.repartition(3), least=6, top=top)
    assert out.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    want = plain_collocations(rows, 6, top)
    assert Counter(map(tuple, out.collect())) == want
    assert len({lang for lang, *_ in want}) >= 3


def test_collocations_with_words_that_name_their_language(spark):
    names = ["en", "de", "fr", "und", "x"]
    rng = random.Random(9)
    rows = [
        (rng.choice(["en", "de", "fr", "und", None, ""]), " ".join(rng.choices(names, k=40)))
        for _ in range(60)
    ]
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    want = plain_collocations(rows, 3, 2000)
    assert Counter(map(tuple, collocations(docs, least=3).collect())) == want
    assert len({lang for lang, *_ in want}) == 5


def test_blocks_and_parts_exchange_lists_and_bits(spark, monkeypatch):
    """A block and a part meet in one row each way, however many phrases they share."""
    monkeypatch.setattr(op12_collocations, "BLOCK", 300)
    monkeypatch.setattr(op12_collocations, "HELD", 600)
    rng = random.Random(4)
    rows = [("en", " ".join(f"w{int(rng.expovariate(0.03))}" for _ in range(60))) for _ in range(80)]
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(2)
    relation = op12_collocations._blocks(docs).cache()
    counted = op12_collocations._counted(relation, 1, 2).cache()
    pairs = counted.select("block", "part").collect()
    assert len(pairs) == len(set(pairs)) <= 4 * relation.count()
    answers = op12_collocations._answers(counted.repartition("part"), 6).collect()
    assert {(r["block"], r["part"]) for r in answers} <= set(map(tuple, pairs))
    assert len(answers) == len({(r["block"], r["part"]) for r in answers})
    count = Counter(w for _, text in rows for w in text.split())
    told = [n for r in answers for n in op12_collocations._unpacked_wide(r["f"]).tolist()]
    assert sorted(told) == sorted(n for n in count.values() if n >= 6)
    assert sum(len(r["f"]) > 0 for r in answers) > 4


def test_scores_beyond_64_bits(spark):
    found = [("a", 10**12, 1), ("b", 10**12, 1), ("a b", 10**12 - 1, 2)]
    rows = [("en", p, s, f) for p, f, s in found]
    found = spark.createDataFrame(rows, "lang string, phrase string, size int, f long")
    totals = spark.createDataFrame([("en", 10**15)], "lang string, n long")
    (row,) = op12_collocations._scored(found, totals).collect()
    assert row["score"] == 1000 * (10**12 - 1) * 10**15 // (10**12 * 10**12)


def test_no_collocations_of_no_rows(none, odd):
    assert collocations(none).collect() == []
    collocations(odd).collect()


# ---- 13: conversation trie ----


def plain_trie(rows, heads=4, family=20):
    turns = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            key = (turn is not None, turn or 0)
            turns[c].append((key, (role or "").encode(), (text or "").encode()))
    for own in turns.values():
        own.sort()
    member, ends = defaultdict(set), defaultdict(list)
    for c in sorted(turns):
        h = zlib.crc32(str(c).encode()) % heads
        base = c - (c % family if c >= 0 else -(-c % family))
        path = [t[1:] for t in turns.get(base, [])[:h] + turns[c][h:]]
        for d in range(len(path) + 1):
            member[tuple(path[:d])].add(c)
        ends[tuple(path)].append(str(c))
    children = Counter(p[:-1] for p in member if p)
    saved, leaves = Counter(), Counter()
    for p, own in member.items():
        words = len(re.findall(rb"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        for d in range(len(p) + 1):
            saved[p[:d]] += (len(own) - 1) * words
            leaves[p[:d]] += not children[p]
    return Counter(
        (
            min(own),
            len(p),
            min(member[p[:-1]]) if p else None,
            len(own),
            children[p],
            leaves[p],
            saved[p],
            hashlib.sha256(",".join(ends[p]).encode()).hexdigest(),
        )
        for p, own in member.items()
    )


def conversations():
    rng = random.Random(9)
    say = ["hi", "hello there", "", None, "a  b\tc\nd", "Ünï", "x\x1fy"]
    rows = [(None, 0, "user", "nobody"), (7, None, "user", "null first"), (7, None, None, None)]
    rows += [(7, 0, "user", "zero"), (7, 0, "user", "same turn"), (7, 0, "user", "same turn")]
    rows += [(-3, 1, "user", "negative"), (-20, 1, "user", "negative"), (10**15 + 1, 3, "user", "big")]
    for c in range(200):
        if c % 20 == 0 and rng.random() < 0.3:
            continue
        for t in range(rng.choice([1, 1, 2, 3, 4, 6])):
            rows.append((c, t, ("user", "bot", None)[t % 3], rng.choice(say[: rng.choice([2, 7])])))
    for c in range(300, 360):  # a large group of equal conversations
        rows += [(c, t, "user", "common opening") for t in range(12)]
    rows += [(400, t, "user", f"turn {t} of many") for t in range(500)]
    rows += [(401, t, "user", f"turn {t} of many") for t in range(499)]
    return rows


@pytest.mark.parametrize("turns, depth", [(1 << 20, 64), (40, 64), (40, 2), (3, 1)])
def test_trie(spark, monkeypatch, turns, depth):
    monkeypatch.setattr(op13_prefix_trie, "RANGE_TURNS", turns)
    monkeypatch.setattr(op13_prefix_trie, "SPLITTER_TURNS", depth)
    monkeypatch.setattr(op13_prefix_trie, "ROWS", 16)
    monkeypatch.setattr(op13_prefix_trie, "RANGES", 64)
    rows = conversations()
    table = spark.createDataFrame(
        [(*r, "k", 1) for r in rows],
        "conv_id long, turn long, role string, text string, path string, depth long",
    )
    out = prefix_trie(table.repartition(3))
    got = [tuple(r) for r in out.collect()]
    want = plain_trie(rows)
    assert Counter(got) == want
    assert len({r[:2] for r in got}) == len(got)


def test_trie_of_no_conversations(spark):
    columns = "conv_id long, turn long, role string, text string"
    assert prefix_trie(spark.createDataFrame([], columns)).collect() == []
    nobody = spark.createDataFrame([(None, 1, "user", "x")], columns)
    assert prefix_trie(nobody).collect() == []


def test_trie_of_turnless_conversations(spark):
    # crc32("1") % 4 is 3: without conversation 0 nothing is left of conversation 1.
    assert zlib.crc32(b"1") % 4 == 3
    table = spark.createDataFrame(
        [(1, 0, "user", "gone")], "conv_id long, turn long, role string, text string"
    )
    (root,) = prefix_trie(table).collect()
    assert tuple(root) == (1, 0, None, 1, 0, 1, 0, hashlib.sha256(b"1").hexdigest())
