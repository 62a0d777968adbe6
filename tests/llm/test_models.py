"""Trained operators by held-out accuracy, and the searches against plain scores."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest

from faultweave.llm import op06_decontamination as decontamination
from faultweave.llm.lyndon import suffix_array
from faultweave.llm.op05_toxicity import SEEDS, fitted, toxicity
from faultweave.llm.op06_decontamination import Index, contaminated, shingle_set, word_list
from faultweave.llm.op08_language_id import language_id
from faultweave.llm.shared import documents


def test_language_of_held_out_documents(spark, sf_dir):
    out = language_id(documents(spark, sf_dir))
    both = out.join(documents(spark, sf_dir).select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in both if r["held_out"]]
    assert len(held) > 30
    assert sum(r["lang"] == r["lang_pred"] for r in held) >= 0.95 * len(held)
    assert all(0 <= r["score"] <= 1 for r in both)


def test_language_of_texts_without_letters_or_labels(spark):
    schema = "doc_id long, text string, lang string"
    docs = spark.createDataFrame([(1, None, "en"), (2, "123 !", "en"), (3, "abc", None)], schema)
    out = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id(docs).collect()}
    assert out[1] == out[2] == ("und", 0.0)
    assert {r["lang_pred"] for r in language_id(docs.where("lang is null")).collect()} == {"und"}
    docs = docs.unionByName(
        spark.createDataFrame([(i, "some words here", "en") for i in range(10, 30)], schema)
    )
    out = {r["doc_id"]: r["lang_pred"] for r in language_id(docs).collect()}
    assert (out[1], out[2], out[3]) == ("und", "und", "en")


def test_toxicity_finds_toxic_and_leaves_clean(spark):
    rng = random.Random(4)
    bad = [w for seeds in SEEDS.values() for w in seeds]
    rows, labels = [], []
    for i in range(600):
        words = [f"w{rng.randrange(500)}" for _ in range(80)]
        toxic = i % 5 == 0
        if toxic:
            for _ in range(4):
                words[rng.randrange(80)] = rng.choice(bad)
        rows.append((i, " ".join(words)))
        if i < 400:
            labels.append((i, int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = toxicity(docs, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    new = [r for r in out if r["doc_id"] >= 400]
    assert sum(r["toxic"] == (r["doc_id"] % 5 == 0) for r in new) >= 0.97 * len(new)
    for r in out:
        assert r["toxic"] == (r["p_toxic"] >= 0.5)


def test_toxicity_without_labels(spark, odd):
    labels = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, toxic int")
    assert not any(r["toxic"] for r in toxicity(odd, labels).collect())


def test_newton_reaches_a_flat_slope():
    rng = np.random.default_rng(2)
    x = (rng.random((500, 12)) < 0.3).astype(np.float32)
    y = rng.random(500) < 1 / (1 + np.exp(-(x @ rng.normal(0, 1, 12) - 0.5)))
    w = fitted(x, y)
    p = 1 / (1 + np.exp(-(x @ w[:-1] + w[-1])))
    assert np.abs(x.T @ (p - y) + w[:-1]).max() < 1e-3


def test_search_finds_all_above_the_threshold():
    rng = random.Random(6)
    items = [(i, " ".join(f"t{int(rng.paretovariate(0.6))}" for _ in range(30))) for i in range(300)]
    df = Counter(t for _, text in items for t in set(word_list(text)))
    for threshold in (0.05, 0.2, 0.6):
        index = Index(items, df, len(items), 30.0, threshold)
        for _ in range(60):
            terms = sorted(rng.sample(range(len(index.hashes)), rng.randint(1, 80)))
            score = Counter()
            for t in terms:
                for i, v in zip(index.item[t], index.impact[t], strict=True):
                    score[i] += v
            want = {i: round(v, 9) for i, v in score.items() if v >= threshold - 1e-9}
            found = [
                hit
                for part in range(index.by_range.shape[1])
                for hit in index.search(np.array(terms), part)
            ]
            assert {i: round(v, 9) for i, v in found} == want


def test_contamination_against_all_pairs(spark, odd, monkeypatch):
    rng = random.Random(8)
    items = [
        (i, " ".join(f"q{rng.randrange(300)}" for _ in range(25)) + ". answer here now.")
        for i in range(60)
    ]
    items += [(100, None), (101, ""), (None, items[0][1]), (1, items[1][1])]
    docs = []
    for i in range(80):
        filler = " ".join(f"w{rng.randrange(300)}" for _ in range(rng.randrange(300)))
        own = word_list(items[i % 60][1])
        if i % 3 == 0:
            own[rng.randrange(len(own))] = "edited"
        text = " ".join(own[: 12 if i % 4 == 0 else None])
        docs.append((i, f"{filler} {text.upper()} {filler}"))
    left = spark.createDataFrame(docs, "doc_id long, text string")
    left = left.unionByName(odd.select("doc_id", "text"))
    right = spark.createDataFrame(items, "item_id long, text string")
    want = set()
    for k, text in docs:
        there = shingle_set(word_list(text), 5)
        for i, item in items:
            part = shingle_set(word_list(item or ""), 5)
            if part and len(part & there) >= 0.8 * len(part):
                want.add((k, i))
    for at_once in (20_000, 10):
        monkeypatch.setattr(decontamination, "ITEMS_AT_ONCE", at_once)
        got = {(r["doc_id"], r["item_id"]) for r in contaminated(left, right).collect()}
        assert got >= want
        assert all(k % 60 == (0 if i is None else i) for k, i in got)


@pytest.mark.parametrize("letters", [1, 2, 3, 26])
def test_suffix_array(letters):
    rng = random.Random(letters)
    for _ in range(400):
        text = bytes(97 + rng.randrange(letters) for _ in range(rng.randrange(50)))
        text = text[:9] * 4 if rng.random() < 0.2 else text
        assert suffix_array(text) == sorted(range(len(text)), key=lambda i: text[i:])


def test_numbers_are_no_letters(spark):
    rows = [(i, "plain words of one language here", "en") for i in range(20)]
    rows += [(101, "1 ½ ² ① Ⅷ", None), (102, "ª", None), (103, "ʰ", None), (104, "_ 9 ٣", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    out = {r.doc_id: r.lang_pred for r in language_id(docs).collect()}
    assert [out[i] for i in (101, 102, 103, 104)] == ["und", "en", "en", "und"]
