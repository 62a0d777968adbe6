"""Hashes of words and shingles, and the join on texts that once broke or fooled them."""

from __future__ import annotations

import pyarrow as pa
import pytest

from faultweave.llm.op10_ngram_join import ngram_jaccard_join
from faultweave.llm.shared import CHUNK_BYTES, NOT_SPACE, Words, chunks, shingles, word_hash


def thue_morse(letters: str, doublings: int) -> str:
    word = letters
    for _ in range(doublings):
        word += word.translate(str.maketrans(letters, letters[::-1]))
    return word


WORD, COMPLEMENT = thue_morse("ab", 9), thue_morse("ba", 9)


def sets(texts, k):
    for chunk in chunks(pa.array(texts)):
        found, text = shingles(Words(chunk, NOT_SPACE), k, short=True)
        yield [found[text == i].tolist() for i in range(len(chunk))]


@pytest.mark.parametrize("k", range(1, 7))
def test_chunks_of_few_words(k):
    for n in range(k + 2):
        words = [f"w{i}" for i in range(n)]
        for texts in ([" ".join(words)], ["", " ".join(words), ""], words):
            if not texts:
                continue
            (own,) = sets(texts, k)
            for text, found in zip(texts, own, strict=True):
                have = len(text.split())
                assert len(found) == (max(1, have - k + 1) if have else 0)


def test_strings_of_structure_have_hashes_of_their_own():
    assert word_hash(WORD) != word_hash(COMPLEMENT)
    words = {f"{'x' * n}{c}{'x' * (70 - n)}" for n in range(71) for c in "ab"}
    words |= {"a" * n for n in range(1, 200)}
    assert len({word_hash(w) for w in words}) == len(words)
    one, other = (next(sets([f"{w} and more words behind"], 4))[0] for w in (WORD, COMPLEMENT))
    assert set(one) - set(other)


def test_hash_does_not_depend_on_the_neighbours():
    text = f"one {WORD} three four"
    (found,) = sets([text], 1)
    assert found[0] == [x for w in text.split() for x in next(sets([w], 1))[0]]


@pytest.mark.parametrize("texts", [["hello world"], ["one", "two"], ["", "a b", ""], ["a b c"]])
def test_join_of_few_words(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    out = {tuple(r) for r in ngram_jaccard_join(docs).collect()}
    assert out == {(i, int(bool(t)), i) for i, t in enumerate(texts)}


def test_join_keeps_structured_words_apart(spark):
    tail = " with the same few words behind"
    rows = [(1, WORD), (2, COMPLEMENT), (3, WORD.upper()), (4, WORD + tail), (5, COMPLEMENT + tail)]
    # Equal sets of different sequences link without being one sequence.
    rows += [(6, "a a a a"), (7, "a a a a a a"), (8, "A A\ta a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r["doc_id"]: r["component_id"] for r in ngram_jaccard_join(docs).collect()}
    assert out == {1: 1, 2: 2, 3: 1, 4: 4, 5: 5, 6: 6, 7: 6, 8: 6}


def test_join_of_texts_beyond_a_chunk(spark):
    long = " ".join(f"word{i}" for i in range(CHUNK_BYTES // 8))
    assert len(long) > CHUNK_BYTES
    huge = "x" * CHUNK_BYTES + " " + "y" * CHUNK_BYTES
    rows = [(1, "tiny one"), (2, long), (3, huge), (4, long + " end"), (5, huge), (6, "tiny one")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    out = {r["doc_id"]: r["component_id"] for r in ngram_jaccard_join(docs).collect()}
    assert out == {1: 1, 2: 2, 3: 3, 4: 2, 5: 3, 6: 1}
