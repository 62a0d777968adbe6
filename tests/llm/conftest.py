"""Small corpora with the awkward cases: nulls, empty and long texts, ties, repeats, clashes."""

from __future__ import annotations

import random

import public_tokenizers
import pytest

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
#: doc_id and text first; the others clash with names that the operators use.
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
CLASHING = COLUMNS + ", n_words long, key string, host string, spans string, kept int, h long"


def sentence(rng: random.Random, words: int, vocabulary: int = 400) -> str:
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(words))


def texts() -> list[tuple[int | None, str | None]]:
    rng = random.Random(3)
    passage = sentence(rng, 30)
    base = sentence(rng, 120)
    out: list[tuple[int | None, str | None]] = [
        (1, base),
        (2, base),
        (3, base.replace("w1 ", "x ", 1) + " tail"),
        (4, None),
        (5, ""),
        (6, " \n\t "),
        (7, "short"),
        (8, "One two three"),
        (9, "one TWO three"),
        (None, base),
        (None, None),
        (10, "x" * 60_000),
        (11, ("same line here\n" * 400) + "end"),
        (12, "Ünïcödé 日本語 " * 30 + "a.b@mail.example.com +1 (555) 123-4567 10.0.0.1"),
        (13, "no lower CASE ### *** $$$ %%% &&& ||| <<< >>> " * 5),
        (14, "0"),
    ]
    for i in range(15, 40):
        own = sentence(rng, 60)
        out.append((i, f"{own} {passage} {sentence(rng, 40)}" if i % 2 else own))
    family = sentence(rng, 150).split()
    for i in range(40, 60):
        edited = list(family)
        for _ in range(rng.randrange(0, 8)):
            edited[rng.randrange(len(edited))] = f"e{rng.randrange(10_000)}"
        out.append((i, " ".join(edited)))
    out += [(20, out[21][1]), (20, out[21][1]), (20, "another version of this document " * 4)]
    return out


@pytest.fixture(scope="session")
def odd(spark):
    rows = [
        (
            k,
            t,
            ("en", "de", None)[i % 3],
            ("a", "b", None, "c")[i % 4],
            None if t is None else len(t),
            7,
            "k",
            None,
            "s",
            1,
            i,
        )
        for i, (k, t) in enumerate(texts())
    ]
    return spark.createDataFrame(rows, CLASHING).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], CLASHING)


@pytest.fixture(scope="session")
def sf_dir():
    return "/root/testdata/sf0.001"
