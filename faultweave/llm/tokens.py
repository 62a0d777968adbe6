"""Byte-level and word-level BPE tokenizers from tokenizers files, as numpy ids."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import tiktoken
from tokenizers import Tokenizer

# Fixed value: the published pattern by which byte-level BPE cuts a text before merging.
PATTERN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
)


def _byte_of() -> dict[str, int]:
    """Bytes by the printable characters that stand for them in vocabulary files."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class Encoder:
    """Ids of a text without special tokens put around it.

    A string of a special token in a text is ordinary text, or with `special` that token, as the
    tokenizers file has it. The ids are those of the tokenizers file. Where its merges stand in the order of their ids,
    the same merges are run by tiktoken, which takes a quarter of the time; texts that it
    refuses, and other files, go to the tokenizers library.
    """

    def __init__(self, path: str, special: bool = False):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        byte_of = _byte_of()
        own = {t["content"] for t in spec["added_tokens"]}
        vocab = {t: i for t, i in spec["model"]["vocab"].items() if t not in own}
        self.special = tuple(own) if special else ()
        ranks = {bytes(byte_of[c] for c in t): i for t, i in vocab.items()}
        merges = (m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"])
        order = [vocab["".join(m)] for m in merges]
        self.slow = Tokenizer.from_file(path)
        self.slow.encode_special_tokens = not special
        #: Bytes that each id stands for.
        self.bytes = np.zeros(max(ranks.values()) + 1, np.int64)
        for raw, i in ranks.items():
            self.bytes[i] = len(raw)
        self.fast = None
        if order == sorted(order):
            self.fast = tiktoken.Encoding(
                "own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}
            )

    def ids(self, text: str) -> np.ndarray:
        if self.fast is not None and not any(t in text for t in self.special):
            try:
                return self.fast.encode_to_numpy(text, disallowed_special=())
            except ValueError:  # a run too long for its pattern matcher
                pass
        found = self.slow.encode(text, add_special_tokens=False).ids
        return np.array(found, np.uint32)


#: Characters at most in a part of a text that is taken apart at once; distinct words remembered.
PART = 1 << 20
REMEMBERED = 1 << 18
# The published pattern by which this kind of tokenizer cuts a text, for the
# characters of Latin-1 in lower case.
_LETTERS = "a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff"
_NUMBERS = "0-9\xb2\xb3\xb9\xbc-\xbe"
_BLANKS = "\\t-\\r \x85\xa0"
_WORD = re.compile(
    f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[^{_LETTERS}{_NUMBERS}{_BLANKS}]+"
)


class WordEncoder:
    """Ids of a text by a tokenizer whose words end with a mark and which drops white space.

    The ids are those of the tokenizers file. Texts of Latin-1 characters are cut into words here
    and their merges run by tiktoken, with a blank for the mark, for no word holds one; ids of
    words met before are remembered. All other texts, and those with strings of special tokens, go
    to the tokenizers library.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        byte_of = _byte_of()
        self.special = [t["content"] for t in spec["added_tokens"]]
        mark = spec["model"]["end_of_word_suffix"]
        ranks = {}
        for token, i in spec["model"]["vocab"].items():
            if token not in self.special:
                body = token.removesuffix(mark)
                ends = b" " if body != token else b""
                ranks[bytes(byte_of[c] for c in body) + ends] = i
        self.slow = Tokenizer.from_file(path)
        self.merges = tiktoken.Encoding(
            "own", pat_str="[^ ]+ ", mergeable_ranks=ranks, special_tokens={}
        )
        self.known: dict[str, tuple[int, ...]] = {}

    def ids(self, text: str) -> np.ndarray:
        return np.concatenate([np.zeros(0, "<u4"), *map(self._part, _parts(text))])

    def _part(self, text: str) -> np.ndarray:
        try:
            text.encode("latin-1")
            plain = not any(s in text for s in self.special)
        except UnicodeEncodeError:
            plain = False
        if not plain:
            return np.array(self.slow.encode(text, add_special_tokens=False).ids, "<u4")
        words = _WORD.findall(text.lower())
        return np.fromiter(chain.from_iterable(map(self._word, words)), "<u4")

    def _word(self, word: str) -> tuple[int, ...]:
        found = self.known.get(word)
        if found is None:
            try:
                found = tuple(self.merges.encode_ordinary(word + " "))
            except ValueError:  # a run too long for its pattern matcher
                found = tuple(self.slow.encode(word, add_special_tokens=False).ids)
            if len(self.known) < REMEMBERED and len(word) < 64:
                self.known[word] = found
        return found


def _parts(text: str) -> Iterator[str]:
    """The text, cut at blanks; no word lies across a cut."""
    at = 0
    while len(text) - at > PART:
        cut = text.find(" ", at + PART)
        if cut < 0:
            break
        yield text[at:cut]
        at = cut
    yield text[at:]
