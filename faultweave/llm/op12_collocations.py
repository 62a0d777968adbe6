"""Phrase collocation mining by set-oriented relations (SETM).

The texts of a language become relations of occurrences, sorted by piece and position and cut
into blocks of about BLOCK words. A row of the stored relation R(1) is one block: the words of its
pieces in order, with a gap in the numbering between pieces, so that neighbours in a piece are
neighbours in number. For each length k:

1. Group and count: each block counts its phrases of k words once and deals them to parts by their
   hash; within a part the counts of all blocks are added up by phrase.
2. Semi-join: a part tells each block which of the block's phrases are frequent, and only their
   occurrences stay in R(k).
3. Merge-join: an occurrence in R(k) and the one at the next position extend each other to an
   occurrence of k + 1 words. Both lists are sorted, so this is one pass.

Blocks meet in shuffles only as (phrase, count) lists of a block and a part, not as occurrences.
There a phrase is a hash of 64 bits; lists are sorted by it and hold differences, and the answer is
a bit a phrase. The first block that holds a frequent phrase gives its text.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from functools import reduce
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from faultweave.llm.shared import U64, mixed, saved, table

#: Words in a block, about, and in the unfinished blocks that a task holds.
BLOCK = 1 << 20
HELD = 1 << 21
#: Occurrences in a part, at most about, and the logarithm of the fewest parts.
PART = 1 << 22
PART_BITS = 6
#: Candidates ranked in one task, about.
RANKED = 100_000
LONGEST = 5

_CUT = re.compile(rb"[.,;:!?\x0A-\x0D]+")


def collocations(docs: DataFrame, least: int = 100, top: int = 2000) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first `top` collocations of each language.

    Texts are cut into pieces at `[.,;:!?\\x0A-\\x0D]` and these into words `[^\\x20\\x09]+`, with A-Z
    lowered. n counts the words of the language, a the occurrences of the phrase within pieces.
    Candidates have 2 to 5 words and a >= least. A cut behind the first words gives l and r, the
    occurrences of both parts, and floor(1000 * a * n / (l * r)); the lowest score counts, among
    equal ones that of the shortest first part. A candidate whose words stand inside a longer
    candidate that occurs as often is dropped. Ranks follow score and a, descending, and the
    phrase by its UTF-8 bytes, so there are no ties.

    A null lang is `und`; null and empty texts have no words, and a language without candidates
    has no rows. Repeated rows count each time. Columns other than text and lang are not read.
    """
    relation = saved(_blocks(docs))
    totals = saved(relation.groupBy("lang").agg(F.sum("n").alias("n")))
    words = totals.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    bits = max(PART_BITS, math.ceil(math.log2(max(words / PART, 1))))
    found = []
    for k in range(1, LONGEST + 1):
        answers = _answers(_counted(relation, k, bits).repartition("part"), least)
        answers = answers.groupBy("block").agg(F.collect_list(F.struct(*_ANSWER)).alias("answers"))
        relation = saved(_extended(relation, answers, k, bits))
        found.append(relation.select("lang", F.explode("named").alias("o")).select("lang", "o.*"))
    found = saved(reduce(DataFrame.unionByName, found))
    return _ranked(_scored(found, totals), top)


# ---- the relations ----


_PHRASES = pa.list_(pa.struct([("phrase", pa.string()), ("size", pa.int32()), ("f", pa.int64())]))
_RELATION = pa.schema(
    [("lang", pa.string()), ("block", pa.int64()), ("n", pa.int64())]
    + [(c, pa.binary()) for c in ("words", "ids", "places")]
    + [("named", _PHRASES)]
)
_COLUMNS = (
    "lang string, block long, n long, words binary, ids binary, places binary, "
    "named array<struct<phrase: string, size: int, f: long>>"
)


class _Block:
    """A block of one language: its distinct words, the numbers of its words in order with -1 for
    all that is not needed any more, and the places where the phrases of k words stand that stay."""

    def __init__(self, lang: str, words: list[bytes], at: np.ndarray, place: np.ndarray):
        self.lang, self.words, self.at, self.place = lang, words, at, place

    def hashes(self, k: int) -> np.ndarray:
        """Of the phrases at all places, telling languages apart."""
        digests = (blake2b(w, digest_size=8).digest() for w in self.words)
        word = np.frombuffer(b"".join(digests), np.uint64)
        # A hash apart from those of words: a word that is its language's name must not cancel it.
        lang = blake2b(self.lang.encode(), digest_size=8, person=b"lang").digest()
        h = np.full(len(self.place), np.frombuffer(lang, np.uint64)[0])
        for j in range(k):
            h = mixed((h ^ word[self.at[self.place + j]]) + U64(k))
        return h

    def row(self, block: int, n: int, named: list[dict]) -> pa.RecordBatch:
        words, ids = _pack(b" ".join(self.words)), _packed(self.at + 1)
        places = _packed(np.diff(self.place, prepend=0))
        named = pa.array([named], _PHRASES)
        return table(_RELATION, [self.lang], [block], [n], [words], [ids], [places], named)

    @classmethod
    def of(cls, batch: pa.RecordBatch, i: int) -> _Block:
        lang, words, ids, places = (batch[c][i].as_py() for c in ("lang", "words", "ids", "places"))
        words = zstandard.ZstdDecompressor().decompress(words).split(b" ")
        return cls(lang, words, _unpacked(ids) - 1, np.cumsum(_unpacked(places), dtype=np.int64))


def _pack(raw: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(raw)


def _packed(numbers: np.ndarray) -> bytes:
    """Numbers below 2**32, their low bytes first and their high bytes last, which pack better."""
    return _pack(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes())


def _unpacked(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8)
    return planes.reshape(4, -1).T.copy().view("<u4").reshape(-1).astype(np.int32)


def _packed_wide(numbers: np.ndarray) -> bytes:
    """Numbers below 2**64, byte by byte, the low bytes first."""
    return _pack(numbers.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes())


def _unpacked_wide(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8)
    return planes.reshape(8, -1).T.copy().view("<u8").reshape(-1)


def _blocks(docs: DataFrame) -> DataFrame:
    """The blocks, with the places of all their words."""

    def run(batches):
        next_block = TaskContext.get().partitionId() << 32
        texts, sizes = defaultdict(list), defaultdict(int)

        def closed(lang):
            nonlocal next_block
            number: dict[bytes, int] = {}
            ids = []
            for text in texts.pop(lang):
                for piece in _CUT.split(text.lower()):
                    own = piece.replace(b"\t", b" ").split(b" ")
                    own = [number.setdefault(w, len(number)) for w in own if w]
                    if own:
                        ids.append(np.array([*own, -1], np.int32))
            sizes.pop(lang)
            if ids:
                at = np.concatenate(ids)
                block = _Block(lang, list(number), at, np.flatnonzero(at >= 0))
                yield block.row(next_block, len(block.place), [])
                next_block += 1

        for batch in batches:
            for lang, text in zip(batch["lang"].to_pylist(), batch["text"], strict=True):
                raw = text.as_buffer().to_pybytes()
                texts[lang].append(raw)
                sizes[lang] += raw.count(b" ") + 1
                if sizes[lang] >= BLOCK or sum(sizes.values()) >= HELD:
                    yield from closed(max(sizes, key=sizes.get))
        for lang in list(sizes):
            yield from closed(lang)

    return docs.select(
        F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    ).mapInArrow(run, _COLUMNS)


#: What a part answers a block: bits of the phrases that are frequent and of those that the block is
#: to name, in the order of their hashes; and the occurrences of the latter.
_ANSWER = ("part", "stays", "named", "f")


def _deal(h: np.ndarray, bits: int) -> np.ndarray:
    """Where in the ascending hashes each part begins, and the end: a part has equal first bits."""
    first = np.arange(1 << bits, dtype=np.uint64) << U64(64 - bits)
    return np.append(np.searchsorted(h, first), len(h))


def _counted(relation: DataFrame, k: int, bits: int) -> DataFrame:
    """(part, block, h, c): how often each phrase of k words, by hash, stands in each block."""
    schema = pa.schema(
        [("part", pa.int32()), ("block", pa.int64()), ("h", pa.binary()), ("c", pa.binary())]
    )

    def run(batches):
        for batch in batches:
            for i, block in enumerate(batch["block"].to_pylist()):
                h, c = np.unique(_Block.of(batch, i).hashes(k), return_counts=True)
                at = _deal(h, bits)
                parts = np.flatnonzero(np.diff(at))
                own = [slice(at[p], at[p + 1]) for p in parts]
                lists = [_packed_wide(np.diff(h[o], prepend=U64(0))) for o in own]
                counts = [_packed_wide(c[o]) for o in own]
                yield table(schema, parts, np.full(len(parts), block), lists, counts)

    columns = relation.select("lang", "block", "words", "ids", "places")
    return columns.mapInArrow(run, "part int, block long, h binary, c binary")


def _answers(counted: DataFrame, least: int) -> DataFrame:
    """(block, part, stays, named, f): the answers to the lists that have frequent phrases. The rows
    of a part are in one partition."""
    schema = pa.schema(
        [("block", pa.int64()), ("part", pa.int32())] + [(c, pa.binary()) for c in _ANSWER[1:]]
    )

    def answered(part: int, lists: list[tuple[int, bytes, bytes]]):
        lists.sort(key=lambda x: x[0])
        own = [np.cumsum(_unpacked_wide(h), dtype=np.uint64) for _, h, _ in lists]
        end = np.cumsum([len(x) for x in own])
        h, c = np.concatenate(own), np.concatenate([_unpacked_wide(c) for _, _, c in lists])
        # Stable, so that the first row of a phrase is that of its first block.
        order = np.argsort(h, kind="stable")
        begin = np.flatnonzero(np.diff(h[order], prepend=~h[order[:1]]))
        f = np.add.reduceat(c[order].astype(np.int64), begin)
        stays, named = np.zeros(len(h), bool), np.zeros(len(h), bool)
        stays[order] = np.repeat(f >= least, np.diff(begin, append=len(h)))
        first = order[begin]
        named[first] = f >= least
        total = np.zeros(len(h), np.int64)
        total[first] = f
        for (block, _, _), low, high in zip(lists, [0, *end[:-1]], end, strict=True):
            here = stays[low:high], named[low:high]
            if here[0].any():
                told = [np.packbits(x).tobytes() for x in here]
                often = _packed_wide(total[low:high][here[1]])
                yield table(schema, [block], [part], [told[0]], [told[1]], [often])

    def run(batches):
        part, lists = None, []
        for batch in batches:
            for row in batch.to_pylist():
                if row["part"] != part and lists:
                    yield from answered(part, lists)
                    lists = []
                part = row["part"]
                lists.append((row["block"], row["h"], row["c"]))
        if lists:
            yield from answered(part, lists)

    columns = "block long, part int, stays binary, named binary, f binary"
    return counted.sortWithinPartitions("part").mapInArrow(run, columns)


def _extended(relation: DataFrame, answers: DataFrame, k: int, bits: int) -> DataFrame:
    """The blocks with the places of phrases of k + 1 words whose parts of k words are frequent;
    and the frequent phrases of k words that the block is to name, as text with their counts."""

    def run(batches):
        for batch in batches:
            for i, number in enumerate(batch["block"].to_pylist()):
                block = _Block.of(batch, i)
                own, first, which = np.unique(block.hashes(k), return_index=True, return_inverse=True)
                at = _deal(own, bits)
                stays, named, f = np.zeros(len(own), bool), [], []
                for answer in sorted(batch["answers"][i].as_py(), key=lambda x: x["part"]):
                    low, high = at[answer["part"]], at[answer["part"] + 1]
                    stays[low:high] = _bits(answer["stays"], high - low)
                    named.append(low + np.flatnonzero(_bits(answer["named"], high - low)))
                    f.append(_unpacked_wide(answer["f"]))
                grams = block.place[first[np.concatenate(named)]]
                told = _named(block, grams, np.concatenate(f), k)
                place = block.place[stays[which]]
                # Merge-join: k words here and k words at the next place are k + 1 words.
                here = place[:-1][np.diff(place) == 1]
                yield _only(block, here[: None if k < LONGEST else 0], k + 1).row(number, 0, told)

    columns = relation.select("lang", "block", "words", "ids", "places")
    return columns.join(answers, "block").mapInArrow(run, _COLUMNS)


def _bits(raw: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(raw, np.uint8), count=n).astype(bool)


def _named(block: _Block, place: np.ndarray, f: np.ndarray, k: int) -> list[dict]:
    grams = np.stack([block.at[place + j] for j in range(k)], axis=1).tolist()
    return [
        {"phrase": b" ".join(block.words[w] for w in gram).decode(), "size": k, "f": n}
        for gram, n in zip(grams, f.tolist(), strict=True)
    ]


def _only(block: _Block, place: np.ndarray, k: int) -> _Block:
    """The block with the k words at each place only."""
    needed = np.zeros(len(block.at), bool)
    for j in range(k):
        needed[place + j] = True
    used, number = np.unique(block.at[needed], return_inverse=True)
    at = np.full(len(block.at), -1, np.int32)
    at[needed] = number
    return _Block(block.lang, [block.words[w] for w in used], at, place)


# ---- scores and ranks ----


def _scored(found: DataFrame, totals: DataFrame) -> DataFrame:
    """(lang, phrase, a, l, r, n, score) of the candidates that no longer one contains."""
    candidates = found.where("size > 1")
    words = F.split("phrase", " ")
    # A phrase inside a longer one that occurs as often is also inside one that is longer by a word.
    inside = candidates.where("size > 2").select(
        "lang",
        F.explode(
            F.array(
                F.array_join(F.slice(words, F.lit(1), F.col("size") - 1), " "),
                F.array_join(F.slice(words, F.lit(2), F.col("size") - 1), " "),
            )
        ).alias("phrase"),
        "f",
    )
    inside = inside.groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    cuts = (
        candidates.join(inside, ["lang", "phrase"], "left")
        .where("longer is null or longer < f")
        .select("lang", "phrase", "size", F.col("f").alias("a"), words.alias("words"))
        .withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
        .select(
            "lang", "phrase", "a", "k",
            F.array_join(F.slice("words", F.lit(1), F.col("k")), " ").alias("first"),
            F.array_join(F.slice("words", F.col("k") + 1, F.col("size") - F.col("k")), " ").alias("rest"),
        )
    )
    part = found.select("lang", F.col("phrase").alias("part"), F.col("f"))
    cuts = cuts.join(part.withColumnsRenamed({"part": "first", "f": "l"}), ["lang", "first"])
    cuts = cuts.join(part.withColumnsRenamed({"part": "rest", "f": "r"}), ["lang", "rest"])
    wide = "cast({} as decimal(19, 0))"
    above = f"cast(1000L * a as decimal(19, 0)) * {wide.format('n')}"
    score = f"({above}) div ({wide.format('l')} * {wide.format('r')})"
    return (
        cuts.join(totals, "lang")
        .withColumn("score", F.expr(score))
        .groupBy("lang", "phrase", "a", "n")
        .agg(F.min(F.struct("score", "k", "l", "r")).alias("best"))
        .select("lang", "phrase", "a", "best.l", "best.r", "n", "best.score")
    )


def _ranked(scored: DataFrame, top: int) -> DataFrame:
    """The first of each language: first of parts that no task finds too large, then of these."""
    scored = saved(scored)
    parts = scored.groupBy("lang").agg(F.ceil(F.count("*") / RANKED).alias("parts"))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    part = F.pmod(F.xxhash64("phrase"), "parts")
    own = Window.partitionBy("lang", part).orderBy(*order)
    best = scored.join(parts, "lang").withColumn("rank", F.row_number().over(own))
    whole = Window.partitionBy("lang").orderBy(*order)
    best = best.where(F.col("rank") <= top).withColumn("rank", F.row_number().over(whole))
    return best.where(F.col("rank") <= top).select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"
    )


ORACLE = r"""
WITH t AS (
  SELECT coalesce(lang, 'und') AS lang, row_number() OVER () AS doc,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS x
  FROM documents
), piece AS (
  SELECT lang, row_number() OVER () AS piece, p FROM (
    SELECT lang, unnest(regexp_split_to_array(x, '[.,;:!?\x0A-\x0D]')) AS p FROM t)
), w AS (
  SELECT lang, piece, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM (
    SELECT lang, piece,
      list_filter(regexp_split_to_array(p, '[\x20\x09]+'), lambda y: y <> '') AS ws FROM piece)
), g AS (
  SELECT lang, word AS w1, lead(word, 1) OVER o AS w2, lead(word, 2) OVER o AS w3,
    lead(word, 3) OVER o AS w4, lead(word, 4) OVER o AS w5
  FROM w WINDOW o AS (PARTITION BY piece ORDER BY i)
), total AS (
  SELECT lang, count(*) AS n FROM w GROUP BY 1
), f AS (
  SELECT lang, 1 AS size, w1 AS phrase, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 100
  UNION ALL SELECT lang, 2, w1 || ' ' || w2, count(*) FROM g
  WHERE w2 IS NOT NULL GROUP BY ALL HAVING count(*) >= 100
  UNION ALL SELECT lang, 3, concat_ws(' ', w1, w2, w3), count(*) FROM g
  WHERE w3 IS NOT NULL GROUP BY ALL HAVING count(*) >= 100
  UNION ALL SELECT lang, 4, concat_ws(' ', w1, w2, w3, w4), count(*) FROM g
  WHERE w4 IS NOT NULL GROUP BY ALL HAVING count(*) >= 100
  UNION ALL SELECT lang, 5, concat_ws(' ', w1, w2, w3, w4, w5), count(*) FROM g
  WHERE w5 IS NOT NULL GROUP BY ALL HAVING count(*) >= 100
), cand AS (
  SELECT * FROM f WHERE size > 1 AND NOT EXISTS (
    SELECT 1 FROM f b WHERE b.lang = f.lang AND b.size > f.size AND b.f >= f.f
      AND contains(' ' || b.phrase || ' ', ' ' || f.phrase || ' '))
), cut AS (
  SELECT c.lang, c.phrase, c.f AS a, k, l.f AS l, r.f AS r, n,
    (1000::HUGEINT * c.f * n) // (l.f::HUGEINT * r.f) AS score
  FROM cand c, generate_series(1, 4) s(k), f l, f r, total t
  WHERE k < c.size AND l.lang = c.lang AND r.lang = c.lang AND t.lang = c.lang
    AND l.phrase = array_to_string(string_split(c.phrase, ' ')[1:k], ' ')
    AND r.phrase = array_to_string(string_split(c.phrase, ' ')[k + 1:], ' ')
), best AS (
  SELECT * FROM cut
  QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
)
SELECT lang,
  row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase::BLOB) AS rank,
  phrase, a, l, r, n, score::BIGINT AS score
FROM best QUALIFY rank <= 2000
"""
