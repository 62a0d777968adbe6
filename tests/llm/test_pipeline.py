"""Decontamination, packing and the whole pipeline against plain Python."""

from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from faultweave.llm import op01_quality_rules
from faultweave.llm import op06_decontamination as decontamination
from faultweave.llm.op04_packing import assign

from .conftest import TOKENIZER, sentence, texts
from .test_rows_op_by_op import ALNUM, base_spans, joined, lower

# ---- 6: decontamination ----


def windows(words, k):
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)}


def share(part, whole):
    return len(part & whole) / len(part)


def plain_pairs(docs, items, threshold=0.6, overlap=0.8):
    """(document, item) of every passage against every item, by the two rules."""
    own = [ALNUM.findall(lower(t)) for _, t in items]
    mean = sum(map(len, own)) / max(1, len(own))
    df = Counter(w for words in own for w in set(words))
    weights = []
    for words in own:
        norm = 1.2 * (0.25 + 0.75 * len(words) / mean) if words else 1.0
        w = {}
        for t, c in Counter(words).items():
            w[t] = math.log(1 + (len(own) - df[t] + 0.5) / (df[t] + 0.5)) * c * 2.2 / (c + norm)
        weights.append({t: v / sum(w.values()) for t, v in w.items()})
    step = max([64, *map(len, own)])
    out = Counter()
    for k, text in docs:
        words = ALNUM.findall(lower(text))
        found = set()
        for at in range(0, len(words), step):
            passage = words[at : at + 2 * step]
            there = set(passage)
            for n, (_, item) in enumerate(items):
                if not own[n]:
                    continue
                if sum(v for t, v in weights[n].items() if t in there) < threshold - 1e-9:
                    continue
                parts = [ALNUM.findall(s) for s in re.split(r"[.!?]+\s", lower(item))]
                last = [p for p in parts if p]
                size = len(last[-1]) if len(last) > 1 else -(-len(own[n]) // 4)
                asked, answer = own[n][:-size] or own[n], set(own[n][-size:])
                whole, asked = (
                    share(windows(p, min(5, len(p))), windows(passage, min(5, len(p))))
                    for p in (own[n], asked)
                )
                if whole >= overlap or min(asked, share(answer, there)) >= overlap:
                    found.add(n)
        out.update((k, items[n][0]) for n in found)
    return out


@pytest.mark.parametrize("at_once", [20_000, 10])
def test_contamination_is_that_of_all_passages_and_items(spark, monkeypatch, at_once):
    monkeypatch.setattr(decontamination, "ITEMS_AT_ONCE", at_once)
    rng = random.Random(12)
    items = [
        (i, f"{sentence(rng, rng.randint(3, 40), 200)}. {sentence(rng, rng.randint(1, 9), 200)}!")
        for i in range(60)
    ]
    items += [(60, "one two"), (61, "single"), (62, None), (63, ""), (None, items[0][1])]
    docs = []
    for i in range(150):
        own = ALNUM.findall(items[i % 62][1])
        question, answer = own[: -len(own) // 5 or None], own[-len(own) // 5 :]
        kind = i % 5
        if kind == 1:  # question and answer apart
            own = question + sentence(rng, 30, 50).split() + answer
        elif kind == 2:  # the answer in another order
            own = question + rng.sample(answer, len(answer))
        elif kind == 3:
            own = [w if rng.random() < 0.95 else "edited" for w in own]
        elif kind == 4:
            own = own[: rng.randint(1, len(own))]
        before, after = (sentence(rng, rng.randrange(200), 200) for _ in range(2))
        docs.append((i, f"{before} {' '.join(own)} {after}"))
    docs += texts()
    left = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    right = spark.createDataFrame(items, "item_id long, text string")
    got = decontamination.contaminated(left, right).collect()
    want = plain_pairs(docs, items)
    assert Counter((r.doc_id, r.item_id) for r in got) == want
    assert len(want) > 60
    by_answer = [r for r in got if r.item_overlap < 0.8]
    assert by_answer and all(min(r.question_overlap, r.answer_overlap) >= 0.8 for r in by_answer)


# ---- 4: packing ----


def plain_assign(sizes, length):
    """Greedy by trying every sequence; the rest as single tokens."""
    full, rests = [], []
    for doc, size in enumerate(sizes):
        full += [[(doc, at, length)] for at in range(0, size - size % length, length)]
        if size % length:
            rests.append((-(size % length), doc, size - size % length))
    count = -sum(r[0] for r in rests) // length
    sequences, cost = [[] for _ in range(count)], [0.0] * count
    over = []
    while rests:
        rests.sort()
        negative, doc, at = rests.pop(0)
        size = -negative
        room = [length - sum(p[2] for p in s) for s in sequences]
        fits = [s for s in range(count) if room[s] >= size]
        if not fits:
            most = max(room, default=0)
            if not most:
                over += [(doc, at + i) for i in range(size)]
                continue
            fits = [s for s in range(count) if room[s] == most]
            rests.append((most - size, doc, at + most))
            size = most
        s = min(fits, key=lambda s: (cost[s], room[s], s))
        sequences[s].append((doc, at, size))
        cost[s] += size + size * size / length
    return full + sequences, over


@pytest.mark.parametrize("seed", range(8))
def test_assign_is_the_plain_greedy(seed):
    rng = random.Random(seed)
    length = 64
    sizes = [rng.choice([1, 5, 30, 31, 32, 63, 64, rng.randint(1, 300)]) for _ in range(rng.randint(1, 150))]
    want, over = plain_assign(sizes, length)
    got = assign(sizes, length)
    assert got[: len(want)] == want
    tail = got[len(want) :]
    assert [(doc, at + i) for s in tail for doc, at, n in s for i in range(n)] == over
    # The rest in falling powers of two.
    assert [sum(n for *_, n in s) for s in tail] == [
        1 << b for b in reversed(range(length)) if len(over) >> b & 1
    ]


# ---- the pipeline ----


def redacted(text):
    runs = []
    for span in filter(None, base_spans(text).split(",")):
        kind, a, b = span.split(":")
        if runs and int(a) < runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], int(b))
        else:
            runs.append([int(a), int(b), kind])
    for a, b, kind in reversed(runs):
        text = f"{text[:a]}[{kind.upper()}]{text[b:]}"
    return text


def corpus():
    """Documents for each stage to reject, and others, on hosts of different quality."""
    rng = random.Random(21)
    items = [(i, f"{sentence(rng, 25)}. {sentence(rng, 6)}.") for i in range(20)]
    private = ["a.b@mail.example.com", "10.0.0.1", "4111 1111 1111 1111", "+1 (555) 123-4567"]
    rows = []
    for i in range(240):
        text = sentence(rng, rng.randint(60, 160))
        host = f"h{i % 6}"
        if i % 12 == 1:
            text = " ".join(text.split()[:5])  # short
        elif i % 12 == 3:
            text = f"{text[:60]} " * 6  # repeats
        elif i % 12 == 5:
            text += f" {rng.choice(items)[1].upper()} {sentence(rng, 40)}"
        elif i % 12 == 7:
            text = f"{text} {rng.choice(private)} {sentence(rng, 20)} {rng.choice(private)}, {private[0]}"
        elif i % 12 == 9 and i > 20:
            own = rows[i - rng.choice([2, 12, 16])][1].split()
            own[rng.randrange(len(own))] = "edited"
            text = " ".join(own)
        elif i % 12 == 11:
            text = rows[rng.randrange(i)][1]
        rows.append((i, text, rng.choice(["en", "de", None]), host, len(text)))
    # A host of mostly rejected documents takes its good ones with it.
    rows += [
        (300 + i, "# $ % " * 20 if i < 30 else sentence(rng, 80), "en", "bad", 100) for i in range(35)
    ]
    rows += [(400, None, None, "h1", None), (401, "", "en", None, 0)]
    rows += [(402, sentence(rng, 90), None, None, 1), (403, sentence(rng, 3000), "en", "h2", 1)]
    return rows, items


def test_pipeline_equals_plain_python(spark, tmp_path):
    rows, items = corpus()
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame(rows, schema).repartition(3)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(
        f"{tmp_path}/benchmark.parquet"
    )
    # Quality rules by their SQL, all other stages in Python.
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS FROM '{tmp_path}/documents.parquet/*.parquet'")
    judged = con.sql(f"SELECT doc_id, kept, failed FROM ({op01_quality_rules.ORACLE})").fetchall()
    good = {k for k, kept, _ in judged if kept}
    stages = [[(k, t) for k, t, *_ in rows if k in good]]
    first = {k for k, _, component in joined(stages[-1]) if k == component}
    stages.append([(k, t) for k, t in stages[-1] if k in first])
    bad = {k for k, _ in plain_pairs(stages[-1], items)}
    stages.append([(k, t) for k, t in stages[-1] if k not in bad])
    stages.append([(k, redacted(t)) for k, t in stages[-1]])
    # Each stage has something to do.
    assert any(k not in good and not failed for k, _, failed in judged)
    sizes = [len(s) for s in stages]
    assert len(rows) > sizes[0] > sizes[1] > sizes[2] > 80
    assert sum(a != b for a, b in zip(stages[2], stages[3], strict=True)) >= 10

    tokenizer = Tokenizer.from_file(str(TOKENIZER))
    ids = {}
    for k, t in stages[-1]:
        own = tokenizer.encode(t, add_special_tokens=False).ids + [0]
        ids[k] = np.array(own, "<u4")
    covered, sequences = defaultdict(list), defaultdict(list)
    for r in corpus_pipeline.run(spark, str(tmp_path)).collect():
        own = ids[r.doc_id]
        assert r.doc_tokens == len(own)
        assert r.ids_crc32 == zlib.crc32(own[r.start : r.start + r.length].tobytes())
        covered[r.doc_id].append((r.start, r.length))
        sequences[r.sequence_id].append((r.offset, r.length))
    assert set(covered) == set(ids)
    for pieces, most in [(p, len(ids[k])) for k, p in covered.items()] + [
        (p, 1024) for p in sequences.values()
    ]:
        at = 0
        for start, n in sorted(pieces):
            assert start == at
            at += n
        assert at == most or (most == 1024 and at & (at - 1) == 0)
