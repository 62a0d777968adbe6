"""N-gram Jaccard join: size-aware, small sets by subsets and large sets by inverted lists.

A document is the set of its k-word shingles. Two sets A and B of similarity s or more share at
least t(n) = ceil(s * n) shingles for the size n of either, because their union is no smaller.

- **Small sets** (up to the boundary size x). A pair whose larger set has m shingles shares a
  subset of t(m) of them. Each set of n gives its subsets of t(m) shingles for every m that a
  partner may have; equal subsets meet as equal keys.
- **Large sets** are found on inverted lists. The shingles of a set are put in hash order and
  the first n - t(n) + l(n) are listed; a similar pair then shares at least l(t(n)) listed
  shingles. Scanning the lists counts, for each set, how many of its listed shingles any other
  document has; sets with too few leave at once. Those that stay keep only their rarest listed
  shingles: so many that any partner still shares one.
- **The boundary** is the size that makes the fewest rows, from the counts of sizes.

Equal word sequences are one class from the start, by a cryptographic digest. On each list only the leader (smallest class) meets
all others; those links are verified on whole sets and joined to components. Then members that
stand in another component than their leader meet the rest of their list. So a family of near
copies costs its list's length and not its square, and no link between different sets is lost:
every pair on a common list is verified, connected already, or ruled out because the buckets of
two sets bound their overlap.
"""

from __future__ import annotations

from hashlib import blake2b
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultweave.llm.components import components
from faultweave.llm.shared import (
    NOT_SPACE,
    U64,
    Words,
    chunks,
    id_and_text,
    mixed,
    one_text,
    packed,
    per_text,
    saved,
    shingles,
    signed,
    table,
    unpacked,
)

#: Sizes considered as boundary. The subsets of a set this small stay below a few hundred.
LARGEST_SMALL = 16
#: Members of a list that meet others in one task, about, and hash buckets of their sketches.
BLOCK = 2048
BUCKETS = 256
#: Rows that a listed shingle costs: counted once, joined once, gathered once.
LIST_COST = 3


class Bounds:
    """Overlaps and sizes that follow from the least similarity, as a percentage."""

    def __init__(self, percent: int):
        self.percent = percent

    def overlap(self, n: int) -> int:
        return -(-self.percent * n // 100)

    def largest_partner(self, n: int) -> int:
        return 100 * n // self.percent

    def listed(self, n: int) -> int:
        return n - self.overlap(n) + 1 + 3 * n // 20

    def shared(self, n: int) -> int:
        return 1 + 3 * self.overlap(n) // 20

    def subsets(self, n: int) -> int:
        return sum(
            comb(n, self.overlap(m))
            for m in range(n, self.largest_partner(n) + 1)
            if self.overlap(m) <= n
        )


def ngram_jaccard_join(docs: DataFrame, k: int = 4, percent: int = 85) -> DataFrame:
    """(doc_id, n_shingles, component_id) of each row of docs.

    n_shingles is the number of distinct k-word shingles; a text with fewer words, but one at
    least, has its whole sequence as its one shingle. component_id is the smallest doc_id that
    links of `percent` or more reach, the row's own included.

    A null or empty text has an empty set, which links with nothing, not even with another
    empty set. Rows without doc_id come out with a null component and link nothing. Rows that
    repeat a doc_id each come out and are versions of one document, linked if any version is.
    Columns other than doc_id and text are not read.
    """
    bounds = Bounds(percent)
    docs = id_and_text(docs)
    sets = saved(_sets(docs, k))
    classes = saved(
        sets.where("n > 0 and doc_id is not null")
        .groupBy("key", "check", "n")
        .agg(F.min("doc_id").alias("node"))
    )
    entries = saved(_entries(docs, classes, bounds, k))
    ends = F.struct("node", "n")
    lists = entries.groupBy("h").agg(F.min(ends).alias("lead"), F.max("node").alias("last"))
    lists = lists.where("lead.node < last").select("h", "lead")
    members = saved(entries.join(lists, "h"))
    bodies = saved(_bodies(docs, members.select("node").distinct()))

    near = f"100 * least(n, lead.n) >= {percent} * greatest(n, lead.n)"
    star = members.where("node <> lead.node").where(near)
    star = star.select(F.col("lead.node").alias("a"), F.col("node").alias("b")).distinct()
    star_links = saved(_verified(star, bodies, percent, k))
    reached = components(star_links)
    rest = _beyond_leader(members, reached, _sketched(bodies, k), percent)
    more_links = _verified(rest, bodies, percent, k)
    reached = components(star_links.union(more_links))

    whole = sets.join(classes, ["key", "check", "n"], "left").join(reached, "node", "left")
    return whole.select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.coalesce("component", "node", "doc_id").alias("component_id"),
    )


def _sets(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, n, key, check): size of each document's set, and the digest of its words."""
    schema = pa.schema([(c, pa.int64()) for c in ("doc_id", "n", "key", "check")])

    def run(batches):
        for batch in batches:
            for texts in chunks(batch["text"]):
                n = [len(own) for own in _distinct(texts, k)]
                ids = batch["doc_id"].slice(texts.first_row, len(texts))
                key, check = np.array([_digest(texts.of(i)) for i in range(len(texts))]).T
                yield table(schema, ids, n, key, check)

    return docs.mapInArrow(run, "doc_id long, n long, key long, check long")


def _digest(text: bytes) -> np.ndarray:
    """128 bits of blake2b over the words, as two numbers."""
    words = b" ".join(text.lower().split())
    return np.frombuffer(blake2b(words, digest_size=16).digest(), np.int64)


def _word_shingles(text: bytes, k: int) -> set[tuple]:
    """The set of a text as words, without hashes."""
    words = text.lower().split()
    if len(words) < k:
        return {tuple(words)} if words else set()
    return set(zip(*(words[i:] for i in range(k)), strict=False))


def _distinct(texts, k: int):
    found, text = shingles(Words(texts, NOT_SPACE), k, short=True)
    return (np.unique(own) for own in per_text(found, text, len(texts)))


def _boundary(classes: DataFrame, bounds: Bounds) -> int:
    """The largest size whose sets are enumerated, by least number of rows."""
    top = bounds.largest_partner(LARGEST_SMALL + 1)
    rows = classes.where(F.col("n") <= top).groupBy("n").count().collect()  # top rows at most
    count = {r["n"]: r["count"] for r in rows}

    def cost(x: int) -> int:
        small = sum(count.get(n, 0) * bounds.subsets(n) for n in range(1, x + 1))
        listed = range(bounds.overlap(x + 1), top + 1)
        return small + LIST_COST * sum(count.get(n, 0) * bounds.listed(n) for n in listed)

    return min(range(LARGEST_SMALL + 1), key=lambda x: (cost(x), x))


def _entries(docs: DataFrame, classes: DataFrame, bounds: Bounds, k: int) -> DataFrame:
    """(h, node, n): keys under which a set must meet every set similar to it."""
    x = _boundary(classes, bounds)
    keys = _keys(docs, bounds, x, k)
    often = keys.groupBy("h").agg(F.count("*").alias("often")).where("often > 1")
    # Keys of small sets must meet once; of listed shingles, as often as any partner implies.
    least = f"if(small, 1L, 1L + (({bounds.percent} * n + 99) div 100) * 3 div 20)"
    rarest = "slice(array_sort(own), 1, greatest(0, int(size(own) - least + 1)))"
    kept = (
        keys.join(often, "h")
        .groupBy("key", "n", "small")
        .agg(F.collect_set(F.struct("often", "h")).alias("own"))
        .withColumn("least", F.expr(least))
        .where("size(own) >= least")
        .select("key", "n", F.expr(rarest).alias("own"))
        .select("key", "n", F.explode("own.h").alias("h"))
    )
    return kept.join(classes.select("key", "n", "node"), ["key", "n"]).select("h", "node", "n")


def _keys(docs: DataFrame, bounds: Bounds, x: int, k: int) -> DataFrame:
    """(h, key, n, small): subsets of the small sets, listed shingles of all that may need it."""
    schema = pa.schema(
        [("h", pa.int64()), ("key", pa.int64()), ("n", pa.int64()), ("small", pa.bool_())]
    )
    listed_from = bounds.overlap(x + 1)

    def run(batches):
        for batch in batches:
            seen = set()  # copies within a batch give the same keys
            for texts in chunks(batch["text"]):
                h, key, n, small = [], [], [], []
                for i, own in enumerate(_distinct(texts, k)):
                    size = len(own)
                    if not size:
                        continue
                    name = int(_digest(texts.of(i))[0])
                    if name in seen:
                        continue
                    seen.add(name)
                    parts = []
                    if size <= x:
                        parts.append((_subsets(own, bounds), True))
                    if size >= listed_from:
                        parts.append((own[: bounds.listed(size)], False))
                    for part, is_small in parts:
                        h.append(part)
                        key.append(np.full(len(part), name, np.int64))
                        n.append(np.full(len(part), size, np.int64))
                        small.append(np.full(len(part), is_small))
                if h:
                    h = signed(np.concatenate(h))
                    yield table(schema, h, *map(np.concatenate, (key, n, small)))

    return docs.where("doc_id is not null").mapInArrow(
        run, "h long, key long, n long, small boolean"
    )


def _subsets(own: np.ndarray, bounds: Bounds) -> np.ndarray:
    n, out = len(own), []
    value, total = mixed(own ^ U64(0xAAAA)), None
    total = value.sum()
    for m in range(n, bounds.largest_partner(n) + 1):
        left_out = n - bounds.overlap(m)
        if left_out < 0:
            continue
        dropped = list(combinations(range(n), left_out))
        gone = value[np.array(dropped, np.int64).reshape(len(dropped), left_out)].sum(axis=1)
        out.append(mixed(total - gone.astype(np.uint64) + U64(m)))
    return np.concatenate(out)


def _bodies(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, body) of the nodes given."""
    return packed(docs).join(nodes, F.col("doc_id") == F.col("node")).select("node", "body")


def _verified(pairs: DataFrame, bodies: DataFrame, percent: int, k: int) -> DataFrame:
    """Those pairs (a, b) whose sets are as similar as asked: by hashes first, then by words."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches):
        last, leader, words = None, None, None
        for batch in batches:
            good = []
            a, b = batch["a"].to_pylist(), batch["b"].to_pylist()
            two = zip(unpacked(batch["body_a"]), unpacked(batch["body_b"]), strict=True)
            for i, (body_a, body_b) in enumerate(two):
                if body_a != last:
                    last, leader, words = body_a, next(_distinct(one_text(body_a), k)), None
                other = next(_distinct(one_text(body_b), k))
                both = len(np.intersect1d(leader, other, assume_unique=True))
                if 100 * both < percent * (len(leader) + len(other) - both):
                    continue
                words = words or _word_shingles(body_a, k)
                other = _word_shingles(body_b, k)
                both = len(words & other)
                if 100 * both >= percent * (len(words) + len(other) - both):
                    good.append(i)
            yield table(schema, [a[i] for i in good], [b[i] for i in good])

    of_b = bodies.select(F.col("node").alias("b"), F.col("body").alias("body_b"))
    of_a = bodies.select(F.col("node").alias("a"), F.col("body").alias("body_a"))
    return pairs.join(of_b, "b").join(of_a, "a").mapInArrow(run, "a long, b long")


def _beyond_leader(members: DataFrame, reached: DataFrame, sketches: DataFrame, percent: int):
    """Pairs (a, b) of a list in different components, of which one at least isn't in the
    leader's, that may be as similar as asked by their sizes and sketches.

    A list is cut into blocks, and blocks meet in tasks: those apart from their leader as probes,
    all members as the list. So a task holds two blocks at most, and only pairs that pass come
    out of it.
    """
    of = reached.withColumnRenamed("component", "of")
    lead = reached.select(F.col("node").alias("lead_node"), F.col("component").alias("lead_of"))
    placed = saved(
        members.select("h", "node", "n", F.col("lead.node").alias("lead_node"))
        .join(of, "node", "left")
        .join(lead, "lead_node", "left")
        .withColumn("of", F.coalesce("of", "node"))
        .withColumn("apart", F.expr("of <> coalesce(lead_of, lead_node)"))
        .drop("lead_of")
    )
    # On a list of two, the other has met the leader already.
    sizes = placed.groupBy("h").agg(
        F.ceil(F.count_if("apart") / BLOCK).alias("probes"), F.ceil(F.count("*") / BLOCK).alias("rows"),
        F.count("*").alias("members"),
    )
    sizes = sizes.where("probes > 0 and members > 2").drop("members")
    held = placed.join(sizes, "h").join(sketches, "node")
    place = F.xxhash64("node")
    probes = held.where("apart").select(
        "*",
        F.lit(0).alias("side"),
        F.pmod(place, "probes").alias("p"),
        F.explode(F.sequence(F.lit(0), F.col("rows") - 1)).alias("r"),
    )
    rows = held.select(
        "*",
        F.lit(1).alias("side"),
        F.explode(F.sequence(F.lit(0), F.col("probes") - 1)).alias("p"),
        F.pmod(place, "rows").alias("r"),
    )
    cell = ("h", "p", "r")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches):
        kept = None
        for batch in batches:
            part = pa.Table.from_batches([batch])
            if kept is not None:
                part = pa.concat_tables([kept, part])
            at = np.stack([part[c].to_numpy() for c in cell])
            new = np.flatnonzero((at[:, 1:] != at[:, :-1]).any(axis=0)) + 1
            edges = [0, *new.tolist()]
            for low, high in zip(edges, edges[1:], strict=False):
                yield from _near(part.slice(low, high - low), percent, schema)
            kept = part.slice(edges[-1]).combine_chunks()
        if kept is not None:
            yield from _near(kept, percent, schema)

    return (
        probes.unionByName(rows)
        .select(*cell, "side", "node", "n", "of", "lead_node", "sketch", "excess")
        .repartition(*cell)
        .sortWithinPartitions(*cell, "side")
        .mapInArrow(run, "a long, b long")
        .distinct()
    )


def _near(cell: pa.Table, percent: int, schema: pa.Schema):
    """The pairs of a cell that pass: equal buckets of two sketches bound the overlap."""
    side = cell["side"].to_numpy()
    probes = int(np.searchsorted(side, 1))
    if not 0 < probes < len(side):
        return
    column = {c: cell[c].to_numpy() for c in ("node", "n", "of", "lead_node", "excess")}
    sketch = np.frombuffer(b"".join(cell["sketch"].to_pylist()), np.uint8).reshape(-1, BUCKETS)
    row = {c: v[probes:] for c, v in column.items()}
    a, b = [], []
    for i in range(probes):
        own = {c: v[i] for c, v in column.items()}
        ok = (row["of"] != own["of"]) & (row["node"] != own["lead_node"])
        low, high = np.minimum(row["n"], own["n"]), np.maximum(row["n"], own["n"])
        ok &= 100 * low >= percent * high
        there = np.flatnonzero(ok)
        if not len(there):
            continue
        both = np.minimum(sketch[probes:][there], sketch[i]).sum(axis=1, dtype=np.int64)
        both += np.minimum(row["excess"][there], own["excess"])
        there = there[(100 + percent) * both >= percent * (row["n"][there] + own["n"])]
        other = row["node"][there]
        a.append(np.minimum(other, own["node"]))
        b.append(np.maximum(other, own["node"]))
    if a:
        yield table(schema, np.concatenate(a), np.concatenate(b))


def _sketched(bodies: DataFrame, k: int) -> DataFrame:
    """(node, sketch, excess): shingles of a set by hash bucket, as bytes, and how many go beyond
    what bytes hold."""
    schema = pa.schema([("node", pa.int64()), ("sketch", pa.binary()), ("excess", pa.int64())])

    def run(batches):
        for batch in batches:
            sketch, excess = [], []
            for raw in unpacked(batch["body"]):
                own = next(_distinct(one_text(raw), k))
                count = np.bincount((own >> U64(20)).astype(np.int64) % BUCKETS, minlength=BUCKETS)
                sketch.append(np.minimum(count, 255).astype(np.uint8).tobytes())
                excess.append(int(np.maximum(count - 255, 0).sum()))
            yield table(schema, batch["node"], sketch, excess)

    return bodies.mapInArrow(run, "node long, sketch binary, excess long")


ORACLE = r"""
WITH RECURSIVE t AS (
  SELECT doc_id, list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), w AS (
  SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM t
), four AS (
  SELECT doc_id, concat_ws(' ', word, lead(word, 1) OVER o, lead(word, 2) OVER o,
    lead(word, 3) OVER o) AS s, lead(word, 3) OVER o AS l
  FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY i)
), sh AS (
  SELECT DISTINCT doc_id, s FROM four WHERE l IS NOT NULL
  UNION ALL SELECT doc_id, array_to_string(ws, ' ') FROM t WHERE len(ws) BETWEEN 1 AND 3
), size AS (
  SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id
), pair AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k
  FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2
), link AS (
  SELECT x, y FROM pair JOIN size a ON a.doc_id = x JOIN size b ON b.doc_id = y
  WHERE 100 * k >= 85 * (a.n + b.n - k)
), both_ways AS (
  SELECT x, y FROM link UNION ALL SELECT y, x FROM link
), reach AS (
  SELECT x, y FROM both_ways
  UNION SELECT r.x, b.y FROM reach r JOIN both_ways b ON b.x = r.y
)
SELECT t.doc_id, coalesce(n, 0) AS n_shingles, least(t.doc_id, coalesce(m, t.doc_id)) AS component_id
FROM t LEFT JOIN size USING (doc_id)
LEFT JOIN (SELECT x AS doc_id, min(y) AS m FROM reach GROUP BY 1) USING (doc_id)
"""
