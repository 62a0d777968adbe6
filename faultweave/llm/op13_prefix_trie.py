"""Prefix trie of conversations by a splitter skeleton.

A conversation is the path of its turns in the trie; a turn is known by a digest of its role and
text. Equal paths are merged first, so a conversation held by many costs one path. The distinct
paths are cut into ranges by splitters: from a sample of paths, the shortest starts that tell
neighbouring quantiles apart. A node can have paths in two ranges only if it is a proper start of
a splitter. These nodes, with the root, are the skeleton; it is small, and every task has it.

Each range is sorted by path and finished by one scan: neighbouring paths share their start, and
a node is complete when the scan leaves it. Skeleton nodes leave partial sums of each range, which
are added up and carried to the root along the skeleton alone.
"""

from __future__ import annotations

from bisect import bisect_right
from hashlib import blake2b, sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from faultweave.llm.shared import saved, table

#: Bytes of a turn's digest.
DIGEST = 16
#: Turns of paths in a range, about; sampled paths for each range; turns of a sampled path read.
RANGE_TURNS = 1 << 20
SAMPLED = 10
SPLITTER_TURNS = 64
#: Finished nodes that are given on at once.
ROWS = 1 << 16
#: Ranges at most, so that the skeleton has a fixed bound.
RANGES = 4096

_WORD = r"[^\x20\x09-\x0D]+"
_NOBODY = sha256(b"").hexdigest()


def prefix_trie(conversations: DataFrame, heads: int = 4, family: int = 20) -> DataFrame:
    """One row per node of the trie of rebuilt conversations: conv_id (smallest member), depth,
    parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Turns are ordered by turn (null first), then by role, the first 64 characters and the digest of
    the text; a null role or text is empty.
    Conversation c is rebuilt as the first h = crc32(c) % heads turns of conversation
    c - c % family and its own turns behind its first h. A node at depth d is a distinct sequence
    of first d turns; conversations that start with it are its members, a subtree includes its
    top. saved_tokens adds up (n_convs - 1) * words of the last turn over the subtree, and
    ends_sha256 digests the ids of members of exactly d turns.

    Rows that repeat are turns of their own. Rows without conv_id belong to no conversation and
    are left out; no rows give no nodes, not even a root. Other columns are not read.
    """
    paths, ids = _paths(conversations, heads, family)
    ends = saved(_ends(ids))
    distinct = saved(_distinct_paths(paths, ends))
    splitters = _splitters(distinct)
    nodes = saved(_scanned(distinct, splitters))
    skeleton = _reduced(nodes.where("at is not null"))
    upper = skeleton.select(F.col("at").alias("parent_at"), F.col("conv_id").alias("upper"))
    below = nodes.where("at is null").join(F.broadcast(upper), "parent_at", "left")
    columns = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves")
    columns += ("saved_tokens", "ends_sha256")
    below = below.withColumn("parent_conv_id", F.coalesce("parent_conv_id", "upper"))
    return below.select(*columns).unionByName(skeleton.select(*columns))


# ---- rebuilt conversations as paths ----


def _paths(conversations: DataFrame, heads: int, family: int) -> tuple[DataFrame, DataFrame]:
    """(conv_id, path, words) of each rebuilt conversation with turns; (conv_id, path digest) of
    all."""
    turns = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    ).where("conv_id is not null")
    # The digest of a turn and the start of its text go on; texts stay where they are read.
    spoken = F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text")
    turns = turns.select(
        "conv_id", "turn", "role",
        F.unhex(F.substring(F.sha2(spoken, 256), 1, 2 * DIGEST)).alias("said"),
        F.substring("text", 1, 64).alias("start"),
        F.regexp_count("text", F.lit(_WORD)).cast("long").alias("words"),
    )
    order = (F.asc_nulls_first("turn"), "role", "start", "said")
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy(*order))
    turns = turns.withColumn("place", place)
    turns = saved(turns.select("conv_id", "place", "said", "words"))
    head_turns = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(heads))
    everyone = turns.select("conv_id").distinct().withColumn("h", head_turns)
    everyone = saved(everyone.withColumn("base", F.expr(f"conv_id - conv_id % {family}")))
    begins = turns.where((F.col("place") < heads) & F.expr(f"conv_id % {family} = 0"))
    start = begins.select(
        F.col("conv_id").alias("base"), "place", "said", "words"
    )
    shared = everyone.where("h > 0").join(start, "base").where("place <= h")
    own = turns.where(F.col("place") > head_turns)
    columns = ("conv_id", "place", "said", "words")
    # Own turns stand behind the head whose places, at most h, are smaller.
    both = shared.select(*columns).unionByName(own.select(*columns))
    paths = saved(_gathered(both))
    ids = everyone.select("conv_id").join(paths.select("conv_id", "key"), "conv_id", "left")
    return paths, ids.withColumn("key", F.coalesce("key", F.lit(b"")))


def _gathered(turns: DataFrame) -> DataFrame:
    """(conv_id, key, path, words): a conversation's digests and words of turns in a row, and the
    digest of the path. Turns come sorted, so a task holds one conversation's digests at a time."""
    schema = pa.schema(
        [("conv_id", pa.int64()), ("key", pa.binary()), ("path", pa.binary()), ("words", pa.binary())]
    )

    def run(batches):
        current, said, words = None, [], []

        def closed():
            path = b"".join(said)
            key = blake2b(path, digest_size=16).digest()
            return current, key, path, np.array(words, np.int64).tobytes()

        for batch in batches:
            out = []
            columns = (batch[c].to_pylist() for c in ("conv_id", "said", "words"))
            for conv_id, digest, n in zip(*columns, strict=True):
                if conv_id != current:
                    if said:
                        out.append(closed())
                    current, said, words = conv_id, [], []
                said.append(digest)
                words.append(n)
            if out:
                yield table(schema, *map(list, zip(*out, strict=True)))
        if said:
            yield table(schema, *([x] for x in closed()))

    return (
        turns.repartition("conv_id")
        .sortWithinPartitions("conv_id", "place")
        .mapInArrow(run, "conv_id long, key binary, path binary, words binary")
    )


def _ends(ids: DataFrame) -> DataFrame:
    """(key, conv_id, n, ends_sha256) of each distinct path: smallest id, number and digest of the
    conversations that are this path. Ids come sorted and run through the digest one by one."""
    schema = pa.schema(
        [("key", pa.binary()), ("conv_id", pa.int64()), ("n", pa.int64()), ("ends", pa.string())]
    )

    def run(batches):
        current, first, n, state = None, None, 0, None
        for batch in batches:
            out = []
            for key, conv_id in zip(batch["key"].to_pylist(), batch["conv_id"].to_pylist(), strict=True):
                if key != current:
                    if n:
                        out.append((current, first, n, state.hexdigest()))
                    current, first, n, state = key, conv_id, 0, sha256()
                state.update(b",%d" % conv_id if n else b"%d" % conv_id)
                n += 1
            if out:
                yield table(schema, *map(list, zip(*out, strict=True)))
        if n:
            yield table(schema, [current], [first], [n], [state.hexdigest()])

    return (
        ids.repartition("key")
        .sortWithinPartitions("key", "conv_id")
        .mapInArrow(run, "key binary, conv_id long, n long, ends string")
    )


def _distinct_paths(paths: DataFrame, ends: DataFrame) -> DataFrame:
    """(path, words, conv_id, n, ends) of each distinct path, the empty one included."""
    one = ends.join(paths.select("conv_id", "path", "words"), "conv_id", "left")
    return one.select(
        F.coalesce("path", F.lit(b"")).alias("path"),
        F.coalesce("words", F.lit(b"")).alias("words"),
        "conv_id", "n", "ends",
    )


# ---- the skeleton ----


def _splitters(distinct: DataFrame) -> list[bytes]:
    """Ascending starts of paths that cut the paths into ranges of about RANGE_TURNS turns.

    The driver reads SAMPLED starts of SPLITTER_TURNS turns at most for each of at most RANGES
    ranges.
    """
    size = F.octet_length("path") / DIGEST
    rows, turns = distinct.agg(F.count("*"), F.sum(size)).first()
    ranges = min(RANGES, int((turns or 0) // RANGE_TURNS) + 1)
    if ranges == 1:
        return []
    start = F.substring("path", 1, DIGEST * SPLITTER_TURNS).alias("start")
    # Which rows are read follows from their ids alone, so a lost task reads the same again.
    wanted = min(1.0, ranges * SAMPLED / rows)
    chance = F.pmod(F.xxhash64("conv_id"), F.lit(1 << 30)) < int(wanted * (1 << 30))
    found = distinct.where(chance).select(start, size.alias("turns")).collect()
    found = sorted((bytes(r["start"]), r["turns"]) for r in found)
    if not found:
        return []
    weight = np.cumsum([t for _, t in found])
    cuts = np.searchsorted(weight, np.arange(1, ranges) * weight[-1] / ranges)
    out = set()
    for i in cuts:
        if 0 < i < len(found) and found[i][0] != found[i - 1][0]:
            out.add(found[i][0][: DIGEST * (_common(found[i - 1][0], found[i][0]) + 1)])
    return sorted(out)


def _common(a: bytes, b: bytes) -> int:
    """Number of first turns that two paths share."""
    n = min(len(a), len(b)) // DIGEST
    low, high = 0, n
    while low < high:
        middle = (low + high + 1) // 2
        if a[: DIGEST * middle] == b[: DIGEST * middle]:
            low = middle
        else:
            high = middle - 1
    return low


def _scanned(distinct: DataFrame, splitters: list[bytes]) -> DataFrame:
    """The finished nodes, and with `at`, their path, the parts of skeleton nodes.

    A finished node's parent is named by its smallest member, or by its path where it is in the
    skeleton.
    """
    shared = {s[:n] for s in splitters for n in range(0, len(s), DIGEST)} | {b""}
    deepest = max(len(s) for s in shared) // DIGEST
    numbers = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves")
    numbers += ("saved_tokens", "words")
    schema = pa.schema(
        [(c, pa.int64()) for c in numbers]
        + [("ends_sha256", pa.string()), ("at", pa.binary()), ("parent_at", pa.binary())]
    )

    def ranges(batches):
        for batch in batches:
            of = [bisect_right(splitters, p) for p in batch["path"].to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(of, pa.int32())], [*batch.schema.names, "range"]
            )

    def run(batches):
        current, scan = None, None
        for batch in batches:
            columns = (batch[c].to_pylist() for c in ("range", "path", "words", "conv_id", "n", "ends"))
            for of, path, words, conv_id, n, ends in zip(*columns, strict=True):
                if of != current:
                    if scan is not None:
                        yield from scan.rest(schema)
                    current, scan = of, _Scan(shared, deepest)
                yield from scan.add(schema, path, words, conv_id, n, ends)
        if scan is not None:
            yield from scan.rest(schema)

    columns = "path binary, words binary, conv_id long, n long, ends string, range int"
    return (
        distinct.mapInArrow(ranges, columns)
        .repartitionById(len(splitters) + 1, "range")
        .sortWithinPartitions("range", "path")
        .mapInArrow(
            run,
            ", ".join(f"{c} long" for c in numbers)
            + ", ends_sha256 string, at binary, parent_at binary",
        )
    )


class _Scan:
    """The nodes of one range, whose distinct paths come in order.

    Of each node: smallest member, depth, node above, members, children, leaves, saved tokens of
    the finished nodes below and of itself, words, ends, and its path if it is in the skeleton.
    Whenever the scan is back at the skeleton, all nodes but the open ones are complete and leave,
    so a task holds about ROWS nodes and one subtree.
    """

    def __init__(self, shared: set[bytes], deepest: int):
        self.shared, self.deepest = shared, deepest
        self.columns = [[] for _ in range(10)]
        (self.conv, self.depth, self.above, self.members, self.children) = self.columns[:5]
        (self.leaves, self.saved, self.words, self.ends, self.key) = self.columns[5:]
        self.stack: list[int] = []
        self.last = b""

    def add(self, schema: pa.Schema, path: bytes, words: bytes, conv_id: int, n: int, ends: str):
        common = _common(self.last, path)
        if not self.stack:
            self._open(path, 0, conv_id)
        while len(self.stack) > common + 1:
            self._close()
        if len(self.conv) > ROWS and self.key[self.stack[-1]] is not None:
            yield self._leave(schema)
        for own in np.frombuffer(words, np.int64)[common:].tolist():
            self._open(path, own, conv_id)
        top = self.stack[-1]
        self.members[top] += n
        self.conv[top] = min(self.conv[top], conv_id)
        self.ends[top] = ends
        self.last = path

    def rest(self, schema: pa.Schema):
        while self.stack:
            self._close()
        yield self._leave(schema)

    def _open(self, path: bytes, words: int, conv_id: int) -> None:
        depth = len(self.stack)
        start = path[: DIGEST * depth] if depth <= self.deepest else None
        key = start if start in self.shared else None
        row = (conv_id, depth, self.stack[-1] if depth else -1, 0, 0, 0, 0, words, None, key)
        self.stack.append(len(self.conv))
        for column, value in zip(self.columns, row, strict=True):
            column.append(value)

    def _close(self) -> None:
        i = self.stack.pop()
        if self.key[i] is not None:
            return  # a part of a skeleton node counts where all its parts are added up
        if not self.children[i]:
            self.leaves[i] = 1
        self.saved[i] += (self.members[i] - 1) * self.words[i]
        up = self.above[i]
        self.members[up] += self.members[i]
        self.conv[up] = min(self.conv[up], self.conv[i])
        self.children[up] += 1
        self.leaves[up] += self.leaves[i]
        self.saved[up] += self.saved[i]

    def _leave(self, schema: pa.Schema) -> pa.RecordBatch:
        """The complete nodes; only those on the stack stay."""
        stay = set(self.stack)
        gone = [i for i in range(len(self.conv)) if i not in stay]
        own = {
            name: [column[i] for i in gone]
            for name, column in zip(
                ("conv_id", "depth", "above", "n_convs", "n_children", "n_leaves")
                + ("saved_tokens", "words", "ends_sha256", "at"),
                self.columns,
                strict=True,
            )
        }
        up = own["above"]
        key = [self.key[u] if u >= 0 else None for u in up]
        own["parent_at"] = key
        own["parent_conv_id"] = [
            self.conv[u] if u >= 0 and k is None else None for u, k in zip(up, key, strict=True)
        ]
        own["ends_sha256"] = [e or _NOBODY for e in own["ends_sha256"]]
        out = table(schema, *(own[f.name] for f in schema))
        for column in self.columns:
            column[:] = [column[i] for i in self.stack]
        self.stack = list(range(len(self.stack)))
        self.above[:] = range(-1, len(self.stack) - 1)
        return out


def _reduced(parts: DataFrame) -> DataFrame:
    """The skeleton nodes: parts added up by node, then carried along the skeleton to the root.

    After the first sum there is one row for each skeleton node, of which there are at most RANGES
    times SPLITTER_TURNS whatever the input, so the second step is one small group.
    """
    ends = F.max(F.when(F.col("ends_sha256") != _NOBODY, F.col("ends_sha256")))
    summed = parts.groupBy("at").agg(
        F.min("conv_id").alias("conv_id"),
        F.max("depth").alias("depth"),
        *(F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")),
        F.max("words").alias("words"),
        F.coalesce(ends, F.lit(_NOBODY)).alias("ends_sha256"),
    )
    numbers = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves")
    numbers += ("saved_tokens",)
    schema = pa.schema(
        [(c, pa.int64()) for c in numbers] + [("ends_sha256", pa.string()), ("at", pa.binary())]
    )

    def run(batches):
        rows = [r for batch in batches for r in batch.to_pylist()]
        node = {r["at"]: r for r in rows}
        for r in sorted(rows, key=lambda r: -r["depth"]):
            r["n_leaves"] = r["n_leaves"] if r["n_children"] else 1
            r["saved_tokens"] += (r["n_convs"] - 1) * r["words"]
            if r["depth"]:
                up = node[r["at"][:-DIGEST]]
                up["conv_id"] = min(up["conv_id"], r["conv_id"])
                up["n_children"] += 1
                for c in ("n_convs", "n_leaves", "saved_tokens"):
                    up[c] += r[c]
        for r in rows:
            up = node[r["at"][:-DIGEST]] if r["depth"] else None
            r["parent_conv_id"] = up["conv_id"] if up else None
        if rows:
            # The root has no turn, so nothing is saved in itself.
            yield table(schema, *([r[f.name] for r in rows] for f in schema))

    columns = ", ".join(f"{c} long" for c in numbers) + ", ends_sha256 string, at binary"
    return saved(summed.coalesce(1).mapInArrow(run, columns))


ORACLE = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL
), o AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS place
  FROM t
), tab AS (
  SELECT list(list_reduce(list_prepend(i, range(8)), lambda a, b:
    CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) ORDER BY i) AS tb
  FROM range(256) r(i)
), c AS (
  SELECT conv_id, xor(4294967295, list_reduce(list_prepend(4294967295,
    list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
    lambda a, b: xor(a >> 8, tb[1 + (xor(a, b) & 255)]))) % 4 AS h
  FROM (SELECT DISTINCT conv_id FROM t), tab
), rebuilt AS (
  SELECT c.conv_id, place, role, text
  FROM c JOIN o ON o.conv_id = c.conv_id - c.conv_id % 20 WHERE place <= h
  UNION ALL SELECT o.conv_id, place, role, text FROM o JOIN c USING (conv_id) WHERE place > h
), s AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY place) AS d,
    sha256(strlen(role) || ':' || role || text) AS said,
    len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words
  FROM rebuilt
), m AS (
  SELECT conv_id, 0 AS d, '' AS node, 0 AS words FROM c
  UNION ALL SELECT conv_id, d, sha256(string_agg(said, ',') OVER (PARTITION BY conv_id ORDER BY d)),
    words FROM s
), last AS (
  SELECT conv_id, max(d) AS d FROM m GROUP BY 1
), node AS (
  SELECT node, m.d, min(m.conv_id) AS conv_id, count(*) AS n, max(words) AS words,
    sha256(coalesce(string_agg(last.conv_id, ',' ORDER BY last.conv_id), '')) AS ends
  FROM m LEFT JOIN last ON last.conv_id = m.conv_id AND last.d = m.d GROUP BY 1, 2
), edge AS (
  SELECT b.node, p.node AS up FROM node b JOIN m p ON p.conv_id = b.conv_id AND p.d = b.d - 1
), child AS (
  SELECT up AS node, count(*) AS k FROM edge GROUP BY 1
), below AS (
  SELECT m.node, sum((k IS NULL)::INT) AS leaves, sum((n - 1) * b.words) AS saved
  FROM node b LEFT JOIN child USING (node) JOIN m ON m.conv_id = b.conv_id AND m.d <= b.d
  GROUP BY 1
)
SELECT a.conv_id, a.d AS depth, p.conv_id AS parent_conv_id, a.n AS n_convs,
  coalesce(k, 0) AS n_children, leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens,
  a.ends AS ends_sha256
FROM node a LEFT JOIN edge USING (node) LEFT JOIN node p ON p.node = edge.up
LEFT JOIN child ON child.node = a.node JOIN below ON below.node = a.node
"""
