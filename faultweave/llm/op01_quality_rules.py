"""Quality rules on the level of hosts, in DataFrame and SQL functions only.

Each document is measured inside its own row. Failures of each rule are summed by host, and the
failure rate of a host is shrunk towards the others by a beta prior fitted to all hosts, so that
a host of few documents is not judged by them alone. A host is blocked where its shrunk rate of
any rule passes the limit; verdicts are joined back to the documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultweave.llm.shared import saved

WINDOW = 5
#: Characters that count as symbols.
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\f\r"

#: Rules by name; true means the document fails. The first two are the base.
RULES = {
    "short": "n_words < 10",
    "repeats": "100 * n_repeat_words > 20 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "lines": "2 * n_dup_lines > n_lines",
    "word_length": "2 * word_chars < 5 * n_words or word_chars > 12 * n_words",
}
BASE = ("short", "repeats")
#: Bounds of the strength of the prior, in documents.
WEAKEST, STRONGEST = 2.0, 10000.0


def quality_rules(docs: DataFrame, host: str = "source", limit: float = 0.5) -> DataFrame:
    """One row per row of docs: doc_id, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, kept, host_rate, host_blocked and failed (names of the rules).

    kept is false if any rule fails or the host is blocked. host_rate is the greatest shrunk
    failure rate of the document's host, rounded to six digits.

    A null text has no words, so it fails for being short. A null host has no verdict: its
    documents are judged by themselves and its rate is null. Null doc_ids and repeated rows come
    out as they are and count as documents of their host. No rows give no rows.
    """
    measured = saved(_measured(docs, host))
    rates = _host_rates(measured)
    rate = F.greatest(*(F.col(f"rate_{name}") for name in RULES))
    verdicts = rates.select("host", rate.alias("rate"))
    names = F.array_compact(F.array(*(F.when(F.col(r), F.lit(r)) for r in RULES)))
    return (
        measured.join(verdicts, "host", "left")
        .withColumn("host_blocked", F.coalesce(F.col("rate") > limit, F.lit(False)))
        .select(
            "doc_id",
            "n_words",
            "word_chars",
            "n_symbols",
            "n_dup_lines",
            "n_repeat_words",
            F.expr(" or ".join(BASE)).alias("base_failed"),
            F.expr(f"not ({' or '.join(RULES)} or host_blocked)").alias("kept"),
            F.round("rate", 6).alias("host_rate"),
            "host_blocked",
            F.array_join(names, ",").alias("failed"),
        )
    )


def quality_filter(docs: DataFrame, host: str = "source", limit: float = 0.5) -> DataFrame:
    """The rows of docs that quality_rules keeps, with all their columns.

    Documents are measured twice, once for their hosts and once for themselves, which moves no
    text; only the hosts that are blocked are joined.
    """
    rates = _host_rates(_measured(docs, host))
    rate = F.greatest(*(F.col(f"rate_{name}") for name in RULES))
    blocked = saved(rates.where(rate > limit).select("host"))
    # The row is one column, so that no column of it meets a working column.
    held = docs.select(F.struct(*docs.columns).alias("doc_id"), "text", F.col(host).alias("source"))
    # A generator stands below the filter, which would else be pushed down with all measures
    # written out in it, each as often as it is used.
    measured = _measured(held, "source", None).select(
        "doc_id", "host", F.explode(F.array(F.expr(f"not ({' or '.join(RULES)})"))).alias("kept")
    )
    return measured.where("kept").join(blocked, "host", "left_anti").select(
        *(F.col("doc_id").getField(c).alias(c) for c in docs.columns)
    )


def _measured(docs: DataFrame, host: str, id_type: str | None = "long") -> DataFrame:
    """Counts and rule failures of each document; doc_id is carried as it is without id_type.

    Every select is one step, so that an array used more than once is made once a row.
    """
    text = docs.select(
        (F.col("doc_id").cast(id_type) if id_type else F.col("doc_id")).alias("doc_id"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        F.col(host).cast("string").alias("host"),
    )
    solid = F.translate("text", SPACES, "")
    lines = F.filter(F.split("text", "\n"), lambda x: F.translate(x, SPACES, "") != "")
    counted = text.select(
        "doc_id",
        "host",
        F.length(solid).cast("long").alias("word_chars"),
        (F.length(solid) - F.length(F.translate(solid, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        lines.alias("lines"),
        F.split(F.btrim("text", F.lit(SPACES)), r"[\x20\x09-\x0D]+").alias("words"),
    )
    last = f"(size(words) - {WINDOW})"
    window = ", ".join(f"words[i + {j}]" for j in range(WINDOW))
    hashed = counted.selectExpr(
        "doc_id",
        "host",
        "word_chars",
        "n_symbols",
        "bigint(size(lines)) AS n_lines",
        "bigint(size(lines) - size(array_distinct(lines))) AS n_dup_lines",
        "IF(word_chars = 0, 0L, bigint(size(words))) AS n_words",
        f"IF({last} < 0, array(), transform(sequence(0, {last}), i -> xxhash64({window}))) AS at",
    )
    # Windows found more than once, by hash and place; most documents have none.
    ordered = hashed.withColumn(
        "ordered",
        F.expr(
            "IF(size(array_distinct(at)) = size(at), NULL,"
            " array_sort(transform(at, (h, i) -> struct(h AS h, i AS i))))"
        ),
    ).drop("at")
    again = (
        "(k > 0 AND ordered[k - 1].h = x.h) OR (k + 1 < size(ordered) AND ordered[k + 1].h = x.h)"
    )
    placed = ordered.withColumn(
        "places", F.expr(f"array_sort(transform(filter(ordered, (x, k) -> {again}), x -> x.i))")
    )
    covered = (
        f"aggregate(places, struct(-{WINDOW} AS at, 0 AS n),"
        f" (a, x) -> struct(x AS at, a.n + least({WINDOW}, x - a.at) AS n), a -> a.n)"
    )
    out = placed.withColumn("n_repeat_words", F.expr(f"bigint(coalesce({covered}, 0))"))
    return out.drop("ordered", "places").withColumns({r: F.expr(e) for r, e in RULES.items()})


def _host_rates(measured: DataFrame) -> DataFrame:
    """(host, rate_<rule>): failure rates, shrunk."""
    hosts = saved(
        measured.where("host is not null")
        .groupBy("host")
        .agg(F.count("*").alias("n"), *(F.count_if(F.col(r)).alias(r) for r in RULES))
    )
    sums = hosts.agg(
        F.count("*").alias("hosts"),
        F.sum("n").alias("n"),
        *(F.sum(r).alias(r) for r in RULES),
        *(F.sum(F.col(r) * F.col(r) / F.col("n")).alias(f"{r}_square") for r in RULES),
    ).first()
    rates = []
    for r in RULES:
        mean, strength = _prior(sums["hosts"], sums["n"] or 0, sums[r], sums[f"{r}_square"])
        rates.append(
            ((F.col(r) + mean * strength) / (F.col("n") + strength)).alias(f"rate_{r}")
        )
    return hosts.select("host", *rates)


def _prior(hosts: int, n: int, failed: int | None, square: float | None) -> tuple[float, float]:
    """Mean and strength of the beta prior, by moments of the host rates weighted by size."""
    if not n:
        return 0.0, WEAKEST
    mean = failed / n
    inside = mean * (1 - mean)
    between = square / n - mean * mean - inside * (hosts - 1) / n
    if between <= 0:
        return mean, STRONGEST
    return mean, min(STRONGEST, max(WEAKEST, inside / between - 1))


ORACLE = r"""
WITH t AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, source FROM documents
), base AS (
  SELECT r, doc_id, source,
    list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls,
    CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols
  FROM t
), w AS (
  SELECT r, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM base
), win AS (
  SELECT r, i, concat_ws(' ', word, lead(word, 1) OVER o, lead(word, 2) OVER o,
    lead(word, 3) OVER o, lead(word, 4) OVER o) AS s, lead(word, 4) OVER o AS l
  FROM w WINDOW o AS (PARTITION BY r ORDER BY i)
), twice AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, s) AS c FROM win
    WHERE l IS NOT NULL) WHERE c > 1
), rep AS (
  SELECT r, count(DISTINCT i + j) AS n
  FROM twice, (SELECT unnest([0, 1, 2, 3, 4]) AS j) GROUP BY r
), m AS (
  SELECT base.r, doc_id, source, CAST(len(ws) AS BIGINT) AS n_words, word_chars, n_symbols,
    CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, len(ls) AS n_lines,
    CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words
  FROM base LEFT JOIN rep ON base.r = rep.r
), f AS (
  SELECT *, n_words < 10 AS short, 100 * n_repeat_words > 20 * n_words AS repeats,
    10 * n_symbols > n_words AS symbols, 2 * n_dup_lines > n_lines AS lines,
    2 * word_chars < 5 * n_words OR word_chars > 12 * n_words AS word_length
  FROM m
), long AS (
  SELECT source, unnest(['short', 'repeats', 'symbols', 'lines', 'word_length']) AS rule,
    unnest([short, repeats, symbols, lines, word_length]) AS bad FROM f WHERE source IS NOT NULL
), host AS (
  SELECT source, rule, count(*) AS n, count(*) FILTER (WHERE bad) AS k FROM long GROUP BY 1, 2
), mom AS (
  SELECT rule, sum(k) / sum(n) AS mean, sum(k) / sum(n) * (1 - sum(k) / sum(n)) AS inside,
    sum(k * k / n) / sum(n) - (sum(k) / sum(n)) * (sum(k) / sum(n))
      - sum(k) / sum(n) * (1 - sum(k) / sum(n)) * (count(*) - 1) / sum(n) AS between_hosts
  FROM host GROUP BY rule
), prior AS (
  SELECT rule, mean, CASE WHEN between_hosts <= 0 THEN 10000.0
    ELSE least(10000.0, greatest(2.0, inside / between_hosts - 1)) END AS strength FROM mom
), rate AS (
  SELECT source, max((k + mean * strength) / (n + strength)) AS rate
  FROM host JOIN prior USING (rule) GROUP BY source
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  short OR repeats AS base_failed,
  NOT (short OR repeats OR symbols OR lines OR word_length OR coalesce(rate > 0.5, FALSE)) AS kept,
  round(rate, 6) AS host_rate, coalesce(rate > 0.5, FALSE) AS host_blocked,
  concat_ws(',', CASE WHEN short THEN 'short' END, CASE WHEN repeats THEN 'repeats' END,
    CASE WHEN symbols THEN 'symbols' END, CASE WHEN lines THEN 'lines' END,
    CASE WHEN word_length THEN 'word_length' END) AS failed
FROM f LEFT JOIN rate USING (source)
"""
