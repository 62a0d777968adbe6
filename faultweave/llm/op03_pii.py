"""Personal data by weak supervision, in DataFrame and SQL functions only.

Base kinds (email, ip, card, phone) follow fixed patterns and always stand. Further identifiers
are candidates of any length, whole words of letters, digits, `_`, `-`, `+`, `/`, inner dots and
a closing `=`: those that mix letters and digits, have nine characters with a digit or twenty
without, begin as known keys do, or are a value after a cue word and `:` or `=`; and account
numbers printed in groups of four. Four labelers vote on each candidate for, against or not at
all: a shape pattern, a gazetteer of known beginnings and known harmless terms, the words before
it, and the mix of its characters. Expectation-maximisation over the counts of vote patterns
estimates how reliable each labeler is, and a span classifier (naive Bayes on features of the
span) is trained on the posteriors and decides.

Patterns are written so that each place of a text is tried once: runs are possessive and begin
where no run is under way. Java's matcher gives the matches and, by the same scan, the pieces
between them; running sums of both lengths are the offsets. All of this happens inside the row of
a document. Only counts of patterns are gathered: votes and features have few values each, so
there are at most PATTERNS rows whatever the input.
"""

from __future__ import annotations

import math
from collections import defaultdict
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The base patterns of the contract, in linear form.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A text without this cannot hold the kind.
NEEDS = {"email": "@", "ip": ".", "card": None, "phone": "+"}

#: Characters before a candidate that count as its context.
CONTEXT = 24
#: Kinds of candidates by shape; all others are secrets.
SHAPES = {
    "ssn": r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$",
    "iban": r"^[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}$",
}
KINDS = (*BASE, *SHAPES, "secret")

# Word lists of the labelers.
BEGINNINGS = "akia|asia|ghp_|gho_|github_pat_|glpat-|sk-|sk_|pk_|rk_|xox|ya29|eyj|aiza|npm_|pypi-"
HARMLESS = "//|www\\.|iso-|utf-|sha-|md5|covid-|rfc|http|windows-|ieee|us-ascii|mp3|mp4|h264"
CUES = "token|secret|password|passwd|pwd|api[ _-]?key|access[ _-]?key|private[ _-]?key|auth|bearer"
CUES += "|credential|ssn|social security|iban|account|passport"
HARMLESS_CUES = "version|isbn|issn|doi|page|chapter|section|figure|table|build|revision|commit|model"

# A word is a run with dots inside; each is tried at its beginning only, and looked through once.
_RUN = "[A-Za-z0-9_+/-]"
_DOT = rf"\.(?={_RUN})"
_START = rf"(?<!{_RUN})(?<!{_RUN}\.)(?={_RUN})"


def _past(others: str, wanted: str) -> str:
    """Looks ahead for wanted in the word, past others."""
    return rf"(?={others}*+(?:{_DOT}{others}*+)*+{wanted})"


_DIGIT = _past("[A-Za-z_+/-]", "[0-9]")
_LETTER = _past("[0-9_+/-]", "[A-Za-z]")
_VALUE = rf"(?<=[:=][ \"']{{0,2}})(?<=(?i:{CUES})[\"']?[ ]?[:=][ ]?[\"']?)"
_WANTED = "|".join(
    [
        _DIGIT + _LETTER,
        _DIGIT + rf"(?=(?:{_RUN}|{_DOT}){{9}})",
        rf"(?={_RUN}{{20}})",
        rf"(?=(?i:{BEGINNINGS}))",
        _VALUE,
    ]
)
_PRINTED = r"[A-Z]{2}[0-9]{2}(?: [A-Z0-9]{4}){3,7}+(?: [A-Z0-9]{1,3})?+(?![A-Za-z0-9])"
_WORD = rf"{_RUN}++(?:{_DOT}{_RUN}++)*+(?:={{1,2}}+(?![A-Za-z0-9_+/=-]))?+"
CANDIDATE = rf"{_START}(?:{_PRINTED}|(?:{_WANTED}){_WORD})"

VOTES = ("by_shape", "by_gazetteer", "by_context", "by_mix")
FEATURES = ("length", "digits", "charset", "cue", "before")
#: 3 votes by 4 labelers, times the values of the features.
PATTERNS = 3**4 * 5 * 5 * 5 * 3 * 4
ROUNDS = 25


def pii_spans(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans and
    n_added.

    spans is `kind:start:end`, in code points with exclusive end, ordered by start and then kind
    (email, ip, card, phone, ssn, iban, secret), joined by commas; base_sha256 is the hash of the
    same text of the base kinds alone. Base spans of different kinds may overlap; an added span
    overlaps a base span only where it holds all of it, as a key holds digits.

    A null or empty text has no spans. Null doc_ids and repeated rows come out as they are;
    repeats count in training as often as they occur. No rows give no rows. Columns other than
    doc_id and text are not read.
    """
    text = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    found = _spans(text, "doc_id")
    return found.select(
        "doc_id",
        *(F.size(k).cast("long").alias(f"n_{k}") for k in BASE),
        F.sha2(_joined("base"), 256).alias("base_sha256"),
        _joined("spans").alias("spans"),
        (F.size("spans") - F.size("base")).cast("long").alias("n_added"),
    )


def redacted(docs: DataFrame) -> DataFrame:
    """docs with each span of personal data in `text` replaced by its kind in brackets.

    Of overlapping spans the first (of equals, the first kind) names the whole run. Other columns
    stay, but n_chars follows the text where there is one. A null text stays null.
    """
    # Working columns must not meet columns of the same name.
    held = docs.select(F.struct(*docs.columns).alias("row"), F.coalesce("text", F.lit("")).alias("text"))
    merged = """aggregate(spans, cast(array() AS array<struct<s:int,e:int,kind:string>>), (a, x) ->
        IF(size(a) > 0 AND x.s < element_at(a, -1).e,
           concat(slice(a, 1, size(a) - 1), array(struct(element_at(a, -1).s AS s,
                  greatest(element_at(a, -1).e, x.e) AS e, element_at(a, -1).kind AS kind))),
           concat(a, array(struct(x.s AS s, x.e AS e, x.kind AS kind)))))"""
    pieces = """transform(runs, (x, i) -> concat(
        substring(text, IF(i = 0, 0, runs[i - 1].e) + 1, x.s - IF(i = 0, 0, runs[i - 1].e)),
        '[', upper(x.kind), ']'))"""
    rest = "substring(text, element_at(runs, -1).e + 1)"
    clean = (
        _spans(held, "row", "text")
        .withColumn("runs", F.when(F.size("spans") > 0, F.expr(merged)))
        .withColumn("clean", F.expr(f"IF(runs IS NULL, text, concat(array_join({pieces}, ''), {rest}))"))
    )
    changed = F.when(F.col("row.text").isNotNull(), F.col("clean"))
    new = {"text": changed}
    if "n_chars" in docs.columns:
        length = F.length(changed).cast(docs.schema["n_chars"].dataType)
        new["n_chars"] = F.when(F.col("runs").isNull(), F.col("row.n_chars")).otherwise(length)
    return clean.select(
        *(new.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns)
    )


def _spans(text: DataFrame, *keep: str) -> DataFrame:
    """keep, the spans of each base kind, `base` (all of those) and `spans` (with added ones)."""
    placed = _candidates(text, *keep)
    score = _score(_train(placed))
    added = F.filter("candidates", lambda x: score(x) > 0)
    added = F.transform(added, lambda x: F.struct(x.s.alias("s"), x.e.alias("e"), x.kind.alias("kind")))
    return placed.select(
        *keep,
        *BASE,
        F.col("base"),
        _ordered(F.concat("base", added)).alias("spans"),
    )


def _joined(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x.kind, x.s, x.e)), ",")


def _ordered(spans: Column) -> Column:
    """Spans by start, then kind as listed."""
    place = F.create_map(*(F.lit(x) for i, k in enumerate(KINDS) for x in (k, i)))
    keyed = F.transform(
        spans,
        lambda x: F.struct(x.s.alias("s"), place[x.kind].alias("k"), x.e.alias("e"), x.kind.alias("kind")),
    )
    return F.transform(
        F.array_sort(keyed), lambda x: F.struct(x.s.alias("s"), x.e.alias("e"), x.kind.alias("kind"))
    )


def _offsets(matches: str, gaps: str) -> str:
    """SQL of structs (s, e, v, before) of the matches: running sums of the lengths of gaps and
    matches, in blocks and blocks of blocks, so that a text of many matches costs little more
    than their number."""

    def total(values: str, first: str, count: str) -> str:
        return f"aggregate(slice({values}, {first} + 1, {count}), 0, (a, x) -> a + x)"

    def blocks(values: str) -> str:
        every = f"sequence(0, size({values}) div 64)"
        return f"transform({every}, b -> {total(values, 'b * 64', '64')})"

    place = " + ".join(
        [
            total("wide", "0", "i div 4096"),
            total("sums", "i div 4096 * 64", "i div 64 % 64"),
            total("d", "i div 64 * 64", "i % 64"),
            f"length({gaps}[i])",
        ]
    )
    found = f"""struct(s AS s, s + length(m) AS e, m AS v, right({gaps}[i], {CONTEXT}) AS before)"""
    each = f"transform({matches}, (m, i) -> transform(array({place}), s -> {found})[0])"
    with_wide = f"transform(array({blocks('sums')}), wide -> {each})[0]"
    with_sums = f"transform(array({blocks('d')}), sums -> {with_wide})[0]"
    lengths = f"transform({matches}, (m, i) -> length(m) + length({gaps}[i]))"
    return f"transform(array({lengths}), d -> {with_sums})[0]"


_NONE = "cast(array() AS array<struct<s:int,e:int,v:string,before:string>>)"


def _candidates(text: DataFrame, *keep: str) -> DataFrame:
    patterns = BASE | {"other": CANDIDATE}
    matches, spans = [], []
    for kind, pattern in patterns.items():
        need = NEEDS.get(kind)
        can = F.col("text").contains(need) if need else F.lit(True)
        if kind in ("ip", "card", "phone"):
            can = can & F.col("has_digit")
        all_of = F.regexp_extract_all("text", F.lit(pattern), F.lit(0))
        matches.append(F.when(can, all_of).otherwise(F.array().cast("array<string>")).alias(f"m_{kind}"))
        gaps = F.when(F.size(f"m_{kind}") > 0, F.split("text", pattern, -1))
        spans.append((f"m_{kind}", gaps.alias(f"g_{kind}")))
    found = (
        text.withColumn("has_digit", F.col("text").rlike("[0-9]"))
        .select(*dict.fromkeys([*keep, "text"]), *matches)
        .select(*keep, *(m for m, _ in spans), *(g for _, g in spans))
        .selectExpr(
            *keep,
            *(
                f"IF(size(m_{k}) = 0, {_NONE}, {_offsets(f'm_{k}', f'g_{k}')}) AS {k}"
                for k in patterns
            ),
        )
    )
    base = found.select(
        *keep,
        *(F.filter(k, _valid(k)).alias(k) for k in BASE),
        F.col("other"),
    )
    base = base.withColumn("base", _ordered(F.concat(*(_named(k) for k in BASE))))
    # Spans that overlap a candidate and aren't within it go over its start or its end.
    cut = " OR ".join(_crosses(k, f"x.{end}") for k in BASE for end in ("s", "e"))
    free = F.expr(f"filter(other, x -> NOT ({cut}))")
    return base.withColumn("other", free).select(
        *keep, *BASE, "base", F.transform("other", _voted).alias("candidates")
    )


def _crosses(spans: str, place: str) -> str:
    """SQL: one of the spans, which are in order and apart, holds place and begins before it.
    Found by halving."""
    before = f"""aggregate(sequence(cast(log2(size({spans})) AS int), 0, -1), 0, (a, k) ->
        IF(a + shiftleft(1, k) <= size({spans}) AND {spans}[a + shiftleft(1, k) - 1].s < {place},
           a + shiftleft(1, k), a))"""
    last = f"transform(array({before}), n -> n > 0 AND {spans}[greatest(n, 1) - 1].e > {place})[0]"
    return f"(size({spans}) > 0 AND {last})"


def _named(kind: str) -> Column:
    return F.transform(
        kind, lambda x: F.struct(x.s.alias("s"), x.e.alias("e"), F.lit(kind).alias("kind"))
    )


def _valid(kind: str):
    def ip(x):
        part = r"0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
        return x.v.rlike(rf"^{part}(?:\.{part}){{3}}$")

    def card(x):
        digits = F.regexp_replace(x.v, "[^0-9]", "")
        long = F.length(digits).between(12, 19)
        return F.when(long, _luhn(digits) % 10 == 0).otherwise(False)

    def phone(x):
        return F.length(F.regexp_replace(x.v, "[^0-9]", "")).between(9, 15)

    return {"ip": ip, "card": card, "phone": phone}.get(kind, lambda x: F.lit(True))


def _luhn(digits: Column) -> Column:
    turned = F.split(F.reverse(digits), "")

    def value(d, i):
        twice = d.cast("int") * 2
        even = F.when(twice > 9, twice - 9).otherwise(twice)
        return F.when(i % 2 == 1, even).otherwise(d.cast("int"))

    digit = F.filter(turned, lambda d: d != "")
    return F.aggregate(F.transform(digit, value), F.lit(0), lambda a, x: a + x)


def _voted(x: Column) -> Column:
    """A candidate with its kind, votes and features."""
    low, before = F.lower(x.v), F.lower(x.before)
    kind = reduce(
        lambda rest, k: F.when(x.v.rlike(SHAPES[k]), F.lit(k)).otherwise(rest),
        SHAPES,
        F.lit("secret"),
    )
    n = F.length(x.v)
    digits = n - F.length(F.regexp_replace(x.v, "[0-9]", ""))
    plain = low.rlike(
        "^(?:[0-9]{1,4}[-/.+]){1,3}[0-9]{1,4}$|^[a-z]++(?:[-_/.+][a-z]++)*+[-_]?[0-9]{0,3}$"
        "|^[0-9.]+$"
    )
    shape = x.v.rlike("|".join(SHAPES.values())) | low.rlike("^(?=[0-9]*[a-f])[0-9a-f]{32,}$")
    begins = low.rlike(f"^(?:.*[/.+])?(?:{BEGINNINGS})")
    cue = before.rlike(f"(?:{CUES})[^a-z0-9]*(?:[a-z]+[^a-z0-9]+)?$")
    no_cue = before.rlike(f"(?:{HARMLESS_CUES})[^a-z0-9]*$")
    mixed = (n >= 20) & digits.between(n * 0.1, n * 0.9)

    def vote(yes: Column, no: Column) -> Column:
        return F.when(yes, 1).when(no, -1).otherwise(0)

    return F.struct(
        x.s.alias("s"),
        x.e.alias("e"),
        kind.alias("kind"),
        vote(shape, plain & ~shape).alias("by_shape"),
        vote(begins, low.rlike(f"^(?:{HARMLESS})")).alias("by_gazetteer"),
        vote(cue, no_cue).alias("by_context"),
        vote(mixed, (n < 14) & ~shape).alias("by_mix"),
        F.least(F.lit(4), (n / 10).cast("int")).alias("length"),
        (digits * 4 / n).cast("int").alias("digits"),
        F.when(low.rlike("^[0-9a-f]+$"), 0)
        .when(x.v.rlike("^[0-9-]+$"), 1)
        .when(x.v.rlike("^[A-Z0-9 ]+$"), 2)
        .when(x.v.rlike("[_.+/-]"), 3)
        .otherwise(4)
        .alias("charset"),
        F.when(cue, 2).when(no_cue, 1).otherwise(0).alias("cue"),
        F.when(x.before.rlike("[\"']$"), 3)
        .when(x.before.rlike("[:=] ?$"), 2)
        .when(x.before.rlike(r"\s$|^$"), 1)
        .otherwise(0)
        .alias("before"),
    )


def _train(placed: DataFrame) -> dict[tuple[str, int], float]:
    """Log odds of each value of each feature, and of a span as such under ("", 0)."""
    rows = _patterns(placed).collect()  # PATTERNS + 1 rows at most
    rows = sorted((tuple(r[:-1]), r["n"]) for r in rows if r["by_shape"] is not None)
    votes = defaultdict(int)
    for key, n in rows:
        votes[key[: len(VOTES)]] += n
    posterior = expected(dict(votes))
    yes, no = defaultdict(lambda: 1.0), defaultdict(lambda: 1.0)
    for key, n in rows:
        p = posterior[key[: len(VOTES)]]
        for place in (("", 0), *zip(FEATURES, key[len(VOTES) :], strict=True)):
            yes[place] += n * p
            no[place] += n * (1 - p)
    odds = {place: math.log(yes[place] / no[place]) for place in sorted(yes)}
    # A feature adds what its value says beyond the share of spans as such.
    return {p: v if p == ("", 0) else v - odds["", 0] for p, v in odds.items()}


def _patterns(placed: DataFrame) -> DataFrame:
    """How many candidates have each pattern of votes and features; rows without any have nulls.

    A plain explode also filters on the size of the array. That filter, pushed down to the table,
    finds all candidates again, several times; the outer one has no filter.
    """
    columns = (*VOTES, *FEATURES)
    one = placed.select(F.explode_outer("candidates").alias("x")).select(*(f"x.{c}" for c in columns))
    return one.groupBy(*columns).agg(F.count("*").alias("n"))


def expected(votes: dict[tuple, int]) -> dict[tuple, float]:
    """The posterior of a true span for each vote pattern, by expectation-maximisation.

    votes: candidates by pattern. Each labeler has, for true and for false spans, its shares of
    the votes -1, 0 and 1; they start and are smoothed as those of a labeler that is right more
    often than wrong, which keeps the two classes from changing places.
    """
    prior = {True: {-1: 1.0, 0: 2.0, 1: 3.0}, False: {-1: 3.0, 0: 2.0, 1: 1.0}}
    labelers = range(len(VOTES))
    share = {(j, y): dict(prior[y]) for j in labelers for y in prior}
    share = {k: {v: c / 6 for v, c in s.items()} for k, s in share.items()}
    true = 0.5
    posterior = {}
    for _ in range(ROUNDS):
        for key in votes:
            p, q = true, 1 - true
            for j, v in enumerate(key):
                p *= share[j, True][v]
                q *= share[j, False][v]
            posterior[key] = p / (p + q)
        total = sum(votes.values())
        true = (1 + sum(n * posterior[k] for k, n in votes.items())) / (2 + total)
        for j in labelers:
            for y in prior:
                count = dict(prior[y])
                for key, n in votes.items():
                    count[key[j]] += n * (posterior[key] if y else 1 - posterior[key])
                whole = sum(count.values())
                share[j, y] = {v: c / whole for v, c in count.items()}
    return posterior


def _score(odds: dict[tuple[str, int], float]):
    """The log odds of a candidate as an expression."""

    def score(x: Column) -> Column:
        total = F.lit(odds.get(("", 0), 0.0))
        for feature in FEATURES:
            values = [(v, o) for (name, v), o in odds.items() if name == feature]
            if values:
                table = F.create_map(*(F.lit(y) for pair in values for y in pair))
                total = total + F.coalesce(F.try_element_at(table, x[feature]), F.lit(0.0))
        return total

    return score
