"""Personal data: weak labelers vote, EM weighs them, a final classifier decides.

Base spans come from fixed patterns and checks and always stay.  For secrets (keys, passwords,
tokens) a wide pattern proposes candidate spans; regular expressions, a gazetteer of key prefixes
and labelers of the context vote for or against each (or abstain).  Expectation-maximisation over
the counts of vote patterns estimates each labeler's reliability without any labels; the posterior
of a candidate's votes then trains a logistic classifier on the span's own features, and the
classifier decides.

* Finding is map-only; its narrow result is written, so the texts are read once.
* What is gathered is one row for each pattern of votes and feature buckets, a number fixed by
  the labelers and buckets whatever the corpus, pre-aggregated map-side.
* No pattern repeats a group, so long runs cannot exhaust the regex engine's stack, and each is
  anchored at the start of a run, so they take linear time.  Places are chunked prefix sums.

Defined results: null text counts as empty and has no spans; a corpus without candidates adds no
spans; rows that repeat are treated alike; extra columns are not returned.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import let, materialise

KINDS = ("email", "ip", "card", "phone", "secret")  # the order of spans that start together
CHUNK = 256
CONTEXT = 32          # code points on the left that context labelers see
EM_ROUNDS = 50
FIT_ROUNDS = 400

#: Patterns are matched in a copy of the text of equal length, in which separators that cannot be
#: part of a match are replaced; that leaves patterns without repeated groups.
LOCAL = "[A-Za-z0-9._%+-]"
EMAIL = rf"(?:\G|(?<!{LOCAL})){LOCAL}++@[A-Za-z0-9-]++\.[A-Za-z0-9.-]++"
LOOSE_DOT = r"(?<![A-Za-z0-9-])\.|\.(?![A-Za-z0-9-])"   # not between label characters
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9][0-9 -]++"
LOOSE_GAP = r"(?<![0-9])[ -]|[ -](?![0-9])"              # not a single separator between digits
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
BYTE = r"0*+(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])?"
CANDIDATE = r"(?<![A-Za-z0-9_+/-])[A-Za-z0-9_+/-]{12,}+"


def _prefix_sums(sizes: Column) -> Column:
    """Inclusive prefix sums of an array of numbers, in chunks (time n * CHUNK / 2)."""
    plus = lambda a, b: a + b
    zero = F.lit(0).cast("long")
    chunk = lambda c: F.slice(sizes, c * CHUNK + 1, F.lit(CHUNK))
    numbers = F.sequence(F.lit(0), F.floor((F.size(sizes) - 1) / CHUNK).cast("int"))
    totals = F.transform(numbers, lambda c: F.aggregate(chunk(c), zero, plus))

    def inside(totals: Column) -> Column:
        return F.flatten(F.transform(numbers, lambda c: let(chunk(c), lambda part: let(
            F.aggregate(F.slice(totals, F.lit(1), c), zero, plus),
            lambda base: F.transform(F.sequence(F.lit(1), F.size(part)),
                                     lambda j: base + F.aggregate(F.slice(part, F.lit(1), j), zero, plus))))))

    return let(totals, inside)


def matches(text: Column, pattern: str, applies: Column) -> Column:
    """Matches of ``pattern`` as array<struct<start, end, match, left, right>>, leftmost, not
    overlapping; left and right are the texts up to the neighbouring matches.  Nothing is run
    where ``applies`` is false."""
    empty = F.array().cast("array<struct<start:bigint,end:bigint,match:string,left:string,right:string>>")

    def places(found: Column, pieces: Column) -> Column:
        sizes = F.transform(found, lambda m, i: F.length(m).cast("long") + F.length(F.get(pieces, i)))
        return let(_prefix_sums(sizes), lambda ends: F.transform(found, lambda m, i: F.struct(
            (F.get(ends, i) - F.length(m)).alias("start"), F.get(ends, i).alias("end"), m.alias("match"),
            F.get(pieces, i).alias("left"), F.get(pieces, i + 1).alias("right"))))

    found = let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda f: F.when(
        F.size(f) > 0, let(F.split(text, pattern), lambda pieces: places(f, pieces))))
    return F.coalesce(F.when(applies, found), empty)


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether a digit string passes the Luhn check (called for 12 to 19 digits)."""
    doubled = lambda d: F.when(d > 4, 2 * d - 9).otherwise(2 * d)
    values = F.transform(F.reverse(F.split(digits, "")), lambda d: d.cast("int"))
    total = F.aggregate(F.transform(values, lambda d, i: F.when(i % 2 == 1, doubled(d)).otherwise(d)), F.lit(0), lambda a, b: a + b)
    return total % 10 == 0


def base_spans(text: Column) -> dict[str, Column]:
    """The base kinds' spans (see :func:`matches`)."""
    any_digit = F.regexp_like(text, F.lit("[0-9]"))
    email = matches(F.regexp_replace(text, LOOSE_DOT, "%"), EMAIL, F.contains(text, F.lit("@")))
    ip = F.filter(matches(text, IP, any_digit & F.contains(text, F.lit("."))),
                  lambda m: F.regexp_like(m["match"], F.lit(rf"\A{BYTE}\.{BYTE}\.{BYTE}\.{BYTE}\z")))
    card = F.filter(matches(F.regexp_replace(text, LOOSE_GAP, "_"), CARD, any_digit), lambda m: let(
        _digits(m["match"]), lambda d: F.when(F.length(d).between(12, 19), _luhn(d)).otherwise(F.lit(False))))
    phone = F.filter(matches(text, PHONE, F.contains(text, F.lit("+"))),
                     lambda m: F.length(_digits(m["match"])).between(9, 15))
    return {"email": email, "ip": ip, "card": card, "phone": phone}


# -- weak labelers of candidate secrets: 1 for, -1 against, 0 abstains ---------------------------

KEY_PREFIXES = ("AKIA", "ASIA", "ghp_", "gho_", "glpat-", "xoxb-", "sk_live_", "AIza")
CONTEXT_WORDS = ("password", "passwd", "pwd", "token", "secret", "api_key", "apikey", "credential", "private key")


def _vote(test: Column, value: int) -> Column:
    return F.when(test, F.lit(value)).otherwise(F.lit(0))


def votes(value: Column, left: Column, right: Column) -> list[Column]:
    like = lambda c, p: F.regexp_like(c, F.lit(p))
    return [
        _vote(like(value, r"\A[0-9a-f]{16,}\z"), 1),                                            # regex
        _vote(like(value, r"\A(?:[A-Za-z]+[-_/+]?[0-9]{1,4}|[0-9/+-]+[A-Za-z]{1,3})\z"), -1),   # regex: word and number
        _vote(like(value, rf"\A(?:{'|'.join(KEY_PREFIXES)})"), 1),                              # gazetteer
        _vote(like(left, rf"(?i)(?:{'|'.join(CONTEXT_WORDS)})[\"']?\s?[:=]\s?[\"']?\z"), 1),   # context
        _vote(like(left, r"(?i)(?:://\S*|version|isbn|commit|page|figure|\.|@)\s?\z") | like(right, r"\A[@.][A-Za-z]"), -1),
        F.when(F.length(F.regexp_replace(value, "[^0-9]", "")) * 5 >= F.length(value), F.lit(1)).otherwise(F.lit(-1)),  # density
    ]


def span_features(value: Column, left: Column) -> list[Column]:
    """Bucketed features of a span, each a small whole number."""
    digits, upper = F.length(F.regexp_replace(value, "[^0-9]", "")), F.length(F.regexp_replace(value, "[^A-Z]", ""))
    bucket = lambda v, cuts: sum([(v >= c).cast("int") for c in cuts], F.lit(0))
    switches = F.regexp_count(value, F.lit("[0-9](?=[A-Za-z])"))
    return [bucket(F.length(value), (16, 20, 32)), bucket(digits / F.length(value), (0.1, 0.25, 0.5)),
            bucket(upper / F.length(value), (0.05, 0.4)), bucket(switches, (1, 3, 6)),
            F.regexp_like(left, F.lit("[=:\"']\\s?\\z")).cast("int")]


FEATURE_SIZES = (4, 4, 3, 4, 2)


def _text_left(m: Column) -> Column:
    return F.substring(m["left"], -CONTEXT, CONTEXT)


def candidates(text: Column) -> Column:
    """Candidate secrets: array<struct<start, end, votes, features>>."""
    both = F.filter(matches(text, CANDIDATE, F.regexp_like(text, F.lit("[0-9]"))),
                    lambda m: F.regexp_like(m["match"], F.lit("[0-9]")) & F.regexp_like(m["match"], F.lit("[A-Za-z]")))
    return F.transform(both, lambda m: F.struct(
        m["start"].alias("start"), m["end"].alias("end"),
        F.array(*votes(m["match"], _text_left(m), F.substring(m["right"], 1, 2))).alias("votes"),
        F.array(*span_features(m["match"], _text_left(m))).alias("features")))


def find(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Written, one row a document: ``id_col``, an array of base spans a kind, and the candidates."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    narrow = lambda spans: F.transform(spans, lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end")))
    return materialise(docs.select(F.col(id_col), *[narrow(c).alias(k) for k, c in base_spans(text).items()],
                                   candidates(text).alias("candidates")), "pii-found")


# -- what the labelers are worth, and the classifier ---------------------------------------------

@dataclass
class Model:
    reliability: list[dict[int, tuple[float, float]]]  # per labeler: vote -> (P given clean, P given private)
    prior: float
    weights: list[list[float]]                         # per feature: one weight a bucket
    bias: float

    def column(self, features: Column) -> Column:
        """The probability that a candidate with these features is private."""
        score = F.lit(self.bias)
        for i, w in enumerate(self.weights):
            score = score + F.element_at(F.array(*map(F.lit, w)), F.get(features, F.lit(i)) + 1)
        return 1 / (1 + F.exp(-score))


def estimate(patterns: Sequence[tuple[tuple[int, ...], int]]) -> tuple[list, float, dict]:
    """EM over (votes, count): labeler reliabilities, the share of private spans, and the posterior
    of every pattern.  It starts from the sign of the votes' sum."""
    posterior = {v: 0.5 + 0.4 * ((sum(v) > 0) - (sum(v) < 0)) for v, _ in patterns}
    reliability, prior = [], 0.5
    total = sum(n for _, n in patterns)
    for _ in range(EM_ROUNDS):
        mass = sum(n * posterior[v] for v, n in patterns)
        prior = (mass + 1) / (total + 2)
        reliability = []
        for i in range(len(patterns[0][0])):
            table = {}
            for vote in (-1, 0, 1):
                seen = [(v, n) for v, n in patterns if v[i] == vote]
                yes = sum(n * posterior[v] for v, n in seen)
                no = sum(n for _, n in seen) - yes
                table[vote] = ((no + 0.5) / (total - mass + 1.5), (yes + 0.5) / (mass + 1.5))
            reliability.append(table)
        for v, _ in patterns:
            odds = math.log(prior / (1 - prior)) + sum(math.log(t[x][1] / t[x][0]) for t, x in zip(reliability, v))
            posterior[v] = 1 / (1 + math.exp(-max(-50.0, min(50.0, odds))))
    return reliability, prior, posterior


def train(rows: Sequence[tuple[tuple[int, ...], float, float]]) -> tuple[list[list[float]], float]:
    """Logistic regression on (features, weight, soft label) with a small penalty, by gradient descent."""
    weights, bias = [[0.0] * size for size in FEATURE_SIZES], 0.0
    total = sum(w for _, w, _ in rows)
    for _ in range(FIT_ROUNDS):
        grad, grad_bias = [[0.0] * size for size in FEATURE_SIZES], 0.0
        for f, w, y in rows:
            score = bias + sum(weights[i][b] for i, b in enumerate(f))
            error = w / total * (1 / (1 + math.exp(-max(-50.0, min(50.0, score)))) - y)
            grad_bias += error
            for i, b in enumerate(f):
                grad[i][b] += error
        bias -= 2.0 * grad_bias
        weights = [[w - 2.0 * (g + 1e-4 * w) for w, g in zip(ws, gs)] for ws, gs in zip(weights, grad)]
    return weights, bias


def fit(found: DataFrame) -> Model | None:
    """The model of all candidates in ``found``; None without candidates."""
    counts = found.select(F.explode("candidates").alias("c")).groupBy("c.votes", "c.features") \
        .agg(F.count("*").alias("n")).orderBy("votes", "features").collect()  # at most one row a bucket
    if not counts:
        return None
    by_votes: dict[tuple, int] = {}
    for r in counts:
        by_votes[tuple(r["votes"])] = by_votes.get(tuple(r["votes"]), 0) + r["n"]
    reliability, prior, posterior = estimate(sorted(by_votes.items()))
    weights, bias = train([(tuple(r["features"]), r["n"], posterior[tuple(r["votes"])]) for r in counts])
    return Model(reliability, prior, weights, bias)


def classify(found: DataFrame, model: Model | None) -> DataFrame:
    """``found`` without candidates, with the column ``secret`` of accepted spans."""
    spans = F.transform("candidates", lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end")))
    if model is None:
        accepted = F.slice(spans, 1, 0)
    else:
        accepted = F.transform(F.filter("candidates", lambda c: model.column(c["features"]) >= 0.5),
                               lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end")))
    return found.withColumn("secret", accepted).drop("candidates")


def listed(kinds: Sequence[str]) -> Column:
    """``kind:start:end`` of the spans in the columns ``kinds``, by start, then kind, comma-joined."""
    def tagged(kind: str) -> Column:
        return F.transform(kind, lambda s: F.struct(s["start"].alias("start"), F.lit(KINDS.index(kind)).alias("place"),
                                                    s["end"].alias("end"), F.lit(kind).alias("kind")))

    return F.array_join(F.transform(F.sort_array(F.concat(*map(tagged, kinds))), lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def detect(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and, for each of KINDS, array<struct<start, end>> in code points, end exclusive."""
    found = find(docs, id_col=id_col, text_col=text_col)
    return classify(found, fit(found))
