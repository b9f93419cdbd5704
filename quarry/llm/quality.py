"""Quality rules: a learned decision list over text statistics.

The statistics of a text are column expressions.  Sequential covering learns an ordered list of
threshold conjunctions that find low-quality texts: each rule is grown on one part of the labelled
statistics (condition by condition, by information gain), pruned on the other part, kept if precise
there, and the rows it covers are set aside before the next rule is grown.  The list is emitted as
one ordered conditional expression, so judging a corpus is map-only.

Fitting reads at most ``max_labelled`` labelled documents (chosen by a hash of their id), a bound
that keeps the labelled ids broadcastable and the statistics on the driver; judging covers all rows.

Defined results: null text counts as empty, has zero statistics and fails the base rule; without
labelled rows the list is empty and only the base rule rejects; an id that is labelled twice
counts with its lowest label; rows that repeat are judged alike; extra columns pass through.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import SPACE, let

WINDOW = 8                # words
MAX_LABELLED = 20_000
CUTS = 24                 # candidate thresholds a feature
MAX_CONDITIONS = 3
MAX_RULES = 12
MIN_PRECISION = 0.98      # on the pruning part
MIN_COVERED = 5           # rows of the growing part

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MORE = ("n_lines", "n_distinct_words", "n_upper", "n_marks")


def _repeat_words(words: Column) -> Column:
    """Words inside WINDOW-word windows that occur twice or more in the text.

    Hashes of the windows rule most texts out (equal windows have equal hashes); only a text with
    two equal hashes sorts its windows themselves, next to their places, and measures what the
    repeated ones cover.
    """
    def covered(places: Column) -> Column:
        steps = F.transform(F.sequence(F.lit(1), F.size(places)),
                            lambda j: F.when(j == F.size(places), F.lit(WINDOW))
                            .otherwise(F.least(F.lit(WINDOW), F.get(places, j) - F.get(places, j - 1))))
        return F.when(F.size(places) > 0, F.aggregate(steps, F.lit(0), lambda a, b: a + b)).otherwise(F.lit(0))

    def repeated(sorted_windows: Column) -> Column:
        at = lambda j: F.get(sorted_windows, j)["window"]  # noqa: E731 (0-based; null outside)
        twice = F.filter(F.sequence(F.lit(0), F.size(sorted_windows) - 1),
                         lambda j: F.coalesce(at(j) == at(j - 1), F.lit(False)) | F.coalesce(at(j) == at(j + 1), F.lit(False)))
        return F.sort_array(F.transform(twice, lambda j: F.get(sorted_windows, j)["place"]))

    starts = F.sequence(F.lit(1), F.size(words) - (WINDOW - 1))
    exact = let(F.sort_array(F.transform(starts, lambda i: F.struct(
        F.concat_ws(" ", F.slice(words, i, F.lit(WINDOW))).alias("window"), i.alias("place")))),
        lambda s: let(repeated(s), covered))
    hashes = F.transform(starts, lambda i: F.xxhash64(*[F.get(words, i + (k - 1)) for k in range(WINDOW)]))
    screened = let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(exact))
    return F.when(F.size(words) >= WINDOW, screened).otherwise(F.lit(0))


def statistics(text: Column) -> Column:
    """A struct of BASE and MORE, all long."""
    text = F.coalesce(text, F.lit(""))

    def measure(words: Column, lines: Column, whole: Column) -> Column:
        values = {
            "n_words": F.size(words),
            "word_chars": F.length(F.concat_ws("", words)),
            "n_symbols": F.regexp_count(whole, F.lit("[#*$%&|<>]")),
            "n_dup_lines": F.size(lines) - F.size(F.array_distinct(lines)),
            "n_repeat_words": _repeat_words(words),
            "n_lines": F.size(lines),
            "n_distinct_words": F.size(F.array_distinct(words)),
            "n_upper": F.regexp_count(whole, F.lit(r"\p{Lu}")),
            "n_marks": F.regexp_count(whole, F.lit("[.,;:!?]")),
        }
        return F.struct(*[v.cast("long").alias(k) for k, v in values.items()])

    words = F.array_remove(F.split(text, SPACE), "")
    lines = F.filter(F.split(text, "\n"), lambda x: F.regexp_like(x, F.lit(r"[^\x20\x09-\x0D]")))
    return let(F.struct(words.alias("words"), lines.alias("lines"), text.alias("whole")),
               lambda t: measure(t["words"], t["lines"], t["whole"]))


def features(stats: Column) -> dict[str, Column]:
    """What the rules may test, from the statistics struct (doubles; 0 for texts without words)."""
    def per(value: str, unit: str) -> Column:
        return F.when(stats[unit] > 0, stats[value] / stats[unit]).otherwise(F.lit(0.0))

    return {"word_length": per("word_chars", "n_words"), "symbols_per_word": per("n_symbols", "n_words"),
            "dup_line_share": per("n_dup_lines", "n_lines"), "repeat_share": per("n_repeat_words", "n_words"),
            "distinct_share": per("n_distinct_words", "n_words"), "upper_share": per("n_upper", "word_chars"),
            "marks_per_word": per("n_marks", "n_words"), "words_per_line": per("n_words", "n_lines")}


def base_failed(stats: Column) -> Column:
    return (stats["n_words"] < 20) | (100 * stats["n_repeat_words"] > 30 * stats["n_words"])


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def holds(self, row: dict) -> bool:
        return row[self.feature] >= self.threshold if self.above else row[self.feature] <= self.threshold

    def column(self, by_name: dict[str, Column]) -> Column:
        value = by_name[self.feature]
        return value >= F.lit(self.threshold) if self.above else value <= F.lit(self.threshold)

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.above else '<='} {self.threshold:.6g}"


Rule = tuple[Condition, ...]


def _covers(rule: Rule, rows: Sequence[dict]) -> list[dict]:
    return [r for r in rows if all(c.holds(r) for c in rule)]


def _counts(rows: Sequence[dict]) -> tuple[int, int]:
    bad = sum(r["bad"] for r in rows)
    return bad, len(rows) - bad


def _cuts(rows: Sequence[dict], names: Sequence[str]) -> dict[str, list[float]]:
    cuts = {}
    for name in names:
        values = sorted(r[name] for r in rows)
        cuts[name] = sorted({values[(len(values) - 1) * i // CUTS] for i in range(CUTS + 1)})
    return cuts


def _best_condition(rows: list[dict], names: Sequence[str]) -> Condition | None:
    """The condition with the highest information gain (FOIL's) over ``rows``; ties: the first."""
    bad, good = _counts(rows)
    if not bad or not good:
        return None
    before, best, best_gain = math.log2(bad / (bad + good)), None, 1e-9
    for name, cuts in _cuts(rows, names).items():
        for cut in cuts:
            for above in (True, False):
                p, n = _counts([r for r in rows if (r[name] >= cut if above else r[name] <= cut)])
                if p and (gain := p * (math.log2(p / (p + n)) - before)) > best_gain:
                    best, best_gain = Condition(name, above, cut), gain
    return best


def _worth(rule: Rule, rows: Sequence[dict]) -> float:
    p, n = _counts(_covers(rule, rows))
    return (p - n) / (p + n) if p + n else -1.0


def learn(rows: Sequence[dict], names: Sequence[str]) -> list[Rule]:
    """Sequential covering over rows of feature values with ``bad`` (0/1) and ``part`` (0-2; 2 prunes)."""
    grow, prune, rules = [r for r in rows if r["part"] < 2], [r for r in rows if r["part"] == 2], []
    while len(rules) < MAX_RULES:
        rule: Rule = ()
        left = grow
        while len(rule) < MAX_CONDITIONS and (found := _best_condition(left, names)):
            rule, left = (*rule, found), [r for r in left if found.holds(r)]
        if not rule:
            break
        shorter = [rule[:n] for n in range(1, len(rule) + 1)]
        rule = max(shorter, key=lambda c: _worth(c, prune))
        p, n = _counts(_covers(rule, prune))
        if p < (p + n) * MIN_PRECISION or not p or len(_covers(rule, grow)) < MIN_COVERED:
            break
        rules.append(rule)
        grow = [r for r in grow if not all(c.holds(r) for c in rule)]
        prune = [r for r in prune if not all(c.holds(r) for c in rule)]
    return rules


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "quality", max_labelled: int = MAX_LABELLED) -> list[Rule]:
    """The decision list learned from ``labels`` (id, 0 = low quality) over the texts in ``docs``."""
    given = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()) \
        .groupBy(F.col(id_col).alias("_id")).agg(F.min(label_col).alias("_label"))
    place = F.pmod(F.xxhash64("_id"), F.lit(1 << 30))
    known = labels.count()
    share = min(1.0, 1.2 * max_labelled / max(known, 1))  # thins the sort below; it still picks by hash order
    chosen = given.filter(place < int(share * (1 << 30))).orderBy(place, "_id").limit(max_labelled)
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    # max_labelled rows of two numbers: a proven bound for the broadcast
    stats = texts.join(F.broadcast(chosen), "_id").select("_id", "_label", statistics(F.col("_text")).alias("s"))
    named = features(F.col("s"))
    # what the base rule rejects is set aside here: as a filter in the plan it would be pushed below
    # the join and computed for every document
    rows = stats.select((F.col("_label") == 0).cast("int").alias("bad"), F.pmod(F.xxhash64(F.lit("part"), "_id"), F.lit(3)).alias("part"),
                        base_failed(F.col("s")).alias("base"), *[c.alias(n) for n, c in named.items()]) \
        .orderBy("_id").limit(2 * max_labelled).collect()
    return learn([r.asDict() for r in rows if not r["base"]], list(named))


def judge(docs: DataFrame, rules: Sequence[Rule], *, text_col: str = "text") -> DataFrame:
    """``docs`` with the BASE statistics, base_failed, rule (the first that covers the text) and kept."""
    out = [c for c in docs.columns if c not in (*BASE, "base_failed", "rule", "kept")]
    judged = docs.select(*out, statistics(F.col(text_col)).alias("__stats"))
    stats = F.col("__stats")
    named, verdict = features(stats), F.lit(None).cast("string")
    for rule in reversed(rules):  # ordered: the first rule is the outermost condition
        test = rule[0].column(named)
        for condition in rule[1:]:
            test = test & condition.column(named)
        verdict = F.when(test, F.lit(" and ".join(map(str, rule)))).otherwise(verdict)
    return judged.select(*out, *[stats[c].alias(c) for c in BASE], base_failed(stats).alias("base_failed"),
                         verdict.alias("rule")).withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())
