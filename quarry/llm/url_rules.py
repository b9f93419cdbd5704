"""URL filters: pattern rules found through their rarest literal token.

A rule is a pattern over ``host + path`` (host with A-Z lower-cased, no query or fragment).  Two
forms exist: host rules ``net/`` (the host and its subdomains, the path a prefix) and regular
expressions with their literal tokens stated.  The index keeps every rule under one token, the one
that the fewest URLs have; a URL's tokens fetch its candidate rules, and only those run.

The rule list is configuration: it travels inside the plan, so its size is checked
(``MAX_RULES``; beyond it an error, never a shortened list).  Judging is then map-only over the
pages; the only exchange counts the rules' tokens, pre-aggregated to one row a token and task.

Defined results: a null URL or one without ``://`` has empty host and path, fits no rule and gets
the default verdict.  Rows that repeat are judged alike; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import LOWER, UPPER, ascii_lower

MAX_RULES = 20_000


@dataclass(frozen=True)
class Rule:
    name: str
    verdict: str              # block or allow
    pattern: str              # Java regular expression, searched in host + path
    tokens: tuple[str, ...]   # literal tokens that every fitting URL has
    listed: bool = True       # False: of the method's own patterns, below every listed rule


def host_rule(verdict: str, name: str) -> Rule:
    """``example.net/en/``: the host and its subdomains, if the path starts with the rule's."""
    host, slash, path = name.partition("/")
    path = slash + path
    # the host part holds no slash, so the anchor cannot reach into the path
    pattern = rf"\A(?:[^/?#]*\.)?{re.escape(host)}{re.escape(path)}"
    whole = path if not path or not path[-1].isalnum() else path[:re.search(r"[A-Za-z0-9]*\Z", path).start()]
    return Rule(name, verdict, pattern, tuple(re.findall("[a-z0-9]+", (host + whole).translate(str.maketrans(UPPER, LOWER)))))


def text_rule(verdict: str, name: str, pattern: str, *tokens: str) -> Rule:
    return Rule(name, verdict, pattern, tokens, listed=False)


#: The listed rules of the registered query.
LISTED = (host_rule("block", "net/"), host_rule("allow", "example.net/en/"),
          host_rule("block", "example.com/de/"), host_rule("allow", "org/fr/"))
#: The method's own patterns decide where no listed rule fits.
OWN = (text_rule("block", "login", r"/(?i:login|signin)(?:[/.]|\z)", "login"),
       text_rule("block", "signin", r"/(?i:signin)(?:[/.]|\z)", "signin"),
       text_rule("block", "wp-admin", r"/(?i:wp-admin)(?:/|\z)", "wp", "admin"),
       text_rule("block", "exe", r"(?i:\.exe)\z", "exe"),
       text_rule("block", "zip", r"(?i:\.zip)\z", "zip"))


def with_parts(pages: DataFrame, url_col: str = "url") -> DataFrame:
    """``pages`` with host, path and the distinct literal tokens of both (``__url_tokens``)."""
    url = F.coalesce(F.col(url_col), F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = ascii_lower(F.regexp_extract(rest, r"\A[^/?#]*", 0))
    path = F.regexp_extract(rest, r"(?s)\A[^/?#]*([^?#]*)", 1)
    tokens = F.array_distinct(F.array_remove(F.split(ascii_lower(F.concat(host, path)), "[^a-z0-9]+"), ""))
    return pages.withColumns({"host": host, "path": path}).withColumn("__url_tokens", tokens)


def rarest_tokens(parts: DataFrame, rules: Sequence[Rule]) -> dict[str, list[Rule]]:
    """The index: each rule under that of its tokens which the fewest rows have (ties: the first by name)."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"{len(rules)} rules; the list is part of the plan and may have {MAX_RULES}")
    if any(not r.tokens for r in rules):
        raise ValueError("every rule needs a literal token")
    wanted = sorted({t for r in rules for t in r.tokens})
    seen = F.array_intersect("__url_tokens", F.array(*map(F.lit, wanted)))
    counts = {r["token"]: r["n"] for r in parts.select(F.explode(seen).alias("token")).groupBy("token")
              .agg(F.count("*").alias("n")).collect()}  # at most one row for each of the rules' tokens
    index = defaultdict(list)
    for rule in rules:
        index[min(rule.tokens, key=lambda t: (counts.get(t, 0), t))].append(rule)
    return dict(index)


def _rule_struct(rule: Rule) -> Column:
    return F.struct(F.lit(rule.listed).alias("listed"), F.lit(len(rule.name)).alias("size"),
                    F.lit(rule.name).alias("name"), F.lit(rule.verdict).alias("verdict"),
                    F.lit(rule.pattern).alias("pattern"))


def judge(pages: DataFrame, rules: Sequence[Rule] = LISTED + OWN, *, url_col: str = "url",
          default: str = "allow") -> DataFrame:
    """``pages`` with host, path, rule (the listed rule that decided, else null), verdict and
    own_rule (the method's pattern that decided, else null).

    Listed rules go before own patterns, then the longest name wins, then the name's order.
    """
    out = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict", "own_rule")]
    parts = with_parts(pages.select(*out), url_col)
    index = rarest_tokens(parts, rules)
    pairs = [x for token, found in sorted(index.items())
             for x in (F.lit(token), F.array(*[_rule_struct(r) for r in found]))]
    if not pairs:
        return parts.drop("__url_tokens").withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default),
                                                  "own_rule": F.lit(None).cast("string")})
    by_token = F.create_map(*pairs)
    keys = F.array(*[F.lit(t) for t in sorted(index)])
    fetched = F.flatten(F.transform(F.array_intersect("__url_tokens", keys), lambda t: by_token[t]))
    where = F.concat("host", "path")
    fitting = F.filter(fetched, lambda r: F.regexp_like(where, r["pattern"]))
    best = F.array_max(fitting)  # struct order: listed, size, name
    judged = parts.withColumn("__url_best", best)
    listed = F.col("__url_best.listed")
    return judged.select(*out, "host", "path", F.when(listed, F.col("__url_best.name")).alias("rule"),
                         F.coalesce(F.col("__url_best.verdict"), F.lit(default)).alias("verdict"),
                         F.when(~listed, F.col("__url_best.name")).alias("own_rule"))
