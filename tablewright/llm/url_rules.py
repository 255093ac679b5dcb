"""URL filters: pattern rules indexed by their rarest literal token.

A rule is a regular expression over ``host + path`` with the literal tokens
every match must hold.  Each rule is filed under the one of its tokens that
fewest rules have.  A URL's tokens fetch the rules filed under them, and only
those run their expression.  All of it is DataFrame expressions; the index is a
literal map of the rules given, so nothing is joined or shuffled.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_SPLIT = "[^a-z0-9]+"


@dataclass(frozen=True)
class Rule:
    """``name`` is reported; ``tokens`` are lower-case runs of a-z and 0-9 that stand in every match."""

    name: str
    verdict: str
    pattern: str
    tokens: tuple[str, ...]


def site_rule(spec: str, verdict: str) -> Rule:
    """``host/path``: that host and its subdomains, where the path begins so."""
    host, slash, path = spec.partition("/")
    path = slash + path
    # A token cut off by the end of the rule may go on in the URL, so the path's last run counts only if the rule closes it.
    closed = re.findall(r"[a-z0-9]+(?=[^a-zA-Z0-9])", path)
    tokens = tuple(dict.fromkeys([*re.findall("[a-z0-9]+", host), *closed]))
    return Rule(spec, verdict, f"^(?:[^/]*\\.)?{_literal(host)}{_literal(path)}", tokens)


def word_rule(words: str, verdict: str = "block") -> Rule:
    """Host labels or path parts in which these words stand side by side."""
    tokens = tuple(words.split())
    return Rule(words, verdict, "(?:^|[^a-z0-9])" + "[-._]".join(map(_literal, tokens)) + "(?:$|[^a-z0-9])", tokens)


def _literal(text: str) -> str:
    return re.sub(r"([^A-Za-z0-9/_])", r"\\\1", text)


#: The method's own rules, for URLs that no site rule fits: names that shops, betting and advert sites use.
OWN_RULES = [
    word_rule(w) for w in (
        "casino win", "free bets", "cheap pills", "spam farm", "adult x", "ads track", "online casino", "sports betting",
        "poker bonus", "payday loan", "replica watches", "weight loss", "xxx", "porn", "viagra", "doubleclick", "adserver",
    )
]


def index(rules: list[Rule]) -> dict[str, list[Rule]]:
    """Each rule under the one of its tokens that fewest rules hold (ties: the longest, then the first)."""
    if bare := [r.name for r in rules if not r.tokens]:
        raise ValueError(f"rules without a literal token: {bare}")
    often = Counter(t for r in rules for t in set(r.tokens))
    out: dict[str, list[Rule]] = {}
    for rule in rules:
        out.setdefault(min(rule.tokens, key=lambda t: (often[t], -len(t), t)), []).append(rule)
    return out


def host_of(url: str) -> Column:
    rest = F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: str) -> Column:
    return F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def _matches(rules: list[Rule], target: str, tokens: str) -> Column:
    """Array of (size, name, verdict) of the rules that match, longest name last."""
    filed = index(rules)
    entry = lambda r: F.struct(
        F.lit(len(r.name)).alias("size"), F.lit(r.name).alias("name"), F.lit(r.verdict).alias("verdict"), F.lit(r.pattern).alias("pattern")
    )
    pairs = [x for token, some in filed.items() for x in (F.lit(token), F.array(*map(entry, some)))]
    table = F.create_map(*pairs)
    fetched = F.flatten(F.filter(F.transform(F.col(tokens), lambda t: F.try_element_at(table, t)), lambda x: x.isNotNull()))
    return F.sort_array(F.filter(fetched, lambda r: F.expr("true") & F.rlike(F.col(target), r["pattern"])))


def judge_urls(
    pages: DataFrame, rules: list[Rule], own_rules: list[Rule] = OWN_RULES, url: str = "url", otherwise: str = "allow", keys: tuple[str, ...] = ("page_id",),
) -> DataFrame:
    """One row per row of ``pages``: keys, host, path, rule, verdict.

    Of the rules that match, the longest name wins (ties: the last by name); it
    stands in ``rule``.  Where none does, ``own_rules`` decide the verdict and
    ``rule`` is null; where none of those matches either, it is ``otherwise``.
    A null URL or one without ``://`` has an empty host and path.  Other columns
    are not read; repeated rows are judged one by one.
    """
    df = pages.select(*(F.col(f"`{k}`").alias(f"_{i}") for i, k in enumerate(keys)), F.col(f"`{url}`").cast("string").alias("_url"))
    df = df.select(*(f"_{i}" for i in range(len(keys))), host_of("_url").alias("_host"), path_of("_url").alias("_path"))
    df = df.withColumn("_target", F.concat("_host", "_path"))
    df = df.withColumn("_tokens", F.array_distinct(F.split(F.col("_target"), _SPLIT)))
    best = lambda some: F.try_element_at(some, F.lit(-1))
    df = df.withColumn("_best", best(_matches(rules, "_target", "_tokens")) if rules else F.lit(None).cast("struct<name:string,verdict:string>"))
    lower = df.withColumn("_lower", F.lower("_target")).withColumn("_words", F.array_distinct(F.split(F.col("_lower"), _SPLIT)))
    own = best(_matches(own_rules, "_lower", "_words"))["verdict"] if own_rules else F.lit(None).cast("string")
    verdict = F.when(F.col("_best").isNotNull(), F.col("_best.verdict")).otherwise(F.coalesce(own, F.lit(otherwise)))
    return lower.select(
        *(F.col(f"_{i}").alias(k) for i, k in enumerate(keys)), F.col("_host").alias("host"), F.col("_path").alias("path"),
        F.col("_best.name").alias("rule"), verdict.alias("verdict"),
    )
