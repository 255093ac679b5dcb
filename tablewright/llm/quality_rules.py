"""Quality rules: learned decision lists over text statistics, as ordered Spark conditions.

All statistics and verdicts are DataFrame expressions.  The list is learned by
sequential covering from the statistics of a bounded sample of labelled rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty
from .sampling import labelled

_BLANKS = " \t\n\x0b\f\r"
_SYMBOLS = "#*$%&|<>"


def with_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words (long) to a frame.

    Words are runs of characters other than ASCII white space.  n_lines counts
    lines with a word, n_dup_lines those of them equal to an earlier one,
    n_repeat_words the words in windows of three words found twice or more.  A
    null or empty text has zeros everywhere.  Columns of these names are
    replaced.
    """
    own = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")
    df = docs.drop(*own, "_stats").withColumn("_stats", F.expr(_word_statistics(f"coalesce(CAST(`{text}` AS STRING), '')")))
    t, blanks = text_or_empty(text), F.lit(_BLANKS)
    lines = F.filter(F.split(t, "\n"), lambda line: F.btrim(line, blanks) != "")
    return df.withColumns({
        **{c: F.col(f"_stats.{c}").cast("long") for c in ("n_words", "word_chars", "n_repeat_words")},
        "n_symbols": F.length(F.regexp_replace(t, f"[^{_SYMBOLS}]+", "")).cast("long"),
        "n_lines": F.size(lines).cast("long"),
        "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
    }).drop("_stats")


def _word_statistics(text: str) -> str:
    """One expression for all that is counted in words.

    Each step is bound to a name by a one-element array, so it is made once per
    text, also where a filter on the result is pushed down and the expression
    with it.  Windows of three words are hashed; only a text in which two hashes
    agree has them sorted, with their places.
    """
    blanks = "concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))"
    words = f"filter(split(btrim({text}, {blanks}), '[\\\\x20\\\\x09-\\\\x0D]+'), x -> x != '')"
    hashed = "CASE WHEN size(w) > 2 THEN transform(sequence(2, size(w) - 1), i -> xxhash64(w[i - 2], w[i - 1], w[i])) ELSE array() END"
    found_twice = """transform(array(sort_array(transform(h, (x, i) -> struct(x AS x, i AS i)))), s ->
        transform(filter(s, (e, k) -> (k > 0 AND s[greatest(k - 1, 0)].x = e.x) OR (k + 1 < size(s) AND s[least(k + 1, size(s) - 1)].x = e.x)), e -> e.i))[0]"""
    covered = "size(array_union(array_union(p, transform(p, i -> i + 1)), transform(p, i -> i + 2)))"
    repeated = f"""transform(array({hashed}), h -> CASE WHEN size(array_distinct(h)) = size(h) THEN 0
        ELSE transform(array({found_twice}), p -> {covered})[0] END)[0]"""
    return f"""transform(array({words}), w -> named_struct(
        'n_words', size(w), 'word_chars', length(array_join(w, '')), 'n_repeat_words', {repeated}))[0]"""


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


#: What conditions test: ratios that don't depend on a text's length, and its length.
FEATURES = {
    "words": "CAST(n_words AS DOUBLE)",
    "word_length": "word_chars / greatest(n_words, 1)",
    "symbols_per_word": "n_symbols / greatest(n_words, 1)",
    "duplicate_lines": "n_dup_lines / greatest(n_lines, 1)",
    "repeated_words": "n_repeat_words / greatest(n_words, 1)",
    "words_per_line": "n_words / greatest(n_lines, 1)",
}


@dataclass(frozen=True)
class Rule:
    """Reject a text that meets all conditions (feature, whether above, threshold)."""

    conditions: tuple[tuple[str, bool, float], ...]

    def column(self) -> Column:
        out = F.lit(True)
        for name, above, cut in self.conditions:
            value = F.expr(FEATURES[name])
            out = out & (value >= F.lit(float(cut)) if above else value < F.lit(float(cut)))
        return out

    def covers(self, x: dict[str, np.ndarray]) -> np.ndarray:
        out = np.ones(len(next(iter(x.values()))), bool)
        for name, above, cut in self.conditions:
            out &= x[name] >= cut if above else x[name] < cut
        return out


def _counts(mask: np.ndarray, bad: np.ndarray) -> tuple[int, int]:
    return int((mask & bad).sum()), int((mask & ~bad).sum())


def _grow(x: dict[str, np.ndarray], bad: np.ndarray, most: int, cuts: int) -> Rule:
    """Add the condition with the largest information gain until no good row is covered."""
    chosen: list[tuple[str, bool, float]] = []
    inside = np.ones(len(bad), bool)
    while len(chosen) < most:
        p, n = _counts(inside, bad)
        if not p or not n:
            break
        before, best = np.log2(p / (p + n)), (1e-9, None)
        for name, values in x.items():
            for cut in np.unique(np.quantile(values[inside], np.linspace(0, 1, cuts))):
                for above in (True, False):
                    p1, n1 = _counts(inside & ((values >= cut) if above else (values < cut)), bad)
                    if p1 and (gain := p1 * (np.log2(p1 / (p1 + n1)) - before)) > best[0]:
                        best = gain, (name, above, float(cut))
        if best[1] is None:
            break
        chosen.append(best[1])
        inside &= Rule((best[1],)).covers(x)
    return Rule(tuple(chosen))


def learn(x: dict[str, np.ndarray], bad: np.ndarray, precision: float = 0.9, support: int = 5, most_rules: int = 12, most_conditions: int = 4, cuts: int = 33) -> list[Rule]:
    """Sequential covering: grow a rule on two thirds of the rows, prune it on the rest, keep it if it is precise.

    A rule is cut back to the first conditions that are most precise on the
    rows it was not grown on (ties: fewer conditions).  Learning ends with the
    first rule below ``precision`` there, or with fewer than ``support`` rejected
    rows in all.  No labelled rows, or one class only: no rules.
    """
    rules: list[Rule] = []
    left = np.ones(len(bad), bool)
    part = np.arange(len(bad)) % 3
    while len(rules) < most_rules and (left & bad).sum() >= support:
        grow, prune = left & (part < 2), left & (part == 2)
        rule = _grow({k: v[grow] for k, v in x.items()}, bad[grow], most_conditions, cuts)
        if not rule.conditions:
            break

        def worth(k: int, rule: Rule = rule, prune: np.ndarray = prune) -> tuple[float, int]:
            p, n = _counts(Rule(rule.conditions[:k]).covers(x) & prune, bad)
            return (p + 1) / (p + n + 2), -k

        rule = Rule(rule.conditions[: max(range(1, len(rule.conditions) + 1), key=worth)])
        p, n = _counts(rule.covers(x) & left, bad)
        held = _counts(rule.covers(x) & prune, bad)
        if p < support or p < precision * (p + n) or held[0] < precision * sum(held):
            break
        rules.append(rule)
        left &= ~rule.covers(x)
    return rules


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = 2500, id: str = "doc_id", text: str = "text") -> list[Rule]:
    """Learn the list on at most ``per_class`` labelled rows of each class; base failures are left out."""
    rows = with_statistics(labelled(docs, labels, label, per_class, id, text, fold=False), "_text").where(~base_failed())
    got = rows.select("_id", "_label", *(F.expr(v).alias(k) for k, v in FEATURES.items())).orderBy(F.xxhash64("_id"), "_id").collect()
    x = {k: np.array([r[k] for r in got], float) for k in FEATURES}
    return learn(x, np.array([r["_label"] == 0 for r in got], bool))


def verdict(rules: list[Rule]) -> Column:
    """The list as one ordered condition: the number of the first rule that rejects, or null."""
    out = F.lit(None).cast("int")
    for i in reversed(range(len(rules))):
        out = F.when(rules[i].column(), F.lit(i)).otherwise(out)
    return out


def judge_quality(docs: DataFrame, rules: list[Rule], id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, statistics, base_failed, kept, rule (the first that rejects, else null).

    Rows with a null or repeated id are judged like any others; other columns are not read.
    """
    rows = with_statistics(docs.select(F.col(f"`{id}`").alias("_id"), F.col(f"`{text}`").alias("_text")), "_text")
    rows = rows.withColumn("base_failed", base_failed()).withColumn("rule", verdict(rules))
    return rows.select(
        F.col("_id").alias(id), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & F.col("rule").isNull()).alias("kept"), "rule",
    )
