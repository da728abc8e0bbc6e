"""Quality rules as a short-circuit cascade, in DataFrame functions only.

Each rule is a predicate of one text. Its cost (seconds on a bounded sample) and its
rejection share are measured first; then the rules run as one CASE expression,
cheapest rejection first, so that a rejected text skips all later rules. The order
changes only the run time: a text is kept when the base test and every rule pass.

Rows: NULL text has no words and fails the base test; repeated rows, and rows with one
``doc_id`` or without any, are judged each on its own; very long texts are judged whole; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinlens.session import durable

SPACE = r"[\x20\x09-\x0D]+"
SAMPLE_ROWS = 2000  # rows on which costs and selectivities are measured; they only set the order


@dataclass(frozen=True)
class Rule:
    name: str
    fails: str  #: SQL predicate over text, words, lines and the counts


# Thresholds; each is far outside of what prose in any language shows. Distinct words of prose grow with the
# length, roughly by its root or faster: fewer than sqrt(2 n) of n words is low variety at any length.
RULES = (
    Rule("symbols", "n_symbols * 4 > n_words"),
    Rule("repeated_lines", "n_dup_lines >= 3 AND n_dup_lines * 10 > size(lines) * 3"),
    Rule("word_length", "word_chars > 15 * n_words OR word_chars * 2 < 3 * n_words"),
    Rule("capitals", "length(regexp_replace(text, '[^A-Z]', '')) * 10 > word_chars * 4"),
    Rule("letters", "length(regexp_replace(text, '[^\\\\p{L}]', '')) * 10 < word_chars * 6"),
    Rule("distinct_words", "size(array_distinct(words)) * 20 < n_words AND size(array_distinct(words)) * size(array_distinct(words)) < 2 * n_words"),
)


def bind(value: str, name: str, body: str) -> str:
    """SQL that evaluates ``value`` once per row and uses it as ``name`` inside lambdas of ``body``."""
    return f"transform(array({value}), {name} -> {body})[0]"


def words(text: str = "text") -> Column:
    """Words of a text (an expression: bind it before use inside a lambda)."""
    return F.expr(f"array_remove(split({text}, '{SPACE.replace(chr(92), chr(92) * 2)}'), '')")


def _repeated() -> Column:
    """Words inside three-word windows that occur twice or more.

    Windows are compared by 64-bit hash. Sorting (hash, place) puts equal windows side
    by side; their places in order then cover min(3, distance) words each.
    """
    windows = "transform(sequence(1, size(v) - 2), i -> xxhash64(element_at(v, i), element_at(v, i + 1), element_at(v, i + 2)))"
    ordered = "array_sort(transform(h, (x, i) -> struct(x AS h, i AS i)))"
    twice = "filter(s, (x, k) -> (k > 0 AND s[k - 1].h = x.h) OR (k + 1 < size(s) AND s[k + 1].h = x.h))"
    covered = (
        f"aggregate(array_sort(transform({twice}, x -> x.i)), struct(-3 AS last, 0 AS n), "
        "(a, i) -> struct(i AS last, a.n + least(3, i - a.last) AS n), a -> a.n)"
    )
    found = bind(ordered, "s", covered)
    per_text = bind(windows, "h", f"CASE WHEN size(array_distinct(h)) = size(h) THEN 0 ELSE {found} END")
    return F.expr(f"CASE WHEN size(words) < 3 THEN 0 ELSE {bind('words', 'v', per_text)} END")


def counts(docs: DataFrame) -> DataFrame:
    """doc_id, text, words, lines and the counts of every text."""
    frame = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    frame = frame.withColumns(
        {
            "words": words(),
            "lines": F.expr("filter(split(text, '\\n'), l -> l rlike '[^\\\\x20\\\\x09-\\\\x0D]')"),
        }
    )
    frame = frame.withColumns(
        {
            "n_words": F.size("words").cast("long"),
            "word_chars": F.length(F.array_join("words", "")).cast("long"),
            "n_symbols": (F.length("text") - F.length(F.regexp_replace("text", "[#*$%&|<>]", ""))).cast("long"),
            "n_dup_lines": (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"),
            "n_repeat_words": _repeated().cast("long"),
        }
    )
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return frame.withColumn("base_failed", failed)


def rule_order(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> list[tuple[Rule, float, float]]:
    """(rule, seconds, share rejected) on a sample, most rejections per second first."""
    total = docs.count()
    sample = docs.sample(fraction=min(1.0, SAMPLE_ROWS / total), seed=1) if total > SAMPLE_ROWS else docs
    # the rules run on what the base test leaves, so they are measured there
    ready = durable(counts(sample).where("NOT base_failed"))

    def timed(share: Column) -> tuple[float, float]:
        began = time.perf_counter()
        value = ready.agg(share.alias("x")).first()[0]
        return time.perf_counter() - began, float(value or 0.0)

    timed(F.avg(F.col("n_words")))  # starts the readers
    floor, _ = timed(F.avg(F.col("n_words")))
    found = []
    for rule in rules:
        seconds, share = timed(F.avg(F.expr(f"CASE WHEN {rule.fails} THEN 1.0D ELSE 0.0D END")))
        found.append((rule, max(seconds - floor, 1e-3), share))
    return sorted(found, key=lambda x: (-x[2] / x[1], x[0].name))


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept."""
    verdict = F.when(F.col("base_failed"), False)
    for rule, _, _ in rule_order(docs, rules):
        verdict = verdict.when(F.expr(rule.fails), False)
    frame = counts(docs).withColumn("kept", verdict.otherwise(True))
    return frame.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )
