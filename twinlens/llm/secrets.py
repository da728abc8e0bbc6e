"""Secret scan with a randomness test battery, in DataFrame functions only.

Three patterns give the base spans. The battery adds spans of kind ``random``: every
token of 20 or more characters is tested under the smallest encoding that covers it
(hexadecimal; base 32 and base 36 in either case, if it has digits; base 64) for

* uniform use of the alphabet (chi-squared statistic, exact mean and variance under
  equal probabilities, upper tail), and of three pooled parts of it, such as vowels,
  consonants and digits: short tokens fill few cells,
* the number of runs above / below the middle of the alphabet (two tails), and the number
  of runs of digits and other signs (lower tail),
* correlation of neighbouring symbols (two tails).

A token's p-value is five times the least of the five. Structured strings get small
p-values, so within each length band (powers of two) the Benjamini-Hochberg procedure at
``FALSE_DISCOVERY`` over all tokens of the table picks the structured ones, together with
those below ``LEVEL`` and with mixed-case tokens that mostly consist of words; the rest
cannot be told from random and are secrets. p-values are kept in steps of 0.1 of
-log10, so one small histogram decides for any number of tokens. Letters of one case
without a digit are words or names to this scan, not keys.

Rows: NULL text is the empty text; every row is scanned and masked by itself, so NULL and
repeated ``doc_id`` make no difference, nor do the names of other columns; very long texts
are scanned whole; an empty table gives no rows. Positions are code points, ends exclusive.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinlens.llm.quality_rules import bind
from twinlens.session import durable

# Patterns of the base kinds, in the order used for ties.
ASSIGN = (
    "([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|"
    "[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
ACCESS = "AKIA[A-Z0-9]+"
HEX = "[0-9a-f]+"
KINDS = ("assign", "access", "hex", "random")

LEAST_TOKEN = 20
TOKEN = "[A-Za-z0-9+/_-]{20,}"
FALSE_DISCOVERY = 0.01
LEVEL = 0.005  # a random token has a p-value below this once in 200 times at most
WORDS = 0.6  # share of characters in words (three letters or more) that makes a mixed-case token a name or a path
STEPS = 300  # p-values below 1e-30 count as 1e-30

_HEX_SYMBOLS = "0123456789abcdef"
_BASE32_SYMBOLS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_BASE36_SYMBOLS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_BASE64_SYMBOLS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _spans(kind: int, pattern: str, group: int, least: int, guard: str) -> Column:
    """array<struct<start, kind, end>> of the leftmost non-overlapping matches of ``pattern``.

    The pieces between the matches (``split``) give the positions. ``guard`` is a cheaper
    test that every text with a span passes.
    """
    p = _quoted(pattern)
    matches = f"regexp_extract_all(text, {p}, 0)"
    kept = f"transform(regexp_extract_all(text, {p}, {group}), x -> length(x))" if group else "transform(m, x -> length(x))"
    step = (
        "(s, k) -> struct(s.at + length(g[k]) + length(m[k]) AS at, "
        f"CASE WHEN n[k] >= {least} THEN concat(s.found, array(struct(s.at + length(g[k]) AS start, {kind} AS kind, "
        "s.at + length(g[k]) + length(m[k]) AS end))) ELSE s.found END AS found)"
    )
    none = "CAST(array() AS array<struct<start:int,kind:int,end:int>>)"
    fold = f"aggregate(sequence(0, size(m) - 1), struct(0 AS at, {none} AS found), {step}, s -> s.found)"
    body = bind(matches, "m", bind(kept, "n", bind(f"split(text, {p}, -1)", "g", f"CASE WHEN size(m) = 0 THEN {none} ELSE {fold} END")))
    return F.expr(f"CASE WHEN text rlike {_quoted(guard)} THEN {body} ELSE {none} END")


def _upper_tail(z: str) -> str:
    """P(Z > z) of the normal distribution for z >= 0 (published rational approximation)."""
    # Coefficients of the approximation.
    t = f"(1 / (1 + 0.2316419 * {z}))"
    series = f"{t} * (0.319381530 + {t} * (-0.356563782 + {t} * (1.781477937 + {t} * (-1.821255978 + {t} * 1.330274429))))"
    return f"(0.3989422804014327 * exp(-{z} * {z} / 2) * {series})"


def _step() -> str:
    """-log10 of a token's p-value in tenths, from its symbols ``y``, alphabet size ``k``, the
    digits' flags ``f`` and the pooled parts ``w`` of the alphabet (share, times seen)."""
    n = "size(y)"
    chi = (
        f"(k / {n} * aggregate(transform(array_distinct(y), c -> size(filter(y, d -> d = c))), 0D, (s, o) -> s + o * o) - {n})"
    )
    chi_z = f"(({chi} - (k - 1)) / sqrt(2D * (k - 1) * ({n} - 1) / {n}))"
    high = "aggregate(y, 0, (s, d) -> s + int(2 * d >= k))"
    digit_runs = f"aggregate(sequence(1, {n} - 1), 1, (s, i) -> s + int(f[i] <> f[i - 1]))"
    digits = "aggregate(f, 0, (s, d) -> s + d)"
    digit_mean = f"(1 + 2D * fd * ({n} - fd) / {n})"
    digit_spread = f"((({digit_mean} - 1) * ({digit_mean} - 2)) / ({n} - 1))"
    digit_z = bind(digits, "fd", f"CASE WHEN {digit_spread} <= 0 THEN 0D ELSE greatest(0D, ({digit_mean} - {digit_runs}) / sqrt({digit_spread})) END")
    pooled = f"({n} * (aggregate(w, 0D, (s, e) -> s + e.seen * e.seen / ({n} * {n} * e.share)) - 1))"
    runs = f"aggregate(sequence(1, {n} - 1), 1, (s, i) -> s + int((2 * y[i] >= k) <> (2 * y[i - 1] >= k)))"
    mean = f"(1 + 2D * hi * ({n} - hi) / {n})"
    spread = f"((({mean} - 1) * ({mean} - 2)) / ({n} - 1))"
    # one side only: no run test, but then the other tests see a token that uses half the alphabet
    runs_z = bind(high, "hi", f"CASE WHEN hi IN (0, {n}) OR {spread} <= 0 THEN 40D ELSE abs({runs} - {mean}) / sqrt({spread}) END")
    total = "aggregate(y, 0D, (s, d) -> s + d)"
    squares = "aggregate(y, 0D, (s, d) -> s + d * d)"
    lagged = f"aggregate(sequence(1, {n} - 1), 0D, (s, i) -> s + y[i] * y[i - 1])"
    var = f"({squares} - {total} * {total} / {n})"
    centred = f"({lagged} - {total} / {n} * (2 * {total} - y[0] - y[{n} - 1]) + ({n} - 1) * {total} * {total} / {n} / {n})"
    serial_z = f"CASE WHEN {var} <= 0 THEN 40D ELSE abs({centred} / {var} + 1D / {n}) * sqrt({n}) END"
    # with two degrees of freedom a chi-squared tail is exp(-x / 2)
    tails = [_upper_tail("z[0]"), *(f"2 * {_upper_tail(f'z[{i}]')}" for i in (1, 2)), _upper_tail("z[3]"), "exp(-z[4] / 2)"]
    capped = f"least({STEPS}, int(floor(-10 * log10(greatest(1e-40D, least(1D, {len(tails)} * least({', '.join(tails)})))))))"
    return bind(f"array(greatest(0D, {chi_z}), {runs_z}, {serial_z}, {digit_z}, greatest(0D, {pooled}))", "z", capped)


def _candidates(docs: DataFrame) -> DataFrame:
    """``docs`` with ``tokens``: array<struct<start, end, band, step>> of the tokens in an encoding."""
    marked = F.expr(
        "transform(long, s -> struct(s.start AS start, s.end AS end, substring(text, s.start + 1, s.end - s.start) AS token))"
    )
    encoding = (
        "CASE WHEN NOT t.token rlike '[0-9]' AND NOT t.token rlike '[a-z].*[A-Z]|[A-Z].*[a-z]' THEN NULL "
        "WHEN t.token rlike '^([0-9a-f]+|[0-9A-F]+)$' AND t.token rlike '[a-fA-F]' THEN 16 "
        "WHEN t.token rlike '^([A-Z2-7]+|[a-z2-7]+)$' THEN 32 WHEN t.token rlike '^([A-Z0-9]+|[a-z0-9]+)$' AND t.token rlike '[A-Za-z]' THEN 36 "
        "WHEN t.token rlike '[a-z]' AND t.token rlike '[A-Z]' THEN 64 END"
    )
    signs = "split(CASE k WHEN 64 THEN translate(t.token, '-_', '+/') ELSE upper(t.token) END, '')"
    alphabet = f"CASE k WHEN 16 THEN '{_HEX_SYMBOLS.upper()}' WHEN 32 THEN '{_BASE32_SYMBOLS}' WHEN 36 THEN '{_BASE36_SYMBOLS}' ELSE '{_BASE64_SYMBOLS}' END"
    symbols = f"transform(x, c -> instr({alphabet}, c) - 1)"
    flags = "transform(x, c -> int(c >= '0' AND c <= '9'))"

    def left(signs: str) -> str:
        return f"length(regexp_replace(t.token, '[{signs}]', ''))"

    def part(share: str, seen: str) -> str:
        return f"named_struct('share', {share}, 'seen', double({seen}))"

    n = "length(t.token)"
    digits, vowels, upper, lower = (f"({n} - {left(x)})" for x in ("0-9", "AEIOUaeiou", "A-Z", "a-z"))
    parts = (
        f"CASE k WHEN 16 THEN array({part('10D / 16', digits)}, {part('6D / 16', left('0-9'))}) "
        f"WHEN 64 THEN array({part('26D / 64', upper)}, {part('26D / 64', lower)}, {part('12D / 64', left('A-Za-z'))}) "
        f"ELSE array({part('5D / k', vowels)}, {part('21D / k', f'({left("0-9")} - {vowels})')}, {part('(k - 26D) / k', digits)}) END"
    )
    wordy = f"k = 64 AND length(regexp_replace(t.token, '[A-Z]?[a-z]{{3,}}|[A-Z][a-z]{{2}}', '')) <= {1 - WORDS} * {n}"
    step = bind(flags, "f", bind(parts, "w", f"CASE WHEN {wordy} THEN {STEPS} ELSE {_step()} END"))
    scored = bind(signs, "x", bind(symbols, "y", f"struct(t.start AS start, t.end AS end, int(floor(log2(size(y)))) AS band, {step} AS step)"))
    tested = f"filter(transform(named, t -> {bind(encoding, 'k', f'CASE WHEN k IS NOT NULL THEN {scored} END')}), x -> x IS NOT NULL)"
    frame = docs.withColumn("long", _spans(3, TOKEN, 0, LEAST_TOKEN, TOKEN))
    return frame.withColumn("named", marked).withColumn("tokens", F.expr(tested)).drop("long", "named")


def _structured(tokens: DataFrame) -> dict[int, int]:
    """Per length band the least step that Benjamini-Hochberg rejects as not random."""
    counted = tokens.groupBy("band", "step").agg(F.count("*").alias("n"))
    # at most 30 bands of STEPS rows, whatever the number of tokens
    ranked = counted.withColumns(
        {
            "above": F.expr("sum(n) OVER (PARTITION BY band ORDER BY step DESC)"),
            "all": F.expr("sum(n) OVER (PARTITION BY band)"),
        }
    )
    kept = ranked.where(F.pow(10.0, -F.col("step") / 10.0) <= F.lit(FALSE_DISCOVERY) * F.col("above") / F.col("all"))
    return {r.band: r.least for r in kept.groupBy("band").agg(F.min("step").alias("least")).collect()}


def _with_found(frame: DataFrame) -> DataFrame:
    """``frame`` (text, never NULL, and others) with ``found``: all spans of the row's text; without ``text``."""
    others = [c for c in frame.columns if c != "text"]
    frame = frame.withColumn(
        "base",
        F.concat(
            _spans(0, ASSIGN, 2, 6, "[:=]\\x20*[\"']?[A-Za-z0-9+/_.=-]{6}"),
            _spans(1, ACCESS, 0, 20, "AKIA[A-Z0-9]{16}"),
            _spans(2, "[0-9a-f]{24,}", 0, 24, "[0-9a-f]{24}"),
        ),
    )
    frame = durable(_candidates(frame).select(*others, "base", "tokens"))
    least = _structured(frame.select(F.explode("tokens").alias("t")).select("t.band", "t.step"))
    always = int(math.ceil(-10 * math.log10(LEVEL)))
    limit = "CASE t.band " + " ".join(f"WHEN {b} THEN {min(s, always)}" for b, s in sorted(least.items())) + f" ELSE {always} END" if least else f"{always}"
    random = (
        f"transform(filter(tokens, t -> t.step < {limit} AND NOT exists(base, b -> b.start < t.end AND t.start < b.end)), "
        "t -> struct(t.start AS start, 3 AS kind, t.end AS end))"
    )
    return frame.select(*others, F.expr(f"array_sort(concat(base, {random}))").alias("found"))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id and ``found``: array<struct<start, kind, end>> of all spans by start, then kind (index in KINDS)."""
    return _with_found(docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")))


def _listed(spans: str) -> str:
    kinds = ", ".join(f"'{k}'" for k in KINDS)
    return f"array_join(transform({spans}, s -> concat(array({kinds})[s.kind], ':', s.start, ':', s.end)), ',')"


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random of every document."""
    counted = {
        f"n_{kind}": F.expr(f"bigint(size(filter(found, s -> s.kind = {number})))") for number, kind in enumerate(KINDS)
    }
    frame = scan(docs).withColumns(counted)
    return frame.select(
        "doc_id",
        "n_assign",
        "n_access",
        "n_hex",
        F.sha2(F.expr(_listed("filter(found, s -> s.kind < 3)")), 256).alias("base_sha256"),
        F.expr(_listed("found")).alias("spans"),
        "n_random",
    )


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span (overlapping ones as one) replaced by ``mark``; other columns stay.

    Each row is masked by its own spans; a row without spans is returned as it is.
    """
    step = (
        "(s, x) -> struct(greatest(s.at, x.end) AS at, CASE WHEN x.start < s.at THEN s.out "
        f"ELSE array_append(array_append(s.out, substring(row.text, s.at + 1, x.start - s.at)), '{mark}') END AS out)"
    )
    none = "CAST(array() AS array<string>)"
    cut = f"aggregate(found, struct(0 AS at, {none} AS out), {step}, s -> concat(array_join(s.out, ''), substring(row.text, s.at + 1)))"
    rows = docs.withColumn("text", F.col("text").cast("string"))
    packed = rows.select(F.struct(*docs.columns).alias("row"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    text = F.expr(f"CASE WHEN size(found) = 0 THEN row.text ELSE {cut} END")
    found = _with_found(packed)
    return found.select(*[text.alias(c) if c == "text" else F.col("row")[c].alias(c) for c in docs.columns])
