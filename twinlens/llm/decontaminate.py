"""Benchmark decontamination with spaced seeds, in DataFrame functions only.

A *mask* selects some positions of a word window and ignores the others, so a seed
still matches when ignored words were substituted. Seeds of the benchmark and of the
training texts meet by hash; each hit fixes a benchmark item and a *diagonal* (text
position minus item position). On that diagonal the words of item and text are
compared one by one: +1 for an equal word, -``PENALTY`` for a substituted one. The
best run must reach ``ENOUGH`` (or the item's length, if that is less), or the equal words
on the diagonal must be at least ``SHARE`` percent of the item's.

Items of up to ``SHORT`` words have seeds of their own length: one for each block of words
left out, so that a replaced word anywhere in the item leaves a seed whole. Items of fewer
than ``SUBSTITUTED`` words say nothing inside a text; they match a text that is nothing else.

A text is compared on every diagonal with the item's stretch of it alone, so work and
memory grow with its length even if all its words are the same.

Rows: NULL texts and texts without words are clean; items without words are never matched;
repeated rows are judged alike; of rows with one ``doc_id`` and different texts, one that
matches marks all; rows without ``doc_id`` can't be named and count as clean; very long
texts are judged whole; an empty table gives no rows; columns other than doc_id / item_id
and text are ignored. Words are split at ``\\x20 \\x09-\\x0D`` and A-Z are lower-cased.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinlens.llm.quality_rules import bind, words
from twinlens.session import durable

# Which words of a window count.
MASKS = ("110110101", "1110010111")
LEAST_WORDS = 8  # of the SQL twin, which knows no shorter items
PENALTY = 2
ENOUGH = 12
SHARE = 80
SHORT = 14
SUBSTITUTED = 5
LITERALS = 50_000  # seeds tested inside each text; more of them join by shuffle
BROADCAST_ROWS = 200_000  # seeds, or (text, item, diagonal) rows; above it joins shuffle

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _worded(frame: DataFrame, key: str) -> DataFrame:
    text = F.translate(F.coalesce(F.col("text").cast("string"), F.lit("")), _UPPER, _LOWER)
    return frame.select(F.col(key), text.alias("text")).select(key, words().alias("words"))


def _unfit(mask: str) -> str:
    """SQL: no window of the words ``v`` is looked up by the mask."""
    return f"size(v) {'<' if len(mask) >= SUBSTITUTED else '<>'} {len(mask)}"


def _seed_sql(masks: list[str]) -> str:
    """array<struct<hash, place, mask>> of all masked windows of ``words``."""
    parts = []
    for number, mask in enumerate(masks):
        picked = ", ".join(f"v[i + {k}]" for k, one in enumerate(mask) if one == "1")
        parts.append(
            f"CASE WHEN {_unfit(mask)} THEN array() ELSE "
            f"transform(sequence(0, size(v) - {len(mask)}), i -> struct(xxhash64({number}, {picked}) AS hash, i AS place, {number} AS mask)) END"
        )
    hashed = "transform(words, w -> xxhash64(w))"
    return bind(hashed, "v", f"concat({', '.join(parts)})")


def _kept_sql(masks: list[str], known: dict[int, str]) -> str:
    """As above, but only seeds whose hash is in the mask's literal list ``known``."""
    parts = []
    for number, mask in enumerate(masks):
        if number not in known:
            continue
        picked = ", ".join(f"v[i + {k}]" for k, one in enumerate(mask) if one == "1")
        hashes = f"transform(sequence(0, size(v) - {len(mask)}), i -> xxhash64({number}, {picked}))"
        hit = f"transform(h, (x, i) -> CASE WHEN x IN ({known[number]}) THEN struct(x AS hash, i AS place) END)"
        parts.append(f"CASE WHEN {_unfit(mask)} THEN array() ELSE filter({bind(hashes, 'h', hit)}, s -> s IS NOT NULL) END")
    return bind("transform(words, w -> xxhash64(w))", "v", f"concat({', '.join(parts)})")


def _short_masks(n: int) -> list[str]:
    """Seeds of an item of ``n`` words: whole, or without one of the blocks that cover it."""
    if n < SUBSTITUTED:
        return ["1" * n]
    block = max(1, n // 3 if n > 8 else n // 4)
    return ["".join("0" if a <= i < a + block else "1" for i in range(n)) for a in range(0, n, block)]


def _few(df: DataFrame) -> DataFrame:
    """Broadcast below a counted bound; otherwise left to a shuffle join."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def overlaps(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, score, matched: verified overlaps of texts with benchmark items."""
    items = durable(_worded(benchmark, "item_id").where(F.size("words") > 0).distinct())
    lengths = items.where(F.size("words") <= SHORT).select(F.size("words").alias("n")).distinct()
    short = sorted(r.n for r in lengths.collect())  # at most SHORT lengths
    masks = [*MASKS, *(m for n in short for m in _short_masks(n))]
    seeds = items.select("item_id", F.size("words").alias("n"), F.explode(F.expr(_seed_sql(masks))).alias("s"))
    # the seeds of a short length come from items of that length alone
    own = F.expr(f"CASE s.mask {' '.join(f'WHEN {k} THEN n = {len(m)}' for k, m in enumerate(masks) if k >= len(MASKS))} ELSE true END" if short else "true")
    seeds = durable(seeds.where(own).select("item_id", "s.hash", F.col("s.place").alias("at"), "s.mask").distinct())
    texts = _worded(docs, "doc_id")
    n_seeds = seeds.count()
    if n_seeds == 0:
        hits = texts.select("doc_id", F.expr("CAST(NULL AS struct<hash:bigint,place:int>)").alias("s")).where("false")
    elif n_seeds <= LITERALS:
        lists: dict[int, list[str]] = {}
        for r in seeds.select("mask", "hash").distinct().collect():  # LITERALS at most, over all masks
            lists.setdefault(r.mask, []).append(f"{r.hash}L" if r.hash != -(2**63) else "bigint(-9223372036854775808)")
        known = {mask: ",".join(hashes) for mask, hashes in lists.items()}
        hits = texts.select("doc_id", F.explode(F.expr(_kept_sql(masks, known))).alias("s"))
    else:
        hits = texts.select("doc_id", F.explode(F.expr(_seed_sql(masks))).alias("s"))
    hits = hits.select("doc_id", "s.hash", "s.place").join(_few(seeds.drop("mask")), "hash")
    lines = durable(hits.select("doc_id", "item_id", (F.col("place") - F.col("at")).alias("diagonal")).distinct())

    # every text once, with the diagonals to compare; each takes its own stretch of the text
    sizes = items.select("item_id", F.size("words").alias("n"))
    wanted = lines.join(_few(sizes), "item_id").groupBy("doc_id").agg(F.collect_list(F.struct("item_id", "diagonal", "n")).alias("lines"))
    stretch = (
        "transform(lines, l -> struct(l.item_id AS item_id, l.diagonal AS diagonal, "
        "slice(words, greatest(l.diagonal, 0) + 1, l.n + least(l.diagonal, 0)) AS said))"
    )
    met = texts.join(_few(wanted), "doc_id").select("doc_id", F.inline(F.expr(stretch)))
    met = met.join(_few(items.withColumnRenamed("words", "asked")), "item_id")
    aligned = "zip_with(said, slice(asked, greatest(-diagonal, 0) + 1, size(said)), (a, b) -> coalesce(a = b, false))"
    start = "struct(0 AS run, 0 AS n, 0 AS best, 0 AS matched)"
    # best run on the diagonal: its score and its number of equal words
    step = (
        f"(s, same) -> {bind(f'struct(CASE WHEN same THEN s.run + 1 ELSE s.run - {PENALTY} END AS run, s.n + int(same) AS n)', 'r', '''
        CASE WHEN r.run <= 0 THEN struct(0 AS run, 0 AS n, s.best AS best, s.matched AS matched)
             WHEN r.run > s.best THEN struct(r.run AS run, r.n AS n, r.run AS best, r.n AS matched)
             ELSE struct(r.run AS run, r.n AS n, s.best AS best, s.matched AS matched) END''')}"
    )
    found = met.withColumn("best", F.expr(f"aggregate({aligned}, {start}, {step})"))
    equal = F.expr(f"size(filter({aligned}, same -> same))")
    enough = F.col("best.best") >= F.least(F.lit(ENOUGH), F.size("asked"))
    found = found.where(enough | (100 * equal >= SHARE * F.size("asked")))
    return found.groupBy("doc_id", "item_id").agg(F.max("best.best").alias("score"), F.max("best.matched").alias("matched"))


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, contaminated, n_items (long), score (int, of the best overlap; 0 if clean) of every document."""
    per_doc = overlaps(docs, benchmark).groupBy("doc_id").agg(
        F.count("*").alias("n_items"), F.max("score").alias("score")
    )
    return docs.select("doc_id").join(per_doc, "doc_id", "left").select(
        "doc_id",
        F.col("n_items").isNotNull().alias("contaminated"),
        F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("score", F.lit(0)).cast("int").alias("score"),
    )
