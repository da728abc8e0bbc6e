"""Fidelity: marginals, pairwise trends and the quality report.

All copies are compared in one pass: rows are tagged with their source, counted
once, and every copy becomes one more counter column next to the real one.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial, reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinlens.functions.values import numeric_or_epoch
from twinlens.operators.counting import before_run, long_cells, ordered_runs
from twinlens.session import durable

REAL = "real"
_BINS = 10
_CELLS_HELD = 1_000_000  # counted cells of column pairs that a task holds: 7 numbers each
_PAIRS_PER_PASS = 300  # keeps one aggregate inside a compilable method


def tag_sources(real: DataFrame, copies: dict[str, DataFrame], columns: list[str]) -> DataFrame:
    """Stack real and copies as ``(source, *columns)`` with the real column types."""
    frames = [real.select(F.lit(REAL).alias("source"), *columns)]
    for name, copy in copies.items():
        aligned = [
            F.col(c) if copy.schema[c].dataType == real.schema[c].dataType
            else F.col(c).try_cast(real.schema[c].dataType).alias(c)
            for c in columns
        ]
        frames.append(copy.select(F.lit(name).alias("source"), *aligned))
    return reduce(DataFrame.union, frames)


def _counters(sources: list[str], weight: str | None = None) -> list[Column]:
    """One conditional count (or sum of ``weight``) per source, named n_0 (real), n_1, n_2, ..."""
    if weight:
        counts = [F.sum(F.when(F.col("source") == s, F.col(weight)).otherwise(0)) for s in sources]
    else:
        counts = [F.count_if(F.col("source") == s) for s in sources]
    return [n.alias(f"n_{i}") for i, n in enumerate(counts)]


def _per_copy(wide: DataFrame, names: list[str], ids: list[str]) -> DataFrame:
    """Turn score columns s_1.. of the copies into rows ``(synth, *ids, score)``."""
    rows = F.array(
        *[F.struct(F.lit(n).alias("synth"), F.col(f"s_{i}").alias("score")) for i, n in enumerate(names, 1)]
    )
    return wide.select(*ids, F.inline(rows)).select("synth", *ids, "score")


def ks_complement(
    real: DataFrame, copies: dict[str, DataFrame], columns: list[str], grid: int | None = None
) -> DataFrame:
    """1 - sup|F_real - F_copy| per numeric or date column, NULLs dropped.

    Exact by default.  ``grid`` first maps values to that many quantile cells of
    the real column, which bounds the distinct values (and makes the result a
    lower-resolution statistic).
    """
    names = list(copies)
    tagged = tag_sources(real, copies, columns)
    cells = {c: numeric_or_epoch(tagged, c) for c in columns}
    if grid:
        cuts = _quantile_cuts(real, columns, grid)
        cells = {c: _grid_cell(expr, cuts[c]) for c, expr in cells.items()}
    long = long_cells(tagged, cells, ["source"]).where(F.col("value").isNotNull())
    return ks_from_cells(long, names, ["column"])


def _quantile_cuts(real: DataFrame, columns: list[str], grid: int) -> dict[str, list[float]]:
    """Inner quantiles per real column: ``grid - 1`` numbers each on the driver."""
    steps = F.lit([i / grid for i in range(1, grid)])
    row = real.agg(*[F.percentile_approx(numeric_or_epoch(real, c), steps, 10 * grid).alias(c) for c in columns]).first()
    return {c: row[c] or [] for c in columns}


def _grid_cell(value: Column, cuts: list[float]) -> Column:
    below = F.filter(F.lit(cuts).cast("array<double>"), lambda cut: cut < value)
    return F.when(value.isNotNull(), F.size(below).cast("double"))


def ks_from_cells(long: DataFrame, names: list[str], ids: list[str]) -> DataFrame:
    """KS complement from rows ``(source, *ids, value)``, per copy and id."""
    sources = [REAL, *names]
    counts = durable(long.groupBy(*ids, "value").agg(*_counters(sources)))  # read for totals and for ranges
    totals = counts.groupBy(*ids).agg(*[F.sum(f"n_{i}").alias(f"t_{i}") for i in range(len(sources))])
    runs = ordered_runs(counts, ids, "value", [f"n_{i}" for i in range(len(sources))])
    # totals hold one row per column of the table, so the broadcast is bounded by the schema
    runs = runs.join(F.broadcast(totals), ids)
    share = {i: F.try_divide(f"cum_n_{i}", f"t_{i}") for i in range(len(sources))}
    aggregates = [F.min("value").alias("run_first")]
    for i in range(1, len(sources)):
        gap = share[0] - share[i]
        aggregates += [F.max(gap).alias(f"hi_{i}"), F.min(gap).alias(f"lo_{i}")]
    for i in range(len(sources)):
        aggregates += [F.sum(f"n_{i}").alias(f"n_{i}"), F.first(f"t_{i}").alias(f"t_{i}")]
    per_run = runs.groupBy(*ids, "run").agg(*aggregates)
    carry = {i: F.try_divide(before_run(ids, f"n_{i}"), F.col(f"t_{i}")) for i in range(len(sources))}
    shifted = per_run.select(
        *ids, *[F.col(f"{x}_{i}") + (carry[0] - carry[i]) for i in range(1, len(sources)) for x in ("hi", "lo")]
    ).toDF(*ids, *[f"{x}_{i}" for i in range(1, len(sources)) for x in ("hi", "lo")])
    scores = shifted.groupBy(*ids).agg(
        *[
            (1 - F.max(F.greatest(F.abs(f"hi_{i}"), F.abs(f"lo_{i}")))).alias(f"s_{i}")
            for i in range(1, len(sources))
        ]
    )
    return _per_copy(scores, names, ids)


def tv_complement(real: DataFrame, copies: dict[str, DataFrame], columns: list[str]) -> DataFrame:
    """1 - half the L1 distance of the category shares; NULL is a category."""
    names = list(copies)
    tagged = tag_sources(real, copies, columns)
    long = long_cells(tagged, {c: F.col(c).cast("string") for c in columns}, ["source"])
    return tv_from_cells(long, names, ["column"], ["value"])


def tv_from_cells(
    long: DataFrame, names: list[str], ids: list[str], values: list[str], weight: str | None = None
) -> DataFrame:
    sources = [REAL, *names]
    counts = durable(long.groupBy(*ids, *values).agg(*_counters(sources, weight)))  # read twice
    totals = counts.groupBy(*ids).agg(*[F.sum(f"n_{i}").alias(f"t_{i}") for i in range(len(sources))])
    joined = counts.join(F.broadcast(totals), ids)  # one row per column or column pair
    gaps = [
        (1 - F.sum(F.abs(F.try_divide("n_0", "t_0") - F.try_divide(f"n_{i}", f"t_{i}"))) / 2).alias(f"s_{i}")
        for i in range(1, len(sources))
    ]
    return _per_copy(joined.groupBy(*ids).agg(*gaps), names, ids)


def column_shapes(
    real: DataFrame, copies: dict[str, DataFrame], numeric: list[str], categorical: list[str]
) -> DataFrame:
    """``(synth, column, metric, score)`` over all scored columns."""
    parts = []
    if numeric:
        parts.append(ks_complement(real, copies, numeric).withColumn("metric", F.lit("KSComplement")))
    if categorical:
        parts.append(tv_complement(real, copies, categorical).withColumn("metric", F.lit("TVComplement")))
    return reduce(DataFrame.union, parts).select("synth", "column", "metric", "score")


def _pearson(a: str, b: str) -> Column:
    """Correlation over complete pairs, NULL for a constant side (``corr`` would fail)."""
    x = F.when(F.col(b).isNotNull(), F.col(a))
    y = F.when(F.col(a).isNotNull(), F.col(b))
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def correlations(tagged: DataFrame, columns: list[str]) -> DataFrame:
    """Pearson correlation of every column pair: ``(source, column_1, column_2, rho)``.

    Pairwise-complete; NULL where undefined.  One aggregate pass with a handful
    of running moments per pair, so only ``pairs x sources`` rows are shuffled.
    """
    numbers = tagged.select("source", *[numeric_or_epoch(tagged, c).alias(c) for c in columns])
    pairs = list(combinations(columns, 2))
    parts = []
    for start in range(0, len(pairs), _PAIRS_PER_PASS):
        chunk = pairs[start : start + _PAIRS_PER_PASS]
        wide = numbers.groupBy("source").agg(*[_pearson(a, b).alias(f"p{i}") for i, (a, b) in enumerate(chunk)])
        rows = [
            F.struct(F.lit(a).alias("column_1"), F.lit(b).alias("column_2"), F.col(f"p{i}").alias("rho"))
            for i, (a, b) in enumerate(chunk)
        ]
        parts.append(wide.select("source", F.inline(F.array(*rows))))
    rho = F.nanvl("rho", F.lit(None).cast("double")).alias("rho")
    return reduce(DataFrame.union, parts).select("source", "column_1", "column_2", rho)


def correlation_similarity(real: DataFrame, copies: dict[str, DataFrame], columns: list[str]) -> DataFrame:
    """1 - |rho_real - rho_copy| / 2 for each numeric pair."""
    rho = correlations(tag_sources(real, copies, columns), columns)
    base = rho.where(F.col("source") == REAL).select("column_1", "column_2", F.col("rho").alias("rho_real"))
    other = rho.where(F.col("source") != REAL).withColumnRenamed("source", "synth")
    score = (1 - F.abs(F.col("rho_real") - F.col("rho")) / 2).alias("score")
    return other.join(base, ["column_1", "column_2"]).select("synth", "column_1", "column_2", score)


def _real_bounds(real: DataFrame, numeric: list[str]) -> Column:
    bounds = []
    for c in numeric:
        value = numeric_or_epoch(real, c)
        bounds += [F.min(value).alias(f"lo_{c}"), F.max(value).alias(f"hi_{c}")]
    return real.agg(F.struct(*bounds)).scalar()


def bin_of(value: Column, low: Column, high: Column, bins: Column) -> Column:
    """Equal-width bin 0..bins-1 over low..high; outside values go to the edge bins."""
    raw = F.floor(F.try_divide(value - low, high - low) * bins)
    clamped = F.least(F.greatest(raw, F.lit(0)), bins - 1)
    return F.when(value.isNotNull(), F.when(high > low, clamped).otherwise(F.lit(0))).cast("int")


def _pair_counter(batches: Iterator[pa.RecordBatch], pairs: list[tuple[int, int]]) -> Iterator[pa.RecordBatch]:
    """Counts of ``(source, pair, a, b)`` over a task's rows; columns are 64-bit codes, NULL included.

    Each column of a batch is numbered once, so a pair is one number per row and its
    counts are one tally. Tallies are merged as they grow and handed on when they
    outgrow ``_CELLS_HELD``.
    """
    kept: list[np.ndarray] = []

    def merged() -> np.ndarray:
        rows = np.concatenate(kept)
        order = np.lexsort(rows[:, :6].T[::-1])
        rows = rows[order]
        first = np.flatnonzero(np.append(True, (rows[1:, :6] != rows[:-1, :6]).any(1)))
        out = rows[first]
        out[:, 6] = np.add.reduceat(rows[:, 6], first)
        return out

    def batch_of(rows: np.ndarray) -> pa.RecordBatch:
        sides = [pa.array(rows[:, k], mask=rows[:, k + 2] == 1) for k in (2, 3)]
        numbers = [pa.array(rows[:, k]) for k in (0, 1)]
        return pa.RecordBatch.from_arrays([*numbers, *sides, pa.array(rows[:, 6])], ["source", "pair", "a", "b", "n"])

    for batch in batches:
        if not batch.num_rows:
            continue
        codes, names = [], []
        for column in batch.columns:
            values, which = np.unique(np.asarray(column.fill_null(0)), return_inverse=True)
            # a NULL is told apart from every code by its own flag
            which[np.asarray(column.is_null())] = len(values)
            codes.append(which)
            names.append((np.append(values, 0), np.append(np.zeros(len(values), np.int64), 1)))
        for number, (i, j) in enumerate(pairs):
            width = len(names[i + 1][0]), len(names[j + 1][0])
            cell = (codes[0] * width[0] + codes[i + 1]) * width[1] + codes[j + 1]
            found, n = np.unique(cell, return_counts=True)
            b, rest = found % width[1], found // width[1]
            a, source = rest % width[0], rest // width[0]
            kept.append(np.column_stack([
                names[0][0][source], np.full(len(found), number), names[i + 1][0][a], names[j + 1][0][b],
                names[i + 1][1][a], names[j + 1][1][b], n,
            ]))
        if sum(map(len, kept)) > _CELLS_HELD:
            kept[:] = [merged()]
            if len(kept[0]) > _CELLS_HELD // 2:
                yield batch_of(kept.pop())
    if kept:
        yield batch_of(merged())


def contingency_similarity(
    real: DataFrame,
    copies: dict[str, DataFrame],
    pairs: list[tuple[str, str]],
    numeric: list[str],
) -> DataFrame:
    """1 - half the L1 distance of the joint shares; numeric sides cut into 10 bins.

    The bins span the real minimum to maximum. Cells are numbers (bin or 64-bit hash of
    the category) and each task tallies all its pairs: rows times pairs exist nowhere,
    only counted cells are shuffled.
    """
    columns = sorted({c for pair in pairs for c in pair})
    tagged = tag_sources(real, copies, columns)
    binned = [c for c in columns if c in numeric]
    labels = tagged
    if binned:
        bounds = _real_bounds(real, binned)
        labels = tagged.withColumn("__bounds", bounds)
    cells = []
    for c in columns:
        if c in binned:
            low, high = F.col("__bounds")[f"lo_{c}"], F.col("__bounds")[f"hi_{c}"]
            cells.append(bin_of(numeric_or_epoch(tagged, c), low, high, F.lit(_BINS)).cast("bigint").alias(c))
        else:
            cells.append(F.when(F.col(c).isNotNull(), F.xxhash64(F.col(c).cast("string"))).alias(c))
    sources = [REAL, *copies]
    number = (F.array_position(F.lit(sources), F.col("source")) - 1).cast("bigint")
    places = [(columns.index(a), columns.index(b)) for a, b in pairs]
    counter = partial(_pair_counter, pairs=places)
    tallies = labels.select(number.alias("source"), *cells).mapInArrow(counter, "source long, pair long, a long, b long, n long")
    long = tallies.select(F.get(F.lit(sources), F.col("source").cast("int")).alias("source"), F.col("pair").cast("int").alias("pair"), "a", "b", "n")
    scores = tv_from_cells(long, list(copies), ["pair"], ["a", "b"], "n")
    names = F.lit([a for a, _ in pairs]), F.lit([b for _, b in pairs])
    named = [F.get(n, "pair").alias(f"column_{k}") for k, n in enumerate(names, 1)]
    return scores.select("synth", *named, "score")


def column_pair_trends(
    real: DataFrame, copies: dict[str, DataFrame], numeric: list[str], categorical: list[str]
) -> DataFrame:
    """``(synth, column_1, column_2, metric, score)`` for every column pair."""
    parts = []
    if len(numeric) > 1:
        scored = correlation_similarity(real, copies, numeric)
        parts.append(scored.withColumn("metric", F.lit("CorrelationSimilarity")))
    mixed = [p for p in combinations([*numeric, *categorical], 2) if not set(p) <= set(numeric)]
    if mixed:
        scored = contingency_similarity(real, copies, mixed, numeric)
        parts.append(scored.withColumn("metric", F.lit("ContingencySimilarity")))
    if not parts:
        return real.sparkSession.createDataFrame(
            [], "synth string, column_1 string, column_2 string, metric string, score double"
        )
    return reduce(DataFrame.union, parts).select("synth", "column_1", "column_2", "metric", "score")


def pair_trend_details(trends: DataFrame, limit: int = 60) -> DataFrame:
    """The first pairs per copy, in column order (the report's detail table)."""
    from pyspark.sql import Window

    order = Window.partitionBy("synth").orderBy("column_1", "column_2")
    ranked = trends.withColumn("__rank", F.row_number().over(order))
    return ranked.where(F.col("__rank") <= limit).drop("__rank")


def quality_report(shapes: DataFrame, trends: DataFrame) -> DataFrame:
    """``(synth, column_shapes, column_pair_trends, overall)`` from the two properties."""
    a = shapes.groupBy("synth").agg(F.avg("score").alias("column_shapes"))
    b = trends.groupBy("synth").agg(F.avg("score").alias("column_pair_trends"))
    both = F.array("column_shapes", "column_pair_trends")
    return a.join(b, "synth", "left").withColumn("overall", mean_of(both))


def mean_of(values: Column) -> Column:
    """Mean of an array's usable entries (NULL and NaN skipped), NULL if none."""
    usable = F.filter(values, lambda v: v.isNotNull() & ~F.isnan(v))
    total = F.aggregate(usable, F.lit(0.0), lambda acc, v: acc + v)
    return F.when(F.size(usable) > 0, total / F.size(usable))


# ---- report matrices -------------------------------------------------------


def quality_matrix(quality: DataFrame, tables: list[str]) -> DataFrame:
    """``(metric, synth, <table>...)`` from ``(synth, table, overall, ...)`` rows."""
    metrics = ["overall", "column_shapes", "column_pair_trends"]
    long = quality.unpivot(["synth", "table"], metrics, "metric", "score")
    return long.groupBy("metric", "synth").pivot("table", tables).agg(F.first("score"))


def shapes_matrix(shapes: DataFrame, columns: list[str]) -> DataFrame:
    """One row per copy, one score column per data column."""
    return shapes.groupBy("synth").pivot("column", columns).agg(F.first("score"))


def pair_trends_matrix(trends: DataFrame, columns: list[str]) -> DataFrame:
    """Symmetric column-by-column scores per copy with a unit diagonal.

    Columns without any scored pair are left out, and a copy with fewer than two
    scored columns has no matrix.
    """
    scored = trends.where(F.col("score").isNotNull()).select("synth", "column_1", "column_2", "score")
    both = scored.union(scored.select("synth", "column_2", "column_1", "score"))
    diagonal = both.select("synth", "column_1").distinct().select(
        "synth", "column_1", F.col("column_1").alias("column_2"), F.lit(1.0).alias("score")
    )
    cells = both.union(diagonal).withColumnRenamed("column_1", "column")
    return cells.groupBy("synth", "column").pivot("column_2", columns).agg(F.first("score"))
