"""Value counts in long form, and cumulative sums that never need one task.

Almost every metric reduces to ``(column, value) -> count``.  Counting first
means a value held by a third of all rows is one row per map task before the
shuffle, so hot values cannot create hot partitions downstream.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from twinlens.model import is_integer
from twinlens.functions.values import text_key
from twinlens.session import durable


def long_cells(df: DataFrame, cells: dict[str, Column], ids: Iterable[str] = ()) -> DataFrame:
    """Unpivot the given expressions to ``(*ids, column, value)`` in one pass."""
    ids = list(ids)
    wide = df.select(*ids, *[expr.alias(name) for name, expr in cells.items()])
    return wide.unpivot(ids, list(cells), "column", "value")


def _count_cells(df: DataFrame, cells: dict[str, Column]) -> DataFrame:
    counted = long_cells(df, cells).groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    return counted.select("column", F.col("value").cast("string").alias("value"), "n")


def text_counts(df: DataFrame, columns: Iterable[str], digest: bool = True) -> DataFrame:
    """``(column, value: string, n)``; NULL is kept as a value.

    Long texts appear as digests unless ``digest`` is off, which callers need
    that use the values themselves and not only their counts.
    Numbers are counted as numbers and spelled out once per distinct value, which
    is far cheaper than turning every cell into text first.
    """
    whole, real, text = {}, {}, {}
    for c in columns:
        if is_integer(df, c):
            whole[c] = F.col(c).cast("bigint")
        elif isinstance(df.schema[c].dataType, T.DoubleType):
            real[c] = F.col(c)
        else:
            text[c] = text_key(df, c) if digest else F.col(c).cast("string")
    return reduce(DataFrame.union, [_count_cells(df, cells) for cells in (whole, real, text) if cells])


def ordered_runs(counts: DataFrame, groups: list[str], order: str, measures: list[str]) -> DataFrame:
    """Split each group into contiguous value ranges and accumulate inside them.

    Adds ``run`` (the range a row fell into) and ``cum_<measure>`` (inclusive
    running sum within group and run).  Ranges come from a range partitioning,
    so even one group with billions of distinct values is spread over all
    tasks.  Callers reduce each run to one row and carry totals across the runs
    (there are no more runs than shuffle partitions).  The ranges only steer the
    layout: results do not depend on where the cuts fall.
    """
    spark = counts.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = counts.repartitionByRange(parts, *groups, order).withColumn("run", F.spark_partition_id())
    window = (
        Window.partitionBy(*groups, "run")
        .orderBy(order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    sums = {f"cum_{m}": F.sum(m).over(window) for m in measures}
    return ranged.withColumns(sums)


def before_run(groups: list[str], measure: str, first: str = "run_first") -> Column:
    """Total of ``measure`` over all earlier runs of the same group (0 for the first)."""
    window = (
        Window.partitionBy(*groups).orderBy(first).rowsBetween(Window.unboundedPreceding, -1)
    )
    return F.coalesce(F.sum(measure).over(window), F.lit(0))


def sketched_distinct(column: str) -> Column:
    """Approximate distinct count (about 1% error) that never shuffles values."""
    return F.hll_sketch_estimate(F.hll_sketch_agg(F.col(column).cast("string"), 14))


def exact_percentiles(long: DataFrame, ids: list[str], fractions: list[float]) -> DataFrame:
    """Interpolated percentiles of ``value`` per group, as columns ``p0, p1, ...``.

    The built-in exact percentile keeps all distinct values of a group in one
    task.  Here values are counted, cut into ranges and ranked range by range;
    the ranges are written down once so that both readers see the same cuts.
    """
    filled = long.where(F.col("value").isNotNull())
    counts = filled.groupBy(*ids, "value").agg(F.count(F.lit(1)).alias("n"))
    runs = durable(ordered_runs(counts, ids, "value", ["n"]))
    sizes = runs.groupBy(*ids, "run").agg(F.min("value").alias("run_first"), F.sum("n").alias("run_n"))
    whole = Window.partitionBy(*ids)
    offsets = sizes.select(
        *ids, "run", before_run(ids, "run_n").alias("before"), F.sum("run_n").over(whole).alias("total")
    )
    # one row per group and range: at most columns x shuffle partitions
    ranked = runs.join(F.broadcast(offsets), [*ids, "run"])
    upto = F.col("before") + F.col("cum_n")
    picks = []
    for i, fraction in enumerate(fractions):
        place = F.lit(fraction) * (F.col("total") - 1)
        for side, rank in (("lo", F.floor(place)), ("hi", F.ceil(place))):
            here = (rank >= upto - F.col("n")) & (rank < upto)
            picks.append(F.max(F.when(here, F.col("value"))).alias(f"{side}{i}"))
        picks.append(F.max(place - F.floor(place)).alias(f"w{i}"))
    found = ranked.groupBy(*ids).agg(*picks)
    return found.select(
        *ids,
        *[
            (F.col(f"lo{i}") + (F.col(f"hi{i}") - F.col(f"lo{i}")) * F.col(f"w{i}")).alias(f"p{i}")
            for i in range(len(fractions))
        ],
    )
