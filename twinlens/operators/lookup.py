"""Counted value tables as number lines: from a position to its value, and back.

A column's distinct values, in text order with NULL last, lie one behind the other; each
covers as many positions as it has rows. Tables of any number of values stay in Spark.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twinlens.functions.values import LONG_TEXT
from twinlens.operators.counting import before_run, ordered_runs, text_counts
from twinlens.operators.skew import spread_join
from twinlens.session import durable

# value tables up to both limits may be handled on the spot; longer ones stay in Spark, with the same results
SHORT_VALUES = 1000
SHORT_LENGTH = 100_000
_HEAVY = 4096  # values with this share of a column's rows are broadcast: fewer than that many per column
_BUCKET_CELLS = 50_000  # positions asked for, or values, that one group of a task handles


def value_counts(df: DataFrame, columns: list[str], nulls: bool = True) -> DataFrame:
    """``(column, value, n)`` with whole texts, written once; without ``nulls`` missing values are left out."""
    counts = text_counts(df, columns, digest=False)
    return durable(counts if nulls else counts.where(F.col("value").isNotNull()))


def value_steps(counts: DataFrame) -> DataFrame:
    """``(column, value, start, n, place, total, values)`` of counted values, written once.

    ``start`` counts the rows of earlier values and ``place`` the earlier values;
    ``total`` are the column's rows and ``values`` its distinct values.
    """
    order = F.when(F.col("value").isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col("value")))
    counts = counts.withColumns({"order": order, "one": F.lit(1).cast("long")})
    runs = durable(ordered_runs(counts, ["column"], "order", ["n", "one"]))
    per_run = runs.groupBy("column", "run").agg(
        F.min("order").alias("run_first"), F.sum("n").alias("run_n"), F.sum("one").alias("run_one")
    )
    whole = Window.partitionBy("column")
    offsets = per_run.select(
        "column", "run", before_run(["column"], "run_n").alias("earlier_n"), before_run(["column"], "run_one").alias("earlier_one"),
        F.sum("run_n").over(whole).alias("total"), F.sum("run_one").over(whole).alias("values"),
    )
    # one row per column and range: at most columns x shuffle partitions
    found = runs.join(F.broadcast(offsets), ["column", "run"])
    start = F.col("earlier_n") + F.col("cum_n") - F.col("n")
    place = F.col("earlier_one") + F.col("cum_one") - 1
    return durable(found.select("column", "value", start.alias("start"), "n", place.alias("place"), "total", "values"))


def values_at(cells: DataFrame, steps: DataFrame, position: str = "at") -> DataFrame:
    """``cells`` (column, ``position``, ...) plus the ``value`` that covers each position.

    Both sides are cut into equal stretches of positions, a long step being repeated in
    every stretch it covers; inside a stretch the last step before a cell is its value.
    One shuffle, no matter how many columns and values; positions beyond a column's total
    have no value.
    """
    totals = steps.groupBy("column").agg(F.first("total").alias("total"), F.first("values").alias("values"))
    asked = cells.groupBy("column").agg(F.count(F.lit(1)).alias("asked"))
    most = F.greatest(F.col("values"), F.coalesce("asked", F.lit(0)))
    widths = durable(
        totals.join(asked, "column", "left").select(
            "column", F.greatest(F.lit(1), F.ceil(F.col("total") * _BUCKET_CELLS / most)).cast("long").alias("width")
        )
    )
    width = F.broadcast(widths)  # one row per column
    covered = F.sequence(F.floor(F.col("start") / F.col("width")), F.floor((F.col("start") + F.col("n") - 1) / F.col("width")))
    known = steps.join(width, "column").withColumn("__bucket", F.explode(covered)).select(
        "column", "__bucket", F.greatest("start", F.col("__bucket") * F.col("width")).alias(position),
        F.struct("value", (F.col("start") + F.col("n")).alias("end")).alias("__step"),
    )
    wanted = cells.join(width, "column").withColumn("__bucket", F.floor(F.col(position) / F.col("width"))).drop("width")
    rows = known.withColumn("__asked", F.lit(0)).unionByName(wanted.withColumn("__asked", F.lit(1)), allowMissingColumns=True)
    upto = Window.partitionBy("column", "__bucket").orderBy(position, "__asked").rowsBetween(Window.unboundedPreceding, 0)
    met = rows.withColumn("__last", F.last("__step", ignorenulls=True).over(upto)).where("__asked = 1")
    value = F.when(F.col(position) < F.col("__last.end"), F.col("__last.value"))
    return met.select(*cells.columns, value.alias("value"))


def _short(value: Column) -> Column:
    """Long texts as digests: join keys stay small."""
    return F.when(F.length(value) > LONG_TEXT, F.sha2(value, 256)).otherwise(value)


def values_to(df: DataFrame, steps: DataFrame, values: dict[str, tuple[str, Column]], answer: Column) -> DataFrame:
    """``df`` with a column of ``answer`` (an expression over ``steps``) for each column of ``values``.

    ``values`` maps the name of the new column to ``(column of steps, text)``. Frequent values
    are looked up where the rows are, from broadcast tables of bounded size. All other values
    of all columns are one exchange: cells meet their steps in a join that spreads hot keys,
    and the answers return to their rows. Values without a step, and NULL, have no answer.
    """
    names = list(values)
    rows = df.select("*", *[_short(text).alias(f"__key_{i}") for i, (_, text) in enumerate(values.values())])
    found = steps.select("column", _short(F.col("value")).alias("key"), answer.alias("answer"), (F.col("n") * _HEAVY > F.col("total")).alias("heavy"))
    found = durable(found)
    tails = {r["column"] for r in found.where("not heavy").select("column").distinct().collect()}  # one row per column
    for i, (column, _) in enumerate(values.values()):
        often = found.where((F.col("column") == column) & F.col("heavy")).select(F.col("key").alias(f"__key_{i}"), F.col("answer").alias(f"__often_{i}"))
        rows = rows.join(F.broadcast(often), f"__key_{i}", "left")  # fewer than _HEAVY short keys
    open_ = {i: column for i, (column, _) in enumerate(values.values()) if column in tails}
    if open_:
        rows = durable(rows.withColumn("__rid", F.monotonically_increasing_id()))  # fixed by writing them
        asked = [
            F.when(F.col(f"__often_{i}").isNull() & F.col(f"__key_{i}").isNotNull(),
                   F.struct(F.lit(i).alias("__cell"), F.lit(c).alias("column"), F.col(f"__key_{i}").alias("key")))
            for i, c in open_.items()
        ]
        cells = rows.select("__rid", F.inline(F.filter(F.array(*asked), lambda x: x.isNotNull())))
        seldom = found.where("not heavy").drop("heavy")
        answers = spread_join(cells, seldom, ["column", "key"], "inner").groupBy("__rid").agg(
            F.map_from_entries(F.collect_list(F.struct("__cell", "answer"))).alias("__answers")
        )
        rows = rows.join(answers, "__rid", "left").drop("__rid")
    picked = [
        F.coalesce(f"__often_{i}", F.col("__answers")[i]).alias(n) if i in open_ else F.col(f"__often_{i}").alias(n)
        for i, n in enumerate(names)
    ]
    return rows.select(*df.columns, *picked)


def gather(rows: DataFrame, answers: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Bring the answers (``__rid``, ``__cell``, ...) back to ``rows`` (``__rid``, ...) as columns; one shuffle.

    ``columns`` has, in order of the cell numbers, an expression over ``answers`` for each new column.
    """
    picked = [F.first(F.when(F.col("__cell") == i, value), ignorenulls=True).alias(c) for i, (c, value) in enumerate(columns.items())]
    return rows.join(answers.groupBy("__rid").agg(*picked), "__rid", "left").drop("__rid")


def short_tables(counts: DataFrame) -> dict[str, list[tuple[str | None, int]]]:
    """(value, n) in order of the columns whose value table is short in rows and characters."""
    length = F.sum(F.coalesce(F.length("value"), F.lit(0)))
    sizes = counts.groupBy("column").agg(F.count(F.lit(1)).alias("values"), length.alias("length"))
    fitting = sizes.where((F.col("values") <= SHORT_VALUES) & (F.col("length") <= SHORT_LENGTH)).select("column")
    tables: dict[str, list[tuple[str | None, int]]] = {}
    for row in counts.join(F.broadcast(fitting), "column").select("column", "value", "n").collect():
        tables.setdefault(row["column"], []).append((row["value"], row["n"]))
    return {c: sorted(t, key=lambda r: (r[0] is None, r[0] or "")) for c, t in tables.items()}


def middle() -> Column:
    """The middle of a step as a share of its column's positions."""
    return (F.col("start") + F.col("n") / 2) / F.col("total")
