"""Bootstrap columns that no generator modelled (and the bootstrap generator)."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twinlens.functions.hashing import hash_draw
from twinlens.model import ColumnRoles
from twinlens.operators.lookup import gather, short_tables, value_counts, value_steps, values_at
from twinlens.session import durable

_STRETCH = 8  # a value table is cut into at most so many stretches, or into stretches of so many totals
_DIGITS = 4  # 65,536 index buckets: 15 million rows each for 10^12 rows


def index_rows(df: DataFrame, key: Column, columns: list[str], digits: int = _DIGITS) -> DataFrame:
    """``(__idx, *columns)``: a dense 0-based index in order of the digest of ``key``.

    A digest spreads rows evenly over 16^digits buckets whatever the values
    are.  Rows are numbered inside their bucket; the bucket sizes (a table of
    fixed size) give the offsets.  No global sort, no single-task window.
    """
    digest = F.md5(key.cast("string"))
    bucket = F.substring(digest, 1, digits)
    keyed = df.select(digest.alias("__digest"), bucket.alias("__bucket"), *columns)
    earlier = Window.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    # bounded by construction: at most 16^digits rows
    offsets = (
        df.groupBy(bucket.alias("__bucket"))
        .agg(F.count(F.lit(1)).alias("__size"))
        .select("__bucket", F.coalesce(F.sum("__size").over(earlier), F.lit(0)).alias("__offset"))
    )
    within = Window.partitionBy("__bucket").orderBy("__digest", *columns)
    numbered = keyed.withColumn("__pos", F.row_number().over(within)).join(F.broadcast(offsets), "__bucket")
    return numbered.select((F.col("__offset") + F.col("__pos") - 1).alias("__idx"), *columns)


def _slots(df: DataFrame, columns: list[str]) -> dict[str, str]:
    """Column type -> name of the slot in which an answer of this type travels."""
    kinds = dict.fromkeys(df.schema[c].dataType.simpleString() for c in columns)
    return {kind: f"__slot_{i}" for i, kind in enumerate(kinds)}


def _numbered(synth: DataFrame, columns: list[str], draws: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """``synth`` without ``columns`` under row numbers, and its draws as cells ``(__rid, __cell, __at)``."""
    kept = [c for c in synth.columns if c not in columns]
    numbered = synth.select(*kept, *[d.alias(f"__draw_{c}") for c, d in draws.items()])
    numbered = durable(numbered.withColumn("__rid", F.monotonically_increasing_id()))  # fixed by writing them
    cells = F.array(*[F.struct(F.lit(i).alias("__cell"), F.col(f"__draw_{c}").alias("__at")) for i, c in enumerate(draws)])
    return numbered.select(*kept, "__rid"), numbered.select("__rid", F.inline(cells))


def refill(
    synth: DataFrame,
    real: DataFrame,
    columns: list[str],
    synth_key: Column,
    real_key: Column,
    order: list[str] | None = None,
    seed: int = 0,
) -> DataFrame:
    """Redraw each of ``columns`` independently, with replacement, from ``real``.

    NULLs are drawn like any value, so the missing rate carries over. The draws of all
    columns are one exchange: every drawn row index is a cell, cells meet the indexed
    real rows in one join, and the answers return to their rows in one grouping. With a
    single column the rows join the indexed real rows at once. An index is uniform, so
    a value shared by a third of the rows skews nothing.
    """
    columns = [c for c in columns if c in real.columns]
    if not columns:
        return synth
    n_real = real.agg(F.count(F.lit(1))).scalar()
    kept = [c for c in synth.columns if c not in columns]
    order = [c for c in order or [*kept, *columns] if c in kept or c in columns]
    if len(columns) == 1:  # a row has one cell and can meet its answer itself
        drawn = synth.select(*kept, hash_draw(synth_key, columns[0], seed, n_real).alias("__idx"))
        return drawn.join(index_rows(real, real_key, columns), "__idx", "left").select(*order)
    rows, cells = _numbered(synth, columns, {c: hash_draw(synth_key, c, seed, n_real) for c in columns})
    slots = _slots(real, columns)
    of_type = {kind: [i for i, c in enumerate(columns) if real.schema[c].dataType.simpleString() == kind] for kind in slots}
    indexed = index_rows(real, real_key, columns)
    named = indexed.select(F.col("__idx").alias("__at"), *[F.col(c).alias(f"__value_{i}") for i, c in enumerate(columns)])
    answers = cells.join(named, "__at").select(
        "__rid", "__cell",
        *[F.coalesce(*[F.when(F.col("__cell") == i, F.col(f"__value_{i}")) for i in of_type[k]]).alias(slot) for k, slot in slots.items()],
    )
    values = {c: F.col(slots[real.schema[c].dataType.simpleString()]) for c in columns}
    return gather(rows, answers, values).select(*order)


def _tree(totals: list[int], draw: Column, low: int = 0, high: int | None = None) -> Column:
    high = len(totals) if high is None else high
    if low == high:
        return F.lit(low)
    at = (low + high) // 2
    return F.when(draw >= totals[at], _tree(totals, draw, at + 1, high)).otherwise(_tree(totals, draw, low, at))


def _count_up_to(totals: list[int], draw: Column) -> Column:
    """Number of the ascending ``totals`` that ``draw`` has reached.

    A short tree finds the stretch and a lambda counts inside it: a lambda is slow for each
    total it looks at, and a tree of all totals is more code than the JVM compiles.
    """
    size = max(_STRETCH, -(-len(totals) // _STRETCH))
    blocks = [totals[i : i + size] for i in range(0, len(totals), size)]
    if len(blocks) == 1:
        return F.size(F.filter(F.lit(totals), lambda total: total <= draw))
    block = _tree([b[-1] for b in blocks[:-1]], draw)
    stretch = F.get(F.array(*[F.lit(b) for b in blocks]), block)
    return block * size + F.size(F.filter(stretch, lambda total: total <= draw))


def refill_by_value(synth: DataFrame, real: DataFrame, columns: list[str], synth_key: Column, seed: int = 0) -> DataFrame:
    """Same draw, from the column's values in text order with NULL last.

    A draw is a position on the counted value table. Short tables are looked up where the
    rows are; the positions of all other columns are one exchange. Both give the same
    values, so the length of a table decides nothing but the way.
    """
    columns = [c for c in columns if c in real.columns]
    if not columns:
        return synth
    counts = value_counts(real, columns)
    short = {c: t for c, t in short_tables(counts).items() if c in columns}
    ends = {c: list(accumulate(n for _, n in t)) for c, t in short.items()}
    wide = [c for c in columns if c not in short]
    kept = [c for c in synth.columns if c not in columns]
    draws = {c: hash_draw(synth_key, c, seed, F.lit(ends[c][-1])) for c in short}
    out = synth
    if wide:
        total = real.agg(F.count(F.lit(1))).scalar()
        out = synth.withColumns({f"__short_{c}": d for c, d in draws.items()})
        rows, cells = _numbered(out, columns, {c: hash_draw(synth_key, c, seed, total) for c in wide})
        asked = cells.withColumn("column", F.get(F.lit(wide), "__cell"))
        answers = values_at(asked, value_steps(counts.where(F.col("column").isin(wide))), "__at")
        values = {c: F.col("value").cast(real.schema[c].dataType) for c in wide}
        out, draws = gather(rows, answers, values), {c: F.col(f"__short_{c}") for c in short}
    if short:
        # a generated row keeps each digest a stored value instead of one call per table step
        stored = F.array(F.struct(*[d.alias(f"__draw_{c}") for c, d in draws.items()]))
        out = out.select("*", F.inline(stored))
    picks = []
    for c in columns:
        if c not in short:
            picks.append(F.col(c))
            continue
        values = F.array(*[F.lit(v).cast("string") for v, _ in short[c]]).cast(f"array<{real.schema[c].dataType.simpleString()}>")
        picks.append(F.get(values, _count_up_to(ends[c], F.col(f"__draw_{c}"))).alias(c))
    return out.select(*kept, *picks)


def bootstrap_table(
    real: DataFrame,
    key: Column,
    columns: list[str] | None = None,
    seed: int = 0,
    small: list[str] | None = None,
    keep_row: str | None = None,
) -> DataFrame:
    """Baseline generator: as many rows as ``real``, every column drawn on its own.

    ``small`` names columns expected to have few values; they are drawn from their counted
    values in text order, all others from the rows in digest order.
    ``keep_row`` names a further column with the key each copied row was drawn under.
    """
    columns = columns or real.columns
    few = [c for c in columns if c in (small or [])]
    frame = refill_by_value(real.select(key.alias("__row")), real, few, F.col("__row"), seed)
    rest = [c for c in columns if c not in few]
    return refill(frame, real, rest, F.col("__row"), key, ["__row", *columns], seed).select(
        *([F.col("__row").alias(keep_row)] if keep_row else []), *columns
    )


def columns_to_model(
    columns: list[str], roles: ColumnRoles, keys: set[str]
) -> tuple[list[str], list[str]]:
    """``(modelled, refilled)``: signal columns and keys are modelled, the rest redrawn."""
    wanted = set(roles.modelable) | keys
    return [c for c in columns if c in wanted], [c for c in columns if c not in wanted]
