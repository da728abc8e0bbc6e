"""Structure profiling: column profiles, durable keys, links, strategy."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinlens.functions import naming
from twinlens.functions.dates import parse_datetime, spans_calendar
from twinlens.functions.values import nearest, printed, text_key
from twinlens.model import (
    Relationship, Tables, is_date, is_integer, is_numeric, scalar_columns,
)
from twinlens.operators.counting import long_cells, sketched_distinct, text_counts
from twinlens.operators.scd import with_next_version

USABLE = 0.8
PROFILE_SCHEMA = (
    "column string, position int, dtype string, datey boolean, idish boolean, audit boolean, "
    "integral boolean, numeric boolean, dated boolean"
)


def _column_facts(df: DataFrame) -> DataFrame:
    """What the schema alone says about each column (one row per column)."""
    rows = [
        (
            c, i, df.schema[c].dataType.simpleString(), naming.is_datey(c), naming.is_idish(c),
            naming.is_audit(c), is_integer(df, c), is_numeric(df, c), is_date(df, c),
        )
        for i, c in enumerate(df.columns)
    ]
    return df.sparkSession.createDataFrame(rows, PROFILE_SCHEMA)


def _date_fraction(parsed: Column, filled: Column, first: Column, last: Column) -> Column:
    """Parsed share, but 0 where enough parses and the dates still cover no real span."""
    share = F.coalesce(F.try_divide(parsed, filled), F.lit(0.0))
    return F.when((share < USABLE) | spans_calendar(first, last), share).otherwise(F.lit(0.0))


def usable_dates(df: DataFrame, columns: list[str]) -> DataFrame:
    """``(column, dt_frac)``: how far each column holds real calendar dates.

    A mangled column (times of day, one repeated day) scores 0 even though its
    values may parse.  Values are counted first and each distinct one parsed once.
    """
    counts = long_cells(df, {c: F.col(c).cast("string") for c in columns}).groupBy("column", "value").agg(
        F.count(F.lit(1)).alias("n")
    )
    parsed = counts.withColumn("parsed", parse_datetime(F.col("value")))
    return parsed.groupBy("column").agg(
        _date_fraction(
            F.sum(F.when(F.col("parsed").isNotNull(), F.col("n"))),
            F.sum(F.when(F.col("value").isNotNull(), F.col("n"))),
            F.min("parsed"),
            F.max("parsed"),
        ).alias("dt_frac")
    )


def _role() -> Column:
    """First rule that applies decides; relies on the columns of the profile frame."""
    unique = F.try_divide("n_distinct", "n_filled")
    return (
        F.when(F.col("dt_raw") >= USABLE, "date")
        .when(F.col("audit"), "audit")
        .when(
            (F.coalesce(unique, F.lit(0.0)) >= 0.99)
            & (F.col("idish") | F.col("integral") | (F.col("n_distinct") == F.col("n_filled"))),
            "surrogate",
        )
        .when(F.col("datey"), "date")
        .when((F.coalesce(unique, F.lit(0.0)) >= 0.9) & ~F.col("numeric"), "free_text")
        .when((F.col("n_distinct") > 1) & (F.col("n_distinct") < F.col("n_filled")), "durable_candidate")
        .otherwise("attribute")
    )


def profile_columns(df: DataFrame, approximate: bool = False) -> DataFrame:
    """One row per column: counts, null share, uniqueness, date share, role, note.

    All columns are unpivoted and counted together: two shuffles in total, the
    second one tiny, instead of one expanded branch per distinct count.
    ``approximate`` swaps the exact distinct counts for sketches (no value
    shuffle at all); dates are then judged by their extremes only.
    """
    facts = _column_facts(df)
    if approximate:
        stats = _sketched_stats(df)
    else:
        columns = scalar_columns(df)
        dated = [c for c in columns if is_date(df, c)]
        parsable = [c for c in columns if naming.is_datey(c) and not is_numeric(df, c) and c not in dated]
        counts = text_counts(df, columns)
        value = F.col("value")
        moment = F.when(F.col("column").isin(dated), value.try_cast("timestamp"))
        if parsable:
            moment = moment.when(F.col("column").isin(parsable), parse_datetime(value))
        stats = (
            counts.withColumn("moment", moment)
            .groupBy("column")
            .agg(
                F.sum("n").alias("n_rows"),
                F.coalesce(F.sum(F.when(value.isNotNull(), F.col("n"))), F.lit(0)).alias("n_filled"),
                F.count("value").alias("n_distinct"),
                F.coalesce(F.sum(F.when(F.col("moment").isNotNull(), F.col("n"))), F.lit(0)).alias("n_parsed"),
                F.min("moment").alias("first"),
                F.max("moment").alias("last"),
            )
        )
    wide = facts.join(F.broadcast(stats), "column", "left")  # one row per column
    zero = F.lit(0).cast("bigint")
    wide = wide.withColumns({c: F.coalesce(c, zero) for c in ("n_rows", "n_filled", "n_distinct", "n_parsed")})
    wide = wide.withColumn(
        "dt_raw",
        F.when(
            (F.col("datey") | F.col("dated")) & ~F.col("numeric"),
            _date_fraction(F.col("n_parsed"), F.col("n_filled"), F.col("first"), F.col("last")),
        ).otherwise(F.lit(0.0)),
    ).withColumn("role", _role())
    repeats = F.concat(
        F.lit("repeats ~"), printed(F.try_divide("n_filled", "n_distinct"), 1),
        F.format_string(" rows/value across %d values", F.col("n_distinct")),
    )
    note = (
        F.when(
            (F.col("role") == "date") & (F.col("dt_raw") < USABLE),
            "named like a date but not parseable as calendar dates; unusable for timelines",
        )
        .when(F.col("role") == "durable_candidate", repeats)
        .otherwise("")
    )
    missing = F.when(F.col("n_rows") > 0, 1 - F.try_divide("n_filled", "n_rows")).otherwise(1.0)
    unique = F.when(F.col("n_filled") > 0, F.try_divide("n_distinct", "n_filled")).otherwise(0.0)
    return wide.select(
        "column", "position", "dtype", "n_rows", "n_distinct",
        nearest(missing, 4).alias("null_frac"),
        nearest(unique, 4).alias("uniqueness"),
        "role",
        nearest(F.col("dt_raw"), 3).alias("dt_frac"),
        note.alias("note"),
    )


def _sketched_stats(df: DataFrame) -> DataFrame:
    parts = []
    for c in scalar_columns(df):
        when = F.col(c).cast("timestamp") if is_date(df, c) else parse_datetime(F.col(c))
        wanted = is_date(df, c) or (naming.is_datey(c) and not is_numeric(df, c))
        moment = when if wanted else F.lit(None).cast("timestamp")
        parts.append(
            F.struct(
                F.lit(c).alias("column"),
                F.count(F.lit(1)).alias("n_rows"),
                F.count(c).alias("n_filled"),
                F.least(sketched_distinct(c), F.count(c)).alias("n_distinct"),
                F.count(moment).alias("n_parsed"),
                F.min(moment).alias("first"),
                F.max(moment).alias("last"),
            )
        )
    return df.agg(F.array(*parts).alias("stats")).select(F.inline("stats"))


# ---- durable keys ----------------------------------------------------------


def _version_fit(average: Column) -> Column:
    falling = F.greatest(F.lit(0.0), 1 - (average - 15) / 85)
    return F.when(average < 1.5, 0.0).when(average <= 15, 1.0).otherwise(falling)


def durable_keys(df: DataFrame, keys: list[str], effective: str | None, end: str | None = None) -> DataFrame:
    """Score each column as an entity key: many entities, few dated versions each.

    ``effective`` must hold usable dates (None otherwise).  Every candidate is
    counted in one unpivoted pass; more than one distinct date within an entity
    is simply ``min <> max``, so no distinct set is kept per entity.
    """
    moment = (parse_datetime(F.col(effective)) if effective else F.lit(None).cast("timestamp")).alias("moment")
    cells = long_cells(df.select("*", moment), {k: text_key(df, k) for k in keys}, ["moment"])
    entities = (
        cells.where(F.col("value").isNotNull())
        .groupBy("column", "value")
        .agg(F.count(F.lit(1)).alias("n"), F.min("moment").alias("first"), F.max("moment").alias("last"))
    )
    several = F.col("n") > 1
    scored = entities.groupBy("column").agg(
        F.count(F.lit(1)).alias("n_entities"),
        F.avg("n").alias("avg"),
        F.max("n").alias("max_versions"),
        F.coalesce(
            F.avg(F.when(several, F.coalesce((F.col("first") < F.col("last")).cast("double"), F.lit(0.0)))), F.lit(0.0)
        ).alias("dated"),
    )
    rows = df.agg(F.greatest(F.count(F.lit(1)), F.lit(1))).scalar()
    entity_fit = F.least(F.lit(1.0), F.col("n_entities") / F.greatest(F.lit(20.0), 0.05 * rows))
    score = 0.45 * entity_fit + 0.25 * _version_fit(F.col("avg")) + 0.30 * F.col("dated")
    out = scored.select(
        "column",
        "n_entities",
        F.round("avg", 2).alias("avg_versions"),
        "max_versions",
        F.round("dated", 3).alias("dated_window_frac"),
        F.round(F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0)), 3).alias("score"),
    )
    if not (effective and end):
        return out.withColumn("contiguity_frac", F.lit(0.0))
    tiled = reduce(DataFrame.union, [contiguity(df, k, effective, end) for k in keys])
    return out.join(F.broadcast(tiled), "column", "left")  # one row per candidate


def contiguity(df: DataFrame, key: str, effective: str, end: str) -> DataFrame:
    """``(column, contiguity_frac)``: share of multi-row entities whose windows tile."""
    versions = df.where(F.col(key).isNotNull()).select(
        F.col(key).alias("__key"),
        parse_datetime(F.col(effective)).alias("__eff"),
        parse_datetime(F.col(end)).alias("__end"),
    )
    # rows starting together tie; the one ending last is the one that continues the timeline
    ordered = with_next_version(versions, "__key", "__eff", "__end")
    tiles = F.col("__last") | F.coalesce(F.col("__end") == F.col("__next"), F.lit(False))
    entities = ordered.groupBy("__key").agg(
        F.count(F.lit(1)).alias("n"), F.min(tiles.cast("double")).alias("tiled")
    )
    share = F.coalesce(F.avg(F.when(F.col("n") > 1, F.col("tiled"))), F.lit(0.0))
    return entities.agg(F.lit(key).alias("column"), F.round(share, 3).alias("contiguity_frac"))


@dataclass
class TableProfile:
    """Driver-side summary of one table (names and a few scores, never values)."""

    name: str
    n_rows: int
    roles: dict[str, str]
    date_columns: list[str]
    usable_date_columns: list[str]
    surrogate_columns: list[str]
    effective_column: str | None
    durable_candidates: list[dict] = field(default_factory=list)
    note: str = ""

    @property
    def is_versioned(self) -> bool:
        return bool(self.durable_candidates) and self.durable_candidates[0]["score"] >= 0.5


DURABLE_SCHEMA = (
    "column string, n_entities bigint, avg_versions double, max_versions bigint, "
    "dated_window_frac double, score double, contiguity_frac double"
)


def effective_column(usable: list[str]) -> str | None:
    named = [c for c in usable if naming.is_effective(c)]
    return (named or usable or [None])[0]


def top_durable_keys(df: DataFrame, profile: list, limit: int = 5) -> DataFrame:
    """Best-scoring durable candidates of a profiled table."""
    keys = [r["column"] for r in profile if r["role"] == "durable_candidate"]
    if not keys:
        return df.sparkSession.createDataFrame([], DURABLE_SCHEMA)
    usable = [r["column"] for r in profile if r["role"] == "date" and r["dt_frac"] >= USABLE]
    return durable_keys(df, keys, effective_column(usable)).orderBy(F.desc("score"), "column").limit(limit)


def collect_profile(profile: DataFrame) -> list:
    """The column profile as driver rows (one per column), in column order."""
    return sorted(profile.collect(), key=lambda r: r["position"])


def profile_table(df: DataFrame, name: str, approximate: bool = False) -> tuple[TableProfile, DataFrame, DataFrame]:
    """``(summary, column profile, durable candidates)`` of one table."""
    frame = profile_columns(df, approximate)
    rows = collect_profile(frame)
    dates = [r["column"] for r in rows if r["role"] == "date"]
    usable = [r["column"] for r in rows if r["role"] == "date" and r["dt_frac"] >= USABLE]
    keys = top_durable_keys(df, rows).collect()
    durable = df.sparkSession.createDataFrame(keys, DURABLE_SCHEMA)
    summary = TableProfile(
        name=name,
        n_rows=rows[0]["n_rows"] if rows else 0,
        roles={r["column"]: r["role"] for r in rows},
        date_columns=dates,
        usable_date_columns=usable,
        surrogate_columns=[r["column"] for r in rows if r["role"] in ("surrogate", "audit")],
        effective_column=effective_column(usable),
        durable_candidates=[k.asDict() for k in keys],
        note="date columns are present but none holds calendar dates; timelines need a clean export"
        if dates and not usable else "",
    )
    return summary, df.sparkSession.createDataFrame(rows, frame.schema), durable


# ---- links -----------------------------------------------------------------

LINK_SCHEMA = (
    "parent_table string, parent_column string, child_table string, child_column string, "
    "overlap_frac double, parent_is_unique boolean, cardinality string, linkable_via_durable boolean"
)


def _shared_key_columns(tables: Tables, eligible: dict[str, set[str]]) -> list[str]:
    found = set()
    for a, b in combinations(tables, 2):
        shared = set(tables[a].columns) & set(tables[b].columns)
        found |= shared & (eligible.get(a, set()) | eligible.get(b, set()))
    return sorted(found)


def find_links(tables: Tables, eligible: dict[str, set[str]], min_overlap: float = 0.3) -> DataFrame:
    """Join candidates among same-named columns, by overlap of their distinct values.

    Each value is reduced to one row of per-table counters, and every table pair
    is then a counter over those rows: two shuffles for all pairs and columns, no
    self-join.
    """
    names = list(tables)
    spark = next(iter(tables.values())).sparkSession
    shared = _shared_key_columns(tables, eligible)
    stacked = [
        long_cells(df, {c: text_key(df, c) for c in cols}).withColumn("table", F.lit(i))
        for i, df in enumerate(tables.values())
        if (cols := [c for c in shared if c in df.columns])
    ]
    if len(stacked) < 2:
        return spark.createDataFrame([], LINK_SCHEMA)
    values = reduce(DataFrame.union, stacked).groupBy("column", "value").agg(
        *[F.count_if(F.col("table") == i).alias(f"n_{i}") for i in range(len(names))]
    )
    filled = F.col("value").isNotNull()
    pairs = [
        (i, j, [c for c in shared if c in tables[names[i]].columns and c in tables[names[j]].columns
                and c in eligible.get(names[i], set()) | eligible.get(names[j], set())])
        for i, j in combinations(range(len(names)), 2)
    ]
    pairs = [p for p in pairs if p[2]]
    per_column = values.groupBy("column").agg(
        *[F.count_if(filled & (F.col(f"n_{i}") > 0)).alias(f"d_{i}") for i in range(len(names))],
        *[(F.max(f"n_{i}") <= 1).alias(f"u_{i}") for i in range(len(names))],
        *[F.count_if(filled & (F.col(f"n_{i}") > 0) & (F.col(f"n_{j}") > 0)).alias(f"x_{i}_{j}") for i, j, _ in pairs],
    )
    rows = F.array(
        *[
            F.struct(
                F.lit(names[i]).alias("a"), F.lit(names[j]).alias("b"), F.array(*map(F.lit, columns)).alias("allowed"),
                F.col(f"d_{i}").alias("d_a"), F.col(f"d_{j}").alias("d_b"),
                F.col(f"u_{i}").alias("u_a"), F.col(f"u_{j}").alias("u_b"), F.col(f"x_{i}_{j}").alias("both"),
            )
            for i, j, columns in pairs
        ]
    )
    cand = per_column.select("column", F.inline(rows)).where(
        F.array_contains("allowed", F.col("column")) & (F.col("d_a") > 0) & (F.col("d_b") > 0)
    )
    covers_b, covers_a = F.try_divide("both", "d_b"), F.try_divide("both", "d_a")
    flipped = F.col("u_b") & ~F.col("u_a")  # the unique side is the parent, else the first table
    cand = cand.where(F.greatest(covers_a, covers_b) >= min_overlap)
    return cand.select(
        F.when(flipped, F.col("b")).otherwise(F.col("a")).alias("parent_table"),
        F.col("column").alias("parent_column"),
        F.when(flipped, F.col("a")).otherwise(F.col("b")).alias("child_table"),
        F.col("column").alias("child_column"),
        F.round(F.when(flipped, covers_a).otherwise(covers_b), 3).alias("overlap_frac"),
        F.when(flipped, F.col("u_b")).otherwise(F.col("u_a")).alias("parent_is_unique"),
        F.when(F.col("u_a") & F.col("u_b"), "1:1")
        .when(F.col("u_a") | F.col("u_b"), "1:many")
        .otherwise("many:many")
        .alias("cardinality"),
        (~(F.col("u_a") | F.col("u_b"))).alias("linkable_via_durable"),
    ).orderBy(F.desc("overlap_frac"), "parent_table", "child_table", "parent_column")


def key_columns(profiles: dict[str, TableProfile]) -> dict[str, set[str]]:
    """Columns per table whose role makes them possible join keys."""
    return {
        name: {c for c, role in p.roles.items() if role in ("surrogate", "durable_candidate")}
        for name, p in profiles.items()
    }


def shared_keys(tables: Tables) -> DataFrame:
    """Column names present in at least two tables, with uniqueness per table."""
    names = sorted(n for n in {c for df in tables.values() for c in df.columns}
                   if sum(n in df.columns for df in tables.values()) >= 2)
    parts = []
    for table, df in tables.items():
        cols = [c for c in names if c in df.columns]
        if not cols:
            continue
        per_column = text_counts(df, cols).groupBy("column").agg(
            F.sum("n").alias("n_rows"), F.count("value").alias("n_distinct")
        )
        unique = (F.col("n_distinct") >= F.col("n_rows")).alias("is_unique")
        parts.append(per_column.select("column", F.lit(table).alias("table"), unique))
    return reduce(DataFrame.union, parts)


# ---- recommendation --------------------------------------------------------


@dataclass
class Recommendation:
    tier: int
    strategy: str
    reasons: list[str]
    relationships: list[Relationship] = field(default_factory=list)
    sequence_specs: dict[str, dict[str, str]] = field(default_factory=dict)
    warnings: list[str] = field(default_factory=list)


def recommend_strategy(profiles: dict[str, TableProfile], links: list) -> Recommendation:
    """Pick a synthesis strategy from the profiles and links (driver rows).

    Precedence: dated histories, then key links, then undated histories, then
    independent tables.
    """
    strong = [l for l in links if l["overlap_frac"] >= 0.5]
    keyed = [l for l in strong if l["parent_is_unique"]]
    durable = [l for l in strong if l["linkable_via_durable"]]
    versioned = {n: p for n, p in profiles.items() if p.is_versioned}
    sequences = {
        n: {"sequence_key": p.durable_candidates[0]["column"], "sequence_index": p.usable_date_columns[0]}
        for n, p in versioned.items()
        if p.usable_date_columns
    }
    if sequences:
        return Recommendation(
            2, "sequential",
            ["entities keep several dated versions under a stable key: generate each history in time order"],
            sequence_specs=sequences,
            warnings=["histories are generated table by table and re-linked by the shared key"]
            if len(profiles) > 1 else [],
        )
    if keyed:
        rels = [
            Relationship(l["parent_table"], l["parent_column"], l["child_table"], l["child_column"]) for l in keyed
        ]
        return Recommendation(
            1, "relational", [f"{len(rels)} key link(s) between tables hold and are kept while generating"], rels
        )
    if versioned:
        warnings = []
        if durable:
            named = ", ".join(f"{l['parent_table']}.{l['parent_column']}" for l in durable[:3])
            warnings.append(f"repeating columns might be the entity key if confirmed: {named}")
        if not any(p.usable_date_columns for p in profiles.values()):
            warnings.append("no column holds calendar dates, so timelines cannot be rebuilt")
        return Recommendation(
            3, "temporal_statistical",
            ["rows look like versions but no trusted key ties them together: keep patterns of change only"],
            warnings=warnings,
        )
    return Recommendation(
        0, "independent", ["no links or version history found: each table is generated on its own"],
        warnings=["some columns share values but none is a clean key"] if links else [],
    )
