"""Privacy attacks on a synthetic copy, and their verdicts."""

from __future__ import annotations

from functools import partial, reduce
from itertools import combinations
from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinlens.functions.hashing import hash_uniform
from twinlens.functions.values import as_number, printed
from twinlens.model import ColumnRoles
from twinlens.operators.counting import exact_percentiles, long_cells, text_counts
from twinlens.operators.encode import Encoder, fit_encoder
from twinlens.operators.forest import fit_forest
from twinlens.operators.knn import knn_distances
from twinlens.operators.skew import heavy_keys, spread_join
from twinlens.operators.utility import binary_auc
from twinlens.session import durable, side_by_side

TOLERANCE = 0.01
_CELL_SPAN = 10  # coarse cells are this many tolerance bands wide
_CELL_COLUMNS = 3  # numbers that make up a coarse cell; the others are compared inside it
_HOT_CELL = 5_000
MIA_TREES = 200
MIA_DEPTH = 10

MIA_SCHEMA = "auc double, accuracy double, n_members bigint, n_holdout bigint, note string"


# ---- membership inference --------------------------------------------------


def membership_features(rows: DataFrame, synth: DataFrame, k: int = 5, codes: int = 0) -> DataFrame:
    """Distances to the k nearest copies plus their mean and minimum, as one array."""
    near = knn_distances(rows, synth, k, codes=codes)
    total = F.aggregate("distances", F.lit(0.0), lambda acc, d: acc + d)
    summary = F.array(F.try_divide(total, F.size("distances")), F.array_min("distances"))
    return near.withColumn("attack", F.concat("distances", summary)).drop("distances")


def membership_inference(
    train: DataFrame,
    holdout: DataFrame,
    synth: DataFrame,
    roles: ColumnRoles,
    row_key: Column,
    k: int = 5,
    seed: int = 0,
    trees: int = MIA_TREES,
    depth: int = MIA_DEPTH,
    encoder: Encoder | None = None,
) -> DataFrame:
    """One row ``(auc, accuracy, n_members, n_holdout, note)`` of a trained attacker.

    AUC near 0.5 means members and fresh rows lie equally close to the copy.
    Classes are balanced and split 60/40 by digests of the row key.  Pass the
    ``encoder`` fitted on ``train`` when several copies are attacked.
    """
    spark = train.sparkSession
    n_train, n_hold, n_synth = train.count(), holdout.count(), synth.count()

    def skipped(note: str) -> DataFrame:
        return spark.createDataFrame([(None, None, n_train, n_hold, note)], MIA_SCHEMA)

    if not roles.modelable or n_hold < 10 or n_train < 10 or n_synth < 5:
        return skipped("insufficient rows, or no usable column")
    try:
        encoder = encoder or fit_encoder(train, roles)
    except ValueError as error:
        return skipped(str(error))
    n = min(n_train, n_hold)
    sides = []
    for df, label, size in ((train, 1.0, n_train), (holdout, 0.0, n_hold)):
        kept = df.where(hash_uniform(row_key, "balance", seed) < n / size)
        sides.append(encoder.compact(kept, row_key.alias("__key"), F.lit(label).alias("label")))
    rows = durable(membership_features(sides[0].union(sides[1]), encoder.compact(synth), k, len(encoder.modes)))
    test = hash_uniform(F.col("__key"), "attack-split", seed) < 0.4
    forest = fit_forest(rows.where(~test), "attack", "label", ("__key", "label", "attack"), trees, depth, seed)
    scored = durable(forest.score(rows.where(test).select("label", "attack"), "attack"))
    auc = binary_auc(scored, "label", "score").first()["auc"]
    hit = ((F.col("score") >= 0.5).cast("double") == F.col("label")).cast("double")
    accuracy = scored.agg(F.avg(hit).alias("a")).first()["a"]
    return spark.createDataFrame([(auc, accuracy, n_train, n_hold, "")], MIA_SCHEMA)


# ---- distance to closest record --------------------------------------------


def dcr_series(real: DataFrame, copies: dict[str, DataFrame], roles: ColumnRoles, baseline: str) -> DataFrame:
    """``(series, distance)``: real to its nearest row of each copy, and (``baseline``) to its nearest other real row."""
    encoder = fit_encoder(real, roles)
    r, codes = durable(encoder.compact(real)), len(encoder.modes)  # asked of every copy and of itself
    first = F.col("distances")[0].alias("distance")

    def closest(name: str, base: DataFrame, skip_self: bool = False) -> DataFrame:
        return knn_distances(r, base, 1, skip_self=skip_self, codes=codes).select(F.lit(name).alias("series"), first)

    searches = [partial(lambda name, copy: closest(name, encoder.compact(copy)), *copy) for copy in copies.items()]
    return reduce(DataFrame.union, side_by_side(real.sparkSession, [*searches, partial(closest, baseline, r, True)]))


def dcr_distances(real: DataFrame, synth: DataFrame, roles: ColumnRoles) -> DataFrame:
    """``(kind, distance)``: real to nearest copy (``synth``) and nearest other real (``real``)."""
    return dcr_series(real, {"synth": synth}, roles, "real").withColumnRenamed("series", "kind")


def dcr_summary(distances: DataFrame) -> DataFrame:
    """Medians, 5th percentile and their ratio, in one row."""
    stats = exact_percentiles(distances.select("kind", F.col("distance").alias("value")), ["kind"], [0.5, 0.05])

    def of(kind: str, column: str) -> Column:
        return F.max(F.when(F.col("kind") == kind, F.col(column)))

    wide = stats.agg(of("synth", "p0").alias("rs"), of("synth", "p1").alias("rs5"), of("real", "p0").alias("rr"))
    return wide.select(
        F.col("rs").alias("dcr_real_synth_median"),
        F.col("rs5").alias("dcr_real_synth_p05"),
        F.col("rr").alias("dcr_real_real_median"),
        (F.col("rs") / (F.col("rr") + 1e-12)).alias("dcr_ratio_median"),
    )


def dcr_overlay(distances: DataFrame, bins: int = 49) -> DataFrame:
    """Shared-bin density per series over 0..p99: ``(series, bin, low, n, density)``.

    ``distances``: (series, distance) of every copy plus the real baseline.
    """
    values = distances.select("series", F.col("distance").alias("value"))
    top = exact_percentiles(values.select(F.lit(0).alias("all"), "value"), ["all"], [0.99])
    high = top.select(F.col("p0") + 1e-9).scalar()
    width = high / bins
    inside = values.where((F.col("value") >= 0) & (F.col("value") <= high))
    placed = inside.withColumn("bin", F.least(F.floor(F.col("value") / width), F.lit(bins - 1)).cast("int"))
    counted = placed.groupBy("series", "bin").agg(F.count(F.lit(1)).alias("n"))
    totals = counted.groupBy("series").agg(F.sum("n").alias("total"))
    joined = counted.join(F.broadcast(totals), "series")  # one row per copy
    return joined.select(
        "series", "bin", (F.col("bin") * width).alias("low"), "n", (F.col("n") / (F.col("total") * width)).alias("density")
    )


# ---- copied rows -----------------------------------------------------------


def _shared(roles: ColumnRoles, *frames: DataFrame) -> tuple[list[str], list[str]]:
    def common(columns):
        return [c for c in columns if all(c in f.columns for f in frames)]

    return common(roles.numeric), common(roles.categorical)


def exact_match_rate(real: DataFrame, synth: DataFrame, roles: ColumnRoles) -> DataFrame:
    """``(n_rows, n_exact_matches, exact_match_rate)``, values compared as text."""
    numeric, categorical = _shared(roles, real, synth)
    columns = numeric + categorical
    text = [F.to_json(F.array(*[F.col(c).cast("string") for c in columns])).alias("row")]
    seen = real.select(*text).distinct().withColumn("hit", F.lit(True))
    rows = synth.select(*text).groupBy("row").agg(F.count(F.lit(1)).alias("n")).join(seen, "row", "left")
    matched = F.coalesce(F.sum(F.when(F.col("hit"), F.col("n"))), F.lit(0))
    return rows.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"),
        matched.alias("n_exact_matches"),
        F.coalesce(F.try_divide(matched, F.sum("n")), F.lit(0.0)).alias("exact_match_rate"),
    )


def _log_cell(value: Column, width: float, shift: Column | float = 0.0) -> Column:
    """Log-scale cell with sign; zero and NULL have cells of their own."""
    index = F.floor(F.ln(F.abs(value)) / width + shift)
    return (
        F.when(value.isNull(), "null")
        .when(value == 0, "0")
        .otherwise(F.concat(F.when(value < 0, "-").otherwise("+"), index.cast("bigint").cast("string")))
    )


def _cells_in_reach(value: Column, tolerance: float, width: float) -> Column:
    """All coarse cells a match of ``value`` may lie in (one or two)."""
    low = F.floor((F.ln(F.abs(value)) + log(1 - tolerance)) / width - 1e-9).cast("bigint")
    high = F.floor((F.ln(F.abs(value)) + log(1 + tolerance)) / width + 1e-9).cast("bigint")
    sign = F.when(value < 0, "-").otherwise("+")
    return (
        F.when(value.isNull(), F.array(F.lit("null")))
        .when(value == 0, F.array(F.lit("0")))
        .otherwise(F.transform(F.sequence(low, high), lambda i: F.concat(sign, i.cast("string"))))
    )


def _key(*parts: Column) -> Column:
    """16 bytes: keys are what travels most."""
    return F.unhex(F.md5(F.to_json(F.array(*parts))))


def new_row_synthesis(
    real: DataFrame, synth: DataFrame, roles: ColumnRoles, tolerance: float = TOLERANCE
) -> DataFrame:
    """``(n_rows, n_matched, new_row_synthesis)``: share of copies with no real look-alike.

    A real row matches when all categories are equal and every number lies within
    ``tolerance * |copy|``; NULL matches NULL.  Cells on a log scale turn the
    band into equality: a copy sharing its fine cell with a real row is matched
    outright, and only the remaining copies are compared within coarse cells,
    crowded ones being salted.  No row cap and no pairwise comparison.
    """
    numeric, categorical = _shared(roles, real, synth)
    if not numeric + categorical:
        raise ValueError("no comparable columns")

    def points(df: DataFrame) -> DataFrame:
        return df.select(*[as_number(F.col(c)).alias(c) for c in numeric], *[F.col(c).cast("string").alias(c) for c in categorical])

    columns = numeric + categorical
    labels = [F.col(c) for c in categorical]
    # both are read several times: written once
    copies = durable(points(synth).groupBy(*columns).agg(F.count(F.lit(1)).alias("n")))
    seen = durable(points(real).distinct())
    fine = log(1 + tolerance) * (1 - 1e-9)
    fine_key = _key(*labels, *[_log_cell(F.col(c), fine) for c in numeric]).alias("fine")
    outright = seen.select(fine_key).distinct()
    left = copies.withColumn("fine", fine_key)
    total = copies.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    if not numeric:
        missed = left.join(outright, "fine", "left_anti")
        unmatched = missed.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    else:
        open_rows = left.join(outright, "fine", "left_anti").drop("fine")
        open_rows = durable(open_rows.withColumn("row", F.monotonically_increasing_id()))  # fixed by writing them
        matched = _matched_in_cells(open_rows, seen, numeric, labels, tolerance)
        unmatched = open_rows.join(matched, "row", "left_anti").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    row = total.select(F.col("n").alias("n_rows")).withColumn("unmatched", unmatched.scalar())
    return row.select(
        "n_rows",
        (F.col("n_rows") - F.col("unmatched")).alias("n_matched"),
        F.try_divide("unmatched", "n_rows").alias("new_row_synthesis"),
    )


def _selective(seen: DataFrame, numeric: list[str], width: float) -> list[str]:
    """The columns with the most evenly filled coarse cells: the smallest chance that two rows share one."""
    if len(numeric) <= _CELL_COLUMNS:
        return numeric
    cells = long_cells(seen, {c: _log_cell(F.col(c), width) for c in numeric}).groupBy("column", "value").agg(F.count(F.lit(1)).cast("double").alias("n"))
    share = cells.groupBy("column").agg((F.sum(F.col("n") * F.col("n")) / F.pow(F.sum("n"), 2)).alias("share"))
    rows = sorted(share.collect(), key=lambda r: (r["share"], r["column"]))  # one row per column
    return [r["column"] for r in rows[:_CELL_COLUMNS]]


def _matched_in_cells(
    open_rows: DataFrame, seen: DataFrame, numeric: list[str], labels: list[Column], tolerance: float
) -> DataFrame:
    """Distinct ``row`` keys of open rows with a real point inside their band.

    Cells are made of the categories and of the few numbers that tell real rows apart
    best, so a row asks for at most 2 ^ ``_CELL_COLUMNS`` cells, however many numbers it has.
    """
    width = _CELL_SPAN * log((1 + tolerance) / (1 - tolerance))
    chosen = _selective(seen, numeric, width)
    points = seen.select(
        _key(*labels, *[_log_cell(F.col(c), width) for c in chosen]).alias("cell"),
        *[F.col(c).alias(f"r_{c}") for c in numeric],
    )  # distinct as ``seen`` is: a cell is a function of the row and holds its categories
    looking = open_rows
    for c in chosen:
        looking = looking.withColumn(f"__cell_{c}", F.explode(_cells_in_reach(F.col(c), tolerance, width)))
    looking = looking.select("row", *numeric, _key(*labels, *[F.col(f"__cell_{c}") for c in chosen]).alias("cell"))
    crowded = (
        points.groupBy("cell")
        .agg(F.count(F.lit(1)).alias("size"))
        .where(F.col("size") > _HOT_CELL)
        .select("cell", F.ceil(F.col("size") / _HOT_CELL).cast("int").alias("salts"))
    )
    salts = F.coalesce("salts", F.lit(1))
    spread = points.join(crowded, "cell", "left").withColumn(
        "salt", F.pmod(F.xxhash64(*[f"r_{c}" for c in numeric]), salts).cast("int")
    )
    asked = looking.join(crowded, "cell", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1)))
    asked = asked.drop("salts").alias("q")
    spread = spread.drop("salts").alias("p")
    near = [
        F.coalesce(F.abs(F.col(f"p.r_{c}") - F.col(f"q.{c}")) <= tolerance * F.abs(F.col(f"q.{c}")), F.col(f"q.{c}").isNull())
        for c in numeric
    ]
    same = (F.col("q.cell") == F.col("p.cell")) & (F.col("q.salt") == F.col("p.salt"))
    return asked.join(spread, reduce(Column.__and__, near, same), "left_semi").select("row").distinct()


# ---- attribute disclosure --------------------------------------------------


def sensitive_shares(real: DataFrame, categorical: list[str]) -> DataFrame:
    """``(column, position, share)``: majority share of each usable categorical."""
    counts = text_counts(real, categorical).where(F.col("value").isNotNull())
    per_column = counts.groupBy("column").agg(
        (F.max("n") / F.sum("n")).alias("share"), F.count(F.lit(1)).alias("n_values")
    )
    place = real.sparkSession.createDataFrame(list(enumerate(categorical)), "position int, column string")
    usable = per_column.where(F.col("n_values") >= 2)
    return usable.join(F.broadcast(place), "column").select("column", "position", "share")


def pick_sensitive(
    real: DataFrame, categorical: list[str], wanted: str | None = None, most_keys: int | None = None
) -> tuple[str, list[str], str] | None:
    """``(sensitive, keys, how)``: the user's column if usable, else the most balanced one.

    All other columns are keys, or the first ``most_keys`` of them.
    """
    shares = {r["column"]: (r["share"], r["position"]) for r in sensitive_shares(real, categorical).collect()}
    if not shares:
        return None
    if wanted in shares:
        sensitive, how = wanted, "user"
    else:
        sensitive = min(shares, key=shares.get)
        how = f"auto ('{wanted}' not usable)" if wanted else "auto"
    return sensitive, [c for c in categorical if c != sensitive][:most_keys], how


def _labels(df: DataFrame, keys: list[str], sensitive: str) -> DataFrame:
    marked = [F.coalesce(F.col(c).cast("string"), F.lit("\u0000")).alias(f"k{i}") for i, c in enumerate(keys)]
    secret = F.coalesce(F.col(sensitive).cast("string"), F.lit("\u0000")).alias("s")
    names = [f"k{i}" for i in range(len(keys))]
    return df.select(*marked, secret).groupBy(*names, "s").agg(F.count(F.lit(1)).alias("n"))


def categorical_cap(real: DataFrame, attacker: DataFrame, keys: list[str], sensitive: str) -> DataFrame:
    """One row ``(n_matched, score)``: 1 - mean chance to infer the secret from an exact key.

    Both sides are reduced to counts per key combination first; NULL score when
    no real key occurs in the attacker's table.
    """
    names = [f"k{i}" for i in range(len(keys))]
    known = _labels(attacker, keys, sensitive)
    targets = _labels(real, keys, sensitive)
    totals = known.groupBy(*names).agg(F.sum("n").alias("total"))
    hits = known.withColumnRenamed("n", "hits")
    joined = targets.join(totals, names).join(hits, [*names, "s"], "left")
    chance = F.coalesce("hits", F.lit(0)) / F.col("total")
    return joined.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_matched"),
        (1 - F.try_divide(F.sum(F.col("n") * chance), F.sum("n"))).alias("score"),
    )


def _masked(labels: DataFrame, names: list[str], subsets: list[tuple[str, ...]], keep: list[str]) -> DataFrame:
    """A row per subset of the keys, ``mask`` being its values and its number."""
    masks = [
        F.to_json(F.array(F.lit(str(i)), *[F.col(n) if n in subset else F.lit(None).cast("string") for n in names]))
        for i, subset in enumerate(subsets)
    ]
    return labels.select(*keep, F.explode(F.array(*masks)).alias("mask"))


def generalized_cap(real: DataFrame, attacker: DataFrame, keys: list[str], sensitive: str) -> DataFrame:
    """Same attack, using the attacker rows at the smallest Hamming distance on the keys.

    Level by level: at distance h all key subsets of size k-h are looked up in one join,
    and only targets without any match go on to the next. At the smallest distance with
    a match the subsets match disjoint rows, so counts add. Keys that many targets share
    are spread over tasks.
    """
    names = [f"k{i}" for i in range(len(keys))]
    known = durable(_labels(attacker, keys, sensitive))
    open_ = durable(_labels(real, keys, sensitive).withColumn("target", F.monotonically_increasing_id()))
    parts = []
    for distance in range(len(names) + 1):
        subsets = list(combinations(names, len(names) - distance))
        seen = _masked(known, names, subsets, ["s", "n"]).groupBy("mask", "s").agg(F.sum("n").alias("hits"))
        totals = seen.groupBy("mask").agg(F.sum("hits").alias("total"))
        asked = durable(_masked(open_, names, subsets, ["target", "s"]))
        heavy = heavy_keys(asked, ["mask"])
        met = spread_join(asked, totals, ["mask"], "inner", heavy)
        met = met.groupBy("target").agg(F.sum("total").alias("total"))
        right = spread_join(asked, seen, ["mask", "s"], "inner").groupBy("target").agg(F.sum("hits").alias("hits"))
        level = durable(open_.join(met, "target", "left").join(right, "target", "left"))
        parts.append(level.where("total > 0").select("n", (F.coalesce("hits", F.lit(0)) / F.col("total")).alias("chance")))
        open_ = level.where("total IS NULL").select(*open_.columns)
        if open_.isEmpty():
            break
    matched = reduce(DataFrame.union, parts)
    return matched.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_matched"),
        (1 - F.try_divide(F.sum(F.col("n") * F.col("chance")), F.sum("n"))).alias("score"),
    )


def cap_attack(real: DataFrame, attacker: DataFrame, keys: list[str], sensitive: str) -> DataFrame:
    """``(score, variant)``: the exact attack, or the nearest-key one where it scores nothing."""
    exact = categorical_cap(real, attacker, keys, sensitive).select("score")
    nearest = generalized_cap(real, attacker, keys, sensitive).select("score").scalar()
    return exact.select(
        F.coalesce("score", nearest).alias("score"),
        F.when(F.col("score").isNotNull(), "exact").otherwise("generalized").alias("variant"),
    )


# ---- verdicts --------------------------------------------------------------

METRIC_SCHEMA = "synth string, table string, metric string, value double, baseline double, note string"


def _graded(gap: Column, ok: float, warn: float) -> Column:
    return F.when(gap <= ok, "PASS").when(gap <= warn, "WARN").otherwise("FAIL")


def privacy_verdicts(metrics: DataFrame) -> DataFrame:
    """Add ``status`` and ``detail`` to metric rows (schema ``METRIC_SCHEMA``).

    A copy is judged against what real holdout rows score under the same attack
    when a baseline exists; a value that could not be computed is SKIP, not FAIL.
    """
    value, baseline, metric = F.col("value"), F.col("baseline"), F.col("metric")
    gap = baseline - value
    membership = _graded(F.abs(value - 0.5), 0.10, 0.20)
    new_rows = F.when(baseline.isNotNull(), _graded(gap, 0.05, 0.20)).otherwise(
        F.when(value >= 0.9, "PASS").when(value >= 0.7, "WARN").otherwise("FAIL")
    )
    cap = F.when(baseline.isNotNull(), _graded(gap, 0.05, 0.20)).otherwise(
        F.when(value >= 0.5, "PASS").when(value >= 0.3, "WARN").otherwise("FAIL")
    )
    status = (
        F.when(value.isNull() | F.isnan(value), "SKIP")
        .when(metric == "membership_inference", membership)
        .when(metric == "new_row_synthesis", new_rows)
        .otherwise(cap)
    )
    low = F.when(metric == "new_row_synthesis", baseline < 0.9).otherwise(baseline < 0.5)
    against = F.concat(
        F.concat(printed(value, 3), F.lit(" vs "), printed(baseline, 3), F.lit(" for a real holdout: ")),
        F.when(gap <= 0.05, "reaches the achievable ceiling").otherwise(F.concat(printed(gap, 2), F.lit(" below it"))),
        F.when(low, " (low ceiling: a property of the table)").otherwise(""),
    )
    detail = (
        F.when(status == "SKIP", F.when(F.col("note") != "", F.col("note")).otherwise("not computable"))
        .when(metric == "membership_inference", F.concat(F.lit("attacker AUC="), printed(value, 3)))
        .when(baseline.isNotNull(), against)
        .otherwise(F.concat(printed(value, 3), F.lit(", no baseline")))
    )
    return metrics.withColumns({"status": status, "detail": detail})
