"""Utility: train on synthetic, test on real, and compare with training on real."""

from __future__ import annotations

from dataclasses import dataclass
from functools import partial

from pyspark.ml.classification import (
    DecisionTreeClassifier, LogisticRegression, RandomForestClassifier,
)
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinlens.functions.hashing import hash_uniform
from twinlens.functions.values import as_number
from twinlens.model import ColumnRoles
from twinlens.operators.counting import before_run, long_cells, ordered_runs, text_counts
from twinlens.operators.encode import fit_encoder
from twinlens.operators.lookup import value_counts, value_steps, values_to
from twinlens.session import durable, side_by_side, spread

REAL = "real"
MISSING = "__nan__"
EFFICACY_SCHEMA = (
    "table string, target string, task string, metric string, train_on string, score double, note string"
)
FULL_SCHEMA = (
    "table string, target string, task string, model string, train_on string, "
    "accuracy double, f1 double, roc_auc double, rmse double, r2 double"
)

# Metric labels of the tidy frame.
BINARY_F1 = "BinaryDecisionTreeClassifier (F1)"
MACRO_F1 = "MulticlassDecisionTreeClassifier (macro F1)"
LINEAR_R2 = "LinearRegression (R2)"
EXTRA = {
    "accuracy": "DecisionTree · accuracy",
    "precision_macro": "DecisionTree · precision (macro)",
    "recall_macro": "DecisionTree · recall (macro)",
}


# ---- target and data preparation -------------------------------------------


def target_candidates(df: DataFrame, roles: ColumnRoles) -> DataFrame:
    """``(column, position, kind, n_distinct, n_filled, variance)`` of every modelled column."""
    spark = df.sparkSession
    place = spark.createDataFrame(
        [(c, i, "categorical" if c in roles.categorical else "numeric") for i, c in enumerate(roles.categorical + roles.numeric)],
        "column string, position int, kind string",
    )
    stats = spark.createDataFrame([], "column string, n_distinct bigint, n_filled bigint, variance double")
    if roles.categorical:
        counts = text_counts(df, roles.categorical).groupBy("column").agg(
            F.count("value").alias("n_distinct"),
            F.sum(F.when(F.col("value").isNotNull(), F.col("n"))).alias("n_filled"),
        )
        stats = stats.union(counts.withColumn("variance", F.lit(None).cast("double")))
    if roles.numeric:
        cells = long_cells(df, {c: as_number(F.col(c)) for c in roles.numeric})
        numbers = cells.groupBy("column").agg(
            F.lit(None).cast("bigint").alias("n_distinct"),
            F.count("value").alias("n_filled"),
            F.var_samp("value").alias("variance"),
        )
        stats = stats.union(numbers)
    return place.join(F.broadcast(stats), "column", "left")  # one row per column


def auto_select_target(df: DataFrame, roles: ColumnRoles) -> tuple[str, str] | None:
    """First categorical with 2..20 classes, else the numeric column that varies most."""
    rows = sorted(target_candidates(df, roles).collect(), key=lambda r: r["position"])
    for r in rows:
        if r["kind"] == "categorical" and 2 <= (r["n_distinct"] or 0) <= 20:
            return r["column"], "classification"
    numeric = [r for r in rows if r["kind"] == "numeric" and (r["n_filled"] or 0) >= 20]
    if numeric:
        return max(numeric, key=lambda r: r["variance"])["column"], "regression"
    return None


def resolve_task(target: str, roles: ColumnRoles, n_distinct: int | None = None) -> str:
    """Task of an overridden target; few distinct values also make it a class."""
    if target in roles.categorical or (n_distinct is not None and 2 <= n_distinct <= 20):
        return "classification"
    return "regression"


def drop_unseen_targets(train: DataFrame, test: DataFrame, target: str) -> DataFrame:
    """Test rows whose class (as text) occurs in the training rows."""
    known = train.where(F.col(target).isNotNull()).select(F.col(target).cast("string").alias("__class")).distinct()
    return test.join(known, F.col(target).cast("string") == F.col("__class"), "left_semi")


def _labelled(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(MISSING))


def align_categories(train: DataFrame, test: DataFrame, columns: list[str]) -> tuple[DataFrame, DataFrame, int]:
    """``(train, test, columns changed)``: missing becomes a category, unknown ones the mode.

    The known categories are one counted row per value; the test side looks all its
    columns up in one exchange, so nothing depends on how many there are.
    """
    columns = [c for c in columns if c in train.columns and c in test.columns]
    train = train.withColumns({c: _labelled(c) for c in columns}) if columns else train
    test = test.withColumns({c: _labelled(c) for c in columns}) if columns else test
    if not columns:
        return train, test, 0
    counts = value_counts(train, columns)
    modes = counts.groupBy("column").agg(F.min_by("value", F.struct(-F.col("n"), F.col("value"))).alias("mode"))
    mode = {r["column"]: r["mode"] for r in modes.collect()}  # one row per column
    totals = counts.groupBy("column").agg(F.sum("n").alias("total"))
    known = counts.join(F.broadcast(totals), "column")
    test = values_to(test, known, {f"__known_{c}": (c, F.col(c)) for c in columns}, F.lit(True))
    seen = test.agg(*[F.max(F.col(f"__known_{c}").isNull()).alias(c) for c in columns]).first()
    test = test.withColumns({c: F.when(F.col(f"__known_{c}"), F.col(c)).otherwise(F.lit(mode.get(c, MISSING))) for c in columns})
    return train, test.drop(*[f"__known_{c}" for c in columns]), sum(bool(seen[c]) for c in columns)


def cap_training_rows(df: DataFrame, key: Column, limit: int = 20_000, seed: int = 0) -> DataFrame:
    """Repeatable sample of at most ``limit`` rows without replacement (opt-in)."""
    order = hash_uniform(key, "train-cap", seed)
    return df.withColumn("__order", order).orderBy("__order", key).limit(limit).drop("__order")


# ---- scores ----------------------------------------------------------------


def class_table(predictions: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """``(class, hits, n_label, n_predicted)`` for every class labelled or predicted."""
    cells = predictions.groupBy(F.col(label).alias("l"), F.col(prediction).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    zero = F.lit(0)
    sides = F.array(
        F.struct(F.col("l").alias("class"), F.when(F.col("l") == F.col("p"), F.col("n")).otherwise(zero).alias("hits"),
                 F.col("n").alias("n_label"), zero.cast("bigint").alias("n_predicted")),
        F.struct(F.col("p").alias("class"), zero.cast("bigint").alias("hits"),
                 zero.cast("bigint").alias("n_label"), F.col("n").alias("n_predicted")),
    )
    return cells.select(F.inline(sides)).groupBy("class").agg(*[F.sum(c).alias(c) for c in ("hits", "n_label", "n_predicted")])


def _f1() -> Column:
    return F.coalesce(F.try_divide(2 * F.col("hits"), F.col("n_label") + F.col("n_predicted")), F.lit(0.0))


def classification_scores(predictions: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Accuracy, macro precision and recall, macro and weighted F1, in one row."""
    def share(part: str) -> Column:
        return F.coalesce(F.try_divide("hits", part), F.lit(0.0))

    return class_table(predictions, label, prediction).agg(
        (F.sum("hits") / F.sum("n_label")).alias("accuracy"),
        F.avg(share("n_predicted")).alias("precision_macro"),
        F.avg(share("n_label")).alias("recall_macro"),
        F.avg(_f1()).alias("f1_macro"),
        (F.sum(_f1() * F.col("n_label")) / F.sum("n_label")).alias("f1_weighted"),
    )


def positive_f1(predictions: DataFrame, positive: str | float, label: str = "label", prediction: str = "prediction") -> DataFrame:
    table = class_table(predictions, label, prediction).where(F.col("class") == positive)
    return table.agg(F.coalesce(F.max(_f1()), F.lit(0.0)).alias("f1"))


def regression_scores(predictions: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """RMSE and R2 in one row (R2 against the labels' own mean)."""
    error = F.col(label) - F.col(prediction)
    return predictions.agg(
        F.sqrt(F.avg(error * error)).alias("rmse"),
        (1 - F.try_divide(F.sum(error * error), F.var_pop(label) * F.count(label))).alias("r2"),
    )


def grouped_auc(scored: DataFrame, ids: list[str], positive: str, score: str) -> DataFrame:
    """``(*ids, n_positive, n_negative, auc)`` by rank sums with tied scores averaged.

    Scores are counted and ranked range by range, never in one task.
    """
    counts = scored.groupBy(*ids, F.col(score).alias("value")).agg(
        F.count_if(F.col(positive) == 1).alias("pos"), F.count_if(F.col(positive) == 0).alias("neg")
    )
    runs = ordered_runs(counts, ids, "value", ["neg"])
    below = F.col("cum_neg") - F.col("neg") / 2
    per_run = runs.groupBy(*ids, "run").agg(
        F.min("value").alias("run_first"), F.sum("pos").alias("pos"), F.sum("neg").alias("neg"),
        F.sum(F.col("pos") * below).alias("wins"),
    )
    carried = per_run.withColumn("wins", F.col("wins") + F.col("pos") * before_run(ids, "neg"))
    total = carried.groupBy(*ids).agg(
        F.sum("pos").alias("n_positive"), F.sum("neg").alias("n_negative"), F.sum("wins").alias("wins")
    )
    auc = F.try_divide(F.col("wins"), F.col("n_positive").cast("double") * F.col("n_negative"))
    return total.select(*ids, "n_positive", "n_negative", auc.alias("auc"))


def binary_auc(scored: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """One row ``(n_positive, n_negative, auc)``; ``label`` is 1 or 0."""
    one = scored.select(F.lit(0).alias("__all"), F.col(label).alias("label"), F.col(score).alias("score"))
    return grouped_auc(one, ["__all"], "label", "score").drop("__all")


def weighted_auc(
    scored: DataFrame, classes: list[str] | None = None, label: str = "label", scores: str = "scores"
) -> DataFrame:
    """One-vs-rest AUC weighted by class support; ``scores`` has a probability per class.

    ``label`` is the place of a row's class in ``scores``, or its name if ``classes`` lists the names.
    """
    if classes:
        scored = scored.withColumn(label, F.array_position(F.lit(classes), F.col(label)) - 1)
    cells = scored.select(label, F.posexplode(scores).alias("class", "score"))
    per_class = grouped_auc(cells.withColumn("hit", (F.col(label) == F.col("class")).cast("int")), ["class"], "hit", "score")
    usable = per_class.where(F.col("auc").isNotNull())
    return usable.agg((F.sum(F.col("auc") * F.col("n_positive")) / F.sum("n_positive")).alias("auc"))


# ---- train / test ----------------------------------------------------------


@dataclass
class Prepared:
    """Encoded training and test rows of one source, written once for all models.

    ``y`` is the number, or the place of the class among the training classes in text order.
    """

    train: DataFrame
    test: DataFrame
    task: str
    n_classes: int


def _n_classes(train: DataFrame, target: str) -> int:
    return train.select(F.count_distinct(F.col(target).cast("string"))).first()[0]


def _prepare(train: DataFrame, test: DataFrame, roles: ColumnRoles, target: str, task: str) -> Prepared:
    """Encode with statistics of the training rows; classes are numbered in a table, not in the plan.

    Models read the training rows again and again, so these are spread over all cores.
    """
    encoder = fit_encoder(train, roles.without(target))
    if task != "classification":
        y = as_number(F.col(target)).cast("double").alias("y")
        sides = [encoder.vectors(df, y).where(F.col("y").isNotNull()) for df in (train, test)]
        return Prepared(spread(sides[0]), sides[1], task, 0)
    counts = value_counts(train, [target], nulls=False)
    steps = value_steps(counts)
    sides = []
    for df in (train, test):
        numbered = values_to(df, steps, {"__y": (target, F.col(target).cast("string"))}, F.col("place"))
        sides.append(encoder.vectors(numbered, F.col("__y").cast("double").alias("y")).where(F.col("y").isNotNull()))
    return Prepared(spread(sides[0]), sides[1], task, counts.count())


def _predict(data: Prepared, model) -> DataFrame:
    """``(label, prediction[, scores])`` of the test rows, classes as their places."""
    fitted = model.setFeaturesCol("features").setLabelCol("y").fit(data.train)
    out = fitted.transform(data.test).withColumnRenamed("y", "label")
    if data.task != "classification":
        return durable(out.select("label", "prediction"))
    scores = vector_to_array("probability") if "probability" in out.columns else F.array().cast("array<double>")
    return durable(out.select("label", "prediction", scores.alias("scores")))


def _note(dropped: int, aligned: int) -> str:
    parts = []
    if dropped:
        parts.append(f"{dropped} test rows have a class that training lacks and were left out")
    if aligned:
        parts.append(f"{aligned} columns hold categories that training lacks; read as missing")
    return "; ".join(parts)


def tstr(
    train: DataFrame,
    holdout: DataFrame,
    copies: dict[str, DataFrame],
    roles: ColumnRoles,
    target: str,
    task: str,
    table: str = "",
    max_depth: int = 12,
    max_train_rows: int | None = None,
    row_key: Column | None = None,
    seed: int = 0,
) -> DataFrame:
    """Tidy efficacy rows: one model per training source, all tested on one holdout.

    A decision tree (F1, accuracy, macro precision and recall) or a linear
    regression (R2), plus ``gap(real-<copy>)`` rows.  All training rows are used
    unless ``max_train_rows`` (with ``row_key``) asks for a sample.
    """
    spark = train.sparkSession
    wanted = [c for c in roles.modelable if c in holdout.columns]
    wanted += [target] if target not in wanted else []
    test = holdout.select(*wanted).where(F.col(target).isNotNull())
    n_test = test.count()

    def scores(source: str, frame: DataFrame) -> list[tuple]:
        fit_rows = frame.where(F.col(target).isNotNull())
        if max_train_rows is not None and row_key is not None:
            fit_rows = cap_training_rows(fit_rows, row_key, max_train_rows, seed)
        fit_rows = fit_rows.select(*[c for c in wanted if c in frame.columns])
        if fit_rows.limit(10).count() < 10 or n_test < 5:
            return []
        seen = drop_unseen_targets(fit_rows, test, target) if task == "classification" else test
        n_seen = seen.count() if task == "classification" else n_test
        features = [c for c in roles.categorical if c != target]
        aligned_train, aligned_test, changed = align_categories(fit_rows, seen, features)
        note = _note(n_test - n_seen, changed)
        return [
            (table, target, task, metric, source, score, "; ".join(x for x in (note, problem) if x))
            for metric, score, problem in _source_scores(aligned_train, aligned_test, roles, target, task, n_seen, max_depth, seed)
        ]

    sources = {name: frame for name, frame in {REAL: train, **copies}.items() if target in frame.columns}
    rows = sum(side_by_side(spark, [partial(scores, *source) for source in sources.items()]), [])
    tidy = spark.createDataFrame(rows, EFFICACY_SCHEMA)
    return tidy.unionByName(efficacy_gaps(tidy))


def _source_scores(train, test, roles, target, task, n_test, max_depth, seed):
    """(metric, score, note); a source that cannot be fitted gets notes instead of scores."""
    try:
        return _fitted_scores(train, test, roles, target, task, n_test, max_depth, seed)
    except ValueError as error:
        if task != "classification":
            return [(LINEAR_R2, None, str(error))]
        headline = BINARY_F1 if _n_classes(train, target) == 2 else MACRO_F1
        return [(m, None, str(error)) for m in (headline, *EXTRA.values())]


def _fitted_scores(train, test, roles, target, task, n_test, max_depth, seed):
    if task != "classification":
        predictions = _predict(_prepare(train, test, roles, target, task), LinearRegression(maxIter=100))
        return [(LINEAR_R2, regression_scores(predictions).first()["r2"], "")]
    if n_test < 5:
        headline = BINARY_F1 if _n_classes(train, target) == 2 else MACRO_F1
        problem = "fewer than 5 test rows are left"
        return [(m, None, problem) for m in (headline, *EXTRA.values())]
    data = _prepare(train, test, roles, target, task)
    predictions = _predict(data, DecisionTreeClassifier(maxDepth=max_depth, maxBins=64, seed=seed))
    scores = classification_scores(predictions).first()
    if data.n_classes == 2:
        headline, f1 = BINARY_F1, positive_f1(predictions, 1.0).first()["f1"]  # the last class in text order
    else:
        headline, f1 = MACRO_F1, scores["f1_macro"]
    return [(headline, f1, ""), *[(label, scores[key], "") for key, label in EXTRA.items()]]


def efficacy_gaps(efficacy: DataFrame) -> DataFrame:
    """Rows ``gap(real-<copy>)`` = real score - copy score per table and metric."""
    scored = efficacy.where(F.col("score").isNotNull() & ~F.isnan("score"))
    base = scored.where(F.col("train_on") == REAL).select("table", "metric", F.col("score").alias("real_score"))
    other = scored.where((F.col("train_on") != REAL) & ~F.col("train_on").startswith("gap("))
    return other.join(base, ["table", "metric"]).select(
        "table", "target", "task", "metric",
        F.concat(F.lit("gap(real-"), "train_on", F.lit(")")).alias("train_on"),
        (F.col("real_score") - F.col("score")).alias("score"),
        F.lit("").alias("note"),
    )


def _model(task: str, kind: str, trees: int, seed: int):
    if task == "classification":
        if kind == "RandomForest":
            return RandomForestClassifier(numTrees=trees, maxDepth=10, maxBins=64, seed=seed)
        return LogisticRegression(maxIter=1000)
    if kind == "RandomForest":
        return RandomForestRegressor(numTrees=trees, maxDepth=10, maxBins=64, seed=seed)
    return LinearRegression(maxIter=1000)


def tstr_full(
    train: DataFrame,
    holdout: DataFrame,
    copies: dict[str, DataFrame],
    roles: ColumnRoles,
    target: str,
    task: str,
    table: str = "",
    trees: int = 200,
    seed: int = 0,
) -> DataFrame:
    """Second protocol: a random forest and a linear baseline per training source.

    Rows without a target are dropped on both sides.
    """
    spark = train.sparkSession
    kinds = ("RandomForest", "baseline")

    def score(source: str, data: Prepared | None, kind: str) -> tuple:
        if data is None:
            return (table, target, task, kind, source, None, None, None, None, None)
        predictions = _predict(data, _model(task, kind, trees, seed))
        if task == "classification":
            s = classification_scores(predictions).first()
            auc = weighted_auc(predictions).first()["auc"]
            return (table, target, task, kind, source, s["accuracy"], s["f1_weighted"], auc, None, None)
        s = regression_scores(predictions).first()
        return (table, target, task, kind, source, None, None, None, s["rmse"], s["r2"])

    def judged(source: str, frame: DataFrame) -> list[tuple]:
        """A row per model, or none if the source cannot be trained on."""
        fit_rows = frame.where(F.col(target).isNotNull())
        if fit_rows.limit(10).count() < 10:
            return []
        if task == "classification" and _n_classes(fit_rows, target) < 2:
            return []
        test = holdout.where(F.col(target).isNotNull())
        if task == "classification":
            test = drop_unseen_targets(fit_rows, test, target)
        try:
            data = _prepare(fit_rows, test, roles, target, task)  # encoded once for both models
        except ValueError:  # no other column can be encoded
            data = None
        return side_by_side(spark, [partial(score, source, data, kind) for kind in kinds])

    sources = [(source, frame) for source, frame in {REAL: train, **copies}.items() if target in frame.columns]
    found = side_by_side(spark, [partial(judged, *source) for source in sources])
    rows = [row for per_kind in zip(*filter(None, found), strict=True) for row in per_kind]
    frame = spark.createDataFrame(rows, FULL_SCHEMA)
    metric = "accuracy" if task == "classification" else "r2"
    base = frame.where(F.col("train_on") == REAL).select("model", F.col(metric).alias("base"))
    gaps = frame.where(F.col("train_on") != REAL).join(base, "model").select(
        "table", "target", "task", "model", F.concat(F.lit("gap(real-"), "train_on", F.lit(")")).alias("train_on"),
        (F.col("base") - F.col(metric)).alias(metric),
    )
    return frame.unionByName(gaps, allowMissingColumns=True)
