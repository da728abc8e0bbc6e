"""Utility queries (U-01 ... U-11)."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import LINE_COPIES_SQL, LINE_ROLES, LINE_SPLIT_SQL, ORDER_ROLES, ORDERS_SPLIT_SQL, lineitem_boot, lineitem_split, load, orders_split, rounded, uniform_sql
from catalog.privacy import customer_split, orders_copies
from twinlens.operators import utility
from twinlens.operators.counting import text_counts
from twinlens.operators.refill import bootstrap_table

_ROLES = LINE_ROLES


def _candidates(spark, sf):
    train, _ = lineitem_split(spark, sf)
    return rounded(utility.target_candidates(train, _ROLES), 3)


def _unseen(spark, sf):
    """Training rows know no 'P' orders, so those leave the test rows."""
    train, held = orders_split(spark, sf)
    return rounded(utility.drop_unseen_targets(train.where("o_orderstatus <> 'P'"), held, "o_orderstatus"))


def _align(spark, sf):
    train, held = orders_split(spark, sf)
    narrow = train.where("o_orderpriority <> '1-URGENT'").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    gaps = held.select(
        "o_orderkey", F.when(F.pmod("o_orderkey", F.lit(7)) != 0, F.col("o_orderstatus")).alias("o_orderstatus"), "o_orderpriority"
    )
    _, test, _ = utility.align_categories(narrow, gaps, ["o_orderstatus", "o_orderpriority"])
    return test


def _cap_rows(spark, sf):
    return utility.cap_training_rows(load(spark, sf, "orders").select("o_orderkey"), F.col("o_orderkey"), 500)


def _predicted(spark, sf):
    """A fixed rule as the classifier: price bands against the real status."""
    price = F.col("o_totalprice")
    guess = F.when(price > 400000, "P").when(price > 200000, "F").otherwise("O")
    return load(spark, sf, "orders").select(F.col("o_orderstatus").alias("label"), guess.alias("prediction"))


def _classification(spark, sf):
    return rounded(utility.classification_scores(_predicted(spark, sf)))


def _regression(spark, sf):
    rows = load(spark, sf, "lineitem").select(
        F.col("l_extendedprice").alias("label"), (F.col("l_quantity") * 2000 + 5000).alias("prediction")
    )
    return rounded(utility.regression_scores(rows))


def _auc(spark, sf):
    rows = load(spark, sf, "lineitem").select(
        (F.col("l_returnflag") == "A").cast("int").alias("label"),
        (F.col("l_quantity") * F.col("l_discount") + F.when(F.col("l_returnflag") == "A", 0.3).otherwise(0.0)).alias("score"),
    )
    return rounded(utility.binary_auc(rows))


def _auc_classes(spark, sf):
    price = F.col("o_totalprice") / 500000
    scores = F.array(price, 1 - price, F.abs(price - 0.5))
    rows = load(spark, sf, "orders").select(F.col("o_orderstatus").alias("label"), scores.alias("scores"))
    return rounded(utility.weighted_auc(rows, ["F", "O", "P"]))


def efficacy_frame(spark, sf):
    """Tidy efficacy rows made of order statistics: F is 'real', O and P two copies."""
    train_on = F.when(F.col("o_orderstatus") == "F", "real").when(F.col("o_orderstatus") == "O", "a").otherwise("b")
    return (
        load(spark, sf, "orders")
        .groupBy(F.col("o_orderpriority").alias("table"), F.concat(F.lit("m"), F.pmod("o_orderkey", F.lit(3)).cast("string")).alias("metric"), train_on.alias("train_on"))
        .agg(F.round(F.avg(F.col("o_totalprice") - 250000) / 10000, 6).alias("score"))
        .select("table", F.lit("t").alias("target"), F.lit("regression").alias("task"), "metric", "train_on", "score", F.lit("").alias("note"))
    )


def _gaps(spark, sf):
    return rounded(utility.efficacy_gaps(efficacy_frame(spark, sf)), 5)


def _tstr(spark, sf):
    train, held, boot = orders_copies(spark, sf)
    return rounded(utility.tstr(train, held, {"boot": boot}, ORDER_ROLES, "o_orderstatus", "classification", "ORDERS"))


def _tstr_regression(spark, sf):
    train, held = lineitem_split(spark, sf, LINE_ROLES.modelable)
    boot = lineitem_boot(train)
    return rounded(utility.tstr(train, held, {"boot": boot}, LINE_ROLES, "l_extendedprice", "regression", "LINEITEM"))


def _tstr_line(spark, sf):
    """One feature, so that the fitted line has a closed form."""
    from twinlens.model import ColumnRoles

    roles = ColumnRoles(["l_quantity", "l_extendedprice"], [])
    train, held = lineitem_split(spark, sf, roles.modelable)
    copies = {"boot": lineitem_boot(train, roles.modelable)}
    frame = utility.tstr(train, held, copies, roles, "l_extendedprice", "regression", "LINEITEM")
    return rounded(frame.select("metric", "train_on", "score"), 5)


def _tstr_full(spark, sf):
    from twinlens.model import ColumnRoles

    train, held = customer_split(spark, sf)
    roles = ColumnRoles(["c_acctbal", "c_nationkey"], ["c_mktsegment"])
    boot = bootstrap_table(train, F.col("c_custkey"), roles.modelable, seed=9, small=["c_mktsegment"])
    return rounded(utility.tstr_full(train, held, {"boot": boot}, roles, "c_mktsegment", "classification", "CUSTOMER"))


def _tasks(spark, sf):
    """Task of every column as a chosen target, once by its role and once by its distinct values as well."""
    train, _ = lineitem_split(spark, sf)
    columns = [*_ROLES.categorical, *_ROLES.numeric, "l_orderkey"]
    counts = {r["column"]: r["n"] for r in text_counts(train, columns).groupBy("column").agg(F.count("value").alias("n")).collect()}
    rows = [(c, utility.resolve_task(c, _ROLES), utility.resolve_task(c, _ROLES, counts[c]), counts[c]) for c in columns]
    return spark.createDataFrame(rows, "column string, by_role string, by_values string, n_distinct long")


QUERIES = {
    "u01_target_candidates": _candidates,
    "u02_resolve_task": _tasks,
    "u03_drop_unseen_targets": _unseen,
    "u04_align_categories": _align,
    "u05_cap_training_rows": _cap_rows,
    "u06_tstr": _tstr,
    "u06_tstr_regression": _tstr_regression,
    "u06_tstr_line": _tstr_line,
    "u07_classification_scores": _classification,
    "u08_regression_scores": _regression,
    "u09_binary_auc": _auc,
    "u09_weighted_auc": _auc_classes,
    "u10_tstr_full": _tstr_full,
    "u11_efficacy_gaps": _gaps,
}

# ---- SQL -------------------------------------------------------------------

EFFICACY_SQL = (
    "SELECT o_orderpriority AS \"table\", 't' AS target, 'regression' AS task, 'm' || (o_orderkey % 3) AS metric, "
    "CASE o_orderstatus WHEN 'F' THEN 'real' WHEN 'O' THEN 'a' ELSE 'b' END AS train_on, "
    "round(avg(o_totalprice - 250000) / 10000, 6) AS score, '' AS note FROM orders GROUP BY ALL"
)


def _candidates_sql() -> str:
    rows = []
    for i, c in enumerate(_ROLES.categorical + _ROLES.numeric):
        if c in _ROLES.categorical:
            rows.append(f"SELECT '{c}' AS \"column\", {i} AS position, 'categorical' AS kind, count(DISTINCT {c}) AS n_distinct, count({c}) AS n_filled, NULL::DOUBLE AS variance FROM train")
        else:
            rows.append(f"SELECT '{c}', {i}, 'numeric', NULL::BIGINT, count({c}), round(var_samp({c}), 3) FROM train")
    return f"WITH {LINE_SPLIT_SQL} " + " UNION ALL ".join(rows)


_GUESS = "CASE WHEN o_totalprice > 400000 THEN 'P' WHEN o_totalprice > 200000 THEN 'F' ELSE 'O' END"
_AUC = (
    "SELECT {s} AS n_positive, {t} AS n_negative, (sum(CASE WHEN y = 1 THEN r END) - {s}::DOUBLE * ({s} + 1) / 2) / ({s}::DOUBLE * {t}) AS auc FROM "
    "(SELECT y, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS r FROM ({rows}))"
).replace("{s}", "count_if(y = 1)::BIGINT").replace("{t}", "count_if(y = 0)::BIGINT")
_SCORES = {"F": "o_totalprice / 500000", "O": "1 - o_totalprice / 500000", "P": "abs(o_totalprice / 500000 - 0.5)"}

SQL = {
    "u01_target_candidates": _candidates_sql(),
    "u02_resolve_task": f"WITH {LINE_SPLIT_SQL} SELECT \"column\", CASE WHEN c THEN 'classification' ELSE 'regression' END AS by_role, "
    "CASE WHEN c OR n_distinct BETWEEN 2 AND 20 THEN 'classification' ELSE 'regression' END AS by_values, n_distinct FROM ("
    + " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", {c in _ROLES.categorical} AS c, count(DISTINCT {c}) AS n_distinct FROM train"
        for c in [*_ROLES.categorical, *_ROLES.numeric, "l_orderkey"]
    )
    + ")",
    "u03_drop_unseen_targets": f"WITH {ORDERS_SPLIT_SQL} SELECT * FROM held WHERE o_orderstatus IN (SELECT o_orderstatus FROM train WHERE o_orderstatus <> 'P')",
    "u04_align_categories": (
        f"WITH {ORDERS_SPLIT_SQL}, tr AS (SELECT * FROM train WHERE o_orderpriority <> '1-URGENT'), "
        "md AS (SELECT (SELECT o_orderstatus FROM tr GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS s, "
        "(SELECT o_orderpriority FROM tr GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS p) "
        "SELECT o_orderkey, CASE WHEN o_orderkey % 7 <> 0 AND o_orderstatus IN (SELECT o_orderstatus FROM tr) THEN o_orderstatus ELSE md.s END AS o_orderstatus, "
        "CASE WHEN o_orderpriority IN (SELECT o_orderpriority FROM tr) THEN o_orderpriority ELSE md.p END AS o_orderpriority FROM held, md"
    ),
    "u05_cap_training_rows": f"SELECT o_orderkey FROM orders ORDER BY {uniform_sql('o_orderkey', 'train-cap', 0)}, o_orderkey LIMIT 500",
    "u06_tstr_line": (
        f"WITH {LINE_COPIES_SQL}, "
        + ", ".join(
            f"m_{s} AS (SELECT regr_slope(l_extendedprice, l_quantity) AS b, regr_intercept(l_extendedprice, l_quantity) AS a FROM {s}), "
            f"s_{s} AS (SELECT 1 - sum((l_extendedprice - a - b * l_quantity) ** 2) / (var_pop(l_extendedprice) * count(*)) AS score FROM held, m_{s})"
            for s in ("train", "boot")
        )
        + " SELECT 'LinearRegression (R2)' AS metric, 'real' AS train_on, round(score, 5) AS score FROM s_train "
        "UNION ALL SELECT 'LinearRegression (R2)', 'boot', round(score, 5) FROM s_boot "
        "UNION ALL SELECT 'LinearRegression (R2)', 'gap(real-boot)', round(s_train.score - s_boot.score, 5) FROM s_train, s_boot"
    ),
    "u07_classification_scores": (
        f"WITH p AS (SELECT o_orderstatus AS l, {_GUESS} AS g FROM orders), c AS (SELECT DISTINCT l AS c FROM p UNION SELECT DISTINCT g FROM p), "
        "t AS (SELECT c, (SELECT count(*) FROM p WHERE l = c AND g = c)::DOUBLE AS tp, (SELECT count(*) FROM p WHERE l = c)::DOUBLE AS nl, (SELECT count(*) FROM p WHERE g = c)::DOUBLE AS np FROM c), "
        "s AS (SELECT *, CASE WHEN np > 0 THEN tp / np ELSE 0 END AS pr, CASE WHEN nl > 0 THEN tp / nl ELSE 0 END AS re, 2 * tp / (nl + np) AS f FROM t) "
        "SELECT round(sum(tp) / sum(nl), 6) AS accuracy, round(avg(pr), 6) AS precision_macro, round(avg(re), 6) AS recall_macro, "
        "round(avg(f), 6) AS f1_macro, round(sum(f * nl) / sum(nl), 6) AS f1_weighted FROM s"
    ),
    "u08_regression_scores": (
        "WITH p AS (SELECT l_extendedprice AS y, l_quantity * 2000 + 5000 AS h FROM lineitem) SELECT round(sqrt(avg((y - h) ** 2)), 6) AS rmse, "
        "round(1 - sum((y - h) ** 2) / (var_pop(y) * count(y)), 6) AS r2 FROM p"
    ),
    "u09_binary_auc": "SELECT n_positive, n_negative, round(auc, 6) AS auc FROM (" + _AUC.replace(
        "{rows}", "SELECT (l_returnflag = 'A')::INT AS y, l_quantity * l_discount + CASE WHEN l_returnflag = 'A' THEN 0.3 ELSE 0.0 END AS x FROM lineitem"
    ) + ")",
    "u09_weighted_auc": "SELECT round(sum(auc * n_positive) / sum(n_positive), 6) AS auc FROM ("
    + " UNION ALL ".join(
        "(" + _AUC.replace("{rows}", f"SELECT (o_orderstatus = '{c}')::INT AS y, {x} AS x FROM orders") + ")" for c, x in _SCORES.items()
    )
    + ")",
    "u11_efficacy_gaps": (
        f"WITH e AS ({EFFICACY_SQL}) SELECT o.\"table\", o.target, o.task, o.metric, 'gap(real-' || o.train_on || ')' AS train_on, "
        "round(r.score - o.score, 5) AS score, '' AS note FROM e o JOIN e r ON r.\"table\" = o.\"table\" AND r.metric = o.metric AND r.train_on = 'real' WHERE o.train_on <> 'real'"
    ),
}
