"""Fidelity queries (F-01 ... F-13)."""

from __future__ import annotations

from itertools import combinations

from catalog.base import (
    LINE_COPIES_SQL, LINE_COPY_NAMES, LINE_ROLES, line_copies, lineitem_split, rounded, LINE_SPLIT_SQL,
)
from twinlens.operators import charts, fidelity

NUM, CAT = LINE_ROLES.numeric, LINE_ROLES.categorical


def _ks(spark, sf):
    real, copies = line_copies(spark, sf)
    return rounded(fidelity.ks_complement(real, copies, [*NUM, "l_shipdate"]))


def _tv(spark, sf):
    real, copies = line_copies(spark, sf, CAT)
    return rounded(fidelity.tv_complement(real, copies, CAT))


def _shapes(spark, sf):
    real, copies = line_copies(spark, sf)
    return fidelity.column_shapes(real, copies, NUM, CAT)


def _trends(spark, sf):
    real, copies = line_copies(spark, sf)
    return fidelity.column_pair_trends(real, copies, NUM, CAT)


def _correlation(spark, sf):
    real, copies = line_copies(spark, sf, NUM)
    return rounded(fidelity.correlation_similarity(real, copies, NUM))


def _contingency(spark, sf):
    real, copies = line_copies(spark, sf)
    pairs = [p for p in combinations(NUM + CAT, 2) if not set(p) <= set(NUM)]
    return rounded(fidelity.contingency_similarity(real, copies, pairs, NUM))


def _quality(spark, sf):
    real, copies = line_copies(spark, sf)  # built once for both properties
    shapes = fidelity.column_shapes(real, copies, NUM, CAT)
    trends = fidelity.column_pair_trends(real, copies, NUM, CAT)
    return rounded(fidelity.quality_report(shapes, trends))


def _quality_matrix(spark, sf):
    from pyspark.sql import functions as F

    from catalog.base import ORDER_ROLES, orders_split

    line_train, line_held = lineitem_split(spark, sf)
    order_train, order_held = orders_split(spark, sf)
    reports = []
    for name, train, held, roles in (
        ("lineitem", line_train, line_held, LINE_ROLES),
        ("orders", order_train, order_held, ORDER_ROLES),
    ):
        copies = {"held": held}
        shapes = fidelity.column_shapes(train, copies, roles.numeric, roles.categorical)
        trends = fidelity.column_pair_trends(train, copies, roles.numeric, roles.categorical)
        reports.append(fidelity.quality_report(shapes, trends).withColumn("table", F.lit(name)))
    return rounded(fidelity.quality_matrix(reports[0].unionByName(reports[1]), ["lineitem", "orders"]))


def _pair_details(spark, sf):
    return rounded(fidelity.pair_trend_details(_trends(spark, sf)))


def _histogram(spark, sf):
    real, copies = line_copies(spark, sf, NUM)
    return rounded(charts.histogram(real, copies, NUM))


def _proportions(spark, sf):
    real, copies = line_copies(spark, sf, [*CAT, "l_quantity"])
    return rounded(charts.category_proportions(real, copies, [*CAT, "l_quantity"], top=20))


def _proportions_overlay(spark, sf):
    real, copies = line_copies(spark, sf, [*CAT, "l_quantity"])
    return rounded(charts.category_proportions(real, copies, [*CAT, "l_quantity"], top=15, real_only=True))


def _corr_matrix(spark, sf):
    real, copies = line_copies(spark, sf, NUM)
    return rounded(charts.correlation_matrix(real, copies, NUM))


# ---- SQL -------------------------------------------------------------------


def _with(body: str, ctes: str = LINE_COPIES_SQL) -> str:
    return f"WITH {ctes} {body}"


def ks_sql(real: str, copy: str, column: str, value: str | None = None) -> str:
    value = value or f"{column}::DOUBLE"
    return (
        f"(SELECT 1 - max(abs(cr / nr - cs / ns)) FROM (SELECT sum(r) OVER w AS cr, sum(s) OVER w AS cs, "
        f"sum(r) OVER () AS nr, sum(s) OVER () AS ns FROM (SELECT v, sum(r)::DOUBLE AS r, sum(s)::DOUBLE AS s FROM ("
        f"SELECT {value} AS v, 1 AS r, 0 AS s FROM {real} UNION ALL SELECT {value}, 0, 1 FROM {copy}) "
        f"WHERE v IS NOT NULL GROUP BY v) WINDOW w AS (ORDER BY v)))"
    )


def tv_sql(real: str, copy: str, *columns: str) -> str:
    keys = ", ".join(f"{c} AS k{i}" for i, c in enumerate(columns))
    names = ", ".join(f"k{i}" for i in range(len(columns)))
    return (
        f"(SELECT 1 - sum(abs(r / (SELECT count(*) FROM {real}) - s / (SELECT count(*) FROM {copy}))) / 2 FROM ("
        f"SELECT {names}, sum(r)::DOUBLE AS r, sum(s)::DOUBLE AS s FROM (SELECT {keys}, 1 AS r, 0 AS s FROM {real} "
        f"UNION ALL SELECT {keys}, 0, 1 FROM {copy}) GROUP BY {names}))"
    )


def corr_sql(table: str, a: str, b: str) -> str:
    return f"(SELECT CASE WHEN isnan(x) THEN NULL ELSE x END FROM (SELECT corr({a}, {b}) AS x FROM {table}))"


def corr_similarity_sql(real: str, copy: str, a: str, b: str) -> str:
    return f"(1 - abs({corr_sql(real, a, b)} - {corr_sql(copy, a, b)}) / 2)"


def bin_sql(real: str, column: str) -> str:
    low, high = f"(SELECT min({column}) FROM {real})", f"(SELECT max({column}) FROM {real})"
    return f"least(greatest(floor(({column} - {low}) / ({high} - {low}) * 10), 0), 9)"


def shape_rows(real, copies, num, cat) -> list[str]:
    rows = []
    for s in copies:
        rows += [f"SELECT '{s}' AS synth, '{c}' AS \"column\", 'KSComplement' AS metric, {ks_sql(real, s, c)} AS score" for c in num]
        rows += [f"SELECT '{s}' AS synth, '{c}' AS \"column\", 'TVComplement' AS metric, {tv_sql(real, s, c)} AS score" for c in cat]
    return rows


def trend_rows(real, copies, num, cat) -> list[str]:
    rows = []
    for s in copies:
        for a, b in combinations([*num, *cat], 2):
            if a in num and b in num:
                metric, score = "CorrelationSimilarity", corr_similarity_sql(real, s, a, b)
            else:
                x = bin_sql(real, a) if a in num else a
                metric, score = "ContingencySimilarity", tv_sql(real, s, x, b)
            rows.append(
                f"SELECT '{s}' AS synth, '{a}' AS column_1, '{b}' AS column_2, '{metric}' AS metric, {score} AS score"
            )
    return rows


def _only(rows: list[str], metric: str) -> list[str]:
    return [r for r in rows if f"'{metric}'" in r]


def _union(rows: list[str]) -> str:
    return " UNION ALL ".join(rows)


_SHAPES = _union(shape_rows("train", LINE_COPY_NAMES, NUM, CAT))
_TREND_ROWS = trend_rows("train", LINE_COPY_NAMES, NUM, CAT)
_TRENDS = _union(_TREND_ROWS)
_QUALITY = (
    "SELECT synth, column_shapes, column_pair_trends, (column_shapes + column_pair_trends) / 2 AS overall FROM "
    "(SELECT synth, avg(score) AS column_shapes FROM shapes GROUP BY synth) JOIN "
    "(SELECT synth, avg(score) AS column_pair_trends FROM trends GROUP BY synth) USING (synth)"
)
_SHIPDATE = "epoch(l_shipdate)::DOUBLE"


def _quality_matrix_sql() -> str:
    from catalog.base import ORDER_ROLES, ORDERS_SPLIT_SQL

    ctes = LINE_SPLIT_SQL + ", " + ORDERS_SPLIT_SQL.replace("train AS", "otrain AS").replace("held AS", "oheld AS")
    parts = []
    for table, real, held, roles in (
        ("lineitem", "train", "held", LINE_ROLES), ("orders", "otrain", "oheld", ORDER_ROLES),
    ):
        shapes = _union(shape_rows(real, [held], roles.numeric, roles.categorical))
        trends = _union(trend_rows(real, [held], roles.numeric, roles.categorical))
        ctes += f", q_{table} AS (SELECT (SELECT avg(score) FROM ({shapes})) AS a, (SELECT avg(score) FROM ({trends})) AS b)"
    for metric, expr in (("overall", "(a + b) / 2"), ("column_shapes", "a"), ("column_pair_trends", "b")):
        parts.append(
            f"SELECT '{metric}' AS metric, 'held' AS synth, round((SELECT {expr} FROM q_lineitem), 6) AS lineitem, "
            f"round((SELECT {expr} FROM q_orders), 6) AS orders"
        )
    return f"WITH {ctes} {_union(parts)}"


def _hist_sql() -> str:
    rows = []
    for source in ("train", *LINE_COPY_NAMES):
        for c in NUM:
            low, high = f"(SELECT min({c}) FROM train)", f"(SELECT max({c}) FROM train)"
            bins = f"(SELECT least(40, greatest(10, floor(sqrt(count({c}))))) FROM train)"
            label = "real" if source == "train" else source
            rows.append(
                f"SELECT '{label}' AS source, '{c}' AS \"column\", bin::INTEGER AS bin, "
                f"round({low} + bin * (({high} - {low}) / {bins}), 6) AS low, count(*) AS n, "
                f"round(count(*) / ((SELECT count({c}) FROM {source}) * (({high} - {low}) / {bins})), 6) AS density FROM "
                f"(SELECT least(greatest(floor(({c} - {low}) / ({high} - {low}) * {bins}), 0), {bins} - 1) AS bin "
                f"FROM {source} WHERE {c} IS NOT NULL) GROUP BY bin"
            )
    return _with(_union(rows))


def _prop_sql(top: int, real_only: bool) -> str:
    sources = ["train", *LINE_COPY_NAMES]
    rows = []
    for c in [*CAT, "l_quantity"]:
        tops = " UNION ".join(
            f"(SELECT v FROM (SELECT {c}::VARCHAR AS v, count(*) AS n FROM {s} WHERE {c} IS NOT NULL GROUP BY 1 "
            f"ORDER BY n DESC, v LIMIT {top}))"
            for s in (sources[:1] if real_only else sources)
        )
        for s in sources:
            label = "real" if s == "train" else s
            rows.append(
                f"SELECT '{c}' AS \"column\", v AS value, '{label}' AS source, round(coalesce((SELECT count(*) FROM {s} "
                f"WHERE {c}::VARCHAR = v)::DOUBLE / (SELECT count({c}) FROM {s}), 0), 6) AS proportion FROM ({tops})"
            )
    return _with(_union(rows))


def _corr_matrix_sql() -> str:
    rows = []
    for s in ("train", *LINE_COPY_NAMES):
        label = "real" if s == "train" else s
        for a in NUM:
            for b in NUM:
                rows.append(f"SELECT '{label}' AS source, '{a}' AS a, '{b}' AS b, round({corr_sql(s, a, b)}, 6) AS rho")
    return _with(_union(rows))


def _matrix_columns(columns: list[str], key: str) -> str:
    return ", ".join(f"round(max(CASE WHEN {key} = '{c}' THEN score END), 6) AS {c}" for c in columns)


QUERIES = {
    "f01_ks_complement": _ks,
    "f02_tv_complement": _tv,
    "f03_column_shapes": lambda spark, sf: rounded(_shapes(spark, sf)),
    "f04_correlation_similarity": _correlation,
    "f05_contingency_similarity": _contingency,
    "f06_column_pair_trends": lambda spark, sf: rounded(_trends(spark, sf)),
    "f06_pair_trend_details": _pair_details,
    "f07_quality_report": _quality,
    "f08_quality_matrix": _quality_matrix,
    "f09_shapes_matrix": lambda spark, sf: rounded(fidelity.shapes_matrix(_shapes(spark, sf), NUM + CAT)),
    "f10_pair_trends_matrix": lambda spark, sf: rounded(fidelity.pair_trends_matrix(_trends(spark, sf), NUM + CAT)),
    "f11_histogram": _histogram,
    "f12_category_proportions": _proportions,
    "f12_category_overlay": _proportions_overlay,
    "f13_correlation_matrix": _corr_matrix,
}

# l_shipdate is not part of the bootstrap columns of LINE_COPIES_SQL, so F-01 adds it to both sides
from catalog.base import LINE_SMALL, boot_sql  # noqa: E402

_KS_CTES = LINE_SPLIT_SQL + ", " + boot_sql("train", "row_key", [*LINE_ROLES.modelable, "l_shipdate"], LINE_SMALL, 7, "boot")


def _ks(spark, sf):  # noqa: F811
    from catalog.base import lineitem_boot

    columns = [*LINE_ROLES.numeric, "l_shipdate"]
    train, held = lineitem_split(spark, sf, columns)
    copies = {"boot": lineitem_boot(train, columns), "held": held}
    return rounded(fidelity.ks_complement(train, copies, [*NUM, "l_shipdate"]))


QUERIES["f01_ks_complement"] = _ks

SQL = {
    "f01_ks_complement": _with(
        _union(
            [
                f"SELECT '{s}' AS synth, '{c}' AS \"column\", "
                f"round({ks_sql('train', s, c, _SHIPDATE if c == 'l_shipdate' else None)}, 6) AS score"
                for s in LINE_COPY_NAMES
                for c in [*NUM, "l_shipdate"]
            ]
        ),
        _KS_CTES,
    ),
    "f02_tv_complement": _with(
        _union([f"SELECT '{s}' AS synth, '{c}' AS \"column\", round({tv_sql('train', s, c)}, 6) AS score"
                for s in LINE_COPY_NAMES for c in CAT])
    ),
    "f03_column_shapes": _with(f'SELECT synth, "column", metric, round(score, 6) AS score FROM ({_SHAPES})'),
    "f04_correlation_similarity": _with(
        f"SELECT synth, column_1, column_2, round(score, 6) AS score FROM ({_union(_only(_TREND_ROWS, 'CorrelationSimilarity'))})"
    ),
    "f05_contingency_similarity": _with(
        f"SELECT synth, column_1, column_2, round(score, 6) AS score FROM ({_union(_only(_TREND_ROWS, 'ContingencySimilarity'))})"
    ),
    "f06_column_pair_trends": _with(
        f"SELECT synth, column_1, column_2, metric, round(score, 6) AS score FROM ({_TRENDS})"
    ),
    "f06_pair_trend_details": _with(
        f"SELECT synth, column_1, column_2, metric, round(score, 6) AS score FROM ({_TRENDS}) "
        "QUALIFY row_number() OVER (PARTITION BY synth ORDER BY column_1, column_2) <= 60"
    ),
    "f07_quality_report": _with(
        "SELECT synth, round(column_shapes, 6) AS column_shapes, round(column_pair_trends, 6) AS column_pair_trends, "
        f"round(overall, 6) AS overall FROM ({_QUALITY})",
        f"{LINE_COPIES_SQL}, shapes AS ({_SHAPES}), trends AS ({_TRENDS})",
    ),
    "f08_quality_matrix": _quality_matrix_sql(),
    "f09_shapes_matrix": _with(f'SELECT synth, {_matrix_columns(NUM + CAT, chr(34) + "column" + chr(34))} FROM ({_SHAPES}) GROUP BY synth'),
    "f10_pair_trends_matrix": _with(
        f'SELECT synth, column_1 AS "column", {_matrix_columns(NUM + CAT, "column_2")} FROM ('
        "SELECT synth, column_1, column_2, score FROM t UNION ALL SELECT synth, column_2, column_1, score FROM t "
        "UNION ALL SELECT DISTINCT synth, column_1, column_1, 1.0 FROM t UNION ALL SELECT DISTINCT synth, column_2, column_2, 1.0 FROM t"
        ") GROUP BY synth, column_1",
        f"{LINE_COPIES_SQL}, t AS ({_TRENDS})",
    ),
    "f11_histogram": _hist_sql(),
    "f12_category_proportions": _prop_sql(20, False),
    "f12_category_overlay": _prop_sql(15, True),
    "f13_correlation_matrix": _corr_matrix_sql(),
}
