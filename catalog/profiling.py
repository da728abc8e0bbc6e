"""Profiling queries (P-02 ... P-13)."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import load, rounded
from catalog.structure import KEYED, keyed_tables
from twinlens.functions.dates import parse_datetime
from twinlens.operators import profile
from twinlens.operators.roles import classify_frame
from twinlens.plans.profiling import profile_dataset
from twinlens.sources.tables import stack_tables

PROFILED = ("orders", "events", "customer", "documents")


def _spelled(df):
    """Order dates in four spellings, one of them a spreadsheet-mangled time."""
    style = F.pmod("o_orderkey", F.lit(4))
    return df.withColumn(
        "spelled",
        F.when(style == 0, F.date_format("o_orderdate", "yyyy-MM-dd"))
        .when(style == 1, F.date_format("o_orderdate", "MM/dd/yyyy"))
        .when(style == 2, F.date_format("o_orderdate", "dd-MMM-yyyy"))
        .otherwise(F.date_format("o_orderdate", "mm:ss.S")),
    )


def _parse(spark, sf):
    df = _spelled(load(spark, sf, "orders"))
    return df.select("o_orderkey", F.date_format(parse_datetime(F.col("spelled")), "yyyy-MM-dd").alias("parsed"))


def _usable(spark, sf):
    df = _spelled(load(spark, sf, "orders")).withColumn("mangled", F.date_format("o_orderdate", "mm:ss.S"))
    df = df.withColumn("one_day", F.lit("2024-01-01")).withColumn("iso", F.date_format("o_orderdate", "yyyy-MM-dd"))
    return rounded(profile.usable_dates(df, ["spelled", "mangled", "one_day", "iso"]))


def _columns(spark, sf):
    return stack_tables({t: profile.profile_columns(load(spark, sf, t)) for t in PROFILED})


def _durable(spark, sf):
    events = load(spark, sf, "events")
    orders = load(spark, sf, "orders")
    return stack_tables(
        {
            "events": profile.durable_keys(events, ["user_id", "event_type"], "ts"),
            "orders": profile.durable_keys(orders, ["o_custkey", "o_orderpriority"], "o_orderdate"),
        }
    )


def _contiguity(spark, sf):
    """Every order lasts until its customer's next one, except for every fifth customer."""
    from pyspark.sql import Window

    orders = load(spark, sf, "orders").groupBy("o_custkey", "o_orderdate").agg(F.max("o_orderkey").alias("o_orderkey"))
    following = F.lead("o_orderdate").over(Window.partitionBy("o_custkey").orderBy("o_orderdate"))
    gap = F.pmod("o_custkey", F.lit(5)) == 0
    versions = orders.withColumn("until", F.when(gap, F.date_add("o_orderdate", 1).cast("timestamp")).otherwise(following))
    return profile.contiguity(versions, "o_custkey", "o_orderdate", "until")


def _table(spark, sf):
    out = {}
    for t in PROFILED:
        df = load(spark, sf, t)
        rows = profile.collect_profile(profile.profile_columns(df))
        out[t] = profile.top_durable_keys(df, rows)
    return stack_tables(out)


ELIGIBLE = {"CUSTOMER": {"custkey"}, "ORDERS": {"custkey"}, "EVENTS": {"custkey"}}


def _links(spark, sf):
    return profile.find_links(keyed_tables(spark, sf), ELIGIBLE)


def _dataset(spark, sf):
    found = profile_dataset(keyed_tables(spark, sf))
    return found["recommendation"]


def _strategy(spark, sf):
    return _dataset(spark, sf).select("tier", "strategy")


def _dataset_links(spark, sf):
    return profile_dataset(keyed_tables(spark, sf))["links"]


def _roles(spark, sf):
    return stack_tables({t: classify_frame(load(spark, sf, t)) for t in (*PROFILED, "lineitem", "embeddings")})


def _typed_roles(spark, sf):
    types = {"l_orderkey": "id", "l_linenumber": "numerical", "l_quantity": "categorical", "l_returnflag": "unknown"}
    return classify_frame(load(spark, sf, "lineitem"), types, max_cardinality=20)


QUERIES = {
    "p02_parse_datetime": _parse,
    "p03_usable_dates": _usable,
    "p04_profile_columns": _columns,
    "p06_durable_keys": _durable,
    "p06_contiguity": _contiguity,
    "p07_top_durable_keys": _table,
    "p08_find_links": _links,
    "p09_recommend_strategy": _strategy,
    "p10_profile_dataset": _dataset,
    "p10_dataset_links": _dataset_links,
    "p11_classify_columns": _roles,
    "p11_classify_with_types": _typed_roles,
    "p13_shared_keys": lambda spark, sf: profile.shared_keys(keyed_tables(spark, sf)),
}

# ---- SQL -------------------------------------------------------------------

# table -> column -> (dtype, name or type suggests a date, id name, audit name)
_FACTS = {
    "orders": {
        "o_orderkey": ("bigint", False, False, False), "o_custkey": ("bigint", False, False, False),
        "o_orderstatus": ("string", False, False, False), "o_totalprice": ("double", False, False, False),
        "o_orderdate": ("timestamp_ntz", True, False, False), "o_orderpriority": ("string", False, False, False),
    },
    "events": {
        "event_id": ("bigint", False, True, False), "ts": ("timestamp_ntz", True, False, False),
        "user_id": ("bigint", False, True, True), "event_type": ("string", False, False, False),
        "value": ("double", False, False, False), "props": ("string", False, False, False),
    },
    "customer": {
        "c_custkey": ("bigint", False, False, False), "c_name": ("string", False, False, False),
        "c_nationkey": ("int", False, False, False), "c_acctbal": ("double", False, False, False),
        "c_mktsegment": ("string", False, False, False),
    },
    "documents": {
        "doc_id": ("bigint", False, True, False), "text": ("string", False, False, False),
        "lang": ("string", False, False, False), "source": ("string", False, False, False),
        "n_chars": ("bigint", False, False, False),
    },
}


def _profile_rows() -> str:
    rows = []
    for t, columns in _FACTS.items():
        for i, (c, (dtype, dated, idish, audit)) in enumerate(columns.items()):
            span = f"(max({c}) - min({c}) >= INTERVAL 2 DAY)" if dated else "false"
            rows.append(
                f"SELECT '{t}' AS \"table\", '{c}' AS \"column\", {i} AS position, '{dtype}' AS dtype, count(*) AS n_rows, "
                f"count({c}) AS nn, count(DISTINCT {c}) AS n_distinct, {dated} AS dated, {idish} AS idish, {audit} AS audit, "
                f"CASE WHEN {span} THEN 1.0 ELSE 0.0 END AS dt FROM {t}"
            )
    return " UNION ALL ".join(rows)


_PROFILE = (
    'SELECT "table", "column", position, dtype, n_rows, n_distinct, round(1 - nn / n_rows, 4) AS null_frac, '
    "round(n_distinct / nn, 4) AS uniqueness, CASE WHEN dt >= 0.8 THEN 'date' WHEN audit THEN 'audit' "
    "WHEN n_distinct / nn >= 0.99 AND (idish OR dtype IN ('bigint', 'int') OR nn = n_distinct) THEN 'surrogate' "
    "WHEN dated THEN 'date' WHEN n_distinct / nn >= 0.9 AND dtype NOT IN ('bigint', 'int', 'double') THEN 'free_text' "
    "WHEN n_distinct > 1 AND n_distinct < nn THEN 'durable_candidate' ELSE 'attribute' END AS role, "
    f"round(dt, 3)::DOUBLE AS dt_frac, nn FROM ({_profile_rows()})"
)
_PROFILE_NOTE = (
    "SELECT * EXCLUDE (nn), CASE WHEN role = 'durable_candidate' THEN 'repeats ~' || printf('%.1f', nn / n_distinct) || "
    f"' rows/value across ' || n_distinct || ' values' ELSE '' END AS note FROM ({_PROFILE})"
)


def _durable_sql(table: str, key: str, eff: str | None) -> str:
    dated = f"count(DISTINCT {eff}) > 1" if eff else "false"
    return (
        f"SELECT '{table}' AS \"table\", '{key}' AS \"column\", E AS n_entities, round(a, 2) AS avg_versions, m AS max_versions, "
        f"round(d, 3) AS dated_window_frac, 0.0::DOUBLE AS contiguity_frac, round(least(greatest(0.45 * least(1.0, E / greatest(20.0, 0.05 * n)) "
        f"+ 0.25 * CASE WHEN a < 1.5 THEN 0 WHEN a <= 15 THEN 1 ELSE greatest(0, 1 - (a - 15) / 85) END + 0.30 * d, 0), 1), 3) AS score "
        f"FROM (SELECT count(*) AS E, avg(c) AS a, max(c) AS m, coalesce(avg(CASE WHEN c > 1 THEN f::INT END), 0) AS d, "
        f"(SELECT count(*) FROM {table})::DOUBLE AS n FROM (SELECT {key}, count(*) AS c, {dated} AS f FROM {table} "
        f"WHERE {key} IS NOT NULL GROUP BY {key}))"
    )


_CANDIDATES = " UNION ALL ".join(
    _durable_sql(t, c, {"orders": "o_orderdate", "events": "ts"}.get(t))
    for t, columns in _FACTS.items() for c in columns if c not in ("o_orderdate", "ts")
)


def _links_sql() -> str:
    rows = []
    names = list(KEYED)
    for i, a in enumerate(names):
        for b in names[i + 1:]:
            ka, kb = KEYED[a][0], KEYED[b][0]
            rows.append(
                f"SELECT '{a.upper()}' AS a, '{b.upper()}' AS b, (SELECT count(*) FROM (SELECT {ka} FROM {a} INTERSECT SELECT {kb} FROM {b})) AS x, "
                f"(SELECT count(DISTINCT {ka}) FROM {a}) AS da, (SELECT count(DISTINCT {kb}) FROM {b}) AS db, "
                f"(SELECT count(DISTINCT {ka}) = count(*) FROM {a}) AS ua, (SELECT count(DISTINCT {kb}) = count(*) FROM {b}) AS ub"
            )
    flip = "(ub AND NOT ua)"
    return (
        f"SELECT CASE WHEN {flip} THEN b ELSE a END AS parent_table, 'custkey' AS parent_column, CASE WHEN {flip} THEN a ELSE b END AS child_table, "
        f"'custkey' AS child_column, round(CASE WHEN {flip} THEN x / da ELSE x / db END, 3) AS overlap_frac, "
        f"CASE WHEN {flip} THEN ub ELSE ua END AS parent_is_unique, CASE WHEN ua AND ub THEN '1:1' WHEN ua OR ub THEN '1:many' ELSE 'many:many' END AS cardinality, "
        f"NOT (ua OR ub) AS linkable_via_durable FROM ({' UNION ALL '.join(rows)}) WHERE greatest(x / da, x / db) >= 0.3"
    )


_ROLE_RULES = {
    "orders": {"o_orderkey": "num", "o_custkey": "num", "o_orderstatus": "cat", "o_totalprice": "num", "o_orderdate": "skip", "o_orderpriority": "cat"},
    "events": {"event_id": "skip", "ts": "skip", "user_id": "skip", "event_type": "cat", "value": "num", "props": "cat"},
    "customer": {"c_custkey": "num", "c_name": "skip", "c_nationkey": "num", "c_acctbal": "num", "c_mktsegment": "cat"},
    "documents": {"doc_id": "skip", "text": "cat", "lang": "cat", "source": "cat", "n_chars": "num"},
    "lineitem": {"l_orderkey": "num", "l_partkey": "num", "l_suppkey": "num", "l_linenumber": "num", "l_quantity": "num",
                 "l_extendedprice": "num", "l_discount": "num", "l_tax": "num", "l_returnflag": "cat", "l_linestatus": "cat", "l_shipdate": "skip"},
    "embeddings": {"vec_id": "skip", "embedding": "skip", "label": "num"},
}


def _roles_sql() -> str:
    rows = []
    for t, columns in _ROLE_RULES.items():
        for i, (c, rule) in enumerate(columns.items()):
            role = {
                "skip": "max('skipped')",
                "cat": f"CASE WHEN count(DISTINCT {c}) <= 50 THEN 'categorical' ELSE 'skipped' END",
                "num": f"CASE WHEN count(DISTINCT {c}) <= 10 AND bool_and({c} = floor({c}) AND {c} BETWEEN -1 AND 10) THEN 'categorical' ELSE 'numeric' END",
            }[rule]
            rows.append(f"SELECT '{t}' AS \"table\", '{c}' AS \"column\", {i} AS position, {role} AS role FROM {t}")
    return " UNION ALL ".join(rows)


def _typed_roles_sql() -> str:
    rows = []
    for i, (c, rule) in enumerate(_ROLE_RULES["lineitem"].items()):
        role = {"l_orderkey": "max('skipped')", "l_linenumber": "max('numeric')", "l_returnflag": "max('skipped')",
                "l_quantity": f"CASE WHEN count(DISTINCT {c}) <= 20 THEN 'categorical' ELSE 'skipped' END"}.get(c) or {
            "skip": "max('skipped')", "cat": f"CASE WHEN count(DISTINCT {c}) <= 20 THEN 'categorical' ELSE 'skipped' END",
            "num": f"CASE WHEN count(DISTINCT {c}) <= 10 AND bool_and({c} = floor({c}) AND {c} BETWEEN -1 AND 10) THEN 'categorical' ELSE 'numeric' END"}[rule]
        rows.append(f"SELECT '{c}' AS \"column\", {i} AS position, {role} AS role FROM lineitem")
    return " UNION ALL ".join(rows)


_SPAN = "max(o_orderdate) - min(o_orderdate) >= INTERVAL 2 DAY"

SQL = {
    "p02_parse_datetime": "SELECT o_orderkey, CASE WHEN o_orderkey % 4 <> 3 THEN strftime(o_orderdate, '%Y-%m-%d') END AS parsed FROM orders",
    "p03_usable_dates": (
        "SELECT 'spelled' AS \"column\", round(CASE WHEN f < 0.8 OR span THEN f ELSE 0 END, 6) AS dt_frac FROM (SELECT avg((o_orderkey % 4 <> 3)::INT) AS f, "
        f"{_SPAN} AS span FROM orders) UNION ALL SELECT 'mangled', 0.0 UNION ALL SELECT 'one_day', 0.0 UNION ALL "
        f"SELECT 'iso', CASE WHEN {_SPAN} THEN 1.0 ELSE 0.0 END FROM orders"
    ),
    "p04_profile_columns": _PROFILE_NOTE,
    "p06_durable_keys": " UNION ALL ".join(
        _durable_sql(*x) for x in (("events", "user_id", "ts"), ("events", "event_type", "ts"),
                                   ("orders", "o_custkey", "o_orderdate"), ("orders", "o_orderpriority", "o_orderdate"))
    ),
    "p06_contiguity": (
        "SELECT 'o_custkey' AS \"column\", round(avg(t), 3) AS contiguity_frac FROM (SELECT o_custkey, count(*) AS n, "
        "min((nxt IS NULL OR nxt = CASE WHEN o_custkey % 5 = 0 THEN o_orderdate + INTERVAL 1 DAY ELSE nxt END)::INT) AS t FROM "
        "(SELECT DISTINCT o_custkey, o_orderdate, lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate) AS nxt "
        "FROM (SELECT DISTINCT o_custkey, o_orderdate FROM orders)) GROUP BY o_custkey) WHERE n > 1"
    ),
    "p07_top_durable_keys": (
        f"SELECT c.* FROM ({_CANDIDATES}) c JOIN ({_PROFILE}) p ON p.\"table\" = c.\"table\" AND p.\"column\" = c.\"column\" "
        "WHERE p.role = 'durable_candidate' QUALIFY row_number() OVER (PARTITION BY c.\"table\" ORDER BY c.score DESC, c.\"column\") <= 5"
    ),
    "p08_find_links": _links_sql(),
    # orders and events carry usable dates and customer has the unique key
    "p09_recommend_strategy": (
        "SELECT CASE WHEN versioned THEN 2 WHEN linked THEN 1 ELSE 0 END AS tier, CASE WHEN versioned THEN 'sequential' WHEN linked THEN 'relational' "
        "ELSE 'independent' END AS strategy FROM (SELECT (SELECT max(score) >= 0.5 FROM ("
        + " UNION ALL ".join(
            _durable_sql(t, c, {"orders": "o_orderdate", "events": "ts"}.get(t))
            for t, c in (("orders", "o_custkey"), ("events", "user_id"), ("events", "event_type"), ("orders", "o_orderpriority"),
                         ("orders", "o_orderstatus"), ("customer", "c_nationkey"), ("customer", "c_mktsegment"))
        )
        + ")) AS versioned, (SELECT coalesce(max(overlap_frac), 0) >= 0.5 FROM ("
        + _links_sql()
        + ") WHERE parent_is_unique) AS linked)"
    ),
    "p10_dataset_links": _links_sql(),
    "p11_classify_columns": _roles_sql(),
    "p11_classify_with_types": _typed_roles_sql(),
    "p13_shared_keys": " UNION ALL ".join(
        f"SELECT 'custkey' AS \"column\", '{t.upper()}' AS \"table\", count(DISTINCT {c}) >= count(*) AS is_unique FROM {t}"
        for t, (c, _) in KEYED.items()
    ),
}
