"""Timeline, masking, refill and constraint queries (M-01 ... M-13)."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import (
    LINE_SPLIT_SQL, ORDERS_SPLIT_SQL, draw_sql, lineitem_split, load, orders_split, rounded, uniform_sql,
)
from twinlens.operators import constraints, pii, refill, scd
from twinlens.operators.roles import classify_columns
from twinlens.sources.tables import stack_tables


def _order_versions(spark, sf):
    orders = load(spark, sf, "orders")
    return orders.select(
        "o_orderkey", "o_custkey", "o_orderdate",
        F.date_add("o_orderdate", 30).cast("string").alias("o_until"), F.lit("?").alias("is_current"),
    )


def _scd(spark, sf):
    fixed, _ = scd.repair_scd_timeline(
        _order_versions(spark, sf), "o_custkey", "o_orderdate", "o_until", "o_orderkey", "is_current"
    )
    return fixed


def _scd_events(spark, sf):
    events = load(spark, sf, "events").select("event_id", "user_id", "ts", F.lit(None).cast("string").alias("until"))
    fixed, _ = scd.repair_scd_timeline(events, "user_id", "ts", "until", "event_id", date_format="yyyy-MM-dd HH:mm:ss")
    return fixed


def _pii_values(spark, sf):
    """Shapes of whole columns: names, texts, and contact details spelled from keys."""
    customer = load(spark, sf, "customer").select(
        "c_name",
        F.concat(F.lit("user"), "c_custkey", F.lit("@mail.example.com")).alias("contact"),
        F.concat(F.lit("613-555-"), F.lpad(F.pmod("c_custkey", F.lit(10000)).cast("string"), 4, "0")).alias("line"),
        F.lpad(F.col("c_custkey").cast("string"), 5, "0").alias("zone"),
        F.concat(F.col("c_custkey") + 1, F.lit(" Elm Street")).alias("place"),
        F.when(F.pmod("c_custkey", F.lit(5)) < 3, F.concat(F.lit("a"), "c_custkey", F.lit("@x.io"))).otherwise("none").alias("mostly"),
    )
    documents = load(spark, sf, "documents").select("text", "lang", "source")
    return rounded(
        stack_tables(
            {
                "customer": pii.value_shapes(customer, customer.columns),
                "documents": pii.value_shapes(documents, documents.columns),
            }
        )
    )


PII_TABLES = ("customer", "supplier", "part", "orders", "documents", "pages")


def _detect(spark, sf):
    rows = [
        (t, c, kind) for t in PII_TABLES for c, kind in pii.detect_pii(load(spark, sf, t)).items()
    ]
    return spark.createDataFrame(rows, "table string, column string, kind string")


FAKED = ("name", "email", "phone", "postal", "street", "other")


def _fake(spark, sf):
    customer = load(spark, sf, "customer").select("c_custkey")
    for kind in FAKED:
        customer = pii.fake_column(customer, kind, kind, F.col("c_custkey"), 0.1 if kind == "phone" else 0.0, seed=3)
    return pii.fake_column(customer, "first_name", "name", F.col("c_custkey"), seed=3)


def _plan(spark, sf):
    customer = load(spark, sf, "customer")
    plan = pii.pii_plan({"c_name": "name", "c_mktsegment": "other", "c_acctbal": "other"}, {"c_mktsegment": "shuffle", "c_acctbal": "drop"})
    return pii.apply_pii_plan(customer, plan, customer, F.col("c_custkey"), seed=3)


def _scored(spark, sf):
    """Faked and dropped columns leave the comparison, shuffled ones stay."""
    customer = load(spark, sf, "customer").select("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")
    plan = pii.pii_plan({"c_name": "name", "c_mktsegment": "street"}, {"c_mktsegment": "Shuffle"})
    return rounded(customer.select(*pii.scored_columns(customer.columns, plan)))


def _modelled(spark, sf):
    """What generators model: signal columns and keys; the rest is named and redrawn later."""
    train, _ = orders_split(spark, sf)
    train = train.select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")
    roles = classify_columns(train, {"o_orderkey": "id", "o_custkey": "id"})
    keep, fill = refill.columns_to_model(train.columns, roles, {"o_orderkey", "o_custkey"})
    return rounded(train.select(*keep, F.lit(",".join(fill)).alias("refilled")))


def _refill(spark, sf):
    train, held = orders_split(spark, sf)
    columns = ["o_custkey", "o_orderdate", "o_orderpriority"]
    return refill.refill(held, train, columns, F.col("o_orderkey"), F.col("o_orderkey"), train.columns, seed=5)


SPECS = [
    {"table": "lineitem", "type": "inequality", "low": "l_tax", "high": "l_discount"},
    {"table": "lineitem", "type": "inequality", "low": "l_discount", "high": "l_quantity", "strict": True},
    {"table": "lineitem", "type": "range", "low": "l_tax", "middle": "l_discount", "high": "l_quantity"},
    {"table": "lineitem", "type": "fixed_increments", "column": "l_linenumber", "increment": 2},
    {"table": "lineitem", "type": "fixed_combinations", "columns": ["l_returnflag", "l_linestatus", "l_quantity", "l_discount"]},
    {"table": "orders", "type": "inequality", "low": "o_orderkey", "high": "o_custkey"},
]


ENFORCED = [
    *[s for s in SPECS if s["type"] in ("range", "fixed_increments")],
    {"table": "lineitem", "type": "fixed_combinations", "columns": ["l_returnflag", "l_linestatus", "l_shipdate"]},
]


def _constraints(spark, sf):
    rules = constraints.build_constraints(SPECS, "lineitem")
    train, held = lineitem_split(spark, sf, list(dict.fromkeys(c for rule in rules for c in rule.columns)))
    return constraints.check_constraints(rules, held, train)


def _enforced(spark, sf):
    """Violations after encoding and decoding: none, whatever the data held before."""
    rules = constraints.build_constraints(ENFORCED, "lineitem")
    train, _ = lineitem_split(spark, sf, list(dict.fromkeys(c for rule in rules for c in rule.columns)))
    rebuilt = constraints.decode_constraints(constraints.encode_constraints(train, rules), rules, train)
    return constraints.check_constraints(rules, rebuilt, train)


QUERIES = {
    "m01_scd_repair": _scd,
    "m01_scd_repair_events": _scd_events,
    "m02_detect_pii": _detect,
    "m03_value_kind": _pii_values,
    "m04_fake_column": _fake,
    "m05_apply_pii_plan": _plan,
    "m06_scored_columns": _scored,
    "m07_refill": _refill,
    "m08_columns_to_model": _modelled,
    "m09_m12_check_constraints": _constraints,
    "m13_enforce_constraints": _enforced,
}

# ---- SQL -------------------------------------------------------------------


def _list(options) -> str:
    return "[" + ", ".join(f"'{o}'" for o in options) + "]"


def _pick_sql(options, key: str, salt: str, seed: int) -> str:
    return f"{_list(options)}[{draw_sql(key, salt, seed, str(len(options)))} + 1]"


def _digits_sql(count: int, key: str, salt: str, seed: int) -> str:
    return f"lpad({draw_sql(key, salt, seed, str(10**count))}::VARCHAR, {count}, '0')"


def _fake_sql(kind: str, key: str, column: str, seed: int) -> str:
    first = _pick_sql(pii.FIRST_NAMES, key, f"{column}:first", seed)
    last = _pick_sql(pii.LAST_NAMES, key, f"{column}:last", seed)
    if kind == "name":
        return first if "first" in column else f"{first} || ' ' || {last}"
    if kind == "email":
        return f"lower({first}) || '.' || lower({last}) || {_digits_sql(3, key, f'{column}:n', seed)} || '@' || {_pick_sql(pii.MAIL_DOMAINS, key, f'{column}:domain', seed)}"
    if kind == "phone":
        return f"{_digits_sql(3, key, f'{column}:area', seed)} || '-555-' || {_digits_sql(4, key, f'{column}:line', seed)}"
    if kind == "postal":
        parts = [_pick_sql(pii.POSTAL_LETTERS if i % 2 == 0 else pii.DIGITS, key, f"{column}:p{i}", seed) for i in range(6)]
        return " || ".join(parts[:3]) + " || ' ' || " + " || ".join(parts[3:])
    if kind == "street":
        return (f"({draw_sql(key, f'{column}:number', seed, '9899')} + 100)::VARCHAR || ' ' || "
                f"{_pick_sql(pii.STREET_NAMES, key, f'{column}:street', seed)} || ' ' || {_pick_sql(pii.STREET_KINDS, key, f'{column}:way', seed)}")
    return " || ".join(_pick_sql(pii.LETTERS, key, f"{column}:l{i}", seed) for i in range(4)) + " || " + _digits_sql(4, key, f"{column}:n", seed)


_FAKES = ", ".join(
    f"CASE WHEN {uniform_sql('c_custkey', f'{k}:missing', 3)} >= {0.1 if k == 'phone' else 0.0} THEN {_fake_sql(k, 'c_custkey', k, 3)} END AS {k}"
    for k in FAKED
)

_SHAPE_SOURCE = {
    "customer": (
        "SELECT c_name, 'user' || c_custkey || '@mail.example.com' AS contact, '613-555-' || lpad((c_custkey % 10000)::VARCHAR, 4, '0') AS line, "
        "lpad(c_custkey::VARCHAR, 5, '0') AS zone, (c_custkey + 1) || ' Elm Street' AS place, "
        "CASE WHEN c_custkey % 5 < 3 THEN 'a' || c_custkey || '@x.io' ELSE 'none' END AS mostly FROM customer",
        ("c_name", "contact", "line", "zone", "place", "mostly"),
    ),
    "documents": ("SELECT text, lang, source FROM documents", ("text", "lang", "source")),
}


def _rx(pattern: str) -> str:
    return "avg(regexp_matches(v, '" + pattern.replace("(?i)", "") + "'" + (", 'i')" if "(?i)" in pattern else ")") + "::INT)"


def _shapes_sql() -> str:
    rows = []
    for t, (source, columns) in _SHAPE_SOURCE.items():
        for c in columns:
            rows.append(
                f"SELECT '{t}' AS \"table\", '{c}' AS \"column\", count(v) AS n, round({_rx(pii.EMAIL)}, 6) AS email, round({_rx(pii.POSTAL)}, 6) AS postal, "
                f"round({_rx(pii.STREET)}, 6) AS street, round({_rx(pii.PHONE)}, 6) AS phone, median(length(regexp_replace(v, '[^0-9]', '', 'g')))::DOUBLE AS digits "
                f"FROM (SELECT trim({c}, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS v FROM ({source}))"
            )
    return (
        "SELECT *, CASE WHEN n < 5 THEN NULL WHEN email >= 0.6 THEN 'email' WHEN postal >= 0.6 THEN 'postal' WHEN street >= 0.6 THEN 'street' "
        f"WHEN phone >= 0.6 AND digits >= 7 THEN 'phone' END AS kind FROM ({' UNION ALL '.join(rows)})"
    )


def _detect_sql() -> str:
    # decided by name: *_name columns; every other text column is judged by its values
    named = {"customer": ["c_name"], "supplier": ["s_name"], "part": ["p_name"], "orders": [], "documents": [], "pages": []}
    texts = {"customer": ["c_mktsegment"], "part": ["p_brand", "p_type"], "orders": ["o_orderstatus", "o_orderpriority"],
             "documents": ["text", "lang", "source"], "pages": ["url", "html"]}
    rows = [f"SELECT '{t}' AS \"table\", '{c}' AS \"column\", 'name' AS kind" for t, cs in named.items() for c in cs]
    for t, cs in texts.items():
        if t == "part":
            cs = ["p_brand"]
        for c in cs:
            if c.upper().endswith("_TYPE"):
                continue
            rows.append(
                f"SELECT '{t}', '{c}', kind FROM (SELECT CASE WHEN {_rx(pii.EMAIL)} >= 0.6 THEN 'email' WHEN {_rx(pii.POSTAL)} >= 0.6 THEN 'postal' "
                f"WHEN {_rx(pii.STREET)} >= 0.6 THEN 'street' WHEN {_rx(pii.PHONE)} >= 0.6 AND median(length(regexp_replace(v, '[^0-9]', '', 'g'))) >= 7 "
                f"THEN 'phone' END AS kind FROM (SELECT trim({c}, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS v FROM {t})) WHERE kind IS NOT NULL"
            )
    return " UNION ALL ".join(rows)


def _constraints_sql() -> str:
    rows = [
        ("inequality", "l_tax,l_discount", "count_if(l_tax > l_discount)"),
        ("inequality", "l_discount,l_quantity", "count_if(l_discount >= l_quantity)"),
        ("range", "l_tax,l_discount,l_quantity", "count_if(l_tax >= l_discount OR l_discount >= l_quantity)"),
        ("fixed_increments", "l_linenumber", "count_if(l_linenumber % 2 <> 0)"),
        ("fixed_combinations", "l_returnflag,l_linestatus,l_quantity,l_discount",
         "count_if((l_returnflag, l_linestatus, l_quantity, l_discount) NOT IN "
         "(SELECT (l_returnflag, l_linestatus, l_quantity, l_discount) FROM train))"),
    ]
    return f"WITH {LINE_SPLIT_SQL} " + " UNION ALL ".join(
        f"SELECT 'lineitem' AS \"table\", '{kind}' AS type, '{columns}' AS columns, {test}::BIGINT AS violations, count(*) AS n_rows FROM held"
        for kind, columns, test in rows
    )


def _enforced_sql() -> str:
    return f"WITH {LINE_SPLIT_SQL} " + " UNION ALL ".join(
        f"SELECT 'lineitem' AS \"table\", '{kind}' AS type, '{columns}' AS columns, 0::BIGINT AS violations, count(*) AS n_rows FROM train"
        for kind, columns in (("range", "l_tax,l_discount,l_quantity"), ("fixed_increments", "l_linenumber"),
                              ("fixed_combinations", "l_returnflag,l_linestatus,l_shipdate"))
    )


def _refill_sql() -> str:
    n = "(SELECT count(*) FROM train)"
    columns = ["o_custkey", "o_orderdate", "o_orderpriority"]
    draws = ", ".join(f"{draw_sql('o_orderkey', c, 5, n)} AS u_{c}" for c in columns)
    joins = " ".join(f"LEFT JOIN idx i_{c} ON i_{c}.idx = d.u_{c}" for c in columns)
    return (
        f"WITH {ORDERS_SPLIT_SQL}, idx AS (SELECT row_number() OVER (ORDER BY md5(o_orderkey::VARCHAR)) - 1 AS idx, {', '.join(columns)} FROM train), "
        f"d AS (SELECT *, {draws} FROM held) SELECT d.o_orderkey, i_o_custkey.o_custkey, d.o_orderstatus, d.o_totalprice, "
        f"i_o_orderdate.o_orderdate, i_o_orderpriority.o_orderpriority FROM d {joins}"
    )


SQL = {
    "m01_scd_repair": (
        "SELECT o_orderkey, o_custkey, strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate, strftime(coalesce(nxt, last_end), '%Y-%m-%d') AS o_until, "
        "CASE WHEN nxt IS NULL THEN 'Y' ELSE 'N' END AS is_current FROM (SELECT *, lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS nxt, "
        "(SELECT max(o_orderdate + INTERVAL 30 DAY) FROM orders) AS last_end FROM orders)"
    ),
    "m01_scd_repair_events": (
        "SELECT event_id, user_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, strftime(coalesce(lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id), "
        "TIMESTAMP '2999-12-31'), '%Y-%m-%d %H:%M:%S') AS until FROM events"
    ),
    "m02_detect_pii": _detect_sql(),
    "m03_value_kind": _shapes_sql(),
    "m04_fake_column": f"SELECT c_custkey, {_FAKES}, {_fake_sql('name', 'c_custkey', 'first_name', 3)} AS first_name FROM customer",
    "m05_apply_pii_plan": f"SELECT c_custkey, {_fake_sql('name', 'c_custkey', 'c_name', 3)} AS c_name, c_nationkey, c_mktsegment FROM customer",
    "m06_scored_columns": "SELECT c_custkey, c_nationkey, c_acctbal, c_mktsegment FROM customer",
    "m07_refill": _refill_sql(),
    "m08_columns_to_model": (
        f"WITH {ORDERS_SPLIT_SQL} SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority, 'o_orderdate' AS refilled FROM train "
        "WHERE (SELECT count(DISTINCT o_orderstatus) <= 50 AND count(DISTINCT o_orderpriority) <= 50 FROM train)"
    ),
    "m09_m12_check_constraints": _constraints_sql(),
    "m13_enforce_constraints": _enforced_sql(),
}
