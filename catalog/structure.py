"""Relational queries (S-01 ... S-15).

nation -> customer -> orders -> lineitem is the real hierarchy.  ``held`` is its
holdout half; ``shifted`` moves every order to a later customer, so that the last
ones become orphans.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import bucket_sql, load, orders_split, rounded
from catalog.fidelity import ks_sql
from twinlens.model import Relationship
from twinlens.operators import split, structure

RELS = [
    Relationship("NATION", "n_nationkey", "CUSTOMER", "c_nationkey"),
    Relationship("CUSTOMER", "c_custkey", "ORDERS", "o_custkey"),
    Relationship("ORDERS", "o_orderkey", "LINEITEM", "l_orderkey"),
]
BROKEN = Relationship("CUSTOMER", "c_nationkey", "ORDERS", "o_custkey")
ABSENT = Relationship("CUSTOMER", "c_custkey", "ORDERS", "no_such_column")
SHIFT = 40


def tables(spark, sf):
    return {t.upper(): load(spark, sf, t) for t in ("nation", "customer", "orders", "lineitem")}


def copies(spark, sf):
    real = tables(spark, sf)
    moved = real["ORDERS"].withColumn("o_custkey", F.col("o_custkey") + SHIFT)
    short = real["ORDERS"].where(F.col("o_orderstatus") != "P")
    return {"shifted": {**real, "ORDERS": moved}, "partial": {**real, "ORDERS": short}}


KEYED = {"customer": ("c_custkey", "c_custkey AS custkey"), "orders": ("o_custkey", "o_custkey AS custkey"),
         "events": ("user_id", "user_id AS custkey")}


def keyed_tables(spark, sf):
    return {t.upper(): load(spark, sf, t).withColumnRenamed(c, "custkey") for t, (c, _) in KEYED.items()}


def _hub(spark, sf):
    found, _, _, info = structure.build_entity_hub(keyed_tables(spark, sf), "custkey")
    return rounded(found[info.parent])


def _key_tables(spark, sf):
    return structure.hub_keys(keyed_tables(spark, sf), "custkey", ["ORDERS", "EVENTS"])


def _varying(spark, sf):
    orders = load(spark, sf, "orders").join(
        load(spark, sf, "customer").select("c_custkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey")
    )
    columns = ["c_mktsegment", "o_orderstatus", "o_totalprice"]
    return structure.varying_entities(orders, "o_custkey", columns)


def _lift(spark, sf):
    orders = load(spark, sf, "orders").join(
        load(spark, sf, "customer").select("c_custkey", "c_mktsegment", "c_acctbal"),
        F.col("o_custkey") == F.col("c_custkey"),
    )
    hub = structure.hub_keys({"O": orders}, "o_custkey", ["O"])
    return structure.lift_columns(hub, orders, "o_custkey", ["c_mktsegment", "c_acctbal"])


def _uniqueness(spark, sf):
    return structure.uniqueness(load(spark, sf, "events"), ["event_id", "user_id", "event_type", "props"])


def _primary_key(spark, sf):
    rows = [(t, structure.pick_primary_key(load(spark, sf, t))) for t in ("customer", "orders", "events", "nation")]
    found = spark.createDataFrame(rows, "table string, primary_key string")
    return found


def _holds(spark, sf):
    return structure.relationships_hold([*RELS, BROKEN, ABSENT], tables(spark, sf))


def _split_random(spark, sf):
    train, held = split.split_random(load(spark, sf, "orders"), F.col("o_orderkey"))
    both = train.withColumn("side", F.lit("train")).union(held.withColumn("side", F.lit("holdout")))
    return both.select("o_orderkey", "side")


def _split_relational(spark, sf):
    real = tables(spark, sf)
    moved = {**real, "ORDERS": copies(spark, sf)["shifted"]["ORDERS"]}
    keys = {
        "NATION": F.col("n_nationkey"), "CUSTOMER": F.col("c_custkey"), "ORDERS": F.col("o_orderkey"),
        "LINEITEM": F.col("l_orderkey"),
    }
    marked = split.mark_relational(moved, RELS, keys)
    parts = [
        df.groupBy(F.col(split.HOLDOUT).alias("holdout")).agg(
            F.count(F.lit(1)).alias("n"), F.sum(key.cast("bigint")).alias("key_sum")
        ).withColumn("table", F.lit(t))
        for (t, df), key in zip(marked.items(), keys.values())
    ]
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3])


def _integrity(spark, sf):
    return rounded(structure.referential_integrity(RELS, tables(spark, sf), copies(spark, sf)))


def _validate(spark, sf):
    real = {**tables(spark, sf), "ORDERS": copies(spark, sf)["shifted"]["ORDERS"]}
    return structure.validate_model([*RELS, BROKEN, ABSENT], real, "o_custkey", ["ORDERS"])


def _records(spark, sf):
    """Relationships through their records and back, doubled ones once, with the cardinality of the data."""
    again = [type(r).from_record(r.as_record()) for r in RELS]
    back = [structure.orient((r.child_table, r.child_key), (r.parent_table, r.parent_key), "many-to-one")[0] for r in RELS]
    return structure.relationship_records([*RELS, *again, *back], tables(spark, sf))


def _children(spark, sf):
    return structure.children_per_parent(load(spark, sf, "customer"), load(spark, sf, "orders"), "c_custkey", "o_custkey")


def _shape(spark, sf):
    return structure.cardinality_shape(RELS, tables(spark, sf), copies(spark, sf))


def _statistic(spark, sf):
    return rounded(structure.cardinality_statistic(RELS, tables(spark, sf), copies(spark, sf)))


def _scores(spark, sf):
    return rounded(structure.structure_scores(_integrity(spark, sf), _shape(spark, sf)))


QUERIES = {
    "s01_entity_keys": _key_tables,
    "s02_entity_hub": _hub,
    "s03_invariant_columns": _varying,
    "s04_lift_invariants": _lift,
    "s05_uniqueness": _uniqueness,
    "s05_primary_key": _primary_key,
    "s06_relationships_hold": _holds,
    "s07_split_random": _split_random,
    "s08_split_relational": _split_relational,
    "s09_referential_integrity": _integrity,
    "s10_validate_model": _validate,
    "s11_children_per_parent": _children,
    "s12_cardinality_shape": lambda spark, sf: rounded(_shape(spark, sf)),
    "s13_cardinality_statistic": _statistic,
    "s14_structure_scores": _scores,
    "s15_relationship_records": _records,
}

# ---- SQL -------------------------------------------------------------------

_COPIES = (
    f"shifted AS (SELECT o_orderkey, o_custkey + {SHIFT} AS o_custkey FROM orders), "
    "partial AS (SELECT * FROM orders WHERE o_orderstatus <> 'P')"
)


def _in_copy(source: str, table: str) -> str:
    return source if table == "ORDERS" and source != "real" else table.lower()


def _integrity_rows() -> str:
    rows = []
    for r in RELS:
        for s in ("real", "shifted", "partial"):
            p, c = _in_copy(s, r.parent_table), _in_copy(s, r.child_table)
            rows.append(
                f"SELECT '{r.label}' AS relationship, '{s}' AS source, "
                f"(SELECT avg(CASE WHEN {r.child_key} IN (SELECT {r.parent_key} FROM {p}) THEN 1.0 ELSE 0 END) "
                f"FROM {c} WHERE {r.child_key} IS NOT NULL) AS fk_coverage, "
                f"(SELECT avg(CASE WHEN {r.parent_key} IN (SELECT {r.child_key} FROM {c}) THEN 1.0 ELSE 0 END) "
                f"FROM {p} WHERE {r.parent_key} IS NOT NULL) AS parent_coverage"
            )
    return " UNION ALL ".join(rows)


def _counts_sql(source: str, r: Relationship) -> str:
    p, c = _in_copy(source, r.parent_table), _in_copy(source, r.child_table)
    return f"(SELECT count({c}.{r.child_key})::DOUBLE AS v FROM {p} LEFT JOIN {c} ON {p}.{r.parent_key} = {c}.{r.child_key} GROUP BY {p}.{r.parent_key})"


_SHAPE_ROWS = " UNION ALL ".join(
    f"SELECT '{s}' AS synth, '{r.label}' AS relationship, {ks_sql(_counts_sql('real', r), _counts_sql(s, r), 'v')} AS score"
    for s in ("shifted", "partial") for r in RELS
)
_STATISTIC_ROWS = " UNION ALL ".join(
    f"SELECT '{s}' AS synth, '{r.label}' AS relationship, (SELECT CASE WHEN hi > lo THEN greatest(0, 1 - abs(m - "
    f"(SELECT avg(v) FROM {_counts_sql(s, r)})) / (hi - lo)) ELSE (m = (SELECT avg(v) FROM {_counts_sql(s, r)}))::INT END "
    f"FROM (SELECT avg(v) AS m, min(v) AS lo, max(v) AS hi FROM {_counts_sql('real', r)})) AS score"
    for s in ("shifted", "partial") for r in RELS
)
_STATUS = "CASE WHEN fk_coverage >= 0.99 THEN 'PASS' WHEN fk_coverage >= 0.9 THEN 'WARN' ELSE 'FAIL' END"
_HELD = bucket_sql("{}") + " < 250"


def _validate_sql() -> str:
    rows = []
    for r in [*RELS, BROKEN]:
        p, c = _in_copy("shifted", r.parent_table), _in_copy("shifted", r.child_table)
        cov = f"(SELECT avg(CASE WHEN {r.child_key} IN (SELECT {r.parent_key} FROM {p}) THEN 1.0 ELSE 0 END) FROM {c})"
        dup = f"(SELECT max(n) FROM (SELECT count(*) AS n FROM {p} GROUP BY {r.parent_key})) > 1"
        rows.append(
            f"SELECT '{r.label}' AS label, CASE WHEN {dup} THEN 'FAIL' WHEN {cov} >= 0.99 THEN 'PASS' "
            f"WHEN {cov} >= 0.9 THEN 'WARN' ELSE 'FAIL' END AS status, CASE WHEN {dup} THEN "
            f"'{r.parent_table}.{r.parent_key} repeats' ELSE "
            f"printf('%.1f', {cov} * 100) || '% of child keys found' END AS detail"
        )
    rows.append(f"SELECT '{ABSENT.label}', 'FAIL', 'table or column not found'")
    rows.append("SELECT 'hub o_custkey → ORDERS', 'PASS', count(DISTINCT o_custkey) || ' entities' FROM shifted")
    return f"WITH {_COPIES} " + " UNION ALL ".join(rows)


def _holds_sql() -> str:
    rows = [f"SELECT '{ABSENT.label}' AS relationship, false AS holds"]
    for r in [*RELS, BROKEN]:
        p, c = r.parent_table.lower(), r.child_table.lower()
        rows.append(
            f"SELECT '{r.label}', (SELECT max(n) FROM (SELECT count(*) AS n FROM {p} GROUP BY {r.parent_key})) = 1 "
            f"AND NOT EXISTS (SELECT 1 FROM {p} WHERE {r.parent_key} IS NULL) AND NOT EXISTS (SELECT 1 FROM {c} "
            f"WHERE {r.child_key} IS NOT NULL AND {r.child_key} NOT IN (SELECT {r.parent_key} FROM {p}))"
        )
    return " UNION ALL ".join(rows)


_UNIQ = " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count(*) AS n_rows, count(*) - count({c}) AS n_null, count(DISTINCT {c}) AS n_distinct, "
    f"count(DISTINCT {c}) = count(*) AS is_unique FROM events"
    for c in ("event_id", "user_id", "event_type", "props")
)
_ORDER_ENTITIES = "FROM orders JOIN customer ON o_custkey = c_custkey"

SQL = {
    "s01_entity_keys": "SELECT o_custkey AS custkey FROM orders UNION SELECT user_id FROM events",
    # columns of customer are constant per customer (one row each); the key itself has the same name everywhere
    "s02_entity_hub": (
        "SELECT k.custkey, c_name, c_nationkey, round(c_acctbal, 6) AS c_acctbal, c_mktsegment FROM "
        "(SELECT c_custkey AS custkey FROM customer UNION SELECT o_custkey FROM orders UNION SELECT user_id FROM events) k "
        "LEFT JOIN customer ON c_custkey = k.custkey"
    ),
    "s03_invariant_columns": "SELECT "
    + ", ".join(
        f"max(d_{c}) > 1 AS varies_{c}, max(d_{c}) > 0 AS filled_{c}"
        for c in ("c_mktsegment", "o_orderstatus", "o_totalprice")
    )
    + " FROM (SELECT "
    + ", ".join(f"count(DISTINCT {c}) AS d_{c}" for c in ("c_mktsegment", "o_orderstatus", "o_totalprice"))
    + f" {_ORDER_ENTITIES} GROUP BY o_custkey)",
    "s04_lift_invariants": f"SELECT o_custkey, max(c_mktsegment) AS c_mktsegment, max(c_acctbal) AS c_acctbal {_ORDER_ENTITIES} GROUP BY o_custkey",
    "s05_uniqueness": _UNIQ,
    "s05_primary_key": (
        "SELECT 'customer' AS \"table\", CASE WHEN count(DISTINCT c_custkey) = count(*) THEN 'c_custkey' END AS primary_key FROM customer "
        "UNION ALL SELECT 'orders', CASE WHEN count(DISTINCT o_orderkey) = count(*) THEN 'o_orderkey' END FROM orders "
        "UNION ALL SELECT 'events', CASE WHEN count(DISTINCT event_id) = count(*) THEN 'event_id' END FROM events "
        "UNION ALL SELECT 'nation', CASE WHEN count(DISTINCT n_nationkey) = count(*) THEN 'n_nationkey' END FROM nation"
    ),
    "s06_relationships_hold": _holds_sql(),
    "s07_split_random": f"SELECT o_orderkey, CASE WHEN {_HELD.format('o_orderkey')} THEN 'holdout' ELSE 'train' END AS side FROM orders",
    "s08_split_relational": (
        f"WITH {_COPIES}, n AS (SELECT n_nationkey AS k, {_HELD.format('n_nationkey')} AS h FROM nation), "
        f"c AS (SELECT c_custkey AS k, coalesce(n.h, {_HELD.format('c_custkey')}) AS h FROM customer LEFT JOIN n ON n.k = c_nationkey), "
        f"o AS (SELECT o_orderkey AS k, coalesce(c.h, {_HELD.format('o_orderkey')}) AS h FROM shifted LEFT JOIN c ON c.k = o_custkey), "
        f"l AS (SELECT l_orderkey AS k, coalesce(o.h, {_HELD.format('l_orderkey')}) AS h FROM lineitem LEFT JOIN o ON o.k = l_orderkey) "
        + " UNION ALL ".join(
            f"SELECT '{t}' AS \"table\", h AS holdout, count(*) AS n, sum(k)::BIGINT AS key_sum FROM {a} GROUP BY h"
            for t, a in (("NATION", "n"), ("CUSTOMER", "c"), ("ORDERS", "o"), ("LINEITEM", "l"))
        )
    ),
    "s09_referential_integrity": (
        f"WITH {_COPIES} SELECT relationship, source, round(fk_coverage, 6) AS fk_coverage, "
        f"round(parent_coverage, 6) AS parent_coverage, {_STATUS} AS status FROM ({_integrity_rows()})"
    ),
    "s10_validate_model": _validate_sql(),
    "s15_relationship_records": " UNION ALL ".join(
        f"SELECT '{r.parent_table}' AS parent_table_name, '{r.parent_key}' AS parent_primary_key, '{r.child_table}' AS child_table_name, "
        f"'{r.child_key}' AS child_foreign_key, CASE WHEN count(*) = count(DISTINCT {r.child_key}) THEN '1-1' ELSE '1-*' END AS cardinality "
        f"FROM {r.child_table.lower()} WHERE {r.child_key} IS NOT NULL"
        for r in RELS
    ),
    "s11_children_per_parent": "SELECT c_custkey, count(o_custkey) AS n_children FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey",
    "s12_cardinality_shape": f"WITH {_COPIES} SELECT synth, relationship, round(score, 6) AS score FROM ({_SHAPE_ROWS})",
    "s13_cardinality_statistic": f"WITH {_COPIES} SELECT synth, relationship, round(score, 6) AS score FROM ({_STATISTIC_ROWS})",
    "s14_structure_scores": (
        f"WITH {_COPIES}, ri AS ({_integrity_rows()}), sh AS ({_SHAPE_ROWS}), d AS ("
        "SELECT a.source AS synth, avg(a.fk_coverage) AS fk_validity, avg(1 - least(1, abs(a.parent_coverage - b.parent_coverage))) AS participation "
        "FROM ri a JOIN ri b ON a.relationship = b.relationship AND b.source = 'real' WHERE a.source <> 'real' GROUP BY a.source) "
        "SELECT synth, round((SELECT avg(score) FROM sh WHERE sh.synth = d.synth), 6) AS structure, round(fk_validity, 6) AS fk_validity, "
        "CASE WHEN fk_validity >= 0.999 THEN 'PASS' WHEN fk_validity >= 0.99 THEN 'WARN' ELSE 'FAIL' END AS fk_gate, "
        "round(participation, 6) AS participation FROM d"
    ),
}
