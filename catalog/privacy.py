"""Privacy queries (V-01 ... V-15)."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from catalog.base import (
    LINE_COPIES_SQL, LINE_ROLES, LINE_SPLIT_SQL, ORDER_ROLES, ORDERS_SPLIT_SQL, boot_sql, bucket_sql, line_copies,
    lineitem_split, load, orders_split, rounded,
)
from twinlens.model import ColumnRoles
from twinlens.operators import encode, knn, privacy
from twinlens.operators.refill import bootstrap_table
from twinlens.operators.split import split_random
from twinlens.plans.privacy import privacy_report
from twinlens.session import durable

CUSTOMER_ROLES = ColumnRoles(["c_acctbal", "c_nationkey"], ["c_mktsegment"])


def customer_split(spark, sf):
    return split_random(load(spark, sf, "customer"), F.col("c_custkey"))


def orders_copies(spark, sf):
    train, held = orders_split(spark, sf)
    boot = bootstrap_table(train, F.col("o_orderkey"), ORDER_ROLES.modelable, seed=9, small=ORDER_ROLES.categorical)
    return train, held, durable(boot)


def _coerce(spark, sf):
    parts = load(spark, sf, "part").withColumn("p_size", F.concat(F.col("p_size").cast("string"), F.when(F.pmod("p_partkey", F.lit(3)) == 0, "cm").otherwise("")))
    return rounded(encode.coerce_frame(parts, ["p_size", "p_retailprice"], ["p_partkey"]))


def _encode(spark, sf):
    train, held = customer_split(spark, sf)
    encoder = encode.fit_encoder(train, CUSTOMER_ROLES)
    numbers = [F.round(encoder.number(c), 6).alias(c) for c in CUSTOMER_ROLES.numeric]
    return held.select("c_custkey", *numbers, encoder.category("c_mktsegment").alias("c_mktsegment"))


def _vectors(spark, sf):
    train, held = customer_split(spark, sf)
    encoder = encode.fit_encoder(train, CUSTOMER_ROLES)
    vectors = encoder.vectors(held, "c_custkey")
    return vectors.select("c_custkey", F.posexplode(vector_to_array("features")).alias("slot", "value")).select(
        "c_custkey", "slot", F.round("value", 6).alias("value")
    )


def _knn(spark, sf):
    rows = load(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("features"))
    base, query = split_random(rows, F.col("vec_id"))
    near = knn.knn_distances(query, base, 5).select("vec_id", F.posexplode("distances").alias("rank", "distance"))
    return rounded(near)


def _dcr_distances(spark, sf):
    train, held = customer_split(spark, sf)
    return privacy.dcr_distances(train, held, CUSTOMER_ROLES)


def _overlay(spark, sf):
    distances = durable(_dcr_distances(spark, sf).withColumnRenamed("kind", "series"))
    return rounded(privacy.dcr_overlay(distances))


def _mia(spark, sf):
    train, held = customer_split(spark, sf)
    boot = durable(bootstrap_table(train, F.col("c_custkey"), CUSTOMER_ROLES.modelable, seed=9, small=["c_mktsegment"]))
    return privacy.membership_inference(train, held, boot, CUSTOMER_ROLES, F.col("c_custkey"))


def _exact(spark, sf):
    real, copies = line_copies(spark, sf)
    return rounded(privacy.exact_match_rate(real, copies["boot"], LINE_ROLES))


def _new_rows(spark, sf):
    train, _, boot = orders_copies(spark, sf)
    return rounded(privacy.new_row_synthesis(train, boot, ORDER_ROLES))


def _new_rows_lineitem(spark, sf):
    real, copies = line_copies(spark, sf)
    return rounded(privacy.new_row_synthesis(real, copies["boot"], LINE_ROLES))


def _new_rows_baseline(spark, sf):
    train, held, _ = orders_copies(spark, sf)
    return rounded(privacy.new_row_synthesis(train, held, ORDER_ROLES))


def _sensitive(spark, sf):
    real, _ = lineitem_split(spark, sf, LINE_ROLES.categorical)
    return rounded(privacy.sensitive_shares(real, LINE_ROLES.categorical))


CAP_KEYS, CAP_SECRET = ["l_linestatus", "l_linenumber"], "l_returnflag"
NEAR_KEYS = ["l_quantity", "l_discount", "l_linenumber"]


def _cap(spark, sf):
    real, copies = line_copies(spark, sf, [*CAP_KEYS, CAP_SECRET])
    return rounded(privacy.categorical_cap(real, copies["boot"], CAP_KEYS, CAP_SECRET))


def _cap_baseline(spark, sf):
    real, held = lineitem_split(spark, sf, [*CAP_KEYS, CAP_SECRET])
    return rounded(privacy.categorical_cap(real, held, CAP_KEYS, CAP_SECRET))


def _generalized(spark, sf):
    """The attacker knows the holdout; keys without an exact match there are the interesting ones."""
    real, held = lineitem_split(spark, sf, [*NEAR_KEYS, CAP_SECRET])
    return rounded(privacy.generalized_cap(real, held, NEAR_KEYS, CAP_SECRET))


def _verdicts(spark, sf):
    metrics = None
    for name, low in (("a", 0.0), ("b", 300000.0)):
        orders = load(spark, sf, "orders").where(F.col("o_totalprice") >= low)
        share = orders.groupBy("o_orderpriority").agg(
            F.round(F.avg((F.col("o_orderstatus") == "F").cast("double")) + 0.3, 6).alias("value"),
            F.round(F.avg((F.col("o_totalprice") > 200000).cast("double")), 6).alias("baseline"),
        )
        rows = None
        for metric in ("membership_inference", "new_row_synthesis", "categorical_cap"):
            part = share.select(
                F.lit(name).alias("synth"), F.col("o_orderpriority").alias("table"), F.lit(metric).alias("metric"),
                F.when(F.col("o_orderpriority") != "5-LOW", F.col("value")).alias("value"),
                F.when(F.lit(metric != "membership_inference"), F.col("baseline")).alias("baseline"), F.lit("").alias("note"),
            )
            rows = part if rows is None else rows.union(part)
        metrics = rows if metrics is None else metrics.union(rows)
    return rounded(privacy.privacy_verdicts(metrics))


def _report(spark, sf):
    train, held = customer_split(spark, sf)
    roles = ColumnRoles(["c_acctbal"], ["c_mktsegment", "c_nationkey"])
    boot = durable(bootstrap_table(train, F.col("c_custkey"), roles.modelable, seed=9, small=["c_mktsegment"]))
    return privacy_report(train, held, {"boot": boot}, roles, F.col("c_custkey"), table="CUSTOMER", extended=True)


QUERIES = {
    "v01_coerce_frame": _coerce,
    "v02_encode": _encode,
    "v02_feature_vectors": _vectors,
    "v03_knn_distances": _knn,
    "v04_membership_inference": _mia,
    "v05_dcr_distances": lambda spark, sf: rounded(_dcr_distances(spark, sf)),
    "v05_dcr_summary": lambda spark, sf: rounded(privacy.dcr_summary(_dcr_distances(spark, sf))),
    "v06_dcr_overlay": _overlay,
    "v07_exact_match": _exact,
    "v08_new_row_synthesis": _new_rows,
    "v08_new_row_lineitem": _new_rows_lineitem,
    "v09_new_row_baseline": _new_rows_baseline,
    "v10_sensitive_shares": _sensitive,
    "v11_categorical_cap": _cap,
    "v12_generalized_cap": _generalized,
    "v13_cap_baseline": _cap_baseline,
    "v14_privacy_verdicts": _verdicts,
    "v15_privacy_report": _report,
}

# ---- SQL -------------------------------------------------------------------

_CUSTOMER = (
    f"train AS (SELECT * FROM customer WHERE {bucket_sql('c_custkey')} >= 250), "
    f"held AS (SELECT * FROM customer WHERE {bucket_sql('c_custkey')} < 250)"
)


def _scaled(c: str) -> str:
    filled = f"coalesce({c}, (SELECT median({c}) FROM train))"
    return f"({filled} - (SELECT avg({filled}) FROM train)) / (SELECT stddev_pop({filled}) FROM train)"


_SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")


def _vector_sql(table: str) -> str:
    return (
        f"SELECT c_custkey, {_scaled('c_acctbal')} AS a, {_scaled('c_nationkey')} AS b, c_mktsegment AS s FROM {table}"
    )


_DISTANCE = "sqrt((x.a - y.a) ** 2 + (x.b - y.b) ** 2 + CASE WHEN x.s = y.s THEN 0 ELSE 2 END)"
_DCR = (
    f"WITH {_CUSTOMER}, tv AS ({_vector_sql('train')}), hv AS ({_vector_sql('held')}), dist AS ("
    f"SELECT 'synth' AS kind, min({_DISTANCE}) AS distance FROM tv x, hv y GROUP BY x.c_custkey UNION ALL "
    f"SELECT 'real', min({_DISTANCE}) FROM tv x, tv y WHERE x.c_custkey <> y.c_custkey GROUP BY x.c_custkey)"
)
_ORDER_COPIES = ORDERS_SPLIT_SQL + ", " + boot_sql("train", "o_orderkey", ORDER_ROLES.modelable, ORDER_ROLES.categorical, 9, "boot")


def _new_rows_sql(ctes: str, synth: str, numeric: list[str], categorical: list[str]) -> str:
    near = [f"(abs(r.{c} - s.{c}) <= 0.01 * abs(s.{c}) OR (r.{c} IS NULL AND s.{c} IS NULL))" for c in numeric]
    same = [f"r.{c} IS NOT DISTINCT FROM s.{c}" for c in categorical]
    columns = ", ".join(numeric + categorical)
    return (
        f"WITH {ctes}, s AS (SELECT {columns}, count(*) AS n FROM {synth} GROUP BY ALL), r AS (SELECT DISTINCT {columns} FROM train), "
        f"m AS (SELECT s.* FROM s SEMI JOIN r ON {' AND '.join(same + near)}) "
        "SELECT sum(n)::BIGINT AS n_rows, (SELECT coalesce(sum(n), 0) FROM m)::BIGINT AS n_matched, "
        "round(1 - (SELECT coalesce(sum(n), 0) FROM m) / sum(n), 6) AS new_row_synthesis FROM s"
    )


def _cap_sql(ctes: str, attacker: str, keys: list[str], secret: str) -> str:
    k = ", ".join(keys)
    on = " AND ".join(f"t.{c} = a.{c}" for c in keys)
    return (
        f"WITH {ctes} SELECT count(*) AS n_matched, round(1 - avg(coalesce(h.n, 0) / a.n), 6) AS score FROM train t "
        f"JOIN (SELECT {k}, count(*) AS n FROM {attacker} GROUP BY {k}) a ON {on} "
        f"LEFT JOIN (SELECT {k}, {secret}, count(*) AS n FROM {attacker} GROUP BY {k}, {secret}) h ON "
        + " AND ".join(f"t.{c} = h.{c}" for c in [*keys, secret])
    )


def _generalized_sql() -> str:
    miss = " + ".join(f"(t.{c} <> a.{c})::INT" for c in NEAR_KEYS)
    k = ", ".join(NEAR_KEYS)
    return (
        f"WITH {LINE_SPLIT_SQL}, t AS (SELECT {k}, {CAP_SECRET} AS s, count(*) AS n FROM train GROUP BY ALL), "
        f"a AS (SELECT {k}, {CAP_SECRET} AS s, count(*) AS n FROM held GROUP BY ALL), "
        f"d AS (SELECT {', '.join('t.' + c for c in NEAR_KEYS)}, t.s, any_value(t.n) AS n, {miss} AS h, sum(a.n) AS total, "
        f"sum(CASE WHEN a.s = t.s THEN a.n ELSE 0 END) AS hits FROM t, a GROUP BY {', '.join('t.' + c for c in NEAR_KEYS)}, t.s, h), "
        f"best AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY {k}, s ORDER BY h) = 1) "
        "SELECT sum(n)::BIGINT AS n_matched, round(1 - sum(n * hits / total) / sum(n), 6) AS score FROM best"
    )


def _overlay_sql() -> str:
    return (
        f"{_DCR}, top AS (SELECT quantile_cont(distance, 0.99) + 1e-9 AS high FROM dist), "
        "b AS (SELECT kind, least(floor(distance / (high / 49)), 48)::INTEGER AS bin, high / 49 AS width FROM dist, top WHERE distance <= high) "
        "SELECT kind AS series, bin, round(bin * any_value(width), 6) AS low, count(*) AS n, "
        "round(count(*) / (sum(count(*)) OVER (PARTITION BY kind) * any_value(width)), 6) AS density FROM b GROUP BY kind, bin"
    )


#: what a judged row says, from value, baseline and metric
DETAIL_SQL = (
    "CASE WHEN value IS NULL THEN 'not computable' WHEN metric = 'membership_inference' THEN printf('attacker AUC=%.3f', value) "
    "WHEN baseline IS NULL THEN printf('%.3f, no baseline', value) ELSE printf('%.3f vs %.3f for a real holdout: ', value, baseline) || "
    "CASE WHEN baseline - value <= 0.05 THEN 'reaches the achievable ceiling' ELSE printf('%.2f below it', baseline - value) END || "
    "CASE WHEN baseline < CASE WHEN metric = 'new_row_synthesis' THEN 0.9 ELSE 0.5 END THEN ' (low ceiling: a property of the table)' ELSE '' END END"
)


def _verdict_sql() -> str:
    rows = []
    for name, low in (("a", 0), ("b", 300000)):
        for metric in ("membership_inference", "new_row_synthesis", "categorical_cap"):
            base = "NULL::DOUBLE" if metric == "membership_inference" else "round(avg((o_totalprice > 200000)::INT), 6)"
            rows.append(
                f"SELECT '{name}' AS synth, o_orderpriority AS \"table\", '{metric}' AS metric, "
                "CASE WHEN o_orderpriority <> '5-LOW' THEN round(avg((o_orderstatus = 'F')::INT) + 0.3, 6) END AS value, "
                f"{base} AS baseline, '' AS note FROM orders WHERE o_totalprice >= {low} GROUP BY o_orderpriority"
            )
    return (
        "SELECT *, CASE WHEN value IS NULL THEN 'SKIP' WHEN metric = 'membership_inference' THEN CASE WHEN abs(value - 0.5) <= 0.1 THEN 'PASS' "
        "WHEN abs(value - 0.5) <= 0.2 THEN 'WARN' ELSE 'FAIL' END WHEN baseline - value <= 0.05 THEN 'PASS' "
        f"WHEN baseline - value <= 0.2 THEN 'WARN' ELSE 'FAIL' END AS status, {DETAIL_SQL} AS detail FROM ({' UNION ALL '.join(rows)})"
    )


def _vectors_sql() -> str:
    parts = [f"SELECT c_custkey, {i} AS slot, round({_scaled(c)}, 6) AS value FROM held" for i, c in enumerate(CUSTOMER_ROLES.numeric)]
    parts.append(
        "SELECT c_custkey, (1 + k.i)::INTEGER AS slot, CASE WHEN c_mktsegment = k.v THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS value FROM held, "
        "(SELECT v, row_number() OVER (ORDER BY v) AS i FROM (SELECT DISTINCT c_mktsegment AS v FROM train)) k"
    )
    return f"WITH {_CUSTOMER} " + " UNION ALL ".join(parts)


_EXACT_COLUMNS = LINE_ROLES.modelable

SQL = {
    "v01_coerce_frame": (
        "SELECT p_partkey::VARCHAR AS p_partkey, p_name, p_brand, p_type, CASE WHEN p_partkey % 3 <> 0 THEN p_size::DOUBLE END AS p_size, "
        "round(p_retailprice, 6) AS p_retailprice FROM part"
    ),
    "v02_encode": (
        f"WITH {_CUSTOMER} SELECT c_custkey, round({_scaled('c_acctbal')}, 6) AS c_acctbal, round({_scaled('c_nationkey')}, 6) AS c_nationkey, "
        "coalesce(c_mktsegment, (SELECT mode(c_mktsegment) FROM train)) AS c_mktsegment FROM held"
    ),
    "v02_feature_vectors": _vectors_sql(),
    "v03_knn_distances": (
        f"WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), q AS (SELECT * FROM e WHERE {bucket_sql('vec_id')} < 250), "
        f"b AS (SELECT * FROM e WHERE {bucket_sql('vec_id')} >= 250) SELECT vec_id, (rank - 1)::INTEGER AS rank, round(distance, 6) AS distance FROM ("
        "SELECT q.vec_id, list_distance(q.v, b.v) AS distance, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_distance(q.v, b.v)) AS rank "
        "FROM q, b) WHERE rank <= 5"
    ),
    "v05_dcr_distances": f"{_DCR} SELECT kind, round(distance, 6) AS distance FROM dist",
    "v05_dcr_summary": (
        f"{_DCR}, m AS (SELECT quantile_cont(distance, 0.5) FILTER (kind = 'synth') AS rs, quantile_cont(distance, 0.05) FILTER (kind = 'synth') AS p, "
        "quantile_cont(distance, 0.5) FILTER (kind = 'real') AS rr FROM dist) SELECT round(rs, 6) AS dcr_real_synth_median, "
        "round(p, 6) AS dcr_real_synth_p05, round(rr, 6) AS dcr_real_real_median, round(rs / (rr + 1e-12), 6) AS dcr_ratio_median FROM m"
    ),
    "v06_dcr_overlay": _overlay_sql(),
    "v07_exact_match": (
        f"WITH {LINE_COPIES_SQL} SELECT count(*) AS n_rows, count_if(hit)::BIGINT AS n_exact_matches, round(avg(hit::INT), 6) AS exact_match_rate FROM "
        f"(SELECT ({', '.join(_EXACT_COLUMNS)}) IN (SELECT ({', '.join(_EXACT_COLUMNS)}) FROM train) AS hit FROM boot)"
    ),
    "v08_new_row_synthesis": _new_rows_sql(_ORDER_COPIES, "boot", ORDER_ROLES.numeric, ORDER_ROLES.categorical),
    "v08_new_row_lineitem": _new_rows_sql(LINE_COPIES_SQL, "boot", LINE_ROLES.numeric, LINE_ROLES.categorical),
    "v09_new_row_baseline": _new_rows_sql(ORDERS_SPLIT_SQL, "held", ORDER_ROLES.numeric, ORDER_ROLES.categorical),
    "v10_sensitive_shares": f"WITH {LINE_SPLIT_SQL} " + " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", {i} AS position, round(max(n) / sum(n), 6) AS share FROM (SELECT count(*) AS n FROM train WHERE {c} IS NOT NULL GROUP BY {c}) HAVING count(*) >= 2"
        for i, c in enumerate(LINE_ROLES.categorical)
    ),
    "v11_categorical_cap": _cap_sql(LINE_COPIES_SQL, "boot", CAP_KEYS, CAP_SECRET),
    "v12_generalized_cap": _generalized_sql(),
    "v13_cap_baseline": _cap_sql(LINE_SPLIT_SQL, "held", CAP_KEYS, CAP_SECRET),
    "v14_privacy_verdicts": _verdict_sql(),
}
