"""Generation queries (G-01 ... G-05)."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import (
    LINE_COPIES_SQL, LINE_ROLES, ORDER_ROLES, ORDERS_SPLIT_SQL, boot_sql, line_copies, lineitem_split, orders_split, rounded,
)
from catalog.structure import RELS, tables
from twinlens.model import ColumnRoles
from twinlens.operators import fidelity, structure, synth
from twinlens.session import durable
from twinlens.sources.tables import stack_tables

ROLES = {
    "NATION": ColumnRoles(categorical=["n_name"]),
    "CUSTOMER": ColumnRoles(["c_acctbal"], ["c_mktsegment"]),
    "ORDERS": ORDER_ROLES,
    "LINEITEM": LINE_ROLES,
}


def _fit(spark, sf):
    """Correlation of the normal scores, in long form."""
    train, _ = lineitem_split(spark, sf)
    model = synth.fit_gaussian_copula(train, LINE_ROLES)
    names = model.columns
    rows = [(a, b, float(model.correlation[i, j])) for i, a in enumerate(names) for j, b in enumerate(names)]
    return rounded(spark.createDataFrame(rows, "a string, b string, rho double"))


def _copula(spark, sf):
    train, _ = lineitem_split(spark, sf)
    model = synth.fit_gaussian_copula(train, LINE_ROLES)
    copy = durable(synth.sample_gaussian_copula(spark, model, 1.0, seed=11))
    return rounded(fidelity.column_shapes(train, {"copula": copy}, LINE_ROLES.numeric, LINE_ROLES.categorical))


def _hierarchy(spark, sf):
    real = tables(spark, sf)
    made = synth.sample_hierarchical(real, RELS, ROLES, {"LINEITEM": None}, seed=11)
    copy = {t: durable(df) for t, df in made.items()}
    return rounded(structure.referential_integrity(RELS, real, {"hierarchical": copy}))


def _suite(spark, sf):
    train, _ = orders_split(spark, sf)
    job = synth.SuiteInput({"ORDERS": train}, {"ORDERS": ORDER_ROLES}, {"ORDERS": F.col("o_orderkey")}, seed=11)
    suite = synth.generate_suite(job, ["gaussian_copula", "bootstrap"])
    # the bootstrap copy is known row by row; of the copula's only its size and its values
    drawn = F.when(F.col("generator") == "bootstrap", F.col("o_totalprice"))
    copies = stack_tables({name: made["ORDERS"] for name, made in suite.items()}, "generator")
    return rounded(
        copies.groupBy("generator").agg(
            F.count(F.lit(1)).alias("n_rows"), F.count("o_orderpriority").alias("n_filled"),
            F.countDistinct("o_orderstatus").alias("n_status"), F.round(F.sum(drawn), 2).alias("price"),
        )
    )


def _bootstrap(spark, sf):
    _, copies = line_copies(spark, sf)
    return rounded(copies["boot"])


QUERIES = {
    "g01_fit_copula": _fit,
    "g02_sample_copula": _copula,
    "g03_sample_hierarchical": _hierarchy,
    "g04_generate_suite": _suite,
    "g05_bootstrap": _bootstrap,
}


def _hierarchy_sql() -> str:
    """Foreign keys of the copy hold and its parents have exactly as many children as the real ones."""
    rows = []
    for r in RELS:
        p, c = r.parent_table.lower(), r.child_table.lower()
        hit = f"(SELECT avg(CASE WHEN {r.child_key} IN (SELECT {r.parent_key} FROM {p}) THEN 1.0 ELSE 0 END) FROM {c} WHERE {r.child_key} IS NOT NULL)"
        used = f"(SELECT avg(CASE WHEN {r.parent_key} IN (SELECT {r.child_key} FROM {c}) THEN 1.0 ELSE 0 END) FROM {p})"
        for source, share in (("real", hit), ("hierarchical", "1.0")):
            rows.append(
                f"SELECT '{r.label}' AS relationship, '{source}' AS source, round({share}, 6)::DOUBLE AS fk_coverage, "
                f"round({used}, 6)::DOUBLE AS parent_coverage, CASE WHEN {share} >= 0.99 THEN 'PASS' WHEN {share} >= 0.9 THEN 'WARN' "
                "ELSE 'FAIL' END AS status"
            )
    return " UNION ALL ".join(rows)


_ORDER_BOOT = boot_sql("train", "o_orderkey", ORDER_ROLES.modelable, ORDER_ROLES.categorical, 11, "boot")

SQL = {
    "g03_sample_hierarchical": _hierarchy_sql(),
    "g04_generate_suite": (
        f"WITH {ORDERS_SPLIT_SQL}, {_ORDER_BOOT} SELECT 'bootstrap' AS generator, count(*) AS n_rows, count(o_orderpriority) AS n_filled, "
        "count(DISTINCT o_orderstatus) AS n_status, round(sum(o_totalprice), 2) AS price FROM boot UNION ALL "
        "SELECT 'gaussian_copula', count(*), count(o_orderpriority), count(DISTINCT o_orderstatus), NULL FROM train"
    ),
    "g05_bootstrap": f"WITH {LINE_COPIES_SQL} SELECT {', '.join(LINE_ROLES.modelable)} FROM boot",
}
