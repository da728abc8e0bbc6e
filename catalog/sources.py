"""Source and sink queries (IO-01 ... IO-06).

The readers run on what Spark itself wrote from the given tables, into a new
folder under the session's checkpoint directory (or a temporary one without it).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import load, rounded
from twinlens.model import TableMeta
from twinlens.operators.roles import apply_schema_overrides, detect_sdtypes
from twinlens.session import new_folder
from twinlens.sources import tables


def _round_trip(spark, sf):
    path = f"{new_folder(spark, "io")}/customer.csv"
    tables.write_table(load(spark, sf, "customer"), path)
    found = tables.read_tables(spark, [path])
    return found["CUSTOMER"]


def _text_round_trip(spark, sf):
    """Long texts with line breaks, quotes and commas survive the CSV sink and reader."""
    path = f"{new_folder(spark, "io")}/documents.csv"
    tables.write_table(load(spark, sf, "documents"), path)
    return tables.read_tables(spark, [path])["DOCUMENTS"]


def _report_csv(spark, sf):
    path = f"{new_folder(spark, "io")}/parts.csv"
    tables.write_table(load(spark, sf, "part"), path)
    return spark.read.option("header", True).option("escape", '"').csv(path).select("p_partkey", "p_name")


def _parquet(spark, sf):
    return tables.read_tables(spark, [f"{sf}/supplier.parquet"], views=True)["SUPPLIER"]


def _report(spark, sf):
    path = f"{new_folder(spark, "io")}/report.parquet"
    shares = load(spark, sf, "orders").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))
    tables.write_report(shares, path, "parquet")
    return spark.read.parquet(path)


def _summary(spark, sf):
    path = f"{new_folder(spark, "io")}/summary.json"
    status = load(spark, sf, "orders").groupBy("o_orderstatus").agg(
        F.avg("o_totalprice").alias("mean"), F.sum(F.lit(float("nan"))).alias("broken")
    )
    summary = status.select("o_orderstatus", F.struct("mean", "broken").alias("price"))
    tables.write_summary(summary, path)
    back = spark.read.schema("o_orderstatus string, price struct<mean: double, broken: double>").json(path)
    return rounded(back.select("o_orderstatus", F.col("price.mean").alias("mean"), F.col("price.broken").alias("broken")))


OVERVIEW = ("orders", "documents", "events")


def _overview(spark, sf):
    return tables.stack_tables({t: tables.table_overview(load(spark, sf, t)) for t in OVERVIEW})


def _preview(spark, sf):
    return tables.table_preview(load(spark, sf, "orders"), ["o_orderkey"])


def _sdtypes(spark, sf):
    return tables.stack_tables({t: detect_sdtypes(load(spark, sf, t)) for t in (*OVERVIEW, "lineitem", "embeddings")})


def _overrides(spark, sf):
    """Edited types change the physical column; the chosen key becomes an id and keeps its values."""
    orders = load(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", "o_totalprice")
    found = {r["column"]: r["sdtype"] for r in detect_sdtypes(orders).collect()}
    edits = {"o_orderkey": "categorical", "o_custkey": "id", "o_orderpriority": "numerical", "o_totalprice": "numerical", "absent": "id"}
    typed, meta = apply_schema_overrides(orders, TableMeta(found), edits, "o_orderkey")
    kinds = F.concat_ws(",", *[F.lit(f"{c}={meta.sdtypes[c]}") for c in orders.columns])
    return rounded(typed.withColumn("sdtypes", kinds))


QUERIES = {
    "io01_read_csv": _round_trip,
    "io01_read_csv_text": _text_round_trip,
    "io01_read_parquet": _parquet,
    "io02_write_csv": _report_csv,
    "io03_write_report": _report,
    "io04_write_summary": _summary,
    "io05_table_overview": _overview,
    "io05_table_preview": _preview,
    "io06_detect_sdtypes": _sdtypes,
    "io07_apply_overrides": _overrides,
}

# ---- SQL -------------------------------------------------------------------

_TYPES = {
    "orders": {"o_orderkey": "id", "o_custkey": "num", "o_orderstatus": "text", "o_totalprice": "num",
               "o_orderdate": "datetime", "o_orderpriority": "text"},
    "documents": {"doc_id": "id", "text": "text", "lang": "text", "source": "text", "n_chars": "num"},
    "events": {"event_id": "id", "ts": "datetime", "user_id": "id", "event_type": "text", "value": "num", "props": "text"},
    "lineitem": {"l_orderkey": "id", "l_partkey": "id", "l_suppkey": "id", "l_linenumber": "num", "l_quantity": "num",
                 "l_extendedprice": "num", "l_discount": "num", "l_tax": "num", "l_returnflag": "text",
                 "l_linestatus": "text", "l_shipdate": "datetime"},
    "embeddings": {"vec_id": "id", "embedding": "unknown", "label": "num"},
}
_KEYISH = {"o_custkey"}


def _sdtype_sql(c: str, kind: str) -> str:
    if kind in ("datetime", "unknown"):
        return f"max('{kind}')"
    unique = f"count(DISTINCT {c}) = count(*)"
    if kind == "id" or c in _KEYISH:
        return f"CASE WHEN {unique} THEN 'id' ELSE 'numerical' END"
    if kind == "num":
        return "max('numerical')"
    return f"CASE WHEN count(DISTINCT {c}) <= 50 THEN 'categorical' ELSE 'unknown' END"


def _sdtypes_sql() -> str:
    return " UNION ALL ".join(
        f"SELECT '{t}' AS \"table\", '{c}' AS \"column\", {i} AS position, {_sdtype_sql(c, kind)} AS sdtype FROM {t}"
        for t, columns in _TYPES.items() for i, (c, kind) in enumerate(columns.items())
    )


def _overview_sql() -> str:
    rows = []
    for t in OVERVIEW:
        for i, (c, kind) in enumerate(_TYPES[t].items()):
            rows.append(
                f"SELECT '{t}' AS \"table\", '{c}' AS \"column\", {i} AS position, {_sdtype_sql(c, kind)} AS sdtype, "
                f"count(*) AS rows, count(DISTINCT {c}) AS \"distinct\", round(100.0 * (count(*) - count({c})) / count(*), 1)::DOUBLE "
                f"AS missing_pct, coalesce(min(substr({c}::VARCHAR, 1, 40)), '') AS example FROM {t}"
            )
    return " UNION ALL ".join(rows)


SQL = {
    "io01_read_csv": "SELECT * REPLACE (c_custkey::BIGINT AS c_custkey, c_nationkey::BIGINT AS c_nationkey) FROM customer",
    "io01_read_csv_text": "SELECT doc_id, text, lang, source, n_chars::BIGINT AS n_chars FROM documents",
    "io01_read_parquet": "SELECT * FROM supplier",
    "io02_write_csv": "SELECT p_partkey::VARCHAR AS p_partkey, p_name FROM part",
    "io03_write_report": "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1",
    "io04_write_summary": "SELECT o_orderstatus, round(avg(o_totalprice), 6) AS mean, NULL::DOUBLE AS broken FROM orders GROUP BY 1",
    "io05_table_overview": _overview_sql(),
    "io05_table_preview": (
        "SELECT o_orderkey::VARCHAR AS o_orderkey, o_custkey::VARCHAR AS o_custkey, o_orderstatus, "
        "o_totalprice::VARCHAR AS o_totalprice, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS o_orderdate, o_orderpriority FROM orders ORDER BY orders.o_orderkey LIMIT 5"
    ),
    "io06_detect_sdtypes": _sdtypes_sql(),
    "io07_apply_overrides": (
        "SELECT o_orderkey, o_custkey::VARCHAR AS o_custkey, o_orderstatus, try_cast(o_orderpriority AS DOUBLE) AS o_orderpriority, "
        "round(o_totalprice, 6) AS o_totalprice, 'o_orderkey=id,o_custkey=id,o_orderstatus=' || CASE WHEN (SELECT count(DISTINCT o_orderstatus) FROM orders) <= 50 "
        "THEN 'categorical' ELSE 'unknown' END || ',o_orderpriority=numerical,o_totalprice=numerical' AS sdtypes FROM orders"
    ),
}
