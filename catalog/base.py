"""Inputs shared by the registered queries, in Spark and in SQL.

Stand-ins: lineitem / orders / customer play the real tables, split by a digest
of their key; ``boot`` is the bootstrap copy of the training rows and ``held`` is
the holdout used as if it were a generator's output.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinlens.model import ColumnRoles
from twinlens.operators.refill import bootstrap_table
from twinlens.operators.split import in_holdout, split_random
from twinlens.session import durable, durable_parts, spread


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    return spread(df) if table in ("lineitem", "orders", "customer", "events") else df


# ---- lineitem --------------------------------------------------------------

LINE_ROLES = ColumnRoles(
    numeric=["l_quantity", "l_extendedprice", "l_discount", "l_tax"],
    categorical=["l_linenumber", "l_returnflag", "l_linestatus"],
)
LINE_SMALL = ["l_quantity", "l_discount", "l_tax", "l_linenumber", "l_returnflag", "l_linestatus"]
_LINE_KEY_PARTS = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice")


def lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [F.col(c).cast("string") for c in _LINE_KEY_PARTS]
    key = F.concat_ws("-", *parts, F.col("l_shipdate").cast("date").cast("string"))
    return load(spark, sf_dir, "lineitem").withColumn("row_key", key)


LINE_SQL = (
    "SELECT *, concat_ws('-', "
    + ", ".join(f"{c}::VARCHAR" for c in _LINE_KEY_PARTS)
    + ", l_shipdate::DATE::VARCHAR) AS row_key FROM lineitem"
)


def lineitem_split(spark: SparkSession, sf_dir: str, columns: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """All rows with ``columns`` and their ``row_key``; every column by default."""
    rows = lineitem(spark, sf_dir)
    rows = rows.select("row_key", *columns) if columns else rows
    return durable_parts(rows, in_holdout(F.col("row_key")))  # read by many metrics, split once


def lineitem_boot(train: DataFrame, columns: list[str] | None = None) -> DataFrame:
    columns = columns or LINE_ROLES.modelable
    # written once: a copy is an input of many metrics and must not be drawn again for each
    return durable(bootstrap_table(train, F.col("row_key"), columns, seed=7, small=LINE_SMALL))


def line_copies(
    spark: SparkSession, sf_dir: str, columns: list[str] | None = None
) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Training rows and their copies with the ``columns`` a query uses; a column is drawn on its own, whatever the others."""
    columns = columns or LINE_ROLES.modelable
    train, held = lineitem_split(spark, sf_dir, columns)
    return train, {"boot": lineitem_boot(train, columns), "held": held}


def bucket_sql(key: str, seed: int = 42) -> str:
    return f"(('0x' || substr(md5({key}::VARCHAR || ':{seed}'), 1, 8))::BIGINT % 1000)"


def draw_sql(key: str, salt: str, seed: int, n: str) -> str:
    return f"(('0x' || substr(md5({key}::VARCHAR || ':{salt}:{seed}'), 1, 15))::BIGINT % {n})"


def uniform_sql(key: str, salt: str, seed: int) -> str:
    return (
        f"((('0x' || substr(md5({key}::VARCHAR || ':{salt}:{seed}'), 1, 13))::BIGINT::DOUBLE + 0.5)"
        f" / {2**52}.0::DOUBLE)"
    )


def boot_sql(real: str, key: str, columns: list[str], small: list[str], seed: int, out: str) -> str:
    """CTEs that bootstrap ``columns`` of ``real``; the last one is called ``out``."""
    big = [c for c in columns if c not in small]
    # rows with equal digests are numbered in column order, as in the Spark version
    order = ", ".join([f"md5({key}::VARCHAR)", *([key] if key not in big else []), *big])
    n = f"(SELECT count(*) FROM {real})"
    ctes = [
        f"{out}_d AS (SELECT {key}, "
        + ", ".join(f"{draw_sql(key, c, seed, n)} AS u_{c}" for c in columns)
        + f" FROM {real})"
    ]
    if big:
        ctes.append(f"{out}_i AS (SELECT row_number() OVER (ORDER BY {order}) - 1 AS idx, {', '.join(big)} FROM {real})")
    for c in small:
        if c in columns:
            ctes.append(
                f"{out}_f_{c} AS (SELECT {c} AS v, sum(count(*)) OVER (ORDER BY {c}::VARCHAR NULLS LAST) - count(*) AS lo, "
                f"sum(count(*)) OVER (ORDER BY {c}::VARCHAR NULLS LAST) AS hi FROM {real} GROUP BY {c})"
            )
    select, joins = [], []
    for c in columns:
        if c in small:
            select.append(f"f_{c}.v AS {c}")
            joins.append(f"LEFT JOIN {out}_f_{c} f_{c} ON d.u_{c} >= f_{c}.lo AND d.u_{c} < f_{c}.hi")
        else:
            select.append(f"i_{c}.{c}")
            joins.append(f"LEFT JOIN {out}_i i_{c} ON d.u_{c} = i_{c}.idx")
    extra = f"d.{key}" + ("" if key not in columns else " AS synth_key")
    ctes.append(f"{out} AS (SELECT {extra}, {', '.join(select)} FROM {out}_d d {' '.join(joins)})")
    return ", ".join(ctes)


LINE_SPLIT_SQL = (
    f"line AS ({LINE_SQL}), "
    f"train AS (SELECT * FROM line WHERE {bucket_sql('row_key')} >= 250), "
    f"held AS (SELECT * FROM line WHERE {bucket_sql('row_key')} < 250)"
)
LINE_COPIES_SQL = LINE_SPLIT_SQL + ", " + boot_sql("train", "row_key", LINE_ROLES.modelable, LINE_SMALL, 7, "boot")

#: copies usable in ``copies x columns`` generated SQL
LINE_COPY_NAMES = ("boot", "held")


# ---- orders / customer -----------------------------------------------------

ORDER_ROLES = ColumnRoles(numeric=["o_totalprice"], categorical=["o_orderstatus", "o_orderpriority"])


def orders_split(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return split_random(load(spark, sf_dir, "orders"), F.col("o_orderkey"))


ORDERS_SPLIT_SQL = (
    f"train AS (SELECT * FROM orders WHERE {bucket_sql('o_orderkey')} >= 250), "
    f"held AS (SELECT * FROM orders WHERE {bucket_sql('o_orderkey')} < 250)"
)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every double column so that both engines print the same digits."""
    doubles = {f.name for f in df.schema.fields if f.dataType.typeName() == "double"}
    return df.select(*[F.round(c, digits).alias(c) if c in doubles else F.col(c) for c in df.columns])
