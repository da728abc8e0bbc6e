"""Equi-joins whose hot and missing keys spread over tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TRACKED = 10_000  # keys a frequency sketch follows; its counts are off by less than rows / 7,500
_MOST = 500  # a key is heavy from this share of all rows on: so many keys at most


def heavy_keys(rows: DataFrame, keys: list[str]) -> list[int]:
    """Hashes of the keys that hold a ``1 / _MOST`` share of the rows or more.

    One pass with a frequency sketch per task: nothing is shuffled by key. Keys with
    NULL are not counted.
    """
    key = F.xxhash64(*keys)
    filled = rows.dropna(subset=keys).select(key.alias("k"))
    row = filled.agg(F.expr(f"approx_top_k(k, {_MOST}, {_TRACKED})").alias("top"), F.count(F.lit(1)).alias("n")).first()
    return [item["item"] for item in row["top"] or [] if item["count"] * _MOST >= row["n"]]


def spread_join(
    rows: DataFrame, table: DataFrame, keys: list[str], how: str = "left", heavy: list[int] | None = None
) -> DataFrame:
    """Join ``rows`` (left or inner) to ``table`` on equal ``keys``, whatever share of the rows one key holds.

    Rows of heavy keys are dealt out by their content to four salts per shuffle partition,
    and the table's rows of these few keys are repeated for every salt. Rows whose key
    has a NULL match nothing and are dealt out freely. ``heavy`` passes keys
    that are known already; all columns but the keys must differ.
    """
    if how not in ("left", "inner"):
        raise ValueError(how)
    heavy = heavy_keys(rows, keys) if heavy is None else heavy
    salts = 4 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    missing = F.lit(False)
    for k in keys:
        missing = missing | F.col(k).isNull()
    hot = F.xxhash64(*keys).isin(heavy) if heavy else F.lit(False)
    content = F.xxhash64(*[c for c in rows.columns if not _unhashable(rows, c)])
    dealt = rows.withColumn("__salt", F.when(missing, content).when(hot, F.pmod(content, F.lit(salts))).otherwise(F.lit(0).cast("long")))
    every = F.when(hot, F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))).otherwise(F.array(F.lit(0).cast("long")))
    copies = table.dropna(subset=keys).withColumn("__salt", F.explode(every))
    return dealt.join(copies, [*keys, "__salt"], how).drop("__salt")


def _unhashable(rows: DataFrame, column: str) -> bool:
    return "map<" in rows.schema[column].dataType.simpleString()
