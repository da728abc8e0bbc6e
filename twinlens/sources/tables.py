"""Read named tables, write tables and reports."""

from __future__ import annotations

import os
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from twinlens.functions.values import finite_or_null
from twinlens.model import Tables, scalar_columns
from twinlens.operators.counting import text_counts
from twinlens.operators.roles import detect_sdtypes

# Spellings of a missing value in delimited text.
NA_WORDS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)
# Tried in this order; the first type every non-missing value of the column fits wins.
_INFERRED = ("bigint", "double", "boolean")


def table_name(path: str) -> str:
    return os.path.splitext(os.path.basename(path.rstrip("/")))[0].upper()


def _without_na_words(df: DataFrame) -> DataFrame:
    return df.select(*[F.when(~F.col(c).isin(*NA_WORDS), F.col(c)).alias(c) for c in df.columns])


def _boolean_word(text: Column) -> Column:
    return F.when(F.lower(text).isin("true", "false"), F.lower(text) == "true")


def _cast_text(column: str, kind: str) -> Column:
    return _boolean_word(F.col(column)) if kind == "boolean" else F.col(column).try_cast(kind)


def infer_types(df: DataFrame) -> dict[str, str]:
    """Type per text column over the whole file, in one aggregate pass.

    A column of integers with blanks stays ``bigint`` (NULL needs no float here);
    an all-missing column stays text.
    """
    fits = [
        F.struct(
            F.count(c).alias("filled"), *[F.count(_cast_text(c, kind)).alias(kind) for kind in _INFERRED]
        ).alias(c)
        for c in df.columns
    ]
    row = df.agg(*fits).first()
    found = {}
    for c in df.columns:
        full = [k for k in _INFERRED if row[c]["filled"] and row[c][k] == row[c]["filled"]]
        found[c] = full[0] if full else "string"
    return found


def read_csv_table(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Delimited text with a header; give ``schema`` to skip the inference pass.

    Quoted values may hold line breaks, so a file is one split: large tables come
    in many files, as :func:`write_table` makes them.
    """
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"')
    if schema is not None:
        return reader.schema(schema).csv(path)
    text = _without_na_words(reader.csv(path))
    kinds = infer_types(text)
    return text.select(
        *[F.col(c) if kinds[c] == "string" else _cast_text(c, kinds[c]).alias(c) for c in text.columns]
    )


def read_tables(
    spark: SparkSession, paths: list[str], schemas: dict[str, T.StructType] | None = None, views: bool = False
) -> Tables:
    """``{NAME: DataFrame}`` from CSV or Parquet paths; the name is the upper-cased basename."""
    tables: Tables = {}
    for path in paths:
        name = table_name(path)
        if path.rstrip("/").endswith(".parquet"):
            df = nan_to_null(spark.read.parquet(path))
        else:
            df = read_csv_table(spark, path, (schemas or {}).get(name))
        if views:
            df.createOrReplaceTempView(name)
        tables[name] = df
    return tables


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN is a missing value here, and only NULL counts, joins and compares as one."""
    floats = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.FloatType, T.DoubleType))}
    return df.select(*[F.nanvl(c, F.lit(None)).alias(c) if c in floats else F.col(c) for c in df.columns])


def write_table(df: DataFrame, path: str) -> None:
    """CSV with a header, one file per partition (never funnelled through one task)."""
    writer = df.write.mode("overwrite").option("header", True).option("escape", '"')
    writer.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def write_report(df: DataFrame, path: str, fmt: str = "csv") -> None:
    """Tidy metric rows (efficacy, leaderboard) as CSV or Parquet."""
    writer = df.write.mode("overwrite")
    writer.option("header", True).csv(path) if fmt == "csv" else writer.format(fmt).save(path)


def write_summary(summary: DataFrame, path: str) -> None:
    """JSON lines with NaN and infinities as null."""
    json_safe(summary).write.mode("overwrite").option("ignoreNullFields", False).json(path)


def json_safe(df: DataFrame) -> DataFrame:
    """Every double, also inside structs and arrays of structs, made finite or null."""
    return df.select(*[_finite(F.col(f.name), f.dataType).alias(f.name) for f in df.schema.fields])


def _finite(column: Column, kind: T.DataType) -> Column:
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return finite_or_null(column)
    if isinstance(kind, T.StructType):
        parts = [_finite(column[f.name], f.dataType).alias(f.name) for f in kind.fields]
        return F.when(column.isNotNull(), F.struct(*parts))
    if isinstance(kind, T.ArrayType):
        return F.transform(column, lambda item: _finite(item, kind.elementType))
    return column


def table_overview(df: DataFrame) -> DataFrame:
    """Per column: semantic type, distinct values, missing percent and an example.

    The example is the smallest first-40-characters of any value: rows have no
    order to take a first one from.
    """
    columns = scalar_columns(df)
    counts = text_counts(df, columns).groupBy("column").agg(
        F.sum("n").alias("rows"),
        F.count("value").alias("distinct"),
        F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).alias("missing"),
    )
    heads = df.agg(*[F.min(F.substring(F.col(c).cast("string"), 1, 40)).alias(c) for c in columns])
    examples = heads.unpivot([], columns, "column", "example")
    # one row per column on every side
    joined = detect_sdtypes(df).join(F.broadcast(counts), "column").join(F.broadcast(examples), "column")
    return joined.select(
        "column", "position", "sdtype", "rows", "distinct",
        F.round(100 * F.col("missing") / F.col("rows"), 1).alias("missing_pct"),
        F.coalesce("example", F.lit("")).alias("example"),
    )


def table_preview(df: DataFrame, order: list[str], rows: int = 5) -> DataFrame:
    """The first rows in an explicit order, as text."""
    return df.orderBy(*order).limit(rows).select(
        *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in df.columns]
    )


def stack_tables(frames: dict[str, DataFrame], label: str = "table") -> DataFrame:
    """Union of same-shaped results with the table name as a column."""
    return reduce(DataFrame.unionByName, [df.withColumn(label, F.lit(name)) for name, df in frames.items()])
