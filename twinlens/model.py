"""Small driver-side descriptions of tables; no row data ever lives here."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: A dataset is a mapping from table name to DataFrame.
Tables = dict[str, DataFrame]

INTEGER_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
NUMERIC_TYPES = INTEGER_TYPES + (T.FloatType, T.DoubleType, T.DecimalType)
DATE_TYPES = (T.DateType, T.TimestampType, T.TimestampNTZType)
SCALAR_TYPES = NUMERIC_TYPES + DATE_TYPES + (T.StringType, T.BooleanType)


@dataclass
class ColumnRoles:
    """Which columns a metric may model, and how."""

    numeric: list[str] = field(default_factory=list)
    categorical: list[str] = field(default_factory=list)
    skipped: list[str] = field(default_factory=list)

    @property
    def modelable(self) -> list[str]:
        return self.numeric + self.categorical

    def without(self, *columns: str) -> "ColumnRoles":
        return ColumnRoles(
            [c for c in self.numeric if c not in columns],
            [c for c in self.categorical if c not in columns],
            list(self.skipped),
        )


@dataclass(frozen=True)
class Relationship:
    """Single-column parent key -> child foreign key."""

    parent_table: str
    parent_key: str
    child_table: str
    child_key: str

    @property
    def label(self) -> str:
        return f"{self.child_table}.{self.child_key} → {self.parent_table}.{self.parent_key}"

    def as_record(self) -> dict[str, str]:
        return {
            "parent_table_name": self.parent_table,
            "parent_primary_key": self.parent_key,
            "child_table_name": self.child_table,
            "child_foreign_key": self.child_key,
        }

    @classmethod
    def from_record(cls, record: dict) -> "Relationship":
        return cls(
            record["parent_table_name"],
            record["parent_primary_key"],
            record["child_table_name"],
            record["child_foreign_key"],
        )


@dataclass
class TableMeta:
    """Semantic type per column plus the primary key, if any."""

    sdtypes: dict[str, str] = field(default_factory=dict)
    primary_key: str | None = None


def column_type(df: DataFrame, column: str) -> T.DataType:
    return df.schema[column].dataType


def is_integer(df: DataFrame, column: str) -> bool:
    return isinstance(column_type(df, column), INTEGER_TYPES)


def is_numeric(df: DataFrame, column: str) -> bool:
    return isinstance(column_type(df, column), NUMERIC_TYPES)


def is_date(df: DataFrame, column: str) -> bool:
    return isinstance(column_type(df, column), DATE_TYPES)


def is_string(df: DataFrame, column: str) -> bool:
    return isinstance(column_type(df, column), T.StringType)


def is_boolean(df: DataFrame, column: str) -> bool:
    return isinstance(column_type(df, column), T.BooleanType)


def scalar_columns(df: DataFrame) -> list[str]:
    """Columns of a scalar type; arrays, maps and structs pass through untouched."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, SCALAR_TYPES)]
