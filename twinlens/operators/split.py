"""Train / holdout splits that are stable across runs and layouts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinlens.functions.hashing import hash_bucket
from twinlens.model import Relationship, Tables
from twinlens.operators.skew import spread_join

HOLDOUT = "__holdout"


def in_holdout(key: Column, fraction: float = 0.25, seed: int = 42) -> Column:
    """Pure function of the key, so parents and children agree without a join."""
    return hash_bucket(key, seed) < int(round(1000 * fraction))


def split_random(
    df: DataFrame, key: Column, fraction: float = 0.25, seed: int = 42
) -> tuple[DataFrame, DataFrame]:
    """``(train, holdout)`` by a digest of the row key; no shuffle, sizes approximate."""
    held = in_holdout(key, fraction, seed)
    return df.where(~held), df.where(held)


def parents_first(names: list[str], parent_of: dict[str, Relationship]) -> list[str]:
    """Tables in an order where every resolvable parent precedes its child."""
    ordered: list[str] = [n for n in names if n not in parent_of]
    pending = [n for n in names if n in parent_of]
    while ready := [n for n in pending if parent_of[n].parent_table in ordered]:
        ordered += ready
        pending = [n for n in pending if n not in ready]
    return ordered + pending


def mark_relational(
    tables: Tables,
    relationships: list[Relationship],
    row_keys: dict[str, Column],
    fraction: float = 0.25,
    seed: int = 42,
) -> Tables:
    """Add a boolean ``__holdout`` column; child rows follow their parent row.

    Orphans, NULL foreign keys and tables on a cycle fall back to the split of
    their own row key.  With several parents the last relationship wins.  A root
    parent's side is a function of its key, so only its keys (two narrow
    columns) travel to the child, never its rows. Children of one parent, and
    those without any, are spread over tasks.
    """
    parent_of = {r.child_table: r for r in relationships}
    marked: Tables = {}
    for name in parents_first(list(tables), parent_of):
        df = tables[name]
        own = in_holdout(row_keys[name], fraction, seed)
        link = parent_of.get(name)
        if link is None or link.parent_table not in marked:
            marked[name] = df.withColumn(HOLDOUT, own)
            continue
        parent = marked[link.parent_table]
        # a parent value on both sides counts as train, as it is looked up there first
        sides = (
            parent.where(F.col(link.parent_key).isNotNull())
            .groupBy(F.col(link.parent_key).alias("__parent_key"))
            .agg(F.min(HOLDOUT).alias("__parent_side"))
        )
        keyed = df.withColumns({"__parent_key": F.col(link.child_key), "__own_side": own})
        marked[name] = (
            spread_join(keyed, sides, ["__parent_key"])
            .withColumn(HOLDOUT, F.coalesce("__parent_side", "__own_side"))
            .drop("__parent_key", "__parent_side", "__own_side")
        )
    return {name: marked[name] for name in tables}


def split_relational(
    tables: Tables,
    relationships: list[Relationship],
    row_keys: dict[str, Column],
    fraction: float = 0.25,
    seed: int = 42,
) -> tuple[Tables, Tables]:
    """``(train, holdout)`` databases with children on their parent's side."""
    marked = mark_relational(tables, relationships, row_keys, fraction, seed)
    train = {t: df.where(~F.col(HOLDOUT)).drop(HOLDOUT) for t, df in marked.items()}
    hold = {t: df.where(HOLDOUT).drop(HOLDOUT) for t, df in marked.items()}
    return train, hold
