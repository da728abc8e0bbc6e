"""Spark-native evaluation of synthetic tables: profile, prepare, generate, score, rank."""

from twinlens.model import ColumnRoles, Relationship, TableMeta, Tables

__all__ = ["ColumnRoles", "Relationship", "TableMeta", "Tables"]
