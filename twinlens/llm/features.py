"""Labelled samples and held-out folds shared by the trained operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; NULL ids count as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, modulus: int = 5) -> DataFrame:
    """doc_id, text, y (0/1), weight: at most ``per_class`` training documents of either label.

    Chosen by a hash of the id; ``weight`` is the share of the class that each row stands
    for. Rows whose remainder is 0 (held out), NULL labels and unknown ids are left out;
    an id with both labels counts as 1.
    """
    known = labels.where(F.col(label).isin(0, 1) & (remainder(F.col("doc_id"), modulus) != 0))
    known = known.groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    total = known.groupBy("y").agg(F.count("*").alias("total"))
    picked = [known.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for y in (0, 1)]
    rows = picked[0].unionByName(picked[1]).join(F.broadcast(total), "y")  # at most two rows
    rows = rows.withColumn("weight", F.greatest(F.lit(1.0), F.col("total") / per_class))
    # at most 2 * per_class rows; a repeated document counts once
    found = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return found.join(F.broadcast(rows.drop("total")), "doc_id").dropDuplicates(["doc_id"])
