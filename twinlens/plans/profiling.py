"""Profile a whole dataset: columns, durable keys, links and a recommendation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinlens.model import Tables
from twinlens.operators import profile

_RECOMMENDATION = (
    "tier int, strategy string, reasons array<string>, warnings array<string>, "
    "relationships array<string>, sequence_specs map<string, map<string, string>>"
)


def profile_dataset(tables: Tables, min_overlap: float = 0.3, approximate: bool = False) -> dict[str, DataFrame]:
    """``columns``, ``durable_candidates``, ``links`` and ``recommendation`` frames.

    Structure only: no cell value leaves the cluster.  Each table is counted in
    one unpivoted job; what reaches the driver is one row per column or link.
    """
    spark = next(iter(tables.values())).sparkSession
    summaries, columns, durable = {}, [], []
    for name, df in tables.items():
        summary, frame, keys = profile.profile_table(df, name, approximate)
        summaries[name] = summary
        columns.append(frame.withColumn("table", F.lit(name)))
        durable.append(keys.withColumn("table", F.lit(name)))
    links = profile.find_links(tables, profile.key_columns(summaries), min_overlap).collect()
    advice = profile.recommend_strategy(summaries, links)
    row = (
        advice.tier, advice.strategy, advice.reasons, advice.warnings,
        [r.label for r in advice.relationships], advice.sequence_specs,
    )
    return {
        "columns": reduce(DataFrame.unionByName, columns),
        "durable_candidates": reduce(DataFrame.unionByName, durable),
        "links": spark.createDataFrame(links, profile.LINK_SCHEMA),
        "recommendation": spark.createDataFrame([row], _RECOMMENDATION),
    }
