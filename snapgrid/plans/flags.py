"""Proximity flags of ranked nodes."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame

from snapgrid.operators.proximity import FLAG_RADIUS_M, near_flags
from snapgrid.plans.ranking import RANKING_COLUMNS


def flag_table(
    rankings: DataFrame, layers: Mapping[str, DataFrame], radius_m: float = FLAG_RADIUS_M
) -> DataFrame:
    """The ranking with one 0/1 column per layer, in the order of ``layers``."""
    flagged = near_flags(rankings, layers, "NODEID", radius_m)
    return flagged.select(*RANKING_COLUMNS, *layers)
