"""Ranking of street nodes by crash severity."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snapgrid.functions.geo import FOOT_M
from snapgrid.operators import spatial_index
from snapgrid.operators.names import intersection_names, node_coordinates
from snapgrid.operators.nearest import join_back, nearest_within, places, snap
from snapgrid.operators.severity import (
    TIE_DIGITS,
    TOP_N,
    merge_summaries,
    min_max_scale,
    score_rows,
    summarise,
    top_n,
)
from snapgrid.operators.targets import point_targets
from snapgrid.session import stage_table

# Fixed value: a crash belongs to a node at most 50 feet away.
SNAP_RADIUS_M = 50 * FOOT_M

# The columns of the ranking, in this order.
RANKING_COLUMNS = [
    "NODEID",
    "crash_count",
    "total_killed",
    "total_injured",
    "severity_score",
    "severity_score_norm",
    "intersection_name",
    "latitude",
    "longitude",
]


def place_nodes(
    crashes: DataFrame, nodes: DataFrame, radius_m: float = SNAP_RADIUS_M, index: spatial_index.SpatialIndex | None = None, **options
) -> DataFrame:
    """``lat, lon, NODEID, dist`` of every crash coordinate at a node, written once.

    Hand it as ``near`` to the ranking and to the node map: the search is the dear part of both.
    With a stored ``index`` of the nodes they are neither measured nor repeated.
    """
    if index is not None:
        spots = stage_table(places(crashes, "latitude", "longitude"), "crash_places")
        return stage_table(spatial_index.nearest_within(index, spots, radius_m, **options), "place_nodes")
    targets = point_targets(nodes, "latitude", "longitude", "NODEID")
    near = nearest_within(places(crashes, "latitude", "longitude"), targets, "NODEID", radius_m, **options)
    return stage_table(near, "place_nodes")


def crash_to_node_map(
    crashes: DataFrame,
    nodes: DataFrame,
    radius_m: float = SNAP_RADIUS_M,
    near: DataFrame | None = None,
    **options,
) -> DataFrame:
    """``collision_id, NODEID, snap_dist`` of the crashes that lie at a node."""
    kept = crashes.select("collision_id", "latitude", "longitude")
    if near is None:
        targets = point_targets(nodes, "latitude", "longitude", "NODEID")
        mapped = snap(kept, targets, radius_m, **options)
    else:
        mapped = join_back(kept, near, "latitude", "longitude", "snap_dist", "inner")
    return mapped.select("collision_id", "NODEID", "snap_dist")


def node_summary(
    crashes: DataFrame,
    nodes: DataFrame,
    as_of: date | datetime | str,
    radius_m: float = SNAP_RADIUS_M,
    near: DataFrame | None = None,
    **options,
) -> DataFrame:
    """Crash count, casualties and severity of every node with a crash.

    The sums are taken per coordinate before the search, so crash rows are
    combined on the map side and only distinct coordinates are matched to nodes.
    """
    by_place = summarise(
        score_rows(crashes, as_of).dropna(subset=["latitude", "longitude"]), "latitude", "longitude"
    ).withColumnsRenamed({"latitude": "lat", "longitude": "lon"})
    if near is not None:
        return merge_summaries(by_place.join(near, ["lat", "lon"]), "NODEID")
    targets = point_targets(nodes, "latitude", "longitude", "NODEID")
    return merge_summaries(nearest_within(by_place, targets, "NODEID", radius_m, **options), "NODEID")


def rank_nodes(
    crashes: DataFrame,
    nodes: DataFrame,
    as_of: date | datetime | str,
    radius_m: float = SNAP_RADIUS_M,
    n: int = TOP_N,
    **options,
) -> DataFrame:
    """The ``n`` most severe nodes, scaled against all nodes with a crash."""
    summary = stage_table(node_summary(crashes, nodes, as_of, radius_m, **options), "node_summary")
    scaled = min_max_scale(summary, "severity_score", "severity_score_norm")
    return top_n(scaled, "severity_score", "NODEID", n=n)


def name_and_place(ranked: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Complete a ranking with intersection names and coordinates."""
    named = intersection_names(edges, only=ranked)
    placed = node_coordinates(nodes.join(ranked.select("NODEID"), "NODEID", "left_semi"))
    return (
        ranked.join(named, "NODEID", "left")
        .join(placed, "NODEID", "left")
        .select(*RANKING_COLUMNS)
        .orderBy(F.round("severity_score", TIE_DIGITS).desc(), "NODEID")
    )


def intersection_rankings(
    crashes: DataFrame,
    nodes: DataFrame,
    edges: DataFrame,
    as_of: date | datetime | str,
    radius_m: float = SNAP_RADIUS_M,
    n: int = TOP_N,
    **options,
) -> DataFrame:
    """Ranking with names and coordinates, in the order of its nine columns."""
    ranked = stage_table(rank_nodes(crashes, nodes, as_of, radius_m, n, **options), "ranked_nodes")
    return name_and_place(ranked, nodes, edges)
