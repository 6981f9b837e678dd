"""Names and coordinates of street nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def node_streets(
    edges: DataFrame, ends: tuple[str, str] = ("NodeIDFrom", "NodeIDTo"), street: str = "Street",
    node: str = "NODEID",
) -> DataFrame:
    """Distinct (node, street) pairs over both ends of the edges; ends without a node are left out."""
    start, end = (edges.select(F.col(e).alias(node), F.col(street).alias("street")) for e in ends)
    return start.unionByName(end).where(F.col(node).isNotNull()).dropDuplicates()


def intersection_names(
    edges: DataFrame,
    ends: tuple[str, str] = ("NodeIDFrom", "NodeIDTo"),
    street: str = "Street",
    node: str = "NODEID",
    only: DataFrame | None = None,
) -> DataFrame:
    """Sorted distinct street names of each node, joined with " & ".

    ``only`` holds the nodes of interest and trims the edges before any shuffle.
    """
    pairs = node_streets(edges, ends, street, node)
    if only is not None:
        pairs = pairs.join(only.select(node), node, "left_semi")
    return pairs.groupBy(node).agg(
        F.array_join(F.array_sort(F.collect_list("street")), " & ").alias("intersection_name")
    )


def node_coordinates(
    nodes: DataFrame, node: str = "NODEID", lat: str = "latitude", lon: str = "longitude"
) -> DataFrame:
    """One coordinate pair per node: the smallest of those given."""
    return (
        nodes.select(node, lat, lon)
        .dropna(subset=[lat, lon])
        .groupBy(node)
        .agg(F.min(F.struct(lat, lon)).alias("_at"))
        .select(node, F.col(f"_at.{lat}").alias(lat), F.col(f"_at.{lon}").alias(lon))
    )
