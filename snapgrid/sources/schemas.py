"""Schemas of the landed inputs. Text columns are coerced by the cleaning step."""

from __future__ import annotations

from snapgrid.functions.text import FLAG_PHRASES

CRASH_PAGE = """
collision_id string, crash_date string, crash_time string, latitude string, longitude string,
number_of_persons_injured string, number_of_persons_killed string,
number_of_pedestrians_injured string, number_of_pedestrians_killed string,
number_of_cyclist_injured string, number_of_cyclist_killed string,
number_of_motorist_injured string, number_of_motorist_killed string,
contributing_factor_vehicle_1 string
"""

# The coordinates of a geometry are kept as JSON text, because one layer may mix
# points, multipoints and lines; each kind is parsed with its own depth.
GEOMETRY_PAGE = "the_geom struct<type: string, coordinates: string>"
RATED_GEOMETRY_PAGE = f"{GEOMETRY_PAGE}, systemrating string"
LAT_LONG_PAGE = "lat string, long string"
FROM_TO_PAGE = "fromlatitude string, fromlongitude string, tolatitude string, tolongitude string"

NODES = "NODEID bigint, latitude double, longitude double"
STREET_EDGES = "NodeIDFrom bigint, NodeIDTo bigint, Street string"
CENTERLINES = "physicalid bigint, stname_lab string, coordinates array<array<double>>"
CRASH_TO_NODE = "collision_id bigint, NODEID bigint, snap_dist double"
RANKINGS = """
NODEID bigint, crash_count bigint, total_killed double, total_injured double,
severity_score double, severity_score_norm double, intersection_name string,
latitude double, longitude double
"""
FLAGS = ", ".join(f"{flag} int" for flag in FLAG_PHRASES)
FLAGGED = f"{RANKINGS}, {FLAGS}"
PREDICTIONS = """
NODEID bigint, predicted_cause string, actual_cause string, ranked_node bigint,
intersection_name string
"""
CORPUS = "`Doc ID` bigint, Title string, Keywords string"
TRUTH = "predicted_cause string, title string"
MASTER = f"{RANKINGS}, predicted_cause string, Top_Intervention string"
