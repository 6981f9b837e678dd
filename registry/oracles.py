"""The registered queries in SQL, by brute force where Spark uses a grid."""

from __future__ import annotations

from registry import views as v
from snapgrid.functions.text import CAUSE_PHRASE, FLAG_PHRASES
from snapgrid.operators.features import FEATURES

HALF = 0.0000005
BASE = f"crash AS ({v.CRASH_SQL}), node AS ({v.NODE_SQL}), edge AS ({v.EDGE_SQL})"

SNAP = f"""
pair AS (
  SELECT c.*, n.nodeid, round({v.haversine_sql('c.latitude', 'c.longitude', 'n.latitude', 'n.longitude')}, 6) AS dist
  FROM crash c JOIN node n
    ON {v.haversine_sql('c.latitude', 'c.longitude', 'n.latitude', 'n.longitude')} <= {v.SNAP_M} + {HALF}
),
snapped AS (
  SELECT * FROM (SELECT *, rank() OVER (PARTITION BY collision_id ORDER BY dist) AS rk FROM pair) WHERE rk = 1
)"""

AGE = f"date_diff('day', crash_date::date, DATE '{v.AS_OF}') / 365.25::double"
BASE_SEVERITY = "10 * coalesce(number_of_persons_killed, 0) + 3 * coalesce(number_of_persons_injured, 0) + 1"

RANKED = f"""{SNAP},
summary AS (
  SELECT nodeid, count(*) AS crash_count,
    coalesce(sum(number_of_persons_killed), 0) AS total_killed,
    coalesce(sum(number_of_persons_injured), 0) AS total_injured,
    coalesce(sum(({BASE_SEVERITY}) * exp(-0.3 * ({AGE}))), 0) AS severity_score
  FROM snapped GROUP BY nodeid
),
scaled AS (
  SELECT *, (severity_score - min(severity_score) OVER ())
    / nullif(max(severity_score) OVER () - min(severity_score) OVER (), 0) AS severity_score_norm
  FROM summary
),
ranked AS (SELECT * FROM scaled ORDER BY round(severity_score, 9) DESC, nodeid LIMIT 500)"""

NAMED = """
named AS (
  SELECT nodeid, string_agg(street, ' & ' ORDER BY street) AS intersection_name
  FROM (SELECT DISTINCT node_from AS nodeid, street FROM edge UNION SELECT DISTINCT node_to, street FROM edge)
  GROUP BY nodeid
)"""

SCORES = "round(severity_score, 4) AS severity_score"


def describe(source: str, column: str) -> str:
    return f"""SELECT count({column}) AS n, round(avg({column}), 4) AS mean, round(stddev_samp({column}), 4) AS std,
      round(min({column})::double, 4) AS min, round(quantile_cont({column}::double, 0.25), 4) AS p25,
      round(quantile_cont({column}::double, 0.5), 4) AS p50, round(quantile_cont({column}::double, 0.75), 4) AS p75,
      round(max({column})::double, 4) AS max FROM {source}"""


def near(flag: str, layer: str, distance: str, radius: float) -> str:
    return f"""WITH {BASE}, layer AS ({layer}),
    hit AS (SELECT DISTINCT n.nodeid FROM node n JOIN layer s ON {distance} < {radius})
    SELECT node.nodeid, (hit.nodeid IS NOT NULL)::int AS {flag} FROM node LEFT JOIN hit USING (nodeid)"""


TO_POINT = v.haversine_sql("n.latitude", "n.longitude", "s.lat", "s.lon")
TO_SEGMENT = v.segment_sql("n.latitude", "n.longitude")

ROW_FLAGS = """
feat AS (
  SELECT *, extract(hour FROM crash_date)::int AS hour, extract(month FROM crash_date)::int AS month,
    extract(year FROM crash_date)::int AS year, (isodow(crash_date) - 1)::int AS dayofweek,
    (extract(hour FROM crash_date) >= 20 OR extract(hour FROM crash_date) <= 5)::int AS is_night,
    (extract(hour FROM crash_date) IN (7, 8, 9, 16, 17, 18))::int AS is_rush_hour,
    (isodow(crash_date) >= 6)::int AS is_weekend,
    (number_of_pedestrians_injured > 0)::int AS is_pedestrian_injury,
    (number_of_pedestrians_killed > 0)::int AS is_pedestrian_death,
    (number_of_cyclist_injured > 0)::int AS is_bike_injury,
    (number_of_cyclist_killed > 0)::int AS is_bike_death,
    (number_of_motorist_injured > 0)::int AS is_motorist_injury,
    (number_of_persons_killed > 0)::int AS is_fatal,
    (number_of_persons_killed > 0 OR number_of_persons_injured >= 2)::int AS is_severe
  FROM {source}
)"""


def node_features(source: str, key: str, digits: int = 4) -> str:
    names = ", ".join(f"round({c}::double, {digits}) AS {c}" for c in FEATURES)
    return f"""SELECT {key}, {names} FROM (
      SELECT *, night_crash_count / (total_crashes + 1e-6::double) AS night_ratio,
        rush_crash_count / (total_crashes + 1e-6::double) AS rush_ratio,
        weekend_crash_count / (total_crashes + 1e-6::double) AS weekend_ratio,
        ped_injury_count / (total_injured + 1e-6::double) AS ped_proportion,
        bike_injury_count / (total_injured + 1e-6::double) AS bike_proportion,
        fatal_crash_count / (total_crashes + 1e-6::double) AS severe_ratio,
        (ped_injury_count > 0)::int AS has_ped_crashes, (bike_injury_count > 0)::int AS has_bike_crashes,
        (night_crash_count > 0)::int AS has_night_crashes, (fatal_crash_count > 0)::int AS has_fatal_crashes
      FROM (SELECT {key}, count(collision_id) AS total_crashes,
        coalesce(sum(number_of_persons_injured), 0) AS total_injured,
        coalesce(sum(number_of_persons_killed), 0) AS total_killed,
        sum(is_pedestrian_injury) AS ped_injury_count, sum(is_pedestrian_death) AS ped_death_count,
        sum(is_bike_injury) AS bike_injury_count, sum(is_bike_death) AS bike_death_count,
        sum(is_night) AS night_crash_count, sum(is_rush_hour) AS rush_crash_count,
        sum(is_weekend) AS weekend_crash_count, sum(is_fatal) AS fatal_crash_count,
        avg(number_of_persons_injured) AS avg_injured
        FROM {source} GROUP BY {key}))"""


def primary(source: str, key: str, label: str, out: str) -> str:
    return f"""SELECT {key}, {label} AS {out} FROM (
      SELECT {key}, {label}, row_number() OVER (PARTITION BY {key} ORDER BY count(*) DESC, {label}) AS rk
      FROM {source} GROUP BY {key}, {label}) WHERE rk = 1"""


LABELLED = """
specified AS (SELECT *, contributing_factor_vehicle_1 AS cause FROM {source}
  WHERE contributing_factor_vehicle_1 <> 'error'),
top AS (SELECT cause FROM specified GROUP BY cause ORDER BY count(*) DESC, cause LIMIT 3),
labelled AS (SELECT *, CASE WHEN cause IN (SELECT cause FROM top) THEN cause ELSE 'Other' END AS cause_label
  FROM specified WHERE cause NOT IN ('error', 'signup'))"""

DIRTY = """
dirty AS (
  SELECT CASE WHEN event_id % 37 <> 0 THEN event_id END AS collision_id,
    CASE WHEN event_id % 19 = 0 THEN NULL WHEN event_id % 31 = 0 THEN strftime(ts, '%Y-%m-%d 00:00:00')
      WHEN event_id % 17 = 1 THEN strftime(ts, '%Y-%m-%d %H:%M:00') ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS crash_date,
    CASE WHEN event_id % 11 = 0 THEN NULL WHEN event_id % 13 = 0 THEN 0
      WHEN event_id % 23 = 0 OR event_id % 29 = 0 THEN NULL ELSE printf('%.5f', 40.3::double + (event_id * 104729 % 80000) / 100000.0::double)::double END AS latitude,
    CASE WHEN event_id % 17 = 0 THEN NULL
      ELSE printf('%.5f', -74.4::double + (event_id * 15485863 % 90000) / 100000.0::double)::double END AS longitude,
    CASE WHEN event_id % 7 = 0 THEN NULL ELSE json_extract_string(props, '$.k')::double END AS number_of_persons_injured,
    0.0::double AS number_of_persons_killed
  FROM events
)"""
CLEAN = f"""WITH {DIRTY} SELECT * FROM dirty
WHERE latitude IS NOT NULL AND longitude IS NOT NULL AND latitude <> 0 AND longitude <> 0
  AND latitude BETWEEN 40.4 AND 41.0 AND longitude BETWEEN -74.3 AND -73.6"""

NEIGHBOURS = """
scored AS (
  SELECT q.vec_id, q.label, d.vec_id AS doc_id, d.label AS doc_label,
    round(list_cosine_similarity(q.embedding::double[], d.embedding::double[]), 9) AS sim
  FROM embeddings q CROSS JOIN embeddings d
),
near AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY sim DESC, doc_id) AS rank FROM scored)
  WHERE rank <= 5
)"""


def tf_idf(queries: str, query_id: str, corpus: str, doc_id: str, k: int) -> str:
    """CTEs ending in ``best``: every query with every document, zero overlap included."""
    words = r"unnest(list_filter(regexp_split_to_array(lower({t}), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> ''))"
    return f"""
q_words AS (SELECT {query_id}, {words.format(t='text')} AS term FROM {queries}),
d_words AS (SELECT {doc_id}, {words.format(t='text')} AS term FROM {corpus}),
q_tf AS (SELECT {query_id}, term, count(*) AS tf FROM q_words GROUP BY ALL),
d_tf AS (SELECT {doc_id}, term, count(*) AS tf FROM d_words GROUP BY ALL),
freq AS (SELECT term, count(*) AS in_docs FROM d_tf GROUP BY term),
size AS (SELECT count(*) AS n FROM {corpus}),
q_w AS (SELECT {query_id}, term, tf * ln((n + 1)::double / (coalesce(in_docs, 0) + 1)) AS w
  FROM q_tf LEFT JOIN freq USING (term) CROSS JOIN size),
d_w AS (SELECT {doc_id}, term, tf * ln((n + 1)::double / (in_docs + 1)) AS w
  FROM d_tf JOIN freq USING (term) CROSS JOIN size),
q_norm AS (SELECT {query_id}, sqrt(sum(w * w)) AS norm FROM q_w GROUP BY ALL),
d_norm AS (SELECT {doc_id}, sqrt(sum(w * w)) AS norm FROM d_w GROUP BY ALL),
dots AS (SELECT {query_id}, {doc_id}, sum(q_w.w * d_w.w) AS dot FROM q_w JOIN d_w USING (term) GROUP BY ALL),
sims AS (
  SELECT q.{query_id}, d.{doc_id},
    round(coalesce(dot / nullif(q_norm.norm * d_norm.norm, 0), 0), 9) AS sim
  FROM (SELECT DISTINCT {query_id} FROM {queries}) q CROSS JOIN {corpus} d
  LEFT JOIN dots ON dots.{query_id} = q.{query_id} AND dots.{doc_id} = d.{doc_id}
  LEFT JOIN q_norm ON q_norm.{query_id} = q.{query_id} LEFT JOIN d_norm ON d_norm.{doc_id} = d.{doc_id}
),
best AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {query_id} ORDER BY sim DESC, {doc_id}) AS rank FROM sims)
  WHERE rank <= {k}
)"""


MASTER = f"""{BASE}, {RANKED}, {NAMED},
cause AS ({primary('snapped', 'nodeid', 'contributing_factor_vehicle_1', 'predicted_cause')}),
master AS (
  SELECT ranked.*, intersection_name, node.latitude, node.longitude, predicted_cause,
    'Treat ' || predicted_cause AS "Top_Intervention"
  FROM ranked LEFT JOIN named USING (nodeid) LEFT JOIN node USING (nodeid) LEFT JOIN cause USING (nodeid)
)"""

_BITS = list(enumerate(FLAG_PHRASES.items()))


def flag_sentence(cause: str) -> str:
    code = "(p_size + 64 * p_partkey)"
    parts = ", ".join(f"CASE WHEN ({code} >> {i}) & 1 = 1 THEN '{phrase}' END" for i, (_, phrase) in _BITS)
    return f"concat_ws(', ', {parts}, '{CAUSE_PHRASE}' || {cause})"


DOTS = f"SELECT lat, lon FROM ({v.POINT_LAYER_SQL})"
MANY_DOTS = f"{DOTS} UNION ALL SELECT lat, lon FROM ({v.MULTIPOINT_LAYER_SQL}) WHERE s_suppkey % 2 = 1"
FLAG_LAYERS = {
    **{f: (DOTS, TO_POINT) for f in (
        "Has_Enhanced_Crossing", "Has_Leading_Pedestrian_Signal", "Has_Turn_Traffic_Calming", "Has_SIP",
        "Has_Exclusive_Pedestrian_Signal", "Has_Accessible_Pedestrian_Signal", "Has_Pedestrian_Ramp",
    )},
    "Is_Protected_Intersection": (MANY_DOTS, TO_POINT),
    **{f: (v.LINE_LAYER_SQL, TO_SEGMENT) for f in ("Has_Bus_Lane", "Has_Speed_Hump", "Is_Bike_Route")},
    "Is_Speed_Reduced": (v.SEGMENT_LAYER_SQL, TO_SEGMENT),
    "Has_Bad_Pavement": (f"SELECT * FROM ({v.SEGMENT_LAYER_SQL}) WHERE systemrating < 3.5", TO_SEGMENT),
}


def flag_query() -> str:
    hits = ", ".join(
        f"""{flag} AS (SELECT DISTINCT n.nodeid FROM placed n JOIN ({layer}) s ON {distance} < {v.SNAP_M})"""
        for flag, (layer, distance) in FLAG_LAYERS.items()
    )
    columns = ", ".join(
        f"(placed.nodeid IN (SELECT nodeid FROM {flag}))::int AS {flag}" for flag in FLAG_LAYERS
    )
    return f"""WITH {BASE}, {RANKED},
    placed AS (SELECT nodeid, latitude, longitude FROM ranked JOIN node USING (nodeid)), {hits}
    SELECT nodeid, {columns} FROM placed"""


CRASH_STREETS = f"""WITH {BASE}, layer AS ({v.LINE_LAYER_SQL}),
pair AS (SELECT n.collision_id, s.stname_lab,
  round(min({TO_SEGMENT}), 6) AS dist FROM crash n CROSS JOIN layer s GROUP BY ALL),
best AS (SELECT * FROM (SELECT *, rank() OVER (PARTITION BY collision_id ORDER BY dist) AS rk FROM pair) WHERE rk = 1)"""

TRAINED = f"""WITH {BASE}, {SNAP}, {ROW_FLAGS.format(source='snapped')}, {LABELLED.format(source='feat')},
made AS ({node_features('labelled', 'nodeid', 12)}),
chosen AS ({primary('labelled', 'nodeid', 'cause_label', 'primary_cause')}),
trained AS (SELECT * FROM made JOIN chosen USING (nodeid))"""
SCALED = ", ".join(
    f"round(coalesce((coalesce({c}, 0) - avg(coalesce({c}, 0)) OVER ()) / nullif(stddev_pop(coalesce({c}, 0)) OVER (), 0), 0), 3) AS {c}"
    for c in FEATURES
)

ORACLES: dict[str, str] = {
    "q_hotspot_rank": f"""WITH {BASE}, {RANKED} SELECT nodeid, crash_count, total_killed, total_injured,
      {SCORES}, round(severity_score_norm, 4) AS severity_score_norm FROM ranked""",
    "q_intersection_rankings": f"""WITH {BASE}, {RANKED}, {NAMED} SELECT nodeid, crash_count, total_killed,
      total_injured, {SCORES}, round(severity_score_norm, 4) AS severity_score_norm, intersection_name,
      latitude, longitude
      FROM ranked LEFT JOIN named USING (nodeid) LEFT JOIN node USING (nodeid)""",
    "q_snap_map": f"WITH {BASE}, {SNAP} SELECT collision_id, nodeid, round(dist, 4) AS snap_dist FROM snapped",
    "q_snap_indexed": f"WITH {BASE}, {SNAP} SELECT collision_id, nodeid, round(dist, 4) AS snap_dist FROM snapped",
    "q_snap_summary": f"WITH {BASE}, {SNAP} {describe('snapped', 'dist')}",
    "q_node_counts": f"WITH {BASE}, {SNAP} SELECT nodeid, count(*) AS n FROM snapped GROUP BY nodeid",
    "q_node_count_summary": f"""WITH {BASE}, {SNAP},
      counted AS (SELECT nodeid, count(*) AS c FROM snapped GROUP BY nodeid) {describe('counted', 'c')}""",
    "q_year_counts": f"""WITH {BASE} SELECT extract(year FROM crash_date)::int AS year, count(*) AS n
      FROM crash WHERE user_id = 8 AND crash_date IS NOT NULL GROUP BY 1""",
    "q_severity_rows": f"""WITH {BASE} SELECT collision_id, round({AGE}, 4) AS age_years,
      round(exp(-0.3 * ({AGE})), 4) AS recency_weight, round({BASE_SEVERITY}, 4) AS base_severity,
      round(({BASE_SEVERITY}) * exp(-0.3 * ({AGE})), 4) AS weighted_score FROM crash""",
    "q_street_names": f"WITH {BASE}, {NAMED} SELECT nodeid, intersection_name FROM named",
    "q_node_coords": f"""WITH {BASE} SELECT p_size, s.latitude, s.longitude
      FROM (SELECT p_size, min(struct_pack(latitude := latitude, longitude := longitude)) AS s
        FROM node JOIN part ON p_partkey = nodeid GROUP BY p_size)""",
    "q_nearest_uncapped": f"""WITH {BASE}, layer AS ({v.SEGMENT_LAYER_SQL}),
      pair AS (SELECT n.nodeid, s.segment_id, round({TO_SEGMENT}, 6) AS dist FROM node n CROSS JOIN layer s)
      SELECT nodeid, segment_id, round(dist, 3) AS distance
      FROM (SELECT *, rank() OVER (PARTITION BY nodeid ORDER BY dist) AS rk FROM pair) WHERE rk = 1""",
    "q_nearest_street": f"{CRASH_STREETS} SELECT collision_id, stname_lab, round(dist, 3) AS distance FROM best",
    "q_street_counts": f"""{CRASH_STREETS} SELECT stname_lab, count(*) AS n FROM best GROUP BY stname_lab
      ORDER BY n DESC, stname_lab LIMIT 10""",
    "q_dedup_join_back": """SELECT event_id, user_id, event_type, n_types FROM events JOIN
      (SELECT user_id, count(DISTINCT event_type) AS n_types FROM events GROUP BY user_id) USING (user_id)""",
    "q_near_point": near("near_point", v.POINT_LAYER_SQL, TO_POINT, v.POINT_M),
    "q_near_multipoint": near("near_multipoint", v.MULTIPOINT_LAYER_SQL, TO_POINT, v.POINT_M),
    "q_near_line": near("near_line", v.LINE_LAYER_SQL, TO_SEGMENT, v.SNAP_M),
    "q_near_segment": near("near_segment", v.SEGMENT_LAYER_SQL, TO_SEGMENT, v.LINE_M),
    "q_near_segment_indexed": near("near_segment", v.SEGMENT_LAYER_SQL, TO_SEGMENT, v.LINE_M),
    "q_near_line_rated": near(
        "near_line_rated", f"SELECT * FROM ({v.SEGMENT_LAYER_SQL}) WHERE systemrating < 3.5", TO_SEGMENT, v.LINE_M
    ),
    "q_flags": flag_query(),
    "q_clean_rows": CLEAN,
    "q_clean_report": f"""WITH {DIRTY},
      told AS (SELECT d.*, CASE WHEN latitude IS NULL THEN 'latitude not a number' WHEN longitude IS NULL THEN 'longitude missing'
        WHEN latitude = 0 OR longitude = 0 THEN 'zero coordinates'
        WHEN NOT (latitude BETWEEN 40.4 AND 41.0 AND longitude BETWEEN -74.3 AND -73.6) THEN 'outside the box' ELSE 'kept' END AS outcome
        FROM dirty d)
      SELECT unnest(['rows', 'kept', 'latitude missing', 'latitude not a number', 'longitude missing', 'longitude not a number',
          'zero coordinates', 'outside the box', 'key not a whole number', 'date missing', 'date not readable',
          'number_of_persons_injured not a number', 'number_of_persons_killed not a number', 'kept with a warning']) AS metric,
        unnest([count(*), count(*) FILTER (outcome = 'kept'), 0, count(*) FILTER (outcome = 'latitude not a number'),
          count(*) FILTER (outcome = 'longitude missing'), 0, count(*) FILTER (outcome = 'zero coordinates'),
          count(*) FILTER (outcome = 'outside the box'), count(*) FILTER (collision_id IS NULL), 0, count(*) FILTER (crash_date IS NULL),
          count(*) FILTER (number_of_persons_injured IS NULL), 0,
          count(*) FILTER (outcome = 'kept' AND (collision_id IS NULL OR crash_date IS NULL OR number_of_persons_injured IS NULL))]) AS n
      FROM told""",
    "q_quantiles_by_month": """SELECT o_orderpriority, strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n,
      round(min(o_totalprice), 4) AS low, round(max(o_totalprice), 4) AS high, true AS p50_within, true AS p90_within
      FROM orders GROUP BY 1, 2""",
    "q_distinct_nodes": """WITH users AS (SELECT DISTINCT event_type, date_trunc('week', ts)::date AS w, user_id FROM events)
      SELECT u.event_type, u.w::varchar AS week, count(*) AS n_users, count(b.user_id) AS n_again, true AS users_within, true AS again_within
      FROM users u LEFT JOIN users b ON b.event_type = u.event_type AND b.user_id = u.user_id AND b.w = u.w - 7 GROUP BY u.event_type, u.w""",
    "q_csv_round_trip": CLEAN,
    "q_stream_ingest": CLEAN,
    "q_layer_variant": f"""WITH spot AS (SELECT s_suppkey AS id, s_suppkey % 6 AS k, lat, lon FROM ({v.POINT_LAYER_SQL})),
      flags(flag, takes) AS (VALUES ('Has_Pedestrian_Ramp', [0]), ('Is_Protected_Intersection', [0, 5]), ('Has_Bus_Lane', [1, 2])),
      ways(k, flag2, n) AS (VALUES (0, 'dot', 1), (5, 'dot', 1), (5, 'dot', 2), (1, 'leg', 1), (2, 'leg', 1), (2, 'leg', 2))
      SELECT flag, id, 'target' AS outcome, round(CASE WHEN n = 1 THEN lat ELSE lat + 0.01 END, 5) AS a_lat,
        round(CASE WHEN n = 1 THEN lon ELSE lon + 0.01 END, 5) AS a_lon,
        CASE WHEN flag2 = 'leg' THEN round(CASE WHEN n = 1 THEN lat + 0.01 ELSE lat END, 5) END AS b_lat,
        CASE WHEN flag2 = 'leg' THEN round(CASE WHEN n = 1 THEN lon + 0.01 ELSE lon END, 5) END AS b_lon
      FROM spot JOIN flags ON list_contains(takes, k) JOIN ways USING (k)
      UNION ALL SELECT flag, CASE WHEN k <> 3 THEN id END,
        CASE k WHEN 3 THEN 'not json' WHEN 4 THEN 'no geometry' ELSE 'wrong kind of geometry' END, NULL, NULL, NULL, NULL
      FROM spot JOIN flags ON NOT list_contains(takes, k)""",
    "q_stream_dedup": CLEAN,
    "q_stream_rank": f"""WITH {BASE}, {RANKED} SELECT nodeid, crash_count, total_killed, total_injured,
      {SCORES}, round(severity_score_norm, 4) AS severity_score_norm FROM ranked""",
    "q_csv_typed": """SELECT o_orderkey, o_custkey, o_orderpriority, round(o_totalprice, 4) AS o_totalprice FROM orders""",
    "q_layer_read": f"""WITH {BASE} SELECT nodeid, latitude, longitude, node_to, street
      FROM node JOIN edge ON node_from = nodeid""",
    "q_corpus_text": """SELECT doc_id, trim(source) AS title,
      CASE WHEN doc_id % 7 <> 0 THEN trim(source) || ': ' || trim(lang) END AS text FROM documents""",
    "q_duplicate_headers": "SELECT event_id, round(value, 4) AS value FROM events",
    "q_cached_table": f"""WITH {BASE} SELECT collision_id, latitude, longitude FROM crash""",
    "q_union_pages": """SELECT event_id, user_id, CASE WHEN event_type = 'click' THEN value END AS value
      FROM events""",
    "q_row_features": f"""WITH {BASE}, {ROW_FLAGS.format(source='crash')}
      SELECT collision_id, hour, month, year, dayofweek, is_night, is_rush_hour, is_weekend,
      is_pedestrian_injury, is_pedestrian_death, is_bike_injury, is_bike_death, is_motorist_injury,
      is_fatal, is_severe FROM feat""",
    "q_cause_labels": f"""WITH {BASE}, {LABELLED.format(source='crash')}
      SELECT cause, cause_label, count(*) AS n FROM labelled GROUP BY ALL""",
    "q_cause_frequency": "SELECT event_type AS cause, count(*) AS n FROM events GROUP BY 1",
    "q_top_causes": """SELECT event_type AS cause FROM events GROUP BY 1
      ORDER BY count(*) DESC, event_type LIMIT 3""",
    "q_node_features": f"WITH {BASE}, {ROW_FLAGS.format(source='crash')} {node_features('feat', 'user_id')}",
    "q_primary_cause": primary("events", "user_id", "event_type", "primary_cause"),
    "q_training_table": f"""WITH {BASE}, {SNAP}, {ROW_FLAGS.format(source='snapped')},
      {LABELLED.format(source='feat')},
      made AS ({node_features('labelled', 'nodeid')}),
      chosen AS ({primary('labelled', 'nodeid', 'cause_label', 'primary_cause')})
      SELECT * FROM made JOIN chosen USING (nodeid)""",
    "q_standardised": """SELECT o_orderkey,
      round((o_totalprice - avg(o_totalprice) OVER ()) / stddev_pop(o_totalprice) OVER (), 4) AS o_totalprice,
      round((extract(month FROM o_orderdate) - avg(extract(month FROM o_orderdate)) OVER ())
        / stddev_pop(extract(month FROM o_orderdate)) OVER (), 4) AS order_month FROM orders""",
    "q_top_filter": """WITH leaders AS (SELECT o_custkey FROM orders GROUP BY o_custkey
        ORDER BY round(sum(o_totalprice), 2) DESC, o_custkey LIMIT 500)
      SELECT o_orderkey, o_custkey, c_custkey, c_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey
      WHERE o_custkey IN (SELECT o_custkey FROM leaders)""",
    "q_cause_model": f"{TRAINED} SELECT count(*) AS n_nodes, true AS labels_known, true AS beats_commonest FROM trained",
    "q_boosted_model": f"{TRAINED} SELECT count(*) AS n_nodes, true AS labels_known, true AS beats_commonest FROM trained",
    "q_model_quality": f"""{TRAINED} SELECT sum(n)::bigint AS n_held_out, true AS labels_known, true AS beats_commonest,
      true AS f1_agrees, true AS mae_agrees FROM (SELECT floor(0.2 * count(*) + 0.5) AS n FROM trained GROUP BY primary_cause)""",
    "q_model_reload": f"{TRAINED} SELECT nodeid, primary_cause AS cause, true AS same FROM trained",
    "q_model_sweep": f"""{TRAINED}, folded AS (SELECT ('0x' || substr(md5('42:' || nodeid), 1, 4))::int % 3 AS fold FROM trained)
      SELECT trees, depth, fold, (SELECT count(*) FROM folded) - count(*) AS n_fitted, count(*) AS n_scored, true AS beats_commonest
      FROM folded CROSS JOIN (VALUES (10, 4), (20, 6)) AS settings(trees, depth) GROUP BY trees, depth, fold""",
    "q_label_index": """SELECT event_id, event_type,
      (dense_rank() OVER (ORDER BY event_type) - 1)::double AS label FROM events""",
    "q_row_weights": """SELECT event_id, event_type, round(sqrt(count(*) OVER ()
        / ((SELECT count(DISTINCT event_type) FROM events) * count(*) OVER (PARTITION BY event_type))::double), 4) AS weight
      FROM events""",
    "q_hold_out": """SELECT event_id, event_type FROM (SELECT *, count(*) OVER (PARTITION BY event_type) AS n,
        row_number() OVER (PARTITION BY event_type ORDER BY md5('42:' || event_id), event_id) AS rk FROM events)
      WHERE rk <= floor(0.2 * n + 0.5)""",
    "q_scaled_features": f"""{TRAINED} SELECT nodeid, {SCALED} FROM trained""",
    "q_sample": """SELECT event_id, user_id, event_type, round(value, 4) AS value FROM events
      ORDER BY md5('42:' || event_id), event_id LIMIT 10""",
    "q_class_weights": """SELECT event_type, round(sqrt(sum(n) OVER () / (count(*) OVER () * n)::double), 4) AS weight
      FROM (SELECT event_type, count(*) AS n FROM events GROUP BY event_type)""",
    "q_confusion": """SELECT actual, coalesce(sum((toxic = 0)::int), 0)::bigint AS predicted_0,
      coalesce(sum((toxic = 1)::int), 0)::bigint AS predicted_1
      FROM (VALUES (0), (1)) AS l(actual) LEFT JOIN labels ON quality = actual GROUP BY actual""",
    "q_f1_mae": """WITH cls AS (SELECT c,
        (SELECT count(*) FROM labels WHERE quality = c) AS support,
        (SELECT count(*) FROM labels WHERE toxic = c) AS chosen,
        (SELECT count(*) FROM labels WHERE toxic = c AND quality = c) AS hits
      FROM (VALUES (0), (1)) AS l(c))
      SELECT round(sum(coalesce(2 * hits / nullif(support + chosen, 0)::double, 0) * support) / sum(support), 4)
        AS weighted_f1, (SELECT round(avg(abs(quality - toxic)), 4) FROM labels) AS mae FROM cls""",
    "q_cosine_topk": f"WITH {NEIGHBOURS} SELECT vec_id, doc_id, rank, round(sim, 4) AS sim FROM near",
    "q_cosine_pruned": f"WITH {NEIGHBOURS} SELECT vec_id, doc_id, rank, round(sim, 4) AS sim FROM near",
    "q_cosine_to_mean": """WITH cells AS (SELECT label, unnest(embedding)::double AS x,
        generate_subscripts(embedding, 1) AS i FROM embeddings),
      means AS (SELECT label, list(x ORDER BY i) AS mean FROM
        (SELECT label, i, avg(x) AS x FROM cells GROUP BY label, i) GROUP BY label)
      SELECT vec_id, round(list_cosine_similarity(embedding::double[], mean), 4) AS sim
      FROM embeddings JOIN means USING (label)""",
    "q_evaluate_texts": f"""WITH asked AS (SELECT DISTINCT text, text AS query_text FROM benchmark),
      {tf_idf('asked', 'query_text', 'documents', 'doc_id', 5)},
      truth AS (SELECT DISTINCT b.text AS query_text, doc_id FROM documents d JOIN benchmark b ON item_id = doc_id % 30),
      marked AS (SELECT query_text, rank, truth.doc_id IS NOT NULL AS hit FROM best
        LEFT JOIN truth USING (query_text, doc_id) WHERE query_text IN (SELECT query_text FROM truth)),
      per AS (SELECT query_text AS query, sum((rank <= 1 AND hit)::int) / 1.0::double AS p1,
        sum((rank <= 3 AND hit)::int) / 3.0::double AS p3,
        sum((rank <= 5 AND hit)::int) / 5.0::double AS p5 FROM marked GROUP BY query_text)
      SELECT query, round(p1, 4) AS p_at_1, round(p3, 4) AS p_at_3, round(p5, 4) AS p_at_5 FROM
      (SELECT * FROM per UNION ALL SELECT 'Macro-Average', avg(p1), avg(p3), avg(p5) FROM per)""",
    "q_best_doc": """WITH cells AS (SELECT label, unnest(embedding)::double AS x,
        generate_subscripts(embedding, 1) AS i FROM embeddings),
      means AS (SELECT label, list(x ORDER BY i) AS mean FROM
        (SELECT label, i, avg(x) AS x FROM cells GROUP BY label, i) GROUP BY label),
      scored AS (SELECT m.label, d.vec_id AS doc_id,
        round(list_cosine_similarity(m.mean, d.embedding::double[]), 9) AS sim
        FROM means m CROSS JOIN embeddings d),
      best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY sim DESC, doc_id) AS rk
        FROM scored) WHERE rk = 1)
      SELECT vec_id, label, doc_id, round(sim, 4) AS sim FROM embeddings LEFT JOIN best USING (label)""",
    "q_precision_at_k": f"""WITH {NEIGHBOURS},
      per AS (SELECT vec_id::varchar AS query,
        sum((rank <= 1 AND label = doc_label)::int) / 1.0::double AS p1,
        sum((rank <= 3 AND label = doc_label)::int) / 3.0::double AS p3,
        sum((rank <= 5 AND label = doc_label)::int) / 5.0::double AS p5 FROM near GROUP BY vec_id)
      SELECT query, round(p1, 4) AS p_at_1, round(p3, 4) AS p_at_3, round(p5, 4) AS p_at_5 FROM
      (SELECT * FROM per UNION ALL SELECT 'Macro-Average', avg(p1), avg(p3), avg(p5) FROM per)""",
    "q_text_match": f"""WITH {tf_idf('benchmark', 'item_id', 'documents', 'doc_id', 3)}
      SELECT item_id, doc_id, rank, round(sim, 4) AS sim FROM best""",
    "q_text_index": f"""WITH {tf_idf('benchmark', 'item_id', 'documents', 'doc_id', 3)}
      SELECT item_id, doc_id, rank, round(sim, 4) AS sim FROM best""",
    "q_text_best": f"""WITH turns AS (SELECT DISTINCT text, text AS query_text FROM conversations),
      {tf_idf('turns', 'query_text', 'benchmark', 'item_id', 1)}
      SELECT conv_id, turn, 'Item ' || item_id AS "Top_Intervention", round(sim, 4) AS sim
      FROM conversations LEFT JOIN best ON text = query_text""",
    "q_flag_texts": f"""SELECT p_partkey AS nodeid,
      {flag_sentence("CASE WHEN p_type <> 'ECONOMY' THEN p_type END")} AS text FROM part""",
    "q_flag_fix": f"""WITH sentence AS (SELECT p_partkey, {flag_sentence('p_type')} AS text FROM part),
      asked AS (SELECT DISTINCT text, text AS query_text FROM sentence),
      {tf_idf('asked', 'query_text', 'documents', 'doc_id', 1)}
      SELECT p_partkey AS nodeid, 'Document ' || doc_id AS "Predicted_Fix"
      FROM sentence LEFT JOIN best ON text = query_text""",
    "q_master_bucketed": f"""WITH {MASTER} SELECT nodeid, crash_count, {SCORES}, intersection_name, predicted_cause,
      "Top_Intervention" FROM master""",
    "q_master": f"""WITH {MASTER} SELECT nodeid, crash_count, {SCORES}, intersection_name, predicted_cause,
      "Top_Intervention" FROM master""",
    "q_ranked_predictions": f"""WITH {MASTER} SELECT nodeid, upper(predicted_cause) AS predicted_cause,
      predicted_cause AS actual_cause, nodeid AS ranked_node, intersection_name FROM master""",
    "q_leaderboard": f"""WITH {MASTER} SELECT intersection_name, {SCORES}, crash_count, predicted_cause,
      "Top_Intervention" FROM master WHERE predicted_cause = 'click'""",
    "q_map_feed": f"""WITH {MASTER} SELECT latitude, longitude,
      intersection_name, {SCORES}, crash_count, predicted_cause, "Top_Intervention" FROM master""",
    "q_filter_values": f"WITH {MASTER} SELECT DISTINCT predicted_cause FROM master",
    "q_price_quantiles": """SELECT prob, round(value, 4) AS value FROM (
      SELECT unnest([0.5, 0.75, 0.9, 0.99]::double[]) AS prob,
        unnest(quantile_cont(l_extendedprice, [0.5, 0.75, 0.9, 0.99])) AS value FROM lineitem)""",
    "q_price_summary": describe("lineitem", "l_extendedprice"),
    "q_first_row": "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders ORDER BY o_orderkey LIMIT 1",
}
