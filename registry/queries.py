"""One query per operator, over the whole of the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.evaluation import MulticlassClassificationEvaluator, RegressionEvaluator
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from registry import views as v
from snapgrid.functions.text import FLAG_PHRASES, flag_text
from snapgrid.operators import cells, clean, evaluation, features, names, nearest, proximity, quality_report, similarity, sketches, spatial_index, summary
from snapgrid.operators import text_index as impact_index
from snapgrid.operators.model import TreeSettings, index_labels, load_cause_model, scaled, scaling, split, standardise
from snapgrid.operators.targets import (
    multipoint_targets,
    point_targets,
    polyline_targets,
    segment_targets,
)
from snapgrid.plans import causes, ranking, recommend, sweep, views as dashboards
from snapgrid.plans.flags import flag_table
from snapgrid.session import scratch_folder, stage_table
from snapgrid.sources import layers as layer_sources
from snapgrid.sources import bucketed, readers, schemas, variants
from snapgrid.streaming import sums
from snapgrid.streaming.ingest import ingest_distinct, ingest_pages

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

CAUSE = causes.CAUSE
USELESS = ["error", "signup"]
RATING_LIMIT = 3.5


def query(fn: Query) -> Query:
    QUERIES["q_" + fn.__name__] = fn
    return fn


def r4(column: str | Column, name: str | None = None) -> Column:
    return F.round(column, 4).alias(name or column)


def _scratch(spark: SparkSession, name: str) -> str:
    return scratch_folder(spark, f"registry-{name}")


def _node_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return point_targets(v.nodes(spark, sf_dir), "latitude", "longitude", "NODEID")


def _segments(spark: SparkSession, sf_dir: str, *keep: str) -> DataFrame:
    return segment_targets(
        v.segment_layer(spark, sf_dir),
        "fromlatitude", "fromlongitude", "tolatitude", "tolongitude", *keep,
    )


# Ranking


@query
def hotspot_rank(spark, sf_dir):
    ranked = ranking.rank_nodes(v.crashes(spark, sf_dir), v.nodes(spark, sf_dir), v.AS_OF, v.SNAP_M)
    return ranked.select(
        F.col("NODEID").alias("nodeid"), "crash_count", "total_killed", "total_injured",
        r4("severity_score"), r4("severity_score_norm"),
    )


@query
def intersection_rankings(spark, sf_dir):
    table = ranking.intersection_rankings(
        v.crashes(spark, sf_dir), v.nodes(spark, sf_dir), v.street_edges(spark, sf_dir),
        v.AS_OF, v.SNAP_M,
    )
    return table.select(
        F.col("NODEID").alias("nodeid"), "crash_count", "total_killed", "total_injured",
        r4("severity_score"), r4("severity_score_norm"), "intersection_name",
        "latitude", "longitude",
    )


def _node_map(spark, sf_dir):
    return ranking.crash_to_node_map(v.crashes(spark, sf_dir), v.nodes(spark, sf_dir), v.SNAP_M)


@query
def snap_map(spark, sf_dir):
    return _node_map(spark, sf_dir).select(
        "collision_id", F.col("NODEID").alias("nodeid"), r4("snap_dist")
    )


@query
def snap_indexed(spark, sf_dir):
    """The node map from a stored index of the nodes, built here and opened anew."""
    path, nodes = _scratch(spark, "node_index"), v.nodes(spark, sf_dir)
    spatial_index.build_index(_node_targets(spark, sf_dir), path, "NODEID")
    near = ranking.place_nodes(v.crashes(spark, sf_dir), nodes, v.SNAP_M, spatial_index.open_index(spark, path))
    mapped = ranking.crash_to_node_map(v.crashes(spark, sf_dir), nodes, near=near)
    return mapped.select("collision_id", F.col("NODEID").alias("nodeid"), r4("snap_dist"))


@query
def snap_summary(spark, sf_dir):
    rows = stage_table(_node_map(spark, sf_dir), "snap_map")
    return summary.describe(rows, "snap_dist").select(
        "n", *[r4(c) for c in ("mean", "std", "min", "p25", "p50", "p75", "max")]
    )


@query
def node_counts(spark, sf_dir):
    counted = dashboards.counts_by(_node_map(spark, sf_dir), "NODEID")
    return counted.select(F.col("NODEID").alias("nodeid"), "n")


@query
def node_count_summary(spark, sf_dir):
    counted = stage_table(dashboards.counts_by(_node_map(spark, sf_dir), "NODEID"), "node_counts")
    return summary.describe(counted, "n").select(
        "n", *[r4(c) for c in ("mean", "std", "min", "p25", "p50", "p75", "max")]
    )


@query
def year_counts(spark, sf_dir):
    return dashboards.year_counts(v.crashes(spark, sf_dir), "user_id", 8)


@query
def severity_rows(spark, sf_dir):
    from snapgrid.operators.severity import score_rows

    return score_rows(v.crashes(spark, sf_dir), v.AS_OF).select(
        "collision_id", r4("age_years"), r4("recency_weight"), r4("base_severity"), r4("weighted_score")
    )


@query
def street_names(spark, sf_dir):
    named = names.intersection_names(v.street_edges(spark, sf_dir))
    return named.select(F.col("NODEID").alias("nodeid"), "intersection_name")


@query
def node_coords(spark, sf_dir):
    sized = v.nodes(spark, sf_dir).join(
        v.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("NODEID"), "p_size"), "NODEID"
    )
    return names.node_coordinates(sized, "p_size").select("p_size", "latitude", "longitude")


# Nearest and near


@query
def nearest_uncapped(spark, sf_dir):
    spots = nearest.places(v.nodes(spark, sf_dir), "latitude", "longitude")
    near = nearest.nearest_any(spots, _segments(spark, sf_dir, "segment_id"), "segment_id", 250.0)
    rows = nearest.join_back(v.nodes(spark, sf_dir), near, "latitude", "longitude", "distance")
    return rows.select(F.col("NODEID").alias("nodeid"), "segment_id", F.round("distance", 3).alias("distance"))


def _crash_streets(spark, sf_dir):
    crashes = v.crashes(spark, sf_dir).select("collision_id", "latitude", "longitude")
    streets = polyline_targets(v.line_layer(spark, sf_dir), "coordinates", "stname_lab")
    near = nearest.nearest_any(
        nearest.places(crashes, "latitude", "longitude"), streets, "stname_lab", 500.0
    )
    return nearest.join_back(crashes, near, "latitude", "longitude", "distance")


@query
def nearest_street(spark, sf_dir):
    return _crash_streets(spark, sf_dir).select(
        "collision_id", "stname_lab", F.round("distance", 3).alias("distance")
    )


@query
def street_counts(spark, sf_dir):
    return dashboards.counts_by(_crash_streets(spark, sf_dir), "stname_lab", top=10)


@query
def dedup_join_back(spark, sf_dir):
    events = v.table(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    pairs = events.select("user_id", "event_type").dropDuplicates()
    per_user = pairs.groupBy("user_id").agg(F.count_distinct("event_type").alias("dist"))
    unique = pairs.join(per_user, "user_id").withColumnsRenamed({"user_id": "lat", "event_type": "lon"})
    return nearest.join_back(events, unique, "user_id", "event_type", "n_types").select(
        "event_id", "user_id", "event_type", "n_types"
    )


def _near(spark, sf_dir, targets, flag, radius):
    return proximity.near_flag(v.nodes(spark, sf_dir), targets, flag, radius).select(
        F.col("NODEID").alias("nodeid"), flag
    )


@query
def near_point(spark, sf_dir):
    targets = point_targets(v.point_layer(spark, sf_dir), "lat", "long")
    return _near(spark, sf_dir, targets, "near_point", v.POINT_M)


@query
def near_multipoint(spark, sf_dir):
    targets = multipoint_targets(v.multipoint_layer(spark, sf_dir), "coordinates")
    return _near(spark, sf_dir, targets, "near_multipoint", v.POINT_M)


@query
def near_line(spark, sf_dir):
    targets = polyline_targets(v.line_layer(spark, sf_dir), "coordinates")
    return _near(spark, sf_dir, targets, "near_line", v.SNAP_M)


@query
def near_segment(spark, sf_dir):
    return _near(spark, sf_dir, _segments(spark, sf_dir), "near_segment", v.LINE_M)


@query
def near_segment_indexed(spark, sf_dir):
    path = _scratch(spark, "segment_index")
    index = spatial_index.build_index(_segments(spark, sf_dir, "segment_id"), path, "segment_id", degrees=1e-3)
    return spatial_index.near_flag(index, v.nodes(spark, sf_dir), "near_segment", v.LINE_M).select(F.col("NODEID").alias("nodeid"), "near_segment")


@query
def near_line_rated(spark, sf_dir):
    layer = v.segment_layer(spark, sf_dir).where(F.col("systemrating") < RATING_LIMIT)
    targets = segment_targets(layer, "fromlatitude", "fromlongitude", "tolatitude", "tolongitude")
    return _near(spark, sf_dir, targets, "near_line_rated", v.LINE_M)


def _landed_layers(spark, sf_dir):
    """All thirteen layers written as GeoJSON pages, geometries mixed, and read back by the layer readers."""
    point, lines = v.point_layer(spark, sf_dir), v.line_layer(spark, sf_dir)
    root = _scratch(spark, "layers")

    def geometry(kind: str, coordinates: Column) -> Column:
        text = F.to_json(coordinates)
        return F.struct(F.lit(kind).alias("type"), text.alias("coordinates")).alias("the_geom")

    odd = F.col("s_suppkey") % 2 == 1
    segments = v.segment_layer(spark, sf_dir)
    dots = point.select(geometry("Point", F.array("long", "lat")))
    strings = lines.where(~odd).select(geometry("LineString", F.col("coordinates")))
    streets = strings.union(lines.where(odd).select(geometry("MultiLineString", F.array("coordinates"))))
    many = v.multipoint_layer(spark, sf_dir).where(odd)
    leg = F.array(F.array("fromlongitude", "fromlatitude"), F.array("tolongitude", "tolatitude"))
    rated = [
        segments.where(F.col("segment_id") % 2 == k).select(geometry(kind, shape), F.col("systemrating").cast("string"))
        for k, (kind, shape) in enumerate((("LineString", leg), ("MultiLineString", F.array(leg))))
    ]
    ends = ("fromlatitude", "fromlongitude", "tolatitude", "tolongitude")
    pages = {
        schemas.LAT_LONG_PAGE: point.select(F.col("lat").cast("string"), F.col("long").cast("string")),
        schemas.FROM_TO_PAGE: segments.select(*[F.col(c).cast("string") for c in ends]),
        schemas.RATED_GEOMETRY_PAGE: rated[0].union(rated[1]),
    }
    by_reader = {
        layer_sources.geo_point_layer: dots.union(strings),
        layer_sources.geo_multipoint_layer: dots.union(many.select(geometry("MultiPoint", F.col("coordinates")))),
        layer_sources.geo_multiline_layer: streets.union(dots),
    }
    for layer in layer_sources.LAYERS.values():
        page = pages[layer.schema] if layer.schema in pages else by_reader[layer.targets]
        page.write.json(f"{root}/{layer.folder}")
    return layer_sources.read_layers(spark, root)


@query
def layer_variant(spark, sf_dir):
    """Suppliers as records of six kinds, two of them broken, read by three layers: each is targets or a reject."""
    path, s = _scratch(spark, "variants"), F.col("s_suppkey")
    at = v.point_layer(spark, sf_dir).withColumn("p", F.array("long", "lat")).withColumn(
        "q", F.array(F.col("long") + F.lit(0.01), F.col("lat") + F.lit(0.01))
    )

    def record(kind: str, coordinates: Column) -> Column:
        return F.to_json(F.struct(s.alias("id"), F.struct(F.lit(kind).alias("type"), coordinates.alias("coordinates")).alias("the_geom")))

    kinds = [
        record("Point", F.col("p")),
        record("LineString", F.to_json(F.array("p", "q"))),
        record("MultiLineString", F.array(F.array("p", "q"), F.array("q", "p"))),
        F.format_string('{"the_geom": {"type": "Point", "id": %d', s),
        F.to_json(F.struct(s.alias("id"))),
        record("MultiPoint", F.array("p", "q")),
    ]
    lines = F.coalesce(*[F.when(s % len(kinds) == k, line) for k, line in enumerate(kinds)])
    at.select(lines.alias("value")).write.text(path)
    made = None
    for flag in ("Has_Pedestrian_Ramp", "Is_Protected_Intersection", "Has_Bus_Lane"):
        layer = variants.variant_layer(variants.read_variant_pages(spark, path), layer_sources.LAYERS[flag], {"id": ("$.id", "bigint")})
        ends = [F.round(c, 5).alias(c) if c in layer.targets.columns else F.lit(None).cast("double").alias(c)
                for c in ("a_lat", "a_lon", "b_lat", "b_lon")]
        hits = layer.targets.select(F.lit(flag).alias("flag"), "id", F.lit("target").alias("outcome"), *ends)
        rest = layer.rejects.select(F.lit(flag).alias("flag"), "id", F.col("reason").alias("outcome"))
        both = hits.unionByName(rest, allowMissingColumns=True)
        made = both if made is None else made.unionByName(both)
    return made


@query
def flags(spark, sf_dir):
    ranked = ranking.rank_nodes(v.crashes(spark, sf_dir), v.nodes(spark, sf_dir), v.AS_OF, v.SNAP_M)
    placed = stage_table(
        ranking.name_and_place(ranked, v.nodes(spark, sf_dir), v.street_edges(spark, sf_dir)), "ranked"
    )
    flagged = flag_table(placed, _landed_layers(spark, sf_dir), v.SNAP_M)
    return flagged.select(F.col("NODEID").alias("nodeid"), *layer_sources.LAYERS)


# Cleaning and sources


def _dirty(spark, sf_dir):
    """``events`` as text columns with blanks, bad numbers and odd headers."""
    i, k = F.col("event_id"), F.get_json_object("props", "$.k")
    lat = F.when(i % 11 == 0, "n/a").when(i % 13 == 0, "0").when(i % 23 == 0, "40.5d").when(i % 29 == 0, "inf").otherwise(
        F.format_string("%.5f", F.lit(40.3) + (i * 104729 % 80000) / F.lit(100000.0))
    )
    lon = F.when(i % 17 == 0, F.lit(None)).otherwise(
        F.format_string("%.5f", F.lit(-74.4) + (i * 15485863 % 90000) / F.lit(100000.0))
    )
    return v.table(spark, sf_dir, "events").select(
        F.when(i % 37 == 0, F.concat(i.cast("string"), F.lit("d")))
        .when(i % 2 == 0, i.cast("string"))
        .otherwise(F.concat(i.cast("string"), F.lit(".0")))
        .alias(" Collision ID"),
        F.when(i % 19 == 0, "someday").when(i % 31 == 0, F.date_format("ts", "MM/dd/yyyy")).when(
            i % 17 == 1, F.date_format("ts", "M/d/yyyy H:mm")
        ).otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")).alias("CRASH DATE"),
        lat.alias("Latitude"),
        lon.alias("LONGITUDE "),
        F.when(i % 7 == 0, "many").otherwise(k).alias("number of persons injured"),
    )


def _tidy(df: DataFrame) -> DataFrame:
    return df.select(
        clean.to_integer_key(F.col("collision_id")).alias("collision_id"),
        F.date_format("crash_date", "yyyy-MM-dd HH:mm:ss").alias("crash_date"),
        "latitude", "longitude", "number_of_persons_injured",
        F.coalesce("number_of_persons_killed", F.lit(0.0)).alias("number_of_persons_killed"),
    )


@query
def clean_rows(spark, sf_dir):
    return _tidy(clean.clean_crashes(_dirty(spark, sf_dir)))


@query
def clean_report(spark, sf_dir):
    """What cleaning kept and rejected, and why, counted by the pass that wrote the rows."""
    return quality_report.report(spark, quality_report.clean_and_write(_dirty(spark, sf_dir), _scratch(spark, "outcomes")))


@query
def csv_round_trip(spark, sf_dir):
    path = _scratch(spark, "csv")
    readers.write_csv(_dirty(spark, sf_dir), path)
    return _tidy(readers.read_crash_csv(spark, path))


@query
def csv_typed(spark, sf_dir):
    """Columns are found by name: the file has them in another order, and one more."""
    path = _scratch(spark, "typed")
    orders = v.table(spark, sf_dir, "orders")
    readers.write_csv(orders.select("o_totalprice", "o_orderstatus", "o_custkey", "o_orderkey", "o_orderpriority"), path)
    typed = readers.read_csv(
        spark, path, "o_orderkey bigint, o_custkey bigint, o_orderpriority string, o_totalprice double"
    )
    return typed.select("o_orderkey", "o_custkey", "o_orderpriority", r4("o_totalprice"))


@query
def layer_read(spark, sf_dir):
    """Nodes landed as Parquet, street edges as JSON lines."""
    path = _scratch(spark, "landed")
    readers.write_parquet(v.nodes(spark, sf_dir), f"{path}/nodes")
    v.street_edges(spark, sf_dir).write.json(f"{path}/edges.jsonl")
    nodes = readers.read_layer(spark, f"{path}/nodes", schemas.NODES)
    edges = readers.read_layer(spark, f"{path}/edges.jsonl", schemas.STREET_EDGES)
    return nodes.join(edges, nodes.NODEID == edges.NodeIDFrom).select(
        F.col("NODEID").alias("nodeid"), "latitude", "longitude", F.col("NodeIDTo").alias("node_to"), F.col("Street").alias("street")
    )


@query
def corpus_text(spark, sf_dir):
    corpus = v.table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("Doc ID"),
        F.concat(F.lit(" "), F.col("source"), F.lit("  ")).alias("Title"),
        F.when(F.col("doc_id") % 7 != 0, F.concat("lang", F.lit(" "))).alias("Keywords"),
    )
    return recommend.corpus_texts(corpus)


@query
def duplicate_headers(spark, sf_dir):
    """Of headers that end up the same the first one stays."""
    events = v.table(spark, sf_dir, "events")
    doubled = events.select(
        F.col("event_id").alias(" Event ID"), F.col("user_id").alias("event id "), F.col("value").alias("VALUE"),
        F.col("event_type").alias("Value "),
    )
    return clean.normalise_headers(doubled).select("event_id", r4("value"))


@query
def stream_ingest(spark, sf_dir):
    pages, sink, state = (_scratch(spark, f"stream_{part}") for part in ("pages", "sink", "state"))
    landed = clean.normalise_headers(_dirty(spark, sf_dir))
    landed.write.json(pages)
    ingest_pages(spark, pages, sink, state, pages_per_batch=2).awaitTermination()
    return _tidy(spark.read.parquet(sink))


@query
def stream_dedup(spark, sf_dir):
    """A third of the rows lands again in later pages; each record is appended once."""
    pages, sink, state = (_scratch(spark, f"dedup_{part}") for part in ("pages", "sink", "state"))
    landed = clean.normalise_headers(_dirty(spark, sf_dir))
    landed.write.json(pages)
    landed.where(F.crc32("collision_id") % 3 == 0).write.mode("append").json(pages)
    ingest_distinct(spark, pages, sink, state, pages_per_batch=2).awaitTermination()
    return _tidy(spark.read.parquet(sink))


@query
def stream_rank(spark, sf_dir):
    """The ranking from sums that followed the pages: rows land wrong, land again, and land corrected."""
    pages, root = _scratch(spark, "sums_pages"), _scratch(spark, "sums")
    crashes = v.crashes(spark, sf_dir).select(
        "collision_id", F.date_format("crash_date", "yyyy-MM-dd'T'HH:mm:ss").alias("crash_date"), "latitude", "longitude",
        "number_of_persons_injured", "number_of_persons_killed",
    )
    text = [F.col(c).cast("string").alias(c) for c in crashes.columns]
    wrong = F.col("collision_id") % 5 == 0
    first = crashes.withColumns(
        {
            "latitude": F.when(wrong, F.lit(40.5) + F.col("collision_id") % 40 / F.lit(100.0)).otherwise(F.col("latitude")),
            "number_of_persons_injured": F.when(wrong, F.lit(7.0)).otherwise(F.col("number_of_persons_injured")),
        }
    )
    # Records that should not be there, and whose correction takes them out.
    void = crashes.where(F.col("collision_id") % 7 == 0).withColumn("collision_id", F.col("collision_id") + 10**12)
    first.unionByName(void).select(*text).write.json(pages)
    first.where(F.col("collision_id") % 3 == 0).select(*text).write.mode("append").json(pages)
    nodes = v.nodes(spark, sf_dir)
    sums.track_sums(spark, pages, root, nodes, "2024-01-01", v.SNAP_M).awaitTermination()
    crashes.where(wrong).unionByName(void.withColumn("latitude", F.lit(0.0))).select(*text).write.mode("append").json(pages)
    sums.track_sums(spark, pages, root, nodes, "2024-06-01", v.SNAP_M).awaitTermination()
    return sums.ranked_sums(spark, root, v.AS_OF).select(
        F.col("NODEID").alias("nodeid"), "crash_count", "total_killed", "total_injured",
        r4("severity_score"), r4("severity_score_norm"),
    )


@query
def cached_table(spark, sf_dir):
    path = _scratch(spark, "cache")

    def build() -> DataFrame:
        return v.crashes(spark, sf_dir).select("collision_id", "latitude", "longitude")

    readers.read_through(spark, path, build)
    return readers.read_through(spark, path, build)


@query
def union_pages(spark, sf_dir):
    events = v.table(spark, sf_dir, "events")
    pages = [
        events.where(F.col("event_type") == "click").select("event_id", "value", "user_id"),
        events.where(F.col("event_type") != "click").select("user_id", "event_id"),
    ]
    return clean.union_pages(*pages).select("event_id", "user_id", "value")


# Causes


@query
def row_features(spark, sf_dir):
    flags = [
        "is_night", "is_rush_hour", "is_weekend", "is_pedestrian_injury", "is_pedestrian_death",
        "is_bike_injury", "is_bike_death", "is_motorist_injury", "is_fatal", "is_severe",
    ]
    return features.row_features(v.crashes(spark, sf_dir)).select(
        "collision_id", "hour", "month", "year", "dayofweek", *flags
    )


@query
def cause_labels(spark, sf_dir):
    rows = features.with_clean_cause(v.crashes(spark, sf_dir), CAUSE)
    labelled = features.label_causes(rows, CAUSE, top=3, unspecified="error", useless=USELESS)
    return labelled.groupBy(F.col(CAUSE).alias("cause"), "cause_label").agg(F.count("*").alias("n"))


@query
def cause_frequency(spark, sf_dir):
    return dashboards.counts_by(v.crashes(spark, sf_dir), CAUSE).withColumnRenamed(CAUSE, "cause")


@query
def top_causes(spark, sf_dir):
    return features.top_labels(v.crashes(spark, sf_dir), CAUSE, 3).withColumnRenamed(CAUSE, "cause")


@query
def node_features(spark, sf_dir):
    rows = features.row_features(v.crashes(spark, sf_dir))
    made = features.node_features(features.node_sums(rows, "user_id"), "user_id")
    return made.select(
        "user_id", *[F.round(F.col(c).cast("double"), 4).alias(c) for c in features.FEATURES]
    )


@query
def primary_cause(spark, sf_dir):
    return features.primary_label(v.crashes(spark, sf_dir), "user_id", CAUSE)


def _training_table(spark, sf_dir):
    at_nodes = causes.crashes_at_nodes(v.crashes(spark, sf_dir), _node_map(spark, sf_dir))
    return causes.training_table(at_nodes, top=3, unspecified="error", useless=USELESS)


@query
def training_table(spark, sf_dir):
    table = _training_table(spark, sf_dir)
    return table.select(
        F.col("NODEID").alias("nodeid"),
        *[F.round(F.col(c).cast("double"), 4).alias(c) for c in features.FEATURES],
        "primary_cause",
    )


@query
def standardised(spark, sf_dir):
    columns = ["o_totalprice", "order_month"]
    orders = v.table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_totalprice", F.month("o_orderdate").cast("double").alias("order_month")
    )
    return standardise(orders, columns).select("o_orderkey", *[r4(c) for c in columns])


@query
def top_filter(spark, sf_dir):
    """Orders as predictions, the customers who spent most as the ranking."""
    orders, customers = v.table(spark, sf_dir, "orders"), v.table(spark, sf_dir, "customer")
    spent = orders.groupBy("o_custkey").agg(F.round(F.sum("o_totalprice"), 2).alias("spent"))
    leaders = spent.orderBy(F.col("spent").desc(), "o_custkey").limit(500)
    ranked = leaders.join(customers, leaders.o_custkey == customers.c_custkey).select(
        F.col("c_custkey").alias("NODEID"), F.col("c_name").alias("intersection_name")
    )
    predicted = orders.select(
        F.col("o_custkey").alias("NODEID"), F.col("o_orderkey").alias("predicted_cause"),
        F.col("o_orderpriority").alias("primary_cause"),
    )
    return causes.ranked_predictions(predicted, ranked).select(
        F.col("predicted_cause").alias("o_orderkey"), F.col("NODEID").alias("o_custkey"),
        F.col("ranked_node").alias("c_custkey"), F.col("intersection_name").alias("c_name"),
    )


@query
def class_weights(spark, sf_dir):
    made = evaluation.class_weights(v.table(spark, sf_dir, "events"), "event_type")
    return made.select("event_type", r4("weight"))


@query
def confusion(spark, sf_dir):
    return evaluation.confusion_matrix(
        v.table(spark, sf_dir, "labels"), "quality", "toxic", [0, 1]
    )


@query
def f1_mae(spark, sf_dir):
    made = evaluation.weighted_f1_and_mae(v.table(spark, sf_dir, "labels"), "quality", "toxic")
    return made.select(r4("weighted_f1"), r4("mae"))


def _checks(run: causes.CauseRun) -> DataFrame:
    """One row: scored nodes, are all predictions known causes, is the F1 above that of the commonest cause?"""
    scored = run.predictions
    known = F.coalesce(F.col("predicted_cause").isin(run.labels), F.lit(False))
    commonest = features.top_labels(scored, "primary_cause", 1).first()[0]
    guessed = scored.withColumn("commonest", F.lit(commonest))
    ours = evaluation.weighted_f1_and_mae(_indexed(scored, run.labels, "predicted_cause"), "a", "p").first()
    theirs = evaluation.weighted_f1_and_mae(_indexed(guessed, run.labels, "commonest"), "a", "p").first()
    return scored.agg(F.count("*").alias("n_nodes"), F.min(known).alias("labels_known")).withColumn(
        "beats_commonest", F.lit(ours.weighted_f1 > theirs.weighted_f1)
    )


def _indexed(rows: DataFrame, labels: list[str], predicted: str) -> DataFrame:
    names = F.array(*[F.lit(x) for x in labels])
    return rows.select(*[F.array_position(names, F.col(c)).alias(n) for c, n in (("primary_cause", "a"), (predicted, "p"))])


@query
def cause_model(spark, sf_dir):
    """The forest with its full number of trees."""
    return _checks(causes.run_model(_training_table(spark, sf_dir), TreeSettings(kind="forest")))


@query
def boosted_model(spark, sf_dir):
    """The model as set: 300 boosted trees for each cause, scored in-sample."""
    return _checks(causes.run_model(_training_table(spark, sf_dir), TreeSettings()))


@query
def model_quality(spark, sf_dir):
    """Held-out nodes: F1 and error as Spark's evaluators see them, and F1 above that of the commonest cause there."""
    run = causes.run_model(_training_table(spark, sf_dir), TreeSettings(kind="forest"), held_out=True)
    ours, seen = run.quality().first(), {"labelCol": "label", "predictionCol": "prediction"}
    f1 = MulticlassClassificationEvaluator(metricName="f1", **seen).evaluate(run.predictions)
    error = RegressionEvaluator(metricName="mae", **seen).evaluate(run.predictions)
    return _checks(run).select(
        F.col("n_nodes").alias("n_held_out"), "labels_known", "beats_commonest",
        F.lit(abs(ours.weighted_f1 - f1) < 1e-9).alias("f1_agrees"), F.lit(abs(ours.mae - error) < 1e-9).alias("mae_agrees"),
    )


@query
def model_reload(spark, sf_dir):
    """A model is written, read again and scores the nodes once more: the same predictions."""
    table, path = stage_table(_training_table(spark, sf_dir), "training"), _scratch(spark, "model")
    run = causes.run_model(table, TreeSettings(trees=40, kind="forest"))
    run.model.save(path)
    again = causes.score_table(load_cause_model(spark, path), table)
    both = run.predictions.join(again.predictions.select("NODEID", F.col("predicted_cause").alias("again"), F.col("label").alias("label_again")), "NODEID")
    same = F.col("predicted_cause").eqNullSafe(F.col("again")) & F.col("label").eqNullSafe(F.col("label_again"))
    return both.select(F.col("NODEID").alias("nodeid"), F.col("primary_cause").alias("cause"), same.alias("same"))


@query
def model_sweep(spark, sf_dir):
    """Two settings on three folds; every setting is scored on the same nodes and beats the commonest cause."""
    settings = [TreeSettings(trees=10, depth=4, kind="forest"), TreeSettings(trees=20, depth=6, kind="forest")]
    scores = sweep.score_settings(_training_table(spark, sf_dir), settings)
    return scores.select(
        "trees", "depth", "fold", "n_fitted", "n_scored", (F.col("weighted_f1") > F.col("commonest_f1")).alias("beats_commonest")
    )


@query
def label_index(spark, sf_dir):
    indexed, _ = index_labels(v.table(spark, sf_dir, "events").select("event_id", "event_type"), "event_type")
    return indexed.select("event_id", "event_type", "label")


@query
def row_weights(spark, sf_dir):
    events = v.table(spark, sf_dir, "events").select("event_id", "event_type")
    return evaluation.with_class_weight(events, "event_type").select("event_id", "event_type", r4("weight"))


@query
def hold_out(spark, sf_dir):
    events = v.table(spark, sf_dir, "events").select("event_id", "event_type")
    return split(events, "event_id", "event_type")[1]


@query
def scaled_features(spark, sf_dir):
    """What the model is fitted on."""
    table = stage_table(_training_table(spark, sf_dir), "training_table")
    made = scaled(table, scaling(table, features.FEATURES))
    return made.select(F.col("NODEID").alias("nodeid"), *[F.round(F.col(c).cast("double"), 3).alias(c) for c in features.FEATURES])


# Retrieval


def _neighbours(spark, sf_dir, k):
    vectors = v.table(spark, sf_dir, "embeddings")
    return similarity.top_k_dense(vectors, vectors.withColumnRenamed("vec_id", "doc_id"),
                                  "vec_id", "doc_id", "embedding", "embedding", k)


@query
def cosine_topk(spark, sf_dir):
    return _neighbours(spark, sf_dir, 5).select(
        "vec_id", "doc_id", F.col("rank").cast("bigint").alias("rank"), r4("sim")
    )


@query
def cosine_pruned(spark, sf_dir):
    """The same ranking by cells and shells."""
    vectors = v.table(spark, sf_dir, "embeddings")
    built = cells.build_cells(vectors.withColumnRenamed("vec_id", "doc_id"), "doc_id", "embedding", 5)
    return cells.top_k_pruned(built, vectors, "vec_id", "embedding", 5)[0].select(
        "vec_id", "doc_id", F.col("rank").cast("bigint").alias("rank"), r4("sim")
    )


def _label_means(vectors):
    return (
        vectors.select("label", F.posexplode("embedding").alias("i", "x"))
        .groupBy("label", "i")
        .agg(F.avg(F.col("x").cast("double")).alias("x"))
        .groupBy("label")
        .agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("cells"))
        .select("label", F.col("cells.x").alias("mean"))
    )


@query
def cosine_to_mean(spark, sf_dir):
    """Cosine of each vector and the mean vector of its label."""
    vectors = v.table(spark, sf_dir, "embeddings")
    paired = vectors.join(_label_means(vectors), "label")
    return paired.select("vec_id", r4(similarity.cosine(F.col("embedding"), F.col("mean")), "sim"))


@query
def best_doc(spark, sf_dir):
    """Best document for the mean vector of each label, brought back to all rows."""
    vectors = v.table(spark, sf_dir, "embeddings")
    means = _label_means(vectors)
    best = similarity.top_k_dense(
        stage_table(means, "label_means"), vectors.withColumnRenamed("vec_id", "doc_id"),
        "label", "doc_id", "mean", "embedding", 1,
    )
    return vectors.select("vec_id", "label").join(best, "label", "left").select(
        "vec_id", "label", "doc_id", r4("sim")
    )


@query
def precision_at_k(spark, sf_dir):
    vectors = v.table(spark, sf_dir, "embeddings")
    labels = vectors.select("vec_id", "label")
    ranked = (
        _neighbours(spark, sf_dir, 5)
        .join(labels, "vec_id")
        .join(labels.toDF("doc_id", "doc_label"), "doc_id")
        .withColumn("hit", F.col("label") == F.col("doc_label"))
    )
    made = evaluation.precision_at_k(stage_table(ranked, "ranked"), "vec_id")
    return made.select("query", r4("p_at_1"), r4("p_at_3"), r4("p_at_5"))


@query
def text_match(spark, sf_dir):
    questions = v.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    corpus = v.table(spark, sf_dir, "documents").select("doc_id", "text")
    return recommend.rank_documents(questions, corpus, 3).select(
        F.col("query_id").alias("item_id"), "doc_id", F.col("rank").cast("bigint").alias("rank"), r4("sim")
    )


@query
def text_index(spark, sf_dir):
    """The same ranking from a stored index, which is built here and opened anew."""
    path = _scratch(spark, "text_index")
    impact_index.build_index(v.table(spark, sf_dir, "documents").select("doc_id", "text"), path)
    questions = v.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return impact_index.search(impact_index.open_index(spark, path), questions, 3).select(
        F.col("query_id").alias("item_id"), "doc_id", F.col("rank").cast("bigint").alias("rank"), r4("sim")
    )


@query
def evaluate_texts(spark, sf_dir):
    """Precision at k of the documents for each benchmark text that has a truth row."""
    items, documents = v.table(spark, sf_dir, "benchmark"), v.table(spark, sf_dir, "documents")
    corpus = documents.select(
        "doc_id", F.concat(F.lit("Document "), F.col("doc_id")).alias("title"), "text"
    )
    listed = corpus.select(
        (F.col("doc_id") % 30).alias("item_id"), F.concat("title", F.lit(" ")).alias("title")
    )
    truth = listed.join(items, "item_id").select(F.col("text").alias("predicted_cause"), "title")
    made = recommend.evaluate_causes(
        items.select(F.col("text").alias("predicted_cause")), corpus, truth
    )
    return made.select("query", r4("p_at_1"), r4("p_at_3"), r4("p_at_5"))


def _benchmark_corpus(spark, sf_dir):
    return v.table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("doc_id"), F.concat(F.lit("Item "), F.col("item_id")).alias("title"), "text"
    )


@query
def text_best(spark, sf_dir):
    turns = v.table(spark, sf_dir, "conversations")
    made = recommend.best_documents(turns, "text", _benchmark_corpus(spark, sf_dir))
    return made.select("conv_id", "turn", "Top_Intervention", r4("sim"))


def _flagged_parts(spark, sf_dir):
    """``part`` with the 13 flags taken from the bits of its size and key."""
    code = F.col("p_size") + 64 * F.col("p_partkey")
    return v.table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("NODEID"),
        *[F.getbit(code, F.lit(i)).cast("int").alias(flag) for i, flag in enumerate(FLAG_PHRASES)],
    )


@query
def flag_texts(spark, sf_dir):
    causes_ = v.table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("NODEID"),
        F.when(F.col("p_type") != "ECONOMY", F.col("p_type")).alias("predicted_cause"),
    )
    described = _flagged_parts(spark, sf_dir).join(causes_, "NODEID", "left")
    return described.select(
        F.col("NODEID").alias("nodeid"), flag_text(F.col("predicted_cause")).alias("text")
    )


@query
def flag_fix(spark, sf_dir):
    predictions = v.table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("NODEID"), F.col("p_type").alias("predicted_cause")
    )
    corpus = v.table(spark, sf_dir, "documents").select(
        "doc_id", F.concat(F.lit("Document "), F.col("doc_id")).alias("title"), "text"
    )
    made = recommend.flag_fixes(_flagged_parts(spark, sf_dir), predictions, corpus)
    return made.select(F.col("NODEID").alias("nodeid"), "Predicted_Fix")


# Result tables


def _ranked_and_at_nodes(spark, sf_dir):
    """The ranking and the crashes at nodes, both from one search."""
    crashes, nodes = v.crashes(spark, sf_dir), v.nodes(spark, sf_dir)
    near = ranking.place_nodes(crashes, nodes, v.SNAP_M)
    ranked = ranking.intersection_rankings(
        crashes, nodes, v.street_edges(spark, sf_dir), v.AS_OF, v.SNAP_M, near=near
    )
    return ranked, causes.crashes_at_nodes(crashes, ranking.crash_to_node_map(crashes, nodes, near=near))


def _master_sides(spark, sf_dir):
    ranked, at_nodes = _ranked_and_at_nodes(spark, sf_dir)
    chosen = features.primary_label(at_nodes, "NODEID", CAUSE, "predicted_cause").withColumn(
        "Top_Intervention", F.concat(F.lit("Treat "), F.col("predicted_cause"))
    )
    return ranked, chosen


def _master(spark, sf_dir):
    return stage_table(recommend.master_table(*_master_sides(spark, sf_dir)), "master")


def _master_columns(table):
    return table.select(
        F.col("NODEID").alias("nodeid"), "crash_count", r4("severity_score"), "intersection_name",
        "predicted_cause", "Top_Intervention",
    )


@query
def master_bucketed(spark, sf_dir):
    """The same table from two that lie in buckets of NODEID."""
    root = _scratch(spark, "bucketed")
    sides = zip(("ranked", "chosen"), _master_sides(spark, sf_dir))
    return _master_columns(recommend.master_table(*[bucketed.write_bucketed(side, f"{root}/{name}", "NODEID", 8) for name, side in sides]))


@query
def master(spark, sf_dir):
    return _master_columns(_master(spark, sf_dir))


@query
def ranked_predictions(spark, sf_dir):
    """Every node's cause, kept for the ranked nodes and named."""
    ranked, at_nodes = _ranked_and_at_nodes(spark, sf_dir)
    ranked = stage_table(ranked, "rankings")
    chosen = features.primary_label(at_nodes, "NODEID", CAUSE).withColumn(
        "predicted_cause", F.upper("primary_cause")
    )
    return causes.ranked_predictions(chosen, ranked).withColumnRenamed("NODEID", "nodeid")


@query
def leaderboard(spark, sf_dir):
    return dashboards.leaderboard(_master(spark, sf_dir), "click").select(
        "intersection_name", r4("severity_score"), "crash_count", "predicted_cause", "Top_Intervention"
    )


@query
def map_feed(spark, sf_dir):
    return dashboards.map_feed(_master(spark, sf_dir), "All").select(
        "latitude", "longitude", "intersection_name", r4("severity_score"), "crash_count",
        "predicted_cause", "Top_Intervention",
    )


@query
def filter_values(spark, sf_dir):
    return dashboards.filter_values(_master(spark, sf_dir))


@query
def price_quantiles(spark, sf_dir):
    made = summary.quantile_table(v.table(spark, sf_dir, "lineitem"), "l_extendedprice")
    return made.select("prob", r4("value"))


@query
def quantiles_by_month(spark, sf_dir):
    """Sketches by priority and day, stored, and merged by month; ranks of the quantiles against all rows."""
    orders = v.table(spark, sf_dir, "orders").select("o_orderpriority", F.to_date("o_orderdate").alias("day"), "o_totalprice")
    month = F.date_format("day", "yyyy-MM").alias("month")
    daily = stage_table(sketches.quantile_sketches(orders, "o_totalprice", "o_orderpriority", "day"), "daily_sketches")
    monthly = sketches.with_quantiles(sketches.merged_quantiles(daily, "o_orderpriority", month), (0.5, 0.9))
    share = lambda q: F.avg((F.col("o_totalprice") <= F.col(q)).cast("double"))
    seen = orders.join(monthly.withColumnsRenamed({"month": "m", "o_orderpriority": "p"}), (F.col("p") == F.col("o_orderpriority")) & (F.col("m") == month))
    allowed = 2 * sketches.KLL_RANK_ERROR + 1 / F.first("n")
    return seen.groupBy(F.col("p").alias("o_orderpriority"), F.col("m").alias("month")).agg(
        F.first("n").alias("n"), r4(F.first("low"), "low"), r4(F.first("high"), "high"),
        *[(F.abs(share(q) - s) <= allowed).alias(f"{q}_within") for q, s in (("p50", 0.5), ("p90", 0.9))],
    )


@query
def distinct_nodes(spark, sf_dir):
    """Distinct users of each kind of event and week, and those of the week before among them, from daily sketches."""
    events = v.table(spark, sf_dir, "events").select("event_type", F.to_date("ts").alias("day"), "user_id")
    week, keys = F.to_date(F.date_trunc("week", "day")).alias("week"), ["event_type", "week"]
    daily = stage_table(sketches.distinct_sketches(events, "user_id", "event_type", "day"), "daily_distinct")
    weekly = stage_table(sketches.merged_distinct(daily, "event_type", week), "weekly_distinct")
    before = weekly.select("event_type", F.date_add("week", 7).alias("week"), F.col("theta").alias("last"))
    found = weekly.join(before, keys, "left").select(
        *keys, F.hll_sketch_estimate("hll").alias("users"), F.coalesce(sketches.in_both(F.col("theta"), F.col("last")), F.lit(0)).alias("again")
    )
    users = events.select("event_type", week, "user_id").distinct()
    last = users.select("event_type", F.date_add("week", 7).alias("week"), "user_id", F.lit(1).alias("seen"))
    exact = users.join(last, [*keys, "user_id"], "left").groupBy(*keys).agg(F.count("*").alias("n_users"), F.count("seen").alias("n_again"))
    near = lambda found, true, of, error: F.abs(F.col(found) - F.col(true)) <= 4 * error * F.col(of) + 1
    return found.join(exact, keys).select(
        "event_type", F.col("week").cast("string").alias("week"), "n_users", "n_again",
        near("users", "n_users", "n_users", sketches.HLL_ERROR).alias("users_within"),
        near("again", "n_again", "n_users", 2 * sketches.THETA_ERROR).alias("again_within"),
    )


@query
def price_summary(spark, sf_dir):
    return summary.describe(v.table(spark, sf_dir, "lineitem"), "l_extendedprice").select(
        "n", *[r4(c) for c in ("mean", "std", "min", "p25", "p50", "p75", "max")]
    )


@query
def first_row(spark, sf_dir):
    return dashboards.first_row(v.table(spark, sf_dir, "orders"), "o_orderkey").select(
        "o_orderkey", "o_custkey", "o_orderstatus"
    )


@query
def sample(spark, sf_dir):
    events = v.table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", r4("value"))
    return dashboards.random_rows(events, "event_id", 10)
