"""The steps of the chain as jobs; hand this file to spark-submit.

    ingest     new crash pages              -> ingested, each page once; each record once with --delay
    track      new crash pages, nodes       -> sums, tracked rankings; corrections count
    rank       crash pages, nodes, edges    -> rankings, crash_to_node
    flags      rankings, layer pages        -> flags; with --rejects also what was no target, and why
    causes     crash pages, map, rankings   -> predictions, quality, confusion, model
    compare    crash pages, map             -> setting_scores, settings by quality on three folds
    score      crash pages, map, rankings, and a stored model -> scored, scored_quality
    index      corpus                       -> index of its texts, for --index of the next three
    recommend  rankings, predictions        -> master
    fixes      flags, predictions           -> fixes
    evaluate   predictions, corpus, truth   -> precision at k
    streets    crash export, centerlines    -> nearest street of every crash
"""

from __future__ import annotations

import argparse
from datetime import date

from pyspark.sql import SparkSession

from snapgrid.operators import text_index
from snapgrid.operators.model import TreeSettings, load_cause_model
from snapgrid.operators.nearest import join_back, nearest_any, places
from snapgrid.operators.targets import polyline_targets
from snapgrid.plans import causes, ranking, recommend, sweep
from snapgrid.plans.flags import flag_table
from snapgrid.session import drop_stage_tables, get_spark, stage_table
from snapgrid.sources import layers, readers, schemas, variants
from snapgrid.streaming import sums
from snapgrid.streaming.ingest import ingest_distinct, ingest_pages


def rank(spark: SparkSession, a: argparse.Namespace) -> None:
    crashes = readers.read_through(
        spark, f"{a.out}/crashes", lambda: readers.read_crash_pages(spark, a.crashes, a.multiline), not a.refresh
    )
    nodes = readers.read_layer(spark, a.nodes, schemas.NODES)
    edges = readers.read_layer(spark, a.edges, schemas.STREET_EDGES)
    near = ranking.place_nodes(crashes, nodes)
    table = ranking.intersection_rankings(crashes, nodes, edges, a.as_of, n=a.top, near=near)
    readers.write_csv(table, f"{a.out}/rankings")
    readers.write_csv(ranking.crash_to_node_map(crashes, nodes, near=near), f"{a.out}/crash_to_node")


def flags(spark: SparkSession, a: argparse.Namespace) -> None:
    ranked = readers.read_csv(spark, a.rankings, schemas.RANKINGS)
    if a.rejects:
        read = variants.read_variant_layers(spark, a.layers, a.multiline)
        readers.write_parquet(variants.reject_table(read), f"{a.out}/rejects")
        targets = {flag: layer.targets for flag, layer in read.items()}
    else:
        targets = layers.read_layers(spark, a.layers, a.multiline)
    readers.write_csv(flag_table(ranked, targets), f"{a.out}/flags")


def causes_(spark: SparkSession, a: argparse.Namespace) -> None:
    crashes = readers.read_through(
        spark, f"{a.out}/crashes", lambda: readers.read_crash_pages(spark, a.crashes, a.multiline), not a.refresh
    )
    node_map = readers.read_csv(spark, a.node_map, schemas.CRASH_TO_NODE)
    ranked = readers.read_csv(spark, a.rankings, schemas.RANKINGS)
    table = causes.training_table(causes.crashes_at_nodes(crashes, node_map))
    settings = TreeSettings(trees=a.trees, depth=a.depth, rate=a.rate, kind=a.kind)
    run = causes.run_model(table, settings, held_out=a.held_out)
    readers.write_csv(causes.ranked_predictions(run.predictions, ranked), f"{a.out}/predictions")
    readers.write_csv(run.quality(), f"{a.out}/quality")
    readers.write_csv(run.confusion(), f"{a.out}/confusion")
    run.model.save(f"{a.out}/model")


def compare(spark: SparkSession, a: argparse.Namespace) -> None:
    crashes = readers.read_crash_pages(spark, a.crashes, a.multiline)
    node_map = readers.read_csv(spark, a.node_map, schemas.CRASH_TO_NODE)
    table = causes.training_table(causes.crashes_at_nodes(crashes, node_map))
    settings = [TreeSettings(trees=t, depth=d, rate=r, kind=a.kind) for t in a.trees for d in a.depth for r in a.rate]
    scores = stage_table(sweep.score_settings(table, settings), "setting_scores")
    readers.write_csv(scores, f"{a.out}/setting_scores")
    readers.write_csv(sweep.best_first(scores), f"{a.out}/settings")


def score(spark: SparkSession, a: argparse.Namespace) -> None:
    crashes = readers.read_crash_pages(spark, a.crashes, a.multiline)
    node_map = readers.read_csv(spark, a.node_map, schemas.CRASH_TO_NODE)
    ranked = readers.read_csv(spark, a.rankings, schemas.RANKINGS)
    table = stage_table(causes.training_table(causes.crashes_at_nodes(crashes, node_map)), "score_table")
    run = causes.score_table(load_cause_model(spark, a.model), table)
    readers.write_csv(causes.ranked_predictions(run.predictions, ranked), f"{a.out}/scored")
    readers.write_csv(run.quality(), f"{a.out}/scored_quality")


def _corpus(spark: SparkSession, a: argparse.Namespace):
    return recommend.corpus_texts(readers.read_csv(spark, a.corpus, schemas.CORPUS))


def _predictions(spark: SparkSession, a: argparse.Namespace):
    return readers.read_csv(spark, a.predictions, schemas.PREDICTIONS)


def index(spark: SparkSession, a: argparse.Namespace) -> None:
    text_index.build_index(_corpus(spark, a).dropna(subset=["doc_id"]), f"{a.out}/index")


def _index(spark: SparkSession, a: argparse.Namespace) -> text_index.TextIndex | None:
    return text_index.open_index(spark, a.index) if a.index else None


def recommend_(spark: SparkSession, a: argparse.Namespace) -> None:
    ranked = readers.read_csv(spark, a.rankings, schemas.RANKINGS)
    chosen = recommend.recommend_for_causes(_predictions(spark, a), _corpus(spark, a), index=_index(spark, a))
    readers.write_csv(recommend.master_table(ranked, chosen), f"{a.out}/master")


def fixes(spark: SparkSession, a: argparse.Namespace) -> None:
    flagged = readers.read_csv(spark, a.flags, schemas.FLAGGED)
    table = recommend.flag_fixes(flagged, _predictions(spark, a), _corpus(spark, a), index=_index(spark, a))
    readers.write_csv(table, f"{a.out}/fixes")


def evaluate(spark: SparkSession, a: argparse.Namespace) -> None:
    truth = readers.read_csv(spark, a.truth, schemas.TRUTH)
    found = recommend.evaluate_causes(_predictions(spark, a), _corpus(spark, a), truth, index=_index(spark, a))
    table = stage_table(found, "quality")
    readers.write_csv(table, f"{a.out}/precision")


def streets(spark: SparkSession, a: argparse.Namespace) -> None:
    crashes = readers.read_crash_csv(spark, a.crashes)
    lines = readers.read_layer(spark, a.centerlines, schemas.CENTERLINES)
    targets = polyline_targets(lines, "coordinates", "stname_lab")
    near = nearest_any(places(crashes, "latitude", "longitude"), targets, "stname_lab", a.start)
    readers.write_parquet(join_back(crashes, near, "latitude", "longitude", "distance"), f"{a.out}/streets")


def ingest(spark: SparkSession, a: argparse.Namespace) -> None:
    paths = (a.crashes, f"{a.out}/ingested", f"{a.out}/ingested-state")
    if a.delay:
        ingest_distinct(spark, *paths, delay=a.delay, multiline=a.multiline).awaitTermination()
    else:
        ingest_pages(spark, *paths, multiline=a.multiline).awaitTermination()


def track(spark: SparkSession, a: argparse.Namespace) -> None:
    nodes = readers.read_layer(spark, a.nodes, schemas.NODES)
    sums.track_sums(spark, a.crashes, f"{a.out}/sums", nodes, a.as_of, multiline=a.multiline).awaitTermination()
    if a.compact:
        sums.compact(spark, f"{a.out}/sums")
    readers.write_csv(sums.ranked_sums(spark, f"{a.out}/sums", a.as_of, a.top), f"{a.out}/tracked_rankings")


JOBS = {
    "ingest": (ingest, ["crashes"]),
    "track": (track, ["crashes", "nodes"]),
    "rank": (rank, ["crashes", "nodes", "edges"]),
    "flags": (flags, ["rankings", "layers"]),
    "causes": (causes_, ["crashes", "node_map", "rankings"]),
    "compare": (compare, ["crashes", "node_map"]),
    "score": (score, ["crashes", "node_map", "rankings", "model"]),
    "index": (index, ["corpus"]),
    "recommend": (recommend_, ["rankings", "predictions", "corpus"]),
    "fixes": (fixes, ["flags", "predictions", "corpus"]),
    "evaluate": (evaluate, ["predictions", "corpus", "truth"]),
    "streets": (streets, ["crashes", "centerlines"]),
}


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    jobs = top.add_subparsers(dest="job", required=True)
    for name, (_, inputs) in JOBS.items():
        job = jobs.add_parser(name)
        for path in inputs:
            job.add_argument("--" + path.replace("_", "-"), required=True)
        job.add_argument("--out", required=True)
        if name in ("ingest", "track", "rank", "flags", "causes", "compare", "score"):
            job.add_argument("--multiline", action="store_true", help="each page is one JSON array")
        if name in ("rank", "causes"):
            job.add_argument("--refresh", action="store_true", help="do not use the cached crashes")
        if name in ("recommend", "fixes", "evaluate"):
            job.add_argument("--index", help="folder that the index job wrote for this corpus")
        if name == "flags":
            job.add_argument("--rejects", action="store_true", help="read records of any kind and write those that are no target, with the reason")
        if name == "ingest":
            job.add_argument("--delay", help="records that land again within this time count once, such as '7 days'")
        if name == "track":
            job.add_argument("--compact", action="store_true", help="fold the batches into one")
        if name in ("rank", "track"):
            job.add_argument("--as-of", default=date.today().isoformat())
            job.add_argument("--top", type=int, default=ranking.TOP_N)
        if name == "causes":
            defaults = TreeSettings()
            job.add_argument("--trees", type=int, default=defaults.trees)
            job.add_argument("--depth", type=int, default=defaults.depth)
            job.add_argument("--rate", type=float, default=defaults.rate)
            job.add_argument("--kind", choices=["boosted", "forest"], default=defaults.kind)
            job.add_argument("--held-out", action="store_true")
        if name == "compare":
            defaults = TreeSettings()
            for option, kind in (("trees", int), ("depth", int), ("rate", float)):
                job.add_argument(f"--{option}", type=kind, nargs="+", default=[getattr(defaults, option)])
            job.add_argument("--kind", choices=["boosted", "forest"], default="forest")
        if name == "streets":
            job.add_argument("--start", type=float, default=50.0, help="first search radius in metres")
    return top


def main(args: list[str] | None = None) -> None:
    parsed = parser().parse_args(args)
    spark = get_spark(f"snapgrid-{parsed.job}")
    try:
        JOBS[parsed.job][0](spark, parsed)
    finally:
        drop_stage_tables(spark)


if __name__ == "__main__":
    main()
