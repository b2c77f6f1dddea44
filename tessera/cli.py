"""Command line: runs counting methods over an edge-list file, prints a report, and writes results.

    python -m tessera.cli graph.txt.gz --run exact,hybrid --threshold 64 --json-out result.json
"""

from __future__ import annotations

import argparse
import json
import sys
import time
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import SparkSession

from .operators import graph, hybrid, sketches, triangles
from .plans import report
from .sources import edges as sources

PROFILES = {"S": sketches.S, "C": sketches.C, "X": sketches.X}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tessera", description="Triangle counts of an edge list: exact, sampled, by sketches, and routed between them.")
    p.add_argument("edge_list", nargs="?", help="text or gzip file (or folder of them), two node labels a line")
    p.add_argument("--run", default="exact,pure,hybrid", help=f"methods, comma-separated: {','.join(report.METHODS)}")
    p.add_argument("--precision", type=int, default=10, help="2**precision registers a sketch")
    p.add_argument("--threshold", type=int, default=64, help="routing cost from which edges go to sketches")
    p.add_argument("--sample", type=float, default=0.1, help="share of edges that the sampled count keeps")
    p.add_argument("--seed", type=int, default=1, help="seed of the sketches' hash (profile C)")
    p.add_argument("--profile", choices=sorted(PROFILES), default="C", help="how sketches are made and used")
    p.add_argument("--truth", type=int, help="known number of triangles; else the exact count, where it is run")
    p.add_argument("--delimiter", help="field delimiter; white space if not given")
    p.add_argument("--comments", default="#%", help="characters that begin a comment line")
    p.add_argument("--no-remap", action="store_true", help="ids are integers; else any labels are taken")
    p.add_argument("--one-indexed", action="store_true", help="with --no-remap, ids count from 1")
    p.add_argument("--assume-simple", action="store_true", help="no edge is repeated: skip the removal of repeats")
    p.add_argument("--partitions", type=int, help="deal the lines out again; for a single gzip file")
    p.add_argument("--max-sketch-gb", type=float, default=8.0, help="refuse sketches of more than this in all")
    p.add_argument("--repeat", type=int, default=1, help="timed runs of each method")
    p.add_argument("--warmup", type=int, default=0, help="runs of each method that are not timed")
    p.add_argument("--sweep", help="thresholds, comma-separated: time strategies instead of the methods of --run")
    p.add_argument("--json-out", type=Path, help="write settings, facts of the graph and results as JSON")
    p.add_argument("--csv-out", type=Path, help="write the rows as CSV")
    p.add_argument("--self-test", action="store_true", help="count a small known graph, exactly and routed")
    return p


def self_test(spark: SparkSession) -> str:
    """Raise unless the known graph has its four triangles, counted exactly and by the routed count without sketches."""
    fwd = graph.orient(sources.self_test_graph(spark)).persist()
    exact, routed = triangles.count(fwd).first().triangles, hybrid.hybrid(fwd, 10**9, 8, sketches.C, most_gb=1.0).first()
    fwd.unpersist()
    if exact != 4 or routed.total != 4 or routed.n_approx:
        raise AssertionError(f"self-test failed: exact={exact}, routed={routed.total}, edges by sketches={routed.n_approx}")
    return f"self-test passed: exact={exact}, all-exact hybrid={routed.total:.0f}"


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> int:
    p = parser()
    a = p.parse_args(argv)
    run = {x.strip() for x in a.run.split(",") if x.strip()}
    try:
        report.validate(run, a.precision, a.threshold)
        gammas = [int(x) for x in a.sweep.split(",")] if a.sweep else []
    except ValueError as wrong:
        p.error(str(wrong))
    if a.one_indexed and not a.no_remap:
        p.error("--one-indexed needs --no-remap")
    if not a.edge_list and not a.self_test:
        p.error("an edge list or --self-test is needed")
    spark = spark or SparkSession.builder.appName("tessera").getOrCreate()
    if a.self_test:
        print(self_test(spark))
        if not a.edge_list:
            return 0
    began = time.perf_counter()
    edges = sources.read_edges(spark, a.edge_list, a.delimiter, a.comments, not a.no_remap, a.one_indexed, not a.assume_simple, a.partitions).persist()
    count = edges.count()
    load = time.perf_counter() - began
    try:
        if gammas:
            rows = report.timings(edges, gammas, a.precision, PROFILES[a.profile], a.repeat, a.warmup)
        else:
            rows = report.experiment(edges, run, a.precision, a.threshold, a.sample, PROFILES[a.profile], a.truth, a.repeat, a.warmup, a.seed, a.max_sketch_gb)
        print(f"edges: {count}  load seconds: {load:.3f}")
        print(report.console(rows if gammas else report.printable(rows)))
        if a.json_out:
            source = "given" if a.truth is not None else "exact" if "exact" in run else None
            settings = {k: str(v) if isinstance(v, Path) else v for k, v in vars(a).items()}
            found = report.document(edges, rows, settings=settings, truth=a.truth, truth_source=source, load_seconds=load)
            a.json_out.write_text(json.dumps(found, indent=2) + "\n")
        if a.csv_out:
            rows.toPandas().to_csv(a.csv_out, index=False)
    except MemoryError as wrong:
        print(f"error: {wrong}", file=sys.stderr)
        return 1
    finally:
        edges.unpersist()
    return 0


if __name__ == "__main__":
    sys.exit(main())
