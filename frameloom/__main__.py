"""Command line: ``python -m frameloom modules | schemas | validate | run | inspect``."""

from __future__ import annotations

import argparse
import datetime
import json
import sys
from pathlib import Path

from frameloom.plans.checks import issues
from frameloom.plans.compile import KINDS, compile_graph
from frameloom.plans.graph import GraphError, read_graph


def _session():
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName("frameloom").getOrCreate()


def _validate(path: str) -> int:
    try:
        found = issues(read_graph(Path(path).read_text(), KINDS))
    except GraphError as e:
        found = [("graph", str(e))]
    for code, subject in found:
        print(f"{code}: {subject}")
    print("invalid" if found else "valid")
    return int(bool(found))


def _run(args: argparse.Namespace) -> int:
    from frameloom.operators import sinks
    from frameloom.plans.binding import Store
    from frameloom.sources.frames import folder_frames

    spark = _session()
    sources = {}
    for spec in args.source:
        node, _, path = spec.partition("=")
        parquet = path.endswith(".parquet")
        sources[node] = spark.read.parquet(path) if parquet else folder_frames(spark, path)
    run = compile_graph(Path(args.graph).read_text(), sources, cycles=args.cycles, store=Store(args.store))
    stamp = datetime.datetime.now(datetime.UTC).strftime("%Y%m%d-%H%M%S-%f")[:-3]
    for node, port in run.sink_ports.items():
        prefix = run.graph.node(node).config.get("sessionPrefix", node)
        sinks.write_session(run.frame, port, f"{args.out}/{prefix}-{stamp}")
    print(json.dumps(run.report().first().asDict()))
    return 0


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="frameloom", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("modules", help="known modules and their kinds")
    commands.add_parser("schemas", help="the frame schema as JSON")
    commands.add_parser("validate", help="check a graph").add_argument("graph")
    run = commands.add_parser("run", help="run a graph over folders or tables of frames")
    run.add_argument("graph")
    run.add_argument("--source", action="append", default=[], metavar="NODE=PATH")
    run.add_argument("--out", default="out")
    run.add_argument("--cycles", type=int, default=0)
    run.add_argument("--store", help="JSON file of binding values")
    commands.add_parser("inspect", help="frames of a session by camera").add_argument("session")
    args = parser.parse_args(argv)
    if args.command == "modules":
        for name, kind in sorted(KINDS.items()):
            print(f"{name}\t{kind}")
        return 0
    if args.command == "validate":
        return _validate(args.graph)
    if args.command == "run":
        return _run(args)
    spark = _session()
    if args.command == "schemas":
        from frameloom.sources.frames import FRAME

        print(spark.createDataFrame([], FRAME).schema.json())
        return 0
    from frameloom.operators.sinks import per_camera

    for row in per_camera(spark.read.parquet(args.session)).orderBy("camera_id").toLocalIterator():
        print(f"{row.camera_id}\t{row.frames}")
    return 0


if __name__ == "__main__":
    sys.exit(main())
