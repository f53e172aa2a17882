"""Command line: build indexes from tables, and compare two.

    python -m volumetra.cli build-synapses EDGES OUT [--population NAME]
    python -m volumetra.cli build-morphology NODES LIBRARY CENTRES OUT [--population NAME]
    python -m volumetra.cli build-morphology-swc NODES FOLDER OUT [--population NAME]
    python -m volumetra.cli build-circuit segments|synapses CONFIG OUT [--populations NAME ...]
    python -m volumetra.cli compare LEFT RIGHT
"""

from __future__ import annotations

import argparse
import logging
import os
import sys

from pyspark.sql import SparkSession

from .operators.compare import likely_same
from .plans.layout import open_index, write, write_populations
from .sources import builders
from .sources.swc import read_swc


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    logging.basicConfig(level=os.environ.get("VOLUMETRA_LOG", "WARNING").upper())
    parser = argparse.ArgumentParser(prog="volumetra")
    commands = parser.add_subparsers(dest="command", required=True)
    for name, places in (("build-synapses", ["edges"]), ("build-morphology", ["nodes", "library", "centres"]), ("build-morphology-swc", ["nodes", "folder"])):
        p = commands.add_parser(name)
        for place in [*places, "out"]:
            p.add_argument(place)
        p.add_argument("--population")
    p = commands.add_parser("build-circuit")
    p.add_argument("kind", choices=["segments", "synapses"])
    p.add_argument("config")
    p.add_argument("out")
    p.add_argument("--populations", nargs="*")
    p = commands.add_parser("compare")
    p.add_argument("left")
    p.add_argument("right")
    a = parser.parse_args(args)
    spark = spark or SparkSession.builder.appName("volumetra").getOrCreate()
    read = spark.read.parquet
    match a.command:
        case "build-synapses":
            write(builders.synapses_from_edges(read(a.edges), a.population), a.out)
        case "build-morphology":
            write(builders.morphologies_from_nodes(read(a.nodes), read(a.library), read(a.centres), a.population), a.out)
        case "build-morphology-swc":
            write(builders.morphologies_from_nodes(read(a.nodes), *read_swc(spark, a.folder), a.population), a.out)
        case "build-circuit":
            found = builders.circuit_populations(spark, a.config, a.kind)
            names = a.populations or list(found)
            for name in names:
                own = found[name]
                index = builders.synapses_from_edges(read(own["file"]), name) if a.kind == "synapses" else builders.morphologies_from_nodes(read(own["file"]), read(own["library"]), read(own["centres"]), name)
                write(index, f"{a.out}/{name}")
            write_populations(spark, a.out, {n: n for n in names})
        case "compare":
            return 0 if likely_same(open_index(spark, a.left), open_index(spark, a.right)) else -1
    return 0


if __name__ == "__main__":
    sys.exit(main())
