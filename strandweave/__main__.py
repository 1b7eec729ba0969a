"""Command line: ``python -m strandweave thorough|simulate``."""

from __future__ import annotations

import argparse
from dataclasses import fields

from . import __version__


def main(argv: list[str] | None = None) -> int:
    from pyspark.sql import SparkSession

    from .plans.thorough import Options, simulate, thorough

    top = argparse.ArgumentParser(prog="strandweave")
    top.add_argument("--version", action="version", version=__version__)
    sub = top.add_subparsers(dest="command", required=True)
    t = sub.add_parser("thorough", help="estimate variants and their proportions")
    for f in fields(Options):
        flag = "--" + f.name.replace("_", "-")
        if isinstance(f.default, bool):
            t.add_argument(flag, action="store_true")
        elif f.name == "graph_component":
            t.add_argument(flag, default="0", help="place of the component by weight, or first,last")
        else:
            kind = type(f.default) if f.default is not None else str
            t.add_argument(flag, type=kind, default=f.default, required=f.name in ("graph", "alignment", "output"))
    s = sub.add_parser("simulate", help="simulate error-free reads")
    for flag, kind, default in (("--graph", str, None), ("--variants", str, None), ("--proportions", str, None), ("--lengths", str, "ont"), ("--bases", int, 1_000_000), ("--gaf", str, None), ("--fasta", str, None), ("--seed", int, 12345)):
        s.add_argument(flag, type=kind, default=default, required=flag in ("--graph", "--variants", "--proportions"))
    a = top.parse_args(argv)
    spark = SparkSession.builder.appName("strandweave").getOrCreate()
    if a.command == "thorough":
        given = {f.name: getattr(a, f.name) for f in fields(Options)}
        place = [int(x) for x in given["graph_component"].split(",")]
        given["graph_component"] = (place[0], place[1] if len(place) > 1 else None)
        r = thorough(spark, Options(**given))
        for c, p in sorted(r.props.items()):
            print(f"{c}\t{p:.6f}")
    else:
        simulate(spark, a.graph, a.variants, [float(x) for x in a.proportions.split(",")], a.lengths, a.bases, a.gaf, a.fasta, a.seed)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
