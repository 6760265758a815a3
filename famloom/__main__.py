"""Command line: ``python -m famloom SEQNAMES ALIGNMENTS OUT``."""

from __future__ import annotations

import argparse
import logging

from pyspark.sql import SparkSession

from famloom import __version__
from famloom.config import MODES, Config
from famloom.operators.graph import clean
from famloom.plans.pipeline import run, stage_counts
from famloom.ship import ship
from famloom.sources.alignments import read_blast, read_dictionary, read_msps
from famloom.sources.reports import snapshot, write_reports


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="famloom", description="Cluster pairwise interval alignments into families.")
    parser.add_argument("seqnames", help="sequence list: a count, then names")
    parser.add_argument("alignments", help="text alignments: a file, a folder or a pattern")
    parser.add_argument("--format", choices=("msp", "blast"), default="msp", help="alignment lines, or text reports")
    parser.add_argument("out", help="folder for reports and tables")
    parser.add_argument("--mode", choices=MODES, default="original")
    parser.add_argument("--method", choices=("single", "double"), default="single")
    parser.add_argument("--cutoff", type=float, default=None)
    parser.add_argument("-v", "--version", action="version", version=__version__)
    parser.add_argument("-l", "--log-level", default="WARNING", choices=("DEBUG", "INFO", "WARNING", "ERROR"))
    parser.add_argument("--stages", default=None, help="folder for finished stages; a run that failed goes on from there")
    args = parser.parse_args(argv)
    logging.basicConfig(level=args.log_level)
    spark = SparkSession.builder.appName("famloom").getOrCreate()
    ship(spark)
    read = read_blast if args.format == "blast" else read_msps
    msps = read(spark, args.alignments, read_dictionary(spark, args.seqnames))
    result = run(msps, Config(mode=args.mode, method=args.method, cutoff=args.cutoff), args.stages)
    write_reports(result, f"{args.out}/reports")
    snapshot(result, f"{args.out}/tables")
    for r in stage_counts(result).collect():
        logging.getLogger("famloom").info("%s %d", r["name"], r["n"])
    clean(spark)


if __name__ == "__main__":
    main()
