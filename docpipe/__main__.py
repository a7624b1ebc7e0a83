"""python -m docpipe INPUT... : files and folders to Markdown, text, JSON or chunks.

Documents go to stdout or below --output; whatever else is said goes to stderr. Exit codes: 0 done,
1 an input failed, 2 wrong usage, 4 no text, 5 no supported format; the first failure decides, or
the first skip if nothing was extracted.
"""

from __future__ import annotations

import argparse
import sys
from collections.abc import Sequence
from typing import TextIO

QUIET, NORMAL, VERBOSE, DEBUG = range(4)


class Log:
    """Errors always, warnings and progress unless quiet, details from -v on."""

    def __init__(self, level: int, to: TextIO):
        self.level, self.to = level, to

    def say(self, least: int, text: str) -> None:
        if self.level >= least:
            print(text, file=self.to)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("docpipe", description="Documents of many formats to Markdown, text, JSON or retrieval chunks.", allow_abbrev=False)
    p.add_argument("inputs", nargs="+", metavar="INPUT", help="files, or folders together with --recursive")
    p.add_argument("--format", choices=("md", "json", "text"), default="md")
    p.add_argument("-o", "--output", metavar="PATH", help="a file for a single input, else a folder; stdout if absent")
    p.add_argument("--recursive", action="store_true", help="read folders, and mirror their trees below --output")
    p.add_argument("--manifest", metavar="PATH", help="a JSON report with a status for each input")
    p.add_argument("--pages", metavar="RANGE", help="pages of paginated formats: 3, 1-10 or 2-")
    p.add_argument("--metadata", action="store_true", help="put metadata in front as YAML")
    p.add_argument("--chunk", nargs="?", type=_count, const=800, metavar="SIZE", help="cut into chunks of about SIZE characters (800)")
    p.add_argument("--chunk-overlap", type=_count, metavar="N", help="characters that neighbouring chunks share")
    p.add_argument("--ocr", action="store_true", help="not in the command: pass ocr= to docpipe.plans.api.run_batch")
    level = p.add_mutually_exclusive_group()
    level.add_argument("-q", "--quiet", action="store_true", help="errors only")
    level.add_argument("-v", "--verbose", action="count", default=0, help="more; twice for Spark's own log too")
    return p


def _count(said: str) -> int:
    if not (said.isascii() and said.isdigit()):
        raise argparse.ArgumentTypeError(f"not a number: {said!r}")
    return int(said)


def usage(argv: Sequence[str] | None = None) -> argparse.Namespace:
    """The arguments; wrong usage ends with exit code 2 before anything is read."""
    from .sources.formats import page_range

    p = parser()
    args = p.parse_args(argv)
    if args.chunk_overlap is not None and args.chunk is None:
        p.error("--chunk-overlap needs --chunk")
    if args.ocr:
        p.error("this command has no text recognition; give a function as ocr= to docpipe.plans.api.run_batch")
    if args.pages is not None:
        try:
            page_range(args.pages)
        except ValueError as e:
            p.error(str(e))
    args.level = QUIET if args.quiet else min(DEBUG, NORMAL + args.verbose)
    return args


def run(spark, args: argparse.Namespace, out: TextIO, err: TextIO) -> int:
    from pyspark.sql import functions as F

    from .plans import api

    log = Log(args.level, err)
    done = api.run_batch(
        spark, args.inputs, args.output, args.format, args.metadata, args.recursive, args.pages, args.chunk, args.chunk_overlap or 0, args.manifest, printed=out,
    )
    n = done.extracted + done.skipped + done.failed
    if not n:
        log.say(NORMAL, "warning: nothing to extract")
    if args.output is None and n > 1:
        log.say(VERBOSE, "all documents go to stdout; --output DIR gives each a file")
    wanted = done.statuses if log.level >= NORMAL else done.statuses.where(F.col("counts_as") == "error")
    for row in wanted.orderBy("ord").toLocalIterator():
        why = f"{row['source']}: {row['message'] or row['reason']}"
        if row["counts_as"] == "error":
            log.say(QUIET, f"error: {why}")
        elif row["counts_as"] == "skipped":
            log.say(NORMAL, f"warning: skipped {why}")
        elif row["output"] is not None:
            log.say(NORMAL, f"{row['source']} -> {row['output']}")
        else:
            log.say(VERBOSE, f"{row['source']}: {row['format']}")
    if n > 1:
        log.say(NORMAL, done.summary)
    return done.exit_code


def main(argv: Sequence[str] | None = None) -> int:
    args = usage(argv)
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.appName("docpipe").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("INFO" if args.level == DEBUG else "ERROR")
    try:
        return run(spark, args, sys.stdout, sys.stderr)
    finally:
        spark.stop()


if __name__ == "__main__":
    sys.exit(main())
