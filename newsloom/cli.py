"""PIP-11: the command line, one run from keywords or URLs to outputs."""

from __future__ import annotations

import argparse
import sys
from dataclasses import fields

from pyspark.sql import SparkSession

from newsloom import config
from newsloom.plans import orchestrate

#: Sources that can be switched on, and what each needs beside itself.
SWITCHES = {"ddg": "search engine, by keywords", "newsapi": "news API, by keywords and with a key"}
#: Options of this engine's own, and those that stand for a setting of the same kind.
OWN = {
    "pages": {"metavar": "PATH", "help": "Parquet table (url, html) to take pages from instead of the network"},
    "search-transport": {"metavar": "MODULE:FUNCTION", "help": "how the search engine is asked (default: over HTTP; newsloom.sources.search:replay reads a table)"},
    "search-table": {"metavar": "PATH", "help": "table of results for the replay"},
    "out": {"metavar": "DIR", "default": "data", "help": "folder of the outputs"},
    "seen": {"action": "store_true", "help": "leave out URLs of earlier runs, and remember those of this one"},
}
# The public options with their defaults.
PUBLIC = {
    "lang": {"metavar": "CODE", "default": "en"},
    "min-body": {"metavar": "CHARS", "type": int, "default": 200},
    "workers": {"metavar": "N", "type": int, "default": next(f.default for f in fields(config.Settings) if f.name == "max_workers")},
    "max-results": {"metavar": "N", "type": int},
    "newsapi-key": {"metavar": "KEY"},
    "sources": {"metavar": "SOURCE_ID", "nargs": "+"},
    "from-date": {"metavar": "YYYY-MM-DD"},
    "to-date": {"metavar": "YYYY-MM-DD"},
}


def build_parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="newsloom", description="Acquire, clean and export news articles with Spark.")
    for name, what in (("urls", "article URLs"), ("keywords", "search keywords")):
        p.add_argument(f"-{name[0]}", f"--{name}", nargs="+", metavar=name[:-1].upper(), help=what)
    for name, what in SWITCHES.items():
        p.add_argument(f"--{name}", action="store_true", help=what)
    for name, spec in {**PUBLIC, **OWN}.items():
        p.add_argument(f"--{name}", **spec)
    return p


def missing(args: argparse.Namespace) -> str | None:
    """What keeps a run from having anything to fetch."""
    if args.urls:
        return None
    if not any(getattr(args, s) for s in SWITCHES):
        return "name URLs, or keywords and a source: " + ", ".join(f"--{s}" for s in SWITCHES)
    return None if args.keywords else "a source needs --keywords"


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = build_parser()
    args = parser.parse_args(argv)
    if problem := missing(args):
        parser.error(problem)
    spark = spark or SparkSession.builder.appName("newsloom").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    stats = orchestrate.run(spark, args, config.load())
    print(orchestrate.summary(stats))
    return 1 if stats["failed"] else 0


if __name__ == "__main__":
    sys.exit(main())
