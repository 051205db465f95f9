"""What the jobs share: options from a config file, row counts in the log, the session of a command line."""

from __future__ import annotations

import argparse
import logging
import sys
from collections.abc import Callable
from dataclasses import fields

from pyspark.sql import SparkSession

log = logging.getLogger("jobs")


def options_of(spark: SparkSession, kind: type, path: str | None):
    """An options dataclass from a JSON file that Spark can read (one object); without one its defaults. An unknown name is an error."""
    if not path:
        return kind()
    found = spark.read.option("multiLine", True).json(path).first().asDict()
    unknown = set(found) - {f.name for f in fields(kind)}
    if unknown:
        raise ValueError(f"{path}: unknown options {sorted(unknown)}")
    return kind(**{k: tuple(v) if isinstance(v, list) else v for k, v in found.items() if v is not None})


def command_line(kind: type, run: Callable, paths: dict[str, str], argv: list[str] | None = None) -> None:
    """Runs run(spark, *paths, options) in a session of its own. paths: what each path argument means."""
    parser = argparse.ArgumentParser(description=sys.modules[kind.__module__].__doc__)
    for name, text in paths.items():
        parser.add_argument(f"--{name}", required=True, help=text)
    parser.add_argument("--config", help="JSON file of options")
    args = parser.parse_args(argv)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    logging.getLogger("py4j").setLevel(logging.WARNING)
    spark = SparkSession.builder.appName(kind.__module__).config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        run(spark, *[getattr(args, name) for name in paths], options_of(spark, kind, args.config))
    finally:
        spark.stop()
