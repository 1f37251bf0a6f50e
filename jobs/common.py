"""What both jobs share: a config file read through Spark, a lexicon from it, the command line's session, logging."""

from __future__ import annotations

import argparse
import json
import logging

from pyspark.sql import SparkSession

from textloom.plans.lexicon import Lexicon

log = logging.getLogger("textloom.jobs")


def read_config(spark: SparkSession, path: str) -> dict:
    """A small JSON object; the path may be remote."""
    return json.loads("\n".join(r.value for r in spark.read.text(path, wholetext=True).collect()))


def lexicon(given: dict) -> Lexicon:
    """Term lists and thresholds by name; what is not given is as in the default domain."""
    return Lexicon(**{k: tuple(v) if isinstance(v, list) else v for k, v in given.items()})


def arguments(about: str, *names: str) -> argparse.Namespace:
    parser = argparse.ArgumentParser(description=about)
    for name in ("config", *names):
        parser.add_argument(f"--{name}", required=True, help="a path that Spark can read or write")
    return parser.parse_args()


def session(name: str) -> SparkSession:
    """For the command line only, which stops it. Batches to Python are bounded in bytes."""
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    return SparkSession.builder.appName(name).config("spark.sql.execution.arrow.maxBytesPerBatch", "4m").getOrCreate()
