"""What both jobs share: settings, the command line, the log."""

from __future__ import annotations

import argparse
import logging
import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

LOG = logging.getLogger("jobs")


def settings(spark: SparkSession, path: str, defaults: dict) -> dict:
    """The defaults, and what a small JSON file says instead; the file may be remote. Names that are not among the defaults are an error."""
    row = spark.read.json(path, multiLine=True).first()
    found = {k: v for k, v in row.asDict().items() if v is not None} if row else {}
    unknown = sorted(set(found) - set(defaults))
    if unknown:
        raise ValueError(f"unknown settings in {path}: {', '.join(unknown)}")
    return defaults | found


def command(job: Callable[..., DataFrame], defaults: dict, about: str, argv: list[str] | None = None) -> None:
    """Run a job once in a session of its own: --documents, --output, and --config for what differs from the defaults."""
    parser = argparse.ArgumentParser(description=about)
    parser.add_argument("--documents", required=True, help="the table of documents (Parquet)")
    parser.add_argument("--output", required=True, help="the folder of the job, the same for every run")
    parser.add_argument("--config", help="a JSON file of settings")
    asked = parser.parse_args(argv)
    logging.basicConfig(stream=sys.stderr, level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName(job.__module__).getOrCreate()
    try:
        job(spark, asked.documents, asked.output, settings(spark, asked.config, defaults) if asked.config else defaults)
    finally:
        spark.stop()
