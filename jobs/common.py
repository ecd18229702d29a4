"""What the jobs share: config files, the command line, tables that may not be there yet."""

from __future__ import annotations

import argparse
import json
import logging
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from fathom.operators.store import prepared


def read_or_none(spark: SparkSession, path: str, schema: str) -> DataFrame | None:
    """A Parquet folder, or None before anything was written to it."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own under spark.checkpoint.dir (or, where that is unset, the context's checkpoint folder)."""
    prepared(spark)
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def main(name: str, about: str, run: Callable[..., dict], argv: list[str] | None = None) -> None:
    """``--config FILE`` gives the arguments of ``run``; ``key=value`` on the command line goes before it."""
    p = argparse.ArgumentParser(prog=name, description=about)
    p.add_argument("--config", help="JSON file of arguments")
    p.add_argument("arguments", nargs="*", metavar="key=value")
    a = p.parse_args(argv)
    given = {}
    if a.config:
        with open(a.config) as f:
            given = json.load(f)
    for pair in a.arguments:
        key, _, value = pair.partition("=")
        given[key] = int(value) if value.isdigit() else value
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName(name).getOrCreate()
    try:
        print(json.dumps(run(spark, **given)))
    finally:
        spark.stop()
