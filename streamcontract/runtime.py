"""Session helpers."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def prepare(spark: SparkSession) -> SparkSession:
    """Lets Python workers import this package from where the driver has it."""
    env = spark.sparkContext.environment
    paths = [x for x in env.get("PYTHONPATH", "").split(os.pathsep) if x]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([*paths, ROOT])
    return spark


def session(name: str = "streamcontract", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings that the operators expect: UTC, adaptive execution."""
    b = SparkSession.builder.appName(name)
    if master:
        b = b.master(master)
    conf = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true"} | conf
    return prepare(b.config(map=conf).getOrCreate())
