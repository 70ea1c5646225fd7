"""Session defaults and the table loader."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Settings every batch job of this library relies on; all can be overridden by the cluster.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.ui.enabled": "false",
}


def session(master: str | None = None, **conf: str) -> SparkSession:
    """A session with the library's defaults; conf keys use ``__`` for dots."""
    builder = SparkSession.builder.appName("lodestack")
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table, read lazily so that filters and column lists reach the scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def share_package(spark: SparkSession) -> None:
    """Let Python workers of this machine find the package where it was not installed; a cluster installs it or ships it."""
    here, environment = str(Path(__file__).resolve().parent.parent), spark.sparkContext.environment
    known = environment.get("PYTHONPATH", "").split(":")
    if here not in known:
        environment["PYTHONPATH"] = ":".join([here, *filter(None, known)])
