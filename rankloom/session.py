"""Session settings shared by the command line, the tests and the bench."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def build_session(app: str = "rankloom", cores: str | int = "*", shuffle_partitions: int | None = None, master: str | None = None, **conf: str) -> SparkSession:
    """A UTC, adaptive session; ``conf`` adds or overrides settings.

    ``master`` is this machine's ``cores`` unless given, or left to spark-submit where that started the driver.

    Only tests and single-machine runs need it: on a cluster every function here takes the session it is given.
    """
    submitted = "PYSPARK_GATEWAY_PORT" in os.environ
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if master or not submitted:
        builder = builder.master(master or f"local[{cores}]")
    if not submitted and (master or "local").startswith("local"):
        builder = builder.config("spark.driver.host", "127.0.0.1")
    if shuffle_partitions is not None:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in conf.items():
        builder = builder.config(key, value)
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    return session
