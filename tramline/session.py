"""Session defaults."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

#: Chosen for a cluster: AQE re-plans joins and partition counts at run time; times are UTC.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(app: str = "tramline", **conf: str) -> SparkSession:
    """A session with the defaults above; conf overrides them."""
    builder = SparkSession.builder.appName(app)
    for key, value in (DEFAULTS | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def local_session(cores: int | None = None, **conf: str) -> SparkSession:
    """A local session for tests and the bench."""
    cores = cores or os.cpu_count() or 4
    extra = {"spark.master": f"local[{cores}]", "spark.sql.shuffle.partitions": str(cores), "spark.ui.enabled": "false"}
    return build_session(**(extra | conf))
