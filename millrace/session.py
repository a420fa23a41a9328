"""Session settings that the engine relies on."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Dates are read and shown in UTC; overflow and bad casts raise.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(master: str = "local[*]", app: str = "millrace", **conf: str) -> SparkSession:
    """A session with SETTINGS; ``conf`` keys use ``__`` for dots."""
    builder = SparkSession.builder.master(master).appName(app)
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()
