"""Session defaults, and jobs that can be cancelled from elsewhere."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession


def get_session(app: str = "quillworks", master: str | None = None) -> SparkSession:
    """A session with the settings the operators assume (UTC, AQE, Arrow)."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    return (
        b.config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


@contextmanager
def cancellable(spark: SparkSession, tag: str) -> Iterator[None]:
    """Actions inside carry the tag; ``cancel`` from another thread ends them with an error, between and within stages."""
    sc = spark.sparkContext
    sc.addJobTag(tag)
    try:
        yield
    finally:
        sc.removeJobTag(tag)


def cancel(spark: SparkSession, tag: str) -> None:
    spark.sparkContext.cancelJobsWithTag(tag)
