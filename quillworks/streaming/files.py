"""The same extraction over files that keep arriving: stateless, so any trigger and restart will do."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillworks.options import ExtractOptions
from quillworks.plans.extract import extract
from quillworks.plans.registry import Registry

FILE = "path string, modificationTime timestamp, length bigint, content binary"


def extract_stream(spark: SparkSession, path: str, options: ExtractOptions = ExtractOptions(), registry: Registry = Registry(), files_per_trigger: int = 1000) -> DataFrame:
    files = spark.readStream.format("binaryFile").schema(FILE).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_per_trigger).load(path)
    return extract(files.select("path", "content"), "content", "path", "path", options, registry)
