"""File corpora as frames of path and content; sizes are checked before anything is read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quillworks.options import ExtractOptions
from quillworks.plans.extract import error, extract
from quillworks.plans.registry import Registry
from quillworks.schema import DOCUMENT


def read_files(spark: SparkSession, path: str | list[str], recursive: bool = True, glob: str | None = None) -> DataFrame:
    """``path, modificationTime, length, content`` of regular files."""
    r = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    return (r.option("pathGlobFilter", glob) if glob else r).load(path)


def extract_files(spark: SparkSession, path: str | list[str], options: ExtractOptions = ExtractOptions(), registry: Registry = Registry(), strict: bool = False, glob: str | None = None) -> DataFrame:
    """``path, length, document, error`` of each file.  The size limit goes down to the file listing."""
    files = read_files(spark, path, glob=glob)
    fits = files.filter(F.col("length") <= options.max_input_bytes).select("path", "length", "content")
    done = extract(fits, "content", "path", "path", options, registry, strict)
    large = files.filter(F.col("length") > options.max_input_bytes).select("path", "length")
    message = F.concat(F.lit("File is too large: "), F.col("length").cast("string"), F.lit(f" bytes, max: {options.max_input_bytes} bytes"))
    return done.unionByName(large.select("path", "length", F.lit(None).cast(DOCUMENT).alias("document"), error("fileTooLarge", message, actual_bytes=F.col("length"), max_bytes=F.lit(options.max_input_bytes)).alias("error")))


def write_documents(documents: DataFrame, path: str, format: str = "parquet", mode: str = "errorifexists") -> None:
    documents.write.mode(mode).format(format).save(path)
