"""Document texts: from files by Spark's binary reader, with the rules of what counts as text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import metadata
from ..operators.entries import name_of
from . import fstree

MOST_READ = 4 << 20


def read(spark: SparkSession, folder: str, glob: str | None = None) -> DataFrame:
    """(path, size, mtime, text) of the text files below a folder; in a local tree, without what links lead to."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    rows = (files.option("pathGlobFilter", glob) if glob else files).load(folder)
    path = F.regexp_replace("path", "^[a-z]+:(//[^/]*)?", "")
    if "://" not in folder:
        fstree.register(spark)
        plain = spark.read.format("fstree").option("root", folder).load().where("NOT is_dir AND NOT is_link").select("path")
        rows = rows.withColumn("path", path).join(plain, "path", "left_semi")
    named = rows.select(path.alias("path"), F.col("length").alias("size"), F.unix_timestamp("modificationTime").alias("mtime"), "content")
    return eligible(named.withColumn("content", F.substring("content", 1, MOST_READ))).select("path", "size", "mtime", F.col("content").cast("string").alias("text"))


def eligible(files: DataFrame) -> DataFrame:
    """Files (path, size, content) worth indexing: by name and size, and without zero bytes near their start."""
    return files.where(metadata.text_file(name_of(F.col("path")), F.col("size"))).where(~metadata.looks_binary(F.col("content")))
