"""The folder that driver and executors share, and frames written there."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where the session names none, a new local one in local mode; an error on a cluster."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = f"file://{tempfile.mkdtemp(prefix='shared-')}"
        spark.sparkContext.setCheckpointDir(root)
    return root


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder (URI) below the shared root. A local or mounted one is removed when the driver ends."""
    uri = f"{shared_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    system, path = open_fs(uri)
    system.create_dir(path, recursive=True)
    if isinstance(system, pafs.LocalFileSystem):
        atexit.register(shutil.rmtree, path, ignore_errors=True)
    return uri


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a URI, on the driver or a worker."""
    if uri.startswith("s3a://"):
        uri = "s3://" + uri[6:]
    if "://" not in uri and not uri.startswith("file:"):
        return pafs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return pafs.FileSystem.from_uri(uri)


def stored(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Write a frame to the shared folder and read it again: cuts lineage and survives lost executors."""
    uri = shared_dir(spark, name)
    df.write.mode("overwrite").parquet(f"{uri}/t")
    return spark.read.schema(df.schema).parquet(f"{uri}/t")
