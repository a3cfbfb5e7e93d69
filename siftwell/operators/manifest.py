"""Manifests: which parts of a folder make up a table. A version is a file of its own, written whole under its
final name and never changed; the newest one counts, so that readers never see half of a change."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import SparkSession

FORMAT = 1


class Conflict(RuntimeError):
    """Another writer published first, again and again."""


def new_name() -> str:
    return f"part-{uuid.uuid4().hex}"


def _files(spark: SparkSession, folder: str):
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/_manifest")
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path, jvm


def _versions(spark: SparkSession, folder: str) -> list[int]:
    fs, path, _ = _files(spark, folder)
    if not fs.exists(path):
        return []
    return sorted(int(n) for n in (s.getPath().getName() for s in fs.listStatus(path)) if n.isdigit())


def _text(spark: SparkSession, folder: str, version: int) -> str:
    fs, path, jvm = _files(spark, folder)
    src = fs.open(jvm.org.apache.hadoop.fs.Path(path, str(version)))
    try:
        return jvm.org.apache.commons.io.IOUtils.toString(src, "UTF-8")
    finally:
        src.close()


def read(spark: SparkSession, folder: str, build: str | None = None) -> list[dict]:
    """The parts of the newest version that can be read whole; none where the folder has no version, one of another
    format, or (with ``build``) one that belongs to another build."""
    for version in reversed(_versions(spark, folder)):
        try:
            found = json.loads(_text(spark, folder, version))
        except ValueError:
            continue  # left half-written by a store that shows files before they are closed
        if found.get("format") != FORMAT or build is not None and found.get("build") != build:
            return []
        return found["parts"]
    return []


def parts_of(spark: SparkSession, folder: str, version: int) -> list[dict]:
    """The parts that one version names; none if it can't be read whole."""
    try:
        return json.loads(_text(spark, folder, version)).get("parts", [])
    except ValueError:
        return []


def version(spark: SparkSession, folder: str) -> int:
    """The newest version, 0 for none: what readers compare to know that a table changed."""
    return max(_versions(spark, folder), default=0)


def publish(spark: SparkSession, folder: str, change: Callable[[list[dict]], list[dict]], build: str | None = None, tries: int = 20) -> int:
    """Make a new version from the newest. Its file is created without overwriting, so that of several writers one
    succeeds and the others start again from its result."""
    fs, path, jvm = _files(spark, folder)
    for _ in range(tries):
        now = version(spark, folder)
        parts = change(read(spark, folder))
        body = json.dumps({"format": FORMAT, "build": build, "parts": parts})
        try:
            out = fs.create(jvm.org.apache.hadoop.fs.Path(path, str(now + 1)), False)
        except Exception as e:  # Py4J wraps what the file system throws
            if "exist" not in str(e).lower():
                raise
            continue
        try:
            out.write(bytearray(body.encode()))
        finally:
            out.close()
        return now + 1
    raise Conflict(f"{folder}: {tries} attempts to publish met another writer's")
