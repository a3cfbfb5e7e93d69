"""Entries: one row for a file-system object, with all derived columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import metadata
from ..functions.bytesql import fold, fold_text, sub
from . import manifest

SCHEMA = "path string, is_dir boolean, is_link boolean, hidden boolean, size long, mtime long"
# What isn't entered when the whole disk is scanned.
EXCLUDED = ("/System/Volumes", "/Volumes", "/dev", "/net", "/home", "/private/var/vm")


def parent(path: Column) -> Column:
    cut = F.length(path) - F.instr(F.reverse(path), "/")
    return F.when(cut <= 0, "/").otherwise(sub(path, 1, cut))


def name_of(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def join_path(folder: Column, name: Column) -> Column:
    return F.when(folder == "/", F.concat(F.lit("/"), name)).otherwise(F.concat(folder, F.lit("/"), name))


def under(path: Column, folder: str) -> Column:
    return (path == folder) | path.startswith(folder.rstrip("/") + "/")


def event_path(path: Column) -> Column:
    """A change event's path without the data volume's prefix and without slashes at its end."""
    bare = F.regexp_replace(path, "^/System/Volumes/Data(?=/|$)", "")
    return F.when(bare.rlike("^/*$"), "/").otherwise(F.regexp_replace(bare, "/+$", ""))


def components(path: Column, root: str) -> Column:
    """Names from the root's child to the entry itself."""
    rel = path if root == "/" else sub(path, len(root) + 1)
    return F.filter(F.split(rel, "/"), lambda p: p != "")


def order_key(names: Column) -> Column:
    """Sorts as a depth-first walk does: names bytewise, hex names after text names."""
    return F.transform(names, lambda n: F.concat(F.when(metadata.is_hex_name(n), "1").otherwise("0"), n))


def excluded(path: Column, root: str, folders: tuple[str, ...] = EXCLUDED) -> Column:
    """Below an excluded folder, which is an entry itself."""
    out = F.lit(False)
    for x in folders if root == "/" else ():
        out = out | path.startswith(f"{x}/")
    return out


def derive(rows: DataFrame, root: str, home: str | None = None) -> DataFrame:
    """rows of SCHEMA (more columns may follow) with name, parent, folders, category, depth, prior and order_key."""
    names = components(F.col("path"), root)
    inside = [x for x in (home or "").removeprefix(root.rstrip("/")).split("/") if x] if home and (home + "/").startswith(root.rstrip("/") + "/") else None
    out = rows.withColumn("name", name_of(F.col("path"))).withColumn("parent", parent(F.col("path"))).withColumn("_n", names)
    out = out.withColumn("folders", F.when(F.size("_n") > 1, F.slice("_n", 1, F.size("_n") - 1)).otherwise(F.array().cast("array<string>")))
    out = out.withColumn("category", F.when(~F.col("is_dir"), metadata.category(F.col("name"))))
    out = out.withColumn("size", F.when(F.col("is_dir"), 0).otherwise(F.col("size")).cast("long"))
    out = out.withColumn("depth", F.size("_n")).withColumn("prior", metadata.prior(F.col("folders"), root == "/", inside))
    return out.withColumn("order_key", order_key(F.col("folders"))).drop("_n")


def lookup(entries: DataFrame, path: str, any_case: bool = False) -> DataFrame:
    """The entry of a path; with any_case, all whose paths differ from it in the case of ASCII letters only."""
    return entries.where(fold(F.col("path")) == fold_text(path)) if any_case else entries.where(F.col("path") == path)


def children(entries: DataFrame, folder: str, name: str | None = None, any_case: bool = False) -> DataFrame:
    """The entries in a folder, or those of a name there."""
    inside = entries.where(F.col("parent") == folder)
    if name is None:
        return inside
    return inside.where(fold(F.col("name")) == fold_text(name)) if any_case else inside.where(F.col("name") == name)


def folders_of(files: DataFrame, root: str) -> DataFrame:
    """The folders on the way to the files, below the root, as SCHEMA rows of time 0."""
    names = components(F.col("path"), root)
    base = "" if root == "/" else root
    chain = F.when(F.size(names) > 1, F.transform(F.sequence(F.lit(1), F.size(names) - 1), lambda i: F.concat(F.lit(f"{base}/"), F.array_join(F.slice(names, 1, i), "/"))))
    paths = files.select(F.explode(chain).alias("path")).distinct()
    dotted = name_of(F.col("path")).startswith(".")
    return paths.select("path", F.lit(True).alias("is_dir"), F.lit(False).alias("is_link"), dotted.alias("hidden"), F.lit(0).cast("long").alias("size"), F.lit(0).cast("long").alias("mtime"))


def save(entries: DataFrame, folder: str, build: str | None = None) -> None:
    """Publish an index as a new version: written aside, clustered by path so that scopes skip most files, and seen by
    readers only when its line is in the manifest. build: a name that tables made from this index must agree with."""
    name = manifest.new_name()
    entries.repartitionByRange("path").sortWithinPartitions("path").write.parquet(f"{folder.rstrip('/')}/{name}")
    manifest.publish(entries.sparkSession, folder, lambda _: [{"name": name}], build)


def load(spark: SparkSession, folder: str, schema=None, build: str | None = None) -> DataFrame:
    """The published index; without one, or with one of another build, an empty frame of the schema."""
    parts = manifest.read(spark, folder, build)
    if not parts:
        return spark.createDataFrame([], schema if schema is not None else SCHEMA)
    return (spark.read.schema(schema) if schema else spark.read).parquet(f"{folder.rstrip('/')}/{parts[-1]['name']}")


def folder_priors(entries: DataFrame, root: str) -> DataFrame:
    """(path, prior): the prior that a folder gives to what it holds."""
    inner = F.concat(F.col("folders"), F.array("name"))
    return entries.where("is_dir").select("path", metadata.prior(inner, root == "/", None).alias("prior"))


def reread(folders: DataFrame, dirty: DataFrame, trees: DataFrame) -> DataFrame:
    """(path, reread) of folders: whether one must be listed anew, being dirty or in a changed tree; the rest are copied."""
    chain = F.transform(F.sequence(F.lit(2), F.size(F.split("path", "/"))), lambda i: F.array_join(F.slice(F.split("path", "/"), 1, i), "/"))
    below = folders.select("path", F.explode(chain).alias("tree")).join(trees.select(F.col("path").alias("tree")), "tree", "left_semi")
    todo = below.select("path").unionByName(dirty.select("path")).distinct().withColumn("reread", F.lit(True))
    return folders.select("path").join(todo, "path", "left").select("path", F.coalesce("reread", F.lit(False)).alias("reread"))


def refresh(old: DataFrame, dirty: DataFrame, trees: DataFrame, listed: DataFrame) -> DataFrame:
    """An index after changes: entries whose folder is dirty, or below a tree, are replaced by what was listed anew.

    dirty, trees: (path) of folders; listed: rows of old's columns for all of these."""
    kept = old.join(dirty.select(F.col("path").alias("parent")), "parent", "left_anti")
    chain = F.transform(F.sequence(F.lit(1), F.size(F.split("path", "/")) - 1), lambda i: F.array_join(F.slice(F.split("path", "/"), 1, i), "/"))
    below = kept.select("path", F.explode(chain).alias("tree")).join(trees.select(F.col("path").alias("tree")), "tree", "left_semi").select("path")
    return kept.join(below, "path", "left_anti").select(*old.columns).unionByName(listed.select(*old.columns)).dropDuplicates(["path"])
