"""Keeping tables current: diffs, change batches, tombstones and compaction, in batch form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .entries import parent

# When the overlay is merged into the base, in rows and seconds; when segments are merged.
MOST_EXTRAS, MOST_DEAD, LONGEST_S = 50_000, 200_000, 600
TIER, SEGMENT_BYTES, MOST_SEGMENTS = 8, 256 << 20, 6


def sync_diff(held: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """(path, action): what must be added, replaced, kept or dropped so that held is as wanted. keys: columns that tell versions apart."""
    h = held.select("path", F.struct(*keys).alias("h"))
    w = wanted.dropDuplicates(["path"]).select("path", F.struct(*keys).alias("w"))
    both = h.join(w, "path", "full_outer")
    action = F.when(F.col("h").isNull(), "add").when(F.col("w").isNull(), "drop").when(F.col("h") == F.col("w"), "keep").otherwise("replace")
    return both.select("path", action.alias("action"))


def folded(rows: DataFrame) -> DataFrame:
    """The last change of each kind for a path; neither order nor repetition of the changes matters."""
    return rows.groupBy("path", "op").agg(F.max_by(F.struct(*rows.columns), "event_id").alias("r")).select("r.*")


def merge(state: DataFrame, changes: DataFrame) -> DataFrame:
    return folded(state.unionByName(changes.select(*state.columns)))


def ancestors(path: Column) -> Column:
    """The folders above a path."""
    n = F.size(F.split(path, "/"))
    return F.when(n > 2, F.transform(F.sequence(F.lit(2), n - 1), lambda i: F.array_join(F.slice(F.split(path, "/"), 1, i), "/"))).otherwise(F.array().cast("array<string>"))


def current(state: DataFrame) -> DataFrame:
    """The rows that live: upserted, and neither deleted nor below a folder that was deleted since."""
    killed = state.where("op in ('tree', 'delete')").groupBy(F.col("path").alias("tree")).agg(F.max("event_id").alias("killed_at"))
    rows = state.where("op = 'upsert'")
    above = rows.select("path", "event_id", F.explode(F.concat(ancestors(F.col("path")), F.array("path"))).alias("tree"))
    dead = above.join(killed, "tree").where("killed_at > event_id").select("path").distinct()
    return rows.join(dead, "path", "left_anti").drop("op")


def compacted(rows: DataFrame, horizon: int) -> DataFrame:
    """What of rows later changes still depend on: the rows that live, and deletions after the event horizon."""
    state = folded(rows)
    alive = current(state).withColumn("op", F.lit("upsert")).select(*rows.columns)
    return alive.unionByName(state.where((F.col("op") != "upsert") & (F.col("event_id") > horizon)))


def apply(state: DataFrame, changes: DataFrame) -> DataFrame:
    """state (path, event_id, ...) after changes (path, op, event_id, ...): upserts, deletes, and deleted trees."""
    return current(merge(state.withColumn("op", F.lit("upsert")), changes)).select(*state.columns)


def dirty_folders(changes: DataFrame) -> DataFrame:
    """Folders to list again, each once: those of changed paths and those named as such."""
    return changes.select(F.when(F.col("op").isin("dir", "tree"), F.col("path")).otherwise(parent(F.col("path"))).alias("path")).distinct()


def known_folders(wanted: DataFrame, folders: DataFrame) -> DataFrame:
    """Of each folder to list, itself or the nearest one above that is known."""
    near = F.concat(ancestors(F.col("path")), F.array("path"))
    up = wanted.select(F.col("path").alias("asked"), F.posexplode(near).alias("depth", "path")).join(folders.select("path"), "path", "left_semi")
    return up.groupBy("asked").agg(F.max_by("path", "depth").alias("path")).select("path").distinct()


def listing_diff(held: DataFrame, folders: DataFrame, listed: DataFrame, keys: tuple[str, ...] = ("is_dir", "size", "mtime")) -> DataFrame:
    """(path, change): what listing the folders (path) anew shows against the entries held in them: new, changed or gone.

    held, listed: rows with path, parent and keys; held entries of other folders count as they are."""
    inside = held.join(folders.select(F.col("path").alias("parent")), "parent", "left_semi")
    found = sync_diff(inside, listed, list(keys)).where("action <> 'keep'")
    return found.select("path", F.expr("CASE action WHEN 'add' THEN 'new' WHEN 'drop' THEN 'gone' ELSE 'changed' END").alias("change"))


def nearest(paths: DataFrame, folders: DataFrame, value: str) -> DataFrame:
    """(path, value) of the nearest folder above each path that is among the folders (path, value); null without one."""
    up = paths.select("path").withColumn("above", ancestors(F.col("path"))).select("path", F.posexplode("above").alias("_depth", "_folder"))
    found = up.join(folders.select(F.col("path").alias("_folder"), F.col(value).alias("_value")), "_folder")
    best = found.groupBy("path").agg(F.max_by("_value", "_depth").alias(value))
    return paths.select("path").distinct().join(best, "path", "left").select("path", value)


def status(entries: DataFrame, symbols: DataFrame, content: DataFrame, extras: int = 0, dead: int = 0) -> DataFrame:
    """One row of counters."""
    a = entries.agg(F.count("*").alias("entries"), F.count_if("is_dir").alias("dirs"))
    b = symbols.agg(F.count("*").alias("symbols"))
    c = content.agg(F.count("*").alias("content_docs"), F.coalesce(F.sum("size"), F.lit(0)).alias("content_bytes"))
    names = ("entries", "dirs", "symbols", "content_docs", "content_bytes")
    rows = a.unionByName(b, allowMissingColumns=True).unionByName(c, allowMissingColumns=True)
    return rows.agg(*(F.max(n).alias(n) for n in names), F.lit(extras).alias("overlay"), F.lit(dead).alias("removed"))


def compaction_due(extras: int, dead: int, seconds: float) -> bool:
    return extras > MOST_EXTRAS or dead > MOST_DEAD or seconds >= LONGEST_S and extras + dead > 0


def segments_to_merge(sizes: list[int]) -> list[int]:
    """Which segments (by place) to merge next: eight of a tier (powers of four), or the smallest two when there are too many."""
    tiers: dict[int, list[int]] = {}
    for i, n in enumerate(sizes):
        if n < SEGMENT_BYTES:
            tiers.setdefault((max(n, 1).bit_length() - 1) // 2, []).append(i)
    full = [t for t in sorted(tiers) if len(tiers[t]) >= TIER]
    if full:
        return tiers[full[0]][:TIER]
    return sorted(sorted(range(len(sizes)), key=lambda i: (sizes[i], i))[:2]) if len(sizes) > MOST_SEGMENTS else []
