"""The live index: a stream of change events folded into a table of parts.

A micro-batch is written as a part of its own and named in a new manifest; nothing else is rewritten. Reading
takes the last change of each kind for a path over all parts, so that neither order nor repetition of events
matters. Small parts are merged by tiers, and everything is folded into one base when compaction is due; what was
appended meanwhile stays on top. Writers meet only in the manifest, where one of them wins and the others start again
from its result; readers see a version whole, and learn of a newer one by its number.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import live, manifest, postings

CHANGES = "event_id long, path string, op string, size long"
#: Before every event.
NEVER = -(1 << 63)


class Table:
    """A table of parts below a folder that Spark can reach. schema holds at least event_id, path and op."""

    def __init__(self, spark: SparkSession, folder: str, schema: str = CHANGES):
        self.spark, self.folder, self.schema = spark, folder.rstrip("/"), schema

    def version(self) -> int:
        """The newest version, 0 for none."""
        return manifest.version(self.spark, self.folder)

    def parts(self) -> list[dict]:
        return manifest.read(self.spark, self.folder)

    def _all(self, parts: list[dict]) -> DataFrame:
        """The rows of parts; changes up to the base's horizon come too late."""
        out = self.spark.createDataFrame([], self.schema)
        horizon = max((p.get("horizon", NEVER) for p in parts), default=NEVER)
        for base in (True, False):
            paths = [f"{self.folder}/{p['name']}" for p in parts if ("horizon" in p) == base]
            if paths:
                rows = self.spark.read.schema(self.schema).parquet(*paths)
                out = out.unionByName(rows if base or horizon == NEVER else rows.where(F.col("event_id") > horizon))
        return out

    def read(self) -> DataFrame:
        """The last change of each kind for a path."""
        return live.folded(self._all(self.parts()))

    def rows(self) -> DataFrame:
        """The rows that live."""
        return live.current(self.read())

    def _write(self, df: DataFrame, **more: int) -> dict:
        name = manifest.new_name()
        df.write.parquet(f"{self.folder}/{name}")
        rows, dead = self.spark.read.schema(self.schema).parquet(f"{self.folder}/{name}").agg(F.count("*"), F.count_if(F.col("op") != "upsert")).first()
        return {"name": name, "rows": rows, "dead": dead, "at": int(time.time()), **more}

    def _replace(self, old: list[dict], new: dict) -> bool:
        """Put a part in the place of others; False if another writer took one of them first."""
        gone = {p["name"] for p in old}
        done = False

        def change(now: list[dict]) -> list[dict]:
            nonlocal done
            done = gone <= {p["name"] for p in now}
            return [new, *(p for p in now if p["name"] not in gone)] if done else now

        manifest.publish(self.spark, self.folder, change)
        return done

    def append(self, changes: DataFrame) -> None:
        part = self._write(live.folded(changes.select(*self.spark.createDataFrame([], self.schema).columns)))
        if part["rows"]:
            manifest.publish(self.spark, self.folder, lambda now: [*now, part])

    def tidy(self) -> bool:
        """Merge small parts of changes, if there are enough of a size. Whether any were."""
        changes = [p for p in self.parts() if "horizon" not in p]
        which = [changes[i] for i in live.segments_to_merge([p["rows"] for p in changes])]
        return bool(which) and self._replace(which, self._write(live.folded(self._all(which))))

    def due(self) -> bool:
        """Whether compaction is."""
        parts = self.parts()
        changes = [p for p in parts if "horizon" not in p]
        since = max((p["at"] for p in parts if "horizon" in p), default=min((p["at"] for p in changes), default=0))
        dead = sum(p["dead"] for p in changes)
        return live.compaction_due(sum(p["rows"] for p in changes) - dead, dead, time.time() - since)

    def compact(self, late: int | None = None) -> bool:
        """Fold all parts into one base. late: how far behind the newest event others may still come; older deletions
        go and older events count no more. Without it all deletions stay and no event is too late."""
        parts = self.parts()
        if not parts:
            return False
        rows, horizon = self._all(parts), max(p.get("horizon", NEVER) for p in parts)
        if late is not None:
            newest = rows.agg(F.max("event_id")).first()[0]
            horizon = horizon if newest is None else max(horizon, newest - late)
        return self._replace(parts, self._write(live.compacted(rows, horizon), horizon=horizon))

    def vacuum(self, seconds: float = 3600) -> int:
        """Delete what no reader of the last seconds can hold: older manifests but the newest, and older parts that none left names."""
        fs, listed, jvm = manifest._files(self.spark, self.folder)
        if not fs.exists(listed):
            return 0
        before, newest = (time.time() - seconds) * 1000, self.version()
        held: set[str] = set()
        for f in fs.listStatus(listed):
            number = f.getPath().getName()
            if number.isdigit() and int(number) != newest and f.getModificationTime() < before:
                fs.delete(f.getPath(), False)
            elif number.isdigit():
                held |= {p["name"] for p in manifest.parts_of(self.spark, self.folder, int(number))}
        old = [f.getPath() for f in fs.listStatus(jvm.org.apache.hadoop.fs.Path(self.folder)) if f.getModificationTime() < before]
        old = [p for p in old if p.getName().startswith("part-") and p.getName() not in held]
        for path in old:
            fs.delete(path, True)
        return len(old)


def merge_batch(table: Table, ignore: list[str], late: int | None = None) -> Callable[[DataFrame, int], None]:
    def run(batch: DataFrame, batch_id: int) -> None:
        wanted = batch
        for prefix in ignore:
            wanted = wanted.where(~((F.col("path") == prefix) | F.col("path").startswith(f"{prefix}/")))
        table.append(wanted)
        if table.due():
            table.compact(late)
            table.vacuum()
        else:
            table.tidy()

    return run


def _started(changes: DataFrame, run: Callable[[DataFrame, int], None], checkpoint: str, once: bool, seconds: float) -> StreamingQuery:
    writer = changes.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=f"{max(1, int(seconds * 1000))} milliseconds")).start()


def follow(changes: DataFrame, table: Table, checkpoint: str, ignore: list[str] | None = None, once: bool = False, seconds: float = 0.05, late: int | None = None) -> StreamingQuery:
    """Start to follow a stream of CHANGES rows. once: take what is there and stop."""
    return _started(changes, merge_batch(table, ignore or [], late), checkpoint, once, seconds)


def follow_content(changes: DataFrame, folder: str, contents: Callable[[DataFrame], DataFrame], checkpoint: str, once: bool = False, seconds: float = 0.05) -> StreamingQuery:
    """Keep a content index current. contents: (doc_id, path, size, mtime, text) of given paths, as they are now."""

    def run(batch: DataFrame, batch_id: int) -> None:
        postings.sync(batch.sparkSession, folder, contents(batch.where("op = 'upsert'").select("path").distinct()))

    return _started(changes, run, checkpoint, once, seconds)


def read_log(spark: SparkSession, folder: str, files_per_batch: int = 1) -> DataFrame:
    """A change log of JSON files as a stream."""
    return spark.readStream.schema(CHANGES).option("maxFilesPerTrigger", files_per_batch).json(folder)
