"""The content index: postings of folded byte trigrams, Bloom filters of longer grams, and candidates from a plan.

A text's distinct trigrams are found where the text lies, in one Arrow batch, so that nothing is shuffled but
the finished postings when they are saved by trigram. A segment of the index is a folder with postings, Bloom
filters and the documents it covers; it is written aside and becomes visible by its line in the manifest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.bytesql import bytes_text, fold_text
from ..plans.regex import Need, literal_need
from . import manifest
from .live import segments_to_merge

FOLLOW = 7
#: Lengths of the grams in a document's Bloom filter, bits for each gram, and places that a gram sets.
GRAMS, GRAM_BITS, PROBES = (5, 7), 3, 2
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
POSTINGS, BLOOM = "doc_id long, tri string, follow int", "doc_id long, bits int, bloom binary"


def _texts(rows: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray]]:
    """(doc_id, folded bytes) of rows (doc_id, text)."""
    for rb in rows:
        for doc, text in zip(rb.column(0).to_pylist(), rb.column(1), strict=True):
            raw = text.as_buffer() if text.is_valid else b""
            yield doc, _FOLD[np.frombuffer(raw, np.uint8)] if len(raw) else np.zeros(0, np.uint8)


def _document(b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A text's distinct trigrams, as numbers in order, with the buckets of the bytes that follow."""
    wide = b.astype(np.int64)
    tri = (wide[:-2] << 16) | (wide[1:-1] << 8) | wide[2:]
    bit = np.zeros(len(tri), np.int64)
    bit[:-1] = 1 << (wide[3:] % FOLLOW)
    order = np.argsort(tri, kind="stable")
    tri = tri[order]
    at = np.flatnonzero(np.concatenate([[True], tri[1:] != tri[:-1]]))
    return tri[at], np.bitwise_or.reduceat(bit[order], at)


def _trigrams(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names: dict[int, str] = {}
    docs, tris, follows, held = [], [], [], 0

    def out() -> pa.RecordBatch:
        tri = np.concatenate(tris)
        uniq, back = np.unique(tri, return_inverse=True)
        for t in uniq.tolist():
            if t not in names:
                names[t] = bytes((t >> 16, t >> 8 & 255, t & 255)).decode("latin-1")
        words = pa.DictionaryArray.from_arrays(pa.array(back.astype(np.int32)), pa.array([names[t] for t in uniq.tolist()], pa.string()))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(docs)), words.cast(pa.string()), pa.array(np.concatenate(follows).astype(np.int32))], ["doc_id", "tri", "follow"])

    for doc, b in _texts(rows):
        if len(b) >= 3:
            tri, follow = _document(b)
            docs.append(np.full(len(tri), doc, np.int64))
            tris.append(tri)
            follows.append(follow)
            held += len(tri)
            if held >= 1 << 18:
                yield out()
                docs, tris, follows, held = [], [], [], 0
    if held:
        yield out()


def trigrams(content: DataFrame) -> DataFrame:
    """(doc_id, tri, follow) of all texts: distinct trigrams with the buckets of the bytes that follow."""
    return content.select(F.col("doc_id").cast("long"), "text").mapInArrow(_trigrams, POSTINGS)


def gram_hashes(b: np.ndarray, n: int) -> np.ndarray:
    """32-bit hashes of all runs of n folded bytes."""
    if len(b) < n:
        return np.zeros(0, np.uint32)
    out = np.full(len(b) - n + 1, 0x9E3779B9 + n, np.uint32)
    for i in range(n):
        out = (out ^ b[i : len(b) - n + 1 + i]) * np.uint32(0x85EBCA6B)
        out ^= out >> np.uint32(13)
    return out


def _places(hashes: np.ndarray, bits: int) -> np.ndarray:
    """The places that grams set in a filter of so many bits."""
    wide = hashes.astype(np.uint64)
    step = (wide * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33) | np.uint64(1)
    return np.stack([(wide + np.uint64(k) * step) % np.uint64(max(bits, 1)) for k in range(PROBES)])


def bloom_filter(b: np.ndarray) -> tuple[int, bytes]:
    """Size in bits and the filter of a text's grams."""
    hashes = np.unique(np.concatenate([gram_hashes(b, n) for n in GRAMS]))
    bits = -(-max(64, GRAM_BITS * len(hashes)) // 8) * 8
    field = np.zeros(bits, np.uint8)
    field[_places(hashes, bits).ravel().astype(np.int64)] = 1
    return bits, np.packbits(field, bitorder="little").tobytes()


def _blooms(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rb in rows:
        found = [(doc, *bloom_filter(b)) for doc, b in _texts([rb])]
        yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int32()), pa.array([f[2] for f in found], pa.binary())], ["doc_id", "bits", "bloom"])


def blooms(content: DataFrame) -> DataFrame:
    """(doc_id, bits, bloom): a filter of every text's 5- and 7-grams."""
    return content.select(F.col("doc_id").cast("long"), "text").mapInArrow(_blooms, BLOOM)


def may_hold(literal: str) -> Column:
    """Whether a document's filter allows a literal, by its longest grams that fit: computed in the JVM from the filter's bytes."""
    b = _FOLD[np.frombuffer(literal.encode(), np.uint8)]
    n = max((n for n in GRAMS if len(b) >= n), default=0)
    out = F.lit(True)
    for h in np.unique(gram_hashes(b, n)).tolist() if n else []:
        step = ((h * 0x9E3779B97F4A7C15) & ((1 << 64) - 1)) >> 33 | 1
        for k in range(PROBES):
            at = F.pmod(F.lit(h + k * step), F.col("bits").cast("long"))
            byte = F.conv(F.hex(F.substring(F.col("bloom"), (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
            out = out & (F.floor(byte / F.pow(F.lit(2.0), at % 8)) % 2 == 1)
    return F.coalesce(out, F.lit(True))


def literal_plan(text: str) -> tuple[Need, dict[str, int]]:
    """Needed trigrams of a literal and, for each, the buckets that must follow it."""
    low = bytes_text(fold_text(text))
    follows: dict[str, int] = {}
    for i in range(len(low) - 2):
        bit = 1 << (ord(low[i + 3]) % FOLLOW) if i + 3 < len(low) else 0
        follows[low[i : i + 3]] = follows.get(low[i : i + 3], 0) | bit
    return literal_need(low), follows


def grams_of(need: Need) -> set[str]:
    return set() if need is True else {need} if isinstance(need, str) else set().union(*map(grams_of, need[1]))


def candidate_docs(postings: DataFrame, need: Need, follows: dict[str, int] | None = None) -> DataFrame | None:
    """(doc_id) of documents that meet a plan, in one pass over the needed postings; None if it asks for nothing."""
    wanted = sorted(grams_of(need))
    if not wanted:
        return None
    rows = postings.where(F.col("tri").isin(wanted))
    for tri, bits in (follows or {}).items():
        if bits:
            rows = rows.where((F.col("tri") != tri) | (F.col("follow").bitwiseAND(bits) == bits))
    has = rows.groupBy("doc_id").agg(*(F.max(F.col("tri") == t).alias(f"g{i}") for i, t in enumerate(wanted)))
    place = {t: i for i, t in enumerate(wanted)}

    def holds(n: Need) -> Column:
        if n is True:
            return F.lit(True)
        if isinstance(n, str):
            return F.col(f"g{place[n]}")
        out = holds(n[1][0])
        for part in n[1][1:]:
            out = out & holds(part) if n[0] == "and" else out | holds(part)
        return out

    return has.where(holds(need)).select("doc_id")


def pruned(content: DataFrame, postings: DataFrame, need: Need, follows: dict[str, int] | None = None) -> DataFrame:
    """The documents that may match; each must still be verified."""
    docs = candidate_docs(postings, need, follows)
    return content if docs is None else content.join(docs, "doc_id", "left_semi")


# --- an index in a folder


def save(postings: DataFrame, folder: str) -> None:
    """Clustered by trigram, so that a plan reads few row groups."""
    postings.repartitionByRange("tri").sortWithinPartitions("tri", "doc_id").write.mode("overwrite").parquet(folder)


def add_segment(spark: SparkSession, folder: str, content: DataFrame) -> str:
    """Index documents (doc_id, path, size, mtime, text) into a new segment; its name. Documents that an older segment
    has under the same path are theirs no longer."""
    name = manifest.new_name()
    at = f"{folder.rstrip('/')}/{name}"
    save(trigrams(content), f"{at}/postings")
    blooms(content).write.parquet(f"{at}/blooms")
    content.select("doc_id", "path", "size", "mtime").write.parquet(f"{at}/docs")
    size = spark.read.parquet(f"{at}/docs").agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    manifest.publish(spark, folder, lambda now: [*now, {"name": name, "bytes": int(size)}])
    return name


def open_index(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The tables ``docs``, ``postings`` and ``blooms`` of all segments; a path's document is that of the newest that has it."""
    parts = manifest.read(spark, folder)
    kinds = {"docs": "doc_id long, path string, size long, mtime long", "postings": POSTINGS, "blooms": BLOOM}
    out: dict[str, DataFrame] = {}
    for kind, schema in kinds.items():
        frame = spark.createDataFrame([], schema).withColumn("segment", F.lit(0))
        for i, part in enumerate(parts):
            rows = spark.read.schema(schema).parquet(f"{folder.rstrip('/')}/{part['name']}/{kind}").withColumn("segment", F.lit(i))
            frame = rows if i == 0 else frame.unionByName(rows)
        out[kind] = frame
    newest = out["docs"].groupBy("path").agg(F.max_by(F.struct(*out["docs"].columns), "segment").alias("d")).select("d.*")
    out["docs"] = newest if len(parts) > 1 else out["docs"]
    return out


def merge_segments(spark: SparkSession, folder: str, which: list[int]) -> None:
    """Merge segments (by place) into one that holds what is still current of them."""
    parts = manifest.read(spark, folder)
    index = open_index(spark, folder)
    live = index["docs"].where(F.col("segment").isin(which)).select("segment", "doc_id")
    name = manifest.new_name()
    at = f"{folder.rstrip('/')}/{name}"
    for kind in ("postings", "blooms"):
        rows = index[kind].where(F.col("segment").isin(which)).join(live, ["segment", "doc_id"], "left_semi").drop("segment")
        save(rows, f"{at}/{kind}") if kind == "postings" else rows.write.parquet(f"{at}/{kind}")
    index["docs"].where(F.col("segment").isin(which)).drop("segment").write.parquet(f"{at}/docs")
    size = spark.read.parquet(f"{at}/docs").agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    gone = {parts[i]["name"] for i in which}
    last = parts[max(which)]["name"]

    def merged(now: list[dict]) -> list[dict]:
        # in the place of its newest part, so that what came later still wins
        return [{"name": name, "bytes": int(size)} if p["name"] == last else p for p in now if p["name"] == last or p["name"] not in gone]

    manifest.publish(spark, folder, merged)


def sync(spark: SparkSession, folder: str, content: DataFrame) -> int:
    """Index those of content (doc_id, path, size, mtime, text) that the index doesn't have as they are, then merge
    segments that are due. How many were indexed."""
    keys = ["path", "size", "mtime"]
    new = content.join(open_index(spark, folder)["docs"].select(*keys), keys, "left_anti").select("doc_id", "path", "size", "mtime", "text")
    count = new.count()
    if count:
        add_segment(spark, folder, new)
    while which := segments_to_merge([p["bytes"] for p in manifest.read(spark, folder)]):
        merge_segments(spark, folder, which)
    return count


def candidates(index: dict[str, DataFrame], need: Need, follows: dict[str, int] | None = None, literal: str = "") -> DataFrame:
    """(doc_id, path, size, mtime) of current documents that may match; Bloom filters are asked about literals they know."""
    docs = index["docs"]
    found = candidate_docs(index["postings"].withColumn("doc_id", F.struct("segment", "doc_id")), need, follows)
    if found is not None:
        docs = docs.join(found.select("doc_id.*"), ["segment", "doc_id"], "left_semi")
    if len(literal.encode()) >= min(GRAMS):
        allowed = index["blooms"].where(~may_hold(literal)).select("segment", "doc_id")
        docs = docs.join(allowed, ["segment", "doc_id"], "left_anti")
    return docs.select("doc_id", "path", "size", "mtime")


def coverage(index: dict[str, DataFrame], eligible: DataFrame) -> DataFrame:
    """One row: documents and bytes that the index has, eligible files (path, size, mtime) that it covers as they are,
    those it lacks, documents without a filter, and whether it is ready."""
    docs = index["docs"]
    known = docs.agg(F.count("*").alias("docs"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))
    both = eligible.select("path", "size", "mtime").join(docs.select("path", "size", "mtime", F.lit(True).alias("have")), ["path", "size", "mtime"], "left")
    seen = both.agg(F.count_if("have").alias("covered"), F.count_if(F.col("have").isNull()).alias("missing"))
    bare = docs.join(index["blooms"], ["segment", "doc_id"], "left_anti").agg(F.count("*").alias("without_bloom"))
    return known.crossJoin(seen).crossJoin(bare).withColumn("ready", F.col("missing") == 0)
