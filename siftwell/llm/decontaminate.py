"""Benchmark decontamination by winnowing.

A text's fingerprints are the least hash of K-word grams in every SPAN consecutive ones. Two texts
that share K + SPAN - 1 = WINDOW words share a fingerprint there, so looking documents' fingerprints
up among the benchmark's finds every shared window; hits are then extended, comparing the hashes of
whole windows around them. Items shorter than a window are one window each; their lengths are
looked up at every word.

Workers index the benchmark and write it to the shared folder in sorted arrays of at most BLOCK_BYTES of
text; the driver gets their names. Documents are read once and aren't shuffled: a batch is looked up in one
mapped block after the other. Windows are compared by 64-bit hashes: of 10^12 document windows against 10^6
of a benchmark, 0.05 would be hit by chance.

Cases: null and empty texts have no words, hence no hits; items without words or without an id are
left out; items that repeat an id are one item; repeated documents are reported as often as they
occur; other columns, whatever their names, are carried along only when asked for.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared, words
from .words import mix

K, SPAN, WINDOW = 5, 4, 8
BLOCK_BYTES = 16 << 20
#: Fixed by the contract of the query.
CONTAMINATED = 2
SPANS = "array<struct<a: long, b: long>>"


def gram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n words."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(h) - n + 1, np.uint64)
    for i in range(n):
        out = out * np.uint64(0x9E3779B97F4A7C15) + mix(h[i : len(h) - n + 1 + i] + np.uint64(i))
    return mix(out)


def winnow(grams: np.ndarray, span: int) -> np.ndarray:
    """Places of the least hash in every span consecutive ones, the last one of equals."""
    m = len(grams) - span + 1
    if m <= 0:
        return np.zeros(0, np.int64)
    best, at = grams[:m].copy(), np.arange(m)
    for i in range(1, span):
        other = grams[i : i + m]
        less = other <= best
        best[less] = other[less]
        at[less] = np.flatnonzero(less) + i
    return np.unique(at)


def build(ids: list[str], texts: pa.Array, least: int = 1) -> dict:
    """The index of one block: sorted fingerprints; by length, sorted window hashes and their items. Items of
    fewer than ``least`` words are left out."""
    finger, windows = [], {}
    for base, h, offsets in words.texts_words(texts, words.ALNUM):
        for i in range(len(offsets) - 1):
            own = h[offsets[i] : offsets[i + 1]]
            n = min(len(own), WINDOW)
            if n == 0 or len(own) < least:
                continue
            if n == WINDOW:
                grams = gram_hashes(own, K)
                finger.append(grams[winnow(grams, SPAN)])
            w = np.unique(gram_hashes(own, n))
            windows.setdefault(n, []).append((w, np.full(len(w), base + i)))
    out = {}
    for n, found in windows.items():
        keys, who = np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])
        order = np.argsort(keys, kind="stable")
        out[n] = (keys[order], who[order])
    return {"finger": np.unique(np.concatenate(finger)) if finger else np.zeros(0, np.uint64), "windows": out, "ids": ids}


def _dump(index: dict) -> bytes:
    """An index as bytes that can be mapped: a head with all lengths, then the arrays."""
    arrays = [index["finger"], *(x for n in index["windows"] for x in index["windows"][n])]
    head = json.dumps({"ids": index["ids"], "lengths": list(index["windows"]), "sizes": [len(a) for a in arrays]}).encode()
    head += b" " * (-len(head) % 8)
    return len(head).to_bytes(8, "little") + head + b"".join(np.ascontiguousarray(a).tobytes() for a in arrays)


def _map(uri: str) -> dict:
    raw = shared.map_bytes(uri)
    n = int.from_bytes(raw[:8], "little")
    head = json.loads(bytes(raw[8 : 8 + n]))
    body = np.frombuffer(raw, np.uint64, sum(head["sizes"]), 8 + n)
    finger, *rest = np.split(body, np.cumsum(head["sizes"])[:-1])
    return {"finger": finger, "windows": {k: (rest[2 * i], rest[2 * i + 1].view(np.int64)) for i, k in enumerate(head["lengths"])}, "ids": head["ids"]}


def _index(folder: str, limit: int, least: int):
    """Writes blocks of these rows (item_id, text); their URIs."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared.single_threaded()
        ids, texts, size = [], [], 0

        def write() -> pa.RecordBatch:
            uri = f"{folder}/block-{uuid.uuid4().hex}"
            shared.put_bytes(uri, _dump(build(ids, pa.array(texts, pa.string()), least)))
            return pa.RecordBatch.from_arrays([pa.array([uri])], ["uri"])

        for rb in words.batches(rows, "text", limit):
            for item, text in zip(rb.column(0).to_pylist(), rb.column(1).to_pylist(), strict=True):
                if ids and size + len(text) > limit:
                    yield write()
                    ids, texts, size = [], [], 0
                ids.append(item)
                texts.append(text)
                size += len(text)
        if ids:
            yield write()

    return run


def _in(sorted_keys: np.ndarray, keys: np.ndarray) -> np.ndarray:
    if not len(sorted_keys):
        return np.zeros(len(keys), bool)
    at = np.searchsorted(sorted_keys, keys)
    at[at == len(sorted_keys)] = 0
    return sorted_keys[at] == keys


def hits(index: dict, h: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, np.ndarray, set[str]]]:
    """(text, begin and end of hit spans in words, items) of texts with hits; h and offsets as from texts_words."""
    begins = np.repeat(offsets[:-1], np.diff(offsets))  # of each word's text
    ends = np.repeat(offsets[1:], np.diff(offsets))
    starts, sizes, whos = [], [], []
    for n, (keys, who) in index["windows"].items():
        if n == WINDOW:
            grams = gram_hashes(h, K)
            # a window must lie in one text; winnowing over all words still picks the least of each window
            at = winnow(grams, SPAN)
            at = at[_in(index["finger"], grams[at])]
            at = np.unique((at[:, None] - np.arange(SPAN)).ravel())
            at = at[(at >= 0) & (at + n <= len(h))]
        else:
            at = np.arange(max(0, len(h) - n + 1))
        at = at[at + n <= ends[at]] if len(at) else at
        if not len(at):
            continue
        spans = np.zeros(len(at), np.uint64)
        for i in range(n):
            spans = spans * np.uint64(0x9E3779B97F4A7C15) + mix(h[at + i] + np.uint64(i))
        spans = mix(spans)
        low, high = np.searchsorted(keys, spans), np.searchsorted(keys, spans, "right")
        for k in np.flatnonzero(high > low):
            starts.append(at[k])
            sizes.append(n)
            whos.append(set(who[low[k] : high[k]].tolist()))
    if not starts:
        return
    starts, sizes = np.array(starts), np.array(sizes)
    text = np.searchsorted(offsets, starts, "right") - 1
    for t in np.unique(text):
        own = np.flatnonzero(text == t)
        spans = np.stack([starts[own] - offsets[t], starts[own] + sizes[own] - offsets[t]], 1)
        yield int(t), spans, {index["ids"][i] for k in own for i in whos[k]}


def covered(spans: np.ndarray) -> list[tuple[int, int]]:
    """Union of spans."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(map(tuple, spans.tolist())):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def _search(uris: list[str], own: int):
    """Columns (text, others ...) with words, hit spans and items; own: how many other columns there are."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared.single_threaded()
        mapped: list[dict] = []
        for rb in rows:
            mapped = mapped or list(map(_map, uris))
            for small in words.batches([rb], rb.schema.names[0]):
                n_words = np.zeros(small.num_rows, np.int64)
                spans: list[list] = [[] for _ in range(small.num_rows)]
                items: list[set[str]] = [set() for _ in range(small.num_rows)]
                for first, h, offsets in words.texts_words(small.column(0), words.ALNUM):
                    n_words[first : first + len(offsets) - 1] = np.diff(offsets)
                    for index in mapped:
                        for t, found, who in hits(index, h, offsets):
                            spans[first + t].append(found)
                            items[first + t] |= who
                merged = [[{"a": a, "b": b} for a, b in covered(np.concatenate(s))] if s else [] for s in spans]
                found = [pa.array(n_words), pa.array(merged, pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))), pa.array([sorted(x) for x in items], pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays([*small.columns[1 : own + 1], *found], [f"c{i}" for i in range(own + 3)])

    return run


def find(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, keep: list[str], limit: int = BLOCK_BYTES, least: int = 1) -> tuple[DataFrame, list[str]]:
    """The columns to keep of every row of docs with its words, hit word ranges (from 0, end exclusive) and item ids (sorted); and these three's names."""
    folder = shared.shared_dir(spark, "benchmark")
    asked = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("string").alias("item_id"), "text")
    uris = [r["uri"] for r in asked.mapInArrow(_index(folder, limit, least), "uri string").collect()]  # a name for each block
    names = shared.fresh(keep, "n_words", "spans", "items")
    kinds = shared.with_fields(docs, keep, *zip(names, ("long", SPANS, "array<string>"), strict=True))
    rows = docs.select(F.coalesce("text", F.lit("")).alias("text"), *(shared.quoted(k).alias(f"c{i}") for i, k in enumerate(keep)))
    return rows.mapInArrow(_search(uris, len(keep)), kinds), names


def report(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, limit: int = BLOCK_BYTES) -> DataFrame:
    """What a document shares with the benchmark."""
    found, (n_words, spans, items) = find(spark, docs, benchmark, ["doc_id"], limit)
    n_items = F.size(items).cast("long")
    return found.select(
        "doc_id",
        F.col(n_words).alias("n_words"),
        F.coalesce(F.aggregate(spans, F.lit(0).cast("long"), lambda a, s: a + s["b"] - s["a"]), F.lit(0).cast("long")).alias("n_hit"),
        n_items.alias("n_items"),
        F.sha2(F.array_join(items, ",").cast("binary"), 256).alias("items_sha256"),
        (n_items >= CONTAMINATED).alias("contaminated"),
    )


def clean(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, passages: int = 1) -> DataFrame:
    """docs without the rows that share whole windows with ``passages`` items or more, all columns as they were. Items
    shorter than a window condemn no document."""
    found, (_, _, items) = find(spark, docs, benchmark, docs.columns, least=WINDOW)
    return found.where(F.size(items) < passages).select(*map(shared.quoted, docs.columns))
