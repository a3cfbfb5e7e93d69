"""Audio fingerprints of media columns, and their alignment.

A recording (WAV bytes) becomes frames of twelve pitch-class energies. Sixteen rectangle filters slide
over these frames; their sums come from one integral image, are compared as log quotients and cut into
two Gray-coded bits each, so that every frame gives one packed 32-bit number. Recordings are aligned
by the histogram of offsets at which they have equal numbers; the best offsets are accepted by the
share of differing bits over the overlap.

Searching takes a stated query set against all rows: queries go to the workers in blocks of at most
BLOCK of their numbers, sorted, and recordings aren't shuffled. A block has one entry for queries with
equal fingerprints, which are told apart again only in the result.

Cases: null, empty and unreadable recordings, and ones shorter than a filter window, have no numbers
and no matches; equal recordings match each other; repeated rows are matched as often as they occur; a
row never matches its own id; very long recordings are read in slices of frames; other columns are
ignored.
"""

from __future__ import annotations

import io
import wave
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared

FRAME, HOP, LOW, HIGH = 1024, 256, 60.0, 3500.0
#: Frames under a filter; log quotient at which a filter's bits change; energy that counts as none.
SPAN, QUANTILE, FLOOR = 16, 0.45, 0.03
BLOCK = 1 << 20
#: Equal numbers at one offset before bits are compared; frames that must overlap; bits that may differ.
VOTES, OVERLAP, ERRORS = 3, 24, 0.2


def filters() -> list[tuple[int, int, int, int]]:
    """(kind, lowest pitch class, pitch classes, frames) of the filters."""
    return [(i % 5, (5 * i) % (13 - h), h, w) for i in range(16) for h, w in [((4, 6, 8, 12)[i % 4], (16, 12, 8, 4)[i // 4])]]


def decode(data: bytes | None) -> tuple[np.ndarray, int]:
    """Samples (mono) and rate of a 16-bit PCM WAV file."""
    try:
        with wave.open(io.BytesIO(data or b"")) as src:
            if src.getsampwidth() != 2:
                return np.zeros(0), 1
            raw = np.frombuffer(src.readframes(src.getnframes()), "<i2").astype(np.float32)
            channels = src.getnchannels()
            return raw[: len(raw) // channels * channels].reshape(-1, channels).mean(1) / 32768, src.getframerate()
    except (wave.Error, EOFError):
        return np.zeros(0), 1


def encode(samples: np.ndarray, rate: int) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as dst:
        dst.setnchannels(1)
        dst.setsampwidth(2)
        dst.setframerate(rate)
        dst.writeframes((np.clip(samples, -1, 1) * 32767).astype("<i2").tobytes())
    return out.getvalue()


def chroma(samples: np.ndarray, rate: int, slice_frames: int = 4096) -> np.ndarray:
    """Energies of the twelve pitch classes, a row for each frame, each row of length one (or silent)."""
    n = max(0, (len(samples) - FRAME) // HOP + 1)
    freq = np.fft.rfftfreq(FRAME, 1 / rate)
    use = (freq >= LOW) & (freq <= HIGH)
    bins = np.zeros((use.sum(), 12), np.float32)
    bins[np.arange(use.sum()), np.round(12 * np.log2(freq[use] / 440)).astype(int) % 12] = 1
    window = np.hanning(FRAME).astype(np.float32)
    out = np.zeros((n, 12), np.float32)
    for a in range(0, n, slice_frames):
        b = min(n, a + slice_frames)
        frames = np.lib.stride_tricks.sliding_window_view(samples[a * HOP : (b - 1) * HOP + FRAME], FRAME)[::HOP]
        out[a:b] = (np.abs(np.fft.rfft(frames * window, axis=1)[:, use]) ** 2) @ bins
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return np.where(norm > 1e-3, out / np.maximum(norm, 1e-9), 0)


def numbers(image: np.ndarray) -> np.ndarray:
    """A 32-bit number for every frame that begins a whole span."""
    n = len(image) - SPAN + 1
    if n <= 0:
        return np.zeros(0, np.uint32)
    total = np.zeros((len(image) + 1, 13))
    total[1:, 1:] = image.cumsum(0).cumsum(1)
    t = np.arange(n)

    def box(x: int, y: int, w: int, h: int) -> np.ndarray:
        return total[t + x + w, y + h] - total[t + x, y + h] - total[t + x + w, y] + total[t + x, y]

    out = np.zeros(n, np.uint32)
    for kind, y, h, w in filters():
        whole, h2, w2, h3, w3 = box(0, y, w, h), h // 2, w // 2, max(1, h // 3), max(1, w // 3)
        if kind == 0:
            a, part = box(0, y, w, h2), w * h2
        elif kind == 1:
            a, part = box(0, y, w2, h), w2 * h
        elif kind == 2:
            a, part = box(0, y, w2, h2) + box(w2, y + h2, w - w2, h - h2), w2 * h2 + (w - w2) * (h - h2)
        elif kind == 3:
            a, part = box(w3, y, w3, h), w3 * h
        else:
            a, part = box(0, y + h3, w, h3), w * h3
        value = np.log((FLOOR + a / part) / (FLOOR + (whole - a) / (w * h - part)))
        level = (value > -QUANTILE).astype(np.uint32) + (value > 0) + (value > QUANTILE)
        out = (out << np.uint32(2)) | (level ^ (level >> np.uint32(1)))
    return out


def fingerprint(data: bytes | None) -> np.ndarray:
    return numbers(chroma(*decode(data)))


def render(vector: list[float] | None, rate: int = 8000, note: int = 512) -> bytes:
    """A recording that plays a vector: a note for each number, higher for larger ones. Null plays nothing."""
    v = np.nan_to_num(np.asarray([] if vector is None else [np.nan if x is None else x for x in vector], np.float64))
    if not len(v):
        return encode(np.zeros(0), rate)
    scale = np.sqrt(np.mean(v**2)) or 1.0
    pitch = np.round(12 * np.tanh(v / scale)) + 12
    freq = np.repeat(220 * 2 ** (pitch / 12), note)
    return encode(0.5 * np.sin(2 * np.pi * np.cumsum(freq) / rate), rate)


def _prints(make: Callable[[object], bytes | None], keep: str):
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared.single_threaded()
        for rb in rows:
            for a in range(0, rb.num_rows, 256):
                part = rb.slice(a, 256)
                found = [fingerprint(make(x)).view(np.int32) for x in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, pa.list_(pa.int32()))], [keep, "numbers"])

    return run


def fingerprints(media: DataFrame, key: str, column: str, make: Callable[[object], bytes | None] = lambda data: data) -> DataFrame:
    """(key, numbers). make: turns the column's value into WAV bytes."""
    kind = media.schema[key].dataType.simpleString()
    return media.select(key, column).mapInArrow(_prints(make, key), f"`{key}` {kind}, numbers array<int>")


def build(queries: list[tuple[list, np.ndarray]]) -> dict:
    """Sorted numbers of a block, where they come from, and the queries (ids with equal fingerprints, numbers)."""
    values = np.concatenate([q[1] for q in queries]) if queries else np.zeros(0, np.uint32)
    who = np.repeat(np.arange(len(queries)), [len(q[1]) for q in queries])
    at = np.concatenate([np.arange(len(q[1])) for q in queries]) if queries else np.zeros(0, np.int64)
    order = np.argsort(values, kind="stable")
    return {"values": values[order], "who": who[order], "at": at[order], "queries": queries}


def errors(a: np.ndarray, b: np.ndarray, offset: int) -> tuple[float, int]:
    """Share of differing bits where b starts offset frames into a (or before it), and the frames compared."""
    x, y = a[max(0, offset) :], b[max(0, -offset) :]
    n = min(len(x), len(y))
    return (float(np.bitwise_count(x[:n] ^ y[:n]).sum()) / (32 * n), n) if n else (1.0, 0)


def align(block: dict, own: np.ndarray) -> Iterator[tuple[int, int, float, int]]:
    """(query, offset of the recording in it, bit errors, overlap) of a block's queries that match."""
    low = np.searchsorted(block["values"], own)
    count = np.searchsorted(block["values"], own, "right") - low
    if not count.any():
        return
    mine = np.repeat(np.arange(len(own)), count)
    hit = np.repeat(low - np.cumsum(count) + count, count) + np.arange(count.sum())
    who, offset = block["who"][hit], block["at"][hit] - mine
    reach = 1 << 31
    votes, n = np.unique(who * (2 * reach) + offset + reach, return_counts=True)
    last, best = -1, None
    for k in [*votes[n >= VOTES].tolist(), None]:
        q = -2 if k is None else k // (2 * reach)
        if q != last:
            if best is not None:
                yield best
            last, best = q, None
        if k is None:
            continue
        at = k % (2 * reach) - reach
        wrong, overlap = errors(block["queries"][q][1], own, at)
        if wrong <= ERRORS and overlap >= OVERLAP and (best is None or (wrong, -overlap, at) < (best[2], -best[3], best[1])):
            best = (q, at, wrong, overlap)


def _search(block, key: str):
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared.single_threaded()
        index = block.value
        for rb in rows:
            out: list[tuple] = []
            for who, own in zip(rb.column(0).to_pylist(), rb.column(1), strict=True):
                own = np.asarray(own.values).astype(np.int32).view(np.uint32) if own.is_valid else np.zeros(0, np.uint32)
                for q, offset, wrong, overlap in align(index, own):
                    out += [(i, who, offset, wrong, overlap) for i in index["queries"][q][0] if i != who]
            kinds = (rb.schema.field(0).type, rb.schema.field(0).type, pa.int64(), pa.float64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate(kinds)], ["query_id", key, "offset", "bit_errors", "overlap"])

    return run


def blocks(queries: DataFrame, limit: int = BLOCK) -> Iterator[dict]:
    """Blocks of bounded size, streamed through the driver; equal fingerprints next to each other are one query."""
    block: list[tuple[list, np.ndarray]] = []
    size = 0
    for who, values in queries.where("size(numbers) > 0").orderBy(F.xxhash64("numbers"), "numbers").toLocalIterator():
        own = np.asarray(values, np.int32).view(np.uint32)
        if block and np.array_equal(block[-1][1], own) and len(block[-1][0]) < limit:
            block[-1][0].append(who)
            continue
        if block and size + len(own) > limit:
            yield build(block)
            block, size = [], 0
        block.append(([who], own))
        size += len(own)
    if block:
        yield build(block)


def search(spark: SparkSession, prints: DataFrame, queries: DataFrame, key: str) -> DataFrame:
    """query_id, key, offset, bit_errors and overlap of all recordings that match a query; both frames from fingerprints(), stored."""
    kind = prints.schema[key].dataType.simpleString()
    schema = f"query_id {kind}, `{key}` {kind}, offset long, bit_errors double, overlap long"
    found = None
    prints = prints.select(key, "numbers")
    for block in blocks(queries.select(key, "numbers")):
        part = prints.mapInArrow(_search(spark.sparkContext.broadcast(block), key), schema)
        found = part if found is None else found.unionByName(part)
    return found if found is not None else spark.createDataFrame([], schema)


def classes(prints: DataFrame, key: str, query: Column) -> DataFrame:
    """(class_id, numbers, rows, asked) of recordings with equal numbers: how many there are, and whether one is a query."""
    named = prints.where("size(numbers) > 0").groupBy("numbers")
    return named.agg(F.min(key).alias("class_id"), F.count("*").alias("rows"), F.max(query).alias("asked")).select("class_id", "numbers", "rows", "asked")


def match_vectors(spark: SparkSession, vectors: DataFrame, every: int = 50) -> DataFrame:
    """Play each vector, then look for the rows whose id is divisible by ``every`` among all.

    A row for each vector: vec_id; class_id, the least vec_id with the same fingerprint; matches, the other classes
    with a query that it matches, as (query_class, offset, bit_errors, overlap); is_query.
    """
    prints = shared.stored(spark, fingerprints(vectors, "vec_id", "embedding", render), "prints")
    asked = F.coalesce(F.col("vec_id") % every == 0, F.lit(False))
    found = shared.stored(spark, classes(prints, "vec_id", asked), "classes")
    pairs = search(spark, found, found.where("asked"), "class_id")
    matches = F.sort_array(F.collect_list(F.struct(F.col("query_id").alias("query_class"), "offset", "bit_errors", "overlap"))).alias("matches")
    # a class matches no more classes than there are queries
    matched = found.join(pairs.groupBy("class_id").agg(matches), "class_id", "left").select("class_id", "rows", "matches", F.xxhash64("numbers").alias("print"), "numbers")
    table = shared.stored(spark, matched, "matched")
    own = prints.select("vec_id", F.xxhash64("numbers").alias("print"), F.size("numbers").alias("n"), asked.alias("is_query"))
    # two fingerprints of one hash would be told apart by their numbers; such a table is refused
    if table.count() != table.select("print").distinct().count():
        raise ValueError("two fingerprints have the same hash")
    known = shared.joined(own.where("n > 0"), table.drop("numbers"), "print", "rows").select("vec_id", "class_id", "matches", "is_query")
    none = own.where("n <= 0 OR n IS NULL").select("vec_id", F.lit(None).cast(vectors.schema["vec_id"].dataType).alias("class_id"), F.lit(None).cast(table.schema["matches"].dataType).alias("matches"), "is_query")
    kind = table.schema["matches"].dataType.simpleString()
    return known.unionByName(none).withColumn("matches", F.coalesce("matches", F.array().cast(kind)))
