"""Best-fit packing with certified bin counts.

Documents are tokenized once; a longer one than a sequence is cut so that only its first piece may
be shorter than a sequence. Full pieces are sequences of their own. All other pieces are dealt to
partitions of about PART_ROWS, each packed by best-fit decreasing. Dual feasible functions bound
from below how many bins a partition needs; where that many are used, the partition is certified, and
only its emptiest bin may still take in more. Partitions with a gap release the emptier half of their
bins. The released documents are dealt anew (to fewer partitions, by another hash) and packed again; the
new bins count only if they are fewer, so that an exchange never does harm. It ends when one doesn't
help or when one partition holds all. Pieces are dealt by their place, not by what they hold, so that
repeated rows spread.

Only lengths travel: a row of three numbers for a piece. Cases: a null or empty text is one token
(id 0); equal documents and repeated rows are packed as often as they occur; an empty table gives no
pieces; other columns are ignored.
"""

from __future__ import annotations

import base64
import itertools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared, words

CAPACITY = 2048
PART_ROWS = 50_000
SPECIAL = "<|endoftext|>"
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"

_coders: dict[str, tuple] = {}


def coder(vocabulary: str, ranks: str | None):
    """Texts to ids. Where the same vocabulary is given as ranks, a quicker coder with the same ids is used,
    except for texts that hold a special token's string."""
    if vocabulary not in _coders:
        from tokenizers import Tokenizer

        whole = Tokenizer.from_file(vocabulary)
        slow = lambda texts: [e.ids for e in whole.encode_batch(texts, add_special_tokens=False)]
        if ranks is None:
            _coders[vocabulary] = slow
        else:
            import public_tokenizers
            import tiktoken

            with open(ranks, "rb") as src:
                merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, src)}
            quick = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=merges, special_tokens={})
            _coders[vocabulary] = lambda texts: [slow([t])[0] if SPECIAL in t else quick.encode_ordinary(t) for t in texts]
    return _coders[vocabulary]


def _tokenize(vocabulary: str, ranks: str | None, capacity: int):
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared.single_threaded()
        code = coder(vocabulary, ranks)
        for rb in words.batches(rows, "text", 1 << 20):
            out: list[list] = [[] for _ in range(5)]
            for doc, ids in zip(rb.column(0).to_pylist(), code(rb.column(1).to_pylist()), strict=True):
                raw = np.array([*ids, 0], "<u4").tobytes()
                n = len(raw) // 4
                at, piece = 0, 0
                while at < n:
                    end = min(n, at + ((n - at) % capacity or capacity))
                    for values, x in zip(out, (doc, piece, at, end - at, zlib.crc32(raw[4 * at : 4 * end])), strict=True):
                        values.append(x)
                    at, piece = end, piece + 1
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def pieces(docs: DataFrame, vocabulary: str, ranks: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(_tokenize(vocabulary, ranks, capacity), PIECES)


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """The best of two families of dual feasible functions, over all their parameters that matter."""
    if not len(lengths):
        return 0
    count = np.bincount(lengths, minlength=capacity + 1).astype(np.int64)
    size = np.arange(capacity + 1, dtype=np.int64)
    best = -(-int((count * size).sum()) // capacity)
    # u_k: sizes whose (k+1)-fold is a multiple of the capacity stay, others round down to k-ths
    for k in range(1, 21):
        whole = ((k + 1) * size) % capacity == 0
        scaled = np.where(whole, size * k, ((k + 1) * size // capacity) * capacity)
        best = max(best, -(-int((count * scaled).sum()) // (capacity * k)))
    if capacity < 2:
        return best
    # f_e: sizes above capacity - e fill a bin, those below e vanish
    rows, mass = np.cumsum(count), np.cumsum(count * size)
    e = np.arange(1, capacity // 2 + 1)
    big = rows[-1] - rows[capacity - e]
    middle = mass[capacity - e] - mass[e - 1]
    return max(best, int((big - (-middle // capacity)).max()))


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best-fit decreasing: bin and offset of each item, and the bins' fills."""
    room_of: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0  # bit r: a bin with room r is open
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    fills: list[int] = []
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        fit = rooms >> n
        if fit:
            room = n + (fit & -fit).bit_length() - 1
            b = room_of[room].pop()
            if not room_of[room]:
                rooms &= ~(1 << room)
        else:
            room, b = capacity, len(fills)
            fills.append(0)
        bins[i], offsets[i] = b, fills[b]
        fills[b] += n
        if room > n:
            room_of[room - n].append(b)
            rooms |= 1 << (room - n)
    return bins, offsets, np.array(fills, np.int64)


PACKED = PIECES + ", part long, bin long, offset long, done boolean"


def _pack(capacity: int):
    def run(table: pa.Table) -> pa.Table:
        lengths = np.asarray(table["length"])
        bins, offsets, fills = best_fit(lengths, capacity)
        done = np.ones(len(fills), bool)
        if len(fills) > lower_bound(lengths, capacity):
            open_ = np.argsort(fills, kind="stable")[: -(-np.count_nonzero(fills < capacity) // 2)]
            done[open_] = False
        elif len(fills):
            # certified: as few bins as it can have. Its emptiest one may still be filled from elsewhere
            done[np.argmin(fills)] = False
        return table.append_column("bin", pa.array(bins)).append_column("offset", pa.array(offsets)).append_column("done", pa.array(done[bins])).select([x.split()[0] for x in PACKED.split(", ")])

    return run


def pack(spark: SparkSession, cut: DataFrame, capacity: int = CAPACITY, part_rows: int = PART_ROWS, rounds: int | None = None) -> DataFrame:
    """Pieces with sequence_id and offset. cut: a stored frame of pieces."""
    full = cut.where(F.col("length") == capacity)
    out = full.select(*(x.split()[0] for x in PIECES.split(", ")), (F.lit(-1) - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    columns = [*(x.split()[0] for x in PIECES.split(", ")), "sequence_id", "offset"]
    pool, held, bins = cut.where(F.col("length") < capacity), None, None
    n, base = pool.count(), 0
    for turn in itertools.count() if rounds is None else range(rounds):
        if not n:
            break
        place = ["sequence_id", "offset"] if turn else [F.monotonically_increasing_id()]
        parts = max(1, -(-n // part_rows))
        dealt = pool.select(*columns[:-2], F.pmod(F.xxhash64(*place, F.lit(turn)), F.lit(parts)).alias("part"))
        packed = shared.stored(spark, dealt.groupBy("part").applyInArrow(_pack(capacity), PACKED), "packed")
        number = F.lit(base) + F.shiftleft(F.col("part"), 26) + F.col("bin")
        placed = packed.select(*columns[:-2], number.alias("sequence_id"), "offset", "done")
        used = placed.agg(F.count_distinct("sequence_id").alias("all"), F.count_distinct(F.when(~F.col("done"), F.col("sequence_id"))).alias("open"), F.count_if(~F.col("done")).alias("rows")).first()
        if bins is not None and used["all"] >= bins:
            break  # no better than before
        out, base = out.unionByName(placed.where("done").select(*columns)), base + (parts << 26)
        pool = held = placed.where("NOT done")
        n, bins = used["rows"], used["open"]
        if parts == 1:
            break
    return out if held is None else out.unionByName(held.select(*columns))


def pack_documents(spark: SparkSession, docs: DataFrame, vocabulary: str, ranks: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of all pieces."""
    cut = shared.stored(spark, pieces(docs, vocabulary, ranks, capacity), "pieces")
    return pack(spark, cut, capacity)
