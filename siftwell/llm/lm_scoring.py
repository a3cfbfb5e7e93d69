"""Language-model scoring: an interpolated modified Kneser-Ney model of order two or three.

A first pass finds the frequent words, of which there are a bounded number. Counting is a shuffle for each
order. Workers count the n-grams of a few million tokens at a time and send one packed block per shard.
N-grams are dealt by the word before their last, those of frequent words by the whole n-gram, so that no word
fills a shard; a frequent n-gram is one entry of each block. A shard merges its blocks, writes its part of the
model as sorted hash arrays and sends on what its n-grams say about those shorter by a word (as contexts: how
many tokens follow and how many kinds once, twice and more often; as ends: how many kinds go before), again
packed, to the shards of these. The driver gets one row of totals per shard. Scoring workers memory-map the
arrays from the shared folder; pages that are not needed are never read.

Before a text stand as many begin marks as the order asks for; lower orders count the kinds of words before
these too. Words are 64-bit hashes, n-grams hashes of those. Cases: a null text is an empty one and has just
its end token; a null doc_id counts as the empty text when the fold is computed; repeated rows are counted and
returned as often as they occur; without training tokens every token has probability 1/(V+1) with V = 0; other
columns are ignored.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared, words
from .words import mix, pair

#: Two numbers for the begin and the end of a text. Words are known by hashes, which meet neither of the two but by chance.
BEGIN, END = np.uint64(1), np.uint64(2)
#: The model's order: 2 or 3. At three the check tool stops the run: it takes more than four times the input's disk.
ORDER = 2
#: Tokens that a worker counts before it sends them.
FLUSH = 3_000_000
#: Bytes of documents for which one shard is made, by order.
SHARD_BYTES = {2: 24 << 20, 3: 8 << 20}
#: A word is frequent from this part of a shard's mean tokens on; so there are at most shards / HOT of them.
HOT = 1 / 8
#: Counts of counts: how many n-grams of two and three words have a count of one to four.
SEEN = tuple(f"n{n}_{i}" for n in (2, 3) for i in (1, 2, 3, 4))
STATS = ("tokens", "types", "pairs", *(f"n1_{i}" for i in (1, 2, 3, 4)), "n1_more", *SEEN)
FIELDS = ("total", "ones", "twos", "more", "raw", "cont")


def _pack(arrays: list[np.ndarray]) -> bytes:
    """Arrays as bytes; sorted hashes shrink when their bytes are put in planes."""
    body = b"".join(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), -1).T.tobytes() for a in arrays)
    head = json.dumps([[a.dtype.str, len(a)] for a in arrays]).encode()
    return len(head).to_bytes(4, "little") + len(body).to_bytes(8, "little") + head + pa.Codec("zstd", 1).compress(body).to_pybytes()


def _unpack(blob: bytes) -> list[np.ndarray]:
    n, size = int.from_bytes(blob[:4], "little"), int.from_bytes(blob[4:12], "little")
    body = np.frombuffer(pa.Codec("zstd").decompress(blob[12 + n :], size), np.uint8) if size else np.zeros(0, np.uint8)
    out, at = [], 0
    for kind, length in json.loads(blob[12 : 12 + n]):
        wide = np.dtype(kind).itemsize
        out.append(np.ascontiguousarray(body[at : at + wide * length].reshape(wide, length).T).view(kind).reshape(length))
        at += wide * length
    return out


def _narrow(a: np.ndarray) -> np.ndarray:
    """The same numbers (none negative) in as few bytes as hold them."""
    top = int(a.max(initial=0))
    return a.astype(next(k for k in (np.uint8, np.uint16, np.uint32, np.uint64) if top <= np.iinfo(k).max))


def _put_arrays(uri: str, arrays: list[np.ndarray]) -> None:
    """Arrays as a file to be mapped, each from a multiple of eight bytes on."""
    head = json.dumps([[a.dtype.str, len(a)] for a in arrays]).encode()
    parts = [len(head).to_bytes(8, "little"), head, b"\0" * (-len(head) % 8)]
    for a in arrays:
        parts += [a.tobytes(), b"\0" * (-a.nbytes % 8)]
    shared.put_bytes(uri, b"".join(parts))


def _map_arrays(uri: str) -> list[np.ndarray] | None:
    """Arrays that _put_arrays wrote; None if there is no such file."""
    try:
        raw = shared.map_bytes(uri)
    except FileNotFoundError:
        return None  # no hash fell in this shard
    n = int.from_bytes(raw[:8], "little")
    out, at = [], 8 + n + -n % 8
    for kind, length in json.loads(bytes(raw[8 : 8 + n])):
        out.append(np.frombuffer(raw, kind, length, at))
        at += out[-1].nbytes + -out[-1].nbytes % 8
    return out


def _merge(keys: np.ndarray, *sums: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Sorted distinct keys, where each was first found, and the sums over equal keys."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[at], order[at], [np.add.reduceat(s[order], at, dtype=np.uint64) if len(at) else s[:0].astype(np.uint64) for s in sums]


def _grams(hashes: np.ndarray, offsets: np.ndarray, order: int) -> tuple[list[np.ndarray], np.ndarray]:
    """The n-grams' words, one array for each place, a row for each token (an end after each text); and the texts' offsets into them."""
    begins = offsets + np.arange(len(offsets))
    places = [np.insert(hashes, offsets[1:], END)]
    for _ in range(order - 1):
        before = np.empty_like(places[0])
        before[1:] = places[0][:-1]
        before[begins[:-1]] = BEGIN
        places.insert(0, before)
    return places, begins


def _contains(ordered: np.ndarray, values: np.ndarray) -> np.ndarray:
    at = np.searchsorted(ordered, values)
    at[at == len(ordered)] = 0
    return ordered[at] == values if len(ordered) else np.zeros(len(values), bool)


def gram_keys(places: list[np.ndarray], hot: np.ndarray, shards: int) -> np.ndarray:
    """Hashes of n-grams; the first bits say the shard. A single word is its own hash."""
    whole = places[0]
    if len(places) == 1:
        return whole
    for p in places[1:]:
        whole = pair(whole, p)
    bits = np.uint64(shards.bit_length() - 1)
    deal = np.where(_contains(hot, places[-2]), whole, mix(places[-2] + np.uint64(0x5851F42D4C957F2D)))
    return ((deal >> (np.uint64(64) - bits)) << (np.uint64(64) - bits)) | (whole * np.uint64(0xD1342543DE82EF95) >> bits)


def _frequent(shards: int):
    """Words with their counts where they may be frequent: half the share in this partition, or more."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared.single_threaded()
        keys, counts, n = np.zeros(0, np.uint64), np.zeros(0, np.uint64), 0
        for rb in words.batches(rows, "text"):
            for _, hashes, offsets in words.texts_words(rb.column(0), words.SPACED, 4 << 20):
                uniq, c = np.unique(hashes, return_counts=True)
                n += len(hashes)
                # rare ones of a chunk are left out: a word this rare in every chunk isn't frequent
                much = c > len(hashes) * HOT / shards / 4
                keys, _, (counts,) = _merge(np.concatenate([keys, uniq[much]]), np.concatenate([counts, c[much].astype(np.uint64)]))
        much = counts >= n * HOT / shards / 2
        yield pa.RecordBatch.from_arrays([pa.array(keys[much].view(np.int64)), pa.array(counts[much].view(np.int64)), pa.array(np.zeros(much.sum(), np.int64))], ["word", "n", "tokens"])
        yield pa.RecordBatch.from_arrays([pa.array([0], pa.int64()), pa.array([0], pa.int64()), pa.array([n], pa.int64())], ["word", "n", "tokens"])

    return run


def frequent(column: DataFrame, shards: int) -> np.ndarray:
    """The frequent words' hashes, sorted, and the begin of a text."""
    found = column.mapInArrow(_frequent(shards), "word long, n long, tokens long").groupBy("word").agg(F.sum("n").alias("n"), F.sum("tokens").alias("tokens"))
    # at most 4 x shards / HOT words a partition, and one row of tokens
    rows = found.where("tokens > 0").union(found.orderBy(F.desc("n")).limit(int(shards / HOT) + 1)).toArrow()
    total = max(np.asarray(rows["tokens"]).tolist(), default=0)
    hot = rows.filter(pa.array(np.asarray(rows["n"]) > total * HOT / shards))
    return np.unique(np.concatenate([np.asarray(hot["word"], dtype=np.int64).view(np.uint64), [BEGIN]]).astype(np.uint64))


def _dealt(keys: np.ndarray, places: list[np.ndarray], sums: list[np.ndarray], shards: int) -> tuple[list[int], list[bytes]]:
    """N-grams by their sorted keys, in a block for each shard: their words (as numbers in a list of them) and sums."""
    bits = np.uint64(64 - (shards.bit_length() - 1))
    cuts = np.searchsorted(keys >> bits, np.arange(shards + 1, dtype=np.uint64)) if shards > 1 else np.array([0, len(keys)])
    ids, blobs = [], []
    for k in range(shards):
        a, b = cuts[k], cuts[k + 1]
        if a < b:
            known, codes = np.unique(np.concatenate([p[a:b] for p in places]), return_inverse=True)
            codes = _narrow(codes).reshape(len(places), -1)
            # the word by which n-grams are dealt is in order, so that its steps are small
            lead = max(0, len(places) - 2)
            order = np.argsort(codes[lead], kind="stable")
            steps = np.diff(codes[lead][order], prepend=codes.dtype.type(0))
            ids.append(k)
            blobs.append(_pack([known, *(steps if i == lead else c[order] for i, c in enumerate(codes)), *(_narrow(s[a:b][order]) for s in sums)]))
    return ids, blobs


def _opened(blob: bytes, order: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    known, *rest = _unpack(blob)
    codes, lead = rest[:order], max(0, order - 2)
    codes[lead] = np.cumsum(codes[lead], dtype=np.int64)
    return [known[c] for c in codes], rest[order:]


def _collected(table: pa.Table, order: int, hot: np.ndarray, shards: int) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """Sorted keys, words and sums of the distinct n-grams in a shard's blocks."""
    opened = [_opened(b.as_py(), order) for b in table.column("block")]
    places = [np.concatenate(x) for x in zip(*(p for p, _ in opened), strict=True)]
    parts = [np.concatenate(x) for x in zip(*(s for _, s in opened), strict=True)]
    del opened
    keys, first, sums = _merge(gram_keys(places, hot, shards), *parts)
    return keys, [p[first] for p in places], sums


def _blocks(held: list[list[np.ndarray]], hot: np.ndarray, shards: int) -> pa.RecordBatch:
    places = [np.concatenate(x) for x in zip(*held, strict=True)]
    held.clear()
    keys, first, sums = _merge(gram_keys(places, hot, shards), np.ones(len(places[0]), np.uint8))
    ids, blobs = _dealt(keys, [p[first] for p in places], sums, shards)
    none = pa.array(np.zeros(len(ids), np.int64))
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), pa.array(blobs, pa.binary()), *[none] * len(SEEN)], ["shard", "block", *SEEN])


def _count(order: int, shards: int, hot: np.ndarray):
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared.single_threaded()
        held, n = [], 0
        for rb in words.batches(rows, "text"):
            for _, hashes, offsets in words.texts_words(rb.column(0), words.SPACED):
                places, _ = _grams(hashes, offsets, order)
                held.append(places)
                n += len(places[0])
                if n >= FLUSH:
                    yield _blocks(held, hot, shards)
                    n = 0
        if n:
            yield _blocks(held, hot, shards)

    return run


def _shorter(places: list[np.ndarray], count: np.ndarray, raw: np.ndarray, hot: np.ndarray, shards: int) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """What n-grams say about those shorter by a word: FIELDS of their contexts and of their ends."""
    context, end = places[:-1], places[1:]
    keys, first, sums = _merge(gram_keys(context, hot, shards), count, *((x).astype(np.uint8) for x in (count == 1, count == 2, count > 2)))
    keys2, first2, sums2 = _merge(gram_keys(end, hot, shards), raw, np.ones(len(raw), np.uint8))
    zero, zero2 = np.zeros(len(keys), np.uint8), np.zeros(len(keys2), np.uint8)
    places = [np.concatenate([c[first], e[first2]]) for c, e in zip(context, end, strict=True)]
    parts = [*(np.concatenate([s, zero2]) for s in sums), *(np.concatenate([zero, s]) for s in sums2)]
    keys, first, sums = _merge(np.concatenate([keys, keys2]), *parts)
    return keys, [p[first] for p in places], sums


def _gram_shard(n: int, order: int, folder: str, shards: int, hot: np.ndarray):
    """Merge the n-grams of a shard, write their arrays and send on what they say about shorter ones."""

    def run(table: pa.Table) -> pa.Table:
        shared.single_threaded()
        keys, places, sums = _collected(table, n, hot, shards)
        uri = f"{folder}/{n}-{table.column('shard')[0].as_py()}"
        if n == order:
            count = raw = sums[0]
            plain = count == 1
            _put_arrays(uri, [keys[plain], keys[~plain], _narrow(count[~plain])])
        else:
            total, ones, twos, more, raw, count = sums
            plain = (count == 1) & (total == 1)
            _put_arrays(uri, [keys[plain], keys[~plain], *(_narrow(s[~plain]) for s in (count, total, ones, twos, more))])
            ends = count > 0  # the others are only contexts
            places, count, raw = [p[ends] for p in places], count[ends], raw[ends]
        have = {s: int(np.asarray(table.column(s)).sum()) for s in SEEN} | {f"n{n}_{i}": int(np.count_nonzero(count == i)) for i in (1, 2, 3, 4)}
        ids, blobs = _dealt(*_shorter(places, count, raw, hot, shards), shards)
        numbers = [pa.array([have[s]] + [0] * (len(ids) - 1), pa.int64()) for s in SEEN]
        return pa.table([pa.array(ids, pa.int32()), pa.array(blobs, pa.binary()), *numbers], names=["shard", "block", *SEEN])

    return run


def _word_shard(folder: str, shards: int, hot: np.ndarray):
    def run(table: pa.Table) -> pa.Table:
        shared.single_threaded()
        ids, _, sums = _collected(table, 1, hot, shards)
        _put_arrays(f"{folder}/1-{table.column('shard')[0].as_py()}", [ids, *map(_narrow, sums)])
        raw, cont = sums[4], sums[5]
        have = {"tokens": raw.sum(), "types": np.count_nonzero(raw), "pairs": cont.sum(), "n1_more": np.count_nonzero(cont >= 3)}
        have |= {s: np.asarray(table.column(s)).sum() for s in SEEN} | {f"n1_{i}": np.count_nonzero(cont == i) for i in (1, 2, 3, 4)}
        return pa.table({k: pa.array([int(have[k])], pa.int64()) for k in STATS})

    return run


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """Chen and Goodman's three discounts; 0.5, 1 and 1.5 where counts of counts are missing."""
    if not (n1 and n2 and n3 and n4):
        return 0.5, 1.0, 1.5
    y = n1 / (n1 + 2 * n2)
    d = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
    return d if all(0 < x < i + 1 for i, x in enumerate(d)) else (0.5, 1.0, 1.5)


def train(spark: SparkSession, docs: DataFrame, text: str = "text", order: int = ORDER) -> dict:
    """Fit on all rows of docs. The model: its folder, order, number of shards, totals and discounts."""
    column = docs.select(F.coalesce(F.col(text), F.lit("")).alias("text"))
    shards = shared.power_of_two(shared.frame_bytes(docs, text) / SHARD_BYTES[order], 8)
    folder = shared.shared_dir(spark, "ngrams")
    hot = frequent(column, shards)
    kinds = ", ".join(["shard int, block binary", *(f"{k} long" for k in SEEN)])
    held = column.mapInArrow(_count(order, shards, hot), kinds)
    # a task for each shard: how many are in one doesn't hang on the session
    for n in range(order, 1, -1):
        held = held.repartition(shards, "shard").groupBy("shard").applyInArrow(_gram_shard(n, order, folder, shards, hot), kinds)
    totals = held.repartition(shards, "shard").groupBy("shard").applyInArrow(_word_shard(folder, shards, hot), ", ".join(f"{k} long" for k in STATS))
    row = totals.agg(*(F.coalesce(F.sum(k), F.lit(0)).alias(k) for k in STATS)).first()
    model = {k: int(row[k]) for k in STATS} | {"folder": folder, "order": order, "shards": shards, "hot": hot}
    return model | {f"d{n}": discounts(*(model[f"n{n}_{i}"] for i in (1, 2, 3, 4))) for n in range(1, order + 1)}


class Model:
    """The sorted hash arrays, mapped shard by shard when first needed."""

    def __init__(self, meta: dict):
        self.meta, self.mapped = meta, {}
        self.bits = np.uint64(64 - (meta["shards"].bit_length() - 1))

    def _arrays(self, n: int, shard: int) -> list[np.ndarray] | None:
        if (n, shard) not in self.mapped:
            self.mapped[n, shard] = _map_arrays(f"{self.meta['folder']}/{n}-{shard}")
        return self.mapped[n, shard]

    @staticmethod
    def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(keys, wanted)
        at[at == len(keys)] = 0
        hit = keys[at] == wanted if len(keys) else np.zeros(len(wanted), bool)
        return at, hit

    def _by_shard(self, keys: np.ndarray) -> Iterator[tuple[int, int, int]]:
        shard, at = np.unique(keys >> self.bits, return_index=True)
        yield from zip(shard.tolist(), at.tolist(), [*at[1:].tolist(), len(keys)], strict=True)

    def rows(self, n: int, keys: np.ndarray) -> np.ndarray:
        """What is held of sorted n-grams, one row for each number: of words FIELDS; of longer ones their count and, below
        the model's order, as contexts total, ones, twos and more."""
        out = np.zeros((len(FIELDS) if n == 1 else 1 if n == self.meta["order"] else 5, len(keys)))
        for k, a, b in self._by_shard(keys):
            if (arrays := self._arrays(n, k)) is None:
                continue
            if n > 1:
                # of those held apart all numbers are known: once seen, followed by one kind once
                plain, *arrays = arrays
                out[:3, a:b][:, self._find(plain, keys[a:b])[1]] = 1
            at, hit = self._find(arrays[0], keys[a:b])
            for i, values in enumerate(arrays[1:]):
                out[i, a:b][hit] = values[at[hit]]
        return out

    def grams(self, places: list[np.ndarray]) -> np.ndarray:
        """rows() of n-grams in any order."""
        uniq, inverse = np.unique(gram_keys(places, self.meta["hot"], self.meta["shards"]), return_inverse=True)
        return self.rows(len(places), uniq)[:, inverse]

    def _step(self, n: int, count: np.ndarray, context: np.ndarray, lower: np.ndarray) -> np.ndarray:
        """Probabilities of order n from counts, the contexts' (total, ones, twos, more) and the next lower order's probabilities."""
        d = np.array([0.0, *self.meta[f"d{n}"]])
        total, ones, twos, more = context
        seen = np.maximum(total, 1)
        back = np.where(total > 0, (d[1] * ones + d[2] * twos + d[3] * more) / seen, 1.0)
        return np.maximum(count - d[np.minimum(count, 3).astype(int)], 0) / seen + back * lower

    def log10(self, places: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """log10 of the last words' probabilities after those before, and the last words' training counts."""
        m, n = self.meta, len(places[0])
        uniq, inverse = np.unique(np.concatenate(places[-2:]), return_inverse=True)
        known = self.rows(1, uniq)
        raw, cont = known[4], known[5]
        if m["pairs"]:
            d = np.array([0.0, *m["d1"]])
            rest = d[1] * m["n1_1"] + d[2] * m["n1_2"] + d[3] * m["n1_more"]
            uni = (np.maximum(cont - d[np.minimum(cont, 3).astype(int)], 0) + rest / (m["types"] + 1)) / m["pairs"]
        else:
            uni = np.full(len(uniq), 1 / (m["types"] + 1))
        v, w = inverse[:n], inverse[n:]
        if m["order"] == 2:
            p = self._step(2, self.grams(places)[0], known[:4, v], uni[w])
        else:
            pairs = self.grams([np.concatenate([a, b]) for a, b in zip(places[1:], places[:-1], strict=True)])
            p = self._step(2, pairs[0, :n], known[:4, v], uni[w])
            p = self._step(3, self.grams(places)[0], pairs[1:, n:], p)
        return np.log10(p), raw[w]


def _score(meta: dict, names: tuple[str, ...]):
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared.single_threaded()
        model = Model(meta)
        n, v1 = meta["tokens"], meta["types"] + 1
        for rb in words.batches(rows, "text", 6 << 20):
            texts = rb.column(rb.schema.get_field_index("text"))
            length, known, base, score = [], [], [], []
            for _, hashes, offsets in words.texts_words(texts, words.SPACED, 6 << 20):
                places, begins = _grams(hashes, offsets, meta["order"])
                logs, raw = model.log10(places)
                length.append(np.diff(begins))
                known.append(np.add.reduceat((raw > 0).astype(np.int64), begins[:-1]))
                base.append(np.add.reduceat(np.log10((raw + 0.1) / (n + 0.1 * v1)), begins[:-1]))
                score.append(np.add.reduceat(logs, begins[:-1]))
            kept = [rb.column(rb.schema.get_field_index(k)) for k in names]
            length, known, base, score = (np.concatenate(x) if x else np.zeros(0) for x in (length, known, base, score))
            yield pa.RecordBatch.from_arrays([*kept, pa.array(length.astype(np.int64)), pa.array(known.astype(np.int64)), pa.array(np.full(len(length), n, np.int64)), pa.array(base.astype(float)), pa.array(score.astype(float)), pa.array(10 ** (-score / np.maximum(length, 1)))], [*names, "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"])

    return run


def score(docs: DataFrame, model: dict, keep: dict[str, Column], text: str = "text") -> DataFrame:
    """keep: columns to carry along, by the names they get."""
    df = docs.select(*(c.alias(k) for k, c in keep.items()), F.coalesce(F.col(text), F.lit("")).alias("text"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name != "text")
    return df.mapInArrow(_score(model, tuple(keep)), f"{kinds}, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double")


def held_out(doc_id: Column, folds: int = 10, fold: int = 0) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds == fold


def lm_scores(spark: SparkSession, docs: DataFrame, order: int = ORDER) -> DataFrame:
    """Train on the rows that aren't held out and score all."""
    model = train(spark, docs.where(~held_out(F.col("doc_id"))), order=order)
    return score(docs, model, {"doc_id": F.col("doc_id"), "held_out": held_out(F.col("doc_id"))})
