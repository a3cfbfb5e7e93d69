"""Near-duplicate classes by DartMinHash.

A document is the weighted set of its five-word shingles (a shorter one has one shingle of all its
words); a shingle weighs as often as it occurs. Over each shingle's weight axis lies a rank axis; the
plane is cut into strips (by powers of two of the weight) and cells of area one, and hashes alone say
how many darts hit a cell and where. Darts that land below a document's weights and below a rank
bound fall into COORDINATES buckets; the earliest in each is that coordinate of the signature. Two
documents agree in a coordinate with the probability of their weighted Jaccard similarity. A document
whose darts leave a coordinate empty throws again with a doubled bound.

Signatures are banded. Texts with the same words are one node from the start, so copies cost nothing
later. A bucket's pivot is the member that meets most others over all bands: among near copies, the
text they were made from. Nodes are compared with their buckets' pivots, the one they share most bands
with first. Buckets that still hold several classes are then compared across classes (not within), so
that no link found by banding is lost and no group is expanded into its pairs. Large buckets are cut
into blocks, which hold their members' shingles: small sketches of the signatures tell which pairs may
be similar, the shingles decide, and only links that join classes leave the block, fewer than it has
members. Links are always decided on the shingles themselves (as 32-bit hashes). Classes are connected
components, found with large-star and small-star steps, each stored in the shared folder.

Cases: null texts and texts without words are classes of their own; equal texts are one class, also
under one doc_id; a class is named by its least doc_id (null only if all are null); an empty table
gives an empty result; other columns are ignored. Words are folded runs of letters and digits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared, words
from .decontaminate import gram_hashes
from .words import mix

SHINGLE, SIMILARITY = 5, 0.8
#: At a similarity of 0.8 a pair shares none of 64 bands of 8 once in 130,000 times.
BANDS, ROWS = 64, 8
COORDINATES = BANDS * ROWS
#: Documents whose darts are thrown at once.
THROW = 48
#: Bits of the filter that spares most texts a second reading; 2 MB, whatever the corpus.
FILTER_BITS = 1 << 24
#: Buckets up to this size are compared by a join, larger ones in blocks of about so many members and shingles at most.
SMALL, BLOCK, MASS = 16, 1024, 4 << 20
#: Standard deviations below the wanted similarity at which a sketch still counts; a link is missed once in a thousand million times.
SLACK = 6.0
#: A key that holds more than one in so many of all rows is joined by broadcast: there are fewer of them than this.
HOT = 256
_POISSON = np.cumsum(np.exp(-1.0) / np.cumprod(np.concatenate([[1.0], np.arange(1, 24)])))


def _unit(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(11)).astype(np.float64) * 2.0**-53


def shingles(h: np.ndarray, offsets: np.ndarray, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, shingle, weight), sorted by text and shingle."""
    sizes = np.diff(offsets)
    at = np.arange(len(h))
    text = np.repeat(np.arange(len(sizes)), sizes)
    grams, who = [], []
    for k in range(1, n + 1):
        own = at + k <= np.repeat(offsets[1:], sizes) if k == n else (at == np.repeat(offsets[:-1], sizes)) & (np.repeat(sizes, sizes) == k)
        own = np.flatnonzero(own)
        if len(own):
            grams.append(gram_hashes(h, k)[own])
            who.append(text[own])
    if not grams:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    g, t = np.concatenate(grams), np.concatenate(who)
    order = np.argsort(g)
    order = order[np.argsort(t[order].astype(np.uint16 if len(sizes) < 65536 else np.int64), kind="stable")]
    g, t = g[order], t[order]
    new = np.flatnonzero(np.concatenate([[True], (g[1:] != g[:-1]) | (t[1:] != t[:-1])]))
    return t[new], g[new], np.diff(np.append(new, len(g)))


def dart_minhash(text: np.ndarray, element: np.ndarray, weight: np.ndarray, n: int, k: int = COORDINATES, darts: float | None = None) -> np.ndarray:
    """Signatures (n x k) of weighted sets given as rows (text, element, weight > 0); every text has a row."""
    darts = darts or k * (np.log(k) + 3)
    out = np.zeros((n, k), np.uint64)
    bound = darts / np.bincount(text, weights=weight, minlength=n)
    # strips of the weight axis: [0,1), [1,2), [2,4), ...
    strips = 1 + np.ceil(np.log2(np.maximum(weight, 1))).astype(np.int64)
    row = np.repeat(np.arange(len(text)), strips)
    j = np.arange(len(row)) - np.repeat(np.cumsum(strips) - strips, strips)
    wide = np.where(j == 0, 1.0, 2.0 ** (j - 1.0))
    low = np.where(j == 0, 0.0, wide)
    seed = mix(element[row] + j.astype(np.uint64) * np.uint64(0x9FB21C651E98DF25))
    # cells of area one along the rank axis
    cells = np.ceil(bound[text[row]] * wide).astype(np.int64)
    strip = np.repeat(np.arange(len(row)), cells)
    i = np.arange(len(strip)) - np.repeat(np.cumsum(cells) - cells, cells)
    seed = mix(seed[strip] + i.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    hits = np.searchsorted(_POISSON, _unit(seed), "right")
    cell = np.repeat(np.arange(len(strip)), hits)
    d = np.arange(len(cell)) - np.repeat(np.cumsum(hits) - hits, hits)
    dart = mix(seed[cell] + (d.astype(np.uint64) + np.uint64(1)) * np.uint64(0xA0761D6478BD642F))
    s = strip[cell]
    own = text[row[s]]
    rank = (i[cell] + _unit(dart)) / wide[s]
    place = low[s] + wide[s] * _unit(mix(dart + np.uint64(1)))
    keep = (place < weight[row[s]]) & (rank <= bound[own])
    dart, own, rank = dart[keep], own[keep], rank[keep]
    slot = own * k + (mix(dart + np.uint64(2)) % np.uint64(k)).astype(np.int64)
    best = np.full(n * k, np.inf)
    np.minimum.at(best, slot, rank)
    first = rank == best[slot]
    out.ravel()[slot[first]] = dart[first]
    short = np.flatnonzero(np.isinf(best.reshape(n, k)).any(1))
    if len(short):
        again = np.isin(text, short)
        out[short] = dart_minhash(np.searchsorted(short, text[again]), element[again], weight[again], len(short), k, 2 * darts)
    return out


def bands(signatures: np.ndarray, count: int = BANDS) -> np.ndarray:
    n, k = signatures.shape
    parts = signatures.reshape(n, count, k // count)
    out = np.zeros((n, count), np.uint64)
    for i in range(k // count):
        out = out * np.uint64(0x9E3779B97F4A7C15) + mix(parts[:, :, i] + np.uint64(i))
    return mix(out + np.arange(count, dtype=np.uint64) * np.uint64(0xE7037ED1A0B428DB))


def sketch(signatures: np.ndarray) -> np.ndarray:
    """Four bits of each coordinate, two coordinates a byte."""
    four = (mix(signatures) >> np.uint64(60)).astype(np.uint8)
    return (four[:, ::2] << 4) | four[:, 1::2]


def _same_words(h: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A hash of each text's words in order."""
    up, _ = words._power(int(np.diff(offsets).max(initial=0)) + 1)
    at = np.arange(len(h)) - np.repeat(offsets[:-1], np.diff(offsets))
    sums = np.concatenate([[np.uint64(0)], np.cumsum(mix(h) * up[at])])
    return mix(sums[offsets[1:]] - sums[offsets[:-1]] + np.diff(offsets).astype(np.uint64))


def _sign(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    shared.single_threaded()
    for rb in words.batches(rows, "text"):
        for first, h, offsets in words.texts_words(rb.column(1), words.ALNUM):
            n = len(offsets) - 1
            nodes = _same_words(h, offsets)
            for a in range(0, n, THROW):
                b = min(n, a + THROW)
                part, cuts = h[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                text, gram, weight = shingles(part, cuts)
                some = np.diff(cuts) > 0
                found, sketches = np.zeros((b - a, BANDS), np.uint64), np.zeros((b - a, COORDINATES // 2 + 4 * BANDS), np.uint8)
                if some.any():
                    place = np.cumsum(some) - 1
                    signatures = dart_minhash(place[text], gram, weight, int(some.sum()))
                    found[some] = bands(signatures)
                    sketches[some] = np.hstack([sketch(signatures), found[some].astype(np.uint32).view(np.uint8)])
                rank = pa.array(np.where(some, 0, 1), pa.int8())
                keys = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(some * BANDS)]), pa.int32()), pa.array(found[some].ravel().view(np.int64)))
                node = pa.array(nodes[a:b].view(np.int64), mask=~some)
                total = pa.array(np.bincount(text, weights=weight, minlength=b - a).astype(np.int64))
                yield pa.RecordBatch.from_arrays([rb.column(0).slice(first + a, b - a), rank, node, total, keys, pa.array([x.tobytes() for x in sketches], pa.binary())], ["doc_id", "wordless", "node", "weight", "bands", "sketch"])


def _arrays(bits):
    """Shingles of texts whose slot is in the filter: sorted 32-bit hashes and weights, packed."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared.single_threaded()
        have = bits.value
        codec = pa.Codec("zstd", 1)
        for rb in rows:
            slot = np.asarray(rb.column(0))
            rb = rb.filter(pa.array((have[slot >> 6] >> (slot & 63).astype(np.uint64)) & np.uint64(1) == 1))
            for small in words.batches([rb], "text"):
                for _, h, offsets in words.texts_words(small.column(1), words.ALNUM):
                    nodes = _same_words(h, offsets)
                    text, gram, weight = shingles(h, offsets)
                    cuts = np.searchsorted(text, np.arange(len(offsets)))
                    out = []
                    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                        top, count = (gram[a:b] >> np.uint64(32)).astype(np.uint32), weight[a:b].astype(np.uint32)
                        step = np.diff(top, prepend=np.uint32(0))
                        body = np.stack([step, count]).view(np.uint8).reshape(2 * (b - a), 4).T.tobytes()
                        out.append(int(b - a).to_bytes(4, "little") + codec.compress(body).to_pybytes())
                    some = np.diff(offsets) > 0
                    yield pa.RecordBatch.from_arrays([pa.array(nodes.view(np.int64)[some]), pa.array([o for o, s in zip(out, some, strict=True) if s], pa.binary())], ["node", "grams"])

    return run


def _open(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = int.from_bytes(blob[:4], "little")
    both = np.frombuffer(pa.Codec("zstd").decompress(blob[4:], 8 * n), np.uint8).reshape(4, 2 * n).T
    steps, count = np.ascontiguousarray(both).view(np.uint32).reshape(2, n)
    return np.cumsum(steps, dtype=np.uint32), count


def jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    at = np.searchsorted(b[0], a[0])
    at[at == len(b[0])] = 0
    same = b[0][at] == a[0]
    common = int(np.minimum(a[1][same], b[1][at[same]]).sum())
    return common / (int(a[1].sum()) + int(b[1].sum()) - common)


def _across(similarity: float):
    """Links of a block (or between two) that join its classes, each pair looked at in the first band it shares."""
    chance = similarity + (1 - similarity) / 16
    least = (chance - SLACK * np.sqrt(chance * (1 - chance) / COORDINATES)) * COORDINATES

    def run(table: pa.Table) -> pa.Table:
        shared.single_threaded()
        get = lambda k: np.asarray(table[k])
        node, weight, own = get("node"), get("weight"), get("own")
        group = np.unique(get("label"), return_inverse=True)[1]
        two = table["low"][0].as_py() != table["high"][0].as_py()
        packed = np.frombuffer(b"".join(x.as_py() for x in table["sketch"]), np.uint8).reshape(len(node), -1)
        marks = np.ascontiguousarray(packed[:, COORDINATES // 2 :]).view(np.uint32)
        packed = packed[:, : COORDINATES // 2]
        here = int(np.argmax(marks[0] == np.uint32(table["band"][0].as_py() & 0xFFFFFFFF)))
        blobs, texts = table["grams"], {}

        def text(i: int) -> tuple[np.ndarray, np.ndarray]:
            if i not in texts:
                texts[i] = _open(blobs[i].as_py())
            return texts[i]

        left, right = [], []
        high, low = packed >> 4, packed & 15
        for i in range(len(node) - 1):
            rest = np.flatnonzero((group[i + 1 :] != group[i]) & (np.minimum(weight[i + 1 :], weight[i]) >= similarity * np.maximum(weight[i + 1 :], weight[i]))) + i + 1
            if two:
                rest = rest[own[rest] != own[i]]
            if not len(rest):
                continue
            same = (high[rest] == high[i]).sum(1) + (low[rest] == low[i]).sum(1)
            good, same = rest[same >= least], same[same >= least]
            first = np.argmax(marks[good] == marks[i], axis=1) == here
            good, same = good[first], same[first]
            for j in good[np.argsort(-same, kind="stable")].tolist():
                if group[j] != group[i] and jaccard(text(i), text(j)) >= similarity:
                    left.append(max(node[i], node[j]))
                    right.append(min(node[i], node[j]))
                    group[group == group[j]] = group[i]
        return pa.table([pa.array(e, pa.int64()) for e in (left, right)], names=["a", "b"])

    return run


def _compare(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    shared.single_threaded()
    for rb in rows:
        left, right = rb.column(2), rb.column(3)
        found = [jaccard(_open(x.as_py()), _open(y.as_py())) for x, y in zip(left, right, strict=True)]
        yield pa.RecordBatch.from_arrays([rb.column(0), rb.column(1), pa.array(found, pa.float64())], ["a", "b", "similarity"])


def components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """(node, label) of all nodes in edges (a, b); a label is its component's least node."""
    now, before = shared.stored(spark, edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges"), None
    while True:
        state = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if state == before:
            break
        before = state
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").unionByName(least.select("a", F.col("m").alias("b"))).distinct()
        now = shared.stored(spark, small, "edges")
    return now.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("label"))).groupBy("node").agg(F.min("label").alias("label"))


def _filter(spark: SparkSession, ids: DataFrame):
    """A bit set of a fixed size over the hashes of the ids, broadcast."""
    slot = F.pmod(F.xxhash64(ids.columns[0]), F.lit(FILTER_BITS))
    found = ids.select(slot.alias("s")).groupBy(F.shiftright("s", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(s & 63 AS INT))")).alias("b")).toArrow()
    bits = np.zeros(FILTER_BITS // 64, np.uint64)
    bits[np.asarray(found["w"], dtype=np.int64)] = np.asarray(found["b"], dtype=np.int64).view(np.uint64)
    return spark.sparkContext.broadcast(bits)


def _keyed(rows: DataFrame, table: DataFrame, key: str, n: str) -> DataFrame:
    """rows with table's row for their key; table is a stored frame with one row a key, n how many of rows hold it.
    Keys with a large share of the rows stay where they are, so that none of them lands in one task."""
    total = table.agg(F.sum(n)).first()[0] or 0
    hot = table.where(F.col(n) * HOT > total)
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(table.where(F.col(n) * HOT <= total), key)
    return rows.join(F.broadcast(hot), key).unionByName(rest)


def classes(spark: SparkSession, docs: DataFrame, similarity: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, node), node null without words; and nodes (node, rep, copies, label, class_id, class_size), rep its least doc_id."""
    ids = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    kind = ids.schema["doc_id"].dataType.simpleString()
    signed = shared.stored(spark, ids.mapInArrow(_sign, f"doc_id {kind}, wordless byte, node long, weight long, bands array<long>, sketch binary"), "signed")
    nodes = shared.stored(spark, signed.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.first("weight").alias("weight"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch")), "nodes")
    rows = nodes.select("node", "weight", F.explode("bands").alias("band"))
    buckets = shared.stored(spark, rows.groupBy("band").agg(F.count("*").alias("n")).where("n > 1"), "buckets")
    met = shared.stored(spark, _keyed(rows, buckets, "band", "n").select("band", "node", "weight", "n"), "met")
    degrees = met.groupBy("node").agg(F.sum("n").alias("degree"))
    pivots = met.join(degrees, "node").groupBy("band").agg(F.max(F.struct("degree", "node"))["node"].alias("pivot"), F.count("*").alias("n"))
    members = shared.stored(spark, _keyed(met.drop("n"), shared.stored(spark, pivots, "pivots"), "band", "n").select("band", "node", "pivot", "weight", "n"), "members")
    wanted = members.select("node").distinct().join(nodes.select("node", "rep"), "node")
    bits = _filter(spark, wanted.select("rep"))
    slotted = ids.select(F.pmod(F.xxhash64("doc_id"), F.lit(FILTER_BITS)).alias("slot"), "text")
    grams = shared.stored(spark, slotted.mapInArrow(_arrays(bits), "node long, grams binary").join(wanted.select("node"), "node", "left_semi").dropDuplicates(["node"]), "grams")

    def links(pairs: DataFrame) -> DataFrame:
        left, right = grams.select(F.col("node").alias("a"), F.col("grams").alias("ga")), grams.select(F.col("node").alias("b"), F.col("grams").alias("gb"))
        both = pairs.join(left, "a").join(right, "b").select("a", "b", "ga", "gb")
        return both.mapInArrow(_compare, "a long, b long, similarity double")

    stars = shared.stored(spark, members.where("node <> pivot").groupBy("node", "pivot").agg(F.count("*").alias("n")), "stars")
    first = stars.groupBy("node").agg(F.max(F.struct("n", -F.col("pivot"), "pivot"))["pivot"].alias("b")).select(F.col("node").alias("a"), "b")
    tried = shared.stored(spark, links(first), "links")
    labels = shared.stored(spark, components(spark, tried.where(F.col("similarity") >= similarity).select("a", "b")), "labels")

    def joined(pairs: DataFrame, known: DataFrame | None = None) -> DataFrame:
        """Compare pairs (a > b) that haven't been; the labels with the links found and those known."""
        nonlocal tried
        done = tried.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        more = shared.stored(spark, links(pairs.join(done, ["a", "b"], "left_anti")), "links")
        tried = tried.unionByName(more)
        found = more.where(F.col("similarity") >= similarity).select("a", "b")
        found = found if known is None else found.unionByName(known)
        if not found.take(1):
            return labels
        return shared.stored(spark, components(spark, found.unionByName(labels.select(F.col("node").alias("a"), F.col("label").alias("b")))), "labels")

    def label(of: str, into: str) -> DataFrame:
        return labels.select(F.col("node").alias(of), F.col("label").alias(into))

    # the other pivots, where they'd join classes
    apart = stars.join(label("node", "la"), "node", "left").join(label("pivot", "lb"), "pivot", "left").where(F.coalesce("la", "node") != F.coalesce("lb", "pivot"))
    labels = joined(apart.select(F.greatest("node", "pivot").alias("a"), F.least("node", "pivot").alias("b")).distinct())
    # buckets that still hold several classes: compare across classes
    at = members.join(labels, "node", "left").select("band", "node", "weight", "n", F.coalesce("label", "node").alias("label"))
    mixed = at.groupBy("band").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("n"), F.sum("weight").alias("mass")).where("low <> high").select("band", "n", "mass")
    at = shared.stored(spark, _keyed(at.drop("n"), shared.stored(spark, mixed, "apart"), "band", "n"), "mixed")
    small = at.where(F.col("n") <= SMALL)
    other = small.select("band", F.col("node").alias("b"), F.col("weight").alias("wb"), F.col("label").alias("lb"))
    cross = small.select("band", F.col("node").alias("a"), F.col("weight").alias("wa"), F.col("label").alias("la")).join(other, "band")
    # a weighted Jaccard similarity is at most the quotient of the weights
    cross = cross.where((F.col("a") > F.col("b")) & (F.col("la") != F.col("lb")) & (F.least("wa", "wb") >= F.greatest("wa", "wb") * similarity)).select("a", "b")
    large = at.where(F.col("n") > SMALL).join(nodes.select("node", "sketch"), "node").join(grams, "node")
    parts = F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("mass") / MASS)).cast("int")
    own = F.pmod(F.xxhash64("node"), parts).cast("int")
    dealt = large.select("band", "node", "weight", "label", "sketch", "grams", own.alias("own"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("other"))
    dealt = dealt.withColumn("low", F.least("own", "other")).withColumn("high", F.greatest("own", "other")).drop("other")
    blocks = dealt.groupBy("band", "low", "high").applyInArrow(_across(similarity), "a long, b long")
    labels = joined(cross.distinct(), shared.stored(spark, blocks.distinct(), "blocks"))
    # a class's name and size
    named = nodes.select("node", "rep", "copies").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    named = shared.stored(spark, named, "named")
    names = named.groupBy("label").agg(F.min("rep").alias("class_id"), F.sum("copies").alias("class_size"), F.count("*").alias("nodes"))
    return signed, shared.stored(spark, _keyed(named, shared.stored(spark, names, "names"), "label", "nodes").drop("nodes"), "classes")


def near_duplicates(spark: SparkSession, docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, class_id, class_size of every row of docs."""
    signed, nodes = classes(spark, docs, similarity)
    placed = _keyed(signed.where("node is not null").select("doc_id", "node"), nodes.select("node", "copies", "class_id", "class_size"), "node", "copies")
    alone = signed.where("node is null").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(1).cast("long").alias("class_size"))
    return placed.select("doc_id", "class_id", "class_size").unionByName(alone)


def _nodes(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    shared.single_threaded()
    for rb in words.batches(rows, "text"):
        out = [pa.array(_same_words(h, o).view(np.int64), mask=np.diff(o) == 0) for _, h, o in words.texts_words(rb.column(0), words.ALNUM)]
        columns = [*rb.columns[1:], pa.concat_arrays(out)]
        yield pa.RecordBatch.from_arrays(columns, [f"c{i}" for i in range(len(columns))])


def clean(spark: SparkSession, docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One row of each class, that of its least doc_id, with all columns as they were."""
    signed, nodes = classes(spark, docs, similarity)
    columns = [shared.quoted(c) for c in docs.columns]
    node, own = shared.fresh(docs.columns, "node", "least")
    if not signed.groupBy("doc_id").count().where("count > 1").take(1):
        copies = _keyed(signed.where("node is not null").select("doc_id", "node"), nodes.select("node", "copies", "class_id"), "node", "copies").where(~F.col("doc_id").eqNullSafe(F.col("class_id"))).select(F.col("doc_id").alias(own))
        return docs.join(copies, F.col("doc_id").eqNullSafe(F.col(own)), "left_anti")
    # ids that repeat don't tell rows apart: go by the texts' words. Equal rows are one before they are dealt
    rows = docs.select(F.coalesce("text", F.lit("")).alias("text"), *(c.alias(f"c{i}") for i, c in enumerate(columns)))
    rows = rows.mapInArrow(_nodes, shared.with_fields(docs, docs.columns, (node, "long")))
    stays = nodes.groupBy("label").agg(F.min(F.struct(F.col("rep").isNull(), F.col("rep"), F.col("node"))).alias("s")).select(F.col("s.node").alias("stays"), F.col("s.rep").alias(own))
    single = rows.where(F.col(node).isNotNull()).groupBy(node, "doc_id").agg(F.first(F.struct(*columns)).alias("row"))
    kept = single.join(stays, (F.col(node) == F.col("stays")) & F.col("doc_id").eqNullSafe(F.col(own)), "left_semi")
    return kept.select("row.*").unionByName(rows.where(F.col(node).isNull()).select(*columns))
