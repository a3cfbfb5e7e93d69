import numpy as np

from siftwell.llm import chroma


def song(seed, n=64):
    return np.random.default_rng(seed).normal(size=n)


def wav(vector, cut=0, noise=0.0, seed=0):
    samples, rate = chroma.decode(chroma.render(vector))
    samples = samples[cut:] + noise * np.random.default_rng(seed).normal(size=len(samples) - cut)
    return chroma.encode(samples, rate)


def test_odd_recordings():
    for data in (None, b"", b"RIFF", chroma.encode(np.zeros(0), 8000), chroma.encode(np.zeros(500), 8000)):
        assert len(chroma.fingerprint(data)) == 0
    assert len(set(chroma.fingerprint(chroma.encode(np.zeros(20_000), 8000)).tolist())) == 1
    assert len(chroma.fingerprint(chroma.render(None))) == 0 and len(chroma.fingerprint(chroma.render([None, float("nan")] * 40))) > 0


def test_slices_give_the_same_frames():
    samples, rate = chroma.decode(chroma.render(song(1)))
    assert np.allclose(chroma.chroma(samples, rate), chroma.chroma(samples, rate, 7))


def test_integral_image_against_sums():
    image = np.random.default_rng(2).random((30, 12))
    got = chroma.numbers(image)
    for t in range(len(image) - chroma.SPAN + 1):
        number = 0
        for kind, y, h, w in chroma.filters():
            area = image[t : t + w, y : y + h]
            part = {0: area[:, : h // 2], 1: area[: w // 2], 3: area[max(1, w // 3) : 2 * max(1, w // 3)], 4: area[:, max(1, h // 3) : 2 * max(1, h // 3)]}.get(kind)
            a, n = (part.sum(), part.size) if part is not None else (area[: w // 2, : h // 2].sum() + area[w // 2 :, h // 2 :].sum(), (w // 2) * (h // 2) + (w - w // 2) * (h - h // 2))
            value = np.log((chroma.FLOOR + a / n) / (chroma.FLOOR + (area.sum() - a) / (area.size - n)))
            level = int(value > -chroma.QUANTILE) + int(value > 0) + int(value > chroma.QUANTILE)
            number = number << 2 | level ^ level >> 1
        assert got[t] == number


def brute(prints, every):
    """Every offset of every pair."""
    found = set()
    for q, a in prints:
        if q % every == 0:
            for v, b in prints:
                if v != q and len(a) and len(b):
                    best = min((chroma.errors(a, b, k) for k in range(-len(b) + chroma.OVERLAP, len(a) - chroma.OVERLAP + 1)), default=(1, 0))
                    if best[0] <= chroma.ERRORS:
                        found.add((q, v))
    return found


def test_search_against_every_offset(spark):
    rows = [(i, wav(song(i))) for i in range(12)]
    rows += [(20, wav(song(0), cut=chroma.HOP * 20)), (21, wav(song(0), noise=0.01)), (22, wav(song(5), cut=chroma.HOP * 7, noise=0.005)), (30, wav(song(0))), (31, None), (40, b"junk")]
    df = spark.createDataFrame([(i, bytearray(w) if w else None, 1) for i, w in rows], "vec_id long, audio binary, offset int")
    prints = chroma.shared.stored(spark, chroma.fingerprints(df, "vec_id", "audio"), "prints")
    found = chroma.search(spark, prints, prints.where("vec_id % 5 = 0"), "vec_id").collect()
    got = {(r["query_id"], r["vec_id"]): r for r in found}
    assert len(got) == len(found)
    want = brute([(i, chroma.fingerprint(w)) for i, w in rows], 5)
    assert {(0, 20), (0, 21), (0, 30), (30, 0), (20, 0), (5, 22)} <= set(got) <= want
    assert len(got) >= 0.9 * len(want)
    assert got[0, 20]["offset"] == 20 and got[20, 0]["offset"] == -20 and got[5, 22]["offset"] == 7 and got[0, 30]["bit_errors"] == 0


def test_long_silence_hides_no_match(spark):
    """Held tones vote for many offsets; the one where the passage lies is tried too."""
    r = np.random.default_rng(3)
    hold = [0.3] * 40
    rows = [(i, [*map(float, r.normal(size=30)), *hold, *map(float, song(i % 3, 40)), *hold]) for i in range(9)]
    df = spark.createDataFrame([(i, bytearray(chroma.render(v))) for i, v in rows], "vec_id long, audio binary")
    prints = chroma.shared.stored(spark, chroma.fingerprints(df, "vec_id", "audio"), "prints")
    got = {(x["query_id"], x["vec_id"]) for x in chroma.search(spark, prints, prints.where("vec_id % 2 = 0"), "vec_id").collect()}
    want = brute([(i, chroma.fingerprint(chroma.render(v))) for i, v in rows], 2)
    assert got <= want and len(got) >= 0.9 * len(want) and want


def test_classes_and_matches(spark):
    r = np.random.default_rng(6)
    noisy = lambda i: [float(x) for x in song(i) + r.normal(size=64) * 0.002]
    rows = [(i, [float(x) for x in song(i % 4)], "x") for i in range(20)] + [(100 + i, noisy(i), "x") for i in range(4)] + [(200, None, "x"), (201, [], "x"), (None, [1.0] * 64, "x"), (5, [float(x) for x in song(1)], "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, matches string")
    got = chroma.match_vectors(spark, df, 3).collect()
    assert len(got) == len(rows)
    by = {x["vec_id"]: x for x in got}
    prints = {i: chroma.fingerprint(chroma.render(v)).tolist() for i, v, _ in rows}
    for i, x in by.items():
        same = [j for j in prints if j is not None and prints[j] == prints[i]]
        assert x["class_id"] == (min(same) if prints[i] and same else None), i
        assert x["is_query"] == (i is not None and i % 3 == 0)
    want = brute([(i, np.array(p, np.uint32)) for i, p in prints.items() if i is not None], 3)
    pairs = {(by[q]["class_id"], by[v]["class_id"]) for q, v in want if by[q]["class_id"] != by[v]["class_id"]}
    found = {(m["query_class"], x["class_id"]) for x in got for m in x["matches"]}
    assert found <= pairs and len(found) >= 0.9 * len(pairs)


def test_blocks_of_queries(spark):
    rows = [(i, [float(x) for x in song(i % 4)]) for i in range(20)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    parts = list(chroma.blocks(chroma.fingerprints(df, "vec_id", "embedding", chroma.render), 150))
    assert len(parts) == 4 and sum(len(q[0]) for b in parts for q in b["queries"]) == 20


def test_recall_on_the_embeddings(spark):
    """Every query of the corpus against every vector at every offset."""
    table = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select("vec_id", "embedding")
    prints = {x["vec_id"]: chroma.fingerprint(chroma.render(x["embedding"])) for x in table.collect()}
    got = {x["vec_id"]: x for x in chroma.match_vectors(spark, table).collect()}
    names = {v: x["class_id"] for v, x in got.items()}
    found = {(m["query_class"], x["class_id"]) for x in got.values() for m in x["matches"]}
    want = set()
    for q, a in prints.items():
        if q % 50 == 0:
            wide = np.concatenate([np.zeros(200, np.uint32), a, np.zeros(200, np.uint32)])
            for v, b in prints.items():
                if names[v] != names[q]:
                    rolled = np.lib.stride_tricks.sliding_window_view(wide, len(b))
                    bits = np.bitwise_count(rolled ^ b)
                    at = np.arange(len(rolled)) - 200
                    low, high = np.maximum(0, -at), np.minimum(len(b), len(a) - at)
                    sums = np.concatenate([np.zeros((len(rolled), 1)), bits.cumsum(1)], 1)
                    n = high - low
                    ok = n >= chroma.OVERLAP
                    k = np.flatnonzero(ok)
                    share = (sums[k, high[k]] - sums[k, low[k]]) / (32 * n[k])
                    if len(k) and share.min() <= chroma.ERRORS:
                        want.add((names[q], names[v]))
    assert found <= want and len(found) >= 0.9 * len(want)


def test_empty_table(spark):
    assert chroma.match_vectors(spark, spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []
