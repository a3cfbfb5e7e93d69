import random

import pytest

import corpus_pipeline
from siftwell.llm import toxicity

from . import test_decontaminate, test_near_dups, test_packing


@pytest.fixture
def tables(spark, tmp_path):
    r = random.Random(1)
    plain = [f"w{i}" for i in range(500)]
    some = lambda n: [r.choice(plain) for _ in range(n)]
    items = [(i, " ".join(some(20))) for i in range(5)]
    docs, labels = [], []
    for i in range(400):
        w, toxic = some(r.randint(6, 120)), i % 5 == 0
        for _ in range(3 * toxic):
            w.insert(r.randrange(len(w)), r.choice(["grub", "snark", "oaf"]))
        if i % 11 == 1:
            w += items[1][1].split() + (items[2][1].split() if i % 2 else [])
        docs.append((i, " ".join(w)))
        labels.append((i, 1, int(toxic)))
    for i in range(400, 480):
        w = docs[r.randrange(400)][1].split()
        if i % 2:
            w[r.randrange(len(w))] = "changed"
        docs.append((i, " ".join(w)))
    docs += [(480, None), (481, ""), (482, "w1 " * 9000)]
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path), docs, items


def test_stages():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near-duplicates", "decontamination", "packing"]
    assert corpus_pipeline.ORACLE_SQL is None


def test_against_brute_force(spark, tables):
    sf_dir, docs, items = tables
    rows = corpus_pipeline.run(spark, sf_dir).collect()
    table = lambda n: spark.read.parquet(f"{sf_dir}/{n}.parquet")
    judged = {r["doc_id"]: r["predicted"] for r in toxicity.toxicity(spark, table("documents"), table("labels")).collect()}
    assert 60 <= sum(judged.values()) <= 120
    left = [d for d in docs if not judged[d[0]]]
    names = test_near_dups.brute(left)
    left = [d for d in left if d[0] in {c[0] for c in names[d]} or not test_near_dups.bag(d[1])]
    left = [d for d in left if not test_decontaminate.shares(d[1], items)]
    assert {r["doc_id"] for r in rows} == {i for i, _ in left}
    used, least = test_packing.check(spark, left, 2048)
    assert len({r["sequence_id"] for r in rows}) <= used + 1
    assert sum(r["length"] for r in rows) == sum(len(test_packing.Tokenizer.from_file(test_packing.VOCABULARY).encode(t or "", add_special_tokens=False).ids) + 1 for _, t in left)


def test_columns_between_stages(spark, tables):
    sf_dir, _, _ = tables
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.schema.simpleString() == docs.schema.simpleString()
        docs = corpus_pipeline.shared.stored(spark, out, "stage")
