"""Orders of all rows, beyond what the capped queries show."""

import random

from pyspark.sql import functions as F

from siftwell import catalog
from siftwell.operators import numbering

SF = "/root/testdata/sf0.001"


def test_all_rows_are_numbered(spark):
    r = random.Random(2)
    rows = [(r.choice([None, *"abcde"]), i) for i in range(5000)]
    df = spark.createDataFrame(rows, "k string, v long").repartition(7)
    got = {x["v"]: x["at"] for x in numbering.numbered(spark, df, [F.asc_nulls_first("k"), F.desc("v")], "at").collect()}
    want = sorted(rows, key=lambda x: (x[0] is not None, x[0] or "", -x[1]))
    assert got == {v: i + 1 for i, (_, v) in enumerate(want)}
    assert numbering.numbered(spark, df.limit(0), [F.col("k")], "at").collect() == []


def test_no_row_and_no_line_is_left_out(spark):
    q = catalog.queries()
    for capped, whole in (("o7_name_order", "o7_all_names"), ("o5_candidate_order", "o5_all_candidates"), ("w5_path_places", "w5_all_places")):
        first, all_ = set(map(tuple, q[capped](spark, SF).collect())), list(map(tuple, q[whole](spark, SF).collect()))
        assert first <= set(all_) and sorted(x[-1] for x in all_) == list(range(1, len(all_) + 1))
    texts = [x[0] for x in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()]
    assert q["x13_all_lines"](spark, SF).count() == sum(t.count("\n") + 1 for t in texts if t is not None)
