import hashlib
import random
from collections import Counter

from siftwell.llm import warc

SCHEMA = "page_id long, url string, html string, digest string"


def brute(pages):
    first = {}
    for i, _, html in pages:
        if len((html or "").encode()) >= 1000:
            k = html
            first[k] = max(first.get(k, (-1, None)), (1 if i is not None else 0, i), key=lambda x: (x[0], x[1] if x[1] is not None else -1))
    out = []
    for i, _, html in pages:
        raw = (html or "").encode()
        target = first.get(html, (0, None))[1]
        again = target is not None and i != target
        out.append((i, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if again else "response", target if again else None))
    return Counter(out)


def example():
    r = random.Random(1)
    pages = [(i, f"http://x.org/{i}", "".join(r.choice("ab é\r\n<p>") for _ in range(r.randint(0, 3000)))) for i in range(60)]
    copy = "<p>" + "same " * 400
    pages += [(100 + i, "http://y.org/", copy) for i in range(150)]
    pages += [(300, None, None), (301, "", ""), (302, "http://a\nb", "short"), (303, "u", "short"), (304, "u", "x" * 999), (305, "u", "x" * 999), (306, "u", "x" * 1000), (307, "u", "x" * 1000), (307, "u", "x" * 1000), (None, "u", "x" * 1000), (400, "u", "long" * 200_000), (401, "u", "\r\n\r\nContent-Length: 3\r\n\r\n" * 60)]
    return pages


def test_round_trip(spark):
    pages = example()
    df = spark.createDataFrame([(*p, "z") for p in pages], SCHEMA).repartition(5)
    got = warc.round_trip(spark, df).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert Counter(map(tuple, got)) == brute(pages)


def test_payloads_come_back_whole(spark):
    pages = example()
    index = warc.write_archives(spark, spark.createDataFrame([(*p, "z") for p in pages], SCHEMA))
    rows = warc.read_records(index.where("record_type = 'response'"), payloads=True).collect()
    want = Counter((i, (h or "").encode()) for (i, _, h), kind in zip(pages, _kinds(pages), strict=True) if kind == "response")
    assert Counter((r["page_id"], bytes(r["payload"])) for r in rows) == want


def _kinds(pages):
    return [next(k[3] for k in brute(pages) if k[0] == i and k[2] == hashlib.sha1((h or "").encode()).hexdigest()) for i, _, h in pages]


def test_reads_only_what_is_selected(spark):
    index = warc.write_archives(spark, spark.createDataFrame([(*p, "z") for p in example()], SCHEMA))
    some = index.where("page_id % 7 = 0")
    assert sorted(r["page_id"] for r in warc.read_records(some).collect()) == sorted(r["page_id"] for r in some.collect())


def test_ranges():
    assert warc.ranges([(0, 10), (10, 5), (500, 5), (501, 2)], gap=100, most=1000) == [(0, 15, [0, 1]), (500, 505, [2, 3])]
    assert warc.ranges([(0, 10), (12, 10)], gap=5, most=15) == [(0, 10, [0]), (12, 22, [1])]


def test_empty_table(spark):
    assert warc.round_trip(spark, spark.createDataFrame([], SCHEMA)).collect() == []
