import json
import os
import random

import pytest
from pyspark.sql import functions as F

from siftwell import engine, views
from siftwell.functions import metadata, scoring
from siftwell.functions.bytesql import bytes_view, fold_text
from siftwell.functions.symbols import extract
from siftwell.operators import entries, grep, live, postings, search, symbols
from siftwell.plans import regex
from siftwell.plans.query import parse
from siftwell.sources import content, fstree
from siftwell.streaming import live as stream

# Cases of the matching rules: name, query, whether it matches.
CASES = [
    ("loop2.c", "loo2.c", True), ("loop2.c", "loopp2.c", True), ("loop2.c", "oop2.c", True), ("loop2.c", "xloop2.c", True), ("loop2.c", "loox2.c", True), ("loop2.c", "lopo2.c", True),
    ("prefix loop2.c backup", "loo2.c", True), ("prefix loop2.c backup", "loopp2.c", True), ("loop2.c", "loop3.c", False), ("loop2.c", "loop.c", False), ("loop2.c", "loop22.c", False),
    ("loop2.c", "loo2p.c", False), ("loop2.c", "loopc.2", False), ("loop2.c", "'loo2.c", False), ("r_e_a_d_m_e.md", "readme", False), ("README.md", "readme", True),
]


@pytest.mark.parametrize("query", sorted({c[1] for c in CASES}))
def test_matching_cases(spark, query):
    t = parse(query).tokens[0]
    own = [c for c in CASES if c[1] == query]
    df = spark.createDataFrame([(c[0],) for c in own], "name string")
    got = {r[0]: r[1] is not None for r in df.select("name", scoring.token_score(bytes_view(F.col("name")), t.mode, t.text)).collect()}
    assert got == {c[0]: c[2] for c in own}


def model(name: str, q: str, cap: int = 100):
    """The clean score in plain Python, on bytes."""
    n, low = name.encode(), fold_text(name).encode()
    s = low.find(q.encode())
    if s < 0:
        return None
    kind = lambda b: "l" if 97 <= b <= 122 else "u" if 65 <= b <= 90 else "d" if 48 <= b <= 57 else "x" if chr(b) in scoring.DELIMITERS else "o"
    kinds = [kind(b) for b in n]

    def bonus(i):
        before, now = kinds[i - 1] if i else "x", kinds[i]
        return 8 if before == "x" != now else 7 if before + now in ("lu", "ld", "ud") else 0

    m, total, run = len(q.encode()), 0, 0
    for k in range(m):
        b = bonus(s + k)
        if k == 0:
            run, add = b, 2 * b
        else:
            run = max(run, b) if b == 8 else run
            add = max(b, run, 4)
        total += 16 + add
    off = int(len(n) > 1 and n[:1] == b".")
    dot = n.rfind(b".")
    stem = dot if dot > off else len(n)
    place = (100 if s + m == len(n) else 80 if s + m == stem else 30) if s == off else 0
    return total + min(place, cap) - min(len(n), 80) // 3


def test_scores_of_random_names(spark):
    r = random.Random(3)
    names = ["".join(r.choice("abAB1._- é@") for _ in range(r.randint(1, 90 if i % 9 == 0 else 12))) for i in range(600)]
    df = spark.createDataFrame([(n,) for n in names], "name string")
    for q in ("a", "ab", "b1", "a.b", "1_"):
        got = df.select("name", scoring.fuzzy_score(bytes_view(F.col("name")), q).alias("s")).collect()
        assert [(x["name"], x["s"]) for x in got] == [(n, model(n, q)) for n in names]


def edits(word: str, q: str) -> bool:
    """One wrong, extra, missing or swapped letter; digits stay."""
    if word == q:
        return False
    spots = range(len(q) + 1)
    free = lambda c: not c.isdigit()
    for i in spots:
        if i < len(q) and free(q[i]) and q[:i] + q[i + 1 :] == word:
            return True
        if i < len(q) and len(word) == len(q) and free(q[i]) and free(word[i]) and q[:i] + word[i] + q[i + 1 :] == word:
            return True
        if len(word) == len(q) + 1 and free(word[i]) and q[:i] + word[i] + q[i:] == word:
            return True
        if i + 1 < len(q) and free(q[i]) and free(q[i + 1]) and q[:i] + q[i + 1] + q[i] + q[i + 2 :] == word:
            return True
    return False


def test_one_edit_away(spark):
    r = random.Random(4)
    q = "loop2ab"
    words = []
    for _ in range(1500):
        w = list(q)
        for _ in range(r.randint(0, 2)):
            i = r.randrange(len(w) + 1)
            w[i : i + r.randint(0, 1)] = r.choice(["", "o", "l", "3", "x"])
            if len(w) > 2 and r.random() < 0.3:
                j = r.randrange(len(w) - 1)
                w[j], w[j + 1] = w[j + 1], w[j]
        words.append("".join(w))
    df = spark.createDataFrame([(w,) for w in words], "w string")
    got = [x[0] for x in df.select(scoring.let(F.col("w"), lambda w: scoring.one_edit_away(w, q))).collect()]
    assert got == [edits(w, q) for w in words]


def test_may_match_loses_nothing(spark):
    r = random.Random(5)
    names = ["".join(r.choice("abcr ") for _ in range(r.randint(3, 9))) for _ in range(800)]
    df = spark.createDataFrame([(n,) for n in names], "name string").withColumn("n", bytes_view(F.col("name")))
    q = "abcab"
    out = df.select(scoring.may_match(F.col("n"), q).alias("m"), F.greatest(scoring.typo_score(F.col("n"), q), scoring.whole_typo_score(F.col("n"), q)).alias("s"))
    assert out.where("NOT m AND s IS NOT NULL").count() == 0


def tree(spark, rows, root="/r"):
    return entries.derive(spark.createDataFrame(rows, entries.SCHEMA), root)


def test_order_of_ties(spark):
    f = lambda p, d=False: (p, d, False, False, 1, 0)
    df = tree(spark, [f("/r/b/foo"), f("/r/a/foo"), f("/r/a/x/foo"), f("/r/foo", True), f("/r/" + "f00" * 8 + "foo0")])
    assert [r["path"] for r in search.search(df, "foo", "/r", 0).top.collect()][:4] == ["/r/foo", "/r/a/foo", "/r/a/x/foo", "/r/b/foo"]


def test_filters_on_odd_rows(spark):
    df = tree(spark, [("/r/.bashrc", False, False, True, 0, 5), ("/r/a.TXT", False, True, False, 9, 5), ("/r/d.app", True, False, False, 9, 5), ("/r/noext", False, False, False, None, None)])
    names = lambda q: sorted(r["path"] for r in search.matches(df, parse(q), "/r", 100).select("path").collect())
    assert names("ext:bashrc") == ["/r/.bashrc"]
    assert names("kind:link") == ["/r/a.TXT"]
    assert names("type:app") == ["/r/d.app"]
    assert names("size:>=0") == ["/r/.bashrc", "/r/a.TXT"]


SYMBOLS = {
    "c": ("#define FOO 1\nstruct point { int x; };\ntypedef int (*fnp)(int);\nstatic int add(int a) {\n return call(a);\n}\nint decl(int);\n", "FOO:1:macro point:2:type fnp:3:type add:4:fn"),
    "cpp": ("namespace a::b {\nclass Foo final : public Bar { void m() { x(); } };\nFoo::Gee(int a) : b_(a) { }\nusing T = int;\nenum class E { A };\n}", "b:1:module Foo:2:type m:2:fn Gee:3:fn T:4:type E:5:type"),
    "objc": ("@interface A : NSObject\n- (void)doIt:(int)x;\n@end", "A:1:type doIt:2:fn"),
    "rust": ("fn main() { let x: &'a str = r#\"fn no() \"#; }\nstruct S;\nmacro_rules! mm { }\nconst K: u8 = 1;\nmod m;", "main:1:fn S:2:type mm:3:macro K:4:const m:5:module"),
    "go": ("func (r *R) Do() {}\ntype (\n A struct { x int }\n B int\n)", "Do:1:fn A:3:type B:4:type"),
    "python": ("def a(x):\n  pass\nclass B:\n  async def c(self): pass\n\"\"\"def no(): \"\"\"\n# def d\n", "a:1:fn B:3:type c:4:fn"),
    "js": ("function f() {}\nconst g = async (a) => 1\nclass K { static m() { } }\nfoo.bar = () => {}\n", "f:1:fn g:2:fn K:3:type m:3:fn"),
    "ts": ("interface I {}\ntype T = 1\nnamespace N {}\nconst g = (a: number): void => {}", "I:1:type T:2:type N:3:module g:4:fn"),
    "swift": ("func a() {}\nclass var x\nstruct S {}\n", "a:1:fn S:3:type"),
    "java": ("public class A { int f(int x) { return g(x); } record R(int a) {} }", "A:1:type f:1:fn R:1:type"),
    "kotlin": ("fun <T> List<T>.ext(a: Int) = 1\nobject O\n", "ext:1:fn O:2:type"),
    "csharp": ("namespace A.B { class C { int F() => 1; } }", "B:1:module C:1:type F:1:fn"),
    "ruby": ("def self.x?\nend\nclass B::C\nend\n", "x?:1:fn C:3:type"),
    "php": ("<?php function &f() {} class A {} # function no\n", "f:1:fn A:1:type"),
    "lua": ("function a.b:c() end\n--[[ function no() ]]\nlocal function d() end", "c:1:fn d:3:fn"),
    "zig": ("pub fn f() void {}\nconst S = packed struct {};\n", "f:1:fn S:2:type"),
    "shell": ("foo-bar() { :; }\nfunction baz { :; }\n", "foo-bar:1:fn baz:2:fn"),
}


@pytest.mark.parametrize("lang", sorted(SYMBOLS))
def test_symbols_of_a_language(lang):
    text, wanted = SYMBOLS[lang]
    assert " ".join(f"{s.name}:{s.line}:{s.kind}" for s in extract(text, lang)) == wanted


def test_symbols_of_broken_texts():
    r = random.Random(6)
    for lang in SYMBOLS:
        for _ in range(60):
            extract("".join(r.choice("abc(){}<>[]'\"`\\\n#/*-=:;, r1é") for _ in range(80)), lang)
    assert extract("", "c") == [] and extract("x", None) == []


def test_grep_lines(spark):
    texts = {"a": "one\r\ntwo one one  \nthree", "b": "x" * 199 + "é one", "c": "", "d": "one\n", "e": "no\nnone\n\n", "f": None}
    df = spark.createDataFrame([(f"/r/{k}", len(v or ""), 1, v) for k, v in texts.items()], "path string, size long, mtime long, text string")
    run = lambda p, mode, n=5: {r["path"][3:]: [(x["line"], x["text"]) for x in r["lines"]] for r in grep.grep(df, p, mode, per_file=n).collect()}
    assert run("one", "literal") == {"a": [(1, "one"), (2, "two one one")], "b": [(1, "x" * 199)], "d": [(1, "one")], "e": [(2, "none")]}
    assert run("one$", "regex", 1) == {"b": [(1, "x" * 199)], "d": [(1, "one")], "e": [(2, "none")]}
    assert run("e\\s+t", "regex") == {"a": [(1, "one"), (2, "two one one")]}
    assert run("two one", "literal") == {"a": [(2, "two one one")]}
    assert run("One", "literal") == {}
    with pytest.raises(ValueError, match="needs a pattern"):
        grep.grep(df, "", "literal")
    with pytest.raises(ValueError):
        grep.grep(df, "(", "regex")


def test_first_lines_of_empty_matches():
    import re

    assert grep.first_lines(re.compile("^", re.M), "a\nb\n", 9) == [1, 2, 3]
    assert grep.first_lines(re.compile("a\nb"), "xa\nb a\nb", 9) == [1, 2]


def test_candidate_order(spark):
    rows = [("/r/alpha.txt", 100), ("/r/beta.txt", 300), ("/r/gamma.txt", 200), ("/r/old.txt", 50), ("/r/x.log", 400), ("/r/.d/y.txt", 500)]
    df = spark.createDataFrame([(p, 4, t, "needle") for p, t in rows], "path string, size long, mtime long, text string")
    assert [r["path"][3:] for r in grep.grep(df, "needle").orderBy("ord").collect()] == ["beta.txt", "gamma.txt", "alpha.txt", "old.txt", "x.log", ".d/y.txt"]


def test_index_prunes_soundly(spark):
    r = random.Random(8)
    docs = [(i, "".join(r.choice("abcKks é\n") for _ in range(r.randint(0, 60)))) for i in range(200)]
    df = spark.createDataFrame(docs, "doc_id long, text string").cache()
    post = postings.trigrams(df).cache()
    for p in ("abc", "ab", "c k", "aKb"):
        need, follows = postings.literal_plan(p)
        left = {x[0] for x in postings.pruned(df, post, need, follows).select("doc_id").collect()}
        assert left >= {x[0] for x in df.where(grep.Grep(p).matches(F.col("text"))).select("doc_id").collect()}
    for p in ("ab(c|k)a", "a.*bcb", "k{2,}a"):
        left = {x[0] for x in postings.pruned(df, post, regex.regex_need(p)).select("doc_id").collect()}
        assert left >= {x[0] for x in df.where(grep.Grep(p, "regex").matches(F.col("text"))).select("doc_id").collect()}


def test_fstree_and_content(spark, tmp_path):
    (tmp_path / "a/b").mkdir(parents=True)
    (tmp_path / "a/b/x.py").write_text("def f(): pass\n")
    (tmp_path / "a/y.txt").write_bytes(b"bin\0ary")
    (tmp_path / ".hid").write_text("")
    os.symlink("a", tmp_path / "link")
    fstree.register(spark)
    rows = {r["path"].removeprefix(str(tmp_path)): r for r in spark.read.format("fstree").option("root", str(tmp_path)).load().collect()}
    assert sorted(rows) == ["/.hid", "/a", "/a/b", "/a/b/x.py", "/a/y.txt", "/link"]
    assert rows["/link"]["is_link"] and not rows["/link"]["is_dir"] and rows["/.hid"]["hidden"] and rows["/a"]["size"] == 0
    texts = content.read(spark, str(tmp_path)).collect()
    assert [(r["path"], r["text"]) for r in texts] == [(f"{tmp_path}/a/b/x.py", "def f(): pass\n")]
    assert [tuple(r)[1:] for r in symbols.build(content.read(spark, str(tmp_path))).collect()] == [("f", 1, "fn")]
    df = entries.derive(spark.read.format("fstree").option("root", str(tmp_path)).load(), str(tmp_path))
    entries.save(df, str(tmp_path / "index"))
    assert entries.load(spark, str(tmp_path / "index"), df.schema).count() == 6


def test_stream_equals_batch(spark, tmp_path):
    changes = views.changes(spark, "/root/testdata/sf0.001").withColumn("size", F.col("size").cast("long"))
    log = tmp_path / "log"
    for k in range(4):
        changes.where(F.col("event_id") % 4 == k).coalesce(1).write.mode("append").json(str(log))
    wanted = sorted(map(tuple, live.apply(changes.limit(0).select("event_id", "path", "size"), changes.where("path NOT LIKE '/live/u2/%'")).collect()))
    table = stream.Table(spark, f"file://{tmp_path}/table", stream.CHANGES)
    for _ in range(2):  # the second start finds nothing new
        stream.follow(stream.read_log(spark, str(log)), table, str(tmp_path / "ck"), ["/live/u2"], once=True).awaitTermination(120)
        assert sorted(map(tuple, table.rows().select("event_id", "path", "size").collect())) == wanted
    # the same events again, as another stream
    stream.follow(stream.read_log(spark, str(log)), table, str(tmp_path / "ck2"), ["/live/u2"], once=True).awaitTermination(120)
    assert sorted(map(tuple, table.rows().select("event_id", "path", "size").collect())) == wanted


def test_table_of_parts(spark, tmp_path):
    table = stream.Table(spark, f"file://{tmp_path}/parts")
    rows = lambda: sorted((r.path, r.event_id) for r in table.rows().collect())
    add = lambda *x: table.append(spark.createDataFrame([*x], stream.CHANGES))
    assert rows() == [] and not table.compact() and not table.due() and table.version() == 0
    add((1, "/a/b", "upsert", 5), (2, "/a/c", "upsert", 6))
    add((9, "/a", "tree", 0), (10, "/a/d", "upsert", 1))
    assert rows() == [("/a/d", 10)] and table.version() == 2
    assert table.compact() and rows() == [("/a/d", 10)]
    assert sorted(r.op for r in table.read().collect()) == ["tree", "upsert"]
    add((3, "/a/b", "upsert", 7))  # late: the tree was deleted since
    add((11, "/a/b", "upsert", 8), (11, "/a/b", "upsert", 8))
    assert rows() == [("/a/b", 11), ("/a/d", 10)]
    # no deletion is older than the newest event by more than one: the tree's goes, and what is older is too late
    assert table.compact(late=1) and {r.op for r in table.read().collect()} == {"upsert"}
    add((4, "/a/z", "upsert", 1), (12, "/b", "upsert", 1))
    assert rows() == [("/a/b", 11), ("/a/d", 10), ("/b", 12)]
    add()
    for k in range(8):
        add((20 + k, "/many", "upsert", k))
    assert table.tidy() and rows()[-1] == ("/many", 27) and len(table.parts()) < 9
    # another writer took a part first: nothing is lost
    old = table.parts()
    part = table._write(live.folded(table._all(old)), horizon=stream.NEVER)
    add((40, "/late", "upsert", 1))
    assert table._replace(old, part) and ("/late", 40) in rows()
    assert not table._replace(old, part)
    held = rows()
    assert table.vacuum(3600) == 0 and table.vacuum(-60) > 0 and rows() == held


def test_content_upkeep(spark, tmp_path):
    folder, log = f"file://{tmp_path}/index", tmp_path / "log"
    docs = spark.createDataFrame([(i, f"/f{i}", 5, 1, "hello") for i in range(4)], "doc_id long, path string, size long, mtime long, text string")
    spark.createDataFrame([(1, "/f1", "upsert", 5), (2, "/f2", "delete", 0)], stream.CHANGES).write.json(str(log))
    contents = lambda paths: docs.join(paths, "path", "left_semi").select(docs.columns)
    stream.follow_content(stream.read_log(spark, str(log)), folder, contents, str(tmp_path / "ck"), once=True).awaitTermination(120)
    assert [r.path for r in postings.open_index(spark, folder)["docs"].collect()] == ["/f1"]
    assert postings.sync(spark, folder, docs) == 3 and postings.sync(spark, folder, docs) == 0
    assert postings.open_index(spark, folder)["docs"].count() == 4


def test_segments_and_compaction():
    assert live.segments_to_merge([5] * 8) == list(range(8))
    assert live.segments_to_merge([5] * 6) == [] and live.segments_to_merge([9, 1, 2, 8 << 10, 9 << 12, 9 << 14, 9 << 16]) == [1, 2]
    assert live.compaction_due(50_001, 0, 0) and live.compaction_due(1, 0, 600) and not live.compaction_due(0, 0, 900)


def test_service(spark):
    sf = "/root/testdata/sf0.001"
    code = views.code(spark, sf)
    e = engine.Engine(spark, views.tree(spark, sf), views.content(spark, sf), symbols.build(code), views.ROOT, now=views.NOW)
    ask = lambda x: json.loads(engine.handle(e, json.dumps(x)))
    found = ask({"q": "doc", "limit": 3, "id": 7})
    assert found["ok"] and found["id"] == 7.0 and len(found["hits"]) == 3 and found["total"] > 3 and set(found["hits"][0]) == {"path", "dir", "size", "mtime", "score"}
    assert ask({"q": "doc", "limit": 0})["hits"] == []
    assert ask({"q": "size:zz kind:dir"})["warning"] == "ignored size:zz"
    assert ask({"op": "grep", "pattern": "the", "limit": 2})["files"][0]["lines"]
    assert ask({"op": "grep"}) == {"ok": False, "error": "grep needs a pattern"}
    assert ask({"op": "dance"})["error"] == "unknown op"
    assert ask({"q": "sym:brand", "limit": 2})["hits"][0]["kind"] == "type"
    assert ask({"op": "status"})["symbols"] == code.count() * 2
    assert json.loads(engine.handle(e, b"\xff{"))["error"] == "bad request"
    assert engine.cli_lines(e.search("doc", 2).top, "files").count() == 2


def test_metadata_edges(spark):
    df = spark.createDataFrame([("a.min.js", 5), ("x.png", 5), ("x", 0), (".png", 5), ("a." + "z" * 17, 5), ("b.txt", (1 << 20) + 1), ("b.txt", 1 << 20)], "name string, size long")
    assert [r[0] for r in df.select(metadata.text_file(F.col("name"), F.col("size"))).collect()] == [False, False, False, True, True, False, True]


def test_service_and_client(spark, tmp_path):
    import io
    import threading

    from siftwell import service

    rows = spark.createDataFrame([("/r/a.txt", False, False, False, 3, 1), ("/r/b.txt", False, False, False, 3, 2)], entries.SCHEMA)
    content = spark.createDataFrame([("/r/a.txt", 3, 1, "foo"), ("/r/b.txt", 3, 2, "bar")], "path string, size long, mtime long, text string")
    e = engine.Engine(spark, entries.derive(rows, "/r"), content, spark.createDataFrame([], symbols.TABLE), "/r", now=10)
    out = io.BytesIO()
    long = b'{"op": "search", "q": "' + b"x" * (2 << 20) + b'"}\n'
    assert service.serve(e, io.BytesIO(b'{"id": 1, "q": "^a"}\n\n' + long + b'{"op": "none"}'), out) == 3
    found = [json.loads(x) for x in out.getvalue().splitlines()]
    assert [x["ok"] for x in found] == [True, False, False] and found[0]["id"] == 1 and found[0]["total"] == 1
    path = str(tmp_path / "s")
    served = service.Service(e, path).start()
    try:
        with service.Client(path) as c:
            assert c.await_ready(5) and c.status()["entries"] == 2
            assert [h["path"] for h in c.search("txt", 1)["hits"]] == ["/r/a.txt"] and c.search("txt", 0)["total"] == 2
            assert [f["path"] for f in c.grep("bar")["files"]] == ["/r/b.txt"]
            for wrong in (lambda: c.grep("(", "regex"), lambda: c.request("none"), lambda: c.search("x" * (2 << 20))):
                with pytest.raises(ValueError):
                    wrong()
            totals = []
            threads = [threading.Thread(target=lambda q=q: totals.append((q, c.search(q)["total"]))) for q in ("^a", "^b", "txt")]
            [t.start() for t in threads], [t.join() for t in threads]
            assert sorted(totals) == [("^a", 1), ("^b", 1), ("txt", 2)]
    finally:
        served.stop()
