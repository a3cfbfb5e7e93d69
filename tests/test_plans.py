import random
import re

import pytest

from siftwell.plans import regex
from siftwell.plans.query import ANY, Token, parse, split_words


def test_words_and_quotes():
    assert split_words('a "b c"d  e"" "') == ["a", "b cd", "e"]


@pytest.mark.parametrize(
    ("word", "wanted"),
    [("Foo", Token("foo")), ("!x", Token("x", "exact", True)), ("!^a", Token("a", "prefix", True)), ("'a", Token("a", "exact")), ("^a", Token("a", "prefix")), ("a$", Token("a", "suffix")), ("É", Token("\xc3\x89"))],
)
def test_tokens(word, wanted):
    assert parse(word).tokens == (wanted,)


def test_more_than_eight_words_and_pieces():
    q = parse("a/b c d e f g h i j !k")
    assert [t.text for t in q.positive] == list("abcdefgh") and [t.text for t in q.negative] == ["k"]
    assert parse("$ ! ^ '").tokens == ()


@pytest.mark.parametrize(("text", "wanted"), [("size:1.5kb", (1536, None)), ("size:<0", None), ("size:>10", (11, None)), ("size:=7b", (7, 7)), ("size:1..2k", (1, 2048)), ("size:<=3 size:>1", (2, 3))])
def test_sizes(text, wanted):
    size = parse(text).size
    if wanted is None:
        assert size[0] > size[1]
    else:
        assert size[0] == wanted[0] and (wanted[1] is None or size[1] == wanted[1])


def test_ages_types_kinds_and_errors():
    assert parse("mtime:7d").age == (0, 604800)
    assert parse("modified:1d..2w").age == (86400, 1209600)
    assert parse("type:dir,video type:video").types == {"video"}
    app = parse("type:app")
    assert app.kind == "dir" and app.exts == ("app",) and app.types == {"dir"}
    q = parse("size:x kind:zz type:nope")
    assert q.error == "ignored size:x" and q.types == ANY and not q.selects()
    assert parse("foo:bar").tokens == (Token("foo:bar"),)
    assert parse("re:a re:(").name_re is None and parse("re:( re:a").name_re == "a"
    assert parse("grep:Ab regex:c").grep == "c" and parse("sym:A sym:b").syms == ("a", "b")
    assert parse("in:~/x/", home="/h").scope == "/h/x" and parse("limit:9x").limit == 9
    assert not parse("limit:3 sym:a grep:b").selects() and parse("kind:dir").selects()


FIXED = [
    ("12345-678", "prefix 12345-678 suffix"), ("foo12345|bar12345", "bar12345"), ("foo?12345", "fo12345"), ("foo|bar12345", "foo"), ("12345(?:foo)?67890", "1234567890"),
    ("(foo12345)*bar67890", "bar67890"), ("ab{2,3}12345", "abb12345"), ("^abc12345$", "abc12345"), ("[a-z]12345", "z12345"), (r"\d12345", "912345"), (r"(abc)\1-12345", "abcabc-12345"),
    ("(?i)ABC12345", "abc12345"), ("(?!wrong)foo12345", "foo12345"), ("k12345", "\u212a12345"), ("s12345", "\u017f12345"), ("abcds", "abcd\u017f"), ("é?12345", "12345"), ("a{,3}bcd", "a{,3}bcd"), (r"\Qa.b\Ecd", "a.bcd"),
]


@pytest.mark.parametrize(("pattern", "text"), FIXED)
def test_planner_keeps_matches(pattern, text):
    from siftwell.functions.bytesql import fold_text

    assert regex.meets(regex.regex_need(pattern), fold_text(text))


def test_planner_keeps_random_matches():
    r = random.Random(7)
    lit = lambda n=4: "".join(r.choice("abcdeks019") for _ in range(r.randint(1, n)))

    def make(depth=0):
        kind = r.randint(0, 5 if depth < 3 else 0)
        if kind == 0:
            x = lit()
            return x, x
        (p, t), (p2, t2) = make(depth + 1), make(depth + 1)
        if kind == 1:
            return p + p2, t + t2
        if kind == 2:
            return f"(?:{p}|{p2})", r.choice([t, t2])
        if kind == 3:
            return f"(?:{p})?{p2}", r.choice(["", t]) + t2
        if kind == 4:
            n = r.randint(1, 3)
            return f"(?:{p}){{{n},4}}", t * n
        c = r.choice("xyz")
        return f"{p}[xyz].*{p2}", t + c + lit() + t2

    for _ in range(3000):
        pattern, text = make()
        assert re.search(pattern, text), (pattern, text)
        assert regex.meets(regex.regex_need(pattern), text), (pattern, text)


def test_planner_prunes():
    assert not regex.meets(regex.regex_need("(idiot|moron)s"), "a clean text")
    assert regex.regex_need("ab") is True


@pytest.mark.parametrize(("pattern", "wanted"), [("foo", True), ("a+b", True), ("a*", False), ("^$", False), (r"a\sb", False), ("[^x]y", False), ("a|", False), (r"\d+x", True), ("(?s)a.b", False)])
def test_lines_can_be_tested_one_by_one(pattern, wanted):
    assert regex.within_lines(pattern) is wanted
