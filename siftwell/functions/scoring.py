"""Match scores of names as Columns; null is no match.

All take the bytes view of a name. What is looked for is a folded literal, so that every comparison
with it is a plain substring, prefix or equality test. Compiled code only tests whether a name can
match at all; the scores of the few that can are evaluated with their parts bound once (``let``), which
keeps generated code small however many words a query has.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .bytesql import fold, sub

# Fixed values of the ranking.
MATCH, BOUNDARY, CAMEL, CONSECUTIVE = 16, 8, 7, 4
TYPO_LENGTH, TYPO_COST, LONGEST = 5, 60, 128
WHOLE, STEM, START = 100, 80, 30
DELIMITERS = " _-./()[],+@"
ANCESTOR_EACH = 6

_ALL = "".join(map(chr, range(256)))
_KIND = "".join("l" if "a" <= c <= "z" else "u" if "A" <= c <= "Z" else "d" if "0" <= c <= "9" else "x" if c in DELIMITERS else "o" for c in _ALL)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def kinds(name: Column) -> Column:
    """A letter for each byte: lower, upper, digit, delimiter (x) or other."""
    return F.translate(name, _ALL, _KIND)


def bonus(kind: Column, at: Column) -> Column:
    """What the byte at a 0-based place is worth beside the match."""
    now, before = sub(kind, at + 1, 1), F.when(at == 0, "x").otherwise(sub(kind, at, 1))
    camel = ((before == "l") & (now == "u")) | (before.isin("l", "u") & (now == "d"))
    return F.when((before == "x") & (now != "x"), BOUNDARY).when(camel, CAMEL).otherwise(0)


def length_cost(name: Column) -> Column:
    return F.floor(F.least(F.length(name), F.lit(80)) / 3).cast("int")


def offset(name: Column) -> Column:
    """1 after a leading dot."""
    return F.when((F.length(name) > 1) & name.startswith("."), 1).otherwise(0)


def stem_end(name: Column) -> Column:
    """Where the extension's dot is, or the end; a leading dot begins no extension."""
    dot = F.length(name) - F.instr(F.reverse(name), ".")
    return F.when((F.instr(name, ".") > 0) & (dot > offset(name)), dot).otherwise(F.length(name))


def placement(name: Column, start: Column, size: Column, cap: int) -> Column:
    end = start + size
    best = F.when(end == F.length(name), WHOLE).when(end == stem_end(name), STEM).otherwise(START)
    return F.when(start == offset(name), F.least(best, F.lit(cap))).otherwise(0)


def fuzzy_capped(name: Column, wanted: Column, cap: int) -> Column:
    """The score of the first occurrence of a folded text."""
    start = F.instr(fold(name), wanted) - 1
    parts = F.struct(name.alias("name"), kinds(name).alias("kind"), start.alias("start"), F.length(wanted).alias("size"))
    return let(parts, lambda r: F.when((r["size"] > 0) & (r["start"] >= 0), _run_score(r["name"], r["kind"], r["start"], r["size"], cap)))


def _run_score(name: Column, kind: Column, start: Column, size: Column, cap: int) -> Column:
    first = bonus(kind, start)
    # the run's bonus is the first byte's, or a boundary's once one is met
    state = F.struct(F.lit(0).alias("sum"), first.cast("int").alias("run"))

    def step(acc: Column, k: Column) -> Column:
        b = bonus(kind, start + k)
        run = F.when(b >= BOUNDARY, F.greatest(b, acc["run"])).otherwise(acc["run"])
        return F.struct((acc["sum"] + MATCH + F.greatest(b, run, F.lit(CONSECUTIVE))).cast("int").alias("sum"), run.cast("int").alias("run"))

    later = F.when(size > 1, F.aggregate(F.sequence(F.lit(1), F.greatest(size - 1, F.lit(1))), state, step, lambda acc: acc["sum"])).otherwise(0)
    return (MATCH + 2 * first + later + placement(name, start, size, cap) - length_cost(name)).cast("int")


def _digit(c: Column) -> Column:
    return (c >= "0") & (c <= "9")


def _first_difference(name: Column, q: str, branch: Callable[[int], Column], same: Column) -> Column:
    """branch(i) where name and q first differ at i; same where name begins with q."""
    out = None
    for i in range(len(q)):
        differs = ~name.startswith(q[: i + 1])
        out = F.when(differs, branch(i)) if out is None else out.when(differs, branch(i))
    return out.otherwise(same)


def one_edit_prefix(word: Column, q: str) -> Column:
    """How many bytes of a folded word spell q with exactly one edit; 0 for none. Digits are never edited."""
    m = len(q)

    def branch(i: int) -> Column:
        there = sub(word, i + 1, 1)
        letter = (F.length(word) > i) & ~_digit(there)
        rest, free = q[i + 1 :], not q[i].isdigit()
        out = F.when(F.lit(False), 0)
        if free and i + 1 < m and not q[i + 1].isdigit():
            out = out.when(word.startswith(q[:i] + q[i + 1] + q[i] + q[i + 2 :]), m)
        if free:
            out = out.when(letter & sub(word, i + 2).startswith(rest), m)
            out = out.when(word.startswith(q[:i] + rest), m - 1)
        return out.when(letter & sub(word, i + 2).startswith(q[i:]), m + 1).otherwise(0)

    return _first_difference(word, q, branch, F.lit(0))


def one_edit_away(name: Column, q: str) -> Column:
    """Whether a folded name is q with exactly one letter wrong, extra, missing or swapped."""
    n, m = F.length(name), len(q)

    def branch(i: int) -> Column:
        there, free = sub(name, i + 1, 1), not q[i].isdigit()
        wrong = F.lit(free) & ~_digit(there) & (sub(name, i + 2) == q[i + 1 :])
        swapped = F.lit(False)
        if free and i + 1 < m and not q[i + 1].isdigit():
            swapped = name == q[:i] + q[i + 1] + q[i] + q[i + 2 :]
        longer = ~_digit(there) & (sub(name, i + 2) == q[i:])
        shorter = F.lit(free) & (sub(name, i + 1) == q[i + 1 :])
        return F.when(n == m, wrong | swapped).when(n == m + 1, longer).when(n == m - 1, shorter).otherwise(False)

    return _first_difference(name, q, branch, (n == m + 1) & ~_digit(sub(name, m + 1, 1)))


def typo_score(name: Column, q: str) -> Column:
    """Best score of one typo at the start of the name or of a word in it, below a prefix."""
    spaces = F.filter(F.sequence(F.lit(1), F.greatest(F.length(name) - 1, F.lit(1))), lambda i: sub(name, i, 1) == " ")
    words = F.transform(F.concat(F.array(offset(name)), spaces), lambda s: sub(fold(name), s + 1))
    fixed = F.transform(F.filter(words, lambda w: w.startswith(q[:1])), lambda w: F.struct(w.alias("w"), one_edit_prefix(w, q).alias("n")))
    good = F.filter(fixed, lambda r: (r["n"] > 0) & (r["n"] <= LONGEST))
    return F.array_max(F.transform(good, lambda r: fuzzy_capped(name, sub(r["w"], 1, r["n"]), START) - TYPO_COST))


def whole_typo_score(name: Column, q: str) -> Column:
    return let(fold(name), lambda f: F.when((F.length(f) <= LONGEST) & one_edit_away(f, q), fuzzy_capped(name, f, WHOLE) - TYPO_COST))


def may_match(name: Column, q: str) -> Column:
    """A cheap test that every match passes. An edit touches at most two neighbours of three pieces."""
    folded = fold(name)
    if len(q) < TYPO_LENGTH:
        return F.contains(folded, F.lit(q))
    third = len(q) // 3
    out = F.lit(False)
    for piece in (q[:third], q[third : 2 * third], q[2 * third :]):
        out = out | F.contains(folded, F.lit(piece))
    return out


def fuzzy_score(name: Column, q: str) -> Column:
    """A clean occurrence, or in words of five bytes and more one typo."""

    def best(n: Column) -> Column:
        clean = fuzzy_capped(n, F.lit(q), WHOLE)
        return F.greatest(clean, typo_score(n, q), whole_typo_score(n, q)) if len(q) >= TYPO_LENGTH else clean

    return F.when(may_match(name, q), let(name, best))


def token_score(name: Column, mode: str, q: str) -> Column:
    """mode: fuzzy, exact, prefix or suffix; q: folded bytes view."""
    folded, cost = fold(name), length_cost(name)
    if mode == "fuzzy":
        return fuzzy_score(name, q)
    if mode == "exact":
        at = F.instr(folded, q)
        return F.when(at > 0, (F.lit(40) + F.when(at == 1, 30).otherwise(0) - cost).cast("int"))
    if mode == "prefix":
        return F.when(folded.startswith(q), (F.lit(60) - cost).cast("int"))
    return F.when(folded.endswith(q), (F.lit(50) - cost).cast("int"))


def token_matches(name: Column, mode: str, q: str) -> Column:
    """For negated words: no typos."""
    return F.contains(fold(name), F.lit(q)) if mode in ("fuzzy", "exact") else token_score(name, mode, q).isNotNull()
