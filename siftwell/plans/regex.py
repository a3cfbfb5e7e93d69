"""Patterns: checks, the dialect, and which trigrams every match must contain.

The planner is a recursive descent over the pattern that keeps, for each part, the few strings it can
be exactly (if few) and a requirement that any match meets. A requirement is True (none), a trigram,
or ("and" | "or", parts). Whatever isn't understood requires nothing, so that pruning stays sound.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from ..functions.bytesql import fold_text

MOST_EXACT, MOST_CLASS = 16, 8
#: Characters that fold to k and s in Unicode; they aren't ASCII, so trigrams with k or s prove nothing without care.
UNICODE_FOLDS = "ks"
_POSIX = {"alpha": "Alpha", "digit": "Digit", "alnum": "Alnum", "upper": "Upper", "lower": "Lower", "punct": "Punct", "space": "Space", "xdigit": "XDigit", "cntrl": "Cntrl", "graph": "Graph", "print": "Print", "blank": "Blank"}
_UNSUPPORTED = re.compile(r"\(\*|\\K|\\C|\(\?R\)|\(\?\d|\(\?&")


def java(pattern: str) -> str:
    """The pattern in Java's dialect."""
    pattern = re.sub(r"\(\?P<", "(?<", pattern)
    return re.sub(r"\[:(\w+):\]", lambda m: f"\\p{{{_POSIX.get(m[1], m[1])}}}", pattern)


def problem(pattern: str) -> str:
    """Why a pattern can't be used; empty if it can."""
    if m := _UNSUPPORTED.search(pattern):
        return f"unsupported {m[0]}"
    try:
        from pyspark import SparkContext

        jvm = SparkContext._active_spark_context and SparkContext._active_spark_context._jvm
        if jvm:
            jvm.java.util.regex.Pattern.compile(java(pattern))
        else:
            re.compile(re.sub(r"\[:\w+:\]", "a", pattern))
    except Exception as e:  # the JVM's exceptions have no common base here
        return str(getattr(e, "java_exception", e)).splitlines()[0].removeprefix("java.util.regex.PatternSyntaxException: ")
    return ""


def name_pattern(pattern: str) -> str:
    """For names and paths: without case, only line feeds end lines."""
    return f"(?diu){java(pattern)}"


def smart_case(pattern: str) -> bool:
    """Whether case counts: the pattern has an upper-case letter."""
    return any("A" <= c <= "Z" for c in pattern)


def text_pattern(pattern: str) -> str:
    return f"(?dm{'' if smart_case(pattern) else 'iu'}){java(pattern)}"


Need = object  # True, a trigram, or ("and" | "or", [...])


def both(parts: list[Need]) -> Need:
    flat: list[Need] = []
    for p in parts:
        flat += p[1] if isinstance(p, tuple) and p[0] == "and" else [] if p is True else [p]
    flat = list(dict.fromkeys(map(_freeze, flat)))
    return True if not flat else flat[0] if len(flat) == 1 else ("and", tuple(flat))


def either(parts: list[Need]) -> Need:
    if any(p is True for p in parts):
        return True
    flat = list(dict.fromkeys(map(_freeze, parts)))
    return flat[0] if len(flat) == 1 else ("or", tuple(flat))


def _freeze(p: Need) -> Need:
    return (p[0], tuple(p[1])) if isinstance(p, tuple) else p


def literal_need(text: str, unicode_caseless: bool = False) -> Need:
    """All trigrams of a folded text."""
    found = [text[i : i + 3] for i in range(len(text) - 2)]
    return both([t for t in found if not (unicode_caseless and set(t) & set(UNICODE_FOLDS))])


@dataclass
class Part:
    exact: tuple[str, ...] | None  # the strings it can be; None if not few
    need: Need = True


class Planner:
    def __init__(self, pattern: str):
        self.p, self.i = pattern, 0
        self.caseless = not smart_case(pattern)
        self.safe = pattern.isascii() and "(*" not in pattern

    def plan(self) -> Need:
        try:
            part = self.alternatives()
        except (IndexError, RecursionError):
            return True
        return both([part.need, self.of(part)]) if self.safe and self.i == len(self.p) else True

    def of(self, part: Part) -> Need:
        return True if part.exact is None else either([literal_need(x, self.caseless) for x in part.exact])

    def peek(self, n: int = 1) -> str:
        return self.p[self.i : self.i + n]

    def alternatives(self) -> Part:
        parts = [self.sequence()]
        while self.peek() == "|":
            self.i += 1
            parts.append(self.sequence())
        if len(parts) == 1:
            return parts[0]
        if all(p.exact is not None for p in parts):
            exact = tuple(dict.fromkeys(x for p in parts for x in p.exact))
            if len(exact) <= MOST_EXACT:
                return Part(exact, either([p.need for p in parts]))
        return Part(None, either([both([p.need, self.of(p)]) for p in parts]))

    def sequence(self) -> Part:
        """One part after another. A run of exact strings ends where anything may stand; its strings are then required."""
        run, needs, whole = Part(("",)), [], True
        while self.i < len(self.p) and self.peek() not in "|)":
            part = self.repeated()
            needs.append(part.need)
            if part.exact is not None and len(run.exact) * len(part.exact) <= MOST_EXACT:
                run = Part(tuple(dict.fromkeys(x + y for x in run.exact for y in part.exact)))
            else:
                needs.append(self.of(run))
                whole, run = False, Part(("",) if part.exact is None else part.exact)
        return Part(run.exact, both(needs)) if whole else Part(None, both([*needs, self.of(run)]))

    def repeated(self) -> Part:
        part = self.atom()
        while True:
            c = self.peek()
            if c in ("*", "?", "+"):
                least = int(c == "+")
                self.i += 1
            elif c == "{" and (m := re.match(r"\{(\d+)[^}]*\}", self.p[self.i :])):
                least = int(m[1])
                self.i += m.end()
            else:
                return part
            if self.peek() in ("?", "+"):
                self.i += 1
            part = Part(None, both([part.need, self.of(part)]) if least else True)

    def atom(self) -> Part:
        c = self.p[self.i]
        self.i += 1
        if c == ".":
            return Part(None)
        if c in "^$":
            return Part(("",))
        if c == "(":
            if self.peek() == "?":
                if self.peek(2) != "?:":
                    self.safe = False
                    raise IndexError
                self.i += 2
            inner = self.alternatives()
            if self.peek() != ")":
                raise IndexError
            self.i += 1
            return inner
        if c == "[":
            return self.char_class()
        if c == "\\":
            return self.escape()
        return Part((fold_text(c),))

    def escape(self) -> Part:
        c = self.p[self.i]
        self.i += 1
        if c in "bBAzZG":
            return Part(("",))
        if c in "ntr":
            return Part(({"n": "\n", "t": "\t", "r": "\r"}[c],))
        if c == "Q":
            text, _, _ = self.p[self.i :].partition("\\E")
            self.i = min(len(self.p), self.i + len(text) + 2)
            return Part((fold_text(text),))
        if c in "xpP":
            m = re.match(r"\{[^}]*\}|" + ("[0-9a-fA-F]{0,2}" if c == "x" else "."), self.p[self.i :])
            self.i += m.end() if m else 0
            return Part(None)
        if c.isalnum():
            self.safe &= c in "dDsSwWhHvVRX"
            return Part(None)
        return Part((fold_text(c),))

    def char_class(self) -> Part:
        negated = self.peek() == "^"
        self.i += negated
        found: list[str] = []
        plain, first = not negated, True
        while first or self.peek() != "]":
            first = False
            c = self.p[self.i]
            self.i += 1
            if c == "[" and self.peek() == ":":
                self.i = self.p.index(":]", self.i) + 2 if ":]" in self.p[self.i :] else len(self.p)
                plain = False
            elif c == "[" or c == "&" and self.peek() == "&":
                self.safe = plain = False  # Java reads sets within sets
            elif c == "\\":
                e = self.p[self.i]
                self.i += 1
                plain &= not e.isalnum()
                found.append(fold_text(e))
            elif self.peek() == "-" and self.p[self.i + 1] != "]":
                high = self.p[self.i + 1]
                self.i += 2
                if high == "\\" or not 0 <= ord(high) - ord(c) <= MOST_CLASS:
                    plain = False
                    self.i += high == "\\"
                else:
                    found += [fold_text(chr(x)) for x in range(ord(c), ord(high) + 1)]
            else:
                found.append(fold_text(c))
        self.i += 1
        exact = tuple(dict.fromkeys(found))
        return Part(exact) if plain and exact and len(exact) <= MOST_CLASS else Part(None)


def regex_need(pattern: str) -> Need:
    return Planner(pattern).plan()


def meets(need: Need, text: str) -> bool:
    """Whether a folded text has the required trigrams."""
    if need is True:
        return True
    if isinstance(need, str):
        return need in text
    return (all if need[0] == "and" else any)(meets(p, text) for p in need[1])


_MAY_CROSS = re.compile(r"\\[nsWDRvSHNAzZGXQ]|\[\^|\(\?|\.\*\)|\\x|\\p|\\P|\[:")


def within_lines(pattern: str) -> bool:
    """Whether every match surely lies in one line and isn't empty, so that lines can be tested one by one."""
    if "\n" in pattern or _MAY_CROSS.search(pattern) or re.search(r"\[[^\]]*[ -/:-@\[-`{-~]-", pattern):
        return False
    try:
        return re.search(f"(?m){re.sub(r'[+](?=[+])', '', pattern)}", "") is None and not re.search(r"(^|[|(])(\^|\$)*($|[|)])", pattern)
    except re.error:
        return False
