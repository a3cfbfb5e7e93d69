"""The one-line query language, parsed into a frozen Query. No Spark here."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from ..functions.bytesql import bytes_text, fold_text

FILES = frozenset({"none", "video", "audio", "image", "doc", "archive", "code", "font"})
ANY = FILES | {"dir"}
# Names of types, units of sizes (bytes) and ages (seconds).
TYPES = {
    "dir": "dir", "folder": "dir", "directory": "dir", "video": "video", "movie": "video", "audio": "audio", "music": "audio", "image": "image", "photo": "image",
    "picture": "image", "doc": "doc", "document": "doc", "archive": "archive", "zip": "archive", "code": "code", "source": "code", "font": "font",
}
KINDS = {"file": "file", "f": "file", "dir": "dir", "folder": "dir", "d": "dir", "link": "link", "symlink": "link", "l": "link"}
SIZES = {"": 1, "b": 1} | {f"{u}{tail}": 1024**i for i, u in enumerate("kmgt", 1) for tail in ("", "b", "ib")}
AGES = {"s": 1, "m": 60, "min": 60, "h": 3600, "": 86400, "d": 86400, "w": 604800, "mo": 2592000, "y": 31536000}
MOST_TOKENS = 8
TOP = (1 << 63) - 1


@dataclass(frozen=True)
class Token:
    """text: folded, one character for each byte."""

    text: str
    mode: str = "fuzzy"
    negate: bool = False


@dataclass(frozen=True)
class Query:
    tokens: tuple[Token, ...] = ()
    exts: tuple[str, ...] = ()
    types: frozenset[str] = ANY
    kind: str = "any"
    scope: str = ""
    size: tuple[int, int] | None = None
    age: tuple[int, int] | None = None
    name_re: str | None = None
    path_re: str | None = None
    limit: int | None = None
    syms: tuple[str, ...] = ()
    grep: str = ""
    grep_mode: str = ""
    error: str = ""

    @property
    def positive(self) -> tuple[Token, ...]:
        return tuple(t for t in self.tokens if not t.negate)

    @property
    def negative(self) -> tuple[Token, ...]:
        return tuple(t for t in self.tokens if t.negate)

    def selects(self) -> bool:
        """Whether it names any entries; limits, symbols and content alone don't."""
        return bool(self.tokens or self.exts or self.scope or self.size or self.age or self.name_re or self.path_re) or self.types != ANY or self.kind != "any"


def split_words(text: str) -> list[str]:
    words, word, quoted = [], "", False
    for c in text:
        if c == '"':
            quoted = not quoted
        elif c == " " and not quoted:
            words.append(word)
            word = ""
        else:
            word += c
    return [w for w in [*words, word] if w]


def token(word: str) -> Token | None:
    negate = word.startswith("!")
    mode = "exact" if negate else "fuzzy"
    word = word[negate:]
    if word[:1] in ("'", "^"):
        mode, word = {"'": "exact", "^": "prefix"}[word[0]], word[1:]
    elif word.endswith("$"):
        mode, word = "suffix", word[:-1]
    return Token(bytes_text(fold_text(word)), mode, negate) if word else None


def amount(text: str, units: dict[str, int]) -> int:
    """A number with a unit, cut to whole ones; ValueError if it isn't one."""
    m = re.fullmatch(r"(\d*)(?:\.(\d*))?(.*)", text, re.S)
    if not m or not (m[1] or m[2]) or m[3] not in units:
        raise ValueError(text)
    return int(float(f"{m[1] or 0}.{m[2] or 0}") * units[m[3]])


def bounds(text: str, read: Callable[[str], int], bare_is_most: bool) -> tuple[int, int]:
    """<x <=x >x >=x =x a..b or x as [low, high]."""
    m = re.match(r"[<>]=?|=", text)
    op, rest = (m[0], text[m.end() :]) if m else ("", text)
    if op:
        x = read(rest)
        return {">=": (x, TOP), ">": (x + 1, TOP), "<=": (0, x), "<": (0, x - 1) if x else (TOP, 0), "=": (x, x)}[op]
    if ".." in text:
        low, _, high = text.partition("..")
        return read(low), read(high)
    return (0, read(text)) if bare_is_most else (read(text), TOP)


def _narrow(held: tuple[int, int] | None, new: tuple[int, int]) -> tuple[int, int]:
    return (max(held[0], new[0]), min(held[1], new[1])) if held else new


@dataclass
class _Parser:
    home: str
    valid_regex: Callable[[str], str]
    q: Query = field(default_factory=Query)

    def bad(self, word: str, why: str = "ignored ") -> None:
        if not self.q.error:
            self.put(error=why + word)

    def put(self, **values) -> None:
        self.q = replace(self.q, **values)

    def filter(self, key: str, raw: str, word: str) -> bool:
        """Take a key:value word; false if there is no such key."""
        v, q = fold_text(raw), self.q
        if key == "size":
            try:
                self.put(size=_narrow(q.size, bounds(v, lambda s: amount(s, SIZES), False)))
            except ValueError:
                self.bad(word)
        elif key in ("mtime", "modified"):
            try:
                self.put(age=_narrow(q.age, bounds(v, lambda s: amount(s, AGES), True)))
            except ValueError:
                self.bad(word)
        elif key == "type":
            found: set[str] = set()
            for name in filter(None, v.split(",")):
                if name == "app":
                    self.put(kind="dir", exts=(*self.q.exts, "app"))
                    found.add("dir")
                elif name == "file":
                    found |= FILES
                elif name in TYPES:
                    found.add(TYPES[name])
                else:
                    self.bad(word, "unknown type in ")
            if found:
                self.put(types=self.q.types & found)
        elif key == "kind":
            if v in KINDS:
                self.put(kind=KINDS[v])
            else:
                self.bad(word, "unknown kind in ")
        elif key == "ext":
            self.put(exts=q.exts + tuple(x.removeprefix(".") for x in v.split(",") if x))
        elif key == "in":
            place = self.home + raw[1:] if raw.startswith("~") else raw
            self.put(scope=place.rstrip("/") or ("/" if place else ""))
        elif key in ("re", "path"):
            why = self.valid_regex(raw)
            if why:
                self.bad(word, f"{why} in ")
            self.put(**{"name_re" if key == "re" else "path_re": None if why else raw})
        elif key == "limit":
            m = re.match(r"\d+", v)
            self.put(limit=int(m[0]) if m else 0)
        elif key in ("sym", "symbol"):
            if v:
                self.put(syms=(*q.syms, v))
        elif key in ("grep", "content"):
            self.put(grep=raw, grep_mode="literal")
        elif key == "regex":
            self.put(grep=raw, grep_mode="regex")
        else:
            return False
        return True

    def word(self, word: str) -> None:
        key, colon, raw = word.partition(":")
        if colon and key and self.filter(fold_text(key), raw, word):
            return
        for piece in filter(None, word.split("/")):
            t = token(piece)
            if t and (t.negate or len(self.q.positive) < MOST_TOKENS):
                self.put(tokens=(*self.q.tokens, t))


def parse(text: str, home: str = "/", valid_regex: Callable[[str], str] | None = None) -> Query:
    """valid_regex: why a pattern can't be used, or an empty string. The first problem is kept as the query's error."""
    from .regex import problem

    parser = _Parser(home, valid_regex or problem)
    for word in split_words(text):
        parser.word(word)
    return parser.q
