"""Source text as tokens: one regular expression for each language, built from its comment and string rules."""

from __future__ import annotations

import re
from functools import cache
from typing import NamedTuple

# What each language's comments and strings look like.
SLASH = {"c", "cpp", "objc", "java", "kotlin", "csharp", "zig", "swift", "rust", "go", "js", "ts", "php"}
HASH = {"php", "python", "ruby", "shell"}
TRIPLE = {"swift", "python"}
BACKTICK = {"go", "js", "ts", "shell"}
PREPROCESSED = {"c", "cpp", "objc"}
_START, _PART = r"[A-Za-z_$\u0080-\U0010ffff]", r"[A-Za-z0-9_$\u0080-\U0010ffff]"


class Token(NamedTuple):
    kind: str  # ident, num, str, macro or punct
    text: str
    line: int
    first: bool  # the first of its line


@cache
def scanner(lang: str) -> re.Pattern:
    skip, strings = [r"[ \t\r\f\v]+"], []
    if lang in SLASH:
        skip += [r"//[^\n]*", r"/\*(?s:.*?)(?:\*/|\Z)"]
    if lang in HASH:
        skip.append(r"\#[^\n]*")
    if lang == "lua":
        skip += [r"--\[(?P<c>=*)\[(?s:.*?)(?:\](?P=c)\]|\Z)", r"--[^\n]*"]
        strings.append(r"\[(?P<l>=*)\[(?s:.*?)(?:\](?P=l)\]|\Z)")
    if lang in TRIPLE:
        strings += [r'"""(?s:.*?)(?:"""|\Z)', r"'''(?s:.*?)(?:'''|\Z)"]
    if lang == "rust":
        strings.append(r'\bb?r(?P<r>\#*)"(?s:.*?)(?:"(?P=r)|\Z)')
    plain = [r'"(?:\\(?s:.)|[^"\\\n])*(?:"|(?=\n)|\\?\Z)']
    if lang == "rust":
        # a quote without its partner two places on begins a lifetime
        plain.append(r"'(?:\\(?s:.)(?:\\(?s:.)|[^'\\\n])*|[^\n\\])'")
        skip.append("'")
    else:
        plain.append(r"'(?:\\(?s:.)|[^'\\\n])*(?:'|(?=\n)|\\?\Z)")
    if lang in BACKTICK:
        plain.append(r"`(?:\\(?s:.)|[^`\\])*(?:`|\Z)")
    strings += plain
    ident = _START + (f"(?:{_PART}|-(?={_PART}))*" if lang == "shell" else f"{_PART}*")
    if lang == "ruby":
        ident += r"(?:[?!](?!=))?"
    kinds = [("nl", r"\n")]
    if lang in PREPROCESSED:
        kinds.append(("pre", r"\#(?:\\\r?\n|[^\n])*"))
    # strings before skipping, where a lifetime's quote is skipped
    kinds += [("skip", "|".join(skip[:-1] if lang == "rust" else skip)), ("str", "|".join(strings))]
    if lang == "rust":
        kinds.append(("life", "'"))
    kinds += [("ident", ident), ("num", rf"[0-9](?:{_PART}|[.'])*"), ("punct", r"::|->|=>|(?s:.)")]
    return re.compile("|".join(f"(?P<{k}>{p})" for k, p in kinds))


_DEFINE = re.compile(rf"\#[ \t]*define[ \t]*({_PART}+)")


def tokens(source: str, lang: str) -> list[Token]:
    out: list[Token] = []
    line, first = 1, True
    for m in scanner(lang).finditer(source):
        kind, text = m.lastgroup, m[0]
        if m.lastgroup in ("c", "l", "r"):  # a bracket's own group
            kind = next(k for k in ("skip", "str") if m[k] is not None)
        if kind == "nl":
            line, first = line + 1, True
        elif kind == "pre":
            if first:
                if d := _DEFINE.match(text):
                    out.append(Token("macro", d[1], line, True))
                    first = False
                line += text.count("\n")
            else:
                # in the midst of a line it is a mark like any other; what follows is read as code
                out.append(Token("punct", "#", line, False))
                rest = tokens(text[1:], lang)
                out += [t._replace(line=t.line + line - 1, first=t.first and t.line > 1) for t in rest]
                line += text.count("\n")
        elif kind in ("skip", "life"):
            line += text.count("\n")
        else:
            begin = line
            line += text.count("\n")
            out.append(Token(kind, text, line if kind == "str" else begin, first))
            first = False
    return out
