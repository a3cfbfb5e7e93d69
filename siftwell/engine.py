"""The engine: tables and what can be asked of them; and the JSON requests of its service."""

from __future__ import annotations

import json
import time
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import grep as content_search
from .operators import live, postings, search, symbols
from .plans import regex
from .plans.query import parse

HITS, FILES, PER_FILE, MOST_FILES = search.LIMIT, content_search.LIMIT, content_search.PER_FILE, content_search.FALLBACK_FILES
LONGEST_REQUEST, DEEPEST = 1 << 20, 64


@dataclass
class Engine:
    """entries: derived; content: (path, size, mtime, text); defs: (path, name, line, kind). now: seconds, for ages.
    index: the folder of a content index, by which grep leaves out files that cannot match."""

    spark: SparkSession
    entries: DataFrame
    content: DataFrame
    defs: DataFrame
    root: str = "/"
    home: str = "/"
    now: int | None = None
    index: str | None = None

    def clock(self) -> int:
        return int(time.time()) if self.now is None else self.now

    def search(self, text: str, limit: int | None = None) -> search.Hits:
        return search.search(self.entries, text, self.root, self.clock(), limit, self.home)

    def symbols(self, text: str, limit: int = HITS) -> DataFrame:
        return symbols.find(self.defs, self.entries, text, self.root, self.clock(), limit, self.home)

    def grep(self, pattern: str, mode: str = "literal", query: str = "", limit: int = FILES, per_file: int = PER_FILE) -> DataFrame:
        return content_search.grep(self._candidates(pattern, mode), pattern, mode, query, self.clock(), self.root, self.home, limit, per_file)

    def _candidates(self, pattern: str, mode: str) -> DataFrame:
        """Contents that may match by the index, and those that it doesn't have as they are."""
        if not self.index or content_search.Grep(pattern, mode).problem():
            return self.content
        need, follows = postings.literal_plan(pattern) if mode == "literal" else (regex.regex_need(pattern), {})
        held = postings.open_index(self.spark, self.index)
        found = postings.candidates(held, need, follows, pattern if mode == "literal" else "")
        keys = ["path", "size", "mtime"]
        known = self.content.join(found.select(keys), keys, "left_semi")
        return known.unionByName(self.content.join(held["docs"].select(keys), keys, "left_anti").select(known.columns))

    def files(self, text: str, most: int = MOST_FILES) -> DataFrame:
        """Paths that a query selects, in order of path."""
        return search.matches(self.entries.where("not is_dir"), parse(text, self.home), self.root, self.clock()).select("path").orderBy("path").limit(most)

    def status(self) -> dict:
        return live.status(self.entries, self.defs, self.content).first().asDict()


def _depth(x: object, level: int = 0) -> int:
    return max([level, *(_depth(v, level + 1) for v in (x.values() if isinstance(x, dict) else x if isinstance(x, list) else []))])


def _id(x: object) -> object:
    return x if isinstance(x, str) else round(float(x), 3) if isinstance(x, (int, float)) and not isinstance(x, bool) else None


def handle(engine: Engine, line: str | bytes) -> str:
    """One JSON request, one JSON response."""
    text = line.decode("utf-8", "replace") if isinstance(line, bytes) else line
    reply: dict = {}
    began = time.monotonic()
    try:
        request = json.loads(text) if len(text) <= LONGEST_REQUEST else None
        if not isinstance(request, dict) or _depth(request) > DEEPEST:
            raise ValueError("bad request")
        if "id" in request:
            reply["id"] = _id(request["id"])
        body = _answer(engine, request)
        reply = {"ok": True, **reply, **body}
        if request.get("op") != "status":
            reply["ms"] = round((time.monotonic() - began) * 1000, 3)
    except (ValueError, RecursionError) as e:
        why = "bad request" if isinstance(e, (json.JSONDecodeError, RecursionError)) else str(e)
        reply = {"ok": False, **reply, "error": why}
    return json.dumps(reply, ensure_ascii=False)


def _answer(engine: Engine, request: dict) -> dict:
    op = request.get("op", "search")
    if op == "status":
        return {"ready": True, **engine.status()}
    if op not in ("search", "grep"):
        raise ValueError("unknown op")
    text = str(request.get("q", ""))
    q = parse(text, engine.home)
    limit = request.get("limit")
    limit = None if limit is None else max(0, int(limit))
    warning = {"warning": q.error} if q.error else {}
    if op == "grep" or q.grep_mode:
        pattern, mode = (str(request.get("pattern", "")), str(request.get("mode", "literal"))) if op == "grep" else (q.grep, q.grep_mode)
        if not pattern:
            raise ValueError("grep needs a pattern")
        found = engine.grep(pattern, mode, text, FILES if limit is None else limit, int(request.get("per_file", PER_FILE)))
        files = [{"path": r["path"], "lines": [x.asDict() for x in r["lines"]]} for r in found.orderBy("ord").collect()]
        return {"complete": True, "files": files, **warning}
    if q.syms:
        hits = engine.symbols(text, HITS if limit is None else limit)
        total = symbols.matches(engine.defs, engine.entries, q, engine.root, engine.clock()).count()
        return {"total": total, "hits": [{k: r[k] for k in ("path", "line", "symbol", "kind")} for r in hits.orderBy("rank").collect()], **warning}
    hits = engine.search(text, limit)
    return {"total": hits.total(), "hits": [r.asDict() for r in hits.top.collect()], **warning}


def cli_lines(found: DataFrame, kind: str) -> DataFrame:
    """(line) of text output: paths; path:line: kind name; or path:line: text."""
    if kind == "symbols":
        return found.select(F.format_string("%s:%d: %s %s", "path", "line", "kind", "symbol").alias("line"))
    if kind == "grep":
        return found.select("path", F.explode("lines").alias("l")).select(F.format_string("%s:%d: %s", "path", "l.line", "l.text").alias("line"))
    return found.select(F.col("path").alias("line"))
