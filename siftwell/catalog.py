"""The queries of the engine's own operators and their SQL.

Names begin with the operator's number in the survey. The SQL is written for DuckDB and shares nothing
with the Columns it is compared with.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import storage, views
from .functions import metadata, scoring
from .functions.bytesql import bytes_view, fold
from .operators import entries, grep, live, numbering, postings, search, symbols
from .plans import regex
from .plans.query import parse

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}
NOW, ROOT = views.NOW, views.ROOT


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)


def _add(name: str, query: Query, sql: str) -> None:
    _queries[name], _sql[name] = query, sql


# --- the views in SQL

_DOCS = f"docs AS ({views.DOCS.format(documents='documents').replace('octet_length(text)', 'strlen(text)').replace('AS STRING', 'AS VARCHAR').replace('AS mtime', 'AS mtime, name')})"
_DIRS = """dirs AS (SELECT DISTINCT array_to_string(list_slice(string_split(path,'/'),1,i),'/') AS path
  FROM (SELECT path, unnest(range(3, CAST(len(string_split(path,'/')) AS BIGINT))) AS i FROM docs))"""
_ADJUST = """CASE WHEN f='Applications' THEN 30 WHEN f LIKE '%.app' THEN -25 WHEN f LIKE '.%' THEN -25 WHEN f='Library' THEN -20
  WHEN f IN ('Caches','caches','cache','Cache','Logs','DerivedData','CoreSimulator') THEN -20
  WHEN f IN ('node_modules','__pycache__','site-packages','Pods','venv','bower_components') THEN -30
  WHEN f IN ('target','build','dist','out','vendor','deps','tmp','temp') THEN -12 WHEN f IN ('folders','Containers','Group Containers') THEN -10
  WHEN f='Application Support' THEN -5 ELSE 0 END"""
_ENTRIES = f"""raw AS (SELECT path, false AS is_dir, is_link, hidden, size, mtime FROM docs
   UNION ALL SELECT path, true, false, split_part(path,'/',-1) LIKE '.%', 0, 0 FROM dirs),
  named AS (SELECT *, split_part(path,'/',-1) AS name, list_slice(string_split(path,'/'),3,len(string_split(path,'/'))-1) AS folders FROM raw),
  ents AS (SELECT *, CASE WHEN NOT is_dir AND contains(name,'.') THEN lower(split_part(name,'.',-1)) END AS ext,
   list_reduce(list_prepend(0, list_transform(folders, lambda f: {_ADJUST})), lambda a, b: greatest(-100, least(60, a+b))) AS prior,
   CASE WHEN name LIKE '.%' THEN -8 ELSE 0 END + CASE WHEN hidden THEN -8 ELSE 0 END + CASE WHEN (is_dir OR is_link) AND name LIKE '%.app' THEN 25 ELSE 0 END
   + CASE WHEN {NOW}-mtime<=86400 THEN 10 WHEN {NOW}-mtime<=604800 THEN 7 WHEN {NOW}-mtime<=2592000 THEN 4 WHEN {NOW}-mtime<=31536000 THEN 1 ELSE 0 END AS tweak FROM named)"""
_WITH = f"WITH {_DOCS}, {_DIRS}, {_ENTRIES} "
_CATEGORY = "CASE " + " ".join(f"WHEN ext IN ({','.join(repr(x) for x in v.split())}) THEN '{k}'" for k, v in metadata.CATEGORIES.items()) + " END"


def _fuzzy(name: str, q: str, cap: int = 100) -> str:
    """The score of a literal's first occurrence in an ASCII name."""
    up, low, mark = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", scoring.DELIMITERS
    c = f"translate({name}, '{low}{up}0123456789{mark}', '{'l' * 26}{'u' * 26}{'d' * 10}{'x' * len(mark)}')"
    s, n, m = f"strpos(lower({name}), '{q}')", f"strlen({name})", len(q)
    b = lambda p: f"(CASE WHEN substr({c},{p},1)<>'x' AND (({p})=1 OR substr({c},({p})-1,1)='x') THEN 8 WHEN ({p})>1 AND ((substr({c},({p})-1,1)='l' AND substr({c},{p},1)='u') OR (substr({c},({p})-1,1) IN ('l','u') AND substr({c},{p},1)='d')) THEN 7 ELSE 0 END)"
    met = lambda k: " OR ".join(f"{b(f'{s}+{j}')}=8" for j in range(1, k + 1))
    later = "".join(f" + 16 + greatest({b(f'{s}+{k}')}, {b(s)}, 4, CASE WHEN {met(k)} THEN 8 ELSE 0 END)" for k in range(1, m))
    off = f"(CASE WHEN {n}>1 AND {name} LIKE '.%' THEN 1 ELSE 0 END)"
    dot = f"({n} - strpos(reverse({name}),'.'))"
    stem = f"(CASE WHEN contains({name},'.') AND {dot}>{off} THEN {dot} ELSE {n} END)"
    place = f"(CASE WHEN {s}-1={off} THEN least({cap}, CASE WHEN {s}-1+{m}={n} THEN 100 WHEN {s}-1+{m}={stem} THEN 80 ELSE 30 END) ELSE 0 END)"
    return f"(CASE WHEN {s}>0 THEN 16 + 2*{b(s)}{later} + {place} - least({n},80)//3 END)"


def _hits(text: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return search.matches(views.tree(spark, sf_dir), parse(text), ROOT, NOW).select("path", "score")

    return run


def _filter(name: str, text: str, where: str) -> None:
    _add(name, _hits(text), f"{_WITH} SELECT path, CAST(prior + tweak AS INTEGER) AS score FROM ents WHERE {where}")


# --- filters

_filter("f1_size_range", "size:1kb..4kb", "NOT is_dir AND size BETWEEN 1024 AND 4096")
_filter("f1_size_below", "size:<500", "NOT is_dir AND size <= 499")
_filter("f2_size_class_boundary", "size:>=1024 size:<=16kb", "NOT is_dir AND size BETWEEN 1024 AND 16384")
_filter("f3_mtime_window", "mtime:<30d", f"mtime >= {NOW} - 2592000 + 1")
_filter("f3_mtime_range", "modified:2w..1y", f"mtime BETWEEN {NOW}-31536000 AND {NOW}-1209600")
_filter("f4_type_code", "type:code", f"NOT is_dir AND {_CATEGORY}='code'")
_filter("f4_type_doc_or_dir", "type:doc,dir", f"is_dir OR {_CATEGORY}='doc'")
_filter("f4_type_file", "type:file", "NOT is_dir")
_filter("f5_type_app", "type:app", "is_dir AND name LIKE '%.app'")
_filter("f6_kind_file", "kind:file", "NOT is_dir AND NOT is_link")
_filter("f6_kind_dir", "kind:dir", "is_dir")
_filter("f6_kind_link", "kind:link", "is_link")
_filter("f7_ext", "ext:md,.TXT", "contains(name,'.') AND lower(split_part(name,'.',-1)) IN ('md','txt')")
_filter("f8_scope", "in:/corpus/en/ size:>0", "path LIKE '/corpus/en/%' AND NOT is_dir AND size > 0")
_filter("f9_name_regex", "re:^(doc|report).*1[0-9]", "regexp_matches(name, '(?i)^(doc|report).*1[0-9]')")
_filter("f10_path_regex", "path:/(de|fr)/.*src1/", "regexp_matches(path, '(?i)/(de|fr)/.*src1/')")
_filter("f11_root_never", "in:/corpus", "true")
_filter("q5_empty_range", "size:<0", "false")
_filter("q9_bad_filter_ignored", "size:abc kind:dir", "is_dir")
_filter("q11_repeated_filters", "size:>1kb size:<3kb ext:py ext:log type:code,doc type:code", f"NOT is_dir AND size BETWEEN 1025 AND 3071 AND ext IN ('py','log') AND {_CATEGORY}='code'")


def _nothing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(views.tree(spark, sf_dir), "limit:5", ROOT, NOW).top


_add("q10_selects_nothing", _nothing, f"{_WITH} SELECT path, is_dir AS dir, size, mtime, CAST(0 AS INTEGER) AS score FROM ents WHERE false")


def _lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.tree(spark, sf_dir).where(F.col("path") == "/corpus/en/src1").select("path", "is_dir")


_add("f17_lookup", _lookup, f"{_WITH} SELECT path, is_dir FROM ents WHERE path='/corpus/en/src1'")

# --- words and scores


def _token(name: str, word: str, sql: str, where: str = "score IS NOT NULL") -> None:
    _add(name, _hits(word), f"{_WITH}, scored AS (SELECT path, {sql} AS score, prior+tweak AS more FROM ents) SELECT path, CAST(score + more AS INTEGER) AS score FROM scored WHERE {where}")


_token("t3_fuzzy_score", "doc", _fuzzy("name", "doc"))
_token("t3_fuzzy_camel", "notes", _fuzzy("name", "notes"))
_token("t3_fuzzy_long", "readme", _fuzzy("name", "readme"))
_token("t4_single_byte", "n", _fuzzy("name", "n"))
_token("t6_typo_swap", "reprot", f"CASE WHEN lower(name) LIKE 'report%' THEN {_fuzzy('name', 'report', 30)} - 60 END")
_token("t6_typo_missing", "confg.", f"CASE WHEN lower(name) LIKE 'config.%' THEN {_fuzzy('name', 'config.', 30)} - 60 END")
_token("t6_typo_in_word", "fille", f"CASE WHEN name LIKE 'my file%' THEN {_fuzzy('name', 'file', 30)} - 60 END")
_token("t8_exact", "'doc", "CASE WHEN strpos(lower(name),'doc')>0 THEN 40 + CASE WHEN strpos(lower(name),'doc')=1 THEN 30 ELSE 0 END - least(strlen(name),80)//3 END")
_token("t9_prefix", "^Rep", "CASE WHEN lower(name) LIKE 'rep%' THEN 60 - least(strlen(name),80)//3 END")
_token("t10_suffix", ".PY$", "CASE WHEN lower(name) LIKE '%.py' THEN 50 - least(strlen(name),80)//3 END")
_token("f12_word_and_filter", "loop ext:html", f"CASE WHEN name LIKE '%.html' THEN {_fuzzy('name', 'loop')} END")
_token("t11_fuzzy_best", "loop1", f"CASE WHEN contains(name,'loop1') THEN {_fuzzy('name', 'loop1')} END")
_token("t12_negated_word", "doc !notes", f"CASE WHEN NOT contains(lower(name),'notes') THEN {_fuzzy('name', 'doc')} END")
_token("f14_negated_folder", "doc !node_modules", f"CASE WHEN NOT contains(path,'/node_modules') THEN {_fuzzy('name', 'doc')} END")
_token("f14_negated_prefix", "readme !^src1", f"CASE WHEN NOT list_contains(list_transform(folders, lambda f: f LIKE 'src1%'), true) AND name NOT LIKE 'src1%' THEN {_fuzzy('name', 'readme')} END")
_filter("f14_only_negated", "!build", "NOT contains(lower(array_to_string(folders,'/')),'build') AND NOT contains(lower(name),'build')")
_token(
    "f13_multi_token",
    "en doc",
    f"""CASE WHEN (contains(lower(name),'doc') OR contains(lower(name),'en')) AND (contains(lower(name),'doc') OR contains(lower(array_to_string(folders,'/')),'doc'))
    AND (contains(lower(name),'en') OR contains(lower(array_to_string(folders,'/')),'en'))
    THEN coalesce({_fuzzy("name", "doc")}, greatest(0, list_max(list_transform(folders, lambda f: {_fuzzy("f", "doc")})))*3//4)
       + coalesce({_fuzzy("name", "en")}, greatest(0, list_max(list_transform(folders, lambda f: {_fuzzy("f", "en")})))*3//4) END""",
)
_token(
    "t15_ancestor_bonus",
    "src1 config",
    f"""CASE WHEN contains(lower(name),'config') AND contains(array_to_string(folders,'/'),'src1')
    THEN {_fuzzy("name", "config")} + greatest(0, list_max(list_transform(folders, lambda f: {_fuzzy("f", "src1")})))*3//4 END""",
)


def _score_column(score: Callable[[Column], Column]) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = score(bytes_view(F.col("name")))
        return views.tree(spark, sf_dir).select("path", out.alias("value")).where("value IS NOT NULL")

    return run


def _on_names(name: str, score: Callable[[Column], Column], sql: str) -> None:
    _add(name, _score_column(score), f"{_WITH}, v AS (SELECT path, {sql} AS value FROM ents) SELECT path, CAST(value AS INTEGER) AS value FROM v WHERE value IS NOT NULL")


_DIGITS = "regexp_replace({}, '[^0-9]', '', 'g')"
_on_names("t1_find", lambda n: (F.instr(fold(n), "doc") - 1).cast("int"), "strpos(lower(name),'doc') - 1")
_on_names("t2_starts", lambda n: fold(n).startswith("con").cast("int"), "CASE WHEN lower(name) LIKE 'con%' THEN 1 ELSE 0 END")
_on_names("t5_one_edit_prefix", lambda n: scoring.let(fold(n), lambda f: scoring.one_edit_prefix(f, "raedme")), "CASE WHEN lower(name) LIKE 'readme%' THEN 6 ELSE 0 END")
_on_names("t7_whole_typo", lambda n: scoring.let(fold(n), lambda f: scoring.one_edit_away(f, "raedme_16.html").cast("int")), f"CASE WHEN damerau_levenshtein(lower(name),'raedme_16.html')=1 AND {_DIGITS.format('name')}='16' THEN 1 ELSE 0 END")
_on_names("t13_length_cost", scoring.length_cost, "least(strlen(name),80)//3")
_on_names("t14_stem_end", scoring.stem_end, "CASE WHEN contains(name,'.') AND strlen(name)-strpos(reverse(name),'.') > CASE WHEN strlen(name)>1 AND name LIKE '.%' THEN 1 ELSE 0 END THEN strlen(name)-strpos(reverse(name),'.') ELSE strlen(name) END")
_on_names("t20_public_score", lambda n: scoring.token_score(n, "prefix", "my"), "CASE WHEN lower(name) LIKE 'my%' THEN 60 - least(strlen(name),80)//3 END")


def _entry_column(make: Callable[[DataFrame], Column]) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = views.tree(spark, sf_dir)
        return df.select("path", make(df).alias("value"))

    return run


def _on_entries(name: str, make: Callable[[DataFrame], Column], sql: str) -> None:
    _add(name, _entry_column(make), f"{_WITH} SELECT path, {sql} AS value FROM ents")


_on_entries("t16_tweaks", lambda d: metadata.rank_tweaks(d["name"], d["hidden"], d["is_dir"] | d["is_link"], d["mtime"], NOW).cast("int"), "CAST(tweak AS INTEGER)")
_on_entries("t18_prior", lambda d: d["prior"], "CAST(prior AS INTEGER)")
_on_entries("x1_category", lambda d: d["category"], f"CASE WHEN NOT is_dir THEN {_CATEGORY} END")
_on_entries("x2_language", lambda d: metadata.language(d["name"]), "CASE WHEN lower(split_part(name,'.',-1))='py' AND strpos(name,'.')>0 AND strlen(name)-strpos(reverse(name),'.')>0 THEN 'python' END")
_on_entries("x3_size_class", lambda d: metadata.size_class(d["size"]), "CAST(CASE WHEN size<256 THEN 0 ELSE least(15, floor(log2(size)/2 + 1e-12) - 3) END AS INTEGER)")
_on_entries("x5_hex_name", lambda d: metadata.is_hex_name(d["name"]), "regexp_full_match(name, '[0-9a-f]{16,255}')")
_on_entries("x9_doc_rank", lambda d: metadata.doc_rank(d["path"]), "CAST(CASE WHEN contains(path,'/.') THEN -2 ELSE 0 END - CASE WHEN regexp_matches(path,'\\.(jsonl|ndjson|log|lock|sum)$') THEN 1 ELSE 0 END AS INTEGER)")
_on_entries("x10_text_file", lambda d: metadata.text_file(d["name"], d["size"]), "size > 0 AND size <= 1048576")
_on_entries("x11_content_area", lambda d: metadata.in_content_area(d["path"], ROOT), "NOT list_contains(list_transform(folders, lambda f: f IN ('node_modules','.cache') OR (f LIKE '%.app' AND strlen(f)>4)), true)")
_on_entries("x15_parent", lambda d: d["parent"], "array_to_string(list_slice(string_split(path,'/'),1,len(string_split(path,'/'))-1),'/')")
_on_entries("x17_event_path", lambda d: entries.event_path(F.concat(F.lit("/System/Volumes/Data"), d["path"], F.lit("//"))), "path")

# --- ranking and totals


def _ranked(text: str, k: int) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = search.matches(views.tree(spark, sf_dir), parse(text), ROOT, NOW)
        return search.ranked(found, k).select("rank", "path", "score")

    return run


_ORDER = "score DESC, list_transform(folders, lambda f: '0'||f), is_dir DESC, name, path"
_add("o1_ranked_topk", _ranked("doc", 50), f"{_WITH}, s AS (SELECT *, CAST({_fuzzy('name', 'doc')} + prior + tweak AS INTEGER) AS score FROM ents), r AS (SELECT CAST(row_number() OVER (ORDER BY {_ORDER}) AS INTEGER) AS rank, path, score FROM s WHERE score IS NOT NULL) SELECT * FROM r WHERE rank <= 50")
_add("o2_topk_filters_only", _ranked("kind:dir", 20), f"{_WITH}, s AS (SELECT *, CAST(prior + tweak AS INTEGER) AS score FROM ents WHERE is_dir), r AS (SELECT CAST(row_number() OVER (ORDER BY {_ORDER}) AS INTEGER) AS rank, path, score FROM s) SELECT * FROM r WHERE rank <= 20")


def _total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.matches(views.tree(spark, sf_dir), parse("doc limit:5"), ROOT, NOW).agg(F.count("*").alias("total"))


_add("a1_total", _total, f"{_WITH} SELECT count(*) AS total FROM ents WHERE contains(lower(name),'doc')")


def _limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = views.tree(spark, sf_dir)
    tops = [(k, search.search(df, t, ROOT, NOW, n).top) for k, t, n in (("default", "doc", None), ("own", "doc limit:7", None), ("explicit", "doc limit:7", 9), ("zero", "doc", 0))]
    out = None
    for k, top in tops:
        one = top.agg(F.count("*").alias("n")).select(F.lit(k).alias("rule"), "n")
        out = one if out is None else out.unionByName(one)
    return out


_add("o6_limits", _limits, "SELECT * FROM (VALUES ('default', CAST(50 AS BIGINT)), ('own', 7), ('explicit', 9), ('zero', 0)) t(rule, n)")


def _fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .engine import Engine

    df = views.tree(spark, sf_dir)
    return Engine(spark, df, df, df, ROOT, now=NOW).files("ext:md", 40)


_add("o8_files_by_path", _fallback, f"{_WITH} SELECT path FROM ents WHERE NOT is_dir AND name LIKE '%.MD' ORDER BY path LIMIT 40")
_add("a2_name_counts", lambda s, d: search.name_counts(views.tree(s, d)), f"{_WITH} SELECT is_dir, name, count(*) AS n FROM ents GROUP BY ALL")
_add("a12_subtree_counts", lambda s, d: search.subtree_counts(views.tree(s, d), ROOT), f"{_WITH} SELECT array_to_string(list_slice(string_split(path,'/'),1,i),'/') AS path, count(*) AS n FROM (SELECT path, unnest(range(3, CAST(len(string_split(path,'/')) AS BIGINT))) AS i FROM ents) GROUP BY 1")
_add("j4_names_once", lambda s, d: search.by_name(views.tree(s, d), parse("src1")).select("path", F.col("s0").alias("score")), f"{_WITH}, v AS (SELECT path, CAST({_fuzzy('name', 'src1')} AS INTEGER) AS score FROM ents) SELECT * FROM v WHERE score IS NOT NULL")
_add(
    "j1_folder_hits",
    lambda s, d: search.folder_hits(views.tree(s, d), parse("en build")).select("path", "words", "best0", "best1"),
    f"""{_WITH}, up AS (SELECT path, unnest(folders) AS f FROM ents), sc AS (SELECT path, {_fuzzy("f", "en")} AS a, CASE WHEN f='build' THEN {_fuzzy("f", "build")} END AS b FROM up)
    SELECT path, CAST(bit_or(CASE WHEN a IS NULL THEN 0 ELSE 1 END + CASE WHEN b IS NULL THEN 0 ELSE 2 END) AS INTEGER) AS words, CAST(max(coalesce(a,0)) AS INTEGER) AS best0, CAST(max(coalesce(b,0)) AS INTEGER) AS best1
    FROM sc WHERE a IS NOT NULL OR b IS NOT NULL GROUP BY path""",
)


def _outside_dead(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = views.tree(spark, sf_dir)
    dead = df.where("is_dir AND name = 'node_modules'").select(F.col("path").alias("folder"))
    below = df.select("path", F.explode(live.ancestors(F.col("path"))).alias("folder")).join(dead, "folder", "left_semi").select("path")
    return df.join(below, "path", "left_anti").select("path")


_add("j2_negated_subtrees", _outside_dead, f"{_WITH} SELECT path FROM ents WHERE NOT list_contains(folders,'node_modules')")
_add("j3_scope_semi", _hits("in:/corpus/de kind:file"), f"{_WITH} SELECT path, CAST(prior+tweak AS INTEGER) AS score FROM ents WHERE path LIKE '/corpus/de/%' AND NOT is_dir AND NOT is_link")

# --- overlay and incremental upkeep


def _versions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Content as held and as wanted: some files new, some grown, some gone."""
    held = views.content(spark, sf_dir).where("doc_id % 7 <> 0")
    wanted = views.content(spark, sf_dir).where("doc_id % 9 <> 0").withColumn("size", F.when(F.col("doc_id") % 10 == 0, F.col("size") + 1).otherwise(F.col("size")))
    return held, wanted


def _sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    return live.sync_diff(*_versions(spark, sf_dir), ["size", "mtime"])


_add("j7_sync_diff", _sync, f"WITH {_DOCS} SELECT path, CASE WHEN doc_id%7=0 THEN 'add' WHEN doc_id%9=0 THEN 'drop' WHEN doc_id%10=0 THEN 'replace' ELSE 'keep' END AS action FROM docs WHERE NOT (doc_id%7=0 AND doc_id%9=0)")
_add("j8_listing_diff", lambda s, d: _sync(s, d).where("action <> 'keep'").groupBy("action").agg(F.count("*").alias("n")), f"WITH {_DOCS} SELECT CASE WHEN doc_id%7=0 THEN 'add' WHEN doc_id%9=0 THEN 'drop' ELSE 'replace' END AS action, count(*) AS n FROM docs WHERE NOT (doc_id%7=0 AND doc_id%9=0) AND (doc_id%7=0 OR doc_id%9=0 OR doc_id%10=0) GROUP BY 1")


def _reused(spark: SparkSession, sf_dir: str) -> DataFrame:
    held, wanted = (symbols.fingerprint(x) for x in _versions(spark, sf_dir))
    return wanted.join(held.select("path", "fingerprint"), ["path", "fingerprint"], "left_semi").select("path")


_add("j10_fingerprint_reuse", _reused, f"WITH {_DOCS} SELECT path FROM docs WHERE doc_id%7<>0 AND doc_id%9<>0 AND doc_id%10<>0")


def _overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = views.tree(spark, sf_dir)
    dead = base.where("NOT is_dir AND mtime % 9 = 0")
    extras = base.where("NOT is_dir AND mtime % 5 = 0").withColumn("size", F.col("size") + 1)
    return search.overlaid(base, dead, extras)


_add("u1_overlay_view", lambda s, d: _overlay(s, d).select("path", "size", "is_extra"), f"{_WITH} SELECT path, CASE WHEN NOT is_dir AND mtime%5=0 THEN size+1 ELSE size END AS size, NOT is_dir AND mtime%5=0 AS is_extra FROM ents WHERE is_dir OR mtime%5=0 OR mtime%9<>0")
_add(
    "o3_overlay_merge",
    lambda s, d: search.ranked(search.score(_overlay(s, d).where("NOT is_dir"), parse("loop"), NOW), 30).select("rank", "path", "score"),
    f"{_WITH}, s AS (SELECT *, CAST({_fuzzy('name', 'loop')} + prior + tweak AS INTEGER) AS score FROM ents WHERE NOT is_dir AND (mtime%5=0 OR mtime%9<>0)), r AS (SELECT CAST(row_number() OVER (ORDER BY {_ORDER}) AS INTEGER) AS rank, path, score FROM s WHERE score IS NOT NULL) SELECT * FROM r WHERE rank <= 30",
)
_add("f18_dead_excluded", lambda s, d: search.overlaid(views.tree(s, d), views.tree(s, d).where("hidden"), views.tree(s, d).limit(0)).select("path"), f"{_WITH} SELECT path FROM ents WHERE NOT hidden")
_add("j12_overlay_prior", lambda s, d: _overlay(s, d).where("is_extra").select("path", "prior"), f"{_WITH} SELECT path, CAST(prior AS INTEGER) AS prior FROM ents WHERE NOT is_dir AND mtime%5=0")
_CHANGES = "ch AS (SELECT event_id, '/live/u'||CAST(user_id AS VARCHAR)||'/f'||CAST(event_id%50 AS VARCHAR)||'.txt' AS path, CASE WHEN event_type='error' THEN 'delete' ELSE 'upsert' END AS op, CAST(event_id%4096 AS BIGINT) AS size FROM events)"


def _state(spark: SparkSession, sf_dir: str) -> DataFrame:
    changes = views.changes(spark, sf_dir)
    empty = changes.limit(0).select("event_id", "path", "size")
    once = live.apply(empty, changes)
    return live.apply(once, changes)  # a replay changes nothing


_STATE = f"WITH {_CHANGES}, f AS (SELECT path, max(event_id) AS event_id, arg_max(op,event_id) AS op, arg_max(size,event_id) AS size FROM ch GROUP BY path)"
_add("l5_latest_state", _state, f"{_STATE} SELECT event_id, path, size FROM f WHERE op='upsert'")
_add("l2_progress", lambda s, d: views.changes(s, d).agg(F.max("event_id").alias("event_id")), "SELECT max(event_id) AS event_id FROM events")
_add("u4_dirty_folders", lambda s, d: live.dirty_folders(views.changes(s, d)), f"WITH {_CHANGES} SELECT DISTINCT regexp_replace(path,'/[^/]*$','') AS path FROM ch")
_add("u5_wanted_once", lambda s, d: views.changes(s, d).select("path").dropDuplicates(["path"]), f"WITH {_CHANGES} SELECT DISTINCT path FROM ch")


def _trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    changes = views.changes(spark, sf_dir)
    gone = spark.createDataFrame([(1 << 40, "/live/u1", "tree", 0)], "event_id long, path string, op string, size long")
    return live.apply(changes.limit(0).select("event_id", "path", "size"), changes.unionByName(gone)).select("path")


_add("l4_deleted_tree", _trees, f"{_STATE} SELECT path FROM f WHERE op='upsert' AND path NOT LIKE '/live/u1/%'")
_add("l7_ignored", lambda s, d: views.changes(s, d).where(~entries.under(F.col("path"), "/live/u2")).select("event_id"), f"WITH {_CHANGES} SELECT event_id FROM ch WHERE path NOT LIKE '/live/u2/%'")


def _compacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes appended in parts, in any order, with a compaction in between."""
    from .streaming.live import Table

    table, changes = Table(spark, storage.shared_dir(spark, "live")), views.changes(spark, sf_dir)
    for k in (2, 0, 3, 1):
        table.append(changes.where(F.col("event_id") % 4 == k))
        if k == 0:
            table.compact()
    return table.rows().select("event_id", "path", "size")


def _streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log of changes followed as a stream of micro-batches."""
    from .streaming import live as stream

    at = storage.shared_dir(spark, "log")
    views.changes(spark, sf_dir).repartition(4, "event_id").write.json(f"{at}/log")
    table = stream.Table(spark, f"{at}/table")
    query = stream.follow(stream.read_log(spark, f"{at}/log"), table, f"{at}/checkpoint", ["/live/u2"], once=True)
    query.awaitTermination()
    return table.rows().select("event_id", "path", "size")


def _kept_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index of half the files, then brought up to date with files of which some are newer."""
    folder, docs = storage.shared_dir(spark, "upkeep"), views.content(spark, sf_dir)
    postings.sync(spark, folder, docs.where("doc_id % 2 = 0"))
    now = docs.withColumn("mtime", F.when(F.col("doc_id") % 6 == 0, F.col("mtime") + 1).otherwise(F.col("mtime")))
    again = postings.sync(spark, folder, now)
    return postings.open_index(spark, folder)["docs"].select("path", "mtime", F.lit(again).cast("long").alias("indexed"))


_add("l9_compaction", _compacted, f"{_STATE} SELECT event_id, path, size FROM f WHERE op='upsert'")
_add("l3_micro_batches", _streamed, f"{_STATE} SELECT event_id, path, size FROM f WHERE op='upsert' AND path NOT LIKE '/live/u2/%'")
_add(
    "l11_content_upkeep",
    _kept_content,
    f"WITH {_DOCS} SELECT path, CASE WHEN doc_id % 6 = 0 THEN mtime + 1 ELSE mtime END AS mtime, (SELECT count(*) FILTER (doc_id % 2 = 1 OR doc_id % 6 = 0) FROM docs) AS indexed FROM docs",
)
_add(
    "l6_unknown_folder",
    lambda s, d: live.known_folders(views.tree(s, d).where("NOT is_dir").select(F.concat("path", F.lit("/x/y")).alias("path")), views.tree(s, d).where("is_dir")),
    f"{_WITH} SELECT DISTINCT array_to_string(list_slice(string_split(path,'/'),1,len(string_split(path,'/'))-1),'/') AS path FROM ents WHERE NOT is_dir",
)


def _refreshed(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = views.tree(spark, sf_dir)
    dirty = spark.createDataFrame([("/corpus/en/src1",)], "path string")
    trees = spark.createDataFrame([("/corpus/de",)], "path string")
    listed = old.where("path LIKE '/corpus/en/src1/%' OR path LIKE '/corpus/de/%'").where("size % 2 = 0")
    return entries.refresh(old, dirty, trees, listed).select("path")


_add("src5_refresh", _refreshed, f"{_WITH} SELECT path FROM ents WHERE NOT (path LIKE '/corpus/en/src1/%' OR path LIKE '/corpus/de/%') OR size%2=0")
_add("j11_kept_folders", lambda s, d: _refreshed(s, d).where("path LIKE '/corpus/fr/%'"), f"{_WITH} SELECT path FROM ents WHERE path LIKE '/corpus/fr/%'")
_add("src_web_tree", lambda s, d: entries.folders_of(views.web(s, d), "/web").select("path"), "WITH w AS (SELECT '/web/'||regexp_replace(regexp_replace(url,'^https?://',''),'[?#].*$','') AS p FROM pages), v AS (SELECT CASE WHEN p LIKE '%/' THEN p||'index.html' ELSE p END AS path FROM w) SELECT DISTINCT array_to_string(list_slice(string_split(path,'/'),1,i),'/') AS path FROM (SELECT path, unnest(range(3, CAST(len(string_split(path,'/')) AS BIGINT))) AS i FROM v)")


def _status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return live.status(views.tree(spark, sf_dir), symbols.build(views.code(spark, sf_dir)), views.content(spark, sf_dir))


_add("a3_status", _status, f"{_WITH} SELECT count(*) AS entries, CAST(count(*) FILTER (is_dir) AS BIGINT) AS dirs, (SELECT 2*count(*) FROM part) AS symbols, (SELECT count(*) FROM docs) AS content_docs, CAST((SELECT sum(size) FROM docs) AS BIGINT) AS content_bytes, CAST(0 AS INTEGER) AS overlay, CAST(0 AS INTEGER) AS removed FROM ents")
_add("a10_live_content", lambda s, d: views.content(s, d).join(views.content(s, d).where("doc_id % 9 = 0").select("path"), "path", "left_anti").agg(F.count("*").alias("docs"), F.sum("size").alias("bytes")), f"WITH {_DOCS} SELECT count(*) AS docs, CAST(sum(size) AS BIGINT) AS bytes FROM docs WHERE doc_id%9<>0")

# --- symbols

_CODE = "code AS (SELECT '/code/p'||CAST(p_partkey AS VARCHAR)||'.py' AS path, replace(p_name,' ','_') AS fn, replace(p_brand,'#','_') AS ty FROM part), sy AS (SELECT path, fn AS name, 1 AS line, 'fn' AS kind FROM code UNION ALL SELECT path, ty, 3, 'type' FROM code)"
_add("y_extract", lambda s, d: symbols.build(views.code(s, d)), f"WITH {_CODE} SELECT path, name, CAST(line AS INTEGER) AS line, kind FROM sy")
_add("y1_sources", lambda s, d: symbols.sources(views.content(s, d)).select("path", "lang"), f"WITH {_DOCS} SELECT path, 'python' AS lang FROM docs WHERE path LIKE '%.py' AND size <= 1048576 AND NOT (size >= 4096 AND least(size,65536)//(strlen(text[:65536]) - strlen(replace(text[:65536],chr(10),'')) + 1) > 300)")


def _code_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    no = F.lit(False)
    return entries.derive(views.code(spark, sf_dir).select("path", no.alias("is_dir"), no.alias("is_link"), no.alias("hidden"), "size", "mtime"), "/code")


def _symbol_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return symbols.find(symbols.build(views.code(spark, sf_dir)), _code_entries(spark, sf_dir), "sym:BRAND sym:1 p1 ext:py", "/code", NOW, 40)


_add("y5_symbol_search", _symbol_search, f"WITH {_CODE}, h AS (SELECT path, CAST(line AS INTEGER) AS line, name AS symbol, kind FROM sy WHERE contains(lower(name),'brand') AND contains(name,'1') AND contains(split_part(path,'/',-1),'p1')) SELECT *, CAST(row_number() OVER (ORDER BY symbol, split_part(path,'/',-1), path) AS INTEGER) AS rank FROM h QUALIFY rank <= 40")
_add("a4_symbol_total", lambda s, d: symbols.matches(symbols.build(views.code(s, d)), _code_entries(s, d), parse("sym:brand"), "/code", NOW).agg(F.count("*").alias("total")), f"WITH {_CODE} SELECT count(*) AS total FROM sy WHERE contains(lower(name),'brand')")
_add("j5_symbols_in_files", lambda s, d: symbols.matches(symbols.build(views.code(s, d)), _code_entries(s, d), parse("sym:_ re:^p1.*py$"), "/code", NOW).select("path", "name"), f"WITH {_CODE} SELECT path, name FROM sy WHERE contains(name,'_') AND regexp_matches(path,'/p1[^/]*py$')")
_add("w1_first_definition", lambda s, d: symbols.first_definitions(symbols.build(views.code(s, d)).unionByName(symbols.build(views.code(s, d)).withColumn("line", F.col("line") + 5))), f"WITH {_CODE} SELECT path, name, CAST(line AS INTEGER) AS line, kind FROM sy")


def _located(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = views.code(spark, sf_dir)
    hits = symbols.build(code).select("path", "name").unionByName(code.select("path", F.lit("gone").alias("name")))
    return symbols.locate(hits, code)


_add("y6_locate", _located, f"WITH {_CODE} SELECT path, name, CAST(line AS INTEGER) AS line, kind FROM sy UNION ALL SELECT path, 'gone', CAST(0 AS INTEGER), '?' FROM code")


def _symbols_updated(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = views.code(spark, sf_dir)
    known = symbols.fingerprint(code.where("p_partkey % 3 <> 0"))
    held = symbols.build(code.where("p_partkey % 3 <> 0"))
    return symbols.update(held, known, code.where("p_partkey % 5 <> 0"))


_add("y7_incremental", _symbols_updated, f"WITH {_CODE}, p AS (SELECT '/code/p'||CAST(p_partkey AS VARCHAR)||'.py' AS path FROM part WHERE p_partkey%5<>0) SELECT path, name, CAST(line AS INTEGER) AS line, kind FROM sy WHERE path IN (SELECT path FROM p)")
_add("x12_minified", lambda s, d: views.content(s, d).select("doc_id", metadata.minified(F.col("text")).alias("minified")), "WITH h AS (SELECT doc_id, encode(text) AS b FROM documents), c AS (SELECT doc_id, least(octet_length(b),65536) AS n, (octet_length(b) > 65536) AS cut, b FROM h) SELECT doc_id, n >= 4096 AND n//(len(string_split(decode(b), chr(10)))) > 300 AS minified FROM c")

# --- content search


def _grep(pattern: str, mode: str = "literal", query: str = "", limit: int = 1 << 30, per_file: int = 5) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = grep.grep(views.content(spark, sf_dir), pattern, mode, query, NOW, ROOT, limit=limit, per_file=per_file)
        return found.select("path", "ord", F.explode("lines").alias("l")).select("path", "ord", "l.line", "l.text")

    return run


def _grep_sql(doc: str, line: str, limit: int = 1 << 30, per_file: int = 5, where: str = "true") -> str:
    return f"""WITH {_DOCS}, hit AS (SELECT path, text, CASE WHEN contains(path,'/.') THEN -2 ELSE 0 END - CASE WHEN regexp_matches(path,'\\.(jsonl|ndjson|log|lock|sum)$') THEN 1 ELSE 0 END AS rank, mtime FROM docs WHERE ({doc}) AND ({where})),
    o AS (SELECT *, CAST(row_number() OVER (ORDER BY rank DESC, mtime DESC, path) AS INTEGER) AS ord FROM hit QUALIFY ord <= {limit}),
    ln AS (SELECT path, ord, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)),1) AS line FROM o),
    m AS (SELECT path, ord, CAST(line AS INTEGER) AS line, rtrim(l, ' ' || chr(9) || chr(13)) AS l, row_number() OVER (PARTITION BY path ORDER BY line) AS k FROM ln WHERE {line})
    SELECT path, ord, line, CASE WHEN strlen(l) <= 200 THEN l ELSE list_max(list_filter(list_transform(range(1,201), lambda i: substr(l,1,CAST(i AS BIGINT))), lambda s: strlen(s) <= 200)) END AS text FROM m WHERE k <= {per_file}"""


_add("g1_literal_smartcase", _grep("idiot"), _grep_sql("contains(lower(text),'idiot')", "contains(lower(l),'idiot')"))
_add("g1_literal_case", _grep("License"), _grep_sql("contains(text,'License')", "contains(l,'License')"))
_add("g2_regex_multiline", _grep("^the .*and\\.$", "regex"), _grep_sql("regexp_matches(text,'(?im)^the [^\\n]*and\\.$')", "regexp_matches(l,'(?i)^the .*and\\.$')"))
_add("g4_lines", _grep("License|Copyright", "regex", per_file=2), _grep_sql("regexp_matches(text,'License|Copyright')", "regexp_matches(l,'License|Copyright')", per_file=2))
_add("w2_per_file", _grep("the", per_file=3), _grep_sql("contains(lower(text),'the')", "contains(lower(l),'the')", per_file=3))
_add("w3_first_files", _grep("tion", limit=20, per_file=1), _grep_sql("contains(lower(text),'tion')", "contains(lower(l),'tion')", 20, 1))
_add("g6_filters", _grep("er", query="ext:md en size:>1kb", per_file=1), _grep_sql("contains(lower(text),'er')", "contains(lower(l),'er')", per_file=1, where="path LIKE '%.MD' AND size > 1024 AND (contains(lower(path),'/en/') OR regexp_matches(lower(path),'en'))"))
_add("g7_scope", _grep("tion", query="in:/corpus/fr", per_file=1), _grep_sql("contains(lower(text),'tion')", "contains(lower(l),'tion')", per_file=1, where="path LIKE '/corpus/fr/%'"))


_add("a9_counters", lambda s, d: grep.counters(views.content(s, d), grep.Grep("License"), parse("ext:md"), NOW, ROOT), f"WITH {_DOCS} SELECT count(*) AS candidates, count(*) AS read, CAST(count(*) FILTER (contains(text,'License')) AS BIGINT) AS hits, true AS complete FROM docs WHERE path LIKE '%.MD'")
_add("f16_path_filter", lambda s, d: grep.candidates(views.content(s, d), parse("src1 !build type:code"), NOW, ROOT).select("path"), f"WITH {_DOCS} SELECT path FROM docs WHERE contains(path,'src1') AND NOT contains(path,'/build/') AND regexp_matches(path,'\\.(py|html)$')")
_add("g13_ingest", lambda s, d: views.content(s, d).where(metadata.text_file(entries.name_of(F.col("path")), F.col("size")) & ~metadata.looks_binary(F.col("text").cast("binary"))).select("doc_id", metadata.doc_rank(F.col("path")).alias("rank")), f"WITH {_DOCS} SELECT doc_id, CAST(CASE WHEN contains(path,'/.') THEN -2 ELSE 0 END - CASE WHEN regexp_matches(path,'\\.(jsonl|log)$') THEN 1 ELSE 0 END AS INTEGER) AS rank FROM docs WHERE size > 0 AND size <= 1048576 AND NOT contains(text, chr(0))")

# --- the trigram index, on the texts' bytes; in SQL these are two hexadecimal digits each


_BYTES = "hex(encode(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')))"
_DIGIT = "(strpos('0123456789ABCDEF', substr(b, {}, 1)) - 1)"
_NEXT = f"(16 * {_DIGIT.format('2*i+5')} + {_DIGIT.format('2*i+6')}) % 7"
_TRI = f"t AS (SELECT doc_id, {_BYTES} AS b FROM documents), g AS (SELECT doc_id, substr(b, 2*i-1, 6) AS tri, CASE WHEN length(b) >= 2*i+6 THEN CAST(1 << CAST({_NEXT} AS INTEGER) AS INTEGER) ELSE 0 END AS bit FROM (SELECT doc_id, b, unnest(range(1, length(b)//2-1)) AS i FROM t WHERE length(b) >= 6)), post AS (SELECT doc_id, tri, bit_or(bit) AS follow FROM g GROUP BY ALL)"


def _hexed(df: DataFrame) -> DataFrame:
    return df.withColumn("tri", F.hex(F.encode("tri", "ISO-8859-1")))


def _posted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return postings.trigrams(views.content(spark, sf_dir))


_add("a5_doc_trigrams", lambda s, d: _hexed(_posted(s, d)), f"WITH {_TRI} SELECT doc_id, tri, CAST(follow AS INTEGER) AS follow FROM post")
_add("a6_postings_df", lambda s, d: _hexed(_posted(s, d).groupBy("tri").agg(F.count("*").alias("docs"))), f"WITH {_TRI} SELECT tri, count(*) AS docs FROM post GROUP BY tri")


def _planned(pattern: str, mode: str = "literal") -> Query:
    """Documents that the index leaves for a pattern, verified."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        docs = views.content(spark, sf_dir)
        need, follows = postings.literal_plan(pattern) if mode == "literal" else (regex.regex_need(pattern), {})
        left = postings.pruned(docs, postings.trigrams(docs), need, follows)
        return left.where(grep.Grep(pattern, mode).matches(F.col("text"))).select("doc_id")

    return run


_add("g10_literal_pruned", _planned("pathetic"), "SELECT doc_id FROM documents WHERE contains(lower(text),'pathetic')")
_add("g11_regex_pruned", _planned("(idiot|moron)\\w* [a-z]+ing", "regex"), "SELECT doc_id FROM documents WHERE regexp_matches(text,'(?i)(idiot|moron)[0-9a-z_]* [a-z]+ing')")
_add("g8_verified", _planned("the and"), "SELECT doc_id FROM documents WHERE contains(lower(text),'the and')")
_hex = lambda word: word.encode().hex().upper()
_add("u3_and_postings", lambda s, d: postings.candidate_docs(_posted(s, d), regex.both(["lic", "mit"])), f"WITH {_TRI} SELECT doc_id FROM post WHERE tri IN ('{_hex('lic')}','{_hex('mit')}') GROUP BY doc_id HAVING count(*)=2")
_add("u2_or_postings", lambda s, d: postings.candidate_docs(_posted(s, d), regex.either(["lic", "mit"])), f"WITH {_TRI} SELECT DISTINCT doc_id FROM post WHERE tri IN ('{_hex('lic')}','{_hex('mit')}')")
_FOLLOWED = " OR ".join(f"(tri='{_hex('license'[i : i + 3])}'" + (f" AND follow & {1 << (ord('license'[i + 3]) % 7)} <> 0)" if i < 4 else ")") for i in range(5))
_add("j9_postings_intersect", lambda s, d: postings.candidate_docs(_posted(s, d), *postings.literal_plan("License")), f"WITH {_TRI} SELECT doc_id FROM post WHERE {_FOLLOWED} GROUP BY doc_id HAVING count(*)=5")


def _bloomed(literal: str) -> Query:
    """Documents whose filters allow a literal, verified: a filter that lost one would show."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        docs = views.content(spark, sf_dir)
        allowed = postings.blooms(docs).where(postings.may_hold(literal)).select("doc_id")
        return docs.join(allowed, "doc_id", "left_semi").where(grep.Grep(literal).matches(F.col("text"))).select("doc_id")

    return run


_add("x8_bloom_grams", _bloomed("licen"), "SELECT doc_id FROM documents WHERE contains(lower(text),'licen')")
_add("g12_bloom_pruned", _bloomed("pathetic"), "SELECT doc_id FROM documents WHERE contains(lower(text),'pathetic')")


def _segmented(spark: SparkSession, sf_dir: str, merge: bool) -> tuple[str, DataFrame]:
    """An index in three segments, the last of which has newer versions of some files."""
    folder = storage.shared_dir(spark, "index")
    docs = views.content(spark, sf_dir)
    for part in (docs.where("doc_id % 3 = 0"), docs.where("doc_id % 3 = 1"), docs.where("doc_id % 9 = 0").withColumn("size", F.col("size") + 1)):
        postings.add_segment(spark, folder, part)
    if merge:
        postings.merge_segments(spark, folder, [0, 2])
    return folder, docs


def _merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = postings.open_index(spark, _segmented(spark, sf_dir, True)[0])
    return postings.candidates(index, *postings.literal_plan("license"), "license").join(views.content(spark, sf_dir).where(grep.Grep("license").matches(F.col("text"))).select("doc_id"), "doc_id", "left_semi").select("path", "size")


def _covered(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, docs = _segmented(spark, sf_dir, False)
    return postings.coverage(postings.open_index(spark, folder), docs)


_add("g16_segment_merge", _merged, f"WITH {_DOCS} SELECT path, CASE WHEN doc_id % 9 = 0 THEN size + 1 ELSE size END AS size FROM docs WHERE doc_id % 3 <> 2 AND contains(lower(text),'license')")
_add("g17_coverage", _covered, f"WITH {_DOCS} SELECT count(*) FILTER (doc_id%3<>2) AS docs, CAST(sum(CASE WHEN doc_id%9=0 THEN size+1 ELSE size END) FILTER (doc_id%3<>2) AS BIGINT) AS bytes, count(*) FILTER (doc_id%3<>2 AND doc_id%9<>0) AS covered, count(*) FILTER (doc_id%3=2 OR doc_id%9=0) AS missing, CAST(0 AS BIGINT) AS without_bloom, false AS ready FROM docs")


def _engine_grep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grep through a persisted index that lacks a third of the files, which are read anyway."""
    from .engine import Engine

    folder, docs = _segmented(spark, sf_dir, False)
    none = views.tree(spark, sf_dir)
    return Engine(spark, none, docs, none, ROOT, now=NOW, index=folder).grep("License", limit=1 << 30, per_file=1).select("path")


_add("g1_through_index", _engine_grep, f"WITH {_DOCS} SELECT path FROM docs WHERE contains(text,'License')")

# --- symbols of other languages, lookups, fingerprints, exclusions


def _language(ext: str) -> None:
    rows = " UNION ALL ".join(
        f"SELECT path, {' || '.join(['fn' if x == '{fn}' else 'ty' if x == '{ty}' else repr(x) for x in re.split('({fn}|{ty})', name) if x])} AS name, CAST({line} AS INTEGER) AS line, '{kind}' AS kind FROM src"
        for name, line, kind in views.SOURCES[ext][1]
    )
    sql = f"WITH src AS (SELECT '/code/p'||CAST(p_partkey AS VARCHAR)||'.{ext}' AS path, replace(p_name,' ','_') AS fn, replace(p_brand,'#','_') AS ty FROM part) {rows}"
    _add(f"y_extract_{ext}", lambda s, d: symbols.build(views.sources(s, d, ext)), sql)


for _ext in views.SOURCES:
    _language(_ext)

_add("f17_lookup_any_case", lambda s, d: entries.lookup(views.tree(s, d), "/CORPUS/en/SRC1", True).select("path", "is_dir"), f"{_WITH} SELECT path, is_dir FROM ents WHERE lower(path)='/corpus/en/src1'")
_add("f17_children", lambda s, d: entries.children(views.tree(s, d), "/corpus/en").select("path", "is_dir"), f"{_WITH} SELECT path, is_dir FROM ents WHERE array_to_string(list_slice(string_split(path,'/'),1,len(string_split(path,'/'))-1),'/')='/corpus/en'")


def _fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over files and changed versions of some: as many fingerprints as there are different versions."""
    held, wanted = _versions(spark, sf_dir)
    both = symbols.fingerprint(held).select("path", "fingerprint").unionByName(symbols.fingerprint(wanted).select("path", "fingerprint"))
    return both.groupBy("path").agg(F.count("*").alias("rows"), F.count_distinct("fingerprint").alias("versions"))


_add("x7_fingerprints", _fingerprints, f"WITH {_DOCS}, v AS (SELECT path, size FROM docs WHERE doc_id%7<>0 UNION ALL SELECT path, CASE WHEN doc_id%10=0 THEN size+1 ELSE size END FROM docs WHERE doc_id%9<>0) SELECT path, count(*) AS rows, count(DISTINCT size) AS versions FROM v GROUP BY path")
_PLACED = "CASE CAST(length(path) % 4 AS INT) WHEN 0 THEN '/dev' WHEN 1 THEN '/devices' WHEN 2 THEN '/private/var/vm' ELSE '/Users' END || path"
_add("src3_exclusions", lambda s, d: views.tree(s, d).select(F.expr(_PLACED.replace("AS INT)", "AS INT)")).alias("path")).where(~entries.excluded(F.col("path"), "/")), f"{_WITH}, p AS (SELECT {_PLACED} AS path FROM ents) SELECT path FROM p WHERE path NOT LIKE '/dev/%' AND path NOT LIKE '/private/var/vm/%'")

# --- windows, summaries, comparisons


def _preorder(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = views.tree(spark, sf_dir).where("is_dir")
    keyed = df.select("path", F.concat("order_key", entries.order_key(F.array("name"))).alias("key"))
    return numbering.numbered(spark, keyed, [F.col("key")], "pre").select("path", F.col("pre").cast("int").alias("pre"))


_add("w4_preorder", _preorder, f"{_WITH} SELECT path, CAST(row_number() OVER (ORDER BY list_transform(list_append(folders, name), lambda f: '0'||f)) AS INTEGER) AS pre FROM ents WHERE is_dir")


_add("a11_percentiles", lambda s, d: views.content(s, d).agg(F.round(F.percentile("size", F.lit(0.5)), 3).alias("p50"), F.round(F.percentile("size", F.lit(0.9)), 3).alias("p90")), f"WITH {_DOCS} SELECT round(quantile_cont(size, 0.5), 3) AS p50, round(quantile_cont(size, 0.9), 3) AS p90 FROM docs")


def _coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = (views.content(spark, sf_dir).where(grep.Grep(p).matches(F.col("text"))).select("path") for p in ("tion", "idiot"))
    sets = (("both", a.intersect(b)), ("first", a.exceptAll(b)), ("second", b.exceptAll(a)))
    out = None
    for name, df in sets:
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("side"), "n")
        out = one if out is None else out.unionByName(one)
    return out


_add("u6_coverage", _coverage, f"WITH {_DOCS}, m AS (SELECT contains(lower(text),'tion') AS a, contains(lower(text),'idiot') AS b FROM docs) SELECT 'both' AS side, count(*) FILTER (a AND b) AS n FROM m UNION ALL SELECT 'first', count(*) FILTER (a AND NOT b) FROM m UNION ALL SELECT 'second', count(*) FILTER (b AND NOT a) FROM m")


def _content_synced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contents after a sync: only what changed is taken anew."""
    held, wanted = _versions(spark, sf_dir)
    todo = live.sync_diff(held, wanted, ["size", "mtime"])
    kept = held.join(todo.where("action = 'keep'").select("path"), "path", "left_semi").select("path", "size")
    return kept.unionByName(wanted.join(todo.where("action in ('add', 'replace')").select("path"), "path", "left_semi").select("path", "size"))


_add("g14_content_sync", _content_synced, f"WITH {_DOCS} SELECT path, CASE WHEN doc_id%10=0 THEN size+1 ELSE size END AS size FROM docs WHERE doc_id%9<>0")
_add("g15_update_paths", lambda s, d: _sync(s, d).where(entries.under(F.col("path"), "/corpus/fr") & (F.col("action") != "keep")), f"WITH {_DOCS} SELECT path, CASE WHEN doc_id%7=0 THEN 'add' WHEN doc_id%9=0 THEN 'drop' ELSE 'replace' END AS action FROM docs WHERE path LIKE '/corpus/fr/%' AND NOT (doc_id%7=0 AND doc_id%9=0) AND (doc_id%7=0 OR doc_id%9=0 OR doc_id%10=0)")
_add("l12_overlay_scores", lambda s, d: search.score(_overlay(s, d).where("is_extra"), parse("loop"), NOW).select("path", "score"), f"{_WITH}, s AS (SELECT path, CAST({_fuzzy('name', 'loop')} + prior + tweak AS INTEGER) AS score FROM ents WHERE NOT is_dir AND mtime%5=0) SELECT * FROM s WHERE score IS NOT NULL")
_add("snk2_cli_lines", lambda s, d: _cli(s, d), f"WITH {_CODE} SELECT path || ':' || line || ': ' || kind || ' ' || name AS line FROM sy WHERE contains(lower(name),'brand')")


def _cli(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .engine import cli_lines

    found = symbols.find(symbols.build(views.code(spark, sf_dir)), _code_entries(spark, sf_dir), "sym:brand", "/code", NOW, 1 << 30)
    return cli_lines(found, "symbols")

# --- whole orders and all lines


def _all_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = views.tree(spark, sf_dir).select("path", "is_dir", "name")
    return numbering.numbered(spark, df, [F.desc("is_dir"), metadata.is_hex_name(F.col("name")), F.col("name"), F.col("path")], "rank").select("path", "rank")


def _all_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = grep.candidates(views.content(spark, sf_dir), parse(""), NOW, ROOT).select("path", "rank", "mtime")
    return numbering.numbered(spark, found, grep.candidate_order(), "ord").select("path", "rank", "ord")


def _all_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal paths share a place."""
    paths = views.content(spark, sf_dir).groupBy("path").agg(F.count("*").alias("n"))
    placed = numbering.numbered(spark, paths, [F.col("path")], "place")
    return placed.select("path", "place", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("_copy")).drop("_copy")


def _all_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.content(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "l")).select("doc_id", (F.col("i") + 1).alias("n"), metadata.trim_line(F.col("l")).alias("line"))


_add("o7_all_names", _all_names, f"{_WITH} SELECT path, row_number() OVER (ORDER BY is_dir DESC, name, path) AS rank FROM ents")
_add("o5_all_candidates", _all_candidates, f"WITH {_DOCS}, r AS (SELECT path, mtime, CAST(CASE WHEN contains(path,'/.') THEN -2 ELSE 0 END - CASE WHEN regexp_matches(path,'\\.(jsonl|ndjson|log|lock|sum)$') THEN 1 ELSE 0 END AS INTEGER) AS rank FROM docs) SELECT path, rank, row_number() OVER (ORDER BY rank DESC, mtime DESC, path) AS ord FROM r")
_add("w5_all_places", _all_places, f"WITH {_DOCS} SELECT path, dense_rank() OVER (ORDER BY path) AS place FROM docs")
_add("x13_all_lines", _all_lines, "WITH s AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents), f AS (SELECT doc_id, n, rtrim(ls[n], ' '||chr(9)||chr(13)) AS l FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS n FROM s)) SELECT doc_id, n, CASE WHEN strlen(l) <= 200 THEN l ELSE list_max(list_filter(list_transform(range(1,201), lambda i: substr(l,1,CAST(i AS BIGINT))), lambda s: strlen(s) <= 200)) END AS line FROM f")

# --- listings, copies and priors of folders


def _listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folders listed again: of their files some are gone, some grown, some new."""
    held = views.tree(spark, sf_dir)
    folders = held.where("is_dir AND name LIKE 'src%'").select("path")
    now = held.where("NOT is_dir").join(folders.select(F.col("path").alias("parent")), "parent", "left_semi")
    fresh = now.where("mtime % 7 = 0").withColumn("path", F.concat("path", F.lit(".new")))
    now = now.where("mtime % 9 <> 0").withColumn("size", F.when(F.col("mtime") % 5 == 0, F.col("size") + 1).otherwise(F.col("size")))
    return live.listing_diff(held, folders, now.unionByName(fresh))


_add("j8_folder_listings", _listed, f"WITH {_DOCS} SELECT path || '.new' AS path, 'new' AS change FROM docs WHERE mtime%7=0 UNION ALL SELECT path, CASE WHEN mtime%9=0 THEN 'gone' ELSE 'changed' END FROM docs WHERE mtime%9=0 OR mtime%5=0")


def _reread(spark: SparkSession, sf_dir: str) -> DataFrame:
    folders = views.tree(spark, sf_dir).where("is_dir")
    return entries.reread(folders, spark.createDataFrame([("/corpus/en/src1",)], "path string"), spark.createDataFrame([("/corpus/de",)], "path string"))


_add("j11_copied_or_reread", _reread, f"{_WITH} SELECT path, path='/corpus/en/src1' OR path='/corpus/de' OR path LIKE '/corpus/de/%' AS reread FROM ents WHERE is_dir")


def _nearest_priors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files in folders that the index doesn't have take the prior of the nearest one above that it has."""
    df = views.tree(spark, sf_dir)
    paths = df.where("NOT is_dir").select(F.concat("path", F.lit("/x/node_modules/y.txt")).alias("path"))
    paths = paths.unionByName(spark.createDataFrame([("/nowhere/a.txt",)], "path string"))
    return live.nearest(paths, entries.folder_priors(df, ROOT), "prior").select("path", F.coalesce(F.col("prior").cast("int"), F.lit(0)).alias("prior"))


_add("j12_nearest_prior", _nearest_priors, f"{_WITH} SELECT path || '/x/node_modules/y.txt' AS path, CAST(prior AS INTEGER) AS prior FROM ents WHERE NOT is_dir UNION ALL SELECT '/nowhere/a.txt', 0")

# --- masks and hex names

_HELD = "CASE WHEN c BETWEEN 'a' AND 'z' THEN ascii(c)-97 WHEN c BETWEEN '0' AND '9' THEN ascii(c)-22 WHEN c='.' THEN 36 WHEN c='-' OR c='_' THEN 37 WHEN c=' ' THEN 38 WHEN ascii(c)>127 THEN 39 ELSE 40 END"
_add(
    "x4_masks",
    lambda s, d: views.tree(s, d).select("path", metadata.char_mask(F.col("name")).alias("chars"), metadata.start_mask(F.col("name")).alias("starts")),
    f"""{_WITH} SELECT path, list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(string_split(lower(name),''), lambda c: CAST(1 AS BIGINT) << ({_HELD}))), lambda a, b: a | b) AS chars,
    CAST(list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(list_filter(string_split(regexp_replace(lower(name),'^\\.',''),' '), lambda w: w<>''), lambda w: CAST(1 AS BIGINT) << (ascii(w) % 23))), lambda a, b: a | b) AS INTEGER) AS starts FROM ents""",
)


def _hex_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.substring(F.sha1("path"), F.lit(1), F.lit(16) + F.length("path") % 25)
    df = views.content(spark, sf_dir).select("path", metadata.packed_hex(name).alias("packed"))
    return df.select("path", F.octet_length("packed").alias("bytes"), metadata.unpacked_hex(F.col("packed")).alias("name"))


_add("x6_hex_names", _hex_names, f"WITH {_DOCS}, h AS (SELECT path, substr(sha1(path), 1, 16 + length(path) % 25) AS name FROM docs) SELECT path, CAST(1 + (length(name) + 1) // 2 AS INTEGER) AS bytes, name FROM h")

# --- published indexes


def _published(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index published twice: readers see the newer version, whole."""
    folder, df = storage.shared_dir(spark, "index"), views.tree(spark, sf_dir)
    entries.save(df, folder)
    entries.save(df.where("NOT hidden"), folder)
    return entries.load(spark, folder, df.schema).select("path", "size", "prior")


def _built(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols of one build of the index are none of another's."""
    folder = storage.shared_dir(spark, "symbols")
    entries.save(symbols.build(views.code(spark, sf_dir)), folder, "build-1")
    found = [entries.load(spark, folder, symbols.TABLE, b).select(F.lit(b).alias("build"), "path", "name") for b in ("build-1", "build-2")]
    return found[0].unionByName(found[1])


def _overlay_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that came after the index was built are searched at once."""
    code = views.code(spark, sf_dir)
    held = code.where("p_partkey % 2 = 0")
    merged = symbols.update(symbols.build(held), symbols.fingerprint(held), code)
    return symbols.matches(merged, _code_entries(spark, sf_dir), parse("sym:brand"), "/code", NOW).select("path", "name")


_add("src6_published_index", _published, f"{_WITH} SELECT path, size, CAST(prior AS INTEGER) AS prior FROM ents WHERE NOT hidden")
_add("y8_other_build", _built, f"WITH {_CODE} SELECT 'build-1' AS build, path, name FROM sy")
_add("y9_overlay_symbols", _overlay_symbols, f"WITH {_CODE} SELECT path, name FROM sy WHERE contains(lower(name),'brand')")

# --- the query language

_PARSED = ('one  two "a b"', "'exact ^pre suf$ !not", 'x"y z"w !^p', "foo:bar ext:md word", "a/b:c :x")


def _words(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(i, k, t.text, t.mode, t.negate) for i, q in enumerate(_PARSED) for k, t in enumerate(parse(q).tokens)]
    return spark.createDataFrame(rows, "query int, place int, word string, mode string, negated boolean")


_add(
    "q1_words",
    _words,
    """SELECT CAST(query AS INTEGER) AS query, CAST(place AS INTEGER) AS place, word, mode, negated FROM (VALUES (0,0,'one','fuzzy',false), (0,1,'two','fuzzy',false), (0,2,'a b','fuzzy',false),
    (1,0,'exact','exact',false), (1,1,'pre','prefix',false), (1,2,'suf','suffix',false), (1,3,'not','exact',true), (2,0,'xy zw','fuzzy',false), (2,1,'p','prefix',true), (3,0,'foo:bar','fuzzy',false), (3,1,'word','fuzzy',false),
    (4,0,'a','fuzzy',false), (4,1,'b:c','fuzzy',false), (4,2,':x','fuzzy',false)) t(query, place, word, mode, negated)""",
)
_PATTERNS = ("a(", "a+b", "[z-a]", r"\bx\b", "*", "(?P<n>x)", "")


def _problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(i, bool(grep.Grep(p, "regex").problem())) for i, p in enumerate(_PATTERNS)], "pattern int, refused boolean")


_add("g3_refused_patterns", _problems, "SELECT CAST(pattern AS INTEGER) AS pattern, refused FROM (VALUES (0,true), (1,false), (2,true), (3,false), (4,true), (5,false), (6,true)) t(pattern, refused)")
