"""Entries, contents, sources and changes derived from the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import entries

NOW, ROOT = 1704067200, "/corpus"

DOC_NAMES = """
SELECT *, CASE CAST(doc_id % 7 AS INT) WHEN 0 THEN '.doc_' WHEN 1 THEN 'Report-' WHEN 2 THEN 'readme_' WHEN 3 THEN 'DocNotes' WHEN 4 THEN 'my file '
  WHEN 5 THEN 'loop' ELSE 'config.' END || CAST(doc_id AS STRING) || '.' || CASE CAST(doc_id % 6 AS INT) WHEN 0 THEN 'txt' WHEN 1 THEN 'MD' WHEN 2 THEN 'log'
  WHEN 3 THEN 'py' WHEN 4 THEN 'html' ELSE 'jsonl' END AS name FROM {documents}"""
DOCS = """
SELECT doc_id, '/corpus/' || lang || '/' || CASE CAST(doc_id % 8 AS INT) WHEN 0 THEN 'node_modules/' WHEN 1 THEN 'build/' WHEN 2 THEN '.cache/'
  WHEN 3 THEN 'Tool.app/' ELSE '' END || source || '/' || name AS path, octet_length(text) AS size, 1704067200 - (doc_id * 791900) % 40000000 AS mtime,
  doc_id % 11 = 0 AS hidden, doc_id % 13 = 0 AS is_link, text, false AS is_dir FROM (""" + DOC_NAMES + ")"


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, path, size, mtime, hidden, is_link, is_dir, text)"""
    return spark.sql(DOCS, documents=spark.read.parquet(f"{sf_dir}/documents.parquet")).withColumn("size", F.col("size").cast("long"))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("path", "is_dir", "is_link", "hidden", "size", "mtime")


def tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Derived entries of the documents and their folders."""
    found = files(spark, sf_dir)
    return entries.derive(found.unionByName(entries.folders_of(found, ROOT)), ROOT)


def content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, path, size, mtime, text)"""
    return docs(spark, sf_dir).select("doc_id", "path", "size", "mtime", "text")


def web(spark: SparkSession, sf_dir: str) -> DataFrame:
    """URL paths as files."""
    bare = F.regexp_replace(F.regexp_replace("url", "^https?://", ""), "[?#].*$", "")
    path = F.concat(F.lit("/web/"), bare)
    path = F.when(path.endswith("/"), F.concat(path, F.lit("index.html"))).otherwise(path)
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return pages.select("page_id", path.alias("path"), F.lit(False).alias("is_dir"), F.lit(False).alias("is_link"), F.lit(False).alias("hidden"), F.octet_length("html").cast("long").alias("size"), F.lit(NOW).cast("long").alias("mtime"))


def code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Generated Python sources with two definitions each."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    text = F.concat(F.lit("def "), F.translate("p_name", " ", "_"), F.lit("(x):\n    return 1\nclass "), F.translate("p_brand", "#", "_"), F.lit(":\n    pass\n"))
    path = F.concat(F.lit("/code/p"), F.col("p_partkey").cast("string"), F.lit(".py"))
    return part.select("p_partkey", path.alias("path"), text.alias("text"), F.octet_length(text).cast("long").alias("size"), F.lit(NOW).cast("long").alias("mtime"))


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, path, op, size)"""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    path = F.concat(F.lit("/live/u"), F.col("user_id").cast("string"), F.lit("/f"), (F.col("event_id") % 50).cast("string"), F.lit(".txt"))
    return events.select("event_id", path.alias("path"), F.when(F.col("event_type") == "error", "delete").otherwise("upsert").alias("op"), (F.col("event_id") % 4096).cast("long").alias("size"))


#: Generated sources by language: what comes before and after the two names, and the symbols as (name, line, kind).
SOURCES = {
    "c": ("#define {ty} 1\nstruct {fn} {{ int x; }};\nstatic int get_{fn}(int a) {{\n  return a;\n}}\n", (("{ty}", 1, "macro"), ("{fn}", 2, "type"), ("get_{fn}", 3, "fn"))),
    "js": ("function {fn}() {{}}\nconst do_{fn} = async (x) => x\nclass {ty} {{ static run() {{ }} }}\n", (("{fn}", 1, "fn"), ("do_{fn}", 2, "fn"), ("{ty}", 3, "type"), ("run", 3, "fn"))),
    "rs": ("fn {fn}() {{ let c: &'a str = \"fn no()\"; }}\nstruct {ty};\nconst K_{fn}: u8 = 1;\n", (("{fn}", 1, "fn"), ("{ty}", 2, "type"), ("K_{fn}", 3, "const"))),
    "go": ("func (r *R) {fn}() {{}}\ntype (\n {ty} struct {{ x int }}\n T_{fn} int\n)\n", (("{fn}", 1, "fn"), ("{ty}", 3, "type"), ("T_{fn}", 4, "type"))),
}


def sources(spark: SparkSession, sf_dir: str, ext: str) -> DataFrame:
    """Generated sources of a language."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    shape = SOURCES[ext][0].replace("{{", "{").replace("}}", "}")
    text = F.replace(F.replace(F.lit(shape), F.lit("{fn}"), F.translate("p_name", " ", "_")), F.lit("{ty}"), F.translate("p_brand", "#", "_"))
    path = F.concat(F.lit("/code/p"), F.col("p_partkey").cast("string"), F.lit(f".{ext}"))
    return part.select(path.alias("path"), text.alias("text"), F.octet_length(text).cast("long").alias("size"), F.lit(NOW).cast("long").alias("mtime"))
