"""Inventories over the driver's tables.

``corpus_inventory`` gives each document a deterministic file name and path
(mixed-case and double extensions, dot files, excluded folders, archive
entries) and uses its UTF-8 text as the file content. ``url_inventory`` does
the same for web pages, named after the last segment of their URL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfs.operators.duplicates import hash_annotate
from tallyfs.sources.table import table_files, table_inventory

# Fixed fixture values: extension of document ``doc_id`` is entry
# ``doc_id % 16`` of this list (mixed case, a double extension, no extension).
CORPUS_EXTENSIONS = ["TXT", "pdf", "jpg", "html", "py", "java", "mp4", "csv",
                     "tar.gz", "", "json", "md", "png", "mp3", "zip", "docx"]
CORPUS_ROOT = "/corpus"


# Fixed schemas of the driver's tables read here: nothing is inferred, and no
# file footer is opened while a query is being planned.
TABLE_SCHEMAS = {
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "pages": "page_id bigint, url string, html string",
    "benchmark": "item_id bigint, text string",
}


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    path = f"{sf_dir.rstrip('/')}/{name}.parquet"
    schema = TABLE_SCHEMAS.get(name)
    return spark.read.schema(schema).parquet(path) if schema else spark.read.parquet(path)


def corpus_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, text, doc_id, source, lang) with the fixture's naming rules,
    stated as SQL expressions in three small steps."""
    exts = ", ".join("'" + e + "'" for e in CORPUS_EXTENSIONS)
    d = read_table(spark, sf_dir, "documents")
    named = d.selectExpr(
        "doc_id", "text", "lang", "source",
        f"element_at(array({exts}), cast(doc_id % 16 as int) + 1) as e",
        "case when doc_id % 10 = 0 then 'node_modules' when doc_id % 10 = 1 then 'Bin' "
        "when doc_id % 10 = 2 then 'wow!' else 'docs' end as dir",
    ).selectExpr(
        "doc_id", "text", "lang", "source", "dir",
        "concat(case when doc_id % 23 = 0 then '.' else '' end, 'doc_', cast(doc_id as string), "
        "case when e = '' then '' else concat('.', e) end) as name",
    )
    return named.selectExpr(
        f"case when doc_id % 7 = 3 then concat('{CORPUS_ROOT}/', source, '/bundle.zip!/', dir, '/', name) "
        f"else concat('{CORPUS_ROOT}/', source, '/', lang, '/', dir, '/', name) end as path",
        "text", "doc_id", "source", "lang",
    )


def corpus_inventory(spark: SparkSession, sf_dir: str, with_folders: bool = True) -> DataFrame:
    """Inventory (with ``content``) of the document corpus below ``/corpus``."""
    return table_inventory(corpus_table(spark, sf_dir), path="path", content="text",
                           root=CORPUS_ROOT, with_folders=with_folders)


def changed_inventories(spark: SparkSession, sf_dir: str, hashed: bool = False) -> tuple[DataFrame, DataFrame]:
    """(before, after): the corpus, and the corpus with documents removed
    (remainder 3 of 11), one byte longer (4 of 13) and renamed (6 of 17); with
    ``hashed`` eligible files have their hashes."""
    rows = corpus_table(spark, sf_dir)
    after = rows.filter("doc_id % 11 != 3").selectExpr(
        "case when doc_id % 17 = 6 then concat(path, '.moved') else path end as path",
        "case when doc_id % 13 = 4 then concat(text, 'x') else text end as text")
    both = [table_files(df, path="path", content="text") for df in (rows, after)]
    return tuple(hash_annotate(inv) if hashed else inv.drop("content") for inv in both)


def url_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File rows for web pages: leaf = last URL path segment (query and
    fragment dropped), content = UTF-8 html."""
    p = read_table(spark, sf_dir, "pages")
    leaf = F.regexp_extract(F.col("url"), r"^[^?#]*/([^/?#]*)", 1)
    return table_files(p.select(F.col("url").alias("path"), leaf.alias("leaf"), "html"),
                       path="path", content="html", name="leaf")
