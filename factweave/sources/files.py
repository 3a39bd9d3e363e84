"""Readers: uploaded files, tables in several formats, text as pages (S-1, S-4, S-5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def uploads(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, filename, file_size, sha256, content, problem) of files.

    ``problem`` is null for a PDF, else what is wrong: the name doesn't end in .pdf,
    or the first bytes aren't those of a PDF. Both kinds of rows are kept, so that
    rejects can be reported.
    """
    f = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return check_uploads(f.select("path", F.element_at(F.split("path", "/"), -1).alias("filename"), F.col("length").alias("file_size"), "content"))


def check_uploads(files: DataFrame) -> DataFrame:
    """``files`` (filename, content) with ``sha256`` and ``problem``."""
    name = ~F.coalesce(F.lower("filename").endswith(".pdf"), F.lit(False))
    magic = F.coalesce(F.substring("content", 1, 4) != F.lit(b"%PDF"), F.lit(True))
    return files.withColumn("sha256", F.sha2("content", 256)).withColumn("problem", F.when(name, "not a .pdf name").when(magic, "not a PDF"))


def dispositions(incoming: DataFrame, known: DataFrame, force: bool = False) -> DataFrame:
    """(filename, sha256, id, disposition) of checked uploads: rejected, reused, replaced, new.

    A file whose content is known keeps the known id; with ``force`` it is processed
    again under that id. Of equal files of one delivery the first by name is new, the
    others reuse it. New ids come from the content.
    """
    new_id = F.concat(F.lit("doc-"), F.substring("sha256", 1, 32))
    old = known.select("sha256", F.col("id").alias("known_id")).where("sha256 is not null").groupBy("sha256").agg(F.min("known_id").alias("known_id"))
    first = incoming.where("problem is null").groupBy("sha256").agg(F.min("filename").alias("first"))
    j = incoming.select("filename", "sha256", "problem").join(old, "sha256", "left").join(first, "sha256", "left")
    d = F.when(F.col("problem").isNotNull(), "rejected").when(F.col("known_id").isNotNull(), "replaced" if force else "reused").when(F.col("filename") > F.col("first"), "reused").otherwise("new")
    return j.select("filename", "sha256", F.when(F.col("problem").isNull(), F.coalesce("known_id", new_id)).alias("id"), d.alias("disposition"))


def read(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A table in Parquet, ORC, JSON lines or CSV, told by the ending of its path."""
    kind = path.rstrip("/").rsplit(".", 1)[-1]
    r = spark.read.schema(schema) if schema else spark.read
    if kind == "csv":
        return r.option("header", "true").csv(path)
    return {"parquet": r.parquet, "orc": r.orc, "json": r.json, "jsonl": r.json}[kind](path)


def text_pages(texts: DataFrame, key: str, text: str, break_at: str = "\f") -> DataFrame:
    """(document_id, page_number, raw_text): plain texts as pages, cut at form feeds.

    A null text has one empty page, so that the document isn't lost.
    """
    pages = F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), break_at, -1)).alias("k", "raw_text")
    return texts.select(F.col(key).alias("document_id"), pages).select("document_id", (F.col("k") + 1).alias("page_number"), "raw_text")
