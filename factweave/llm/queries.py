"""Registry of the queries of this subpackage."""

from __future__ import annotations

from factweave.session import Scratch, table


def p1_found(spark, d):
    """Chunks beyond the token limit and their blocks beyond it."""
    from factweave.llm.splitting import found_oversized

    return found_oversized(table(spark, d, "chunks"), table(spark, d, "blocks"), Scratch(spark, "p1"))


def p1_pieces(spark, d):
    """All chunks as pieces within the token limit."""
    from factweave.llm.splitting import all_pieces

    return all_pieces(table(spark, d, "chunks"), table(spark, d, "blocks"), Scratch(spark, "p1"))


def p2_found(spark, d):
    """Occurrences of lines repeated across a publisher's files."""
    from factweave.llm.boilerplate import found_lines

    return found_lines(table(spark, d, "pages"), table(spark, d, "document_files"), Scratch(spark, "p2"))


def p2_clean(spark, d):
    """Every page and block without the repeated lines of its publisher."""
    from pyspark.sql import functions as F

    from factweave.llm.boilerplate import boilerplate, without_lines

    pages, files = table(spark, d, "pages"), table(spark, d, "document_files")
    nodes, _ = boilerplate(pages, files, Scratch(spark, "p2"))
    owner = files.select(F.col("id").alias("document_id"), "publisher").where("document_id is not null").groupBy("document_id").agg(F.min("publisher").alias("publisher"))
    owned = pages.select("id", "document_id", "raw_text").join(owner, "document_id", "left")
    blocks = table(spark, d, "blocks").select("id", "page_id", "text").join(owned.select(F.col("id").alias("page_id"), "publisher"), "page_id", "left")
    texts = owned.select(F.lit("page").alias("kind"), "id", "publisher", F.col("raw_text").alias("text")).unionByName(blocks.select(F.lit("block").alias("kind"), "id", "publisher", "text"))
    return without_lines(texts, "text", "publisher", nodes).select("kind", "id", "text", "removed")


def p2_blocks(spark, d):
    """The lines repeated across a publisher's files, and the blocks they stand in together."""
    from factweave.llm.boilerplate import block_lines, boilerplate

    return block_lines(boilerplate(table(spark, d, "pages"), table(spark, d, "document_files"), Scratch(spark, "p2"))[0])


def p3_found(spark, d):
    """Broken words, running lines, page numbers and misread words of pages."""
    from factweave.llm.scans import Scan

    return Scan(table(spark, d, "pages"), Scratch(spark, "p3")).found()


def p3_pages(spark, d):
    """Every page as repaired paragraphs."""
    from factweave.llm.scans import Scan

    return Scan(table(spark, d, "pages"), Scratch(spark, "p3"), context=True).repaired()


def p5_found(spark, d):
    """Group of each fact that corroborating relationships link to another."""
    from factweave.llm.components import fact_groups

    return fact_groups(table(spark, d, "relationships"), table(spark, d, "facts"), Scratch(spark, "p5"))


def p6_found(spark, d):
    """Entity that a fact without one names."""
    from factweave.llm.names import found_entities

    return found_entities(table(spark, d, "facts"), table(spark, d, "entities"), Scratch(spark, "p6"))


def p8_ids(spark, d):
    """Token ids of every document."""
    from factweave.llm.tokenize import encode_documents

    return encode_documents(table(spark, d, "documents").select("doc_id", "text"))


def p9_found(spark, d):
    """Documents and evaluation items that share a run of words."""
    from factweave.llm.leakage import shared_runs

    return shared_runs(table(spark, d, "documents"), table(spark, d, "eval_items"), Scratch(spark, "p9"))


def p9_report(spark, d):
    """Leaks of evaluation items, verbatim or paraphrased, with or without the answer."""
    from factweave.llm.leakage import leak_report

    return leak_report(table(spark, d, "documents"), table(spark, d, "eval_items"), Scratch(spark, "p9"))


def p10_found(spark, d):
    """Pairs of documents whose different texts look the same."""
    from factweave.llm.lookalike import lookalike_pairs

    pairs = lookalike_pairs(table(spark, d, "documents"), Scratch(spark, "p10"))
    return pairs.withColumnsRenamed({"a": "doc_id_a", "b": "doc_id_b"})


def p10_classes(spark, d):
    """Class of each document by the one form of its text, and its number of links."""
    from factweave.llm.lookalike import lookalike_groups

    return lookalike_groups(table(spark, d, "documents"))


def p10_texts(spark, d):
    """Every document in one form for reading, and the form by which texts are equal."""
    from factweave.llm.lookalike import canonical, readable

    return table(spark, d, "documents").select("doc_id", readable("text").alias("text"), canonical("text").alias("form"))


def queries():
    return {k: f for k, f in globals().items() if k[:1] == "p" and k[1:2].isdigit()}


def oracle_sql():
    from factweave.llm.oracle import SQL

    return dict(SQL)
