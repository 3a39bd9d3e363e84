"""Evidence: whether a quote stands in its chunk, and in which blocks (V)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factweave.functions.text import bare, quote_norm, strip
from factweave.session import once

# What is noted of a quote.
NOTE_EMPTY = "Empty source quote provided."
NOTE_FORM = "Source quote verified with minor punctuation or formatting differences."
NOTE_PART = "Partial quote match detected in chunk text; some words differed."
NOTE_NONE = "Source quote does not exist in the source chunk text. Claim rejected."


def _first_long_words(quote: Column) -> Column:
    """The first six words over two letters, or null under four such words."""
    w = F.filter(F.split(quote, " "), lambda x: F.length(x) > 2)
    return F.when(F.size(w) >= 4, F.array_join(F.slice(w, 1, 6), " "))


def verdict(quote: Column, chunk: Column) -> Column:
    """struct(status, note, way) of a quote against a chunk's text (V-5).

    ``way`` is exact, form, part or none. A null or blank quote is rejected, a null
    chunk counts as empty.
    """
    c = quote_norm(F.coalesce(chunk, F.lit("")))
    return verdict_of_forms(quote, c, bare(c))


def quote_forms(quote: Column) -> Column:
    """struct(q, b): the two forms of a quote."""
    q = quote_norm(F.coalesce(quote, F.lit("")))
    return F.struct(q.alias("q"), bare(q).alias("b"))


def verdict_of_forms(quote: Column, c: Column, bc: Column, forms: Column | None = None) -> Column:
    """``verdict`` where the two forms of the chunk's text, and perhaps those of the quote,
    are at hand already."""
    q, bq = (forms["q"], forms["b"]) if forms is not None else (quote_norm(F.coalesce(quote, F.lit(""))), bare(quote_norm(F.coalesce(quote, F.lit("")))))
    make = lambda s, n, w: F.struct(F.lit(s).alias("status"), F.lit(n).alias("note"), F.lit(w).alias("way"))
    part = _first_long_words(bq)
    return (
        F.when(strip(F.coalesce(quote, F.lit(""))) == "", make("rejected", NOTE_EMPTY, "none"))
        .when(F.contains(c, q), make("validated", None, "exact"))
        .when((F.length(bq) >= 8) & F.contains(bc, bq), make("warning", NOTE_FORM, "form"))
        .when(part.isNotNull() & F.contains(bc, part), make("warning", NOTE_PART, "part"))
        .otherwise(make("rejected", NOTE_NONE, "none"))
    )


def attribution(quote: Column, way: Column, blocks: Column, start: Column, end: Column) -> Column:
    """struct(block_ids, start_page, end_page) of a verified quote (V-6, V-7).

    ``blocks`` is the chunk's array of struct(id, norm, bare, page_number) in order, with
    the two forms of each block's text. The first block that holds the whole quote, else the blocks that hold its first or
    last four words, else all blocks with the chunk's pages.
    """
    q = quote_norm(quote)
    words = F.filter(F.split(q, " "), lambda w: w != "")
    n = F.size(words)
    head, tail = F.array_join(F.slice(words, 1, 4), " "), F.array_join(F.slice(words, F.greatest(F.lit(1), n - 3), F.lit(4)), " ")
    whole = F.slice(F.filter(blocks, lambda b: F.contains(b["norm"], q)), 1, 1)
    partly = F.filter(blocks, lambda b: F.contains(b["norm"], head) | F.contains(b["norm"], tail))
    loose = F.slice(F.filter(blocks, lambda b: F.contains(b["bare"], bare(q))), 1, 1)
    hit = F.when(way == "exact", F.when(F.size(whole) > 0, whole).otherwise(partly)).when(way == "form", loose)
    some = F.coalesce(F.size(hit) > 0, F.lit(False))
    page = lambda x: F.transform(x, lambda b: b["page_number"])
    ids = F.when(way == "none", F.array().cast("array<string>")).when(some, F.transform(hit, lambda b: b["id"])).otherwise(F.transform(blocks, lambda b: b["id"]))
    last = F.when(some, F.array_max(page(hit))).when(way == "form", start).otherwise(end)
    return F.struct(ids.alias("block_ids"), F.when(some, F.array_min(page(hit))).otherwise(start).alias("start_page"), last.alias("end_page"))


def chunk_block_texts(chunks: DataFrame, blocks: DataFrame, pages: DataFrame) -> DataFrame:
    """(chunk_id, blocks): each chunk's blocks with the two forms of their text and page, in
    the order of the chunk's list."""
    listed = chunks.select(F.col("id").alias("chunk_id"), F.posexplode(F.from_json("block_ids_json", "array<string>")).alias("k", "block_id"))
    norm = quote_norm(F.col("text"))
    b = blocks.select(F.col("id").alias("block_id"), "page_id", norm.alias("norm"), bare(norm).alias("bare")).join(pages.select(F.col("id").alias("page_id"), "page_number"), "page_id")
    j = listed.join(b, "block_id")
    return j.groupBy("chunk_id").agg(F.sort_array(F.collect_list(F.struct("k", F.col("block_id").alias("id"), "norm", "bare", "page_number"))).alias("blocks"))


def chunk_forms(chunks: DataFrame) -> DataFrame:
    """(chunk_id, norm, bare): the two forms of every chunk's text, made once however many
    facts quote it."""
    c = quote_norm(F.coalesce("text", F.lit("")))
    return chunks.where("id is not null").select(F.col("id").alias("chunk_id"), c.alias("norm"), bare(c).alias("bare"))


def verify_facts(facts: DataFrame, chunks: DataFrame, blocks: DataFrame, pages: DataFrame) -> DataFrame:
    """(fact_id, seq, status, note, way, block_ids, start_page, end_page) of every fact
    whose chunk exists (V-5 to V-8)."""
    c = chunk_forms(chunks).join(chunks.select(F.col("id").alias("chunk_id"), "start_page", "end_page"), "chunk_id").join(chunk_block_texts(chunks, blocks, pages), "chunk_id", "left")
    j = facts.select(F.col("id").alias("fact_id"), "seq", "chunk_id", "source_quote").join(c, "chunk_id")
    none = F.array().cast("array<struct<k:int,id:string,norm:string,bare:string,page_number:int>>")
    j = once(once(j, "f", quote_forms(F.col("source_quote"))), "v", verdict_of_forms(F.col("source_quote"), F.col("norm"), F.col("bare"), F.col("f")))
    j = once(j, "a", attribution(F.coalesce("source_quote", F.lit("")), F.col("v.way"), F.coalesce("blocks", none), F.col("start_page"), F.col("end_page")))
    return j.select("fact_id", "seq", "v.status", "v.note", "v.way", "a.block_ids", F.col("a.start_page").alias("start_page"), F.col("a.end_page").alias("end_page"))


MONEY = r"(\$?\d+(?:\.\d+)?\s*(?:million|billion|M|B)?)\b"


def mock_facts(chunks: DataFrame) -> DataFrame:
    """(chunk_id, k, value_text, value_type, source_quote, subject, predicate, confidence):
    what the offline extractor finds in each chunk (V-2): numbers of two characters or
    more, each with the first line that holds it."""
    lines = F.split("text", "\n", -1)
    m = chunks.select(F.col("id").alias("chunk_id"), lines.alias("lines"), F.posexplode(F.regexp_extract_all("text", F.lit(MONEY), 1)).alias("k", "m"))
    m = m.withColumn("value_text", strip(F.col("m"))).where(F.length("value_text") > 1)
    line = F.get(F.filter("lines", lambda x: F.contains(x, F.col("value_text")) & ~x.startswith("Document Text:")), F.lit(0))
    m = m.withColumn("line", line).where("line is not null")
    return m.select("chunk_id", "k", "value_text", F.when(F.contains(F.col("value_text"), F.lit("$")), "currency").otherwise("number").alias("value_type"), F.substring(strip(F.col("line")), 1, 150).alias("source_quote"), F.lit("Organization").alias("subject"), F.lit("financial_metric").alias("predicate"), F.lit(0.95).alias("confidence"))


def prompt(heading_path: Column, text: Column) -> Column:
    """The text an extraction provider gets for a chunk (V-3)."""
    path = F.array_join(heading_path, " > ")
    head = F.when(F.coalesce(F.size(heading_path), F.lit(0)) > 0, F.concat(F.lit("Section Context: "), path, F.lit("\n\n"))).otherwise("")
    return F.concat(head, F.lit("Document Text:\n```\n"), text, F.lit("\n```\n\nList the explicit facts of the text, each with a verbatim quote."))
