"""Chunks from blocks (K).

The blocks of a document are one array in reading order. Where a chunk ends depends only
on the tokens since it began and on the next heading, so the ends are found by bisection
in running totals; that search, over types and lengths, and the heading paths are the one
step in Python. Texts never leave the JVM: chunks are put together by array functions
from slices of the document's blocks.
"""

from __future__ import annotations

import itertools
import re
from bisect import bisect_left, bisect_right

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factweave.functions.text import strip, token_count

# The name space of chunk ids, and what stands around repeated blocks.
NAMESPACE = "e7b4a2c1-8f3e-4d5a-9b6c-1e2f3a4b5c6d"
MARK, RULE = "[Context from previous section]:", "---"
MIN_TOKENS, MAX_TOKENS, OVERLAP = 800, 2500, 150

CUT = "array<struct<first:int,last:int,before:array<int>,path:array<string>>>"
_NUMBERED = re.compile(r"\d+(?:\.\d+)*")
_TOP = re.compile(r"(?:chapter|part|section)\s+\d", re.I)


def kept_above(heading: str) -> int:
    """How many entries of the path stay above a heading: as many as its number has parts
    but one; none for a chapter, part or section; else the first (K-3)."""
    if m := _NUMBERED.match(heading):
        return m[0].count(".")
    return 0 if _TOP.match(heading) else 1


def paths(headings: list[str]) -> list[list[str]]:
    """The path after each heading."""
    texts = [" ".join(h.split()) for h in headings]
    return list(itertools.accumulate(texts, lambda path, h: [*path[: kept_above(h)], h], initial=[]))[1:]


def ends(tokens: list[int], headings: list[int], least: int, most: int) -> list[int]:
    """Where the chunks of a document end (K-2). A chunk of ``least`` tokens ends before the
    next heading, or before the block that takes it over ``most``, whichever comes first."""
    total, out, at = [0, *itertools.accumulate(tokens)], [], 0
    while at < len(tokens):
        enough = max(at + 1, bisect_left(total, total[at] + least))
        k = bisect_left(headings, enough)
        at = min(len(tokens), headings[k] if k < len(headings) else len(tokens), max(enough, bisect_right(total, total[at] + most) - 1))
        out.append(at)
    return out


def repeated(first: int, last: int, tokens: list[int], is_heading: list[bool], want: int) -> list[int]:
    """The blocks of a chunk that the next one repeats (K-5): the last that is no heading, and
    the one before it if the first alone has fewer than ``want`` tokens."""
    k = next((k for k in range(last - 1, first - 1, -1) if not is_heading[k]), None)
    if k is None or want <= 0:
        return []
    return [k] if tokens[k] >= want or k == first else [k - 1, k]


def cuts(tokens: list[int], headings: dict[int, str], least: int, most: int, overlap: int) -> list[dict]:
    """(first, last, before, path) of each chunk: its blocks from first up to last, those
    repeated before them, and the path in force when it ends. A heading that ends a chunk
    counts already (K-4)."""
    places = sorted(headings)
    after, out, first, before = paths([headings[k] for k in places]), [], 0, []
    is_heading = [k in headings for k in range(len(tokens))]
    for last in ends(tokens, places, least, most):
        n = bisect_right(places, last)
        out.append({"first": first, "last": last, "before": before, "path": after[n - 1] if n else []})
        before, first = repeated(first, last, tokens, is_heading, overlap), last
    return out


def _cuts(least: int, most: int, overlap: int):
    @F.pandas_udf(CUT)
    def run(tokens: pd.Series, types: pd.Series, heads: pd.Series) -> pd.Series:
        return pd.Series([cuts([int(x) for x in n], {k: h for k, (t, h) in enumerate(zip(ts, hs)) if t == "heading"}, least, most, overlap) for n, ts, hs in zip(tokens, types, heads)], dtype=object)

    return run


def uuid5(name: Column, namespace: str = NAMESPACE) -> Column:
    """The name-based UUID (version 5) of a text, built in (K-8)."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), F.encode(name, "utf-8")))
    variant = F.substring(F.lit("89ab"), (F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4 + 1), F.lit(1))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def chunk_id(document: Column, index: Column) -> Column:
    """The same id for the same place of the same document."""
    return uuid5(F.concat(document, F.lit("_chunk_"), index))


def document_blocks(pages: DataFrame, blocks: DataFrame) -> DataFrame:
    """(document_id, blocks, low): the blocks with text of each document in reading order (K-1)
    as structs (page_number, reading_order, block_index, id, block_type, text), and the numbers
    of its pages of low quality."""
    p = pages.where("id is not null and document_id is not null and page_number is not null").select(F.col("id").alias("page_id"), "document_id", "page_number", "is_scanned", "text_quality")
    low = F.coalesce(F.col("is_scanned"), F.lit(False)) | F.coalesce(F.col("text_quality") < 0.5, F.lit(False))
    lows = p.groupBy("document_id").agg(F.collect_set(F.when(low, F.col("page_number"))).alias("low"))
    b = blocks.where("id is not null").select("id", "page_id", "block_index", "block_type", strip(F.col("text")).alias("text"), "reading_order").where("text <> ''")
    b = b.join(p.select("page_id", "document_id", "page_number"), "page_id")
    order = ["page_number", "reading_order", "block_index", "id", "block_type", "text"]
    return b.groupBy("document_id").agg(F.sort_array(F.collect_list(F.struct(*order))).alias("blocks")).join(lows, "document_id")


def chunk_documents(pages: DataFrame, blocks: DataFrame, least: int = MIN_TOKENS, most: int = MAX_TOKENS, overlap: int = OVERLAP) -> DataFrame:
    """The chunks of all documents, from pages and their blocks: id, document_id,
    sequence_index, start_page, end_page, block_ids, heading_path, text, token_count,
    previous_chunk_id, next_chunk_id, has_table, has_low_quality_page, content_hash.

    Blank blocks and blocks without a page are left out; a document without blocks
    has no chunks. Ids are the same on every run.
    """
    field = lambda name: F.transform("blocks", lambda b: b[name])
    d = document_blocks(pages, blocks)
    head = F.transform("blocks", lambda b: F.when(b["block_type"] == "heading", b["text"]))
    d = d.withColumn("cuts", _cuts(least, most, overlap)(F.transform("blocks", lambda b: token_count(b["text"])), field("block_type"), head))
    c = d.select("document_id", "blocks", "low", F.size("cuts").alias("n"), F.posexplode("cuts").alias("sequence_index", "c"))
    c = c.withColumns({"own": F.slice("blocks", F.col("c.first") + 1, F.col("c.last") - F.col("c.first")), "context": F.transform("c.before", lambda k: F.get("blocks", k)), "heading_path": F.col("c.path")}).drop("blocks")
    joined = lambda col: F.array_join(F.transform(col, lambda b: b["text"]), "\n\n")
    context = F.when(F.size("context") > 0, F.concat(F.lit(MARK + "\n"), joined("context"), F.lit("\n" + RULE + "\n\n"))).otherwise("")
    c = c.withColumns({"every": F.concat("context", "own"), "text": F.concat(context, joined("own"))})
    c = c.withColumns({"block_ids": F.transform("every", lambda b: b["id"]), "start_page": F.array_min(F.transform("every", lambda b: b["page_number"])), "end_page": F.array_max(F.transform("every", lambda b: b["page_number"]))})
    digest = F.sha2(F.concat(strip(F.col("text")), F.array_join(F.transform("heading_path", strip), ""), F.array_join("block_ids", "")), 256)
    k = F.col("sequence_index")
    return c.select(
        chunk_id(F.col("document_id"), k).alias("id"), "document_id", "sequence_index", "start_page", "end_page", "block_ids", "heading_path", "text", token_count(F.col("text")).alias("token_count"),
        F.when(k > 0, chunk_id(F.col("document_id"), k - 1)).alias("previous_chunk_id"), F.when(k + 1 < F.col("n"), chunk_id(F.col("document_id"), k + 1)).alias("next_chunk_id"),
        F.exists("every", lambda b: F.coalesce(b["block_type"] == "table", F.lit(False))).alias("has_table"), F.exists("low", lambda p: p.between(F.col("start_page"), F.col("end_page"))).alias("has_low_quality_page"), digest.alias("content_hash"),
    )
