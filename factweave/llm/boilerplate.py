"""Problem 2: lines that keep turning up across one publisher's documents.

Lines are the nodes of a graph per publisher, weighted by the number of the
publisher's files they stand in; an edge joins two lines that follow each other
(blank lines aside), weighted by the number of files in which they do.  Nodes
and edges with high support stay, connected components of them are the
boilerplate blocks (a line by itself is one, too), and matching occurrences are deleted:
each occurrence of a line with ``MIN_LETTERS`` letters, and a shorter line where it
stands next to another line of its block, since a few letters alone don't tell.

Pages are cut into lines once.  Only digests of lines travel; a line is counted once per
file by a distinct over (publisher, line, file), so that the counting key holds the line
and a publisher with a third of all pages is spread over all tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factweave.llm.components import components

MIN_FILES = 4
MIN_SHARE = 0.3
MIN_LETTERS = 12


_ASCII_ODD = "".join(chr(c) for c in range(128) if not chr(c).isalnum() and chr(c) != "\n")


def _ascii(c: Column) -> Column:
    return F.octet_length(c) == F.length(c)


def line_key(line: Column) -> Column:
    """What two lines must share to be the same: letter case, the amount of white
    space, runs of digits and everything outside the first and last letter or
    digit are ignored. Patterns run only where characters that they concern are there."""
    k = F.lower(line)
    k = F.when(_ascii(k), F.btrim(k, F.lit(_ASCII_ODD))).otherwise(F.regexp_replace(k, r"^[^\p{L}\p{Nd}]+|(?<![^\p{L}\p{Nd}])[^\p{L}\p{Nd}]+$", ""))
    k = F.when(_ascii(k) & (F.translate(k, "0123456789", "") == k), k).otherwise(F.regexp_replace(k, r"\p{Nd}+", "0"))
    plain = _ascii(k) & ~F.contains(k, F.lit("  ")) & (F.translate(k, "\t\x0b\x0c\r", "") == k)
    return F.when(plain, k).otherwise(F.regexp_replace(k, r"(?U)\s+", " "))


def letters(line: Column) -> Column:
    return F.when(_ascii(line), F.length(F.translate(line, _ASCII_ODD + "0123456789", ""))).otherwise(F.length(F.regexp_replace(line, r"\P{L}+", "")))


def _digest(c: Column) -> Column:
    return F.unhex(F.md5(c.cast("binary")))


def node_of(publisher: Column, key: Column) -> Column:
    """The node of a publisher's lines with this key."""
    return _digest(F.concat_ws("\x00", publisher, key))


def page_lines(pages: DataFrame, files: DataFrame) -> DataFrame:
    """(publisher, file, page_id, line_no, rank, node, letters) of the lines that
    have a letter or digit, ``rank`` being the line's place among them on its
    page; pages without a file or publisher have none."""
    p = pages.select(F.col("id").alias("page_id"), F.col("document_id").alias("file"), "raw_text").where("raw_text is not null and page_id is not null")
    f = files.select(F.col("id").alias("file"), "publisher").where("file is not null and publisher is not null").distinct()
    numbered = F.transform(F.split("raw_text", "\n", -1), lambda line, i: F.struct((i + 1).alias("line_no"), line.alias("line")))
    full = F.filter(numbered, lambda x: x["line"].rlike(r"[\p{L}\p{Nd}]"))
    lines = p.join(f, "file").select("publisher", "file", "page_id", F.posexplode(full).alias("rank", "x"))
    lines = lines.select("publisher", "file", "page_id", "x.line_no", "rank", line_key(F.col("x.line")).alias("key"))
    # the key has the letters of the line
    return lines.select("publisher", "file", "page_id", "line_no", "rank", node_of(F.col("publisher"), F.col("key")).alias("node"), letters(F.col("key")).alias("letters"))


def boilerplate(pages: DataFrame, files: DataFrame, scratch, min_files: int = MIN_FILES, min_share: float = MIN_SHARE, min_letters: int = MIN_LETTERS) -> tuple[DataFrame, DataFrame]:
    """Nodes (node, publisher, n_files, letters, block, n_lines) with high support, ``block``
    being the smallest node of their block and ``n_lines`` the lines of the block, and the
    occurrences that match (publisher, page_id, line_no, node, letters, block).

    Support is counted over the files of ``files``; a file listed twice counts
    once, null publishers have no boilerplate.
    """
    lines = scratch.write(page_lines(pages, files))
    total = files.where("publisher is not null and id is not null").groupBy("publisher").agg(F.count_distinct("id").alias("total"))
    support = lines.select("publisher", "node", "file", "letters").distinct().groupBy("publisher", "node").agg(F.count_distinct("file").alias("n_files"), F.max("letters").alias("letters"))
    high = support.where(F.col("n_files") >= min_files).join(total, "publisher").where(F.col("n_files") >= F.col("total") * min_share)
    high = scratch.write(high.select("node", "publisher", "n_files", "letters", "total"))
    found = scratch.write(lines.drop("letters").join(scratch.hinted(high.select("node", "letters"), of=high), "node"))

    after = found.select("page_id", (F.col("rank") - 1).alias("rank"), F.col("node").alias("b"))
    pairs = found.join(after, ["page_id", "rank"]).select("publisher", "file", F.col("node").alias("a"), "b").distinct()
    weight = pairs.groupBy("publisher", "a", "b").agg(F.count(F.lit(1)).alias("w"))
    edges = weight.join(total, "publisher").where((F.col("w") >= min_files) & (F.col("w") >= F.col("total") * min_share)).select("a", "b")
    blocks = components(edges, scratch).select(F.col("vertex").alias("node"), F.col("component").alias("block"))
    nodes = scratch.write(high.join(blocks, "node", "left").select("node", "publisher", "n_files", "letters", F.coalesce("block", "node").alias("block")))
    lines_of = nodes.groupBy("block").agg(F.count(F.lit(1)).alias("n_lines"))
    # a short line goes with its neighbours in the block, so a block of short lines only, or one by itself, names none
    nodes = scratch.write(nodes.join(lines_of, "block").select("node", "publisher", "n_files", "letters", "block", "n_lines"))
    hits = found.join(scratch.hinted(nodes.select("node", "block"), of=nodes), "node")
    near = hits.select("page_id", F.explode(F.array(F.col("rank") - 1, F.col("rank") + 1)).alias("rank"), "block").distinct()
    short = hits.where(F.col("letters") < min_letters).join(near, ["page_id", "rank", "block"], "left_semi")
    out = hits.where(F.col("letters") >= min_letters).unionByName(short)
    return nodes, out.select("publisher", "page_id", "line_no", "node", "letters", "block")


def found_lines(pages: DataFrame, files: DataFrame, scratch, min_letters: int = MIN_LETTERS, **kw) -> DataFrame:
    """(page_id, line_no) of each occurrence of a boilerplate line with at least
    ``min_letters`` letters."""
    _, hits = boilerplate(pages, files, scratch, min_letters=min_letters, **kw)
    return hits.where(F.col("letters") >= min_letters).select("page_id", F.col("line_no").cast("int").alias("line_no")).distinct()


def block_lines(nodes: DataFrame) -> DataFrame:
    """(publisher, block, n_lines, n_files, letters): each line with high support and the
    block it belongs to."""
    return nodes.select("publisher", F.hex("block").alias("block"), F.hex("node").alias("line"), "n_lines", "n_files", "letters")


def without_lines(texts: DataFrame, text: str, publisher: str, nodes: DataFrame, min_letters: int = MIN_LETTERS) -> DataFrame:
    """``texts`` with the column ``text`` free of the boilerplate of its publisher and
    ``removed``, the number of lines deleted.

    A publisher's lines come to its texts as one map. There are at most as many of them
    as a file of the publisher has lines on average, divided by the share of files that a
    line must stand in. Null texts stay null, texts without boilerplate stay as they are.
    """
    own = next(c for c in (f"__own{i}" for i in range(len(texts.columns) + 1)) if c not in texts.columns)
    known = nodes.where((F.col("letters") >= min_letters) | (F.col("n_lines") > 1)).groupBy(F.col("publisher").alias(own + "_p")).agg(F.map_from_entries(F.collect_set(F.struct("node", F.struct("block", (F.col("letters") >= min_letters).alias("long"))))).alias(own))
    out = texts.join(known, F.col(publisher) == F.col(own + "_p"), "left")
    split, table = F.split(F.col(text), "\n", -1), F.col(own)
    keyed = F.filter(F.transform(split, lambda line, i: F.struct(i.alias("i"), line_key(line).alias("k"))), lambda s: s["k"] != "")
    marks = F.transform(keyed, lambda s: F.struct(s["i"].alias("i"), F.try_element_at(table, node_of(F.col(publisher), s["k"])).alias("m")))
    out = out.withColumn(own + "_m", F.when(table.isNotNull(), marks))
    at = lambda j: F.get(own + "_m", j)["m"]["block"]
    hit = F.filter(own + "_m", lambda s, j: F.coalesce(s["m"]["long"] | (s["m"]["block"] == at(j - 1)) | (s["m"]["block"] == at(j + 1)), F.lit(False)))
    out = out.withColumn(own + "_g", F.transform(hit, lambda s: s["i"]))
    gone = F.col(own + "_g")
    kept = F.filter(split, lambda line, i: ~F.array_contains(gone, i))
    some = F.coalesce(F.size(gone) > 0, F.lit(False))
    return out.withColumns({text: F.when(some, F.array_join(kept, "\n")).otherwise(F.col(text)), "removed": F.when(some, F.size(gone)).otherwise(0)}).select(*(c for c in texts.columns if c != "removed"), "removed")
