"""Page and block operators: repeated header and footer lines, blocks, tables."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factweave.functions.text import block_type, line_norm, strip

LINES, MIN_RATIO, MIN_PAGES = 3, 0.4, 3


def line_patterns(pages: DataFrame, doc: str = "document_id", text: str = "raw_text", lines: int = LINES, ratio: float = MIN_RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """(doc, position, pattern, occurrences): lines repeated at the top or bottom of the
    pages of a document (T-3).

    A line that stands twice on a page counts twice, and on a short page its lines
    count as top and bottom. Documents under ``min_pages`` pages have no patterns;
    null texts count as empty pages.
    """
    split = F.split(F.coalesce(text, F.lit("")), "\n", -1)
    n = F.size(split)
    edge = lambda name, part: F.transform(part, lambda x: F.struct(F.lit(name).alias("position"), line_norm(x).alias("pattern")))
    both = F.concat(edge("header", F.slice(split, 1, lines)), edge("footer", F.slice(split, F.greatest(F.lit(1), n - lines + 1), F.lit(lines))))
    seen = pages.select(doc, F.explode(F.filter(both, lambda s: F.length(s["pattern"]) > 2)).alias("s")).select(doc, "s.*")
    total = pages.groupBy(doc).agg(F.count(F.lit(1)).alias("n_pages")).where(F.col("n_pages") >= min_pages)
    counts = seen.groupBy(doc, "position", "pattern").agg(F.count(F.lit(1)).alias("occurrences"))
    return counts.join(total, doc).where(F.col("occurrences") >= ratio * F.col("n_pages")).select(doc, "position", "pattern", "occurrences")


def _prefix(lines: Column, patterns: Column, most: int) -> Column:
    """How many of the first ``most`` lines are patterns or blank, up to the first that isn't."""
    flags = F.transform(F.slice(lines, 1, most), lambda x: (line_norm(x) == "") | F.coalesce(F.array_contains(patterns, line_norm(x)), F.lit(False)))
    stop = F.array_position(flags, False)
    return F.when(stop > 0, stop - 1).otherwise(F.size(flags)).cast("int")


def without_patterns(pages: DataFrame, patterns: DataFrame, doc: str = "document_id", text: str = "raw_text", out: str = "cleaned", lines: int = LINES) -> DataFrame:
    """``pages`` with ``out``, the text without the patterns of its document at the top
    and bottom (T-4). Documents without patterns keep their text; null stays null."""
    p = patterns.groupBy(doc).agg(F.collect_set(F.when(F.col("position") == "header", F.col("pattern"))).alias("__h"), F.collect_set(F.when(F.col("position") == "footer", F.col("pattern"))).alias("__f"))
    j = pages.join(p, doc, "left")
    split = F.split(F.col(text), "\n", -1)
    n = F.size(split)
    top = _prefix(split, F.col("__h"), lines)
    rest = F.slice(split, top + 1, F.greatest(F.lit(0), n - top))
    bottom = _prefix(F.reverse(rest), F.col("__f"), lines)
    kept = F.slice(rest, F.lit(1), F.greatest(F.lit(0), F.size(rest) - bottom))
    cleaned = strip(F.array_join(kept, "\n"))
    return j.withColumn(out, F.when(F.col("__h").isNull() & F.col("__f").isNull(), F.col(text)).otherwise(cleaned)).drop("__h", "__f")


def line_blocks(pages: DataFrame, page: str = "id", text: str = "raw_text") -> DataFrame:
    """(page_id, block_index, reading_order, block_type, text, content_hash): the lines of a
    page as blocks, blank ones dropped (S-5, the adapter for text sources)."""
    rank = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n", -1), lambda x, i: F.struct(i.alias("reading_order"), x.alias("text"))), lambda s: strip(s["text"]) != "")
    lines = pages.select(F.col(page).alias("page_id"), F.posexplode(rank).alias("block_index", "s")).select("page_id", "block_index", "s.*")
    return lines.select("page_id", "block_index", "reading_order", block_type(F.col("text")).alias("block_type"), "text", F.substring(F.sha2(F.col("text"), 256), 1, 16).alias("content_hash"))


def table_text(headers: Column, rows: Column) -> Column:
    """A table as text: headers, a rule of 40 dashes, rows, cells joined by `` | `` (S-6)."""
    return F.array_join(F.concat(F.array(F.array_join(headers, " | ", ""), F.repeat(F.lit("-"), 40)), F.transform(rows, lambda r: F.array_join(r, " | ", ""))), "\n")


def parse_table(text: Column) -> Column:
    """struct(headers, rows) of a table's text, null where it isn't one."""
    lines = F.split(text, "\n", -1)
    cells = lambda x: F.split(x, r" \| ")
    ok = (F.size(lines) >= 2) & F.coalesce(F.get(lines, F.lit(1)).rlike("^-{40}$"), F.lit(False))
    return F.when(ok, F.struct(cells(F.get(lines, F.lit(0))).alias("headers"), F.transform(F.slice(lines, F.lit(3), F.greatest(F.lit(0), F.size(lines) - 2)), cells).alias("rows")))


def with_tables(blocks: DataFrame, tables: DataFrame) -> DataFrame:
    """Text blocks and table blocks of pages as one table (S-7): the tables of a page follow its
    texts, block_index counts on and reading_order begins at 1000."""
    from pyspark.sql import Window as W

    count = blocks.groupBy("page_id").agg(F.count(F.lit(1)).cast("int").alias("__n"))
    k = (F.row_number().over(W.partitionBy("page_id").orderBy("block_index", "id")) - 1).cast("int")
    t = tables.withColumn("__k", k).join(count, "page_id", "left").where("page_id is not null")
    t = t.withColumns({"block_index": F.coalesce("__n", F.lit(0)) + F.col("__k"), "reading_order": F.col("__k") + 1000, "block_type": F.lit("table")}).select(*blocks.columns)
    return blocks.where("page_id is not null").unionByName(t)


def table_metadata(table: Column) -> Column:
    """JSON that is kept beside a table's text (S-6): headers, rows and their numbers; null for none."""
    return F.when(table.isNotNull(), F.to_json(F.struct(table["headers"].alias("headers"), table["rows"].alias("rows"), F.size(table["rows"]).alias("row_count"), F.size(table["headers"]).alias("col_count"))))


def with_recognized(pages: DataFrame, provider, image: str = "image", text: str = "cleaned_text") -> DataFrame:
    """Pages whose scanned ones have what ``provider`` recognises of their image at the end of
    ``text`` (S-16); nothing is added where it recognises nothing. Only scanned pages leave the JVM."""
    @F.pandas_udf("string")
    def run(images: pd.Series) -> pd.Series:
        return pd.Series([provider.text(bytes(x)) if x is not None else "" for x in images], dtype=object)

    scanned = F.coalesce(F.col("is_scanned"), F.lit(False))
    seen = pages.withColumn("__seen", F.when(scanned, run(F.when(scanned, F.col(image)))))
    more = F.concat(F.coalesce(text, F.lit("")), F.lit("\n[OCR fallback]:\n"), F.col("__seen"))
    return seen.withColumn(text, F.when(F.coalesce(F.col("__seen") != "", F.lit(False)), more).otherwise(F.col(text))).drop("__seen")
