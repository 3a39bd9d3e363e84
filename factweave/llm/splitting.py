"""Problem 1: chunks beyond the token limit as ordered pieces.

A text is cut where a block, heading, paragraph, table row, list entry or
sentence ends, as far as one does within the window of sizes a piece may have.
Among those places the deepest valley of lexical cohesion is taken: words in
blocks of text left and right of a place are compared by cosine, and the depth of
a valley is how far the similarity rises on both sides of it.  Consecutive pieces
overlap by up to ``overlap`` tokens, beginning at such a place where one is there.

Every piece is a stretch of the text; the stretches without their overlaps are
the text.  Only ids, types and lengths of blocks are joined, and only to the
chunks beyond the limit; a text and its blocks lie in one row, as before.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LIMIT, OVERLAP = 800, 100
#: Words on either side of a place that are compared, and the least share of the room a piece uses where it can.
SIDE_WORDS, FILL = 60, 0.5

# levels of places, best last
CHAR, SPACE, LINE, SENTENCE, ENTRY, PARAGRAPH, BLOCK = range(7)
NAMES = ["char", "space", "line", "sentence", "entry", "paragraph", "block"]

_SENTENCE = re.compile(r"[.!?][\"'”’)\]]*\s+|[。！？]\s*")
_BREAK = re.compile(r"\n+")
_ENTRY = re.compile(r"[-*•>]\s|\(?\w{1,3}[.)]\s|-{3,}")
_CELL = re.compile(r"\s\|\s")
_WORD = re.compile(r"[^\W\d_]{2,}|[぀-ヿ一-鿿]")

PIECES = T.ArrayType(
    T.StructType([T.StructField("piece", T.IntegerType()), T.StructField("text", T.StringType()), T.StructField("token_count", T.IntegerType()), T.StructField("start", T.IntegerType()), T.StructField("overlap_chars", T.IntegerType()), T.StructField("cut_at", T.StringType())])
)


def token_count(text: Column) -> Column:
    """Characters / 4 rounded down, at least 1; 0 for an empty or null text."""
    n = F.length(text)
    return F.when(text.isNull() | (n == 0), 0).otherwise(F.greatest(F.lit(1), F.floor(n / 4))).cast("int")


def places(text: str, lengths: list[int]) -> dict[int, int]:
    """Places where the text may be cut, and their level. ``lengths`` are those of
    the blocks the text ends with, joined by blank lines."""
    at: dict[int, int] = {}

    def put(k: int, level: int) -> None:
        if 0 < k < len(text) and at.get(k, -1) < level:
            at[k] = level

    for m in _SENTENCE.finditer(text):
        put(m.end(), SENTENCE)
    left, after = None, 0
    for m in [*_BREAK.finditer(text), None]:
        line = _is_entry(text[after : m.start() if m else len(text)])
        if after:
            put(after, PARAGRAPH if wide else ENTRY if left or line else LINE)
        if m:
            left, after, wide = line, m.end(), m.end() - m.start() > 1
    end = len(text)
    for n in reversed(lengths):
        start = end - n
        if start < 2 or text[start - 2 : start] != "\n\n":
            break
        put(start, BLOCK)
        end = start - 2
    m = re.match(r"\[Context from previous section\]:\n.*?\n---\n\n", text, re.S)
    if m:
        put(m.end(), BLOCK)
    return at


def _is_entry(line: str) -> bool:
    """Whether a line is a row of a table or an entry of a list."""
    return bool(_ENTRY.match(line.lstrip()) or _CELL.search(line))


class _Side:
    """The words on one side of a place, counted, and their product with the other side."""

    def __init__(self) -> None:
        self.count: Counter = Counter()
        self.square = self.words = 0

    def change(self, words: list[str], by: int, other: _Side) -> int:
        """Add or take away words; the change of the product."""
        dot, count = 0, self.count
        for w in words:
            c = count[w]
            self.square += 1 + 2 * by * c
            count[w] = c + by
            dot += by * other.count.get(w, 0)
        self.words += by * len(words)
        return dot


def similarities(bags: list[list[str]]) -> list[float]:
    """Cosine of the words before and after each place between two bags: whole bags, of a
    large one the nearest ``SIDE_WORDS`` words, until a side has that many.

    Each bag enters and leaves each side once, so the work is in proportion to the words.
    """
    near, far = [b[-SIDE_WORDS:] for b in bags], [b[:SIDE_WORDS] for b in bags]
    left, right, dot, a, b, out = _Side(), _Side(), 0, 0, 0, []
    for g in range(1, len(bags)):
        dot += left.change(near[g - 1], 1, right)
        while a < g - 1 and left.words - len(near[a]) >= SIDE_WORDS:
            dot += left.change(near[a], -1, right)
            a += 1
        if b >= g:
            dot += right.change(far[g - 1], -1, left) if g > 1 else 0
        b = max(b, g)
        while b < len(bags) and right.words < SIDE_WORDS:
            dot += right.change(far[b], 1, left)
            b += 1
        norm = math.sqrt(left.square * right.square)
        out.append(dot / norm if norm else 0.0)
    return out


def depths(text: str, gaps: list[int]) -> dict[int, float]:
    """Depth of the cohesion valley at each gap."""
    edges = [0, *gaps, len(text)]
    sims = similarities([_WORD.findall(text[a:b].lower()) for a, b in zip(edges, edges[1:])])

    def climbed(xs: list[float]) -> list[float]:
        """The height reached from each place, going back as long as it doesn't fall."""
        out: list[float] = []
        for k, x in enumerate(xs):
            out.append(out[-1] if k and xs[k - 1] >= x else x)
        return out

    before, behind = climbed(sims), climbed(sims[::-1])[::-1]
    return {gap: (before[i] - sims[i]) + (behind[i] - sims[i]) for i, gap in enumerate(gaps)}


def split_text(text: str, lengths: list[int], limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, str, int, int, int, str]]:
    """Pieces (number, text, tokens, start, characters of overlap, kind of place it ends at).

    The time is in proportion to the text; what is looked at for a cut is a window of
    the size of a piece.
    """
    most, lap = 4 * limit + 3, 4 * overlap + 3
    tokens = lambda n: max(1, n // 4) if n else 0
    if len(text) <= most:
        return [(0, text, tokens(len(text)), 0, 0, "end")]
    at = places(text, lengths)
    natural = sorted(k for k, level in at.items() if level >= SENTENCE)
    deep = depths(text, natural)
    out, s, o = [], 0, 0
    while len(text) - o > most:
        top = o + most
        end = bisect_right(natural, top)
        inner = natural[bisect_left(natural, max(s + 1, s + FILL * (top - s))) : end] or natural[max(bisect_right(natural, s), end - 1) : end]
        if inner:
            cut = max(inner, key=lambda k: (round(deep[k] + 0.02 * at[k], 6), k))
        else:
            cut = next((k for k in range(top, max(s, top - most // 2), -1) if text[k - 1].isspace()), top)
        level = at.get(cut, SPACE if text[cut - 1].isspace() else CHAR)
        out.append((len(out), text[o:cut], tokens(cut - o), o, s - o, NAMES[level]))
        low = max(cut - lap, o + 1)
        k = bisect_left(natural, low)
        begin = natural[k] if k < len(natural) and natural[k] < cut else next((k for k in range(low, cut) if text[k - 1].isspace() and not text[k].isspace()), low)
        s, o = cut, begin if overlap else cut
    out.append((len(out), text[o:], tokens(len(text) - o), o, s - o, "end"))
    return out


def oversized(chunks: DataFrame, blocks: DataFrame, scratch, limit: int = LIMIT) -> DataFrame:
    """Chunks beyond the limit with ``blocks``, the (position, id, length) of their
    blocks; ids that aren't in ``blocks`` and malformed lists give none."""
    big = chunks.where(F.col("id").isNotNull() & (token_count(F.col("text")) > limit))
    listed = F.from_json("block_ids_json", T.ArrayType(T.StringType()))
    ids = scratch.write(big.select("id", F.posexplode(F.coalesce(listed, F.array().cast("array<string>"))).alias("k", "block_id")).distinct())
    sizes = blocks.select(F.col("id").alias("block_id"), F.length("text").alias("n"), "block_type").where("block_id is not null and n is not null")
    has = sizes.join(scratch.hinted(ids), "block_id").groupBy("id").agg(F.sort_array(F.collect_set(F.struct("k", "block_id", "n"))).alias("blocks"))
    return big.select("id", "heading_path_json", "text").join(has, "id", "left")


def _split(limit: int, overlap: int):
    @F.pandas_udf(PIECES)
    def run(text: pd.Series, lengths: pd.Series) -> pd.Series:
        return pd.Series([split_text(t, [] if n is None else [int(x) for x in n], limit, overlap) for t, n in zip(text, lengths)], dtype=object)

    return run


def split_oversized(chunks: DataFrame, blocks: DataFrame, scratch, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """One row for each chunk beyond the limit: (chunk_id, heading_path_json, pieces,
    cut_blocks), ``cut_blocks`` being the ids of blocks beyond the limit themselves,
    which had to be cut inside."""
    big = oversized(chunks, blocks, scratch, limit)
    lengths = F.transform("blocks", lambda b: b["n"])
    inner = F.transform(F.filter("blocks", lambda b: F.floor(b["n"] / 4) > limit), lambda b: b["block_id"])
    return big.select(F.col("id").alias("chunk_id"), "heading_path_json", _split(limit, overlap)("text", lengths).alias("pieces"), F.coalesce(inner, F.array().cast("array<string>")).alias("cut_blocks"))


def found_oversized(chunks: DataFrame, blocks: DataFrame, scratch, limit: int = LIMIT) -> DataFrame:
    """(chunk_id, block_id) of the chunks that were split, and of each of their blocks
    that had to be cut inside, else ''."""
    s = split_oversized(chunks, blocks, scratch, limit).where(F.size("pieces") > 1)
    return s.select("chunk_id", F.explode(F.when(F.size("cut_blocks") > 0, F.col("cut_blocks")).otherwise(F.array(F.lit("")))).alias("block_id")).distinct()


def all_pieces(chunks: DataFrame, blocks: DataFrame, scratch, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """(chunk_id, piece, text, token_count, start, overlap_chars, cut_at,
    heading_path_json) of every chunk; one within the limit is its own piece, also
    where its text is null or empty (0 tokens)."""
    small = chunks.where(F.col("id").isNull() | (token_count(F.col("text")) <= limit))
    small = small.select(F.col("id").alias("chunk_id"), F.lit(0).alias("piece"), "text", token_count(F.col("text")).alias("token_count"), F.lit(0).alias("start"), F.lit(0).alias("overlap_chars"), F.lit("end").alias("cut_at"), "heading_path_json")
    split = split_oversized(chunks, blocks, scratch, limit, overlap)
    return small.unionByName(split.select("chunk_id", "heading_path_json", F.explode("pieces").alias("p")).select("chunk_id", "p.*", "heading_path_json"))
