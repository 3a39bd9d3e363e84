"""Problem 8: encoding a corpus with a public byte-level BPE tokenizer.

Short texts are encoded where they lie, one Arrow batch at a time, without any
shuffle.  A text longer than ``segment_chars`` is cut into segments that are
encoded by different tasks and concatenated again as a tree.  A cut is free of
consequences where white space begins after a non-space, because the splitting
pattern of the tokenizer always ends a word there; where a segment holds no such
place (text without spaces) it is cut anywhere, and the join is repaired: growing
windows around the join are encoded anew until the first token of the window is
one of the left half's and the last one is one of the right half's at the same
byte positions.  From there on both halves agree with the encoding of the whole,
since a sequence of tokens is the encoding of its bytes if each neighbouring
pair of tokens is stable, and every pair of the result occurs in an encoding.

Null and empty texts get the empty list.
"""

from __future__ import annotations

import base64
import functools

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factweave.session import Scratch

#: Texts beyond this many characters are encoded by several tasks.
SEGMENT_CHARS = 1 << 18
#: Unsplit words beyond this many bytes are encoded as a tree of halves.
LEAF_BYTES = 1 << 10

IDS = T.ArrayType(T.IntegerType(), False)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


class Encoder:
    """Byte-level BPE over the vocabulary file ``path`` (ranks in base64)."""

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.words = regex.compile(public_tokenizers.PATTERN)
        self.long = regex.compile(r"\S{%d,}|\s{%d,}" % (LEAF_BYTES, LEAF_BYTES))
        self.bpe = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=self.ranks, special_tokens={})
        self.length = {v: len(k) for k, v in self.ranks.items()}

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        if not self.long.search(text):
            return self.bpe.encode_ordinary(text)
        out: list[int] = []
        for m in self.words.finditer(text):
            out += self.word(m[0].encode("utf-8", "surrogatepass"))
        return out

    def word(self, b: bytes) -> list[int]:
        """Ids of one unsplit word: halves first, then the join."""
        if len(b) <= LEAF_BYTES:
            return self.bpe._encode_single_piece(b)
        h = len(b) // 2
        return self.join(b[:h], self.word(b[:h]), b[h:], self.word(b[h:]))

    def join(self, lb: bytes, left: list[int], rb: bytes, right: list[int]) -> list[int]:
        """Ids of the word ``lb + rb`` from the ids of both parts."""
        size, n = self.length, 8
        while True:
            i, j = max(0, len(left) - n), min(len(right), n)
            a = sum(size[t] for t in left[i:])
            z = sum(size[t] for t in right[:j])
            window = self.bpe._encode_single_piece(lb[len(lb) - a :] + rb[:z])
            if (i == 0 or window[0] == left[i]) and (j == len(right) or window[-1] == right[j - 1]):
                return left[:i] + window + right[j:]
            n *= 2

    def join_text(self, lt: str, li: list[int], rt: str, ri: list[int]) -> list[int]:
        """Ids of the text ``lt + rt``, cut at any place, from the ids of both parts.

        Of the words of ``lt`` only the last can end elsewhere in the whole. From
        its start the whole is split on until a word ends where one of ``rt`` ends.
        """
        p = 0
        for m in self.words.finditer(lt):
            p = m.start()
        whole, n = lt[p:] + rt, len(lt) - p
        new, mine, at, theirs = [], iter(self.words.finditer(whole)), 0, iter(self.words.finditer(rt))
        end = n
        while True:
            m = next(mine, None)
            if m is None:
                break
            new.append(m[0])
            at = m.end()
            while end < at:
                end = n + next(theirs).end()
            if end == at:
                break
        tail, head = self.encode(lt[p:]), self.encode(rt[: at - n])
        if len(new) == 1 and at > n:
            middle = self.join(lt[p:].encode(), tail, rt[: at - n].encode(), head)
        else:
            middle = [t for w in new for t in self.word(w.encode())]
        return li[: len(li) - len(tail)] + middle + ri[len(head) :]


@functools.lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def cut_points(text: str, size: int) -> list[tuple[int, int, bool]]:
    """Segments (start, end, hard) of ``text``; ``hard`` if the end isn't a place
    where the splitting pattern always ends a word."""
    out, at, n = [], 0, len(text)
    safe = regex.compile(r"(?<=\S)(?=\s)")
    while n - at > size:
        end, hard = at + size, True
        for m in safe.finditer(text, at + size // 2, at + size):
            if m.start() > at:
                end, hard = m.start(), False
        out.append((at, end, hard))
        at = end
    out.append((at, n, False))
    return out


def concat(enc: Encoder, texts: list[str], ids: list[list[int]], hard: list[bool]) -> list[int]:
    """Ids of the concatenation of neighbouring segments, joined pairwise as a tree."""
    parts = list(zip(texts, ids, hard))
    while len(parts) > 1:
        nxt = []
        for k in range(0, len(parts) - 1, 2):
            (lt, li, lh), (rt, ri, rh) = parts[k], parts[k + 1]
            nxt.append((lt + rt, enc.join_text(lt, li, rt, ri) if lh else li + ri, rh))
        if len(parts) % 2:
            nxt.append(parts[-1])
        parts = nxt
    return parts[0][1]


def encode_documents(df: DataFrame, text: str = "text", out: str = "ids", vocabulary: str | None = None, segment_chars: int = SEGMENT_CHARS, scratch=None) -> DataFrame:
    """``df`` without ``text`` and with ``out``, the list of token ids of ``text``.

    Every row of ``df`` gives one row; null and empty texts give the empty list.
    Other columns are kept as they are, whatever they are called, except one
    called ``out``, which is replaced.  An empty input gives an empty result.

    Whether there is a text beyond ``segment_chars`` is found first, without Python. Such
    rows are written to the shared folder with a number, which names a row even where keys
    repeat or are null; their segments are encoded apart and joined by that number.
    """
    path = vocabulary or default_vocabulary()
    df = df.drop(out) if out in df.columns and out != text else df
    keep = [c for c in df.columns if c != text]
    is_long = F.length(F.col(text)) > segment_chars

    @F.pandas_udf(IDS)
    def ids_of(batches: pd.Series) -> pd.Series:
        enc = encoder(path)
        return pd.Series([enc.encode(t) for t in batches], dtype=object)

    if not df.agg(F.coalesce(F.max(is_long), F.lit(False))).first()[0]:
        return df.select(*keep, ids_of(F.col(text)).alias(out))
    short = df.where(is_long.isNull() | ~is_long).select(*keep, ids_of(F.col(text)).alias(out))
    row = next(c for c in (f"__row{i}" for i in range(len(df.columns) + 1)) if c not in df.columns)
    rows = (scratch or Scratch(df.sparkSession, "p8")).write(df.where(is_long).withColumn(row, F.monotonically_increasing_id()))

    def cut(it):
        for pdf in it:
            for r, t in zip(pdf["row"], pdf["t"]):
                for k, (a, b, h) in enumerate(cut_points(t, segment_chars)):
                    yield pd.DataFrame({"row": [r], "k": [k], "t": [t[a:b]], "h": [h]})

    segments = rows.select(F.col(row).alias("row"), F.col(text).alias("t")).mapInPandas(cut, "row long, k int, t string, h boolean").repartition("row", "k")

    def together(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("k")
        ids = concat(encoder(path), list(pdf.t), [[int(i) for i in x] for x in pdf.ids], list(pdf.h))
        return pd.DataFrame({row: [key[0]], out: [ids]})

    # one group holds the segments of one text, which was one value of one row before
    joined = segments.withColumn("ids", ids_of(F.col("t"))).groupBy("row").applyInPandas(together, T.StructType([T.StructField(row, T.LongType()), T.StructField(out, IDS)]))
    return short.unionByName(rows.select(row, *keep).join(joined, row).select(*keep, out))
