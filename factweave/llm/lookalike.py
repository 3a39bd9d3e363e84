"""Problem 10: one form for text that looks the same.

A transducer over grapheme clusters reads a text once, takes the longest cluster
that starts at each place and writes its canonical form: full-width and
half-width forms become ordinary ones, base letters with combining accents
become precomposed ones, ligatures are written out, invisible characters vanish,
every kind of space becomes U+0020 and look-alike letters of other scripts
become the Latin ones. Letter case, digits, quotation marks, dashes, the number
of spaces, tabs and line breaks stay.  Joiners that are visible stay as well:
U+200D between emoji, and U+200C/U+200D between letters of a cursive script or
after a sign that joins consonants.

The mapping is a table made once, from the Unicode database by rule and the fixed
look-alike tables below: every character that changes, and every base letter with
one accent.  It is checked for conflicts when it is made: no canonical form may be
changed by the mapping again, no printable ASCII character may change, and
characters fall together only for a reason that is stated (width, accent, ligature,
space, nothing to be seen, look-alike).

Equality is decided by that form.  For reading, look-alike letters are replaced only
in words that mix scripts (``readable``): a word wholly in Cyrillic or Greek is what
it seems to be.
"""

from __future__ import annotations

import functools
import re
import unicodedata

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Letters that are drawn like a Latin letter.
CYRILLIC = dict(zip("АВЕЅІЈКМНОРСТУХԌԚԜҮӀаеѕіјорсухԁһԛԝү", "ABESIJKMHOPCTYXGQWYIaesijopcyxdhqwy"))
GREEK = dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹϳανογιρυϲ", "ABEZHIKMNOPTYXCjavoyipuc"))
ARMENIAN = dict(zip("ՕՍԼօսհոզց", "OULouhnqg"))

#: Cf characters that are drawn.
DRAWN = {*range(0x600, 0x606), 0x6DD, 0x70F, 0x890, 0x891, 0x8E2, 0x110BD, 0x110CD}
#: Drawn as nothing although they are no format characters.
FILLERS = "\u034f\u115f\u1160\u17b4\u17b5\u3164\uffa0"
JOINERS = "\u200c\u200d"
#: Cursive scripts, whose letters U+200C and U+200D part or join.
CURSIVE = r"\p{Arabic}\p{Syriac}\p{Mongolian}\p{Nko}"
#: Text without any of these is its own form.
_ODD = "[^\\x20-\\x7e\\n\\t\\r]"
_LATIN = regex.compile(r"\p{Latin}")
_FOREIGN = regex.compile(r"[\p{Cyrillic}\p{Greek}\p{Armenian}]")
_WORD = regex.compile(r"[\p{L}\p{M}]+")
EMOJI = r"[\p{Extended_Pictographic}\p{Emoji_Modifier}\ufe0f\u20e3]"


def _invisible(c: int) -> bool:
    ch, cat = chr(c), unicodedata.category(chr(c))
    return ch in FILLERS or (cat == "Cf" and c not in DRAWN) or (cat == "Cc" and ch not in "\t\n\r\x0b\x0c\x85") or 0xFE00 <= c <= 0xFE0D or 0x180B <= c <= 0x180D or 0xE0100 <= c <= 0xE01EF


class Transducer:
    def __init__(self) -> None:
        self.single: dict[str, str] = {}
        accented, virama = [], []
        for c in range(0x110000):
            if 0xD800 <= c < 0xE000 or 0x20000 <= c < 0xE0000:
                continue
            ch = chr(c)
            if unicodedata.combining(ch) == 9:
                virama.append(ch)
            if _invisible(c):
                self.single[ch] = ""
                continue
            if unicodedata.category(ch) == "Zs":
                if ch != " ":
                    self.single[ch] = " "
                continue
            d = unicodedata.decomposition(ch)
            roman = 0x2160 <= c < 0x2180 and d.startswith("<compat>")
            letter = d.startswith("<font>") and unicodedata.category(ch)[0] == "L"
            if d.startswith(("<wide>", "<narrow>")) or roman or letter or (d.startswith("<compat>") and "LIGATURE" in unicodedata.name(ch, "")):
                self.single[ch] = unicodedata.normalize("NFKC", ch)
            elif d and d[0] != "<":
                accented.append(ch)
        self.alike = CYRILLIC | GREEK | ARMENIAN
        cls = lambda chars: "".join(f"\\U{ord(c):08x}" for c in sorted(chars))
        gone = cls(c for c, o in self.single.items() if not o)
        special = cls(c for c, o in self.single.items() if o) + cls(self.alike)
        marks = r"\p{M}\uff9e\uff9f"
        # longest first: emoji sequences, joiners that shape letters, clusters with accents, single characters
        self.pattern = regex.compile(
            rf"(?P<keep>{EMOJI}+(?:\u200d{EMOJI}+)+|(?<=[{CURSIVE}])[{JOINERS}](?=[{CURSIVE}])|(?<=[{cls(virama)}])[{JOINERS}](?=\p{{L}}))"
            rf"|[^{marks}{gone}][{marks}{gone}]*[{marks}]|[{special}]|[{gone}]|[^\x00-\x7f]"
        )
        # the transducer has to look only at runs of other than plain characters and the base letter before one
        self.odd = re.compile(r"[\x20-\x7e]?[^\t-\r\x20-\x7e]+")
        #: what each cluster becomes: every character that changes, every base with one accent; longer clusters are added as they come
        self.table = {c: self.cluster(c) for c in [*self.single, *self.alike, *accented]}
        self.table |= {unicodedata.normalize("NFD", c): self.table[c] for c in accented}
        self._check()
        self.runs: dict[str, str] = {}

    def cluster(self, s: str, alike: bool = True) -> str:
        """The canonical form of a cluster, by rule."""
        s = unicodedata.normalize("NFD", "".join(self.single.get(c, c) for c in s))
        return unicodedata.normalize("NFC", "".join(self.alike.get(c, c) for c in s) if alike else s)

    def _one(self, m: regex.Match) -> str:
        s = m[0]
        if m["keep"] is not None:
            return s
        out = self.table.get(s)
        if out is None:
            out = self.cluster(s)
            if len(self.table) < 1 << 17:
                self.table[s] = out
        return out

    def _run(self, m: re.Match) -> str:
        s = m[0]
        out = self.runs.get(s)
        if out is None:
            out = self.pattern.sub(self._one, s)
            if len(s) <= 16 and len(self.runs) < 1 << 17:
                self.runs[s] = out
        return out

    def __call__(self, text: str) -> str:
        return self.odd.sub(self._run, text)

    def readable(self, text: str) -> str:
        """The form for reading: look-alike letters stay in words of one script."""
        mixed = lambda m: self(m[0]) if _FOREIGN.search(m[0]) and _LATIN.search(m[0]) else m[0]
        plain = lambda m: m[0] if m["keep"] is not None else self.cluster(m[0], False)
        text = self.odd.sub(lambda m: self.pattern.sub(plain, m[0]), text)
        return _WORD.sub(mixed, text) if _FOREIGN.search(text) else text

    def _check(self) -> None:
        """Refuse a mapping with conflicts."""
        for s, to in self.table.items():
            if self.cluster(to) != to:
                raise ValueError(f"{s!r} -> {to!r} is mapped again")
        plain = [chr(c) for c in range(0x20, 0x7F)]
        if any(self.cluster(c) != c for c in plain) or len({*map(self.cluster, plain)}) != len(plain):
            raise ValueError("an ASCII character is mapped")
        # what falls together without the look-alike tables must be the same under compatibility, a space or nothing
        for s, to in self.table.items():
            bare = self.cluster(s, False)
            if bare not in ("", " ") and unicodedata.normalize("NFKC", s) != unicodedata.normalize("NFKC", bare):
                raise ValueError(f"{s!r} -> {to!r} has no reason")
            if bare != to and not {*unicodedata.normalize("NFD", bare)} & {*self.alike}:
                raise ValueError(f"{s!r} -> {to!r} has no reason")
        for script in (CYRILLIC, GREEK, ARMENIAN):
            if len({*script.values()}) < len(script) - 3 or any(len(v) != 1 or not v.isascii() for v in script.values()):
                raise ValueError("a look-alike table is ambiguous")


@functools.lru_cache(maxsize=1)
def transducer() -> Transducer:
    return Transducer()


@F.pandas_udf(StringType())
def _canonical(batches: pd.Series) -> pd.Series:
    t = transducer()
    return pd.Series([None if x is None else t(x) for x in batches], dtype=object)


@F.pandas_udf(StringType())
def _readable(batches: pd.Series) -> pd.Series:
    t = transducer()
    return pd.Series([None if x is None else t.readable(x) for x in batches], dtype=object)


def readable(text: Column | str) -> Column:
    """``text`` for reading: as ``canonical``, but a word of one script keeps its letters."""
    c = F.col(text) if isinstance(text, str) else text
    odd = c.rlike(_ODD)
    return F.when(odd, _readable(F.when(odd, c))).otherwise(c)


def canonical(text: Column | str) -> Column:
    """The one form of ``text``; null for null.

    Text of printable ASCII only is its own form, so it never leaves the JVM.
    """
    c = F.col(text) if isinstance(text, str) else text
    odd = c.rlike(_ODD)
    return F.when(odd, _canonical(F.when(odd, c))).otherwise(c)


def with_canonical(df: DataFrame, text: str = "text", out: str = "canonical") -> DataFrame:
    """``df`` with the one form of ``text`` in ``out``; all rows and columns are kept."""
    return df.withColumn(out, canonical(text))


def digest(c: Column) -> Column:
    return F.unhex(F.sha2(c.cast("binary"), 256))


def lookalike_classes(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, form, exact): digests of the one form and of the text itself.

    Rows with a null key or a text without a visible character (null, empty,
    blank, only invisible characters) are left out.
    """
    one = canonical(text)
    d = df.select(F.col(key).alias("key"), F.col(text).alias("text")).where(F.col("key").isNotNull() & F.col("text").isNotNull())
    d = d.select("key", "text", one.alias("one")).where(F.col("one").rlike("(?U)[^\\s]"))
    return d.select("key", digest(F.col("one")).alias("form"), digest(F.col("text")).alias("exact"))


def lookalike_groups(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, form, links): a row for each key with a visible text: the digest of its one
    form, which is its class, and to how many different texts it is linked by it.

    Keys that repeat give a row for each of their texts.
    """
    members = lookalike_classes(df, key, text).distinct()
    size = members.select("form", "exact").distinct().groupBy("form").agg((F.count(F.lit(1)) - 1).alias("links"))
    return members.join(size, "form").select(F.col("key").alias(key), F.hex("form").alias("form"), "links")


def lookalike_pairs(df: DataFrame, scratch, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(a, b), a < b: keys whose texts differ but have the same one form.

    Pairs are formed between the distinct texts of a form and then expanded with
    the keys of each text, so that copies of one text, however many, are never
    compared with each other.  Repeated keys give one pair.
    """
    members = scratch.write(lookalike_classes(df, key, text).distinct())
    texts = members.select("form", "exact").distinct()
    several = texts.groupBy("form").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("form")
    texts = scratch.write(texts.join(several, "form", "left_semi"))
    pairs = texts.alias("x").join(texts.alias("y"), (F.col("x.form") == F.col("y.form")) & (F.col("x.exact") < F.col("y.exact")))
    pairs = pairs.select(F.col("x.exact").alias("ea"), F.col("y.exact").alias("eb"))
    m = members.join(several, "form", "left_semi").select("key", "exact")
    left = pairs.join(m.select(F.col("exact").alias("ea"), F.col("key").alias("ka")), "ea")
    both = left.join(m.select(F.col("exact").alias("eb"), F.col("key").alias("kb")), "eb")
    return both.where("ka <> kb").select(F.least("ka", "kb").alias("a"), F.greatest("ka", "kb").alias("b")).distinct()
