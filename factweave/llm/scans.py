"""Problem 3: text of scanned pages as continuous readable paragraphs.

* Running lines and page numbers are found among the outer lines of a page;
  running lines recur on at least three pages of their file.
* A word broken at a line end is told from one with a hyphen of its own by the
  corpus frequency of the joined and of the hyphenated word.
* Misread words: the corpus gives a frequency lexicon; a symmetric-delete index
  (both sides with up to two characters left out) finds the frequent words near a
  rare one, a weighted edit distance in which pairs of confused glyphs are cheap
  decides, and the word before picks among several repairs.

Pages are read once, into a table of lines, and lines are cut into words once, into
a table of words with what tells names from ordinary words.  The lexicon, the index
and the repairs are tables over distinct words, which grow far slower than the text;
occurrences are only counted with partial aggregates and looked up.
"""

from __future__ import annotations

import functools
import itertools
import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

# What is printed, and what recognition makes of it.
CONFUSIONS = {
    ("o", "0"), ("l", "1"), ("i", "1"), ("s", "5"), ("g", "9"), ("b", "6"), ("z", "2"), ("b", "8"), ("a", "@"), ("s", "$"), ("l", "|"), ("i", "|"), ("i", "!"), ("l", "!"),
    ("e", "c"), ("c", "e"), ("i", "l"), ("l", "i"), ("t", "f"), ("f", "t"), ("h", "b"), ("b", "h"), ("u", "ii"), ("n", "ii"), ("u", "li"), ("h", "li"), ("m", "rn"), ("rn", "m"), ("in", "m"), ("m", "in"), ("ni", "m"), ("nn", "m"),
    ("d", "cl"), ("cl", "d"), ("w", "vv"), ("u", "v"), ("v", "u"), ("n", "u"), ("u", "n"), ("n", "ri"), ("r", "n"), ("a", "o"), ("o", "a"), ("q", "g"), ("g", "q"), ("e", "o"), ("o", "e"),
}
#: Cost of a confused pair, of any other edit, and the most a repair may cost.
CONFUSED, EDIT, MOST = 0.3, 1.0, 0.35
#: A longer word may hold two misread characters.
LONG, MOST_LONG = 9, 0.65
#: A printed word occurs at least so often, and so many times as often as its misreading.
MIN_COUNT, RATIO = 8, 8.0
#: Beyond this length a word is found by pieces of ``PIECE`` characters, of which two misread places leave one whole.
LONG_KEYS, PIECE = 32, 6
EDGE, MIN_PAGES = 3, 3

HYPHENS = ("-", "\u2010", "\u00ad", "\u00ac")
WHITE = " \t\x0b\x0c\r\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
# one class without alternatives, which Java would match by recursion on a very long word
WORD = r"[\p{L}\p{Nd}][\p{L}\p{Nd}|!@$'’]*"
#: What stands before the first word of a sentence or cell.
OPENERS = '.!?:;|>*)(“"'
PAGE_NO = r"(?i)^(?:(?:page|p\.|pg\.?|seite|pagina|página|стр\.)\s*)?[\[(–-]*\s*(\d{1,6})\s*(?:(?:/|of|von|de|sur)\s*\d{1,6}\s*)?[\])–-]*$"


def _broken(line: Column) -> Column:
    """Whether a line ends in a hyphen after a letter or digit."""
    hyphen = functools.reduce(lambda x, y: x | y, (F.endswith(line, F.lit(h)) for h in HYPHENS))
    return F.coalesce(hyphen & F.right(line, F.lit(2)).rlike(r"^[\p{L}\p{Nd}]"), F.lit(False))


def line_table(pages: DataFrame) -> DataFrame:
    """(page_id, file, page_number, line_no, line, broken, after, cont, outer) of the lines
    that aren't blank, of pages with text.

    Lines have no white space at the end (a carriage return is such).  ``broken`` and
    ``cont`` tell whether the line and the one before end in a hyphen after a letter or
    digit, ``after`` is the next line where this one is broken, ``outer`` tells whether it
    is among the first or last three that aren't blank.
    """
    lines = F.transform(F.split("raw_text", "\n", -1), lambda x: F.rtrim(x, F.lit(WHITE)))
    p = pages.where("id is not null and raw_text is not null").select(F.col("id").alias("page_id"), F.col("document_id").alias("file"), "page_number", lines.alias("lines"))
    full = F.filter(F.transform("lines", lambda x, i: F.when(x != "", i)), lambda i: i.isNotNull())
    p = p.withColumn("full", full)
    edge = F.concat(F.slice("full", 1, EDGE), F.slice("full", F.greatest(F.lit(1), F.size("full") - EDGE + 1), F.lit(EDGE)))
    p = p.withColumns({"edge": edge, "broken": F.transform("lines", _broken)})
    each = F.transform("full", lambda i: F.struct((i + 1).alias("line_no"), F.get("lines", i).alias("line"), F.get("broken", i).alias("broken"), F.when(F.get("broken", i), F.coalesce(F.get("lines", i + 1), F.lit(""))).alias("after"), F.coalesce(F.get("broken", i - 1), F.lit(False)).alias("cont"), F.array_contains("edge", i).alias("outer")))
    return p.select("page_id", "file", "page_number", F.explode(each).alias("s")).select("page_id", "file", "page_number", "s.*")


def outer_lines(lines: DataFrame) -> DataFrame:
    """(page_id, file, page_number, line_no, line, page_no) of the outer lines;
    ``page_no`` tells whether the line is nothing but the page's number."""
    o = lines.where("outer").select("page_id", "file", "page_number", "line_no", "line")
    bare = F.regexp_extract(F.trim("line"), PAGE_NO, 1)
    is_no = (bare != "") & ((bare.try_cast("int") == F.col("page_number")) | (F.col("page_number").isNull() & F.trim("line").rlike(r"(?i)[a-z\[/-]")))
    return o.withColumn("page_no", F.coalesce(is_no, F.lit(False)))


def _without_number(line: Column, page: Column) -> Column:
    """A line in lower case without white space and without a page number at either end."""
    k = F.lower(F.regexp_replace(line, r"(?U)\s+", " "))
    k = F.regexp_replace(k, r"(?:^| )(?:page|p\.|pg\.?|seite) ?\d{1,6}(?: ?(?:/|of|von) ?\d{1,6})?(?= |$)", " ")
    p = F.coalesce(page.cast("string"), F.lit("x"))
    last, first = r"(?:^|(?<= ))[\[(-]? ?(\d{1,6}) ?(?:(?:/|of|von) ?\d{1,6})? ?[\])-]?$", r"^[\[(-]? ?(\d{1,6}) ?[\])-]? "
    k = F.when(F.regexp_extract(k, last, 1) == p, F.regexp_replace(k, last, " ")).otherwise(k)
    k = F.when(F.regexp_extract(k, first, 1) == p, F.regexp_replace(k, first, " ")).otherwise(k)
    return F.regexp_replace(k, r"(?U)\s+", "")


def running_lines(outer: DataFrame, min_pages: int = MIN_PAGES) -> DataFrame:
    """(page_id, line_no) of outer lines with letters that recur on ``min_pages`` pages of a file."""
    o = outer.where(~F.col("page_no") & F.col("line").rlike(r"\p{L}") & F.col("file").isNotNull())
    o = o.withColumn("key", F.xxhash64(_without_number(F.col("line"), F.col("page_number")), F.lit(1)))
    o = o.withColumn("key2", F.xxhash64(_without_number(F.col("line"), F.col("page_number")), F.lit(2))).select("page_id", "line_no", "file", "key", "key2")
    often = o.select("file", "key", "key2", "page_id").distinct().groupBy("file", "key", "key2").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_pages)
    return o.join(often, ["file", "key", "key2"], "left_semi").select("page_id", "line_no")


def tokens(lines: DataFrame, context: bool = False) -> DataFrame:
    """(page_id, line_no, word, plain, capital) of whole words, with ``context`` also
    ``prev``, the word before on the line, where no sentence starts between.

    ``plain`` tells that a word is no name: it has no capital, or one at the start of a
    sentence or line only.  Parts of words that a line end breaks are no words; numbers
    are left out.
    """
    # from behind, so that a very long word or gap costs no more than its length
    cut = F.when(F.col("broken"), F.reverse(F.regexp_replace(F.reverse("line"), r"^\S+", ""))).otherwise(F.col("line"))
    cut = F.when(F.col("cont"), F.regexp_replace(cut, r"^\s*\S+", "")).otherwise(cut)
    # arrays are only cut and shifted; all work on words is done by scalar expressions after the explode
    raw = F.regexp_extract_all(cut, F.lit(rf"(?:[{OPENERS}]\s*)?" + WORD), F.lit(0))
    t = lines.select("page_id", "line_no", raw.alias("ws"))
    word = lambda c: F.rtrim(F.ltrim(c, F.lit(OPENERS + " \t\u00a0")), F.lit("|!@$'’"))
    if context:
        before = F.concat(F.array(F.lit(None).cast("string")), F.slice("ws", F.lit(1), F.greatest(F.lit(0), F.size("ws") - 1)))
        t = t.select("page_id", "line_no", F.posexplode(F.arrays_zip(before.alias("p"), F.col("ws").alias("w"))).alias("k", "x")).select("page_id", "line_no", "k", F.col("x.p").alias("p"), F.col("x.w").alias("w"))
    else:
        t = t.select("page_id", "line_no", F.posexplode("ws").alias("k", "w"))
    opened = F.instr(F.lit(OPENERS), F.left("w", F.lit(1))) > 0
    t = t.withColumns({"word": word(F.col("w")), "start": (F.col("k") == 0) | opened}).where(F.translate("word", "0123456789", "") != "")
    t = t.withColumns({"low": F.lower("word"), "rest": F.substring("word", 2, 1 << 30)})
    capital = F.left("word", F.lit(1)) != F.left("low", F.lit(1))
    plain = (F.col("word") == F.col("low")) | (F.col("start") & capital & (F.col("rest") == F.lower("rest")) & F.col("rest").rlike(r"\p{Ll}[^\p{Ll}]*\p{Ll}"))
    more = [F.when(~opened, F.lower(word(F.col("p")))).alias("prev")] if context else []
    return t.select("page_id", "line_no", "word", plain.alias("plain"), capital.alias("capital"), *more)


def lexicon(tok: DataFrame) -> DataFrame:
    """(word, n, small, caps): how often a word stands as an ordinary word, in small
    letters only, and with a capital inside a sentence."""
    return tok.groupBy(F.lower("word").alias("word")).agg(F.count_if("plain").alias("n"), F.count_if(F.col("plain") & ~F.col("capital")).alias("small"), F.count_if(~F.col("plain") & F.col("capital")).alias("caps"))


#: What each printed letter or pair can be seen as.
SEEN_AS: dict[str, list[str]] = {}
for _a, _b in sorted(CONFUSIONS):
    SEEN_AS.setdefault(_a, []).append(_b)


def distance(printed: str, seen: str, most: int = 2) -> float:
    """Weighted edits that turn ``printed`` into ``seen``: confused pairs, at most ``most``;
    any other edit costs ``EDIT`` or more, which is beyond every repair, and gives ``EDIT``.

    The two sides of a pair begin with different characters, so a pair can only stand
    where the words differ: the alignment is forced up to there.
    """

    def walk(i: int, j: int, left: int) -> int:
        while i < len(printed) and j < len(seen) and printed[i] == seen[j]:
            i, j = i + 1, j + 1
        if i == len(printed) and j == len(seen):
            return 0
        if not left:
            return 99
        tries = [walk(i + n, j + len(b), left - 1) for n in (1, 2) for b in SEEN_AS.get(printed[i : i + n], ()) if i + n <= len(printed) and seen.startswith(b, j)]
        return min(tries, default=98) + 1

    n = walk(0, 0, most)
    return CONFUSED * n if n <= most else EDIT


def variants(word: str) -> set[str]:
    """The word with one confusion of two characters with one."""
    return {word[:i] + b + word[i + n :] for n in (1, 2) for i in range(len(word) - n + 1) for b in SEEN_AS.get(word[i : i + n], ()) if n + len(b) > 2}


def left_out(word: str, n: int) -> set[str]:
    """The word with ``n`` characters left out."""
    return {"".join(c for k, c in enumerate(word) if k not in gone) for gone in itertools.combinations(range(len(word)), n)}


#: How many characters are left out of the printed and of the seen word.
MEET = ((1, 1), (1, 2), (2, 1))


def keys(word: str, printed: bool) -> set[str]:
    """Keys under which a printed word and what it is seen as meet: both with one or two
    characters left out, as one confusion takes; of long words both with two, also after a
    confusion that changes the length.  Very long words meet by a piece that is whole in both."""
    if len(word) > LONG_KEYS:
        step = PIECE if printed else 1
        out = {"=" + word[i : i + PIECE] for i in range(0, len(word) - PIECE + 1, step)}
        if len(word) > LONG_KEYS + 2:
            return out
    else:
        out = set()
    for p, q in MEET:
        out |= {f"{p}{q}{x}" for x in left_out(word, p if printed else q)}
    if printed and len(word) >= LONG:
        out |= {"22" + x for x in left_out(word, 2)}
        for v in variants(word):
            out |= {f"v{p}{q}{x}" for p, q in MEET for x in left_out(v, p)}
    elif not printed and len(word) >= LONG - 2:
        out |= {"22" + x for x in left_out(word, 2)} | {f"v{p}{q}{x}" for p, q in MEET for x in left_out(word, q)}
    return out


def _keys(printed: bool):
    def run(it):
        for pdf in it:
            yield pdf.assign(key=[sorted(keys(w, printed)) for w in pdf.word]).explode("key").dropna(subset=["key"])

    return run


@F.pandas_udf(DoubleType())
def _cost(printed: pd.Series, seen: pd.Series) -> pd.Series:
    return pd.Series([distance(x, y, 2 if len(x) >= LONG else 1) for x, y in zip(printed, seen)], dtype=float)


def repairs(lex: DataFrame, scratch) -> DataFrame:
    """(seen, printed, cost, n): what a rare word can be a misreading of."""
    lex = lex.where(F.length("word") >= 3)
    common = lex.where(((F.col("small") >= MIN_COUNT) | ((F.col("n") >= MIN_COUNT) & (F.col("caps") <= 0.1 * F.col("n")))) & F.col("word").rlike(r"^[\p{L}'’]+$")).select("word", "n")
    rare = lex.where((F.col("n") > 0) & F.col("word").rlike(r"^[\p{L}\p{Nd}|!@$'’]+$") & F.col("word").rlike(r"\p{L}") & (F.length(F.regexp_replace("word", r"[^\p{Nd}]", "")) <= 2)).select("word", "n")
    # distinct words are few bytes and much work
    spread = lambda d: d.repartition(max(8, d.sparkSession.sparkContext.defaultParallelism), "word")
    a = spread(common).mapInPandas(_keys(True), "word string, n long, key string").withColumnsRenamed({"word": "printed", "n": "n"})
    b = spread(rare).mapInPandas(_keys(False), "word string, n long, key string").withColumnsRenamed({"word": "seen", "n": "m"})
    near = a.join(b, "key").where((F.col("printed") != F.col("seen")) & (F.col("n") >= RATIO * F.col("m"))).select("seen", "printed", "n").distinct()
    scored = scratch.write(near.withColumn("cost", _cost("printed", "seen")).where(F.col("cost") <= F.when(F.length("printed") >= LONG, MOST_LONG).otherwise(MOST)))
    best = scored.groupBy("seen").agg(F.min("cost").alias("low"))
    return scratch.write(scored.join(best, "seen").where(F.col("cost") <= F.col("low") + 1e-9).select("seen", "printed", "cost", "n"))


def pick(tok: DataFrame, fixes: DataFrame, scratch) -> DataFrame:
    """(prev, seen, printed): the repair of a misread word after each word before it.

    Among repairs of equal cost the one that the corpus has most often after
    ``prev`` comes first, then the more frequent word.
    """
    tok = tok.select(F.lower("word").alias("lower"), "prev")
    places = tok.join(scratch.hinted(fixes.select(F.col("seen").alias("lower")).distinct(), of=fixes), "lower", "left_semi").select("prev", F.col("lower").alias("seen")).distinct()
    tried = places.join(fixes, "seen")
    pairs = tok.where("prev is not null").join(scratch.hinted(fixes.select(F.col("printed").alias("lower")).distinct(), of=fixes), "lower", "left_semi").groupBy("prev", F.col("lower").alias("printed")).agg(F.count(F.lit(1)).alias("k"))
    scored = tried.join(pairs, ["prev", "printed"], "left")
    return scored.groupBy("prev", "seen").agg(F.max(F.struct(F.coalesce("k", F.lit(0)), "n", "printed")).alias("b")).select("prev", "seen", F.col("b.printed").alias("printed"))


def broken_words(lines: DataFrame, lex: DataFrame, fixes: DataFrame) -> DataFrame:
    """(page_id, line_no) of lines that end inside a word without a hyphen of its own there."""
    ends = F.reverse(F.regexp_extract(F.reverse("line"), r"^[^\p{L}]([\p{L}'\u2019]+)", 1))
    p = lines.where("broken").select("page_id", "line_no", ends.alias("a"), F.right("line", F.lit(1)).alias("h"), F.regexp_extract("after", r"^\s*([\p{L}'\u2019]+)", 1).alias("b")).where("a <> '' and b <> ''")
    p = p.where(F.col("b").rlike(r"^\p{Ll}") | F.col("a").rlike(r"^\p{Lu}{2,}$")).withColumns({"a": F.lower("a"), "b": F.lower("b")})
    soft = p.where(F.col("h").isin("\u00ad", "\u00ac")).select("page_id", "line_no")
    hard = p.where(~F.col("h").isin("\u00ad", "\u00ac"))
    kinds = hard.select("a", "b").distinct()
    # hyphenated words inside lines
    compound = F.lit(r"(?<![\p{L}-])(\p{L}+[-\u2010]\p{L}+)(?![\p{L}-])")
    hyphened = F.contains("line", F.lit("-")) | F.contains("line", F.lit("\u2010"))
    inside = lines.where(hyphened).select(F.explode(F.regexp_extract_all(F.lower("line"), compound, 1)).alias("c"))
    own = inside.groupBy(F.translate("c", "\u2010", "-").alias("c")).agg(F.count(F.lit(1)).alias("own"))
    fixed = fixes.groupBy("seen").agg(F.max_by("printed", "n").alias("printed"))
    right = lambda df, c: df.join(fixed.select(F.col("seen").alias(c), F.col("printed").alias("_p")), c, "left").withColumn(c + "_r", F.coalesce("_p", c)).drop("_p")
    k = right(right(right(kinds.withColumn("ab", F.concat("a", "b")), "a"), "b"), "ab").withColumn("c", F.concat_ws("-", "a_r", "b_r"))
    words = lex.select("word", "n")
    k = k.join(own, "c", "left").join(words.select(F.col("word").alias("ab_r"), F.col("n").alias("joined")), "ab_r", "left")
    k = k.join(words.select(F.col("word").alias("a_r"), F.col("n").alias("na")), "a_r", "left").join(words.select(F.col("word").alias("b_r"), F.col("n").alias("nb")), "b_r", "left")
    k = k.fillna(0, ["own", "joined", "na", "nb"])
    two = (F.col("na") >= MIN_COUNT) & (F.col("nb") >= MIN_COUNT)
    split = F.when((F.col("own") > 0) | (F.col("joined") > 0), F.col("joined") > F.col("own")).otherwise(~two)
    return soft.unionByName(hard.join(k.where(split).select("a", "b"), ["a", "b"], "left_semi").select("page_id", "line_no"))


class Scan:
    """The findings of a table of pages, shared by the queries."""

    def __init__(self, pages: DataFrame, scratch, context: bool = False):
        self.pages, self.scratch = pages, scratch
        self.lines = scratch.write(line_table(pages))
        self.outer = outer_lines(self.lines)
        self.tokens = scratch.write(tokens(self.lines, context))
        self.lexicon = scratch.write(lexicon(self.tokens))
        self.fixes = repairs(self.lexicon, scratch)

    def misread(self, *more: str) -> DataFrame:
        """(page_id, line_no, word) of misread whole words."""
        seen = self.scratch.hinted(self.fixes.select(F.col("seen").alias("lower")).distinct(), of=self.fixes)
        return self.tokens.where("plain").withColumn("lower", F.lower("word")).join(seen, "lower", "left_semi").select("page_id", "line_no", "word", *more)

    def found(self) -> DataFrame:
        """(page_id, line_no, kind), distinct.  Pages without text have no row; a page
        number is no running line."""
        kinds = [
            broken_words(self.lines, self.lexicon, self.fixes).withColumn("kind", F.lit("split_word")),
            running_lines(self.outer).withColumn("kind", F.lit("running")),
            self.outer.where("page_no").select("page_id", "line_no").withColumn("kind", F.lit("page_no")),
            self.misread().select("page_id", "line_no").withColumn("kind", F.lit("misread")),
        ]
        return functools.reduce(DataFrame.unionByName, kinds).select("page_id", F.col("line_no").cast("int").alias("line_no"), "kind").distinct()

    def repaired(self) -> DataFrame:
        """(page_id, repaired): each page as paragraphs, separated by blank lines.

        Running lines and page numbers are left out, broken words are joined,
        misread ones replaced and the lines of a paragraph joined by spaces.
        """
        found = self.found().where("kind <> 'misread'").groupBy("page_id").agg(F.collect_list(F.struct("line_no", "kind")).alias("marks"))
        best = self.scratch.write(pick(self.tokens, self.fixes, self.scratch))
        table = self.scratch.hinted(best.select(F.coalesce("prev", F.lit("")).alias("p"), "seen", "printed"), of=best)
        words = self.misread("prev", "lower").select("page_id", "line_no", "word", F.coalesce("prev", F.lit("")).alias("p"), F.col("lower").alias("seen")).join(table, ["p", "seen"])
        words = words.groupBy("page_id").agg(F.collect_set(F.struct("line_no", "word", "printed")).alias("words"))
        # what is found in a page comes back to the page's text
        frame = self.pages.where("id is not null and raw_text is not null").select(F.col("id").alias("page_id"), F.transform(F.split("raw_text", "\n", -1), lambda x: F.rtrim(x, F.lit(WHITE))).alias("lines"))
        out = frame.join(found, "page_id", "left").join(words, "page_id", "left")
        return out.select("page_id", _rebuild("lines", F.to_json("marks"), F.to_json("words")).alias("repaired"))


def rebuild(lines: list[str], marks: list[dict], words: list[dict]) -> str:
    drop = {m["line_no"] for m in marks if m["kind"] in ("running", "page_no")}
    broken = {m["line_no"] for m in marks if m["kind"] == "split_word"}
    fix: dict[int, dict[str, str]] = {}
    for w in words:
        fix.setdefault(w["line_no"], {})[w["word"]] = w["printed"].capitalize() if w["word"][:1].isupper() else w["printed"]
    out, glue = [""], False
    for k, line in enumerate(lines, 1):
        if k in drop:
            continue
        for a, b in fix.get(k, {}).items():
            line = re.sub(rf"(?<![^\W_]){re.escape(a)}(?![^\W_])", lambda _, b=b: b, line)
        line = line.strip()
        if not line:
            if out[-1]:
                out.append("")
        elif k in broken:
            out[-1] += ("" if glue or not out[-1] else " ") + line[:-1]
            glue = True
            continue
        elif "|" in line or line.startswith("---"):
            out[-1] += ("\n" if out[-1] else "") + line
        else:
            own = out[-1].endswith("-") and out[-1][-2:-1].isalpha()
            out[-1] += ("" if glue or own or not out[-1] else "\n" if "|" in out[-1] else " ") + line
        glue = False
    return "\n\n".join(x for x in out if x)


@F.pandas_udf(StringType())
def _rebuild(lines: pd.Series, marks: pd.Series, words: pd.Series) -> pd.Series:
    load = lambda x: json.loads(x) if x else []
    return pd.Series([rebuild(list(a), load(m), load(w)) for a, m, w in zip(lines, marks, words)], dtype=object)
