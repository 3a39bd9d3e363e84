"""Problem 9: evaluation texts inside a corpus.

Texts are brought to one visual form, split into words and cut into passages of
``WINDOW`` words every ``STRIDE`` words, so that every run of ``RUN`` words lies
whole in a passage of its text.  A passage is a TF-IDF vector over the words of
the evaluation texts, with document frequencies counted over the whole corpus and
weights between 1 and 2 (binary counts).  A distributed randomised SVD of the
evaluation passages gives a latent space of ``RANK`` dimensions; corpus passages are
folded into it and their cosines with all evaluation passages give the candidates,
which are then compared word by word: longest common run, longest common
subsequence, answer.

No case is lost by the reduction, whatever the rank.  Let P be the projection on the
latent space, y an evaluation passage and s the words of a run of it.  A corpus passage
that holds the run is s plus at most WINDOW - RUN other words, so its product with y in
the latent space is at least <Ps, Py> + (WINDOW - RUN) m, where m, at most 0, is the
least that one word adds, over all known words.  The least such bound over the runs
of y, divided by the lengths of both passages, is the cosine from which a pair is a
candidate.  The rank decides only how many candidates are compared for nothing.

A paraphrase need not share any run.  Stretches of a document, twice as long as the
item and every half of its length, are compared with the item if enough of their words
are among the item's: a common subsequence can't be longer than their number.

The evaluation texts are the stated query set.  What goes to the tasks at once is
bounded in bytes (``BLOCK_BYTES``, counted from the texts): a set of some ten thousand
texts takes one pass over the words of the corpus, a larger one more passes.
"""

from __future__ import annotations

import functools
import itertools
import math
import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factweave.llm.lookalike import canonical, transducer

RUN, WINDOW, STRIDE = 12, 16, 5
#: Dimensions of the latent space; passes of the power iteration.
RANK, POWER = 128, 2
#: Bound of what one block of evaluation texts takes in a task, in bytes.
BLOCK_BYTES = 64 << 20
#: Documents that are compared with a block as one matrix product.
BATCH = 512

_WORDS = re.compile(r"[^\W_]+")


def words(text: str | None) -> list[str]:
    """Runs of letters and digits in lower case, of the text in its one visual form."""
    return _WORDS.findall(transducer()(text).lower()) if text else []


def with_words(df: DataFrame, key: str, scratch, *more: str) -> DataFrame:
    """(key, words) of texts with at least ``RUN`` words, joined by spaces; null keys and
    texts have no row. Only texts with other than ASCII characters leave the JVM."""
    spaced = F.trim(F.regexp_replace(F.lower(canonical("text")), r"[^\p{L}\p{N}]+", " "))
    d = df.where(F.col(key).isNotNull() & F.col("text").isNotNull()).select(F.col(key).alias("key"), *more, spaced.alias("words"))
    return scratch.write(d.where(F.length("words") - F.length(F.translate("words", " ", "")) >= RUN - 1))


def windows(n: int) -> range:
    return range(0, max(1, n - RUN + 1), STRIDE)


def _frequency(vocab: dict[str, int]):
    def run(it):
        total, n = np.zeros(len(vocab), dtype=np.int64), 0
        for pdf in it:
            for ws in pdf.words:
                n += 1
                for w in {*ws.split(" ")}:
                    k = vocab.get(w)
                    if k is not None:
                        total[k] += 1
        yield pd.DataFrame({"k": [-1, *np.flatnonzero(total)], "c": [n, *total[total > 0]]})

    return run


def weights(corpus: DataFrame, vocab: dict[str, int]) -> np.ndarray:
    """Weights from 1 (in every document) to 2 (in none), by document frequency in the corpus."""
    rows = corpus.select("words").mapInPandas(_frequency(vocab), "k long, c long").groupBy("k").agg(F.sum("c").alias("c")).collect()  # at most one row a word of the block
    df, n = np.zeros(len(vocab)), 1
    for r in rows:
        if r.k < 0:
            n = max(1, r.c)
        else:
            df[r.k] = r.c
    return 1 + np.log((n + 1) / (df + 1)) / np.log(n + 1)


def passages(ws: list[str], vocab: dict[str, int], least: int = 0) -> list[tuple[list[int], int]]:
    """For each passage with ``least`` places that known words take, its known words,
    each once, and how many others it has."""
    ids = [vocab.get(w, -1) for w in ws]
    total = [0, *itertools.accumulate(i >= 0 for i in ids)]
    out = []
    for s in windows(len(ws)):
        if total[min(s + WINDOW, len(ids))] - total[s] < least:
            continue
        part = ids[s : s + WINDOW]
        known = {i for i in part if i >= 0}
        other = len({w for w, i in zip(ws[s : s + WINDOW], part) if i < 0})
        out.append((sorted(known), other))
    return out


def _rows(lists: list[list[int]], w: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """Weighted sums of basis rows: the product of a sparse matrix, given by the column
    numbers of its rows, with ``basis``."""
    out = np.zeros((len(lists), basis.shape[1]), dtype=np.float32)
    full = [k for k, x in enumerate(lists) if x]
    if full:
        flat = np.concatenate([lists[k] for k in full]).astype(np.int64)
        starts = np.cumsum([0, *(len(lists[k]) for k in full)])[:-1]
        out[full] = np.add.reduceat(basis[flat] * w[flat, None].astype(np.float32), starts, axis=0)
    return out


def _gram(vocab: dict[str, int], w: np.ndarray, omega: np.ndarray):
    """Rows of A' A omega of a partition's passages A."""

    def run(it):
        total: dict[int, np.ndarray] = {}
        for pdf in it:
            lists = [p for ws in pdf.words for p, _ in passages(ws.split(" "), vocab)]
            y = _rows(lists, w, omega)
            for p, row in zip(lists, y):
                for k in p:
                    total[k] = total[k] + row * w[k] if k in total else row * w[k]
        if total:
            yield pd.DataFrame({"k": list(total), "row": [r.astype(np.float32) for r in total.values()]})

    return run


#: Words whose rows one task adds.
TOGETHER = 1024


def _add(pdf: pd.DataFrame) -> pd.DataFrame:
    ks, at = np.unique(pdf.k, return_inverse=True)
    total = np.zeros((len(ks), len(pdf.row.iloc[0])), dtype=np.float32)
    np.add.at(total, at, np.stack(pdf.row))
    return pd.DataFrame({"k": ks, "row": list(total)})


def latent_basis(items: DataFrame, vocab: dict[str, int], w: np.ndarray, rank: int = RANK, power: int = POWER) -> np.ndarray:
    """Orthonormal basis (words x rank) of a randomised SVD of the passages of ``items``.

    Each pass multiplies the passages with the current sketch in the tasks; the rows of
    the partial products are added there too, so that words x rank numbers come to the
    driver, which makes them orthogonal.
    """
    k = min(rank, len(vocab))
    q = np.random.default_rng(9).standard_normal((len(vocab), k)).astype(np.float32)
    for _ in range(power + 1):
        y = np.zeros((len(vocab), k))
        parts = items.select("words").mapInPandas(_gram(vocab, w, q), "k long, row array<float>")
        # a group holds one row a word and task
        for r in parts.groupBy(F.floor(F.col("k") / TOGETHER)).applyInPandas(_add, "k long, row array<float>").toLocalIterator():
            y[r.k] = r.row
        q = np.linalg.qr(y)[0].astype(np.float32)
    return q


def longest_run(a: list[str], b: list[str]) -> int:
    """Length of the longest run of words that both texts hold."""
    where: dict[str, list[int]] = {}
    for j, x in enumerate(b):
        where.setdefault(x, []).append(j)
    best, last = 0, {}
    for x in a:
        now = {}
        for j in where.get(x, ()):
            n = last.get(j - 1, 0) + 1
            now[j] = n
            best = max(best, n)
        last = now
    return best


def common_subsequence(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, bit-parallel over ``b``."""
    where: dict[str, int] = {}
    for j, x in enumerate(b):
        where[x] = where.get(x, 0) | 1 << j
    full = (1 << len(b)) - 1
    v = full
    for x in a:
        u = v & where.get(x, 0)
        v = ((v + u) | (v - u)) & full
    return len(b) - v.bit_count()


def near_subsequence(ws: list[str], t: list[str], own: frozenset, least: int) -> int:
    """The longest common subsequence of ``t`` with a stretch of ``ws`` twice as long, one
    every half of its length; 0 if it is under ``least``."""
    n, best = len(t), 0
    known = [0, *itertools.accumulate(x in own for x in ws)]
    for at in range(0, max(1, len(ws) - n), max(1, n // 2)):
        end = min(len(ws), at + 2 * n)
        if known[end] - known[at] >= max(least, best + 1):
            best = max(best, common_subsequence(ws[at:end], t))
    return best if best >= least else 0


class Block:
    """One block of evaluation texts, ready to be compared with a corpus."""

    def __init__(self, rows: list, corpus: DataFrame, items: DataFrame, rank: int, least: float | None = None):
        texts: dict[tuple, list] = {}
        for r in rows:
            texts.setdefault(tuple(r.words.split(" ")), []).append((r.key, r.answer))
        self.texts = [list(t) for t in texts]
        self.owners = list(texts.values())
        self.vocab = {w: k for k, w in enumerate(sorted({w for t in self.texts for w in t}))}
        self.w = weights(corpus, self.vocab)
        basis = latent_basis(items, self.vocab, self.w, rank)
        #: the latent vector of each word, weighted
        self.latent = (basis * self.w[:, None]).astype(np.float32)
        self.sets = [frozenset(t) for t in self.texts]
        #: different words that a document shares at least if it shares a run
        self.shared = [min(len({*t[s : s + RUN]}) for s in range(len(t) - RUN + 1)) for t in self.texts]
        #: words that a subsequence takes at least, if it is a paraphrase
        self.least = None if least is None else [max(1, math.ceil(least * len(t) - 1e-9)) for t in self.texts]
        if least is not None:
            #: different words that a paraphrase shares at least: all but those of the places that it leaves out
            self.kept = np.array([max(1, len(s) - len(t) + n) for s, t, n in zip(self.sets, self.texts, self.least)])
            holders: list[list[int]] = [[] for _ in self.vocab]
            for k, s in enumerate(self.sets):
                for x in s:
                    holders[self.vocab[x]].append(k)
            #: the texts in which each word occurs
            self.holders = [np.array(h) for h in holders]
        y, floor, self.text_of = [], [], []
        latent = self.latent.astype(np.float64)
        for k, t in enumerate(self.texts):
            ids = [self.vocab[x] for x in t]
            for s in windows(len(t)):
                part = ids[s : s + WINDOW]
                z = latent[sorted({*part})].sum(0)
                add = latent @ z
                run = min(add[sorted({*part[j : j + RUN]})].sum() for j in range(len(part) - RUN + 1))
                y.append(z)
                floor.append(run + (WINDOW - RUN) * min(0.0, add.min()))
                self.text_of.append(k)
        self.y = np.array(y, dtype=np.float32)
        self.floor = (np.array(floor) - 1e-3).astype(np.float32)
        self.text_of = np.array(self.text_of)


def _search(blk):
    """Candidates of each document by latent cosine and, for paraphrases, by their words in
    a stretch, then the comparison of words."""

    def candidates(docs: list[list[str]]) -> list[set[int]]:
        """Texts one of whose passages is as near as a passage with a shared run must be."""
        b = blk.value
        lists, doc = [], []
        for d, ws in enumerate(docs):
            for known, _ in passages(ws, b.vocab, RUN):
                lists.append(known)
                doc.append(d)
        out: list[set[int]] = [set() for _ in docs]
        for s in range(0, len(lists), 1024):
            part = lists[s : s + 1024]
            flat = np.concatenate([np.asarray(x) for x in part])
            z = np.add.reduceat(b.latent[flat], np.cumsum([0, *(len(x) for x in part)])[:-1], axis=0)
            # both sides of the cosine and of its bound are divided by the same two lengths
            for i, j in zip(*np.nonzero(z @ b.y.T >= b.floor)):
                out[doc[s + i]].add(int(b.text_of[j]))
        return out

    def paraphrases(docs: list[list[str]]) -> list[set[int]]:
        """Texts of whose different words a document holds as many as a paraphrase must."""
        b = blk.value
        out = []
        for ws in docs:
            held = [b.holders[b.vocab[x]] for x in {*ws} if x in b.vocab]
            count = np.bincount(np.concatenate(held), minlength=len(b.texts)) if held else np.zeros(len(b.texts))
            out.append({int(k) for k in np.flatnonzero(count >= b.kept)})
        return out

    def run(it):
        b = blk.value
        for pdf in it:
            rows = []
            for at in range(0, len(pdf), BATCH):
                part = pdf.iloc[at : at + BATCH]
                docs = [x.split(" ") for x in part.words]
                alike = paraphrases(docs) if b.least is not None else [set()] * len(docs)
                for key, ws, near, like in zip(part.key, docs, candidates(docs), alike):
                    held = {*ws} if near or like else ()
                    for k in sorted(near | like):
                        t = b.texts[k]
                        n = longest_run(ws, t) if k in near and len(held & b.sets[k]) >= b.shared[k] else 0
                        c = near_subsequence(ws, t, b.sets[k], b.least[k]) if k in like else 0
                        if n < RUN and not c:
                            continue
                        n = n or longest_run(ws, t)
                        for item, answer in b.owners[k]:
                            aw = _WORDS.findall((answer or "").lower())
                            rows.append((key, item, n, c, len(t), bool(aw) and all(x in held for x in aw)))
            yield pd.DataFrame(rows, columns=["doc", "item", "run", "lcs", "n_words", "has_answer"])

    return run


def block_bytes(words: int, rank: int = RANK) -> int:
    """What evaluation texts of so many words take in a task, at most: a passage every
    ``STRIDE`` words and a latent vector for each word, and the words themselves."""
    return words * (4 * rank // STRIDE + 4 * rank + 200)


def leaks(documents: DataFrame, items: DataFrame, scratch, rank: int = RANK, block: int = BLOCK_BYTES, least: float | None = None) -> DataFrame:
    """(doc_id, item_id, run, lcs, n_words, has_answer) of documents and items that share a
    run of ``RUN`` words and, with ``least``, of those whose ``lcs`` is at least that part of
    the item.

    ``run`` is the longest common run in words, ``lcs`` the longest common subsequence with
    a stretch of the document (see ``near_subsequence``; 0 below ``least`` or without it),
    ``n_words`` the words of the item, ``has_answer`` whether the document holds all
    words of its answer.  Null, empty and short texts (under ``RUN`` words) give no
    row; documents or items that occur twice give their rows once.
    """
    spark = documents.sparkSession
    corpus = with_words(documents, "doc_id", scratch)
    queries = with_words(items, "item_id", scratch, "answer")
    size = queries.agg(F.coalesce(F.sum(F.size(F.split("words", " "))), F.lit(0)).alias("n")).first().n
    # a hash deals texts out unevenly, by a part that shrinks with their number; half the bound leaves room for it
    keyed = queries.withColumn("block", F.pmod(F.xxhash64("words"), F.lit(max(1, -(-block_bytes(size, rank) * 2 // block)))))
    blocks = sorted(r.block for r in keyed.select("block").distinct().collect())
    parts = []
    for n in blocks:
        own = keyed.where(F.col("block") == n).drop("block")
        blk = spark.sparkContext.broadcast(Block(own.collect(), corpus, own, rank, least))  # texts of bounded bytes
        parts.append(corpus.mapInPandas(_search(blk), "doc long, item long, run int, lcs int, n_words int, has_answer boolean"))
    if not parts:
        return corpus.select(F.col("key").alias("doc_id"), F.col("key").alias("item_id"), *(F.lit(0).alias(c) for c in ("run", "lcs", "n_words")), F.lit(False).alias("has_answer")).limit(0)
    out = functools.reduce(DataFrame.unionByName, parts)
    return out.withColumnsRenamed({"doc": "doc_id", "item": "item_id"}).distinct()


def shared_runs(documents: DataFrame, items: DataFrame, scratch, **kw) -> DataFrame:
    """(doc_id, item_id) of documents and items that share a run of ``RUN`` words."""
    return leaks(documents, items, scratch, **kw).where(F.col("run") >= RUN).select("doc_id", "item_id").distinct()


def leak_report(documents: DataFrame, items: DataFrame, scratch, least: float = 0.6, **kw) -> DataFrame:
    """Leaks with their kind: `verbatim` (a run of ``RUN`` words), `paraphrase` (at least
    ``least`` of the item's words in order) and, of those, with the answer or not."""
    found = leaks(documents, items, scratch, least=least, **kw)
    kind = F.when(F.col("run") >= RUN, "verbatim").when(F.col("lcs") >= least * F.col("n_words"), "paraphrase")
    return found.withColumn("kind", kind).where("kind is not null")
