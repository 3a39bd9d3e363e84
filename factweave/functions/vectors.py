"""Text as vectors and similarities of texts and vectors."""

from __future__ import annotations

import collections
import difflib
import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factweave.functions.text import filled, folded, strip


def canonical_text(f: str = "", name: Column | None = None) -> Column:
    """A fact as one line for retrieval: subject; predicate; type; time; scope; geography;
    qualifiers (E-1). ``name`` is the entity's canonical name, if known."""
    c = lambda x: F.col(f + x)
    subject = strip(F.coalesce(filled(name) if name is not None else F.lit(None).cast("string"), c("subject"), F.lit("")))
    text = filled(c("time_text"))
    span = F.when(filled(c("time_start")).isNotNull() | filled(c("time_end")).isNotNull(), filled(F.regexp_replace(F.concat(F.coalesce(c("time_start"), F.lit("")), F.lit(".."), F.coalesce(c("time_end"), F.lit(""))), r"^\.+|\.+$", "")))
    time = F.coalesce(filled(F.concat_ws(", ", strip(text), F.when(strip(text).isNull() | (strip(text) != span), span))), F.lit("unspecified time"))
    or_else = lambda x, d: F.coalesce(filled(strip(c(x))), F.lit(d))
    raw = c("qualifiers_json")
    listed = F.filter(F.transform(F.from_json(raw, "array<string>"), strip), lambda q: q != "")
    quals = F.coalesce(filled(F.array_join(listed, ", ")), F.when(F.from_json(raw, "array<string>").isNull(), filled(strip(raw))), F.lit("no qualifiers"))
    return F.concat_ws("; ", subject, strip(F.coalesce(c("predicate"), F.lit(""))), F.coalesce(c("value_type"), F.lit("")), time, or_else("scope", "unspecified scope"), or_else("geography", "unspecified geography"), quals)


DIMENSIONS = 128


def features(text: str) -> list[str]:
    words = text.lower().replace(";", " ").replace(",", " ").split()
    return words + [w[i : i + 3] for w in words for i in range(len(w) - 2)]


def embed(text: str, dimensions: int = DIMENSIONS, memo: dict | None = None) -> np.ndarray:
    """Signed hashed counts of words and character trigrams, of length 1 (E-2); zeros for a blank text."""
    memo = {} if memo is None else memo
    v = np.zeros(dimensions)
    for f in features(text):
        if f not in memo:
            h = hashlib.sha256(f.encode()).digest()
            memo[f] = (int.from_bytes(h[:4], "big") % dimensions, 1.0 if h[4] % 2 == 0 else -1.0)
        k, s = memo[f]
        v[k] += s
    n = np.sqrt((v * v).sum())
    return v / n if n else v


#: Vectors of single words, and how many of them are kept.
_WORDS: dict[str, np.ndarray] = {}
WORDS = 1 << 15


def embeddings(texts, dimensions: int = DIMENSIONS, step: int = 2048) -> np.ndarray:
    """The vectors of ``embed`` as rows of a matrix of floats; a text's is the sum of its words'."""
    texts, memo = list(texts), {}
    out = np.zeros((len(texts), dimensions), dtype=np.float32)
    for s in range(0, len(texts), step):
        if len(_WORDS) > WORDS:
            _WORDS.clear()
        vocabulary: dict[str, int] = {"": 0}
        rows = [np.zeros(dimensions, dtype=np.int32)]
        codes, starts = [], []
        for t in texts[s : s + step]:
            starts.append(len(codes))
            codes.append(0)
            for w in (t or "").lower().replace(";", " ").replace(",", " ").split():
                c = vocabulary.get(w)
                if c is None:
                    v = _WORDS.get(w)
                    if v is None:
                        v = np.zeros(dimensions, dtype=np.int32)
                        for f in features(w):
                            if f not in memo:
                                h = hashlib.sha256(f.encode()).digest()
                                memo[f] = (int.from_bytes(h[:4], "big") % dimensions, 1 if h[4] % 2 == 0 else -1)
                            k, x = memo[f]
                            v[k] += x
                        _WORDS[w] = v
                    c = vocabulary[w] = len(rows)
                    rows.append(v)
                codes.append(c)
        v = np.add.reduceat(np.stack(rows)[codes], starts, axis=0).astype(np.float64)
        n = np.sqrt((v * v).sum(1))[:, None]
        out[s : s + step] = np.divide(v, n, out=np.zeros_like(v), where=n > 0)
    return out


@F.pandas_udf(T.ArrayType(T.FloatType()))
def hash_embedding(text: pd.Series) -> pd.Series:
    memo: dict = {}
    return pd.Series([embed(t or "", memo=memo).astype("float32") for t in text], dtype=object)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, z: s + z)


def cosine(a: Column, b: Column, aa: Column | None = None, bb: Column | None = None) -> Column:
    """Cosine of two vectors (E-4): 0 where one is empty, null or zero, or lengths differ; within [-1, 1].
    ``aa`` and ``bb`` are their products with themselves, where these are at hand."""
    norm = F.sqrt((dot(a, a) if aa is None else aa) * (dot(b, b) if bb is None else bb))
    ok = (F.size(a) > 0) & (F.size(a) == F.size(b)) & (norm > 0)
    return F.when(ok, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b) / norm))).otherwise(0.0)


def word_jaccard(a: Column, b: Column) -> Column:
    """Shared share of the words of two texts (E-9); 0 where both have none."""
    w = lambda c: F.filter(F.split(folded(c), r"(?U)\s+"), lambda x: x != "")
    x, y = w(a), w(b)
    return F.coalesce(F.try_divide(F.size(F.array_intersect(x, y)), F.size(F.array_union(x, y))), F.lit(0.0))


@F.pandas_udf(T.DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp similarity (E-8); for distinct pairs of strings."""
    return pd.Series([difflib.SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b)], dtype=float)


def sequence_ratio_from(a: Column, b: Column, least: float) -> Column:
    """``sequence_ratio`` where it is at least ``least``, else 0: the bounds by length and by
    the letters that both texts have are tried first."""

    @F.pandas_udf(T.DoubleType())
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        letters: dict[str, collections.Counter] = {}
        out = []
        for x, y in zip(a, b):
            n = len(x) + len(y)
            if 2 * min(len(x), len(y)) < least * n:
                out.append(0.0)
                continue
            for t in (x, y):
                if t not in letters:
                    letters[t] = collections.Counter(t)
            u = letters[y]
            same = sum(min(c, u[k]) for k, c in letters[x].items() if k in u)
            out.append(difflib.SequenceMatcher(None, x, y).ratio() if 2 * same >= least * n else 0.0)
        return pd.Series(out, dtype=float)

    return run(a, b)


#: Query vectors that go to the tasks at once.
BLOCK = 4096


def vector_search(vectors: DataFrame, queries: DataFrame, least: float, key: str = "vec_id", vector: str = "embedding", block: int = BLOCK) -> DataFrame:
    """(query_id, key, similarity) of all vectors whose cosine with a query is at least ``least``.

    The queries, a stated set, go to the tasks in blocks of ``block`` vectors, and
    each batch of vectors meets a block as one matrix product; nothing is shuffled.
    Null, empty and zero vectors and those of another length match nothing; a vector
    doesn't match itself.
    """
    spark = vectors.sparkSession
    kind = dict(vectors.dtypes)[key]

    def unit(rows) -> tuple[list, np.ndarray]:
        good = [(k, np.asarray(v, dtype=np.float64)) for k, v in rows if v is not None and len(v)]
        good = [(k, v / n) for k, v in good if (n := np.sqrt((v * v).sum())) > 0]
        return [k for k, _ in good], [v for _, v in good]

    rows = queries.select(key, vector).toLocalIterator()
    parts, done = [], False
    while not done:
        chunk = [r for _, r in zip(range(block), rows)]
        done = len(chunk) < block
        ids, vs = unit((r[0], r[1]) for r in chunk)
        for size in sorted({len(v) for v in vs}):
            own = [k for k, v in zip(ids, vs) if len(v) == size]
            q = spark.sparkContext.broadcast((own, np.stack([v for v in vs if len(v) == size])))

            def run(it, q=q, size=size):
                names, m = q.value
                for pdf in it:
                    ks, xs = unit((k, v) for k, v in zip(pdf[key], pdf[vector]) if v is not None and len(v) == size)
                    if not ks:
                        continue
                    s = np.clip(np.stack(xs) @ m.T, -1, 1)
                    i, j = np.nonzero(s >= least)
                    yield pd.DataFrame([(names[b], ks[a], float(s[a, b])) for a, b in zip(i, j) if names[b] != ks[a]], columns=["query_id", key, "similarity"])

            parts.append(vectors.select(key, vector).mapInPandas(run, f"query_id {kind}, {key} {kind}, similarity double"))
    if not parts:
        return vectors.select(F.col(key).alias("query_id"), key, F.lit(0.0).alias("similarity")).limit(0)
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out
