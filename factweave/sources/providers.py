"""Interfaces of outside services, with offline defaults (S-16, V-1, V-4, E-7, R-10).

A provider is called with batches in ``mapInPandas``; a partition is a worker, so the
number of partitions bounds how many calls run at once. Network providers implement
the same protocols outside this library.
"""

from __future__ import annotations

import re
import time
from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factweave.functions.text import RETRY
from factweave.functions.vectors import embed
from factweave.operators import pairs as PR
from factweave.operators.verify import prompt


class Embedder(Protocol):
    model: str
    dimensions: int

    def embed(self, texts: list[str]) -> list[list[float]]: ...


class Recognizer(Protocol):
    """Recognises the text of a scanned page."""

    def text(self, image: bytes) -> str: ...


class Judge(Protocol):
    """Answers for pairs that the comparison leaves open: for (key, prompt) rows the columns
    type, confidence, dimension and explanation."""

    def decide(self, pairs: pd.DataFrame) -> pd.DataFrame: ...


class HashEmbedder:
    """The offline embedder."""

    model, dimensions = "hash-embedding-v1", 128

    def embed(self, texts: list[str]) -> list[list[float]]:
        memo: dict = {}
        return [embed(t or "", self.dimensions, memo).tolist() for t in texts]


class NoRecognizer:
    """The offline recogniser: it knows nothing."""

    def text(self, image: bytes) -> str:
        return ""


class Extractor(Protocol):
    """Finds claims in the text of a chunk (V-1): for each prompt a list of dicts with columns of
    the facts table, and `confidence` and `notes` where it likes."""

    version: str

    def extract(self, prompts: list[str]) -> list[list[dict]]: ...


class Transient(Exception):
    """A failure that may pass."""


class Limited(Transient):
    """Too many requests; the message may say how long to wait."""


class Fatal(Exception):
    """A failure that no repetition mends, such as a wrong key or a malformed request."""


_WAIT = [re.compile(p) for p in RETRY]


def asked_wait(message: str) -> float | None:
    """Seconds that a service's message asks to wait (as ``functions.text.retry_delay``), or None."""
    for p in _WAIT:
        if m := p.search(message):
            try:
                return max(float(m[1]) + 1.5, 5.0)
            except ValueError:
                continue
    return None


def retrying(call, *args, attempts: int = 3, wait: float = 0.5, sleep=time.sleep):
    """The result of ``call``. A Transient failure is tried again after 0.5, 1, ... seconds; a
    Limited one after what its message asks for, else at least 5, 10, ... seconds (V-4).
    Anything else, a Fatal failure above all, is raised at once."""
    for k in range(attempts):
        try:
            return call(*args)
        except Transient as e:
            if k == attempts - 1:
                raise
            plain = wait * 2**k
            sleep((asked_wait(str(e)) or max(plain, 5.0 * (k + 1))) if isinstance(e, Limited) else plain)


def extract_claims(chunks: DataFrame, provider: Extractor, at_once: int = 4, batch: int = 8, columns: str = "subject string, predicate string, value_text string, value_type string, unit string, currency string, time_text string, scope string, geography string, source_quote string, confidence double, notes string") -> DataFrame:
    """(chunk_id, k, ``columns``): the claims that ``provider`` finds in each chunk, ``at_once``
    workers; what ``pipeline.assembled`` takes. A claim without a column has null there."""
    names = [c.split()[0] for c in columns.split(", ")]

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            for s in range(0, len(pdf), batch):
                part = pdf.iloc[s : s + batch]
                found = retrying(provider.extract, list(part.prompt))
                rows = [(i, k, *(c.get(n) for n in names)) for i, cs in zip(part.chunk_id, found) for k, c in enumerate(cs)]
                yield pd.DataFrame(rows, columns=["chunk_id", "k", *names]).astype({n: object for n in names})

    path = F.coalesce(F.from_json("heading_path_json", "array<string>"), F.array().cast("array<string>"))
    asked = chunks.select(F.col("id").alias("chunk_id"), prompt(path, F.coalesce("text", F.lit(""))).alias("prompt"))
    return asked.repartition(at_once).mapInPandas(run, f"chunk_id string, k int, {columns}")


def judge_pairs(pairs: DataFrame, provider: Judge, at_once: int = 4, batch: int = 16) -> DataFrame:
    """(key, type, confidence, dimension, explanation) of compared pairs that are left open, each
    key once (R-10, R-12); what a cache of answers keeps (``store.with_cache``)."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            for s in range(0, len(pdf), batch):
                part = pdf.iloc[s : s + batch]
                said = retrying(provider.decide, part)
                yield pd.DataFrame({"key": list(part.key), **{c: list(said[c]) for c in ("type", "confidence", "dimension", "explanation")}})

    open_ = pairs.where("d.branch = 'open'").select(PR.cache_key().alias("key"), PR.pair_prompt().alias("prompt")).dropDuplicates(["key"])
    return open_.repartition(at_once).mapInPandas(run, "key string, type string, confidence double, dimension string, explanation string")


def embed_texts(texts: DataFrame, key: str, text: str, provider: Embedder, at_once: int = 4, batch: int = 25) -> DataFrame:
    """(key, model, vector) of distinct texts' rows by a provider, ``at_once`` workers."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            for s in range(0, len(pdf), batch):
                part = pdf.iloc[s : s + batch]
                yield pd.DataFrame({key: part[key], "model": provider.model, "vector": retrying(provider.embed, list(part[text]))})

    kind = dict(texts.dtypes)[key]
    return texts.select(key, text).repartition(at_once).mapInPandas(run, f"{key} {kind}, model string, vector array<float>")
