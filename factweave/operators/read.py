"""Reading the tables of the model with optional filters (Q, C-9, C-10, W-1).

Each function takes the tables (a mapping of name to DataFrame) and filters, all of them
optional, and returns a plan: filters reach the scan, joins are only made where a filter or
column needs them. Facts and relationships are read as they are given: of several
deliveries take the last before (``facts.latest``). Substring filters ignore letter case
and take ``%`` and ``_`` as wildcards; null never matches. Listings are pages in a total order.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Tables = Mapping[str, DataFrame]
#: Rows of a page of results, and the most a caller may ask for.
LIMIT, MOST = 50, 500


def like(c: Column | str, text: str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(F.ilike(c, F.lit(f"%{text}%")), F.lit(False))


def page(df: DataFrame, *order: Column | str, limit: int | None = LIMIT, offset: int = 0) -> DataFrame:
    """One page of a listing; ``limit`` None gives all rows, unordered."""
    if limit is None:
        return df
    if not 1 <= limit <= MOST or offset < 0:
        raise ValueError(f"limit must be 1 to {MOST} and offset not negative")
    return df.orderBy(*order).offset(offset).limit(limit)


def _given(df: DataFrame, **equal) -> DataFrame:
    for c, v in equal.items():
        if v is not None:
            df = df.where(F.col(c) == v)
    return df


def _least(df: DataFrame, c: str, v: float | None) -> DataFrame:
    return df if v is None else df.where(F.col(c) >= v)


def _newest(c: str = "created_at") -> Column:
    return F.col(c).desc_nulls_last()


def _names(t: Tables) -> DataFrame:
    return t["entities"].select(F.col("id").alias("entity_id"), F.col("canonical_name").alias("entity_name"))


def _files(t: Tables) -> DataFrame:
    return t["document_files"].select(F.col("id").alias("document_id"), F.col("original_filename").alias("document_name"))


def facts(t: Tables, document_id: str | None = None, subject: str | None = None, entity: str | None = None, predicate: str | None = None, status: str | None = None, min_confidence: float | None = None, limit: int | None = LIMIT, offset: int = 0) -> DataFrame:
    """Facts, newest first (Q-1, Q-2): ``subject`` is sought in the subject, ``entity`` in the
    subject and the entity's name."""
    f = _least(_given(t["facts"], document_id=document_id, validation_status=status), "extraction_confidence", min_confidence)
    if subject:
        f = f.where(like("subject", subject))
    if predicate:
        f = f.where(like("predicate", predicate))
    if entity:
        named = f.join(_names(t), "entity_id", "left")
        f = named.where(like("subject", entity) | like("entity_name", entity)).select(*t["facts"].columns)
    return page(f, F.col("seq").desc(), "id", limit=limit, offset=offset)


def search(t: Tables, text: str | None = None, status: str | None = None, value_type: str | None = None, limit: int | None = LIMIT, offset: int = 0) -> DataFrame:
    """Facts with ``document_name`` and ``entity_name``, newest first, found in any of subject,
    predicate, value and entity's name (Q-3)."""
    f = _given(t["facts"], validation_status=status, value_type=value_type).join(_files(t), "document_id", "left").join(_names(t), "entity_id", "left")
    if text:
        f = f.where(like("subject", text) | like("predicate", text) | like("value_text", text) | like("entity_name", text))
    return page(f, F.col("seq").desc(), "id", limit=limit, offset=offset)


def _kinds(t: Tables, kind: str | None, dimension: str | None, fact_id: str | None, min_confidence: float | None) -> DataFrame:
    r = t["relationships"]
    if kind:
        r = r.where(F.lower(F.regexp_replace("relationship_type", r"(?U)^\s+|(?<!\s)\s+$", "")) == kind.strip().lower())
    r = _least(_given(r, primary_dimension=dimension and dimension.lower()), "confidence", min_confidence)
    return r if fact_id is None else r.where((F.col("fact_a_id") == fact_id) | (F.col("fact_b_id") == fact_id))


def _best() -> tuple[Column, ...]:
    return F.col("confidence").desc_nulls_last(), _newest(), F.col("id")


def relationships(t: Tables, kind: str | None = None, dimension: str | None = None, fact_id: str | None = None, min_confidence: float | None = None, limit: int | None = LIMIT, offset: int = 0) -> DataFrame:
    """Relationships, surest first (Q-4); ``fact_id`` is sought at either end."""
    return page(_kinds(t, kind, dimension, fact_id, min_confidence), *_best(), limit=limit, offset=offset)


def document_relationships(t: Tables, document_id: str | None = None, kind: str | None = None, dimension: str | None = None, fact_id: str | None = None, min_confidence: float | None = None, limit: int | None = LIMIT, offset: int = 0) -> DataFrame:
    """Relationships both of whose facts exist, of a document on either side (Q-5)."""
    f = t["facts"].select("id", "document_id")
    r = _kinds(t, kind, dimension, fact_id, min_confidence)
    j = r.join(f.select(F.col("id").alias("fact_a_id"), F.col("document_id").alias("__da")), "fact_a_id").join(f.select(F.col("id").alias("fact_b_id"), F.col("document_id").alias("__db")), "fact_b_id")
    if document_id is not None:
        j = j.where((F.col("__da") == document_id) | (F.col("__db") == document_id))
    return page(j.select(*r.columns), *_best(), limit=limit, offset=offset)


#: Columns of a fact that stand beside a relationship, and what they are called there.
FACT_COLUMNS = {
    "subject": "subject", "predicate": "predicate", "value_text": "value", "normalized_numeric_value": "norm_val", "unit": "unit", "time_text": "time", "scope": "scope", "geography": "geography",
    "source_quote": "quote", "source_page_start": "page", "document_id": "doc_id",
}


def enriched(t: Tables, kind: str | None = None, text: str | None = None, sort: str = "confidence", limit: int | None = 100, offset: int = 0) -> DataFrame:
    """Relationships with twelve columns of each fact and its document (Q-6, Q-12): ``fa_`` and
    ``fb_`` columns. ``text`` is sought in the explanation, both subjects, predicates and
    document names; ``sort`` is confidence or created_at, the highest first. Relationships
    without one of their facts are left out."""
    f = t["facts"].select("id", *FACT_COLUMNS).join(_files(t), "document_id", "left")
    side = lambda s: f.select(F.col("id").alias(f"fact_{s}_id"), *(F.col(c).alias(f"f{s}_{n}") for c, n in FACT_COLUMNS.items()), F.col("document_name").alias(f"f{s}_doc_name"))
    r = _kinds(t, None if kind is None or kind.lower() == "all" else kind, None, None, None)
    j = r.join(side("a"), "fact_a_id").join(side("b"), "fact_b_id")
    if text:
        found = like("explanation", text)
        for c in ("subject", "predicate", "doc_name"):
            found = found | like(f"fa_{c}", text) | like(f"fb_{c}", text)
        j = j.where(found)
    order = _best() if sort == "confidence" else (_newest(), F.col("id"))
    return page(j.select(*r.columns, *(c for c in j.columns if c[:3] in ("fa_", "fb_"))), *order, limit=limit, offset=offset)


def documents(t: Tables, status: str | None = None, limit: int | None = LIMIT, offset: int = 0) -> DataFrame:
    """Documents, newest first (Q-7)."""
    return page(_given(t["document_files"], status=status), _newest(), "id", limit=limit, offset=offset)


def pages(t: Tables, document_id: str) -> DataFrame:
    """Pages of a document in order (Q-8)."""
    return t["pages"].where(F.col("document_id") == document_id).orderBy("page_number", "id")


def blocks(t: Tables, document_id: str, page_number: int | None = None) -> DataFrame:
    """Blocks of a document, or of one of its pages, in reading order, with the page's number (Q-9)."""
    p = _given(t["pages"], document_id=document_id, page_number=page_number).select(F.col("id").alias("page_id"), "page_number")
    return t["blocks"].join(p, "page_id").orderBy("page_number", "reading_order", "block_index", "id")


def chunks(t: Tables, document_id: str) -> DataFrame:
    """Chunks of a document in order (Q-10)."""
    return t["chunks"].where(F.col("document_id") == document_id).orderBy("sequence_index", "id")


def doubtful_facts(t: Tables, status: str = "rejected", limit: int | None = None) -> DataFrame:
    """Facts of a status with their documents, newest first (Q-11)."""
    f = t["facts"].where(F.col("validation_status") == status).join(_files(t), "document_id", "left")
    return page(f, _newest(), "id", limit=limit)


def jobs(t: Tables, status: str | None = None, limit: int | None = 20) -> DataFrame:
    """Jobs, newest first; with status `failed` those to look at (Q-13)."""
    return page(_given(t["jobs"], status=status), _newest(), "id", limit=limit)


def job_status(t: Tables, job_id: str) -> DataFrame:
    """State, stage and progress of a job (Q-15)."""
    j = t["jobs"].where(F.col("id") == job_id)
    return j.select("id", "status", F.col("current_stage").alias("stage"), F.round("progress", 2).alias("progress"), "completed_items", "total_items", "error_message", "created_at", "started_at", "completed_at")


def low_quality_pages(t: Tables, below: float = 0.3) -> DataFrame:
    """Scanned pages and pages of poor text, the worst first (Q-14)."""
    p = t["pages"].where(F.coalesce(F.col("is_scanned"), F.lit(False)) | F.coalesce(F.col("text_quality") < below, F.lit(False)))
    p = p.join(_files(t), "document_id", "left").select("id", "document_id", "page_number", "text_quality", "is_scanned", "document_name", F.length("raw_text").alias("raw_len"))
    return p.orderBy("text_quality", "page_number", "id")


def candidates(t: Tables, document_id: str | None = None, fact_id: str | None = None, status: str | None = None, min_score: float | None = None, limit: int | None = LIMIT, offset: int = 0) -> DataFrame:
    """Candidate pairs, best first (C-9); fact and document are sought at either end."""
    c = _least(_given(t["candidate_pairs"], status=status), "candidate_score", min_score)
    if fact_id is not None:
        c = c.where((F.col("fact_a_id") == fact_id) | (F.col("fact_b_id") == fact_id))
    if document_id is not None:
        own = t["facts"].where(F.col("document_id") == document_id).select("id").distinct()
        ends = own.select(F.col("id").alias("fact_a_id"), F.lit(True).alias("__a")), own.select(F.col("id").alias("fact_b_id"), F.lit(True).alias("__b"))
        c = c.join(ends[0], "fact_a_id", "left").join(ends[1], "fact_b_id", "left").where("__a or __b").select(*t["candidate_pairs"].columns)
    return page(c, F.col("candidate_score").desc_nulls_last(), "fact_a_id", "fact_b_id", limit=limit, offset=offset)


def by_id(t: Tables, name: str, key: str) -> DataFrame:
    """The row of a table with an id (C-10)."""
    return t[name].where(F.col("id") == key)


def found(df: DataFrame):
    """The one row of a plan; LookupError where there is none."""
    row = df.first()
    if row is None:
        raise LookupError("not found")
    return row


def missing(ids: DataFrame, known: DataFrame, key: str = "id") -> DataFrame:
    """The distinct ids that ``known`` doesn't have (Q-16)."""
    return ids.select(key).where(F.col(key).isNotNull()).distinct().join(known.select(key), key, "left_anti")


def targets(t: Tables, ids: DataFrame) -> DataFrame:
    """(id, target) of distinct ids: what a request to process one means, `document`, else
    `job`, else `missing` (Q-17)."""
    kind = lambda name, k: t[name].select("id", F.lit(k).alias(k)).where("id is not null").distinct()
    j = ids.select("id").where("id is not null").distinct().join(kind("document_files", "document"), "id", "left").join(kind("jobs", "job"), "id", "left")
    return j.select("id", F.coalesce("document", "job", F.lit("missing")).alias("target"))


def reconcile(t: Tables, a: str, b: str) -> DataFrame:
    """The comparison of two facts by their ids (Q-18); no row where one isn't there."""
    from factweave.operators import pairs as PR

    ids = t["facts"].sparkSession.createDataFrame([(a, b)], "fact_a_id string, fact_b_id string")
    facts_of = PR.with_entity(t["facts"].where(F.col("id").isin(a, b)), t["entities"])
    return PR.compare(PR.pair_up(ids, facts_of))
