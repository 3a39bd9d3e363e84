"""Queries of the read operators (``operators.read``), each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from factweave.functions import text as X
from factweave.operators import pairs as PR, read as R
from factweave.plans.reference import _BASE, _DIM, _KIND, _OUT, LATEST, latest_facts, query, related_pairs
from factweave.session import Scratch, table

#: A file, a fact and a page that every scale has, found in a total order.
ANY_FILE = "(SELECT document_id FROM facts WHERE document_id IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)"
ANY_FACT = "(SELECT fact_a_id FROM relationships WHERE fact_a_id <> fact_b_id AND fact_a_id IN (SELECT id FROM facts) AND fact_b_id IN (SELECT id FROM facts) GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)"


def tables(spark, d) -> dict:
    t = {n: table(spark, d, n) for n in ("document_files", "pages", "blocks", "chunks", "entities", "relationships")}
    return t | {"facts": latest_facts(spark, d), "jobs": jobs_of(t["document_files"])}


def jobs_of(files):
    """A job for each file, as far as its status tells: the tables have no jobs of their own."""
    status = F.when(F.col("status") == "error", "failed").when(F.col("status") == "ready", "completed").when(F.col("status") == "processing", "running").otherwise("queued")
    done = F.when(F.col("status") == "ready", 5).when(F.col("status") == "processing", 2).otherwise(0)
    return files.select(F.concat(F.lit("job-"), "id").alias("id"), F.lit("full").alias("job_type"), F.array("id").alias("document_ids"), status.alias("status"), F.round(done / 5, 2).alias("progress"), F.lit("extract").alias("current_stage"), F.lit(5).alias("total_items"), done.alias("completed_items"), "error_message", "created_at", F.col("created_at").alias("started_at"), F.col("updated_at").alias("completed_at"))


JOBS = "jobs AS (SELECT 'job-' || id AS id, CASE status WHEN 'error' THEN 'failed' WHEN 'ready' THEN 'completed' WHEN 'processing' THEN 'running' ELSE 'queued' END AS status, CASE status WHEN 'ready' THEN 5 WHEN 'processing' THEN 2 ELSE 0 END AS completed_items, error_message, created_at FROM document_files)"


def any_file(spark, d) -> str:
    """The file with the most facts."""
    f = table(spark, d, "facts").where("document_id is not null").groupBy("document_id").agg(F.count(F.lit(1)).alias("n"))
    return f.orderBy(F.col("n").desc(), "document_id").first().document_id


def any_fact(spark, d) -> str:
    """The fact with the most relationships to other facts as their first."""
    facts = table(spark, d, "facts").select("id")
    r = table(spark, d, "relationships").where("fact_a_id <> fact_b_id").join(facts.withColumnRenamed("id", "fact_a_id"), "fact_a_id", "left_semi").join(facts.withColumnRenamed("id", "fact_b_id"), "fact_b_id", "left_semi")
    return r.groupBy("fact_a_id").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "fact_a_id").first().fact_a_id


@query(f"""WITH {LATEST} SELECT f.id, f.subject, f.predicate, f.value_text, f.extraction_confidence FROM lf f LEFT JOIN entities e ON e.id = f.entity_id
WHERE (coalesce(f.subject ILIKE '%mining%', false) OR coalesce(e.canonical_name ILIKE '%mining%', false)) AND f.predicate ILIKE '%revenue%' AND f.validation_status = 'validated' AND f.extraction_confidence >= 0.8 ORDER BY f.seq DESC LIMIT 50 OFFSET 10""")
def search_facts(spark, d):
    """A page of validated facts on a subject or entity and a metric, newest first (Q-2)."""
    return R.facts(tables(spark, d), entity="mining", predicate="revenue", status="validated", min_confidence=0.8, offset=10).select("id", "subject", "predicate", "value_text", "extraction_confidence")


@query(f"""WITH {LATEST} SELECT id, subject, predicate, extraction_confidence FROM lf WHERE document_id = {ANY_FILE} AND subject ILIKE '%e%' ORDER BY seq DESC LIMIT 20 OFFSET 2""")
def document_facts(spark, d):
    """A page of a document's facts by subject (Q-1)."""
    return R.facts(tables(spark, d), document_id=any_file(spark, d), subject="e", limit=20, offset=2).select("id", "subject", "predicate", "extraction_confidence")


@query(f"""WITH {LATEST} SELECT f.id, f.subject, f.value_text, f.geography, d.original_filename AS document_name, e.canonical_name AS entity_name FROM lf f LEFT JOIN document_files d ON d.id = f.document_id LEFT JOIN entities e ON e.id = f.entity_id
WHERE f.value_type = 'currency' AND (coalesce(f.subject ILIKE '%energy%', false) OR coalesce(f.predicate ILIKE '%energy%', false) OR coalesce(f.value_text ILIKE '%energy%', false) OR coalesce(e.canonical_name ILIKE '%energy%', false)) ORDER BY f.seq DESC LIMIT 50""")
def search_facts_joined(spark, d):
    """A page of facts of a type found in any of four columns, with their documents (Q-3)."""
    return R.search(tables(spark, d), "energy", value_type="currency").select("id", "subject", "value_text", "geography", "document_name", "entity_name")


@query(f"SELECT id, {_KIND} AS relationship_type, confidence FROM relationships WHERE {_KIND} = 'contradicts' AND confidence >= 0.7 ORDER BY confidence DESC NULLS LAST, created_at DESC NULLS LAST, id LIMIT 50")
def list_relationships(spark, d):
    """A page of relationships of a type above a confidence (Q-4)."""
    return R.relationships(tables(spark, d), kind="Contradicts", min_confidence=0.7).select("id", F.lower(X.strip(F.col("relationship_type"))).alias("relationship_type"), "confidence")


@query(f"SELECT id, fact_a_id, fact_b_id, primary_dimension FROM relationships WHERE fact_a_id = {ANY_FACT} OR fact_b_id = {ANY_FACT}")
def fact_relationships(spark, d):
    """All relationships of a fact, at either end (Q-4)."""
    return R.relationships(tables(spark, d), fact_id=any_fact(spark, d), limit=None).select("id", "fact_a_id", "fact_b_id", "primary_dimension")


@query(f"""WITH {LATEST} SELECT r.id, r.fact_a_id, r.fact_b_id, r.confidence FROM relationships r JOIN lf a ON a.id = r.fact_a_id JOIN lf b ON b.id = r.fact_b_id
WHERE (a.document_id = {ANY_FILE} OR b.document_id = {ANY_FILE}) AND r.confidence >= 0.2""")
def document_relationships(spark, d):
    """Relationships of a document on either side, both of whose facts exist (Q-5)."""
    return R.document_relationships(tables(spark, d), any_file(spark, d), min_confidence=0.2, limit=None).select("id", "fact_a_id", "fact_b_id", "confidence")


_SIDES = ", ".join(f"f{s}.{c} AS f{s}_{n}" for s in "ab" for c, n in R.FACT_COLUMNS.items()) + ", da.original_filename AS fa_doc_name, db.original_filename AS fb_doc_name"
_ENRICH = f"""WITH {LATEST} SELECT r.* EXCLUDE (created_at), epoch_us(r.created_at) AS created_us, {_SIDES}
FROM relationships r JOIN lf fa ON fa.id = r.fact_a_id JOIN lf fb ON fb.id = r.fact_b_id LEFT JOIN document_files da ON da.id = fa.document_id LEFT JOIN document_files db ON db.id = fb.document_id"""


def _flat(df):
    return df.withColumn("created_us", F.unix_micros("created_at")).drop("created_at")


@query(_ENRICH)
def relationships_enriched(spark, d):
    """All relationships with all columns of both facts and their documents (Q-6)."""
    return _flat(R.enriched(tables(spark, d), limit=None))


@query(_ENRICH + f" WHERE {_KIND} = 'uncertain'")
def uncertain_relationships(spark, d):
    """Relationships that are uncertain, with both facts and their documents (Q-12)."""
    return _flat(R.enriched(tables(spark, d), kind="uncertain", limit=None))


@query(_ENRICH + " WHERE " + " OR ".join(f"coalesce({c} ILIKE '%energy%', false)" for c in ("r.explanation", "fa.subject", "fb.subject", "fa.predicate", "fb.predicate", "da.original_filename", "db.original_filename")) + " ORDER BY r.created_at DESC NULLS LAST, r.id LIMIT 60 OFFSET 5")
def search_relationships(spark, d):
    """A page of relationships found in any of seven columns, newest first (Q-6)."""
    return _flat(R.enriched(tables(spark, d), kind="all", text="energy", sort="created_at", limit=60, offset=5))


@query(f"WITH {LATEST} SELECT count(*) AS n, r.id FROM relationships r JOIN lf fa ON fa.id = r.fact_a_id JOIN lf fb ON fb.id = r.fact_b_id WHERE fa.document_id <> fb.document_id GROUP BY r.id")
def cross_document_relationships(spark, d):
    """Relationships between facts of different documents."""
    f = latest_facts(spark, d).select("id", "document_id")
    r = table(spark, d, "relationships").select(F.col("id").alias("rid"), "fact_a_id", "fact_b_id")
    j = r.join(f.select(F.col("id").alias("fact_a_id"), F.col("document_id").alias("da")), "fact_a_id").join(f.select(F.col("id").alias("fact_b_id"), F.col("document_id").alias("db")), "fact_b_id")
    return j.where("da <> db").groupBy(F.col("rid").alias("id")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT id, title, status FROM document_files WHERE status = 'uploaded' ORDER BY created_at DESC NULLS LAST, id LIMIT 50 OFFSET 20")
def document_listing(spark, d):
    """A page of documents of a status, newest first (Q-7)."""
    return R.documents(tables(spark, d), status="uploaded", offset=20).select("id", "title", "status")


@query(f"SELECT id, page_number, length(raw_text) AS chars FROM pages WHERE document_id = {ANY_FILE}")
def page_listing(spark, d):
    """The pages of a document (Q-8)."""
    return R.pages(tables(spark, d), any_file(spark, d)).select("id", "page_number", F.length("raw_text").cast("bigint").alias("chars"))


@query(f"SELECT p.page_number, b.id, b.block_type, row_number() OVER (ORDER BY p.page_number NULLS FIRST, b.reading_order NULLS FIRST, b.block_index NULLS FIRST, b.id)::INT AS k FROM blocks b JOIN pages p ON p.id = b.page_id WHERE p.document_id = {ANY_FILE}")
def document_block_listing(spark, d):
    """The blocks of a document in reading order, numbered (Q-9)."""
    from pyspark.sql import Window as W

    # the window runs over the blocks of one document
    w = W.orderBy("page_number", "reading_order", "block_index", "id")
    return R.blocks(tables(spark, d), any_file(spark, d)).select("page_number", "id", "block_type", F.row_number().over(w).alias("k"))


@query("SELECT p.document_id, p.page_number, b.id, b.block_type, row_number() OVER (PARTITION BY p.document_id ORDER BY p.page_number NULLS FIRST, b.reading_order NULLS FIRST, b.block_index NULLS FIRST, b.id)::INT AS k FROM blocks b JOIN pages p ON p.id = b.page_id")
def block_listing(spark, d):
    """Blocks of every document in reading order, numbered (Q-9)."""
    from pyspark.sql import Window as W

    j = table(spark, d, "blocks").join(table(spark, d, "pages").select(F.col("id").alias("page_id"), "document_id", "page_number"), "page_id")
    w = W.partitionBy("document_id").orderBy("page_number", "reading_order", "block_index", "id")
    return j.select("document_id", "page_number", "id", "block_type", F.row_number().over(w).alias("k"))


@query(f"SELECT id, sequence_index, start_page, end_page, token_count FROM chunks WHERE document_id = {ANY_FILE}")
def chunk_listing(spark, d):
    """The chunks of a document (Q-10)."""
    return R.chunks(tables(spark, d), any_file(spark, d)).select("id", "sequence_index", "start_page", "end_page", "token_count")


@query("SELECT id, document_id, sequence_index, lag(id) OVER w AS previous_id, lead(id) OVER w AS next_id FROM chunks WINDOW w AS (PARTITION BY document_id ORDER BY sequence_index NULLS FIRST, id)")
def chunk_links(spark, d):
    """Chunks of every document in order, each with its neighbours (Q-10, K-9)."""
    from pyspark.sql import Window as W

    w = W.partitionBy("document_id").orderBy("sequence_index", "id")
    return table(spark, d, "chunks").select("id", "document_id", "sequence_index", F.lag("id").over(w).alias("previous_id"), F.lead("id").over(w).alias("next_id"))


@query(f"WITH {LATEST} SELECT f.id, f.validation_status, f.source_quote, d.original_filename AS document_name FROM lf f LEFT JOIN document_files d ON d.id = f.document_id WHERE f.validation_status IN ('rejected', 'warning')")
def rejected_and_warning(spark, d):
    """Facts that verification rejected or doubts, with their documents (Q-11)."""
    t = tables(spark, d)
    both = R.doubtful_facts(t, "rejected").unionByName(R.doubtful_facts(t, "warning"))
    return both.select("id", "validation_status", "source_quote", "document_name")


@query(f"WITH {JOBS} SELECT id, status, error_message FROM jobs WHERE status = 'failed'")
def failed_jobs(spark, d):
    """Jobs that failed (Q-13)."""
    return R.jobs(tables(spark, d), status="failed", limit=None).select("id", "status", "error_message")


@query(f"WITH {JOBS} SELECT id, status FROM jobs ORDER BY created_at DESC NULLS LAST, id LIMIT 20")
def recent_jobs(spark, d):
    """The newest jobs (Q-13)."""
    return R.jobs(tables(spark, d)).select("id", "status")


@query(f"WITH {JOBS} SELECT id, status, round(completed_items / 5.0, 2)::DOUBLE AS progress, completed_items, 5 AS total_items FROM jobs WHERE id = 'job-' || {ANY_FILE}")
def job_status(spark, d):
    """State and progress of a job (Q-15)."""
    return R.job_status(tables(spark, d), "job-" + any_file(spark, d)).select("id", "status", "progress", "completed_items", "total_items")


@query("SELECT p.id, p.page_number, p.text_quality, length(p.raw_text)::INT AS raw_len, d.original_filename AS document_name FROM pages p LEFT JOIN document_files d ON d.id = p.document_id WHERE p.is_scanned OR p.text_quality < 0.3")
def low_quality_pages(spark, d):
    """Scanned pages and pages of poor text (Q-14)."""
    return R.low_quality_pages(tables(spark, d)).select("id", "page_number", "text_quality", "raw_len", "document_name")


@query("SELECT id FROM (SELECT fact_a_id AS id FROM relationships WHERE fact_a_id IS NOT NULL UNION SELECT fact_b_id FROM relationships WHERE fact_b_id IS NOT NULL) WHERE id NOT IN (SELECT id FROM facts WHERE id IS NOT NULL)")
def missing_ids(spark, d):
    """Ends of relationships that are no facts (Q-16)."""
    r = table(spark, d, "relationships")
    return R.missing(r.select(F.explode(F.array("fact_a_id", "fact_b_id")).alias("id")), table(spark, d, "facts"))


@query(f"WITH {JOBS} SELECT id, CASE WHEN id IN (SELECT id FROM document_files) THEN 'document' WHEN id IN (SELECT id FROM jobs) THEN 'job' ELSE 'missing' END AS target FROM (SELECT fact_a_id AS id FROM relationships WHERE fact_a_id IS NOT NULL UNION SELECT document_id FROM pages WHERE document_id IS NOT NULL UNION SELECT 'job-' || document_id FROM pages WHERE document_id IS NOT NULL)")
def target_dispatch(spark, d):
    """What each of a set of ids is: a document, a job or missing (Q-17)."""
    p = table(spark, d, "pages").where("document_id is not null")
    ids = table(spark, d, "relationships").select(F.col("fact_a_id").alias("id")).unionByName(p.select(F.explode(F.array("document_id", F.concat(F.lit("job-"), "document_id"))).alias("id")))
    return R.targets(tables(spark, d), ids)


@query(f"""{_BASE} SELECT a_id, b_id, {_OUT} AS relationship_type, {_DIM} AS primary_dimension FROM z WHERE a_id = {ANY_FACT} AND b_id = (SELECT min(fact_b_id) FROM relationships WHERE fact_a_id = {ANY_FACT} AND fact_a_id <> fact_b_id AND fact_b_id IN (SELECT id FROM facts))""")
def reconcile_pair(spark, d):
    """The comparison of two facts by their ids (Q-18)."""
    a = any_fact(spark, d)
    b = table(spark, d, "relationships").where((F.col("fact_a_id") == a) & (F.col("fact_b_id") != a)).join(table(spark, d, "facts").select(F.col("id").alias("fact_b_id")), "fact_b_id", "left_semi").agg(F.min("fact_b_id")).first()[0]
    return R.reconcile(tables(spark, d), a, b).select("a_id", "b_id", F.col("d.type").alias("relationship_type"), F.col("d.dimension").alias("primary_dimension"))


# ---- candidates --------------------------------------------------------------------------------------------------------


_SCORED = f"""{_BASE}, sc AS (SELECT *, CASE WHEN d_entity THEN 1.0 ELSE 0.0 END AS es, CASE WHEN pa = pb THEN 1.0 WHEN d_family THEN 0.91 ELSE 0.0 END AS ps, CASE WHEN ya IS NOT NULL AND yb IS NOT NULL THEN ya = yb WHEN sta OR stb THEN true END AS period FROM z),
cp AS (SELECT *, round(least(1.0, 0.30 * es + 0.30 * ps + CASE WHEN period IS NULL THEN 0.05 WHEN period THEN 0.10 ELSE 0.0 END + CASE WHEN a_document_id = b_document_id THEN 0.0 ELSE 0.05 END), 2)::DOUBLE AS score FROM sc)"""


def scored_pairs(spark, d):
    """The pairs that relationships name, in the form of candidates, by a score without vectors
    and without the similarity of different names."""
    p = related_pairs(spark, d)
    es, ps, none = F.when(PR.same_entity(), 1.0).otherwise(0.0), PR.predicate_similarity(F.lit(0.0)), F.lit(0.0)
    return p.select("a_id", "b_id", "a_document_id", "b_document_id", es.alias("entity_similarity"), ps.alias("predicate_similarity"), none.alias("semantic"), PR.period_compatible().alias("period"), PR.pair_score(es, ps, none).alias("score"), PR.reasons(es, ps, none).alias("reasons"))


@query(f"""{_SCORED} SELECT a_id, b_id, score, array_to_string(list_filter([CASE WHEN d_entity THEN 'same canonical entity' END, CASE WHEN pa = pb THEN 'exact predicate match: ' || pa WHEN ps >= 0.7 THEN 'predicate semantic similarity 0.91' END,
  CASE WHEN ya = yb THEN 'same fiscal year' WHEN (ya IS NULL OR yb IS NULL) AND a_time_start <> '' AND a_time_end <> '' AND a_time_start = b_time_start AND a_time_end = b_time_end THEN 'identical time period' END,
  CASE WHEN sa <> '' AND sa = sb THEN 'same scope ' || sa WHEN ga <> '' AND ga = gb THEN 'same geography ' || ga END, CASE WHEN ca <> '' AND ca = cb THEN 'same currency ' || ca END, CASE WHEN ua <> '' AND ua = ub THEN 'same unit ' || ua END], lambda x: x IS NOT NULL), '; ') AS reasons FROM cp""")
def candidate_reasons(spark, d):
    """Why each related pair would be selected (C-1 to C-6)."""
    return scored_pairs(spark, d).select("a_id", "b_id", "score", F.array_join("reasons", "; ").alias("reasons"))


@query(f"""{_SCORED}, own AS (SELECT id FROM facts WHERE document_id = {ANY_FILE})
SELECT DISTINCT least(a_id, b_id) AS fact_a_id, greatest(a_id, b_id) AS fact_b_id, coalesce(a_document_id = b_document_id, false) AS same_document, score AS candidate_score, period AS period_compatible, 'pending' AS status FROM cp WHERE score >= 0.4 AND (a_id IN (SELECT id FROM own) OR b_id IN (SELECT id FROM own))""")
def candidate_listing(spark, d):
    """Candidate pairs of a document above a score (C-9)."""
    t = tables(spark, d) | {"candidate_pairs": PR.candidate_rows(scored_pairs(spark, d))}
    return R.candidates(t, document_id=any_file(spark, d), status="pending", min_score=0.4, limit=None).select("fact_a_id", "fact_b_id", "same_document", "candidate_score", "period_compatible", "status")


@query(f"""{_BASE}, un AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY least(a_id, b_id), greatest(a_id, b_id) ORDER BY a_id) AS rn FROM z WHERE a_id < b_id) WHERE branch <> 'rejected')
SELECT a_id AS fact_a_id, b_id AS fact_b_id, {_OUT} AS relationship_type, {_DIM} AS primary_dimension, 'evaluated' AS status FROM un WHERE a_document_id = {ANY_FILE} OR b_document_id = {ANY_FILE}""")
def evaluate_candidates(spark, d):
    """The pending candidates of a document, evaluated, and their status after it (R-13, S-10)."""
    t, scratch = tables(spark, d), Scratch(spark, "evaluate")
    rows = scratch.write(PR.candidate_rows(scored_pairs(spark, d).where("a_id < b_id")))
    made, after = PR.evaluate(rows, t["facts"], t["entities"], document_id=any_file(spark, d))
    return made.join(after.select("fact_a_id", "fact_b_id", "status"), ["fact_a_id", "fact_b_id"]).select("fact_a_id", "fact_b_id", "relationship_type", "primary_dimension", "status")


def _shown(a: str, b: str, name: str, match: str) -> str:
    return f"{{'dimension': '{name}', 'fact_a': coalesce(nullif({a}, ''), '-'), 'fact_b': coalesce(nullif({b}, ''), '-'), 'match': coalesce({match}, false)}}"


@query(f"""{_BASE}, r AS (SELECT a_id, b_id, unnest([{_shown('coalesce(a_name, a_subject)', 'coalesce(b_name, b_subject)', 'Entity', 'd_entity')}, {_shown('a_predicate', 'b_predicate', 'Metric', 'd_predicate')}, {_shown('a_time_text', 'b_time_text', 'Time Period', 'd_period')}, {_shown('a_geography', 'b_geography', 'Geography', 'd_geo')},
  {_shown("coalesce(nullif(a_unit, ''), nullif(a_currency, ''))", "coalesce(nullif(b_unit, ''), nullif(b_currency, ''))", 'Unit / Currency', 'd_unit AND d_currency')}, {_shown('a_scope', 'b_scope', 'Scope', 'd_scope')}]) AS r FROM z)
SELECT a_id, b_id, r.dimension AS dimension, r.fact_a AS fact_a, r.fact_b AS fact_b, r.match AS match FROM r""")
def comparison_rows(spark, d):
    """The six rows that show each compared pair (T-16)."""
    c = PR.compare(related_pairs(spark, d)).select("a_id", "b_id", F.explode(PR.comparison_rows()).alias("r"))
    return c.select("a_id", "b_id", "r.dimension", "r.fact_a", "r.fact_b", F.col("r.match").alias("match"))


def _lines(s: str) -> str:
    or_ = lambda c, d: f"coalesce(nullif({s}_{c}, ''), '{d}')"
    return f"""concat_ws(chr(10), 'Entity: ' || coalesce({s}_name, {s}_subject, 'N/A'), 'Metric: ' || {or_('predicate', 'N/A')}, 'Value: ' || {or_('value_text', 'N/A')}, 'Unit: ' || coalesce(nullif({s}_normalized_unit, ''), nullif({s}_unit, ''), 'N/A'), 'Currency: ' || {or_('currency', 'N/A')},
  'Period: ' || {or_('time_text', 'N/A')}, 'Scope: ' || {or_('scope', 'unspecified')}, 'Geography: ' || {or_('geography', 'unspecified')}, 'Qualifiers: ' || nullif({s}_qualifiers_json, ''))"""


@query(f"""{_BASE} SELECT a_id, b_id, 'Fact A' || chr(10) || {_lines('a')} || chr(10) || chr(10) || 'Fact B' || chr(10) || {_lines('b')} || chr(10) || chr(10) || 'Decide from these facts alone: corroborates, contradicts, reconciles, uncertain or unrelated; name the dimension that decides and say why.' AS prompt FROM z WHERE branch = 'open'""")
def pair_prompts(spark, d):
    """The text that a judge gets for each pair that the comparison leaves open (R-15), but for the
    line with the normalised number, which engines print differently."""
    open_ = PR.compare(related_pairs(spark, d)).where("d.branch = 'open'")
    return open_.select("a_id", "b_id", F.regexp_replace(PR.pair_prompt(), r"\nNormalized: [^\n]*", "").alias("prompt"))
