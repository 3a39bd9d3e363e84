"""Tables of the data model, their enumerations and contracts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: DDL of each table.
TABLES = {
    "document_files": "id string, filename string, original_filename string, sha256 string, file_size bigint, page_count int, title string, document_type string, published_date string, reporting_period string, publisher string, status string, error_message string, metadata_json string, created_at timestamp, updated_at timestamp",
    "pages": "id string, document_id string, page_number int, width double, height double, raw_text string, cleaned_text string, text_quality double, is_scanned boolean, metadata_json string",
    "blocks": "id string, page_id string, block_index int, block_type string, text string, x0 double, y0 double, x1 double, y1 double, reading_order int, content_hash string, metadata_json string",
    "chunks": "id string, document_id string, sequence_index int, start_page int, end_page int, block_ids_json string, heading_path_json string, text string, token_count int, previous_chunk_id string, next_chunk_id string, has_table boolean, has_low_quality_page boolean, content_hash string, extraction_status string",
    "facts": "id string, document_id string, chunk_id string, subject string, subject_mention string, entity_id string, predicate string, predicate_mention string, value_text string, value_type string, numeric_value double, normalized_numeric_value double, unit string, normalized_unit string, currency string, time_text string, time_start string, time_end string, time_granularity string, scope string, geography string, qualifiers_json string, source_quote string, source_page_start int, source_page_end int, source_block_ids_json string, extraction_confidence double, validation_status string, extraction_notes_json string, created_at timestamp, seq bigint",
    "entities": "id string, canonical_name string, entity_type string, confidence double, metadata_json string, created_at timestamp",
    "entity_aliases": "id string, entity_id string, alias string, confidence double, created_at timestamp",
    "fact_embeddings": "id string, fact_id string, model string, dimensions int, vector array<float>, content_hash string, created_at timestamp",
    "candidate_pairs": "id string, fact_a_id string, fact_b_id string, same_document boolean, entity_similarity double, predicate_similarity double, semantic_similarity double, unit_compatible boolean, period_compatible boolean, scope_compatible boolean, candidate_score double, reasons array<string>, status string, created_at timestamp",
    "relationships": "id string, fact_a_id string, fact_b_id string, relationship_type string, confidence double, primary_dimension string, context_comparison_json string, explanation string, evidence_fact_a string, evidence_fact_b string, reasoning_version string, created_at timestamp",
    "jobs": "id string, job_type string, document_ids array<string>, status string, progress double, current_stage string, total_items int, completed_items int, error_message string, created_at timestamp, started_at timestamp, completed_at timestamp",
    "llm_cache": "id string, operation string, model string, prompt_version string, input_hash string, response_json string, created_at timestamp",
}

# Closed domains.
DOMAINS = {
    ("document_files", "status"): "uploaded processing ready error", ("blocks", "block_type"): "paragraph heading table caption list header footer unknown image", ("facts", "value_type"): "number currency percentage date duration boolean text quantity range",
    ("facts", "time_granularity"): "day month quarter half year fiscal_year unknown", ("facts", "validation_status"): "validated warning rejected", ("chunks", "extraction_status"): "pending processing completed failed",
    ("entities", "entity_type"): "person organization company location product other", ("relationships", "relationship_type"): "corroborates contradicts reconciles uncertain unrelated",
    ("relationships", "primary_dimension"): "value time scope unit entity definition geography other", ("candidate_pairs", "status"): "pending evaluated skipped", ("jobs", "job_type"): "full extraction relationship reprocess", ("jobs", "status"): "queued running completed failed",
}
RANGES = {("facts", "extraction_confidence"), ("entities", "confidence"), ("entity_aliases", "confidence"), ("relationships", "confidence")}


def violations(name: str) -> Column:
    """Names of the columns of a row that break a contract of table ``name``, as an array."""
    checks = [F.when(~F.col(c).isin(*d.split()), F.lit(c)) for (t, c), d in DOMAINS.items() if t == name]
    checks += [F.when(~F.col(c).between(0.0, 1.0), F.lit(c)) for t, c in RANGES if t == name]
    return F.array_compact(F.array(*checks)) if checks else F.array().cast("array<string>")


def contract_report(df: DataFrame, name: str) -> DataFrame:
    """(column, rows): how many rows break each contract."""
    return df.select(F.explode(violations(name)).alias("column")).groupBy("column").agg(F.count(F.lit(1)).alias("rows"))
