"""Facts: normalisation, latest delivery, duplicates within a document (N-7, A)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factweave.functions import normalize as N
from factweave.functions.text import filled, folded


def latest(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The last row of each key (S-9); ``order`` must tell rows of a key apart."""
    cols = df.columns
    packed = df.groupBy(*keys).agg(F.max_by(F.struct(*cols), F.struct(*order)).alias("__r"))
    return packed.select("__r.*")


def document_year_ends(files: DataFrame) -> DataFrame:
    """(document_id, fiscal_year_end) that documents state; malformed metadata give null (N-8)."""
    return files.select(F.col("id").alias("document_id"), F.get_json_object("metadata_json", "$.fiscal_year_end").alias("fiscal_year_end"))


def normalize_facts(facts: DataFrame, files: DataFrame) -> DataFrame:
    """Facts with n_* columns: number, period and predicate in normal form (N-7)."""
    f = facts.join(document_year_ends(files), "document_id", "left")
    f = N.with_numeric(f, "n", F.col("value_text"), F.col("unit"), F.col("currency"), F.col("value_type"))
    f = f.withColumns({"p": N.period(F.col("time_text"), F.col("fiscal_year_end")), "q": N.predicate(F.col("predicate"))})
    return f.withColumns({
        "n_value": F.col("n.normalized"), "n_unit": F.col("n.normalized_unit"), "n_currency": F.col("n.currency"), "n_type": F.col("n.value_type"),
        "n_time_text": F.col("p.time_text"), "n_time_start": F.col("p.time_start"), "n_time_end": F.col("p.time_end"), "n_granularity": F.col("p.time_granularity"), "n_predicate": F.col("q.predicate"),
        "predicate_mention": F.coalesce(filled(F.col("predicate_mention")), F.col("predicate")), "stem": N.legal_stem(F.col("subject")),
    }).drop("n", "p", "q")


def json_list(c: Column) -> Column:
    """The strings of a JSON list; null, malformed and other JSON give an empty list."""
    return F.coalesce(F.from_json(c, "array<string>"), F.array().cast("array<string>"))


def dedup_key(value: str = "normalized_numeric_value", unit: str = "normalized_unit", time: str = "time_text", start: str = "time_start", end: str = "time_end") -> dict[str, Column]:
    """What two claims of a document must share to be one (A-1)."""
    return {
        "k_subject": F.coalesce(filled(F.col("entity_id")), folded(F.col("subject"))),
        "k_predicate": folded(F.col("predicate")),
        "k_value": F.coalesce(F.concat(F.lit("number "), F.round(value, 6).cast("string")), F.concat(F.lit("text "), folded(F.col("value_text")))),
        "k_unit": folded(F.coalesce(filled(F.col(unit)), filled(F.col("unit")), filled(F.col("currency")))),
        "k_time": folded(F.col(time)), "k_start": F.coalesce(start, F.lit("")), "k_end": F.coalesce(end, F.lit("")),
        "k_scope": folded(F.col("scope")), "k_geo": folded(F.col("geography")), "k_quals": F.array_join(F.array_sort(json_list(F.col("qualifiers_json"))), "\u0001"),
    }


def merge_duplicates(facts: DataFrame, **key) -> DataFrame:
    """One row per distinct claim of a document (A-2): (fact_id, document_id, n_claims,
    block_ids, page_start, page_end, quotes, notes, confidence, status).

    The first claim by ``seq`` gives id and status; blocks are united, pages span,
    quotes follow in order without repeats, confidence is the highest. A group is
    the copies of one claim in one document: what is aggregated is only their
    evidence, after a map-side part.
    """
    f = facts.withColumns(dedup_key(**key))
    ks = [c for c in f.columns if c.startswith("k_")]
    g = f.groupBy("document_id", *ks).agg(
        F.min_by(F.struct("id", "validation_status"), "seq").alias("first"), F.count(F.lit(1)).alias("n_claims"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set(json_list(F.col("source_block_ids_json")))))).alias("block_ids"),
        F.min("source_page_start").alias("page_start"), F.max("source_page_end").alias("page_end"),
        F.transform(F.sort_array(F.collect_list(F.struct("seq", "source_quote"))), lambda s: s["source_quote"]).alias("quotes"),
        F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("seq", json_list(F.col("extraction_notes_json")).alias("n")))), lambda s: s["n"])).alias("notes"), F.max("extraction_confidence").alias("confidence"),
    )
    note = F.concat(F.lit("Deduplicated from "), F.col("n_claims"), F.lit(" identical claims across pages "), F.col("page_start"), F.lit("–"), F.col("page_end"), F.lit("."))
    return g.select(
        F.col("first.id").alias("fact_id"), "document_id", "n_claims", F.array_join("block_ids", ",").alias("block_ids"), "page_start", "page_end",
        F.array_join(F.array_distinct(F.filter("quotes", lambda q: q != "")), " | ").alias("quotes"),
        F.array_join(F.when(F.col("n_claims") > 1, F.array_append("notes", note)).otherwise(F.col("notes")), " | ").alias("notes"), "confidence", F.col("first.validation_status").alias("status"),
    )


def resolve_entities(facts: DataFrame, entities: DataFrame, aliases: DataFrame) -> DataFrame:
    """(name, entity_id, way) of each distinct subject (N-6): the entity with that name,
    else with that alias, else with that legal stem; else a new one whose id comes
    from the stem. A generic mention is always new and uncertain.

    Where several entities qualify the smallest id is taken. Null and blank subjects
    count as `Unknown Entity`.
    """
    names = facts.select(N.clean_name(F.col("subject")).alias("name")).distinct()
    names = names.withColumns({"low": F.lower("name"), "stem": F.lower(N.legal_stem(F.col("name"))), "generic": N.is_generic(F.col("name"))})
    e = entities.where("id is not null and canonical_name is not null").select(F.col("id").alias("entity_id"), F.lower(N.clean_name(F.col("canonical_name"))).alias("low"), F.lower(N.legal_stem(F.col("canonical_name"))).alias("stem"))
    by_name = e.groupBy("low").agg(F.min("entity_id").alias("by_name"))
    by_alias = aliases.where("alias is not null").groupBy(F.lower(N.clean_name(F.col("alias"))).alias("low")).agg(F.min("entity_id").alias("by_alias"))
    by_stem = e.where(F.length("stem") >= 3).groupBy("stem").agg(F.min("entity_id").alias("by_stem"))
    j = names.join(by_name, "low", "left").join(by_alias, "low", "left").join(by_stem, "stem", "left")
    key = F.when(F.length("stem") >= 3, F.col("stem")).otherwise(F.col("low"))
    new = F.concat(F.lit("new:"), F.substring(F.sha2(key, 256), 1, 16))
    way = F.when(F.col("generic"), "generic").when(F.col("by_name").isNotNull(), "name").when(F.col("by_alias").isNotNull(), "alias").when(F.col("by_stem").isNotNull(), "stem").otherwise("new")
    found = F.coalesce("by_name", "by_alias", "by_stem", new)
    conf = F.when(way == "generic", 0.5).when(way == "stem", 0.95).otherwise(1.0)
    return j.select("name", F.when(F.col("generic"), F.concat(F.lit("generic:"), F.col("low"))).otherwise(found).alias("entity_id"), way.alias("way"), conf.alias("confidence"))


def with_entities(facts: DataFrame, entities: DataFrame, aliases: DataFrame) -> DataFrame:
    """Facts whose missing entity ids are resolved by their subject (N-6, N-7); ids of new
    entities aren't among ``entities``, so their name is the subject and their type unknown."""
    missing = filled(F.col("entity_id")).isNull()
    r = resolve_entities(facts.where(missing), entities, aliases).select("name", F.col("entity_id").alias("__resolved"))
    # facts with an id stay out of the join: their null names would all meet in one task
    f = facts.where(missing).withColumn("name", N.clean_name(F.col("subject"))).join(r, "name", "left")
    return facts.where(~missing).select(*facts.columns).unionByName(f.withColumn("entity_id", F.col("__resolved")).select(*facts.columns))
