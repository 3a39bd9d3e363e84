"""A small invented corpus with known outcomes (S-15, R-16)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factweave import schemas
from factweave.operators import facts as FA, pairs as PR
from factweave.plans.pipeline import normalized

# (case, subject, predicate, value of A, time of A, value of B, time of B, status of B, expected type, expected dimension)
CASES = [
    ("same amount in other words", "Northwind Mills", "total revenue", "$120 million", "FY2025", "120,000 thousand USD", "Fiscal Year 2025", "validated", "corroborates", "value"),
    ("two headcounts", "Northwind Mills", "headcount", "15,000", "FY2024", "11,200", "FY2024", "validated", "contradicts", "value"),
    ("year and quarter", "Northwind Mills", "revenue", "$500M", "FY2024", "$140M", "Q4 FY2024", "validated", "reconciles", "time"),
    ("invented quote", "Northwind Mills", "net income", "$9M", "FY2024", "$11M", "FY2024", "rejected", "uncertain", "value"),
]


def tables(spark: SparkSession) -> dict[str, DataFrame]:
    """Facts, entities and files of the demonstration."""
    rows = []
    for k, (_, subject, pred, va, ta, vb, tb, status, *_x) in enumerate(CASES):
        for s, v, t, ok in (("a", va, ta, "validated"), ("b", vb, tb, status)):
            rows.append((f"{k}{s}", f"doc {s}", subject, pred, v, "currency" if "$" in v or "USD" in v else "number", t, ok, 2 * k + (s == "b")))
    f = spark.createDataFrame(rows, "id string, document_id string, subject string, predicate string, value_text string, value_type string, time_text string, validation_status string, seq long")
    names = [c.strip().split(" ") for c in schemas.TABLES["facts"].split(",")]
    facts = f.select(*(F.col(n) if n in f.columns else F.lit(None).cast(t).alias(n) for n, t in names))
    return {"facts": facts, "entities": spark.createDataFrame([], schemas.TABLES["entities"]), "document_files": spark.createDataFrame([], schemas.TABLES["document_files"])}


def corpus(spark: SparkSession) -> dict[str, DataFrame]:
    """The demonstration as a small store (S-15): the facts above and some more, their documents,
    chunks and entities, relationships between them and a finished job."""
    t = tables(spark)
    fields = lambda name: [c.strip().split(" ")[0] for c in schemas.TABLES[name].split(",")]

    def rows(name: str, records: list[dict]) -> DataFrame:
        return spark.createDataFrame([tuple(r.get(f) for f in fields(name)) for r in records], schemas.TABLES[name])

    files = [dict(id=f"doc {s}", filename=f"{s}.pdf", original_filename=f"Northwind {s}.pdf", sha256=str(n) * 64, page_count=1, title=f"Northwind report {s}", status="ready", metadata_json='{"fiscal_year_end": "12-31"}') for n, s in enumerate("abc")]
    entities = [dict(id="e1", canonical_name="Northwind Mills", entity_type="company", confidence=1.0), dict(id="e2", canonical_name="Southgate Dairy", entity_type="company", confidence=1.0), dict(id="e3", canonical_name="Ada Quill", entity_type="person", confidence=1.0)]
    more = [dict(id=f"m{k}", document_id="doc c", chunk_id="chunk c", subject=n, predicate=p, value_text=v, value_type="text" if p == "ceo" else "currency", time_text=y, validation_status="validated", extraction_confidence=0.9, seq=20 + k)
            for k, (n, p, v, y) in enumerate([("Northwind Mills", "total revenue", "USD 120 million", "FY2025"), ("Southgate Dairy", "net income", "€4M", "FY2024"), ("Southgate Dairy", "ceo", "Ada Quill", "2024"), ("Northwind Mills", "net sales", "$480M", "FY2024"), ("Southgate Dairy", "headcount", "310", "FY2024")])]
    facts = t["facts"].withColumn("chunk_id", F.concat(F.lit("chunk "), F.substring("document_id", -1, 1))).unionByName(rows("facts", more))
    names = spark.createDataFrame([(e["canonical_name"], e["id"]) for e in entities], "subject string, own string")
    facts = facts.join(names, "subject", "left").withColumn("entity_id", F.col("own")).select(*fields("facts"))
    texts = facts.groupBy("document_id", "chunk_id").agg(F.array_join(F.array_sort(F.collect_set(F.concat_ws(" ", "subject", "predicate", "value_text", "time_text"))), ".\n").alias("text"))
    chunks = texts.select(*(F.col("chunk_id").alias(n) if n == "id" else F.col(n) if n in texts.columns else F.lit(0 if n == "sequence_index" else 1).cast(k).alias(n) if k == "int" else F.lit(None).cast(k).alias(n) for n, k in (c.strip().split(" ") for c in schemas.TABLES["chunks"].split(","))))
    pairs = [(f"{k}a", f"{k}b") for k in range(len(CASES))] + [("0a", "m0"), ("2a", "m3")]
    ids = spark.createDataFrame(pairs, "fact_a_id string, fact_b_id string")
    f = PR.with_entity(normalized(FA.latest(facts, ["id"], F.col("seq")), rows("document_files", files)), rows("entities", entities))
    made, _ = PR.evaluate(PR.candidate_rows(_plain(PR.pair_up(ids, f))), normalized(facts, rows("document_files", files)), rows("entities", entities))
    related = made.select(*(F.col(n) if n in made.columns else F.lit(None).cast(k).alias(n) for n, k in (c.strip().split(" ") for c in schemas.TABLES["relationships"].split(","))))
    job = [dict(id="job 1", job_type="full", document_ids=[x["id"] for x in files], status="completed", progress=1.0, current_stage="relate", total_items=11, completed_items=11)]
    return {"document_files": rows("document_files", files), "entities": rows("entities", entities), "facts": facts, "chunks": chunks, "relationships": related, "jobs": rows("jobs", job)}


def _plain(pairs: DataFrame) -> DataFrame:
    """Pairs in the form of candidates, without vectors."""
    one, none = F.lit(1.0), F.lit(0.0)
    return pairs.select("a_id", "b_id", "a_document_id", "b_document_id", one.alias("entity_similarity"), PR.predicate_similarity(none).alias("predicate_similarity"), none.alias("semantic"), PR.period_compatible().alias("period"), PR.pair_score(one, PR.predicate_similarity(none), none).alias("score"), PR.reasons(one, PR.predicate_similarity(none), none).alias("reasons"))


def scorecard(spark: SparkSession) -> DataFrame:
    """(case, expected, actual, passed) of the four known cases."""
    t = tables(spark)
    f = PR.with_entity(normalized(FA.latest(t["facts"], ["id"], F.col("seq")), t["document_files"]), t["entities"])
    cases = spark.createDataFrame([(c[0], f"{k}a", f"{k}b", f"{c[8]}/{c[9]}") for k, c in enumerate(CASES)], "case string, fact_a_id string, fact_b_id string, expected string")
    d = PR.compare(PR.pair_up(cases, f)).withColumn("actual", F.concat_ws("/", "d.type", "d.dimension"))
    return d.select("case", "expected", "actual", (F.col("expected") == F.col("actual")).alias("passed"))
