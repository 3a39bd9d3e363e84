"""The stages of a job over sets of documents (W-2).

Each stage is a plan over all selected documents; the driver only strings them
together and logs one row per stage. Modes: `full` and `reprocess` make chunks and
facts anew, the others take those that exist. Facts of documents without pages among
the tables aren't of the run and stay as they are.
"""

from __future__ import annotations

import datetime as dt
import threading
import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factweave import schemas
from factweave.operators import chunking, facts as FA, pairs as PR, verify as VF
from factweave.session import Scratch


def normalized(facts: DataFrame, files: DataFrame) -> DataFrame:
    """Facts with their number, unit, period and predicate replaced by the normal forms."""
    f = FA.normalize_facts(facts, files)
    pairs = {"normalized_numeric_value": "n_value", "normalized_unit": "n_unit", "currency": "n_currency", "time_text": "n_time_text", "time_start": "n_time_start", "time_end": "n_time_end", "time_granularity": "n_granularity", "predicate": "n_predicate"}
    return f.withColumns({k: F.col(v) for k, v in pairs.items()}).select(*facts.columns)


def merged(facts: DataFrame) -> DataFrame:
    """One fact per distinct claim of a document, with the first claim's columns."""
    kept = FA.merge_duplicates(facts).select(F.col("fact_id").alias("id"))
    return facts.join(kept, "id", "left_semi")


def prepared(facts: DataFrame, files: DataFrame, entities: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """The facts that are paired: last delivery of each, in normal form and with their
    entity, one per claim. Without ``aliases`` none are known."""
    if aliases is None:
        aliases = facts.sparkSession.createDataFrame([], schemas.TABLES["entity_aliases"])
    return merged(FA.with_entities(normalized(FA.latest(facts, ["id"], F.col("created_at"), F.col("seq")), files), entities, aliases))


def assembled(extracted: DataFrame, chunks: DataFrame, blocks: DataFrame, pages: DataFrame) -> DataFrame:
    """Claims of an extractor as rows of the facts table, their quotes verified against the
    chunks (V-5 to V-8).

    ``extracted`` has chunk_id, k (the place of a claim in its chunk, which gives its id) and
    any columns of the facts table, or `confidence` and `notes` for those of the extraction.
    ``seq`` follows the chunks of a document.
    """
    e = extracted.join(chunks.select(F.col("id").alias("chunk_id"), F.col("document_id").alias("__document"), "sequence_index"), "chunk_id")
    seq = F.shiftleft(F.coalesce("sequence_index", F.lit(0)).cast("bigint"), 32) + F.col("k")
    e = e.withColumns({"id": F.substring(F.sha2(F.concat_ws("::", "chunk_id", "k"), 256), 1, 32), "seq": seq, "document_id": F.col("__document")})
    v = VF.verify_facts(e, chunks, blocks, pages).select(F.col("fact_id").alias("id"), "status", "note", "block_ids", F.col("start_page").alias("__start"), F.col("end_page").alias("__end"))
    or_null = lambda c: F.col(c) if c in extracted.columns else F.lit(None).cast("string")
    made = {
        "source_page_start": F.col("__start"), "source_page_end": F.col("__end"), "source_block_ids_json": F.to_json("block_ids"), "validation_status": F.col("status"),
        "extraction_notes_json": F.to_json(F.array_compact(F.array(F.col("note"), or_null("notes")))), "created_at": F.current_timestamp(), "id": F.col("id"), "seq": F.col("seq"), "document_id": F.col("document_id"),
    }
    if "extraction_confidence" not in extracted.columns:
        made["extraction_confidence"] = or_null("confidence")
    names = [c.strip().split(" ") for c in schemas.TABLES["facts"].split(",")]
    return e.join(v, "id").select(*((made[n] if n in made else or_null(n)).cast(t).alias(n) for n, t in names))


def related(facts: DataFrame, entities: DataFrame, queries: str | None = None, min_score: float = 0.6, k: int = 10, exact: bool = False) -> DataFrame:
    """(a_id, b_id, relationship_type, primary_dimension, confidence, explanation) of the
    candidates of ``prepared`` facts: the ``k`` best of either end among all facts or, with
    ``queries``, those of the facts for which that condition holds.

    With ``queries`` or ``exact`` nothing is lost: each (query) fact is compared with all
    facts, in blocks. Else, as that work grows with the square of the facts, facts of different
    entities meet only where their names share a word and are alike (``pairs.name_pairs``).
    """
    scratch = Scratch(facts.sparkSession, "related")
    facts = scratch.write(facts)
    f = PR.with_entity(facts, entities)
    if queries is not None or exact:
        c = PR.search_candidates(facts, entities, facts if queries is None else facts.where(queries), scratch, min_score, k)
        if queries is None:
            c = c.select(F.least("a_id", "b_id").alias("a_id"), F.greatest("a_id", "b_id").alias("b_id")).distinct()
    else:
        c = PR.candidates(facts, entities, min_score=min_score, k=k, similar_names=scratch.write(PR.name_pairs(f)))
    c = scratch.write(c.select("a_id", "b_id"))
    j = PR.pair_up(c.withColumnsRenamed({"a_id": "fa", "b_id": "fb"}), f, "fa", "fb")
    d = PR.compare(j).where("d.branch <> 'rejected'")
    return d.select("a_id", "b_id", F.col("d.type").alias("relationship_type"), F.col("d.dimension").alias("primary_dimension"), F.col("d.confidence").alias("confidence"), "explanation")


def relationships(facts: DataFrame, entities: DataFrame, files: DataFrame, queries: str | None = None, min_score: float = 0.6, k: int = 10, aliases: DataFrame | None = None) -> DataFrame:
    """``related`` of facts as they were delivered."""
    return related(prepared(facts, files, entities, aliases), entities, queries, min_score, k)


class Job:
    """A run over documents: chunk, extract and verify, normalise, pair, decide.

    ``extract`` maps chunks to claims (see ``assembled``) and defaults to the offline
    extractor; a network provider is given the same way (``sources.providers``). ``exact``
    relates facts without loss (see ``related``). ``log``
    holds one (stage, status, seconds, message) per stage; a failing stage, or one whose
    input is missing, ends the job.
    """

    STAGES = ("chunk", "extract", "normalise", "relate")

    def __init__(self, tables: dict[str, DataFrame], mode: str = "full", extract: Callable[[DataFrame], DataFrame] | None = None, exact: bool = False):
        self.t, self.mode, self.exact = dict(tables), mode, exact
        self.extractor = extract or VF.mock_facts
        self.scratch = Scratch(next(iter(tables.values())).sparkSession, "job")
        self.log: list[tuple[str, str, float, str | None]] = []
        self.created, self.started, self.ended = time.time(), None, None

    def row(self, job_id: str, error: str | None = None) -> DataFrame:
        """The job as a row of the table of jobs: how far it is and what failed (W-2, A-6)."""
        done = sum(x[1] == "completed" for x in self.log)
        state = "failed" if error or any(x[1] == "failed" for x in self.log) else "completed" if done == len(self.STAGES) else "running" if self.log else "queued"
        stage = self.STAGES[min(done, len(self.STAGES) - 1)]
        message = error or next((f"{x[0]}: {x[3]}" for x in self.log if x[1] == "failed"), None)
        now = lambda at: None if at is None else dt.datetime.fromtimestamp(at, dt.timezone.utc)
        kind = {"extract": "extraction"}.get(self.mode, self.mode)
        values = (job_id, kind, [], state, round(done / len(self.STAGES), 2), stage, len(self.STAGES), done, message, now(self.created), now(self.started), now(self.ended))
        return self.scratch.spark.createDataFrame([values], schemas.TABLES["jobs"])

    def need(self, *names: str) -> list[DataFrame]:
        if missing := [n for n in names if n not in self.t]:
            raise ValueError(f"no input: {', '.join(missing)}")
        return [self.t[n] for n in names]

    def chunk(self) -> None:
        if self.mode in ("full", "reprocess") or "chunks" not in self.t:
            c = chunking.chunk_documents(*self.need("pages", "blocks"))
            self.t["chunks"] = self.scratch.write(c.withColumns({"block_ids_json": F.to_json("block_ids"), "heading_path_json": F.to_json("heading_path")}))

    def extract(self) -> None:
        if self.mode in ("full", "reprocess") or "facts" not in self.t:
            chunks, blocks, pages = self.need("chunks", "blocks", "pages")
            self.t["extracted"] = self.scratch.write(self.extractor(chunks))
            facts = assembled(self.t["extracted"], chunks, blocks, pages)
            if "facts" in self.t:
                others = self.t["facts"].join(pages.select("document_id").distinct(), "document_id", "left_anti")
                facts = facts.unionByName(others.select(*facts.columns))
            self.t["facts"] = self.scratch.write(facts)

    def normalise(self) -> None:
        self.t["normalized"] = self.scratch.write(prepared(*self.need("facts", "document_files", "entities"), self.t.get("entity_aliases")))

    def relate(self) -> None:
        self.t["related"] = self.scratch.write(related(*self.need("normalized", "entities"), exact=self.exact))

    def run(self) -> dict[str, DataFrame]:
        self.started = time.time()
        for s in self.STAGES:
            at = self.ended = time.time()
            try:
                getattr(self, s)()
                self.ended = time.time()
                self.log.append((s, "completed", self.ended - at, None))
            except Exception as e:
                self.log.append((s, "failed", time.time() - at, str(e)[:500]))
                raise
        return self.t


def launch(job: Job) -> threading.Thread:
    """The job in a thread of its own (W-3); what becomes of it stands in ``job.log`` and ``job.row``."""

    def run() -> None:
        try:
            job.run()
        except Exception:  # noqa: BLE001  (the log has it)
            pass

    t = threading.Thread(target=run, daemon=True)
    t.start()
    return t
