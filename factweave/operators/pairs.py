"""Pairs of facts: compatibility, candidate score, comparison (C, R).

A pair is a row whose columns of the two facts are called ``a_x`` and ``b_x``;
``pair_up`` makes such rows from ids.
"""

from __future__ import annotations

import bisect
import collections
import decimal
import difflib
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factweave.functions.normalize import family
from factweave.functions.text import equivalent, filled, folded, is_quarter, year_of
from factweave.functions.vectors import canonical_text, cosine, dot, embeddings, hash_embedding, sequence_ratio, sequence_ratio_from, word_jaccard
from factweave.session import once

#: Facts of one entity that a task compares with the others of the entity, where all facts meet.
SHARE = 1024
COLUMNS = ["id", "document_id", "entity_id", "subject", "predicate", "value_text", "value_type", "normalized_numeric_value", "unit", "normalized_unit", "currency", "time_text", "time_start", "time_end", "scope", "geography", "qualifiers_json", "validation_status"]


def with_entity(facts: DataFrame, entities: DataFrame) -> DataFrame:
    """Facts (``COLUMNS``) with ``name`` and ``entity_type`` of their entity."""
    e = entities.select(F.col("id").alias("entity_id"), F.col("canonical_name").alias("name"), "entity_type")
    return facts.select(*COLUMNS).join(e, "entity_id", "left")


def side(facts: DataFrame, s: str) -> DataFrame:
    return facts.select(*(F.col(c).alias(f"{s}_{c}") for c in facts.columns))


def pair_up(pairs: DataFrame, facts: DataFrame, a: str = "fact_a_id", b: str = "fact_b_id") -> DataFrame:
    """Pairs of ids with the columns of both facts; pairs with an unknown end fall away (S-10)."""
    return pairs.join(side(facts, "a"), F.col(a) == F.col("a_id")).join(side(facts, "b"), F.col(b) == F.col("b_id"))


def _both(x: Column, y: Column) -> Column:
    return (x != "") & (y != "")


def entity_compatible(a: str = "a", b: str = "b") -> Column:
    """Types are equal, unknown or `other` (C-1)."""
    x, y = F.col(f"{a}_entity_type"), F.col(f"{b}_entity_type")
    return F.coalesce((x == y) | (x == "other") | (y == "other"), F.lit(True))


def effective_name(s: str) -> Column:
    return folded(F.coalesce(f"{s}_name", f"{s}_subject"))


def same_entity() -> Column:
    ids = F.coalesce((F.col("a_entity_id") == F.col("b_entity_id")) & (F.col("a_entity_id") != ""), F.lit(False))
    x, y = effective_name("a"), effective_name("b")
    return ids | ((x == y) & (x != ""))


def _unit(s: str) -> Column:
    return folded(F.coalesce(filled(F.col(f"{s}_normalized_unit")), F.col(f"{s}_unit")))


def _currency(s: str) -> Column:
    return F.upper(folded(F.col(f"{s}_currency")))


def _kind(s: str, k: str) -> Column:
    return F.coalesce(F.col(f"{s}_value_type") == k, F.lit(False))


def _percent(s: str) -> Column:
    return _kind(s, "percentage") | (folded(F.col(f"{s}_unit")) == "%") | (folded(F.col(f"{s}_normalized_unit")) == "%")


def _money(s: str) -> Column:
    return _kind(s, "currency") | (_currency(s) != "")


def unit_compatible() -> Column:
    """Whether units and currencies can be compared (C-3)."""
    ca, cb, ua, ub = _currency("a"), _currency("b"), _unit("a"), _unit("b")
    pa, pb = _percent("a"), _percent("b")
    return ~(_both(ca, cb) & (ca != cb)) & ~((pa & _money("b")) | (_money("a") & pb)) & ~(_both(ua, ub) & (ua != ub) & (pa != pb))


def _year(s: str) -> Column:
    return F.coalesce(year_of(F.col(f"{s}_time_text")), year_of(F.col(f"{s}_time_start")))


def _stated(s: str) -> Column:
    return (folded(F.col(f"{s}_time_text")) != "") | (F.coalesce(F.col(f"{s}_time_start"), F.lit("")) != "")


def period_compatible() -> Column:
    """True, false, or null where neither fact states a time (C-4)."""
    ya, yb = _year("a"), _year("b")
    return F.when(ya.isNotNull() & yb.isNotNull(), ya == yb).when(_stated("a") | _stated("b"), True)


def predicate_similarity(ratio: Column) -> Column:
    """1 for equal predicates, .91 within a family, else ``ratio`` (C-2)."""
    x, y = folded(F.col("a_predicate")), folded(F.col("b_predicate"))
    return F.when(x == y, 1.0).when(family(x) == family(y), 0.91).otherwise(F.round(ratio, 2))


def entity_similarity(ratio: Column) -> Column:
    return F.when(same_entity(), 1.0).otherwise(F.round(F.greatest(ratio, word_jaccard(F.coalesce("a_name", "a_subject"), F.coalesce("b_name", "b_subject"))), 2))


def pair_score(entity: Column, predicate: Column, semantic: Column) -> Column:
    """The weighted score of a candidate pair (C-6)."""
    p = period_compatible()
    time = F.when(p.isNull(), 0.05).when(p, 0.10).otherwise(0.0)
    cross = F.when(F.col("a_document_id") == F.col("b_document_id"), 0.0).otherwise(0.05)
    s = entity * 0.30 + predicate * 0.30 + F.greatest(F.lit(0.0), semantic) * 0.25 + time + cross
    return F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), s)), 2)


def reasons(entity: Column, predicate: Column, semantic: Column) -> Column:
    """Why a pair was selected, in words, in the order entity, metric, period, scope, unit, vector (C-1 to C-6)."""
    say = lambda text, x: F.concat(F.lit(text), x)
    two = lambda x: F.format_number(x, 2)
    pa, pb, sa, sb, ga, gb = (folded(F.col(c)) for c in ("a_predicate", "b_predicate", "a_scope", "b_scope", "a_geography", "b_geography"))
    ca, cb, ua, ub = _currency("a"), _currency("b"), _unit("a"), _unit("b")
    start = F.col("a_time_start") == F.col("b_time_start")
    span = start & (F.col("a_time_end") == F.col("b_time_end")) & _both(F.coalesce("a_time_start", F.lit("")), F.coalesce("a_time_end", F.lit("")))
    # The wordings of reasons.
    return F.array_compact(F.array(
        F.when(same_entity(), "same canonical entity").when(entity >= 0.80, say("entity semantic similarity ", two(entity))),
        F.when(pa == pb, say("exact predicate match: ", pa)).when(predicate >= 0.70, say("predicate semantic similarity ", two(predicate))),
        F.when(_year("a") == _year("b"), "same fiscal year").when(_year("a").isNull() | _year("b").isNull(), F.when(span, "identical time period")),
        F.when(_both(sa, sb) & (sa == sb), say("same scope ", sa)).when(_both(ga, gb) & (ga == gb), say("same geography ", ga)),
        F.when(_both(ca, cb) & (ca == cb), say("same currency ", ca)), F.when(_both(ua, ub) & (ua == ub), say("same unit ", ua)),
        F.when(semantic >= 0.70, say("embedding similarity ", two(semantic))),
    ))


def top_k_either(scored: DataFrame, k: int) -> DataFrame:
    """Scored pairs that are among the best ``k`` of either end (C-8).

    Ties are broken by cross-document first and then by the ids. Each end keeps at
    most k rows before anything is sorted globally (Spark limits the groups of a
    rank window early).
    """
    from pyspark.sql import Window as W

    ends = scored.select("*", F.explode(F.array(F.col("a_id"), F.col("b_id"))).alias("__end"))
    w = W.partitionBy("__end").orderBy(F.col("score").desc(), (F.col("a_document_id") == F.col("b_document_id")).asc(), "a_id", "b_id")
    return ends.withColumn("__k", F.row_number().over(w)).where(F.col("__k") <= k).drop("__end", "__k").dropDuplicates(["a_id", "b_id"])


def name_pairs(facts: DataFrame, least: float = 0.5, of: DataFrame | None = None) -> DataFrame:
    """(x, y, similarity) of different effective names that share a word and whose
    similarity (E-8, E-9) is at least ``least``; over distinct names only. ``of`` restricts
    x to the names of these facts."""
    names = lambda d: d.select(folded(F.coalesce("name", "subject")).alias("x")).where("x <> ''").distinct()
    words = lambda d: names(d).select("x", F.explode(F.array_distinct(F.split("x", r"(?U)\s+"))).alias("w"))
    pairs = words(facts if of is None else of).join(words(facts).withColumnRenamed("x", "y"), "w").where("x <> y").select("x", "y").distinct()
    # similarities are rounded to two places before they are held against `least`
    sim = F.round(F.greatest(sequence_ratio_from(F.col("x"), F.col("y"), least - 0.006), word_jaccard(F.col("x"), F.col("y"))), 2)
    return once(pairs, "similarity", sim).where(F.col("similarity") >= least)


def candidates(facts: DataFrame, entities: DataFrame, queries: DataFrame | None = None, min_score: float = 0.6, k: int = 10, cross_document_only: bool = False, similar_names: DataFrame | None = None) -> DataFrame:
    """Candidate pairs (a_id, b_id, score, ...), the ``k`` best of each fact (C-1 to C-8).

    Facts meet by an equality join on their entity (its id, else the subject) and on
    their effective name, which different ids may share.
    ``similar_names``, as from ``name_pairs``, lets facts of names that are alike meet
    as well, unless even equal predicates and a cosine of 1 can't lift them over the ``k``
    best that an end has among its own entity's. Predicates are compared once for each distinct pair of strings that meets.
    A pair is dropped before vectors are touched if even a cosine of 1 can't lift it
    to ``min_score``. ``queries`` restricts one end to a set of facts, so that the
    work grows with the queries times the facts of their entities.

    Facts with status `rejected` or a null id take no part; a fact delivered several
    times must be reduced before (``facts.latest``).
    """
    from pyspark.sql import Window as W

    f = with_entity(facts.where("id is not null").where(F.coalesce(F.col("validation_status") != "rejected", F.lit(True))), entities)
    f = f.withColumn("vector", hash_embedding(canonical_text(name=F.col("name")))).withColumn("own", dot(F.col("vector"), F.col("vector"))).withColumn("p", folded(F.col("predicate")))
    f = f.withColumn("low", folded(F.coalesce("name", "subject"))).withColumn("e", F.coalesce("entity_id", "low"))
    left = f if queries is None else f.join(queries.select("id").distinct(), "id", "left_semi")
    by_entity, by_name = F.concat(F.lit("e "), "e"), F.concat(F.lit("n "), "low")
    shared = f.where("low <> ''").groupBy("low").agg(F.min("e").alias("e1"), F.max("e").alias("e2")).where("e1 <> e2").select("low")

    def scored(left: DataFrame, right: DataFrame, bounds: bool = False) -> DataFrame:
        """Scored pairs of rows with equal ``m``, of which those by name have different ``e``."""
        if queries is None:
            # the facts of a large entity are dealt out over tasks, each of which meets all of them
            shares = right.groupBy("m").agg(F.ceil(F.count(F.lit(1)) / SHARE).cast("int").alias("n"))
            left = left.join(shares, "m").withColumn("share", F.pmod(F.xxhash64("id"), F.col("n")).cast("int")).drop("n")
            right = right.join(shares, "m").withColumn("share", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).drop("n")
        else:
            left, right = left.withColumn("share", F.lit(0)), right.withColumn("share", F.lit(0))
        met = left.select("m", F.col("p").alias("x")).distinct().join(right.select("m", F.col("p").alias("y")).distinct(), "m").select("x", "y").distinct()
        alike = F.when(F.col("x") == F.col("y"), 1.0).when(family(F.col("x")) == family(F.col("y")), 0.91).otherwise(F.round(sequence_ratio("x", "y"), 2))
        alike = met.select(F.col("x").alias("a_p"), F.col("y").alias("b_p"), alike.alias("pred"))
        j = side(left, "a").join(side(right, "b"), (F.col("a_m") == F.col("b_m")) & (F.col("a_share") == F.col("b_share"))).where("a_m like 'e %' or a_e <> b_e")
        j = j.where(F.col("a_id") < F.col("b_id") if queries is None else F.col("a_id") != F.col("b_id")).where(entity_compatible() & unit_compatible())
        if cross_document_only:
            j = j.where("a_document_id <> b_document_id")
        most = pair_score(F.col("a_es"), F.col("pred"), F.lit(1.0))
        least = F.lit(min_score) if not bounds else F.col("a_bound") if queries is not None else F.least("a_bound", "b_bound")
        j = j.join(alike, ["a_p", "b_p"]).where(most >= least)
        j = once(j, "semantic", cosine(F.col("a_vector"), F.col("b_vector"), F.col("a_own"), F.col("b_own"))).withColumn("score", pair_score(F.col("a_es"), F.col("pred"), F.col("semantic"))).where(F.col("score") >= min_score)
        return j.select("a_id", "b_id", "a_document_id", "b_document_id", F.col("a_es").alias("entity_similarity"), F.col("pred").alias("predicate_similarity"), F.round("semantic", 2).alias("semantic"), period_compatible().alias("period"), "score", reasons(F.col("a_es"), F.col("pred"), F.col("semantic")).alias("reasons"))

    one = F.lit(1.0)
    named = left.join(shared, "low", "left_semi").withColumn("m", by_name)
    right = f.withColumn("m", by_entity).unionByName(f.join(shared, "low", "left_semi").withColumn("m", by_name))
    j = scored(left.withColumn("m", by_entity).unionByName(named).withColumn("es", one), right)
    w = W.partitionBy("end").orderBy(F.col("score").desc())
    if similar_names is not None:
        ends = j.select(F.explode(F.array("a_id", "b_id")).alias("end"), "score") if queries is None else j.select(F.col("a_id").alias("end"), "score")
        full = ends.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).where(F.col("rank") == k).select(F.col("end").alias("id"), F.col("score").alias("bound"))
        bound = lambda d: d.join(full, "id", "left").withColumn("bound", F.coalesce("bound", F.lit(min_score)))
        left, right = bound(left), f if queries is not None else bound(f)
        names = similar_names.join(left.groupBy(F.col("low").alias("x")).agg(F.min("bound").alias("bx")), "x")
        floor = F.col("bx")
        if queries is None:
            names, floor = names.join(left.groupBy(F.col("low").alias("y")).agg(F.min("bound").alias("by")), "y"), F.least("bx", "by")
        # the best score with that similarity: same predicate and period, another document
        names = names.where(F.round(F.least(one, F.col("similarity") * 0.30 + 0.30 + 0.25 + 0.10 + 0.05), 2) >= floor).select(F.col("x").alias("low"), "y", F.col("similarity").alias("es"))
        more = left.join(names, "low").withColumn("m", F.concat(F.lit("n "), "y")).drop("y")
        j = j.unionByName(scored(more, right.withColumn("m", by_name), True))
    if queries is None:
        return top_k_either(j, k)
    w = W.partitionBy("a_id").orderBy(F.col("score").desc(), (F.col("a_document_id") == F.col("b_document_id")).asc(), "b_id")
    return j.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def candidate_rows(c: DataFrame) -> DataFrame:
    """Candidates as rows of the table of candidate pairs, the smaller id first; a pair found
    from both ends is one row, whose id comes from the ends."""
    a, b = F.least("a_id", "b_id"), F.greatest("a_id", "b_id")
    rows = c.select(
        F.substring(F.sha2(F.concat_ws("::", a, b), 256), 1, 32).alias("id"), a.alias("fact_a_id"), b.alias("fact_b_id"), F.coalesce(F.col("a_document_id") == F.col("b_document_id"), F.lit(False)).alias("same_document"), "entity_similarity", "predicate_similarity",
        F.greatest(F.lit(0.0), "semantic").alias("semantic_similarity"), F.lit(True).alias("unit_compatible"), F.col("period").alias("period_compatible"), F.lit(True).alias("scope_compatible"), F.col("score").alias("candidate_score"), "reasons",
        F.lit("pending").alias("status"), F.current_timestamp().alias("created_at"),
    )
    return rows.dropDuplicates(["fact_a_id", "fact_b_id"])


def evaluate(candidates: DataFrame, facts: DataFrame, entities: DataFrame, document_id: str | None = None, force: bool = False) -> tuple[DataFrame, DataFrame]:
    """(relationships, candidates) of a run over the table of candidate pairs (R-13, S-10).

    Pending pairs are compared, with ``force`` all; with ``document_id`` those of which one
    fact is the document's. Pairs with an unknown or rejected end give no relationship and
    keep their status, all others come back as evaluated. Ids come from the ends.
    """
    f = with_entity(facts, entities).where(F.coalesce(F.col("validation_status") != "rejected", F.lit(True)))
    todo = candidates if force else candidates.where("status = 'pending'")
    j = pair_up(todo.select("fact_a_id", "fact_b_id").distinct(), f, "fact_a_id", "fact_b_id")
    if document_id is not None:
        j = j.where((F.col("a_document_id") == document_id) | (F.col("b_document_id") == document_id))
    d = compare(j)
    made = d.select(
        F.substring(F.sha2(F.concat_ws("::", F.least("a_id", "b_id"), F.greatest("a_id", "b_id"), F.lit("v1")), 256), 1, 32).alias("id"), F.col("a_id").alias("fact_a_id"), F.col("b_id").alias("fact_b_id"), F.col("d.type").alias("relationship_type"),
        F.col("d.confidence").alias("confidence"), F.col("d.dimension").alias("primary_dimension"), F.to_json(F.struct(*(F.col(c).alias(c[2:]) for c in DIMENSIONS))).alias("context_comparison_json"), "explanation", F.lit("v1").alias("reasoning_version"),
    )
    done = made.select(F.least("fact_a_id", "fact_b_id").alias("__x"), F.greatest("fact_a_id", "fact_b_id").alias("__y"), F.lit("evaluated").alias("__new")).distinct()
    after = candidates.withColumns({"__x": F.least("fact_a_id", "fact_b_id"), "__y": F.greatest("fact_a_id", "fact_b_id")}).join(done, ["__x", "__y"], "left")
    return made, after.withColumn("status", F.coalesce("__new", "status")).select(*candidates.columns)


#: The dimensions that a relationship keeps of its comparison.
DIMENSIONS = ["d_entity", "d_predicate", "d_period", "d_scope", "d_geo", "d_unit", "d_currency", "d_quals", "d_equal", "d_difference"]


def comparison_rows() -> Column:
    """The six rows that show a compared pair (T-16): dimension, both sides, whether they match."""
    row = lambda name, a, b, m: F.struct(F.lit(name).alias("dimension"), F.coalesce(filled(a), F.lit("-")).alias("fact_a"), F.coalesce(filled(b), F.lit("-")).alias("fact_b"), F.coalesce(m, F.lit(False)).alias("match"))
    two = lambda name, x, m: row(name, F.col(f"a_{x}"), F.col(f"b_{x}"), m)
    unit = lambda s: F.coalesce(filled(F.col(f"{s}_unit")), filled(F.col(f"{s}_currency")))
    return F.array(
        row("Entity", F.coalesce("a_name", "a_subject"), F.coalesce("b_name", "b_subject"), F.col("d_entity")), two("Metric", "predicate", F.col("d_predicate")), two("Time Period", "time_text", F.col("d_period")),
        two("Geography", "geography", F.col("d_geo")), row("Unit / Currency", unit("a"), unit("b"), F.col("d_unit") & F.col("d_currency")), two("Scope", "scope", F.col("d_scope")),
    )


def _prompt_lines(s: str) -> Column:
    """A fact of a pair as lines of text; what is missing is said to be."""
    c = lambda x: F.col(f"{s}_{x}")
    or_ = lambda x, d: F.coalesce(filled(x), F.lit(d))
    line = lambda name, *x: F.concat(F.lit(f"{name}: "), *x)
    return F.concat_ws("\n",
        line("Entity", F.coalesce(c("name"), c("subject"), F.lit("N/A"))), line("Metric", or_(c("predicate"), "N/A")), line("Value", or_(c("value_text"), "N/A")), line("Normalized", F.coalesce(c("normalized_numeric_value").cast("string"), F.lit("N/A"))),
        line("Unit", F.coalesce(filled(c("normalized_unit")), filled(c("unit")), F.lit("N/A"))), line("Currency", or_(c("currency"), "N/A")), line("Period", or_(c("time_text"), "N/A")), line("Scope", or_(c("scope"), "unspecified")), line("Geography", or_(c("geography"), "unspecified")),
        F.when(filled(c("qualifiers_json")).isNotNull(), line("Qualifiers", c("qualifiers_json"))),
    )


def pair_prompt() -> Column:
    """The text that a judge of open pairs gets (R-15)."""
    return F.concat(F.lit("Fact A\n"), _prompt_lines("a"), F.lit("\n\nFact B\n"), _prompt_lines("b"), F.lit("\n\nDecide from these facts alone: corroborates, contradicts, reconciles, uncertain or unrelated; name the dimension that decides and say why."))


def live(facts: DataFrame) -> DataFrame:
    """Facts that take part in pairs: with an id, and not rejected."""
    return facts.where("id is not null").where(F.coalesce(F.col("validation_status") != "rejected", F.lit(True)))


def profiles(facts: DataFrame, entities: DataFrame) -> DataFrame:
    """What the score of a pair depends on, a row for each fact; its vector comes from ``text``."""
    f = with_entity(live(facts), entities)
    a = side(f.withColumn("text", canonical_text(name=F.col("name"))), "a")
    kind = F.when(F.col("a_entity_type") != "other", F.col("a_entity_type"))
    a = a.select(
        F.col("a_id").alias("id"), F.col("a_document_id").alias("document"), filled(F.col("a_entity_id")).alias("entity"), kind.alias("kind"), effective_name("a").alias("name"), folded(F.col("a_predicate")).alias("predicate"),
        _currency("a").alias("currency"), _unit("a").alias("unit"), _percent("a").alias("percent"), _money("a").alias("money"), _year("a").cast("int").alias("year"), _stated("a").alias("stated"), "a_text",
    )
    return a.withColumnRenamed("a_text", "text").withColumn("family", family(F.col("predicate")))


#: Query facts that go to the tasks at once, facts that a task holds, and facts that are compared as one matrix.
BLOCK, HELD, BATCH = 1 << 15, 1 << 15, 2048
_FOUND = "qa string, qb string, es double, pred double, semantic double, score double, same int"


def search_candidates(facts: DataFrame, entities: DataFrame, queries: DataFrame, scratch, min_score: float = 0.6, k: int = 10, block: int = BLOCK, work=None) -> DataFrame:
    """The ``k`` best candidates of each of a stated set of facts among all facts, whatever their
    entities (C-1 to C-8), with their rank; the columns of ``candidates``.

    Nothing is lost: the result is that of comparing each query fact with each fact. The
    queries go to the tasks in blocks. Facts lie by predicate. They are first compared with the
    queries of their own predicate, which gives each query a score that its best ones have at
    least; then with those queries of other predicates that can still reach that score. A
    batch of facts meets its queries as one product of vectors; with an upper bound for the
    similarity of names (the letters and words that both have, in any order) it tells the few pairs
    whose names are compared. A task gives ``k`` rows a query at most. ``work``, an
    accumulator, counts the pairs of which vectors were multiplied.
    """
    from pyspark.sql import Window as W

    sc = facts.sparkSession.sparkContext
    made = scratch.write(profiles(facts, entities))
    f = scratch.write(made.repartitionByRange(max(1, -(-made.count() // HELD)), "predicate", "id").sortWithinPartitions("predicate", "name"))
    scratch.drop(made)
    rows = f.join(queries.select("id").distinct(), "id", "left_semi").toLocalIterator()
    parts = []
    while chunk := [r.asDict() for _, r in zip(range(block), rows)]:
        q = sc.broadcast(_Side(pd.DataFrame(chunk)))
        own = scratch.write(f.mapInPandas(_search(q, min_score, k, None, work), _FOUND))
        kth = own.groupBy("qa").agg(F.sort_array(F.collect_list("score"), False).alias("s")).where(F.size("s") >= k).select("qa", F.element_at("s", k).alias("kth"))
        bounds = sc.broadcast({r.qa: r.kth for r in kth.toLocalIterator()})
        parts += [own, scratch.write(f.mapInPandas(_search(q, min_score, k, bounds, work), _FOUND))]
    if not parts:
        return candidates(facts, entities, queries, min_score, k)
    found = parts[0]
    for x in parts[1:]:
        found = found.unionByName(x)
    w = W.partitionBy("qa").orderBy(F.col("score").desc(), "same", "qb")
    found = scratch.write(found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("qa", "qb", "es", "pred", "semantic"))
    ends = found.select(F.explode(F.array("qa", "qb")).alias("id")).distinct()
    j = pair_up(found, scratch.write(with_entity(live(facts).join(ends, "id", "left_semi"), entities)), "qa", "qb")
    j = j.withColumn("score", pair_score(F.col("es"), F.col("pred"), F.col("semantic"))).where(F.col("score") >= min_score)
    j = j.select("a_id", "b_id", "a_document_id", "b_document_id", F.col("es").alias("entity_similarity"), F.col("pred").alias("predicate_similarity"), F.round("semantic", 2).alias("semantic"), period_compatible().alias("period"), "score", reasons(F.col("es"), F.col("pred"), F.col("semantic")).alias("reasons"))
    w = W.partitionBy("a_id").orderBy(F.col("score").desc(), (F.col("a_document_id") == F.col("b_document_id")).asc(), "b_id")
    return j.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


_CENT = decimal.Decimal("0.01")


def _two(x: float) -> float:
    """Rounded to two places as Spark does."""
    return float(decimal.Decimal(repr(float(x))).quantize(_CENT, decimal.ROUND_HALF_UP))


def _twos(x: np.ndarray) -> np.ndarray:
    """``_two`` of numbers from 0 to 1."""
    y = np.floor(x * 100 + 0.5) / 100
    for i in np.argwhere(np.abs(x * 100 - np.floor(x * 100) - 0.5) < 1e-6):
        y[tuple(i)] = _two(x[tuple(i)])
    return y


def _ratio(x: str, y: str) -> float:
    return difflib.SequenceMatcher(None, x, y).ratio()


class _Side:
    """The columns of facts as arrays; those of text as codes, which are the codes of ``of``
    where its facts have the value too (-1 is a missing value, -2 one that ``of`` doesn't have)."""

    TEXTS = ("document", "entity", "kind", "currency", "unit")

    def __init__(self, pdf: pd.DataFrame, of: _Side | None = None):
        self.ids = pdf.id.to_numpy(dtype=object)
        self.codes, self.known = {}, {} if of is None else of.known
        for c in self.TEXTS:
            at = self.known.setdefault(c, {})
            missing = lambda x, c=c: x is None or x != x or (x == "" and c != "document")
            code = (lambda x, at=at: at.setdefault(x, len(at))) if of is None else (lambda x, at=at: at.get(x, -2))
            self.codes[c] = np.array([-1 if missing(x) else code(x) for x in pdf[c]], dtype=np.int32)
        self.percent, self.money, self.stated = (pdf[c].to_numpy(dtype=bool) for c in ("percent", "money", "stated"))
        self.year = pdf.year.fillna(0).to_numpy(dtype=np.int32)
        self.name, self.names = pd.factorize(pdf.name.to_numpy(dtype=object))
        self.predicate, self.predicates = pd.factorize(pdf.predicate.to_numpy(dtype=object))
        self.family = dict(zip(pdf.predicate, pdf.family))
        self.vector = embeddings(pdf.text)
        self.size = np.array([len(n) for n in self.names], dtype=np.float32)
        words = [{*n.split()} for n in self.names]
        self.n_words = np.array([len(w) for w in words], dtype=np.float32)
        # words in buckets and letters, the rarer ones as one: what two names share is at most what these share
        self.words = np.zeros((len(words), 256), dtype=np.float32)
        for i, ws in enumerate(words):
            for w in ws:
                self.words[i, zlib.crc32(w.encode()) % 256] += 1
        if of is None:
            counts = collections.Counter(c for n in self.names for c in n)
            self.letters = {c: i for i, (c, _) in enumerate(counts.most_common(48))}
        else:
            self.letters = of.letters
        self.bag = np.zeros((len(self.names), len(self.letters) + 1), dtype=np.int16 if self.size.max(initial=0) < 32000 else np.int32)
        for i, n in enumerate(self.names):
            for c, m in collections.Counter(n).items():
                self.bag[i, self.letters.get(c, len(self.letters))] += m
        # the places of each letter in a name as bits, or its letters in order
        if of is None:
            self.places = np.zeros((len(self.names), len(self.letters) + 2), dtype=np.uint64)
            for i, n in enumerate(self.names):
                for at, c in enumerate(n[:64]):
                    self.places[i, self.letters.get(c, len(self.letters))] |= np.uint64(1 << at)
        else:
            self.order = np.full((len(self.names), 64), len(self.letters) + 1, dtype=np.int16)
            for i, n in enumerate(self.names):
                m = n[:64]
                self.order[i, : len(m)] = [self.letters.get(c, len(self.letters)) for c in m]


def _ordered(q: _Side, b: _Side, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """An upper bound for the similarity of pairs of names by the letters that both have in the
    same order (their longest common subsequence), 1 for names of over 64 letters."""
    v, length = np.full(len(i), ~np.uint64(0)), int(min(64, b.size[j].max(initial=0)))
    order, places = b.order[j, :length], q.places[i]
    rows = np.arange(len(i))
    for t in range(length):
        m = places[rows, order[:, t]]
        u = v & m
        v = (v + u) | (v - u)
    common = np.bitwise_count(~v).astype(np.float64)
    total = q.size[i] + b.size[j]
    letters = np.where(total > 0, 2 * common / np.maximum(1, total), 1)
    both = q.n_words[i] + b.n_words[j]
    words = np.minimum((q.words[i] * b.words[j]).sum(1), np.minimum(q.n_words[i], b.n_words[j]))
    top = np.minimum(1, np.maximum(letters, words / np.maximum(1, both - words)) + 0.00501)
    return np.where((q.size[i] > 64) | (b.size[j] > 64), 1.0, top)


def _shared_names(q: _Side, b: _Side, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """An upper bound for the similarity of the names ``i`` of ``q`` and ``j`` of ``b``."""
    common = np.zeros((len(i), len(j)), dtype=np.promote_types(q.bag.dtype, b.bag.dtype))
    for c in range(q.bag.shape[1]):
        x, y = q.bag[i, c], b.bag[j, c]
        if x.any() and y.any():
            common += np.minimum(x[:, None], y[None, :])
    total = q.size[i][:, None] + b.size[j][None, :]
    letters = np.where(total > 0, 2 * common / np.maximum(1, total), 1)
    both = q.n_words[i][:, None] + b.n_words[j][None, :]
    words = np.minimum(q.words[i] @ b.words[j].T, np.minimum(q.n_words[i][:, None], b.n_words[j][None, :]))
    return np.minimum(1, np.maximum(letters, words / np.maximum(1, both - words)) + 0.00501).astype(np.float32)


class _Search:
    """The best ``k`` facts for each query, in the order of the ranking, and the score of the last."""

    def __init__(self, q: _Side, kth: np.ndarray, min_score: float, k: int):
        self.q, self.kth, self.min_score, self.k = q, kth, min_score, k
        self.best: dict[int, list] = collections.defaultdict(list)
        self.ratios: dict[tuple[str, str], float] = {}
        self.metrics: dict[tuple[str, str], float] = {}
        self.matchers: dict[str, difflib.SequenceMatcher] = {}

    def metric(self, x: str, y: str, fx, fy) -> float:
        """Similarity of two predicates (C-2)."""
        if (x, y) not in self.metrics:
            self.metrics[x, y] = 1.0 if x == y else 0.91 if fx is not None and fx == fy else _two(_ratio(x, y))
        return self.metrics[x, y]

    def comparable(self, b: _Side, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Of pairs of rows, whether types, units and currencies can be compared and both aren't one fact."""
        q = self.q
        code = lambda c: (q.codes[c][i], b.codes[c][j])
        apart = lambda x, y: (x != -1) & (y != -1) & (x != y)
        pq, pb = q.percent[i], b.percent[j]
        bad = apart(*code("kind")) | apart(*code("currency")) | (pq & b.money[j]) | (q.money[i] & pb) | (apart(*code("unit")) & (pq != pb))
        return ~bad & (q.ids[i] != b.ids[j])

    def rest(self, b: _Side, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of pairs of rows: cosine, what period and documents add, whether they are of one document (-1: one is unknown)."""
        q = self.q
        u, v = q.vector[i].astype(np.float64), b.vector[j].astype(np.float64)
        norm = np.sqrt((u * u).sum(1) * (v * v).sum(1))
        cos = np.clip(np.divide((u * v).sum(1), norm, out=np.zeros_like(norm), where=norm > 0), -1, 1)
        years = (q.year[i] > 0) & (b.year[j] > 0)
        time = np.where(years, np.where(q.year[i] == b.year[j], 0.10, 0.0), np.where(q.stated[i] | b.stated[j], 0.10, 0.05))
        x, y = q.codes["document"][i], b.codes["document"][j]
        same = np.where((x == -1) | (y == -1), -1, x == y)
        return cos, time, np.where(same == 1, 0.0, 0.05), same

    def take(self, i: int, order: tuple, *values: float) -> None:
        found = self.best[i]
        bisect.insort(found, (order, *values))
        if len(found) > self.k:
            found.pop()
        if len(found) == self.k:
            self.kth[i] = max(self.kth[i], -found[-1][0][0])

    def one_entity(self, b: _Side, preds: np.ndarray) -> int:
        """Compares facts with the queries of their entity or name and of their predicate."""
        q, met = self.q, 0
        by = lambda code: pd.DataFrame({"p": b.predicate, "c": code}).groupby(["p", "c"]).indices
        place = {n: i for i, n in enumerate(b.names)}
        by_entity, by_name = by(b.codes["entity"]), by(b.name)
        own = {p: i for i, p in enumerate(b.predicates)}
        todo = np.flatnonzero(np.isin(q.predicate, preds))
        groups = pd.DataFrame({"p": q.predicate[todo], "e": q.codes["entity"][todo], "n": q.name[todo]}).groupby(["p", "e", "n"]).indices
        for (p, e, n), at in groups.items():
            p, n = own[q.predicates[p]], q.names[n]
            js = [x for x in (by_entity.get((p, e)) if e >= 0 else None, by_name.get((p, place.get(n, -1))) if n else None) if x is not None]
            if not js:
                continue
            js = js[0] if len(js) == 1 else np.union1d(*js)
            for i in todo[at]:
                for s in range(0, len(js), 1 << 14):
                    j = js[s : s + (1 << 14)]
                    met += len(j)
                    i_ = np.full(len(j), i)
                    ok = self.comparable(b, i_, j)
                    j, i_ = j[ok], i_[ok]
                    cos, time, cross, same = self.rest(b, i_, j)
                    score = _twos(np.minimum(1.0, 0.30 + 0.30 + np.maximum(0.0, cos) * 0.25 + time + cross))
                    good = np.flatnonzero(score >= self.kth[i])
                    for x in good[np.lexsort((b.ids[j[good]].astype(str), same[good], -score[good]))][: self.k]:
                        self.take(i, (-score[x], int(same[x]), b.ids[j[x]]), 1.0, 1.0, float(cos[x]))
        return met

    def batch(self, b: _Side, rows: slice, own: bool) -> int:
        """Compares a batch of facts with the queries of their predicates or, if not ``own``, of all others."""
        q = self.q
        cols, col = np.unique(b.predicate[rows], return_inverse=True)
        table = np.full((len(q.predicates), len(cols)), -10.0)
        at = {p: i for i, p in enumerate(q.predicates)}
        if own:
            for y, c in enumerate(cols):
                if (x := at.get(b.predicates[c])) is not None:
                    table[x, y] = 1.0
        else:
            least = np.full(len(q.predicates), np.inf)
            np.minimum.at(least, q.predicate, self.kth)
            size, related = np.array([len(p) for p in q.predicates]), np.array([q.family[p] is not None for p in q.predicates])
            for y, c in enumerate(cols):
                name = b.predicates[c]
                # a ratio is at most what the lengths allow; what can't reach is not compared
                top = np.where(related, 1.0, 2 * np.minimum(size, len(name)) / np.maximum(1, size + len(name)) + 0.00501)
                for x in np.flatnonzero(0.30 * top + 0.70501 >= least):
                    p = q.predicates[x]
                    if p != name:
                        table[x, y] = self.metric(p, name, q.family[p], b.family[name])
        i = np.flatnonzero((0.30 * table.max(1) + 0.70502)[q.predicate] >= self.kth)
        if not len(i):
            return 0
        met = 0
        for s in range(0, len(i), BATCH // 2):
            met += self.matrix(b, rows, i[s : s + BATCH // 2], table, col, own)
        return met

    def matrix(self, b: _Side, rows: slice, i: np.ndarray, table: np.ndarray, col: np.ndarray, own: bool) -> int:
        q = self.q
        reach = q.vector[i] @ b.vector[rows].T
        met = reach.size
        np.maximum(reach, 0, out=reach)
        reach *= 0.25
        reach += (0.30 * table).astype(np.float32)[q.predicate[i]][:, col] if table.shape[1] > 1 else (0.30 * table[:, 0]).astype(np.float32)[q.predicate[i]][:, None]
        need = (self.kth[i] - 0.15503).astype(np.float32)
        # where even equal names wouldn't do, names aren't looked at
        can = np.flatnonzero((reach.max(0) >= need.min() - 0.30))
        can = can[(reach[:, can] >= (need - 0.30)[:, None]).any(0)]
        if not len(can):
            return met
        reach, j_of = reach[:, can], np.arange(rows.start, rows.start + len(col))[can]
        ni, nq = np.unique(q.name[i], return_inverse=True)
        nj, nb = np.unique(b.name[j_of], return_inverse=True)
        upper = 0.30 * _shared_names(q, b, ni, nj)[nq[:, None], nb[None, :]]
        entity = q.codes["entity"][i][:, None] == np.where(b.codes["entity"] < 0, -3, b.codes["entity"])[j_of][None, :]
        upper[entity] = 0.30
        x, y = np.nonzero(reach + upper >= need[:, None])
        if not len(x):
            return met
        for s in range(0, len(x), 1 << 16):
            self.pairs(b, i[x[s : s + (1 << 16)]], j_of[y[s : s + (1 << 16)]], upper[x[s : s + (1 << 16)], y[s : s + (1 << 16)]], table, col, rows.start, own)
        return met

    def pairs(self, b: _Side, i: np.ndarray, j: np.ndarray, upper: np.ndarray, table: np.ndarray, col: np.ndarray, start: int, own: bool) -> None:
        """Compares pairs of rows of which ``upper`` bounds what their names add."""
        q = self.q
        same = ((q.codes["entity"][i] >= 0) & (q.codes["entity"][i] == b.codes["entity"][j])) | ((q.names[q.name[i]] == b.names[b.name[j]]) & (q.size[q.name[i]] > 0))
        ok = self.comparable(b, i, j)
        if own:
            ok &= ~same  # these were compared before
        i, j, upper, same = i[ok], j[ok], upper[ok], same[ok]
        cos, time, cross, alike = self.rest(b, i, j)
        pred = table[q.predicate[i], col[j - start]]
        reach = upper + pred * 0.30 + np.maximum(0.0, cos) * 0.25 + time + cross + 0.00502
        x = np.flatnonzero((reach >= self.kth[i]) & ~same)
        names, place = np.unique(q.name[i[x]].astype(np.int64) * len(b.names) + b.name[j[x]], return_inverse=True)
        tops = np.concatenate([_ordered(q, b, n // len(b.names), n % len(b.names)) for n in np.array_split(names, 1 + len(names) // BATCH)])[place]
        reach[x] -= upper[x] - np.minimum(upper[x], 0.30 * tops)
        order = np.flatnonzero(reach >= self.kth[i])
        order = order[np.argsort(-reach[order], kind="stable")]
        while len(order):
            for x in order[:256]:
                a, y = int(i[x]), int(j[x])
                if reach[x] < self.kth[a]:
                    continue
                es = 1.0
                if not same[x]:
                    key = (q.names[q.name[a]], b.names[b.name[y]])
                    es = self.ratios.get(key)
                    if es is None:
                        u, v = {*key[0].split()}, {*key[1].split()}
                        es = self.ratios[key] = _two(max(self.ratio(*key), len(u & v) / len(u | v) if u or v else 0.0))
                score = es * 0.30 + pred[x] * 0.30 + max(0.0, cos[x]) * 0.25 + time[x] + cross[x]
                if score + 0.00502 < self.kth[a]:
                    continue
                score = _two(min(1.0, max(0.0, score)))
                if score >= self.kth[a]:
                    # null documents come first, as nulls do
                    self.take(a, (-score, int(alike[x]), b.ids[y]), es, float(pred[x]), float(cos[x]))
            order = order[256:]
            order = order[reach[order] >= self.kth[i[order]]]

    def ratio(self, x: str, y: str) -> float:
        if y not in self.matchers:
            if len(self.matchers) > BATCH:
                self.matchers.clear()
            self.matchers[y] = difflib.SequenceMatcher(None, "", y)
        self.matchers[y].set_seq1(x)
        return self.matchers[y].ratio()


def _search(queries, min_score: float, k: int, bounds, work):
    """The best ``k`` facts of a partition for each query: without ``bounds`` among those of its
    predicate, else among the others, which must reach the bound of the query."""

    def run(it):
        q = queries.value
        kth = np.full(len(q.ids), float(min_score))
        if bounds is not None:
            kth = np.array([max(min_score, bounds.value.get(x, min_score)) for x in q.ids])
        search = _Search(q, kth, min_score, k)

        def held():
            parts, n = [], 0
            for pdf in it:
                parts.append(pdf)
                n += len(pdf)
                if n >= HELD:
                    yield pd.concat(parts, ignore_index=True)
                    parts, n = [], 0
            if n:
                yield pd.concat(parts, ignore_index=True)

        for pdf in held():
            b, met = _Side(pdf, q), 0
            if bounds is None:
                met += search.one_entity(b, np.flatnonzero(np.isin(q.predicates, b.predicates)))
            for s in range(0, len(b.ids), BATCH):
                met += search.batch(b, slice(s, min(s + BATCH, len(b.ids))), bounds is None)
            # similarities are remembered for the facts held only, so that memory stays bounded
            search.ratios.clear()
            if work is not None:
                work.add(met)
        rows = [(q.ids[i], x[0][2], *x[1:], -x[0][0], x[0][1]) for i, xs in search.best.items() for x in xs]
        yield pd.DataFrame(rows, columns=["qa", "qb", "es", "pred", "semantic", "score", "same"])

    return run


def _qualifiers(s: str) -> Column:
    return F.array_sort(F.array_distinct(F.coalesce(F.from_json(f"{s}_qualifiers_json", "array<string>"), F.array().cast("array<string>"))))


def with_dimensions(pairs: DataFrame) -> DataFrame:
    """Pairs with the flags of each dimension (R-4 to R-6)."""
    ca, cb, ua, ub = _currency("a"), _currency("b"), _unit("a"), _unit("b")
    sa, sb, ga, gb = (folded(F.col(x)) for x in ("a_scope", "b_scope", "a_geography", "b_geography"))
    ya, yb, qa, qb = _year("a"), _year("b"), is_quarter(F.col("a_time_text")), is_quarter(F.col("b_time_text"))
    starts = filled(F.col("a_time_start")).isNotNull() & filled(F.col("b_time_start")).isNotNull()
    years = ya.isNotNull() & yb.isNotNull()
    period = F.when(years & (ya != yb), False).when(qa != qb, False).when(starts, (F.col("a_time_start") == F.col("b_time_start")) & F.col("a_time_end").eqNullSafe(F.col("b_time_end"))).when(years & ~qa & ~qb, True)
    va, vb = F.col("a_normalized_numeric_value"), F.col("b_normalized_numeric_value")
    numbers = va.isNotNull() & vb.isNotNull()
    apart = F.abs(va - vb) / F.greatest(F.abs(va), F.abs(vb), F.lit(1e-6))
    money = (ca != "") | (cb != "") | _kind("a", "currency") | _kind("b", "currency")
    pct = lambda s: _kind(s, "percentage") | (_unit(s) == "%")
    x, y = folded(F.col("a_predicate")), folded(F.col("b_predicate"))
    return pairs.withColumns({
        "d_types": entity_compatible(), "d_entity": same_entity(), "d_predicate": (x == y) & (x != ""), "d_family": F.coalesce(family(x) == family(y), F.lit(False)), "d_percent": pct("a") == pct("b"),
        "d_currency": ~(_both(ca, cb) & (ca != cb)), "d_currency_explicit": F.when(money, (ca != "") & (ca == cb)).otherwise(ca == cb), "d_unit": ~(_both(ua, ub) & (ua != ub)), "d_period": period,
        "d_scope": ~(_both(sa, sb) & (sa != sb)), "d_scope_explicit": sa == sb, "d_geo": ~(_both(ga, gb) & (ga != gb)), "d_geo_explicit": ga == gb, "d_quals": _qualifiers("a") == _qualifiers("b"), "d_numbers": numbers,
        "d_equal": F.when(numbers, apart <= 0.005).otherwise(equivalent(F.col("a_value_text"), F.col("b_value_text"))), "d_difference": F.round(F.when(numbers, apart), 4),
        "d_any_scope": (sa != "") | (sb != ""), "d_any_geo": (ga != "") | (gb != ""), "d_any_currency": (ca != "") | (cb != ""),
    })


def decision(fallback: bool = True) -> Column:
    """struct(type, confidence, dimension, branch) of a pair with dimensions (R-1 to R-11).

    One ladder: the first branch that holds decides. Branch `open` is where the
    deterministic comparison says nothing; with ``fallback`` the offline provider
    answers it.
    """
    c = F.col
    make = lambda t, p, d, b: F.struct(F.lit(t).alias("type"), F.lit(p).alias("confidence"), F.lit(d).alias("dimension"), F.lit(b).alias("branch"))
    rejected = F.coalesce(c("a_validation_status") == "rejected", F.lit(False)) | F.coalesce(c("b_validation_status") == "rejected", F.lit(False))
    same = c("d_currency") & c("d_unit") & F.coalesce(c("d_period"), F.lit(False)) & c("d_scope") & c("d_geo") & c("d_quals")
    explicit = c("d_currency_explicit") & c("d_scope_explicit") & c("d_geo_explicit") & c("d_numbers")
    differ = ~c("d_equal")
    x, y = folded(c("a_predicate")), folded(c("b_predicate"))
    ladder = (
        F.when(rejected, make("uncertain", 0.0, "value", "rejected"))
        .when(~c("d_types"), make("unrelated", 1.0, "entity", "types"))
        .when(~c("d_entity"), make("unrelated", 1.0, "entity", "entities"))
        .when(~c("d_predicate") & ~c("d_family"), make("unrelated", 1.0, "definition", "predicates"))
        .when(c("d_predicate") & ~c("d_percent"), make("reconciles", 0.95, "unit", "percent"))
        .when(c("d_predicate") & same & c("d_equal"), make("corroborates", 1.0, "value", "equal"))
        .when(c("d_predicate") & same & explicit & differ, make("contradicts", 0.95, "value", "differ"))
        .when(c("d_predicate") & differ & ~F.coalesce(c("d_period"), F.lit(True)), make("reconciles", 0.95, "time", "period"))
        .when(c("d_predicate") & differ & (~c("d_scope") | ~c("d_scope_explicit")) & c("d_any_scope"), make("reconciles", 0.9, "scope", "scope"))
        .when(c("d_predicate") & differ & (~c("d_geo") | ~c("d_geo_explicit")) & c("d_any_geo"), make("reconciles", 0.9, "geography", "geography"))
        .when(c("d_predicate") & differ & (~c("d_currency") | ~c("d_currency_explicit")) & c("d_any_currency"), make("reconciles", 0.9, "unit", "currency"))
        .when(c("d_predicate") & differ & ~c("d_unit"), make("reconciles", 0.9, "unit", "unit"))
    )
    if fallback:
        ladder = ladder.when(F.array_sort(F.array(x, y)) == F.array(F.lit("revenue"), F.lit("sales")), make("reconciles", 0.9, "definition", "open"))
        return ladder.otherwise(make("uncertain", 0.6, "other", "open"))
    return ladder.otherwise(make(None, None, None, "open"))


def explanation() -> Column:
    """A sentence for each branch of the decision ``d`` (R-14)."""
    c = F.col
    name = F.coalesce("a_name", "a_subject")
    or_ = lambda x: F.coalesce(filled(c(x)), F.lit("unspecified"))
    vs = lambda x: F.concat(F.lit("'"), or_(f"a_{x}"), F.lit("' vs '"), or_(f"b_{x}"), F.lit("'"))
    say = lambda *x: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in x))
    b = c("d.branch")
    return (
        F.when(b == "rejected", "A fact of the pair was rejected by verification.")
        .when(b == "types", say("Entity types differ: ", or_("a_entity_type"), " vs ", or_("b_entity_type"), "."))
        .when(b == "entities", say("Facts are about different entities: ", F.lit("'"), name, "' vs '", F.coalesce("b_name", "b_subject"), "'."))
        .when(b == "predicates", say("Facts are about different metrics: ", vs("predicate"), "."))
        .when(b == "percent", say("One value is a percentage, the other is not: ", vs("value_text"), "."))
        .when(b == "equal", say("Both sources give ", name, " ", c("a_predicate"), " as ", c("a_value_text"), "."))
        .when(b == "differ", say("Sources contradict each other on ", name, " ", c("a_predicate"), ": ", vs("value_text"), "."))
        .when(b == "period", say("Values are for different periods: ", vs("time_text"), "."))
        .when(b == "scope", say("Values differ by scope: ", vs("scope"), "."))
        .when(b == "geography", say("Values differ by geography: ", vs("geography"), "."))
        .when(b == "currency", say("Values differ by currency: ", vs("currency"), "."))
        .when(b == "unit", say("Values differ by unit: ", vs("unit"), "."))
        .otherwise("No dimension decides; the offline provider answered.")
    )


def compare(pairs: DataFrame, fallback: bool = True) -> DataFrame:
    """Pairs with dimensions, the decision ``d`` and ``explanation``."""
    return with_dimensions(pairs).withColumn("d", decision(fallback)).withColumn("explanation", explanation())


def cache_key(version: str = "v1") -> Column:
    """Key under which a provider's answer for a pair is kept (R-12)."""
    return F.sha2(F.concat_ws("::", F.col("a_id"), F.col("a_value_text"), F.col("b_id"), F.col("b_value_text"), F.lit(version)), 256)
