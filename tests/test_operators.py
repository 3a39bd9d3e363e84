import hashlib
import math
import random
import uuid

import pytest
from pyspark.sql import functions as F

from factweave import schemas
from factweave.functions import vectors as V
from factweave.operators import chunking as K, facts as FA, pages as PG, pairs as PR, store as ST, verify as VF
from factweave.sources import demo, files, providers


# ---- pages and chunks


def test_header_and_footer_lines(spark):
    body = ["ACME REPORT\n\nText {k} one\nmore {k}\nInternal use\n{k}".format(k=k) for k in range(1, 5)]
    p = spark.createDataFrame([(f"p{k}", "d", t) for k, t in enumerate(body)] + [("q", "short", "ACME REPORT"), ("r", "d", None)], "id string, document_id string, raw_text string")
    pat = PG.line_patterns(p)
    assert {(r.position, r.pattern) for r in pat.collect()} == {("header", "ACME REPORT"), ("footer", "Internal use")}
    out = {r.id: r.cleaned for r in PG.without_patterns(p, pat).collect()}
    assert out["p0"] == "Text 1 one\nmore 1" and out["q"] == "ACME REPORT" and out["r"] is None


def test_tables_and_blocks(spark):
    df = spark.createDataFrame([(["a", "b"], [["1", "2"], ["3", None]])], "h array<string>, r array<array<string>>")
    t = df.select(PG.table_text(F.col("h"), F.col("r")).alias("t")).first().t
    assert t == "a | b\n" + "-" * 40 + "\n1 | 2\n3 | "
    back = spark.createDataFrame([(t,), ("x\ny",), (None,), ("one",)], "t string").select(PG.parse_table(F.col("t")).alias("p")).collect()
    assert back[0].p.headers == ["a", "b"] and len(back[0].p.rows) == 2 and back[1].p is None and back[2].p is None and back[3].p is None
    b = PG.line_blocks(spark.createDataFrame([("p", "1. Intro\n\nSome text here."), ("q", None)], "id string, raw_text string")).collect()
    assert [(r.block_index, r.reading_order, r.block_type) for r in b] == [(0, 0, "heading"), (1, 2, "paragraph")]
    assert b[0].content_hash == hashlib.sha256(b"1. Intro").hexdigest()[:16]


def chunks_of(spark, rows, least, most, overlap, low=()):
    """Chunks of one document from (id, type, text, page) rows."""
    nos = sorted({p for *_, p in rows} | {*low}) or [1]
    pages = spark.createDataFrame([(f"p{n}", "d", n, n in low, None) for n in nos], "id string, document_id string, page_number int, is_scanned boolean, text_quality double")
    blocks = spark.createDataFrame([(i, f"p{n}", k, kind, t, k) for k, (i, kind, t, n) in enumerate(rows)], "id string, page_id string, block_index int, block_type string, text string, reading_order int")
    return K.chunk_documents(pages, blocks, least, most, overlap).orderBy("sequence_index").collect()


def words(i, n):
    return (i + " ") * (4 * n // (len(i) + 1))


def test_chunks_follow_sections(spark):
    h, h2 = ("h", "heading", "1. Introduction", 1), ("h2", "heading", "1.1 Overview", 1)
    one = chunks_of(spark, [h, h2, ("b", "paragraph", words("b", 50), 1)], 500, 1000, 150)
    assert len(one) == 1 and one[0].heading_path == ["1. Introduction", "1.1 Overview"]
    two = chunks_of(spark, [h, ("b1", "paragraph", words("b1", 20), 1), ("b2", "paragraph", words("b2", 20), 1), ("h3", "heading", "2. Next", 1), ("b4", "table", words("b4", 20), 3)], 15, 30, 15, low=(2,))
    assert [c.previous_chunk_id for c in two] == [None, *(c.id for c in two[:-1])] and [c.next_chunk_id for c in two] == [*(c.id for c in two[1:]), None]
    assert two[1].text.startswith(K.MARK) and two[-1].has_table and two[-1].has_low_quality_page and not two[0].has_low_quality_page
    assert two[0].id == str(uuid.uuid5(uuid.UUID(K.NAMESPACE), "d_chunk_0")) and two[-1].id == str(uuid.uuid5(uuid.UUID(K.NAMESPACE), f"d_chunk_{len(two) - 1}"))
    c = two[1]
    assert c.content_hash == hashlib.sha256("".join([c.text.strip(), *c.heading_path, *c.block_ids]).encode()).hexdigest()
    table = ("t", "table", words("t", 3000), 1)
    assert any(table[2].strip() in c.text for c in chunks_of(spark, [("a", "paragraph", words("a", 900), 1), table], 800, 2500, 150))
    assert chunks_of(spark, [], 1, 2, 1) == [] and chunks_of(spark, [("x", "paragraph", " ", 1)], 1, 2, 1) == []


def test_ends_of_chunks_by_their_definition():
    rnd = random.Random(3)
    for _ in range(500):
        n = rnd.randint(0, 30)
        tokens, headings = [rnd.choice([1, 2, 5, 20, 90]) for _ in range(n)], {k: rnd.choice(["1. A", "1.2 B", "2.3.1 C", "Part 4", "Notes"]) for k in range(n) if rnd.random() < 0.3}
        least, most, want = rnd.choice([1, 10, 30]), rnd.choice([10, 40, 100]), rnd.choice([0, 3, 25])
        got, at = K.cuts(tokens, headings, least, most, want), 0
        for c, before in zip(got, [None, *got]):
            end = next((k for k in range(at + 1, n) if sum(tokens[at:k]) >= least and (k in headings or sum(tokens[at : k + 1]) > most)), n)
            assert (c["first"], c["last"]) == (at, end)
            path = []
            for k in sorted(headings):
                if k <= end:
                    h = headings[k]
                    path = path[: {"1. A": 0, "1.2 B": 1, "2.3.1 C": 2, "Part 4": 0, "Notes": 1}[h]] + [h]
            assert c["path"] == path
            if before is None or not want:
                assert c["before"] == []
            else:
                group = [k for k in range(before["first"], before["last"])]
                while group and group[-1] in headings:
                    group.pop()
                assert c["before"] == (group[-1:] if group and tokens[group[-1]] >= want else group[-2:])
            at = end
        assert at == n


def test_chunk_table_is_stable(spark):
    p = spark.createDataFrame([("p1", "d", 1, False, 1.0), ("p2", "d", 2, True, None), ("p3", None, 1, None, None)], "id string, document_id string, page_number int, is_scanned boolean, text_quality double")
    b = spark.createDataFrame([("b1", "p1", 0, "paragraph", "one", 1), ("b2", "p2", 0, "paragraph", "two", None), ("b3", "gone", 0, "paragraph", "three", 1), ("b4", "p2", 1, "paragraph", None, 2)], "id string, page_id string, block_index int, block_type string, text string, reading_order int")
    a, c = K.chunk_documents(p, b).collect(), K.chunk_documents(p, b).collect()
    assert a == c and len(a) == 1 and a[0].block_ids == ["b1", "b2"] and a[0].text == "one\n\ntwo"
    assert K.chunk_documents(p.limit(0), b).count() == 0


# ---- evidence


def test_verdicts(spark):
    text = "Acme Corp. reported revenue of $120 million in FY2025, up from last year.\nThe board approved a new plan."
    cases = [("reported revenue of $120 million in FY2025", "validated"), ("reported  revenue of “$120 million” in FY2025", "warning"), ("Revenue of 120 million in FY2025 up from last year", "warning"), ("The board approved a new plan and then left the building at once", "rejected"), ("reported revenue million invented figure", "rejected"), ("", "rejected"), (None, "rejected")]
    df = spark.createDataFrame([(q, text) for q, _ in cases], "q string, c string")
    assert [r.s for r in df.select(VF.verdict(F.col("q"), F.col("c"))["status"].alias("s")).collect()] == [s for _, s in cases]


def test_attribution(spark):
    pages = spark.createDataFrame([("p1", 1), ("p2", 2)], "id string, page_number int")
    blocks = spark.createDataFrame([("b1", "p1", "Alpha grew by ten percent this year."), ("b2", "p2", "Beta fell, sharply, by five.")], "id string, page_id string, text string")
    chunks = spark.createDataFrame([("c", "Alpha grew by ten percent this year.\n\nBeta fell, sharply, by five.", '["b1", "b2"]', 1, 2)], "id string, text string, block_ids_json string, start_page int, end_page int")
    facts = spark.createDataFrame([("f1", 1, "c", "grew by ten percent"), ("f2", 2, "c", "beta FELL sharply by five"), ("f3", 3, "c", "ten percent this year. Beta fell, sharply, by"), ("f4", 4, "c", "nothing like that here"), ("f5", 5, "gone", "x")], "id string, seq int, chunk_id string, source_quote string")
    got = {r.fact_id: (r.status, r.block_ids, r.start_page, r.end_page) for r in VF.verify_facts(facts, chunks, blocks, pages).collect()}
    assert got == {"f1": ("validated", ["b1"], 1, 1), "f2": ("warning", ["b2"], 2, 2), "f3": ("validated", ["b1", "b2"], 1, 2), "f4": ("rejected", [], 1, 2)}


# ---- pairs

CASES = [
    (dict(v="$383 billion", n=3.83e11, c="USD", t="FY2023"), dict(v="$383,000 million", n=3.83e11, c="USD", t="Fiscal Year 2023"), ("corroborates", "value")),
    (dict(v="$383 billion", n=3.83e11, c="USD", t="FY2023"), dict(v="$300 billion", n=3e11, c="USD", t="FY2023"), ("contradicts", "value")),
    (dict(n=1.0, t="FY2023"), dict(n=2.0, t="Q4 2023"), ("reconciles", "time")),
    (dict(n=1.0, t="FY2023", s="consolidated"), dict(n=2.0, t="FY2023", s="Google Cloud"), ("reconciles", "scope")),
    (dict(n=1.0, t="FY2023", s="consolidated"), dict(n=2.0, t="FY2023"), ("reconciles", "scope")),
    (dict(n=1.0, t="FY2023", g="Asia"), dict(n=2.0, t="FY2023"), ("reconciles", "geography")),
    (dict(n=1.0, t="FY2023", c="USD"), dict(n=2.0, t="FY2023"), ("reconciles", "unit")),
    (dict(n=0.35, u="%", t="FY2023"), dict(n=4.6e10, c="USD", t="FY2023"), ("reconciles", "unit")),
    (dict(n=1.0, subj="Apple"), dict(n=1.0, subj="Microsoft"), ("unrelated", "entity")),
    (dict(n=1.0, p="revenue"), dict(n=1.0, p="founder"), ("unrelated", "definition")),
    (dict(n=1.0, p="revenue"), dict(n=2.0, p="sales"), ("reconciles", "definition")),
    (dict(v="San Francisco, CA", t="FY2023"), dict(v="San Francisco, California", t="FY2023"), ("corroborates", "value")),
    (dict(v="San Francisco", t="FY2023"), dict(v="Austin", t="FY2023"), ("uncertain", "other")),
    (dict(n=1.0, st="rejected"), dict(n=1.0), ("uncertain", "value")),
    (dict(n=None, v=None, subj=None), dict(n=None, v=None, subj=None), ("unrelated", "entity")),
]
SCHEMA = "id string, document_id string, entity_id string, subject string, predicate string, value_text string, value_type string, normalized_numeric_value double, unit string, normalized_unit string, currency string, time_text string, time_start string, time_end string, scope string, geography string, qualifiers_json string, validation_status string, name string, entity_type string"


def row(i, v="1", n=None, c=None, t=None, s=None, g=None, u=None, subj="Acme", p="revenue", st="validated", e=None, doc="d", q=None):
    return (i, doc, e, subj, p, v, "number", n, u, u, c, t, None, None, s, g, q, st, None, None)


def test_decisions(spark):
    f = spark.createDataFrame([row(f"{k}{s}", **x) for k, c in enumerate(CASES) for s, x in zip("ab", c)], SCHEMA)
    ids = spark.createDataFrame([(k, f"{k}a", f"{k}b") for k in range(len(CASES))], "k int, fact_a_id string, fact_b_id string")
    got = {r.k: (r.d.type, r.d.dimension) for r in PR.compare(PR.pair_up(ids, f)).collect()}
    assert [got[k] for k in range(len(CASES))] == [c[2] for c in CASES]


def test_candidates_equal_brute_force(spark):
    ents = spark.createDataFrame([("e1", "Apple Inc", "company"), ("e2", "Tim Cook", "person")], "id string, canonical_name string, entity_type string")
    rows = [row(f"f{k}", n=float(k), p=p, e=e, subj="Apple", doc=f"d{k % 3}", t=t) for k, (p, e, t) in enumerate([(p, e, t) for p in ("revenue", "sales", "headcount", "founder") for e in ("e1", "e2", None) for t in ("FY2023", "FY2024", None)])]
    f = spark.createDataFrame([r[:18] for r in rows], ", ".join(SCHEMA.split(", ")[:18]))
    got = {(r.a_id, r.b_id): r.score for r in PR.candidates(f, ents, k=4).collect()}
    fe = PR.with_entity(f, ents).withColumn("v", V.hash_embedding(V.canonical_text(name=F.col("name"))))
    a, b = PR.side(fe, "a"), PR.side(fe, "b")
    j = a.join(b, F.col("a_id") < F.col("b_id")).where(PR.same_entity() & (F.coalesce("a_entity_id", F.lower("a_subject")) == F.coalesce("b_entity_id", F.lower("b_subject"))) & PR.entity_compatible() & PR.unit_compatible())
    s = PR.pair_score(F.lit(1.0), PR.predicate_similarity(V.sequence_ratio("a_predicate", "b_predicate")), V.cosine(F.col("a_v"), F.col("b_v")))
    every = [(r.a_id, r.b_id, r.s, r.same) for r in j.select("a_id", "b_id", s.alias("s"), (F.col("a_document_id") == F.col("b_document_id")).alias("same")).collect() if r.s >= 0.6]
    best = set()
    for e in {x for r in every for x in r[:2]}:
        best |= {(r[0], r[1]) for r in sorted((r for r in every if e in r[:2]), key=lambda r: (-r[2], r[3], r[0], r[1]))[:4]}
    assert set(got) == best and all(got[(r[0], r[1])] == r[2] for r in every if (r[0], r[1]) in best)
    assert PR.candidates(f.limit(0), ents).count() == 0


def test_candidates_of_other_names_equal_brute_force(spark):
    ents = spark.createDataFrame([("e1", "Acme Mining", "company"), ("e2", "Acme Mining Group", "company"), ("e3", "acme mining", "other")], "id string, canonical_name string, entity_type string")
    subjects = [("e1", "x"), ("e2", "x"), ("e3", "x"), (None, "Acme Mining"), (None, "Acme Minning Co"), (None, "Acme"), (None, "Nobody")]
    rows = [row(f"f{k:02}", n=float(k), p=p, e=e, subj=s, doc=f"d{k % 3}", t=t) for k, (p, (e, s), t) in enumerate([(p, x, t) for p in ("revenue", "sales", "headcount") for x in subjects for t in ("FY2023", None)])]
    f = spark.createDataFrame([r[:18] for r in rows], ", ".join(SCHEMA.split(", ")[:18]))
    fe = PR.with_entity(f, ents).withColumn("v", V.hash_embedding(V.canonical_text(name=F.col("name"))))
    alike = PR.name_pairs(fe)
    sims = {(r.x, r.y): r.similarity for r in alike.collect()}
    a, b = PR.side(fe, "a"), PR.side(fe, "b")
    j = a.join(b, F.col("a_id") != F.col("b_id")).where(PR.entity_compatible() & PR.unit_compatible())
    names = spark.createDataFrame([(*k, v) for k, v in sims.items()], "x string, y string, sim double")
    j = j.join(names, (PR.effective_name("a") == F.col("x")) & (PR.effective_name("b") == F.col("y")), "left").withColumn("es", F.when(PR.same_entity(), 1.0).otherwise(F.col("sim"))).where("es is not null")
    s = PR.pair_score(F.col("es"), PR.predicate_similarity(V.sequence_ratio("a_predicate", "b_predicate")), V.cosine(F.col("a_v"), F.col("b_v")))
    every = [r for r in j.select("a_id", "b_id", s.alias("s"), (F.col("a_document_id") == F.col("b_document_id")).alias("same"), "es").collect() if r.s >= 0.6]
    assert any(r.es < 1 for r in every)
    for k in (3, 12):
        top = {e: [(r.a_id, r.b_id, r.s) for r in sorted((r for r in every if r.a_id == e), key=lambda r: (-r.s, r.same, r.b_id))[:k]] for e in {r.a_id for r in every}}
        of = f.where("id in ('f00', 'f06', 'f08', 'f33')")
        got = {(r.a_id, r.b_id, r.score) for r in PR.candidates(f, ents, queries=of, k=k, similar_names=alike).collect()}
        assert got == {x for e in ("f00", "f06", "f08", "f33") for x in top[e]}
        got = [(r.a_id, r.b_id) for r in PR.candidates(f, ents, k=k, similar_names=alike).collect()]
        assert sorted(got) == sorted({tuple(sorted(x[:2])) for v in top.values() for x in v})


def test_searched_candidates_equal_the_nested_loop(spark, scratch, k=7):
    from pyspark.sql import Window as W

    from factweave.plans.reference import latest_facts
    from tests.oracle import DATA

    ents = spark.read.parquet(f"{DATA}/entities.parquet")
    f = scratch.write(latest_facts(spark, DATA))
    of = f.where("seq % 20 = 0")
    got = {(r.a_id, r.b_id): (r.score, r.rank) for r in PR.search_candidates(f, ents, of, scratch, k=k).collect()}
    fe = scratch.write(PR.with_entity(PR.live(f), ents).withColumn("v", V.hash_embedding(V.canonical_text(name=F.col("name")))))
    j = PR.side(fe.join(of.select("id"), "id", "left_semi"), "a").crossJoin(PR.side(fe, "b")).where("a_id <> b_id").where(PR.entity_compatible() & PR.unit_compatible())
    es = PR.entity_similarity(V.sequence_ratio(PR.effective_name("a"), PR.effective_name("b")))
    s = PR.pair_score(es, PR.predicate_similarity(V.sequence_ratio(F.lower("a_predicate"), F.lower("b_predicate"))), V.cosine(F.col("a_v"), F.col("b_v")))
    w = W.partitionBy("a_id").orderBy(F.col("score").desc(), (F.col("a_document_id") == F.col("b_document_id")).asc(), "b_id")
    want = j.withColumn("score", s).where("score >= 0.6").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    assert got == {(r.a_id, r.b_id): (r.score, r.rank) for r in want.select("a_id", "b_id", "score", "rank").collect()} and got


def test_searched_candidates_of_odd_facts(spark, scratch):
    ents = spark.createDataFrame([("e1", "Apple Inc", "company")], "id string, canonical_name string, entity_type string")
    odd = [row("n1", v=None, subj=None, p=None, doc=None), row("n2", subj="", p="", doc=None), row("n3", subj="x" * 5000, e="e1"), row("r", e="e1", st="rejected"), row("a", e="e1"), row("b", subj="Apple Inc", doc="d2"), row("c", subj="Aple Inc", doc="d3", c="USD"), (None, *row("z")[1:])]
    f = spark.createDataFrame([r[:18] for r in odd], ", ".join(SCHEMA.split(", ")[:18]))
    got = {(r.a_id, r.b_id): r.entity_similarity for r in PR.search_candidates(f, ents, f, scratch, min_score=0.0, block=3).collect()}
    ids = {"n1", "n2", "n3", "a", "b", "c"}
    assert {x for p in got for x in p} == ids and len(got) == 30 and got["a", "b"] == 1.0 and got["n1", "a"] == 0.0
    assert PR.search_candidates(f, ents, f.limit(0), scratch).count() == 0 and PR.search_candidates(f.limit(0), ents, f, scratch).count() == 0


def test_searched_candidates_meet_only_what_can_rank(spark, scratch):
    rnd = random.Random(5)
    word = lambda n: "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    names, metrics = [f"{word(7)} {word(8)}" for _ in range(12)], [word(12) for _ in range(30)]
    rows = [row(f"f{k:05}", n=1.0, p=metrics[k // 12 % 30], subj=names[k % 12], doc=f"d{k % 50}", t="FY2023") for k in range(6000)]
    f = spark.createDataFrame([r[:18] for r in rows], ", ".join(SCHEMA.split(", ")[:18]))
    ents = spark.createDataFrame([], "id string, canonical_name string, entity_type string")
    work = spark.sparkContext.accumulator(0)
    got = PR.search_candidates(f, ents, f.where("id like '%00'"), scratch, work=work).collect()
    # no fact of another metric comes near ten facts of the same name and metric
    assert 0 < work.value < 0.5 * 60 * 6000 and len(got) == 600 and all(r.entity_similarity == r.predicate_similarity == 1.0 for r in got)
    of = {r[0]: (r[3], r[4], r[1]) for r in rows}
    for a in {r.a_id for r in got}:
        alike = sorted((of[a][2] == of[b][2], b) for b in of if b != a and of[b][:2] == of[a][:2])
        assert [r.b_id for r in sorted((r for r in got if r.a_id == a), key=lambda r: r.rank)] == [b for _, b in alike[:10]]


def test_names_are_bounded(k=400):
    import difflib

    import numpy as np
    import pandas as pd

    rnd = random.Random(3)
    names = ["", "a", "\u00e9" * 70, "x" * 64, *(" ".join("".join(rnd.choice("abcd\u00e9") for _ in range(rnd.randint(1, 7))) for _ in range(rnd.randint(1, 4))) for _ in range(k))]
    one = {"document": None, "entity": None, "kind": None, "predicate": "p", "currency": "", "unit": "", "percent": False, "money": False, "stated": False, "year": None, "family": None, "text": ""}
    q = PR._Side(pd.DataFrame([{"id": str(i), "name": n, **one} for i, n in enumerate(names[: k // 2])]))
    b = PR._Side(pd.DataFrame([{"id": str(i), "name": n, **one} for i, n in enumerate(names)]), q)
    i, j = np.repeat(np.arange(len(q.names)), len(b.names)), np.tile(np.arange(len(b.names)), len(q.names))
    first, second = PR._shared_names(q, b, np.arange(len(q.names)), np.arange(len(b.names))).ravel(), PR._ordered(q, b, i, j)
    for x in rnd.sample(range(len(i)), 4000):
        m, n = q.names[i[x]], b.names[j[x]]
        u, v = {*m.split()}, {*n.split()}
        true = round(max(difflib.SequenceMatcher(None, m, n).ratio(), len(u & v) / len(u | v) if u or v else 0.0), 4)
        assert true <= first[x] + 1e-6 and true <= second[x] + 1e-6


def test_missing_entities_are_resolved(spark):
    ents = spark.createDataFrame([("e1", "Acme Mining", "company", 1.0)], "id string, canonical_name string, entity_type string, confidence double")
    aliases = spark.createDataFrame([("e1", "AM")], "entity_id string, alias string")
    f = spark.createDataFrame([("a", None, "acme mining"), ("b", "", "AM"), ("c", "e9", "Acme Mining"), ("d", None, "Acme Mining Inc."), ("e", None, "Other"), ("f", None, None)], "id string, entity_id string, subject string")
    got = {r.id: r.entity_id for r in FA.with_entities(f, ents, aliases).collect()}
    assert [got[x] for x in "abcd"] == ["e1", "e1", "e9", "e1"] and got["e"].startswith("new:") and got["f"].startswith("new:") and len(got) == 6


def test_vectors(spark):
    c = lambda a, b: spark.createDataFrame([(a, b)], "a array<float>, b array<float>").select(V.cosine(F.col("a"), F.col("b")).alias("x")).first().x
    assert [round(c(*x), 6) for x in (([1.0, 2.0], [1.0, 2.0]), ([1.0, 0.0], [0.0, 1.0]), ([1.0], [-1.0]), ([], []), ([1.0], [1.0, 2.0]), ([0.0], [0.0]))] == [1, 0, -1, 0, 0, 0]
    assert c(None, [1.0]) == 0.0
    assert not V.embed(" ").any() and math.isclose((V.embed("revenue of acme") ** 2).sum(), 1.0)
    v = spark.createDataFrame([(k, [float(k % 7), float(k % 5), 1.0]) for k in range(200)] + [(900, None), (901, []), (902, [0.0, 0.0, 0.0]), (None, [1.0, 1.0, 1.0])], "vec_id int, embedding array<double>")
    got = {(r.query_id, r.vec_id) for r in V.vector_search(v, v.where("vec_id % 50 = 0"), 0.98, block=3).collect() if r.vec_id is not None}
    rows = {r.vec_id: r.embedding for r in v.collect() if r.vec_id is not None and r.embedding and any(r.embedding)}
    cos = lambda a, b: sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a) * sum(y * y for y in b))
    assert got == {(q, k) for q in rows if q % 50 == 0 for k in rows if k != q and cos(rows[q], rows[k]) >= 0.98}


# ---- facts and store


def test_duplicates_are_merged(spark):
    cols = "id string, document_id string, entity_id string, subject string, predicate string, value_text string, normalized_numeric_value double, unit string, normalized_unit string, currency string, time_text string, time_start string, time_end string, scope string, geography string, qualifiers_json string, source_quote string, source_page_start int, source_page_end int, source_block_ids_json string, extraction_confidence double, validation_status string, extraction_notes_json string, seq long"
    f = lambda i, seq, time, q, bl, pg, conf: (i, "d", None, "Acme", "revenue", "$120M", 1.2e8, None, None, "USD", time, None, None, None, None, None, q, pg, pg, bl, conf, "validated", "{broken", seq)
    r = FA.merge_duplicates(spark.createDataFrame([f("a", 1, "FY2025", "$120 million", '["block_1"]', 1, 0.9), f("b", 2, "FY2025", "$120M", '["block_10"]', 4, 0.95), f("c", 3, "FY2024", "$120M", None, 2, 0.5)], cols)).collect()
    m = {x.fact_id: x for x in r}
    assert set(m) == {"a", "c"} and (m["a"].page_start, m["a"].page_end, m["a"].block_ids, m["a"].quotes, m["a"].confidence) == (1, 4, "block_1,block_10", "$120 million | $120M", 0.95)
    assert m["a"].notes == "Deduplicated from 2 identical claims across pages 1–4." and m["c"].notes == ""


def test_store(spark, tmp_path):
    made = ST.create(spark, str(tmp_path))
    assert set(made) == set(schemas.TABLES) and ST.create(spark, str(tmp_path)) == []
    old, new = spark.createDataFrame([(1, "a"), (2, "b")], "id int, x string"), spark.createDataFrame([(2, "c"), (3, "d"), (3, "e")], "id int, x string")
    assert sorted(tuple(r) for r in ST.upsert(old, new, ["id"]).collect()) == [(1, "a"), (2, "c"), (3, "e")]
    assert sorted(tuple(r) for r in ST.update(old, spark.createDataFrame([(1, None), (2, "z")], "id int, x string"), "id").collect()) == [(1, "a"), (2, "z")]
    assert [r.id for r in ST.prune(old, new, "id").collect()] == [2]
    hits, misses = ST.with_cache(old.withColumnRenamed("x", "key"), spark.createDataFrame([("a", "yes")], "key string, answer string"), "key", "answer")
    assert [r.answer for r in hits.collect()] == ["yes"] and [r.key for r in misses.collect()] == ["b"]
    bad = spark.createDataFrame([("nonsense", 2.0), ("unrelated", 0.5), (None, None)], "relationship_type string, confidence double").withColumn("primary_dimension", F.lit("value"))
    assert {(r.column, r.rows) for r in schemas.contract_report(bad, "relationships").collect()} == {("relationship_type", 1), ("confidence", 1)}


# ---- sources


def test_uploads(spark, tmp_path):
    for name, data in (("a.pdf", b"%PDF-1 x"), ("b.PDF", b"%PDF-1 x"), ("c.txt", b"%PDF"), ("d.pdf", b"hello")):
        (tmp_path / name).write_bytes(data)
    up = files.uploads(spark, str(tmp_path))
    d = {r.filename: r.disposition for r in files.dispositions(up, spark.createDataFrame([], "id string, sha256 string")).collect()}
    assert d == {"a.pdf": "new", "b.PDF": "reused", "c.txt": "rejected", "d.pdf": "rejected"}
    known = up.where("filename = 'a.pdf'").select(F.lit("old").alias("id"), "sha256")
    assert {r.disposition for r in files.dispositions(up.where("problem is null"), known, force=True).collect()} == {"replaced"}
    t = files.text_pages(spark.createDataFrame([("d", "one\ftwo"), ("e", None)], "k string, t string"), "k", "t")
    assert sorted(tuple(r) for r in t.collect()) == [("d", 1, "one"), ("d", 2, "two"), ("e", 1, "")]


@pytest.mark.parametrize("kind", ["parquet", "orc", "json", "csv"])
def test_formats(spark, tmp_path, kind):
    w = spark.createDataFrame([("a", "1")], "k string, v string").write
    path = f"{tmp_path}/t.{kind}"
    (w.option("header", "true") if kind == "csv" else w).format(kind).save(path)
    assert [tuple(r) for r in files.read(spark, path, "k string, v string").collect()] == [("a", "1")]


def test_providers(spark):
    calls = []

    def flaky(x):
        calls.append(x)
        if len(calls) < 3:
            raise providers.Transient
        return x

    assert providers.retrying(flaky, 7, sleep=lambda s: None) == 7 and len(calls) == 3
    e = providers.embed_texts(spark.createDataFrame([("a", "x y"), ("b", None)], "k string, t string"), "k", "t", providers.HashEmbedder()).collect()
    assert {len(r.vector) for r in e} == {128} and {r.model for r in e} == {"hash-embedding-v1"}


def test_scorecard(spark):
    assert all(r.passed for r in demo.scorecard(spark).collect())


def test_pipeline_job(spark):
    from factweave.plans.pipeline import Job
    from tests.oracle import DATA

    job = Job({t: spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("document_files", "pages", "blocks", "facts", "entities")})
    out = job.run()
    assert [x[:2] for x in job.log] == [(s, "completed") for s in Job.STAGES]
    assert out["chunks"].count() and out["extracted"].count() and out["normalized"].count()


def test_job_relates_all_facts(spark):
    from factweave.plans.pipeline import Job

    t = demo.tables(spark)
    job = Job({**t, "facts": t["facts"].withColumn("seq", F.col("seq") + 1)}, mode="relationship")
    job.normalise()
    job.relate()
    got = {(r.a_id, r.b_id) for r in job.t["related"].collect()}
    assert got >= {("0a", "0b"), ("1a", "1b"), ("2a", "2b")} and not [r for r in got if "3b" in r] and all(a < b for a, b in got)


def test_job_carries_extracted_facts_on(spark):
    from factweave.plans.pipeline import Job

    t = demo.tables(spark)
    pages = spark.createDataFrame([(f"p{k}", f"d{k}", 1, False, 1.0) for k in (1, 2)], "id string, document_id string, page_number int, is_scanned boolean, text_quality double")
    text = "Total sales were $120 million in that year."
    blocks = spark.createDataFrame([(f"b{k}", f"p{k}", 0, "paragraph", text, 1) for k in (1, 2)], "id string, page_id string, block_index int, block_type string, text string, reading_order int")
    old = t["facts"].limit(1).withColumns({"id": F.lit("old"), "document_id": F.lit("d1")}).unionByName(t["facts"].limit(1).withColumns({"id": F.lit("other"), "document_id": F.lit("elsewhere")}))
    quotes = F.array(F.lit("sales were $120 million"), F.lit("a quote that was invented for this"))

    def extract(chunks):
        return chunks.select(F.col("id").alias("chunk_id"), F.posexplode(quotes).alias("k", "source_quote")).withColumns({"value_text": F.lit("$120 million"), "value_type": F.lit("currency"), "subject": F.lit("Acme"), "predicate": F.lit("sales"), "scope": F.col("k").cast("string"), "confidence": F.lit(0.9)})

    given = {"pages": pages, "blocks": blocks, "facts": old, "entities": t["entities"], "document_files": t["document_files"]}
    out = Job(given, extract=extract).run()
    facts = {(r.document_id, r.source_quote): r for r in out["facts"].collect()}
    assert len(facts) == 5 and "old" not in {r.id for r in facts.values()} and "other" in {r.id for r in facts.values()}
    assert out["facts"].columns == t["facts"].columns and not out["facts"].where(F.size(schemas.violations("facts")) > 0).count()
    good, bad = facts["d1", "sales were $120 million"], facts["d1", "a quote that was invented for this"]
    assert (good.validation_status, good.source_block_ids_json, good.source_page_start) == ("validated", '["b1"]', 1) and (bad.validation_status, bad.source_block_ids_json) == ("rejected", "[]")
    assert {r.normalized_numeric_value for r in out["normalized"].where("id <> 'other'").collect()} == {1.2e8}
    assert [{r.a_id, r.b_id} for r in out["related"].collect()] == [{good.id, facts["d2", "sales were $120 million"].id}]
    for missing, stage in (("blocks", "chunk"), ("document_files", "normalise"), ("entities", "normalise")):
        job = Job({k: v for k, v in given.items() if k != missing}, extract=extract)
        with pytest.raises(ValueError, match=missing):
            job.run()
        assert job.log[-1][:2] == (stage, "failed")


def test_streams(spark, tmp_path):
    from factweave.streaming import ingest

    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    t = lambda s: F.lit(s).cast("timestamp")
    for k, (i, text, at) in enumerate([("a", "x", "2024-01-01 00:00:00"), ("b", "x", "2024-01-01 00:10:00"), ("a", "z", "2024-01-01 01:30:00")]):
        spark.range(1).select(F.lit(i).alias("id"), F.lit(text).alias("text"), t(at).alias("at")).coalesce(1).write.mode("append").parquet(src)
    schema = "id string, text string, at timestamp"
    q = ingest.first_contents(ingest.stream(spark, src, schema), "text", "at").writeStream.format("memory").queryName("firsts").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r.text for r in spark.table("firsts").collect()) == ["x", "z"]
    q = ingest.window_counts(ingest.stream(spark, src, schema), "at", "id").writeStream.outputMode("complete").format("memory").queryName("counts").start()
    q.processAllAvailable()
    q.stop()
    assert sorted((str(r.start)[11:13], r.id, r.n) for r in spark.table("counts").collect()) == [("00", "a", 1), ("00", "b", 1), ("01", "a", 1)]
    q = ingest.stream(spark, src, schema).writeStream.foreachBatch(ingest.upsert_into(out, ["id"])).option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    import glob

    last = sorted(glob.glob(out + "/v=*"), key=lambda p: int(p.rsplit("=", 1)[1]))[-1]
    assert sorted(r.id for r in spark.read.parquet(last).collect()) == ["a", "b"]


def test_stored_documents_are_replaced(spark, tmp_path):
    rows = lambda *x: spark.createDataFrame(x, "id string, document_id string")
    root = str(tmp_path)
    ST.store_documents(root, "pages", rows(("p1", "a"), ("p2", "a"), ("p3", "b"), ("p4", "c")), rows(("", "a"), ("", "b"), ("", "c")))
    ST.store_documents(root, "pages", rows(("p5", "a")), rows(("", "a"), ("", "b")))  # b is deleted
    assert sorted((r.id, r.document_id) for r in spark.read.parquet(f"{root}/pages").collect()) == [("p4", "c"), ("p5", "a")]


def test_vectors_are_reused(spark):
    ents = spark.createDataFrame([("e1", "Apple Inc")], "id string, canonical_name string")
    f = spark.createDataFrame([row("f1", e="e1")[:18], row("f2")[:18], row("f3", p="sales")[:18]], ", ".join(SCHEMA.split(", ")[:18]))
    have = ST.embed_facts(f.where("id <> 'f2'"), ents)
    changed = f.withColumn("scope", F.when(F.col("id") == "f3", "group"))
    v = {r.fact_id: r for r in ST.embed_facts(changed, ents, have).collect()}
    assert {k: r.reused for k, r in v.items()} == {"f1": True, "f2": False, "f3": False} and all(len(r.vector) == 128 for r in v.values())
    assert [r.fact_id for r in ST.fetch_vectors(have, f.where("id in ('f1', 'f2')")).collect()] == ["f1"]


def test_tables_follow_texts(spark):
    b = spark.createDataFrame([("b1", "p", 0, "paragraph", 4), ("b2", "p", 1, "paragraph", 9)], "id string, page_id string, block_index int, block_type string, reading_order int")
    t = spark.createDataFrame([("t1", "p", 7, "table", 5), ("t2", "p", 3, "table", 6), ("t3", "q", 0, "table", 1)], "id string, page_id string, block_index int, block_type string, reading_order int")
    got = {r.id: (r.block_index, r.reading_order) for r in PG.with_tables(b, t).collect()}
    assert got == {"b1": (0, 4), "b2": (1, 9), "t2": (2, 1000), "t1": (3, 1001), "t3": (0, 1000)}
    m = spark.createDataFrame([("a | b\n" + "-" * 40 + "\n1 | 2",), ("x",)], "t string").select(PG.table_metadata(PG.parse_table(F.col("t"))).alias("m")).collect()
    assert [r.m for r in m] == ['{"headers":["a","b"],"rows":[["1","2"]],"row_count":1,"col_count":2}', None]


def test_services(spark):
    said = []

    def limited(x):
        if len(said) < 2:
            raise providers.Limited("retryDelay: 9" if not said else "429")
        return x

    assert providers.retrying(limited, 1, sleep=said.append) == 1 and said == [10.5, 10.0]
    with pytest.raises(providers.Fatal):
        providers.retrying(lambda: (_ for _ in ()).throw(providers.Fatal("key")), sleep=lambda s: pytest.fail("waited"))

    class Words:
        version = "v1"

        def extract(self, prompts):
            return [[{"subject": "Acme", "source_quote": p.split("```")[1].strip()}] * ("two" in p) for p in prompts]

    chunks = spark.createDataFrame([("c1", "two words", '["A"]'), ("c2", "none", None)], "id string, text string, heading_path_json string")
    got = providers.extract_claims(chunks, Words()).collect()
    assert [(r.chunk_id, r.k, r.subject, r.source_quote, r.unit) for r in got] == [("c1", 0, "Acme", "two words", None)]

    class Reader:
        def text(self, image):
            return image.decode()

    pages = spark.createDataFrame([("a", True, b"seen", "x"), ("b", False, b"no", "y"), ("c", True, None, None), ("d", True, b"only", None)], "id string, is_scanned boolean, image binary, cleaned_text string")
    assert {r.id: r.cleaned_text for r in PG.with_recognized(pages, Reader()).collect()} == {"a": "x\n[OCR fallback]:\nseen", "b": "y", "c": None, "d": "\n[OCR fallback]:\nonly"}

    class Yes:
        def decide(self, pairs):
            return pairs.assign(type="uncertain", confidence=0.5, dimension="other", explanation=pairs.prompt.str.len().astype(str))

    f = spark.createDataFrame([row("1a", v="San Francisco", t="FY2023"), row("1b", v="Austin", t="FY2023")], SCHEMA)
    j = providers.judge_pairs(PR.compare(PR.pair_up(spark.createDataFrame([("1a", "1b")], "fact_a_id string, fact_b_id string"), f)), Yes()).collect()
    assert [(r.type, r.dimension) for r in j] == [("uncertain", "other")]


def test_reading_checks_its_arguments(spark):
    from factweave.operators import read as R

    t = demo.corpus(spark)
    assert t["relationships"].count() == 5 and t["facts"].count() == 13 and t["chunks"].count() == 3 and {r.status for r in R.jobs(t).collect()} == {"completed"}
    assert {r.id for r in R.facts(t, entity="northwind", predicate="REV").collect()} >= {"0a", "m0"} and R.facts(t, document_id="no").count() == 0
    assert {r.fact_b_id for r in R.document_relationships(t, "doc c").collect()} == {"m0", "m3"} and R.found(R.by_id(t, "facts", "m1")).subject == "Southgate Dairy"
    assert [r.id for r in R.search(t, "quill").collect()] == ["m2"] and R.enriched(t, text="b.pdf").count() == 3
    with pytest.raises(LookupError):
        R.found(R.by_id(t, "facts", "gone"))
    with pytest.raises(ValueError):
        R.facts(t, limit=501)
    from factweave.plans.pipeline import normalized

    assert R.reconcile(t | {"facts": normalized(t["facts"], t["document_files"])}, "0a", "m0").first().d.type == "corroborates" and R.reconcile(t, "0a", "gone").count() == 0


def test_command_line(spark, tmp_path, capsys):
    from factweave import cli
    from tests.oracle import DATA

    a, b = [r.id for r in spark.read.parquet(f"{DATA}/facts.parquet").select("id").distinct().orderBy("id").limit(2).collect()]
    assert cli.main(["evaluate"], spark) == 0 and cli.main([], spark) == 2
    assert cli.main(["reconcile", DATA, a, b], spark) == 0 and cli.main(["reconcile", DATA, a, "gone"], spark) == 1 and cli.main(["chunk", DATA], spark) == 0
    assert "pass" in capsys.readouterr().out


def test_jobs_tell_how_far_they_are(spark):
    from factweave.plans.pipeline import Job, launch

    t = demo.tables(spark)
    job = Job(t, mode="relationship")
    assert job.row("j").first().status == "queued"
    launch(job).join()
    r = job.row("j").first()
    assert (r.status, r.completed_items, r.current_stage) == ("failed", 0, "chunk") and "pages" in r.error_message and not schemas.contract_report(job.row("j"), "jobs").count()
