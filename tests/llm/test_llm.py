"""Each operator against brute force, and on nulls, empty and long texts, repeated rows,
ties, empty tables and columns of clashing names."""

import collections
import itertools
import json
import math
import random
import re
import time
import unicodedata

import pytest
from pyspark.sql import functions as F

from factweave.llm import boilerplate, components, leakage, lookalike, names, queries, scans, splitting, tokenize
from tests.oracle import DATA, connect, same

CLASH = ["key", "ids", "one", "form", "exact", "word", "line", "n", "u", "v", "m", "a", "b", "text2", "__row", "s", "k", "block", "words", "publisher2"]


def clash(df):
    """The table with columns whose names operators might use inside."""
    for c in CLASH:
        if c not in df.columns:
            df = df.withColumn(c, F.lit("x"))
    return df


@pytest.fixture(scope="module")
def con():
    return connect()


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_equals_sql(spark, con, name):
    same(queries.queries()[name](spark, DATA), con, queries.oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(set(queries.queries()) - set(queries.oracle_sql())))
def test_runs(spark, name):
    queries.queries()[name](spark, DATA).collect()


# ---- 1


def random_text(rnd, n):
    return "".join(rnd.choice(["abc def. ", "x" * rnd.choice([1, 50, 5000]), "\n", "\n\n", "a | b\n", "- entry\n", "あ。"]) for _ in range(n))


def test_pieces_lose_nothing():
    rnd = random.Random(1)
    for _ in range(200):
        t = random_text(rnd, rnd.randint(1, 600))
        p = splitting.split_text(t, [])
        assert all(len(x[1]) // 4 <= 800 for x in p) and "".join(x[1][x[4] :] for x in p) == t
        assert all(b[4] // 4 <= 100 and b[3] + b[4] == a[3] + len(a[1]) for a, b in zip(p, p[1:]))


def test_cuts_are_natural_where_they_can_be():
    topic = lambda w: " ".join(f"{w} {w}s matter here." for _ in range(50))
    t = "\n\n".join(topic(w) for w in ("river", "engine", "garden", "market", "winter"))
    kinds = {x[5] for x in splitting.split_text(t, [])[:-1]}
    assert kinds <= {"paragraph", "sentence", "entry", "block"}
    assert splitting.split_text(t, [])[0][5] == "paragraph"  # the valley between two topics


def brute_similarities(bags):
    out = []
    for g in range(1, len(bags)):
        left, right, k = collections.Counter(), collections.Counter(), g - 1
        while k >= 0 and left.total() < splitting.SIDE_WORDS:
            left.update(bags[k][-splitting.SIDE_WORDS :])
            k -= 1
        k = g
        while k < len(bags) and right.total() < splitting.SIDE_WORDS:
            right.update(bags[k][: splitting.SIDE_WORDS])
            k += 1
        dot = sum(c * right[w] for w, c in left.items())
        norm = math.sqrt(sum(c * c for c in left.values()) * sum(c * c for c in right.values()))
        out.append(dot / norm if norm else 0.0)
    return out


def test_cohesion_equals_brute_force():
    rnd = random.Random(4)
    for _ in range(200):
        bags = [[rnd.choice("abcdefgh") for _ in range(rnd.choice([0, 0, 3, 20, 59, 60, 61, 150]))] for _ in range(rnd.randint(1, 30))]
        assert splitting.similarities(bags) == brute_similarities(bags)


@pytest.mark.parametrize("unit", ["12 | 34 | 56\n", "The same sentence stands here again. ", " ", "x"])
def test_time_is_in_proportion_to_the_text(unit):
    text, at = unit * (10_000_000 // len(unit)), time.time()
    pieces = splitting.split_text(text, [])
    assert time.time() - at < 60 and "".join(p[1][p[4] :] for p in pieces) == text and all(len(p[1]) // 4 <= 800 for p in pieces)


def test_a_long_row_is_a_row():
    assert splitting.places("a" * 3000 + " | b\nsecond line", [])[3005] == splitting.ENTRY


def test_oversized_chunks(spark, scratch):
    long, mid = "word. " * 700, "x" * 1000
    chunks = clash(spark.createDataFrame([("c1", long, '["b1", "b2"]', None), ("c1", long, '["b1", "b2"]', None), ("c2", "\n\n".join([mid] * 4), '["b2", "b2"]', "[]"), ("c3", None, None, None), ("c4", "", "[]", None), ("c5", "y" * 100000, "{broken", None), (None, long, None, None), ("c6", "z" * 3203, "[]", None)], "id string, text string, block_ids_json string, heading_path_json string"))
    blocks = clash(spark.createDataFrame([("b1", long, "paragraph"), ("b2", mid, None), (None, "q", None), ("b3", None, "table")], "id string, text string, block_type string"))
    assert {tuple(r) for r in splitting.found_oversized(chunks, blocks, scratch).collect()} == {("c1", "b1"), ("c2", ""), ("c5", "")}
    pieces = splitting.all_pieces(chunks, blocks, scratch).collect()
    assert max(r.token_count for r in pieces if r.chunk_id) <= 800
    by = collections.defaultdict(list)
    for r in pieces:
        by[r.chunk_id].append(r)
    assert [r.text for r in by["c3"]] == [None] and [r.text for r in by["c4"]] == [""] and len(by["c6"]) == 1
    assert "".join(r.text[r.overlap_chars :] for r in sorted(by["c5"], key=lambda r: r.piece)) == "y" * 100000
    assert splitting.found_oversized(chunks.limit(0), blocks.limit(0), scratch).count() == 0


# ---- 2


def test_boilerplate(spark, scratch):
    legal, share = "  This Notice is for holders of 12 shares only! ", ">> SHARE this report: copy link - mail"
    files, pages = [], []
    for k in range(10):
        files.append((f"d{k}", "P"))
        pages.append((f"p{k}", f"d{k}", f"Body {'abcdefghij'[k]} is long enough to count\n\n{legal.replace('12', str(k))}\n{share.lower() if k % 2 else share}" + ("\nrare but long enough line" if k < 3 else "") + "\nshort 1"))
    files += [("n1", None), ("d0", "P"), (None, "P"), ("lone", "Q")]
    pages += [("px", "n1", legal), ("py", None, legal), ("pz", "d1", None), ("pw", "d2", ""), (None, "d3", legal), ("pq", "lone", legal)]
    f = clash(spark.createDataFrame(files, "id string, publisher string"))
    p = clash(spark.createDataFrame(pages, "id string, document_id string, raw_text string"))
    got = {tuple(r) for r in boilerplate.found_lines(p, f, scratch).collect()}
    assert got == {(f"p{k}", n) for k in range(10) for n in (3, 4)}
    nodes, hits = boilerplate.boilerplate(p, f, scratch)
    blocks = {r.node: r.block for r in nodes.collect()}
    assert len(set(blocks.values())) == 1  # consecutive lines are one block
    texts = spark.createDataFrame([("t1", "P", f"Keep me please\n{legal}\nand me"), ("t2", "Q", legal), ("t3", None, legal), ("t4", "P", None)], "id string, publisher string, text string")
    out = {r.id: (r.text, r.removed) for r in boilerplate.without_lines(texts, "text", "publisher", nodes).collect()}
    assert out == {"t1": ("Keep me please\nand me", 1), "t2": (legal, 0), "t3": (legal, 0), "t4": (None, 0)}
    # `short 1` is removed with its block, and stays where it stands alone
    texts = clash(spark.createDataFrame([("t5", "P", f"Keep\n{share}\n\nshort 2\nshort 3"), ("t6", "P", "short 1\nKeep"), ("t7", "P", "")], "id string, publisher string, text string"))
    out = {r.id: (r.text, r.removed) for r in boilerplate.without_lines(texts, "text", "publisher", nodes).collect()}
    assert out == {"t5": ("Keep\n", 3), "t6": ("short 1\nKeep", 0), "t7": ("", 0)}
    assert {r.n_lines for r in boilerplate.block_lines(nodes).collect()} == {3} and boilerplate.block_lines(nodes).count() == 3
    assert {(r.page_id, r.line_no) for r in hits.collect()} == {(f"p{k}", n) for k in range(10) for n in ((3, 4, 6) if k < 3 else (3, 4, 5))} - {(f"p{k}", 6) for k in range(3)}
    assert boilerplate.found_lines(p.limit(0), f.limit(0), scratch).count() == 0


# ---- 3


def scanned(spark):
    body = ["The committee reviewed the maintenance programme and recorded open items.", "Management considers the long-term estimate to be sustainable.", "The committee approved additional maintenance for the department."]
    pages = []
    for k in range(40):
        own = [f"Section {chr(97 + k % 26) * (3 + k // 26 + j)} begins" for j in range(3)]
        text = [f"Acme Review 2020   Page {k % 4 + 1} of 4", *own[:2], *body, own[2], f"Working copy, file 4bd0 {k % 4 + 1}" if k % 2 else "Working  copy, file 4bd0", f"- {k % 4 + 1} -"]
        pages.append((f"p{k}", f"d{k // 4}", k % 4 + 1, "\n".join(text)))
    bad = "The cornmittee reviewed the main-\ntenance programme and recordcd the long-\nterm estimate. Purcstand AG and unit L70-0b and CO2\nbought sustain¬\nable items with Managernent.\nManagernent considers 0pen items.\r\n7"
    pages += [("bad", "x", 7, bad), ("null", "x", 1, None), ("empty", "x", 2, ""), ("long", "x", 3, "Z9" * 200000), (None, "x", 4, bad), ("nofile", None, None, "7\nx")]
    return clash(spark.createDataFrame(pages, "id string, document_id string, page_number int, raw_text string"))


def test_scans(spark, scratch):
    s = scans.Scan(scanned(spark), scratch, context=True)
    got = collections.defaultdict(set)
    for r in s.found().collect():
        got[r.page_id].add((r.line_no, r.kind))
    assert got["bad"] == {(1, "split_word"), (4, "split_word"), (1, "misread"), (2, "misread"), (6, "misread"), (7, "page_no")}
    assert got["p5"] == {(1, "running"), (8, "running"), (9, "page_no")}
    assert not got["null"] | got["empty"] | got["long"]
    text = {r.page_id: r.repaired for r in s.repaired().collect()}
    assert text["bad"] == "The committee reviewed the maintenance programme and recorded the long-term estimate. Purcstand AG and unit L70-0b and CO2 bought sustainable items with Managernent. Management considers open items."
    assert "Page" not in text["p5"] and "Working" not in text["p5"] and text["empty"] == ""
    assert scans.Scan(scanned(spark).limit(0), scratch).found().count() == 0


def brute_distance(printed, seen):
    d = [[99.0] * (len(seen) + 1) for _ in range(len(printed) + 1)]
    d[0][0] = 0.0
    for i in range(len(printed) + 1):
        for j in range(len(seen) + 1):
            if i and j and printed[i - 1] == seen[j - 1]:
                d[i][j] = min(d[i][j], d[i - 1][j - 1])
            for a, b in ((1, 1), (1, 2), (2, 1), (2, 2)):
                if i >= a and j >= b and (printed[i - a : i], seen[j - b : j]) in scans.CONFUSIONS:
                    d[i][j] = min(d[i][j], d[i - a][j - b] + scans.CONFUSED)
    return d[-1][-1]


def test_distance():
    assert scans.distance("maintenance", "malntenance") == pytest.approx(0.3) and scans.distance("in", "m") == pytest.approx(0.3)
    assert scans.distance("abc", "abc") == 0 and scans.distance("cat", "dog") >= 1
    rnd = random.Random(6)
    for _ in range(3000):
        w = "".join(rnd.choice("mrnicldhuvwioae") for _ in range(rnd.randint(1, 12)))
        v = w
        for _ in range(rnd.randint(0, 3)):
            v = rnd.choice(sorted(confused(v))) if confused(v) else v
        want = brute_distance(w, v)
        assert scans.distance(w, v) == pytest.approx(want) if want <= 2 * scans.CONFUSED + 0.01 else scans.distance(w, v) >= 1


def confused(w):
    return {w[:i] + b + w[i + n :] for n in (1, 2) for i in range(len(w) - n + 1) for b in scans.SEEN_AS.get(w[i : i + n], ())}


def test_repairs_meet_in_the_index():
    rnd = random.Random(9)
    for _ in range(1500):
        w = "".join(rnd.choice("mrnicldhuvwioaetsp") for _ in range(rnd.choice([3, 5, 8, 9, 14, 31, 32, 33, 34, 40, 60])))
        v = w
        for _ in range(rnd.choice([1, 2]) if len(w) >= scans.LONG else 1):
            v = rnd.choice(sorted(confused(v))) if confused(v) else v
        if 3 <= len(v) and v != w and scans.distance(w, v) < 1:
            assert scans.keys(w, True) & scans.keys(v, False), (w, v)


# ---- 5


def brute_components(pairs):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {(x, find(x)) for x in list(parent)}


@pytest.mark.parametrize("kind", ["random", "chain", "star", "cliques"])
def test_components(spark, scratch, kind):
    rnd = random.Random(5)
    n = 300
    pairs = {
        "random": [(rnd.randrange(n), rnd.randrange(n)) for _ in range(260)], "chain": [(k, k + 1) for k in rnd.sample(range(n), n - 1)], "star": [(n, k) for k in range(n)],
        "cliques": [(10 * c + i, 10 * c + j) for c in range(20) for i in range(6) for j in range(i)],
    }[kind]
    pairs = [(f"v{a:04d}", f"v{b:04d}") for a, b in pairs]
    df = spark.createDataFrame(pairs + pairs[:5] + [(b, a) for a, b in pairs[:5]] + [("q", "q"), (None, "z"), ("z", None)], "a string, b string")
    got = {tuple(r) for r in components.components(df, scratch).collect()}
    assert got == brute_components((a, b) for a, b in pairs if a != b)


def test_fact_groups(spark, scratch):
    r = clash(spark.createDataFrame([("f1", "f2", " Corroborates"), ("f3", "f2", "corroborates\t"), ("f4", "f5", "contradicts"), ("f6", "gone", "corroborates"), ("f7", "f7", "corroborates"), ("f8", None, "corroborates"), ("f8", "f1", None)], "fact_a_id string, fact_b_id string, relationship_type string"))
    f = clash(spark.createDataFrame([(f"f{k}",) for k in range(9)] + [("f1",), (None,)], "id string"))
    assert {tuple(x) for x in components.fact_groups(r, f, scratch).collect()} == {(f"f{k}", "f1") for k in (1, 2, 3)}
    assert components.fact_groups(r.limit(0), f, scratch).count() == 0


# ---- 6

ENTITIES = [("e1", "Sezeland Mining Manufacturing Inc."), ("e2", "Remilmock Water Group Pte. Ltd."), ("e3", "Remilmock Energy Group AG"), ("e4", "Theodore A. Kavolten"), ("e5", "Edward Kavolten"), ("e6", "Josephine Helorgor"), ("e7", "Jonathan Helorgor"), ("e8", None)]


@pytest.mark.parametrize("spelling, entity", [
    ("SMM Inc.", "e1"), ("SMM AG", None), ("Sezeland & Co. Mining", "e1"), ("sezeland mining mfg", "e1"), ("Manufacturing of Sezeland Mining", "e1"), ("Seze1and Mng Mfg GmbH", "e1"), ("SezelandMining", "e1"), ("Szeland Mining", "e1"), ("Sezeland", "e1"),
    ("Remilmock", None), ("Water, Remilmock", "e2"), ("Remilmotck Wate. Grp LLC", "e2"), ("Remilmock E. Group", "e3"), ("Kavolten, Ted", "e4"), ("E. Kavolten", "e5"), ("KAVOLTEN Theodore", "e4"), ("Theodore B. Kavolten", None), ("J. Helorgor", None), ("Josie Helorgor", "e6"), ("Ms/Mr Jon Helorgor", "e7"),
    ("Jonathan Helmaskmar", None), ("the company", None), ("management", None), ("Board of Directors", None), ("Cumbandey Shipping Group PLC", None), ("", None), ("?", None), ("x" * 100000, None),
])
def test_spelling(spelling, entity):
    scored = sorted(((names.fit(names.parse(spelling), names.parse(n)), i) for i, n in ENTITIES if n), reverse=True)
    scored = [x for x in scored if x[0] >= names.LEAST]
    best = [i for s, i in scored if s >= scored[0][0] - names.MARGIN] if scored else []
    assert (best[0] if len(best) == 1 else None) == entity


def test_assignment_equals_brute_force():
    rnd = random.Random(1)
    for _ in range(500):
        n = rnd.randint(1, 4)
        gain = [[rnd.choice([names.NEVER, rnd.random()]) for _ in range(rnd.randint(n, 5))] for _ in range(1)]
        gain += [[rnd.choice([names.NEVER, rnd.random()]) for _ in gain[0]] for _ in range(n - 1)]
        best = max(sum(gain[i][c] for i, c in enumerate(o)) for o in itertools.permutations(range(len(gain[0])), n))
        assert names.assignment(gain) == pytest.approx(best)


def test_variants_meet():
    assert names.whole("abcd") & names.whole("abd") and names.whole("abcd") & names.whole("abxd") and names.whole("abcd") & names.whole("acbd")
    assert not names.whole("abcd") & names.whole("axyd") and len(names.whole("abc")) == 4 and len(names.whole("x" * 10000)) == 2
    p = names.parse
    assert names.variant(p("Szelnd Mining"), p("szeland  mining")) and not names.variant(p("Remilmock Water"), p("Remilmock Energy")) and not names.variant(p("Acme Mining AG"), p("Acme Mining Inc"))


def test_clusters_reach_variants_of_variants(spark, scratch):
    e = spark.createDataFrame([("e1", "Sezeland Mining Inc."), ("e2", "Wei Li"), ("e3", "Kavolten Trading AG"), ("e4", "Kavolden Trading AG")], "id string, canonical_name string")
    rows = [("f1", "Szeland Mining"), ("f2", "Szelnd Mining"), ("f3", "Szlnd Mining"), ("f4", "li wei"), ("f5", "Wei Li"), ("f6", "Kavolten Trading"), ("f7", "Kavolden Trading"), ("f8", " ".join(["word"] * 50000)), ("f9", "x" * 300000)]
    f = spark.createDataFrame([(i, None, s, None) for i, s in rows], "id string, entity_id string, subject string, subject_mention string")
    got = {tuple(r) for r in names.found_entities(f, e, scratch).collect()}
    assert got >= {("f1", "e1"), ("f2", "e1"), ("f5", "e2"), ("f6", "e3"), ("f7", "e4")} and not {i for i, _ in got} & {"f8", "f9"}
    scored = spark.createDataFrame([("szeland mining||", "e1", 0.9)], "form string, entity_id string, score double")
    forms = spark.createDataFrame([("szeland mining||",), ("szelnd mining||",), ("zelnd mining||",), ("other||",)], "form string")
    links = names.form_links(scored)
    found = names.clustered(links, names.form_variants(forms, scored, links), scratch)
    assert {tuple(r) for r in found.collect()} == {("szeland mining||", "e1"), ("szelnd mining||", "e1")}


def test_names_meet_in_a_block():
    for a, b in [("Sezeland", "Szeland"), ("Kavolten", "Kavotlen"), ("Helorgor", "Helorgur"), ("Remilmock", "Remimock"), ("Remilmock", "Remilmotck")]:
        assert set(names.keys((a.lower(),))) & set(names.keys((b.lower(),)))


def test_found_entities(spark, scratch):
    e = clash(spark.createDataFrame(ENTITIES + ENTITIES[:1], "id string, canonical_name string"))
    rows = [("f1", None, "Szeland Mining", None), ("f1", None, "Szeland Mining", None), ("f2", None, "the Group", "Kavolten, Ted"), ("f3", "e1", "Edward Kavolten", None), ("f4", None, "Edward Kavolten", "Josie Helorgor"), ("f5", None, None, None), (None, None, "Edward Kavolten", None), ("f6", None, " ", "x" * 10000), ("f7", None, "Edward Kavolten", "E. Kavolten")]
    f = clash(spark.createDataFrame(rows, "id string, entity_id string, subject string, subject_mention string"))
    assert {tuple(r) for r in names.found_entities(f, e, scratch).collect()} == {("f1", "e1"), ("f2", "e4"), ("f7", "e5")}
    assert names.found_entities(f.limit(0), e, scratch).count() == 0 and names.found_entities(f, e.limit(0), scratch).count() == 0


def test_held_out_accuracy(con):
    """Spellings of facts whose entity is known."""
    ents = con.execute("select id, canonical_name from entities").fetchall()
    rows = con.execute("select distinct entity_id, subject from facts where entity_id is not null").fetchall()
    parsed = [(i, names.parse(n)) for i, n in ents]
    block = collections.defaultdict(set)
    for i, p in parsed:
        for k in names.keys(p.tokens[:1] if p.legal else p.tokens[-1:]):
            block[k].add(i)
    of, right, wrong = dict(parsed), 0, 0
    for e, s in rows:
        p = names.parse(s)
        c = sorted(((names.fit(p, of[i]), i) for i in set().union(*(block.get(k, set()) for k in names.keys(p.tokens)))), reverse=True)
        if c and c[0][0] >= names.LEAST and (len(c) == 1 or c[1][0] < c[0][0] - names.MARGIN):
            right, wrong = right + (c[0][1] == e), wrong + (c[0][1] != e)
    assert wrong == 0 and right >= 0.95 * len(rows)


# ---- 8


def test_encoding_is_exact():
    enc = tokenize.encoder(tokenize.default_vocabulary())
    rnd = random.Random(3)
    kinds = ["abcdefgh", "日本語監査人は重要な誤りを。", "0123456789", "aaaaaaab", "  \n\t", "'s't!?..", "éüß🧾"]
    for _ in range(120):
        t = "".join(rnd.choice(rnd.choice(kinds)) for _ in range(rnd.choice([10, 3000]))) + "".join(rnd.choice(kinds[0]) for _ in range(rnd.choice([0, 5000])))
        assert enc.encode(t) == enc.bpe.encode_ordinary(t)
        assert enc.bpe.decode(enc.encode(t)) == t
    for _ in range(600):
        t = "".join(rnd.choice(rnd.choice(kinds)) for _ in range(rnd.choice([10, 30, 300])))
        c = tokenize.cut_points(t, rnd.choice([3, 7, 20, 64]))
        assert "".join(t[a:b] for a, b, _ in c) == t
        assert tokenize.concat(enc, [t[a:b] for a, b, _ in c], [enc.encode(t[a:b]) for a, b, _ in c], [h for *_, h in c]) == enc.bpe.encode_ordinary(t)


def test_encoding_of_a_table(spark):
    enc = tokenize.encoder(tokenize.default_vocabulary())
    texts = ["Hello world", None, "", " ", "<|endoftext|> is text", "x" * 5000, "日本" * 3000, "many words " * 2000, "many words " * 2000]
    df = clash(spark.createDataFrame([(k if k < 8 else None, t) for k, t in enumerate(texts)], "doc_id long, text string"))
    out = tokenize.encode_documents(df, segment_chars=1000).collect()
    assert len(out) == len(texts) and "text" not in out[0].asDict() and out[0].k == "x"
    for r in out:
        assert list(r.ids) == enc.bpe.encode_ordinary(texts[8 if r.doc_id is None else r.doc_id] or "")
    assert tokenize.encode_documents(df.limit(0)).count() == 0


# ---- 9


def test_leaks_equal_brute_force(spark, scratch):
    rnd = random.Random(7)
    vocab = [f"w{k}" for k in range(400)]
    common = ["the", "of", "and", "to", "in"]
    text = lambda n: [rnd.choice(vocab if rnd.random() < 0.6 else common) for _ in range(n)]
    items = [(k, " ".join(text(rnd.randint(12, 50))), "a") for k in range(30)] + [(30, None, None), (31, "", ""), (32, "too short", "x"), (33, "yes " * 20, None)]
    items += [(34, items[0][1], "b"), (None, items[1][1], "c")]
    docs = []
    for k in range(300):
        d = text(rnd.randint(0, 120))
        if k % 3 == 0:
            src = rnd.choice(items[:30])[1].split()
            n = min(len(src), rnd.choice([9, 11, 12, 13, 20]))
            at, to = rnd.randint(0, len(src) - n), rnd.randint(0, len(d))
            d[to:to] = [w.upper() if rnd.random() < 0.2 else w + rnd.choice([",", "", "​"]) for w in src[at : at + n]]
        docs.append((k, " ".join(d)))
    docs += [(300, None), (301, ""), (302, "yes " * 5000), (303, items[2][1] * 3), (303, items[2][1] * 3), (None, items[3][1])]
    index = collections.defaultdict(set)
    for i, t, _ in items:
        w = leakage.words(t)
        for k in range(len(w) - 11):
            index[tuple(w[k : k + 12])].add(i)
    want = set()
    for i, t in docs:
        w = leakage.words(t)
        for k in range(len(w) - 11):
            want |= {(i, j) for j in index.get(tuple(w[k : k + 12]), ()) if i is not None and j is not None}
    d = clash(spark.createDataFrame(docs, "doc_id long, text string"))
    q = clash(spark.createDataFrame(items, "item_id long, text string, answer string"))
    for rank, block in ((16, leakage.BLOCK_BYTES), (128, 300_000), (384, leakage.BLOCK_BYTES)):
        assert {tuple(r) for r in leakage.shared_runs(d, q, scratch, rank=rank, block=block).collect()} == want
    assert leakage.shared_runs(d.limit(0), q, scratch).count() == 0 and leakage.shared_runs(d, q.limit(0), scratch).count() == 0


def test_word_comparisons():
    rnd = random.Random(2)
    for _ in range(200):
        a, b = ([rnd.choice("abc") for _ in range(rnd.randint(0, 15))] for _ in range(2))
        run = max((n for n in range(1, 16) for i in range(len(a) - n + 1) for j in range(len(b) - n + 1) if a[i : i + n] == b[j : j + n]), default=0)
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert leakage.longest_run(a, b) == run and leakage.common_subsequence(a, b) == table[-1][-1]


def test_paraphrases_are_reported(spark, scratch):
    item = "a ferry operator in marrowby exports many spindles at a fixed price each after several buyers withdraw from the joint tender"
    w = item.split()
    near = " ".join(x for k, x in enumerate(w) if k % 7)
    docs = spark.createDataFrame([(1, f"{near} 42 crowns"), (2, item), (3, "nothing of the kind is said in this quite different text about other things")], "doc_id long, text string")
    got = {r.doc_id: (r.kind, r.has_answer) for r in leakage.leak_report(docs, spark.createDataFrame([(1, item, "42 crowns")], "item_id long, text string, answer string"), scratch).collect()}
    assert got == {1: ("paraphrase", True), 2: ("verbatim", False)}


def test_paraphrases_without_runs_equal_brute_force(spark, scratch):
    rnd = random.Random(5)
    vocab = [f"w{k}" for k in range(300)] + ["the", "of"] * 40
    items = [(k, " ".join(rnd.choice(vocab) for _ in range(rnd.randint(12, 40))), None) for k in range(25)] + [(25, "yes no " * 8 + "x", None)]
    docs = []
    for k in range(200):
        w = leakage.words(rnd.choice(items)[1])
        step = rnd.randint(2, 6)
        docs.append((k, " ".join([f"n{j}" if j % step == 0 else x for j, x in enumerate(w)] + [rnd.choice(vocab) for _ in range(rnd.randint(0, 60))])))
    want = {}
    for d, t in docs:
        for i, u, _ in items:
            a, b = leakage.words(t), leakage.words(u)
            n, c = leakage.longest_run(a, b), max(leakage.common_subsequence(a[k : k + 2 * len(b)], b) for k in range(0, max(1, len(a) - len(b)), len(b) // 2))
            if len(a) >= leakage.RUN and n < leakage.RUN and c >= 0.6 * len(b):
                want[d, i] = (n, c)
    assert sum(n < leakage.RUN // 2 for n, _ in want.values()) > 50
    got = leakage.leak_report(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string, answer string"), scratch, block=300_000).where("kind = 'paraphrase'").collect()
    assert {(r.doc_id, r.item_id): (r.run, r.lcs) for r in got} == want


def test_planted_paraphrases(spark, scratch, con):
    """Recall and precision on the evaluation texts, in the midst of the corpus' own text."""
    rnd = random.Random(8)
    items = con.execute("select item_id, text from eval_items where text is not null").fetchall()
    corpus = [x for (x,) in con.execute("select text from documents where length(text) > 200").fetchall()]
    docs, planted = [], {}
    for k in range(400):
        i, t = rnd.choice(items)
        w = leakage.words(t)
        keep = [x for j, x in enumerate(w) if j % rnd.choice([5, 6, 7])] if k % 2 else w
        keep = [y for x in keep for y in ([x, rnd.choice(["indeed", "also", "rather"])] if rnd.random() < 0.1 else ["quiet"] if rnd.random() < 0.1 else [x])]
        docs.append((k, f"{rnd.choice(corpus)} {' '.join(keep)}. {rnd.choice(corpus)}" if k < 300 else rnd.choice(corpus)))
        if k < 300:
            planted[k] = i
    got = leakage.leak_report(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(*r, None) for r in items], "item_id long, text string, answer string"), scratch).collect()
    best = {}
    for r in got:
        best.setdefault(r.doc_id, []).append((max(r.lcs, r.run) / r.n_words, r.item_id))
    recall = sum(any(i == planted[k] for _, i in best.get(k, [])) for k in planted) / len(planted)
    own = {i for k, v in best.items() if k < 300 for _, i in v}
    right = sum(max(v)[1] == planted[k] for k, v in best.items() if k in planted)
    assert recall >= 0.95 and right / sum(k in planted for k in best) >= 0.9 and own


# ---- 10

ALIKE = [("ｶﾞ", "ガ"), ("éa", "éa"), ("ﬁx", "fix"), ("a​b", "ab"), ("а", "a"), ("a　b", "a b"), ("ё", "ë"), ("x­‍y", "xy"), ("Ａ１：", "A1:"), ("e​́", "é"), ("Å", "Å"), ("ΑΒΕ", "ABE"), ("no break", "no break")]
DIFFERENT = [("a b", "a  b"), ("A", "a"), ("“q”", '"q"'), ("a–b", "a-b"), ("0", "O"), ("1", "l"), ("👩‍🔧", "👩🔧"), ("a\tb", "a b"), ("№", "No"), ("é", "e"), ("ж", "x"), ("क्‍ष", "क्ष")]


ALIKE += [("Ⅳ", "IV"), ("𝐀b", "Ab"), ("α", "a"), ("हि\u200cन्दी", "हिन्दी"), ("ոо", "no")]
DIFFERENT += [("क्\u200cष", "क्ष"), ("می\u200cروم", "میروم"), ("к", "k"), ("½", "1/2"), ("²", "2")]


def test_words_of_one_script_stay_readable():
    t = lookalike.transducer()
    s = "Аудиторы проверили отчёт и Ｗater; Rероrt, Αθήνα, κόσμος"
    assert t.readable(s) == "Аудиторы проверили отчёт и Water; Report, Αθήνα, κόσμος"
    assert t(s) == t(t.readable(s)) == t("Аудиторы проверили отчёт и Water; Report, Αθήνα, κόσμος")


def test_groups_of_lookalikes(spark):
    docs = [(1, "Report"), (2, "Repоrt"), (3, "Report"), (4, "Ｒeport"), (5, "report"), (6, None), (7, " "), (None, "Report")]
    df = clash(spark.createDataFrame(docs, "doc_id long, text string"))
    got = {r.doc_id: (r.form, r.links) for r in lookalike.lookalike_groups(df).collect()}
    assert {k: v[1] for k, v in got.items()} == {1: 2, 2: 2, 3: 2, 4: 2, 5: 0} and len({got[k][0] for k in (1, 2, 3, 4)}) == 1
    assert lookalike.lookalike_groups(df.limit(0)).count() == 0


@pytest.mark.parametrize("a, b", ALIKE)
def test_alike(a, b):
    t = lookalike.transducer()
    assert t(a) == t(b) and t(t(a)) == t(a)


@pytest.mark.parametrize("a, b", DIFFERENT)
def test_different(a, b):
    t = lookalike.transducer()
    assert t(a) != t(b)


def test_plain_text_stays():
    t = lookalike.transducer()
    s = "".join(chr(c) for c in range(0x20, 0x7F)) + "\n\t äöüß 監査人 검토 العربية"
    assert t(s) == unicodedata.normalize("NFC", s)


def test_lookalike_pairs(spark, scratch):
    docs = [(1, "Report on Water"), (2, "Repоrt on Water"), (3, "Report on Water"), (4, "Report on Water"), (5, "report on Water"), (6, None), (7, ""), (8, "​"), (9, " "), (10, "​​"), (None, "Repоrt on Water"), (1, "Report on Water"), (11, "x" * 300000), (12, "х" * 300000)]
    df = clash(spark.createDataFrame(docs, "doc_id long, text string"))
    want = {(1, 2), (1, 3), (2, 3), (2, 4), (3, 4), (11, 12)}
    assert {tuple(r) for r in lookalike.lookalike_pairs(df, scratch).collect()} == want
    assert lookalike.lookalike_pairs(df.limit(0), scratch).count() == 0
    assert lookalike.with_canonical(df).where("doc_id is null").first().canonical == "Report on Water"


def test_the_library_does_not_need_this_package():
    import pathlib

    root = pathlib.Path(queries.__file__).parents[1]
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert not re.search(r"^\s*(from|import) factweave\.llm", p.read_text(), re.M), p
    assert json.dumps(sorted(queries.queries()))
