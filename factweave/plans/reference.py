"""Queries of the operators on documents, facts and relationships, each with the SQL
that says the same, where SQL can."""

from __future__ import annotations

from pyspark.sql import functions as F

from factweave import schemas
from factweave.functions import normalize as N
from factweave.functions import text as X
from factweave.functions import vectors as V
from factweave.operators import chunking, facts as FA, pages as PG, pairs as PR, store as ST, verify as VF
from factweave.session import Scratch, once, table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


#: DuckDB: the last delivery of each fact; white space at the ends; words of any white space.
LATEST = "lf AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY created_at DESC NULLS LAST, seq DESC) AS rn FROM facts) WHERE rn = 1)"
WS = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def strip_sql(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '^{WS}+', ''), '{WS}+$', '')"


def collapse_sql(x: str) -> str:
    return f"regexp_replace({x}, '{WS}+', ' ', 'g')"


def folded_sql(x: str) -> str:
    return f"lower({strip_sql(f'''coalesce({x}, '')''')})"


def latest_facts(spark, d):
    return FA.latest(table(spark, d, "facts"), ["id"], F.col("created_at"), F.col("seq"))


# ---- flagship -------------------------------------------------------------------------------------------------


@query("""
WITH amounts AS (
  SELECT c_custkey AS k, c_nationkey AS g, year(o_orderdate) AS y, round(sum(o_totalprice::DECIMAL(18,2)))::BIGINT AS amount
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2, 3
), pairs AS (
  SELECT k % 5 AS v, amount * 1000.0 AS a, CASE k % 5 WHEN 0 THEN amount * 1000.0 WHEN 1 THEN amount * 2000.0 WHEN 2 THEN amount * 250.0 WHEN 3 THEN amount * 600.0 ELSE amount * 700.0 END AS b FROM amounts
), decided AS (
  SELECT CASE v WHEN 0 THEN 'corroborates' WHEN 1 THEN 'contradicts' ELSE 'reconciles' END AS relationship_type,
         CASE v WHEN 0 THEN 'value' WHEN 1 THEN 'value' WHEN 2 THEN 'time' WHEN 3 THEN 'scope' ELSE 'unit' END AS primary_dimension FROM pairs
)
SELECT relationship_type, primary_dimension, count(*)::BIGINT AS n FROM decided GROUP BY 1, 2
""")
def reconcile_orders(spark, d):
    """Two reports on yearly order totals, read, normalised, compared and counted by outcome."""
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    j = o.join(c, o.o_custkey == c.c_custkey).groupBy("c_custkey", "c_nationkey", F.year("o_orderdate").alias("y")).agg(F.round(F.sum(F.col("o_totalprice").cast("decimal(18,2)"))).cast("bigint").alias("amount"))
    v, amount = F.col("c_custkey") % 5, F.col("amount")
    lit = F.lit
    value_b = F.when(v == 0, F.concat(amount, lit(",000 USD"))).when(v == 1, F.concat(lit("$"), amount * 2, lit(" thousand"))).when(v == 2, F.concat(lit("$"), amount * 250)).when(v == 3, F.concat(lit("$"), amount * 600)).otherwise(F.concat(amount * 700, lit("")))
    none = lit(None).cast("string")
    told = {
        "a": (F.concat(lit("$"), amount, lit(" thousand")), F.concat(lit("FY"), "y"), lit("consolidated")),
        "b": (value_b, F.when(v == 2, F.concat(lit("Q4 FY"), "y")).otherwise(F.concat(lit("FY"), "y")), F.when(v == 3, "segment").otherwise("consolidated")),
    }

    def report(s):
        """The facts of one report, as written."""
        value, time, scope = told[s]
        return j.select(lit(s).alias("side"), F.concat("c_custkey", lit("-"), "y").alias("key"), F.concat(lit("customer "), "c_custkey").alias("subject"), F.col("c_nationkey").cast("string").alias("geography"), value.alias("value_text"), time.alias("said"), scope.alias("scope"))

    f = N.with_numeric(report("a").unionByName(report("b")), "n", F.col("value_text"), none, none, none).withColumn("p", N.period(F.col("said"), none))
    # normalised facts are a stage of their own: each is compared, none is read twice from its text
    f = Scratch(spark, "reports").write(f.select("side", "key", "subject", "geography", "value_text", "scope", "n", "p"))
    f = f.select(
        "side", "key", F.concat("side", "key").alias("id"), F.col("side").alias("document_id"), none.alias("entity_id"), "subject", lit("total_revenue").alias("predicate"), "value_text", F.col("n.value_type").alias("value_type"),
        F.col("n.normalized").alias("normalized_numeric_value"), F.col("n.unit").alias("unit"), F.col("n.normalized_unit").alias("normalized_unit"), F.col("n.currency").alias("currency"), F.col("p.time_text").alias("time_text"), F.col("p.time_start").alias("time_start"),
        F.col("p.time_end").alias("time_end"), "scope", "geography", none.alias("qualifiers_json"), lit("validated").alias("validation_status"), none.alias("name"), none.alias("entity_type"),
    )
    pairs = PR.side(f.where("side = 'a'"), "a").join(PR.side(f.where("side = 'b'"), "b"), F.col("a_key") == F.col("b_key"))
    return PR.compare(pairs).groupBy(F.col("d.type").alias("relationship_type"), F.col("d.dimension").alias("primary_dimension")).agg(F.count(lit(1)).alias("n"))


# ---- documents, pages, blocks ------------------------------------------------------------------------------------


@query("""
SELECT doc_id, sha256(text) AS hash, coalesce(min(doc_id) OVER (PARTITION BY sha256(text)), doc_id) AS first, coalesce(text IS NOT NULL AND min(doc_id) OVER (PARTITION BY sha256(text)) < doc_id, false) AS is_duplicate
FROM documents WHERE text IS NOT NULL
UNION ALL SELECT doc_id, NULL, doc_id, false FROM documents WHERE text IS NULL
""")
def doc_hash_dedup(spark, d):
    """Content hash of every document and the first document with it."""
    return ST.first_by_hash(table(spark, d, "documents"), "text", "doc_id")


@query("""
WITH h AS (SELECT doc_id, sha256(text) AS hash, ingested_at < TIMESTAMP '2023-01-03' AS old FROM documents WHERE text IS NOT NULL AND ingested_at IS NOT NULL)
SELECT min(doc_id) AS doc_id, hash FROM h WHERE NOT old AND hash NOT IN (SELECT hash FROM h WHERE old) GROUP BY hash
UNION ALL SELECT doc_id, NULL FROM documents WHERE text IS NULL AND ingested_at >= TIMESTAMP '2023-01-03'
""")
def incremental_new_docs(spark, d):
    """Documents of a later delivery whose content is new."""
    docs = table(spark, d, "documents")
    old, new = docs.where("ingested_at < TIMESTAMP '2023-01-03'"), docs.where("ingested_at >= TIMESTAMP '2023-01-03'")
    return ST.new_documents(new, old, "text", "doc_id")


@query("""
WITH f AS (SELECT id, coalesce(original_filename, '') || '/' || id AS filename, sha256(coalesce(publisher, id)) AS sha256, created_at < TIMESTAMPTZ '2023-01-03' AS old, coalesce(lower(original_filename) LIKE '%.pdf', false) AS pdf FROM document_files),
k AS (SELECT sha256, min(id) AS known_id FROM f WHERE old GROUP BY 1), n AS (SELECT sha256, min(filename) AS first FROM f WHERE NOT old AND pdf GROUP BY 1)
SELECT f.filename, f.sha256, CASE WHEN pdf THEN coalesce(known_id, 'doc-' || substr(f.sha256, 1, 32)) END AS id, CASE WHEN NOT pdf THEN 'rejected' WHEN known_id IS NOT NULL THEN 'reused' WHEN f.filename > first THEN 'reused' ELSE 'new' END AS disposition
FROM f LEFT JOIN k USING (sha256) LEFT JOIN n USING (sha256) WHERE NOT old
""")
def upload_disposition(spark, d):
    """What becomes of each file of a later delivery: rejected, reused (known content) or new. The files have
    no equal contents, so the publisher stands for it."""
    from factweave.sources.files import dispositions

    name = F.concat(F.coalesce("original_filename", F.lit("")), F.lit("/"), "id")
    pdf = F.coalesce(F.lower("original_filename").endswith(".pdf"), F.lit(False))
    f = table(spark, d, "document_files").select("id", name.alias("filename"), F.sha2(F.coalesce("publisher", "id"), 256).alias("sha256"), F.when(~pdf, "not a .pdf name").alias("problem"), (F.col("created_at") < F.lit("2023-01-03").cast("timestamp")).alias("old"))
    return dispositions(f.where("not old"), f.where("old").select("id", "sha256"))


@query(f"""
WITH p AS (SELECT id, length({strip_sql("coalesce(raw_text, '')")})::DOUBLE AS n, greatest(coalesce(width * height, 0.0), 1.0) AS area FROM pages)
SELECT id, n::INT AS chars, round(n / area, 6) AS density, n < 50 AS is_scanned,
  CASE WHEN n = 0 THEN 0.0 WHEN n < 50 THEN round(least(n / 50, 0.5), 3) WHEN n / area < 0.0004 THEN round(0.5 + 0.5 * (n / area) / 0.0004, 3) ELSE 1.0 END::DOUBLE AS quality
FROM p
""")
def page_quality(spark, d):
    """Text density and quality of every page."""
    return table(spark, d, "pages").select("id", X.page_quality(F.col("raw_text"), F.col("width"), F.col("height")).alias("q")).select("id", "q.*")


@query(f"""
WITH p AS (SELECT document_id, string_split(coalesce(raw_text, ''), chr(10)) AS l FROM pages),
e AS (
  SELECT document_id, 'header' AS position, unnest(l[1:3]) AS line FROM p
  UNION ALL SELECT document_id, 'footer', unnest(l[greatest(1, len(l) - 2):]) FROM p
), k AS (
  SELECT document_id, position, {collapse_sql(f"regexp_replace(regexp_replace(regexp_replace({strip_sql('line')}, '^[0-9]+$', ''), '(?i)^(page[ \t\n\x0c\r\x0b]+)?[0-9]+[ \t\n\x0c\r\x0b]*$', ''), '^-[ \t\n\x0c\r\x0b]*[0-9]+[ \t\n\x0c\r\x0b]*-$', '')")} AS pattern FROM e
), t AS (SELECT document_id, count(*) AS n FROM pages GROUP BY 1 HAVING count(*) >= 3)
SELECT k.document_id, position, pattern, count(*)::BIGINT AS occurrences FROM k JOIN t ON k.document_id = t.document_id WHERE length(pattern) > 2 GROUP BY 1, 2, 3, t.n HAVING count(*) >= 0.4 * t.n
""")
def header_footer_patterns(spark, d):
    """Lines repeated at the top or bottom of a file's pages."""
    return PG.line_patterns(table(spark, d, "pages"))


_NORM = lambda x: collapse_sql(f"regexp_replace({strip_sql(x)}, '(?i)^((page[ \t\n\x0c\r\x0b]+)?[0-9]+[ \t\n\x0c\r\x0b]*|-[ \t\n\x0c\r\x0b]*[0-9]+[ \t\n\x0c\r\x0b]*-)$', '')")


@query(f"""
WITH p AS (SELECT id, document_id, raw_text, string_split(raw_text, chr(10)) AS l, string_split(coalesce(raw_text, ''), chr(10)) AS l0 FROM pages),
e AS (SELECT document_id, 'header' AS position, unnest(l0[1:3]) AS line FROM p UNION ALL SELECT document_id, 'footer', unnest(l0[greatest(1, len(l0) - 2):]) FROM p),
k AS (SELECT document_id, position, {_NORM('line')} AS pattern FROM e), t AS (SELECT document_id, count(*) AS n FROM pages GROUP BY 1 HAVING count(*) >= 3),
c AS (SELECT k.document_id, position, pattern FROM k JOIN t ON k.document_id = t.document_id WHERE length(pattern) > 2 GROUP BY 1, 2, 3, t.n HAVING count(*) >= 0.4 * t.n),
s AS (SELECT document_id, list(pattern) FILTER (position = 'header') AS h, list(pattern) FILTER (position = 'footer') AS f FROM c GROUP BY 1),
j AS (SELECT p.*, s.document_id AS own, coalesce(h, []) AS h, coalesce(f, []) AS f FROM p LEFT JOIN s ON s.document_id = p.document_id),
m AS (SELECT *, list_transform(l[1:3], lambda x: {_NORM('x')} = '' OR list_contains(h, {_NORM('x')})) AS a FROM j),
n AS (SELECT *, l[coalesce(nullif(list_position(a, false), 0), len(a) + 1):] AS rest FROM m),
o AS (SELECT *, list_transform(list_reverse(rest)[1:3], lambda x: {_NORM('x')} = '' OR list_contains(f, {_NORM('x')})) AS b FROM n)
SELECT id, CASE WHEN own IS NULL THEN raw_text ELSE {strip_sql("array_to_string(rest[:len(rest) - (coalesce(nullif(list_position(b, false), 0), len(b) + 1) - 1)], chr(10))")} END AS cleaned FROM o
""")
def header_footer_clean(spark, d):
    """Pages without the repeated lines of their file."""
    p = table(spark, d, "pages").select("id", "document_id", "raw_text")
    return PG.without_patterns(p, PG.line_patterns(p)).select("id", "cleaned")


def _heading_sql(t: str) -> str:
    first = f"split_part({strip_sql(t)}, chr(10), 1)"
    return f"""CASE WHEN length({t}) < 200 AND len(string_split({strip_sql(t)}, chr(10))) <= 3 AND (regexp_matches({strip_sql(first)}, '(?i)^(chapter|section|part)[ \t]+[0-9]') OR regexp_matches({strip_sql(first)}, '^[0-9]+\\.[ \t]+[A-Z]')
      OR regexp_matches({strip_sql(first)}, '^[A-Z][A-Z \t]{{4,}}$') OR regexp_matches({strip_sql(first)}, '^[0-9]+\\.[0-9]+[.0-9]*[ \t]+[^ \t]')) THEN 'heading' ELSE 'paragraph' END"""


@query(f"""
WITH l AS (SELECT id AS page_id, unnest(string_split(coalesce(raw_text, ''), chr(10))) AS text, generate_subscripts(string_split(coalesce(raw_text, ''), chr(10)), 1) - 1 AS reading_order FROM pages)
SELECT page_id, (row_number() OVER (PARTITION BY page_id ORDER BY reading_order) - 1)::INT AS block_index, reading_order::INT AS reading_order, {_heading_sql('text')} AS block_type, text, substr(sha256(text), 1, 16) AS content_hash
FROM l WHERE {strip_sql('text')} <> ''
""")
def line_blocks(spark, d):
    """The lines of every page as blocks with type and hash."""
    return PG.line_blocks(table(spark, d, "pages"))


@query(f"SELECT id, block_type AS stated, {_heading_sql('text')} AS computed FROM blocks WHERE text IS NOT NULL")
def block_types(spark, d):
    """The type of every block by the look of its text."""
    return table(spark, d, "blocks").where("text is not null").select("id", F.col("block_type").alias("stated"), X.block_type(F.col("text")).alias("computed"))


@query("""
WITH t AS (SELECT id, text, string_split(text, chr(10)) AS l FROM blocks WHERE regexp_matches(coalesce(string_split(text, chr(10))[2], ''), '^-{40}$'))
SELECT id, (len(l) - 2)::INT AS row_count, len(string_split(l[1], ' | '))::INT AS col_count, l[1] || chr(10) || repeat('-', 40) || CASE WHEN len(l) > 2 THEN chr(10) || array_to_string(l[3:], chr(10)) ELSE '' END AS flat FROM t
""")
def table_blocks(spark, d):
    """Blocks that hold a table, parsed into headers and rows and written out again."""
    b = table(spark, d, "blocks").select("id", PG.parse_table(F.col("text")).alias("t")).where("t is not null")
    return b.select("id", F.size("t.rows").alias("row_count"), F.size("t.headers").alias("col_count"), PG.table_text(F.col("t.headers"), F.col("t.rows")).alias("flat"))


@query("SELECT id, CASE WHEN text IS NULL THEN NULL WHEN text = '' THEN 0 ELSE greatest(1, length(text) // 4) END::INT AS tokens, token_count AS stated FROM chunks")
def token_counts(spark, d):
    """Tokens of every chunk, counted and as stated."""
    return table(spark, d, "chunks").select("id", F.when(F.col("text").isNotNull(), X.token_count(F.col("text"))).alias("tokens"), F.col("token_count").alias("stated"))


@query()
def chunk_documents(spark, d):
    """Chunks of all files, made anew from their blocks (lists joined by commas)."""
    c = chunking.chunk_documents(table(spark, d, "pages"), table(spark, d, "blocks"))
    return c.withColumns({"block_ids": F.array_join("block_ids", ","), "heading_path": F.array_join("heading_path", " > ")})


# ---- evidence ------------------------------------------------------------------------------------------------------


def _quote_sql(x: str) -> str:
    return strip_sql(collapse_sql(f"""translate({x}, '“”„‟‘’‚‛–—―', '""\"\"''''''''---')"""))


def _bare_sql(x: str) -> str:
    return strip_sql(collapse_sql(f"lower(regexp_replace({x}, '[^\\pL\\pM\\p{{Nd}}\\p{{Pc}}\\x{{200c}}\\x{{200d}}\\s]', ' ', 'g'))"))


@query(f"SELECT seq, {_quote_sql('source_quote')} AS quote, {_bare_sql(_quote_sql('source_quote'))} AS plain FROM facts")
def quote_forms(spark, d):
    """Every quote in the two forms in which it is compared."""
    q = X.quote_norm(F.col("source_quote"))
    return table(spark, d, "facts").select("seq", q.alias("quote"), X.bare(q).alias("plain"))


@query(f"""
WITH j AS (
  SELECT f.seq, f.source_quote AS raw, {_quote_sql("coalesce(f.source_quote, '')")} AS q, {_quote_sql("coalesce(c.text, '')")} AS c FROM facts f JOIN chunks c ON c.id = f.chunk_id
), k AS (SELECT *, {_bare_sql('q')} AS bq, {_bare_sql('c')} AS bc FROM j),
w AS (SELECT *, list_filter(string_split(bq, ' '), lambda x: length(x) > 2) AS ws FROM k)
SELECT seq, CASE WHEN {strip_sql("coalesce(raw, '')")} = '' THEN 'rejected' WHEN contains(c, q) THEN 'validated' WHEN length(bq) >= 8 AND contains(bc, bq) THEN 'warning'
  WHEN len(ws) >= 4 AND contains(bc, array_to_string(ws[1:6], ' ')) THEN 'warning' ELSE 'rejected' END AS status FROM w
""")
def verify_quotes(spark, d):
    """Whether the quote of every fact stands in its chunk."""
    f, c = table(spark, d, "facts"), table(spark, d, "chunks")
    j = f.select("seq", "chunk_id", "source_quote").join(VF.chunk_forms(c), "chunk_id")
    j = once(j, "f", VF.quote_forms(F.col("source_quote")))
    return j.select("seq", VF.verdict_of_forms(F.col("source_quote"), F.col("norm"), F.col("bare"), F.col("f"))["status"].alias("status"))


@query(f"""
WITH pg AS (SELECT id, page_number FROM pages), bl AS (SELECT b.id, p.page_number, {_quote_sql('b.text')} AS n FROM blocks b JOIN pg p ON p.id = b.page_id),
bk AS (SELECT *, {_bare_sql('n')} AS r FROM bl),
ch AS (SELECT id, text, start_page, end_page, CASE WHEN json_valid(block_ids_json) AND json_type(block_ids_json) = 'ARRAY' THEN from_json(block_ids_json, '["VARCHAR"]') ELSE [] END AS ids FROM chunks),
li AS (SELECT id AS chunk_id, unnest(ids) AS block_id, generate_subscripts(ids, 1) AS k FROM ch),
cb AS (SELECT chunk_id, list({{'id': block_id, 'n': n, 'r': r, 'p': page_number}} ORDER BY k, block_id) AS bs FROM li JOIN bk ON bk.id = block_id GROUP BY 1),
j AS (SELECT f.id AS fact_id, f.seq, f.source_quote AS raw, c.start_page AS cs, c.end_page AS ce, coalesce(cb.bs, []) AS bs, {_quote_sql("coalesce(f.source_quote, '')")} AS q, {_quote_sql("coalesce(c.text, '')")} AS c FROM facts f JOIN ch c ON c.id = f.chunk_id LEFT JOIN cb ON cb.chunk_id = c.id),
k AS (SELECT *, {_bare_sql('q')} AS bq, {_bare_sql('c')} AS bc FROM j),
w AS (SELECT *, list_filter(string_split(bq, ' '), lambda x: length(x) > 2) AS ws, list_filter(string_split(q, ' '), lambda x: x <> '') AS qs FROM k),
v AS (SELECT *, CASE WHEN {strip_sql("coalesce(raw, '')")} = '' THEN 'none' WHEN contains(c, q) THEN 'exact' WHEN length(bq) >= 8 AND contains(bc, bq) THEN 'form' WHEN len(ws) >= 4 AND contains(bc, array_to_string(ws[1:6], ' ')) THEN 'part' ELSE 'none' END AS way,
  array_to_string(qs[1:4], ' ') AS head, array_to_string(qs[greatest(1, len(qs) - 3):len(qs)], ' ') AS tail FROM w),
h AS (SELECT *, CASE way WHEN 'exact' THEN CASE WHEN len(list_filter(bs, lambda b: contains(b.n, q))) > 0 THEN list_filter(bs, lambda b: contains(b.n, q))[1:1] ELSE list_filter(bs, lambda b: contains(b.n, head) OR contains(b.n, tail)) END
  WHEN 'form' THEN list_filter(bs, lambda b: contains(b.r, bq))[1:1] ELSE [] END AS hit FROM v)
SELECT fact_id, seq, CASE WHEN {strip_sql("coalesce(raw, '')")} = '' OR way = 'none' THEN 'rejected' WHEN way = 'exact' THEN 'validated' ELSE 'warning' END AS status, way,
  CASE WHEN {strip_sql("coalesce(raw, '')")} = '' THEN '{VF.NOTE_EMPTY}' WHEN way = 'form' THEN '{VF.NOTE_FORM}' WHEN way = 'part' THEN '{VF.NOTE_PART}' WHEN way = 'none' THEN '{VF.NOTE_NONE}' END AS note,
  array_to_string(list_transform(CASE WHEN way = 'none' THEN [] WHEN len(hit) > 0 THEN hit ELSE bs END, lambda b: b.id), ',') AS block_ids,
  CASE WHEN len(hit) > 0 THEN list_min(list_transform(hit, lambda b: b.p)) ELSE cs END AS start_page, CASE WHEN len(hit) > 0 THEN list_max(list_transform(hit, lambda b: b.p)) WHEN way = 'form' THEN cs ELSE ce END AS end_page FROM h
""")
def quote_attribution(spark, d):
    """Blocks and pages to which each verified quote is traced."""
    v = VF.verify_facts(*(table(spark, d, t) for t in ("facts", "chunks", "blocks", "pages")))
    return v.withColumn("block_ids", F.array_join("block_ids", ","))


@query(f"""
WITH c AS (SELECT id, string_split(text, chr(10)) AS l, regexp_extract_all(regexp_replace(text, '[\\x{{aa}}\\x{{b5}}\\x{{ba}}\\x{{c0}}-\\x{{d6}}\\x{{d8}}-\\x{{f6}}\\x{{f8}}-\\x{{2ff}}\\x{{370}}-\\x{{1fff}}\\x{{3040}}-\\x{{10ffff}}]', 'x', 'g'), '(\\$?[0-9]+(?:\\.[0-9]+)?[ \t\n\x0c\r\x0b]*(?:million|billion|M|B)?)\\b', 1) AS ms FROM chunks),
m AS (SELECT id, l, unnest(ms) AS m, generate_subscripts(ms, 1) - 1 AS k FROM c),
v AS (SELECT *, {strip_sql('m')} AS value_text FROM m WHERE length({strip_sql('m')}) > 1),
q AS (SELECT *, list_filter(l, lambda x: contains(x, value_text) AND NOT starts_with(x, 'Document Text:'))[1] AS line FROM v)
SELECT id AS chunk_id, k::INT AS k, value_text, CASE WHEN contains(value_text, '$') THEN 'currency' ELSE 'number' END AS value_type, substr({strip_sql('line')}, 1, 150) AS source_quote, 'Organization' AS subject, 'financial_metric' AS predicate, 0.95::DOUBLE AS confidence
FROM q WHERE line IS NOT NULL
""")
def mock_extract(spark, d):
    """Facts that the offline extractor finds in every chunk."""
    return VF.mock_facts(table(spark, d, "chunks"))


@query("""
WITH c AS (SELECT id, text, CASE WHEN json_valid(heading_path_json) AND json_type(heading_path_json) = 'ARRAY' THEN from_json(heading_path_json, '["VARCHAR"]') ELSE [] END AS path FROM chunks)
SELECT id, CASE WHEN len(path) > 0 THEN 'Section Context: ' || array_to_string(path, ' > ') || chr(10) || chr(10) ELSE '' END || 'Document Text:' || chr(10) || '```' || chr(10) || coalesce(text, '') || chr(10) || '```' || chr(10) || chr(10) || 'List the explicit facts of the text, each with a verbatim quote.' AS prompt FROM c
""")
def extraction_prompts(spark, d):
    """The text an extraction provider gets for every chunk."""
    path = F.coalesce(F.from_json("heading_path_json", "array<string>"), F.array().cast("array<string>"))
    return table(spark, d, "chunks").select("id", VF.prompt(path, F.coalesce("text", F.lit(""))).alias("prompt"))


# ---- normalisers -----------------------------------------------------------------------------------------------------

_CODES = "|".join(N.CODES)
_SIGN_SQL = "CASE " + " ".join(f"WHEN contains(t0, '{s}') THEN '{c}'" for s, c in reversed(N.SIGNS)) + " END"
_SIZE_SQL = "map {" + ", ".join(f"'{k}': {v:.1f}" for k, v in N.MAGNITUDES.items()) + "}"
_PARTS = "^\\s*([0-9]+(?:\\.[0-9]+)?)\\s*:\\s*([0-9]+(?:\\.[0-9]+)?)\\s*$"
_TRIMMED = "regexp_replace(regexp_replace({x}, '^[.,;:()]+', ''), '[.,;:()]+$', '')"


@query(f"""
WITH a AS (SELECT seq, unit AS du, currency AS dc, value_type AS dt, {strip_sql("coalesce(value_text, '')")} AS v FROM facts),
b AS (SELECT *, lower(v) AS t0 FROM a),
c AS (SELECT *, {_SIGN_SQL} AS sign, regexp_replace(t0, '[$€£¥₹₩]|chf', ' ', 'g') AS t1 FROM b),
d AS (SELECT *, upper(list_max(regexp_extract_all(t1, '\\b({_CODES})\\b', 1))) AS code, regexp_replace(t1, '\\b({_CODES})\\b', ' ', 'g') AS t2 FROM c),
e AS (SELECT *, coalesce(code, sign, dc) AS cur, (regexp_matches(t2, '%|percent|pct') OR coalesce(dt = 'percentage', false) OR coalesce(contains(du, '%'), false)) AS pct, regexp_replace(t2, '%|percentage|percent|pct', ' ', 'g') AS t3 FROM d),
f AS (SELECT *, regexp_matches(t3, '^\\s*[0-9]+(\\.[0-9]+)?\\s*:\\s*[0-9]+(\\.[0-9]+)?\\s*$') AS ratio, list_filter(regexp_split_to_array(t3, '{WS}+'), lambda w: w <> '') AS ws FROM e),
g AS (SELECT *, list_filter(list_transform(ws, lambda w: ({_SIZE_SQL})[{_TRIMMED.format(x='w')}]), lambda m: m IS NOT NULL) AS sizes, array_to_string(list_filter(ws, lambda w: ({_SIZE_SQL})[{_TRIMMED.format(x='w')}] IS NULL), ' ') AS rest FROM f),
h AS (SELECT *, coalesce(list_product(sizes), 1.0) AS m0, nullif(regexp_extract(rest, '[0-9]+(?:\\.[0-9]+)?\\s*([kmbt])\\b', 1), '') AS suffix FROM g),
i AS (SELECT *, CASE WHEN m0 = 1.0 THEN coalesce(({_SIZE_SQL})[suffix], 1.0) ELSE m0 END AS m,
  try_cast(nullif(regexp_extract(regexp_replace(regexp_replace(rest, '([0-9]),([0-9])', '\\1\\2', 'g'), '([0-9]),([0-9])', '\\1\\2', 'g'), '[-+]?[0-9]*\\.?[0-9]+'), '') AS DOUBLE) AS base FROM h)
SELECT seq, CASE WHEN v = '' THEN NULL WHEN ratio THEN q ELSE base END AS raw,
  CASE WHEN v = '' THEN NULL WHEN ratio THEN q WHEN pct THEN round(CASE WHEN base > 1 THEN base / 100 ELSE base END, 6) WHEN nullif(cur, '') IS NOT NULL THEN round(base * m, 2) ELSE base * m END AS normalized,
  CASE WHEN v = '' THEN du WHEN ratio THEN 'ratio' WHEN base IS NOT NULL AND pct THEN '%' WHEN base IS NOT NULL AND nullif(cur, '') IS NOT NULL THEN cur ELSE du END AS unit,
  CASE WHEN v = '' THEN dc ELSE cur END AS currency,
  CASE WHEN ratio THEN 'range' WHEN v = '' OR base IS NULL THEN coalesce(dt, 'text') WHEN pct THEN 'percentage' WHEN nullif(cur, '') IS NOT NULL THEN 'currency' ELSE coalesce(dt, 'number') END AS value_type
FROM (SELECT *, try_cast(regexp_extract(t3, '{_PARTS}', 1) AS DOUBLE) / nullif(try_cast(regexp_extract(t3, '{_PARTS}', 2) AS DOUBLE), 0) AS q FROM i)
""")
def normalize_numeric(spark, d):
    """Numbers, units and currencies of every fact's value in normal form."""
    f = table(spark, d, "facts").select("seq", "value_text", F.col("unit").alias("du"), F.col("currency").alias("dc"), "value_type")
    return N.with_numeric(f, "n", F.col("value_text"), F.col("du"), F.col("dc"), F.col("value_type")).select("seq", "n.raw", "n.normalized", "n.unit", "n.currency", "n.value_type")


_Y = "(19[0-9][0-9]|20[0-9][0-9])"
_MONTH_SQL = "map {" + ", ".join(f"'{k}': {v}" for k, v in N.MONTH_NUMBER.items()) + "}"
_FY = "(?i)\\b(?:FY|Fiscal(?:\\s+Year)?)\\s*[''’]?([0-9]{2,4})\\b"
_R = f"\\b{_Y}\\s*(?:-|–|—|to)\\s*{_Y}\\b"
_Q = f"(?i)\\b(?:Q([1-4])\\s*{_Y}|([1-4])Q\\s*{_Y})\\b"
_M = f"\\b([a-zA-Z]+)\\s+{_Y}\\b"


@query(f"""
WITH a AS (SELECT f.seq, {collapse_sql(strip_sql('f.time_text'))} AS c, CASE WHEN json_valid(m.metadata_json) THEN json_extract_string(m.metadata_json, '$.fiscal_year_end') END AS fye FROM facts f LEFT JOIN document_files m ON m.id = f.document_id),
b AS (SELECT *, nullif(regexp_extract(c, '{_FY}', 1), '') AS fy, nullif(regexp_extract(c, '(?i)\\bQ([1-4])\\b', 1), '') AS fq, nullif(regexp_extract(c, '{_R}', 1), '') AS r1, nullif(regexp_extract(c, '{_R}', 2), '') AS r2,
  coalesce(nullif(regexp_extract(c, '{_Q}', 1), ''), nullif(regexp_extract(c, '{_Q}', 3), '')) AS q, coalesce(nullif(regexp_extract(c, '{_Q}', 2), ''), nullif(regexp_extract(c, '{_Q}', 4), '')) AS qy,
  ({_MONTH_SQL})[lower(regexp_extract(c, '{_M}', 1))] AS mo, nullif(regexp_extract(c, '{_M}', 2), '') AS my, nullif(regexp_extract(c, '\\b{_Y}\\b', 1), '') AS y FROM a),
k AS (SELECT *, CASE WHEN length(fy) = 4 THEN fy::INT ELSE fy::INT + 2000 END AS fyy,
  CASE WHEN c IS NULL OR c = '' THEN 'none' WHEN fy IS NOT NULL AND fq IS NOT NULL THEN 'fq' WHEN fy IS NOT NULL THEN 'fy' WHEN r1 IS NOT NULL THEN 'range' WHEN q IS NOT NULL THEN 'q' WHEN mo IS NOT NULL THEN 'm' WHEN y IS NOT NULL THEN 'y' ELSE 'x' END AS k FROM b)
SELECT seq,
  CASE k WHEN 'fq' THEN 'Q' || fq || ' FY' || fyy WHEN 'fy' THEN 'FY' || fyy WHEN 'range' THEN r1 || '-' || r2 WHEN 'q' THEN 'Q' || q || ' ' || qy WHEN 'm' THEN monthname(make_date(my::INT, mo, 1)) || ' ' || my WHEN 'y' THEN y WHEN 'x' THEN c END AS time_text,
  CASE k WHEN 'fy' THEN CASE fye WHEN '03-31' THEN (fyy - 1) || '-04-01' WHEN '12-31' THEN fyy || '-01-01' END WHEN 'range' THEN r1 || '-01-01' WHEN 'q' THEN qy || (map {{'1': '-01-01', '2': '-04-01', '3': '-07-01', '4': '-10-01'}})[q]
    WHEN 'm' THEN strftime(make_date(my::INT, mo, 1), '%Y-%m-%d') WHEN 'y' THEN y || '-01-01' END AS time_start,
  CASE k WHEN 'fy' THEN CASE fye WHEN '03-31' THEN fyy || '-03-31' WHEN '12-31' THEN fyy || '-12-31' END WHEN 'range' THEN r2 || '-12-31' WHEN 'q' THEN qy || (map {{'1': '-03-31', '2': '-06-30', '3': '-09-30', '4': '-12-31'}})[q]
    WHEN 'm' THEN strftime(last_day(make_date(my::INT, mo, 1)), '%Y-%m-%d') WHEN 'y' THEN y || '-12-31' END AS time_end,
  CASE k WHEN 'fq' THEN 'quarter' WHEN 'fy' THEN 'fiscal_year' WHEN 'range' THEN 'year' WHEN 'q' THEN 'quarter' WHEN 'm' THEN 'month' WHEN 'y' THEN 'year' WHEN 'x' THEN 'unknown' END AS time_granularity
FROM k
""")
def normalize_periods(spark, d):
    """The period of every fact in normal form."""
    f = table(spark, d, "facts").join(FA.document_year_ends(table(spark, d, "document_files")), "document_id", "left")
    return f.select("seq", N.period(F.col("time_text"), F.col("fiscal_year_end")).alias("p")).select("seq", "p.*")


_SYN_SQL = "map {" + ", ".join(f"'{k}': '{v}'" for k, v in N.SYNONYMS.items()) + "}"


@query(f"""
WITH k AS (SELECT seq, regexp_replace(regexp_replace(regexp_replace(regexp_replace({folded_sql('predicate')}, '[-/\\s]+', '_', 'g'), '[^\\pL\\pM\\p{{Nd}}\\p{{Pc}}]', '', 'g'), '^_+', ''), '_+$', '') AS k FROM facts)
SELECT seq, CASE WHEN k = '' THEN 'unknown_predicate' ELSE coalesce(({_SYN_SQL})[k], k) END AS predicate, CASE WHEN k = '' THEN 0.5 WHEN ({_SYN_SQL})[k] IS NOT NULL THEN 1.0 ELSE 0.85 END::DOUBLE AS confidence, ({_SYN_SQL})[k] IS NOT NULL AS known FROM k
""")
def normalize_predicates(spark, d):
    """The metric that every fact's predicate names."""
    return table(spark, d, "facts").select("seq", N.predicate(F.col("predicate")).alias("p")).select("seq", "p.*")


def _clean_sql(x: str) -> str:
    return f"coalesce(nullif({collapse_sql(strip_sql(x))}, ''), 'Unknown Entity')"


def _stem_sql(x: str) -> str:
    s = _clean_sql(x)
    for p in N.LEGAL:
        s = f"trim(regexp_replace({s}, '(?i){p}', '', 'g'), ' ,.-')"
    return s


@query(f"WITH n AS (SELECT DISTINCT subject FROM facts) SELECT subject, {_clean_sql('subject')} AS name, {_stem_sql('subject')} AS stem, lower({_clean_sql('subject')}) IN ({', '.join(repr(g) for g in N.GENERIC)}) AS generic FROM n")
def entity_stems(spark, d):
    """Every distinct subject as clean name and without its legal form."""
    c = F.col("subject")
    return table(spark, d, "facts").select("subject").distinct().select("subject", N.clean_name(c).alias("name"), N.legal_stem(c).alias("stem"), N.is_generic(c).alias("generic"))


@query(f"""
WITH n0 AS (SELECT DISTINCT {_clean_sql('subject')} AS name FROM facts), n AS (SELECT name, lower(name) AS low, lower({_stem_sql('name')}) AS stem, lower(name) IN ({', '.join(repr(g) for g in N.GENERIC)}) AS generic FROM n0),
e AS (SELECT id, lower({_clean_sql('canonical_name')}) AS low, lower({_stem_sql('canonical_name')}) AS stem FROM entities),
bn AS (SELECT low, min(id) AS by_name FROM e GROUP BY 1), ba AS (SELECT lower({_clean_sql('alias')}) AS low, min(entity_id) AS by_alias FROM entity_aliases WHERE alias IS NOT NULL GROUP BY 1), bs AS (SELECT stem, min(id) AS by_stem FROM e WHERE length(stem) >= 3 GROUP BY 1)
SELECT name, CASE WHEN generic THEN 'generic:' || low ELSE coalesce(by_name, by_alias, by_stem, 'new:' || substr(sha256(CASE WHEN length(n.stem) >= 3 THEN n.stem ELSE n.low END), 1, 16)) END AS entity_id,
  CASE WHEN generic THEN 'generic' WHEN by_name IS NOT NULL THEN 'name' WHEN by_alias IS NOT NULL THEN 'alias' WHEN by_stem IS NOT NULL THEN 'stem' ELSE 'new' END AS way,
  CASE WHEN generic THEN 0.5 WHEN by_name IS NULL AND by_alias IS NULL AND by_stem IS NOT NULL THEN 0.95 ELSE 1.0 END::DOUBLE AS confidence
FROM n LEFT JOIN bn USING (low) LEFT JOIN ba USING (low) LEFT JOIN bs USING (stem)
""")
def entity_resolution(spark, d):
    """The entity of every distinct subject by name, alias or legal stem."""
    return FA.resolve_entities(*(table(spark, d, t) for t in ("facts", "entities", "entity_aliases")))


@query(f"""
WITH m AS (SELECT id, CASE WHEN json_valid(metadata_json) THEN metadata_json END AS j FROM document_files)
SELECT id, json_extract_string(j, '$.timezone') AS timezone, json_extract_string(j, '$.date_order') AS date_order, json_extract_string(j, '$.fiscal_year_end') AS fiscal_year_end FROM m
""")
def document_context(spark, d):
    """What the metadata of every file say about its dates; malformed metadata say nothing."""
    j = "metadata_json"
    return table(spark, d, "document_files").select("id", *(F.get_json_object(j, f"$.{k}").alias(k) for k in ("timezone", "date_order", "fiscal_year_end")))


@query(f"""
SELECT seq, nullif(regexp_extract(lower(time_text), '(20[0-9]{{2}}|19[0-9]{{2}})', 1), '') AS year, coalesce(regexp_matches(lower(time_text), '\\bq[1-4]\\b|(first|second|third|fourth)\\s*quarter'), false) AS quarter FROM facts
""")
def period_markers(spark, d):
    """Year and quarter that every fact's time names."""
    return table(spark, d, "facts").select("seq", X.year_of(F.col("time_text")).alias("year"), X.is_quarter(F.col("time_text")).alias("quarter"))


@query("""
WITH t AS (SELECT id, created_at AS a, updated_at AS b, greatest(0, (epoch_us(updated_at) - epoch_us(created_at)) // 1000000) AS s FROM document_files)
SELECT id, CASE WHEN a IS NULL OR b IS NULL THEN '-' WHEN s < 60 THEN s || 's' WHEN s % 60 = 0 THEN (s // 60) || 'm' ELSE (s // 60) || 'm ' || (s % 60) || 's' END AS took FROM t
""")
def durations(spark, d):
    """Time from the creation to the last change of every file's record."""
    return table(spark, d, "document_files").select("id", X.duration(F.col("created_at"), F.col("updated_at")).alias("took"))


@query("""
SELECT id, CASE n % 6 WHEN 0 THEN greatest(n + 1.5, 5.0) WHEN 1 THEN greatest(n + 0.5 + 1.5, 5.0) WHEN 2 THEN greatest(n + 1.5, 5.0) WHEN 3 THEN greatest(n + 0.25 + 1.5, 5.0) ELSE 45.0 END::DOUBLE AS seconds FROM (SELECT id, page_count AS n FROM document_files WHERE page_count IS NOT NULL)
""")
def retry_delays(spark, d):
    """Waiting times read from error messages in several wordings."""
    n = F.col("page_count")
    say = lambda a, b: F.concat(F.lit(a), n, F.lit(b))
    said = F.when(n % 6 == 0, say("Please retry in ", "s.")).when(n % 6 == 1, say("{'retryDelay': '", ".5s'}")).when(n % 6 == 2, say("retryDelay: ", "")).when(n % 6 == 3, say("{\"retry_after\": ", ".25}")).when(n % 6 == 4, say("retry-after ", "")).otherwise("quota exceeded")
    return table(spark, d, "document_files").where("page_count is not null").select("id", X.retry_delay(said).alias("seconds"))


@query("""
SELECT id, CASE WHEN created_at IS NULL THEN '' ELSE strftime(timezone('Europe/Berlin', created_at::TIMESTAMPTZ), '%Y-%m-%d %H:%M:%S') END AS iso, CASE WHEN created_at IS NULL THEN '' ELSE strftime(timezone('America/New_York', created_at::TIMESTAMPTZ), '%Y-%m-%d %H:%M:%S') END AS utc,
  CASE WHEN original_filename IS NULL THEN '' ELSE replace(substr(original_filename, 1, 19), 'T', ' ') END AS other FROM document_files WHERE original_filename IS NULL OR NOT regexp_matches(original_filename, '^[0-9]{4}')
""")
def local_times(spark, d):
    """Time stamps of files as local time: naive ones, those with Z, and texts that are none."""
    f = table(spark, d, "document_files").where("original_filename is null or not original_filename rlike '^[0-9]{4}'")
    naive, zulu = F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss.SSS"), F.concat(F.date_format("created_at", "yyyy-MM-dd HH:mm:ss"), F.lit("Z"))
    return f.select("id", X.local_time(naive, "Europe/Berlin").alias("iso"), X.local_time(zulu, "America/New_York").alias("utc"), X.local_time(F.col("original_filename"), "UTC").alias("other"))


# ---- facts -----------------------------------------------------------------------------------------------------------


@query("SELECT * EXCLUDE (rn) FROM (SELECT id, seq, value_text, epoch_us(created_at) AS created_us, row_number() OVER (PARTITION BY id ORDER BY created_at DESC NULLS LAST, seq DESC) AS rn FROM facts) WHERE rn = 1")
def upsert_latest(spark, d):
    """The last delivery of every fact."""
    f = FA.latest(table(spark, d, "facts").select("id", "seq", "value_text", "created_at"), ["id"], F.col("created_at"), F.col("seq"))
    return f.select("id", "seq", "value_text", F.unix_micros("created_at").alias("created_us"))


_LIST = "CASE WHEN json_valid({x}) AND json_type({x}) = 'ARRAY' THEN from_json({x}, '[\"VARCHAR\"]') ELSE [] END"


@query(f"""
WITH k AS (SELECT *, coalesce(nullif(entity_id, ''), {folded_sql('subject')}) AS k1, {folded_sql('predicate')} AS k2, normalized_numeric_value::DECIMAL(30,6) AS k3, CASE WHEN normalized_numeric_value IS NULL THEN {folded_sql('value_text')} END AS k4,
  {folded_sql("coalesce(nullif(normalized_unit, ''), nullif(unit, ''), nullif(currency, ''))")} AS k5, {folded_sql('time_text')} AS k6, coalesce(time_start, '') AS k7, coalesce(time_end, '') AS k8, {folded_sql('scope')} AS k9, {folded_sql('geography')} AS k10,
  array_to_string(list_sort({_LIST.format(x='qualifiers_json')}), chr(1)) AS k11, {_LIST.format(x='source_block_ids_json')} AS bl, {_LIST.format(x='extraction_notes_json')} AS nl FROM facts),
q AS (SELECT document_id, k1, k2, k3, k4, k5, k6, k7, k8, k9, k10, k11, source_quote, min(seq) AS s FROM k WHERE source_quote <> '' GROUP BY ALL),
qq AS (SELECT * EXCLUDE (source_quote, s), string_agg(source_quote, ' | ' ORDER BY s) AS quotes FROM q GROUP BY ALL)
SELECT arg_min(k.id, seq) AS fact_id, k.document_id, count(*)::BIGINT AS n_claims, array_to_string(list_sort(list_distinct(flatten(list(bl)))), ',') AS block_ids, min(source_page_start) AS page_start, max(source_page_end) AS page_end, coalesce(any_value(quotes), '') AS quotes,
  array_to_string(list_concat(flatten(list(nl ORDER BY seq)), CASE WHEN count(*) > 1 THEN ['Deduplicated from ' || count(*) || ' identical claims across pages ' || min(source_page_start) || '–' || max(source_page_end) || '.'] ELSE [] END), ' | ') AS notes,
  max(extraction_confidence) AS confidence, arg_min(validation_status, seq) AS status
FROM k LEFT JOIN qq ON k.document_id IS NOT DISTINCT FROM qq.document_id AND k.k1 = qq.k1 AND k.k2 = qq.k2 AND k.k3 IS NOT DISTINCT FROM qq.k3 AND k.k4 IS NOT DISTINCT FROM qq.k4 AND k.k5 = qq.k5 AND k.k6 = qq.k6 AND k.k7 = qq.k7 AND k.k8 = qq.k8 AND k.k9 = qq.k9 AND k.k10 = qq.k10 AND k.k11 = qq.k11
GROUP BY k.document_id, k.k1, k.k2, k.k3, k.k4, k.k5, k.k6, k.k7, k.k8, k.k9, k.k10, k.k11
""")
def fact_dedup(spark, d):
    """Claims that a document makes more than once, merged with all their evidence."""
    return FA.merge_duplicates(table(spark, d, "facts"))


_ONE = "coalesce(nullif({x}, ''), '{d}')"


_CANON = f"""WITH {LATEST}, j AS (SELECT f.*, e.canonical_name AS name FROM lf f LEFT JOIN entities e ON e.id = f.entity_id),
k AS (SELECT *, nullif({strip_sql('time_text')}, '') AS t, CASE WHEN nullif(time_start, '') IS NOT NULL OR nullif(time_end, '') IS NOT NULL THEN nullif(trim(coalesce(time_start, '') || '..' || coalesce(time_end, ''), '.'), '') END AS span,
  list_filter(list_transform({_LIST.format(x='qualifiers_json')}, lambda q: {strip_sql('q')}), lambda q: q <> '') AS ql, coalesce(json_valid(qualifiers_json) AND json_type(qualifiers_json) = 'ARRAY', false) AS is_list FROM j),
c AS (SELECT id, seq, {strip_sql("coalesce(nullif(name, ''), subject, '')")} || '; ' || {strip_sql("coalesce(predicate, '')")} || '; ' || coalesce(value_type, '') || '; ' || coalesce(nullif(concat_ws(', ', t, CASE WHEN t IS NULL OR t <> span THEN span END), ''), 'unspecified time') || '; '
  || {_ONE.format(x=strip_sql('scope'), d='unspecified scope')} || '; ' || {_ONE.format(x=strip_sql('geography'), d='unspecified geography')} || '; ' || coalesce(nullif(array_to_string(ql, ', '), ''), CASE WHEN NOT is_list THEN nullif({strip_sql('qualifiers_json')}, '') END, 'no qualifiers') AS text
FROM k)"""


@query(f"{_CANON} SELECT id, text FROM c")
def canonical_text(spark, d):
    """Every fact as one line for retrieval."""
    e = table(spark, d, "entities").select(F.col("id").alias("entity_id"), F.col("canonical_name").alias("name"))
    return latest_facts(spark, d).join(e, "entity_id", "left").select("id", V.canonical_text(name=F.col("name")).alias("text"))


@query("""
WITH t AS (SELECT id, lower(canonical_name) AS s FROM entities WHERE canonical_name IS NOT NULL),
w AS (SELECT id, unnest(list_filter(regexp_split_to_array(replace(replace(s, ';', ' '), ',', ' '), '\\s+'), lambda x: x <> '')) AS w FROM t),
f AS (SELECT id, w AS f FROM w UNION ALL SELECT id, unnest(list_transform(range(1, length(w) - 1), lambda i: substr(w, i::INT, 3))) FROM w WHERE length(w) >= 3),
h AS (SELECT id, sha256(f) AS h FROM f),
c AS (SELECT id, ('0x' || substr(h, 1, 8))::BIGINT % 128 AS k, sum(CASE WHEN ('0x' || substr(h, 9, 2))::BIGINT % 2 = 0 THEN 1.0 ELSE -1.0 END) AS v FROM h GROUP BY 1, 2),
n AS (SELECT id, sqrt(sum(v * v)) AS n FROM c GROUP BY 1)
SELECT c.id, c.k::INT AS k, round((c.v / n.n)::FLOAT::DOUBLE, 5) AS v FROM c JOIN n USING (id) WHERE c.v <> 0
""")
def hash_embedding(spark, d):
    """The non-zero components of every entity name's hashed vector."""
    e = table(spark, d, "entities").where("canonical_name is not null").select("id", F.posexplode(V.hash_embedding(F.col("canonical_name"))).alias("k", "v"))
    return e.where("v <> 0").select("id", "k", F.round(F.col("v").cast("double"), 5).alias("v"))


@query(f"""{_CANON}, old AS (SELECT sha256(text) AS hash, id FROM c WHERE seq % 3 <> 0)
SELECT id AS fact_id, sha256(text) AS content_hash, 'hash-embedding-v1' AS model, 128 AS dimensions, seq % 3 <> 0 AS reused FROM c""")
def embedding_reuse(spark, d):
    """A vector for every fact, and whether one of its present text was at hand (here: for two of
    three facts, and for the others one of another text)."""
    e = table(spark, d, "entities")
    f = latest_facts(spark, d)
    have = ST.embed_facts(f.withColumn("scope", F.when(F.col("seq") % 3 == 0, "elsewhere").otherwise(F.col("scope"))), e)
    v = ST.embed_facts(f, e, Scratch(spark, "vectors").write(have))
    return v.select("fact_id", "content_hash", "model", "dimensions", "reused")


@query(f"WITH {LATEST} SELECT id AS fact_id FROM lf WHERE document_id = (SELECT min(id) FROM document_files)")
def embedding_fetch(spark, d):
    """The vectors of a document's facts (E-6)."""
    f = latest_facts(spark, d)
    first = table(spark, d, "document_files").agg(F.min("id").alias("document_id"))
    return ST.fetch_vectors(ST.embed_facts(f, table(spark, d, "entities")), f.join(first, "document_id", "left_semi").select("id")).select("fact_id")


@query("""
WITH t AS (SELECT b.*, regexp_matches(coalesce(string_split(text, chr(10))[2], ''), '^-{40}$') AS is_table FROM blocks b), n AS (SELECT page_id, count(*) FILTER (NOT is_table) AS n_text FROM t GROUP BY 1),
x AS (SELECT page_id, id, is_table, row_number() OVER (PARTITION BY page_id, is_table ORDER BY block_index NULLS FIRST, id) - 1 AS k, block_index, reading_order FROM t WHERE is_table)
SELECT id, page_id, (n_text + k)::INT AS block_index, (1000 + k)::INT AS reading_order, 'table' AS block_type FROM x JOIN n USING (page_id)
UNION ALL SELECT id, page_id, block_index, reading_order, block_type FROM t WHERE NOT is_table AND page_id IS NOT NULL
""")
def document_blocks(spark, d):
    """The blocks of every page as they are stored: tables come after its texts (S-7)."""
    b = table(spark, d, "blocks").withColumn("is_table", PG.parse_table(F.col("text")).isNotNull())
    out = PG.with_tables(b.where("not is_table"), b.where("is_table"))
    return out.select("id", "page_id", "block_index", "reading_order", "block_type")


@query("""
SELECT q.vec_id AS query_id, v.vec_id, round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 4) AS similarity FROM embeddings q JOIN embeddings v ON v.vec_id <> q.vec_id
WHERE q.vec_id % 100 = 0 AND list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) >= 0.2
""")
def cosine_search(spark, d):
    """Vectors near each query vector (ids divisible by 100), against all vectors."""
    v = table(spark, d, "embeddings")
    return V.vector_search(v, v.where("vec_id % 100 = 0"), 0.2).withColumn("similarity", F.round("similarity", 4))


@query("""
WITH n AS (SELECT id, lower(canonical_name) AS name, list_distinct(string_split(lower(canonical_name), ' ')) AS w FROM entities WHERE canonical_name IS NOT NULL), a AS (SELECT entity_id, alias, list_distinct(list_filter(regexp_split_to_array(lower(trim(alias)), '\\s+'), lambda x: x <> '')) AS w FROM entity_aliases WHERE alias IS NOT NULL)
SELECT a.entity_id, a.alias, round(CASE WHEN len(list_distinct(list_concat(n.w, a.w))) = 0 THEN 0 ELSE len(list_intersect(n.w, a.w))::DOUBLE / len(list_distinct(list_concat(n.w, a.w))) END, 4) AS similarity, count(*)::BIGINT AS n FROM a JOIN n ON n.id = a.entity_id GROUP BY ALL
""")
def alias_jaccard(spark, d):
    """Words that every alias shares with its entity's name."""
    e = table(spark, d, "entities").where("canonical_name is not null").select(F.col("id").alias("entity_id"), "canonical_name")
    a = table(spark, d, "entity_aliases").where("alias is not null").join(e, "entity_id")
    return a.groupBy("entity_id", "alias", F.round(V.word_jaccard(F.col("alias"), F.col("canonical_name")), 4).alias("similarity")).agg(F.count(F.lit(1)).alias("n"))


@query()
def alias_ratio(spark, d):
    """Ratcliff-Obershelp similarity of every distinct alias and its entity's name."""
    e = table(spark, d, "entities").select(F.col("id").alias("entity_id"), "canonical_name")
    a = table(spark, d, "entity_aliases").select("entity_id", "alias").distinct().join(e, "entity_id")
    return a.select("entity_id", "alias", F.round(V.sequence_ratio("alias", "canonical_name"), 4).alias("ratio"))


# ---- pairs of facts --------------------------------------------------------------------------------------------------

_COLS = ", ".join(f"{s}.{c} AS {s}_{c}" for s in "ab" for c in [*PR.COLUMNS, "name", "entity_type"])
_PAIRS = f"""{LATEST}, fe AS (SELECT f.*, e.canonical_name AS name, e.entity_type FROM lf f LEFT JOIN entities e ON e.id = f.entity_id),
ids AS (SELECT DISTINCT fact_a_id, fact_b_id FROM relationships WHERE fact_a_id <> fact_b_id),
pr AS (SELECT {_COLS} FROM ids JOIN fe a ON a.id = fact_a_id JOIN fe b ON b.id = fact_b_id)"""


def _side(s: str) -> str:
    f = lambda c: folded_sql(f"{s}_{c}")
    return f"""upper({f('currency')}) AS c{s}, {folded_sql(f"coalesce(nullif({s}_normalized_unit, ''), {s}_unit)")} AS u{s}, {f('scope')} AS s{s}, {f('geography')} AS g{s}, {f('predicate')} AS p{s}, {folded_sql(f'coalesce({s}_name, {s}_subject)')} AS n{s},
  coalesce(nullif(regexp_extract(lower({s}_time_text), '(20[0-9]{{2}}|19[0-9]{{2}})', 1), ''), nullif(regexp_extract(lower({s}_time_start), '(20[0-9]{{2}}|19[0-9]{{2}})', 1), '')) AS y{s},
  coalesce(regexp_matches(lower({s}_time_text), '\\bq[1-4]\\b|(first|second|third|fourth)\\s*quarter'), false) AS q{s}, list_sort(list_distinct({_LIST.format(x=f'{s}_qualifiers_json')})) AS l{s},
  coalesce({s}_value_type = 'percentage', false) AS pc{s}, coalesce({s}_value_type = 'currency', false) AS mo{s}, ({f('time_text')} <> '' OR coalesce({s}_time_start, '') <> '') AS st{s}"""


_ABBR = "map {" + ", ".join(f"'{k}': '{v}'" for k, v in X.ABBREVIATIONS.items()) + "}"
_IGN = "[" + ", ".join(f"'{w}'" for w in X.IGNORABLE) + "]"


def _tokens_sql(x: str) -> str:
    return f"flatten(list_transform(list_filter(string_split({_bare_sql(x)}, ' '), lambda w: w <> ''), lambda w: string_split(coalesce(({_ABBR})[w], w), ' ')))"


_FAM = "map {" + ", ".join(f"'{k}': '{v}'" for k, v in N.FAMILY_OF.items()) + "}"
_BASE = f"""WITH {_PAIRS}, v AS (SELECT *, {_side('a')}, {_side('b')}, {_tokens_sql('a_value_text')} AS ta, {_tokens_sql('b_value_text')} AS tb FROM pr),
w AS (SELECT *, coalesce(a_entity_type = b_entity_type OR a_entity_type = 'other' OR b_entity_type = 'other', true) AS d_types, coalesce(a_entity_id = b_entity_id AND a_entity_id <> '', false) OR (na = nb AND na <> '') AS d_entity,
  pa = pb AND pa <> '' AS d_predicate, coalesce(({_FAM})[pa] = ({_FAM})[pb], false) AS d_family, (pca OR ua = '%') = (pcb OR ub = '%') AS d_percent, NOT (ca <> '' AND cb <> '' AND ca <> cb) AS d_currency,
  CASE WHEN ca <> '' OR cb <> '' OR moa OR mob THEN ca <> '' AND ca = cb ELSE ca = cb END AS d_currency_explicit, NOT (ua <> '' AND ub <> '' AND ua <> ub) AS d_unit,
  CASE WHEN ya <> yb THEN false WHEN qa <> qb THEN false WHEN nullif(a_time_start, '') IS NOT NULL AND nullif(b_time_start, '') IS NOT NULL THEN a_time_start = b_time_start AND a_time_end IS NOT DISTINCT FROM b_time_end WHEN ya IS NOT NULL AND yb IS NOT NULL AND NOT qa AND NOT qb THEN true END AS d_period,
  NOT (sa <> '' AND sb <> '' AND sa <> sb) AS d_scope, sa = sb AS d_scope_explicit, NOT (ga <> '' AND gb <> '' AND ga <> gb) AS d_geo, ga = gb AS d_geo_explicit, la = lb AS d_quals, a_normalized_numeric_value IS NOT NULL AND b_normalized_numeric_value IS NOT NULL AS d_numbers,
  list_filter(list_concat(list_filter(ta, lambda t: NOT list_contains(tb, t)), list_filter(tb, lambda t: NOT list_contains(ta, t))), lambda t: NOT list_contains({_IGN}, t)) AS odd FROM v),
x AS (SELECT *, coalesce(a_value_text, '') <> '' AND coalesce(b_value_text, '') <> '' AND (lower({strip_sql('a_value_text')}) = lower({strip_sql('b_value_text')}) OR (len(ta) > 0 AND len(tb) > 0 AND len(odd) = 0)) AS equivalent,
  abs(a_normalized_numeric_value - b_normalized_numeric_value) / greatest(abs(a_normalized_numeric_value), abs(b_normalized_numeric_value), 1e-6) AS apart FROM w),
y AS (SELECT *, CASE WHEN d_numbers THEN apart <= 0.005 ELSE equivalent END AS d_equal FROM x),
z AS (SELECT *, CASE WHEN coalesce(a_validation_status = 'rejected', false) OR coalesce(b_validation_status = 'rejected', false) THEN 'rejected' WHEN NOT d_types THEN 'types' WHEN NOT d_entity THEN 'entities' WHEN NOT d_predicate AND NOT d_family THEN 'predicates'
  WHEN d_predicate AND NOT d_percent THEN 'percent' WHEN d_predicate AND d_currency AND d_unit AND coalesce(d_period, false) AND d_scope AND d_geo AND d_quals AND d_equal THEN 'equal'
  WHEN d_predicate AND d_currency AND d_unit AND coalesce(d_period, false) AND d_scope AND d_geo AND d_quals AND d_currency_explicit AND d_scope_explicit AND d_geo_explicit AND d_numbers AND NOT d_equal THEN 'differ'
  WHEN d_predicate AND NOT d_equal AND NOT coalesce(d_period, true) THEN 'period' WHEN d_predicate AND NOT d_equal AND NOT d_scope_explicit AND (sa <> '' OR sb <> '') THEN 'scope' WHEN d_predicate AND NOT d_equal AND NOT d_geo_explicit AND (ga <> '' OR gb <> '') THEN 'geography'
  WHEN d_predicate AND NOT d_equal AND (NOT d_currency OR NOT d_currency_explicit) AND (ca <> '' OR cb <> '') THEN 'currency' WHEN d_predicate AND NOT d_equal AND NOT d_unit THEN 'unit' ELSE 'open' END AS branch FROM y)"""
_OUT = """CASE branch WHEN 'rejected' THEN 'uncertain' WHEN 'types' THEN 'unrelated' WHEN 'entities' THEN 'unrelated' WHEN 'predicates' THEN 'unrelated' WHEN 'equal' THEN 'corroborates' WHEN 'differ' THEN 'contradicts' WHEN 'open' THEN CASE WHEN least(pa, pb) = 'revenue' AND greatest(pa, pb) = 'sales' THEN 'reconciles' ELSE 'uncertain' END ELSE 'reconciles' END"""
_DIM = """CASE branch WHEN 'rejected' THEN 'value' WHEN 'types' THEN 'entity' WHEN 'entities' THEN 'entity' WHEN 'predicates' THEN 'definition' WHEN 'percent' THEN 'unit' WHEN 'equal' THEN 'value' WHEN 'differ' THEN 'value' WHEN 'period' THEN 'time' WHEN 'scope' THEN 'scope' WHEN 'geography' THEN 'geography' WHEN 'currency' THEN 'unit' WHEN 'unit' THEN 'unit' ELSE CASE WHEN least(pa, pb) = 'revenue' AND greatest(pa, pb) = 'sales' THEN 'definition' ELSE 'other' END END"""
_CONF = """CASE branch WHEN 'rejected' THEN 0.0 WHEN 'types' THEN 1.0 WHEN 'entities' THEN 1.0 WHEN 'predicates' THEN 1.0 WHEN 'percent' THEN 0.95 WHEN 'equal' THEN 1.0 WHEN 'differ' THEN 0.95 WHEN 'period' THEN 0.95 WHEN 'open' THEN CASE WHEN least(pa, pb) = 'revenue' AND greatest(pa, pb) = 'sales' THEN 0.9 ELSE 0.6 END ELSE 0.9 END"""


def related_pairs(spark, d, turned: bool = False):
    """The distinct pairs of different facts that relationships name, with both facts; ``turned``
    names the smaller id first."""
    a, b = F.col("fact_a_id"), F.col("fact_b_id")
    ids = table(spark, d, "relationships").where("fact_a_id <> fact_b_id").select((F.least(a, b) if turned else a).alias("fact_a_id"), (F.greatest(a, b) if turned else b).alias("fact_b_id")).distinct()
    return PR.pair_up(ids, PR.with_entity(latest_facts(spark, d), table(spark, d, "entities")))


_TURNED = _BASE.replace("SELECT DISTINCT fact_a_id, fact_b_id FROM", "SELECT DISTINCT least(fact_a_id, fact_b_id) AS fact_a_id, greatest(fact_a_id, fact_b_id) AS fact_b_id FROM")


@query(f"""{_BASE} SELECT a_id, b_id, {_OUT} AS relationship_type, {_DIM} AS primary_dimension, ({_CONF})::DOUBLE AS confidence, branch, d_period, d_equal, round(CASE WHEN d_numbers THEN apart END, 4) AS difference FROM z""")
def comparator(spark, d):
    """The comparison of every related pair of facts: outcome, dimension, branch."""
    c = PR.compare(related_pairs(spark, d))
    return c.select("a_id", "b_id", F.col("d.type").alias("relationship_type"), F.col("d.dimension").alias("primary_dimension"), F.col("d.confidence").alias("confidence"), F.col("d.branch").alias("branch"), "d_period", "d_equal", F.col("d_difference").alias("difference"))


@query(f"""{_BASE} SELECT a_id, b_id, d_types AS entity, d_entity AS same_entity,
  NOT (ca <> '' AND cb <> '' AND ca <> cb) AND NOT (((pca OR {folded_sql('a_unit')} = '%' OR {folded_sql('a_normalized_unit')} = '%') AND (mob OR cb <> '')) OR ((pcb OR {folded_sql('b_unit')} = '%' OR {folded_sql('b_normalized_unit')} = '%') AND (moa OR ca <> '')))
    AND NOT (ua <> '' AND ub <> '' AND ua <> ub AND (pca OR {folded_sql('a_unit')} = '%' OR {folded_sql('a_normalized_unit')} = '%') <> (pcb OR {folded_sql('b_unit')} = '%' OR {folded_sql('b_normalized_unit')} = '%')) AS unit,
  CASE WHEN ya IS NOT NULL AND yb IS NOT NULL THEN ya = yb WHEN sta OR stb THEN true END AS period FROM z""")
def pair_compatibility(spark, d):
    """Whether entity types, units and periods of every related pair can be compared."""
    return related_pairs(spark, d).select("a_id", "b_id", PR.entity_compatible().alias("entity"), PR.same_entity().alias("same_entity"), PR.unit_compatible().alias("unit"), PR.period_compatible().alias("period"))


@query(f"{_BASE} SELECT a_id, b_id, equivalent, array_to_string(ta, ' ') AS words_a FROM x")
def text_equivalence(spark, d):
    """Whether the values of every related pair say the same as texts."""
    a, b = F.col("a_value_text"), F.col("b_value_text")
    return related_pairs(spark, d).select("a_id", "b_id", X.equivalent(a, b).alias("equivalent"), F.array_join(X.text_tokens(a), " ").alias("words_a"))


@query(f"""{_TURNED}, s AS (SELECT *, round(least(1.0, 0.30 * (CASE WHEN d_entity THEN 1.0 ELSE 0.0 END) + 0.30 * (CASE WHEN pa = pb THEN 1.0 WHEN ({_FAM})[pa] = ({_FAM})[pb] THEN 0.91 ELSE 0.0 END) + 0.25
  + CASE WHEN ya IS NOT NULL AND yb IS NOT NULL THEN CASE WHEN ya = yb THEN 0.10 ELSE 0.0 END WHEN sta OR stb THEN 0.10 ELSE 0.05 END + CASE WHEN a_document_id = b_document_id THEN 0.0 ELSE 0.05 END), 2) AS score FROM z),
e AS (SELECT a_id, b_id, score, a_document_id = b_document_id AS same, unnest([a_id, b_id]) AS e FROM s),
r AS (SELECT *, row_number() OVER (PARTITION BY e ORDER BY score DESC, same ASC NULLS FIRST, a_id, b_id) AS k FROM e)
SELECT DISTINCT a_id, b_id, score::DOUBLE AS score FROM r WHERE k <= 3""")
def topk_either_endpoint(spark, d):
    """Related pairs that are among the three best of either fact, by the score without vectors."""
    p = related_pairs(spark, d, turned=True)
    one = F.when(PR.same_entity(), 1.0).otherwise(0.0)
    p = p.withColumn("score", PR.pair_score(one, PR.predicate_similarity(F.lit(0.0)), F.lit(1.0)))
    return PR.top_k_either(p.select("a_id", "b_id", "a_document_id", "b_document_id", "score"), 3).select("a_id", "b_id", "score")


@query()
def candidate_pairs(spark, d):
    """The ten best candidates of each query fact (seq divisible by 100) among all facts, without loss."""
    e = table(spark, d, "entities")
    scratch = Scratch(spark, "candidates")
    last = scratch.write(FA.latest(table(spark, d, "facts").select(*PR.COLUMNS, "created_at", "seq"), ["id"], F.col("created_at"), F.col("seq")))
    f = scratch.write(FA.with_entities(last, e, table(spark, d, "entity_aliases")))
    c = PR.search_candidates(f, e, f.where("seq % 100 = 0"), scratch)
    return c.select("a_id", "b_id", "predicate_similarity", "semantic", "period", "score", "rank")


@query(f"""{_BASE}, k AS (SELECT a_id, b_id, branch, sha256(concat_ws('::', a_id, a_value_text, b_id, b_value_text, 'v1')) AS key, a_id < b_id AS cached FROM z WHERE branch = 'open')
SELECT key, any_value(a_id) AS a_id, any_value(b_id) AS b_id, bool_or(cached) AS cached FROM k GROUP BY key""")
def provider_cache(spark, d):
    """Pairs that the comparison leaves open, by cache key, and whether the cache answers them."""
    open_ = PR.compare(related_pairs(spark, d)).where("d.branch = 'open'").withColumn("key", PR.cache_key())
    cache = open_.where("a_id < b_id").select("key", F.lit("cached").alias("answer"))
    hits, misses = ST.with_cache(open_.select("key", "a_id", "b_id"), cache, "key", "answer")
    return hits.select("key", "a_id", "b_id", F.lit(True).alias("cached")).distinct().unionByName(misses.select("key", "a_id", "b_id", F.lit(False).alias("cached")))


def _vs(c: str) -> str:
    return f"chr(39) || coalesce(nullif(a_{c}, ''), 'unspecified') || chr(39) || ' vs ' || chr(39) || coalesce(nullif(b_{c}, ''), 'unspecified') || chr(39)"


@query(f"""{_BASE}, na AS (SELECT *, coalesce(a_name, a_subject) AS an, coalesce(b_name, b_subject) AS bn FROM z)
SELECT a_id, b_id, CASE branch WHEN 'rejected' THEN 'A fact of the pair was rejected by verification.' WHEN 'types' THEN 'Entity types differ: ' || coalesce(nullif(a_entity_type, ''), 'unspecified') || ' vs ' || coalesce(nullif(b_entity_type, ''), 'unspecified') || '.'
  WHEN 'entities' THEN 'Facts are about different entities: ' || chr(39) || an || chr(39) || ' vs ' || chr(39) || bn || chr(39) || '.' WHEN 'predicates' THEN 'Facts are about different metrics: ' || {_vs('predicate')} || '.' WHEN 'percent' THEN 'One value is a percentage, the other is not: ' || {_vs('value_text')} || '.'
  WHEN 'equal' THEN 'Both sources give ' || an || ' ' || a_predicate || ' as ' || a_value_text || '.' WHEN 'differ' THEN 'Sources contradict each other on ' || an || ' ' || a_predicate || ': ' || {_vs('value_text')} || '.' WHEN 'period' THEN 'Values are for different periods: ' || {_vs('time_text')} || '.'
  WHEN 'scope' THEN 'Values differ by scope: ' || {_vs('scope')} || '.' WHEN 'geography' THEN 'Values differ by geography: ' || {_vs('geography')} || '.' WHEN 'currency' THEN 'Values differ by currency: ' || {_vs('currency')} || '.' WHEN 'unit' THEN 'Values differ by unit: ' || {_vs('unit')} || '.'
  ELSE 'No dimension decides; the offline provider answered.' END AS explanation FROM na""")
def explanations(spark, d):
    """The sentence that explains the outcome of every related pair."""
    return PR.compare(related_pairs(spark, d)).select("a_id", "b_id", "explanation")


# ---- aggregates --------------------------------------------------------------------------------------------------------

_KIND = f"lower({strip_sql('relationship_type')})"


@query(f"""WITH {LATEST}, r AS (SELECT {_KIND} AS t FROM relationships)
SELECT (SELECT count(*) FROM document_files) AS documents, (SELECT count(*) FROM entities) AS entities, (SELECT count(*) FROM lf) AS facts, (SELECT count(*) FILTER (validation_status = 'validated') FROM lf) AS validated, (SELECT count(*) FILTER (validation_status = 'warning') FROM lf) AS warning,
  (SELECT count(*) FILTER (validation_status = 'rejected') FROM lf) AS rejected, count(*) AS relationships, count(*) FILTER (t = 'corroborates') AS corroborates, count(*) FILTER (t = 'contradicts') AS contradicts, count(*) FILTER (t = 'reconciles') AS reconciles, count(*) FILTER (t = 'uncertain') AS uncertain, count(*) FILTER (t = 'unrelated') AS unrelated FROM r""")
def knowledge_summary(spark, d):
    """Counters of documents, entities, facts by status and relationships by type."""
    n = F.count(F.lit(1))
    f = latest_facts(spark, d).agg(n.alias("facts"), *(F.count_if(F.col("validation_status") == s).alias(s) for s in ("validated", "warning", "rejected")))
    t = F.lower(X.strip(F.col("relationship_type")))
    r = table(spark, d, "relationships").agg(n.alias("relationships"), *(F.count_if(t == s).alias(s) for s in ("corroborates", "contradicts", "reconciles", "uncertain", "unrelated")))
    # four one-row aggregates side by side
    one = lambda df: df.withColumn("__k", F.lit(1))
    parts = [table(spark, d, "document_files").agg(n.alias("documents")), table(spark, d, "entities").agg(n.alias("entities")), f, r]
    out = one(parts[0])
    for p in parts[1:]:
        out = out.join(one(p), "__k")
    return out.drop("__k")


@query(f"WITH {LATEST}, a AS (SELECT entity_id, array_to_string(list_sort(list_distinct(list(alias))), '; ') AS aliases FROM entity_aliases WHERE alias IS NOT NULL GROUP BY 1), c AS (SELECT entity_id, count(*) AS n FROM lf GROUP BY 1) SELECT e.id, e.canonical_name, coalesce(c.n, 0)::BIGINT AS n_facts, coalesce(a.aliases, '') AS aliases FROM entities e LEFT JOIN c ON c.entity_id = e.id LEFT JOIN a ON a.entity_id = e.id")
def entity_breakdown(spark, d):
    """Every entity with the number of its facts and its aliases."""
    c = latest_facts(spark, d).groupBy("entity_id").agg(F.count(F.lit(1)).alias("n_facts"))
    a = table(spark, d, "entity_aliases").where("alias is not null").groupBy("entity_id").agg(F.array_join(F.array_sort(F.collect_set("alias")), "; ").alias("aliases"))
    e = table(spark, d, "entities").select("id", "canonical_name", F.col("id").alias("entity_id"))
    return e.join(c, "entity_id", "left").join(a, "entity_id", "left").select("id", "canonical_name", F.coalesce("n_facts", F.lit(0)).alias("n_facts"), F.coalesce("aliases", F.lit("")).alias("aliases"))


@query(f"SELECT {_KIND} AS kind, primary_dimension AS dimension, count(*)::BIGINT AS n, round(avg(confidence), 6) AS confidence FROM relationships GROUP BY 1, 2")
def relationship_distribution(spark, d):
    """Relationships by type and dimension."""
    return table(spark, d, "relationships").groupBy(F.lower(X.strip(F.col("relationship_type"))).alias("kind"), F.col("primary_dimension").alias("dimension")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("confidence"), 6).alias("confidence"))


_TABLES = ("document_files", "pages", "blocks", "chunks", "facts", "entities", "entity_aliases", "relationships")


@query(" UNION ALL ".join(f"SELECT '{t}' AS name, count(*)::BIGINT AS n FROM {t}" for t in _TABLES))
def table_counts(spark, d):
    """Rows of every table."""
    out = None
    for t in _TABLES:
        c = table(spark, d, t).agg(F.count(F.lit(1)).alias("n")).select(F.lit(t).alias("name"), "n")
        out = c if out is None else out.unionByName(c)
    return out


@query("WITH c AS (SELECT document_id, count(*) AS done FROM chunks GROUP BY 1) SELECT d.id, coalesce(c.done, 0)::BIGINT AS done, round(coalesce(c.done, 0) / (3.0 * greatest(d.page_count, 0) + 2), 2)::DOUBLE AS progress FROM document_files d LEFT JOIN c ON c.document_id = d.id WHERE d.page_count IS NOT NULL")
def progress(spark, d):
    """Chunks made of every document and the share of its steps they are."""
    c = table(spark, d, "chunks").groupBy(F.col("document_id").alias("id")).agg(F.count(F.lit(1)).alias("done"))
    f = table(spark, d, "document_files").where("page_count is not null").join(c, "id", "left").withColumn("done", F.coalesce("done", F.lit(0)))
    return f.select("id", "done", F.round(F.col("done") / (3.0 * F.greatest("page_count", F.lit(0)) + 2), 2).alias("progress"))


@query("SELECT id, 65 >= length(t) AS whole, CASE WHEN length(t) > 65 THEN substr(t, 1, 62) || '...' ELSE t END AS title FROM (SELECT id, split_part(explanation, '. ', 1) AS t FROM relationships WHERE explanation IS NOT NULL)")
def relationship_titles(spark, d):
    """A short title of every relationship."""
    t = F.substring_index("explanation", ". ", 1)
    return table(spark, d, "relationships").where("explanation is not null").select("id", (F.length(t) <= 65).alias("whole"), X.short_title(F.col("explanation")).alias("title"))


@query("SELECT id, fact_a_id, fact_b_id FROM relationships WHERE fact_a_id IN (SELECT id FROM facts) AND fact_b_id IN (SELECT id FROM facts)")
def guarded_relationships(spark, d):
    """Relationships both of whose facts exist."""
    return ST.known(table(spark, d, "relationships").select("id", "fact_a_id", "fact_b_id"), table(spark, d, "facts"))


@query("""WITH live AS (SELECT id FROM document_files WHERE status <> 'error'), p AS (SELECT id FROM pages WHERE document_id IN (SELECT id FROM live)), c AS (SELECT id FROM chunks WHERE document_id IN (SELECT id FROM live)), f AS (SELECT DISTINCT id FROM facts WHERE chunk_id IN (SELECT id FROM c))
SELECT 'pages' AS name, count(*)::BIGINT AS n FROM p UNION ALL SELECT 'blocks', count(*) FROM blocks WHERE page_id IN (SELECT id FROM p) UNION ALL SELECT 'chunks', count(*) FROM c UNION ALL SELECT 'facts', count(*) FROM f
UNION ALL SELECT 'relationships', count(*) FROM relationships WHERE fact_a_id IN (SELECT id FROM f) AND fact_b_id IN (SELECT id FROM f)""")
def cascade_prune(spark, d):
    """What is left of each table when failed documents are deleted."""
    t = {x: table(spark, d, x) for x in _TABLES}
    live = t["document_files"].where("status <> 'error'")
    pages, chunks = ST.prune(t["pages"], live, "document_id"), ST.prune(t["chunks"], live, "document_id")
    facts = ST.prune(t["facts"], chunks, "chunk_id").select("id").distinct()
    left = {"pages": pages, "blocks": ST.prune(t["blocks"], pages, "page_id"), "chunks": chunks, "facts": facts, "relationships": ST.known(t["relationships"], facts)}
    out = None
    for k, df in left.items():
        c = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("name"), "n")
        out = c if out is None else out.unionByName(c)
    return out


@query("SELECT f.id, f.seq, CASE WHEN e.id IS NOT NULL THEN f.entity_id END AS entity_id FROM facts f LEFT JOIN (SELECT DISTINCT id FROM entities WHERE entity_type <> 'other') e ON e.id = f.entity_id")
def orphan_entities(spark, d):
    """Facts with a null entity where the entity is gone (here: those of type other)."""
    e = table(spark, d, "entities").where("entity_type <> 'other'")
    return ST.orphan_to_null(table(spark, d, "facts").select("id", "seq", "entity_id"), e, "entity_id")


@query("SELECT c.id, CASE WHEN c.id IN (SELECT chunk_id FROM facts WHERE chunk_id IS NOT NULL) THEN 'completed' ELSE c.extraction_status END AS extraction_status FROM chunks c")
def status_update(spark, d):
    """Chunks with the status `completed` where facts were extracted from them."""
    done = table(spark, d, "facts").where("chunk_id is not null").select(F.col("chunk_id").alias("id"), F.lit("completed").alias("extraction_status")).distinct()
    return ST.update(table(spark, d, "chunks").select("id", "extraction_status"), done, "id")


@query("SELECT id FROM document_files WHERE id NOT IN (SELECT document_id FROM chunks WHERE document_id IS NOT NULL)")
def unprocessed_documents(spark, d):
    """Documents without chunks, which a run has still to process."""
    c = table(spark, d, "chunks").select(F.col("document_id").alias("id")).distinct()
    return table(spark, d, "document_files").join(c, "id", "left_anti").select("id")


_CHECKED = ("document_files", "blocks", "chunks", "facts", "entities", "entity_aliases", "relationships")
_RULES = [(t, c, f"{c} NOT IN ({', '.join(repr(v) for v in d.split())})") for (t, c), d in schemas.DOMAINS.items()] + [(t, c, f"NOT {c} BETWEEN 0 AND 1") for t, c in sorted(schemas.RANGES)]


@query("SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{t}' AS name, '{c}' AS column, count(*) FILTER ({rule})::BIGINT AS rows FROM {t}" for t, c, rule in _RULES if t in _CHECKED) + ") WHERE rows > 0")
def contract_report(spark, d):
    """How many rows of each table break each contract of the data model."""
    out = None
    for t in _CHECKED:
        r = schemas.contract_report(table(spark, d, t), t).withColumn("name", F.lit(t))
        out = r if out is None else out.unionByName(r)
    return out


@query()
def pipeline_relationships(spark, d):
    """The whole pipeline over the facts of the tables for the query facts (seq divisible by 100): normalise, merge, pair, decide; relationships by outcome."""
    from factweave.plans.pipeline import relationships

    r = relationships(*(table(spark, d, t) for t in ("facts", "entities", "document_files")), queries="seq % 100 = 0", aliases=table(spark, d, "entity_aliases"))
    return r.groupBy("relationship_type", "primary_dimension").agg(F.count(F.lit(1)).alias("n"))
