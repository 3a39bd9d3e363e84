"""Problem 6: which entity a typed name means.

Spellings are parsed into tokens; those that differ in letter case, spaces and
punctuation only are one form and are compared once.  Forms and entities are blocked
by phonetic codes of their sorted tokens: the code of a token and, for longer codes,
the code with any one position left out, so that one wrong, missing, extra or
exchanged consonant still meets the right block; short tokens by themselves, and all
tokens together.  Pairs that share a block are compared token by token: equal,
Jaro-Winkler with a bound on the edits, nickname table, abbreviation, initial.

A form is accepted for an entity if it fits that entity better than every other.  A
form that fits none is compared with the accepted forms that are a letter away from
it as a whole.  Both kinds of accepted pairs are clustered by connected components; a
component that holds one entity gives it to all its forms, one that holds several to
none but those accepted for an entity themselves.

Names are compared once however many rows carry them, and the entity side of
a block is bounded by the number of entities that share a stem or family name.
"""

from __future__ import annotations

import functools
import math
import re
import unicodedata
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factweave.llm.components import components

# Legal forms, words of no meaning in a name, short forms of given names.
LEGAL = ["inc", "incorporated", "corporation", "corp", "plc", "limited", "ltd", "pte ltd", "gmbh", "llc", "llp", "ag", "sa", "sas", "sarl", "nv", "bv", "oy", "ab", "as", "spa", "kg", "se", "kk", "pty ltd", "co ltd"]
EMPTY = ["the", "of", "and", "co", "dr", "mr", "ms", "mrs", "prof", "sir", "mx", "st"]
NICKNAMES = {
    "alexander": "alex al sandy sasha xander lex", "andrew": "andy drew", "anthony": "tony ant", "benjamin": "ben benny benji", "catherine": "cathy kate kathy katie cat", "charles": "charlie chuck chas",
    "christina": "tina chris chrissie christie", "christopher": "chris kit topher", "daniel": "dan danny", "david": "dave davy", "edward": "ed eddie ned", "elizabeth": "liz lizzie beth betty eliza bess libby lisa",
    "frances": "fran fanny", "francesca": "fran frankie cesca francie chess", "francis": "frank fran", "frederick": "fred freddie fritz freddy rick", "gabriella": "gabi gabby ella gaby bella", "george": "georgie",
    "henry": "harry hank hal", "jacob": "jake", "james": "jim jimmy jamie", "john": "johnny jack", "jonathan": "jon jonny nathan johnny", "joseph": "joe joey", "josephine": "josie jo posy", "katherine": "kate kathy katie kat kitty kay",
    "lawrence": "larry laurie", "leonard": "leo len lenny", "margaret": "maggie meg peggy marge greta madge daisy", "matilda": "tilda tilly mattie maud", "matthew": "matt", "michael": "mike mick mickey", "nicholas": "nick nicky klaus nico",
    "patricia": "pat patty tricia", "patrick": "pat paddy", "penelope": "penny pen nell", "peter": "pete", "philip": "phil pip", "rebecca": "becky becca bec", "richard": "rick dick rich richie ricky", "robert": "rob bob bobby robbie bert",
    "samuel": "sam sammy", "stephen": "steve", "susannah": "sue susie suzy sanna anna", "theodore": "ted teddy theo", "thomas": "tom tommy", "timothy": "tim", "victoria": "vicky tori", "walter": "walt wally", "william": "bill will billy willie liam",
}
FULL = {}
for _full, _short in NICKNAMES.items():
    for _s in _short.split():
        FULL.setdefault(_s, set()).add(_full)

_LEGAL = re.compile(r"[\s,]+(" + "|".join(r"\.?\s*".join(map(re.escape, x.split())) if " " in x else (r"\.?".join(x) if len(x) <= 3 else x) for x in sorted(LEGAL, key=len, reverse=True)) + r")\.?\s*$", re.I)
_TOKEN = re.compile(r"[^\W_]+(?:['’@][^\W_]+)*\.?")
_GLYPH = str.maketrans("013569@", "oiesbga")
#: Consonants that sound alike share a digit; vowels and h, w, y sound as nothing.
_SOUND = str.maketrans("bpfvcgjkqsxzdtlmnr", "111122222222334556")


class Name(NamedTuple):
    tokens: tuple[str, ...]
    dotted: tuple[bool, ...]
    legal: str
    raw: str


def fold(s: str) -> str:
    s = unicodedata.normalize("NFKD", s).replace("ß", "ss").replace("ø", "o").replace("ł", "l")
    return "".join(c for c in s if not unicodedata.combining(c))


@functools.lru_cache(maxsize=1 << 16)
def parse(raw: str) -> Name:
    """Tokens of a name without titles and small words, and its legal form."""
    s = re.sub(r"\s+", " ", fold(raw)).strip()
    m = _LEGAL.search(" " + s)
    legal = ""
    if m:
        legal = re.sub(r"\W", "", m[1]).lower()
        s = (" " + s)[: m.start()].strip()
    s = re.sub(r"\b[Mm]s/[Mm]r\b|&\s*[Cc]o\.?", " ", s)
    s = re.sub(r"(?<=[a-z@0-9])(?=[A-Z][a-z@0-9])", " ", s)
    tokens, dotted = [], []
    for t in _TOKEN.findall(s):
        dot = t.endswith(".")
        t = t.rstrip(".").replace("’", "").replace("'", "")
        if re.search(r"[a-zA-Z]", t) and re.search(r"[0-9@]", t):
            t = t.translate(_GLYPH)
        t = t.lower()
        if t and t not in EMPTY and not t.isdigit():
            tokens.append(t)
            dotted.append(dot)
    return Name(tuple(tokens), tuple(dotted), legal, s)


def form(n: Name) -> str:
    """What is compared of a name, as text: tokens, which of them end in a dot, legal form
    and whether the name is in capitals, which tells an acronym."""
    upper = len(n.tokens) == 1 and n.raw.strip(".").replace(".", "").isupper()
    return " ".join(t + "." * d for t, d in zip(n.tokens, n.dotted)) + "|" + n.legal + "|" + "U" * upper


@functools.lru_cache(maxsize=1 << 16)
def name_of(form: str) -> Name:
    tokens, legal, upper = form.split("|")
    ts = tokens.split(" ") if tokens else []
    return Name(tuple(t.rstrip(".") for t in ts), tuple(t.endswith(".") for t in ts), legal, "A" if upper else "a")


def sound(t: str) -> str:
    """Phonetic code: the class of each consonant, a leading vowel as A. Doubles count twice, so that one wrong letter is one wrong place."""
    lead = "A" if t[:1] in "aeiouhwy" else ""
    return lead + "".join(c.translate(_SOUND) for c in t if c not in "aeiouhwy" and c.isascii() and c.isalpha())


def keys(tokens: tuple[str, ...]) -> list[str]:
    """Block keys of tokens: codes of the sorted tokens, whole and with one place left out;
    tokens under three letters as they are."""
    out = set()
    for t in sorted(tokens):
        if len(t) < 3:
            out.add("'" + t)
            continue
        c = sound(t)
        out.add(c)
        if len(c) >= 3:
            out.update(c[:i] + c[i + 1 :] for i in range(len(c)))
    return sorted(out)


def together(n: Name) -> list[str]:
    """Block keys of a name as a whole: all its tokens, and its initials with its legal form."""
    return ["=" + " ".join(sorted(n.tokens))] if n.tokens else []


def jaro_winkler(a: str, b: str) -> float:
    if a == b:
        return 1.0
    n, m = len(a), len(b)
    if not n or not m:
        return 0.0
    w = max(0, max(n, m) // 2 - 1)
    used, hit = [False] * m, []
    for i, c in enumerate(a):
        for j in range(max(0, i - w), min(m, i + w + 1)):
            if not used[j] and b[j] == c:
                used[j] = True
                hit.append(c)
                break
    k = len(hit)
    if not k:
        return 0.0
    other = [b[j] for j in range(m) if used[j]]
    t = sum(x != y for x, y in zip(hit, other)) / 2
    jaro = (k / n + k / m + (k - t) / k) / 3
    p = 0
    while p < min(4, n, m) and a[p] == b[p]:
        p += 1
    return jaro + p * 0.1 * (1 - jaro)


def edits(a: str, b: str, most: int) -> int:
    """Insertions, deletions, substitutions and exchanges of neighbours, or most + 1."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    two, one = [], list(range(len(b) + 1))
    for i, c in enumerate(a, 1):
        row = [i] + [0] * len(b)
        for j, d in enumerate(b, 1):
            row[j] = min(one[j] + 1, row[j - 1] + 1, one[j - 1] + (c != d))
            if i > 1 and j > 1 and c == b[j - 2] and a[i - 2] == d:
                row[j] = min(row[j], two[j - 2] + 1)
        if min(row) > most:
            return most + 1
        two, one = one, row
    return one[-1]


@functools.lru_cache(maxsize=1 << 17)
def typo(a: str, b: str) -> float:
    """How well ``a`` is ``b`` with typing errors; 0 if not."""
    if a == b:
        return 1.0
    if min(len(a), len(b)) < 4:
        return 0.0
    j = jaro_winkler(a, b)
    most = 2 if min(len(a), len(b)) >= 6 else 1
    e = edits(a, b, most)
    if e > most and "rn" in a + b:
        e = edits(a.replace("rn", "m"), b.replace("rn", "m"), most)
    if e > most or j < (0.78 if e == 1 else 0.85):
        return 0.0
    return 0.97 - 0.03 * e


def short(t: str, w: str, dot: bool) -> float:
    """How well ``t`` abbreviates ``w``: it starts like it and leaves letters out."""
    if len(t) == 1:
        return 0.5 if w.startswith(t) else 0.0
    if t[0] != w[0] or len(t) > len(w) - (1 if dot else 2):
        return 0.0
    rest = iter(w)
    if not all(c in rest for c in t):
        return 0.0
    return 0.85 if w.startswith(t) or t[-1] == w[-1] else (0.8 if dot else 0.7)


def fit(name: Name, other: Name) -> float:
    """How well a spelling fits an entity's name: 0 not at all, over 1 if it is the name."""
    if not name.tokens or not other.tokens:
        return 0.0
    if name.tokens == other.tokens and name.legal in ("", other.legal):
        return 1.05
    return fit_company(name, other) if other.legal else fit_person(name, other)


def assignment(gain: list[list[float]]) -> float:
    """The greatest sum of one entry a row, all in different columns (Hungarian method);
    there are as many columns as rows at least."""
    n, m = len(gain), len(gain[0])
    u, v, of = [0.0] * (n + 1), [0.0] * (m + 1), [0] * (m + 1)
    for i in range(1, n + 1):
        of[0], j = i, 0
        low, way, done = [math.inf] * (m + 1), [0] * (m + 1), [False] * (m + 1)
        while of[j]:
            done[j] = True
            delta, to = math.inf, 0
            for k in range(1, m + 1):
                if not done[k]:
                    c = -gain[of[j] - 1][k - 1] - u[of[j]] - v[k]
                    if c < low[k]:
                        low[k], way[k] = c, j
                    if low[k] < delta:
                        delta, to = low[k], k
            for k in range(m + 1):
                if done[k]:
                    u[of[k]], v[k] = u[of[k]] + delta, v[k] - delta
                else:
                    low[k] -= delta
            j = to
        while j:
            of[j], j = of[way[j]], way[j]
    return sum(gain[of[k] - 1][k - 1] for k in range(1, m + 1) if of[k])


#: What an entry gains that must be taken, and loses that must not.
MUST, NEVER = 100.0, -10000.0


def fit_company(name: Name, other: Name) -> float:
    """Each token must stand for another word of the company's name, one of them for its first."""
    t, w = name.tokens, other.tokens
    if len(t) == 1 and name.raw.strip(".").replace(".", "").isupper() and t[0] == "".join(x[0] for x in w) and len(w) > 1:
        return 0.9 if name.legal == other.legal else 0.0
    if len(t) > len(w):
        return 0.0
    gain = []
    for x, dot in zip(t, name.dotted):
        row = [typo(x, y) or (short(x, y, dot) if k else 0.0) for k, y in enumerate(w)]
        if not any(row):
            return 0.0
        gain.append([(q + (0 if k else MUST)) if q else NEVER for k, q in enumerate(row)])
    total = assignment(gain)
    return round((total - MUST) / len(t), 9) if total >= MUST else 0.0


def fit_person(name: Name, other: Name) -> float:
    t, w = name.tokens, other.tokens
    if name.legal or len(w) < 2 or not 2 <= len(t) <= 3:
        return 0.0
    given, middle, family = w[0], w[1:-1], w[-1]
    best = 0.0
    for f in range(len(t)):
        qf = typo(t[f], family)
        if not qf or len(t[f]) < 3:
            continue
        rest = t[f + 1 :] + t[:f]
        for g, mid in ((rest[0], rest[1:]), (rest[-1], rest[:-1])):
            if len(g) == 1:
                qg = 0.5 if given[0] == g else 0.0
            elif given in FULL.get(g, ()):
                qg = 0.96
            else:
                qg = typo(g, given) or max((typo(g, s) * 0.96 for s in NICKNAMES.get(given, "").split() if len(s) > 3), default=0.0)
            if not qg:
                continue
            extra = 0.0
            if mid and middle:
                if mid[0][0] != middle[0][0] or (len(mid[0]) > 1 and len(middle[0]) > 1 and not typo(mid[0], middle[0])):
                    continue
                extra = 0.05
            elif mid:
                if len(mid[0]) > 1:
                    continue
                extra = -0.05
            best = max(best, (qf + qg) / 2 + extra)
    return best


LEAST = 0.6
MARGIN = 0.012


def spellings(facts: DataFrame) -> DataFrame:
    """Distinct non-blank names of facts without an entity."""
    n = facts.where("entity_id is null").select(F.explode(F.array_distinct(F.array("subject", "subject_mention"))).alias("name"))
    return n.where(F.col("name").rlike(r"(?U)\w")).distinct()


def _spread(df: DataFrame, *by: str) -> DataFrame:
    """Rows of few bytes and much work, over all tasks."""
    spark = df.sparkSession
    return df.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), *by)


@F.pandas_udf(T.StringType())
def _form(name: pd.Series) -> pd.Series:
    return pd.Series([form(parse(n)) for n in name], dtype=object)


def _keyed(most: int, longest: int):
    """Keys of forms. All tokens of a form must fit one of a name's each, so forms have none
    that have more than ``most`` tokens (a person's three at least) or one that no token
    of a name, of ``longest`` letters at most, can have become (`m` as `rn`, and two more)."""

    def run(it):
        for pdf in it:
            ks = []
            for f in pdf.form:
                p = name_of(f)
                k = [*keys(p.tokens), *together(p)] if len(p.tokens) <= max(most, 3) and max(map(len, p.tokens), default=0) <= 2 * longest + 2 else []
                if len(p.tokens) == 1 and p.legal and len(p.tokens[0]) <= most:
                    k.append("=" + p.tokens[0] + " " + p.legal)
                ks.append(k)
            yield pdf.assign(key=ks).explode("key").dropna(subset=["key"])

    return run


def _entity_keyed(it):
    for pdf in it:
        ks = []
        for f in pdf.canonical:
            p = name_of(f)
            k = [*keys(p.tokens[:1] if p.legal else p.tokens[-1:]), *together(p)]
            if p.legal and len(p.tokens) > 1:
                k.append("=" + "".join(x[0] for x in p.tokens) + " " + p.legal)
            ks.append(k)
        yield pdf.assign(key=ks).explode("key").dropna(subset=["key"])


@F.pandas_udf(T.DoubleType())
def _fit(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([fit(name_of(x), name_of(y)) for x, y in zip(a, b)])


def form_fits(forms: DataFrame, entities: DataFrame, scratch) -> DataFrame:
    """(form, entity_id, score) of all forms and entities that fit."""
    ents = entities.where("id is not null and canonical_name is not null").select(F.col("id").alias("entity_id"), F.col("canonical_name").alias("name")).distinct()
    ents = scratch.write(ents.select("entity_id", _form("name").alias("canonical")).distinct())
    tokens = F.split(F.substring_index("canonical", "|", 1), " ")
    most, longest = ents.agg(F.max(F.size(tokens)), F.max(F.array_max(F.transform(tokens, F.length)))).first()
    left = forms.mapInPandas(_keyed(most or 0, longest or 0), "form string, key string")
    right = ents.mapInPandas(_entity_keyed, "entity_id string, canonical string, key string")
    pairs = _spread(left.join(right, "key").select("form", "entity_id", "canonical").distinct(), "form")
    return pairs.withColumn("score", _fit("form", "canonical")).where(F.col("score") >= LEAST).select("form", "entity_id", "score")


def form_links(scored: DataFrame) -> DataFrame:
    """(form, entity_id): the one entity each form fits best; forms that fit several equally
    well have none."""
    top = scored.groupBy("form").agg(F.max("score").alias("top"))
    near = scored.join(top, "form").where(F.col("score") >= F.col("top") - MARGIN)
    return near.groupBy("form").agg(F.min("entity_id").alias("entity_id"), F.max("entity_id").alias("z")).where("entity_id = z").select("form", "entity_id")


def variant(a: Name, b: Name) -> bool:
    """Whether two spellings differ by a letter, or two exchanged ones, in one token."""
    if len(a.tokens) != len(b.tokens) or (a.legal and b.legal and a.legal != b.legal):
        return False
    odd = [(x, y) for x, y in zip(a.tokens, b.tokens) if x != y]
    return not odd or (len(odd) == 1 and min(map(len, odd[0])) >= 4 and edits(*odd[0], 1) == 1 and jaro_winkler(*odd[0]) >= 0.85)


#: Of the digests of a name's letters: a prime, and the base of the polynomial.
PRIME, BASE = (1 << 61) - 1, 1_000_003


def whole(t: str) -> set[int]:
    """Digests of the text and of the text without each one of its letters, in time in
    proportion to its length."""
    before, power = [0], [1]
    for c in t:
        before.append((before[-1] * BASE + ord(c)) % PRIME)
        power.append(power[-1] * BASE % PRIME)
    n = len(t)
    out = {before[n]}
    for i in range(n):
        behind = (before[n] - before[i + 1] * power[n - i - 1]) % PRIME
        out.add((before[i] * power[n - i - 1] + behind) % PRIME)
    return out


def _whole(it):
    for pdf in it:
        yield pdf[["id"]].assign(key=[sorted(whole(f.split("|")[0].replace(".", ""))) for f in pdf.form]).explode("key").astype({"key": "int64"})


@F.pandas_udf(T.BooleanType())
def _variant(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([variant(name_of(x), name_of(y)) for x, y in zip(a, b)], dtype=bool)


def form_variants(forms: DataFrame, scored: DataFrame, links: DataFrame) -> DataFrame:
    """(a, b): forms that fit no entity, with the accepted forms they are variants of.

    They meet by nearly all their letters, so the forms that meet are variants, not the
    bearers of a common word.
    """
    named = lambda d, n: d.select(F.md5("form").alias(f"i{n}"), F.col("form").alias(n))
    key = lambda d, n: d.withColumnsRenamed({f"i{n}": "id", n: "form"}).mapInPandas(_whole, "id string, key long").withColumnRenamed("id", f"i{n}")
    open_, known = named(forms.join(scored.select("form").distinct(), "form", "left_anti"), "a"), named(links.select("form"), "b")
    # only digests meet: a long text has as many keys as letters
    pairs = key(open_, "a").join(key(known, "b"), "key").select("ia", "ib").distinct()
    pairs = pairs.join(open_, "ia").join(known, "ib").select("a", "b")
    return pairs.where(_variant("a", "b"))


def clustered(links: DataFrame, variants: DataFrame, scratch) -> DataFrame:
    """(form, entity_id): accepted pairs, of forms with entities and of forms with each other,
    grouped by connected components, which give their one entity to all their forms."""
    edges = links.select(F.concat(F.lit("e"), "entity_id").alias("a"), F.concat(F.lit("f"), "form").alias("b"))
    groups = scratch.write(components(edges.unionByName(variants.select(F.concat(F.lit("f"), "a").alias("a"), F.concat(F.lit("f"), "b").alias("b"))), scratch))
    owner = groups.where(F.col("vertex").startswith("e")).groupBy("component").agg(F.min("vertex").alias("e"), F.count(F.lit(1)).alias("n"))
    members = groups.where(F.col("vertex").startswith("f")).join(owner, "component").select(F.expr("substr(vertex, 2)").alias("form"), F.when(F.col("n") == 1, F.expr("substr(e, 2)")).alias("one"))
    # a variant between the forms of two entities joins their groups; forms keep their own entity then
    return members.join(links, "form", "left").select("form", F.coalesce("one", "entity_id").alias("entity_id")).where("entity_id is not null")


def found_entities(facts: DataFrame, entities: DataFrame, scratch) -> DataFrame:
    """(fact_id, entity_id) of facts without an entity whose subject or mention
    names exactly one; where both name one and they differ there is no row.

    Null and blank names name nothing; rows delivered twice give one row.
    """
    names = scratch.write(_spread(spellings(facts), "name").select("name", _form("name").alias("form")))
    forms = scratch.write(_spread(names.select("form").distinct(), "form"))
    scored = scratch.write(form_fits(forms, entities, scratch))
    links = scratch.write(form_links(scored))
    named = clustered(links, scratch.write(form_variants(forms, scored, links)), scratch)
    named = scratch.write(names.join(named, "form").select("name", "entity_id"))
    f = facts.where("entity_id is null and id is not null").select(F.col("id").alias("fact_id"), F.explode(F.array_distinct(F.array("subject", "subject_mention"))).alias("name")).where("name is not null")
    hit = f.join(named, "name").groupBy("fact_id").agg(F.min("entity_id").alias("entity_id"), F.max("entity_id").alias("z"))
    return hit.where("entity_id = z").select("fact_id", "entity_id")
