"""Tables on shared storage: creating, replacing, upserting, pruning (S-7 to S-14)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factweave import schemas
from factweave.functions.vectors import DIMENSIONS, canonical_text, hash_embedding
from factweave.operators.facts import latest


def create(spark: SparkSession, root: str) -> list[str]:
    """Empty tables for every schema that has none yet; what exists stays (S-14)."""
    made = []
    for name, schema in schemas.TABLES.items():
        path = f"{root}/{name}.parquet"
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
            spark.createDataFrame([], schema).write.parquet(path)
            made.append(name)
    return made


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``old`` replaced by those of ``new`` with the same keys (S-9); of several
    new rows of a key the one that compares highest stays."""
    both = old.withColumn("__v", F.lit(0)).unionByName(new.withColumn("__v", F.lit(1)))
    rest = [c for c in old.columns if c not in keys]
    return latest(both, keys, F.col("__v"), *(F.col(c).cast("string") for c in rest)).drop("__v")


def replace_documents(old: DataFrame, new: DataFrame, key: str = "document_id") -> DataFrame:
    """``old`` without the documents of ``new``, plus ``new`` (S-8)."""
    return old.join(new.select(key).distinct(), key, "left_anti").select(*old.columns).unionByName(new.select(*old.columns))


def prune(child: DataFrame, parent: DataFrame, fk: str, pk: str = "id") -> DataFrame:
    """Rows whose parent still exists (the cascade of a delete)."""
    return child.join(parent.select(F.col(pk).alias(fk)).distinct(), fk, "left_semi")


def orphan_to_null(child: DataFrame, parent: DataFrame, fk: str, pk: str = "id") -> DataFrame:
    """Rows with a null where their parent is gone (SET NULL)."""
    p = parent.select(F.col(pk).alias(fk), F.lit(True).alias("__has")).distinct()
    return child.join(p, fk, "left").withColumn(fk, F.when(F.col("__has"), F.col(fk))).drop("__has").select(*child.columns)


def update(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows with the values that ``new`` supplies; null leaves a value as it is (S-11)."""
    n = new.select(key, *(F.col(c).alias(f"__{c}") for c in new.columns if c != key))
    cols = [F.coalesce(f"__{c}", c).alias(c) if c in new.columns and c != key else F.col(c) for c in old.columns]
    return old.join(n, key, "left").select(*cols)


def known(df: DataFrame, facts: DataFrame, a: str = "fact_a_id", b: str = "fact_b_id") -> DataFrame:
    """Pairs whose ends both are facts (S-10)."""
    return prune(prune(df, facts, a), facts, b)


def first_by_hash(documents: DataFrame, text: str, key: str) -> DataFrame:
    """(key, hash, first, is_duplicate): the first document with each content (S-2).

    The content itself doesn't travel: only digests do. Null content has a null hash
    and is never a duplicate.
    """
    h = documents.select(key, F.sha2(text, 256).alias("hash"))
    first = h.where("hash is not null").groupBy("hash").agg(F.min(key).alias("first"))
    return h.join(first, "hash", "left").select(key, "hash", F.coalesce("first", key).alias("first"), F.coalesce(F.col("first") < F.col(key), F.lit(False)).alias("is_duplicate"))


def new_documents(incoming: DataFrame, existing: DataFrame, text: str, key: str) -> DataFrame:
    """The first incoming document of each content that ``existing`` doesn't hold (S-2, S-12)."""
    first = first_by_hash(incoming, text, key).where("not is_duplicate").select(key, "hash")
    return first.join(existing.select(F.sha2(text, 256).alias("hash")).distinct(), "hash", "left_anti").select(key, "hash")


def with_cache(requests: DataFrame, cache: DataFrame, key: str, answer: str) -> tuple[DataFrame, DataFrame]:
    """Requests answered by the cache, and the misses, each distinct key once (S-13)."""
    hits = requests.join(cache.select(key, answer), key)
    misses = requests.join(cache.select(key), key, "left_anti").dropDuplicates([key])
    return hits, misses


#: Folders into which a stored table is dealt by its document.
PARTS = 64


def store_documents(root: str, name: str, rows: DataFrame, documents: DataFrame, key: str = "document_id", parts: int = PARTS) -> None:
    """Write ``rows`` of a table in place of all rows of ``documents`` (S-7, S-8).

    The table lies in ``parts`` folders by a hash of the document; only folders that hold
    one of the documents are written anew, by a dynamic overwrite after their present rows
    are read and kept apart in a written copy, so that a failed write can be repeated.
    """
    from factweave.session import Scratch

    spark, path = rows.sparkSession, f"{root}/{name}"
    part = F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")
    ids = documents.select(key).where(F.col(key).isNotNull()).distinct()
    out = rows.withColumn("part", part)
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    scratch, touched = Scratch(spark, "store"), []
    if fs.exists(p):
        touched = sorted(r.part for r in ids.select(part.alias("part")).distinct().collect())  # at most `parts`
        old = spark.read.parquet(path).where(F.col("part").isin(touched)).join(ids, key, "left_anti")
        out = out.unionByName(old.select(*out.columns))
    out = scratch.write(out)
    out.repartition("part").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(path)
    for n in {*touched} - {r.part for r in out.select("part").distinct().collect()}:  # folders that have no row any more
        fs.delete(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/part={n}"), True)
    scratch.clear()


def embed_facts(facts: DataFrame, entities: DataFrame, have: DataFrame | None = None, model: str = "hash-embedding-v1") -> DataFrame:
    """(fact_id, model, dimensions, vector, content_hash, reused): a vector for each fact (E-5).

    A vector of ``have`` is taken where it is the fact's, of the model and of the same text;
    only the others are computed. The result is ``have`` after the upsert, for these facts.
    """
    names = entities.select(F.col("id").alias("entity_id"), F.col("canonical_name").alias("name"))
    f = facts.join(names, "entity_id", "left").select(F.col("id").alias("fact_id"), canonical_text(name=F.col("name")).alias("text")).withColumn("content_hash", F.sha2("text", 256))
    if have is None:
        f = f.withColumn("known", F.lit(None).cast("array<float>"))
    else:
        h = have.where((F.col("model") == model) & (F.size("vector") > 0)).select("fact_id", "content_hash", F.col("vector").alias("known"))
        f = f.join(h, ["fact_id", "content_hash"], "left")
    new = F.when(F.col("known").isNull(), hash_embedding(F.when(F.col("known").isNull(), F.col("text"))))
    return f.select("fact_id", F.lit(model).alias("model"), F.lit(DIMENSIONS).alias("dimensions"), F.coalesce("known", new).alias("vector"), "content_hash", F.col("known").isNotNull().alias("reused"))


def fetch_vectors(vectors: DataFrame, ids: DataFrame, model: str = "hash-embedding-v1") -> DataFrame:
    """The vectors of a set of facts (E-6)."""
    return vectors.where(F.col("model") == model).join(ids.select(F.col("id").alias("fact_id")).distinct(), "fact_id", "left_semi")
