"""Session set-up and the small amount of physical plumbing operators share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast by hint only after its measured size was found below this.
BROADCAST_BYTES = 32 << 20


def build(app: str = "factweave", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators expect (UTC, AQE, Arrow)."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.enabled": "false",
    }
    for k, v in (base | conf).items():
        b = b.config(k, v)
    return b.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share.

    It is read from ``spark.checkpoint.dir``; only where that is unset (tests on
    one machine) a temporary folder takes its place.
    """
    sc = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not at:
        if not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="factweave-")
        sc.setCheckpointDir(at)
    return at.rstrip("/")


def once(df: DataFrame, name: str, value) -> DataFrame:
    """``df`` with the column ``name``, computed once a row.

    The optimizer inlines the fields of a struct wherever they are used; a generator
    over a single element, which costs nothing, keeps it from doing so. For expressions
    of moderate size: a generator's code isn't split into methods.
    """
    return df.withColumn(name, F.explode(F.array(value)))


class Scratch:
    """Tables written to the shared folder to cut lineage.

    A written table survives the loss of executors, is columnar and compressed
    (``DataFrame.checkpoint`` writes neither) and carries exact size statistics
    for the planner.  ``drop`` and ``clear`` remove tables; the rest goes when the
    driver ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.n = 0

    def write(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n}"
        df.write.option("compression", "zstd").parquet(path)
        if self.n == 1:
            self._fs().deleteOnExit(self._path(self.root))  # when the driver's JVM ends
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def bytes(self, df: DataFrame) -> int:
        """Bytes of the files of a written table."""
        return int(self._fs().getContentSummary(self._path(df._scratch_path)).getLength())

    def width(self, df: DataFrame) -> int:
        """Bytes of a written flat table's rows in memory, counted: its texts and 16 a column."""
        text = [F.octet_length(F.col(f"`{n}`")) for n, t in df.dtypes if t in ("string", "binary")]
        size = F.lit(16 * len(df.columns)).cast("long")
        for t in text:
            size = size + F.coalesce(t, F.lit(0))
        return int(df.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0])

    def drop(self, *dfs: DataFrame) -> None:
        """Delete tables that no later plan reads."""
        for df in dfs:
            self._fs().delete(self._path(df._scratch_path), True)

    def clear(self) -> None:
        """Delete all tables, once what was made of them is stored; else they go with the driver."""
        self._fs().delete(self._path(self.root), True)

    def hinted(self, df: DataFrame, of: DataFrame | None = None, bound: int = BROADCAST_BYTES) -> DataFrame:
        """``df`` with a broadcast hint if the rows of the flat written table ``of``
        (``df`` itself, or what it selects from) take ``bound`` bytes at most, which are
        counted; otherwise unhinted, so that a sort-merge join with AQE's skew handling
        takes over."""
        of = df if of is None else of
        flat = all("<" not in t for _, t in of.dtypes)
        return F.broadcast(df) if flat and self.bytes(of) <= bound and self.width(of) <= bound else df

    def _fs(self):
        return self._path(self.root).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, path: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
