"""Session factory and the shared scratch space of iterative operators."""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def get_spark(app: str = "weftline", master: str | None = None, **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; cluster settings already present win."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    }
    for k, v in {**defaults, **conf}.items():
        b = b.config(k, v)
    return b.getOrCreate()


def scratch_root(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; on a local master that names none, a temporary one, deleted at exit.

    On a cluster the folder must be named: executors could not read one another's temporary folders.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        path = tempfile.mkdtemp(prefix="weftline-")
        atexit.register(shutil.rmtree, path, ignore_errors=True)
        root = "file://" + path
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


_BASES: list[str] = []


def release(spark: SparkSession) -> int:
    """Deletes all scratch tables of this process, once no frame that reads them is used any more; returns how many folders went."""
    n = len(_BASES)
    while _BASES:
        _delete(spark, _BASES.pop())
    return n


def _delete(spark: SparkSession, path: str) -> None:
    own = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    own.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(own, True)


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors' Python workers, once for each application."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    home = Path(__file__).resolve().parent
    path = Path(tempfile.mkdtemp(prefix="weftline-")) / "weftline.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(home.rglob("*.py")):
            z.write(f, f"{home.name}/{f.relative_to(home)}")
    context.addPyFile(str(path))
    _SHIPPED.add(context.applicationId)


class Scratch:
    """Parquet tables in the shared scratch folder: they cut lineage and outlive lost executors.

    ``save`` writes and rereads a frame, ``drop`` deletes tables that no later plan reads, and ``release`` all
    that are left, when the results that read them have been taken.
    """

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.base = f"{scratch_root(spark)}/weftline-{uuid.uuid4().hex}"
        self.n = 0
        _BASES.append(self.base)

    def save(self, df: DataFrame, dictionary: bool = True) -> DataFrame:
        """Without a dictionary, hashes and digests, which never repeat, are written faster."""
        self.n += 1
        path = f"{self.base}/{self.n}"
        df.write.option("compression", "zstd").option("parquet.enable.dictionary", str(dictionary).lower()).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._weftline_path = path
        return out

    def save_bucketed(self, df: DataFrame, column: str, n: int) -> DataFrame:
        """The same, bucketed: joins and groups on ``column`` need no exchange of the table. It is in no catalogue afterwards."""
        self.n += 1
        path, name = f"{self.base}/{self.n}", f"weftline_{uuid.uuid4().hex}"
        options = {"path": path, "compression": "zstd", "parquet.enable.dictionary": "false"}
        df.write.bucketBy(n, column).options(**options).format("parquet").saveAsTable(name)
        out = self.spark.table(name)
        self.spark.sql(f"DROP TABLE {name}")
        out._weftline_path = path
        return out

    def tidy(self) -> None:
        """Lets Spark delete the shuffle files of finished plans now, not at its next collection."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()

    def drop(self, *frames: DataFrame) -> None:
        for df in frames:
            _delete(self.spark, df._weftline_path)
