"""Session helpers: settings for tests and benches, and the shared folder for cut lineage."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


def local_session(cores: int | str = 8, name: str = "tallyforge", memory: str = "8g", partitions: int = 8) -> SparkSession:
    """A local session for tests and benches; a cluster brings its own session."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as ``spark.checkpoint.dir`` names it.

    Only where a local session leaves the setting unset is a temporary folder made; on a
    cluster a missing setting is an error, because no machine-local folder would do.
    """
    folder = spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getConf().get(CHECKPOINT_KEY)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError(f"{CHECKPOINT_KEY} must name a folder that all executors share")
    folder = "file://" + tempfile.mkdtemp(prefix="tallyforge-")
    spark.conf.set(CHECKPOINT_KEY, folder)
    return folder


def place(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder; what is written there goes when :func:`sweep` is called, or when the driver ends."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(folder)
    _PLACES.append(path)
    return path


#: Paths given out by :func:`place` in this process.
_PLACES: list[str] = []


def cut(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once as a table in the shared folder and read it back.

    The stages after it depend on files that outlive any executor, not on cached blocks.
    """
    path = place(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sweep(spark: SparkSession) -> int:
    """Delete what this process wrote to the shared folder so far, and say how many tables that was.

    For the end of a run, when the frames built on them are no longer needed.
    """
    for path in (done := _PLACES[:]):
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    del _PLACES[: len(done)]
    return len(done)


def data_dir(default: str = "/root/testdata/sf0.1") -> str:
    return os.environ.get("BENCH_SF_DIR", default)


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once a session, so that their Python workers can import it."""
    sc = spark.sparkContext
    if getattr(sc, "_tallyforge_shipped", False):
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="tallyforge-")) / "tallyforge.zip"
    with zipfile.ZipFile(target, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    sc.addPyFile(str(target))
    sc._tallyforge_shipped = True


def spread(df: DataFrame) -> DataFrame:
    """Rows over all cores where a table has fewer partitions than that; larger tables pass untouched.

    For work that costs far more than moving its input: a small file is one partition, whatever its rows cost.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
