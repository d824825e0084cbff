"""Session helpers: a local session for tests, shared-folder checkpoints and staged tables."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_KEY = "spark.checkpoint.dir"


def local_session(cores: str = "8", shuffle_partitions: int = 8) -> SparkSession:
    """Session for tests and the bench; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("gleanmark")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """Folder that all executors share.

    The cluster names it in ``spark.checkpoint.dir``. Only where that is unset and Spark runs on one machine, as in tests, a
    temporary folder is made, set as the checkpoint folder and removed at the end; a cluster without one is an error, since
    its executors share no folder of their own.
    """
    named = spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getConf().get(CHECKPOINT_KEY, None)
    if named:
        return named.rstrip("/")
    made = spark.sparkContext._jsc.sc().getCheckpointDir()
    if made.isDefined():
        return made.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {CHECKPOINT_KEY} to a folder that all executors share")
    place = tempfile.mkdtemp(prefix="gleanmark-")
    atexit.register(shutil.rmtree, place, ignore_errors=True)
    spark.sparkContext.setCheckpointDir("file://" + place)
    return "file://" + place


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: later jobs start from files that survive a lost executor."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/staged-{name}-{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path)
    _STAGED.append(path)
    return spark.read.schema(df.schema).parquet(path)


#: Tables that this process has staged.
_STAGED: list[str] = []


def drop_staged(spark: SparkSession) -> int:
    """Deletes the tables staged so far by this process, and says how many; results that weren't written yet need them."""
    files, done = spark.sparkContext._jvm.org.apache.hadoop.fs, 0
    while _STAGED:
        path = files.Path(_STAGED.pop())
        done += bool(path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True))
    return done


def bounded_sample(df: DataFrame, key: str, rows: int) -> list:
    """At most ``rows`` rows, those that come first by the hash of ``key``: the same for the same data in any layout.

    A filter on the hash, set by the number of rows, keeps what each task sends for the final order near ``rows`` in all.
    """
    total = df.count()
    if total > 2 * rows:
        df = df.where(F.pmod(F.xxhash64(key), F.lit(total)) < 2 * rows)
    return df.orderBy(F.xxhash64(key)).limit(rows).collect()
