"""Session defaults, table access and lineage cuts shared by all operators."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_CONF = "spark.checkpoint.dir"
SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def build(app: str = "timberline", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution, UTC and Arrow batches on."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    }
    for k, v in {**base, **conf}.items():
        b = b.config(k, v)
    return b.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the cluster names it. In local mode, where driver and executors are one process,
    an unset folder is made on this machine; on a cluster that is an error."""
    have = spark.conf.get(CHECKPOINT_CONF, None)
    if not have:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder that all executors share")
        have = "file://" + tempfile.mkdtemp(prefix="timberline-")
        spark.conf.set(CHECKPOINT_CONF, have)
    return have.rstrip("/")


def _drop(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the JVM may be gone already
        pass


_scopes: list[list[str]] = []


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Tables that `cut` writes inside are removed at its end: for sessions that run many queries. What reads them must
    have been written or collected by then."""
    _scopes.append([])
    try:
        yield
    finally:
        for path in _scopes.pop():
            _drop(spark, path)


def cut(df: DataFrame, label: str = "cut") -> DataFrame:
    """Write df as a compressed table into the shared folder and read it back.

    Cuts lineage and survives lost executors; columnar and prunable, unlike an RDD checkpoint. Removed when the
    driver ends. What was shuffled to make it is removed as soon as it is written."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    before = spark.conf.get(SHUFFLES_GO, None)
    spark.conf.set(SHUFFLES_GO, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(SHUFFLES_GO) if before is None else spark.conf.set(SHUFFLES_GO, before)
    atexit.register(_drop, spark, path)
    for kept in _scopes:
        kept.append(path)
    return spark.read.schema(df.schema).parquet(path)


#: So many repeated keys at most are sent to all tasks; beyond, the rows are shuffled.
REPEATED = 500_000


def once(df: DataFrame, key: str) -> DataFrame:
    """One row per key, where rows of a key are equal in all columns. Only the keys are shuffled, and the rows of those that
    occur again, which are few where deliveries repeat; with more than REPEATED of them all rows are. Null is a key."""
    again = cut(df.groupBy(key).agg(F.count("*").alias("n")).where("n > 1").select(F.col(key).alias("__k")), "repeated")
    n = again.count()
    if n == 0:
        return df
    if n > REPEATED:
        return df.dropDuplicates([key])
    same = F.col(key).eqNullSafe(F.col("__k"))
    single = df.join(F.broadcast(again), same, "left_anti")
    return single.unionAll(df.join(F.broadcast(again), same, "left_semi").dropDuplicates([key]))
