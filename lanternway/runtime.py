"""Session helpers: shared scratch tables, hot keys and joins that survive them."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: At most so many keys are treated as hot; more cannot each hold 1/64 of the rows.
MAX_HOT = 64
SALTS = 32


def local_session(name: str = "lanternway", cores: str = "*", partitions: int = 8) -> SparkSession:
    """A session for one machine, as tests and the benchmark use it."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder; partition and bucket pruning are left to the scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir where the cluster names one, else the context's own.

    One is made here only where driver and executors are one machine; on a cluster a missing setting is an error,
    as what executors wrote to their own disks could not be read again.
    """
    set_by_cluster = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if set_by_cluster:
        return set_by_cluster.rstrip("/")
    made = sc.getCheckpointDir()
    if made is None:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="lanternway-"))
        made = sc.getCheckpointDir()
    return made.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session may be gone; the folder then goes with it
        pass


class Scratch:
    """Written intermediate tables in the shared folder.

    Writing cuts the lineage and survives the loss of an executor, and the footers give later plans true sizes.
    ``drop`` deletes a table no longer read; a table goes at the latest when the driver exits. A result may still
    read from tables after the operator has returned, so they cannot go before that.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        self.n = 0
        atexit.register(_delete, spark, self.root)

    def keep(self, df: DataFrame) -> DataFrame:
        path = f"{self.root}/t{self.n}"
        self.n += 1
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, df: DataFrame | None) -> None:
        if path := getattr(df, "_scratch_path", None):
            _delete(self.spark, path)


def hot_keys(df: DataFrame, key: str, share: float = 1 / MAX_HOT) -> list:
    """Keys that hold more than ``share`` of the rows; at most MAX_HOT, found by one pass with a bounded
    frequent-items sketch and no shuffle. They only steer salting, never which rows are kept."""
    row = df.where(F.col(key).isNotNull()).agg(
        F.expr(f"approx_top_k({key}, {MAX_HOT}, {MAX_HOT * 64})").alias("top"), F.count(F.lit(1)).alias("n")
    ).first()
    if not row or not row["n"]:
        return []
    return [x["item"] for x in row["top"] if x["count"] > max(1000, share * row["n"])]


def salt_of(key: Column, hot: list, spread: Column, salts: int = SALTS) -> Column:
    """Salt of a many-side row: spread over the salts if its key is hot, else 0."""
    if not hot:
        return F.lit(0)
    return F.when(key.isin(hot), F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int")).otherwise(0)


def salts_of(key: Column, hot: list, salts: int = SALTS) -> Column:
    """Salts at which a one-side row must stand: all of them if its key is hot."""
    if not hot:
        return F.array(F.lit(0))
    return F.when(key.isin(hot), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))


#: Below so many rows even a single key fits one task, and looking for hot ones costs more than it saves.
CROWD_ROWS = 200_000


def salted_join(many: DataFrame, one: DataFrame, key: str, spread: Column, how: str = "inner", rows: int | None = None, hot: list | None = None) -> DataFrame:
    """Equi-join of ``many`` with ``one`` (at most one row a key) on ``key``, hot keys spread over salts.

    rows: how many rows ``many`` has, where that is known. hot: its hot keys, where they are known.
    """
    if hot is None:
        hot = hot_keys(many, key) if rows is None or rows > CROWD_ROWS else []
    if not hot:
        return many.join(one, key, how)
    left = many.withColumn("_salt", salt_of(F.col(key), hot, spread))
    right = one.withColumn("_salt", F.explode(salts_of(F.col(key), hot)))
    return left.join(right, [key, "_salt"], how).drop("_salt")
