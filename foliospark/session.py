"""The session that the engine expects."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key is hot if it holds more than one in so many rows; there are less such keys than that.
HOT_KEYS = 1000


def build_session(app: str = "foliospark", master: str | None = None, **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution and Arrow; conf overrides (dots as double underscores)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    return builder.config(map=settings).getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one where that is unset and the master is local (tests). A cluster without the setting is an error, as its executors couldn't read a temporary folder of the driver."""
    path = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.foliospark.shared", None)
    if not path:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = f"file://{tempfile.mkdtemp(prefix='foliospark-')}"
        spark.conf.set("spark.foliospark.shared", path)
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


_SCRATCH = "spark.foliospark.scratch"


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/foliospark/{spark.conf.get(_SCRATCH, '')}{name}-{uuid.uuid4().hex}"


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that are stored within go to a folder of their own, which is removed at the end. So a result that reads them has to be written within, to a path made outside."""
    before, own = spark.conf.get(_SCRATCH, ""), f"scratch-{uuid.uuid4().hex}/"
    spark.conf.set(_SCRATCH, own)
    try:
        yield
    finally:
        spark.conf.set(_SCRATCH, before)
        remove(spark, f"{shared_dir(spark)}/foliospark/{own}")


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a file or folder that a run has no more use for; nothing if it isn't there."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: lineage ends here and lost executors don't matter."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def join_counted(rows: DataFrame, keys: DataFrame, on: str | list[str], count: str) -> DataFrame:
    """rows joined with the stored table keys, which has one row for each value of `on` and its number of rows in `count`. Keys that hold more than one in HOT_KEYS of the counted rows, so less than HOT_KEYS keys, are broadcast; only the others are shuffled, by sort-merge at every size, so no key fills a task. A null never matches."""
    total = keys.agg(F.sum(count)).first()[0] or 0
    is_hot = F.col(count) * HOT_KEYS > total
    hot = keys.filter(is_hot)
    far = rows.join(F.broadcast(hot.select(on)), on, "left_anti").join(keys.filter(~is_hot).hint("merge"), on)
    return rows.join(F.broadcast(hot), on).unionByName(far)


def spread(df: DataFrame) -> DataFrame:
    """df over as many partitions as there are cores, if its plan reads fewer bytes than one input split: for small files ahead of costly functions. Large inputs are left as they are."""
    spark = df.sparkSession
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(spark.sparkContext.defaultParallelism) if size < 128 << 20 else df
