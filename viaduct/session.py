"""Session helpers: worker import path, shared folder, tables written to cut lineage, joins on keys that may be hot."""

from __future__ import annotations

import os
import tempfile
import threading
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

ROOT = str(Path(__file__).resolve().parent.parent)
#: Keys that hold more than one in this many of all rows are hot; there can be no more of them than this.
HOT_KEYS = 10_000
#: Spark's bound of the bytes of an Arrow batch.
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
_OWN: dict[str, str] = {}
_MADE: dict[tuple[str, int], list[str]] = {}


def ready(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package when it is not installed (local runs), and bound the batches they get.

    A session that sets the size of Arrow batches itself keeps its own.
    """
    if spark.conf.get(BATCH_BYTES, None) is None:
        spark.conf.set(BATCH_BYTES, "4m")
    env = spark.sparkContext.environment
    paths = [p for p in (env.get("PYTHONPATH") or os.environ.get("PYTHONPATH", "")).split(os.pathsep) if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *paths])
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where it is unset, a temporary folder of this machine is used in local mode only; a cluster has to name one.
    """
    path = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not path:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        path = _OWN.get(app)
        if path is None:
            path = _OWN[app] = Path(tempfile.mkdtemp(prefix="spark-", dir="/tmp")).as_uri()
            spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    path = f"{shared_dir(spark)}/viaduct/{name}-{uuid.uuid4().hex}"
    _made(spark).append(path)
    return path


def _made(spark: SparkSession) -> list[str]:
    """The paths handed out to this thread."""
    return _MADE.setdefault((spark.sparkContext.applicationId, threading.get_ident()), [])


def stored(df: DataFrame, name: str = "table", path: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it again: its lineage ends there."""
    spark = df.sparkSession
    path = path or scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def observed(df: DataFrame, name: str = "table", **metrics) -> tuple[DataFrame, dict]:
    """``stored``, and aggregates of its rows that are taken while it is written; without any, ``n``, their number."""
    seen = Observation()
    columns = [c.alias(k) for k, c in (metrics or {"n": F.count(F.lit(1))}).items()]
    own = stored(df.observe(seen, *columns), name)
    return own, seen.get


def made(spark: SparkSession) -> int:
    """How many paths this thread was handed out so far: a mark for ``clear``."""
    return len(_made(spark))


def clear(spark: SparkSession, since: int = 0, spare: tuple[str, ...] = ()) -> None:
    """Delete what was written below the paths handed out to this thread after the mark ``since``, but for ``spare``.

    For callers that have written their results: tables that were read from those paths are gone afterwards.
    """
    own = _made(spark)
    for path in own[since:]:
        if path not in spare:
            remove(spark, path)
    own[since:] = [p for p in own[since:] if p in spare]


def remove(spark: SparkSession, path: str) -> None:
    """Delete one path, if it exists, on whatever file system it lies."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def has_files(spark: SparkSession, path: str) -> bool:
    """Whether a path exists, on whatever file system it lies."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def drop_stored(*tables: DataFrame) -> None:
    """Delete tables made by ``stored`` that nothing will read again, such as those of an earlier round of a loop."""
    for table in tables:
        for path in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
            remove(table.sparkSession, path)


def join_counted(left: DataFrame, right: DataFrame, on: str, rows: str, how: str = "left") -> DataFrame:
    """``left`` joined to ``right``, which has each key once and, as ``rows``, how many rows of ``left`` have it.

    Hot keys are broadcast, so that no task gets all rows of one; ``HOT_KEYS`` bounds how many there can be. ``how`` says
    whether keys that ``right`` lacks are kept with nulls. ``right`` is stored here; ``left`` is read twice.
    """
    right, seen = observed(right, "counted", total=F.coalesce(F.sum(rows), F.lit(0)))
    hot = F.col(rows) > max(1000, seen["total"] // HOT_KEYS)
    few = F.broadcast(right.filter(hot))
    plain = left.join(few.select(on), on, "left_anti").join(right.filter(~hot), on, how)
    return left.join(few, on).select(plain.columns).unionByName(plain)
