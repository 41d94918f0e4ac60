"""Helpers shared by the operators: table access, shared-folder tables, Arrow batch size."""

from __future__ import annotations

import contextlib
import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"
#: Intermediate tables written for an owner (owned()): path -> (owner, session).
_written: dict[str, tuple[str, SparkSession]] = {}
_owner: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's Parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or in local mode, where it is unset, a temporary one."""
    path = spark.conf.get(CHECKPOINT_CONF, None)
    if not path:
        path = spark.sparkContext.getCheckpointDir()
    if not path:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="maxfold-")
        spark.sparkContext.setCheckpointDir(path)
        path = spark.sparkContext.getCheckpointDir()
    return path


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that is not in use; it belongs to the owner, if there is one."""
    path = f"{shared_dir(spark)}/maxfold-{name}-{uuid.uuid4().hex}"
    if _owner:
        _written[path] = (_owner[-1], spark)
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage ends there, lost executors lose nothing."""
    path, schema = fresh_path(df.sparkSession, name), df.schema
    df.write.parquet(path)
    out = df.sparkSession.read.schema(schema).parquet(path)
    out.written_to = path
    return out


def small_arrow_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Bound the rows of an Arrow batch, so that a Python worker holds a few MB of texts at a time.

    A setting of the session, read when a plan runs, so it cannot be put back here; it only ever gets smaller.
    """
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def written_table(df: DataFrame, name: str, bucket_by: str) -> DataFrame:
    """``df`` as a bucketed Parquet table in the shared folder: joins by ``bucket_by`` do not shuffle it.

    The catalog knows it only while it is written; its files stay.
    """
    spark = df.sparkSession
    name = f"maxfold_{name}_{uuid.uuid4().hex}"
    path = fresh_path(spark, name)
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.bucketBy(buckets, bucket_by).option("path", path).option("compression", "zstd").saveAsTable(name)
    out = spark.table(name)
    out.written_to = path
    spark.sql(f"DROP TABLE {name}")
    return out


@contextlib.contextmanager
def owned() -> Iterator[str]:
    """Intermediate tables written within belong to the owner that is given, who may release() them.

    What an inner owner leaves goes to the outer one.
    """
    owner = uuid.uuid4().hex
    _owner.append(owner)
    try:
        yield owner
    finally:
        _owner.remove(owner)
        for path, (whose, spark) in list(_written.items()):
            if whose == owner and _owner:
                _written[path] = (_owner[-1], spark)


def release(owner: str, keep: Iterable[DataFrame] = ()) -> None:
    """Delete the owner's intermediate tables, but for those that materialize() returned as ``keep``."""
    kept = {getattr(df, "written_to", None) for df in keep}
    for path, (whose, spark) in list(_written.items()):
        if whose == owner and path not in kept:
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
            del _written[path]


def unused(columns: Iterable[str], name: str) -> str:
    """``name``, with as many underscores in front as make it differ from all columns."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name
