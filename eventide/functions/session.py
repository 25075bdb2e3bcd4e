"""Where a session keeps what is shared between jobs."""

from __future__ import annotations

import contextlib
import re
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import types as T


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names in ``spark.checkpoint.dir``; a local session without one gets a temporary one, others raise."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[[^-]*\])?$", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="eventide-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


@contextlib.contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Tables written meanwhile leave no shuffle files behind: what they are made of is not read again once they are stored."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


#: Types that Parquet keeps as they are.
_STORABLE = (T.StringType, T.BinaryType, T.BooleanType, T.IntegralType, T.FractionalType, T.DateType, T.TimestampType, T.TimestampNTZType)


def _storable(kind: T.DataType) -> bool:
    """Whether Parquet can keep values of a type: no voids, intervals or structs that are empty or have a name twice."""
    if isinstance(kind, T.StructType):
        return 0 < len(kind.names) == len({n.lower() for n in kind.names}) and all(_storable(f.dataType) for f in kind)
    if isinstance(kind, T.MapType):
        return _storable(kind.keyType) and _storable(kind.valueType)
    return _storable(kind.elementType) if isinstance(kind, T.ArrayType) else isinstance(kind, _STORABLE)


def settled(df: DataFrame) -> DataFrame:
    """``df``, computed once and kept in the shared folder, which cuts its lineage.

    It is kept as packed Parquet, of which later steps read the columns that they need; what Parquet can't keep becomes a checkpoint,
    which Spark doesn't pack.
    """
    spark = df.sparkSession
    folder = shared_folder(spark)
    if _storable(df.schema):
        path = f"{folder}/settled-{uuid.uuid4().hex}"
        with shuffles_removed(spark):
            df.write.option("compression", "zstd").parquet(path)
        return spark.read.schema(df.schema).parquet(path)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint()


def released(df: DataFrame) -> None:
    """Removes what ``settled`` kept as Parquet, when nothing reads it any more."""
    spark = df.sparkSession
    for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
        if path.rpartition("/")[2].startswith("settled-"):
            target = spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def observed(df: DataFrame, **counters: Column) -> tuple[DataFrame, dict[str, int]]:
    """``df`` kept, and the counters over its rows from the same pass.

    The counters are the last thing before the rows are kept, so that a task that runs again is not counted again.
    """
    seen = Observation()
    kept = settled(df.observe(seen, *(c.alias(n) for n, c in counters.items())))
    return kept, {n: seen.get.get(n) or 0 for n in counters}
