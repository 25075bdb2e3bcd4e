"""What the operators share: reading text batches, shared storage, hashing.

Everything that is kept between jobs lies in the folder that the session's
``spark.checkpoint.dir`` names, which all executors can reach.
"""

from __future__ import annotations

import contextlib
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

#: Bytes of text that one call of an operator's function gets at most, unless one text is longer.
CHUNK_BYTES = 4 << 20
#: Bytes of an Arrow batch of texts.
BATCH_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The shared folder that the session names.

    Only a local session, whose tasks run in the driver, gets a temporary one if it names none.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[[^-]*\])?$", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="eventide-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def written(df: DataFrame, label: str, **options: str) -> DataFrame:
    """Writes ``df`` as Parquet in the shared folder and reads it back, which cuts its lineage."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/eventide/{label}-{uuid.uuid4().hex}"
    with shuffles_removed(spark):
        df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, by: str, label: str) -> DataFrame:
    """As ``written``, in a bucket for each shuffle partition, so that joins on ``by`` don't move the table again."""
    spark = df.sparkSession
    name = f"{label}_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/eventide/{name}"
    with shuffles_removed(spark):
        df.write.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), by).option("path", path).saveAsTable(name, format="parquet")
    found = spark.table(name)
    #: The frame knows its files and buckets; only the name goes, the files of a table with a path stay.
    spark.sql(f"DROP TABLE {name}")
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


def dropped(df: DataFrame) -> None:
    """Removes the files of a table that ``written`` made and that nothing reads any more."""
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        removed(df.sparkSession, folder)


def removed(spark: SparkSession, folder: str) -> None:
    """Removes a folder in any store that Spark reaches."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


class Scratch:
    """Tables of one operator's run that nothing reads any more once its result is stored."""

    def __init__(self):
        self.tables: list[DataFrame] = []

    def written(self, df: DataFrame, label: str) -> DataFrame:
        self.tables.append(written(df, label))
        return self.tables[-1]

    def drop(self, *tables: DataFrame) -> None:
        """Removes these tables, or all."""
        for df in tables or self.tables:
            dropped(df)
        self.tables = [t for t in self.tables if tables and not any(t is x for x in tables)]


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, after its session has been told to send at most BATCH_BYTES to Python at once.

    Spark has no such setting for one query alone; it changes no result, and a lower one is kept.
    """
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if conf.get(name) != str(BATCH_BYTES) and int(re.match(r"\d+", conf.get(name))[0]) > BATCH_BYTES:
        conf.set(name, str(BATCH_BYTES))
    return df


def fresh(name: str, *frames: DataFrame) -> str:
    """A column name that none of the frames has, in any case of letters, and that does not begin one."""
    taken = [c.lower() for df in frames for c in df.columns]
    while any(c.startswith(name) for c in taken):
        name = "_" + name
    return name


def byte_texts(column: pa.Array) -> list[bytes]:
    """A string column's UTF-8 bytes, null as empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


def map_texts(
    df: DataFrame,
    function: Callable[..., dict],
    schema: pa.Schema,
    keys: list[str] = ["doc_id"],
    text: str = "text",
    setup: Callable[[], object] | None = None,
) -> DataFrame:
    """Maps chunks of rows: ``function(state, keys as lists..., texts as bytes) -> columns``.

    ``setup`` runs once in each task and makes ``state``.  Only the named columns are read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = setup() if setup else None
        for batch in batches:
            texts = byte_texts(batch.column(len(keys)))
            held = [batch.column(i).to_pylist() for i in range(len(keys))]
            at = 0
            while at < len(texts):
                to, size = at, 0
                while to < len(texts) and (to == at or size + len(texts[to]) <= CHUNK_BYTES):
                    size += len(texts[to])
                    to += 1
                out = function(state, *(h[at:to] for h in held), texts[at:to])
                yield pa.RecordBatch.from_arrays(
                    [x if isinstance(x, pa.Array) else pa.array(x, f.type) for f, x in ((f, out[f.name]) for f in schema)], schema=schema
                )
                at = to

    return small_batches(df).select(*keys, text).mapInArrow(run, from_arrow_schema(schema))


def keep_rows(df: DataFrame, keep: Callable[[list[bytes]], list[bool]], text: str = "text") -> DataFrame:
    """The rows of ``df``, all columns, whose texts ``keep`` accepts; no row moves."""
    place = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, kept, at = byte_texts(batch.column(place)), [], 0
            while at < len(texts):
                to, size = at, 0
                while to < len(texts) and (to == at or size + len(texts[to]) <= CHUNK_BYTES):
                    size += len(texts[to])
                    to += 1
                kept += [bool(x) for x in keep(texts[at:to])]
                at = to
            yield batch.filter(pa.array(kept, pa.bool_()))

    return small_batches(df).mapInArrow(run, df.schema)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of unsigned 64-bit numbers that scatters all bits (the finaliser of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def held_out(modulus: int, remainder: int):
    """Whether crc32 of the decimal doc_id has this remainder; null ids are held out nowhere."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % modulus == remainder, F.lit(False))
