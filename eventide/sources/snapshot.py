"""Catalogue snapshots that replace each other at once."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ..plans.schemas import TABLES
from .readers import read_catalogue
from .search_index import SearchIndex, write_index


def file_system(spark: SparkSession, path: str):
    """The file system of a path, and the path for it."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def remove_folder(spark: SparkSession, path: str) -> None:
    fs, target = file_system(spark, path)
    fs.delete(target, True)


def _pointers(spark: SparkSession, root: str) -> list[str]:
    fs, folder = file_system(spark, f"{root}/pointers")
    return sorted(f.getPath().getName() for f in fs.listStatus(folder)) if fs.exists(folder) else []


def newest_pointer(spark: SparkSession, root: str) -> str:
    """The folder below ``root`` that the newest pointer names."""
    last = _pointers(spark, root)
    if not last:
        raise FileNotFoundError(f"there is no snapshot in {root}")
    return last[-1].partition("-")[2]


def add_pointer(spark: SparkSession, root: str, name: str) -> None:
    """Makes the folder ``name`` the one that counts, by one rename."""
    last = _pointers(spark, root)
    number = int(last[-1].partition("-")[0]) + 1 if last else 1
    fs, pointer = file_system(spark, f"{root}/pointers/{number:012d}-{name}")
    fs.mkdirs(pointer.getParent())
    _, draft = file_system(spark, f"{root}/{name}/pointer")
    fs.create(draft, True).close()
    if not fs.rename(draft, pointer):
        raise OSError(f"{pointer} could not be written")


def write_snapshot(spark: SparkSession, state: dict[str, DataFrame], root: str, files: int | None = None, index: bool = False) -> str:
    """Writes all relations to a new folder below ``root``, then adds a pointer to it, which takes one rename.

    The newest pointer counts, so there is a snapshot at any time; a run that fails before the last step
    leaves the old one in place.  ``files`` compacts each relation to that many files; ``index`` adds the
    search index of the plans.
    """
    name = f"snapshot-{uuid.uuid4().hex}"
    for relation, frame in state.items():
        (frame.coalesce(files) if files else frame).write.parquet(f"{root}/{name}/{relation}")
    if index:
        write_index(spark.read.schema(TABLES["plans"]).parquet(f"{root}/{name}/plans"), f"{root}/{name}/search")
    add_pointer(spark, root, name)
    return f"{root}/{name}"


def read_snapshot(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """The relations of the newest snapshot."""
    return read_catalogue(spark, f"{root}/{newest_pointer(spark, root)}")


def read_index(spark: SparkSession, root: str) -> SearchIndex:
    """The search index of the newest snapshot, which must have been written with one."""
    return SearchIndex(spark, f"{root}/{newest_pointer(spark, root)}/search")
