"""The catalogue in buckets: a change rewrites the buckets that it touches, and nothing else.

Each relation is dealt into buckets by a hash of its key.  A manifest says where each bucket lies; a
new version writes new folders for touched buckets and a manifest that names them beside the old ones.  The
newest pointer counts, as with whole snapshots, so readers see one version or the other.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.session import settled, shuffles_removed
from ..operators import state
from ..plans.schemas import TABLES
from .snapshot import add_pointer, file_system, newest_pointer

#: The key by which a relation is dealt; relations without one are small and lie in one bucket.
KEYS = {"plans": "id", "texts": "id", "bodies": "key", "plan_sources": "source_record_id", "plan_categories": "plan_id", "images": "plan_source_id", "prints": "fingerprint"}
#: Long columns of plans, which lie apart by id, so that a batch without them doesn't move them; a plan that has none of them has no row.
TEXTS = ("original_title", "title_ca", "title_es", "original_description", "description_ca", "description_es")
#: Characters up to which a text stands in ``texts`` itself; there a longer one has the digest by which it stands in ``bodies``, once for all plans.
SHORT = 64
#: ``prints`` is derived: the fingerprints of plans, for a match that reads no plan.
SCHEMAS = TABLES | {"plans": ", ".join(f for f in TABLES["plans"].split(", ") if f.split()[0] not in TEXTS), "texts": "id long, " + ", ".join(f"{n} string, {n}_key binary" for n in TEXTS), "bodies": "key binary, body string", "prints": "fingerprint string, id long"}
#: Rows of a bucket lie by its key; texts lie by a hash, equal ones together, so that what repeats is stored once.
ORDER = KEYS | {"texts": "_text"}
MANIFEST = "relation string, bucket int, path string, top long"

State = dict[str, DataFrame]


def _digest(column: str) -> Column:
    return F.unhex(F.sha2(F.col(column).cast("binary"), 256))


def _bodies(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(key, body) of the long texts in these columns, each once: equal ones are dropped before they move."""
    long = rows.select(F.explode(F.array(*(F.col(c).cast("string") for c in columns))).alias("body")).where(F.char_length("body") > SHORT)
    return long.distinct().select(_digest("body").alias("key"), "body")


class BucketStore:
    """Versions of the catalogue below ``root``; ``buckets`` is fixed when it is created."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root
        rows = spark.read.schema(MANIFEST).parquet(f"{root}/{newest_pointer(spark, root)}/manifest").collect()
        self.paths: dict[str, dict[int, str]] = {name: {} for name in SCHEMAS}
        self.tops: dict[str, int] = {}
        for r in rows:
            if r["path"]:
                self.paths[r["relation"]][r["bucket"]] = r["path"]
            else:
                self.tops[r["relation"]] = r["top"]
        self.buckets = self.tops.pop("_buckets")
        if self.tops.pop("_texts", 0) < 2:
            raise ValueError(f"the store in {root} has the texts of plans once for each plan; create it anew")

    @classmethod
    def create(cls, spark: SparkSession, st: State, root: str, buckets: int = 64) -> BucketStore:
        """Writes the whole state, which also compacts it."""
        store = object.__new__(cls)
        store.spark, store.root, store.buckets, store.paths, store.tops = spark, root, buckets, {name: {} for name in SCHEMAS}, {}
        store._commit(st | store._parts(st["plans"]) | {"prints": None}, {name: None for name in SCHEMAS})
        return cls(spark, root)

    def bucket(self, relation: str, column: str | None = None) -> Column:
        key = column or KEYS.get(relation)
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int") if key else F.lit(0)

    def read(self, texts: bool = True) -> State:
        """All relations; plans without their texts if these are not asked for."""
        return {name: self._rows(name, None) for name in TABLES} | ({"plans": self._plans(None)} if texts else {})

    def _plans(self, only: list[int] | None) -> DataFrame:
        """Whole plans of these buckets."""
        columns = self.spark.createDataFrame([], TABLES["plans"]).columns
        texts = self._rows("texts", only)
        wanted = texts.select("id", F.explode(F.array(*(F.struct(F.lit(n).alias("name"), F.col(f"{n}_key").alias("key")) for n in TEXTS))).alias("of")).select("id", "of.*").where("key IS NOT NULL")
        long = wanted.join(self._rows("bodies", None), "key").groupBy("id").agg(*(F.max(F.when(F.col("name") == n, F.col("body"))).alias(f"_{n}") for n in TEXTS))
        whole = texts.join(long, "id", "left").select("id", *(F.coalesce(n, f"_{n}").alias(n) for n in TEXTS))
        return self._rows("plans", only).join(whole, "id", "left").select(*columns)

    @staticmethod
    def _parts(plans: DataFrame) -> State:
        """``plans`` as they are stored: without texts; the texts by id; and the long ones, each once."""
        short = {n: F.char_length(n) <= SHORT for n in TEXTS}
        texts = plans.where(F.coalesce(*TEXTS).isNotNull()).select("id", *(c for n in TEXTS for c in (F.when(short[n], F.col(n)).alias(n), F.when(~short[n], _digest(n)).alias(f"{n}_key"))))
        return {"plans": plans.drop(*TEXTS), "texts": texts, "bodies": _bodies(plans, TEXTS)}

    def _rows(self, relation: str, only: list[int] | None) -> DataFrame:
        paths = [p for b, p in self.paths[relation].items() if only is None or b in only]
        return self.spark.read.schema(SCHEMAS[relation]).parquet(*paths) if paths else self.spark.createDataFrame([], SCHEMAS[relation])

    def touched(self, relation: str, keys: DataFrame, column: str) -> list[int]:
        """The buckets of these keys, at most all."""
        return sorted(r["b"] for r in keys.select(self.bucket(relation, column).alias("b")).distinct().collect())

    def replace(self, rows: State, touched: dict[str, list[int]]) -> BucketStore:
        """A version in which the touched buckets hold exactly ``rows``; all other files stay as they are."""
        self._commit(rows, touched)
        return BucketStore(self.spark, self.root)

    def _commit(self, rows: State, touched: dict[str, list[int] | None]) -> None:
        """Writes the buckets (None: all), then the manifest, then the pointer."""
        name = f"version-{uuid.uuid4().hex}"
        for relation, frame in rows.items():
            folder = f"{self.root}/{name}/{relation}"
            if frame is None:
                frame = self._rows("plans", None).select("fingerprint", "id")
            schema = self.spark.createDataFrame([], SCHEMAS[relation]).schema
            shaped = frame.select(*(F.col(f.name).cast(f.dataType) for f in schema)).withColumn("_bucket", self.bucket(relation))
            if relation == "texts":
                shaped = shaped.withColumn("_text", F.xxhash64(*TEXTS, *(f"{n}_key" for n in TEXTS)))
            with shuffles_removed(self.spark):
                shaped.repartition("_bucket").sortWithinPartitions("_bucket", *([ORDER[relation]] if relation in ORDER else [])).drop("_text").write.partitionBy("_bucket").parquet(folder)
            fs, target = file_system(self.spark, folder)
            found = {int(f.getPath().getName().partition("=")[2]): f.getPath().toString() for f in fs.listStatus(target) if f.getPath().getName().startswith("_bucket=")}
            kept = {} if touched[relation] is None else {b: p for b, p in self.paths[relation].items() if b not in touched[relation]}
            self.paths[relation] = kept | found
            if "id" in frame.columns and relation not in ("prints", "texts"):
                stored = self.spark.read.schema(SCHEMAS[relation]).parquet(*found.values()) if found else shaped.limit(0)
                self.tops[relation] = max(self.tops.get(relation, 0), stored.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0])
        lines = [(relation, b, p, None) for relation, places in self.paths.items() for b, p in places.items()]
        lines += [(relation, None, None, top) for relation, top in (self.tops | {"_buckets": self.buckets, "_texts": 2}).items()]
        self.spark.createDataFrame(lines, MANIFEST).coalesce(1).write.parquet(f"{self.root}/{name}/manifest")
        add_pointer(self.spark, self.root, name)

    def upsert(self, incoming: DataFrame, source_id: int, now: str) -> tuple[BucketStore, DataFrame]:
        """The store after ``state.upsert_outcomes`` and ``state.apply_batch`` of a batch, and the outcomes.

        Only buckets of the batch's record ids, fingerprints and plans are read and written; texts of plans only
        if the batch has some, and then those of long texts that come with it.  Long texts that no plan has any more
        stay until the store is created anew.
        """
        incoming = settled(incoming)
        touched = {"plan_sources": self.touched("plan_sources", incoming, "record_id"), "prints": self.touched("prints", incoming, "fingerprint")}
        links, prints = self._rows("plan_sources", touched["plan_sources"]), self._rows("prints", touched["prints"])
        outcomes = settled(state.upsert_outcomes(incoming, links, prints, source_id, self.tops.get("plans", 0)))
        for relation in ("plans", "plan_categories"):
            touched[relation] = self.touched(relation, outcomes, "plan_id")
        worded = any(c in incoming.columns for c in TEXTS)
        part = {"plans": self._plans(touched["plans"]) if worded else self._rows("plans", touched["plans"]), "plan_sources": links, "plan_categories": self._rows("plan_categories", touched["plan_categories"]), "categories": self._rows("categories", None)}
        after = state.apply_batch(part, outcomes, source_id, now, self.tops.get("plan_sources", 0))
        new = outcomes.where("action = 'insert'").select("fingerprint", F.col("plan_id").alias("id"))
        rows = {name: after[name] for name in ("plans", "plan_sources", "plan_categories")} | {"prints": prints.union(new)}
        if worded:
            new = settled(_bodies(outcomes, [c for c in TEXTS if c in outcomes.columns]))
            touched["texts"], touched["bodies"] = touched["plans"], self.touched("bodies", new, "key")
            rows |= self._parts(after["plans"]) | {"bodies": self._rows("bodies", touched["bodies"]).union(new).distinct()}
        return self.replace(rows, touched), outcomes

    def vacuum(self) -> list[str]:
        """Deletes the versions' folders that the newest manifest doesn't name, and returns their names."""
        named = {p.split("/")[-3] for places in self.paths.values() for p in places.values()} | {newest_pointer(self.spark, self.root)}
        fs, folder = file_system(self.spark, self.root)
        gone = [f.getPath() for f in fs.listStatus(folder) if f.getPath().getName().startswith("version-") and f.getPath().getName() not in named]
        for path in gone:
            fs.delete(path, True)
        return [p.getName() for p in gone]
