"""MinHash near-dedup: universal hash minima, banding, verification and components.

Equal shingle sets form one class, so copies cost nothing further.  Classes that share a band
are candidates.  How many shingles of a class stand in any other candidate bounds its
similarity to every one of them; pairs beyond the bound are no candidates.  In a bucket, members
are compared with a centre, first the one with the smallest share of shingles of its own; a
member takes the centre that it meets in most buckets, so a round compares each node once.
Confirmed links are contracted, and buckets that still hold several components go on with other
centres.  The members of what is then still open are dealt into tiles of about TILE, and tiles of a
bucket are compared two by two: a small bucket has one tile, a large one many, which are spread over all
tasks.  In a pair of tiles, bounds and sketches are compared as arrays, and only what they suggest becomes a row.
A pair inside one component needs no comparison, and no link between different texts is lost.
Every link is confirmed on the full sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from .common import Scratch, map_texts, mix64, small_batches, table, written
from .components import connected_components

#: Words of a shingle, and the similarity in percent from which two sets are linked.
WORDS, PERCENT = 5, 75
#: Bands and minima of a band; a pair at 0.75 shares no band once in 190,000 times.
BANDS, ROWS = 32, 4
#: Rounds with centres before what is left is compared.
ROUNDS = 2
#: Members of a tile, about; a task compares two tiles of a bucket at a time.
TILE = 512
#: Bits of a candidate's sketch, one for each of as many other minima, and the similarity that they must suggest;
#: a pair at 0.75 falls below it (4.8 standard deviations) about once in 500,000 times.
SKETCH_BITS, SUGGESTED = 1024, 0.65

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_RANDOM = np.random.RandomState(20240229)
_A = _RANDOM.randint(0, 1 << 62, BANDS * ROWS).astype(np.uint64) * np.uint64(4) + np.uint64(1)
_B = _RANDOM.randint(0, 1 << 62, BANDS * ROWS).astype(np.uint64)
_C = _RANDOM.randint(0, 1 << 62, SKETCH_BITS).astype(np.uint64) * np.uint64(4) + np.uint64(3)
_D = _RANDOM.randint(0, 1 << 62, SKETCH_BITS).astype(np.uint64)
_STEP = np.uint64(0x9E3779B97F4A7C15)

SIGNED = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("n_shingles", pa.int64()), ("node", pa.binary()), ("bands", pa.list_(pa.int64()))])
PAIRS = pa.schema([("u", pa.binary()), ("v", pa.binary())])
SETS = pa.schema([("node", pa.binary()), ("keys", pa.list_(pa.int32())), ("sketch", pa.list_(pa.int64())), ("shingles", pa.list_(pa.int64()))])


def shingle_set(text: bytes, size: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles; of the whole sequence if it has fewer words."""
    words = text.translate(_LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < size:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), 1)], np.uint64)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = len(hashes) - size + 1
    out = np.zeros(n, np.uint64)
    for k in range(size):
        out *= _STEP
        out += hashes[k : k + n]
    return np.unique(mix64(out))


def set_digest(shingles: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(shingles.tobytes())


def minima(shingles: np.ndarray, a: np.ndarray = _A, b: np.ndarray = _B) -> np.ndarray:
    """The least value of each universal hash function over the set."""
    out = np.full(len(a), np.iinfo(np.uint64).max, np.uint64)
    wide = (1 << 17) // len(a)
    for at in range(0, len(shingles), wide):
        block = shingles[None, at : at + wide] * a[:, None]
        block += b[:, None]
        np.minimum(out, block.min(1), out=out)
    return out


def sketch(shingles: np.ndarray) -> np.ndarray:
    """One bit of each of many minima."""
    return np.packbits((minima(shingles, _C, _D) >> np.uint64(24)).astype(np.uint8) & 1).view(np.int64)


def band_keys(lows: np.ndarray) -> np.ndarray:
    out = np.arange(BANDS, dtype=np.uint64)
    for k in range(ROWS):
        out = mix64(out * _STEP + lows.reshape(BANDS, ROWS)[:, k])
    return out.view(np.int64)


def _signed(_, ids, texts):
    sets = [shingle_set(t) for t in texts]
    return {
        "doc_id": ids,
        "text_hash": np.array([xxhash.xxh64_intdigest(t, 42) for t in texts], np.uint64).view(np.int64),
        "n_shingles": [len(s) for s in sets],
        "node": [set_digest(s) for s in sets],
        "bands": [band_keys(minima(s)) if len(s) else None for s in sets],
    }


def _sets(_, nodes, texts):
    """Sets of the texts that have the digest of their class; others share only the doc_id."""
    sets = [shingle_set(t) for t in texts]
    rows = [(n, s) for n, s in zip(nodes, sets, strict=True) if set_digest(s) == n]
    return {
        "node": [n for n, _ in rows],
        "keys": [band_keys(minima(s)).astype(np.int32) for _, s in rows],
        "sketch": [sketch(s) for _, s in rows],
        "shingles": [s.view(np.int64) for _, s in rows],
    }


def _likely(a: str, b: str):
    """Whether two sketches suggest similar sets: of two different minima, bits differ with a chance of one half."""
    apart = sum((F.bit_count(F.col(a)[i].bitwiseXOR(F.col(b)[i])) for i in range(SKETCH_BITS // 64)), F.lit(0))
    return apart <= int((1 - SUGGESTED) * SKETCH_BITS / 2)


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those pairs (u, v) whose sketches suggest it and whose sets are similar enough: 100 * intersection >= PERCENT * union."""
    left = sets.select(F.col("node").alias("u"), F.col("sketch").alias("su"), F.col("shingles").alias("s"))
    right = sets.select(F.col("node").alias("v"), F.col("sketch").alias("sv"), F.col("shingles").alias("t"))
    both = pairs.join(left, "u").join(right, "v").where(_likely("su", "sv"))
    common = F.size(F.array_intersect("s", "t"))
    return both.where(common * 100 >= (F.size("s") + F.size("t") - common) * PERCENT).select("u", "v")


def _possible(n: str, r: str, m: str, q: str):
    """Whether sets of n and m shingles, of which r and q stand in other candidates, can be similar enough."""
    common = F.least(n, r, m, q)
    return common * 100 >= (F.col(n) + F.col(m) - common) * PERCENT


def _shared_counts(sets: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, r): how many shingles of a node stand in other nodes too; hash collisions only add."""
    each = sets.select("node", F.explode("shingles").alias("s")).select("node", F.hash("s").alias("s"))
    common = scratch.written(each.groupBy("s").agg(F.count("*").alias("c")).where("c > 1").select("s"), "common")
    return each.join(common, "s", "left_semi").groupBy("node").agg(F.count("*").alias("r"))


def tile_pairs(held: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Places of the pairs of one pair of tiles that ``_possible`` and ``_likely`` leave: of different tiles, or of one.

    A pair that meets in several buckets is found in that of its first common band alone.
    """
    n, r, root, bits, tile, keys = (held[c] for c in ("n", "r", "root", "sketch", "tile", "keys"))
    left = np.flatnonzero(tile == tile[0])
    right = left if len(left) == len(tile) else np.flatnonzero(tile != tile[0])
    most, found = int((1 - SUGGESTED) * SKETCH_BITS / 2), []
    for at in range(0, len(left), 64):
        a = left[at : at + 64, None]
        common = np.minimum(np.minimum(n[a], r[a]), np.minimum(n[right], r[right]))
        open_ = (root[a] != root[right]).any(2) & (common * 100 >= (n[a] + n[right] - common) * PERCENT)
        if right is left:
            open_ &= a < right
        i, j = np.nonzero(open_)
        i, j = a[i, 0], right[j]
        for k in range(0, len(i), 1 << 15):
            x, y = i[k : k + (1 << 15)], j[k : k + (1 << 15)]
            near = np.bitwise_count(bits[x] ^ bits[y]).sum(1, dtype=np.int64) <= most
            x, y = x[near], y[near]
            here = (keys[x] == keys[y]).argmax(1) == held["band"][x]
            found.append((x[here], y[here]))
    return tuple(np.concatenate([np.zeros(0, np.int64), *(f[k] for f in found)]) for k in (0, 1))


def _words(column: pa.Array) -> np.ndarray:
    """Values of 16 bytes as pairs of numbers."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(-1, 2)


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows to the pairs (u < v) of each pair of tiles; one pair of tiles is in memory at a time, besides a batch."""
    kept: list[pa.RecordBatch] = []

    def pairs(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
        held = {c: rows.column(c).to_numpy(zero_copy_only=False) for c in ("n", "r", "tile", "band")}
        held["keys"] = rows.column("keys").flatten().to_numpy(zero_copy_only=False).reshape(rows.num_rows, -1)
        held |= {"root": _words(rows.column("root")), "sketch": rows.column("sketch").flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(rows.num_rows, -1)}
        i, j = tile_pairs(held)
        nodes = rows.column("node").to_pylist()
        both = [sorted((nodes[x], nodes[y])) for x, y in zip(i.tolist(), j.tolist())]
        return pa.RecordBatch.from_arrays([pa.array([p[k] for p in both], pa.binary()) for k in (0, 1)], schema=PAIRS)

    last = None
    for batch in batches:
        keys = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("bucket", "a", "b")], 1)
        cuts = [0, *(np.flatnonzero((np.diff(keys, axis=0) != 0).any(1)) + 1).tolist(), len(keys)]
        for low, high in zip(cuts, cuts[1:]):
            if high == low:
                continue
            if last is not None and (keys[low] != last).any():
                yield pairs(kept)
                kept = []
            last = keys[low]
            kept.append(batch.slice(low, high - low))
    if kept:
        yield pairs(kept)


def _open_pairs(live: DataFrame) -> DataFrame:
    """Pairs (u, v) of different roots that share a bucket of ``live`` (bucket, band, node, n, r, root, sketch, keys) and may be similar enough.

    The same way for buckets of all sizes: each member goes to all tiles of its bucket, one pair of tiles a key.
    """
    sizes = live.groupBy("bucket").agg(F.ceil(F.count("*") / TILE).cast("int").alias("tiles"))
    dealt = live.join(sizes, "bucket").withColumn("tile", F.pmod(F.xxhash64("node"), "tiles").cast("int"))
    sent = dealt.select("bucket", "band", "node", "n", "r", "root", "sketch", "keys", "tile", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("other"))
    sent = sent.select("bucket", F.least("tile", "other").alias("a"), F.greatest("tile", "other").alias("b"), "tile", "band", "node", "n", "r", "root", "sketch", "keys")
    spread = small_batches(sent).repartition("bucket", "a", "b").sortWithinPartitions("bucket", "a", "b")
    return spread.mapInArrow(_tiles, from_arrow_schema(PAIRS))


def _resolve(members: DataFrame, sets: DataFrame, scratch: Scratch) -> DataFrame:
    """Links (u, v) that connect every component.

    ``members``: bucket, band, node, n, r, sketch, keys.  A root is a node of the same component; a round
    moves roots to ones that are smaller in one order of all roots, so that no cycle can arise.
    """
    labels = members.select("node", F.col("node").alias("root")).distinct()
    links: DataFrame | None = None
    for k in range(ROUNDS + 1):
        rooted = members.join(labels, "node")
        one = F.struct("node", "n", "r", "sketch")
        by_root = rooted.groupBy("bucket", "root").agg(F.min_by(one, F.xxhash64("node", F.lit(k))).alias("one"))
        own = F.when(F.lit(k) == 0, 1 - F.col("one.r") / F.col("one.n")).otherwise(0.0)
        order = F.struct(own.alias("own"), F.xxhash64("root", F.lit(k)).alias("h"))
        buckets = by_root.groupBy("bucket").agg(F.count("*").alias("roots"), F.min_by(F.struct("one.*", "root", order.alias("order")), order).alias("centre")).where("roots > 1")
        live = rooted.join(scratch.written(buckets.select("bucket", "centre"), "buckets"), "bucket")
        if k == ROUNDS:
            pairs = scratch.written(_open_pairs(live), "pairs")
            found = scratch.written(_verified(pairs, sets), "links")
            return links.union(found) if links is not None else found
        centre = {c: F.col(f"centre.{c}") for c in ("node", "n", "r", "sketch", "root", "order")}
        rows = live.select("node", "n", "r", "sketch", "root", centre["node"].alias("v"), centre["n"].alias("m"), centre["r"].alias("q"), centre["sketch"].alias("other"), centre["root"].alias("to"), centre["order"].alias("order"))
        met = rows.where((F.col("root") != F.col("to")) & _possible("n", "r", "m", "q") & _likely("sketch", "other")).groupBy("node", "root", "v", "to", "order").agg(F.count("*").alias("c"))
        pairs = met.groupBy("node", "root").agg(F.max_by(F.struct("v", "to"), F.struct("c", "order")).alias("x")).select(F.col("node").alias("u"), "x.v", "root", "x.to")
        pairs = scratch.written(pairs, "pairs")
        found = scratch.written(_verified(pairs.select("u", "v"), sets).join(pairs, ["u", "v"]), "links")
        links = found.select("u", "v") if links is None else links.union(found.select("u", "v"))
        moved = found.groupBy("root").agg(F.min_by("to", F.xxhash64("to", F.lit(k))).alias("to"))
        labels = scratch.written(labels.join(moved, "root", "left").select("node", F.coalesce("to", "root").alias("root")), "labels")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_shingles, component_id, kept, text_hash (Spark's xxhash64).

    Null texts and texts without words have an empty set and stand alone; so does a null doc_id's
    row unless its set is shared, and a null id is the smallest of a component only if it has no
    other.  Rows with equal sets are always linked, rows with equal ids only through their sets.
    An empty table gives no rows; of the columns only doc_id and text are read, so others may have any names.
    Texts may be of any length.
    """
    spark = docs.sparkSession
    scratch = Scratch()
    signed = written(map_texts(docs, _signed, SIGNED), "signed")
    full = signed.where("n_shingles > 0")
    classes = scratch.written(full.groupBy("node").agg(F.min("doc_id").alias("least")), "classes")
    first = (full["node"] == classes["node"]) & full["doc_id"].eqNullSafe(classes["least"])
    bands = full.join(classes, first, "left_semi").select(F.posexplode("bands").alias("band", "bucket"), "node")
    shared = scratch.written(bands.groupBy("bucket").agg(F.count("*").alias("c")).where("c > 1").select("bucket"), "shared")
    members = scratch.written(bands.join(shared, "bucket", "left_semi").distinct(), "members")
    chosen = scratch.written(members.select("node").distinct().join(classes, "node").select(F.col("least").alias("doc_id"), "node"), "chosen")
    # What is chosen grows with the input, so the texts go to it in the same way at every size.
    chosen = chosen.withColumnRenamed("doc_id", "__id").hint("merge")
    texts = docs.select("doc_id", "text").join(chosen, F.col("doc_id").eqNullSafe(F.col("__id"))).select("node", "text")
    sets = scratch.written(map_texts(texts, _sets, SETS, keys=["node"]), "sets")
    if sets.count() > chosen.count():
        sets = scratch.written(sets.dropDuplicates(["node"]), "sets")
    # Dealt once by node and kept; a lost part is made anew from the stored table.
    sets = sets.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "node").persist()
    counted = _shared_counts(sets, scratch).join(sets.select("node", F.size("shingles").alias("n"), "sketch", "keys"), "node").where(F.col("r") * 100 >= F.col("n") * PERCENT)
    links = scratch.written(_resolve(scratch.written(members.join(counted, "node"), "members"), sets, scratch), "links")
    sets.unpersist()
    stars = connected_components(links)
    scratch.tables.append(stars)
    stars = stars.select(F.col("u").alias("node"), F.col("v").alias("root"))
    rooted = classes.join(stars, "node", "left").select("node", "least", F.coalesce("root", "node").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    roots = written(rooted.join(least, "root").select("node", "component_id"), "roots")
    scratch.drop()
    return signed.select("doc_id", "n_shingles", "node", "text_hash").join(roots, "node", "left").select(
        "doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("component_id", "doc_id").eqNullSafe(F.col("doc_id")).alias("kept"), "text_hash"
    )


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose doc_id stands for its component, with all their columns."""
    kept = near_duplicates(docs).where("kept").select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash")).distinct()
    same = docs["doc_id"].eqNullSafe(kept["__id"]) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == kept["__hash"])
    return docs.join(kept, same, "left_semi")


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).drop("text_hash")


ORACLE = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
u AS (SELECT row, unnest(words) AS w, generate_subscripts(words, 1) AS i FROM d WHERE len(words) >= 5),
x AS (SELECT row, concat_ws(' ', w, lead(w) OVER p, lead(w, 2) OVER p, lead(w, 3) OVER p, lead(w, 4) OVER p) AS s, lead(w, 4) OVER p AS last FROM u WINDOW p AS (PARTITION BY row ORDER BY i)),
s AS (SELECT DISTINCT row, s FROM x WHERE last IS NOT NULL UNION ALL SELECT row, array_to_string(words, ' ') FROM d WHERE len(words) BETWEEN 1 AND 4),
n AS (SELECT row, count(*) AS n FROM s GROUP BY row),
c AS (SELECT a.row AS a, b.row AS b, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.row < b.row GROUP BY 1, 2),
l AS (SELECT a, b FROM c JOIN n x ON x.row = a JOIN n y ON y.row = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT row AS a, row AS b FROM d UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b),
m AS (SELECT r.a AS row, min(doc_id) AS component_id FROM r JOIN d ON d.row = r.b GROUP BY r.a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM d JOIN m USING (row) LEFT JOIN n USING (row)
"""
