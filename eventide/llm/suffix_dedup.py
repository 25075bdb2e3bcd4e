"""Substring dedup by distributed prefix doubling over thinned positions.

A byte is removed if a string of LENGTH bytes covers it that also starts elsewhere.  Doubling the
ranks of all positions would sort every byte of the corpus several times, so positions are thinned first:
every string of LENGTH bytes has one anchor, the leftmost place with the least hash of ANCHOR bytes
in it, and equal strings have equal anchors at equal offsets.  Consecutive strings with one
anchor form a run.  Runs whose anchor stands once leave, and of runs that stand elsewhere as a whole
only one goes on.

What the strings of up to STEP offsets of a run share is a core of BLOCK << DOUBLINGS bytes.  Cores get
their ranks by prefix doubling: the first rank of a position is the hash of BLOCK bytes; then Spark
sorts the pairs of ranks at a position and at BLOCK, 2 * BLOCK and 4 * BLOCK bytes behind it, and a
pair's place in this order is the rank of twice the length.  After every sort, cores
with a position whose rank is unique leave.  At last, cores of equal rank compare the bytes on either side.

Equal pairs may fill any number of sorted partitions; a row for each partition tells where its first
pair began.  Groups of more than GROUP rows in the last step are counted string by string with
partial sums instead of in one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from .common import Scratch, map_texts, mix64, table, written

LENGTH = 400
ANCHOR = 48
#: Bytes of a position's first rank, and how often the length of ranks is doubled.
BLOCK, DOUBLINGS = 43, 3
CORE = BLOCK << DOUBLINGS
#: Offsets at which strings of LENGTH bytes share a core.
STEP = LENGTH - CORE + 1
#: Rows of one group that a task compares at most.
GROUP = 512
#: Positions of a text that are read at once.
SEGMENT = 1 << 20

_RANDOM = np.random.RandomState(404)
_VALUE = (_RANDOM.randint(0, 1 << 62, 256).astype(np.uint64) << np.uint64(2)) | _RANDOM.randint(0, 4, 256).astype(np.uint64)
_BASE = 0x9E3779B97F4A7C15
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

RUNS = pa.schema([("h", pa.int64()), ("v", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("s", pa.int64()), ("n", pa.int32()), ("d", pa.int32())])
TEXTS = pa.schema([("doc_id", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("body", pa.binary())])
PARTS = pa.schema([("blocks", pa.list_(pa.int64())), ("k1", pa.int64()), ("k2", pa.int64()), ("at", pa.int64()), ("low", pa.int32()), ("high", pa.int32()), ("left", pa.binary()), ("right", pa.binary()), ("single", pa.bool_())])
MEMBERS = ["core", "k1", "k2", "at", "low", "high", "left", "right", "single"]
RANKED = pa.schema([("id", pa.int64()), ("i", pa.int32()), ("part", pa.int32()), ("head", pa.int64()), ("alone", pa.bool_()), ("edge", pa.list_(pa.int64()))])
FOUND = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("s", pa.int64()), ("n", pa.int32())])
RESULT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least n of them."""
    if len(_POWERS[0]) < n:
        for i, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(max(n, 1 << 14), base, np.uint64)
            steps[0] = 1
            _POWERS[i] = np.multiply.accumulate(steps)
    return _POWERS[0][:n], _POWERS[1][:n]


def anchored_runs(text: bytes, length: int = LENGTH, anchor: int = ANCHOR) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(hash, start, strings, offset of the anchor from the start) of each run, by segments of the text."""
    wide = length - anchor + 1
    for base in range(0, len(text) - length + 1, SEGMENT):
        a = np.frombuffer(text, np.uint8, min(len(text) - base, SEGMENT + length - 1), base)
        up, down = _powers(len(a))
        sums = np.zeros(len(a) + 1, np.uint64)
        np.cumsum(_VALUE[a] * up, out=sums[1:], dtype=np.uint64)
        g = mix64((sums[anchor:] - sums[:-anchor]) * down[: len(a) - anchor + 1])
        x = (g & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(g), dtype=np.uint64)
        m = len(g) - wide + 1
        blocks = np.concatenate([x, np.full(-len(x) % wide, np.uint64(2**64 - 1))]).reshape(-1, wide)
        ahead = np.minimum.accumulate(blocks, 1).ravel()
        behind = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
        place = (np.minimum(behind[:m], ahead[wide - 1 : wide - 1 + m]) & np.uint64(0xFFFFFFFF)).astype(np.int64)
        starts = np.concatenate(([0], np.flatnonzero(np.diff(place)) + 1))
        yield g[place[starts]].view(np.int64), starts + base, np.diff(np.append(starts, m)), place[starts] - starts


def _keys(doc, text: bytes) -> tuple[int, int]:
    """Two hashes that name a row; rows with equal id and text are one row twice."""
    raw = repr(doc).encode() + b"\0" + text
    a, b = xxhash.xxh3_64_intdigest(raw, 1), xxhash.xxh3_64_intdigest(raw, 2)
    return a - (1 << 63), b - (1 << 63)


def _rank_runs(_, ids, texts):
    out = [[] for _ in RUNS]
    for doc, text in zip(ids, texts, strict=True):
        if len(text) < LENGTH:
            continue
        k1, k2 = _keys(doc, text)
        for h, s, n, d in anchored_runs(text):
            spans = zip(s.tolist(), (s + n + (LENGTH - 1)).tolist(), strict=True)
            v = np.array([xxhash.xxh3_64_intdigest(text[a:b]) for a, b in spans], np.uint64).view(np.int64)
            for held, x in zip(out, (h, v, np.full(len(h), k1), np.full(len(h), k2), s, n, d), strict=True):
                held.append(x)
    return {f.name: pa.array(np.concatenate(x) if x else [], f.type) for f, x in zip(RUNS, out, strict=True)}


def _pack_texts(packer, ids, texts):
    keys = [_keys(i, t) for i, t in zip(ids, texts, strict=True)]
    return {"doc_id": ids, "k1": [k for k, _ in keys], "k2": [k for _, k in keys], "body": [packer.compress(t) for t in texts]}


def _split_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(k1, k2, body, runs) to the shared part and both flanks of each offset range of each run."""
    unpack = zstandard.ZstdDecompressor()
    for batch in batches:
        k1s, k2s, bodies, runs = (batch.column(i).to_pylist() for i in range(4))
        for lo in range(0, len(k1s), 64):
            rows = []
            for k1, k2, body, units in zip(k1s[lo : lo + 64], k2s[lo : lo + 64], bodies[lo : lo + 64], runs[lo : lo + 64], strict=True):
                text = unpack.decompress(body)
                for unit in units:
                    anchor, most, least = unit["s"] + unit["d"], unit["d"], unit["d"] - unit["n"] + 1
                    for j in range(least // STEP, most // STEP + 1):
                        low, high = max(0, least - j * STEP), min(STEP - 1, most - j * STEP)
                        at, end = anchor - j * STEP, anchor - j * STEP + CORE
                        #: Ranks of different offsets must differ.
                        blocks = [xxhash.xxh3_64_intdigest(text[x : x + BLOCK], j) - (1 << 63) for x in range(at, end, BLOCK)]
                        rows.append((blocks, k1, k2, at, low, high, text[at - high : at], text[end : end + STEP - 1 - low], unit["c"] == 1))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), PARTS, strict=True)], schema=PARTS)


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (a, b, id, i, part) to the place in this partition where each one's pair begins, and whether the pair stands here once.

    ``edge`` is (a, b, rows before) in the first row of a partition, and in the last one.
    """
    held: list[np.ndarray] = []
    seen = head = 0

    def rows(a, b, i, at, part, heads, alone, edges):
        edge = [None] * len(a)
        for x in edges:
            edge[x] = [int(a[x]), int(b[x]), seen + x]
        columns = (i, at, part, heads, alone, edge)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, RANKED, strict=True)], schema=RANKED)

    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        new = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(5)]
        a, b, i, at, part = (np.concatenate(x) for x in zip(held, new, strict=True)) if held else new
        begins = np.concatenate(([last is None or last != (a[0], b[0])], (np.diff(a) != 0) | (np.diff(b) != 0)))
        heads = np.maximum.accumulate(np.where(begins, np.arange(seen, seen + len(a)), head))
        n = len(a) - 1
        if n:
            yield rows(a[:n], b[:n], i[:n], at[:n], part[:n], heads[:n], begins[:n] & begins[1:], [0] * (seen == 0))
            last, head = (a[n - 1], b[n - 1]), int(heads[n - 1])
        seen += n
        held = [x[n:] for x in (a, b, i, at, part)]
    if held:
        a, b, i, at, part = held
        begins = last is None or last != (a[0], b[0])
        yield rows(a, b, i, at, part, np.array([seen if begins else head]), np.array([begins]), [0])


def _joined_edges(edges: list[tuple[int, int, int, int, int]]) -> list[tuple[int, int, int, bool, bool]]:
    """(part, a, b, rows before, head) of first and last rows to (part, offset, head of the first pair, whether the pair goes on before, and behind)."""
    ends: dict[int, list] = {}
    for part, *edge in sorted(edges, key=lambda e: (e[0], e[3])):
        ends.setdefault(part, []).append(edge)
    out, offset, before, top = [], 0, None, 0
    parts = sorted(ends)
    for k, part in enumerate(parts):
        first, last = ends[part][0], ends[part][-1]
        behind = ends[parts[k + 1]][0][:2] if k + 1 < len(parts) else None
        joins = before == first[:2]
        begin = top if joins else offset
        out.append((part, offset, begin, joins, behind == last[:2]))
        top = begin if last[3] == 0 else offset + last[3]
        offset, before = offset + last[2] + 1, last[:2]
    return out


def reranked(pairs: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, i, rank, alone) of a stored table (id, i, a, b): the place of each row's pair (a, b) among all pairs in order.

    Rows are sorted by pair and position, so equal pairs may fill several partitions.
    """
    keys = ["a", "b", "id", "i"]
    ordered = pairs.repartitionByRange(*keys).sortWithinPartitions(*keys).select("a", "b", "id", "i", F.spark_partition_id().alias("part"))
    placed = scratch.written(ordered.mapInArrow(_places, from_arrow_schema(RANKED)), "placed")
    edges = placed.where("edge is not null").select("part", F.col("edge")[0], F.col("edge")[1], F.col("edge")[2], "head").collect()
    shape = "part int, offset long, begin long, before boolean, behind boolean, final long"
    last = {e[0]: e[3] for e in sorted(map(tuple, edges), key=lambda e: (e[0], e[3]))}
    joined = pairs.sparkSession.createDataFrame([(*e, last[e[0]]) for e in _joined_edges([tuple(e) for e in edges])], shape)
    first, final = F.col("head") == 0, F.col("edge").isNotNull() & (F.col("edge")[2] == F.col("final"))
    rank = F.when(first, F.col("begin")).otherwise(F.col("offset") + F.col("head"))
    alone = F.col("alone") & ~(first & F.col("before")) & ~(F.coalesce(final, F.lit(False)) & F.col("behind"))
    return placed.join(F.broadcast(joined), "part").select("id", "i", rank.alias("rank"), alone.alias("alone"))


def core_ranks(parts: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, core): equal for parts (id, blocks) with equal cores; parts whose core stands once are left out."""
    pieces = parts.select("id", F.col("blocks").alias("ranks"))
    for _ in range(DOUBLINGS):
        two = F.transform(F.sequence(F.lit(0), F.size("ranks") - 1, F.lit(2)), lambda x: F.struct(F.col("ranks")[x].alias("a"), F.col("ranks")[x + 1].alias("b")))
        pairs = scratch.written(pieces.select("id", F.posexplode(two).alias("i", "p")).select("id", "i", "p.a", "p.b"), "pairs")
        found = reranked(pairs, scratch)
        whole = found.groupBy("id").agg(F.max("alone").alias("alone"), F.array_sort(F.collect_list(F.struct("i", "rank"))).alias("r"))
        pieces = whole.where("not alone").select("id", F.transform("r", lambda x: x["rank"]).alias("ranks"))
    return pieces.select("id", F.col("ranks")[0].alias("core"))


def repeated_strings(members: list[tuple[int, int, bytes, bytes]]) -> list[list[int]]:
    """For each member (low, high, left, right) of a group, the offsets in low..high at which another one has the same string.

    At offset x the string is the last x bytes of left, what the group shares, and the first
    STEP - 1 - x bytes of right.
    """
    seen: dict[tuple[int, bytes], int] = {}
    flanks = [(left + right, len(left)) for _, _, left, right in members]
    for (low, high, _, _), (both, middle) in zip(members, flanks, strict=True):
        for x in range(low, high + 1):
            key = (x, both[middle - x : middle - x + STEP - 1])
            seen[key] = seen.get(key, 0) + 1
    return [[x for x in range(low, high + 1) if seen[x, both[middle - x : middle - x + STEP - 1]] > 1] for (low, high, _, _), (both, middle) in zip(members, flanks, strict=True)]


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by core to the repeated strings of those that stand once."""

    def settle(rows):
        for row, xs in zip(rows, repeated_strings([r[4:8] for r in rows]), strict=True):
            if row[8] and xs:
                first = last = xs[0]
                for x in [*xs[1:], None]:
                    if x is not None and x == last + 1:
                        last = x
                        continue
                    yield row[1], row[2], row[3] - last, last - first + 1
                    first = last = x

    def sent(found):
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found, strict=True), FOUND, strict=True)], schema=FOUND)

    group, found = [], []
    for batch in batches:
        for row in zip(*(batch.column(i).to_pylist() for i in range(len(MEMBERS))), strict=True):
            if group and group[0][0] != row[0]:
                found += settle(group)
                group = []
            group.append(row)
        if len(found) > 10_000:
            yield sent(found)
            found = []
    found += settle(group)
    if found:
        yield sent(found)


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    unpack = zstandard.ZstdDecompressor()
    for batch in batches:
        rows = []
        for doc, body, found in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            text = unpack.decompress(body)
            kept, removed, spans, end = hashlib.sha256(), 0, 0, 0
            for s, n in sorted((r["s"], r["n"]) for r in found or ()):
                stop = s + n + LENGTH - 1
                if s > end or not spans:
                    spans += 1
                    kept.update(text[end:s])
                    end = s
                removed += max(0, stop - end)
                end = max(end, stop)
            kept.update(text[end:])
            rows.append((doc, len(text), removed, spans, kept.hexdigest()))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(RESULT)], schema=RESULT)


def substring_dedup(docs: DataFrame) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    A null text counts as empty; texts of fewer than LENGTH bytes keep everything.  Equal texts of
    at least LENGTH bytes lose all bytes in every row, also where whole rows are repeated.
    An empty table gives no rows; of the columns only doc_id and text are read, so others may have any names.
    Texts may be of any length; they are read by segments.
    """
    scratch = Scratch()
    runs = scratch.written(map_texts(docs, _rank_runs, RUNS), "runs")
    shared = scratch.written(runs.groupBy("h").agg(F.count("*").alias("c")).where("c > 1").select("h"), "ranks")
    alive = scratch.written(runs.join(shared, "h", "left_semi"), "runs")
    scratch.drop(runs)
    firsts = [F.first(c).alias(c) for c in ("k1", "k2", "s", "n", "d")]
    kinds = scratch.written(alive.groupBy("h", "v").agg(F.count("*").alias("c"), *firsts), "kinds")
    settled = alive.join(kinds.where("c > 1").select("h", "v"), ["h", "v"], "left_semi").select("k1", "k2", "s", "n")
    several = kinds.groupBy("h").agg(F.count("*").alias("kinds"), F.min("c").alias("least")).where("kinds > 1 and least = 1").select("h")
    units = kinds.join(several, "h", "left_semi").groupBy("k1", "k2").agg(F.collect_list(F.struct("s", "n", "d", "c")).alias("runs"))
    texts = map_texts(docs, _pack_texts, TEXTS, setup=lambda: zstandard.ZstdCompressor(level=1))
    parts = texts.select("k1", "k2", "body").join(units, ["k1", "k2"]).select("k1", "k2", "body", "runs").mapInArrow(_split_runs, from_arrow_schema(PARTS))
    parts = scratch.written(parts.withColumn("id", F.monotonically_increasing_id()), "parts")
    ranked = scratch.written(parts.drop("blocks").join(core_ranks(parts.select("id", "blocks"), scratch), "id").select(*MEMBERS), "ranked")
    cores = ranked.groupBy("core").agg(F.count("*").alias("m"), F.max(F.col("single").cast("int")).alias("open")).where("open = 1").select("core", "m")
    grouped = scratch.written(ranked.join(cores, "core").select(*MEMBERS, "m"), "grouped")
    scratch.drop(parts)
    scratch.drop(ranked)
    small = grouped.where(F.col("m") <= GROUP).drop("m").repartition("core").sortWithinPartitions("core").mapInArrow(_compare, from_arrow_schema(FOUND))
    middle = F.length("left")
    strings = grouped.where(F.col("m") > GROUP).select("core", "k1", "k2", "at", "single", F.concat("left", "right").alias("both"), middle.alias("middle"), F.explode(F.sequence("low", "high")).alias("x"))
    strings = strings.select("core", "x", F.expr(f"substring(both, middle - x + 1, {STEP - 1})").alias("string"), "k1", "k2", (F.col("at") - F.col("x")).alias("s"), "single")
    twice = strings.groupBy("core", "x", "string").agg(F.count("*").alias("c")).where("c > 1").drop("c")
    large = strings.where("single").join(twice, ["core", "x", "string"], "left_semi").select("k1", "k2", "s", F.lit(1).alias("n"))
    found = settled.union(small.select("k1", "k2", "s", "n")).union(large)
    spans = written(found.groupBy("k1", "k2").agg(F.collect_list(F.struct("s", "n")).alias("found")), "spans")
    scratch.drop()
    return texts.join(spans, ["k1", "k2"], "left").select("doc_id", "body", "found").mapInArrow(_remove, from_arrow_schema(RESULT))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents"))


#: Strings are compared by 64-bit hashes; texts as hexadecimal digits, two for each byte.
ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
p AS (SELECT row, unnest(range(0, len(x) // 2 - 399)) AS i, x FROM d WHERE len(x) >= 800),
h AS (SELECT row, i, hash(substr(x, CAST(2 * i + 1 AS BIGINT), 800)) AS h FROM p),
t AS (SELECT h FROM h GROUP BY h HAVING count(*) > 1),
f AS (SELECT row, i, coalesce(i > lag(i) OVER o + 400, true) AS opens FROM h SEMI JOIN t USING (h) WINDOW o AS (PARTITION BY row ORDER BY i)),
g AS (SELECT row, i, sum(CAST(opens AS INT)) OVER (PARTITION BY row ORDER BY i) AS k FROM f),
s AS (SELECT row, k, min(i) AS a, max(i) + 400 AS b FROM g GROUP BY row, k),
e AS (SELECT row, a, b, coalesce(lag(b) OVER (PARTITION BY row ORDER BY a), 0) AS before FROM s),
r AS (SELECT row, CAST(sum(b - a) AS BIGINT) AS n_removed, count(*) AS n_spans, max(b) AS stop FROM e GROUP BY row),
q AS (SELECT e.row, string_agg(substr(x, CAST(2 * before + 1 AS BIGINT), CAST(2 * (a - before) AS BIGINT)), '' ORDER BY a) AS kept FROM e JOIN d ON d.row = e.row GROUP BY e.row)
SELECT doc_id, CAST(len(x) // 2 AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, '') || substr(x, CAST(2 * coalesce(stop, 0) + 1 AS BIGINT)))) AS kept_sha256
FROM d LEFT JOIN r ON r.row = d.row LEFT JOIN q ON q.row = d.row
"""
