"""Spelling variants: words one edit apart, each with its most frequent neighbour.

Words are bytes of Latin-1, one for each code point.  Of every word, deletions and replacements are hashed
and looked up in blocked Bloom filters of the vocabulary, one shard for each length (insertions are
others' deletions).  Only what the filters know is written out as a string and joined to the vocabulary,
which leaves no false positives.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from .common import Scratch, dropped, map_texts, mix64, small_batches, table, written

#: A word has so many code points and occurrences at least.
LEAST_LENGTH, LEAST_COUNT = 5, 3
#: Of the hashes of a document's words, those that this divides lose a code point.
MODULUS = 97
#: Bits of the filters for each word; a filter's blocks have 256.
BITS = 16
#: Blocks of the filters that are broadcast at once (32 MB); a larger vocabulary takes several rounds.
FILTER_BLOCKS = 1 << 20
#: Edits that are hashed at once.
PROBES = 1 << 20
#: Edits of a task, about.
TASK_PROBES = 40_000_000

COUNT = pa.schema([("code", pa.binary()), ("n", pa.int64())])
SHARD = pa.schema([("length", pa.int32()), ("words", pa.int64()), *((f"m{k}", pa.int64()) for k in range(4))])
BLOCK = pa.schema([("block", pa.int64()), *((f"b{k}", pa.int32()) for k in range(8))])
FOUND = pa.schema([("near", pa.binary()), ("code", pa.binary()), ("n", pa.int64())])

#: What each Latin-1 byte becomes: letters themselves, A to Z in lower case, all else a blank.
_LETTERS = bytes(b if chr(b) in "abcdefghijklmnopqrstuvwxyz" or b >= 0xC0 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


# ---- words -----------------------------------------------------------------------------------


def _count(_, ids: list, texts: list[bytes]) -> dict:
    """Occurrences of the words of a chunk, with what the documents' hashes delete."""
    total: Counter = Counter()
    for ident, text in zip(ids, texts):
        found = Counter(text.decode("utf-8", "replace").encode("latin-1", "replace").translate(_LETTERS).split())
        start = zlib.crc32(f"{'' if ident is None else ident}:".encode())
        for word, n in found.items():
            h = zlib.crc32(word if word.isascii() else word.decode("latin-1").encode(), start)
            if not h % MODULUS:
                at = h % len(word)
                word = word[:at] + word[at + 1 :]
            if len(word) >= LEAST_LENGTH:
                total[word] += n
    return {"code": list(total), "n": list(total.values())}


def vocabulary(docs: DataFrame) -> DataFrame:
    """(code, n): the words of all texts with their occurrences; added up before rows move."""
    return map_texts(docs, _count, COUNT).groupBy("code").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


def _by_length(codes: list[bytes]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Length, places in the list, and a matrix of code points, for each length."""
    lengths = np.array([len(c) for c in codes])
    for length in np.unique(lengths):
        at = np.flatnonzero(lengths == length)
        yield int(length), at, np.frombuffer(b"".join(codes[i] for i in at), np.uint8).reshape(len(at), length)


def _mapped(df: DataFrame, columns: list[str], function, schema: pa.Schema) -> DataFrame:
    """Each batch's columns, as lists, through a generator of record batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from function(*(batch.column(k).to_pylist() for k in range(len(columns))))

    return small_batches(df).select(*columns).mapInArrow(run, from_arrow_schema(schema))


# ---- filters ---------------------------------------------------------------------------------

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = np.uint64(pow(_BASE, -1, 1 << 64))
_LETTER = mix64(np.arange(1, 257, dtype=np.uint64))
_SALTS = np.array([2 * int(x >> np.uint64(33)) + 1 for x in mix64(np.arange(1001, 1009, dtype=np.uint64))], dtype=np.uint32)


def _powers(length: int) -> np.ndarray:
    out = np.full(length, _BASE, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def _hashed(sums: np.ndarray, length: int) -> np.ndarray:
    return mix64(sums + np.uint64(length))


class Filters:
    """Where the blocks of each length's shard lie in one row of blocks, and the letters of each shard."""

    def __init__(self, shards: list):
        self.at: dict[int, tuple[int, int]] = {}
        self.letters: dict[int, np.ndarray] = {}
        self.blocks = 0
        for r in sorted(shards, key=lambda r: r["length"]):
            own = max(1, math.ceil(r["words"] * BITS / 256))
            self.at[r["length"]] = (self.blocks, own)
            self.letters[r["length"]] = np.array([64 * k + b for k in range(4) for b in range(64) if r[f"m{k}"] >> b & 1], np.uint8)
            self.blocks += own

    def probes(self, length: int) -> int:
        """Edits of a word of this length, at most."""
        return length * (1 + len(self.letters[length]))

    def block(self, hashes: np.ndarray, length: int) -> np.ndarray:
        first, own = self.at[length]
        return np.uint64(first) + ((hashes >> np.uint64(32)) * np.uint64(own) >> np.uint64(32))

    def known(self, hashes: np.ndarray, length: int, first: int, bits: np.ndarray) -> np.ndarray:
        """Places of the hashes that the blocks from ``first`` on hold; a hash whose block is elsewhere is in another round."""
        block = self.block(hashes, length).astype(np.int64) - first
        at = np.flatnonzero((block >= 0) & (block < len(bits)))
        low = hashes.astype(np.uint32)
        for k in range(8):
            at = at[bits[block[at], k] >> (low[at] * _SALTS[k] >> np.uint32(27)) & np.uint32(1) == 1]
        return at


def shards(words: DataFrame) -> Filters:
    """A row for each length goes to the driver: how many words it has, and a mask of their letters."""

    def run(codes: list[bytes]) -> Iterator[pa.RecordBatch]:
        rows = []
        for length, at, matrix in _by_length(codes):
            seen = np.isin(np.arange(256), matrix)
            masks = [sum(1 << int(b) for b in np.flatnonzero(seen[64 * k : 64 * k + 64])) for k in range(4)]
            rows.append((length, len(at), *(m - (1 << 64) if m >> 63 else m for m in masks)))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), SHARD)], schema=SHARD)

    found = _mapped(words, ["code"], run, SHARD)
    return Filters(found.groupBy("length").agg(F.sum("words").alias("words"), *(F.bit_or(f"m{k}").alias(f"m{k}") for k in range(4))).collect())


def filter_blocks(words: DataFrame, filters: Filters) -> DataFrame:
    """(block, b0 to b7): the blocks' bits, as Spark's bitwise or of what tasks set."""

    def run(codes: list[bytes]) -> Iterator[pa.RecordBatch]:
        blocks, bits = [], []
        for length, _, matrix in _by_length(codes):
            hashes = _hashed((_LETTER[matrix] * _powers(length)).sum(1, dtype=np.uint64), length)
            blocks.append(filters.block(hashes, length))
            bits.append(np.uint32(1) << (hashes.astype(np.uint32)[:, None] * _SALTS >> np.uint32(27)))
        if blocks:
            every, own = np.unique(np.concatenate(blocks), return_inverse=True)
            out = np.zeros((len(every), 8), np.uint32)
            np.bitwise_or.at(out, own, np.concatenate(bits))
            yield pa.RecordBatch.from_arrays([pa.array(every.astype(np.int64)), *(pa.array(np.ascontiguousarray(out[:, k]).view(np.int32)) for k in range(8))], schema=BLOCK)

    return _mapped(words, ["code"], run, BLOCK).groupBy("block").agg(*(F.bit_or(f"b{k}").alias(f"b{k}") for k in range(8)))


# ---- neighbours ------------------------------------------------------------------------------


def edits(matrix: np.ndarray, filters: Filters, first: int, bits: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows of ``matrix``, edited words) for the edits that the filters know.

    Deletions of the first of equal letters in a row, and replacements by a later letter: every pair of
    neighbours comes from one of its words, once.
    """
    n, length = matrix.shape
    powers, letters = _powers(length), filters.letters[length]
    shorter = length - 1 in filters.at
    step = max(1, PROBES // (n * (len(letters) + 1)))
    terms_before = np.zeros(n, np.uint64)
    whole = np.zeros(n, np.uint64)
    for j in range(0, length, step):
        whole += (_LETTER[matrix[:, j : j + step]] * powers[j : j + step]).sum(1, dtype=np.uint64)
    for j in range(0, length, step):
        part = matrix[:, j : j + step]
        terms = _LETTER[part] * powers[j : j + step]
        before = terms_before[:, None] + np.cumsum(terms, axis=1, dtype=np.uint64) - terms
        terms_before = terms_before + terms.sum(1, dtype=np.uint64)
        if shorter:
            old = matrix[:, j - 1 : j + part.shape[1] - 1] if j else np.concatenate([np.zeros((n, 1), np.uint8), part[:, :-1]], axis=1)
            row, at = np.nonzero(part != old)
            sums = before[row, at] + (whole[row] - before[row, at] - terms[row, at]) * _INVERSE
            hit = filters.known(_hashed(sums, length - 1), length - 1, first, bits)
            if len(hit):
                row, at = row[hit], at[hit] + j
                keep = np.ones((len(row), length), bool)
                keep[np.arange(len(row)), at] = False
                yield row, matrix[row][keep].reshape(len(row), length - 1)
        row, at, letter = np.nonzero(letters > part[:, :, None])
        new = _LETTER[letters] * powers[j : j + step, None]
        sums = (whole[:, None] - terms)[row, at] + new[at, letter]
        hit = filters.known(_hashed(sums, length), length, first, bits)
        if len(hit):
            row, at, letter = row[hit], at[hit] + j, letter[hit]
            changed = matrix[row]
            changed[np.arange(len(row)), at] = letters[letter]
            yield row, changed


def _binary(matrix: np.ndarray) -> pa.Array:
    """The rows of a matrix of bytes as binary values."""
    n, length = matrix.shape
    offsets = pa.py_buffer(np.arange(0, (n + 1) * length, length, dtype=np.int32))
    return pa.Array.from_buffers(pa.binary(), n, [None, offsets, pa.py_buffer(np.ascontiguousarray(matrix))])


def candidates(words: DataFrame, filters: Filters, first: int, held: Broadcast) -> DataFrame:
    """(near, code, n): edits of the words that the filters of this round know, a false positive now and then."""

    def run(codes: list[bytes], counts: list[int]) -> Iterator[pa.RecordBatch]:
        bits, n = held.value, np.array(counts, np.int64)
        for length, at, matrix in _by_length(codes):
            chunk = max(1, PROBES // filters.probes(length))
            for k in range(0, len(at), chunk):
                for row, edited in edits(matrix[k : k + chunk], filters, first, bits):
                    yield pa.RecordBatch.from_arrays([_binary(edited), _binary(matrix[k : k + chunk][row]), pa.array(n[at[k : k + chunk][row]])], schema=FOUND)

    return _mapped(words, ["code", "n"], run, FOUND)


def near_pairs(words: DataFrame, scratch: Scratch) -> list[DataFrame]:
    """Tables (code, n, near, near_n) of all pairs of ``words`` one edit apart, each pair once; one table for each round of filters.

    A round holds FILTER_BLOCKS blocks, and looks up the edits whose block it holds; so each edit is looked up
    once, whatever the vocabulary's size, and a filter is never fuller than planned.
    """
    spark, filters = words.sparkSession, shards(words)
    if not filters.blocks:
        return []
    blocks = scratch.written(filter_blocks(words, filters), "filters") if filters.blocks > FILTER_BLOCKS else filter_blocks(words, filters)
    work = sum(own * 256 // BITS * filters.probes(length) for length, (_, own) in filters.at.items())
    spread = words.repartition(max(spark.sparkContext.defaultParallelism, math.ceil(work / TASK_PROBES)), "code")
    out = []
    for first in range(0, filters.blocks, FILTER_BLOCKS):
        size = min(FILTER_BLOCKS, filters.blocks - first)
        rows = blocks.where(F.col("block").between(first, first + size - 1)).toArrow()
        bits = np.zeros((size, 8), np.uint32)
        at = rows.column("block").to_numpy() - first
        for k in range(8):
            bits[at, k] = rows.column(f"b{k}").to_numpy().view(np.uint32)
        del rows
        held = spark.sparkContext.broadcast(bits)
        exact = words.select(F.col("code").alias("near"), F.col("n").alias("near_n"))
        out.append(scratch.written(candidates(spread, filters, first, held).join(exact, "near").select("code", "n", "near", "near_n"), "near"))
        held.destroy()
    return out


def forms(words: DataFrame, pairs: list[DataFrame]) -> DataFrame:
    """(code, n, n_near, form, form_n): the near word that occurs most, if at least twice as often; of equal ones the first."""
    each = words.select("code", F.lit(0).alias("is_near"), F.lit(None).cast("long").alias("other_n"), F.lit(None).cast("binary").alias("other"), "n")
    for p in pairs:
        one = p.select("code", F.lit(1), F.col("near_n"), F.col("near"), F.lit(None).cast("long"))
        each = each.union(one).union(p.select("near", F.lit(1), F.col("n"), F.col("code"), F.lit(None).cast("long")))
    best = F.min(F.when(F.col("is_near") == 1, F.struct((-F.col("other_n")).alias("minus"), "other")))
    rows = each.groupBy("code").agg(F.max("n").alias("n"), F.sum("is_near").alias("n_near"), best.alias("best"))
    has = -F.col("best.minus") >= 2 * F.col("n")
    return rows.select("code", "n", "n_near", F.when(has, F.col("best.other")).alias("form"), F.when(has, -F.col("best.minus")).alias("form_n"))


def roots(found: DataFrame) -> DataFrame:
    """(code, root) of the words that have a form, by doubling the steps; a form occurs twice as often, so there are few."""
    now = written(found.where("form IS NOT NULL").select("code", F.col("form").alias("root"), F.lit(True).alias("moved")), "roots")
    while now.where("moved").head(1):
        on = now.select(F.col("code").alias("root"), F.col("root").alias("next"))
        new = written(now.join(on, "root", "left").select("code", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        dropped(now)
        now = new
    return now.select("code", "root")


def spelling_variants(docs: DataFrame) -> DataFrame:
    """(word, form, root, n, n_near, form_n): a row for each word of the texts.

    Words are runs of letters (A to Z in lower case, and the letters from U+00C0 to U+00FF as they are) of
    whole texts, less what the hash of document and word deletes, of LEAST_LENGTH code points and
    LEAST_COUNT occurrences or more.  Null and empty texts have none; a null doc_id is hashed as nothing; a
    repeated row counts again; words can be of any length.  An empty table gives no rows; columns besides
    doc_id and text are not read.
    """
    scratch = Scratch()
    words = scratch.written(vocabulary(docs), "vocabulary")
    found = written(forms(words, near_pairs(words, scratch)), "forms")
    scratch.drop()
    text = lambda c: F.decode(c, "ISO-8859-1")
    rows = found.join(roots(found), "code", "left")
    return rows.select(text("code").alias("word"), text("form").alias("form"), text(F.coalesce("root", "code")).alias("root"), "n", "n_near", "form_n")


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"))


#: The checksum's table is made by its rule; neighbours meet in the words with one code point cut out or masked.
ORACLE = """
WITH RECURSIVE t AS (SELECT list_transform(range(256), lambda n: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n)) AS crc),
found AS (SELECT doc_id, word, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) AS word FROM documents) d GROUP BY ALL),
bytes AS (SELECT *, flatten(list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || word, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)] ELSE [192 + unicode(c) // 64, 128 + unicode(c) % 64] END)) AS b FROM found),
hashed AS (SELECT word, n, xor(list_reduce(b, lambda c, x: xor(c >> 8, crc[(xor(c, x) & 255) + 1]), 4294967295), 4294967295) AS h FROM bytes, t),
words AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (SELECT CASE WHEN h % 97 = 0 THEN substr(word, 1, h % length(word)) || substr(word, h % length(word) + 2) ELSE word END AS word, n FROM hashed) w WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
places AS (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM words),
keys AS (SELECT word, substr(word, 1, i - 1) || '*' || substr(word, i + 1) AS key FROM places UNION ALL SELECT DISTINCT word, substr(word, 1, i - 1) || substr(word, i + 1) FROM places),
pairs AS (SELECT a.word, b.word AS near FROM keys a JOIN keys b ON a.key = b.key AND a.word <> b.word AND contains(a.key, '*')
  UNION SELECT a.word, a.key FROM keys a JOIN words w ON w.word = a.key UNION SELECT a.key, a.word FROM keys a JOIN words w ON w.word = a.key),
best AS (SELECT p.word, count(*) AS n_near, arg_max(near, struct_pack(n := v.n, m := list_transform(string_split(near, ''), lambda c: -unicode(c)))) AS near, max(v.n) AS near_n FROM pairs p JOIN words v ON v.word = near GROUP BY p.word),
forms AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 2 * w.n THEN near END AS form, CASE WHEN near_n >= 2 * w.n THEN near_n END AS form_n FROM words w LEFT JOIN best b ON b.word = w.word),
steps AS (SELECT word, form, word AS root FROM forms UNION ALL SELECT s.word, f.form, f.word FROM steps s JOIN forms f ON f.word = s.form)
SELECT f.word, f.form, s.root, f.n, f.n_near, f.form_n FROM forms f JOIN steps s ON s.word = f.word AND s.form IS NULL
"""
