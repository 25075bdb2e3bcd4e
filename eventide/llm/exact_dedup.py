"""Exact dedup with Patricia tries as owners of texts.

Texts are compared with white space normalised.  A first trie in every map task folds
equal texts of that task, so that a text with a third of all rows leaves each task once.
Partitions by length and content hash then insert the full byte strings into compressed
radix tries; a terminal node keeps the smallest identifier and the count.  A trie that
outgrows its memory spills whole subtrees, which are finished one after another.
"""

from __future__ import annotations

import hashlib
import heapq
import os
import pickle
import re
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from .common import CHUNK_BYTES, byte_texts, fresh, small_batches, table, written

#: Bytes of strings that a trie keeps before it spills its largest subtree.
TRIE_BYTES = 96 << 20
#: Bytes of strings in the map-side trie before its texts are sent on.
MAP_BYTES = 32 << 20
#: Bytes of a spilled subtree that wait for the next write to its file.
SPILL_BUFFER = 1 << 20

_SPACE = re.compile(rb"[\x20\x09-\x0D]+")
_ODD = re.compile(rb"[\x09-\x0D]|  ")


def normalised(text: bytes) -> bytes:
    return _SPACE.sub(b" ", text) if _ODD.search(text) else text


class _Node:
    __slots__ = ("children", "edge", "value")

    def __init__(self, edge: bytes, value=None):
        self.edge, self.children, self.value = edge, {}, value


class _Spilled:
    """A subtree's keys, without what leads to it, in a file of this task; only the last ones are in memory."""

    def __init__(self, path: str):
        self.path, self.rows, self.size = path, [], 0

    def add(self, key: bytes, value) -> None:
        self.rows.append((key, value))
        self.size += len(key) + 64
        if self.size > SPILL_BUFFER:
            self.flush()

    def flush(self) -> None:
        with open(self.path, "ab") as out:
            for row in self.rows:
                pickle.dump(row, out, pickle.HIGHEST_PROTOCOL)
        self.rows, self.size = [], 0

    def read(self) -> Iterator[tuple[bytes, object]]:
        self.flush()
        with open(self.path, "rb") as file:
            while file.peek(1):
                yield pickle.load(file)

    def shared(self) -> bytes:
        """The longest prefix of all its keys."""
        found = None
        for key, _ in self.read():
            found = key if found is None else found[: _common(found, key, 0)]
            if not found:
                break
        return found or b""


def _merged(old, new):
    """Values are (smallest id, count, payload, rows with the smallest id); None ids never win."""
    if old is None:
        return new
    if old[0] == new[0]:
        return (old[0], old[1] + new[1], old[2], old[3] + new[3])
    a, b = (old, new) if new[0] is None or (old[0] is not None and old[0] < new[0]) else (new, old)
    return (a[0], a[1] + b[1], a[2], a[3])


class PatriciaTrie:
    """Byte strings to values; common prefixes are stored once, an edge holds a whole run of bytes.

    Beyond ``max_bytes`` of edges, whole subtrees, at any depth, move to files, and later keys that
    reach such a subtree follow.  Files are read back one after another into tries of their own, without the
    prefix that all their keys share, so each holds fewer different keys than the one it came from,
    however long the keys and what they share.
    """

    def __init__(self, max_bytes: int = TRIE_BYTES):
        self.root, self.bytes, self.max_bytes = _Node(b""), 0, max_bytes
        self.folder: tempfile.TemporaryDirectory | None = None
        self.files = 0

    def insert(self, key: bytes, value) -> None:
        node, at = self.root, 0
        while True:
            if at == len(key):
                node.value = _merged(node.value, value)
                break
            child = node.children.get(key[at])
            if child is None:
                node.children[key[at]] = _Node(key[at:], value)
                self.bytes += len(key) - at
                break
            if isinstance(child, _Spilled):
                child.add(key[at:], value)
                return
            edge = child.edge
            if key.startswith(edge, at):
                node, at = child, at + len(edge)
                continue
            n = _common(edge, key, at)
            middle = _Node(edge[:n])
            child.edge = edge[n:]
            middle.children[child.edge[0]] = child
            node.children[key[at]] = middle
            node, at = middle, at + n
        if self.bytes > self.max_bytes:
            self._spill()

    def _spill(self) -> None:
        """Moves the largest subtrees to files until half of the room is free.

        A subtree that holds over half of it, or has files below, is opened instead; only where that
        frees too little do subtrees take in the files below them.
        """
        sizes, deep = {}, set()
        for node in reversed(list(_nodes(self.root))):
            below = node.children.values()
            sizes[id(node)] = len(node.edge) + sum(sizes[id(c)] for c in below if isinstance(c, _Node))
            if any(isinstance(c, _Spilled) or id(c) in deep for c in below):
                deep.add(id(node))
        for merging in (False, True):
            open_: list[tuple] = []

            def opened(node: _Node, open_=open_):
                for first, c in node.children.items():
                    if isinstance(c, _Node):
                        heapq.heappush(open_, (-sizes[id(c)], id(c), first, node, c))

            opened(self.root)
            while open_ and self.bytes > self.max_bytes // 2:
                size, _, first, parent, node = heapq.heappop(open_)
                if not merging and id(node) in deep or -size > self.max_bytes // 2 and node.children:
                    opened(node)
                    continue
                parent.children[first] = self._written(node)
                self.bytes += size
            if self.bytes <= self.max_bytes:
                return

    def _written(self, top: _Node) -> _Spilled:
        self.folder = self.folder or tempfile.TemporaryDirectory(dir=os.environ.get("TMPDIR"))
        self.files += 1
        out = _Spilled(f"{self.folder.name}/{self.files}")
        for key, node in _walk(b"", top):
            if node.value is not None:
                out.add(key, node.value)
            for c in node.children.values():
                if isinstance(c, _Spilled):
                    for rest, value in c.read():
                        out.add(key + rest, value)
                    os.remove(c.path)
        return out

    def items(self) -> Iterator[tuple[bytes, tuple]]:
        """All keys and values, once; the trie is empty afterwards."""
        todo: list[tuple[bytes, _Spilled]] = []
        trie, before = self, b""
        try:
            while True:
                for key, node in _walk(before, trie.root):
                    if node.value is not None:
                        yield key, node.value
                    todo += [(key, c) for c in node.children.values() if isinstance(c, _Spilled)]
                trie.root, trie.bytes = _Node(b""), 0
                if not todo:
                    return
                before, file = todo.pop()
                shared = file.shared()
                trie = PatriciaTrie(self.max_bytes)
                trie.folder, trie.files = self.folder, self.files
                for key, value in file.read():
                    trie.insert(key[len(shared) :], value)
                self.files = trie.files
                os.remove(file.path)
                before += shared
        finally:
            if self.folder:
                self.folder.cleanup()
                self.folder = None


def _walk(prefix: bytes, node: _Node):
    todo = [(prefix, node)]
    while todo:
        key, node = todo.pop()
        key += node.edge
        yield key, node
        todo += [(key, c) for c in node.children.values() if isinstance(c, _Node)]


def _nodes(node: _Node):
    todo = [node]
    while todo:
        node = todo.pop()
        yield node
        todo += [c for c in node.children.values() if isinstance(c, _Node)]


def _common(edge: bytes, key: bytes, at: int) -> int:
    """Length of the common prefix of edge and key[at:], found by halving."""
    low, high = 0, min(len(edge), len(key) - at)
    while low < high:
        middle = (low + high + 1) // 2
        if edge[low:middle] == key[at + low : at + middle]:
            low = middle
        else:
            high = middle - 1
    return low


ROW = pa.schema([("doc_id", pa.int64()), ("size", pa.int64()), ("sha", pa.binary())])
PART = pa.schema([("size", pa.int64()), ("sha", pa.binary()), ("body", pa.binary()), ("least", pa.int64()), ("n", pa.int64()), ("same", pa.int64())])
OWNER = pa.schema([("size", pa.int64()), ("sha", pa.binary()), ("keep_id", pa.int64()), ("group_size", pa.int64()), ("same", pa.int64())])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [normalised(t) for t in byte_texts(batch.column(1))]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).cast(pa.int64()), pa.array(map(len, texts), pa.int64()), pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary())], schema=ROW
        )


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Equal texts of this task become one row."""

    def sent(trie: PatriciaTrie):
        rows, size = [], 0
        for key, (least, n, _, same) in trie.items():
            rows.append((len(key), hashlib.sha256(key).digest(), key, least, n, same))
            size += len(key)
            if size > CHUNK_BYTES:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), PART)], schema=PART)
                rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), PART)], schema=PART)

    trie = PatriciaTrie(1 << 62)
    for batch in batches:
        for i, text in zip(batch.column(0).to_pylist(), byte_texts(batch.column(1)), strict=True):
            trie.insert(normalised(text), (i, 1, None, 1))
            if trie.bytes > MAP_BYTES:
                yield from sent(trie)
                trie = PatriciaTrie(1 << 62)
    yield from sent(trie)


def _own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The tries of one partition: full strings decide, terminal nodes hold the smallest id."""
    trie = PatriciaTrie()
    for batch in batches:
        columns = [batch.column(i).to_pylist() for i in range(5)]
        for sha, body, least, n, same in zip(*columns, strict=True):
            trie.insert(body, (least, n, sha, same))
    rows = []
    for key, (least, n, sha, same) in trie.items():
        rows.append((len(key), sha, least, n, same))
        if len(rows) == 20_000:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), OWNER)], schema=OWNER)
            rows = []
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), OWNER)], schema=OWNER)


def text_owners(docs: DataFrame) -> DataFrame:
    """One row for each distinct normalised text: its length and SHA-256, its smallest doc_id, and how many rows have it, and have that id too."""
    parts = small_batches(docs).select("doc_id", "text").mapInArrow(_fold, from_arrow_schema(PART))
    placed = parts.repartition(F.col("size"), F.col("sha")).select("sha", "body", "least", "n", "same")
    return placed.mapInArrow(_own, from_arrow_schema(OWNER))


def exact_dedup(docs: DataFrame) -> DataFrame:
    """One row for each row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    A null text counts as empty.  Of rows that share both text and smallest doc_id, all are kept
    (the id stays, not one of its repetitions).  A null doc_id is the smallest of its
    group only if the group has no other; then keep_id is null and the row is kept.  Texts may be of
    any length and share heads of any length.
    An empty table gives no rows; of the columns only doc_id and text are read, so others may have any names.
    """
    rows = small_batches(docs).select("doc_id", "text").mapInArrow(_digests, from_arrow_schema(ROW))
    return (
        rows.join(text_owners(docs), ["size", "sha"])
        .select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))
    )


def drop_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; of a row that is repeated, one.

    The owners are stored first; they tell whether any row is repeated, and only then are rows
    compared with each other.
    """
    body = F.regexp_replace(F.coalesce(F.col("text"), F.lit("")), r"[\x20\x09-\x0D]+", " ")
    owners = written(text_owners(docs), "owners")
    key, owner = fresh("key", docs), fresh("owner", docs)
    kept = owners.select(F.col("keep_id").alias(owner), F.lower(F.hex("sha")).alias(key + "_"))
    keyed = docs.withColumn(key, F.sha2(body, 256))
    out = keyed.join(kept, keyed["doc_id"].eqNullSafe(kept[owner]) & (keyed[key] == kept[key + "_"]), "left_semi")
    if owners.where("same > 1").head(1):
        out = out.dropDuplicates(["doc_id", key])
    return out.drop(key)


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS body FROM documents),
g AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY body) AS keep_id, count(*) OVER (PARTITION BY body) AS group_size, sha256(body) AS text_sha256 FROM n)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM g
"""
