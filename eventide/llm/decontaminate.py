"""Benchmark decontamination by the q-gram lemma.

Items and texts are lower-cased, what is no letter or digit becomes one space, and characters
are the bytes of UTF-8.  An item's windows are the patterns.  A place within k edits of a
pattern of length m shares at least m - q + 1 - k * q q-grams with it, on diagonals that lie at
most k apart.  So shared q-grams are counted in overlapping diagonal bands, bands that reach
the bound are kept, and a banded alignment verifies each of them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from .common import Scratch, dropped, keep_rows, map_texts, table, written
from .license_scan import WORD_BYTES

#: Characters of a q-gram; they fill one 64-bit number.
Q = 8
#: Characters of a window of an item, and between the starts of two windows.
WINDOW, STRIDE = 160, 80
#: Edits for each character that a match may have.
RATE = 0.1
#: Bytes of benchmark text in a block, of which a worker makes one index; that has about 40 bytes for each, and takes 230 while it is made.
BLOCK_BYTES = 1 << 20
#: Blocks that one pass over the documents looks for.
PASS_BLOCKS = 4
#: log2 of the filter's places: at least, and at most, where it has eight for each q-gram.
FILTER, FILTER_MOST = 20, 25
#: A q-gram that stands more often is left out where the bound can spare it; so many are always needed.
FREQUENT, NEEDED = 256, 4
#: A q-gram that more patterns have at the same place is counted for groups of them.
SHARED = 32
#: Hits that are counted at once, about, and bytes of text whose q-grams are looked up at once.
HITS = 1 << 20
SEGMENT = 1 << 19

MATCHES = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("windows", pa.int64()), ("matched", pa.int64()), ("errors", pa.int64()), ("start", pa.int64()), ("stop", pa.int64())])


def normalised(text: bytes) -> bytes:
    return b" ".join(text.translate(WORD_BYTES).split())


def windows(text: bytes) -> list[bytes]:
    """Overlapping windows that cover a normalised item; the item itself if it is short."""
    if len(text) <= WINDOW:
        return [text] if text else []
    starts = [*range(0, len(text) - WINDOW, STRIDE), len(text) - WINDOW]
    return [text[i : i + WINDOW] for i in starts]


def grams(text: np.ndarray) -> np.ndarray:
    """The q-gram at each position as a number."""
    n = len(text) - Q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    return np.ndarray((n,), "<u8", text, strides=(1,)).copy()


def _distinct(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    return x[np.concatenate(([True], np.diff(x) != 0))[: len(x)]]


def _pieces(rows: np.ndarray) -> np.ndarray:
    """16-bit hashes of all three characters that follow each other in each row."""
    x = rows.astype(np.uint32)
    x = x[:, :-2] | x[:, 1:-1] << np.uint32(8) | x[:, 2:] << np.uint32(16)
    return (x * np.uint32(2654435761) >> np.uint32(16)).astype(np.uint16)


def align(patterns: np.ndarray, sizes: np.ndarray, budgets: np.ndarray, text: np.ndarray, lows: np.ndarray, band: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(errors, start, end) of each pattern's best place on the ``band`` diagonals from ``lows`` on.

    One row of the alignment is computed for all patterns at once, and only the cells of the
    band.  The place may begin anywhere; its start is carried along.  Errors beyond the budget
    are only known to be beyond it.
    """
    n, steps = len(sizes), np.arange(band)
    row = np.zeros((n, band), np.int64)
    errors, starts, ends = np.full(n, 1 << 30), np.zeros(n, np.int64), np.zeros(n, np.int64)
    begin = lows[:, None] + steps
    alive = np.arange(n)
    for i in range(int(sizes.max(initial=0))):
        at = lows[alive, None] + i + steps
        inside = (at >= 0) & (at < len(text))
        cell = np.where(inside, text[np.clip(at, 0, len(text) - 1)], 0)
        same = row + (cell != patterns[alive, i, None])
        skip = np.concatenate([row[:, 1:] + 1, np.full((len(alive), 1), 1 << 20)], 1)
        best = np.minimum(same, skip)
        start = np.where(same <= skip, begin, np.concatenate([begin[:, 1:], begin[:, -1:]], 1))
        shifted = np.minimum.accumulate(best - steps, 1)
        source = np.maximum.accumulate(np.where(best - steps == shifted, steps, 0), 1)
        row = shifted + steps
        begin = np.take_along_axis(start, source, 1)
        over = sizes[alive] == i + 1
        if over.any():
            d = row[over].argmin(1)
            errors[alive[over]] = row[over, d]
            starts[alive[over]] = begin[over, d]
            ends[alive[over]] = lows[alive[over]] + i + 1 + d
        stay = ~over & (row.min(1) <= budgets[alive])
        if not stay.all():
            row, begin, alive = row[stay], begin[stay], alive[stay]
            if not len(alive):
                break
    return errors, starts, ends


class Index:
    """q-grams of all windows of a block of items.

    Two things keep common q-grams from multiplying with the patterns that have them.  A pattern leaves out its
    most frequent q-grams, as many as its bound can spare, and its bound falls by as many.
    Patterns that share frequent q-grams at the same places, such as the opening of a question,
    count these once, as a group.
    """

    def __init__(self, items: list[tuple[int, bytes]], frequent: int = FREQUENT, shared: int = SHARED):
        self.items = [i for i, _ in items]
        self.counts, self.short = [], []
        owners: dict[bytes, dict[int, int]] = {}
        for at, (_, text) in enumerate(items):
            parts = windows(normalised(text))
            self.counts.append(len(parts))
            for part in parts:
                if len(part) < Q:
                    self.short.append((at, b" " + part + b" "))
                else:
                    mine = owners.setdefault(part, {})
                    mine[at] = mine.get(at, 0) + 1
        self.patterns, self.owners = list(owners), list(owners.values())
        self.sizes = sizes = np.array([len(p) for p in self.patterns], np.int64)
        self.matrix = np.array([list(p.ljust(WINDOW, b"\0")) for p in self.patterns], np.uint8).reshape(-1, WINDOW)
        self.budget = np.minimum((sizes * RATE).astype(np.int64), (sizes - Q) // Q)
        self.least = sizes - Q + 1 - self.budget * Q
        g = [grams(np.frombuffer(p, np.uint8)) for p in self.patterns]
        keys = np.concatenate([np.zeros(0, np.uint64), *g])
        owner = np.repeat(np.arange(len(g)), [len(x) for x in g])
        place = np.concatenate([np.zeros(0, np.int64), *(np.arange(len(x)) for x in g)])
        keys, owner, place = self._spare(keys, owner, place, frequent)
        keys, owner, place = self._merge(keys, owner, place, shared)
        order = np.argsort(keys, kind="stable")
        self.keys, self.starts = np.unique(keys[order], return_index=True)
        self.starts = np.append(self.starts, len(keys))
        self.owner, self.place = owner[order].astype(np.int32), place[order].astype(np.int16)
        self.shift = np.uint64(64 - min(max(FILTER, (8 * len(self.keys)).bit_length()), FILTER_MOST))
        self.filter = np.zeros(1 << (64 - int(self.shift)), bool)
        self.filter[self._slot(self.keys)] = True

    def _spare(self, keys: np.ndarray, owner: np.ndarray, place: np.ndarray, frequent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Leaves out frequent q-grams; what a pattern still needs of the others is ``need``."""
        _, inverse, count = np.unique(keys, return_inverse=True, return_counts=True)
        often = count[inverse] if len(keys) else count
        order = np.lexsort((place, keys, -often, owner))
        first = np.searchsorted(owner[order], np.arange(len(self.sizes)))
        rank = np.arange(len(order)) - np.repeat(first, np.diff(np.append(first, len(order))))
        spared = np.zeros(len(keys), bool)
        spared[order] = (often[order] > frequent) & (rank < self.least[owner[order]] - NEEDED)
        self.need = self.least - np.bincount(owner[spared], minlength=len(self.sizes))
        return keys[~spared], owner[~spared], place[~spared]

    def _merge(self, keys: np.ndarray, owner: np.ndarray, place: np.ndarray, shared: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Makes groups of patterns with the same q-grams at the same places, of those that many patterns have; groups count as further owners."""
        wide = self.budget[owner]
        order = np.lexsort((wide, place, keys))
        new = np.concatenate(([True], (np.diff(keys[order]) != 0) | (np.diff(place[order]) != 0) | (np.diff(wide[order]) != 0)))[: len(order)]
        number = np.empty(len(keys), np.int64)
        number[order] = np.cumsum(new) - 1
        common = np.bincount(number, minlength=1)[number] > shared if len(keys) else np.zeros(0, bool)
        held = np.flatnonzero(common)
        held = held[np.lexsort((number[held], owner[held]))]
        cuts = np.flatnonzero(np.diff(owner[held])) + 1
        profiles: dict[bytes, list[np.ndarray]] = {}
        for part in np.split(held, cuts) if len(held) else []:
            profiles.setdefault(number[part].tobytes(), []).append(part)
        n, alone = len(self.sizes), ~common
        self.group = np.full(n, -1)
        self.members: list[np.ndarray] = []
        added = []
        for parts in profiles.values():
            if len(parts) < 2:
                alone[parts[0]] = True
                continue
            mine = owner[[p[0] for p in parts]]
            self.group[mine] = len(self.members)
            added.append((keys[parts[0]], np.full(len(parts[0]), n + len(self.members)), place[parts[0]]))
            self.members.append(mine)
        self.wide = np.concatenate([self.budget, [self.budget[m[0]] for m in self.members]]).astype(np.int64) + 1
        self.fewest = np.array([self.need[m].min() for m in self.members], np.int64)
        grouped = np.flatnonzero(self.group >= 0)
        self.row = np.full(n, -1)
        self.row[grouped] = np.arange(len(grouped))
        self.pieces = _pieces(self.matrix[grouped])
        self.whole = np.arange(WINDOW - 2) < self.sizes[grouped, None] - 2
        parts = [(keys[alone], owner[alone], place[alone]), *added]
        return tuple(np.concatenate([p[i] for p in parts]) for i in range(3))

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift

    def _hits(self, text: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Sorted numbers of (owner, band) and how many q-grams are shared there; a bounded number of hits at a time."""
        found, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if not len(self.keys):
            return found, counts
        for base in range(0, len(text) - Q + 1, SEGMENT):
            g = grams(text[base : base + SEGMENT + Q - 1])
            at = np.flatnonzero(self.filter[self._slot(g)])
            slot = np.minimum(np.searchsorted(self.keys, g[at]), len(self.keys) - 1)
            true = self.keys[slot] == g[at]
            at, slot = at[true] + base, slot[true]
            n = self.starts[slot + 1] - self.starts[slot]
            turns = np.cumsum(n) // HITS
            cuts = [0, *(np.flatnonzero(np.diff(turns)) + 1).tolist(), len(n)]
            for low, high in zip(cuts, cuts[1:]):
                few, some = n[low:high], slot[low:high]
                each = np.arange(few.sum()) - np.repeat(np.cumsum(few) - few, few) + np.repeat(self.starts[some], few)
                owner = self.owner[each].astype(np.int64)
                diagonal = np.repeat(at[low:high], few) - self.place[each] + WINDOW
                key, count = np.unique(owner * size + diagonal // self.wide[owner] + 1, return_counts=True)
                if len(found):
                    key, inverse = np.unique(np.concatenate([found, key]), return_inverse=True)
                    count = np.bincount(inverse, np.concatenate([counts, count])).astype(np.int64)
                found, counts = key, count
        return found, counts

    def regions(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The pattern and first diagonal of each pair of bands that reaches its bound."""
        size = len(text) + 2 * WINDOW + 4
        keys, counts = self._hits(text, size)

        def of(key: np.ndarray) -> np.ndarray:
            i = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            return np.where(keys[i] == key, counts[i], 0)

        if not len(keys):
            return keys, keys
        n = len(self.sizes)
        end = int(np.searchsorted(keys, n * size))
        near = np.zeros_like(counts)
        joined = np.flatnonzero(keys[1:] == keys[:-1] + 1)
        near[joined] = counts[joined + 1]
        pattern = keys[:end] // size
        alone = self.group[pattern] < 0
        good = alone & (counts[:end] + near[:end] >= self.need[pattern])
        pairs = [(pattern[good], keys[:end][good] % size)]
        own = keys[:end][~alone]
        start = _distinct(np.concatenate([own, own - 1]))
        pattern, band = start // size, start % size
        both = (n + self.group[pattern]) * size + band
        good = of(start) + of(start + 1) + of(both) + of(both + 1) >= self.need[pattern]
        pairs.append((pattern[good], band[good]))
        start = _distinct(np.concatenate([keys[end:], keys[end:] - 1]))
        total = of(start) + of(start + 1)
        enough = total >= self.fewest[start // size - n]
        places: dict[tuple[int, int], list[np.ndarray]] = {}
        for key, count in zip(start[enough].tolist(), total[enough].tolist(), strict=True):
            mine = self.members[key // size - n]
            places.setdefault((int(self.wide[key // size]), key % size), []).append(mine[self.need[mine] <= count])
        for (_, band), mine in places.items():
            mine = self._likely(np.concatenate(mine), text, band)
            pairs.append((mine, np.full(len(mine), band)))
        found = _distinct(np.concatenate([p * size + b for p, b in pairs]))
        p = found // size
        return p, (found % size - 1) * self.wide[p] - WINDOW

    def _likely(self, patterns: np.ndarray, text: np.ndarray, band: int) -> np.ndarray:
        """Those, all of one budget, whose pieces of three characters stand near the band as often as the budget demands."""
        if not len(patterns):
            return patterns
        wide, k = int(self.wide[patterns[0]]), int(self.budget[patterns[0]])
        low = (band - 1) * wide - WINDOW
        there = np.zeros(1 << 16, bool)
        there[_pieces(text[None, max(0, low - k) : max(0, low + 2 * wide + int(self.sizes[patterns].max()) + k)])] = True
        rows = self.row[patterns]
        return patterns[(there[self.pieces[rows]] & self.whole[rows]).sum(1) >= self.sizes[patterns] - 2 - 3 * k]

    def matches(self, texts: list[bytes]) -> list[dict[int, list]]:
        """For each normalised text: item -> [windows that match, fewest errors, start, stop]."""
        out: list[dict] = [{} for _ in texts]
        joined = np.frombuffer((b"\0" * WINDOW).join(texts), np.uint8)
        starts = np.cumsum([0, *(len(t) + WINDOW for t in texts)])
        seen: set[tuple[int, int]] = set()
        patterns, diagonals = self.regions(joined)
        for at in range(0, len(patterns), 2048):
            p, d = patterns[at : at + 2048], diagonals[at : at + 2048]
            k = self.budget[p]
            errors, lows, highs = align(self.matrix[p], self.sizes[p], k, joined, d - k, int(4 * k.max() + 3))
            for i in np.flatnonzero(errors <= k).tolist():
                where = int(np.searchsorted(starts, (lows[i] + highs[i]) // 2, "right")) - 1
                base, q = int(starts[where]), int(p[i])
                new = (where, q) not in seen
                seen.add((where, q))
                for owner, times in self.owners[q].items():
                    item = out[where].setdefault(owner, [0, int(errors[i]), int(lows[i]) - base, 0])
                    item[0] += times * new
                    item[1] = min(item[1], int(errors[i]))
                    item[2] = max(0, min(item[2], int(lows[i]) - base))
                    item[3] = max(item[3], min(int(highs[i]) - base, len(texts[where])))
        for at, word in self.short:
            for where, text in enumerate(texts):
                i = (b" " + text + b" ").find(word)
                if i >= 0:
                    out[where][at] = [1, 0, i, i + len(word) - 2]
        return out


def item_blocks(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(block, item_id, text, times): the items in blocks of about ``block_bytes``; a repeated item is one with a number of times."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text IS NOT NULL").groupBy("item_id", "text").agg(F.count("*").alias("times"))
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(max(1, -(-total // block_bytes)))).cast("int"))


class _Passes:
    """Groups of blocks.  The driver sends the texts of one group's items at a time; workers build the indexes, each once."""

    def __init__(self, benchmark: DataFrame, block_bytes: int):
        self.context, self.scratch = benchmark.sparkSession.sparkContext, Scratch()
        self.items = self.scratch.written(item_blocks(benchmark, block_bytes), "leak-items")
        blocks = sorted(r["block"] for r in self.items.select("block").distinct().collect())
        self.groups = [blocks[i : i + PASS_BLOCKS] for i in range(0, len(blocks), PASS_BLOCKS)]
        self.sent: list = []

    def __iter__(self):
        """For each pass a function of normalised texts: (index, its matches of each text)."""
        for group in self.groups:
            self.sent = [self.context.broadcast([tuple(r) for r in self.items.where(F.col("block") == b).select("item_id", "text", "times").collect()]) for b in group]

            def found(texts: list[bytes], sent=tuple(self.sent)) -> list[tuple[Index, list[dict]]]:
                return [(index, index.matches(texts)) for index in map(_built, sent)]

            yield found

    def over(self) -> None:
        """The pass is stored: tasks need its blocks no more."""
        for b in self.sent:
            b.destroy()
        self.sent = []


def _built(sent: Broadcast) -> Index:
    """A block's index, made once in a worker; it stays as long as the broadcast."""
    if not hasattr(sent, "index"):
        held = sorted(sent.value, key=lambda x: (x[0] is None, x[0] or 0, x[1]))
        sent.index = Index([(i, t.encode()) for i, t, _ in held])
        sent.index.times = [n for *_, n in held]
        del sent._value
    return sent.index


def find_leaks(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row for each row of ``docs`` and item that it holds: windows of the item, how many match, fewest errors, span.

    The span counts bytes of the normalised text.  Null and empty texts and items match nothing;
    items shorter than a q-gram must stand there exactly, as whole words.  Repeated rows and ids
    of documents repeat in the result.  An empty benchmark, or an empty table of documents, gives no rows.  An item that is repeated
    under one item_id counts each time.  Texts may be of any length; items that share an opening
    cost no more than those that don't until a text has what distinguishes them.  Only doc_id and text (item_id and text) are read.

    The documents are read once for each PASS_BLOCKS blocks of benchmark text, and every pass is stored.
    """
    passes, parts = _Passes(benchmark, block_bytes), []
    for find in passes:

        def run(_, ids, texts, find=find):
            rows = []
            for index, every in find([normalised(t) for t in texts]):
                for doc, found in zip(ids, every, strict=True):
                    rows += [(doc, index.items[at], index.counts[at], *x) for at, x in sorted(found.items()) for _ in range(index.times[at])]
            return {f.name: [r[i] for r in rows] for i, f in enumerate(MATCHES)}

        parts.append(written(map_texts(docs, run, MATCHES), "leaks"))
        passes.over()
    passes.scratch.drop()
    if not parts:
        return docs.sparkSession.createDataFrame([], from_arrow_schema(MATCHES))
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out


def drop_leaks(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item, with all their columns; what a pass keeps is stored for the next one."""
    passes, last = _Passes(benchmark, block_bytes), None
    for find in passes:
        kept = written(keep_rows(docs, lambda texts, find=find: [not any(x) for x in zip(*(every for _, every in find([normalised(t) for t in texts])))]), "unleaked")
        passes.over()
        if last is not None:
            dropped(last)
        docs = last = kept
    passes.scratch.drop()
    return docs


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
