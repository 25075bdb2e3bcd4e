"""Cost-balanced packing of documents into token sequences.

A document's ids are cut into pieces of at most the capacity.  Pieces are dealt into cells by a
hash of what they are and of how often that has come before, so that repeated rows spread too; in a cell, the cost of a piece is estimated as linear plus quadratic (attention), and
pieces, longest first, go to the sequence of lowest cost that still has room for them.
Cells hold thousands of pieces, so no task sees all of them.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_texts, table, written

CAPACITY = 4096
END_ID = 2
TOKENIZER = "word_bpe_49k.json"
#: Cost of a piece of n ids: LINEAR * n + QUADRATIC * n * n.
LINEAR, QUADRATIC = 1.0, 1.0 / 8192
#: Pieces in a cell, about.
CELL = 4096
#: Words whose ids a worker remembers.
REMEMBERED = 800_000
#: Texts with one of these go through the tokenizer whole: odd white space, a letter whose lower case is two, special tokens.
ODD = ("\x1c", "\x1d", "\x1e", "\x1f", "\x85", "\xa0", "\u0130", "<|")

#: Kinds of pieces whose repetitions a task counts before it begins anew.
COUNTED = 200_000

PIECES = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("turn", pa.int64())])
PACKED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class WordTokenizer:
    """The ids of a word BPE as little-endian unsigned 32-bit numbers, remembered by word.

    The tokenizer splits text before its merges, so that a word has the same ids in every text.
    Texts with characters whose case or normal form depends on their neighbours, and texts with
    special tokens, go through the tokenizer whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        low = [chr(c) for c in range(0x300)]
        letters = re.escape("".join(c for c in low if unicodedata.category(c)[0] == "L"))
        digits = re.escape("".join(c for c in low if unicodedata.category(c)[0] == "N"))
        self.words = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{digits}]|[^\\s{letters}{digits}]+").findall
        self.far = re.compile("[^\x00-\u02ff]").search
        self.known: dict[str, bytes] = {}
        size = self.tokenizer.get_vocab_size()
        self.ends = np.array([str(self.tokenizer.id_to_token(i)).endswith("</w>") for i in range(size)])

    def odd(self, text: str) -> bool:
        """Whether a text has to go through the tokenizer whole."""
        if any(map(text.__contains__, ODD)):
            return True
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return self.far(text) is not None
        return False

    def learn(self, words: list[str]) -> None:
        """The ids of new words, which the tokenizer sees in one line; a word's last token is marked as such."""
        for at in range(0, len(words), 20_000):
            some = words[at : at + 20_000]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, "<u4")
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) != len(some):
                raise ValueError("a word has no last token")
            raw, stops = ids.tobytes(), (stops * 4).tolist()
            self.known.update(zip(some, map(raw.__getitem__, map(slice, [0, *stops], stops)), strict=False))

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text.  Words that are not known yet are learnt together."""
        if len(self.known) > REMEMBERED:
            self.known.clear()
        out: list = [None] * len(texts)
        split, new, get = {}, set(), self.known.get
        for i, t in enumerate(texts):
            if self.odd(t):
                out[i] = np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes()
                continue
            words = self.words(t.lower())
            ids = list(map(get, words))
            gaps = []
            if None in ids:
                gaps = [k for k, x in enumerate(ids) if x is None]
                words = [words[k] for k in gaps]
                new.update(words)
            split[i] = ids, gaps, words
        self.learn(list(new))
        for i, (ids, gaps, words) in split.items():
            for k, w in zip(gaps, words, strict=False):
                ids[k] = self.known[w]
            out[i] = b"".join(ids)
        return out


@lru_cache(2)
def _tokenizer(name: str) -> WordTokenizer:
    import os

    import public_tokenizers

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return WordTokenizer(name if "/" in name else public_tokenizers.path(name))


def tokenized_pieces(docs: DataFrame, tokenizer: str = TOKENIZER, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Cuts each document's ids and its end id at multiples of the capacity; one row for each piece."""

    def run(state, ids, texts):
        coder, seen = state
        out = {f.name: [] for f in PIECES}
        for doc, raw in zip(ids, coder.encode([t.decode("utf-8", "replace") for t in texts]), strict=True):
            raw += end_id.to_bytes(4, "little")
            n = len(raw) // 4
            for start in range(0, n, capacity):
                part = raw[start * 4 : (start + capacity) * 4]
                crc = zlib.crc32(part)
                if len(seen) >= COUNTED:
                    seen.clear()
                turn = seen[doc, start, crc] = seen.get((doc, start, crc), -1) + 1
                for name, x in zip(out, (doc, start, len(part) // 4, crc, n, turn), strict=True):
                    out[name].append(x)
        return out

    return map_texts(docs, run, PIECES, setup=lambda: (_tokenizer(tokenizer), {}))


def assign(lengths: np.ndarray, capacity: int, linear: float = LINEAR, quadratic: float = QUADRATIC) -> np.ndarray:
    """The sequence of each piece; ``lengths`` are descending.

    There are as many sequences as the ids need at least; one more opens when a piece finds no room.
    """
    n = max(1, -(-int(lengths.sum()) // capacity))
    room, cost = np.full(n, capacity), np.zeros(n)
    out = np.empty(len(lengths), np.int64)
    for i, size in enumerate(lengths.tolist()):
        at = int(np.argmin(np.where(room >= size, cost, np.inf)))
        if room[at] < size:
            at = len(room)
            room, cost = np.append(room, capacity), np.append(cost, 0.0)
        room[at] -= size
        cost[at] += linear * size + quadratic * size * size
        out[i] = at
    return out


def dealt(pieces: DataFrame, cells: int) -> DataFrame:
    """``pieces`` with the cell of each."""
    return pieces.withColumn("cell", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", "turn"), F.lit(cells)))


def pack(pieces: DataFrame, capacity: int = CAPACITY, cell: int = CELL, linear: float = LINEAR, quadratic: float = QUADRATIC) -> DataFrame:
    """Gives every piece a sequence and its offset there.  ``pieces`` must be a stored table."""
    cells = max(1, round(pieces.count() / cell))

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        number = int(frame["cell"].iloc[0])
        frame = frame.sort_values(["length", "doc_id", "start", "ids_crc32"], ascending=[False, True, True, True], ignore_index=True)
        frame["sequence_id"] = assign(frame["length"].to_numpy(), capacity, linear, quadratic)
        frame["offset"] = frame.groupby("sequence_id")["length"].cumsum() - frame["length"]
        frame["sequence_id"] += number << 32
        return frame[[x.split()[0] for x in PACKED.split(", ")]]

    return dealt(pieces, cells).groupBy("cell").applyInPandas(run, PACKED)


def pack_documents(docs: DataFrame, tokenizer: str = TOKENIZER, capacity: int = CAPACITY) -> DataFrame:
    """One row for each piece of each row of ``docs``.

    A null text counts as empty: its document is the end id alone.  Repeated rows are packed as
    often as they stand there.  A null doc_id stays null.  No documents: no rows.  Bytes that are no
    UTF-8 count as U+FFFD.
    Of the columns only doc_id and text are read, so others may have any names.  Texts may be of any length.
    """
    return pack(written(tokenized_pieces(docs, tokenizer, capacity), "pieces"), capacity)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
