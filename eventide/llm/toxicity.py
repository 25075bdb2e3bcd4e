"""Toxicity by class-conditional Kneser-Ney models.

Each class, toxic and ordinary, has two models.  One gives words, and pairs of words, a likelihood: it discounts
its own counts and backs off to one distribution of both classes, made of how many different words a
word follows, so a rare expression is judged like any other.  The other one spells words letter by
letter, with letters that back off to continuation counts of both classes in the same way, and so
judges an expression by its parts.  A word's evidence is the difference of its log-likelihoods in the
two classes, of both models.  A document's score compares them for each word: over the whole text, over
its strongest passage and over its strongest expressions, with weights fitted on labelled
documents that the models have not seen.  The text's length is no input.
"""

from __future__ import annotations

import math
from collections import Counter
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import dropped, held_out, keep_rows, map_texts, small_batches, table, written

#: Labelled documents that each class's model is fitted on, and the weights; at most.
FIT_DOCS, WEIGH_DOCS = 1500, 1500
#: Bytes of text of a class in either half; the last document may go beyond.
FIT_BYTES = 8 << 20
#: Letters of the longest context, and what is taken off each count of letters and of continuations.
CONTEXT, DISCOUNT = 5, 0.75
#: What is taken off each count of words: what stands in one document alone has no weight of its own.
WORD_DISCOUNT = 1
#: Letters that the lowest order spreads over.
ALPHABET = 256
#: Words of a passage, and how many expressions count as the strongest.
PASSAGE, STRONGEST = 40, 3
#: Score from which a document counts as toxic.
THRESHOLD = 0.3
#: Words whose evidence a worker remembers.
REMEMBERED = 400_000

_BREAKS = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
SCORES = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])
EVIDENCE = ["whole", "passage", "strongest"]


def words_of(text: bytes) -> list[bytes]:
    return text.decode("utf-8", "replace").lower().encode().translate(_BREAKS).split()


def _bytes(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "replace")


def _letters(word: bytes) -> str:
    return "<" + word.decode("utf-8", "replace") + ">"


class Evidence(dict):
    """A word's log-likelihood under the toxic models less that under the ordinary ones.

    ``grams`` holds the difference of each seen context and letter, ``contexts`` that of letters
    a context was never seen with; there, the shared backoff is the same for both and cancels.  ``words`` holds
    the difference of the word model beyond that of its backoff, ``pairs`` that of words after the one before.
    """

    def __init__(self, grams: dict[str, float], contexts: dict[str, float], words: dict[bytes, float] | None = None, pairs: dict[tuple[bytes, bytes], float] | None = None):
        super().__init__()
        self.grams, self.contexts, self.words, self.pairs = grams, contexts, words or {}, pairs or {}

    def __reduce__(self):
        return Evidence, (self.grams, self.contexts, self.words, self.pairs)

    def __missing__(self, word: bytes) -> float:
        s, total = _letters(word), self.words.get(word, 0.0)
        for i in range(1, len(s)):
            a = i - CONTEXT if i > CONTEXT else 0
            x = self.grams.get(s[a : i + 1])
            total += self.contexts.get(s[a:i], 0.0) if x is None else x
        self[word] = total
        return total

    def of(self, words: list[bytes]) -> np.ndarray:
        """The evidence of each word after the one before it."""
        if len(self) > REMEMBERED:
            self.clear()
        out = np.fromiter(map(self.__getitem__, words), np.float64, len(words))
        if self.pairs:
            out[1:] += np.fromiter(map(self.pairs.get, zip(words, words[1:]), repeat(0.0)), np.float64, len(words) - 1)
        return out


class LetterModel:
    """The spelling of words in two classes, with one backoff for both.  ``counts``: in how many documents of a class each word stands."""

    def __init__(self, counts: dict[int, Counter]):
        own: dict[int, Counter] = {k: Counter() for k in (0, 1)}
        for k, words in counts.items():
            for word, n in words.items():
                s = _letters(word)
                for i in range(1, len(s)):
                    own[k][s[max(0, i - CONTEXT) : i + 1]] += n
        self.own = own
        level = set(own[0]) | set(own[1])
        self.shared: dict[tuple[int, str], float] = {}
        self.layers = []
        while level and max(map(len, level)) > 1:
            continued = Counter(g[1:] for g in level if len(g) > 1)
            self.layers.append((continued, *_sums(continued)))
            level = set(continued)
        self.sums, self.kinds = zip(*(_sums(own[k]) for k in (0, 1)))

    def backoff(self, g: str, depth: int = 0) -> float:
        """Chance of the last letter of g after the others, by how many different letters g follows."""
        if depth == len(self.layers) or not g:
            return 1 / ALPHABET
        key = (depth, g)
        if (p := self.shared.get(key)) is None:
            continued, sums, kinds = self.layers[depth]
            lower = self.backoff(g[1:], depth + 1)
            total = sums.get(g[:-1], 0)
            p = self.shared[key] = (max(continued.get(g, 0) - DISCOUNT, 0) + DISCOUNT * kinds[g[:-1]] * lower) / total if total else lower
        return p

    def weight(self, k: int, context: str) -> float:
        return DISCOUNT * self.kinds[k][context] / self.sums[k][context] if context in self.sums[k] else 1.0

    def letter(self, k: int, g: str) -> float:
        """Chance of the last letter of g after the others in class k."""
        c = g[:-1]
        own = max(self.own[k].get(g, 0) - DISCOUNT, 0) / self.sums[k][c] if c in self.sums[k] else 0.0
        return own + self.weight(k, c) * self.backoff(g[1:])

    def word(self, k: int, word: bytes) -> float:
        s = _letters(word)
        return math.exp(sum(math.log(self.letter(k, s[max(0, i - CONTEXT) : i + 1])) for i in range(1, len(s))))


def _sums(counts: Counter) -> tuple[Counter, Counter]:
    """Of the grams that share all but the last item: the sum of their counts, and how many there are."""
    sums, kinds = Counter(), Counter()
    for g, n in counts.items():
        sums[g[:-1]] += n
        kinds[g[:-1]] += 1
    return sums, kinds


class WordModel:
    """Words and pairs in two classes, with one backoff for both.

    ``counts``: in how many documents of a class each word stands; ``follows``: how many different words a word
    follows; ``pairs``: in how many documents two words stand in a row, at least those with
    more than WORD_DISCOUNT; ``before``: of a word, the sum of all such counts and how many words follow it.
    """

    def __init__(self, counts: dict[int, Counter], follows: Counter, pairs: dict[int, Counter], before: dict[int, dict[bytes, tuple[int, int]]]):
        self.counts, self.follows, self.pairs, self.before = counts, follows, pairs, before
        pool = counts[0] + counts[1]
        self.pool, self.total = pool, len(pool) + sum(follows[w] for w in pool)
        self.letters = LetterModel({0: pool, 1: Counter()})
        self.sums = {k: sum(counts[k].values()) for k in (0, 1)}
        self.shared: dict[bytes, float] = {}

    def backoff(self, word: bytes) -> float:
        """Chance of a word in either class, by how many different words it follows, or else by its letters."""
        if (p := self.shared.get(word)) is None:
            own = max(self.follows[word] + (word in self.pool) - DISCOUNT, 0)
            p = self.shared[word] = (own + DISCOUNT * len(self.pool) * self.letters.word(0, word)) / self.total
        return p

    def weight(self, k: int) -> float:
        return WORD_DISCOUNT * len(self.counts[k]) / self.sums[k]

    def word(self, k: int, word: bytes) -> float:
        return max(self.counts[k][word] - WORD_DISCOUNT, 0) / self.sums[k] + self.weight(k) * self.backoff(word)

    def pair_weight(self, k: int, first: bytes) -> float:
        n, kinds = self.before[k].get(first, (0, 0))
        return WORD_DISCOUNT * kinds / n if n else 1.0

    def pair(self, k: int, first: bytes, word: bytes) -> float:
        """Chance of a word after another one."""
        n, _ = self.before[k].get(first, (0, 0))
        own = max(self.pairs[k][first, word] - WORD_DISCOUNT, 0) / n if n else 0.0
        return own + self.pair_weight(k, first) * self.word(k, word)


def fit_evidence(counts: dict[int, Counter], follows: Counter = Counter(), pairs: dict[int, Counter] = {0: Counter(), 1: Counter()}, before: dict[int, dict] = {0: {}, 1: {}}) -> Evidence:
    """Of counts as in ``WordModel``.  What has no weight of its own gets no entry: its evidence is that of its letters."""
    model = LetterModel(counts)
    grams = {g: math.log(model.letter(1, g) / model.letter(0, g)) for g in set(model.own[0]) | set(model.own[1])}
    contexts = {c: math.log(model.weight(1, c) / model.weight(0, c)) for c in set(model.sums[0]) | set(model.sums[1])}
    del model  # before the next one takes as much memory
    model = WordModel(counts, follows, pairs, before)
    none = math.log(model.weight(1) / model.weight(0))
    words = {w: math.log(model.word(1, w) / model.word(0, w)) - none for w, n in model.pool.items() if n > WORD_DISCOUNT and max(counts[k][w] for k in (0, 1)) > WORD_DISCOUNT}
    both = {}
    for u, w in {p for k in (0, 1) for p, n in pairs[k].items() if n > WORD_DISCOUNT}:
        alone = math.log(model.pair_weight(1, u) * model.word(1, w)) - math.log(model.pair_weight(0, u) * model.word(0, w))
        both[u, w] = math.log(model.pair(1, u, w)) - math.log(model.pair(0, u, w)) - alone
    return Evidence(grams, contexts, words, both)


def _strongest(v: np.ndarray, n: int) -> float:
    """The largest mean of n values in a row; of all if there are fewer."""
    if len(v) <= n:
        return float(v.mean())
    sums = np.concatenate(([0.0], np.cumsum(v)))
    return float((sums[n:] - sums[:-n]).max()) / n


def weighed(evidence: Evidence, text: bytes) -> list[float]:
    """A text's evidence for each word, in the order of EVIDENCE; all 0 without words."""
    words = words_of(text)
    if not words:
        return [0.0] * len(EVIDENCE)
    v = evidence.of(words)
    return [float(v.mean()), _strongest(v, PASSAGE), float(np.partition(v, -STRONGEST)[-STRONGEST:].mean() if len(v) > STRONGEST else v.mean())]


def fit_weights(x: np.ndarray, y: np.ndarray, rounds: int = 60, ridge: float = 0.02) -> np.ndarray:
    """Logistic regression by Newton steps; the first weight is the constant."""
    spread = x.std(0) + 1e-9
    mean = x.mean(0)
    z = np.c_[np.ones(len(x)), (x - mean) / spread]
    w = np.zeros(z.shape[1])
    penalty = ridge * np.eye(len(w)) * (np.arange(len(w)) > 0)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve(z.T @ (z * (p * (1 - p) + 1e-9)[:, None]) + penalty, z.T @ (p - y) + penalty @ w)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    slopes = w[1:] / spread
    return np.concatenate(([w[0] - slopes @ mean], slopes))


def _sample(labels: DataFrame, toxic: int, part: int, most: int) -> DataFrame:
    """Of this class and part of the learnable labels, the ones with smallest hashes."""
    mine = labels.where((F.col("toxic") == toxic) & F.col("doc_id").isNotNull() & ~held_out(4, 2) & (F.pmod(F.xxhash64("doc_id"), F.lit(2)) == part))
    return mine.select("doc_id", F.lit(toxic).alias("toxic"), F.lit(part).alias("part")).orderBy(F.xxhash64("doc_id", F.lit(1)), "doc_id").limit(most)


def fit(docs: DataFrame, labels: DataFrame, fit_docs: int = FIT_DOCS, weigh_docs: int = WEIGH_DOCS, fit_bytes: int = FIT_BYTES) -> tuple[Evidence, np.ndarray]:
    """The models and the weights.  Labels of held-out documents are never read.

    At most 2 * (fit_docs + weigh_docs) labelled documents are used, half the labels of a class
    for its model and the other half for the weights.  Equal texts count once; of an id with several labels the
    smallest counts.  Every text is read whole; of each class and half, documents are taken until their texts have
    ``fit_bytes`` bytes, which bounds what the models hold, and the driver while they are made.
    Without labels of both classes every weight is 0 and every score 0 but for the constant.
    """
    picked = [_sample(labels, k, part, most) for k in (0, 1) for part, most in ((0, fit_docs), (1, weigh_docs))]
    chosen = picked[0].union(picked[1]).union(picked[2]).union(picked[3]).groupBy("doc_id").agg(F.min(F.struct("toxic", "part")).alias("x")).select("doc_id", "x.*")
    sizes = docs.select("doc_id", F.octet_length("text").alias("size")).join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic", "part").agg(F.sum("size").alias("size"))
    #: A row for each chosen document, so a few thousand at most.
    before = F.sum("size").over(Window.partitionBy("toxic", "part").orderBy(F.xxhash64("doc_id", F.lit(1)), "doc_id")) - F.col("size")
    chosen = written(sizes.withColumn("before", before).where(F.coalesce("before", F.lit(0)) < fit_bytes).select("doc_id", "toxic", "part"), "chosen")
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    texts = written(texts.groupBy(F.xxhash64("text").alias("h")).agg(F.min_by(F.struct("text", "toxic", "part"), "doc_id").alias("x")).select("x.*"), "labelled")

    def spread(frames):
        for frame in frames:
            found: dict[tuple[bytes, bytes], list[int]] = {}
            for text, toxic in zip(frame["text"], frame["toxic"], strict=True):
                words = words_of(_bytes(text))
                for pair in {*zip(words, repeat(b"")), *zip(words, words[1:])}:
                    found.setdefault(pair, [0, 0])[toxic] += 1
            yield pd.DataFrame({"word": [u for u, _ in found], "next": [v for _, v in found], "n0": [x[0] for x in found.values()], "n1": [x[1] for x in found.values()]})

    sums = small_batches(texts).where("part = 0").mapInPandas(spread, "word binary, next binary, n0 long, n1 long").groupBy("word", "next").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    sums = written(sums, "counts")
    alone, paired = sums.where("length(next) = 0").drop("next"), sums.where("length(next) > 0")
    follows = paired.groupBy(F.col("next").alias("word")).agg(F.count("*").alias("follows"))
    before = paired.groupBy("word").agg(F.sum("n0").alias("s0"), F.count_if(F.col("n0") > 0).alias("k0"), F.sum("n1").alias("s1"), F.count_if(F.col("n1") > 0).alias("k1"))
    known = alone.join(follows, "word", "left").join(before, "word", "left").na.fill(0).toArrow()
    often = paired.where((F.col("n0") > WORD_DISCOUNT) | (F.col("n1") > WORD_DISCOUNT)).toArrow()
    dropped(sums)
    words, column = known["word"].to_pylist(), lambda t, n: t[n].to_pylist()
    counts = {k: Counter({w: n for w, n in zip(words, column(known, f"n{k}"), strict=True) if n}) for k in (0, 1)}
    follows = Counter({w: n for w, n in zip(words, column(known, "follows"), strict=True) if n})
    before = {k: {w: (n, m) for w, n, m in zip(words, column(known, f"s{k}"), column(known, f"k{k}"), strict=True) if n} for k in (0, 1)}
    pairs = {k: Counter({(u, w): n for u, w, n in zip(column(often, "word"), column(often, "next"), column(often, f"n{k}"), strict=True) if n}) for k in (0, 1)}
    del known, often, words
    none = -2.0
    if not counts[0] or not counts[1]:
        dropped(texts)
        return Evidence({}, {}), np.array([none] + [0.0] * len(EVIDENCE))
    evidence = fit_evidence(counts, follows, pairs, before)
    del counts, follows, pairs, before
    shared = docs.sparkSession.sparkContext.broadcast(evidence)

    def measure(frames):
        for frame in frames:
            rows = [weighed(shared.value, _bytes(t)) for t in frame["text"]]
            yield pd.DataFrame(rows, columns=EVIDENCE).assign(toxic=frame["toxic"].to_numpy())

    seen = small_batches(texts).where("part = 1").mapInPandas(measure, ", ".join(f"{c} double" for c in EVIDENCE) + ", toxic int").toPandas().sort_values([*EVIDENCE, "toxic"])
    shared.destroy()
    dropped(texts)
    if seen["toxic"].nunique() < 2:
        return evidence, np.array([none] + [0.0] * len(EVIDENCE))
    return evidence, fit_weights(seen[EVIDENCE].to_numpy(), seen["toxic"].to_numpy(float))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, **bounds) -> DataFrame:
    """The rows of ``docs`` that score below the threshold, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, **bounds))

    def keep(texts: list[bytes]) -> list[bool]:
        evidence, w = shared.value
        z = np.array([weighed(evidence, t) for t in texts]) @ w[1:] + w[0]
        return (1 / (1 + np.exp(-np.clip(z, -60, 60))) < threshold).tolist()

    return keep_rows(docs, keep)


def score_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, **bounds) -> DataFrame:
    """One row for each row of ``docs``: doc_id, held_out, score, predicted.

    Null and empty texts have no evidence and get the score of that.  Equal rows get equal scores.
    An empty table gives no rows; of the columns only doc_id and text (doc_id and toxic of labels) are read, so others may have any names.
    """
    evidence, weights = fit(docs, labels, **bounds)
    shared = docs.sparkSession.sparkContext.broadcast((evidence, weights))

    def run(_, ids, texts):
        evidence, w = shared.value
        z = np.array([weighed(evidence, t) for t in texts]) @ w[1:] + w[0]
        return {"doc_id": ids, "score": 1 / (1 + np.exp(-np.clip(z, -60, 60)))}

    return map_texts(docs, run, SCORES).select("doc_id", held_out(4, 2).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
