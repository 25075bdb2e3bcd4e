import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from eventide.llm import decontaminate, exact_dedup, minhash, packing, toxicity

from .helpers import EDGES, documents, prose

SMALL = "/root/testdata/sf0.001"


def tokens(text):
    raw = packing._tokenizer(packing.TOKENIZER).tokenizer.encode(text or "", add_special_tokens=False).ids
    return np.array([*raw, packing.END_ID], "<u4")


def test_pieces_cover_every_id_once(spark):
    long = prose(1, 4000)
    rows = [(1, None), (2, ""), (3, "It's naïve, ΣΑΣ x"), (4, long), (5, "<|endoftext|> a"), (6, "a\x1cb\x85c"), (7, prose(2, 30)), (8, "日本語 x"), (None, "y")]
    got = [r.asDict() for r in packing.pack_documents(documents(spark, rows)).collect()]
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    for doc, text in rows:
        ids, at = tokens(text), 0
        for r in sorted(by_doc[doc], key=lambda r: r["start"]):
            assert (r["start"], r["doc_tokens"]) == (at, len(ids)) and r["length"] > 0
            at += r["length"]
            assert r["ids_crc32"] == zlib.crc32(ids[r["start"] : at].tobytes())
        assert at == len(ids)
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= packing.CAPACITY
    assert packing.pack_documents(documents(spark, [])).count() == 0
    assert packing.pack_documents(documents(spark, [(1, "a"), (1, "a")])).count() == 2


def test_words_give_the_ids_of_whole_texts(spark):
    texts = [r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    coder = packing._tokenizer(packing.TOKENIZER)
    for text, raw in zip(texts, coder.encode(texts), strict=True):
        assert raw == tokens(text)[:-1].tobytes()


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=60))
def test_assignment_fits_and_wastes_little(lengths):
    lengths = np.array(sorted(lengths, reverse=True), np.int64)
    where = packing.assign(lengths, 20)
    sums = np.bincount(where, lengths, minlength=1) if len(lengths) else np.zeros(1)
    assert (sums <= 20).all()
    cost = lambda n: n + n * n / 8192
    room, costs = [20] * max(1, -(-int(lengths.sum()) // 20)), [0.0] * max(1, -(-int(lengths.sum()) // 20))
    for n, at in zip(lengths.tolist(), where.tolist(), strict=True):
        open_ = [(costs[i], i) for i in range(len(room)) if room[i] >= n]
        if not open_:
            room.append(20)
            costs.append(0.0)
            open_ = [(0.0, len(room) - 1)]
        assert at == min(open_)[1]
        room[at] -= n
        costs[at] += cost(n)
    least = -(-int(lengths.sum()) // 20)
    assert len(sums[sums > 0]) <= max(1, least + (lengths > 10).sum()) and (len(sums) <= max(1, 2 * least))


def test_little_padding_on_the_test_tables(spark):
    rows = packing.pack_documents(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).groupBy("sequence_id").agg(F.sum("length").alias("n")).collect()
    used = sum(r["n"] for r in rows)
    assert max(r["n"] for r in rows) <= packing.CAPACITY and len(rows) * packing.CAPACITY <= 1.02 * used


def test_repeated_rows_use_all_cells(spark):
    one = spark.range(40_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("").alias("text"))
    pieces = packing.tokenized_pieces(one.repartition(4))
    sizes = [r["count"] for r in packing.dealt(pieces, 10).groupBy("cell").count().collect()]
    assert len(sizes) == 10 and max(sizes) < 1.2 * 4_000


def test_bytes_that_are_no_text_and_very_long_texts(spark):
    rows = documents(spark, [(1, "ok")]).select("doc_id", F.expr("cast(x'61ff62' as string)").alias("text")).union(documents(spark, [(2, "word " * 300_000)]).select("doc_id", "text"))
    got = packing.pack_documents(rows).collect()
    assert sum(r["length"] for r in got if r["doc_id"] == 1) == len(tokens("a\ufffdb"))
    assert sum(r["length"] for r in got if r["doc_id"] == 2) == len(tokens("word " * 300_000)) == next(r["doc_tokens"] for r in got if r["doc_id"] == 2)


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs, out = spark.read.parquet(f"{SMALL}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stages") / name)
        stage(spark, docs, SMALL).write.parquet(path)
        before, docs = docs, spark.read.parquet(path)
        out.append((name, before, docs))
    return out


def ids(df):
    return sorted(r["doc_id"] for r in df.select("doc_id").collect())


def test_stages_agree_with_their_operators(spark, stages):
    assert [n for n, _, _ in stages] == ["toxicity", "exact_dedup", "minhash", "decontaminate", "packing"]
    by = {n: (a, b) for n, a, b in stages}
    for n in list(by)[:-1]:
        assert by[n][0].columns == by[n][1].columns
    labels, benchmark = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("labels", "benchmark"))
    a, b = by["toxicity"]
    assert ids(b) == ids(toxicity.score_toxicity(a, labels).where("predicted = 0"))
    a, b = by["exact_dedup"]
    assert ids(b) == ids(exact_dedup.exact_dedup(a).where("kept"))
    a, b = by["minhash"]
    assert ids(b) == ids(minhash.near_duplicates(a).where("kept"))
    a, b = by["decontaminate"]
    leaks = {r["doc_id"] for r in decontaminate.find_leaks(a, benchmark).collect()}
    assert leaks and ids(b) == [i for i in ids(a) if i not in leaks]
    a, b = by["packing"]
    assert sorted({*ids(b)}) == ids(a)


def test_run_equals_the_stages(spark, stages):
    got = corpus_pipeline.run(spark, SMALL)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, stages[-1][2].collect()))


def test_stages_take_odd_documents(spark, tmp_path):
    docs = documents(spark, EDGES).select("doc_id", "text", "lang", "source", "n_chars")
    for rows, n in ((docs, 5), (docs.limit(0), 0)):
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
            path = str(tmp_path / f"{n}-{k}")
            stage(spark, rows, SMALL).write.parquet(path)
            rows = spark.read.parquet(path)
        assert rows.count() <= n
