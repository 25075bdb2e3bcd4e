import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from eventide.llm import components, exact_dedup, minhash

from .helpers import EDGES, documents, prose, union


def brute_exact(rows):
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = defaultdict(list)
    for i, t in rows:
        groups[norm(t)].append(i)
    out = []
    for i, t in rows:
        mine = groups[norm(t)]
        keep = min((x for x in mine if x is not None), default=None)
        out.append((i, keep, len(mine), i == keep, hashlib.sha256(norm(t).encode()).hexdigest()))
    return Counter(out)


def test_exact_dedup(spark):
    rows = EDGES + [(100 + i, f"text {i % 7}") for i in range(60)] + [(9, "x" * 300_000), (8, "x" * 300_000)]
    got = exact_dedup.exact_dedup(documents(spark, rows)).collect()
    assert Counter(map(tuple, got)) == brute_exact(rows)
    assert exact_dedup.exact_dedup(documents(spark, [])).count() == 0


def test_drop_copies_leaves_one_row(spark):
    kept = exact_dedup.drop_copies(documents(spark, EDGES))
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 3, 5, 6, 7]
    assert kept.columns == documents(spark, []).columns


KEYS = st.one_of(st.binary(max_size=6), st.builds(lambda n, m, end: b"p" * n + b"q" * m + end, st.sampled_from([0, 3, 900, 901]), st.integers(0, 700), st.binary(max_size=3)))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(KEYS, st.integers(0, 9)), max_size=40), st.sampled_from([1, 8, 200, 1500, 1 << 20]))
def test_trie_equals_dict(items, most):
    trie, want = exact_dedup.PatriciaTrie(most), {}
    for key, i in items:
        trie.insert(key, (i, 1, key, 1))
        low, n = want.get(key, (i, 0))
        want[key] = (min(low, i), n + 1)
    got = [(k, v[0], v[1]) for k, v in trie.items()]
    assert sorted(got) == sorted((k, *v) for k, v in want.items())
    assert trie.folder is None


@pytest.mark.parametrize("shared", [0, 3_000, 100_000])
def test_trie_spills_long_keys_and_long_shared_heads(shared):
    r = random.Random(shared)
    head = r.randbytes(shared)
    keys = [head + r.randbytes(r.choice([0, 1, 40, 6_000, 50_000])) for _ in range(60)] + [head[: i * 1_000] for i in range(shared // 1_000)]
    trie = exact_dedup.PatriciaTrie(2_000)
    for turn in range(3):
        for i, key in enumerate(keys):
            trie.insert(key, (i - turn, 1, None, 1))
    want = {}
    for i, key in enumerate(keys):
        want[key] = (min(i - 2, want.get(key, (i, 0))[0]), want.get(key, (i, 0))[1] + 3)
    got = {k: v[:2] for k, v in trie.items()}
    assert got == want


def test_trie_of_one_key_beyond_its_memory():
    trie = exact_dedup.PatriciaTrie(2_000)
    for i in range(4):
        trie.insert(b"x" * 6_000, (i, 1, None, 1))
    assert [(k, v) for k, v in trie.items()] == [(b"x" * 6_000, (0, 4, None, 1))]


def test_spilled_partitions_give_the_same_result(spark, monkeypatch):
    """Workers read the module anew, so the limits reach them through the trie's default."""
    rows = [(i, prose(1, 800) + prose(2 + i % 5, 30 * (i % 7))) for i in range(60)]
    real = exact_dedup.PatriciaTrie.__init__
    monkeypatch.setattr(exact_dedup.PatriciaTrie, "__init__", lambda self, most=2_000: real(self, most))
    parts = list(exact_dedup._fold(iter([pa.RecordBatch.from_pydict({"doc_id": [i for i, _ in rows], "text": [t for _, t in rows]})])))
    picked = [p.select(["sha", "body", "least", "n", "same"]) for p in parts]
    got = {r["sha"]: (r["keep_id"], r["group_size"]) for b in exact_dedup._own(iter(picked)) for r in b.to_pylist()}
    want = defaultdict(list)
    for i, t in rows:
        want[hashlib.sha256(t.encode()).digest()].append(i)
    assert got == {k: (min(v), len(v)) for k, v in want.items()}


def test_drop_copies_keeps_columns_with_its_own_names(spark):
    docs = documents(spark, EDGES)
    for name in ("__key", "key", "_key", "owner", "__id", "__sha", "same", "KEEP_ID"):
        docs = docs.withColumn(name, F.lit(name))
    rows = exact_dedup.drop_copies(docs)
    assert rows.columns == docs.columns and {r["__key"] for r in rows.collect()} == {"__key"}


def brute_near(rows):
    def shingles(t):
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if x]
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())

    sets = [shingles(t) for _, t in rows]
    pairs = [(a, b) for a in range(len(rows)) for b in range(a) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    comp = union(pairs, range(len(rows)))
    least = {}
    for a, (i, _) in enumerate(rows):
        if i is not None:
            least[comp[a]] = min(least.get(comp[a], i), i)
    return Counter((i, len(sets[a]), least.get(comp[a]), i == least.get(comp[a])) for a, (i, _) in enumerate(rows))


def near_rows():
    r, rows = random.Random(4), []
    for base in range(6):
        w = prose(base, 80).split()
        for k in range(9):
            x = list(w)
            for _ in range(r.choice([0, 1, 2, 3, 4, 6])):
                x[r.randrange(len(x))] = f"edit{r.randrange(10**6)}"
            rows.append((base * 20 + k, " ".join(x)))
    return rows


def test_near_duplicates(spark):
    rows = EDGES + near_rows() + [(500, "one two"), (501, "ONE  two"), (502, "one two three")]
    got = minhash.near_duplicates(documents(spark, rows)).collect()
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in got) == brute_near(rows)


def test_near_duplicates_of_nothing(spark):
    assert minhash.near_duplicates(documents(spark, [])).count() == 0
    assert [r["kept"] for r in minhash.near_duplicates(documents(spark, [(1, None), (2, prose(1, 50))])).collect()] == [True, True]


def test_open_buckets_are_compared_in_the_end(spark, monkeypatch):
    monkeypatch.setattr(minhash, "ROUNDS", 0)
    rows = near_rows()
    got = minhash.near_duplicates(documents(spark, rows)).collect()
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in got) == brute_near(rows)


@pytest.mark.parametrize("tile", [1, 4, 10**6])
def test_tiles_of_any_size_give_the_same(spark, monkeypatch, tile):
    monkeypatch.setattr(minhash, "TILE", tile)
    monkeypatch.setattr(minhash, "ROUNDS", 0)
    rows = EDGES + near_rows()
    got = minhash.near_duplicates(documents(spark, rows)).collect()
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in got) == brute_near(rows)


def test_drop_near_duplicates_joins_on_text(spark):
    rows = [(i, t) for i, t in near_rows()]
    kept = minhash.drop_near_duplicates(documents(spark, rows))
    assert sorted(r["doc_id"] for r in kept.select("doc_id").collect()) == sorted({c for _, _, c, k in brute_near(rows) if k})


def test_components(spark):
    r = random.Random(3)
    for n, m in ((1, 0), (30, 20), (40, 80), (60, 59)):
        pairs = [(i, i + 1) for i in range(m)] if m == 59 else [(r.randrange(n), r.randrange(n)) for _ in range(m)]
        edges = spark.createDataFrame(pairs, "u long, v long")
        want = {a: b for a, b in union(pairs, range(n)).items() if a != b}
        assert {x["u"]: x["v"] for x in components.connected_components(edges).collect()} == want


def test_one_bucket_of_20000_unlike_members(spark):
    """Only similar members of the bucket become rows, and no task has many of its members' tiles."""
    r = np.random.default_rng(12)
    n = 20_000
    bits = r.integers(-(2**63), 2**63, (n, 16))
    for i in range(0, 400, 2):
        bits[i + 1] = bits[i]
        bits[i + 1, : i // 100] ^= 1 << 5
    names = [int(i).to_bytes(16, "big") for i in r.permutation(n)]
    roots = [names[i] if i % 40 else names[i & ~1] for i in range(n)]
    roots = [names[i - 1] if i % 40 == 1 else root for i, root in enumerate(roots)]
    rows = pa.table({"bucket": [7] * n, "node": names, "n": [100] * n, "r": [100 if i % 10 != 4 else 60 for i in range(n)], "root": roots, "sketch": bits.tolist(), "band": [3] * n, "keys": [[j, i, j, 5, i] for j, i in enumerate(range(n))]})
    live = spark.createDataFrame(rows).repartition(4)
    found = {(bytes(p["u"]), bytes(p["v"])) for p in minhash._open_pairs(live).collect()}
    want = {tuple(sorted((names[i], names[i + 1]))) for i in range(0, 400, 2) if i % 40 and i % 10 != 4}
    assert found == want
    tiles = -(-n // minhash.TILE)
    assert tiles > 30 and minhash.TILE**2 * 4 < n**2 / 50


def test_documents_with_a_common_half(spark):
    half, rows = prose(900, 60), []
    for i in range(120):
        own = prose(1000 + i, 60)
        rows += [(2 * i, f"{half} {own}"), (2 * i + 1, f"{half} {own} {prose(5000 + i, i % 50)}")]
    got = minhash.near_duplicates(documents(spark, rows)).collect()
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in got) == brute_near(rows)
