import hashlib
import random
import re
import time
from collections import Counter
from pathlib import Path

from hypothesis import given, settings
from hypothesis import strategies as st

from eventide.llm import common, decontaminate, passage_chains, suffix_dedup

from .helpers import EDGES, documents, prose


def brute_removed(rows, length=400):
    texts, seen = [(i, (t or "").encode()) for i, t in rows], Counter()
    for _, b in texts:
        seen.update(b[i : i + length] for i in range(len(b) - length + 1))
    out = []
    for i, b in texts:
        gone = bytearray(len(b))
        for s in range(len(b) - length + 1):
            if seen[b[s : s + length]] > 1:
                gone[s : s + length] = b"\1" * length
        spans = bytes(gone).replace(b"\0", b" ").split()
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        out.append((i, len(b), sum(gone), len(spans), hashlib.sha256(kept).hexdigest()))
    return Counter(out)


def test_suffix_dedup(spark):
    shared, other = prose(1, 160), prose(2, 150)
    rows = EDGES + [
        (10, prose(3, 60) + " " + shared + " " + prose(4, 60)), (11, shared + prose(5, 40)), (12, prose(6, 30) + shared[37:]), (13, shared[:399]), (14, shared[100:500]),
        (15, other + " | " + other), (16, "ab" * 500), (17, "z" * 401), (18, "z" * 400), (19, prose(7, 300)), (20, prose(7, 300)), (20, prose(7, 300)), (21, shared[:300] + "é" + shared[300:]),
        (22, other[50:] + shared[:450]), (None, other[20:470]),
    ]
    got = suffix_dedup.substring_dedup(documents(spark, rows)).collect()
    assert Counter(map(tuple, got)) == brute_removed(rows)
    assert suffix_dedup.substring_dedup(documents(spark, [])).count() == 0


def test_suffix_dedup_of_a_large_group(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "GROUP", 3)
    shared = prose(9, 120)
    rows = [(i, prose(100 + i, 1 + i) + " " + shared[: 430 + i] + prose(200 + i, 20)) for i in range(12)]
    got = suffix_dedup.substring_dedup(documents(spark, rows)).collect()
    assert Counter(map(tuple, got)) == brute_removed(rows)


def test_ranks_equal_those_of_one_sorted_list(spark):
    """Pairs that fill several partitions keep one rank; a pair that stands once is alone."""
    r = random.Random(11)
    rows = [(i, 0, 5, 5) for i in range(900)] + [(1000 + i, i % 3, r.randrange(12), r.randrange(12)) for i in range(300)] + [(5000, 1, -(1 << 63), 7), (5001, 0, (1 << 63) - 1, 7)]
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        pairs = suffix_dedup.written(spark.createDataFrame(rows, "id long, i int, a long, b long"), "test")
        got = {(x["id"], x["i"]): (x["rank"], x["alone"]) for x in suffix_dedup.reranked(pairs, suffix_dedup.Scratch()).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    order = sorted((a, b) for _, _, a, b in rows)
    first, n = {p: order.index(p) for p in set(order)}, Counter(order)
    assert got == {(i, k): (first[a, b], n[a, b] == 1) for i, k, a, b in rows}
    assert suffix_dedup.reranked(suffix_dedup.written(pairs.limit(0), "test"), suffix_dedup.Scratch()).count() == 0


def test_edges_of_partitions():
    pairs = [(1, 1), (1, 2), (1, 2), (1, 2), (1, 2), (2, 0), (3, 0), (3, 0), (4, 4)]
    for cuts in ([2, 3, 7], [1, 4], [5, 6], [3, 8], [1, 2, 3, 4, 5, 6, 7, 8]):
        edges, expected = [], []
        for part, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(pairs)])):
            mine = pairs[a:b]
            head = lambda x: mine.index(mine[x])  # noqa: B023, E731
            edges += [(part, *mine[0], 0, 0)] * (len(mine) > 1) + [(part, *mine[-1], len(mine) - 1, head(-1))]
            expected.append((part, a, pairs.index(mine[0]), a > 0 and pairs[a - 1] == mine[0], b < len(pairs) and pairs[b] == mine[-1]))
        assert suffix_dedup._joined_edges(edges) == expected


def test_segments_do_not_change_the_result(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SEGMENT", 300)
    rows = [(1, prose(1, 300)), (2, "x" + prose(1, 300)), (3, prose(1, 150))]
    got = [r for i, t in rows for r in suffix_dedup.anchored_runs(t.encode())]
    assert sum(int(n.sum()) for _, _, n, _ in got) == sum(len(t) - 399 for _, t in rows)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 30)), max_size=12, unique=True))
def test_chains_use_each_match_once_in_order(matches):
    found = passage_chains.chains(set(matches))
    assert sorted(m for c in found for m in c) == sorted(matches)
    for c in found:
        assert all(a[0] < b[0] and a[1] < b[1] for a, b in zip(c, c[1:]))


@settings(max_examples=80, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 30)), min_size=1, max_size=12, unique=True))
def test_first_chain_has_the_best_score(matches):
    k, gap = passage_chains.K, passage_chains.GAP_COST
    best = {}
    for x, y in sorted(matches):
        best[x, y] = k + max([0.0, *(v - gap * (x - a + y - b) for (a, b), v in best.items() if a < x and b < y)])
    first = passage_chains.chains(set(matches))[0]
    score = k * len(first) - gap * (first[-1][0] - first[0][0] + first[-1][1] - first[0][1])
    assert abs(score - max(best.values())) < 1e-9


def test_fuzzy_passages(spark):
    passage = prose(1, 70).split()
    fuzzy = list(passage)
    fuzzy[30], fuzzy[50] = "xx", "yy"
    del fuzzy[40]
    rows = EDGES + [
        (10, prose(2, 50) + " " + " ".join(passage) + " " + prose(3, 50)), (11, prose(4, 20) + " " + " ".join(fuzzy) + " " + prose(5, 80)), (12, " ".join(passage).upper()),
        (13, prose(6, 200)), (14, prose(7, 30) + " " + prose(7, 30)), (15, prose(8, 60)), (15, prose(8, 60)),
    ]
    got = passage_chains.fuzzy_passages(documents(spark, rows)).collect()
    assert {r["doc_id"] for r in got} | {r["owner_id"] for r in got} == {10, 11, 12}
    one = next(r for r in got if r["doc_id"] == 11 and r["owner_id"] == 10)
    assert abs(one["start_word"] - 20) <= 2 and abs(one["n_words"] - 69) <= 3 and 3 <= one["errors"] <= 5
    assert abs(one["owner_start"] - 50) <= 2
    assert passage_chains.fuzzy_passages(documents(spark, [])).count() == 0


def test_two_passages_near_each_other(spark):
    """Both of two exact passages with other words between them are found, however short the gap."""
    rows, expected = [], {}
    for i, (first, gap, second) in enumerate([(55, 40, 55), (60, 50, 60), (80, 60, 80), (45, 40, 90), (55, 40, 20)] * 6):
        one, two = prose(1000 + i, first), prose(2000 + i, second)
        for side in (0, 1):
            rows.append((2 * i + side, " ".join([prose(3000 + 2 * i + side, 30), one, prose(4000 + 2 * i + side, gap), two, prose(5000 + 2 * i + side, 30)])))
        expected[2 * i] = [(30, first)] + [(30 + first + gap, second)] * (second >= passage_chains.MIN_WORDS)
    got = passage_chains.fuzzy_passages(documents(spark, rows)).collect()
    assert all({r["doc_id"] // 2, r["owner_id"] // 2} == {r["doc_id"] // 2} and r["similarity"] >= 0.75 for r in got)
    for doc, parts in expected.items():
        found = [r for r in got if r["doc_id"] == doc]
        for start, n in parts:
            assert any(r["start_word"] <= start + 3 and r["start_word"] + r["n_words"] >= start + n - 3 for r in found), (doc, start, n, found)


def test_passages_whose_parts_have_other_owners(spark):
    """Two documents share two lines that each also stand in smaller and larger documents, but never together."""
    rows, pairs = [], []
    for g in range(12):
        one, two = prose(100 + g, 30), prose(200 + g, 30)
        a, b = 1000 + 2 * g, 5000 + 2 * g
        for doc, text in ((a, one + " " + two), (b, one + " " + two), (10 + g, one), (9000 + g, one), (50 + g, two), (9100 + g, two)):
            rows.append((doc, " ".join([prose(10_000 + doc, 40), text, prose(30_000 + doc, 40)])))
        pairs.append((a, b))
    got = passage_chains.fuzzy_passages(documents(spark, rows)).collect()
    found = {(r["doc_id"], r["owner_id"]): r for r in got if r["n_words"] >= 60}
    assert all((a, b) in found and (b, a) in found for a, b in pairs)
    assert {x for pair in found for x in pair} == {x for pair in pairs for x in pair}


def test_passages_whose_seeds_all_have_other_owners(spark, monkeypatch):
    """Edited passages of lines that each stand in a smaller and a larger document too, never together; tiles of all sizes find them."""
    rows, groups = [], []
    for g in range(4):
        lines = [prose(90_000 + 10 * g + i, 12) for i in range(5)]
        group = [1000 + 10 * g + j for j in range(4)]
        for doc in group:
            rows.append((doc, " ".join([prose(91_000 + doc, 40), *(f"{line} w{doc}x{i}" for i, line in enumerate(lines)), prose(93_000 + doc, 40)])))
        for i, line in enumerate(lines):
            rows += [(10 * g + i, f"{prose(95_000 + 10 * g + i, 30)} {line} {prose(96_000 + 10 * g + i, 30)}"), (9000 + 10 * g + i, f"{prose(97_000 + 10 * g + i, 30)} {line} {prose(98_000 + 10 * g + i, 30)}")]
        groups.append(group)
    for tile in (512, 2):
        monkeypatch.setattr(passage_chains, "TILE", tile)
        got = passage_chains.fuzzy_passages(documents(spark, rows)).collect()
        assert {frozenset((r["doc_id"], r["owner_id"])) for r in got if r["n_words"] >= 60} == {frozenset((a, b)) for group in groups for a in group for b in group if a < b}
        assert all(r["similarity"] >= 0.75 for r in got)


def test_shifted_passages_whose_seeds_all_have_other_owners(spark):
    """With words left out between the lines no diagonal has half of the words; both places of a pair that share lines at unlike places are compared."""
    lines = [prose(99_000 + i, 12) for i in range(5)]
    rows = [(100, " ".join([prose(99_100, 40), *lines, prose(99_101, 40)])), (101, " ".join([prose(99_102, 40), *(f"{line} w{i}" for i, line in enumerate(lines)), prose(99_103, 40)]))]
    rows += [(doc + i, f"{prose(99_200 + doc + i, 30)} {line} {prose(99_800 + doc + i, 30)}") for doc in (1, 301) for i, line in enumerate(lines)]
    got = passage_chains.fuzzy_passages(documents(spark, rows)).collect()
    assert {frozenset((r["doc_id"], r["owner_id"])) for r in got if r["n_words"] >= 58} == {frozenset((100, 101))}


def test_copies_have_the_first_as_owner(spark):
    text, other = prose(99_900, 90), prose(99_901, 50)
    rows = [(5, text), (2, text.upper()), (None, text), (7, f"{other} {text}"), (7, f"{other} {text}"), (8, prose(99_902, 20)), (9, prose(99_902, 20))]
    got = passage_chains.fuzzy_passages(documents(spark, rows)).collect()
    assert sorted(tuple(r)[:7] for r in got if r["owner_id"] is None and r["doc_id"] != 7) == [(2, 0, 90, None, 0, 90, 0), (5, 0, 90, None, 0, 90, 0)]
    assert [tuple(r)[:7] for r in got if r["doc_id"] == 7] == [(7, 50, 90, None, 0, 90, 0)] and [tuple(r)[:7] for r in got if r["owner_id"] == 7] == [(None, 0, 90, 7, 50, 90, 0)]
    assert len(got) == 4


def similarity(x, y):
    """By plain edit distance of words."""
    row = list(range(len(y) + 1))
    for i, w in enumerate(x, 1):
        new = [i]
        for j, v in enumerate(y, 1):
            new.append(min(row[j - 1] + (v != w), row[j] + 1, new[-1] + 1))
        row = new
    return 1 - row[-1] / max(len(x), len(y))


def test_places_of_a_repeated_word_are_few():
    """Of a word or a phrase that stands many times in a row, places grow with the length of the passage only, not with every word."""
    for words in (["the"], ["one", "two", "three"]):
        hashes = passage_chains.word_hashes(" ".join(words * (3_000 // len(words))).encode())
        grams, at = passage_chains.seeds(hashes)
        assert len(at) < 6 * 3_000 / passage_chains.LONG and len(set(zip(grams.tolist(), at.tolist()))) == len(at)
        short = at[at % 2 == 0] // 2
        assert short.min() < len(words) and short.max() > 3_000 - passage_chains.K - len(words)


def test_repeated_words_are_matched_from_end_to_end(spark):
    """Runs of one word, of unlike lengths and in other words, give every document but the one with the longest a passage as long as its run, and few rows."""
    runs = {i: 150 + 35 * i for i in range(12)}
    rows = [(i, f"{prose(500 + i, 50 + 7 * i)} {'the ' * n}{prose(600 + i, 60)}") for i, n in runs.items()]
    got = passage_chains.fuzzy_passages(documents(spark, rows)).collect()
    longest = {i: max(max((r.n_words for r in got if r.doc_id == i), default=0), max((r.owner_words for r in got if r.owner_id == i), default=0)) for i in runs}
    assert all(longest[i] >= n for i, n in runs.items() if i != 11) and longest[11] >= runs[10]
    assert len(got) <= 4 * len({(r.doc_id, r.owner_id) for r in got})


def test_edited_passages_are_found(spark):
    """Of passages with one word in nine changed, or some changed, left out and put in, nearly all have a row."""
    r, rows, kinds = random.Random(5), [], {}
    for i in range(120):
        x = prose(40_000 + i, 60).split()
        if i % 3 == 0:
            y = [w if j % 9 != 4 else f"new{j}" for j, w in enumerate(x)]
        elif i % 3 == 1:
            y = [f"new{j}" if r.random() < 0.15 else w for j, w in enumerate(x)]
        else:
            y = [v for j, w in enumerate(x) if (u := r.random()) >= 0.05 for v in ([w, f"new{j}"] if u < 0.1 else [w])]
        if similarity(x, y) >= 0.8:
            kinds[i] = i % 3
            rows += [(2 * i, " ".join([prose(50_000 + i, 40), *x, prose(60_000 + i, 40)])), (2 * i + 1, " ".join([prose(70_000 + i, 40), *y, prose(80_000 + i, 40)]))]
    got = passage_chains.fuzzy_passages(documents(spark, rows)).collect()
    assert all(r["doc_id"] // 2 == r["owner_id"] // 2 for r in got)
    found = {r["doc_id"] // 2 for r in got if r["start_word"] < 100 and r["start_word"] + r["n_words"] > 40}
    for kind in range(3):
        of = [i for i, k in kinds.items() if k == kind]
        assert len(of) >= 25 and len(found & set(of)) >= 0.9 * len(of), (kind, len(of), len(found & set(of)))


def edit(text, r, n):
    out = bytearray(text)
    for _ in range(n):
        p = r.randrange(len(out))
        kind = r.random()
        if kind < 0.4:
            out[p] = r.randrange(97, 123)
        elif kind < 0.7:
            del out[p]
        else:
            out.insert(p, r.randrange(97, 123))
    return bytes(out)


def brute_errors(pattern, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(pattern, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j - 1] + (c != d), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_windows_within_the_budget_are_found():
    r = random.Random(5)
    items = [(i, prose(i, n).encode()) for i, n in enumerate((12, 20, 30, 60, 90))]
    index = decontaminate.Index(items)
    texts = []
    for i, t in items:
        budget = int(len(decontaminate.windows(t)[0]) * decontaminate.RATE)
        texts += [decontaminate.normalised(prose(50 + i, 40).encode() + b" " + edit(t, r, n) + b" " + prose(60 + i, 40).encode()) for n in (0, budget // 2, budget)]
    texts.append(b"")
    found = index.matches(texts)
    for n, text in enumerate(texts):
        for at, (pattern, owner) in enumerate(zip(index.patterns, [next(iter(o)) for o in index.owners], strict=True)):
            errors = brute_errors(pattern, text)
            if errors <= index.budget[at]:
                assert owner in found[n] and found[n][owner][1] <= errors
        for owner, hit in found[n].items():
            mine = [p for p, o in zip(index.patterns, [next(iter(o)) for o in index.owners], strict=True) if o == owner]
            assert min(brute_errors(p, text) for p in mine) <= hit[1]


def test_leaks(spark):
    items = [(1, prose(1, 40)), (2, prose(2, 15)), (3, None), (4, ""), (5, "zq"), (2, prose(2, 15))]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    rows = EDGES + [(10, prose(9, 90)), (11, "A b " + prose(1, 40).upper().replace(" ", ",  ") + " c"), (12, prose(8, 3) + " " + prose(2, 15)), (13, "x zq. y"), (14, "xzqy"), (None, prose(2, 15))]
    got = decontaminate.find_leaks(documents(spark, rows), benchmark, block_bytes=200).select("doc_id", "item_id").distinct().collect()
    assert {tuple(r) for r in got} == {(11, 1), (12, 2), (13, 5), (None, 2)}
    kept = decontaminate.drop_leaks(documents(spark, rows), benchmark)
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter(i for i, _ in EDGES) + Counter([10, 14])
    assert decontaminate.find_leaks(documents(spark, []), benchmark).count() == 0
    assert decontaminate.find_leaks(documents(spark, rows), benchmark.limit(0)).count() == 0


def stems(n):
    """Items that share their first 60 characters."""
    stem = prose(77, 20)[:60]
    return stem, [(i, f"{stem} {prose(10_000 + i, 9)}".encode()) for i in range(n)]


def test_items_of_one_stem_equal_brute_force():
    """Sparing frequent q-grams and counting for groups changes no result."""
    stem, items = stems(90)
    items += [(200 + i, f"{prose(300 + i, 6)} {stem} {prose(400 + i, 4)}".encode()) for i in range(60)] + [(300, items[0][1]), (301, stem.encode())]
    r = random.Random(8)
    texts = []
    for i in range(0, 150, 15):
        budget = len(decontaminate.normalised(items[i][1])) // 10
        texts.append(decontaminate.normalised(prose(i, 20).encode() + b" " + edit(items[i][1], r, budget - i % 3) + b" " + stem.encode() * 3 + b" " + prose(500 + i, 8).encode()))
    plain, tight = decontaminate.Index(items, 1 << 30, 1 << 30), decontaminate.Index(items, 8, 4)
    assert len(tight.members) and (tight.need < tight.least).any()
    found = tight.matches(texts)
    assert found == plain.matches(texts)
    for text, hits in zip(texts[:3], found):
        for pattern, owners, k in zip(tight.patterns, tight.owners, tight.budget, strict=True):
            assert (brute_errors(pattern, text) <= k) == all(o in hits for o in owners)


def test_thousands_of_items_of_one_stem():
    stem, items = stems(5_000)
    index = decontaminate.Index(items)
    text = b" ".join([decontaminate.normalised((stem + " ").encode() + prose(i, 1).encode()) for i in range(150)] + [decontaminate.normalised(items[7][1])])
    began = time.process_time()
    found = index.matches([text])
    assert time.process_time() - began < 20
    assert list(found[0]) == [7]


def test_very_long_texts(spark):
    """A text of a megabyte among short ones, for the operators on passages and benchmark items."""
    body = prose(71_000, 160_000)
    piece = " ".join(body.split()[90_000:90_070])
    rows = [(1, body), (2, f"{prose(72_000, 50)} {piece} {prose(73_000, 50)}"), (3, None), (4, "")]
    got = passage_chains.fuzzy_passages(documents(spark, rows)).collect()
    assert {(r["doc_id"], r["owner_id"]) for r in got} == {(1, 2), (2, 1)} and all(r["n_words"] >= 70 for r in got)
    benchmark = spark.createDataFrame([(9, piece), (10, prose(74_000, 60)), (None, None)], "item_id long, text string")
    leaks = decontaminate.find_leaks(documents(spark, rows), benchmark).collect()
    assert sorted((r["doc_id"], r["item_id"], r["errors"]) for r in leaks) == [(1, 9, 0), (2, 9, 0)]


def test_an_owner_of_many_documents_is_shared_out(spark, monkeypatch):
    monkeypatch.setattr(passage_chains, "SHARE", 3)
    common = prose(75_000, 80)
    rows = [(i, f"{prose(76_000 + i, 30)} {common} {prose(77_000 + i, 30)}") for i in range(20)]
    shared = sorted(map(tuple, passage_chains.fuzzy_passages(documents(spark, rows)).collect()))
    assert {(r[0], r[3]) for r in shared} >= {(i, 0) for i in range(1, 20)} | {(i, 19) for i in range(19)}
    monkeypatch.setattr(passage_chains, "SHARE", 10**6)
    assert sorted(map(tuple, passage_chains.fuzzy_passages(documents(spark, rows)).collect())) == shared


def test_leaks_over_several_passes(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "PASS_BLOCKS", 2)
    items = [(i, prose(78_000 + i, 30)) for i in range(12)] + [(3, prose(78_003, 30))]
    rows = [(i, f"{prose(79_000 + i, 20)} {items[i][1]} {prose(79_500 + i, 20)}" if i % 2 else prose(79_000 + i, 60)) for i in range(12)]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = sorted((r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(documents(spark, rows), benchmark, block_bytes=300).collect())
    assert got == sorted([(i, i) for i in range(12) if i % 2] + [(3, 3)])
    kept = decontaminate.drop_leaks(documents(spark, rows), benchmark, block_bytes=300)
    assert sorted(r["doc_id"] for r in kept.collect()) == [0, 2, 4, 6, 8, 10]


def test_only_texts_and_passages_stay(spark):
    """What a step alone needs, shuffle files too, is gone when the step is over."""
    folder = Path(common.shared_dir(spark).removeprefix("file://"), "eventide")
    blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    moved = lambda: set(re.findall(r"shuffle_\d+_\d+_\d+\.data", blocks.getAllFiles().mkString(" ")))
    before, left = set(folder.glob("*")), moved()
    found = passage_chains.fuzzy_passages(documents(spark, [(i, prose(40 + i, 30) + " " + prose(9, 60) + " " + prose(60 + i, 30)) for i in range(5)]))
    until = time.time() + 20
    while moved() - left and time.time() < until:
        time.sleep(0.2)
    assert not moved() - left
    assert {re.match("[a-z]+", f.name)[0] for f in set(folder.glob("*")) - before} == {"texts", "passages"}
    #: The first and the last are each other's owners, and both are those of the three others.
    assert found.count() == 8


def test_a_table_in_buckets_is_joined_where_it_lies(spark):
    rows = spark.range(100).selectExpr("id", "id % 7 AS v")
    held = common.bucketed(rows, "id", "held")
    joined = held.hint("merge").join(rows.groupBy("id").count(), "id")
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and joined.count() == 100
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("held_")]
