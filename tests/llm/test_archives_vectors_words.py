import gzip
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from eventide.llm import spelling, warc, whitening

from .helpers import documents, prose

# ---- WARC ------------------------------------------------------------------------------------

PAGES = "page_id long, url string, html string, response string, capture_id string, kind string"
LONG = "<p>" + "x" * 120 + "</p>"
ODD = [
    (1, "http://a/1", LONG), (2, "http://a/2", LONG), (3, None, LONG), (None, "http://a/4", LONG), (4, "http://a/5?q=a b\r\nX: y", None), (5, "", ""), (6, "http://a/6", "short"), (7, "http://a/7", "short"),
    (8, "http://ü/日本", "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\nWARC/1.1\r\n" * 9), (9, "x", "\r\n\r\n\r\n" + "é" * 80 + "\r\n\r\n"), (10, "y", "\n\r" * 70), (1, "http://a/1", LONG), (11, "z", "日本語" * 200_000),
    (12, 'q"\\', "a\rb" * 50), (13, "u", "﻿" + "<html>" * 30),
]


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", "z") for r in rows], PAGES)


def brute_captures(rows):
    body = [(h or "").encode() for _, _, h in rows]
    groups = defaultdict(list)
    for (i, _, _), b in zip(rows, body):
        if len(b) >= 100:
            groups[b].append(i)
    out = []
    for (i, u, _), b in zip(rows, body):
        first = min((x for x in groups[b] if x is not None), default=None)
        again = first is not None and i != first
        out.append((i, u, len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", first if again else None))
    return Counter(out)


def archived(spark, rows, path):
    warc.write_archives(pages(spark, rows), path)
    return warc.read_records(spark, path)


def test_archives_round_trip(spark, tmp_path):
    path = f"file://{tmp_path}/w"
    records = archived(spark, ODD, path).persist()
    found = warc.resolved(warc.page_captures(warc.captures(records)))
    names = ("page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert Counter(tuple(r[n] for n in names) for r in found.collect()) == brute_captures(ODD)
    assert {r["intact"] for r in found.where("record_type = 'response'").collect()} == {True}
    ids = [r["record_id"] for r in records.collect()]
    assert len(ids) == len(set(ids)) == 3 * len(ODD)
    with_payload = {r["response"]["payload_digest"]: r["response"]["payload"] for r in warc.captures(warc.read_records(spark, path, True)).collect() if r["response"]["record_type"] == "response"}
    assert all(hashlib.sha256(bytes(p)).hexdigest() == d for d, p in with_payload.items())
    records.unpersist()


def test_archives_are_plain_warc(spark, tmp_path):
    """A reader that knows nothing but the format finds the same records."""
    archived(spark, ODD, f"file://{tmp_path}/w")
    kinds = Counter()
    for file in (tmp_path / "w").glob("part-*"):
        raw = gzip.decompress(file.read_bytes())
        while raw:
            head, _, raw = raw.partition(b"\r\n\r\n")
            lines = head.split(b"\r\n")
            fields = dict(line.split(b": ", 1) for line in lines[1:])
            n = int(fields[b"Content-Length"])
            assert lines[0] == b"WARC/1.1" and raw[n : n + 4] == b"\r\n\r\n"
            kinds[fields[b"WARC-Type"].decode()] += 1
            raw = raw[n + 4 :]
    assert kinds == {"response": len(ODD) - 3, "revisit": 3, "request": len(ODD), "metadata": len(ODD)}


def test_transactions_in_any_order(spark):
    """Links in either direction, over a request, to none, and to several records."""
    rows = [
        ("r1", "response", []), ("q1", "request", ["r1"]), ("m1", "metadata", ["r1"]), ("r2", "response", ["q2"]), ("q2", "request", []), ("m2", "metadata", ["q2"]), ("r3", "revisit", []), ("m3b", "metadata", ["r3"]), ("m3a", "metadata", ["r3", "r1"]),
        ("q9", "request", ["gone"]), ("r4", "response", []),
    ]
    full = [(i, k, c, "u", "d", "s", None, "h", {"n": i}, 1, "p", True) for i, k, c in rows]
    records = spark.createDataFrame(full, "record_id string, record_type string, concurrent_to array<string>, target_uri string, date string, stated_digest string, refers_to_uri string, http string, fields map<string,string>, payload_bytes long, payload_digest string, intact boolean")
    got = {r["capture_id"]: (r["request"] and r["request"]["record_id"], r["metadata"] and r["metadata"]["record_id"], r["n_requests"], r["n_metadata"]) for r in warc.captures(records).collect()}
    assert got == {"r1": ("q1", "m1", 1, 2), "r2": ("q2", "m2", 1, 1), "r3": (None, "m3b", 0, 1), "r4": (None, None, 0, 0)}


def test_no_pages_and_broken_archives(spark, tmp_path):
    assert archived(spark, [], f"file://{tmp_path}/none").count() == 0
    head = b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 9\r\n\r\n"
    for name, raw in {"cut": head + b"abc", "long": head + b"abcdefghij\r\n\r\n", "junk": b"abc\r\n"}.items():
        (tmp_path / f"{name}.gz").write_bytes(gzip.compress(raw))
        with pytest.raises(Exception, match="BrokenArchive"):
            warc.read_records(spark, f"file://{tmp_path}/{name}.gz").collect()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(max_size=60) | st.sampled_from([b"", b"\r\n", b"\r\n\r\n", b"WARC/1.1\r\n", b"a\r\n\r\nWARC/1.1"]), max_size=6))
def test_records_are_split_by_length(blocks):
    raw = b"".join(b"WARC/1.1\r\nWARC-Type: x\r\nContent-Length: %d\r\n\r\n%b\r\n\r\n" % (len(b), b) for b in blocks)
    lines = raw.split(b"\r\n")[:-1] if raw else []
    assert [b for _, b in warc.split_records((1, line) for line in lines)] == blocks


# ---- whitening -------------------------------------------------------------------------------

VECTORS = "vec_id long, embedding array<float>, label int, x double, component string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1, 0.5, "c") for i, v in rows], VECTORS)


def brute_whitening(rows, k=4):
    good = [(i, v) for i, v in rows if v and all(c is not None and np.isfinite(c) for c in v)]
    x = np.floor(256 * np.array([v for _, v in good], np.float32).astype(float)).astype(np.int64)
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(0)
    centred = fit - s / n
    cov = centred.T @ centred / n
    e, u = np.linalg.eigh(cov)
    at = np.argsort(-e)[:k]
    return [i for i, _ in good], n, ((n * x - s) ** 2).sum(1), (x - s / n) @ (u[:, at] / np.sqrt(e[at])), e[at] / np.trace(cov)


def test_whitening(spark):
    r = np.random.default_rng(3)
    rows = [(int(i), [float(c) for c in r.normal(0, 1 + np.arange(7) / 3)]) for i in range(300)]
    rows += [(1000 + i, rows[5][1]) for i in range(90)] + [(5, rows[5][1]), (None, rows[6][1]), (2000, None), (2001, [None] * 7), (2002, [float("nan")] + [0.0] * 6), (2003, [float("inf")] * 7), (2004, []), (2005, [1.0, 2.0])]
    got = whitening.whiten(vectors(spark, rows)).collect()
    ids, n, deviation, white, explained = brute_whitening([(i, v) for i, v in rows if v is None or len(v) == 7])
    by = defaultdict(list)
    for g in got:
        assert (g["n"], g["identity_error"] < 1e-9) == (n, True) and abs(g["explained"] - explained[g["component"] - 1]) < 1e-9
        by[g["component"]].append((-1 if g["vec_id"] is None else g["vec_id"], g["deviation"], g["whitened"]))
    key = [-1 if i is None else i for i in ids]
    assert sorted(by) == [1, 2, 3, 4]
    for c, found in by.items():
        want = sorted(zip(key, deviation.tolist(), white[:, c - 1].tolist()))
        found.sort()
        assert [f[:2] for f in found] == [w[:2] for w in want]
        a, b = np.array([f[2] for f in found]), np.array([w[2] for w in want])
        assert min(np.abs(a - b).max(), np.abs(a + b).max()) < 1e-9


def test_whitening_of_little(spark):
    assert whitening.whiten(vectors(spark, [])).count() == 0
    one = whitening.whiten(vectors(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect()
    assert sorted((r["vec_id"], r["component"], r["n"], r["deviation"], r["whitened"], r["explained"]) for r in one) == [(i, c, 1, 0, None, None) for i in (1, 2) for c in (1, 2)]
    line = whitening.whiten(vectors(spark, [(i, [float(i), 2.0 * i, 0.0]) for i in range(5)])).where("vec_id = 4").collect()
    assert [r["whitened"] is None for r in sorted(line, key=lambda r: r["component"])] == [False, True, True]
    huge = whitening.whiten(vectors(spark, [(1, [1e30, 0.0]), (2, [0.0, 1.0])])).collect()
    assert {r["deviation"] for r in huge} == {None}


@pytest.mark.parametrize("values", [[9.0, 4.0, 1.0, 0.5], [5.0, 5.0, 5.0, 1.0], [3.0, 3.0 + 1e-9, 3.0 - 1e-9, 2.0, 2.0 + 1e-12], [1e6, 1.0, 1e-6], [2.0] * 6, list(1 + np.arange(40) / 1e7), list(np.arange(60.0) // 3)])
def test_eigenvectors_are_refined_to_double_precision(values):
    r = np.random.default_rng(len(values))
    q, _ = np.linalg.qr(r.normal(size=(len(values), len(values))))
    a = q @ np.diag(values) @ q.T
    a = (a + a.T) / 2
    e, x = whitening.eigenvectors(a)
    assert np.abs(e - np.sort(values)[::-1]).max() <= 1e-12 * max(values)
    assert np.abs(x.T @ x - np.eye(len(values))).max() < 1e-13 and np.abs(a @ x - x * e).max() < 2e-13 * max(values)


def test_sums_and_covariance_by_parts(spark):
    r = np.random.default_rng(1)
    x = r.integers(-(2**40), 2**40, (500, 70))
    fit = spark.createDataFrame([(v.tolist(),) for v in x], "x array<long>").repartition(7)
    n, sums = whitening.exact_sums(fit, 70)
    assert (n, sums) == (500, x.sum(0).tolist())
    mean = x.mean(0)
    got = whitening.covariance(fit, "x", 70, n, lambda c: whitening._matrix(c, 70) - mean)
    want = np.cov(x.T, bias=True)
    assert np.abs(got - want).max() < 1e-12 * np.abs(want).max()


# ---- spelling --------------------------------------------------------------------------------

_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def edited_once(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = (a, b) if len(a) > len(b) else (b, a)
    return len(a) - len(b) == 1 and any(a[:i] + a[i + 1 :] == b for i in range(len(a)))


def brute_spelling(rows):
    counts = Counter()
    for i, text in rows:
        for word in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = word.translate(_LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{word}".encode())
            if h % 97 == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            counts[word] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}
    near = {w: [v for v in words if edited_once(w, v)] for w in words}
    best = {w: min(near[w], key=lambda v: (-words[v], v), default=None) for w in words}
    form = {w: b if b is not None and words[b] >= 2 * words[w] else None for w, b in best.items()}

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return Counter((w, form[w], root(w), n, len(near[w]), words[form[w]] if form[w] else None) for w, n in words.items())


def variants(spark, rows):
    got = spelling.spelling_variants(documents(spark, rows)).collect()
    return Counter(tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in got)


def spelled(seed=8):
    r, rows = random.Random(seed), []
    base = prose(seed, 60).split() + ["straße", "ÀÉÎõü", "naïveté", "×÷×÷×", "aaaaa", "aaaaaa", "aabaa", "zz" * 3_000]
    for i in range(160):
        words = []
        for _ in range(40):
            w = r.choice(base)
            for _ in range(r.choice([0, 0, 0, 1, 2])):
                p = r.randrange(len(w))
                w = r.choice([w[:p] + w[p + 1 :], w[:p] + r.choice("abé") + w[p:], w[:p] + r.choice("abÉ") + w[p + 1 :]]) or "q"
            words += [w if r.random() < 0.8 else w.upper()] * r.choice([1, 1, 3])
        rows.append((i, r.choice([" ", "-", "1", "日", "\n"]).join(words)))
    return rows + [(None, "Hello hello HELLO helo, hellö hallo " * 9), (7, None), (8, ""), (9, "helo " * 40), (9, "helo " * 40)]


def test_spelling_variants(spark):
    rows = spelled()
    assert variants(spark, rows) == brute_spelling(rows)
    assert variants(spark, []) == Counter()


def test_forms_lead_to_a_root_over_several_steps(spark):
    chain = ["abcde", "abcdf", "abcgf", "abhgf", "aihgf", "jihgf"]
    rows = [(1000 + i, f"{w} " * (3 << i)) for i, w in enumerate(chain)]
    got = {r[0]: (r[1], r[2]) for r in variants(spark, rows)}
    assert variants(spark, rows) == brute_spelling(rows) and got["abcde"] == ("abcdf", "jihgf") and got["jihgf"] == (None, "jihgf")


def test_several_rounds_of_small_filters(spark, monkeypatch):
    """What the filters hold and how it is cut into rounds changes nothing, nor does a filter full of false positives."""
    rows = spelled(9)
    want = brute_spelling(rows)
    monkeypatch.setattr(spelling, "FILTER_BLOCKS", 4)
    monkeypatch.setattr(spelling, "PROBES", 64)
    assert variants(spark, rows) == want
    monkeypatch.setattr(spelling, "FILTER_BLOCKS", 1 << 20)
    monkeypatch.setattr(spelling, "BITS", 1)
    assert variants(spark, rows) == want


def test_every_pair_comes_from_one_word_once(spark):
    words = ["aabbb", "aabb", "abbb", "abab", "aab", "baabb", "zaabb", "aazbb", "aabbz", "azbb", "x" * 30, "x" * 29]
    codes = spark.createDataFrame([(w.encode("latin-1"), 5) for w in words], "code binary, n long")
    scratch = spelling.Scratch()
    pairs = [tuple(sorted((bytes(r["code"]).decode(), bytes(r["near"]).decode()))) for p in spelling.near_pairs(codes, scratch) for r in p.collect()]
    assert sorted(pairs) == sorted((a, b) for a in words for b in words if a < b and edited_once(a, b))
    assert codes.where(F.length("code") > 0).count() == len(words)
