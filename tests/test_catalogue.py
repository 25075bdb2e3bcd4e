import random
import re
import time
from datetime import date, datetime, timezone

import pytest
from pyspark.sql import functions as F

from eventide.functions import clock
from eventide.operators import feed, predicates, search, state
from eventide.operators.ordering import numbered, running_sum
from eventide.plans.schemas import PLANS

NOW = datetime(2026, 8, 17, 12, tzinfo=timezone.utc)
FIELDS = [f.split()[0] for f in PLANS.split(", ")]


def plans(spark, *rows):
    base = {"kind": "event", "status": "active", "quality_score": 80, "permanent": 0, "featured": 0, "image_reuse_allowed": 0}
    full = [base | {"id": i, "fingerprint": f"f{i}", "original_title": f"t{i}", "title_ca": f"t{i}"} | r for i, r in enumerate(rows, 1)]
    return spark.createDataFrame([tuple(r.get(f) for f in FIELDS) for r in full], PLANS)


def ids(df):
    return [r["id"] for r in df.select("id").collect()]


def test_clock():
    assert clock.retention_cutoff(NOW, 90) == "2026-05-19"
    assert clock.retention_cutoff(NOW) == "2026-08-17"
    assert clock.horizon(datetime(2026, 8, 18, 10, tzinfo=timezone.utc)) == ("2026-08-18", "2026-11-16")
    assert clock.local_date(datetime(2026, 8, 17, 23, tzinfo=timezone.utc)) == date(2026, 8, 18)
    assert clock.inactive_cutoff(NOW) == "2026-08-10T12:00:00.000Z"
    for day, span in ((20, (21, 23)), (21, (21, 23)), (22, (22, 23)), (23, (23, 23))):
        assert clock.quick_range("weekend", date(2026, 8, day)) == tuple(f"2026-08-{d}" for d in span)


@pytest.mark.parametrize(
    ("row", "issue"),
    [
        ({"start_date": "2024-01-01", "end_date": "2924-01-01"}, "EXTREME_FUTURE_DATE"),
        ({"start_date": "2026-02-02", "end_date": "2026-02-01"}, "END_BEFORE_START"),
        ({"start_date": "2016-02-29", "end_date": "2026-03-01"}, None),
        ({"start_date": "2016-02-29", "end_date": "2026-03-02"}, "EVENT_DURATION_EXCEEDS_10_YEARS"),
        ({"start_date": "2026-01-01", "end_date": "2036-01-01"}, None),
        ({"start_date": "2026-02-30"}, "INVALID_DATE_FORMAT"),
        ({"start_date": "2026-8-1"}, "INVALID_DATE_FORMAT"),
        ({"start_date": "2026-01-01", "end_date": ""}, "INVALID_DATE_FORMAT"),
        ({"start_date": "x", "permanent": 1}, None),
        ({"start_date": "x", "kind": "place"}, None),
        ({}, None),
    ],
)
def test_coherence(spark, row, issue):
    assert plans(spark, row).select(predicates.coherence_issue(2026).alias("x")).first()["x"] == issue


def test_visibility(spark):
    rows = plans(
        spark, {"start_date": "2026-08-20", "end_date": "2026-08-20"}, {"quality_score": 34}, {"start_date": "2026-08-16"}, {"start_date": "2026-08-16", "permanent": 1},
        {"province": "Fora d'Espanya"}, {"comarca": "Fuera de Cataluña"}, {"locality": "outside of Spain"}, {"municipality": "Sant Fora"}, {"status": "cancelled"}, {"end_date": "2026-08-17"},
    )
    assert sorted(ids(rows.where(predicates.visible(NOW)))) == [1, 4, 8, 10]


def test_search_filters_and_orders(spark):
    rows = plans(
        spark, {"start_date": "2026-08-20", "end_date": "2026-08-22", "municipality": "Cadaqués", "is_free": 1}, {"permanent": 1, "municipality": "cadaques"}, {"start_date": "2026-08-19", "end_date": "2026-08-20", "is_free": 0, "venue_name": "Teatre Àgora"},
    )
    find = lambda **q: search.matching(rows, search.parse_filters(q), NOW)
    assert sorted(ids(find(municipality="CADAQUÉS"))) == [1, 2]
    assert ids(find(free="false")) == [3]
    assert ids(find(q="agora")) == [3]
    assert ids(find(q="' OR 1=1 --")) == []
    f = search.parse_filters({"date": "2026-08-20"})
    assert ids(search.page(find(date="2026-08-20"), f)) == [1, 3, 2]
    f = search.parse_filters({"page": "2", "limit": "1"})
    assert search.envelope(find(), f).first().asDict() == {"page": 2, "limit": 1, "total": 3, "pages": 3}
    assert ids(search.page(find(), f)) == [1]
    weekend = {"editorial": "home-weekend", "dateFrom": "2026-08-20", "dateTo": "2026-08-22"}
    assert ids(search.page(find(**weekend), search.parse_filters(weekend))) == [1, 3, 2]


@pytest.mark.parametrize(
    "query",
    [
        {"page": "201"}, {"limit": "101"}, {"date": "2026-02-30"}, {"free": "yes"}, {"foo": "1"}, {"lang": "en"}, {"province": " "}, {"q": "x" * 101}, {"kind": ["a", "b"]},
        {"date": "2026-01-01", "dateFrom": "2026-01-01"}, {"dateFrom": "2026-02-01", "dateTo": "2026-01-01"}, {"editorial": "home-weekend"}, {"sort": "rand"},
    ],
)
def test_invalid_queries(query):
    with pytest.raises(search.InvalidQuery):
        search.parse_filters(query)


def test_filter_codec():
    assert search.parse_filters({"q": "  ", "category": "a,b,a"}).categories == ("a", "b")
    assert search.shared_filters({"q": "x", "free": "false", "page": "2", "date": ""}) == {"q": "x"}


def sessions(spark, rows):
    schema = "pos long, event_id string, title string, venue_id string, venue_name string, municipality string, start_date string, end_date string, start_time string"
    return spark.createDataFrame([(i, f"e{i}", t, "", v, "Girona", d, d, h) for i, (t, v, d, h) in enumerate(rows)], schema)


def test_recurring_inventory(spark):
    day = lambda i: f"2026-09-{i:02d}"
    many = [("Visita", "Sala", day(i), f"{h}:00") for i in range(1, 31) for h in range(10, 14)]
    few = [("Altra", "Sala", day(i), "10:00") for i in range(1, 31)]
    rows = sessions(spark, many + few)
    found = feed.recurring_inventory(rows)
    assert [(r["sessions"], r["active_days"]) for r in found.collect()] == [(120, 30)]
    assert feed.without_recurring(rows, found).count() == 30


def test_sessions_and_variants(spark):
    rows = sessions(spark, [("Concert", "Sala", "2026-09-01", "20:00"), ("El Concert", "sala", "2026-09-01", "18:00"), ("Concert | Paquetes VIP", "Sala", "2026-09-01", "20:00"), ("Concert | Paquete VIP", "Sala", "2026-09-01", "21:00"), ("Upgrade Concert", "Sala", "2026-09-01", "09:00"), ("Upgradexx Concert", "Sala", "2026-09-01", "09:00"), ("Meet & Greet Nobody", "Sala", "2026-09-01", "09:00")])
    one = feed.daily_sessions(rows).where("title_k = 'concert'").first()
    assert (one["hours"], one["records"], one["first_pos"]) == (["18:00", "20:00"], 2, 0)
    assert {(r["event_id"], r["type"], r["main_event_id"]) for r in feed.product_variants(rows).collect()} == {("e2", "PACKAGE_VARIANT", "e0"), ("e4", "PRODUCT_VARIANT", "e0")}


def test_variants_of_a_crowded_place(spark):
    """20,000 add-ons and 20,000 main events of one place and day: no add-on meets all events."""
    rows = spark.range(40_000, numPartitions=4).select(
        F.col("id").alias("pos"), F.concat(F.lit("e"), "id").alias("event_id"), F.when(F.col("id") % 2 == 0, "Upgrade Concert").otherwise(F.concat(F.lit("Concert "), (F.col("id") % 20).cast("string"))).alias("title"),
        F.lit("").alias("venue_id"), F.lit("Sala").alias("venue_name"), F.lit("Girona").alias("municipality"), F.lit("2026-09-01").alias("start_date"), F.lit("2026-09-01").alias("end_date"), F.lit("20:00").alias("start_time"),
    )
    began = time.monotonic()
    found = {(r["event_id"], r["main_event_id"]) for r in feed.product_variants(rows).collect()}
    assert found == {(f"e{i}", "e1" if i == 0 else "e0") for i in range(0, 40_000, 2)}
    assert time.monotonic() - began < 30


def test_variants_equal_brute_force(spark):
    r = random.Random(3)
    titles = ["Concert", "Concert Gran", "Ball", "Upgrade Concert", "Upgrade Upgrade Concert", "Upgrade Ball", "Ball | Paquetes VIP", "Upgrade Concert | Paquete VIP", "Upgrade", "Gran", " | Paquetes VIP"]
    made = [(r.choice(titles), r.choice(["Sala", "Teatre", ""]), r.choice(["2026-09-01", "2026-09-02", None]), r.choice(["20:00", "", None])) for _ in range(150)]
    title_k = lambda t: "-".join(re.findall("[a-z0-9]+", t.lower()))
    want = set()
    for i, (title, *place, hour) in enumerate(made):
        mains = [(j, title_k(t), h) for j, (t, *p, h) in enumerate(made) if p == place and p[0] and j != i]
        package = title_k(re.sub(r"(?i)\s*\|\s*paquetes?\s+vip\s*$", "", title))
        base = title_k(title.replace("Upgrade", " ")) if title.startswith("Upgrade") else ""
        hits = [("PACKAGE_VARIANT", j) for j, k, h in mains if "VIP" in title and h == hour and k == package]
        hits += [("PRODUCT_VARIANT", j) for j, k, _ in mains if base and (k in base or base in k)]
        want |= {(f"e{i}", kind, f"e{j}") for kind, j in sorted(hits)[:1]}
    assert {tuple(x) for x in feed.product_variants(sessions(spark, made)).collect()} == want and len(want) > 30


@pytest.mark.parametrize(
    ("start", "end", "expected"),
    [("2026-08-18", "2026-08-18", "accepted"), ("2026-08-01", "2026-08-18", "accepted"), ("2026-08-01", "2026-08-17", "out"), ("2026-11-16", None, "accepted"), ("2026-11-17", None, "out"), ("x", None, "invalid"), ("2026-09-02", "2026-09-01", "invalid")],
)
def test_horizon(spark, start, end, expected):
    row = spark.createDataFrame([(start, end)], "start_date string, end_date string")
    assert row.select(feed.horizon_class("2026-08-18", "2026-11-16").alias("x")).first()["x"] == expected


@pytest.mark.parametrize(
    ("country", "state_", "postal", "lat", "lon", "confirmed"),
    [("es", "Gerona", None, "42", "2.5", True), ("ES", None, "08001", "41.4", "2.1", True), ("ES", "Girona", None, None, None, False), ("ES", "Girona", None, "x", "2", True), ("FR", "Girona", None, "42", "2.5", False), ("ES", "Madrid", "28001", "42", "2", False), ("ES", "Girona", None, "50", "2", False)],
)
def test_territory(spark, country, state_, postal, lat, lon, confirmed):
    row = spark.createDataFrame([(country, state_, postal, lat, lon)], "a string, b string, c string, d string, e string")
    assert row.select(feed.territory(*(F.col(x) for x in "abcde")).alias("p")).first()["p"]["confirmed"] is confirmed


LINK = "id long, plan_id long, source_id long, source_record_id string, source_url string, source_created_at string, source_updated_at string, source_payload_json string, imported_at string, last_seen_at string"


def links(spark, *rows):
    return spark.createDataFrame([(i, p, s, r, None, None, None, v, "t0", "t0") for i, (p, s, r, v) in enumerate(rows, 1)], LINK)


def test_upsert_is_idempotent(spark):
    known, provenance = plans(spark, {"fingerprint": "a"}, {"fingerprint": "b", "status": "inactive"}), links(spark, (1, 1, "r1", "p1"))
    batch = spark.createDataFrame([(1, "r1", "a", "p1"), (2, "r2", "b", "p2"), (3, "r3", "c", "p3"), (4, "r4", "c", "p4"), (5, "r3", "c", "p3")], "pos long, record_id string, fingerprint string, payload string")
    rows = state.upsert_outcomes(batch, provenance, known, 1)
    assert [(r["outcome"], r["plan_id"]) for r in rows.orderBy("pos").collect()] == [("skipped", 1), ("updated", 2), ("inserted", 3), ("updated", 3), ("skipped", 3)]
    after = state.merge_provenance(provenance, rows, 1, "t1")
    assert after.count() == 4 and after.select("id").distinct().count() == 4
    new = plans(spark, {"fingerprint": "a"}, {"fingerprint": "b"}, {"fingerprint": "c"})
    again = state.upsert_outcomes(batch, after, new, 1)
    assert {r["outcome"] for r in again.collect()} == {"skipped"}


def test_fill_overwrite_and_reactivate(spark):
    stored = plans(spark, {"title_es": None, "status": "inactive", "inactive_at": "x", "quality_score": 40}, {"status": "cancelled"})
    folded = state.fold_fills(plans(spark, {"title_es": "uno", "quality_score": 30}, {"id": 1, "title_es": "dos", "quality_score": 50}), "id", "original_title", ["title_es"])
    row = state.fill(stored, folded, "now").orderBy("id").first()
    assert (row["title_es"], row["quality_score"], row["status"], row["inactive_at"]) == ("uno", 50, "active", None)
    assert [r["status"] for r in state.reactivate(stored, stored.select("id"), "now").orderBy("id").collect()] == ["active", "cancelled"]
    changed = plans(spark, {"title_es": None, "original_title": "new", "fingerprint": "other"}).select("id", "title_es", "original_title", "status", "fingerprint")
    row = state.overwrite(stored, changed, "now").orderBy("id").first()
    assert (row["original_title"], row["fingerprint"], row["inactive_at"]) == ("new", "f1", None)


def test_removal(spark):
    st = {"plans": plans(spark, {}, {}), "plan_sources": links(spark, (1, 7, "a", ""), (2, 7, "b", ""), (2, 8, "c", "")), "plan_categories": spark.createDataFrame([(1, 1), (2, 1)], "plan_id long, category_id long")}
    assert state.remove_event(st, 7, "zz", "now")[1] == "not-found"
    after, result = state.remove_event(st, 7, "a", "now", purge_plan=True)
    assert result == "purged" and ids(after["plans"]) == [2] and after["plan_categories"].count() == 1
    same, result = state.remove_event(st, 7, "a", "now", purge_plan=True, dry_run=True)
    assert result == "purged" and same is st
    after, result = state.remove_event(st, 7, "b", "now", purge_plan=True)
    assert result == "removed" and [r["status"] for r in after["plans"].orderBy("id").collect()] == ["active", "active"]
    after, _ = state.remove_event(st, 7, "a", "now")
    assert [r["status"] for r in after["plans"].orderBy("id").collect()] == ["inactive", "active"]


def test_inactive_audit(spark):
    at = lambda d: f"2026-08-{d:02d}T12:00:00.000Z"
    rows = plans(spark, *({"status": "inactive", "inactive_at": x} for x in (at(9), at(10), at(11), None)), {})
    audit = state.inactive_audit(rows, links(spark, (4, 1, "x", "")), NOW).orderBy("id").collect()
    assert [(r["reason"], r["days"]) for r in audit] == [("eligible", 8), ("eligible", 7), ("too-recent", 6), ("has-source", None)]


def test_images_and_cache(spark):
    schema = "o long, url string, ratio string, width int, height int, is_fallback int"
    rows = [(1, "http://a/x", "16_9", 640, 360, 0), (1, "https://a/big", "16_9", 2049, 100, 0), (1, "https://a/fall", "16_9", 640, 360, 1), (1, "https://a/good", "16_9", 1024, 576, 0), (1, "https://a/square", "1_1", 640, 360, 0)]
    best = state.best_image_per_role(spark.createDataFrame(rows, schema), "o").collect()
    assert {(r["role"], r["url"]) for r in best} == {("card", "https://a/good"), ("detail", "https://a/good")}
    files = spark.createDataFrame([(1, 10, "2026-01-02T00:00:00"), (2, 10, "2026-01-01T00:00:00"), (3, 5, "2025-01-01T00:00:00"), (4, 5, "2026-01-01T00:00:00")], "image_id long, size long, fetched_at string")
    valid = spark.createDataFrame([(1,), (2,), (3,)], "image_id long")
    got = {r["image_id"]: r["action"] for r in state.cache_evictions(files, "2026-01-02T01:00:00", 48, 15, valid).collect()}
    assert got == {1: "kept", 2: "evicted", 3: "expired", 4: "orphan"}


def test_the_least_id_decides_between_equal_images(spark):
    rows = [(i, 1, "https://i.example/a", "4_3", 640, h, 0) for i, h in ((9, 400), (3, 320), (5, 320), (4, 400))]
    images = spark.createDataFrame(rows, "id long, o long, url string, ratio string, width int, height int, is_fallback int").repartition(1, "o")
    for order in ("id", "-id"):
        best = state.best_image_per_role(images.sortWithinPartitions(F.expr(order)), "o").where("role = 'card'").collect()
        assert [r["id"] for r in best] == [3]


def test_numbers_and_running_sums_lose_no_row(spark):
    """Bounds of range partitions come from small samples, so two readings would have different ones."""
    rows = spark.range(20_000, numPartitions=4).select(F.col("id").alias("pos"), F.lit(1).alias("one"), F.repeat(F.sha2(F.col("id").cast("string"), 256), 8).alias("text"))
    changed = {"spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.execution.rangeExchange.sampleSizePerPartition": "4"}
    before = {n: spark.conf.get(n, None) for n in changed}
    try:
        for name, value in changed.items():
            spark.conf.set(name, value)
        made = numbered(rows, 5, "pos").agg(F.count("*"), F.count_if(F.col("id") != F.col("pos") + 6), F.max(F.length("text"))).first()
        summed = running_sum(rows, "one", [F.col("pos")], "sum").agg(F.count("*"), F.count_if(F.col("sum") != F.col("pos") + 1), F.max(F.length("text"))).first()
    finally:
        for name, value in before.items():
            spark.conf.set(name, value) if value else spark.conf.unset(name)
    assert tuple(made) == (20_000, 0, 512) and tuple(summed) == (20_000, 0, 512)
